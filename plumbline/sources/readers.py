"""Readers of tasks, results, logs and training data."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline import schemas
from plumbline.functions.text import instance_key
from plumbline.operators import difficulty


def _missing(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def tasks(raw: DataFrame, limit: int | None = None, verified: DataFrame | None = None, errors: bool = False) -> DataFrame:
    """Task rows of raw ones (schemas.TASKS_RAW): test lists from JSON (both empty if either doesn't parse), missing patches
    as ''; limit takes the first by ordinal; verified: a table of ids that are, else none is; errors: also a column error that
    names the list that doesn't parse."""
    if limit is not None:
        raw = raw.orderBy("ordinal").limit(limit)
    lists = [F.from_json(c, "array<string>") for c in ("FAIL_TO_PASS", "PASS_TO_PASS")]
    bad = lists[0].isNull() | lists[1].isNull()
    none = F.array().cast("array<string>")
    out = raw.select("instance_id", "repo", F.coalesce("problem_statement", F.lit("")).alias("problem_statement"), F.coalesce("test_patch", F.lit("")).alias("test_patch"), F.coalesce("patch", F.lit("")).alias("gold_patch"), F.when(bad, none).otherwise(lists[0]).alias("fail_to_pass"), F.when(bad, none).otherwise(lists[1]).alias("pass_to_pass"), "difficulty", *([F.when(lists[0].isNull(), "FAIL_TO_PASS is no list").when(lists[1].isNull(), "PASS_TO_PASS is no list").alias("error")] if errors else []))
    if verified is None:
        return out.withColumn("is_verified", F.lit(False))
    ids = verified.select("instance_id").distinct().withColumn("is_verified", F.lit(True))
    return out.join(ids, "instance_id", "left").withColumn("is_verified", F.coalesce("is_verified", F.lit(False)))


def verified_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of a table in which every task is verified."""
    return tasks(raw, limit).withColumn("is_verified", F.lit(True))


def gold_patches(raw: DataFrame, limit: int | None = None) -> DataFrame:
    if limit is not None:
        raw = raw.orderBy("ordinal").limit(limit)
    return raw.select("instance_id", "patch")


#: Of a record that doesn't parse, so many characters are shown.
SHOWN = 200


def _json(spark: SparkSession, path: str, schema: str, errors: bool, lines: bool) -> DataFrame:
    if not errors:
        return spark.read.schema(schema).json(path, multiLine=not lines)
    # parsed as text, as the JSON reader keeps no file's name with what it can't parse
    raw = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"))
    names = StructType.fromDDL(schema).names
    what = F.concat(F.col("file"), F.lit(": not of the schema: "), F.substring("value", 1, SHOWN))
    if lines:
        parsed = raw.select("value", "file", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
        bad = F.col("r._bad").isNotNull()
    else:
        fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)
        parsed = raw.select("value", "file", F.explode_outer(F.from_json("value", f"array<struct<{fields}>>")).alias("r"))
        bad = F.col("r").isNull() & ~F.trim("value").rlike(r"^\[\s*\]$")
    return parsed.select(*(F.when(~bad, F.col("r")[n]).alias(n) for n in names), F.when(bad, what).alias("error"))


def json_array(spark: SparkSession, path: str, schema: str = schemas.PHASE1, errors: bool = False) -> DataFrame:
    """Files that hold one JSON array (or one object) each; errors: files that don't parse are rows with a column error."""
    return _json(spark, path, schema, errors, lines=False)


def routed(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one (only what there is to tell of them); agents.rejected() makes results of these."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def per_task(report: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row a task of a report whose per_task maps ids to structs."""
    return report.select(F.explode("per_task").alias(key, "v")).select(key, "v.*")


def json_lines(spark: SparkSession, path: str, schema: str = schemas.TRAINING, errors: bool = False) -> DataFrame:
    """A JSON row a line; blank lines are skipped; errors: lines that don't parse are rows with a column error."""
    return _json(spark, path, schema, errors, lines=True)


def _scanned(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, content, error) of a folder's files: content is null, and error says why, of files that aren't UTF-8 or can't be read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    found = read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    good = found.select("path", text.alias("content"), F.when(text.isNull(), "not UTF-8").alias("error"))
    # names alone don't open files, so what can't be read is what is named and not found
    lost = read.load(folder).select("path").join(found.select("path"), "path", "left_anti")
    return good.unionByName(lost.select("path", F.lit(None).cast("string").alias("content"), F.lit("can't be read").alias("error")))


def _empty(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of a folder's empty files, which Spark's readers pass over."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)
    return [n for f in found if f.getLen() == 0 and f.isFile() and (n := f.getPath().getName()).endswith(suffix) and n[0] not in "._"]


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def log_files(spark: SparkSession, folder: str, errors: bool = False) -> DataFrame:
    """(key, content) of every .log file of a folder; empty without the folder. A file that can't be read or decoded is skipped, or,
    with errors, a row without content and with a column error."""
    if _missing(spark, folder):
        return spark.createDataFrame([], "key string, content string" + (", error string" if errors else ""))
    rows = _scanned(spark, folder, "*.log").select(F.regexp_replace(_name(F.col("path")), r"\.log$", "").alias("key"), "content", "error")
    if empty := _empty(spark, folder, ".log"):
        rows = rows.unionByName(spark.createDataFrame([(n.removesuffix(".log"), "", None) for n in empty], "key string, content string, error string"))
    return rows if errors else rows.where("error is null").drop("error")


def skipped_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(error, n): how many files log_files() leaves out, and why."""
    return log_files(spark, folder, errors=True).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


#: Fixed value: what a harness prints for a passing exploit.
RESOLVED = "Instances resolved: 1"


def resolved_logs(logs: DataFrame) -> DataFrame:
    """(key, resolved)."""
    return logs.select("key", F.col("content").contains(RESOLVED).alias("resolved"))


def split_key(key: Column) -> tuple[Column, Column]:
    """Task and index of a key like <task>_exploit_<n>; null if it isn't one."""
    pattern = r"(?s)^(.*)_exploit_(\d+)$"
    return F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(key, pattern, 2), F.lit("")).cast("int")


def log_results(logs: DataFrame) -> DataFrame:
    """(instance_id, idx, passed) of the logs whose names have an index."""
    task, idx = split_key(F.col("key"))
    return resolved_logs(logs).select(task.alias("instance_id"), idx.alias("idx"), F.col("resolved").alias("passed")).where("idx is not null")


def passed_lists(logs: DataFrame) -> DataFrame:
    """(instance_id, passed array): the indexes that passed, sorted."""
    return log_results(logs).where("passed").groupBy("instance_id").agg(F.sort_array(F.collect_list("idx")).alias("passed"))


def log_details(logs: DataFrame) -> DataFrame:
    """(instance_id, exploit_index, verified, has_error, key): four ways in which a log may say that its task is resolved."""
    pattern = r"(?s)^(.*)_exploit_(.*)$"
    split = F.col("key").rlike(pattern)
    task = F.when(split, instance_key(F.regexp_extract("key", pattern, 1))).otherwise(F.col("key"))
    text = F.col("content")
    named = text.contains(task)
    line = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    stated = F.exists(line, lambda s: s.startswith("{") & F.lower(s).contains("resolved") & F.coalesce(F.try_variant_get(F.try_parse_json(s), "$.resolved", "string").contains(task), F.lit(False)))
    same_line = F.exists(F.split(F.lower(text), "\n"), lambda s: F.rlike(s, F.concat(F.lit(r"resolved.*\Q"), F.lower(task), F.lit(r"\E"))))
    done = same_line | (text.contains("✓") & named) | stated | (named & text.contains("RESOLVED"))
    error = text.contains("Error") | (F.lower(text).contains("error") & ~F.lower(text).contains("exit_code"))
    return logs.select(task.alias("instance_id"), F.when(split, F.regexp_extract("key", pattern, 2)).otherwise("0").alias("exploit_index"), done.alias("verified"), error.alias("has_error"), "key")


def stated_resolved(report: Column, instance_id: Column) -> Column:
    """Whether a harness's JSON report (text) has the task as resolved, in any of its shapes; false if it doesn't parse."""
    v = F.try_parse_json(report)
    listed = [F.coalesce(F.array_contains(F.try_variant_get(v, p, "array<string>"), instance_id), F.lit(False)) for p in ("$.resolved", "$.resolved_instances")]
    entry = F.from_json(report, "map<string, string>")[instance_id]
    return listed[0] | listed[1] | F.coalesce(F.get_json_object(entry, "$.resolved") == "true", F.lit(False))


def harness_result(report: Column, instance_id: Column, log: Column) -> Column:
    """Whether the report has the task as resolved, or else the log names it along with RESOLVED."""
    return stated_resolved(report, instance_id) | F.coalesce(log.contains(instance_id) & log.contains("RESOLVED"), F.lit(False))


def harness_results(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """(run_id, instance_id, resolved, n_files) of runs (run_id, instance_id), whose files lie anywhere below folder/run_id: a report is
    a .json file with the run's name in its own, a log any .log file. All files are found and read in one scan; those that
    can't be read count for nothing; a run without files, or a missing folder, has resolved nothing."""
    if _missing(spark, folder):
        return runs.select("run_id", "instance_id", F.lit(False).alias("resolved"), F.lit(0).cast("long").alias("n_files"))
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    below = F.regexp_extract(F.replace(path, F.lit(root), F.lit("\n")), r"\n/([^/]+)/", 1)
    f = _scanned(spark, folder, "*.{json,log}", recursive=True).where("error is null").select(below.alias("run_id"), _name(F.col("path")).alias("name"), "content")
    f = runs.select("run_id", "instance_id").join(f, "run_id", "left")
    used = F.col("name").endswith(".log") | F.col("name").contains(F.col("run_id"))
    said = F.when(F.col("name").endswith(".json"), stated_resolved(F.col("content"), F.col("instance_id"))).otherwise(F.col("content").contains(F.col("instance_id")) & F.col("content").contains("RESOLVED"))
    return f.groupBy("run_id", "instance_id").agg(F.coalesce(F.bool_or(used & said), F.lit(False)).alias("resolved"), F.count_if(used).alias("n_files"))


def submissions(table: DataFrame) -> DataFrame:
    """(submission, resolved) of what leaderboard entries solved; rows without a list solve nothing."""
    return table.select("submission", F.coalesce("resolved", F.array().cast("array<string>")).alias("resolved"))


def cached_solve_rates(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, solve_rate) of a cache file."""
    return json_array(spark, path, schemas.SOLVE_RATE_CACHE).select(F.explode("solve_rates").alias("instance_id", "solve_rate"))


# Caches


def fingerprint(*tables: DataFrame) -> str:
    """A digest of the tables' columns and rows, whatever order rows lie in: count, sum and exclusive or of row hashes, one pass each."""
    out = []
    for t in tables:
        h = [F.xxhash64(F.lit(i), *(F.to_json(F.struct(F.col(f"`{c}`"))) for c in t.columns)) for i in range(2)]
        out.append([t.dtypes, list(t.agg(F.count("*"), *(f for x in h for f in (F.sum(x.cast("decimal(38,0)")).cast("string"), F.bit_xor(x)))).first())])
    return hashlib.sha256(json.dumps(out).encode()).hexdigest()[:32]


def read_through(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored in folder under key; make() is called, and its table stored, only if there is none.

    A table is written beside its place and put there by one rename, so readers see all of it or nothing; of writers at the
    same time the first one's stays. What a writer that died left behind is under another name and never read.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place = hadoop(f"{folder.rstrip('/')}/{key}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        under_way = hadoop(f"{folder.rstrip('/')}/_{key}-{uuid.uuid4().hex}")
        make().write.parquet(under_way.toString())
        # renaming onto a folder that has come meanwhile would move ours into it
        if files.exists(place) or not files.rename(under_way, place):
            files.delete(under_way, True)
    return spark.read.parquet(place.toString())


def solve_rates_through(spark: SparkSession, folder: str, submissions: DataFrame, targets: DataFrame) -> DataFrame:
    """Solve rates of the targets by submissions (submission, resolved), stored under a fingerprint of both: the same input is
    never computed twice, and other input is never mistaken for it."""
    return read_through(spark, folder, fingerprint(submissions, targets.select("instance_id")), lambda: difficulty.from_lists(submissions, targets))
