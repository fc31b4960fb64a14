"""Reports as one JSON document each, written in parallel and never held as a whole.

A report has a head (a small row of totals), entries in the order of their keys, as an object's members or an array's
elements, and maybe a list of items within each entry. Every entry and item is a line of text. Entries are dealt by ranges of
their keys, and lines of an entry with very many items by ranges of (key, place), so it is spread over tasks; tasks write their ranges as fragments, and the document
is the fragments' bytes in the order of their names between the head and its end, streamed through the driver by a buffer
of fixed size into a file that gets its name at the end. entries_of() and items_of() read documents back in parallel, line by
line.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.numbers import rounded
from plumbline.operators import composite, hybrid, optimize
from plumbline.session import materialized, scratch

NULLS = {"ignoreNullFields": "false"}
ORDER = ("key", "part", "place")
#: Entries with more items than that are spread over tasks, line by line; others are put together in one.
MANY = 10_000


@dataclass(frozen=True)
class Report:
    """head: one row, or None for a document that is nothing but its entries; entries (key, entry struct), keys unique and not null;
    field: where they go in the head; keyed: as members named by key, else as an array in the order of keys; items (key,
    place, item struct): a list of each entry, in the order of place (unique within a key), in the field items_field."""

    head: DataFrame | None
    entries: DataFrame
    field: str = "per_task"
    keyed: bool = True
    items: DataFrame | None = None
    items_field: str = "items"


def _json(c: Column | str) -> Column:
    return F.to_json(c, NULLS)


def _lines(r: Report) -> DataFrame:
    """(key, part, place, text): the document's text between head and end, dealt by ranges of the key or, where entries have very
    many items, of all three. A row is a line, or an entry with all its items."""
    name = F.concat(F.expr("substring(to_json(map(cast(key as string), 0)), 2, length(to_json(map(cast(key as string), 0))) - 4)"), F.lit(":")) if r.keyed else F.lit("")
    first = r.entries.agg(F.min("key").alias("first"))
    comma = F.when(F.col("key") == F.col("first"), "").otherwise(",")
    body = _json("entry")
    key_and_first = r.entries.crossJoin(F.broadcast(first))  # one row
    if r.items is None:
        return key_and_first.select("key", F.lit(0).alias("part"), F.lit(None).cast("string").alias("place"), F.concat(comma, name, body).alias("text")).repartitionByRange(*ORDER)
    opened = F.concat(F.expr("substring(to_json(entry, map('ignoreNullFields', 'false')), 1, length(to_json(entry, map('ignoreNullFields', 'false'))) - 1)"), F.when(body == "{}", "").otherwise(","), F.lit(f'"{r.items_field}":['))
    place = F.col("place")
    large = materialized(r.items.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(F.col("key").alias("k")), "large")
    is_large, any_large = F.col("key") == F.col("k"), not large.isEmpty()
    apart = lambda df: df.join(large, is_large, "left_anti") if any_large else df
    none = F.lit(None).cast(r.items.schema["place"].dataType)
    # an entry and its items meet by their key's range, so that one shuffle both groups and orders them
    own = apart(r.items).select("key", F.lit(None).cast(r.entries.schema["entry"].dataType).alias("entry"), F.struct(place, _json("item").alias("text")).alias("i"))
    rows = apart(r.entries).select("key", "entry", F.lit(None).cast(own.schema["i"].dataType).alias("i")).unionByName(own)
    whole = rows.repartitionByRange("key").groupBy("key").agg(F.first("entry", ignorenulls=True).alias("entry"), F.sort_array(F.collect_list("i")).alias("i")).where(F.col("entry").isNotNull()).crossJoin(F.broadcast(first))  # one row
    texts = F.when(F.size("i") > 0, F.concat(F.array_join(F.col("i.text"), "\n,"), F.lit("\n"))).otherwise("")
    whole = whole.select("key", F.lit(0).alias("part"), none.alias("place"), F.concat(comma, name, opened, F.lit("\n"), texts, F.lit("]}")).alias("text"))
    if not any_large:
        return whole
    many = r.items.join(large, is_large, "left_semi")
    least = many.groupBy(F.col("key").alias("k")).agg(F.min("place").alias("least"))
    lines = many.join(least, F.col("key") == F.col("k")).select("key", F.lit(1).alias("part"), place, F.concat(F.when(place == F.col("least"), "").otherwise(","), _json("item")).alias("text"))
    start = key_and_first.join(large, is_large, "left_semi").select("key", F.lit(0).alias("part"), none.alias("place"), F.concat(comma, name, opened).alias("text"))
    end = r.entries.join(large, is_large, "left_semi").select("key", F.lit(2).alias("part"), none.alias("place"), F.lit("]}").alias("text"))
    lines = lines.join(r.entries.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_semi")
    return whole.unionByName(start).unionByName(lines).unionByName(end).repartitionByRange(*ORDER)


def write_report(r: Report, path: str) -> None:
    """The document as the file path, in place of one that is there. Without entries it has an empty object or array."""
    spark = r.entries.sparkSession
    parts = scratch(spark, "report")
    _lines(r).sortWithinPartitions(*ORDER).select("text").write.text(parts)
    begin, end = ("{", "}") if r.keyed else ("[", "]")
    if r.head is not None:
        head = r.head.select(_json(F.struct("*")).alias("j")).head().j[:-1]
        begin, end = f'{head}{"" if head == "{" else ","}\n"{r.field}":{begin}', f"{end}}}"
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target, source = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    files, there = target.getFileSystem(conf), source.getFileSystem(conf)
    under_way = hadoop.fs.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
    out = files.create(under_way, True)
    try:
        out.write(bytearray(f"{begin}\n".encode()))
        for name in sorted(f.getPath().getName() for f in there.listStatus(source)):
            if name.startswith("part-"):
                fragment = there.open(hadoop.fs.Path(source, name))
                hadoop.io.IOUtils.copyBytes(fragment, out, 1 << 16, False)
                fragment.close()
                there.delete(hadoop.fs.Path(source, name), False)  # or the document would take its size twice
        out.write(bytearray(f"{end}\n".encode()))
    finally:
        out.close()
    files.delete(target, False)
    files.rename(under_way, target)
    there.delete(source, True)


def _bare(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("line"))


def head_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The totals of a document: its first line, without what follows."""
    line = F.regexp_replace("line", ",?$", "}")
    return _bare(spark, path).limit(1).select(F.from_json(line, schema).alias("h")).select("h.*")


def entries_of(spark: SparkSession, path: str, schema: str, items: bool = False, keyed: bool = True) -> DataFrame:
    """(key, entry...) of a document's entries, without key unless keyed; items: whether they hold lists of items, which stay out."""
    line = F.regexp_replace("line", r',?"\w+":\[$', "}") if items else F.col("line")
    if not keyed:
        rows = _bare(spark, path).where(F.col("line").startswith("{") & F.col("line").endswith(r':[' if items else "}"))
        return rows.select(F.from_json(line, schema).alias("e")).select("e.*")
    rows = _bare(spark, path).where(F.col("line").startswith('"') & ~F.col("line").rlike(r'^"\w+":[\[{]$'))
    pairs = F.from_json(F.concat(F.lit("{"), line, F.lit("}")), f"map<string, struct<{_typed(schema)}>>")
    return rows.select(F.explode(pairs).alias("key", "e")).select("key", "e.*")


def items_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All items of a document's entries, whosever they are."""
    rows = _bare(spark, path).where(F.col("line").startswith("{") & F.col("line").endswith("}"))
    return rows.select(F.from_json("line", schema).alias("i")).select("i.*")


def _typed(schema: str) -> str:
    """'a int, b string' as the fields of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


# The reports. Field names are fixed values: those of the documents that other tools read.


def _entry(df: DataFrame, key: str, fields: dict[str, Column | str]) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())).alias("entry"))


def _item(df: DataFrame, key: str, place: str, fields: dict[str, Column | str]) -> DataFrame:
    item = F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))
    return df.select(F.col(key).alias("key"), F.col(place).alias("place"), item.alias("item"))


VERIFIER = {"top1_accuracy": "top1", "bottom1_accuracy": "bottom1", "spearman_rho": "spearman", "mae": "mae", "composite_score": "composite", "n_candidates": "n_candidates", "n_false_positives": "n_false_positives", "n_false_negatives": "n_false_negatives", "false_positive_rate": "fpr", "false_negative_rate": "fnr"}


def verifier_report(scores: DataFrame, candidates: DataFrame, separation: DataFrame | None = None, categories: DataFrame | None = None) -> Report:
    """Verifier scores of all tasks with their candidates. separation: its one row, left out unless both groups have tasks; categories:
    category_success(), a row a category."""
    scores = materialized(scores, "scores")
    mean = lambda c: rounded(F.coalesce(F.avg(c), F.lit(0.0)))
    head = scores.agg(F.count("*").alias("total_tasks_scored"), F.count_if(F.col("n_false_positives") > 0).alias("n_hackable"), F.count_if(F.col("n_false_positives") == 0).alias("n_non_hackable"), mean("composite").alias("mean_composite"), mean("spearman").alias("mean_spearman"), mean("fpr").alias("mean_fpr"), mean("fnr").alias("mean_fnr"))
    if separation is not None:
        s = F.struct(F.col("u").alias("mann_whitney_u"), F.col("p").alias("p_value"), F.col("effect").alias("effect_size_r"), F.col("significant").alias("is_significant"), F.col("threshold").alias("optimal_threshold"), F.col("youden").alias("threshold_youden_j"), *(F.array(f"lo_{x}", f"hi_{x}").alias(f"ci_{n}") for x, n in (("x", "hackable"), ("y", "non_hackable")) if f"lo_{x}" in separation.columns))
        head = head.crossJoin(F.broadcast(separation.select(F.when((F.col("n_x") > 0) & (F.col("n_y") > 0), s).alias("statistical_analysis"))))  # one row each
    if categories is not None:
        c = F.struct(F.struct((-F.col("verified")).alias("a"), F.col("category").alias("b")).alias("o"), F.struct("category", F.col("attempts").alias("total_attempts"), F.col("verified").alias("docker_verified"), F.col("rate").alias("success_rate")).alias("v"))
        head = head.crossJoin(F.broadcast(categories.agg(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"]).alias("exploit_categories"))))
    quality = F.element_at(F.array(*(F.lit(q.upper()) for q in schemas.QUALITY)), F.col("true_quality") + 1)
    passed = F.coalesce(F.col("verifier_pass").cast("double"), F.lit(0.0))
    items = _item(candidates, "instance_id", "patch_id", {"patch_id": "patch_id", "source": "source", "verifier_pass": "verifier_pass", "true_quality": quality, "verifier_score": passed, "true_score": F.col("true_quality") / 3.0})
    return Report(head, _entry(scores, "instance_id", VERIFIER), items=items, items_field="candidates")


RATES = {"precision": "precision", "recall": "recall", "f1": "f1", "false_positive_rate": "fpr", "false_negative_rate": "fnr"}


def hybrid_report(confusion: DataFrame, cells: DataFrame) -> Report:
    """Confusion of all tasks with the cell of each judged candidate. cells (instance_id, patch_id, verifier_pass, cell)."""
    confusion = materialized(confusion, "confusion")
    aggregate = F.struct("tp", "fp", "fn", "tn", *(F.col(v).alias(k) for k, v in RATES.items()), "tasks_with_fp", "tasks_with_fn").alias("aggregate")
    totals = confusion.agg(F.count("*").alias("total_tasks"), rounded(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("total_cost_usd"))
    head = totals.crossJoin(F.broadcast(hybrid.overall(confusion).select(aggregate)))  # one row each
    fields = {**{c: c for c in ("tp", "fp", "fn", "tn")}, **RATES, "n_judged": "n_judged"}
    items = _item(cells.where("cell <> 'skipped'"), "instance_id", "patch_id", {"patch_id": "patch_id", "verifier_pass": "verifier_pass", "judge_correct": F.col("cell").isin("tp", "fn"), "category": F.upper("cell")})
    return Report(head, _entry(confusion, "instance_id", fields), items=items, items_field="entries")


def composite_report(scores: DataFrame) -> Report:
    """Composite scores, verdicts and weaknesses of all tasks; dimensions that a task lacks are left out of its scores."""
    scores = materialized(scores, "scores")
    head = scores.agg(F.count("*").alias("total_tasks"), F.struct(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("KEEP", "FIX", "DROP"))).alias("verdict_counts"), rounded(F.coalesce(F.avg("eqs"), F.lit(0.0))).alias("mean_eqs"), F.struct(*(F.count(d).alias(d) for d in composite.DIMENSIONS)).alias("dimensions_available"))
    there = F.map_filter(F.create_map(*(x for d in composite.DIMENSIONS for x in (F.lit(d), F.col(d)))), lambda _, v: v.isNotNull())
    return Report(head, _entry(scores, "instance_id", {"eqs": "eqs", "verdict": "verdict", "dimension_scores": there, "weaknesses": "weaknesses"}))


def attack_report(results: DataFrame) -> Report:
    """Attack results in the order of ordinal: (ordinal, instance_id, rounds, exploit_patches, total_strategies, max_confidence,
    total_cost_usd, elapsed_seconds)."""
    head = results.agg(F.count("*").alias("total_tasks"), F.coalesce(F.sum("total_strategies"), F.lit(0)).alias("total_new_strategies"), rounded(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0))).alias("total_cost_usd"))
    return Report(head, _entry(results, "ordinal", {c: c for c in results.columns if c != "ordinal"}), keyed=False)


def optimization_report(done: optimize.Optimized) -> Report:
    """What optimized() gives: totals, and each iteration with its tasks."""
    totals = {"total_iterations": "total_iterations", "converged": "converged", "initial_mean_eqs": "initial_mean", "final_mean_eqs": "final_mean", "total_improvement": "total_improvement", "total_cost_usd": "total_cost_usd", "tasks_upgraded_total": "n_upgraded", "convergence_curve": "convergence_curve"}
    fields = {"iteration": "iteration", "tasks_targeted": "n_tasks", "augmentations_generated": "n_augmentations", "tasks_improved": "n_improved", "tasks_upgraded": "n_upgraded", "mean_eqs_before": "mean_before", "mean_eqs_after": "mean_after", "improvement": "improvement", "cost_usd": "cost_usd"}
    items = None
    for i, s in enumerate(done.steps, 1):
        s = s.withColumn("iteration", F.lit(i))
        items = s if items is None else items.unionByName(s)
    if items is not None:
        items = _item(items, "iteration", "instance_id", {"instance_id": "instance_id", "eqs_before": "before", "eqs_after": "after", "improvement": rounded(F.col("after") - F.col("before")), "n_augmentations": "n_augmentations", "improved": "improved", "upgraded": "upgraded"})
    head = done.totals.select(*(F.col(v).alias(k) for k, v in totals.items()))
    return Report(head, _entry(done.iterations, "iteration", fields), field="iterations", keyed=False, items=items, items_field="per_task")


def comparison_report(compared: DataFrame, changes: DataFrame) -> Report:
    """A comparison of two runs: abtest.compared()'s row, and abtest.changes() as entries by task."""
    head = compared.select(F.col("n").alias("n_eval_tasks"), F.struct(F.col("pass_a").alias("trained_pass_at_1")).alias("group_a"), F.struct(F.col("pass_b").alias("trained_pass_at_1")).alias("group_b"), F.col("delta").alias("delta_pass_at_1"), F.array("lo", "hi").alias("ci_95_pct"), F.col("p").alias("mcnemar_p_value"), F.col("n_fixed").alias("mcnemar_b_fail_to_pass"), F.col("n_regressed").alias("mcnemar_c_pass_to_fail"), "verdict")
    return Report(head, _entry(changes, "task_id", {"change": "change"}), field="changes")


def verification_report(results: DataFrame, summary: DataFrame) -> Report:
    """Attempted exploits by task: results (instance_id, exploit_index, verified, has_error, key), and attack.verification_summary()."""
    hackable = F.concat(F.col("tasks_hackable").cast("string"), F.lit("/"), F.col("total_tasks").cast("string"), F.lit(" tasks"))
    detail = F.when(F.col("outcome") == "CHECK", "no verified exploits").when(F.col("outcome") != "NO_DATA", F.concat(hackable, F.lit(" have verified exploits")))
    head = summary.select(F.col("total_tasks").alias("total_tasks_tested"), F.col("tasks_hackable").alias("tasks_with_verified_exploit"), "hackability_rate", F.col("total_exploits").alias("total_exploits_attempted"), F.col("exploits_verified").alias("total_exploits_verified"), "exploit_success_rate", "outcome", detail.alias("outcome_detail"))
    per_task = results.groupBy("instance_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("v"))
    items = _item(results, "instance_id", "key", {"exploit_index": "exploit_index", "verified": "verified", "has_error": "has_error", "log_file": F.concat("key", F.lit(".log"))})
    return Report(head, _entry(per_task, "instance_id", {"exploits_attempted": "n", "exploits_verified": "v"}), items=items, items_field="exploit_details")


def phase1_report(results: DataFrame) -> Report:
    """First-round results (ordinal and schemas.PHASE1) as an array in the order of ordinal."""
    return Report(None, _entry(results, "ordinal", {c: c for c in results.columns if c != "ordinal"}), keyed=False)
