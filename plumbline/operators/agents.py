"""Pluggable agents that analyse tasks, one failure costing one row.

An agent is registered under its name. Native ones are columns over the tasks' table, Python ones functions of a row.
run() gives a row for each task and agent (schemas.AGENT_RESULT); where the analysis fails, that row has the verdict ERROR, no
score and what went wrong, and every other row is as if nothing had happened. Nothing that an agent does to a row can end
the job, short of ending its process.

All native agents are one projection, so tasks are scanned once for them; all Python agents are one pass over Arrow
batches. Python agents are timed by row. Native expressions run fused for many rows at a time and have no time of their own:
execution_time is null.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from plumbline import schemas
from plumbline.operators import attack
from plumbline.session import shipped

#: What an agent gives; the registry adds the rest.
FIELDS = ("verdict", "score", "issues", "metrics", "confidence", "cost_usd")
NOTHING: dict[str, Any] = {"verdict": "PASS", "score": 1.0, "issues": [], "metrics": {}, "confidence": 1.0, "cost_usd": 0.0}
#: Error messages are cut to so many characters.
LONGEST = 2000


@dataclass(frozen=True)
class Native:
    """result: by field name, columns over the tasks' table; fields left out have the values of NOTHING. fault: a message where a
    task can't be analysed, else null; result is not evaluated there. What may fail within result is to be written with try_
    functions that leave a null: a null verdict is an error, too."""

    result: Mapping[str, Column]
    fault: Column | None = None


#: A function of a row as a dict, to the fields that differ from NOTHING.
Python = Callable[[dict[str, Any]], dict[str, Any]]


def _struct(kind: str) -> StructType:
    return StructType.fromDDL(kind)


def _native(name: str, a: Native) -> Column:
    fields = {f.name: f.dataType.simpleString() for f in _struct(schemas.AGENT_RESULT).fields}
    plain = {"verdict": F.lit("PASS"), "score": F.lit(1.0), "issues": F.array(), "metrics": F.create_map(), "confidence": F.lit(1.0), "cost_usd": F.lit(0.0)}
    if set(a.result) - set(plain):
        raise ValueError(f"agent {name}: unknown fields {sorted(set(a.result) - set(plain))}")
    made = {**plain, **a.result}
    fault = a.fault if a.fault is not None else F.lit(None).cast("string")
    fault = F.when(fault.isNotNull(), fault).when(made["verdict"].isNull(), "no verdict")
    failed = fault.isNotNull()
    error = {"verdict": F.lit("ERROR"), "score": F.lit(0.0), "issues": F.array(), "metrics": F.create_map(F.lit("error"), fault), "confidence": F.lit(0.0), "cost_usd": F.lit(0.0)}
    values = {f: F.when(failed, error[f].cast(fields[f])).otherwise(made[f].cast(fields[f])) for f in FIELDS}
    return F.struct(F.lit(name).alias("agent_name"), *(values[f].alias(f) for f in FIELDS), F.lit(None).cast("double").alias("execution_time"), F.substring(fault, 1, LONGEST).alias("error"))


def _judged(name: str, f: Python, row: dict[str, Any]) -> dict[str, Any]:
    """One row's result; an exception of any kind, or a result of the wrong form, becomes an ERROR."""
    began = time.perf_counter()
    try:
        given = f(row)
        if unknown := set(given) - set(FIELDS):
            raise ValueError(f"unknown fields {sorted(unknown)}")
        out = {**NOTHING, **given}
        out = {**out, "verdict": str(out["verdict"]), "score": float(out["score"]), "confidence": float(out["confidence"]), "cost_usd": float(out["cost_usd"]), "metrics": {str(k): None if v is None else str(v) for k, v in out["metrics"].items()}, "issues": [_issue(x) for x in out["issues"]], "error": None}
    except Exception as e:
        said = (f"{type(e).__name__}: {e}" if str(e) else type(e).__name__)[:LONGEST]
        out = {**NOTHING, "verdict": "ERROR", "score": 0.0, "confidence": 0.0, "metrics": {"error": said}, "error": said}
    return {**out, "agent_name": name, "execution_time": time.perf_counter() - began}


def _issue(x: Mapping[str, Any]) -> dict[str, Any]:
    text = lambda k: None if x.get(k) is None else str(x[k])
    return {"type": str(x["type"]), "severity": str(x["severity"]), "message": str(x["message"]), "confidence": float(x.get("confidence", 1.0)), "agent_source": text("agent_source"), "exploit_patch": text("exploit_patch")}


@dataclass
class Registry:
    """Agents by name, in the order in which they were registered."""

    agents: dict[str, Native | Python] = field(default_factory=dict)

    def register(self, name: str, agent: Native | Python) -> None:
        if name in self.agents:
            raise ValueError(f"agent {name} is there already")
        self.agents[name] = agent

    def run(self, tasks: DataFrame, key: str = "instance_id", names: list[str] | None = None) -> DataFrame:
        """(key, agent result...): a row for each task and agent. A task's key may be null or repeat. No agents, no rows."""
        names = list(self.agents) if names is None else names
        if missing := [n for n in names if n not in self.agents]:
            raise KeyError(f"unknown agents: {missing}")
        native = {n: a for n in names if isinstance(a := self.agents[n], Native)}
        python = {n: a for n in names if not isinstance(a := self.agents[n], Native)}
        parts = [_run_native(tasks, key, native)] if native or not python else []
        if python:
            parts.append(_run_python(tasks, key, python))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _run_native(tasks: DataFrame, key: str, agents: Mapping[str, Native]) -> DataFrame:
    kind = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in _struct(schemas.AGENT_RESULT).fields)}>>"
    each = F.array(*(_native(n, a) for n, a in agents.items())).cast(kind)
    return tasks.select(F.col(key), F.explode(each).alias("_r")).select(key, "_r.*")


def _run_python(tasks: DataFrame, key: str, agents: Mapping[str, Python]) -> DataFrame:
    out = _struct(schemas.AGENT_RESULT)
    names = [f.name for f in out.fields]
    kinds = {f.name: to_arrow_type(f.dataType) for f in out.fields}
    agents = dict(agents)
    shipped(tasks.sparkSession)

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = part.to_pylist()
                made = [_judged(n, f, row) for row in rows for n, f in agents.items()]
                keys = part.column(key).take(pa.array([i for i in range(len(rows)) for _ in agents]))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([list(m[n].items()) if n == "metrics" else m[n] for m in made], kinds[n]) for n in names)], [key, *names])

    return tasks.mapInArrow(judge, f"`{key}` {tasks.schema[key].dataType.simpleString()}, {schemas.AGENT_RESULT}")


def rejected(rows: DataFrame, agent: str, error: str = "error") -> DataFrame:
    """ERROR results (schemas.AGENT_RESULT with instance_id) of input rows that a reader set aside, with their error."""
    bad = F.substring(F.col(error), 1, LONGEST)
    values = {"instance_id": F.col("instance_id") if "instance_id" in rows.columns else F.lit(None), "agent_name": F.lit(agent), "verdict": F.lit("ERROR"), "score": F.lit(0.0), "issues": F.array(), "metrics": F.create_map(F.lit("error"), bad), "confidence": F.lit(0.0), "cost_usd": F.lit(0.0), "execution_time": F.lit(None), "error": bad}
    return rows.where(F.col(error).isNotNull()).select(*(values[f.name].cast(f.dataType).alias(f.name) for f in _struct(f"instance_id string, {schemas.AGENT_RESULT}").fields))


def attacker(metrics: Column, strategies: Column | None = None, name: str = "attacker") -> Native:
    """The agent that looks for ways around a task's tests: rule flags of its pattern metrics and a model's strategies. Without
    metrics there is nothing to judge."""
    none = F.array().cast("array<struct<name:string,category:string,description:string,confidence:int,exploit_patch:string>>")
    s, flags = strategies if strategies is not None else none, attack.flags(metrics)
    confidences = F.transform(s, lambda x: x["confidence"])
    j = attack.judged(flags, confidences)
    number = lambda c: c.cast("string")
    facts = F.create_map(F.lit("num_strategies"), number(F.size(s)), F.lit("n_pattern_flags"), number(F.size(flags)), F.lit("max_exploit_confidence"), number(F.coalesce(F.array_max(confidences), F.lit(0))))
    fault = F.when(metrics.isNull(), "no pattern metrics")
    return Native({"verdict": j["verdict"], "score": j["score"], "confidence": j["confidence"], "issues": attack.issues(flags, s, name), "metrics": facts}, fault)
