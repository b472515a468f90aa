"""Tables that depend on one another: order of work, impact, columns read, and the record of a run."""

from __future__ import annotations

import re
import uuid
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEPENDS = re.compile(r"^--\s*depends_on:\s*(.+)$", re.M)
_TABLE = re.compile(r"\b(?:from|join)\s+([a-z_][\w.]*)", re.I)
_CTE = re.compile(r"(?:\bwith|,)\s*([a-z_]\w*)\s+as\s*\(", re.I)


def dependencies(sql: str) -> set[str]:
    """Tables that a model names in its header comment or reads after FROM and JOIN, without its own CTEs."""
    body = re.sub(r"--.*", "", sql)
    own = {m.lower() for m in _CTE.findall(body)}
    said = {t.strip() for line in _DEPENDS.findall(sql) for t in line.split(",")}
    return said | {t for t in _TABLE.findall(body) if t.lower() not in own}


def order(models: dict[str, str]) -> list[str]:
    """Names in an order in which each comes after what it reads; raises ValueError on a cycle."""
    try:
        return list(TopologicalSorter({n: dependencies(s) & set(models) - {n} | ({n} if n in dependencies(s) else set()) for n, s in models.items()}).static_order())
    except CycleError as e:
        raise ValueError(f"models depend on each other in a circle: {e.args[1]}") from None


def impact(models: dict[str, str], changed: str) -> set[str]:
    """Models that read ``changed``, directly or through others."""
    hit, todo = set(), [changed]
    while todo:
        t = todo.pop()
        for n, s in models.items():
            if t in dependencies(s) and n not in hit:
                hit.add(n)
                todo.append(n)
    return hit


def run(spark: SparkSession, models: dict[str, str]) -> dict[str, DataFrame]:
    """Each model as a view, in order."""
    out = {}
    for n in order(models):
        out[n] = spark.sql(models[n])
        out[n].createOrReplaceTempView(n)
    return out


def columns_read(df: DataFrame) -> set[str]:
    """Attributes that a plan refers to, from its analysed form: for bans on protected attributes."""
    plan = df._jdf.queryExecution().analyzed()
    found, todo = set(), [plan]
    while todo:
        p = todo.pop()
        it = p.references().iterator()
        while it.hasNext():
            found.add(it.next().name())
        kids = p.children().iterator()
        while kids.hasNext():
            todo.append(kids.next())
    return found


def run_record(inputs: dict[str, DataFrame], amount: dict[str, str]) -> DataFrame:
    """One row an input: run, rows, sum of its amount, checksum."""
    run_id, out = uuid.uuid4().hex, None
    for n, df in inputs.items():
        one = df.agg(F.lit(run_id).alias("run_id"), F.lit(n).alias("input"), F.count("*").alias("rows"), F.sum(F.col(amount[n]).cast("double")).alias("amount"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
        out = one if out is None else out.unionByName(one)
    return out
