"""Justifications of EL entailments over all axioms, not only told paths: minimal sets of axioms that still entail.

Many subsets are tried in one completion: a trial is a copy of its axioms whose names carry the trial's number, so the
copies share the run's rounds and joins and never meet. Inputs are the rows of a module (`taxonomy.module`), which
keeps the copies small; axioms are rows (id, form, a, b, c) of the normal forms, and one id may have several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import written
from . import el
from .normalise import SHAPES, TOP

BOTTOM = el.BOTTOM


def entailing(rows: DataFrame, trials: DataFrame, sub: str, sup: str) -> list[int]:
    """The trials (trial, id) whose axioms entail sub <= sup."""
    spark = rows.sparkSession
    all_rows = written(trials.join(rows, "id"))
    name = lambda c: F.when(F.col(c).isin(TOP, BOTTOM), F.col(c)).otherwise(F.concat_ws(" ", F.col("trial").cast("string"), F.col(c)))
    tables = {n: all_rows.where(F.col("form") == n).select(*(name(x).alias(c) for x, c in zip("abc", shape.split()))) for n, shape in SHAPES.items()}
    ends = trials.select("trial").distinct().select(F.explode(F.array(F.concat_ws(" ", F.col("trial").cast("string"), F.lit(sub)), F.concat_ws(" ", F.col("trial").cast("string"), F.lit(sup)))).alias("name"))
    kb = el.ELAxioms(spark, **tables, extra_names=ends)
    symbols = kb.symbols()
    subs = el.readout(el.complete(kb, symbols), symbols)
    tail = F.col("sup").isin(BOTTOM) | (F.substring_index("sup", " ", -1) == sup)
    same = F.col("sup").isin(BOTTOM) | (F.substring_index("sub", " ", 1) == F.substring_index("sup", " ", 1))
    hit = subs.where((F.substring_index("sub", " ", -1) == sub) & tail & same).select(F.substring_index("sub", " ", 1).cast("long").alias("trial")).distinct()
    return sorted(r.trial for r in hit.collect())  # one number a trial


def one(rows: DataFrame, ids: list[int], sub: str, sup: str) -> list[int] | None:
    """One justification among the axioms `ids`, in ascending order, or None. Each round tries every prefix of what is left at once: the
    shortest that entails ends in an axiom that no subset of it can spare."""
    spark, fixed, open_ = rows.sparkSession, [], sorted(ids)
    while True:
        trials = [(k, i) for k in range(len(open_) + 1) for i in [*fixed, *open_[:k]]]
        hits = entailing(rows, spark.createDataFrame(trials, "trial long, id long"), sub, sup) if trials else []
        if not hits:
            return None
        if hits[0] == 0:
            return sorted(fixed)
        fixed.append(open_[hits[0] - 1])
        open_ = open_[: hits[0] - 1]


def every(rows: DataFrame, sub: str, sup: str) -> list[list[int]]:
    """All justifications, by hitting sets: after each find, its axioms are left out one by one and the rest is searched again."""
    ids = [r.id for r in rows.select("id").distinct().collect()]  # of the module
    found: list[list[int]] = []
    done: set[frozenset] = set()
    queue = [frozenset()]
    while queue:
        out = queue.pop(0)
        known = next((f for f in found if not out & set(f)), None)
        got = known or one(rows, [i for i in ids if i not in out], sub, sup)
        if got is None:
            continue
        if known is None:
            found.append(got)
        for i in got:
            if (more := out | {i}) not in done:
                done.add(more)
                queue.append(more)
    return sorted(found)


def as_json(found: list[list[int]], axioms: DataFrame, sub: str, sup: str) -> DataFrame:
    """(value): one JSON object a justification, with its axioms' text from `axioms` (id, text), for `write.text`."""
    spark = axioms.sparkSession
    sets = spark.createDataFrame([(k, i) for k, ids in enumerate(found) for i in ids], "k long, id long")
    per = sets.join(axioms, "id").groupBy("k").agg(F.array_sort(F.collect_list("text")).alias("axioms"))
    return per.select(F.to_json(F.struct(F.lit(sub).alias("sub"), F.lit(sup).alias("sup"), "axioms")).alias("value"))
