"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source gets a token target: a share of the wanted total by its weight, at most
`max_copies` times what the source holds, the excess reshared by weight (water-filling,
solved by a short monotone iteration of aggregates over the table of sources).

Within a source, a document may be taken 0, 1 or 2 times. Of all ways to tilt the
maximum-entropy copies (a fair coin tossed twice), entropy balancing takes the one nearest in relative
entropy that meets the token constraint: document d is taken at rate
2 * sigmoid(lambda_s * x_d), x_d its size over the source's mean size. lambda_s minimises the
convex dual sum_d 2*log(1+exp(lambda*x_d)) - lambda*T; all sources' duals are solved together
by safeguarded Newton steps, each one aggregate over the histogram (source, size, documents),
so a hot source costs its distinct sizes and no more. Rates become copies by systematic
rounding along the sizes of a source; what a source is then short of or over (less than its
longest document) is made up in a few passes by further documents, the longest that bring it closer first. Within a size, documents get the extra copies in hash order, ranked by
cells of a fixed number of salts so that no task holds a whole group of equal sizes.

Edge cases: null and empty texts have size 0 and are taken 0 words; a null source is a source
of its own and comes last; a source of size 0 has target 0; an empty table gives an empty
result; repeated rows count as rows; extra columns are ignored. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, written

WEIGHTS = (3.0, 1.0, 2.0)
SALTS = 256
NEWTON_STEPS = 40
TOLERANCE = 1e-6


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, max_size, rank): sources by code point, null last. Ranks come from a range
    partitioning and per-partition offsets, so no task orders all sources."""
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.max("size").alias("max_size")))
    parted = written(per.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    offsets = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parted.join(offsets.select("part", "before"), "part").withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("part", "before")


def with_targets(sources: DataFrame, share: float, cap: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds `target`. The level L with sum(min(cap * size, weight * L)) = share * sum(size) is found from
    below: capped sources leave the sum, the rest divide what remains, until no more are capped."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = -1.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * level if level >= 0 else F.lit(False)
        got = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], (total - got[0]) / got[1]
    return sources.withColumn("target", F.least(F.col("most"), F.col("weight") * max(level, 0.0))).drop("weight", "most", "rank")


def _sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def tilts(hist: DataFrame, sources: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source_key, tilt): the dual solution of each source whose target is inside (0, 2 * size)."""
    inner = sources.where((F.col("target") > 0) & (F.col("target") < 2 * F.col("source_size")))
    mean = F.col("source_size") / F.col("n_docs")
    state = inner.select("source_key", "target", "source_size", mean.alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done"))
    state = written(state)
    h = hist.where("size > 0").withColumnRenamed("source_key", "k")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        p = _sigmoid(F.col("tilt") * x)
        sums = (
            h.join(state.where("not done").select(F.col("source_key").alias("k"), "tilt", "mean"), "k")
            .groupBy("k")
            .agg(F.sum(2 * F.col("n") * F.col("size") * p).alias("taken"), F.sum(2 * F.col("n") * F.col("size") * x * p * (1 - p)).alias("slope"))
        )
        gap = F.col("taken") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap < 0, F.col("hi")).otherwise(F.col("tilt"))
        step = F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        inside = (step > lo) & (step < hi)
        moved = F.when(inside, step).otherwise((lo + hi) / 2)
        met = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("source_size"), F.lit(True))
        state = written(
            state.join(sums.withColumnRenamed("k", "source_key"), "source_key", "left").select(
                "source_key", "target", "source_size", "mean",
                F.when(F.col("done") | met, F.col("tilt")).otherwise(moved).alias("tilt"), lo.alias("lo"), hi.alias("hi"), (F.col("done") | met).alias("done"),
            )
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source_key", "tilt")


def settled(rated: DataFrame, passes: int = 5) -> DataFrame:
    """Moves `extra` so that each source's words come near the target: longest documents first, each pass only what brings the sum closer."""
    source = Window.partitionBy("source_key")
    down = source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(passes):
        near = 0.5 if i >= passes - 2 else 0.0  # the last passes may overshoot where that is nearer
        gap = F.col("target") - F.sum((F.col("n") * F.col("whole") + F.col("extra")) * F.col("size")).over(source)
        rated = rated.withColumn("gap", gap)
        free = F.when(F.col("whole") >= 2, 0).when(F.col("gap") > 0, F.col("n") - F.col("extra")).otherwise(F.col("extra"))
        rated = rated.withColumn("free", F.when((F.col("size") > 0) & ((1 - near) * F.col("size") <= F.abs("gap")), free).otherwise(0))
        rated = rated.withColumn("before", F.sum(F.col("free") * F.col("size")).over(down) - F.col("free") * F.col("size"))
        fits = F.floor((F.abs("gap") - F.col("before")) / F.greatest(F.col("size"), F.lit(1)) + near)
        step = F.greatest(F.lit(0), F.least(F.col("free"), fits)) * F.signum("gap")
        rated = rated.withColumn("extra", (F.col("extra") + step).cast("long")).drop("gap", "free", "before")
    return rated


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate (of its size), copies, taken."""
    # null sources get a key of their own so that plain equi-joins carry them
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sizes = written(docs.select("doc_id", "source", key.alias("source_key"), n_words(F.col("text")).alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")))
    sources = with_targets(ranked_sources(sizes), share, cap, weights).withColumn("source_key", key)
    sources = written(sources)
    cells = written(sizes.groupBy("source_key", "size", "salt").agg(F.count(F.lit(1)).alias("n_cell")))
    hist = written(cells.groupBy("source_key", "size").agg(F.sum("n_cell").alias("n")))
    solved = sources.join(tilts(hist, sources), "source_key", "left").select("source_key", "source_size", "n_docs", "target", "tilt")
    rate = (
        F.when(F.col("target") <= 0, 0.0)
        .when(F.col("tilt").isNull(), 2.0)
        .otherwise(2 * _sigmoid(F.col("tilt") * F.col("size") * F.col("n_docs") / F.col("source_size")))
    )
    rated = hist.join(solved, "source_key").withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(rate))
    # systematic rounding: extra copies are where the running sum of fractions passes a whole number
    whole, part = F.floor("rate"), F.col("n") * (F.col("rate") - F.floor("rate"))
    along = Window.partitionBy("source_key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(part).over(along)
    extra = (F.floor(run + 0.5 + 1e-9) - F.floor(run - part + 0.5 + 1e-9)).cast("long")
    rated = rated.select("source_key", "size", "n", "source_size", "target", "rate", whole.cast("long").alias("whole"), F.least(F.col("n"), extra).alias("extra"))
    rated = written(settled(rated)).drop("n")
    before = F.sum("n_cell").over(Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_cell")
    cells = cells.withColumn("before", before).join(rated, ["source_key", "size"]).drop("n_cell")
    order = Window.partitionBy("source_key", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    placed = sizes.withColumn("nth", F.row_number().over(order)).join(cells, ["source_key", "size", "salt"])
    copies = F.col("whole") + F.when(F.col("before") + F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def taken(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; documents without words, which have no share, stay once."""
    own, size, source, times, nth, place, copy = fresh(docs, "own_id", "own_size", "own_source", "times", "nth", "place", "copy")
    copies = mix(docs, share, cap, weights).select(F.col("doc_id").alias(own), F.col("size").alias(size), F.col("source").alias(source), F.col("copies").alias(times))
    copies, rows = written(copies), docs
    match = F.col("doc_id").eqNullSafe(F.col(own))
    if copies.select(own).distinct().count() < copies.count():  # rows that share a doc_id are told apart by size, source and place
        copies = copies.withColumn(nth, F.row_number().over(Window.partitionBy(own).orderBy(size, source)))
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(n_words(F.col("text")), "source")))
        match = match & (F.col(place) == F.col(nth))
    often = F.when(F.col(size) == 0, 1).otherwise(F.col(times)).cast("int")
    return rows.join(copies, match).withColumn(copy, F.explode(F.array_repeat(F.lit(1), often))).select(*docs.columns)
