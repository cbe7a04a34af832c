"""N-gram Jaccard join over word shingles, by count vectors and R-trees.

A set's shingles are hashed into groups; the counts by group are its point, and the summed minima of two
points bound the overlap from above. Two sets link when den * overlap >= num * union (a `Rule`; 85 of 100 by default), which
allows r = floor((|A| + |B|) * (den - num) / (den + num)) shingles in one but not in the other.

Routing. Of r + 2 or more hashed groups, two linked sets agree on two in full (each differing shingle
spoils one group at most). A set that fills more than r groups agrees with its partners on one that it fills, and there are so many groups that
almost all sets do. So linked sets meet in a cell named by a group and the hash of
its content, or, when neither fills more than r groups, by two groups that are empty in both. r depends on the sizes, so sizes are cut into bands of ratio den/num and a set takes part
in its own band's cells and in the band's below; linked sets are in one band or in neighbours. Small sets meet in
the cells of their first shingles in hash order instead (as many as cannot all be missing in a linked set). A set that fills f > r groups agrees with its
partners on f - r of them; so it leaves its f - r - 1 largest cells, those of common shingles first, and links with nothing when no more than these are shared.

Joining. 1. Every set is paired with the leader of its largest cell and with the heaviest leader it meets in any; then those outside
a cell's most frequent component with the heaviest of these. Pairs whose
point bound is too small are dropped, the rest verified on the whole sets, and the links' components
taken: a group of near copies becomes one. 2. Cells that still hold several components are
searched: an R-tree over the members' points finds, for every member outside the cell's most frequent component, those of other
components whose bound reaches the threshold; these pairs, and those of cells with two members only, are verified as well unless step 1 did. Sets that meet in many cells are told as a pair in the first of these.
The sets of cells larger than a block are routed once more by a second hash; what is still larger is searched block by
block. Since pairs inside a component add nothing, no link between components is lost.

Equal sets are one set (named by a 64-bit fingerprint of its shingles) throughout. Which texts to fetch for
verification is prefiltered by a Bloom filter of bounded size; the join behind it is exact.

Edge cases: null, empty and blank texts have an empty set and link with nothing; texts of fewer words than a shingle are one shingle;
equal rows link; an empty table gives an empty result; extra columns are ignored; rows
with a null doc_id join the component of a set that others have too, and never name it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import discard, fresh, release, small_batches, written
from .components import components
from .suffix_dedup import ASKED, block_answers, block_requests, blocks, doc_ids, flags

GROUPS = 256
LEAF = 16
BLOCK = 512
FIRST = 8  # cells of a set by which pairs that meet earlier are known
BLOOM_MAX_BITS = 1 << 27
BYTES_PER_BUCKET = 8_000_000
BLOCK_BYTES = 1_000_000
ROWS_OF_SETS = 200  # pairs of whole sets a Python worker holds at once


class Rule(NamedTuple):
    """Sets of shingles of `words` words link when den * overlap >= num * union."""

    words: int = 4
    num: int = 85
    den: int = 100


RULE = Rule()


def need(n, m, rule: Rule = RULE):
    """Least overlap of linked sets of sizes n and m."""
    return -((-rule.num * (n + m)) // (rule.num + rule.den))


@lru_cache
def _bands(rule: Rule) -> np.ndarray:
    """Upper ends of the size bands: sizes of one link are in one band or in neighbours."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, (ends[-1] + 1) * rule.den // rule.num))
    return np.array(ends)


SMALL = 60


def _spoiled(top: int, rule: Rule = RULE) -> int:
    """Most shingles in one set but not in the other, of linked sets with at most `top` shingles together."""
    return max(top - 2 * int(need(0, top, rule)), top - 1 - 2 * int(need(0, top - 1, rule)))


@lru_cache(maxsize=4096)
def _groups(r: int, least: int) -> int:
    """Hashed groups, r + 2 at least, of which almost all sets of `least` shingles or more fill more than r: by three deviations."""
    m = r + 2
    while True:
        none = np.exp(-least / m)  # a group's chance to be empty
        if m - m * none - 3 * np.sqrt(m * none) > r or m > 3 * r:
            return m
        m += max(1, m >> 6)


def routes(s: np.ndarray, rule: Rule = RULE) -> list[tuple[int, np.ndarray, int]]:
    """The size bands a set of sorted shingle hashes is routed in: the band, the names of its cells there, and its spare cells. A set
    meets every partner in more cells than are spare, so of its cells as many as are spare need not be searched."""
    bands = _bands(rule)
    band, n, out = int(np.searchsorted(bands, len(s))), len(s), []
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s)])
    for low in sorted({band, max(0, band - 1)}):
        top = int(bands[low] + bands[low + 1])
        r = _spoiled(top, rule)
        if not r:
            continue  # only equal sets link
        if top < SMALL:
            first = s[: n - -(-rule.num * n // rule.den) + 1]
            out.append((low, hashing.mix(first + hashing.U(low)), 0))
            continue
        m = _groups(r, int(bands[low - 1]) + 1 if low else 1)  # two groups at least agree in full
        group = ((s >> hashing.U(32)) * hashing.U(m)) >> hashing.U(32)  # ascending, as s is
        at = np.searchsorted(group, np.arange(m + 1, dtype=np.uint64))
        held = np.diff(at)
        full = np.flatnonzero(held)
        named = hashing.mix((run[at[1:]] - run[at[:-1]])[full] + full.astype(np.uint64) * hashing.U(0x9E3779B97F4A7C15) + hashing.U(low))
        if len(full) <= r:  # no full group need agree: pairs of groups that are both empty
            none = np.flatnonzero(held == 0).astype(np.uint64)
            i, j = np.triu_indices(len(none), 1)
            named = np.concatenate([named, hashing.mix(none[i] * hashing.U(1 << 40) + none[j] * hashing.U(1 << 12) + hashing.U(low))])
        out.append((low, named, max(0, len(full) - r - 1)))  # r full groups at most are spoiled
    return out


def cells(s: np.ndarray, rule: Rule = RULE) -> np.ndarray:
    """Names of the cells of a set of sorted shingle hashes."""
    return np.concatenate([np.zeros(0, np.uint64), *(named for _, named, _ in routes(s, rule))])


def second_routes(s: np.ndarray, rule: Rule) -> list[tuple[int, np.ndarray, int]]:
    """A second routing: the same set under another hash, so that what brought many sets
    together by chance or by one common shingle parts them again. Linked sets meet here as well."""
    return routes(np.sort(hashing.mix(s ^ hashing.U(0xA0761D6478BD642F))), rule)


MEMBER = "cell long, id long, band int, spare int"


def _members(routed: list[tuple[int, list]]) -> tuple[np.ndarray, ...]:
    """Cell, id, band and spare cells of the routes of sets, in columns."""
    flat = [(named, i, band, spare) for i, got in routed for band, named, spare in got]
    n = [len(x[0]) for x in flat]
    cell = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in flat)])
    return cell, *(np.repeat(np.array([x[k] for x in flat], kind), n) for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))


def points(s: np.ndarray) -> bytes:
    """Counts by group, as bytes, or as 32-bit numbers when a count exceeds a byte (sets of some 50,000 shingles)."""
    counts = np.bincount((s >> hashing.U(3)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
    return counts.astype(np.uint32 if counts.max() > 255 else np.uint8).tobytes()


def _counts(packed) -> np.ndarray:
    """Rows of counts of packed points, whichever width each has."""
    packed = list(packed)
    if all(len(p) == GROUPS for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == GROUPS else np.uint32).astype(np.uint32) for p in packed])


def _set(text: str | None, words: int) -> np.ndarray:
    return hashing.shingles((text or "").encode("utf-8", "replace").lower(), words)


def _name(s: np.ndarray) -> int:
    return int(np.add.reduce(hashing.mix(s * hashing.U(0x2545F4914F6CDD1D) + hashing.U(len(s)))).astype(np.int64))


def _block_sets(row, words: int) -> list[np.ndarray]:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.data).lower(), np.uint8)
    end = np.cumsum(np.frombuffer(row.sizes, np.int64))
    return hashing.block_shingles(a, end - np.frombuffer(row.sizes, np.int64), end, words)


def sets(stored: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, id, point) of every row of the blocks; id names the set, null when it is empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                got = _block_sets(row, rule.words)
                yield pd.DataFrame({"doc_id": pd.array(doc_ids(row), "Int64"), "n": [len(s) for s in got], "id": pd.array([_name(s) if len(s) else None for s in got], "Int64"), "point": [points(s) for s in got]})

    return stored.mapInPandas(read, "doc_id long, n long, id long, point binary")


def _block_cells(row, rule: Rule) -> tuple[np.ndarray, ...]:
    """Distinct (cell, id) of a block, with band and spare, ordered by cell."""
    cell, ids, band, spare = _members([(_name(s), routes(s, rule)) for s in _block_sets(row, rule.words) if len(s)])
    order = np.lexsort((ids, cell))
    cell, ids = cell[order], ids[order]
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1])
    return cell[new], ids[new], band[order][new], spare[order][new]


def rarest(rows: DataFrame) -> DataFrame:
    """(cell, id, size) of members (cell, id, band, spare), without cells of one set. Each set leaves as many of its largest cells of a band as are
    spare. All order cells alike, so linked sets still meet in the smallest cell that both have: each has more than its spare ones at or above it."""
    sized = rows.join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cell")
    place = F.row_number().over(Window.partitionBy("id", "band").orderBy(F.desc("size"), F.desc("cell")))
    kept = written(sized.withColumn("place", place).where("place > spare").select("cell", "id"))
    return kept.join(kept.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cell")


def memberships(stored: DataFrame, n_buckets: int, rule: Rule) -> DataFrame:
    """(cell, id, size, weight, leader) of the cells that hold two sets or more. A set's weight is the size of all its cells; the
    heaviest leads a cell: it agrees with most others, as the text does that copies were made from. Blocks first ask, by 32 bits a cell and
    bucket, which of their cells another block has too; only those and cells with two sets inside the block travel as rows, and only of sets that share
    more of a band's cells than are spare there: others link with nothing."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                keys = np.unique(_block_cells(row, rule)[0])
                if len(keys):
                    yield block_requests(row.block, n_buckets, keys)

    known = stored.join(block_answers(stored.mapInPandas(ask, ASKED), "bits"), "block", "left")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                cell, ids, band, spare = _block_cells(row, rule)
                keys, group, count = np.unique(cell, return_inverse=True, return_counts=True)
                if len(keys):
                    out = ((flags(row.bits, len(keys)) > 0) | (count > 1))[group]
                    got = pd.DataFrame({"cell": cell[out].astype(np.int64), "id": ids[out], "band": band[out], "spare": spare[out]})
                    yield got[got.groupby(["id", "band"])["cell"].transform("size") > got.spare]

    rows = written(known.mapInPandas(send, MEMBER).distinct())
    sized = written(rarest(rows))
    discard(rows)
    weight = sized.groupBy("id").agg(F.sum("size").alias("weight"))
    of = sized.join(weight, "id")
    return of.join(of.groupBy("cell").agg(F.max(F.struct("weight", "id")).alias("leader")), "cell").select("cell", "id", "size", "weight", "leader")


def bounded(pairs: DataFrame, known: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose points leave room for a link."""
    side = lambda x: known.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}"))

    @F.pandas_udf("boolean")
    def room(na: pd.Series, nb: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
        if not len(na):
            return pd.Series([], dtype=bool)
        return pd.Series(np.minimum(_counts(pa), _counts(pb)).sum(1, dtype=np.int64) >= need(na.to_numpy(), nb.to_numpy(), rule))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{rule.den} * least(n_a, n_b) >= {rule.num} * greatest(n_a, n_b)")
    return sized.where(room("n_a", "n_b", "p_a", "p_b")).select("a", "b")


def _bloom(ids: DataFrame, n: int) -> np.ndarray:
    """Bit words of a Bloom filter, about 16 bits an id up to a bounded size."""
    bits = 1 << min(BLOOM_MAX_BITS.bit_length() - 1, max(12, int(16 * n).bit_length()))
    at = F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(bits)) for i in range(3))))
    words = ids.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    out = np.zeros(bits // 64, np.int64)
    rows = words.toPandas()  # as many as the filter has words, at most
    out[rows.w.to_numpy(np.int64)] = rows.v.to_numpy(np.int64)
    return out


def whole_sets(docs: DataFrame, known: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """(id, s): the whole sets of the given ids, one document's text read for each."""
    spark = docs.sparkSession
    ids = written(ids.select("id").distinct().join(known.select("id", "doc_id"), "id"))
    filt = spark.sparkContext.broadcast(_bloom(ids.select(F.col("doc_id").alias("id")), ids.count()))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = filt.value
        for pdf in batches:
            maybe = np.ones(len(pdf), bool)
            for p in (pdf.p0, pdf.p1, pdf.p2):
                p = p.to_numpy(np.int64) % (64 * len(words))
                maybe &= (words[p >> 6] >> (p & 63)) & 1 == 1
            got = [s for s in (_set(t, rule.words) for t in pdf.text[maybe]) if len(s)]
            yield pd.DataFrame({"id": [_name(s) for s in got], "s": [s.tobytes() for s in got]}, columns=["id", "s"])

    hashes = [F.coalesce(F.xxhash64("doc_id", F.lit(i)), F.lit(0)).alias(f"p{i}") for i in range(3)]
    with small_batches(spark, ROWS_OF_SETS):
        found = docs.select(*hashes, "text").mapInPandas(whole, "id long, s binary")
        out = written(found.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.first("s").alias("s")))
    discard(ids)
    return out


def verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of set ids that link, checked on the whole sets."""
    pairs = written(pairs.select("a", "b").distinct())
    found = whole_sets(docs, known, pairs.select(F.explode(F.array("a", "b")).alias("id")), rule)

    @F.pandas_udf("boolean")
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            out.append(rule.den * both >= rule.num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    with_sets = pairs.join(found.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(found.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")
    with small_batches(docs.sparkSession, ROWS_OF_SETS):
        out = written(with_sets.where(links("s_a", "s_b")).select("a", "b"))
    discard(found)
    discard(pairs)
    release(docs.sparkSession)
    return out


class RTree:
    """Packed R-tree over count vectors: a node keeps the largest count by group and its sizes' range."""

    def __init__(self, point: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((*point.T[:4], size))
        self.levels = [(point[self.order], size[self.order], size[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, q: np.ndarray, n: int, rule: Rule = RULE) -> np.ndarray:
        """Members whose bound with q reaches what a link needs."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[(rule.den * high[at] >= rule.num * n) & (rule.num * low[at] <= rule.den * n)]
            at = at[np.minimum(top[at], q).sum(1, dtype=np.int64) >= need(low[at], n, rule)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def _search(asked: pd.DataFrame, held: pd.DataFrame, cell: int, rule: Rule) -> pd.DataFrame:
    """Pairs of an asked and a held set of different components whose bound reaches what a link needs. Pairs whose first cells show that they meet in
    a cell before this one are left to that cell."""
    tree = RTree(_counts(held.point), held.n.to_numpy(np.int64))
    ids, roots, out = held.id.to_numpy(), held.root.to_numpy(), []
    first = np.stack(held["first"].to_list())
    first = np.where(first < cell, first, cell)
    for q, n, i, root, before in zip(_counts(asked.point), asked.n, asked.id, asked.root, asked["first"]):
        hit = tree.search(q, n, rule)
        hit = hit[(ids[hit] != i) & (roots[hit] != root)]
        hit = hit[~np.isin(first[hit], before[before < cell]).any(1)]
        out.append(np.stack([np.minimum(ids[hit], i), np.maximum(ids[hit], i)], 1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def unresolved(members: DataFrame, roots: DataFrame, known: DataFrame, rule: Rule, docs: DataFrame | None = None, level: int = 0) -> DataFrame:
    """Pairs of different components that an R-tree search of their common cells leaves open; a cell of two members is such a pair
    itself. The sets of crowded cells are first routed once more, among themselves. Of two components in a cell one at least is not the cell's most
    frequent, so only members of the others ask; they ask every block of the cell."""
    rows = rooted(members.select("cell", "id"), roots)
    by_root = rows.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.min("id").alias("a"), F.max("id").alias("b"))
    mixed = by_root.groupBy("cell").agg(
        F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("size"), F.sum("who").alias("who"), F.min("a").alias("a"), F.max("b").alias("b")
    )
    mixed = written(mixed.where("roots > 1"))
    two = bounded(mixed.where("size = 2").select("a", "b").distinct(), known, rule)
    # cells with the same members are searched once
    once = written(mixed.where("size > 2").groupBy("who", "size").agg(F.min(F.struct("cell", "most")).alias("c")).select("c.cell", "c.most", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    finer = None
    if not level and not once.where("blocks > 1").isEmpty():
        crowded = written(rows.join(once.where("blocks > 1"), "cell").select("id").distinct())
        finer = unresolved(written(within(docs, known, crowded, rule)), roots, known, rule, docs, level + 1)
        once = once.where("blocks = 1")
    # a pair is told in the first cell of both that is searched, as far as the first few cells of each show it
    first = rows.select("cell", "id").join(mixed.select("cell"), "cell").groupBy("id").agg(F.slice(F.array_sort(F.collect_list("cell")), 1, FIRST).alias("first"))
    first = first.select("id", F.slice(F.concat("first", F.array_repeat(F.lit(np.iinfo(np.int64).max), FIRST)), 1, FIRST).alias("first"))
    data = rows.join(once, "cell").join(known.select("id", "n", "point"), "id").join(first, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asks, every = F.col("root") != F.col("most"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    alone = data.where("blocks = 1").select("*", F.lit(0).alias("block"), F.lit(0).alias("part"), asks.alias("asks"), F.lit(True).alias("held"))
    held = data.where("blocks > 1").select("*", F.col("own").alias("block"), every.alias("part"), F.lit(False).alias("asks"), F.lit(True).alias("held"))
    asked = data.where("blocks > 1").where(asks).select("*", every.alias("block"), F.col("own").alias("part"), F.lit(True).alias("asks"), F.lit(False).alias("held"))
    tasks = alone.unionByName(held).unionByName(asked).select("cell", "block", "part", "asks", "held", "id", "root", "n", "point", "first")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, held = pdf.asks.to_numpy(bool), pdf.held.to_numpy(bool)
        return _search(pdf[asks], pdf[held], pdf.cell.iloc[0], rule) if asks.any() and held.any() else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    out = tasks.groupBy("cell", "block", "part").applyInPandas(search, "a long, b long").unionByName(two)
    return (out if finer is None else out.unionByName(finer)).distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of (id, other), the smaller first."""
    return pairs.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def second_tries(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b): the sets outside their cell's most frequent component with the heaviest of these, for each set's largest such cell and
    its heaviest such partner."""
    rows = rooted(members.select("cell", "id", "size", "weight"), roots)
    most = rows.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("roots"))
    others = written(rows.join(most.where("roots > 2"), "cell").where("root <> most").select("cell", "id", "size", "weight"))
    lead = others.groupBy("cell").agg(F.max(F.struct("weight", "id")).alias("leader"))
    tries = others.join(lead, "cell").groupBy("id").agg(F.max(F.struct("size", "leader"))["leader"]["id"].alias("a0"), F.max("leader")["id"].alias("a1"))
    return ordered(tries.select("id", F.explode(F.array("a0", "a1")).alias("other")))


def within(docs: DataFrame, known: DataFrame, crowded: DataFrame, rule: Rule) -> DataFrame:
    """(cell, id) of the second routing of the sets (id) that crowded cells hold, each routed once however many hold it."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, ids, band, spare = _members([(i, second_routes(np.frombuffer(s, np.uint64), rule)) for i, s in zip(pdf.id, pdf.s)])
            yield pd.DataFrame({"cell": cell.astype(np.int64), "id": ids, "band": band, "spare": spare})

    with small_batches(docs.sparkSession, ROWS_OF_SETS):
        rows = written(whole_sets(docs, known, crowded, rule).mapInPandas(route, MEMBER).distinct())
    return rarest(rows).select("cell", "id")


def ngram_join(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    stored = written(blocks(docs, BLOCK_BYTES))
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    rows = written(sets(stored, rule))
    known = written(rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("point").alias("point")))
    members = written(memberships(stored, int(total // BYTES_PER_BUCKET) + 1, rule))
    release(docs.sparkSession)
    # each set tries the leader of its largest cell and the heaviest leader it meets: most near copies join one component here
    tries = members.groupBy("id").agg(F.max(F.struct("size", "leader"))["leader"]["id"].alias("a0"), F.max("leader")["id"].alias("a1"))
    star = written(bounded(ordered(tries.select("id", F.explode(F.array("a0", "a1")).alias("other"))), known, rule))
    links = verified(docs, known, star, rule)
    # then those outside a cell's most frequent component try the heaviest of theirs
    again = written(bounded(second_tries(members, written(components(links))), known, rule).join(star, ["a", "b"], "left_anti"))
    links = links.unionByName(verified(docs, known, again, rule))
    star, roots = star.unionByName(again), written(components(links))
    more = verified(docs, known, unresolved(members, roots, known, rule, docs).join(star, ["a", "b"], "left_anti"), rule)
    roots = components(links.unionByName(more))
    named = known.select(F.col("id").alias("node"), "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = written(named.join(low, "root").select(F.col("node").alias("id"), "component_id"))
    full = rows.where("id is not null").join(of, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The rows of docs, all columns, without those that link with a row before them: of each component the row with the smallest doc_id stays
    (null last; of rows that share it, one)."""
    ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    keep, row = fresh(docs, "keep_id", "row_id")
    if ids[0] == ids[1]:
        named = ngram_join(docs, rule).where("doc_id = component_id").select(F.col("doc_id").alias(keep))
        return docs.join(named, F.col("doc_id") == F.col(keep), "left_semi")
    # rows that share a doc_id, or have none, are told apart by a number of their own
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    of = written(ngram_join(rows.select(F.col(row).alias("doc_id"), "text"), rule).select(F.col("doc_id").alias(row), "component_id"))
    best = rows.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("order")).join(of, row)
    best = best.groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order")[row].alias(row))
    return rows.join(best, row, "left_semi").select(*docs.columns)
