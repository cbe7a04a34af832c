"""Exact dedup through a sharded cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z; the row with the largest
doc_id of each group stays. Every text becomes the SHA-256 of its normalised UTF-8 bytes.
Digests are dealt to shards by their leading bits. A shard keeps a cuckoo filter (four
16-bit fingerprints a bucket) and, beside each slot, the stored key: the whole digest, the
largest live doc_id and the number of live rows. A fingerprint hit is verified against the
keys of its two buckets; a miss is a new key. When an insertion kicks too long, the filter
doubles and is refilled from the stored keys. Deletion takes a live row away; a key whose
last row goes leaves the filter.

Copies are combined within each Arrow batch before the shuffle, so a shard reads at most
one row per digest and batch however large the group of copies is. Shards are sized by the
number of rows, so a task holds a bounded number of keys.

Edge cases: null text counts as empty, so nulls and empty texts form one group; repeated
rows count in group_size; an empty table gives an empty result; extra columns are ignored.
A null doc_id is the smallest of its group, and keep_id is null if all of them are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, written

SLOTS = 4
MAX_KICKS = 200
ROWS_PER_SHARD = 100_000
KEYS = "shard int, digest binary, keep_id long, refs long, slot int, n_buckets int"


class CuckooShard:
    """Cuckoo filter over digests, with the stored keys beside the slots."""

    def __init__(self, n_buckets: int = 64):
        self.keys: list[list] = []  # [digest, keep_id, refs]; None where deleted
        self._empty(n_buckets)

    def _empty(self, n_buckets: int) -> None:
        self.n = n_buckets
        self.prints = [0] * (n_buckets * SLOTS)
        self.owner = [-1] * (n_buckets * SLOTS)

    def _place(self, digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0) and first bucket; bytes 0-3 chose the shard."""
        return int.from_bytes(digest[4:6], "little") or 1, int.from_bytes(digest[6:12], "little") & (self.n - 1)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n - 1)

    def find(self, digest: bytes) -> int:
        """Slot of the digest, or -1. Fingerprint hits are checked against the stored keys."""
        fp, b = self._place(digest)
        for bucket in (b, self._other(b, fp)):
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[s] == fp and self.keys[self.owner[s]][0] == digest:
                    return s
        return -1

    def _try(self, key: int) -> bool:
        fp, b = self._place(self.keys[key][0])
        for kick in range(MAX_KICKS):
            for bucket in (b, self._other(b, fp)):
                for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.owner[s] = fp, key
                        return True
            b = self._other(b, fp) if kick % 2 else b
            s = b * SLOTS + kick % SLOTS
            fp, self.prints[s] = self.prints[s], fp
            key, self.owner[s] = self.owner[s], key
            b = self._other(b, fp)
        return False

    def _resize(self) -> None:
        live = [k for k in self.keys if k]
        n = self.n
        while True:
            n *= 2
            self.keys = live
            self._empty(n)
            if all(self._try(i) for i in range(len(live))):
                return

    def insert(self, digest: bytes, keep_id, refs: int) -> None:
        s = self.find(digest)
        if s >= 0:
            key = self.keys[self.owner[s]]
            key[1] = keep_id if key[1] is None else key[1] if keep_id is None else max(key[1], keep_id)
            key[2] += refs
            return
        self.keys.append([digest, keep_id, refs])
        if not self._try(len(self.keys) - 1):
            self._resize()

    def delete(self, digest: bytes, refs: int) -> bool:
        """Take live rows away; True if the digest was live."""
        s = self.find(digest)
        if s < 0:
            return False
        key = self.keys[self.owner[s]]
        key[2] -= refs
        if key[2] <= 0:
            self.keys[self.owner[s]] = None
            self.prints[s], self.owner[s] = 0, -1
        return True

    @classmethod
    def restore(cls, state: pd.DataFrame) -> CuckooShard:
        shard = cls(int(state.n_buckets.iloc[0]) if len(state) else 64)
        none = state.none if "none" in state else state.keep_id.isna()
        for digest, keep_id, no_id, refs, slot in zip(state.digest, state.keep_id, none, state.refs, state.slot):
            shard.keys.append([bytes(digest), None if no_id else int(keep_id), int(refs)])
            shard.prints[slot] = shard._place(bytes(digest))[0]
            shard.owner[slot] = len(shard.keys) - 1
        return shard

    def state(self, shard: int) -> pd.DataFrame:
        at = [(k, s) for s, k in enumerate(self.owner) if k >= 0]
        digest, keep_id, refs = zip(*(self.keys[k] for k, _ in at)) if at else ((), (), ())
        return pd.DataFrame({"shard": shard, "digest": list(digest), "keep_id": pd.array(list(keep_id), "Int64"), "refs": list(refs), "slot": [s for _, s in at], "n_buckets": self.n})


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row, from the whole normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(lower_ascii(F.col("text")), 256)).alias("digest"))


def _combined(rows: DataFrame, n_shards: int) -> DataFrame:
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pdf.assign(refs=1).groupby("digest", sort=False, dropna=False).agg({"doc_id": "max", "none": "min", "refs": "sum"}).reset_index()
            got["shard"] = [int.from_bytes(d[:4], "big") % n_shards for d in got.digest]
            yield got[["shard", "digest", "doc_id", "none", "refs"]]

    # a null is the smallest, and pandas must not see it: longs with nulls would become floats
    whole = (F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "digest")
    return rows.select(*whole).mapInPandas(combine, "shard int, digest binary, doc_id long, none boolean, refs long")


def build_index(rows: DataFrame, n_shards: int) -> DataFrame:
    """Index rows (KEYS) of all (doc_id, digest) rows: the stored keys and their filter slots."""

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = CuckooShard()
        for digest, doc_id, none, refs in zip(pdf.digest, pdf.doc_id, pdf.none, pdf.refs):
            shard.insert(bytes(digest), None if none else int(doc_id), int(refs))
        return shard.state(key[0])

    return _combined(rows, n_shards).groupBy("shard").applyInPandas(fill, KEYS)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, n_shards: int, live: DataFrame | None = None) -> DataFrame:
    """The index after taking rows out and then adding rows. With the rows that were `live` before, a key whose largest doc_id may
    have gone gets the largest of those left; without them such a key keeps the old one, as the index holds digests, not rows."""
    changes = _combined(inserts, n_shards).withColumn("gone", F.lit(False)).unionByName(_combined(deletes, n_shards).withColumn("gone", F.lit(True)))

    def apply(key: tuple, state: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = CuckooShard.restore(state)
        for gone, digest, doc_id, none, refs in sorted(zip(new.gone, new.digest, new.doc_id, new.none, new.refs), key=lambda r: not r[0]):
            if gone:
                shard.delete(bytes(digest), int(refs))
            else:
                shard.insert(bytes(digest), None if none else int(doc_id), int(refs))
        return shard.state(key[0])

    whole = index.withColumn("none", F.col("keep_id").isNull()).withColumn("keep_id", F.coalesce("keep_id", F.lit(0).cast("long")))
    out = whole.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, KEYS)
    if live is None:
        return out
    signed = lambda df, n: df.select("doc_id", "digest", F.lit(n).alias("n"))
    left = signed(live, 1).unionByName(signed(deletes, -1)).unionByName(signed(inserts, 1)).join(deletes.select("digest").distinct(), "digest", "left_semi")
    left = left.groupBy("digest", "doc_id").agg(F.sum("n").alias("n")).where("n > 0").groupBy("digest").agg(F.max("doc_id").alias("largest"), F.lit(True).alias("touched"))
    rows = out.join(left, "digest", "left").withColumn("keep_id", F.when(F.col("touched"), F.col("largest")).otherwise(F.col("keep_id")))
    return rows.select("shard", "digest", "keep_id", "refs", "slot", "n_buckets")


def exact_dedup(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    rows = written(digests(docs))
    n_shards = max(1, -(-rows.count() // rows_per_shard))
    keys = build_index(rows, n_shards).select("digest", "keep_id", F.col("refs").alias("group_size"))
    return rows.join(keys, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def one_of_each(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The rows of docs that stay, all columns; rows that also share the doc_id count as one row."""
    kept_id, kept_digest, own = fresh(docs, "kept_id", "kept_digest", "own_digest")
    stays = written(exact_dedup(docs, rows_per_shard).where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_digest)))
    rows = docs.withColumn(own, F.unhex(F.sha2(lower_ascii(F.col("text")), 256)))
    kept = rows.join(stays.distinct(), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    if stays.distinct().count() < stays.count():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)
