"""Suffix-array dedup by depth-limited radix passes over byte suffixes.

Every byte covered by a `depth`-byte string that also starts in a document with a smaller doc_id goes. Suffixes
are ordered only through their first `depth` bytes, from the most significant digit on; after each
pass only groups that still hold two documents are refined, and equal groups at full depth are the repeated windows:

1. Digit one is a `GRAM`-byte string at an anchor. Anchors are the smallest hashes of each window (minimisers): which
   anchor a window has depends on its bytes alone, so equal windows meet under equal anchors, and a suffix
   whose anchor string is in no other document is repeated nowhere and drops out.
2. Digit two is the whole stretch of bytes that windows around the anchor reach. A stretch that a smaller document holds
   too is removed as one; one that is alone under its anchor string drops out.
3. What is left - borders of repeats - is refined to full depth, window by window.

A pass sends keys from blocks of text to buckets: a block sends a key once, with its smallest doc_id, so the most common
string costs one entry a block; the bucket answers with bits, in the order of the keys. Blocks
(compressed text) are written to the shared folder once, bucketed by their number so that answers
come to them without a shuffle of text, and hashed anew in each pass, which costs less than keeping positions. Keys are compared by 96 bits of hash (38 and more in pass 1, which only filters).

Edge cases: null text is empty; texts shorter than `depth` lose nothing; a repeated doc_id is not smaller than itself; a null doc_id counts as
larger than all; an empty table gives an empty result; extra columns are ignored; text is any UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import bucketed, release, whole_id, written
from .hashing import U

DEPTH = 50
GRAM = 25
BLOCK_BYTES = 2_000_000
KEYS_PER_BUCKET = 1_000_000
LAST = np.iinfo(np.int64).max
BLOCK = "block long, n_bytes long, data binary, ids binary, known binary, sizes binary"
ASKED = "bucket int, block long, keys binary, checks binary, docs binary, ids binary, low binary, high binary"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of about `block_bytes` of text: its bytes compressed, the doc_ids and the sizes."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1)
        ids, texts, total = [], [], 0

        def row() -> pd.DataFrame:
            sizes = np.array([len(t) for t in texts], np.int64)
            known = np.array([i is not None for i in ids], bool)
            return pd.DataFrame({"block": [(task << 32) + made], "n_bytes": [total], "data": [pack.compress(b"".join(texts))], "ids": [np.array([LAST if i is None else i for i in ids], np.int64).tobytes()], "known": [known.tobytes()], "sizes": [sizes.tobytes()]})

        for pdf in batches:
            for doc_id, none, text in zip(pdf.doc_id, pdf.none, pdf.text):
                ids.append(None if none else int(doc_id))
                texts.append((text or "").encode("utf-8", "replace"))
                total += len(texts[-1])
                if total >= block_bytes:
                    yield row()
                    ids, texts, total, made = [], [], 0, made + 1
        if ids:
            yield row()

    return docs.select(*whole_id("doc_id"), "text").mapInPandas(build, BLOCK)


def doc_ids(row) -> list[int | None]:
    """The doc_ids of a block's texts; nulls stand apart from the largest long."""
    return [i if known else None for i, known in zip(np.frombuffer(row.ids, np.int64).tolist(), row.known)]


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or largest) of every `width` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        x = least(x[:-n], x[n:])
        n *= 2
    return least(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def flags(answers: list, n: int) -> np.ndarray:
    """Bits of all buckets in key order, as bytes."""
    some = isinstance(answers, (list, np.ndarray))
    got = [np.frombuffer(x["bits"], np.uint8) for x in sorted(answers, key=lambda x: x["bucket"])] if some else []
    return np.concatenate(got) if got else np.zeros(n, np.uint8)


class Block:
    """A block's anchors and, pass by pass, what is known of them."""

    def __init__(self, row, depth: int):
        data = zstandard.ZstdDecompressor().decompress(row.data)
        self.a, self.depth, self.reach = np.frombuffer(data, np.uint8), depth, depth - GRAM
        self.ids, self.sizes = np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64)
        self.named = doc_ids(row)
        self.end = np.cumsum(self.sizes)
        self.start = self.end - self.sizes
        n, none = len(self.a), np.zeros(0, np.uint64)
        self.at, self.gram, self.best = np.zeros(0, np.int64), none, none
        if n >= depth:
            gram = hashing.mix(hashing.windows(self.a, GRAM)) | U(1)
            best = _slide(gram, self.reach + 1, np.minimum)
            for s, e in zip(self.start, self.end):  # windows that would leave their document
                best[max(s, e - depth + 1) : e] = 0
            self.best = best
            pad = np.zeros(self.reach, np.uint64)
            over = _slide(np.concatenate([pad, best, pad]), self.reach + 1, np.maximum)
            self.at = np.flatnonzero(over == gram)
            self.gram = gram[self.at]
        self.doc = np.searchsorted(self.end, self.at, side="right")
        self.id = self.ids[self.doc] if len(self.at) else np.zeros(0, np.int64)

    def groups(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, group of each entry, and each group's smallest and largest doc_id."""
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.flatnonzero(new)
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(new) - 1
        low, high = (f.reduceat(ids[order], at) if len(at) else ids for f in (np.minimum, np.maximum))
        return k[at], group, low, high

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.gram, self.doc, self.id = self.at[mask], self.gram[mask], self.doc[mask], self.id[mask]

    def first_digit(self) -> np.ndarray:
        self.keys, self.group, low, high = self.groups(self.gram, self.id)
        self.inside = low != high
        return self.keys

    def after_first(self, answers) -> None:
        keys = self.first_digit()
        self.keep((self.inside | (flags(answers, len(keys)) > 0))[self.group] if len(keys) else np.zeros(0, bool))
        self.left = np.maximum(self.start[self.doc], self.at - self.reach) if len(self.at) else self.at
        self.right = np.minimum(self.end[self.doc], self.at + self.depth) if len(self.at) else self.at

    def strings(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the bytes [left, right)."""
        out = []
        for base in (hashing.BASE, hashing.BASE2):
            h = hashing.stretches(self.a, left, right, base)
            out.append(hashing.mix(h + (right - left).astype(np.uint64) * U(0x9E3779B97F4A7C15)))
        return out[0], (out[1] >> U(32)).astype(np.uint32)

    def second_digit(self) -> dict:
        self.whole, self.check = self.strings(self.left, self.right)
        self.whole = hashing.mix(self.whole + self.gram + (self.at - self.left).astype(np.uint64))
        wkeys, self.wgroup, self.wlow, _ = self.groups(self.whole, self.id)
        gkeys, self.ggroup, self.glow, _ = self.groups(self.gram, self.id)
        short = (self.whole >> U(32)).astype(np.int64)
        _, _, low, high = self.groups(self.gram, short)
        return {"whole": (wkeys, self.representative(self.wgroup, self.check), self.wlow, None, None), "gram": (gkeys, None, self.glow, low.astype(np.uint32), high.astype(np.uint32))}

    @staticmethod
    def representative(group: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(int(group.max()) + 1 if len(group) else 0, values.dtype)
        out[group] = values
        return out

    def after_second(self, whole, gram) -> None:
        """Splits anchors into those whose stretch goes, and those whose windows must be asked for."""
        self.second_digit()
        smaller, contested = flags(whole, len(self.wlow)) & 1, flags(gram, len(self.glow)) >> 1
        full = (smaller[self.wgroup] > 0) | (self.id > self.wlow[self.wgroup]) if len(self.at) else np.zeros(0, bool)
        self.gone = (self.left[full], self.right[full])
        if len(self.at):
            self.keep(~full & (contested[self.ggroup] > 0))
        place = self.at[:, None] + np.arange(-self.reach, 1)
        there = (place >= 0) & (place < len(self.best))
        there[there] = self.best[place[there]] == np.broadcast_to(self.gram[:, None], place.shape)[there]
        self.window = np.unique(place[there])
        self.window_id = self.ids[np.searchsorted(self.end, self.window, side="right")] if len(self.window) else np.zeros(0, np.int64)

    def last_digit(self) -> dict:
        key, check = self.strings(self.window, self.window + self.depth)
        keys, self.xgroup, self.xlow, _ = self.groups(key, self.window_id)
        return {"window": (keys, self.representative(self.xgroup, check), self.xlow, None, None)}

    def result(self, window) -> pd.DataFrame:
        self.last_digit()
        edge = np.zeros(len(self.a) + 1, np.int32)
        np.add.at(edge, self.gone[0], 1)
        np.add.at(edge, self.gone[1], -1)
        if len(self.window):
            dup = (flags(window, len(self.xlow)) & 1)[self.xgroup].astype(bool) | (self.window_id > self.xlow[self.xgroup])
            np.add.at(edge, self.window[dup], 1)
            np.add.at(edge, self.window[dup] + self.depth, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = []
        for doc_id, s, e in zip(self.named, self.start.tolist(), self.end.tolist()):
            own = gone[s:e]
            flip = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            spans = [{"start": x, "end": y} for x, y in zip(flip[::2].tolist(), flip[1::2].tolist())]
            rows.append((doc_id, e - s, spans, self.a[s:e][~own].tobytes()))
        # not from a column of longs and Nones, which pandas would take for floats
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"]).assign(doc_id=pd.array(self.named, "Int64"))


def block_requests(block: int, n_buckets: int, keys, checks=None, docs=None, low=None, high=None) -> pd.DataFrame:
    """Rows of one block's sorted keys, cut where the bucket changes."""
    bucket = ((keys >> U(32)) * U(n_buckets)) >> U(32)
    at = np.concatenate(([0], np.flatnonzero(np.diff(bucket.view(np.int64))) + 1, [len(keys)]))
    parts = []
    for s, e in zip(at[:-1], at[1:]):
        cut = [None if x is None else x[s:e].tobytes() for x in (checks, low, high)]
        ids = place = None
        if docs is not None:
            ids, place = np.unique(docs[s:e], return_inverse=True)
            ids, place = ids.tobytes(), place.astype("<u4" if len(ids) > 65535 else "<u2").tobytes()
        parts.append((int(bucket[s]), block, keys[s:e].astype(np.uint32).tobytes() if docs is None else keys[s:e].tobytes(), cut[0], place, ids, cut[1], cut[2]))
    return pd.DataFrame(parts, columns=["bucket", "block", "keys", "checks", "docs", "ids", "low", "high"])


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per key: bit 0, another block has it with a smaller doc_id (or has it at all, if no ids came); bit 1, different stretches."""
    plain = pdf.docs.iloc[0] is None
    sizes = [len(k) // (4 if plain else 8) for k in pdf["keys"]]
    keys = np.frombuffer(b"".join(pdf["keys"]), np.uint32 if plain else np.uint64)
    if pdf.checks.iloc[0] is not None:
        check = np.frombuffer(b"".join(pdf.checks), np.uint32)
        order = np.lexsort((check, keys))
        new = np.concatenate(([True], (np.diff(keys[order]) != 0) | (np.diff(check[order]) != 0)))
    else:
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], np.diff(keys[order]) != 0))
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    if plain:
        bits = (np.diff(np.append(at, len(keys))) > 1)[group].astype(np.uint8)
    else:
        docs = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(d, "<u2" if len(i) <= 8 * 65535 else "<u4")] for i, d in zip(pdf.ids, pdf.docs)])[order]
        bits = (np.minimum.reduceat(docs, at)[group] < docs).astype(np.uint8)
        if pdf.low.iloc[0] is not None:
            low, high = (np.frombuffer(b"".join(x), np.uint32)[order] for x in (pdf.low, pdf.high))
            bits |= (np.minimum.reduceat(low, at) != np.maximum.reduceat(high, at))[group].astype(np.uint8) << 1
    out = np.empty(len(keys), np.uint8)
    out[order] = bits
    cuts = np.cumsum([0, *sizes])
    return pd.DataFrame({"block": pdf.block, "bucket": pdf.bucket, "bits": [out[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:])]})


def block_answers(requests: DataFrame, name: str) -> DataFrame:
    """One row per block: its answers by bucket."""
    answers = requests.groupBy("bucket").applyInPandas(_answer, "block long, bucket int, bits binary")
    return written(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)))


def suffix_dedup(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs) and kept (remaining bytes) of every row."""
    if depth <= GRAM:
        raise ValueError(f"depth must be over {GRAM} bytes")
    stored = bucketed(blocks(docs, block_bytes), "block")
    release(docs.sparkSession)
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(1, int(total * 2 / (depth - GRAM + 2) / keys_per_bucket) + 1)
    answers: list[DataFrame] = []

    def replay(row) -> Block:
        b = Block(row, depth)
        if hasattr(row, "first"):
            b.after_first(row.first)
        if hasattr(row, "whole"):
            b.after_second(row.whole, row.gram)
        return b

    def ask(step, *names: str) -> None:
        """Sends the keys of `step` for every block; the answers become columns of the blocks."""
        known = stored
        for a in answers:
            known = known.join(a, "block", "left")

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    for name, (keys, *rest) in step(replay(row)).items():
                        if len(keys):
                            yield block_requests(row.block, n_buckets, keys, *rest).assign(name=name)

        sent = known.mapInPandas(send, f"{ASKED}, name string")
        if len(names) > 1:  # both kinds of keys come from one reading of the text
            asked = sent.groupBy("bucket", "name").applyInPandas(lambda pdf: _answer(pdf).assign(name=pdf.name.iloc[0]), "block long, bucket int, bits binary, name string")
            got = written(asked.groupBy("block").agg(*(F.collect_list(F.when(F.col("name") == n, F.struct("bucket", "bits"))).alias(n) for n in names)))
            answers.append(got)
        else:
            answers.append(block_answers(sent, names[0]))

    passes = (lambda b: {"first": (b.first_digit(), None, None, None, None)}, "first"), (lambda b: b.second_digit(), "whole", "gram"), (lambda b: b.last_digit(), "window")
    for p in passes:
        ask(*p)
        release(docs.sparkSession)  # the pass's shuffles are done with
    known = stored
    for a in answers:
        known = known.join(a, "block", "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield replay(row).result(row.window)

    return known.mapInPandas(finish, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
