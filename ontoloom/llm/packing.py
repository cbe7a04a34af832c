"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are those of a public tokenizer without special tokens, then one end id.
Ids are cut into whole windows and pieces of at most `max_piece` ids. Pieces are dealt by a
hash into blocks of a bounded number of pieces; within a block, k-way differencing starts
from one partial partition per piece and keeps merging the two partial partitions with
the largest spreads, the fullest windows of one on the emptiest of the other, into k near-equal
windows. k starts at ceil(ids / capacity) and rises while a window exceeds the capacity.

Edge cases: null text is empty and gives one piece holding the end id; a very long document
gives many pieces, dealt over the blocks; repeated rows are packed each; an empty table gives an
empty result; extra columns are ignored; a null doc_id is carried.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_again, whole_id, written

CAPACITY = 2048
MAX_PIECE = 512
END_ID = 1
PIECES_PER_BLOCK = 1024
CACHED_WORDS = 400_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceIds(dict):
    """Little-endian uint32 ids of pieces of lower-cased words, by the tokenizer's model alone; the first CACHED_WORDS are kept."""

    #: The characters that stand for the bytes of a piece in the model's vocabulary.
    byte_names = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.byte_names)
        ids = b"".join([self.packed[t.id] for t in self.model.tokenize(name)])
        if len(self) < CACHED_WORDS:
            self[piece] = ids
        return ids


class WordIds(dict):
    """Little-endian uint32 ids of words. This tokenizer drops white space and never merges across it, so a
    text's ids are those of its words joined; the first CACHED_WORDS words a worker meets are kept. Words of printable ASCII and
    Latin-1 letters, which its normalizer only lower-cases, go piece by piece; other words are encoded by the tokenizer, as are whole
    texts with a separator that only Python takes for white space, or with a special token's text."""

    unusual = re.compile(r"[\x1c-\x1f]|<\|")
    plain = re.compile("[!-~À-ÖØ-öø-ÿ]*")
    pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")  # fixed: the tokenizer's own pattern, for plain words

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.piece_ids = PieceIds(self.tokenizer)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.plain.fullmatch(word):
            ids = b"".join(map(self.piece_ids.__getitem__, self.pieces.findall(word.lower())))
        else:
            ids = self.encode(word)
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return self.encode(text) if self.unusual.search(text) else b"".join(map(self.__getitem__, text.split()))


_CODERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id (0 where it is `none`), start, length, ids_crc32, doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _CODERS.get(tokenizer) or _CODERS.setdefault(tokenizer, WordIds(tokenizer))
        for pdf in batches:
            rows = []
            for doc_id, none, ids in zip(pdf.doc_id, pdf.none, (coder.text(t or "") for t in pdf.text)):
                ids += end
                n, at = len(ids) // 4, 0
                while at < n:
                    size = capacity if n - at >= capacity else min(max_piece, n - at)
                    rows.append((doc_id, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, none))
                    at += size
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "none"])

    return docs.select(*whole_id("doc_id"), "text").mapInPandas(cut, f"{PIECE}, none boolean")


def difference(lengths: list[int], k: int) -> tuple[np.ndarray, int]:
    """Window of each length among k near-equal windows, and the largest window."""
    # a partial partition: descending sums of its windows that hold something, and a tree node for each
    heap = [(-x, i, np.array([x], np.int64), np.array([i])) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    n, made, left, right = len(lengths), len(lengths), [], []
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
        else:  # the fullest of one meets the emptiest of the other
            b, nb = b[::-1], nb[::-1]
            new = np.arange(n + len(left), n + len(left) + both)
            left.extend(na[len(a) - both :].tolist())
            right.extend(nb[:both].tolist())
            sums = np.concatenate([a[: len(a) - both], a[len(a) - both :] + b[:both], b[both:]])
            nodes = np.concatenate([na[: len(a) - both], new, nb[both:]])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        made += 1
        heapq.heappush(heap, (-spread, made, sums, nodes))
    _, _, sums, nodes = heap[0]
    window = np.zeros(n + len(left), np.int64)
    window[nodes] = np.arange(len(nodes))
    for i in range(len(left) - 1, -1, -1):
        window[left[i]] = window[right[i]] = window[n + i]
    return window[:n], int(sums[0])


def pack_block(lengths: list[int], capacity: int) -> np.ndarray:
    """Window of each piece; no window holds more than the capacity."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        window, most = difference(lengths, k)
        if most <= capacity:
            return window
        k += 1


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, pieces_per_block: int = PIECES_PER_BLOCK) -> DataFrame:
    """One row per piece, with sequence_id, offset in it and the sequence's length."""
    cut = written(pieces(docs, tokenizer or default_tokenizer(), capacity, max_piece))
    n_blocks = max(1, -(-cut.count() // pieces_per_block))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=False, ignore_index=True)
        window = np.arange(len(pdf))
        short = np.flatnonzero(pdf.length.to_numpy() < capacity)
        if len(short):
            window[short] = len(pdf) + pack_block(pdf.length.to_numpy()[short].tolist(), capacity)
        pdf["sequence_id"] = key[0] * (1 << 32) + window
        by = pdf.groupby("sequence_id").length
        pdf["offset"] = by.cumsum() - pdf.length
        pdf["sequence_length"] = by.transform("sum")
        return pdf.drop(columns="block")

    # a number of its own deals out equal rows as well
    blocks = cut.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))
    placed = blocks.groupBy("block").applyInPandas(place, f"{PIECE}, none boolean, sequence_id long, offset long, sequence_length long")
    return placed.select(id_again("doc_id"), *(c for c in placed.columns if c not in ("doc_id", "none")))
