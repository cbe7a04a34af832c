"""LM scoring by online logistic context mixing over counts that grow with the corpus.

A text is its lower-cased words and one end token. A token is coded by binary decisions, richest context first: does it
follow the last two words in some other training text? else, does it follow the last word? else, is it known? A yes is
followed by the token's share of that context's count; the last no by the spelling, bit by bit, each bit a decision as well. Every decision
is predicted from several contexts - how often the history has occurred, the outcomes before, the hashed last word -
each by the zeros and ones it has seen in all training texts. Their logits are summed with weights that a gate
picks and that each text learns online as it goes, and a table indexed by the mixed logit, adapted along the text as well,
refines the result. The spelling mixes contexts of one, two, three and five letters in the same way: a text starts from the weights and the table that the
distinct training words have taught, and goes on learning from the words it spells.
The score is the sum of log10 over all decisions; over n bytes, it is bits per byte.

What is gathered are the counts of all words, pairs and triples of the training texts, in buckets whose number follows
the input; a pair or triple is named by its bucket and 32 bits of hash. A training text is scored by what the other texts hold: its
own counts are taken out. The tables of the decisions and of the spelling have a fixed size, whatever the input, and are broadcast.

Work is dealt in blocks of text. A block sends each of its words, pairs and triples once with its count, and gets the sums
back in the same order, so a word that occurs everywhere costs a bucket one entry a block, and no list of documents exists.
A score depends on the texts alone, not on how they are dealt.

Edge cases: null and empty texts are one end token; very long texts are scored whole; without training texts every
token is spelled and the base counts are zero; rows of one doc_id are texts of their own; a null doc_id belongs to the training part
(its crc32 is null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import bucketed, discard, release, written
from .hashing import U
from .mixing_model import GROUP_BITS, LETTER_BITS, Bits, Mixer, Shape, hashed, online, scattered, tally
from .suffix_dedup import blocks, doc_ids

BLOCK_BYTES = 4_000_000
KEYS_PER_BUCKET = 800_000
WORDS_PER_BUCKET = 400_000
CHUNK_WORDS = 20_000
LETTERS = Shape(sizes=(1 << 16, 1 << 17, 1 << 18, 1 << 18), kinds=2, sure=(3, 2))
END_HASH, START_HASH = U(0x1234567), U(0x7654321)
TWO, THREE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Slots of the decisions' contexts: frequencies, three outcomes, frequency and run, frequency and outcomes, hashed last word.
SLOTS = (3 * 256, 3 * 64, 3 * 512, 3 * 256, 3 << 12)
GATES = 12
PLACES = 1 << 20


def _pack(x: np.ndarray, kind=np.uint32) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _unpack(x: bytes, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


class Grouped(NamedTuple):
    keys: np.ndarray  # sorted and distinct
    of: np.ndarray  # group of each token
    counts: np.ndarray  # training occurrences by key
    own: np.ndarray  # by token, the key's training occurrences in the token's own document


class Text:
    """Tokens of a block: hashes of words in order, with an end after each document."""

    def __init__(self, row):
        self.data = zstandard.ZstdDecompressor().decompress(row.data).lower()
        self.ids, self.sizes = doc_ids(row), np.frombuffer(row.sizes, np.int64)
        self.train = np.array([i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i in self.ids], bool)
        a, end = np.frombuffer(self.data, np.uint8), np.cumsum(self.sizes)
        word, at = hashing.block_words(a, end - self.sizes) if len(a) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.n_tokens = np.diff(np.concatenate(([0], np.searchsorted(at, end)))) + 1
        self.doc = np.repeat(np.arange(len(self.sizes)), self.n_tokens)
        self.last = np.cumsum(self.n_tokens) - 1
        self.first = self.last - self.n_tokens + 1
        self.hash = np.full(len(self.doc), END_HASH)
        is_word = np.ones(len(self.hash), bool)
        is_word[self.last] = False
        self.hash[is_word] = word
        self.at = np.full(len(self.hash), len(a))  # where each word starts; an end is an empty word
        self.at[is_word] = at

    def before(self, x: np.ndarray, start, steps: int = 1) -> np.ndarray:
        """Each token's value `steps` places earlier in its document."""
        out = np.full(len(x), start, x.dtype)
        out[steps:] = x[: len(x) - steps]
        for k in range(steps):
            out[np.minimum(self.first + k, self.last)] = start
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each token with the one and the two before it."""
        back = self.before(self.hash, START_HASH)
        two = back * TWO + self.hash
        return hashing.mix(two), hashing.mix(self.before(self.hash, START_HASH, 2) * THREE + two * TWO)

    def grouped(self, keys: np.ndarray) -> Grouped:
        n, low = len(keys), U(PLACES - 1)
        # places ride in the low bits, so sorting values also orders a key's tokens; rarely two keys differ there only
        at = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64)) if n < PLACES else None
        order = np.argsort(keys, kind="stable") if at is None else (at & low).astype(np.int64)
        k = keys[order]
        new = np.ones(n, bool)
        new[1:] = k[1:] != k[:-1]
        if at is not None and (new[1:] & (at[1:] ^ at[:-1] <= low)).any():
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            new[1:] = k[1:] != k[:-1]
        d = self.doc[order]
        run = new.copy()
        run[1:] |= d[1:] != d[:-1]
        starts, runs = np.flatnonzero(new), np.flatnonzero(run)
        sizes = np.diff(np.append(runs, n))
        trained = sizes * self.train[d[runs]]
        of, own = np.empty(n, np.int32), np.empty(n, np.int32)
        of[order] = np.cumsum(new, dtype=np.int32) - 1
        own[order] = np.repeat(trained.astype(np.int32), sizes)
        return Grouped(k[starts], of, np.add.reduceat(trained, np.flatnonzero(new[runs])) if n else trained, own)

    def spellings(self, group: Grouped) -> list[bytes]:
        """A spelling of each distinct token; an end has an empty one."""
        words, at = [], 0
        for size in self.sizes.tolist():
            words += self.data[at : at + size].split()
            words.append(b"")
            at += size
        where = np.zeros(len(group.keys), np.int64)
        where[group.of] = np.arange(len(group.of))
        return [words[i] for i in where.tolist()]

    def spelled(self, tokens: np.ndarray) -> bytes:
        """The words of some tokens, with a space between two."""
        a = np.frombuffer(self.data, np.uint8)
        spaces = np.append(hashing.separators(a), len(a))
        start = self.at[tokens]
        end = np.minimum(spaces[np.searchsorted(spaces, start)], np.cumsum(self.sizes)[self.doc[tokens]])
        return b" ".join([self.data[s:e] for s, e in zip(start.tolist(), end.tolist())])


def _cuts(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted keys dealt by their upper bits."""
    bucket = (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)
    at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    return [(int(bucket[s]), s, e) for s, e in zip(at[:-1].tolist(), at[1:].tolist())] if len(bucket) else []


def each_row(of: Callable) -> Callable:
    """For mapInPandas: a frame of each row. What a row took is free before the next row is begun."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from map(of, pdf.itertuples())

    return run


def words_sent(stored: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, block, words, keys, counts): each block's distinct tokens."""

    def send(row) -> pd.DataFrame:
        text = Text(row)
        g = text.grouped(text.hash)
        words = text.spellings(g)
        rows = [(b, row.block, b"\n".join(words[s:e]), g.keys[s:e].tobytes(), _pack(g.counts[s:e])) for b, s, e in _cuts(g.keys, n_buckets)]
        return pd.DataFrame(rows, columns=["bucket", "block", "words", "keys", "counts"])

    return stored.mapInPandas(each_row(send), "bucket long, block long, words binary, keys binary, counts binary")


def _gathered(pdf: pd.DataFrame):
    """Distinct keys of a bucket, the first entry of each, the group of each entry, and counts."""
    keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
    counts = np.concatenate([_unpack(c) for c in pdf.counts])
    got, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return got, first, group, np.bincount(group, counts, len(got)).astype(np.int64)


def vocabulary(sent: DataFrame) -> DataFrame:
    """(bucket, hash, word, n) of every distinct token of the training texts."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        got, first, _, n = _gathered(pdf)
        words = [w for x in pdf.words for w in x.split(b"\n")]
        use = np.flatnonzero(n)
        return pd.DataFrame({"bucket": pdf.bucket.iloc[0], "hash": got[use].astype(np.int64), "word": [words[i] for i in first[use].tolist()], "n": n[use]})

    return written(sent.groupBy("bucket").applyInPandas(count, "bucket long, hash long, word binary, n long"))


def letter_bits(words: list[bytes]) -> Bits:
    """Decisions of spelling words; each ends with a space."""
    a = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(a == 0x20)
    owner = np.zeros(len(a), np.int64)
    owner[ends[:-1] + 1] = 1
    owner = np.cumsum(owner)
    start = np.concatenate(([0], ends[:-1] + 1))[owner]
    place = np.arange(len(a)) - start
    before, contexts = np.zeros(len(a), np.uint32), []
    for i in range(1, 6):
        c = np.zeros(len(a), np.uint32)
        c[i:] = a[:-i] + np.uint32(1)
        c[place < i] = 0
        before = before * np.uint32(0x2C9277B5) + c
        if i in (1, 2, 3, 5):
            contexts.append(before * np.uint32(0x9E3779B1) + np.uint32(i))
    byte, k = a[:, None].astype(np.int32), np.arange(8, dtype=np.int32)
    node, bit = (1 << k) | (byte >> (8 - k)), ((byte >> (7 - k)) & 1).ravel().astype(np.int64)
    first = np.concatenate(([0], a[:-1])).astype(np.int32)
    first[place == 0] = 0
    mixed = scattered(node)
    slots = [(first[:, None] * 256 + node).ravel(), *(hashed(c[:, None], mixed, n).ravel() for c, n in zip(contexts[1:], LETTERS.sizes[1:]))]
    return Bits(slots, np.tile((k >= 3).astype(np.int64), len(a)), bit, np.repeat(owner, 8))


def _summed(rows: DataFrame) -> np.ndarray:
    """Sum of float arrays by part; the driver gets one table, whatever the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([_unpack(v, np.float32) for v in pdf["values"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "values": [total.tobytes()]})

    got = rows.groupBy("part").applyInPandas(add, "part int, values binary").collect()
    return np.concatenate([np.frombuffer(r["values"], np.float64) for r in sorted(got, key=lambda r: r.part)]) if got else np.zeros(0)


SUMS = "part int, values binary"


def _parts(tables: list[np.ndarray], size: int = 1 << 17) -> pd.DataFrame:
    flat = np.concatenate(tables)
    return pd.DataFrame({"part": range(0, -(-len(flat) // size)), "values": [_pack(flat[i : i + size], np.float32) for i in range(0, len(flat), size)]})


def _tables(sizes, flat: np.ndarray) -> list[np.ndarray]:
    at = np.cumsum([0, *(2 * s for s in sizes)])
    flat = flat if len(flat) else np.zeros(at[-1])
    return [flat[s:e].astype(np.float32) for s, e in zip(at[:-1], at[1:])]


def fit_letters(vocab: DataFrame) -> tuple[list[np.ndarray], Mixer]:
    """The speller, from the distinct training words. Each bucket of words is one online stream, in the order of the hashes."""
    spark = vocab.sparkSession

    def bits_of(pdf: pd.DataFrame) -> Iterator[Bits]:
        words = pdf.word.tolist()
        for i in range(0, len(words), CHUNK_WORDS):
            yield letter_bits(words[i : i + CHUNK_WORDS])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for bits in bits_of(pdf):
                new = tally(LETTERS.sizes, bits)
                total = new if total is None else [a + b for a, b in zip(total, new)]
        if total is not None:
            yield _parts(total)

    counts = _tables(LETTERS.sizes, _summed(vocab.mapInPandas(add, SUMS)))
    sent = spark.sparkContext.broadcast(counts)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        mixer = Mixer(LETTERS)
        for bits in bits_of(pdf.sort_values("hash")):
            mixer.learn(sent.value, bits)
        return _parts([mixer.state()])

    state = _summed(vocab.groupBy("bucket").applyInPandas(learn, SUMS))
    return counts, Mixer.average(LETTERS, state) if len(state) else Mixer(LETTERS)


def spelling(words: list[bytes], told: np.ndarray, doc: np.ndarray, n_docs: int, tables: list[np.ndarray], mixer: Mixer) -> np.ndarray:
    """log10 probability of the spelled words of each document, bit by bit. A document starts from the mixer of the training words, and its weights and
    refinement go on learning along its own words; `told` words are in the tables by this document alone and leave them first."""
    size = 8 * (np.array([len(w) for w in words], np.int64) + 1)
    of = np.bincount(doc, size, n_docs).astype(np.int64)
    start = np.searchsorted(doc, np.arange(n_docs + 1))
    out = np.zeros(n_docs)

    def cost(at: np.ndarray, owner: np.ndarray, n: int, state) -> np.ndarray:
        bits = letter_bits([words[i] for i in at.tolist()])
        logits, gate = mixer.inputs(tables, bits, slice(None), told[at])
        return online(np.stack(logits, 1), gate, LETTERS.gates, bits.kind, bits.bit, owner[bits.owner], n, state=state, tokens=LETTER_BITS)

    # documents of like size step together
    order = [d for d in np.argsort(-of, kind="stable").tolist() if of[d]]
    i = 0
    while i < len(order):
        j, total = i + 1, of[order[i]]
        while j < len(order) and total + of[order[j]] <= GROUP_BITS:
            total += of[order[j]]
            j += 1
        group, state = order[i:j], mixer.begun(j - i)
        at = np.concatenate([np.arange(start[d], start[d + 1]) for d in group])
        # a long document, alone in its group, is taken part by part
        part = (np.cumsum(size[at]) - 1) // GROUP_BITS if len(group) == 1 else np.zeros(len(at), np.int64)
        owner = np.repeat(np.arange(len(group)), [start[d + 1] - start[d] for d in group])
        for p in np.unique(part).tolist():
            out[group] += cost(at[part == p], owner[part == p], len(group), state)
        i = j
    return out


ANSWER = "block long, kind int, bucket long, counts binary"


def word_answers(sent: DataFrame) -> DataFrame:
    """Each block's words: training counts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, group, c = _gathered(pdf)
        cut = np.cumsum([0, *(len(k) // 8 for k in pdf["keys"])])
        return pd.DataFrame({"block": pdf.block, "kind": 1, "bucket": pdf.bucket, "counts": [_pack(c[group[s:e]]) for s, e in zip(cut[:-1], cut[1:])]})

    return sent.select("bucket", "block", "keys", "counts").groupBy("bucket").applyInPandas(add, ANSWER)


def gram_answers(stored: DataFrame, kind: int, n_buckets: int) -> DataFrame:
    """Each block's pairs (kind 2) or triples (kind 3): training counts."""

    def send(row) -> pd.DataFrame:
        text = Text(row)
        g = text.grouped(text.grams()[kind - 2])
        rows = [(b, row.block, g.keys[s:e].astype(np.uint32).tobytes(), _pack(g.counts[s:e])) for b, s, e in _cuts(g.keys, n_buckets)]
        return pd.DataFrame(rows, columns=["bucket", "block", "keys", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint32)
        counts = np.concatenate([_unpack(c) for c in pdf.counts])
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = np.diff(keys[order]) != 0
        total = np.empty(len(keys), np.int64)
        total[order] = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        cut = np.cumsum([0, *(len(k) // 4 for k in pdf["keys"])])
        return pd.DataFrame({"block": pdf.block, "kind": kind, "bucket": pdf.bucket, "counts": [_pack(total[s:e]) for s, e in zip(cut[:-1], cut[1:])]})

    return written(stored.mapInPandas(each_row(send), "bucket long, block long, keys binary, counts binary").groupBy("bucket").applyInPandas(add, ANSWER))


class Decisions(NamedTuple):
    packed: np.ndarray
    gate: np.ndarray
    kind: np.ndarray
    bit: np.ndarray
    doc: np.ndarray

    def slots(self) -> Iterator[np.ndarray]:
        """The slot of each context, one context after the other."""
        kind, p = self.kind, self.packed
        f2, f1, l1, l2 = (lambda x=x: field(p, *x) for x in (FREQUENT2, FREQUENT1, LEVEL1, LEVEL2))
        yield kind * 256 + f2() * 16 + f1()
        yield kind * 64 + l1() * 16 + l2() * 4 + field(p, *LEVEL3)
        yield kind * 512 + (f2() * 4 + l1()) * 8 + field(p, *RUN)
        yield kind * 256 + (f1() * 4 + l1()) * 4 + l2()
        yield (kind << 12) + field(p, *LAST_WORD)


#: Place and width of what a packed decision holds.
KIND, BIT, FREQUENT2, FREQUENT1, LEVEL1, LEVEL2, LEVEL3, RUN, LAST_WORD = (0, 2), (2, 1), (3, 4), (7, 4), (11, 2), (13, 2), (15, 2), (17, 3), (20, 12)


def field(p: np.ndarray, at: int, bits: int) -> np.ndarray:
    return (p >> at) & ((1 << bits) - 1)


def unpacked(row) -> Decisions:
    """A block's decisions."""
    p = _unpack(row.decisions).view(np.int32)
    kind, size = field(p, *KIND), np.frombuffer(row.asked, np.int64)
    return Decisions(p, kind * 4 + field(p, *LEVEL1), kind, field(p, *BIT), np.repeat(np.arange(len(size), dtype=np.int32), size))


def _step(x: np.ndarray) -> np.ndarray:
    return np.minimum(15, np.floor(2 * np.log2(x + 1.0))).astype(np.uint32)


class Counted:
    """A block's tokens with what the training texts - without a token's own text - hold of them."""

    def __init__(self, row, n_train: int, n_texts: int):
        self.text = t = Text(row)
        got = {k: {} for k in (1, 2, 3)}
        for x in row.answers:
            got[x["kind"]][x["bucket"]] = x

        def joined(kind: int) -> np.ndarray:
            parts = [_unpack(got[kind][b]["counts"]) for b in sorted(got[kind])]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

        def left(g: Grouped, kind: int) -> np.ndarray:
            return np.maximum(joined(kind)[g.of].astype(np.int64) - g.own, 0)

        g = t.grouped(t.hash)
        self.all = joined(1)[g.of].astype(np.int64)
        own_size = (t.n_tokens * t.train)[t.doc]
        self.n = n_train - own_size
        self.c1 = np.maximum(self.all - g.own, 0)
        two, three = t.grams()
        self.c2, self.c3 = left(t.grouped(two), 2), left(t.grouped(three), 3)
        start = n_texts - t.train[t.doc]
        at_start = np.zeros(len(t.doc), bool)
        at_start[t.first] = True
        self.h1 = np.where(at_start, start, t.before(self.c1, 0))  # how often the last word has occurred
        self.h2 = t.before(self.c2, 0)  # the last two; a text's first token has no such history

    def decisions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All binary decisions over known words in order, each in 32 bits; their number by document; each token's share (log10); the tokens that are spelled."""
        t = self.text
        ask3 = self.h2 > 0
        hit3 = ask3 & (self.c3 > 0)
        ask2 = ~hit3 & (self.h1 > 0)
        hit2 = ask2 & (self.c2 > 0)
        ask1 = ~hit3 & ~hit2
        hit1 = ask1 & (self.c1 > 0)
        level = np.where(hit3, 3, np.where(hit2, 2, np.where(hit1, 1, 0))).astype(np.uint32)
        some, of = np.choose(level, [self.c1, self.c1, self.c2, self.c3]), np.choose(level, [self.n, self.n, self.h1, self.h2])
        rest = np.where(level == 0, 0.0, np.log10(np.minimum(1.0, np.maximum(some, 1) / np.maximum(of, 1))))
        l1, l2, l3 = (t.before(level, 0, k) for k in (1, 2, 3))
        place = np.arange(len(level))
        broken = np.maximum.accumulate(np.where(l1 != 3, place, 0)) if len(level) else place
        run = np.minimum(7, place - broken).astype(np.uint32)
        word = (t.before(t.hash, START_HASH) >> U(52)).astype(np.uint32)
        history = _step(self.h2) << 3 | _step(self.h1) << 7 | l1 << 11 | l2 << 13 | l3 << 15 | run << 17 | word << 20
        n = ask3.astype(np.int64) + ask2 + ask1
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        for k, (ask, hit) in enumerate(((ask3, hit3), (ask2, hit2), (ask1, hit1))):
            out[at[ask]] = history[ask] | k | hit[ask].astype(np.uint32) << 2
            at = at + ask
        return out, np.bincount(t.doc, n, len(t.ids)).astype(np.int64), rest, np.flatnonzero(level == 0)


TEXTS = "ids binary, known binary, train binary, sizes binary, n_tokens binary, n_known binary, base binary, rest binary, asked binary, decisions binary, unknown binary, told binary, words binary"


def lm_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every row."""
    spark: SparkSession = docs.sparkSession
    stored = bucketed(blocks(docs, BLOCK_BYTES), "block")
    release(spark)
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    # a word a block sends stands for some 20 bytes of text, a pair or triple for some 8
    sent = written(words_sent(stored, int(total // (20 * WORDS_PER_BUCKET)) + 1))
    vocab = vocabulary(sent)
    n_train, n_types = (x or 0 for x in vocab.agg(F.sum("n"), F.count(F.lit(1))).first())
    n_texts = (vocab.where(F.col("hash") == int(END_HASH)).agg(F.sum("n")).first()[0]) or 0
    letters = spark.sparkContext.broadcast(fit_letters(vocab))
    answers = written(word_answers(sent))
    discard(sent)
    discard(vocab)
    del sent, vocab
    for kind in (2, 3):  # one after the other, as each moves several times what it answers
        release(spark)
        answers = answers.unionByName(gram_answers(stored, kind, int(total // (8 * KEYS_PER_BUCKET)) + 1))
    release(spark)
    by_block = written(answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "counts")).alias("answers")))
    discard(answers)
    release(spark)
    z = np.log10(n_train + 0.1 * (n_types + 1))

    def decide(row) -> pd.DataFrame:
        counted = Counted(row, n_train, n_texts)
        text, n, known = counted.text, len(counted.text.ids), counted.all > 0
        base = np.bincount(text.doc, np.log10(counted.all + 0.1), n) - text.n_tokens * z
        decisions, asked, rest, unknown = counted.decisions()
        by_doc = (text.train, text.sizes, text.n_tokens, np.bincount(text.doc, known, n).astype(np.int64), base, np.bincount(text.doc, rest, n), asked)
        spelled = np.bincount(text.doc[unknown], minlength=n).astype(np.int64).tobytes(), known[unknown].tobytes(), zstandard.ZstdCompressor(level=1).compress(text.spelled(unknown))
        return pd.DataFrame([(row.ids, row.known, *(x.tobytes() for x in by_doc), _pack(decisions), *spelled)], columns=[c.split()[0] for c in TEXTS.split(", ")])

    decided = written(stored.join(by_block, "block").mapInPandas(each_row(decide), TEXTS))
    for done in (by_block, stored):
        discard(done)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each context has seen, of the decisions of training texts."""
        sums = None
        for pdf in batches:
            for new in map(trained, pdf.itertuples()):
                sums = new if sums is None else [a + b for a, b in zip(sums, new)]
        if sums is not None:
            yield _parts(sums)

    def trained(row) -> list[np.ndarray]:
        d = unpacked(row)
        use = np.frombuffer(row.train, bool)[d.doc]
        bit = d.bit[use]
        return [np.bincount(2 * s[use] + bit, minlength=2 * n) for s, n in zip(d.slots(), SLOTS)]

    seen = _tables(SLOTS, _summed(decided.mapInPandas(gather, SUMS)))
    logits = spark.sparkContext.broadcast([np.log((x[1::2] + 0.4) / (x[::2] + 0.4)).astype(np.float32) for x in seen])

    def finish(row) -> pd.DataFrame:
        d, ids = unpacked(row), doc_ids(row)
        x = np.empty((len(d.bit), len(SLOTS)), np.float32)
        for c, slot in enumerate(d.slots()):
            x[:, c] = logits.value[c].take(slot)
        score = np.frombuffer(row.rest, np.float64) + online(x, d.gate, GATES, d.kind, d.bit, d.doc, len(ids))
        del d, x
        unknown = np.frombuffer(row.unknown, np.int64)
        if unknown.any():
            words = zstandard.ZstdDecompressor().decompress(row.words).split(b" ")
            score = score + spelling(words, np.frombuffer(row.told, bool), np.repeat(np.arange(len(ids)), unknown), len(ids), *letters.value)
        whole = lambda c: np.frombuffer(c, np.int64)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": ~np.frombuffer(row.train, bool), "n_tokens": whole(row.n_tokens), "n_known": whole(row.n_known),
                             "train_tokens": int(n_train), "base_score": np.frombuffer(row.base, np.float64), "score": score, "n_bytes": whole(row.sizes)})

    return decided.mapInPandas(each_row(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
