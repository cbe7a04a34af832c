import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from ontoloom.llm import exact_dedup, ngram_join, sentence_dedup, suffix_dedup


def lower(text):
    return (text or "").encode().lower()


def test_cuckoo_shard_inserts_deletes_and_resizes():
    shard = exact_dedup.CuckooShard(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        shard.insert(k, i, 1)
        shard.insert(k, i + 10_000, 2)
    assert shard.n > 500 and all(shard.find(k) >= 0 for k in keys)
    assert shard.find(hashlib.sha256(b"new").digest()) < 0
    for k in keys[:1000]:
        assert shard.delete(k, 1) and shard.find(k) >= 0 and shard.delete(k, 2)
    assert not shard.delete(keys[0], 1)
    again = exact_dedup.CuckooShard.restore(shard.state(0))
    assert all(again.find(k) < 0 for k in keys[:1000]) and all(again.find(k) >= 0 for k in keys[1000:])
    assert again.keys[again.owner[again.find(keys[2000])]] == [keys[2000], 12_000, 3]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, best[lower(t)], len(groups[lower(t)]), i == best[lower(t)], hashlib.sha256(lower(t)).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_exact_dedup(name, request):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_dedup(docs, rows_per_shard=50).collect()
    assert Counter(tuple(r) for r in got) == brute_exact(rows)


def test_exact_dedup_stage_keeps_columns_and_one_row(odd):
    got = exact_dedup.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 3, 4, 5, 7, 8, 9, 10, 11, 11, 2**63 - 1]


def test_index_updates(spark):
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    new = spark.createDataFrame([(1000, "text 3"), (1001, "other")], "doc_id long, text string")
    old = spark.createDataFrame([(i, f"text {i % 40}") for i in range(0, 100, 40)], "doc_id long, text string")
    index = exact_dedup.build_index(exact_dedup.digests(rows), 3)
    got = exact_dedup.update_index(index, exact_dedup.digests(new), exact_dedup.digests(old), 3).collect()
    refs = {bytes(r.digest): (r.keep_id, r.refs) for r in got}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert digest("text 0") not in refs and refs[digest("text 3")] == (1000, 4) and refs[digest("other")] == (1001, 1) and len(refs) == 40


def brute_components(rows):
    sets, root = [], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for doc_id, text in rows:
        w = lower(text).split()
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        seen = Counter()
        for x in s:
            seen.update(inverted[x])
            inverted[x].append(i)
        for j, both in seen.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)].append(doc_id)
    return Counter((rows[i][0], len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i in range(len(rows)))


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_ngram_join(name, request):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in ngram_join.ngram_join(docs).collect()) == brute_components(rows)


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 20])
def test_ngram_join_of_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks make cells crowded, so that sets are routed twice
    rng, rows = random.Random(3), []
    base = [f"b{i}" for i in range(200)]
    for d in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, " ".join(f"s{rng.randrange(40)}" for _ in range(rng.randrange(1, 14)))) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngram_join.ngram_join(docs).collect()) == brute_components(rows)


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(10):
            spoiled = ngram_join._spoiled(2 * len(a))
            k = rng.integers(0, spoiled // 2 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert set(ngram_join.cells(a)) & set(ngram_join.cells(b))


def test_rtree_finds_all_that_the_bound_admits():
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (500, ngram_join.GROUPS))
    points[250:] = points[:250] + (rng.random((250, ngram_join.GROUPS)) < 0.1)
    points = points.astype(np.uint8)
    size = points.sum(1, dtype=np.int64)
    tree = ngram_join.RTree(points, size)
    for q in range(0, 500, 7):
        bound = np.minimum(points, points[q]).sum(1, dtype=np.int64)
        fits = (bound >= ngram_join.need(size, size[q])) & (100 * size >= 85 * size[q]) & (85 * size <= 100 * size[q])
        assert set(tree.search(points[q], int(size[q]))) == set(np.flatnonzero(fits))


def test_bounds_hold_for_very_long_sets():
    rng = np.random.default_rng(7)
    a = np.unique(rng.integers(0, 1 << 63, 90_000, dtype=np.uint64))
    b, short = np.unique(np.concatenate([a[4:], rng.integers(0, 1 << 63, 4, dtype=np.uint64)])), a[:500]
    both = ngram_join._counts([ngram_join.points(s) for s in (a, b, short)])
    assert np.minimum(both[0], both[1]).sum(dtype=np.int64) >= ngram_join.need(len(a), len(b))
    assert both.sum(1, dtype=np.int64).tolist() == [len(a), len(b), len(short)]
    assert sorted(ngram_join.RTree(both, np.array([len(a), len(b), len(short)])).search(both[0], len(a))) == [0, 1]


def test_ngram_join_of_two_very_long_near_copies(spark):
    words = [f"w{i}" for i in range(80_000)]
    other = [*words[:40_000], "changed", *words[40_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"v{i}" for i in range(80_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngram_join.ngram_join(docs).collect()) == brute_components(rows)
    assert Counter(r.component_id for r in ngram_join.ngram_join(docs).collect()) == {1: 2, 3: 1}


def test_cells_of_two_members_are_not_skipped(spark):
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    far = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    known = spark.createDataFrame([(i, len(s), bytearray(ngram_join.points(s))) for i, s in ((1, a[2:]), (2, a), (3, far))], "id long, n long, point binary")
    members = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (12, 1), (12, 2)], "cell long, id long")
    roots = spark.createDataFrame([], "node long, root long")
    assert [tuple(r) for r in ngram_join.unresolved(members, roots, known, ngram_join.RULE).collect()] == [(1, 2)]
    roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    assert ngram_join.unresolved(members, roots, known, ngram_join.RULE).count() == 0


def brute_suffix(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    low = {}
    for i, b in data:
        for p in range(len(b) - 49):
            low[b[p : p + 50]] = min(order(i), low.get(b[p : p + 50], float("inf")))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        spans = [p for p in range(len(b)) if gone[p] and (not p or not gone[p - 1])]
        out.append((i, len(b), len(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_suffix_dedup(name, request):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.suffix_dedup(docs, block_bytes=20_000, keys_per_bucket=3_000).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == brute_suffix(rows)


def test_suffix_dedup_of_periodic_and_shared_texts(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(140))
    rows = [(d, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(0, 200))) + passage[rng.randrange(60) : rng.randrange(70, 140)] * (d % 3) + "-" * rng.randrange(0, 160)) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.suffix_dedup(docs, block_bytes=3_000, keys_per_bucket=500).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == brute_suffix(rows)


def brute_sentences(rows, span=2, min_words=8):
    """Sentence dedup over lists: (doc_id, sentences, removed, text) of every row; equal rows are one document."""
    import re

    docs = {}
    for d, t in rows:
        parts = re.split(r"(?<=[.!?][ \t\x0b\x0c\r])|(?<=\n)", t or "")
        docs[d, t or ""] = parts if parts[-1] or len(parts) == 1 else parts[:-1] + [""]
    order = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    runs = defaultdict(list)
    for k in order:
        words = [(i, p.encode().lower().split()) for i, p in enumerate(docs[k])]
        words = [x for x in words if x[1]]
        for i in range(max(1, len(words) - span + 1) if words else 0):
            run = words[i : i + span]
            if sum(len(w) for _, w in run) >= min_words:
                runs[tuple(tuple(w) for _, w in run)].append((k, run[0][0], run[-1][0]))
    gone = defaultdict(set)
    for found in runs.values():
        for k, at, last in found[1:]:
            gone[k] |= set(range(at, last + 1))
    return Counter((d, len(docs[d, t or ""]), len(gone[d, t or ""]), "".join(p for i, p in enumerate(docs[d, t or ""]) if i not in gone[d, t or ""])) for d, t in rows)


@pytest.mark.parametrize("name", ["documents", "nothing", "ties"])
def test_sentence_dedup(name, spark, request):
    if name == "ties":
        same = "A passage that two rows share and that is long enough. It goes on with a second sentence here."
        docs = spark.createDataFrame([(1, same), (2, "Own start of a text with words. " + same), (3, "Own text of the third row, alone. Nothing else in it at all."), (3, same + " End."), (None, same), (4, None), (5, ""), (5, same), (5, same)], "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, sentence_dedup.sentence_dedup(docs).collect())) == brute_sentences(rows)


def test_sentence_dedup_keeps_every_row(odd):
    assert sentence_dedup.sentence_dedup(odd).count() == odd.count()


def test_deletion_of_the_largest_id_leaves_the_next(spark):
    rows = [(i, hashlib.sha256(str(i % 40).encode()).digest()) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, digest binary")
    index = exact_dedup.build_index(docs, 3)
    gone = docs.where("doc_id >= 150 or doc_id % 40 = 7")
    new = spark.createDataFrame([(900, rows[7][1])], docs.schema)
    got = {bytes(r.digest): (r.keep_id, r.refs) for r in exact_dedup.update_index(index, new, gone, 3, live=docs).collect()}
    left = defaultdict(list)
    for i, d in [*((i, d) for i, d in rows if i < 150 and i % 40 != 7), (900, rows[7][1])]:
        left[d].append(i)
    assert got == {d: (max(ids), len(ids)) for d, ids in left.items()}


def test_sentence_dedup_by_hand(spark, odd, nothing):
    shared = "The quick brown fox jumps over the lazy dog. It then runs all the way home again! Was it tired? "
    rows = [(1, f"Own start here. {shared}Own end of one."), (2, f"Another start.\n{shared}Another end."), (3, "Nothing shared. At all in this one. "), (4, shared.upper()), (5, None)]
    got = {r.doc_id: r for r in sentence_dedup.sentence_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[5].text == ""
    assert got[2].text == "Another start.\nAnother end." and got[2].n_removed == 3 and got[4].text == ""
    assert sentence_dedup.sentence_dedup(nothing).count() == 0
    assert sentence_dedup.sentence_dedup(odd).count() == odd.count()


def test_block_hashes_equal_single_ones():
    from ontoloom.llm import hashing

    texts = [b"a b c d e f", b"", b"one", b"x y z", b" lead and trail  ", b"joined", b"up next to it now and then"]
    end = np.cumsum([len(t) for t in texts])
    got = hashing.block_shingles(np.frombuffer(b"".join(texts), np.uint8), end - [len(t) for t in texts], end, 4)
    assert all(np.array_equal(g, hashing.shingles(t, 4)) for g, t in zip(got, texts))


def test_sentence_dedup_of_a_text_with_many_sentences(spark):
    # cut anew for each sentence that stays, this text took minutes
    lines = [f"Line {i} of a long text, with words enough to count." for i in range(12_000)]
    rows = [(1, " ".join(lines[:2])), (2, " ".join(lines))]
    start = time.monotonic()
    got = {r.doc_id: r for r in sentence_dedup.sentence_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].n_sentences == 12_000 and got[2].n_removed == 2 and got[2].text == " ".join(lines[2:])
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("rule", [ngram_join.RULE, ngram_join.Rule(words=5, num=80)])
def test_unlike_sets_do_not_meet_by_empty_groups(rule):
    rng = np.random.default_rng(12)
    for n in (120, 700, 5000):
        some = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(60)]
        got = np.concatenate([np.unique(ngram_join.cells(s, rule)) for s in some])
        assert len(np.unique(got)) > 0.999 * len(got)
    for n in (22, 31, 48, 70, 130, 700, 5000):  # sets that just link meet, with few full groups as well
        bands = ngram_join._bands(rule)
        for k in range(40):
            s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            if k % 2:  # all hashes in a quarter of the range: most groups are empty
                s = np.sort(s >> np.uint64(2))
            less = np.sort(rng.choice(s, n - n * (rule.den - rule.num) // rule.den, replace=False))
            spare = n * (rule.den - rule.num) // (rule.den + rule.num)
            swap = np.unique(np.concatenate([rng.choice(s, n - spare, replace=False), rng.integers(0, 1 << 64, spare, dtype=np.uint64)]))
            for t in (less, swap):
                both = len(np.intersect1d(s, t))
                assert rule.den * both >= rule.num * (len(s) + len(t) - both)
                assert abs(int(np.searchsorted(bands, len(s))) - int(np.searchsorted(bands, len(t)))) <= 1
                assert len(np.intersect1d(ngram_join.cells(s, rule), ngram_join.cells(t, rule)))


@pytest.mark.parametrize("rule", [ngram_join.RULE, ngram_join.Rule(words=5, num=80)])
def test_linked_sets_meet_in_a_cell_that_is_not_spare(rule):
    rng, spared = np.random.default_rng(21), 0
    for n in (25, 48, 70, 130, 700, 3000):
        for _ in range(30):
            s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            k = n * (rule.den - rule.num) // (rule.den + rule.num)
            t = np.unique(np.concatenate([rng.choice(s, n - k, replace=False), rng.integers(0, 1 << 64, k, dtype=np.uint64)]))
            got = [{band: (named, spare) for band, named, spare in ngram_join.routes(x, rule)} for x in (s, t)]
            order = rng.permutation(1 << 16)  # any order of cells, the same for both
            place = lambda c: order[(c & np.uint64(0xFFFF)).astype(int)] * float(1 << 48) + (c >> np.uint64(16)).astype(float)
            left = [{c for named, spare in x.values() for c in named[np.argsort(place(named))][: max(0, len(named) - spare)].tolist()} for x in got]
            spared += sum(spare for x in got for _, spare in x.values())
            assert left[0] & left[1]
    assert spared > 1000


def test_a_pair_is_told_in_the_first_of_its_cells():
    rng = np.random.default_rng(22)
    s = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    most = np.iinfo(np.int64).max
    rows = pd.DataFrame({"id": [1, 2, 3], "n": 300, "root": [1, 2, 3], "point": [ngram_join.points(s)] * 3, "first": [np.array(x) for x in ([5, 7, most], [5, 7, 9], [7, 8, 9])]})
    found = {cell: [tuple(x) for x in ngram_join._search(rows[rows.id.isin(held)], rows[rows.id.isin(held)], cell, ngram_join.RULE).to_numpy().tolist()] for cell, held in ((5, [1, 2]), (7, [1, 2, 3]), (9, [2, 3]))}
    assert found == {5: [(1, 2)], 7: [(1, 3), (2, 3)], 9: []}
