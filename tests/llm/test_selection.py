import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ontoloom.llm import html_text, mixing, packing, quality_rules, toxicity

from .conftest import SF


def sized(text):
    return len((text or "").encode().split())


def brute_targets(rows, share=1.5, cap=2.0):
    size = defaultdict(int)
    for source, text in rows:
        size[source] += sized(text)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, open_, total = dict.fromkeys(order, 0.0), set(order), share * sum(size.values())
    while open_:
        level = total / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= cap * size[s]}
        if not over:
            return size, {s: weight[s] * level if s in open_ else target[s] for s in order}
        for s in over:
            target[s] = cap * size[s]
            total -= target[s]
        open_ -= over
    return size, target


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_mixing_meets_targets(name, request):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("source", "text").collect()]
    got = mixing.mix(docs).collect()
    size, target = brute_targets(rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert len(got) == len(rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= max(1, 0.05 * target[s] if name == "documents" else longest[s])
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, got))


def test_mixing_stage_repeats_rows(odd):
    got = mixing.taken(odd)
    assert got.columns == odd.columns
    assert {r.doc_id for r in got.select("doc_id").collect()} >= {2, 3, 4}


def test_differencing_fills_windows():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (5, 8), (40, 4), (300, 37)):
        lengths = rng.integers(1, 513, n).tolist()
        window, most = packing.difference(lengths, k)
        sums = np.bincount(window, lengths, k)
        assert len(window) == n and sums.max() == most
        if n > 100:
            assert sums.max() - sums.min() < 100
    window = packing.pack_block([512] * 9, 1024)
    assert np.bincount(window, [512] * 9).max() <= 1024


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_packing_is_an_exact_round_trip(name, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, zlib.crc32(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    got = packing.pack(docs, pieces_per_block=200).collect()
    ids = {(d, zlib.crc32(np.array(x, "<u4").tobytes())): x for d, t in rows for x in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]}
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc_id, parts in by_doc.items():
        texts = [x for (d, _), x in ids.items() if d == doc_id]
        assert sum(p.length for p in parts) == sum(len(x) * want[doc_id, zlib.crc32(np.array(x, "<u4").tobytes())] for x in texts)
        for p in parts:
            assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in texts)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_words_have_the_tokenizers_ids():
    coder = packing.WordIds(packing.default_tokenizer())
    texts = ["a'b's don't x's 's''s '", "<|endoftext|> x", "İstanbul ΣΑΣ é ﬁ", "a\x1cb c\x85d e　f", "x\x00y\x7fz", "１２ ½ 3a4b5 ...!!!##", "日本語 \U0001f600‍\U0001f600", "", " ", "A'S It'LL '9's", "x" * 3000]
    for t in texts:
        assert coder.text(t) == np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_words_share_their_pieces(monkeypatch):
    coder = packing.WordIds(packing.default_tokenizer())
    letters = [chr(i) for i in range(33, 400)]
    for t in (x for c in letters for x in (c, c * 2, f"a{c}B", f"{c}'S{c}", f"1{c}1")):
        if t.split() == [t]:
            assert coder.text(t) == coder.encode(t), t
    want = coder.encode("Größe, GRÖSSE größe! 'größe' naïve")
    monkeypatch.setattr(coder, "encode", None)  # plain words need no whole encoding
    assert coder.text("Größe, GRÖSSE größe! 'größe' naïve") == want
    before = len(coder.piece_ids)
    coder.text("Größe!' GRÖßE, größe,größe NAÏVE")
    assert len(coder.piece_ids) - before <= 1  # "!'" alone is new


def test_toxicity_finds_planted_words(spark, nothing, odd):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("re", "lo", "mi", "ta", "vo") for b in ("na", "dor", "sel", "tik", "pum")]
    rows, labels = [], []
    for d in range(900):
        text = list(rng.choice(words, 60))
        toxic = d % 4 == 0
        if toxic:
            for bad in ("scumbag", "worthlessly", "idiotic"):
                text.insert(int(rng.integers(60)), bad)
        rows.append((d, " ".join(text), "en", "a"))
        labels.append((d, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    clean = toxicity.keep_clean(docs, known)
    assert clean.columns == docs.columns and abs(clean.count() - 675) < 15
    assert toxicity.toxicity(nothing, known).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, known.limit(0)).collect()} == {0.0}


def brute_statistics(text):
    t = text or ""
    words = [w.decode() for w in t.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["documents", "odd", "nothing"])
def test_quality_statistics(name, request):
    docs = request.getfixturevalue(name)
    want = Counter((d, *brute_statistics(t)) for d, t in docs.select("doc_id", "text").collect())
    got = quality_rules.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == want


def test_quality_rules_learn_planted_thresholds(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in got and not got[r.doc_id].base_failed}
    good = [got[i].kept for i, q in known.items() if q == 1]
    bad = [got[i].kept for i, q in known.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5
    bare = quality_rules.quality_rules(odd, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in bare) and len(bare) == odd.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy</div><article><header><h2>Head &amp; tail</h2></header><p><b>One   two<br>three<p>Four &eacute; &lt;tag&gt;</p><div class="comments"><p>reader says</p></div></article>
<aside>Side</aside><form><p>Sign up</p></form><footer>&copy; foot</footer>"""


def test_html_of_a_marked_article():
    kept = [t for z, t in html_text.blocks(PAGE) if z == "article"]
    assert kept == ["Head & tail", "One two three", "Four é <tag>"]


def test_html_uses_the_host_where_nothing_is_marked(spark, nothing):
    body = "<div><p>{0}</p></div><div>Read more of our great stories every single day here</div>"
    rows = [(i, f"http://h{i % 2}.example/{i}", body.format(f"unique text number {i} with words w{i} x{i} y{i}")) for i in range(6)]
    rows += [(10, "http://h0.example/a", PAGE), (11, None, None), (12, "http://h9.example", ""), (13, "http://h9.example", "<p>alone & <b>un</b>closed")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "unique text number 3 with words w3 x3 y3" and got[10].startswith("Head & tail\n")
    assert got[11] == "" and got[12] == "" and got[13] == "alone & unclosed"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert html_text.extract(pages).where("n_chars > 0").count() == pages.count()


def brute_unique(pages, depth, share):
    """Token runs of unmarked pages that no boilerplate covers, host by host over whole token strings."""
    out = {}
    for host in {h for _, h, _ in pages}:
        own = [(k, [w for b in blocks for w in b.split()], blocks) for k, h, blocks in pages if h == host]
        seen = defaultdict(set)
        for k, words, _ in own:
            for i in range(len(words) - depth + 1):
                seen[tuple(words[i : i + depth])].add(k)
        for k, words, blocks in own:
            gone = {j for i in range(len(words) - depth + 1) if len(seen[tuple(words[i : i + depth])]) >= max(2, share * len(own)) for j in range(i, i + depth)}
            kept, at = [], 0
            for b in blocks:
                left = [w for i, w in enumerate(b.split(), at) if i not in gone]
                at += len(b.split())
                kept += [" ".join(left)] if left else []
            out[k] = "\n".join(kept or blocks)
    return out


def test_host_array_against_brute_force(spark):
    rng, pages = np.random.default_rng(6), []
    for k in range(120):
        host = f"h{min(3, int(rng.integers(8)))}.example"
        blocks = [" ".join(f"m{host}{i}" for i in range(9)), *(" ".join(rng.choice([f"w{i}" for i in range(30)], rng.integers(1, 40))) for _ in range(4)), " ".join(f"f{host}{i}" for i in range(12))]
        pages.append((k, host, blocks[int(rng.integers(2)) :]))
    pages += [(200, "h0.example", pages[0][2]), (201, "h9.example", ["only page of its host"])]
    rows = [(k, f"https://{h}/{k}", "".join(f"<div>{b}</div>" for b in blocks)) for k, h, blocks in pages]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute_unique(pages, html_text.DEPTH, html_text.SHARE)


def test_html_rows_are_told_apart_and_text_is_kept(spark):
    shared = "<div>one common line that all pages of this host carry at their end</div>"
    rows = [(2, "http://h.example/a", "<div>first page alpha</div>" + shared), (2, "http://h.example/b", "<div>second page beta</div>" + shared), (None, "http://h.example/c", "<div>third gamma</div>" + shared),
            (3, None, "<div>no url</div>" + shared), (None, None, "<div>nothing at all</div>" + shared), (2, "http://other.example/", "<div>the words one common line that all pages of this host carry stay</div>")]
    got = sorted(r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == sorted(["first page alpha", "second page beta", "third gamma", "no url", "nothing at all", "the words one common line that all pages of this host carry stay"])
    inline = "<article><p>Press the <button>Save</button> key, see <label>the name</label>.</p><p class='related'>kept</p><div class='share-price'>up</div><h2 id='social-impact'>impact</h2><div class='share-links'>no</div></article>"
    teaser = "<main><article><p>More here</p></article><div>a long body of the page itself with many more words</div></main>"
    rows = [(1, "http://x.example/1", inline), (2, "http://x.example/2", teaser)]
    got = {r.page_id: (r.text, r.route) for r in html_text.routed(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("Press the Save key, see the name.\nkept\nup\nimpact", "marked")
    assert got[2] == ("More here\na long body of the page itself with many more words", "unique")


def test_the_host_array_decides_inside_marked_articles(spark):
    promo = "Write to our editors with any question you have about this story today"
    page = lambda body: f"<nav>Menu of the site</nav><article>{body}</article>"
    own = lambda k: f"<p>{' '.join(f'w{k}x{i}' for i in range(20))}</p>"
    rows = [(k, f"http://h.example/{k}", page(own(k) + f"<p>{promo}</p>")) for k in range(6)]
    rows += [(6, "http://h.example/6", page(own(0) + f"<p>{promo}</p>")), (7, "http://h.example/7", page(f"<p>{promo}</p>"))]  # a copy of an article; nothing but the repeat
    rows += [(10 + k, f"http://few.example/{k}", page(own(k) + f"<p>{promo}</p>")) for k in range(3)]  # too few pages to tell
    rows += [(20 + k, f"http://same.example/{k}", page(own(9) + own(8) + (own(7) if k else ""))) for k in range(5)]  # copies and a near copy
    got = {r.page_id: (r.text, r.route) for r in html_text.routed(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda k: own(k)[3:-4]
    assert all(got[k] == (text(k), "marked") for k in range(6)) and got[6][0] == text(0) and got[7][0] == promo
    assert all(got[10 + k][0] == f"{text(k)}\n{promo}" for k in range(3))
    assert got[20][0] == f"{text(9)}\n{text(8)}" and all(got[20 + k][0] == f"{text(9)}\n{text(8)}\n{text(7)}" for k in range(1, 5))
