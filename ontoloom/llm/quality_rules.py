"""Quality rules: base limits and a learned decision list, in DataFrame operations only.

Sequential covering learns an ordered list of threshold conjunctions for the class
quality = 0 from labelled statistics. Features are cut into bins at quantiles of
the labelled rows; one aggregate of (feature, bin) class counts over the growing rows
gives every candidate literal of a step, and FOIL's gain picks one. A grown rule is pruned from its end on the
rows kept back for pruning, accepted while it is precise enough there, and its rows leave.
All labelled rows count; the driver sees only the counts. The list becomes one ordered Spark CASE expression.

Edge cases: null text has no words and fails the base limits; a text of separators does as well; without labels
(or with labels of one class) the list is empty and keeps what passes the base limits; null labels are
ignored; repeated rows count each; an empty table gives an empty result; extra columns are ignored. Windows of five
words are compared by a 64-bit hash.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

SYMBOLS = "#*$%&|<>"
BINS = 32
GRID = 2000  # places of the logarithmic grid by a factor of e
MAX_RULES, MAX_LITERALS = 10, 4
MIN_PRECISION = 0.9
MIN_COVER = 3


class Literal(NamedTuple):
    feature: str
    above: bool  # feature > cut, or feature <= cut
    cut: float
    bin: int

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)


Rule = tuple[Literal, ...]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row: a one-element array names it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more. Most texts have no such window and
    stop at the distinct count; the rest sort (hash, place) pairs and add up the covered words."""

    def places(p: Column) -> Column:
        same = lambda x, k: F.coalesce((k > 0) & (F.get(p, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda p: _let(places(p), total))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(_let(hashes, count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns (long) and the features (double) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    base = docs.select("doc_id", text.alias("text"), F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"), lines.alias("lines"))
    chars = F.length(F.translate("text", " \t\n\x0b\x0c\r", ""))
    got = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_marks"),
        F.regexp_count("text", F.lit(r"[.]")).alias("n_stops"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("n_words").cast("double").alias("f_words"),
        per("word_chars", "n_words").alias("f_word_length"),
        per("n_symbols", "n_words").alias("f_symbols"),
        per("n_dup_lines", "n_lines").alias("f_dup_lines"),
        per("n_repeat_words", "n_words").alias("f_repeats"),
        per("n_words", "n_lines").alias("f_line_words"),
        per("n_upper", "word_chars").alias("f_upper"),
        per("n_digits", "word_chars").alias("f_digits"),
        per("n_marks", "n_words").alias("f_marks"),
        per("n_stops", "n_words").alias("f_stops"),
        per("n_distinct", "n_words").alias("f_distinct"),
    )


FEATURES = ("f_words", "f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_line_words", "f_upper", "f_digits", "f_marks", "f_stops", "f_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _both(rule: Rule, columns) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & columns(x)
    return out


UNPIVOTED = f"stack({len(FEATURES)}, {', '.join(f'{f!r}, {f}' for f in FEATURES)}) as (feature, value)"


def quantiles(rows: DataFrame) -> dict[str, list[float]]:
    """Cuts at the quantiles of every feature, from exact counts over a fixed logarithmic grid: the same whatever the order of the rows."""
    grid = rows.selectExpr(UNPIVOTED).groupBy("feature", F.floor(F.log1p("value") * GRID).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, list[tuple[int, int]]] = {}
    for feature, at, n in grid.collect():  # as many rows as the grid has places, at most
        counts.setdefault(feature, []).append((at, n))
    out = {}
    for feature, found in counts.items():
        total, seen, cuts = sum(n for _, n in found), 0, set()
        for at, n in sorted(found):
            # the upper end of a place closes every share that is reached in it
            if int(seen * (BINS + 1) / total) < int((seen + n) * (BINS + 1) / total) <= BINS:
                cuts.add(math.expm1((at + 1) / GRID))
            seen += n
        out[feature] = sorted(cuts)
    return out


def learn(rows: DataFrame) -> list[Rule]:
    """Rules for quality = 0, in order, from rows of features and `quality`."""
    cuts = quantiles(rows)
    if not cuts:
        return []
    bins = [sum(((F.col(f) > F.lit(c)).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]  # bin j: over j cuts
    left = written(rows.select(*bins, (F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("grow")))
    # above cut number j means a bin over j
    met = lambda x: F.col(x.feature) > x.bin if x.above else F.col(x.feature) <= x.bin
    unpivoted = UNPIVOTED.replace("value", "bin")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        open_rows = left.where(~F.lit(False) & _both((), met))
        for r in rules:
            open_rows = open_rows.where(~_both(r, met))
        rule: Rule = ()
        while len(rule) < MAX_LITERALS:
            counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
            grown = open_rows.where("grow").where(_both(rule, met)).selectExpr("bad", unpivoted)
            for feature, b, bad, n in grown.groupBy("feature", "bin").agg(F.sum("bad"), F.count(F.lit(1))).collect():
                counts[feature][b] = (bad, n - bad)
            p0, n0 = (sum(v[i] for v in counts[FEATURES[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, of in counts.items():
                p = n = 0
                for j in range(len(cuts[f])):
                    p, n = p + of.get(j, (0, 0))[0], n + of.get(j, (0, 0))[1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= MIN_COVER:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            best = max(best, (gain, Literal(f, above, float(cuts[f][j]), j)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        held = open_rows.where("not grow").agg(*(F.sum(F.when(_both(h, met), F.col("bad") * s + (1 - F.col("bad")) * (1 - s))) for h in heads for s in (1, 0))).first()
        worth = [((p or 0) - (n or 0)) / max(1, (p or 0) + (n or 0)) for p, n in zip(held[::2], held[1::2])]
        keep = max(range(len(heads)), key=lambda i: (worth[i], -i))
        p, n = held[2 * keep] or 0, held[2 * keep + 1] or 0
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(heads[keep])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one CASE: false for the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(_both(rules[0], Literal.column), False)
    for r in rules[1:]:
        out = out.when(_both(r, Literal.column), False)
    return out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base statistics, base_failed and kept of every row."""
    stats = written(statistics(docs))
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rules = learn(stats.where(~base_failed()).join(known, "doc_id").select("doc_id", "quality", *FEATURES))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept")
    )
