"""Substring dedup by sliding spans of sentences.

A text is cut after a full stop, question or exclamation mark that white space follows, and after a line break; each
sentence keeps its white space, so the sentences joined are the text. Every run of `span` consecutive sentences with
at least `min_words` words is hashed, case and white space aside; runs are joined globally on the hash, and the first
one (smallest doc_id, then place) of each hash stays. A sentence covered by any other run of a repeated hash is removed. Runs are compared by 128 bits.

The first runs come from an aggregate that combines before the shuffle, so a passage shared by a third of
all documents costs each task one row; the join back is an equi-join that Spark can split.

Edge cases: null text counts as empty and stays empty; texts of fewer sentences than a span are one run if they have enough words;
rows that share a doc_id but not the text are told apart, and ordered, by their text's hash; rows equal in both are one document and get one result each;
rows with a null doc_id come after all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, lower_ascii, written

SPAN = 2
MIN_WORDS = 8
#: Splits behind these places; Java's look-behind keeps the separator with its sentence.
BREAKS = r"(?<=[.!?][\x20\x09\x0B-\x0D])|(?<=\n)"


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAKS)


def text_key() -> Column:
    """Tells apart texts that share a doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def spans(docs: DataFrame, span: int, min_words: int) -> DataFrame:
    """(doc_id, t, at, last, x, y) of every run of sentences with a word: places of its first and last sentence, and its hash."""
    words = F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(lower_ascii(s), SPACES, " ")).alias("s")))
    # sentences without a word break no run
    rows = docs.select("doc_id", text_key().alias("t"), F.filter(words, lambda x: x["s"] != "").alias("w"))
    one = lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("h"), F.xxhash64(F.lit(1), x["s"]).alias("g"), (F.regexp_count(x["s"], F.lit(" ")) + 1).alias("n"))
    rows = rows.where("size(w) > 0").select("doc_id", "t", F.transform("w", one).alias("h"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("h") - span + 1)), lambda i: F.slice("h", i, span))
    run = F.explode(F.transform(runs, lambda r: F.struct(
        r[0]["i"].alias("at"), F.element_at(r, -1)["i"].alias("last"), F.xxhash64(F.transform(r, lambda x: x["h"])).alias("x"), F.xxhash64(F.transform(r, lambda x: x["g"])).alias("y"),
        F.aggregate(r, F.lit(0), lambda a, x: a + x["n"]).alias("n")
    )))
    return rows.select("doc_id", "t", run.alias("r")).select("doc_id", "t", "r.*").where(F.col("n") >= min_words).drop("n")


def sentence_dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, of every row."""
    found = written(spans(docs, span, min_words))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "at")
    repeated = found.groupBy("x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y", "first")
    later = found.join(repeated, ["x", "y"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "t").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", "last")))).alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    rows = docs.select("doc_id", "text", text_key().alias("t"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    # as the element of an array the sentences are a variable below; named in the inner lambda they would be cut anew for each one that stays
    cut = F.transform(F.array(sentences(F.col("text"))), lambda parts: F.struct(
        F.size(parts).cast("long").alias("n"),
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone"), lambda i: F.get(parts, i)), "").alias("kept"),
    ))
    rows = rows.select("doc_id", "text", "gone", F.explode(cut).alias("c"))
    return rows.select("doc_id", F.col("c.n").alias("n_sentences"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
                       F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.col("c.kept")).alias("text"))
