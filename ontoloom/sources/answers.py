"""Clause JSON in; answer lines and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = "struct<kind: string, name: string, arg: string>"
ATOM = f"struct<kind: string, name: string, t1: {TERM}, t2: {TERM}>"
CLAUSE = f"body array<{ATOM}>, head array<{ATOM}>"


def read_clauses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(body, head) of every clause of {"clauses": [...]} documents, or of JSON lines with one clause each. Documents laid out over
    several lines need `multi_line`; without it they are refused, as is anything that is not JSON."""
    docs = spark.read.schema(f"clauses array<struct<{CLAUSE.replace('body array', 'body: array').replace('head array', 'head: array')}>>, {CLAUSE}").json(path, multiLine=multi_line, mode="FAILFAST")
    whole = docs.where("clauses is not null").select(F.explode("clauses").alias("c")).select("c.body", "c.head")
    return whole.unionByName(docs.where("clauses is null and head is not null").select("body", "head"))


def lines(subs: DataFrame, types: DataFrame | None = None, same: DataFrame | None = None, consistent: bool | None = None, dropped: int = 0) -> DataFrame:
    """(value): CONSISTENT and DROPPED if known, and SUB, UNSAT, TYPE and SAME rows as tab-separated text, for `write.text`. An
    inconsistent ontology has no TYPE and no SAME rows."""
    if consistent is False:
        types = same = None
    out = subs.where("sup <> 'owl:Nothing'").select(F.concat_ws("\t", F.lit("SUB"), "sub", "sup").alias("value"))
    out = out.unionByName(subs.where("sup = 'owl:Nothing'").select(F.concat_ws("\t", F.lit("UNSAT"), "sub").alias("value")))
    if types is not None:
        out = out.unionByName(types.select(F.concat_ws("\t", F.lit("TYPE"), F.col("ind").cast("string"), "cls").alias("value")))
    if same is not None:
        out = out.unionByName(same.where("node <> rep").select(F.concat_ws("\t", F.lit("SAME"), F.col("rep").cast("string"), F.col("node").cast("string")).alias("value")))
    heads = ([] if consistent is None else [f"CONSISTENT {int(consistent)}"]) + ([f"DROPPED {dropped}"] if dropped else [])
    return subs.sparkSession.createDataFrame([(h,) for h in heads], "value string").unionByName(out) if heads else out


def json_rows(subs: DataFrame) -> DataFrame:
    """(value): one JSON object per class with its super-classes, for `write.text`; no row holds the whole answer."""
    per = subs.groupBy("sub").agg(F.array_sort(F.collect_set("sup")).alias("sups"))
    return per.select(F.to_json(F.struct(F.col("sub").alias("class"), F.col("sups").alias("subsumptions"), F.array_contains("sups", "owl:Nothing").alias("unsatisfiable"))).alias("value"))


def edge_rows(told: DataFrame) -> DataFrame:
    """(sub, sup, subsumptions_are_graph_edges): told links for consumers that close them themselves."""
    return told.select("sub", "sup").distinct().withColumn("subsumptions_are_graph_edges", F.lit(True))
