"""A knowledge base over the relational tables: individuals, classes, roles and data facts.

Individuals are longs, 8 * key + kind, so tables join without a dictionary; `label` gives them back their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind code of an individual and the first letter of its name
KINDS = {"customer": (0, "c"), "orders": (1, "o"), "supplier": (2, "s"), "part": (3, "p"), "nation": (4, "n"), "region": (5, "r")}
PREFIX = ["c", "o", "s", "p", "n", "r"]


def ind(kind: str, column: str) -> Column:
    return F.col(column).cast("long") * 8 + KINDS[kind][0]


def label(column: str) -> Column:
    c = F.col(column)
    return F.concat(F.element_at(F.array(*map(F.lit, PREFIX)), (F.pmod(c, F.lit(8)) + 1).cast("int")), F.shiftright(c, 3).cast("string"))


class KB:
    """Lazy fact tables; only the columns a query asks for are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def roles(self, *names: str) -> DataFrame:
        """(role, src, dst) facts of the named roles."""
        t = self.table
        sources = {
            "placedBy": lambda: t("orders").select(ind("orders", "o_orderkey").alias("src"), ind("customer", "o_custkey").alias("dst")),
            "inNation": lambda: t("customer").select(ind("customer", "c_custkey").alias("src"), ind("nation", "c_nationkey").alias("dst"))
            .unionByName(t("supplier").select(ind("supplier", "s_suppkey").alias("src"), ind("nation", "s_nationkey").alias("dst"))),
            "inRegion": lambda: t("nation").select(ind("nation", "n_nationkey").alias("src"), ind("region", "n_regionkey").alias("dst")),
            "hasPart": lambda: t("lineitem").select(ind("orders", "l_orderkey").alias("src"), ind("part", "l_partkey").alias("dst")),
            "suppliedBy": lambda: t("lineitem").select(ind("orders", "l_orderkey").alias("src"), ind("supplier", "l_suppkey").alias("dst")),
        }
        out = None
        for n in names:
            rows = sources[n]().select(F.lit(n).alias("role"), "src", "dst")
            out = rows if out is None else out.unionByName(rows)
        return out

    def classes(self, *kinds: str) -> DataFrame:
        """(ind, cls) facts: segment of customers, priority of orders, brand and type of parts, kind of the rest."""
        t = self.table
        sources = {
            "customer": lambda: t("customer").select(ind("customer", "c_custkey").alias("ind"), F.concat(F.lit("Segment_"), "c_mktsegment").alias("cls")),
            "orders": lambda: t("orders").select(ind("orders", "o_orderkey").alias("ind"), F.concat(F.lit("Priority_"), "o_orderpriority").alias("cls")),
            "part": lambda: t("part").select(ind("part", "p_partkey").alias("ind"), F.explode(F.array(F.concat(F.lit("Brand_"), "p_brand"), F.concat(F.lit("Type_"), "p_type"))).alias("cls")),
            "nation": lambda: t("nation").select(ind("nation", "n_nationkey").alias("ind"), F.lit("Nation").alias("cls")),
            "region": lambda: t("region").select(ind("region", "r_regionkey").alias("ind"), F.lit("Region").alias("cls")),
        }
        out = None
        for k in kinds:
            rows = sources[k]()
            out = rows if out is None else out.unionByName(rows)
        return out

    def tbox(self) -> DataFrame:
        """(sub, sup): told subsumptions over the names of nations, regions, parts, segments and priorities."""
        t = self.table
        one = lambda *rows: self.spark.createDataFrame(list(rows), "sub string, sup string")
        nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("Nation_"), "n_name").alias("sub"), F.concat(F.lit("Region_"), "r_name").alias("sup"))
        regions = t("region").select(F.concat(F.lit("Region_"), "r_name").alias("sub"), F.lit("Place").alias("sup"))
        brands = t("part").select("p_brand").distinct().select(F.concat(F.lit("Brand_"), "p_brand").alias("sub"), F.concat(F.lit("Maker_"), F.substring("p_brand", 1, 7)).alias("sup"))
        makers = brands.select(F.col("sup").alias("sub")).distinct().withColumn("sup", F.lit("Branded"))
        types = t("part").select("p_type").distinct().select(F.concat(F.lit("Type_"), "p_type").alias("sub"), F.lit("Typed").alias("sup"))
        segments = t("customer").select("c_mktsegment").distinct().select(F.concat(F.lit("Segment_"), "c_mktsegment").alias("sub"), F.lit("Customer").alias("sup"))
        priorities = t("orders").select("o_orderpriority").distinct().select(F.concat(F.lit("Priority_"), "o_orderpriority").alias("sub"), F.lit("Order").alias("sup"))
        top = one(("Branded", "Product"), ("Typed", "Product"), ("Product", "Thing_"), ("Place", "Thing_"), ("Customer", "Agent"), ("Agent", "Thing_"), ("Order", "Thing_"))
        out = top
        for x in (nations, regions, brands, makers, types, segments, priorities):
            out = out.unionByName(x)
        return out
