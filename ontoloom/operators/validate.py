"""Input validation: each check returns the offending rows; no row means valid. Axioms are (id, head, args array<string>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure
from . import rbox

# fixed values: the standard prefixes of OWL 2
STANDARD = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}

# fixed values: kinds of entity that may not share a name
CLASHING = [("Class", "Datatype"), ("ObjectProperty", "DataProperty"), ("ObjectProperty", "AnnotationProperty"), ("DataProperty", "AnnotationProperty")]


def duplicate_prefixes(prefixes: DataFrame) -> DataFrame:
    """Prefixes (prefix, iri) declared twice, or a standard one bound elsewhere."""
    standard = F.element_at(F.create_map(*(F.lit(x) for p in STANDARD.items() for x in p)), F.col("prefix"))
    twice = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix", F.lit("declared twice").alias("why"))
    return twice.unionByName(prefixes.where(standard.isNotNull() & (standard != F.col("iri"))).select("prefix", F.lit("standard prefix rebound").alias("why")).distinct())


def unknown_prefixes(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Abbreviated names (name) whose prefix nobody declares."""
    short = names.where(~F.col("name").startswith("<") & F.col("name").contains(":"))
    return short.withColumn("prefix", F.substring_index("name", ":", 1)).join(prefixes.select("prefix"), "prefix", "left_anti").where(~F.col("prefix").isin(*STANDARD)).select("name")


def undeclared(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, kind) used without a declaration of that kind; individuals and built-in names need none."""
    mine = uses.where((F.col("kind") != "NamedIndividual") & ~F.col("name").rlike("^(owl|rdf|rdfs|xsd):"))
    return mine.join(declared, ["name", "kind"], "left_anti").select("name", "kind").distinct()


def punned(declared: DataFrame) -> DataFrame:
    """Names declared as two kinds that may not share one."""
    kinds = declared.groupBy("name").agg(F.collect_set("kind").alias("kinds"))
    clash = F.lit(False)
    for a, b in CLASHING:
        clash = clash | (F.array_contains("kinds", a) & F.array_contains("kinds", b))
    return kinds.where(clash).select("name")


def non_simple_uses(uses: DataFrame, subrole: DataFrame, chains: DataFrame, transitive: DataFrame) -> DataFrame:
    """(id, role): axioms that need a simple role and have a composite one."""
    return uses.join(rbox.non_simple(subrole, chains, transitive), "role", "left_semi")


def not_a_forest(edges: DataFrame) -> DataFrame:
    """Anonymous individuals' edges (a, b) that break the forest: loops, parallel edges, and what is left of components with as many
    edges as nodes once their leaves have gone, again and again."""
    from ..plans.fixpoint import components, written

    und = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    loops = und.where("a = b").select("a", "b", F.lit("loop").alias("why")).distinct()
    parallel = und.where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", F.lit("parallel").alias("why"))
    plain = written(und.where("a <> b").distinct())
    moved = lambda df: df.hint("merge")  # noqa: E731  # grows with the nodes: never sent to the driver

    def trimmed(core: DataFrame) -> DataFrame:
        ends = core.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("x")
        return written(core.join(moved(ends.withColumnRenamed("x", "a")), "a", "left_semi").join(moved(ends.withColumnRenamed("x", "b")), "b", "left_semi").select("a", "b"))

    # leaves go first, as they are the most; components then end what would be trimmed link by link
    plain = trimmed(plain)
    comp = written(components(plain))
    nodes = comp.groupBy("rep").agg(F.count(F.lit(1)).alias("nodes"))
    links = plain.join(moved(comp), F.col("a") == F.col("node")).select("a", "b", "rep")
    cyclic = nodes.join(moved(links.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))), "rep").where("links >= nodes").select("rep")
    core, n = written(links.join(moved(cyclic), "rep", "left_semi").select("a", "b")), -1
    while n != (n := core.count()):
        core = trimmed(core)
    return loops.unionByName(parallel).unionByName(core.withColumn("why", F.lit("cycle")))


def cyclic_datatypes(definitions: DataFrame) -> DataFrame:
    """Datatypes (name, uses) that reach themselves, and those defined twice."""
    loop = closure(definitions, "name", "uses").where("name = uses").select("name", F.lit("cyclic").alias("why"))
    return loop.unionByName(definitions.select("name", "definition").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit("defined twice").alias("why")))


def misused_top_data(axioms: DataFrame) -> DataFrame:
    """Axioms that use owl:topDataProperty anywhere but as a super-property."""
    elsewhere = F.array_contains(F.when(F.col("head") == "SubDataPropertyOf", F.slice("args", 1, 1)).otherwise(F.col("args")), "owl:topDataProperty")
    return axioms.where(elsewhere)


def dropped(axioms: DataFrame, supported: list[str]) -> DataFrame:
    """(head, n): axioms outside the supported heads, counted so that an answer can say what it left out."""
    return axioms.where(~F.col("head").isin(supported)).groupBy("head").agg(F.count(F.lit(1)).alias("n"))
