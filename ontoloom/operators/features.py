"""Structure of an ontology in counts: constructs, axiom heads, roles, clause shapes, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: OWL constructs by family
FAMILIES = {
    "existential": "ObjectSomeValuesFrom|ObjectHasValue",
    "universal": "ObjectAllValuesFrom",
    "disjunction": "ObjectUnionOf|DisjointUnion",
    "negation": "ObjectComplementOf|DisjointClasses",
    "number": "ObjectMinCardinality|ObjectMaxCardinality|ObjectExactCardinality|FunctionalObjectProperty",
    "nominal": "ObjectOneOf",
    "inverse": "InverseObjectProperties|ObjectInverseOf|SymmetricObjectProperty",
    "chain": "ObjectPropertyChain|TransitiveObjectProperty",
    "data": "DataSomeValuesFrom|DataAllValuesFrom|DataHasValue|DataPropertyAssertion",
    "rule": "DLSafeRule",
}


def text(axioms: DataFrame) -> DataFrame:
    return axioms.select("ontology", "head", F.concat("head", F.lit("("), F.array_join("args", " "), F.lit(")")).alias("text"))


def census(axioms: DataFrame) -> DataFrame:
    """(ontology, head, n) of axiom heads."""
    return axioms.groupBy("ontology", "head").agg(F.count(F.lit(1)).alias("n"))


def vector(axioms: DataFrame) -> DataFrame:
    """One row per ontology: axioms, and how often each family occurs, with has_ flags."""
    rows = text(axioms)
    counts = [F.sum(F.regexp_count("text", F.lit(rf"\b(?:{p})\b"))).alias(f"n_{k}") for k, p in FAMILIES.items()]
    got = rows.groupBy("ontology").agg(F.count(F.lit(1)).alias("n_axioms"), *counts)
    return got.select("*", *((F.col(f"n_{k}") > 0).alias(f"has_{k}") for k in FAMILIES))


def route(features: DataFrame) -> DataFrame:
    """(ontology, route): the engine by what occurs, never by how much: el, alc, or deferred."""
    hard = F.col("has_number") | F.col("has_nominal") | F.col("has_rule") | F.col("has_inverse")
    soft = F.col("has_universal") | F.col("has_disjunction")
    return features.select("ontology", F.when(hard, "deferred").when(soft, "alc").otherwise("el").alias("route"))


def role_census(role_facts: DataFrame) -> DataFrame:
    """(role, n_facts, n_src, n_dst, max_out): sizes and the largest fan-out of each role."""
    out = role_facts.groupBy("role", "src").agg(F.count(F.lit(1)).alias("n")).groupBy("role").agg(F.sum("n").alias("n_facts"), F.count(F.lit(1)).alias("n_src"), F.max("n").alias("max_out"))
    return out.join(role_facts.select("role", "dst").distinct().groupBy("role").agg(F.count(F.lit(1)).alias("n_dst")), "role")


def clause_shapes(clauses: DataFrame) -> DataFrame:
    """One row of clause statistics."""
    concepts = F.filter(F.concat("body", "head"), lambda a: a["kind"] == "concept")
    rows = clauses.select(F.size("body").alias("b"), F.size("head").alias("h"), F.transform(concepts, lambda a: a["name"]).alias("names"))
    shape = rows.agg(F.count(F.lit(1)).alias("n_clauses"), F.max("b").alias("max_body"), F.max("h").alias("max_head"), F.sum(F.when(F.col("h") <= 1, 1).otherwise(0)).alias("n_horn"), F.avg("b").alias("mean_body"))
    names = rows.select(F.explode("names").alias("name")).agg(F.count_distinct("name").alias("n_concepts"))
    return shape.join(F.broadcast(names))  # one row each
