"""Queries of the reasoning operators over the relational tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builtins, facets, literals
from ..operators import abox, clashes, data, el, features, rbox, rules, taxonomy, types, validate
from ..sources import answers, ofn
from ..streaming import incremental
from . import classify
from .fixpoint import closure, components, written
from .kb import KB, ind, label

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _ALL[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rows(spark: SparkSession, schema: str, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


TBOX = """told(sub, sup) AS (
    SELECT 'Nation_' || n_name, 'Region_' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT 'Region_' || r_name, 'Place' FROM region
    UNION SELECT DISTINCT 'Brand_' || p_brand, 'Maker_' || substr(p_brand, 1, 7) FROM part
    UNION SELECT DISTINCT 'Maker_' || substr(p_brand, 1, 7), 'Branded' FROM part
    UNION SELECT DISTINCT 'Type_' || p_type, 'Typed' FROM part
    UNION SELECT DISTINCT 'Segment_' || c_mktsegment, 'Customer' FROM customer
    UNION SELECT DISTINCT 'Priority_' || o_orderpriority, 'Order' FROM orders
    UNION VALUES ('Branded', 'Product'), ('Typed', 'Product'), ('Product', 'Thing_'), ('Place', 'Thing_'), ('Customer', 'Agent'), ('Agent', 'Thing_'), ('Order', 'Thing_')),
closed(sub, sup) AS (SELECT sub, sup FROM told UNION SELECT c.sub, t.sup FROM closed c JOIN told t ON c.sup = t.sub)"""


def el_axioms(spark: SparkSession, sf_dir: str) -> el.ELAxioms:
    """Orders, customers and places as classes: every order is under some placedBy.customer, and so on."""
    kb = KB(spark, sf_dir)
    t = kb.table
    order, customer = F.concat(F.lit("O_"), "o_orderkey"), F.concat(F.lit("C_"), "o_custkey")
    nf1 = kb.tbox().unionByName(t("customer").select(F.concat(F.lit("C_"), "c_custkey").alias("sub"), F.concat(F.lit("Segment_"), "c_mktsegment").alias("sup")))
    nf1 = nf1.unionByName(t("orders").select(order.alias("sub"), F.concat(F.lit("Priority_"), "o_orderpriority").alias("sup")))
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("Nation_"), "n_name").alias("filler"))
    nf3 = t("orders").select(order.alias("sub"), F.lit("placedBy").alias("role"), customer.alias("filler"))
    nf3 = nf3.unionByName(t("customer").join(nations, "c_nationkey").select(F.concat(F.lit("C_"), "c_custkey").alias("sub"), F.lit("inNation").alias("role"), "filler"))
    return el.ELAxioms(
        spark, nf1=nf1, nf3=nf3,
        nf2=_rows(spark, "left string, right string, sup string", ("Priority_1-URGENT", "BuildingOrder", "RushBuilding"), ("AsiaOrder", "BuildingOrder", "owl:Nothing")),
        nf4=_rows(spark, "role string, filler string, sup string", ("placedBy", "Segment_BUILDING", "BuildingOrder"), ("orderedFrom", "Region_ASIA", "AsiaOrder"), ("locatedIn", "Region_EUROPE", "European")),
        nf6=_rows(spark, "sub string, sup string", ("inNation", "locatedIn")),
        nf7=_rows(spark, "first string, second string, sup string", ("placedBy", "inNation", "orderedFrom")),
    )


_EL = f"""WITH RECURSIVE {TBOX},
person AS (SELECT 'C_' || c_custkey AS cls, c_custkey, 'Segment_' || c_mktsegment AS seg, 'Nation_' || n_name AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey),
euro AS (SELECT DISTINCT sub FROM closed WHERE sup = 'Region_EUROPE' UNION SELECT 'Region_EUROPE'),
asia AS (SELECT DISTINCT sub FROM closed WHERE sup = 'Region_ASIA' UNION SELECT 'Region_ASIA'),
ord AS (SELECT 'O_' || o_orderkey AS cls, 'Priority_' || o_orderpriority AS pri, p.seg, p.nat FROM orders JOIN person p ON o_custkey = c_custkey),
bad AS (SELECT cls FROM ord WHERE seg = 'Segment_BUILDING' AND nat IN (SELECT sub FROM asia)),
subs AS (
    SELECT sub, sup FROM closed
    UNION SELECT cls, seg FROM person UNION SELECT cls, c.sup FROM person JOIN closed c ON c.sub = seg
    UNION SELECT cls, 'European' FROM person WHERE nat IN (SELECT sub FROM euro)
    UNION SELECT cls, pri FROM ord UNION SELECT cls, c.sup FROM ord JOIN closed c ON c.sub = pri
    UNION SELECT cls, 'BuildingOrder' FROM ord WHERE seg = 'Segment_BUILDING'
    UNION SELECT cls, 'AsiaOrder' FROM ord WHERE nat IN (SELECT sub FROM asia)
    UNION SELECT cls, 'RushBuilding' FROM ord WHERE seg = 'Segment_BUILDING' AND pri = 'Priority_1-URGENT')"""


@query(f"{_EL} SELECT sub, sup FROM subs WHERE sub NOT IN (SELECT cls FROM bad) UNION SELECT cls, 'owl:Nothing' FROM bad")
def el_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    axioms = el_axioms(spark, sf_dir)
    symbols = axioms.symbols()
    return el.readout(el.complete(axioms, symbols), symbols)


@query(f"{_EL} SELECT cls AS sub FROM bad")
def el_unsat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el_taxonomy(spark, sf_dir).where("sup = 'owl:Nothing'").select("sub")


@query(f"{_EL} SELECT 'O_' || o_orderkey AS src, 'orderedFrom' AS role, p.nat AS dst FROM orders JOIN person p ON o_custkey = c_custkey UNION ALL SELECT cls, 'locatedIn', nat FROM person")
def el_role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    axioms = el_axioms(spark, sf_dir)
    symbols = axioms.symbols()
    return el.edges(el.complete(axioms, symbols), symbols, ["orderedFrom", "locatedIn"])


@query(f"WITH RECURSIVE {TBOX} SELECT sub, sup FROM closed")
def el_nf1_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    axioms = el.ELAxioms(spark, nf1=KB(spark, sf_dir).tbox())
    symbols = axioms.symbols()
    return el.readout(el.complete(axioms, symbols), symbols)


@query("""WITH n AS (SELECT 'n' || n_nationkey AS n FROM nation)
    SELECT n || x AS sub, CASE WHEN y = 'owl:Nothing' THEN y ELSE n || y END AS sup FROM n, (VALUES ('A', 'D'), ('B', 'D'), ('E', 'owl:Nothing'), ('G', 'owl:Nothing'), ('H', 'K'), ('X', 'owl:Nothing'), ('Y', 'owl:Nothing')) t(x, y)""")
def el_small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation: transitivity, bottom through an edge and through an existential on the left, a reflexive role."""
    n = KB(spark, sf_dir).table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("n"))
    c = lambda x: F.concat("n", F.lit(x))
    rows = lambda *of: n.select(F.explode(F.array(*of)).alias("x")).select("x.*")
    link = lambda a, r, b: F.struct(c(a).alias("sub"), F.lit(r).alias("role"), c(b).alias("filler"))
    back = lambda r, a, b: F.struct(F.lit(r).alias("role"), c(a).alias("filler"), (c(b) if b else F.lit("owl:Nothing")).alias("sup"))
    axioms = el.ELAxioms(
        spark,
        nf3=rows(link("A", "r", "B"), link("B", "r", "C"), link("E", "s", "G"), link("X", "r", "F"), link("Y", "s", "X")),
        nf4=rows(back("r", "C", "D"), back("refl", "H", "K"), back("r", "F", None)),
        nf5=n.select(c("G").alias("sub")),
        nf7=_rows(spark, "first string, second string, sup string", ("r", "r", "r")),
        reflexive=_rows(spark, "role string", ("refl",)),
    )
    symbols = axioms.symbols()
    return el.readout(el.complete(axioms, symbols), symbols)


@query(f"WITH RECURSIVE {TBOX} SELECT t.sub, t.sup FROM told t WHERE NOT EXISTS (SELECT 1 FROM closed a JOIN closed b ON a.sup = b.sub WHERE a.sub = t.sub AND b.sup = t.sup)")
def taxonomy_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.direct(written(closure(KB(spark, sf_dir).tbox(), "sub", "sup")))


_CYCLE = "extra(sub, sup) AS (SELECT 'Place', 'Area' UNION SELECT 'Area', 'Place')"


@query(f"""WITH RECURSIVE {TBOX.split(',\nclosed')[0]}, {_CYCLE}, e AS (SELECT * FROM told UNION SELECT * FROM extra),
    closed(sub, sup) AS (SELECT sub, sup FROM e UNION SELECT c.sub, e.sup FROM closed c JOIN e ON c.sup = e.sub)
    SELECT n.cls, coalesce(least(n.cls, (SELECT min(a.sup) FROM closed a JOIN closed b ON a.sup = b.sub AND a.sub = b.sup WHERE a.sub = n.cls)), n.cls) AS rep
    FROM (SELECT sub AS cls FROM e UNION SELECT sup FROM e) n""")
def taxonomy_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = KB(spark, sf_dir).tbox().unionByName(_rows(spark, "sub string, sup string", ("Place", "Area"), ("Area", "Place")))
    return taxonomy.equivalents(written(closure(told, "sub", "sup")))


@query(f"""WITH RECURSIVE {TBOX}, names AS (SELECT sub AS n FROM told UNION SELECT sup FROM told)
    SELECT a.n AS sub, b.n AS sup, a.n = b.n OR EXISTS (SELECT 1 FROM closed WHERE sub = a.n AND sup = b.n) AS entailed
    FROM names a JOIN names b ON b.n IN ('Place', 'Product', 'Agent')""")
def entailment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = KB(spark, sf_dir).tbox()
    names = told.select(F.explode(F.array("sub", "sup")).alias("sub")).distinct()
    asked = names.withColumn("sup", F.explode(F.array(*map(F.lit, ("Place", "Product", "Agent")))))
    return taxonomy.entailed(written(closure(told, "sub", "sup")), asked)


@query(f"WITH RECURSIVE {TBOX}, reach(n) AS (SELECT 'Nation_NATION_3' UNION SELECT sup FROM closed WHERE sub = 'Nation_NATION_3') SELECT sub, sup FROM told WHERE sub IN (SELECT n FROM reach)")
def locality_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = KB(spark, sf_dir).tbox().distinct()
    axioms = told.select(F.xxhash64("sub", "sup").alias("id"), F.array("sub").alias("left"), F.array("sup").alias("right"))
    return taxonomy.module(axioms, _rows(spark, "name string", ("Nation_NATION_3",))).select(F.col("left")[0].alias("sub"), F.col("right")[0].alias("sup"))


@query("""SELECT '3,' || (1000 + n_regionkey) AS axioms FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '2003,' || (3000 + n_regionkey) FROM nation WHERE n_nationkey = 3""")
def explain_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why is nation 3 under Place: through its region, or through its zone; the way through a twin of itself is not minimal."""
    n = KB(spark, sf_dir).table("nation")
    link = lambda id_, a, b: F.struct(id_.cast("long").alias("id"), a.alias("sub"), b.alias("sup"))
    name = lambda p, c: F.concat(F.lit(p), c)
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    told = n.select(F.explode(F.array(
        link(k, name("N", k), name("R", r)), link(1000 + r, name("R", r), F.lit("Place")), link(2000 + k, name("N", k), name("Z", r)), link(3000 + r, name("Z", r), F.lit("Place")),
        link(4000 + k, name("N", k), name("T", k)), link(5000 + k, name("T", k), name("N", k)))).alias("x")).select("x.*").distinct()
    return taxonomy.justifications(told, "N3", "Place").select(F.array_join("axioms", ",").alias("axioms"))


# role boxes

_ROLES_SQL = "e0(sub, sup) AS (SELECT 'in_n' || n_nationkey, 'in_r' || n_regionkey FROM nation UNION SELECT 'in_r' || r_regionkey, 'in' FROM region UNION SELECT '-holds_r' || r_regionkey, 'in_r' || r_regionkey FROM region)"


def _subroles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role for every nation under its region's, that under one for all, and an inverse for every region."""
    t = KB(spark, sf_dir).table
    role = lambda p, c: F.concat(F.lit(p), c)
    nations = t("nation").select(role("in_n", "n_nationkey").alias("sub"), role("in_r", "n_regionkey").alias("sup"))
    regions = t("region").select(F.explode(F.array(F.struct(role("in_r", "r_regionkey").alias("sub"), F.lit("in").alias("sup")), F.struct(role("-holds_r", "r_regionkey").alias("sub"), role("in_r", "r_regionkey").alias("sup")))).alias("x"))
    return nations.unionByName(regions.select("x.*"))


@query(f"""WITH RECURSIVE {_ROLES_SQL}, e(sub, sup) AS (SELECT sub, sup FROM e0 UNION SELECT CASE WHEN sub[1] = '-' THEN sub[2:] ELSE '-' || sub END, CASE WHEN sup[1] = '-' THEN sup[2:] ELSE '-' || sup END FROM e0),
    c(sub, sup) AS (SELECT sub, sup FROM e UNION SELECT sub, sub FROM e UNION SELECT sup, sup FROM e UNION SELECT c.sub, e.sup FROM c JOIN e ON c.sup = e.sub) SELECT sub, sup FROM c""")
def rbox_super_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rbox.super_closure(_subroles(spark, sf_dir))


@query("""SELECT 'in_n' || n_nationkey AS role FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT 'in_r' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT 'in' UNION SELECT 'holds_r' || r_regionkey FROM region WHERE r_regionkey = 1
    UNION SELECT 'in_r' || r_regionkey FROM region WHERE r_regionkey = 1""")
def rbox_nonsimple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth nation's role is a chain's, one inverse is transitive: both and all above them are composite."""
    n = KB(spark, sf_dir).table("nation").where("n_nationkey % 5 = 0").select(F.lit("a").alias("first"), F.lit("b").alias("second"), F.concat(F.lit("in_n"), "n_nationkey").alias("sup"))
    return rbox.non_simple(_subroles(spark, sf_dir), n, _rows(spark, "role string", ("holds_r1",)))


@query("SELECT 's' || n_nationkey AS role FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 't' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def rbox_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation two chains that need each other's role, if it is even; chains that only begin or end with their own role are regular."""
    n = KB(spark, sf_dir).table("nation")
    role = lambda p: F.concat(F.lit(p), "n_nationkey")
    chain = lambda a, b, c: F.struct(a.alias("first"), b.alias("second"), c.alias("sup"))
    back = F.when(F.col("n_nationkey") % 2 == 0, role("s")).otherwise(role("q"))
    chains = n.select(F.explode(F.array(chain(role("r"), role("t"), role("s")), chain(back, role("r"), role("t")), chain(role("u"), role("u"), role("u")), chain(role("v"), role("u"), role("v")))).alias("x")).select("x.*")
    return rbox.irregular(n.select(role("r").alias("sub"), role("p").alias("sup")), chains)


_GEO = """geo(src, dst) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    reg(src, dst) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


@query(f"""WITH {_GEO}, ord(src, dst) AS (SELECT DISTINCT 'o' || o_orderkey, 'c' || o_custkey FROM orders)
    SELECT 'locatedIn' AS role, src, dst FROM geo UNION ALL SELECT 'locatedIn', src, dst FROM reg UNION ALL SELECT 'locatedIn', g.src, r.dst FROM geo g JOIN reg r ON g.dst = r.src
    UNION ALL SELECT 'placed', dst, src FROM ord UNION ALL SELECT DISTINCT 'orderedFrom', o.src, g.dst FROM ord o JOIN geo g ON o.dst = g.src
    UNION ALL SELECT 'neighbour', src, dst FROM (SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst FROM nation a JOIN nation b ON abs(a.n_nationkey - b.n_nationkey) = 1)""")
def rbox_role_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchy, inverse, symmetry, transitivity and a chain at once."""
    kb = KB(spark, sf_dir)
    pairs = kb.table("nation").select(F.lit("neighbour").alias("role"), ind("nation", "n_nationkey").alias("src"), (ind("nation", "n_nationkey") + 8).alias("dst"))
    nations = kb.table("nation").select(ind("nation", "n_nationkey").alias("dst"))
    facts = kb.roles("placedBy", "inNation", "inRegion").unionByName(pairs.join(nations, "dst", "left_semi"))
    got = rbox.role_facts(
        facts,
        _rows(spark, "sub string, sup string", ("inNation", "locatedIn"), ("inRegion", "locatedIn")),
        _rows(spark, "role string, inverse string", ("placedBy", "placed")),
        _rows(spark, "role string", ("neighbour",)),
        _rows(spark, "role string", ("locatedIn",)),
        _rows(spark, "first string, second string, sup string", ("placedBy", "inNation", "orderedFrom")),
    )
    return got.where(F.col("role").isin("locatedIn", "placed", "orderedFrom", "neighbour")).select("role", label("src").alias("src"), label("dst").alias("dst"))


@query("""SELECT DISTINCT 'o' || o_orderkey AS ind, 'Order' AS cls FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 'Buyer' FROM orders
    UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'Filled' FROM lineitem UNION ALL SELECT DISTINCT 'p' || l_partkey, 'Sold' FROM lineitem""")
def rbox_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = KB(spark, sf_dir).roles("placedBy", "hasPart")
    got = rbox.domain_range(facts, _rows(spark, "role string, cls string", ("placedBy", "Order"), ("hasPart", "Filled")), _rows(spark, "role string, cls string", ("placedBy", "Buyer"), ("hasPart", "Sold")))
    return got.select(label("ind").alias("ind"), "cls")


@query("SELECT DISTINCT 'o' || o_orderkey AS src, 'r' || n_regionkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def rule_chain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = _rows(spark, "from_state string, role string, to_state string", ("0", "placedBy", "1"), ("1", "inNation", "2"), ("2", "inRegion", "3"))
    got = rbox.path_automaton(KB(spark, sf_dir).roles("placedBy", "inNation", "inRegion"), moves, "0", ["3"])
    return got.select(label("src").alias("src"), label("dst").alias("dst"))


# assertions

_FACTS = """facts(ind, cls) AS (SELECT 'c' || c_custkey, 'Segment_' || c_mktsegment FROM customer UNION SELECT 'o' || o_orderkey, 'Priority_' || o_orderpriority FROM orders
    UNION SELECT 'p' || p_partkey, 'Brand_' || p_brand FROM part UNION SELECT 'p' || p_partkey, 'Type_' || p_type FROM part)"""


@query(f"WITH RECURSIVE {TBOX}, {_FACTS} SELECT ind, cls FROM facts UNION SELECT f.ind, c.sup FROM facts f JOIN closed c ON c.sub = f.cls")
def abox_types_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KB(spark, sf_dir)
    return abox.all_types(kb.classes("customer", "orders", "part"), kb.tbox()).select(label("ind").alias("ind"), "cls")


@query(f"WITH {_FACTS} SELECT ind, cls FROM facts")
def abox_types_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Told types with classes far above them, which must go again."""
    kb = KB(spark, sf_dir)
    told = written(kb.tbox())
    facts = kb.classes("customer", "orders", "part")
    far = kb.classes("customer").select("ind", F.lit("Agent").alias("cls")).unionByName(kb.classes("part").select("ind", F.lit("Product").alias("cls")))
    return abox.direct_types(written(abox.all_types(facts, told, far)), told).select(label("ind").alias("ind"), "cls")


@query("""WITH o AS (SELECT 'o' || o_orderkey AS ind, 'c' || o_custkey AS c, o_orderpriority AS p, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey),
    seg AS (SELECT 'c' || c_custkey AS ind, 'Segment_' || c_mktsegment AS cls FROM customer)
    SELECT ind, 'Priority_' || p AS cls FROM o UNION SELECT ind, 'Order' FROM o UNION SELECT ind, cls FROM seg UNION SELECT ind, 'Customer' FROM seg UNION SELECT DISTINCT c, 'Buyer' FROM o
    UNION SELECT ind, 'BuildingOrder' FROM o WHERE s = 'BUILDING' UNION SELECT ind, 'RushBuilding' FROM o WHERE s = 'BUILDING' AND p = '1-URGENT'
    UNION SELECT ind, 'Flagged' FROM o WHERE s = 'BUILDING' AND p = '1-URGENT'""")
def abox_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KB(spark, sf_dir)
    told = kb.table("customer").select("c_mktsegment").distinct().select(F.concat(F.lit("Segment_"), "c_mktsegment").alias("sub"), F.lit("Customer").alias("sup"))
    told = told.unionByName(_rows(spark, "sub string, sup string", ("RushBuilding", "Flagged")))
    got = abox.materialize(
        kb.classes("customer", "orders"), kb.roles("placedBy"), told,
        _rows(spark, "left string, right string, sup string", ("Priority_1-URGENT", "BuildingOrder", "RushBuilding")),
        _rows(spark, "role string, filler string, sup string", ("placedBy", "Segment_BUILDING", "BuildingOrder")),
        _rows(spark, "role string, cls string", ("placedBy", "Order")), _rows(spark, "role string, cls string", ("placedBy", "Buyer")),
    )
    return got.select(label("ind").alias("ind"), "cls")


@query("""WITH k AS (SELECT c_custkey, c_nationkey, c_mktsegment, floor(c_acctbal / 1000) AS b FROM customer),
    g AS (SELECT c_nationkey, c_mktsegment, b, min(c_custkey) AS rep FROM k GROUP BY 1, 2, 3) SELECT 'c' || c_custkey AS node, 'c' || rep AS rep FROM k JOIN g USING (c_nationkey, c_mktsegment, b)""")
def abox_same_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = KB(spark, sf_dir).table("customer").select(ind("customer", "c_custkey").alias("node"), "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("b"))
    return abox.same_by_key(rows, "node", ["c_nationkey", "c_mktsegment", "b"]).select(label("node").alias("node"), label("rep").alias("rep"))


@query("""WITH RECURSIVE e(a, b) AS (SELECT DISTINCT 's' || l1.l_suppkey, 's' || l2.l_suppkey FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT a AS node, 's' || min(CAST(substr(b, 2) AS BIGINT)) AS rep FROM r GROUP BY a HAVING count(DISTINCT b) > 1""")
def abox_same_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliedBy taken as functional: suppliers of one order are one."""
    facts = KB(spark, sf_dir).table("lineitem").select(F.lit("suppliedBy").alias("role"), ind("orders", "l_orderkey").alias("src"), ind("supplier", "l_suppkey").alias("dst"))
    return abox.same_functional(facts, _rows(spark, "role string", ("suppliedBy",))).select(label("node").alias("node"), label("rep").alias("rep"))


@query("""SELECT 'c' || c_custkey AS ind, 'Poor' AS a, 'Rich' AS b FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def abox_clash_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = KB(spark, sf_dir).table
    facts = t("customer").where("c_acctbal < 0").select(ind("customer", "c_custkey").alias("ind"), F.lit("Poor").alias("cls"))
    facts = facts.unionByName(t("orders").where("o_totalprice > 200000").select(ind("customer", "o_custkey").alias("ind"), F.lit("Rich").alias("cls")).distinct())
    return abox.disjoint_clash(facts, _rows(spark, "a string, b string", ("Poor", "Rich"))).select(label("ind").alias("ind"), "a", "b")


@query("""SELECT DISTINCT 'locatedIn' AS role, 'c' || c_custkey AS src, 'r' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_mktsegment = 'BUILDING'""")
def abox_clash_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KB(spark, sf_dir)
    none = _rows(spark, "role string, inverse string")
    facts = rbox.role_facts(kb.roles("inNation", "inRegion"), _rows(spark, "sub string, sup string", ("inNation", "locatedIn"), ("inRegion", "locatedIn")), none, none.select("role"),
                            _rows(spark, "role string", ("locatedIn",)), _rows(spark, "first string, second string, sup string"))
    denied = kb.table("customer").where("c_mktsegment = 'BUILDING'").select(F.lit("locatedIn").alias("role"), ind("customer", "c_custkey").alias("src"), F.lit(2 * 8 + 5).cast("long").alias("dst"))
    return abox.negative_clash(facts, denied).select("role", label("src").alias("src"), label("dst").alias("dst"))


@query("""WITH k AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS rep FROM customer)
    SELECT 'c' || a.c_custkey AS a, 'c' || b.c_custkey AS b FROM k a JOIN k b ON b.c_custkey = a.c_custkey + 1 WHERE a.rep = b.rep""")
def abox_clash_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = KB(spark, sf_dir).table("customer").select(ind("customer", "c_custkey").alias("node"), "c_nationkey", "c_mktsegment")
    different = customers.select(F.col("node").alias("a"), (F.col("node") + 8).alias("b"))
    return abox.different_clash(abox.same_by_key(customers, "node", ["c_nationkey", "c_mktsegment"]), different).select(label("a").alias("a"), label("b").alias("b"))


@query("""WITH k AS (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS rep FROM supplier)
    SELECT 'suppliedBy' AS role, 'o' || l_orderkey AS src, count(DISTINCT rep) AS n FROM lineitem JOIN k ON l_suppkey = s_suppkey GROUP BY l_orderkey""")
def abox_atmost_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct suppliers of an order, when suppliers of one nation are equal."""
    kb = KB(spark, sf_dir)
    same = abox.same_by_key(kb.table("supplier").select(ind("supplier", "s_suppkey").alias("node"), "s_nationkey"), "node", ["s_nationkey"])
    return abox.successor_counts(kb.roles("suppliedBy"), same).select("role", label("src").alias("src"), "n")


@query("""WITH k AS (SELECT c_custkey, c_mktsegment, min(c_custkey) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 5000)) AS rep FROM customer)
    SELECT DISTINCT 'c' || a.c_custkey AS ind, 'Segment_' || b.c_mktsegment AS cls FROM k a JOIN k b ON a.rep = b.rep""")
def abox_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KB(spark, sf_dir)
    rows = kb.table("customer").select(ind("customer", "c_custkey").alias("node"), "c_nationkey", F.floor(F.col("c_acctbal") / 5000).alias("b"))
    return abox.quotient(kb.classes("customer"), abox.same_by_key(rows, "node", ["c_nationkey", "b"])).select(label("ind").alias("ind"), "cls")


@query("""WITH big AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_totalprice > 100000)
    SELECT 'c' || c AS ind, 'BigSpender' AS cls FROM big UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'RichNation' FROM customer WHERE c_custkey IN (SELECT c FROM big) AND c_mktsegment = 'BUILDING'""")
def rule_builtin_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules, one with a comparison, the second fed by the first."""
    kb = KB(spark, sf_dir)
    edges = kb.roles("placedBy", "inNation").select(F.col("role").alias("pred"), F.col("src").alias("s"), F.col("dst").alias("o"))
    price = kb.table("orders").select(F.lit("price").alias("pred"), ind("orders", "o_orderkey").alias("s"), F.col("o_totalprice").cast("long").alias("o"))
    price = price.where("o >= 100000").join(kb.table("orders").where("o_totalprice > 100000").select(ind("orders", "o_orderkey").alias("s")), "s", "left_semi")
    seg = kb.classes("customer").where("cls = 'Segment_BUILDING'").select(F.col("cls").alias("pred"), F.col("ind").alias("s"), F.lit(-1).cast("long").alias("o"))
    a = rules.Atom
    made = rules.chase(
        edges.unionByName(price.select("pred", "s", "o")).unionByName(seg),
        [
            rules.Rule((a("placedBy", "?x", "?c"), a("price", "?x", "?v")), a("BigSpender", "?c"), builtins.where(("swrlb:greaterThanOrEqual", "?v", 100000))),
            rules.Rule((a("BigSpender", "?c"), a("Segment_BUILDING", "?c"), a("inNation", "?c", "?n")), a("RichNation", "?n")),
        ],
    )
    return made.where(F.col("pred").isin("BigSpender", "RichNation")).select(label("s").alias("ind"), F.col("pred").alias("cls"))


@query("""SELECT DISTINCT 'c' || o_custkey AS x, 's' || l_suppkey AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey""")
def rule_bgp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic body of four atoms: customers served by a supplier of their own nation."""
    facts = KB(spark, sf_dir).roles("placedBy", "suppliedBy", "inNation").select(F.col("role").alias("pred"), F.col("src").alias("s"), F.col("dst").alias("o"))
    a = rules.Atom
    rule = rules.Rule((a("suppliedBy", "?o", "?y"), a("placedBy", "?o", "?x"), a("inNation", "?x", "?n"), a("inNation", "?y", "?n")), a("served", "?x", "?y"))
    return rules.bindings(rule, [facts] * 4).select(label("x").alias("x"), label("y").alias("y")).distinct()


@query("""SELECT o_orderpriority AS grp, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, CAST(max(o_totalprice) AS DOUBLE) AS top FROM orders GROUP BY o_orderpriority""")
def sqwrl_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KB(spark, sf_dir).table("orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.max("o_totalprice").alias("top"))


# data

_RANGES = (("debt", -1e9, 0.0), ("low", 0.0, 3000.0), ("middle", 2000.0, 7000.0), ("high", 6000.0, 1e9))
_RANGES_SQL = "r(range_name, low, high) AS (VALUES ('debt', -1e9, 0.0), ('low', 0.0, 3000.0), ('middle', 2000.0, 7000.0), ('high', 6000.0, 1e9))"


def _balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = KB(spark, sf_dir).table("customer").select(ind("customer", "c_custkey").alias("ind"), F.col("c_acctbal").alias("value"))
    return facts, _rows(spark, "range_name string, low double, high double", *_RANGES)


@query(f"WITH {_RANGES_SQL} SELECT 'c' || c_custkey AS ind, range_name FROM customer JOIN r ON c_acctbal >= low AND c_acctbal < high")
def data_facet_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.facet_members(*_balances(spark, sf_dir)).select(label("ind").alias("ind"), "range_name")


@query("""WITH p AS (SELECT p_partkey, p_retailprice AS v FROM part), q AS (SELECT 'q' || (i * 10) AS range_name, i * 10.0 AS low, i * 10.0 + 25 AS high FROM range(90, 120) t(i))
    SELECT 'p' || p_partkey AS ind, range_name FROM p JOIN q ON v >= low AND v < high""")
def data_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = KB(spark, sf_dir).table("part").select(ind("part", "p_partkey").alias("ind"), F.col("p_retailprice").alias("value"))
    low = F.col("id") * 10.0
    ranges = spark.range(90, 120).select(F.concat(F.lit("q"), F.col("id") * 10).alias("range_name"), low.alias("low"), (low + 25).alias("high"))
    return data.binned_members(facts, ranges, 25.0).select(label("ind").alias("ind"), "range_name")


@query("WITH b AS (SELECT DISTINCT CAST(p_retailprice AS DOUBLE) AS v FROM part) SELECT v AS low, lead(v) OVER (ORDER BY v) AS high FROM b UNION ALL SELECT NULL, min(v) FROM b")
def data_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.cells(KB(spark, sf_dir).table("part").select(F.col("p_retailprice").cast("double").alias("value")))


@query(f"""WITH {_RANGES_SQL}, m AS (SELECT c_custkey, string_agg(range_name, ',' ORDER BY range_name) AS v FROM customer JOIN r ON c_acctbal >= low AND c_acctbal < high GROUP BY 1)
    SELECT 'c' || c_custkey AS ind, 'c' || min(c_custkey) OVER (PARTITION BY v) AS rep FROM m""")
def data_value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.profiles(data.facet_members(*_balances(spark, sf_dir))).select(label("ind").alias("ind"), label("rep").alias("rep"))


@query("SELECT 'o' || l_orderkey AS ind, 'quantity' AS prop FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_quantity) > 1")
def data_functional_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = KB(spark, sf_dir).table("lineitem").select(ind("orders", "l_orderkey").alias("ind"), F.lit("quantity").alias("prop"), literals.value_key(F.col("l_quantity").cast("string"), F.lit("xsd:double")).alias("value_key"))
    return data.functional_clash(rows).select(label("ind").alias("ind"), "prop")


@query("SELECT 'c' || o_custkey AS prop FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1 AND count(DISTINCT o_orderkey % 2) > 1")
def data_range_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property for every customer, with an enumerated range for every order: its priority and its parity."""
    items = F.array("o_orderpriority", (F.col("o_orderkey") % 2).cast("string"), "o_orderpriority")
    return data.empty_ranges(KB(spark, sf_dir).table("orders").select(F.concat(F.lit("c"), "o_custkey").alias("prop"), items.alias("items")))


@query("""WITH k AS (SELECT o_orderkey AS k FROM orders)
    SELECT '+00' || k AS lex, 'xsd:integer' AS dt, true AS ok, 'n:' || k AS value_key FROM k
    UNION ALL SELECT '-0' || k || '.50', 'xsd:decimal', true, 'n:-' || k || '.5' FROM k
    UNION ALL SELECT CAST(k AS VARCHAR), 'xsd:unsignedByte', k <= 255, 'n:' || k FROM k
    UNION ALL SELECT '-' || k, 'xsd:short', k <= 32768, 'n:' || CAST(-k AS VARCHAR) FROM k
    UNION ALL SELECT CASE WHEN k % 2 = 0 THEN '1' ELSE 'false' END, 'xsd:boolean', true, CASE WHEN k % 2 = 0 THEN 'b:true' ELSE 'b:false' END FROM k
    UNION ALL SELECT CASE k % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN '-0' ELSE 'INF' END, 'xsd:double', true, CASE k % 3 WHEN 0 THEN 'd:NaN' WHEN 1 THEN 'd:-0.0' ELSE 'd:INF' END FROM k
    UNION ALL SELECT 'a' || k, 'xsd:hexBinary', length(CAST(k AS VARCHAR)) % 2 = 1, 'x:A' || k FROM k
    UNION ALL SELECT '2024-02-29T10:00:00.' || k || '00Z', 'xsd:dateTime', true, 't:2024-02-29T10:00:00' || CASE k WHEN 0 THEN '' ELSE '.' || rtrim(CAST(k AS VARCHAR), '0') END || 'Z' FROM k
    UNION ALL SELECT 'x' || k, 'rdfs:Literal', false, 's:x' || k || '@' FROM k""")
def data_literal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine spellings for every order number."""
    k = F.col("o_orderkey").cast("string")
    n = F.col("o_orderkey")
    spelled = lambda lex, dt: F.struct(lex.alias("lex"), F.lit(dt).alias("dt"))
    rows = KB(spark, sf_dir).table("orders").select(F.explode(F.array(
        spelled(F.concat(F.lit("+00"), k), "xsd:integer"), spelled(F.concat(F.lit("-0"), k, F.lit(".50")), "xsd:decimal"), spelled(k, "xsd:unsignedByte"), spelled(F.concat(F.lit("-"), k), "xsd:short"),
        spelled(F.when(n % 2 == 0, "1").otherwise("false"), "xsd:boolean"), spelled(F.when(n % 3 == 0, "NaN").when(n % 3 == 1, "-0").otherwise("INF"), "xsd:double"), spelled(F.concat(F.lit("a"), k), "xsd:hexBinary"),
        spelled(F.concat(F.lit("2024-02-29T10:00:00."), k, F.lit("00Z")), "xsd:dateTime"), spelled(F.concat(F.lit("x"), k), "rdfs:Literal"))).alias("x")).select("x.*")
    return rows.select("lex", "dt", literals.valid(F.col("lex"), F.col("dt")).alias("ok"), literals.value_key(F.col("lex"), F.col("dt")).alias("value_key"))


@query("SELECT 'c' || c_custkey AS ind, 'InNonEmptyWorld' AS cls FROM customer WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 50)")
def universal_role_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universal role reaches every individual, so 'some U.C' holds everywhere or nowhere: a one-row flag."""
    kb = KB(spark, sf_dir)
    some = kb.table("part").where("p_size = 50").select(F.lit(1).alias("one")).limit(1)
    return kb.table("customer").join(F.broadcast(some)).select(F.concat(F.lit("c"), "c_custkey").alias("ind"), F.lit("InNonEmptyWorld").alias("cls"))


@query("SELECT 'c' || c_custkey AS ind, 'ThirdOrSeventh' AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7')")
def nominal_oneof(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = KB(spark, sf_dir)
    members = kb.table("nation").where(F.col("n_name").isin("NATION_3", "NATION_7")).select(ind("nation", "n_nationkey").alias("dst"))
    return kb.roles("inNation").join(members, "dst", "left_semi").where("src % 8 = 0").select(label("src").alias("ind"), F.lit("ThirdOrSeventh").alias("cls"))


# types, validation, structure, updates

@query("""WITH n AS (SELECT 'n' || n_nationkey AS n FROM nation)
    SELECT n || x AS sub, CASE WHEN y = 'owl:Nothing' THEN y ELSE n || y END AS sup FROM n, (VALUES ('A', 'D'), ('B', 'D'), ('C', 'D'), ('P', 'S'), ('U', 'owl:Nothing')) t(x, y)""")
def alc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation a disjunction (A <= B or C, both under D), an existential met by a universal (P), and a clash (U)."""
    keys = KB(spark, sf_dir).table("nation").select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("n"))
    name = lambda x: F.concat("n", F.lit(x))
    names = lambda *xs: F.array(*map(name, xs)) if xs else F.array().cast("array<string>")
    rule = lambda i, body, head: F.struct((10 * F.col("n_nationkey") + i).cast("long").alias("id"), names(*body).alias("body"), names(*head).alias("head"))
    gcis = keys.select(F.explode(F.array(rule(1, "A", "BC"), rule(2, "B", "D"), rule(3, "C", "D"), rule(4, "QR", ""), rule(6, "P", "S"))).alias("x")).select("x.*")
    link = lambda a, b: F.struct(name(a).alias("a"), F.lit("r").alias("role"), name(b).alias("b"))
    some, every = (keys.select(F.explode(F.array(*x)).alias("x")).select("x.*") for x in ((link("P", "Q"), link("U", "Q")), (link("P", "T"), link("U", "R"))))
    classes = [r[0] for r in keys.select(F.explode(names(*"ABCDPSU")).alias("x")).collect()]
    return types.subsumptions(types.alive_types(gcis, some, every, classes), classes)


@query("SELECT 'Nation' || n_nationkey AS name, 'Class' AS kind FROM nation WHERE n_regionkey > 2 UNION SELECT 'likes' || n_nationkey, 'ObjectProperty' FROM nation WHERE n_nationkey % 2 = 0")
def validate_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations use a class and a role each; some declare none, some declare the role as another kind."""
    n = KB(spark, sf_dir).table("nation")
    named = lambda p, kind, c: F.struct(F.concat(F.lit(p), "n_nationkey").alias("name"), F.lit(kind).alias("kind")) if c is None else F.when(c, named(p, kind, None))
    rows = lambda *of: n.select(F.explode(F.array(*of)).alias("x")).where("x is not null").select("x.*")
    uses = rows(named("Nation", "Class", None), named("likes", "ObjectProperty", None), named("bob", "NamedIndividual", None)).unionByName(_rows(spark, "name string, kind string", ("owl:Thing", "Class")))
    odd = F.col("n_nationkey") % 2 == 1
    return validate.undeclared(uses, rows(named("Nation", "Class", F.col("n_regionkey") <= 2), named("likes", "ObjectProperty", odd), named("likes", "DataProperty", ~odd)))


@query("SELECT 'likes' || n_nationkey AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'Kind' || n_nationkey FROM nation WHERE n_regionkey = 2")
def validate_punning(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = KB(spark, sf_dir).table("nation")
    name = lambda p: F.concat(F.lit(p), "n_nationkey")
    rows = n.select(F.explode(F.array(
        F.struct(name("likes").alias("name"), F.lit("ObjectProperty").alias("kind")), F.struct(name("likes").alias("name"), F.when(F.col("n_regionkey") == 1, "DataProperty").otherwise("NamedIndividual").alias("kind")),
        F.struct(name("Kind").alias("name"), F.lit("Class").alias("kind")), F.struct(name("Kind").alias("name"), F.when(F.col("n_regionkey") == 2, "Datatype").otherwise("NamedIndividual").alias("kind")))).alias("x"))
    return validate.punned(rows.select("x.*"))


@query("""SELECT 'n' || least(a, b) AS a, 'n' || greatest(a, b) AS b, 'cycle' AS why FROM (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation)
    UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey, 'loop' FROM customer WHERE c_acctbal < -900""")
def validate_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a ring, customers hanging on them as leaves, some customers tied to themselves."""
    kb = KB(spark, sf_dir)
    n = kb.table("nation").select("n_nationkey")
    ring = n.select(ind("nation", "n_nationkey").alias("a"), (((F.col("n_nationkey") + 1) % 25).cast("long") * 8 + 4).alias("b"))
    leaves = kb.roles("inNation").where("src % 8 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    own = kb.table("customer").where("c_acctbal < -900").select(ind("customer", "c_custkey").alias("a"), ind("customer", "c_custkey").alias("b"))
    return validate.not_a_forest(ring.unionByName(leaves).unionByName(own)).select(label("a").alias("a"), label("b").alias("b"), "why")


@query("SELECT 'p' || n_nationkey AS prefix, 'declared twice' AS why FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'owl', 'standard prefix rebound'")
def validate_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = KB(spark, sf_dir).table("nation")
    mine = n.select(F.concat(F.lit("p"), "n_nationkey").alias("prefix"), F.explode(F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("http://a/"), F.lit("http://b/"))).otherwise(F.array(F.lit("http://a/")))).alias("iri"))
    return validate.duplicate_prefixes(mine.unionByName(_rows(spark, "prefix string, iri string", ("owl", "http://else/"), ("xsd", validate.STANDARD["xsd"]))))


@query("SELECT 'T' || n_nationkey AS name, 'cyclic' AS why FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'U' || n_nationkey, 'defined twice' FROM nation WHERE n_regionkey = 1")
def validate_datatypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datatypes of nations of region 0 use each other in a ring, those of region 1 have two definitions."""
    n = KB(spark, sf_dir).table("nation")
    ring = n.where("n_regionkey = 0").select("n_nationkey")
    low = ring.agg(F.min("n_nationkey").alias("low"))
    following = ring.alias("x").join(ring.alias("y"), F.col("x.n_nationkey") < F.col("y.n_nationkey"), "left").groupBy(F.col("x.n_nationkey").alias("k")).agg(F.min("y.n_nationkey").alias("k2"))
    uses = following.join(low).select(F.concat(F.lit("T"), "k").alias("name"), F.concat(F.lit("T"), F.coalesce("k2", "low")).alias("uses"), F.lit("d").alias("definition"))
    twice = n.where("n_regionkey > 0").select(F.concat(F.lit("U"), "n_nationkey").alias("name"), F.explode(F.when(F.col("n_regionkey") == 1, F.array(F.lit("xsd:int"), F.lit("xsd:byte"))).otherwise(F.array(F.lit("xsd:int")))).alias("uses"))
    return validate.cyclic_datatypes(uses.unionByName(twice.select("name", "uses", F.col("uses").alias("definition"))))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ontology, value): one document a region, in functional syntax, of its nations and their customers."""
    t = KB(spark, sf_dir).table
    n = t("nation").select("n_nationkey", "n_regionkey")
    wide = F.when(F.col("n_regionkey") == 1, "SubClassOf(:N%1$d ObjectUnionOf(:East :West)) ").when(F.col("n_regionkey") == 2, "InverseObjectProperties(:in%1$d :has%1$d) ").otherwise("")
    nation = F.format_string("Declaration(Class(:N%1$d)) SubClassOf(:N%1$d ObjectSomeValuesFrom(:in :R%2$d)) ", "n_nationkey", "n_regionkey")
    nation = F.concat(nation, F.when(wide == "", "").otherwise(F.regexp_replace(wide, r"%1\$d", F.col("n_nationkey").cast("string"))))
    customer = F.format_string("SubClassOf(:C%d ObjectIntersectionOf(:S%s ObjectSomeValuesFrom(:in :N%d))) ", "c_custkey", "c_mktsegment", "c_nationkey")
    customers = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", customer.alias("line"))
    heads = t("region").select(F.col("r_regionkey").alias("n_regionkey"), F.format_string(
        "TransitiveObjectProperty(:in) EquivalentClasses(:Builder%1$d ObjectIntersectionOf(:SBUILDING ObjectSomeValuesFrom(:in :R%1$d))) DisjointClasses(:SBUILDING :SMACHINERY :SHOUSEHOLD) ", "r_regionkey").alias("line"))
    lines = n.select("n_regionkey", nation.alias("line")).unionByName(customers).unionByName(heads)
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return lines.groupBy("n_regionkey").agg(body.alias("body")).select(F.format_string("region %d", "n_regionkey").alias("ontology"), F.concat(F.lit("Prefix(:=<http://e/>) # one region\nOntology(<http://e/o>\n"), "body", F.lit(")")).alias("value"))


@query("""WITH r AS (SELECT 'region ' || r_regionkey AS ontology, r_regionkey AS k FROM region), n AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1),
    c AS (SELECT n_regionkey AS k, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), x AS (SELECT * FROM r JOIN n USING (k) LEFT JOIN c USING (k))
    SELECT ontology, 'Prefix' AS head, CAST(1 AS BIGINT) AS n FROM r UNION ALL SELECT ontology, h, 1 FROM r, (VALUES ('TransitiveObjectProperty'), ('EquivalentClasses'), ('DisjointClasses')) t(h)
    UNION ALL SELECT ontology, 'Declaration', n FROM x UNION ALL SELECT ontology, 'SubClassOf', CAST(n + coalesce(c, 0) + CASE WHEN k = 1 THEN n ELSE 0 END AS BIGINT) FROM x
    UNION ALL SELECT ontology, 'InverseObjectProperties', n FROM x WHERE k = 2""")
def construct_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.census(ofn.parse_rows(_texts(spark, sf_dir)))


@query("SELECT 'region ' || r_regionkey AS ontology, CASE r_regionkey WHEN 1 THEN 'alc' WHEN 2 THEN 'deferred' ELSE 'el' END AS route FROM region")
def feature_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.route(features.vector(ofn.parse_rows(_texts(spark, sf_dir))))


@query("""WITH c AS (SELECT 'C' || c_custkey AS sub, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3)
    SELECT 'CONSISTENT 1' AS value UNION ALL SELECT concat('SUB', chr(9), ':', sub, chr(9), ':S', seg) FROM c UNION ALL SELECT concat('SUB', chr(9), ':', sub, chr(9), ':Builder3') FROM c WHERE seg = 'BUILDING'
    UNION ALL SELECT concat('SUB', chr(9), ':Builder3', chr(9), ':SBUILDING')""")
def ofn_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text ontology through the parser, the structural transformation, EL completion and the line sink."""
    return classify.lines(ofn.parse_rows(_texts(spark, sf_dir).where("ontology = 'region 3'")))


@query("""SELECT concat('SUB', chr(9), ':Only', n_nationkey, chr(9), ':Some', n_nationkey) AS value FROM nation WHERE n_regionkey = 1 UNION ALL SELECT concat('SUB', chr(9), ':N', n_nationkey, chr(9), ':Side') FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT concat('SUB', chr(9), x, chr(9), ':Side') FROM (VALUES (':East'), (':West')) t(x) UNION ALL SELECT concat('UNSAT', chr(9), ':Both', n_nationkey) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'CONSISTENT 1'""")
def alc_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with unions, universals on both sides and complements, through type elimination."""
    n = KB(spark, sf_dir).table("nation").where("n_regionkey = 1")
    line = F.format_string(
        "SubClassOf(:N%1$d ObjectUnionOf(:East :West)) SubClassOf(:Only%1$d ObjectAllValuesFrom(:r%1$d :East)) EquivalentClasses(:Some%1$d ObjectAllValuesFrom(:r%1$d ObjectUnionOf(:East :West))) "
        "SubClassOf(:Both%1$d ObjectIntersectionOf(ObjectSomeValuesFrom(:r%1$d :N%1$d) ObjectAllValuesFrom(:r%1$d ObjectComplementOf(:Side))))", "n_nationkey")  # fmt: skip
    text = n.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    text = text.select(F.lit("alc").alias("ontology"), F.concat(F.lit("Ontology(<http://e/o> SubClassOf(:East :Side) SubClassOf(:West :Side)\n"), "body", F.lit(")")).alias("value"))
    return classify.lines(ofn.parse_rows(text))


@query("""WITH r(role, src, dst) AS (SELECT 'placedBy', 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'hasPart', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
    o AS (SELECT role, src, count(*) AS n FROM r GROUP BY 1, 2) SELECT r.role, count(*) AS n_facts, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, (SELECT max(n) FROM o WHERE o.role = r.role) AS max_out FROM r GROUP BY r.role""")
def role_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.role_census(KB(spark, sf_dir).roles("placedBy", "hasPart"))


@query(f"WITH RECURSIVE {TBOX.split(',\nclosed')[0]}, e AS (SELECT * FROM told UNION SELECT 'Thing_', 'Root' UNION SELECT 'Region_ASIA', 'Far'), closed(sub, sup) AS (SELECT sub, sup FROM e UNION SELECT c.sub, e.sup FROM closed c JOIN e ON c.sup = e.sub) SELECT sub, sup FROM closed")
def incremental_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = written(closure(KB(spark, sf_dir).tbox(), "sub", "sup"))
    return incremental.add_edges(closed, _rows(spark, "sub string, sup string", ("Thing_", "Root"), ("Region_ASIA", "Far")))


@query(f"""WITH RECURSIVE {TBOX}, e AS (SELECT * FROM told WHERE NOT (sub = 'Product' AND sup = 'Thing_')), c2(sub, sup) AS (SELECT sub, sup FROM e UNION SELECT c.sub, e.sup FROM c2 c JOIN e ON c.sup = e.sub)
    SELECT '-' AS op, sub, sup FROM (SELECT sub, sup FROM closed EXCEPT SELECT sub, sup FROM c2)""")
def incremental_row_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = written(KB(spark, sf_dir).tbox().distinct())
    before = written(closure(told, "sub", "sup"))
    after = written(incremental.remove_edges(told, before, _rows(spark, "sub string, sup string", ("Product", "Thing_"))))
    return incremental.changed(before, after)


@query("""WITH RECURSIVE e(a, b) AS (SELECT DISTINCT c_custkey, 1000000000 + c_nationkey * 1000 + CAST(floor(c_acctbal / 100) AS BIGINT) FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(a, min(b)) AS rep FROM r GROUP BY a""")
def equality_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers tied through what they share: a nation and a band of their balance."""
    rows = KB(spark, sf_dir).table("customer").select(F.col("c_custkey").cast("long").alias("a"), (1_000_000_000 + F.col("c_nationkey") * 1000 + F.floor(F.col("c_acctbal") / 100)).cast("long").alias("b"))
    return components(rows)


@query(f"WITH RECURSIVE {TBOX} SELECT concat('SUB', chr(9), sub, chr(9), sup) AS value FROM closed")
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.lines(closure(KB(spark, sf_dir).tbox(), "sub", "sup"))


# clashes and the answer they add up to

def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, src, dst): nations of customers and of the suppliers of their orders."""
    kb = KB(spark, sf_dir)
    home = kb.roles("inNation").select("src", F.col("dst").alias("nation"))
    buyer = kb.roles("placedBy").select(F.col("src").alias("order"), F.col("dst").alias("src")).join(home, "src").select("order", F.col("nation").alias("src"))
    seller = kb.roles("suppliedBy").select(F.col("src").alias("order"), F.col("dst").alias("s")).join(home.withColumnRenamed("src", "s"), "s").select("order", F.col("nation").alias("dst"))
    return buyer.join(seller, "order").select(F.lit("buysFrom").alias("role"), "src", "dst").distinct()


_TRADES = "trades(src, dst) AS (SELECT DISTINCT c_nationkey, s_nationkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {_TRADES} SELECT 'buysFrom' AS role, 'n' || src AS src FROM trades WHERE src = dst")
def clash_irreflexive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clashes.irreflexive(_trades(spark, sf_dir), _rows(spark, "role string", ("buysFrom",))).select("role", label("src").alias("src"))


@query(f"WITH {_TRADES} SELECT 'buysFrom' AS role, 'n' || a.src AS src, 'n' || a.dst AS dst FROM trades a JOIN trades b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
def clash_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clashes.asymmetric(_trades(spark, sf_dir), _rows(spark, "role string", ("buysFrom",))).select("role", label("src").alias("src"), label("dst").alias("dst"))


@query("""SELECT 'openFor' AS a, 'urgentFor' AS b, 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def clash_disjoint_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = KB(spark, sf_dir).table("orders")
    ends = (ind("orders", "o_orderkey").alias("src"), ind("customer", "o_custkey").alias("dst"))
    facts = t.where("o_orderstatus = 'O'").select(F.lit("openFor").alias("role"), *ends).unionByName(t.where("o_orderpriority = '1-URGENT'").select(F.lit("urgentFor").alias("role"), *ends))
    return clashes.disjoint_roles(facts, _rows(spark, "a string, b string", ("openFor", "urgentFor"))).select("a", "b", label("src").alias("src"), label("dst").alias("dst"))


@query(f"WITH {_TRADES} SELECT 'n' || src AS ind, 'HomeTrader' AS cls FROM trades WHERE src = dst")
def has_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clashes.self_members(_trades(spark, sf_dir), _rows(spark, "role string, cls string", ("buysFrom", "HomeTrader"))).select(label("ind").alias("ind"), "cls")


@query("""SELECT 'suppliedBy' AS role, 'o' || l_orderkey AS src, max(n) AS n FROM (SELECT l_orderkey, s_nationkey, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE n > 1 GROUP BY l_orderkey""")
def clash_too_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one supplier an order, where the suppliers of one nation are all different."""
    kb = KB(spark, sf_dir)
    groups = kb.table("supplier").select(F.col("s_nationkey").alias("grp"), ind("supplier", "s_suppkey").alias("ind"))
    return clashes.too_many(kb.roles("suppliedBy"), _rows(spark, "role string, most int", ("suppliedBy", 1)), groups).select("role", label("src").alias("src"), "n")


@query(f"""WITH {_TRADES}, x(why, n) AS (SELECT 'irreflexive', count(*) FROM trades WHERE src = dst UNION ALL SELECT 'disjoint', count(*) FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)
    UNION ALL SELECT 'negative', 0) SELECT why, n FROM x UNION ALL SELECT 'consistent', CAST(sum(n) = 0 AS BIGINT) FROM x""")
def consistency_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check's offenders, and the one answer: 1 if there are none."""
    nothing = abox.negative_clash(KB(spark, sf_dir).roles("inRegion"), _rows(spark, "role string, src long, dst long", ("inRegion", 0, 0)))
    checks = written(clashes.consistency({"irreflexive": clash_irreflexive(spark, sf_dir), "disjoint": abox_clash_disjoint(spark, sf_dir), "negative": nothing}))
    return checks.unionByName(clashes.consistent(checks).select(F.lit("consistent").alias("why"), F.col("consistent").cast("long").alias("n")))


@query("""SELECT 'p' || p_partkey AS ind, p_retailprice >= 950.5 AS dear, p_size < 20 AS small, length(p_name) <= 12 AS brief, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AS low_brand FROM part""")
def data_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, lengths and patterns of literals."""
    text = lambda c: F.col(c).cast("string")
    return KB(spark, sf_dir).table("part").select(
        F.concat(F.lit("p"), "p_partkey").alias("ind"), facets.meets(text("p_retailprice"), "xsd:double", "xsd:minInclusive", "950.5").alias("dear"), facets.meets(text("p_size"), "xsd:integer", "xsd:maxExclusive", "20").alias("small"),
        facets.meets(F.col("p_name"), "xsd:string", "xsd:maxLength", "12").alias("brief"), facets.meets(F.col("p_brand"), "xsd:string", "xsd:pattern", "Brand#[1-3][0-9]").alias("low_brand"),
    )


@query("""SELECT DISTINCT 'c' || o_custkey AS ind, 'Discounted' AS cls FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE floor(l_quantity * 2) + 1 > 90""")
def rule_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule with arithmetic built-ins: the quantity doubled and one added is over ninety."""
    kb = KB(spark, sf_dir)
    placed = kb.roles("placedBy").select(F.col("role").alias("pred"), F.col("src").alias("s"), F.col("dst").alias("o"))
    amount = kb.table("lineitem").select(F.lit("quantity").alias("pred"), ind("orders", "l_orderkey").alias("s"), F.floor(F.col("l_quantity") * 2).alias("o"))
    a = rules.Atom
    rule = rules.Rule((a("placedBy", "?x", "?c"), a("quantity", "?x", "?q")), a("Discounted", "?c"), builtins.data_range("?q", low=0) + " and q + 1 > 90")
    return rules.bindings(rule, [placed, amount]).select(label("c").alias("ind"), F.lit("Discounted").alias("cls")).distinct()


@query(f"{_EL} SELECT sub, sup FROM subs WHERE sub NOT IN (SELECT cls FROM bad) UNION SELECT cls, 'owl:Nothing' FROM bad")
def incremental_el(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion that goes on from the facts of the role and class hierarchy when the existentials arrive."""
    full = el_axioms(spark, sf_dir)
    first = el.ELAxioms(spark, nf1=full.nf1, nf6=full.nf6)
    symbols = full.symbols()
    return el.readout(el.complete(full, symbols, known=written(el.complete(first))), symbols)
