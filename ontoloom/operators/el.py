"""EL completion: the least fixpoint of the seven normal-form rules, bottom and reflexive roles.

Facts are one table (c, r, d) of 64-bit symbol hashes: r = 0 says that c is under d, another r that c has an
r-edge to d. Each round joins the round's new facts with the axiom tables (measured, and
broadcast where small) and with the known facts, hash-partitioned by the node that links two premises.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import closure, fixpoint, small, written

TOP, BOTTOM = "owl:Thing", "owl:Nothing"


def key(name: Column) -> Column:
    return F.xxhash64(name)


def _empty(spark: SparkSession, columns: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns.split()))


@dataclass
class ELAxioms:
    """Normal forms by name. nf1 A<=B, nf2 A&B<=C, nf3 A<=some r.B, nf4 some r.A<=B, nf5 A<=bottom, nf6 r<=s, nf7 r o s<=t."""

    spark: SparkSession
    nf1: DataFrame | None = None  # sub sup
    nf2: DataFrame | None = None  # left right sup
    nf3: DataFrame | None = None  # sub role filler
    nf4: DataFrame | None = None  # role filler sup
    nf5: DataFrame | None = None  # sub
    nf6: DataFrame | None = None  # sub sup
    nf7: DataFrame | None = None  # first second sup
    reflexive: DataFrame | None = None  # role
    extra: list[str] = field(default_factory=list)  # declared classes
    extra_names: DataFrame | None = None  # declared classes (name), when they come as a table

    shapes = {"nf1": "sub sup", "nf2": "left right sup", "nf3": "sub role filler", "nf4": "role filler sup", "nf5": "sub", "nf6": "sub sup", "nf7": "first second sup", "reflexive": "role"}
    roles = {"nf3": {"role"}, "nf4": {"role"}, "nf6": {"sub", "sup"}, "nf7": {"first", "second", "sup"}, "reflexive": {"role"}}

    def table(self, name: str) -> DataFrame:
        df = getattr(self, name)
        return _empty(self.spark, self.shapes[name]) if df is None else df.select(*self.shapes[name].split())

    def keyed(self, name: str) -> DataFrame:
        df = self.table(name)
        return df.select(*(key(F.col(c)).alias(c) for c in df.columns)).distinct()

    def tables(self) -> dict[str, DataFrame]:
        """The tables that have rows, by hashes. All are written by one job, each to a folder of its own."""
        rows = None
        for n, shape in self.shapes.items():
            if getattr(self, n) is not None:
                df = self.keyed(n)
                df = df.select(F.lit(n).alias("form"), *(F.col(c).alias(x) for c, x in zip(df.columns, "xyz")), *(F.lit(None).cast("long").alias(x) for x in "xyz"[len(df.columns) :]))
                rows = df if rows is None else rows.unionByName(df)
        if rows is None:
            return {}
        kept = written(rows, "form")
        some = {r.form for r in kept.select("form").distinct().collect()}  # eight at most
        return {n: kept.where(F.col("form") == n).select(*(F.col(x).alias(c) for x, c in zip("xyz", shape.split()))) for n, shape in self.shapes.items() if n in some}

    def symbols(self) -> DataFrame:
        """(id, name) of every class. Two names with one hash stop the run: identity is the whole name."""
        out = self.spark.createDataFrame([(x,) for x in [TOP, BOTTOM, *self.extra]], "name string")
        for name, shape in self.shapes.items():
            for c in shape.split():
                if c not in self.roles.get(name, ()) and getattr(self, name) is not None:
                    out = out.unionByName(self.table(name).select(F.col(c).alias("name")))
        if self.extra_names is not None:
            out = out.unionByName(self.extra_names.select("name"))
        out = written(out.distinct().select(key(F.col("name")).alias("id"), "name"))
        if not out.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("two symbols share a hash")
        return out


def _plain(facts: DataFrame, top: int) -> DataFrame:
    """Facts but those that hold of every class: that it is under itself and under top."""
    return facts.where(~((F.col("r") == 0) & ((F.col("c") == F.col("d")) | (F.col("d") == top))))


def complete(axioms: ELAxioms, symbols: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """All facts (c, r, d). Facts `known` of a smaller set of axioms are kept: the run goes on from them, and after its first
    round only what the added axioms bring is joined.

    That a class is under itself and under top holds of every class and takes part only where a left-hand side names it, so such facts are
    added at the end. Told subsumptions and edges are facts from the start; what is left of their axioms for the rounds are those of classes
    that a rule can derive, which are few where most classes lie at the bottom. A round's rule runs only if the new facts have a premise for it."""
    spark = axioms.spark
    symbols = axioms.symbols() if symbols is None else symbols
    top, bottom = (spark.range(1).select(key(F.lit(x))).first()[0] for x in (TOP, BOTTOM))
    t = axioms.tables()
    zero = F.lit(0).cast("long")
    under = lambda df, c, d: df.select(F.col(c).alias("c"), zero.alias("r"), F.col(d).alias("d"))
    to = lambda df, c, r, d: df.select(F.col(c).alias("c"), F.col(r).alias("r"), F.col(d).alias("d"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    least = lambda df, n: df.withColumn("d", F.lit(n)).select(F.col(df.columns[0]).alias("c"), zero.alias("r"), "d")
    ids = symbols.select(F.col("id").alias("c"))
    one = lambda n: spark.range(1).select(F.lit(n).alias("c"))

    # told facts, as they stand; the fact that a class is under itself, for the classes that a conjunction or an existential asks for
    seed = [least(one(top), top)]
    if "nf1" in t:
        seed.append(under(t["nf1"], "sub", "sup"))
    if "nf3" in t:
        seed.append(to(t["nf3"], "sub", "role", "filler"))
    if "nf5" in t:
        seed.append(least(t["nf5"], bottom))
    asked = [t[n].select(F.col(c).alias("x")) for n, c in (("nf2", "left"), ("nf2", "right"), ("nf4", "filler")) if n in t]
    seed += [a.select(F.col("x").alias("c"), zero.alias("r"), F.col("x").alias("d")) for a in asked]
    left = asked + [t[n].select(F.col("sub").alias("x")) for n in ("nf1", "nf3", "nf5") if n in t]
    if left and not union(left).where(F.col("x") == top).isEmpty():
        seed.append(least(ids, top))
    if "reflexive" in t:
        seed.append(ids.crossJoin(F.broadcast(t["reflexive"])).select("c", F.col("role").alias("r"), F.col("c").alias("d")))
    if known is not None:
        seed.append(_plain(known.select("c", "r", "d"), top))

    # what a class can be found under: axioms of other classes have done their part
    sups = [t[n].select(F.col("sup").alias("sub")) for n in ("nf1", "nf2", "nf4") if n in t] + [one(n).select(F.col("c").alias("sub")) for n in (top, bottom)]
    if known is not None:
        sups.append(known.where("r = 0 and c <> d").select(F.col("d").alias("sub")))
    sups = small(union(sups).distinct())
    for n in {"nf1", "nf3", "nf5"} & t.keys():
        t[n] = t[n].join(sups, "sub", "left_semi").distinct()
    for n in {"nf1", "nf6"} & t.keys():  # closed by doubling, so a long chain costs no round a link
        t[n] = closure(t[n], "sub", "sup")
    t = {n: small(df) for n, df in t.items() if n != "reflexive"}
    premises = [("nf1", "sub", 0), ("nf2", "left", 0), ("nf2", "right", 0), ("nf3", "sub", 0), ("nf5", "sub", 0), ("nf4", "filler", 0), ("nf4", "role", 1), ("nf6", "sub", 1), ("nf7", "first", 1), ("nf7", "second", 1)]
    marks = [t[n].select(F.lit(f"{n} {c}").alias("form"), F.lit(e).alias("e"), F.col(c).alias("x")) for n, c, e in premises if n in t]
    marks = small(union([*marks, one(bottom).select(F.lit("lost").alias("form"), F.lit(0).alias("e"), F.col("c").alias("x"))]).distinct())
    asks = {c: small(t[n].select(c).distinct()) for n, c in (("nf2", "left"), ("nf2", "right"), ("nf4", "filler"), ("nf4", "role"), ("nf7", "second")) if n in t}
    lost_before = False

    def sub(facts: DataFrame, a: str, b: str) -> DataFrame:
        return facts.where("r = 0").select(F.col("c").alias(a), F.col("d").alias(b))

    def edge(facts: DataFrame, a: str, r: str, b: str) -> DataFrame:
        return facts.where("r <> 0").select(F.col("c").alias(a), F.col("r").alias(r), F.col("d").alias(b))

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        nonlocal lost_before
        by = F.when(F.col("r") == 0, F.col("d")).otherwise(F.col("r")).alias("x")
        rows = delta.groupBy((F.col("r") != 0).cast("int").alias("e"), by).agg(F.count(F.lit(1)).alias("n")).join(marks, ["e", "x"])
        new = {r.form: r.n for r in rows.groupBy("form").agg(F.sum("n").alias("n")).collect()}  # eleven at most
        few = lambda df, n: F.broadcast(df) if n <= 100_000 else df
        out = []
        if "nf1 sub" in new:
            out.append(under(sub(delta, "c", "x").join(t["nf1"].select(F.col("sub").alias("x"), "sup"), "x"), "c", "sup"))
        if "nf5 sub" in new:
            out.append(least(sub(delta, "c", "x").join(t["nf5"].select(F.col("sub").alias("x")), "x").select("c"), bottom))
        for a, b in (("left", "right"), ("right", "left")):
            if f"nf2 {a}" in new:
                half = sub(delta, "c", a).join(t["nf2"], a)
                other = sub(known, "c", b).join(asks[b], b, "left_semi")
                out.append(under(few(half, new[f"nf2 {a}"]).join(other, ["c", b]), "c", "sup"))
        if "nf3 sub" in new:
            out.append(to(sub(delta, "c", "x").join(t["nf3"].select(F.col("sub").alias("x"), "role", "filler"), "x"), "c", "role", "filler"))
        if "nf6 sub" in new:
            out.append(to(edge(delta, "c", "role", "d").join(t["nf6"].select(F.col("sub").alias("role"), "sup"), "role"), "c", "sup", "d"))
        # only fillers and roles that some axiom asks for meet
        if "nf4 role" in new:
            fillers = sub(known, "m", "filler").join(asks["filler"], "filler", "left_semi")
            out.append(under(edge(delta, "c", "role", "m").join(t["nf4"], "role").join(fillers, ["m", "filler"]), "c", "sup"))
        if "nf4 filler" in new:
            links = edge(known, "c", "role", "m").join(asks["role"], "role", "left_semi")
            out.append(under(few(sub(delta, "m", "filler").join(t["nf4"], "filler"), new["nf4 filler"]).join(links, ["m", "role"]), "c", "sup"))
        if "nf7 first" in new:
            onward = edge(known, "m", "second", "d").join(asks["second"], "second", "left_semi")
            out.append(to(few(edge(delta, "c", "first", "m").join(t["nf7"], "first"), new["nf7 first"]).join(onward, ["m", "second"]), "c", "sup", "d"))
        if "nf7 second" in new:
            start = edge(known, "c", "first", "m").join(t["nf7"], "first")
            out.append(to(start.join(few(edge(delta, "m", "second", "d").join(asks["second"], "second", "left_semi"), new["nf7 second"]), ["m", "second"]), "c", "sup", "d"))
        # bottom comes back along every edge, whichever rule gave it
        lost = lambda facts: facts.where((F.col("r") == 0) & (F.col("d") == bottom)).select(F.col("c").alias("m"))
        out.append(least(edge(delta, "c", "role", "m").where(F.col("m") == bottom).select("c"), bottom))
        if "lost" in new:
            out.append(least(edge(known, "c", "role", "m").join(few(lost(delta), new["lost"]), "m").select("c"), bottom))
        if lost_before:
            out.append(least(edge(delta, "c", "role", "m").join(lost(known), "m").select("c"), bottom))
        lost_before = lost_before or "lost" in new
        return union(out)

    found = _plain(fixpoint(union(seed), step), top)
    own = ids.select("c", zero.alias("r"), F.col("c").alias("d"))
    return found.unionByName(own).unionByName(least(ids.where(F.col("c") != top), top))


def consistent(facts: DataFrame) -> bool:
    """Whether everything is not under nothing."""
    top, bottom = facts.sparkSession.range(1).select(key(F.lit(TOP)), key(F.lit(BOTTOM))).first()
    return facts.where((F.col("c") == top) & (F.col("r") == 0) & (F.col("d") == bottom)).isEmpty()


def readout(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sub, sup) of named classes without reflexive pairs and top; an unsatisfiable class is under owl:Nothing only."""
    rows = facts.where("r = 0 and c <> d").where(F.col("d") != key(F.lit(TOP))).select("c", "d")
    named = rows.join(symbols.select(F.col("id").alias("c"), F.col("name").alias("sub")), "c").join(symbols.select(F.col("id").alias("d"), F.col("name").alias("sup")), "d")
    named = named.where(~F.col("sub").isin(TOP, BOTTOM) & (F.col("sup") != TOP)).select("sub", "sup")
    lost = named.where(F.col("sup") == BOTTOM).select("sub")
    return named.join(lost, "sub", "left_anti").unionByName(lost.withColumn("sup", F.lit(BOTTOM)))


def edges(facts: DataFrame, symbols: DataFrame, roles: list[str]) -> DataFrame:
    """(src, role, dst) by name; the roles asked for are few."""
    names = facts.sparkSession.createDataFrame([(r,) for r in roles], "role string").select(key(F.col("role")).alias("r"), "role")
    rows = facts.where("r <> 0").join(F.broadcast(names), "r")
    return rows.join(symbols.select(F.col("id").alias("c"), F.col("name").alias("src")), "c").join(symbols.select(F.col("id").alias("d"), F.col("name").alias("dst")), "d").select("src", "role", "dst")


def is_el(clauses: DataFrame) -> DataFrame:
    """One row: whether every clause (head array) has one head at most and none with an equality or an individual."""
    bad = (F.size("head") > 1) | F.exists("head", lambda a: a["kind"] == "eq") | F.exists("head", lambda a: F.coalesce(a["t1"]["kind"], F.lit("")) == "ind")
    return clauses.agg((F.count(F.when(bad, 1)) == 0).alias("is_el"), F.count(F.when(bad, 1)).alias("n_outside"))
