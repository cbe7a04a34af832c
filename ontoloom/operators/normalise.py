"""Structural transformation: nested class expressions to the flat tables of EL completion and of type elimination.

A subexpression becomes a class named by its own text, so equal subexpressions share one name wherever they occur. On the
left of an inclusion the name lies above the expression, on the right below it; only the direction that the place
needs is stated. Axioms are dealt over tasks; each is transformed by itself, as a whole or not at all, and says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Deferred, closure, written

TOP, BOTTOM = "owl:Thing", "owl:Nothing"
OWL = "http://www.w3.org/2002/07/owl#"
_TOKEN = re.compile(r'<[^>\s]*>|"(?:[^"\\]|\\.)*"\S*|[()]|[^\s()"]+')
# fixed values: heads that say nothing about classes
SILENT = {"Prefix", "Declaration", "AnnotationAssertion", "AnnotationPropertyDomain", "AnnotationPropertyRange", "SubAnnotationPropertyOf", "Annotation"}

Node = str | tuple  # a name, or (constructor, *arguments)


class Outside(Exception):
    """The axiom is not expressible in the target language."""


def tree(text: str, prefixes: dict[str, str]) -> Node:
    """Nested tuples of an expression; the vocabulary's own names lose their spelling."""
    stack: list[list] = [[]]
    for tok in _TOKEN.findall(text):
        if tok == "(":
            stack.append([stack[-1].pop()])
        elif tok == ")":
            done = tuple(stack.pop())
            stack[-1].append(done)
        else:
            stack[-1].append(named(tok, prefixes))
    if len(stack) != 1 or len(stack[0]) != 1:
        raise Outside(text)
    return stack[0][0]


def named(name: str, prefixes: dict[str, str]) -> str:
    """owl:x for any spelling of the vocabulary's names; other names as they are."""
    if name.startswith("<"):
        return f"owl:{name[1:-1].removeprefix(OWL)}" if name.startswith(f"<{OWL}") else name
    prefix, colon, local = name.partition(":")
    return f"owl:{local}" if colon and prefixes.get(f"{prefix}:") == f"<{OWL}>" else name


def shown(e: Node) -> str:
    return e if isinstance(e, str) else f"{e[0]}({' '.join(map(shown, e[1:]))})"


def simpler(e: Node) -> Node:
    """Rewrites constructors that others express; intersections and unions lose repeats, trivial members and order."""
    if isinstance(e, str):
        return e
    kind, *args = e
    if kind in ("ObjectIntersectionOf", "ObjectUnionOf"):
        unit, zero = (TOP, BOTTOM) if kind == "ObjectIntersectionOf" else (BOTTOM, TOP)
        parts = {shown(x): x for a in map(simpler, args) for x in (a[1:] if not isinstance(a, str) and a[0] == kind else [a]) if x != unit}
        if zero in parts:
            return zero
        return unit if not parts else next(iter(parts.values())) if len(parts) == 1 else (kind, *(parts[k] for k in sorted(parts)))
    if kind == "ObjectComplementOf":
        inner = simpler(args[0])
        swapped = {TOP: BOTTOM, BOTTOM: TOP}.get(inner) if isinstance(inner, str) else inner[1] if inner[0] == kind else None
        return swapped or (kind, inner)
    if kind in ("ObjectMinCardinality", "ObjectMaxCardinality", "ObjectExactCardinality"):
        n, role, filler = int(args[0]), args[1], simpler(args[2]) if len(args) > 2 else TOP
        if kind == "ObjectExactCardinality":
            low, high = simpler(("ObjectMinCardinality", args[0], role, filler)), simpler(("ObjectMaxCardinality", args[0], role, filler))
            return simpler(("ObjectIntersectionOf", low, high))
        if kind == "ObjectMinCardinality" and n <= 1:
            return simpler(("ObjectSomeValuesFrom", role, filler)) if n else TOP
        if kind == "ObjectMaxCardinality" and n == 0:
            return simpler(("ObjectAllValuesFrom", role, simpler(("ObjectComplementOf", filler))))
        return (kind, args[0], role, filler)
    if kind in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
        role, filler = args[0], simpler(args[1])
        some = kind == "ObjectSomeValuesFrom"
        if filler == (BOTTOM if some else TOP) or role == "owl:bottomObjectProperty":
            return BOTTOM if some else TOP
        return (kind, role, filler)
    return (kind, *map(simpler, args))


def inclusions(head: str, args: list[Node]) -> list[tuple[Node, Node]] | None:
    """The axiom as inclusions between class expressions; None if it is about something else."""
    if head == "SubClassOf":
        return [(args[0], args[1])]
    if head == "EquivalentClasses":
        return [(a, b) for a, b in zip(args, [*args[1:], args[0]]) if a != b]
    if head == "DisjointClasses":
        return [(("ObjectIntersectionOf", a, b), BOTTOM) for i, a in enumerate(args) for b in args[i + 1 :]]
    if head == "DisjointUnion":
        name, *parts = args
        return [(name, ("ObjectUnionOf", *parts)), *((p, name) for p in parts), *inclusions("DisjointClasses", parts)]
    if head == "ObjectPropertyDomain":
        return [(("ObjectSomeValuesFrom", args[0], TOP), args[1])]
    return None


class ToEL:
    """Rows (form, a, b, c) of the normal forms nf1 to nf7, reflexive and range."""

    def __init__(self):
        self.rows: list[tuple] = []

    def role(self, r: Node) -> str:
        if not isinstance(r, str) or r in ("owl:topObjectProperty", "owl:bottomObjectProperty"):
            raise Outside(shown(r))
        return r

    def under(self, sub: str, sup: str) -> None:
        if sub != BOTTOM and sup != TOP and sub != sup:
            self.rows.append(("nf5", sub, None, None) if sup == BOTTOM else ("nf1", sub, sup, None))

    def left(self, e: Node) -> str:
        """A class above e."""
        if isinstance(e, str):
            return e
        kind, *args = e
        name = f"above {shown(e)}"
        if kind == "ObjectIntersectionOf":
            at = self.left(args[0])
            for k, x in enumerate(args[1:], 2):
                up = name if k == len(args) else f"above {shown((kind, *args[:k]))}"
                self.rows.append(("nf2", at, self.left(x), up))
                at = up
        elif kind == "ObjectUnionOf":
            for x in args:
                self.under(self.left(x), name)
        elif kind == "ObjectSomeValuesFrom":
            self.rows.append(("nf4", self.role(args[0]), self.left(args[1]), name))
        else:
            raise Outside(shown(e))
        return name

    def right(self, name: str, e: Node) -> None:
        """name lies under e."""
        if isinstance(e, str):
            return self.under(name, e)
        kind, *args = e
        if kind == "ObjectIntersectionOf":
            for x in args:
                self.right(name, x)
        elif kind == "ObjectSomeValuesFrom":
            self.rows.append(("nf3", name, self.role(args[0]), self.below(args[1])))
        elif kind == "ObjectComplementOf":
            self.rows.append(("nf2", name, self.left(args[0]), BOTTOM))
        elif kind == "ObjectAllValuesFrom" and (args[1] == BOTTOM or args[1][0] == "ObjectComplementOf"):  # nothing of a kind follows
            filler = TOP if args[1] == BOTTOM else args[1][1]
            self.rows.append(("nf2", name, self.left(("ObjectSomeValuesFrom", args[0], filler)), BOTTOM))
        else:
            raise Outside(shown(e))

    def below(self, e: Node) -> str:
        if isinstance(e, str):
            return e
        name = f"below {shown(e)}"
        self.right(name, e)
        return name

    def axiom(self, head: str, args: list[Node]) -> None:
        pairs = inclusions(head, args)
        if pairs is not None:
            for a, b in pairs:
                a, b = simpler(a), simpler(b)
                if a != BOTTOM and b != TOP:
                    self.right(self.left(a), b)
        elif head == "ObjectPropertyRange":
            self.rows.append(("range", self.role(args[0]), self.below(simpler(args[1])), None))
        elif head == "SubObjectPropertyOf":
            chain = [*map(self.role, args[0][1:])] if not isinstance(args[0], str) and args[0][0] == "ObjectPropertyChain" else [self.role(args[0])]
            sup = args[1] if args[1] == "owl:topObjectProperty" else self.role(args[1])
            if len(chain) == 1:
                self.rows.append(("nf6", chain[0], sup, None))
            for k in range(1, len(chain)):  # a longer chain goes by its beginnings
                first = chain[0] if k == 1 else f"chain {' '.join(chain[:k])}"
                self.rows.append(("nf7", first, chain[k], sup if k == len(chain) - 1 else f"chain {' '.join(chain[: k + 1])}"))
        elif head == "EquivalentObjectProperties":
            for a, b in zip(args, [*args[1:], args[0]]):
                self.rows.append(("nf6", self.role(a), self.role(b), None))
        elif head == "TransitiveObjectProperty":
            self.rows.append(("nf7", *[self.role(args[0])] * 3))
        elif head == "ReflexiveObjectProperty":
            self.rows.append(("reflexive", self.role(args[0]), None, None))
        else:
            raise Outside(head)


class ToALC:
    """Rows: gci (body and head, names split by tabs), some and all (a, role, b), subrole, transitive."""

    def __init__(self):
        self.rows: list[tuple] = []

    role = ToEL.role

    def gci(self, body: list[str], head: list[str]) -> None:
        if TOP not in head and BOTTOM not in body:
            self.rows.append(("gci", "\t".join(sorted({x for x in body if x != TOP})), "\t".join(sorted({x for x in head if x != BOTTOM})), None))

    def left(self, e: Node) -> str:
        if isinstance(e, str):
            return e
        kind, *args = e
        name = f"above {shown(e)}"
        if kind == "ObjectIntersectionOf":
            self.gci([self.left(x) for x in args], [name])
        elif kind == "ObjectUnionOf":
            for x in args:
                self.gci([self.left(x)], [name])
        elif kind == "ObjectComplementOf":
            self.gci([], [name, self.below(args[0])])
        elif kind in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
            # by contraposition: what is not under the name has none (or one) of the filler's complement
            other = f"not {name}"
            self.gci([], [name, other])
            self.gci([name, other], [])
            self.rows.append(("all" if kind == "ObjectSomeValuesFrom" else "some", other, self.role(args[0]), self.below(simpler(("ObjectComplementOf", args[1])))))
        else:
            raise Outside(shown(e))
        return name

    def right(self, name: str, e: Node) -> None:
        if isinstance(e, str):
            return self.gci([name], [e])
        kind, *args = e
        if kind == "ObjectIntersectionOf":
            for x in args:
                self.right(name, x)
        elif kind == "ObjectUnionOf":
            self.gci([name], [self.below(x) for x in args])
        elif kind == "ObjectComplementOf":
            self.gci([name, self.left(args[0])], [])
        elif kind in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
            self.rows.append(("some" if kind == "ObjectSomeValuesFrom" else "all", name, self.role(args[0]), self.below(args[1])))
        else:
            raise Outside(shown(e))

    def below(self, e: Node) -> str:
        if isinstance(e, str):
            return e
        name = f"below {shown(e)}"
        self.right(name, e)
        return name

    def axiom(self, head: str, args: list[Node]) -> None:
        pairs = inclusions(head, args)
        if pairs is not None:
            for a, b in pairs:
                a, b = simpler(a), simpler(b)
                if a != BOTTOM and b != TOP:
                    self.right(self.left(a), b)
        elif head == "ObjectPropertyRange":
            self.rows.append(("all", TOP, self.role(args[0]), self.below(simpler(args[1]))))
        elif head == "SubObjectPropertyOf":
            self.rows.append(("subrole", self.role(args[0]), self.role(args[1]), None))
        elif head == "EquivalentObjectProperties":
            for a, b in zip(args, [*args[1:], args[0]]):
                self.rows.append(("subrole", self.role(a), self.role(b), None))
        elif head == "TransitiveObjectProperty":
            self.rows.append(("transitive", self.role(args[0]), None, None))
        else:
            raise Outside(head)


def transformed(axioms: DataFrame, target: Callable[[], ToEL | ToALC]) -> DataFrame:
    """(ontology, ordinal, form, a, b, c) of every axiom; form is `silent` where nothing is said, `rest` where the target cannot say it."""
    pairs = axioms.where("head = 'Prefix'").select("ontology", F.struct(F.col("args")[0], F.element_at("args", -1)).alias("p"))
    prefixes = pairs.groupBy("ontology").agg(F.map_from_entries(F.array_distinct(F.collect_list("p"))).alias("prefixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ontology, ordinal, head, args, known in zip(pdf.ontology, pdf.ordinal, pdf["head"], pdf["args"], pdf.prefixes):
                rows = [("silent", None, None, None)]
                if head not in SILENT:
                    try:
                        to, names = target(), dict(known) if known is not None else {}
                        to.axiom(head, [tree(a, names) for a in args if not a.startswith("Annotation(")])
                        rows = to.rows or rows
                    except (Outside, ValueError):
                        rows = [("rest", head, None, None)]
                out += [(ontology, ordinal, *r) for r in rows]
            yield pd.DataFrame(out, columns=["ontology", "ordinal", "form", "a", "b", "c"])

    rows = axioms.select("ontology", "ordinal", "head", "args").join(prefixes, "ontology", "left")
    return rows.mapInPandas(run, "ontology string, ordinal long, form string, a string, b string, c string")


#: Columns of each table of the EL normal forms.
SHAPES = {"nf1": "sub sup", "nf2": "left right sup", "nf3": "sub role filler", "nf4": "role filler sup", "nf5": "sub", "nf6": "sub sup", "nf7": "first second sup", "reflexive": "role"}


def el_tables(axioms: DataFrame) -> dict[str, DataFrame]:
    """Tables of the EL normal forms by name, and `rest`: the axioms outside, as they were. Every axiom is either in tables, silent, or in
    rest. Ranges go into the fillers of existentials; those a chain could reach are left in rest."""
    rows = written(transformed(axioms, ToEL))
    out = {n: rows.where(F.col("form") == n).select(*(F.col(x).alias(c) for x, c in zip("abc", shape.split()))).distinct() for n, shape in SHAPES.items()}
    rest = rows.where("form = 'rest'").select("ontology", "ordinal")
    ranges = rows.where("form = 'range'").select("ontology", "ordinal", F.col("a").alias("sup"), F.col("b").alias("cls"))
    if not ranges.isEmpty():
        roles = out["nf3"].select(F.col("role").alias("sub")).unionByName(out["nf7"].select(F.col("sup").alias("sub"))).distinct()
        up = written(closure(out["nf6"], "sub", "sup").unionByName(roles.withColumn("sup", F.col("sub"))).distinct())
        chained = up.join(out["nf7"].where("not (first = sup and second = sup)").select(F.col("sup").alias("sub")), "sub", "left_semi").select("sup")
        reached = ranges.join(chained, "sup", "left_semi")
        rest = rest.unionByName(reached.select("ontology", "ordinal"))
        of = up.join(ranges.join(chained, "sup", "left_anti"), "sup").groupBy(F.col("sub").alias("role")).agg(F.array_sort(F.collect_set("cls")).alias("classes"))
        wide = written(out["nf3"].join(of, "role", "left").withColumn("both", F.when(F.col("classes").isNotNull(), F.concat(F.lit("below "), "filler", F.lit(" in ("), F.array_join("classes", " "), F.lit(")")))))
        narrowed = wide.where("both is not null").select(F.col("both").alias("sub"), F.explode(F.array_append("classes", F.col("filler"))).alias("sup"))
        out["nf1"] = out["nf1"].unionByName(narrowed).distinct()
        out["nf3"] = wide.select("sub", "role", F.coalesce("both", "filler").alias("filler")).distinct()
    out["rest"] = axioms.join(rest.distinct(), ["ontology", "ordinal"], "left_semi")
    return out


def alc_tables(axioms: DataFrame) -> dict[str, DataFrame]:
    """gcis (id, body, head), some and all (a, role, b) for type elimination; role inclusions and transitivity are
    worked into `all`. Raises Deferred for what is outside."""
    rows = written(transformed(axioms, ToALC))
    outside = [r.a for r in rows.where("form = 'rest'").select("a").distinct().limit(20).collect()]
    if outside:
        raise Deferred(f"outside ALCH with transitive roles: {', '.join(sorted(outside))}")
    names = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\t"))
    gcis = rows.where("form = 'gci'").select(names("a").alias("body"), names("b").alias("head")).distinct()
    some = rows.where("form = 'some'").select("a", F.col("b").alias("role"), F.col("c").alias("b")).distinct()
    every = rows.where("form = 'all'").select("a", F.col("b").alias("role"), F.col("c").alias("b")).distinct()
    roles = some.select("role").unionByName(every.select("role")).unionByName(rows.where("form = 'transitive'").select(F.col("a").alias("role"))).distinct()
    sub = rows.where("form = 'subrole'").select(F.col("a").alias("sub"), F.col("b").alias("sup"))
    down = written(closure(sub, "sub", "sup").unionByName(roles.select(F.col("role").alias("sub"), F.col("role").alias("sup"))).distinct())
    wide = written(every.join(down, F.col("role") == F.col("sup")).select("a", F.col("sub").alias("role"), "b").distinct())
    over = every.join(down.join(rows.where("form = 'transitive'").select(F.col("a").alias("sub")), "sub", "left_semi"), F.col("role") == F.col("sup"))
    # along a transitive role a universal hands itself on
    step = written(over.select("a", F.col("sub").alias("role"), "b", F.concat(F.lit("along "), "sub", F.lit(" "), "b").alias("z")).distinct())
    handed = step.select("a", "role", F.col("z").alias("b")).unionByName(step.select(F.col("z").alias("a"), "role", F.col("z").alias("b")))
    below = down.where("sub <> sup")
    handed = handed.unionByName(handed.join(below, F.col("role") == F.col("sup")).select("a", F.col("sub").alias("role"), "b"))
    gcis = gcis.unionByName(step.select(F.array("z").alias("body"), F.array("b").alias("head"))).distinct()
    top = F.array(F.lit(TOP))
    uses_top = gcis.sparkSession.range(1).select(F.array().cast("array<string>").alias("body"), top.alias("head"))
    gcis = written(gcis.unionByName(uses_top).withColumn("id", F.monotonically_increasing_id()))
    return {"gcis": gcis.select("id", "body", "head"), "some": some, "all": wide.unionByName(handed).distinct()}
