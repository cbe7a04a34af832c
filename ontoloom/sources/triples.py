"""N-Triples lines, small Turtle and RDF/XML documents to triples, and triples to axiom rows by joins.

Every triple must be used by some axiom or declaration; what is left over is returned, and a reader that must be
strict refuses it.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import written

TRIPLE = "ontology string, s string, p string, o string"
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
_TOKEN = re.compile(r"""\s+|\#[^\n]*|(<[^>\s]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^(?:<[^>\s]*>|[^\s;,.\[\]()]+))?|@\w+|[;,\[\]()]|\.(?=\s|$)|[^\s;,\[\]()"<>\#]+?(?=\.?(?:\s|$)|[;,\[\]()]))""")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """One line is one triple, so files split over tasks."""
    part = lambda i: F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)\s+(.*\S)\s*\.\s*$", i)
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return rows.select(F.input_file_name().alias("ontology"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def turtle_triples(text: str) -> list[tuple[str, str, str]]:
    """Triples of a document with prefixes, predicate and object lists, blank nodes and collections."""
    tokens = [m[1] for m in _TOKEN.finditer(text) if m[1]]
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str]] = []
    at, blank = 0, 0

    def full(tok: str) -> str:
        if tok == "a":
            return f"<{RDF}type>"
        if tok[0] in '<"_' or ":" not in tok:
            return tok
        prefix, _, local = tok.partition(":")
        return f"<{prefixes[prefix]}{local}>"

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:t{blank}"

    def node() -> str:
        nonlocal at
        tok = tokens[at]
        at += 1
        if tok == "[":
            me = fresh()
            if tokens[at] != "]":
                predicates(me)
            at += 1
            return me
        if tok == "(":
            items = []
            while tokens[at] != ")":
                items.append(node())
            at += 1
            rest = f"<{RDF}nil>"
            for item in reversed(items):
                cell = fresh()
                out.extend([(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", rest)])
                rest = cell
            return rest
        return full(tok)

    def predicates(subject: str) -> None:
        nonlocal at
        while True:
            p = full(tokens[at])
            at += 1
            out.append((subject, p, node()))
            while tokens[at] == ",":
                at += 1
                out.append((subject, p, node()))
            while tokens[at] == ";":
                at += 1
            if tokens[at] in (".", "]"):
                return

    while at < len(tokens):
        if tokens[at].lower() in ("@prefix", "prefix"):
            prefixes[tokens[at + 1].rstrip(":")] = tokens[at + 2][1:-1]
            at += 3 + (tokens[at][0] == "@")
            continue
        subject = node()
        if tokens[at] != ".":
            predicates(subject)
        at += 1
    return out


def rdfxml_triples(text: str) -> list[tuple[str, str, str]]:
    """Triples of an RDF/XML document: node and property elements, typed nodes, property attributes, languages, collections, nested nodes."""
    out: list[tuple[str, str, str]] = []
    root, blank = ET.fromstring(text), 0
    rdf, xml = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
    iri = lambda tag: f"<{tag[1:].replace('}', '')}>"

    def against(base: str, ref: str) -> str:
        return f"<{urljoin(base, ref) if not ref.startswith('#') else base.partition('#')[0] + ref}>"

    def fresh() -> str:
        nonlocal blank
        blank += 1
        return f"_:x{blank}"

    def literal(value: str, lang: str | None, kind: str | None) -> str:
        quoted = '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return f"{quoted}^^<{kind}>" if kind else f"{quoted}@{lang}" if lang else quoted

    def attributes(subject: str, element: ET.Element, lang: str | None) -> None:
        for key, value in element.attrib.items():
            if key.startswith("{") and not key.startswith((rdf, xml)):
                out.append((subject, iri(key), literal(value, lang, None)))
            elif key == f"{rdf}type":
                out.append((subject, f"<{RDF}type>", f"<{value}>"))

    def node(element: ET.Element, base: str, lang: str | None) -> str:
        base, lang = element.get(f"{xml}base", base), element.get(f"{xml}lang", lang)
        about, name, id_ = (element.get(f"{rdf}{x}") for x in ("about", "nodeID", "ID"))
        me = against(base, about) if about is not None else f"_:{name}" if name else against(base, f"#{id_}") if id_ else fresh()
        if element.tag != f"{rdf}Description":
            out.append((me, f"<{RDF}type>", iri(element.tag)))
        attributes(me, element, lang)
        counter = 0
        for child in element:
            predicate, inner = iri(child.tag), child.get(f"{xml}lang", lang)
            if child.tag == f"{rdf}li":
                counter += 1
                predicate = f"<{RDF}_{counter}>"
            kind = child.get(f"{rdf}parseType")
            if kind == "Collection":
                rest, items = f"<{RDF}nil>", [node(x, base, inner) for x in child]
                for item in reversed(items):
                    cell = fresh()
                    out.extend([(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", rest)])
                    rest = cell
                out.append((me, predicate, rest))
            elif kind == "Literal":
                inside = (child.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in child)
                out.append((me, predicate, literal(inside, None, f"{RDF}XMLLiteral")))
            elif kind == "Resource":
                me2 = fresh()
                out.append((me, predicate, me2))
                holder = ET.Element(f"{rdf}Description", {f"{rdf}nodeID": me2[2:]})
                holder.extend(list(child))
                node(holder, base, inner)
            elif child.get(f"{rdf}resource") is not None or child.get(f"{rdf}nodeID"):
                target = child.get(f"{rdf}resource")
                target = against(base, target) if target is not None else f"_:{child.get(f'{rdf}nodeID')}"
                out.append((me, predicate, target))
                attributes(target, child, inner)
            elif len(child):
                for x in child:
                    out.append((me, predicate, node(x, base, inner)))
            else:
                out.append((me, predicate, literal(child.text or "", inner if not child.get(f"{rdf}datatype") else None, child.get(f"{rdf}datatype"))))
        return me

    base, lang = root.get(f"{xml}base", ""), root.get(f"{xml}lang")
    for element in root if root.tag == f"{rdf}RDF" else [root]:
        node(element, base, lang)
    return out


def rdfxml_rows(files: DataFrame) -> DataFrame:
    """Triples of RDF/XML documents (ontology, value); a document is one row of work, documents are dealt over tasks."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(o, *t) for o, text in zip(pdf.ontology, pdf["value"]) for t in rdfxml_triples(text)], columns=["ontology", "s", "p", "o"])

    return files.mapInPandas(parse, TRIPLE)


def parse_rows(files: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(o, *t) for o, text in zip(pdf.ontology, pdf["value"]) for t in turtle_triples(text)], columns=["ontology", "s", "p", "o"])

    return files.mapInPandas(parse, TRIPLE)


# fixed values: predicates and types that are axioms between two names or about one
BINARY = {f"<{RDFS}subClassOf>": "SubClassOf", f"<{OWL}equivalentClass>": "EquivalentClasses", f"<{OWL}disjointWith>": "DisjointClasses", f"<{RDFS}subPropertyOf>": "SubObjectPropertyOf",
          f"<{RDFS}domain>": "ObjectPropertyDomain", f"<{RDFS}range>": "ObjectPropertyRange", f"<{OWL}inverseOf>": "InverseObjectProperties", f"<{OWL}sameAs>": "SameIndividual", f"<{OWL}differentFrom>": "DifferentIndividuals"}
UNARY = {f"<{OWL}{x}Property>": f"{x}ObjectProperty" for x in ("Transitive", "Symmetric", "Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Asymmetric")}
DECLARED = {f"<{OWL}{x}>": x for x in ("Class", "ObjectProperty", "NamedIndividual", "AnnotationProperty")} | {f"<{OWL}DatatypeProperty>": "DataProperty"}


def axioms(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, args) rows, and the triples that no axiom used. Existential restrictions are joined back from their blank nodes."""
    t = written(triples.select("ontology", "s", "p", "o").distinct())
    lookup = lambda table, c: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c))
    typed = f"<{RDF}type>"
    on = t.where(F.col("p") == f"<{OWL}onProperty>").select("ontology", F.col("s").alias("node"), F.col("o").alias("role"))
    some = t.where(F.col("p") == f"<{OWL}someValuesFrom>").select("ontology", F.col("s").alias("node"), F.col("o").alias("filler"))
    expr = on.join(some, ["ontology", "node"]).select("ontology", "node", F.concat(F.lit("ObjectSomeValuesFrom("), "role", F.lit(" "), "filler", F.lit(")")).alias("expr"))
    named = lambda df, c: df.join(expr.withColumnRenamed("node", c), ["ontology", c], "left").withColumn(c, F.coalesce("expr", c)).drop("expr")
    pairs = named(named(t.withColumn("head", lookup(BINARY, "p")).where("head is not null"), "s"), "o")
    types = t.where(F.col("p") == typed)
    one = types.withColumn("head", lookup(UNARY, "o")).where("head is not null").select("ontology", "head", F.array("s").alias("args"))
    kinds = types.withColumn("kind", lookup(DECLARED, "o")).where("kind is not null").select("ontology", F.lit("Declaration").alias("head"), F.array(F.concat("kind", F.lit("("), "s", F.lit(")"))).alias("args"))
    roles = t.where((F.col("p") == typed) & (F.col("o") == f"<{OWL}ObjectProperty>")).select("ontology", F.col("s").alias("p"))
    links = t.join(roles, ["ontology", "p"], "left_semi").select("ontology", F.lit("ObjectPropertyAssertion").alias("head"), F.array("p", "s", "o").alias("args"))
    vocabulary = F.col("o").startswith(f"<{OWL}") | F.col("o").startswith(f"<{RDFS}") | F.col("o").startswith(f"<{RDF}")
    members = types.where(~vocabulary).select("ontology", F.lit("ClassAssertion").alias("head"), F.array("o", "s").alias("args"))
    out = pairs.select("ontology", "head", F.array("s", "o").alias("args")).unionByName(one).unionByName(kinds).unionByName(links).unionByName(members)
    parts = t.join(expr.select("ontology", F.col("node").alias("s")), ["ontology", "s"], "left_semi").where(F.col("p").isin(f"<{OWL}onProperty>", f"<{OWL}someValuesFrom>", typed))
    used = t.where(lookup(BINARY, "p").isNotNull() | ((F.col("p") == typed) & (lookup(UNARY, "o").isNotNull() | lookup(DECLARED, "o").isNotNull() | ~vocabulary | F.col("o").isin(f"<{OWL}Ontology>"))))
    used = used.unionByName(t.join(roles, ["ontology", "p"], "left_semi").select(*t.columns)).unionByName(parts.select(*t.columns))
    return out, t.join(used.distinct(), ["ontology", "s", "p", "o"], "left_anti")
