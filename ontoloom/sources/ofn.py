"""OWL functional syntax: text files to axiom rows, and the rows to the operators' tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(<[^>\s]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^(?:<[^>\s]*>|[^\s()"]+))?|\(|\)|=|[^\s()<>"=\#]+|[<>])""")
BATCH = 10_000  # axioms sent at a time
AXIOM = "ontology string, ordinal long, head string, args array<string>"


def axioms_of(text: str) -> list[tuple[str, list[str]]]:
    """(head, args) of the axioms and prefixes of one document; nested expressions stay text with single spaces."""
    return list(each_axiom(text))


def each_axiom(text: str) -> Iterator[tuple[str, list[str]]]:
    """`axioms_of`, one after the other: nothing of a document is held but its text and the axiom that is open."""
    stack, head = [], None
    for m in _TOKEN.finditer(text):
        tok = m[1]
        if tok is None:
            continue
        if tok == "(":
            stack.append([head])
            head = None
        elif tok == ")":
            if head is not None:
                stack[-1].append(head)
                head = None
            done = stack.pop()
            name, args = done[0], done[1:]
            outer = [s[0] for s in stack]
            if outer in ([], ["Ontology"]) and name != "Ontology":
                yield name, args
            elif stack:
                stack[-1].append(f"{name}({' '.join(args)})")
        else:
            if head is not None:
                if not stack:
                    head = None
                    continue
                stack[-1].append(head)
            head = tok
    if stack:
        raise ValueError("unbalanced parentheses")


def read_ofn(spark: SparkSession, path: str) -> DataFrame:
    """(ontology, ordinal, head, args) of every axiom; one document is one row of work, documents are dealt over tasks."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("ontology"), "value")
    return parse_rows(files)


def parse_rows(files: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((o, i, h, a) for o, text in zip(pdf.ontology, pdf["value"]) for i, (h, a) in enumerate(each_axiom(text or "")))
            while some := list(islice(rows, BATCH)):
                yield pd.DataFrame(some, columns=["ontology", "ordinal", "head", "args"])

    return files.mapInPandas(parse, AXIOM)


def sniff(first: str) -> str:
    """ofn, xml or turtle, by content."""
    head = first.lstrip("﻿ \t\r\n")
    if head.startswith(("Prefix(", "Ontology(", "#")):
        return "ofn"
    if head.startswith("<"):
        return "turtle" if re.match(r"<[^>\s?!]+:[^>\s]*>\s", head) else "xml"
    return "turtle" if head.startswith(("@prefix", "@base", "PREFIX", "BASE")) else "ofn"


def no_imports(axioms: DataFrame) -> None:
    """Imports are refused: nothing is fetched."""
    if not axioms.where("head = 'Import'").isEmpty():
        raise ValueError("imports are not followed")


def told(axioms: DataFrame) -> DataFrame:
    """(sub, sup) between names: SubClassOf, and EquivalentClasses both ways along the list."""
    flat = axioms.where(F.forall("args", lambda a: ~a.contains("(")))
    sub = flat.where("head = 'SubClassOf'").select(F.col("args")[0].alias("sub"), F.col("args")[1].alias("sup"))
    eq = flat.where("head = 'EquivalentClasses'").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("args") - 1), lambda i: F.struct(F.col("args")[i - 1].alias("sub"), F.col("args")[i].alias("sup")))).alias("e")).select("e.*")
    return sub.unionByName(eq).unionByName(eq.select(F.col("sup").alias("sub"), F.col("sub").alias("sup")))


def class_names(axioms: DataFrame) -> DataFrame:
    """(name, kind) of declarations."""
    inner = F.regexp_extract_all(F.col("args")[0], F.lit(r"^(\w+)\((.*)\)$"), 1)
    return axioms.where("head = 'Declaration'").select(F.regexp_extract(F.col("args")[0], r"\((.*)\)$", 1).alias("name"), F.get(inner, 0).alias("kind"))
