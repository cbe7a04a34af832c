"""OWL/XML documents to the axiom rows of functional syntax: the two forms share heads and argument order."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ofn import AXIOM

OWL = "{http://www.w3.org/2002/07/owl#}"
# fixed values: elements that only name an entity
ENTITIES = {"Class", "Datatype", "ObjectProperty", "DataProperty", "AnnotationProperty", "NamedIndividual", "AnonymousIndividual"}


def _name(node: ET.Element) -> str:
    iri = node.get("IRI") or node.get("abbreviatedIRI") or node.get("nodeID") or (node.text or "").strip()
    return iri if node.get("IRI") is None else f"<{iri}>"


def expression(node: ET.Element, declared: bool = False) -> str:
    tag = node.tag.removeprefix(OWL)
    if tag in ENTITIES:
        return f"{tag}({_name(node)})" if declared else _name(node)
    if tag in ("IRI", "AbbreviatedIRI"):
        return f"<{node.text}>" if tag == "IRI" else (node.text or "")
    if tag == "Literal":
        text = (node.text or "").replace("\\", "\\\\").replace('"', '\\"')
        lang = node.get("{http://www.w3.org/XML/1998/namespace}lang")
        kind = node.get("datatypeIRI")
        return f'"{text}"' + (f"@{lang}" if lang else f"^^<{kind}>" if kind else "")
    args = ([node.get("cardinality")] if node.get("cardinality") else []) + [expression(x, tag == "Declaration") for x in node]
    return f"{tag}({' '.join(args)})"


def axioms_of(text: str) -> list[tuple[str, list[str]]]:
    out = []
    for node in ET.fromstring(text):
        tag = node.tag.removeprefix(OWL)
        if tag == "Prefix":
            out.append((tag, [f"{node.get('name')}:", "=", f"<{node.get('IRI')}>"]))
        else:
            args = [expression(x, tag == "Declaration") for x in node]
            out.append((tag, args or [(node.text or "").strip()]))
    return out


def parse_rows(files: DataFrame) -> DataFrame:
    """(ontology, ordinal, head, args) from rows (ontology, value), one document each."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(o, i, h, a) for o, text in zip(pdf.ontology, pdf["value"]) for i, (h, a) in enumerate(axioms_of(text))]
            yield pd.DataFrame(rows, columns=["ontology", "ordinal", "head", "args"])

    return files.mapInPandas(parse, AXIOM)


def read_owlxml(spark: SparkSession, path: str) -> DataFrame:
    return parse_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("ontology"), "value"))
