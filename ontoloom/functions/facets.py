"""Facets of data ranges: which a base type allows, and whether a literal meets one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import INTEGERS

# fixed values: facets of the OWL 2 datatype map by kind of base type
NUMBERS = [*INTEGERS, "xsd:decimal", "owl:rational", "owl:real", "xsd:double", "xsd:float"]
STRINGS = ["xsd:string", "xsd:normalizedString", "xsd:token", "xsd:language", "xsd:Name", "xsd:NCName", "xsd:NMTOKEN", "xsd:anyURI"]
BINARIES = ["xsd:hexBinary", "xsd:base64Binary"]
TIMES = ["xsd:dateTime", "xsd:dateTimeStamp"]
BOUNDS = ["xsd:minInclusive", "xsd:maxInclusive", "xsd:minExclusive", "xsd:maxExclusive"]
LENGTHS = ["xsd:length", "xsd:minLength", "xsd:maxLength"]
#: \i and \c of the XSD regular expressions, as Java classes.
_ESCAPES = {r"\i": r"[\p{L}_:]", r"\c": r"[\p{L}\p{N}._:\-]", r"\I": r"[^\p{L}_:]", r"\C": r"[^\p{L}\p{N}._:\-]"}


def allowed(base: Column, facet: Column) -> Column:
    """Whether a base type may be restricted by a facet."""
    return (
        F.when(base.isin(NUMBERS + TIMES), facet.isin(BOUNDS))
        .when(base.isin(BINARIES), facet.isin(LENGTHS))
        .when(base.isin(STRINGS), facet.isin([*LENGTHS, "xsd:pattern"]))
        .when(base == "rdf:PlainLiteral", facet.isin([*LENGTHS, "xsd:pattern", "rdf:langRange"]))
        .otherwise(F.lit(False))
    )


def java_pattern(pattern: str) -> str:
    """An XSD pattern as a Java one: it matches whole strings, ^ and $ stand for themselves."""
    out, at, inside = [], 0, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in _ESCAPES:
            out.append(_ESCAPES[two][1:-1] if inside and two[1].islower() else _ESCAPES[two])
            at += 2
        elif two[0] == "\\":
            out.append(two)
            at += 2
        else:
            inside += (two[0] == "[") - (two[0] == "]")
            out.append("\\" + two[0] if two[0] in "^$" and not inside else two[0])
            at += 1
    return f"^(?:{''.join(out)})$"


def in_language_range(tag: Column, wanted: str) -> Column:
    """Basic filtering: the range, or the range and a further subtag; * takes every tag."""
    low, tag = wanted.lower(), F.lower(F.coalesce(tag, F.lit("")))
    return (tag != "") if low == "*" else (tag == low) | tag.startswith(f"{low}-")


def _number(lex: Column) -> Column:
    ratio = F.split(lex, "/")
    exact = lex.try_cast("decimal(38,12)")
    return F.when(lex.contains("/"), F.get(ratio, 0).try_cast("decimal(38,12)") / F.get(ratio, 1).try_cast("decimal(38,12)")).otherwise(exact)


def meets(lex: Column, base: str, facet: str, value: str, lang: Column | None = None) -> Column:
    """Whether a literal of the base type is in the range that the facet cuts out; null where the facet is not allowed."""
    if base in ("xsd:double", "xsd:float"):
        kind = base.removeprefix("xsd:")
        left, right = F.regexp_replace(lex, "^([+-]?)INF$", "$1Infinity").try_cast(kind), F.lit(value.replace("INF", "Infinity")).cast(kind)
        known = ~F.isnan(left)
    elif base in TIMES:
        left, right, known = lex.try_cast("timestamp"), F.lit(value).cast("timestamp"), F.lit(True)
    elif base in NUMBERS:
        left, right, known = _number(lex), _number(F.lit(value)), F.lit(True)
    else:
        left = right = known = None
    if left is not None:
        ways = {"xsd:minInclusive": lambda: left >= right, "xsd:maxInclusive": lambda: left <= right, "xsd:minExclusive": lambda: left > right, "xsd:maxExclusive": lambda: left < right}
        return ways[facet]() & known if facet in ways else F.lit(None).cast("boolean")
    if facet in LENGTHS and base in [*STRINGS, *BINARIES, "rdf:PlainLiteral"]:
        if int(value) < 0:
            raise ValueError(f"{facet} {value}")
        size = F.length(lex) / 2 if base == "xsd:hexBinary" else F.octet_length(F.unbase64(lex)) if base == "xsd:base64Binary" else F.length(lex)
        return {"xsd:length": size == int(value), "xsd:minLength": size >= int(value), "xsd:maxLength": size <= int(value)}[facet]
    if facet == "xsd:pattern" and base in [*STRINGS, "rdf:PlainLiteral"]:
        return lex.rlike(java_pattern(value))
    if facet == "rdf:langRange" and base == "rdf:PlainLiteral":
        return in_language_range(F.lit(None).cast("string") if lang is None else lang, value)
    return F.lit(None).cast("boolean")
