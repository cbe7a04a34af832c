"""Literals: lexical spaces and value keys. Two literals have equal keys exactly when they are one value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lexical patterns of the OWL 2 datatype map
LEXICAL = {
    "xsd:integer": r"[+-]?[0-9]+",
    "xsd:decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "xsd:boolean": r"true|false|1|0",
    "xsd:double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "xsd:float": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "xsd:hexBinary": r"([0-9a-fA-F]{2})*",
    "xsd:language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",
    "xsd:dateTime": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])?",
    "owl:rational": r"[+-]?[0-9]+/0*[1-9][0-9]*",
    "xsd:string": r"(?s).*",
    "xsd:anyURI": r"\S*",
    "xsd:normalizedString": r"[^\t\n\r]*",
    "xsd:token": r"([^\s]+( [^\s]+)*)?",
    "xsd:Name": r"[\p{L}_:][\p{L}\p{N}._:\-]*",
    "xsd:NCName": r"[\p{L}_][\p{L}\p{N}._\-]*",
    "xsd:NMTOKEN": r"[\p{L}\p{N}._:\-]+",
    "xsd:base64Binary": r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?",
    "xsd:dateTimeStamp": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])",
    "rdf:PlainLiteral": r"(?s).*",
}
# fixed values: least and greatest of the bounded integer types
BOUNDS = {
    "xsd:byte": (-128, 127),
    "xsd:short": (-32768, 32767),
    "xsd:int": (-(2**31), 2**31 - 1),
    "xsd:long": (-(2**63), 2**63 - 1),
    "xsd:unsignedByte": (0, 255),
    "xsd:unsignedShort": (0, 65535),
    "xsd:unsignedInt": (0, 2**32 - 1),
    "xsd:unsignedLong": (0, 2**64 - 1),
    "xsd:nonNegativeInteger": (0, None),
    "xsd:positiveInteger": (1, None),
    "xsd:nonPositiveInteger": (None, 0),
    "xsd:negativeInteger": (None, -1),
}
INTEGERS = ["xsd:integer", *BOUNDS]


def _digits(lex: Column) -> Column:
    """Canonical form of an integer of any length."""
    bare = F.regexp_replace(lex, r"^[+-]?0*", "")
    return F.when(bare == "", F.lit("0")).otherwise(F.concat(F.when(lex.startswith("-"), "-").otherwise(""), bare))


def _below(a: Column, b: str) -> Column:
    """Canonical integers a <= b, by sign, length and digits, whatever their length."""
    neg, bneg, size = a.startswith("-"), b.startswith("-"), len(b)
    wide = F.length(a)
    mag = (wide < size) | ((wide == size) & (a <= F.lit(b)))
    back = (wide > size) | ((wide == size) & (a >= F.lit(b)))
    return F.when(neg & F.lit(not bneg), F.lit(True)).when(~neg & F.lit(bneg), F.lit(False)).when(neg, back).otherwise(mag)


def valid(lex: Column, datatype: Column) -> Column:
    """Whether a lexical form belongs to its datatype; rdfs:Literal and owl:real type no literal."""
    out = F.when(datatype.isin("rdfs:Literal", "owl:real"), F.lit(False))
    for name, pattern in LEXICAL.items():
        out = out.when(datatype == name, lex.rlike(f"^(?:{pattern})$"))
    canon = _digits(lex)
    for name, (low, high) in BOUNDS.items():
        ok = lex.rlike(f"^(?:{LEXICAL['xsd:integer']})$")
        if high is not None:
            ok = ok & _below(canon, str(high))
        if low is not None:
            ok = ok & (_below(canon, str(low - 1)) == F.lit(False))
        out = out.when(datatype == name, ok)
    return out.otherwise(F.lit(False))


#: Well-formed language tags: a language, then subtags of one to eight letters or digits.
LANGUAGE_TAG = r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$"


def valid_language(lang: Column) -> Column:
    """Whether a language tag is well formed; none is."""
    return lang.isNull() | lang.rlike(LANGUAGE_TAG)


def value_key(lex: Column, datatype: Column, lang: Column | None = None) -> Column:
    """A string that names the literal's value: integers and decimals by value across their types, floats by
    type and bits (NaN and signed zeros apart), dateTimes with their offset, strings with their language."""
    whole = F.regexp_replace(F.regexp_replace(lex, r"\..*$", ""), r"^([+-]?)$", "$10")
    frac = F.regexp_replace(F.regexp_extract(lex, r"\.([0-9]*)", 1), "0+$", "")
    number = F.when(frac == "", _digits(whole)).otherwise(F.concat(F.when(lex.startswith("-") & (_digits(whole) == "0"), "-").otherwise(""), _digits(whole), F.lit("."), frac))
    number = F.when(datatype.isin(INTEGERS), _digits(lex)).otherwise(number)
    special = F.when(lex.rlike("^[+]?INF$"), "INF").when(lex == "-INF", "-INF").when(lex == "NaN", "NaN")
    double = F.coalesce(special, F.when(lex.rlike(r"^-0*(\.0*)?([eE].*)?$"), "-0.0").otherwise(lex.try_cast("double").cast("string")))
    single = F.coalesce(special, F.when(lex.rlike(r"^-0*(\.0*)?([eE].*)?$"), "-0.0").otherwise(lex.try_cast("float").cast("string")))
    tag = F.lit("") if lang is None else F.lower(F.coalesce(lang, F.lit("")))
    return (
        F.when(datatype.isin([*INTEGERS, "xsd:decimal"]), F.concat(F.lit("n:"), number))
        .when(datatype == "xsd:double", F.concat(F.lit("d:"), double))
        .when(datatype == "xsd:float", F.concat(F.lit("f:"), single))
        .when(datatype == "xsd:boolean", F.concat(F.lit("b:"), F.when(lex.isin("true", "1"), "true").otherwise("false")))
        .when(datatype == "xsd:hexBinary", F.concat(F.lit("x:"), F.upper(lex)))
        .when(datatype == "xsd:dateTime", F.concat(F.lit("t:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(lex, r"(\.[0-9]*?)0+(Z|[+-]..:..)?$", "$1$2"), r"\.(Z|[+-]..:..)?$", "$1"), r"[+-]00:00$", "Z")))
        .otherwise(F.concat(F.lit("s:"), lex, F.lit("@"), tag))
    )
