"""Built-in atoms of rules as SQL over the variables of a body; what is not in the registry is refused."""

from __future__ import annotations

# fixed values: built-ins of the rule language, by what they say of their arguments
TESTS = {
    "swrlb:equal": "{0} = {1}", "swrlb:notEqual": "{0} <> {1}", "swrlb:lessThan": "{0} < {1}", "swrlb:lessThanOrEqual": "{0} <= {1}", "swrlb:greaterThan": "{0} > {1}", "swrlb:greaterThanOrEqual": "{0} >= {1}",
    "swrlb:stringEqualIgnoreCase": "lower({0}) = lower({1})", "swrlb:contains": "contains({0}, {1})", "swrlb:containsIgnoreCase": "contains(lower({0}), lower({1}))", "swrlb:startsWith": "startswith({0}, {1})",
    "swrlb:endsWith": "endswith({0}, {1})", "swrlb:matches": "{0} rlike concat('^(?:', {1}, ')$')", "swrlb:booleanNot": "{0} = not {1}",
    "owl:sameAs": "{0} = {1}", "owl:differentFrom": "{0} <> {1}",
}
# the first argument is the value of the others
VALUES = {
    "swrlb:add": " + ", "swrlb:multiply": " * ", "swrlb:stringConcat": "concat", "swrlb:subtract": "{0} - {1}", "swrlb:divide": "{0} / {1}", "swrlb:integerDivide": "{0} div {1}", "swrlb:mod": "{0} % {1}", "swrlb:pow": "power({0}, {1})",
    "swrlb:unaryMinus": "-{0}", "swrlb:unaryPlus": "{0}", "swrlb:abs": "abs({0})", "swrlb:ceiling": "ceil({0})", "swrlb:floor": "floor({0})", "swrlb:round": "floor({0} + 0.5)", "swrlb:roundHalfToEven": "bround({0})",
    "swrlb:stringLength": "length({0})", "swrlb:upperCase": "upper({0})", "swrlb:lowerCase": "lower({0})", "swrlb:normalizeSpace": "trim(regexp_replace({0}, '\\\\s+', ' '))", "swrlb:translate": "translate({0}, {1}, {2})",
    "swrlb:substringBefore": "if(contains({0}, {1}), substring_index({0}, {1}, 1), '')", "swrlb:substringAfter": "if(contains({0}, {1}), substring({0}, instr({0}, {1}) + length({1})), '')", "swrlb:replace": "regexp_replace({0}, {1}, {2})",
}


def _term(x) -> str:
    if isinstance(x, str):
        return x[1:] if x.startswith("?") else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(x).lower() if isinstance(x, bool) else repr(x)


def sql(name: str, *args) -> str:
    """The atom as an SQL condition; variables begin with a question mark, all else is a constant."""
    terms = [_term(a) for a in args]
    if name in TESTS:
        return f"({TESTS[name].format(*terms)})"
    if name == "swrlb:substring":
        return f"({terms[0]} = substring({', '.join(terms[1:])}))"
    if name not in VALUES:
        raise ValueError(f"unknown built-in {name}")
    form, (out, *rest) = VALUES[name], terms
    value = form.join(rest) if form.startswith(" ") else f"concat({', '.join(rest)})" if form == "concat" else form.format(*rest)
    return f"({out} = {value})"


def where(*atoms: tuple) -> str:
    """Several built-in atoms (name, *arguments) as one condition for `rules.Rule`."""
    return " and ".join(sql(*a) for a in atoms) or "true"


def data_range(variable: str, low=None, high=None, values=None) -> str:
    """A data range atom over a number or an enumeration."""
    v = _term(variable)
    parts = [f"{v} >= {low!r}"] * (low is not None) + [f"{v} <= {high!r}"] * (high is not None)
    return " and ".join([*parts, *([f"{v} in ({', '.join(map(_term, values))})"] if values else [])]) or "true"
