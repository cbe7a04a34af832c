import itertools
import random

import pytest

from ontoloom.operators import el, normalise
from ontoloom.plans import classify
from ontoloom.plans.fixpoint import Deferred
from ontoloom.sources import answers, ofn


def parsed(spark, *texts):
    return ofn.parse_rows(spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(texts)], "ontology string, value string"))


def told(spark, *axioms):
    return parsed(spark, f"Prefix(:=<http://e/>) Ontology(<http://e/o> {' '.join(axioms)})")


def subs(got):
    return {(r.sub, r["sup"]) for r in got.subs.collect()}


def brute_el(names, rows):
    """Completion over sets, rule by rule until nothing is new. rows: (form, *arguments)."""
    top, bottom = "owl:Thing", "owl:Nothing"
    s = {n: {n, top} for n in names | {top, bottom}}
    e = set()
    while True:
        before = sum(map(len, s.values())) + len(e)
        for form, *x in rows:
            for c in s:
                if form == "nf1" and x[0] in s[c]:
                    s[c].add(x[1])
                elif form == "nf2" and x[0] in s[c] and x[1] in s[c]:
                    s[c].add(x[2])
                elif form == "nf3" and x[0] in s[c]:
                    e.add((c, x[1], x[2]))
                elif form == "nf5" and x[0] in s[c]:
                    s[c].add(bottom)
            if form == "nf4":
                for c, r, d in list(e):
                    if r == x[0] and x[1] in s[d]:
                        s[c].add(x[2])
            if form == "nf6":
                e |= {(c, x[1], d) for c, r, d in e if r == x[0]}
            if form == "nf7":
                e |= {(a, x[2], d) for a, r, b in e for c, q, d in e if r == x[0] and q == x[1] and b == c}
        for c, _, d in e:
            if bottom in s[d]:
                s[c].add(bottom)
        if sum(map(len, s.values())) + len(e) == before:
            lost = {c for c in s if bottom in s[c]}
            return {(c, d) for c in names - lost for d in s[c] - {c, top}} | {(c, bottom) for c in lost & names}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_completion_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names, roles = [f"C{i}" for i in range(12)], ["r", "s", "t"]
    c, r = lambda: rng.choice(names), lambda: rng.choice(roles)
    rows = [("nf1", c(), c()) for _ in range(5)] + [("nf2", c(), c(), c()) for _ in range(4)] + [("nf3", c(), r(), c()) for _ in range(9)] + [("nf4", r(), c(), c()) for _ in range(5)]
    rows += [("nf4", r(), c(), "owl:Nothing"), ("nf6", "r", "s"), ("nf7", "s", "t", "t")]
    tables = {f: spark.createDataFrame([x[1:] for x in rows if x[0] == f], ", ".join(f"{k} string" for k in el.ELAxioms.shapes[f].split())) for f in {x[0] for x in rows}}
    kb = el.ELAxioms(spark, **tables, extra=names)
    symbols = kb.symbols()
    got = {(x.sub, x["sup"]) for x in el.readout(el.complete(kb, symbols), symbols).collect()}
    assert got == brute_el(set(names), rows)


def test_bottom_comes_back_without_nf1_or_nf5(spark):
    got = classify.classify(told(spark, "SubClassOf(:X ObjectSomeValuesFrom(:r :F))", "SubClassOf(ObjectSomeValuesFrom(:r :F) owl:Nothing)", "SubClassOf(:Y ObjectSomeValuesFrom(:s :X))"))
    assert got.engine == "el" and got.consistent and subs(got) == {(":X", "owl:Nothing"), (":Y", "owl:Nothing")}


def test_a_long_chain_of_classes_takes_few_rounds(spark):
    kb = el.ELAxioms(spark, nf1=spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(300)], "sub string, sup string"))
    symbols = kb.symbols()
    assert el.readout(el.complete(kb, symbols), symbols).count() == 300 * 301 // 2


AXIOMS = [
    "Declaration(Class(:A))", "DisjointClasses(:A :B :C)", "SubObjectPropertyOf(ObjectPropertyChain(:r :s :t) :u)", "SubObjectPropertyOf(ObjectInverseOf(:r) :s)",
    "ObjectPropertyDomain(:r ObjectUnionOf(:A :B))", "DisjointClasses(ObjectSomeValuesFrom(:r :A) :B)", "DisjointUnion(:D :A :B)", "ObjectPropertyRange(:r :E)", "FunctionalObjectProperty(:r)",
    "SubClassOf(:A ObjectMinCardinality(1 :r :B))", "SubClassOf(:A ObjectMaxCardinality(0 :r :Q))", "SubClassOf(:A ObjectMinCardinality(2 :r :B))", "SubClassOf(:A ObjectHasValue(:r :a))",
    "ClassAssertion(:A :a)", "SubClassOf(ObjectUnionOf(:G :H) ObjectSomeValuesFrom(:r ObjectIntersectionOf(:A :E ObjectSomeValuesFrom(:s :C))))",
]


def test_every_axiom_is_in_tables_silent_or_rest(spark):
    axioms = told(spark, *AXIOMS)
    rows = {}
    for r in normalise.transformed(axioms, normalise.ToEL).collect():
        rows.setdefault(r.ordinal, set()).add("rest" if r.form == "rest" else "silent" if r.form == "silent" else "form")
    assert set(rows) == {r.ordinal for r in axioms.collect()} and all(len(v) == 1 for v in rows.values())
    rest = {(r["head"], tuple(r["args"])) for r in normalise.el_tables(axioms)["rest"].collect()}
    assert {h for h, _ in rest} == {"SubObjectPropertyOf", "ObjectPropertyDomain", "DisjointUnion", "FunctionalObjectProperty", "SubClassOf", "ClassAssertion"}
    assert len([1 for h, _ in rest if h == "SubClassOf"]) == 2  # at least two, and a value


CASES = [
    # conjunctions, disjointness of three, a chain of three with a domain, ranges, spelled-out built-ins
    (["DisjointClasses(:A :B :C)", "SubClassOf(:X ObjectIntersectionOf(:A :C))"], "el", {(":X", "owl:Nothing")}),
    (["SubObjectPropertyOf(ObjectPropertyChain(:s :t :u) :r)", "ObjectPropertyDomain(:r :C)", "SubClassOf(:A ObjectSomeValuesFrom(:s ObjectSomeValuesFrom(:t ObjectSomeValuesFrom(:u :D))))"], "el", {(":A", ":C")}),
    (["ObjectPropertyRange(:s :E)", "SubObjectPropertyOf(:r :s)", "SubClassOf(:A ObjectSomeValuesFrom(:r :B))", "SubClassOf(ObjectSomeValuesFrom(:r ObjectIntersectionOf(:B :E)) :F)"], "el", {(":A", ":F")}),
    (["SubClassOf(:A <http://www.w3.org/2002/07/owl#Nothing>)", "SubClassOf(:B ObjectSomeValuesFrom(:r :A))"], "el", {(":A", "owl:Nothing"), (":B", "owl:Nothing")}),
    (["SubClassOf(:A ObjectComplementOf(:B))", "SubClassOf(:X ObjectIntersectionOf(:A :B))"], "el", {(":X", "owl:Nothing")}),
    (["SubClassOf(:A ObjectMinCardinality(1 :r :B))", "SubClassOf(:A ObjectMaxCardinality(0 :r :B))"], "el", {(":A", "owl:Nothing")}),
    (["EquivalentClasses(:A :B :C)", "SubClassOf(:C :D)"], "el", {(a, b) for a, b in itertools.product([":A", ":B", ":C"], [":A", ":B", ":C", ":D"]) if a != b}),
    (["EquivalentObjectProperties(:r :s)", "SubClassOf(:A ObjectSomeValuesFrom(:r :B))", "SubClassOf(ObjectSomeValuesFrom(:s :B) :C)", "ReflexiveObjectProperty(:q)", "SubClassOf(ObjectSomeValuesFrom(:q :C) :D)"], "el", {(":A", ":C"), (":A", ":D"), (":C", ":D")}),
    # universals, unions and complements
    (["SubClassOf(:A ObjectAllValuesFrom(:r :C))", "EquivalentClasses(:B ObjectAllValuesFrom(:r ObjectUnionOf(:C :D)))"], "alc", {(":A", ":B")}),
    (["DisjointUnion(:D :A :B)", "SubClassOf(:A :X)", "SubClassOf(:B :X)"], "alc", {(":A", ":D"), (":B", ":D"), (":D", ":X"), (":A", ":X"), (":B", ":X")}),
    (["SubClassOf(:A ObjectSomeValuesFrom(:r :B))", "SubClassOf(:A ObjectAllValuesFrom(:s ObjectComplementOf(:B)))", "SubObjectPropertyOf(:r :s)", "SubClassOf(:X ObjectUnionOf(:A :Y))"], "alc", {(":A", "owl:Nothing"), (":X", ":Y")}),
    (["TransitiveObjectProperty(:r)", "SubClassOf(:A ObjectAllValuesFrom(:r :C))", "SubClassOf(:A ObjectSomeValuesFrom(:r ObjectSomeValuesFrom(:r ObjectComplementOf(:C))))", "SubClassOf(:Z ObjectUnionOf(:A :W))"], "alc", {(":A", "owl:Nothing"), (":Z", ":W")}),
    (["SubClassOf(ObjectComplementOf(:A) :B)", "SubClassOf(:A :C)", "SubClassOf(:B :C)", "SubClassOf(:X :Y)"], "alc", {(a, ":C") for a in (":A", ":B", ":X", ":Y")} | {(":X", ":Y")}),
]


@pytest.mark.parametrize("axioms,engine,want", CASES)
def test_from_text_to_subsumptions(spark, axioms, engine, want):
    got = classify.classify(told(spark, *axioms))
    assert got.engine == engine and got.consistent and subs(got) == want


def test_inconsistency_and_refusals(spark):
    got = classify.classify(told(spark, "SubClassOf(owl:Thing :A)", "SubClassOf(:A owl:Nothing)"))
    assert not got.consistent
    assert {r.value for r in answers.lines(got.subs, consistent=got.consistent).collect()} == {"CONSISTENT 0", "UNSAT\t:A"}
    assert not classify.classify(told(spark, "SubClassOf(ObjectComplementOf(:A) :A)", "SubClassOf(:A ObjectIntersectionOf(:B ObjectComplementOf(:B)))", "SubClassOf(:C ObjectUnionOf(:D :E))")).consistent
    for axiom in ("SubClassOf(:A ObjectMinCardinality(2 :r :B))", "InverseObjectProperties(:r :s)", "ClassAssertion(:A :a)"):
        with pytest.raises(Deferred):
            classify.classify(told(spark, "SubClassOf(:A :B)", axiom))
    with pytest.raises(ValueError):
        classify.classify(told(spark, "Import(<http://elsewhere>)"))


def test_clauses_over_several_lines_are_refused_or_read(spark, tmp_path):
    path = str(tmp_path / "c.json")
    with open(path, "w") as f:
        f.write('{"clauses": [\n  {"body": [], "head": [{"kind": "concept", "name": "A"}]}\n]}\n')
    with pytest.raises(Exception):
        answers.read_clauses(spark, path).collect()
    assert [r["head"][0]["name"] for r in answers.read_clauses(spark, path, multi_line=True).collect()] == ["A"]


def test_rdfxml_triples():
    from ontoloom.sources import triples

    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://e/" xml:base="http://e/o">
      <owl:Class rdf:about="http://e/A"><rdfs:subClassOf rdf:resource="#B"/><rdfs:label xml:lang="en">say "hi"</rdfs:label>
        <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://e/r"/><owl:someValuesFrom rdf:resource="http://e/C"/></owl:Restriction></rdfs:subClassOf></owl:Class>
      <rdf:Description rdf:nodeID="n"><e:size rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</e:size><e:parts rdf:parseType="Collection"><rdf:Description rdf:about="x"/></e:parts></rdf:Description></rdf:RDF>"""
    got = triples.rdfxml_triples(text)
    rdf, rdfs, owl = triples.RDF, triples.RDFS, triples.OWL
    blank = next(s for s, p, o in got if p == f"<{owl}onProperty>")
    cell = next(s for s, p, o in got if p == f"<{rdf}first>")
    assert set(got) == {
        ("<http://e/A>", f"<{rdf}type>", f"<{owl}Class>"), ("<http://e/A>", f"<{rdfs}subClassOf>", "<http://e/o#B>"), ("<http://e/A>", f"<{rdfs}label>", '"say \\"hi\\""@en'), ("<http://e/A>", f"<{rdfs}subClassOf>", blank),
        (blank, f"<{rdf}type>", f"<{owl}Restriction>"), (blank, f"<{owl}onProperty>", "<http://e/r>"), (blank, f"<{owl}someValuesFrom>", "<http://e/C>"),
        ("_:n", "<http://e/size>", '"5"^^<http://www.w3.org/2001/XMLSchema#int>'), ("_:n", "<http://e/parts>", cell), (cell, f"<{rdf}first>", "<http://e/x>"), (cell, f"<{rdf}rest>", f"<{rdf}nil>"),
    }


def test_justifications_over_all_axioms(spark):
    from ontoloom.operators import explain

    schema = "id long, form string, a string, b string, c string"
    rows = spark.createDataFrame([(1, "nf1", "A", "B", None), (2, "nf3", "B", "r", "C"), (3, "nf4", "r", "C", "D"), (4, "nf2", "B", "D", "E"), (6, "nf1", "X", "Y", None)], schema)
    assert explain.one(rows, [1, 2, 3, 4, 6], "A", "E") == [1, 2, 3, 4]
    two = spark.createDataFrame([(1, "nf1", "A", "E", None), (2, "nf5", "A", None, None)], schema)
    assert explain.every(two, "A", "E") == [[1], [2]]
    text = two.select("id", "form").withColumnRenamed("form", "text")
    assert [r.value for r in explain.as_json([[2]], text, "A", "E").collect()] == ['{"sub":"A","sup":"E","axioms":["nf5"]}']


def test_completion_goes_on_from_known_facts(spark):
    nf1 = spark.createDataFrame([("A", "B"), ("B", "C")], "sub string, sup string")
    small = el.ELAxioms(spark, nf1=nf1)
    facts = el.complete(small)
    nf3 = spark.createDataFrame([("C", "r", "D")], "sub string, role string, filler string")
    nf4 = spark.createDataFrame([("r", "D", "E")], "role string, filler string, sup string")
    large = el.ELAxioms(spark, nf1=nf1, nf3=nf3, nf4=nf4)
    symbols = large.symbols()
    row = lambda df: {tuple(r) for r in df.collect()}
    assert row(el.readout(el.complete(large, symbols, known=facts), symbols)) == row(el.readout(el.complete(large, symbols), symbols))


def test_builtin_atoms(spark):
    from ontoloom.functions import builtins

    row = spark.createDataFrame([(7, 3, "O'Hara Lane", 10)], "x long, y long, s string, z long")
    true = [("swrlb:add", "?z", "?x", "?y"), ("swrlb:subtract", 4, "?x", "?y"), ("swrlb:mod", 1, "?x", "?y"), ("swrlb:integerDivide", 2, "?x", "?y"), ("swrlb:contains", "?s", "'Hara"), ("swrlb:stringLength", 11, "?s"),
            ("swrlb:upperCase", "O'HARA LANE", "?s"), ("swrlb:substringBefore", "O", "?s", "'"), ("swrlb:substringAfter", "Lane", "?s", " "), ("swrlb:substring", "Hara", "?s", 3, 4), ("swrlb:matches", "?s", "O.*e"),
            ("swrlb:stringConcat", "O'Hara Lane!", "?s", "!"), ("swrlb:round", 8, 7.5), ("owl:differentFrom", "?x", "?y"), ("swrlb:lessThan", "?y", "?x")]
    assert row.where(builtins.where(*true)).count() == 1
    assert row.where(builtins.where(("swrlb:greaterThan", "?y", "?x"))).count() == 0 and row.where(builtins.data_range("?x", 5, 9)).count() == 1 and row.where(builtins.data_range("?x", values=[1, 2])).count() == 0
    with pytest.raises(ValueError):
        builtins.sql("swrlb:unheardOf", "?x")


def test_facets(spark):
    from ontoloom.functions import facets, literals
    from pyspark.sql import functions as F

    one = spark.range(1)
    meets = lambda lex, base, facet, value, lang=None: one.select(facets.meets(F.lit(lex), base, facet, value, F.lit(lang)).alias("m")).first().m
    assert meets("10", "xsd:integer", "xsd:minInclusive", "10") and not meets("10", "xsd:integer", "xsd:minExclusive", "10.0") and meets("1/3", "owl:rational", "xsd:maxExclusive", "0.5")
    assert not meets("NaN", "xsd:double", "xsd:minInclusive", "-INF") and meets("INF", "xsd:double", "xsd:minInclusive", "1e300") and meets("2024-01-01T00:00:00Z", "xsd:dateTime", "xsd:maxInclusive", "2024-01-01T01:00:00+01:00")
    assert meets("abc", "xsd:string", "xsd:pattern", "[a-c]+") and not meets("abcd", "xsd:string", "xsd:pattern", "[a-c]+") and meets("^a", "xsd:string", "xsd:pattern", "^a") and meets("a:b-1", "xsd:string", "xsd:pattern", r"\i\c*")
    assert meets("0aff", "xsd:hexBinary", "xsd:length", "2") and meets("YWJj", "xsd:base64Binary", "xsd:maxLength", "3") and meets("x", "rdf:PlainLiteral", "rdf:langRange", "de", "de-AT") and not meets("x", "rdf:PlainLiteral", "rdf:langRange", "de", "den")
    assert meets("5", "xsd:integer", "xsd:pattern", "5") is None
    with pytest.raises(ValueError):
        meets("a", "xsd:string", "xsd:length", "-1")
    allowed = lambda base, facet: one.select(facets.allowed(F.lit(base), F.lit(facet)).alias("m")).first().m
    assert allowed("xsd:byte", "xsd:minInclusive") and not allowed("xsd:byte", "xsd:pattern") and allowed("xsd:token", "xsd:pattern") and not allowed("xsd:boolean", "xsd:length")
    lexical = [("a  b", "xsd:token", False), ("a b", "xsd:token", True), ("a\tb", "xsd:normalizedString", False), ("1a", "xsd:Name", False), (":a", "xsd:Name", True), (":a", "xsd:NCName", False), ("YQ==", "xsd:base64Binary", True),
               ("YR==", "xsd:base64Binary", False), ("2024-01-01T00:00:00", "xsd:dateTimeStamp", False), ("1.2", "xsd:NMTOKEN", True)]
    rows = spark.createDataFrame(lexical, "lex string, dt string, ok boolean")
    assert rows.where(literals.valid(F.col("lex"), F.col("dt")) != F.col("ok")).collect() == []
    assert [r.ok for r in spark.createDataFrame([("de-AT",), ("d_e",), (None,)], "l string").select(literals.valid_language(F.col("l")).alias("ok")).collect()] == [True, False, True]
