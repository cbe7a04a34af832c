import itertools
import random

import pytest

from ontoloom.operators import abox, el, features, rbox, rules, taxonomy, types
from ontoloom.plans.fixpoint import Deferred, closure, components, fixpoint
from ontoloom.sources import answers, ofn, owlxml, triples
from ontoloom.streaming import incremental


def brute_closure(edges):
    got = set(edges)
    while True:
        new = {(a, d) for a, b in got for c, d in edges if b == c} - got
        if not new:
            return got
        got |= new


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


def pairs(df):
    return {tuple(r) for r in df.collect()}


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "sub string, sup string")


def test_closure_of_cyclic_graphs(spark):
    edges = random_edges(1, 14, 20)
    assert pairs(closure(edges_df(spark, edges), "sub", "sup")) == brute_closure(edges)


def test_fixpoint_defers_instead_of_answering_in_part(spark):
    seed = spark.createDataFrame([(0,)], "x long")
    with pytest.raises(Deferred):
        fixpoint(seed, lambda delta, known: delta.selectExpr("x + 1 as x"), max_rounds=3)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (11, 11)]
    assert pairs(components(spark.createDataFrame(edges, "a long, b long"))) == {(1, 1), (2, 1), (3, 1), *((i, 4) for i in range(4, 10)), (11, 11)}


def test_updates_equal_fresh_closures(spark):
    edges = random_edges(5, 12, 16)
    gone, new = edges[::5], [("n1", "z"), ("z", "n3")]
    told = edges_df(spark, edges)
    closed = closure(told, "sub", "sup")
    assert pairs(incremental.add_edges(closed, edges_df(spark, new))) == brute_closure(edges + new)
    left = [e for e in edges if e not in gone]
    assert pairs(incremental.remove_edges(told, closed, edges_df(spark, gone))) == brute_closure(left)


def test_session_follows_a_stream(spark, tmp_path):
    edges = [("a", "b"), ("b", "c")]
    session = incremental.Session(spark, edges_df(spark, edges))
    (tmp_path / "ops").mkdir()
    (tmp_path / "ops" / "1.json").write_text('{"revision": 1, "op": "add", "sub": "c", "sup": "d"}\n{"revision": 2, "op": "remove", "sub": "a", "sup": "b"}\n')
    session.follow(str(tmp_path / "ops"), str(tmp_path / "cp")).awaitTermination(60)
    assert session.revision == 1 and pairs(session.closed) == {("b", "c"), ("c", "d"), ("b", "d")}


def test_el_is_blind_to_order_and_copies(spark):
    rows = [("A", "B"), ("B", "C"), ("C", "owl:Nothing")]
    def run(rows):
        kb = el.ELAxioms(spark, nf1=edges_df(spark, rows))
        symbols = kb.symbols()
        return pairs(el.readout(el.complete(kb, symbols), symbols))
    assert run(rows) == run(rows[::-1] + rows) == {("A", "owl:Nothing"), ("B", "owl:Nothing"), ("C", "owl:Nothing")}


def models_say(gcis, some, every, names):
    """Subsumptions by brute force over all sets of names: the greatest set of types with witnesses."""
    good = [frozenset(c) for n in range(len(names) + 1) for c in itertools.combinations(names, n)]
    good = {t for t in good if all(not set(b) <= t or set(h) & t for b, h in gcis)}
    while True:
        fits = lambda t, u, r: all(y in u for x, s, y in every if s == r and x in t)
        new = {t for t in good if all(any(b in u and fits(t, u, r) for u in good) for a, r, b in some if a in t)}
        if new == good:
            break
        good = new
    out = set()
    for a in names:
        own = [t for t in good if a in t]
        if not own:
            out.add((a, "owl:Nothing"))
        else:
            out |= {(a, b) for b in names if a != b and all(b in t for t in own)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_types_against_all_models(spark, seed):
    rng = random.Random(seed)
    names = ["A", "B", "C", "D", "E"]
    pick = lambda lo, hi: rng.sample(names, rng.randrange(lo, hi))
    gcis = [(pick(1, 3), pick(0, 3) if rng.random() < 0.3 else pick(1, 3)) for _ in range(4)]
    some = [(rng.choice(names), "r", rng.choice(names)) for _ in range(2)]
    every = [(rng.choice(names), "r", rng.choice(names)) for _ in range(2)]
    g = spark.createDataFrame([(i, b, h) for i, (b, h) in enumerate(gcis)], "id long, body array<string>, head array<string>")
    s, e = (spark.createDataFrame(x, "a string, role string, b string") for x in (some, every))
    assert pairs(types.subsumptions(types.alive_types(g, s, e, names), names)) == models_say(gcis, some, every, names)


def test_functional_merging_propagates(spark):
    facts = [("f", 1, 10), ("f", 1, 11), ("f", 10, 20), ("f", 11, 21), ("g", 5, 6)]
    got = abox.same_functional(spark.createDataFrame(facts, "role string, src long, dst long"), spark.createDataFrame([("f",)], "role string"))
    assert pairs(got) == {(10, 10), (11, 10), (20, 20), (21, 20)}


def test_rules_chain(spark):
    a = rules.Atom
    facts = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 3, 4)], "pred string, s long, o long")
    got = rules.chase(facts, [rules.Rule((a("p", "?x", "?y"), a("p", "?y", "?z")), a("p", "?x", "?z"))])
    assert {(s, o) for _, s, o in pairs(got)} == brute_closure([(1, 2), (2, 3), (3, 4)])


def test_ofn_text(spark):
    text = 'Prefix(:=<http://e/#>)\nOntology(<http://e> # note (\n SubClassOf(:A ObjectSomeValuesFrom(:r ObjectIntersectionOf(:B :C))) AnnotationAssertion(rdfs:label :A "a ) \\" b"@en))'
    assert ofn.axioms_of(text) == [
        ("Prefix", [":", "=", "<http://e/#>"]),
        ("SubClassOf", [":A", "ObjectSomeValuesFrom(:r ObjectIntersectionOf(:B :C))"]),
        ("AnnotationAssertion", ["rdfs:label", ":A", '"a ) \\" b"@en']),
    ]
    with pytest.raises(ValueError):
        ofn.axioms_of("Ontology(SubClassOf(:A :B)")
    assert [ofn.sniff(x) for x in ("Prefix(:=<x>)", '<?xml version="1.0"?>', "<http://a> <http://b> <http://c> .", "@prefix : <x> .")] == ["ofn", "xml", "turtle", "turtle"]


def test_clauses_and_lines(spark, tmp_path):
    atom = '{"kind": "concept", "name": "%s", "t1": {"kind": "var", "name": "x"}}'
    (tmp_path / "c.json").write_text('{"clauses": [{"body": [%s], "head": [%s, %s]}, {"body": [], "head": [%s]}]}' % tuple(atom % n for n in "ABCD"))
    clauses = answers.read_clauses(spark, str(tmp_path / "c.json"))
    assert clauses.count() == 2 and el.is_el(clauses).first().is_el is False
    shape = features.clause_shapes(clauses).first()
    assert (shape.n_clauses, shape.max_head, shape.n_concepts, shape.n_horn) == (2, 2, 4, 1)
    lines = answers.lines(edges_df(spark, [("A", "B"), ("C", "owl:Nothing")]))
    assert {r.value for r in lines.collect()} == {"SUB\tA\tB", "UNSAT\tC"}
    assert answers.json_rows(edges_df(spark, [("A", "B")])).first().value == '{"class":"A","subsumptions":["B"],"unsatisfiable":false}'


def test_explanations_are_minimal(spark):
    told = spark.createDataFrame([(1, "A", "B"), (2, "B", "C"), (3, "A", "C"), (4, "C", "A")], "id long, sub string, sup string")
    assert {tuple(r.axioms) for r in taxonomy.justifications(told, "A", "C").collect()} == {(3,), (1, 2)}


def test_irregular_chains(spark):
    chains = spark.createDataFrame([("r", "s", "s"), ("s", "r", "t")], "first string, second string, sup string")
    none = spark.createDataFrame([], "sub string, sup string")
    assert rbox.irregular(none, chains).count() == 0
    assert {r.role for r in rbox.irregular(edges_df(spark, [("t", "r")]), chains).collect()} == {"s", "t"}


def test_owlxml_and_functional_syntax_agree(spark):
    xml = """<Ontology xmlns="http://www.w3.org/2002/07/owl#"><Prefix name="" IRI="http://e/"/><Declaration><Class IRI="http://e/A"/></Declaration>
    <SubClassOf><Class IRI="http://e/A"/><ObjectSomeValuesFrom><ObjectProperty IRI="http://e/r"/><Class abbreviatedIRI=":B"/></ObjectSomeValuesFrom></SubClassOf>
    <SubClassOf><Class abbreviatedIRI=":B"/><ObjectMinCardinality cardinality="2"><ObjectProperty abbreviatedIRI=":r"/></ObjectMinCardinality></SubClassOf></Ontology>"""
    text = "Prefix(:=<http://e/>) Ontology(Declaration(Class(<http://e/A>)) SubClassOf(<http://e/A> ObjectSomeValuesFrom(<http://e/r> :B)) SubClassOf(:B ObjectMinCardinality(2 :r)))"
    assert owlxml.axioms_of(xml) == ofn.axioms_of(text)


def test_turtle_triples_become_axioms(spark):
    text = """@prefix : <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
    :A a owl:Class ; rdfs:subClassOf :B , [ a owl:Restriction ; owl:onProperty :r ; owl:someValuesFrom :C ] . # note
    :r a owl:ObjectProperty, owl:TransitiveProperty . :x a :A ; :r :y . :x :odd "v"@en ."""
    got, rest = triples.axioms(triples.parse_rows(spark.createDataFrame([("o", text)], "ontology string, value string")))
    rows = {(r.head, tuple(r.args)) for r in got.collect()}
    e = lambda x: f"<http://e/{x}>"
    assert rows == {
        ("Declaration", (f"Class({e('A')})",)), ("Declaration", (f"ObjectProperty({e('r')})",)), ("SubClassOf", (e("A"), e("B"))), ("TransitiveObjectProperty", (e("r"),)),
        ("SubClassOf", (e("A"), f"ObjectSomeValuesFrom({e('r')} {e('C')})")), ("ClassAssertion", (e("A"), e("x"))), ("ObjectPropertyAssertion", (e("r"), e("x"), e("y"))),
    }
    assert [(r.p, r.o) for r in rest.collect()] == [(e("odd"), '"v"@en')]
