"""Plans and rounds that must not grow faster than the input."""

import pytest

from ontoloom.operators import abox, clashes, el, rbox
from ontoloom.sources import ofn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark):
    return spark.range(1000).selectExpr("'r' AS role", "id AS src", "id % 7 AS dst")


@pytest.fixture(scope="module")
def t(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def shuffled_by_role(df):
    """Joins that move the facts by role or class, so that one task would get all facts of a role."""
    return "SortMergeJoin" in plan(df) or "CartesianProduct" in plan(df)


def test_axiom_tables_without_statistics_do_not_shuffle_facts_by_role(t, facts):
    role = t("role string", ("r",))
    assert not shuffled_by_role(rbox.domain_range(facts, t("role string, cls string", ("r", "A")), t("role string, cls string", ("r", "B"))))
    assert not shuffled_by_role(clashes.irreflexive(facts, role))
    types = facts.selectExpr("src AS ind", "'A' AS cls")
    assert plan(abox.disjoint_clash(types, t("a string, b string", ("A", "B")))).count("SortMergeJoin") <= 1  # the one by individual
    groups = t("grp int, ind long", (1, 1), (1, 2))
    assert "CartesianProduct" not in plan(clashes.too_many(facts, t("role string, most int", ("r", 1)), groups))


def test_rounds_do_not_shuffle_facts_by_role(t, facts, monkeypatch):
    steps = []
    monkeypatch.setattr(rbox, "fixpoint", lambda seed, step: steps.append((seed, step(seed, seed))) or seed)
    monkeypatch.setattr(abox, "fixpoint", lambda seed, step: steps.append((seed, step(seed, seed))) or seed)
    rbox.path_automaton(facts, t("from_state string, role string, to_state string", ("0", "r", "1")), "0", ["1"])
    none = t("role string")
    rbox.role_facts(facts, t("sub string, sup string", ("r", "s")), t("role string, inverse string"), none, none, t("first string, second string, sup string", ("r", "r", "s")))
    abox.materialize(facts.selectExpr("src AS ind", "'A' AS cls"), facts, t("sub string, sup string", ("A", "B")), t("left string, right string, sup string", ("A", "B", "C")),
                     t("role string, filler string, sup string", ("r", "A", "B")), t("role string, cls string", ("r", "A")), t("role string, cls string", ("r", "A")))
    seeds, rounds = zip(*steps)
    assert not any(shuffled_by_role(s) for s in seeds)
    # what is left to sort are joins by individual: one of a path, two of a chain, two of a conjunction and one of an existential
    assert all(plan(r).count("SortMergeJoin") <= most for r, most in zip(rounds, (1, 2, 3)))
    assert not any("CartesianProduct" in plan(r) for r in rounds)


def test_completion_starts_from_told_facts_and_leaves_out_what_holds_of_every_class(t, spark, monkeypatch):
    seeds = []
    real = el.fixpoint
    monkeypatch.setattr(el, "fixpoint", lambda seed, step: seeds.append(seed) or real(seed, step))
    axioms = el.ELAxioms(
        spark, nf1=t("sub string, sup string", ("a", "b"), ("b", "c"), ("x1", "a"), ("x2", "a"), ("x3", "a")), nf3=t("sub string, role string, filler string", ("x1", "r", "x2")),
        nf4=t("role string, filler string, sup string", ("r", "c", "d"), ("r", "x2", "e")),
    )
    symbols = axioms.symbols()
    got = {tuple(r) for r in el.readout(el.complete(axioms, symbols), symbols).collect()}
    up = {("a", "b"), ("a", "c"), ("b", "c")} | {(x, y) for x in ("x1", "x2", "x3") for y in "abc"}
    assert got == up | {("x1", "d"), ("x1", "e")}
    assert seeds[0].distinct().count() == 5 + 1 + 2 + 1  # told, the edge, what existentials ask for, top
    facts = el.complete(axioms, symbols)
    assert facts.count() == facts.distinct().count() == len(got) + 1 + 2 * symbols.count() - 1


def test_labels_of_components_are_never_broadcast(t, monkeypatch):
    from ontoloom.plans import fixpoint

    plans = []
    real = fixpoint.written
    monkeypatch.setattr(fixpoint, "written", lambda df, *by: plans.append(plan(df)) or real(df, *by))
    got = fixpoint.components(t("a long, b long", (1, 2), (2, 3), (5, 4)))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_axioms_of_a_document_are_sent_as_they_are_read():
    text = "Ontology(<http://e/o> " + "SubClassOf(:A ObjectSomeValuesFrom(:r :B)) " * 3 + "SubClassOf(:A :B"
    rows = ofn.each_axiom(text)
    assert [next(rows) for _ in range(3)] == [("SubClassOf", [":A", "ObjectSomeValuesFrom(:r :B)"])] * 3
    with pytest.raises(ValueError, match="unbalanced"):
        next(rows)
