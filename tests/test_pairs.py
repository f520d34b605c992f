"""Queries whose results are pairs: counts come without listing them, lists without shuffling them."""

import pytest
from pyspark.sql import functions as F

from spanwright.operators import extract as X
from spanwright.operators import imports as B
from spanwright.operators import pairs
from spanwright.operators import resolve as R
from spanwright.operators.pairs import paired
from spanwright.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_pairs(df):
    return plan(df).split("Join")[0]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Twelve files that hold one type of one name and ask for it by imports, one of them twice."""
    ids = range(12)
    canonical = spark.createDataFrame([(f"c{i}", i, f"p.T{i % 2}") for i in ids], "source string, decl_id long, canonical string")
    refs = spark.createDataFrame([(f"c{i}", 100 + i, 1, f"T{i % 3}") for i in ids], "source string, ref_id long, scope_id long, name string")
    imports = spark.createDataFrame([(f"c{i}", k, f"p.T{i % 2}", kind) for i in ids for k, kind in enumerate(("TYPE", "TYPE", "STATIC"))], "source string, ord long, name string, kind string")
    return refs, imports, canonical


def test_cut_keys_give_the_same_pairs(spark):
    left = spark.createDataFrame([(k, i) for k in ("a", "a", "b", None) for i in range(20)], "k string, i long")
    right = spark.createDataFrame([(k, j) for k, n in (("a", 30), ("b", 1), (None, 5)) for j in range(n)], "k string, j long")
    assert rows(paired(left, right, ["k"], 50)) == rows(left.join(right, "k")) == rows(paired(left, right, ["k"]))
    assert paired(left, right, ["k"], 50).columns == ["k", "i", "j"]


def test_exact_imports(corpus):
    refs, imports, canonical = corpus
    hits = R.resolve_exact_imports(refs, imports, canonical)
    assert "Exchange" not in above_pairs(hits) and "Aggregate" not in above_pairs(hits)
    want = sorted((f"c{i}", 100 + i, f"c{j}", j) for i in range(12) for j in range(12) if i % 3 == i % 2 == j % 2)
    assert rows(hits) == want
    own = R.resolve_exact_imports(refs, imports, canonical, True)
    assert rows(own) == [r for r in want if r[0] == r[2]]
    counts = {r.ref_id: r.targets for r in R.count_exact_imports(refs, imports, canonical).collect()}
    assert counts == {k: sum(r[1] == k for r in want) for k in {r[1] for r in want}}


def test_on_demand_imports(corpus):
    refs, _, canonical = corpus
    wide = refs.select("source", F.lit("p").alias("name"), F.lit("TYPE_ON_DEMAND").alias("kind"))
    hits = B.resolve_on_demand(refs, wide.unionByName(wide), canonical)
    assert "Exchange" not in above_pairs(hits) and "Aggregate" not in above_pairs(hits)
    assert rows(hits) == sorted((f"c{i}", 100 + i, f"c{j}", j) for i in range(12) for j in range(12) if i % 3 == j % 2)


def test_static_imports_are_counted_as_they_are_listed(corpus):
    refs, imports, canonical = corpus
    more = imports.select("source", "ord", F.lit("p").alias("name"), F.lit("STATIC_ON_DEMAND").alias("kind"))
    for some in (imports, more, imports.where("source < 'c4'").unionByName(more)):
        asked = (refs, some, canonical, canonical.where("decl_id <> 3"))
        listed = B.resolve_static_imports(*asked).groupBy("source", "ref_id").agg(F.count("target_id"), F.sum("target_id"))
        assert rows(B.static_import_summary(*asked)) == rows(listed) != []


@pytest.mark.parametrize("name", ["b4_qualified_names", "b7_inaccessible_imports", "r10_resolve_expressions"])
def test_pairs_are_not_shuffled(spark, small, name):
    """The last join of each listing stands right under the result, or under a union."""
    text = plan(catalog.queries()[name](spark, small))
    top = [line for line in text.split("SortMergeJoin [name")[0].splitlines()] if "b7" in name else text.split("Union")[0].splitlines()
    assert not any("Exchange" in line or "Aggregate" in line or "Window" in line for line in top)


def test_listed_owners_are_not_broadcast(spark, small):
    assert "Broadcast" not in plan(catalog.queries()["r6_find_members"](spark, small))


def test_labels_cross_the_network_once(spark, small):
    """Only types meet scopes, and places meet no declarations: they are the declarations' own."""
    text = catalog.queries()["s5_label_at"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in text and not any("Join" in line and "name_start" in line for line in text.splitlines())


def test_texts_are_read_once_by_all_tasks(spark, monkeypatch):
    """Types of forty small texts in one partition: one scan of the texts, dealt."""
    written, write = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, label: written.append((label, df.rdd.getNumPartitions(), plan(df))) or write(df, label))
    texts = spark.range(0, 40, 1, 1).selectExpr("concat('s', id) as source", "concat('class A', id, ' { ; x = new B() { }; class C extends A { } } interface D; enum E {') as contents")
    found = X.extract_types(texts)
    assert "regexp_extract_all" not in plan(found) and [w[0] for w in written] == ["braces", "types"]
    assert "REPARTITION" in written[0][2]
    got = [tuple(r) for r in found.where("source = 's7'").orderBy("header_at").select("name", "superclass", "depth", "header_at", "body_at", "enclosing_at").collect()]
    assert got == [("A7", None, 1, 0, 9, None), ("C", "A", 2, 30, 48, 0)]


@pytest.mark.parametrize("name", ["r7_resolve_variables", "b12_local_types"])
def test_scopes_are_met_where_their_file_is(spark, small, monkeypatch, name):
    """Each table is shuffled once, by file; files with more rows than one task should have go by finer keys."""
    written, write = [], pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df, label: written.append((label, plan(df))) or write(df, label))
    want = rows(catalog.queries()[name](spark, small))
    texts = [text for label, text in written if label == "by_source"]
    assert len(texts) == 1 and not any("Exchange hashpartitioning(source" in line and "scope" in line.split("hashpartitioning")[1].split(")")[0] for line in texts[0].splitlines())
    if name.startswith("r7"):
        assert texts[0].count("Exchange hashpartitioning") == 3
    assert spark.conf.get(pairs._ALL_KEYS) == "true"
    monkeypatch.setattr(pairs, "ROWS", 400)
    split = catalog.queries()[name](spark, small)
    assert "Union" in split._jdf.queryExecution().optimizedPlan().toString() and rows(split) == want != []
