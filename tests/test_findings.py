"""Small cases of the reviewer's findings, on rows of their own."""

from pyspark.sql import functions as F

from spanwright.operators import imports as B
from spanwright.operators import pairs
from spanwright.operators import resolve as R
from spanwright.operators import scopes as SC
from spanwright.plans import catalog
from spanwright.sources import tables as A


def orders_of(spark, tmp_path, rows):
    """A folder whose table of orders has the given (o_orderkey, o_custkey)."""
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_goto_locations_goes_to_each_class_of_the_name(spark, tmp_path):
    # file 1: T3 extends T4, T4 extends T5, T4 extends T5, T39 extends T0; file 40: T1 extends T1, T7 extends T7 of a uri that is no file's
    folder = orders_of(spark, tmp_path, [(3, 1), (4, 1), (44, 1), (39, 1), (1, 40), (7, 40)])
    got = sorted(map(tuple, catalog.queries()["r12_goto_locations"](spark, folder).collect()), key=str)
    one, forty = "file:///src/c1.java", "file:///src/c40.java"
    want = [(1, forty, 0, 6, 0, 8), (3, one, 1, 6, 1, 8), (3, one, 3, 6, 3, 8), (39, None, None, None, None, None), (4, None, None, None, None, None), (44, None, None, None, None, None), (7, None, None, None, None, None)]
    assert got == sorted(want, key=str)


def test_written_types_have_all_their_targets_and_primitives_none(spark):
    files = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", None)], "source string, package string")
    scopes = spark.createDataFrame([(s, 0, None, None) for s in "abc"] + [("a", 1, 0, 10)], "source string, scope_id long, parent_id long, owner_id long")
    types = [("a", 10, "A", 0), ("a", 11, "In", 1), ("b", 20, "B", 0), ("b", 21, "Two", 0), ("c", 30, "Two", 0), ("a", 12, "Two", 1), ("b", 22, "int", 0)]
    decls = spark.createDataFrame([(s, k, "TYPE", n, at) for s, k, n, at in types], "source string, decl_id long, kind string, name string, scope_id long")
    twice = decls.unionByName(spark.createDataFrame([("a", 13, "TYPE", "Both", 0), ("b", 23, "TYPE", "Both", 0)], decls.schema))
    imports = spark.createDataFrame([("c", 1, "p.B", "TYPE")], "source string, ord long, name string, kind string")
    asked = [("a", 1, 1, "In", False), ("a", 2, 1, "Two", None), ("a", 3, 0, "Two", False), ("a", 4, 1, "Both", False), ("b", 5, 0, "Both", False), ("c", 6, 0, "B", False), ("c", 7, 0, "A", False), ("b", 8, 0, "int", True), ("b", 9, 0, "int", False), ("b", 10, 0, "p.B", False)]
    refs = spark.createDataFrame(asked, "source string, ref_id long, scope_id long, name string, type_primitive boolean")
    chain, canonical = SC.scope_chain(scopes), R.canonical_types(twice, scopes, files)
    got = sorted(tuple(r) for r in R.resolve_type_refs(refs, chain, twice, imports, files, canonical).select("ref_id", "target_source", "target_id", "stage").collect())
    assert got == [(1, "a", 11, 1), (2, "a", 12, 1), (3, "b", 21, 3), (4, "a", 13, 1), (5, "b", 23, 1), (6, "b", 20, 2), (9, "b", 22, 1)]
    # without the file's own type the package has both
    far = refs.where("ref_id = 5").withColumn("source", F.lit("d"))
    more = files.unionByName(spark.createDataFrame([("d", "p")], files.schema))
    chain = SC.scope_chain(scopes.unionByName(spark.createDataFrame([("d", 0, None, None)], scopes.schema)))
    every = refs.unionByName(far)
    listed = R.resolve_type_refs(every, chain, twice, imports, more, canonical)
    assert sorted((r.target_source, r.target_id) for r in listed.where("source = 'd'").collect()) == [("a", 13), ("b", 23)]
    told = R.resolve_type_refs(every, chain, twice, imports, more, canonical, False).select("source", "ref_id", "stage", "targets", "ids", "first_source", "first_id")
    want = listed.groupBy("source", "ref_id").agg(F.first("stage").alias("stage"), F.count("target_id").alias("targets"), F.sum("target_id").alias("ids"), F.min(F.struct("target_source", "target_id")).alias("t")).select("source", "ref_id", "stage", "targets", "ids", "t.*")
    assert sorted(tuple(r) for r in told.collect()) == sorted(tuple(r) for r in want.collect())


def test_what_a_write_shuffled_is_removed_before_the_query_ends(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(A, "collected", asked.append)
    monkeypatch.setattr(A, "SLOW", 0)
    A.materialize(spark.range(9).groupBy((F.col("id") % 3).alias("k")).count(), "few")
    assert asked == [spark]


def test_direct_supertypes_are_read_once_for_all_rounds(spark):
    direct = spark.createDataFrame([(k, k + 1) for k in range(5)], "type long, super long")
    made = []

    def materialize(df, label):
        made.append(df._jdf.queryExecution().analyzed().toString().count("LogicalRDD"))
        return A.materialize(df, label)

    got = sorted((r["type"], r["super"]) for r in B.supertypes(direct, materialize).collect())
    assert got == [(a, b) for a in range(5) for b in range(a + 1, 6)]
    assert made[0] == 1 and not any(made[1:])


def test_both_sides_of_pairs_are_written_before_they_are_counted(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(pairs, "materialize", lambda df, label: labels.append(label) or A.materialize(df, label))
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "r long, k string")
    known = spark.createDataFrame([("a", 7), ("a", 8), ("c", 9), (None, 10)], "k string, t long")
    out = pairs.paired(rows, known, ["k"])
    assert labels == ["rows", "known", "many"]
    assert sorted((r.r, r.t) for r in out.collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]
