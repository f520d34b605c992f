"""Counts that are told without listing what is counted."""

import pytest
from pyspark.sql import functions as F

from spanwright.operators import environment as E
from spanwright.operators import resolve as R
from spanwright.operators import spans as P
from spanwright.plans import catalog, graph
from spanwright.sources import tables as A


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [P.ROWS, 20])
def test_spans_around_points_are_counted_by_a_sweep(spark, monkeypatch, most):
    """One source has nearly all rows; with 20 rows a task it is cut."""
    monkeypatch.setattr(P, "ROWS", most)
    spans = spark.range(400).selectExpr(
        "if(id % 40 = 0, 'b', 'a') as source", "id * 7 % 300 as start_at", "id * 7 % 300 + id % 23 * (id % 5) - 1 as end_at", "'NODE' as entity_kind", "id as entity_id", "0 as ord"
    )
    points = spark.range(330).selectExpr("case when id % 50 = 0 then 'b' when id % 51 = 0 then null else 'a' end as source", "id as request_id", "if(id % 47 = 0, null, id) as at")
    want = P.containing(points, spans).groupBy("source", "request_id").agg(F.count("entity_id"), F.sum(F.col("end_at") - F.col("start_at")))
    got = P.count_containing(points, spans, ["source", "request_id"])
    assert got.columns == ["source", "request_id", "n", "width"]
    assert rows(got) == rows(want) != []


def test_points_do_not_meet_spans(spark, small):
    assert "Join" not in plan(catalog.queries()["p2_containing"](spark, small))


@pytest.fixture(scope="module")
def shared_names(spark):
    """Sixty files of one package, each with a type of one of two names, that import it, a member that 30 heirs
    of another name have from one type, and on demand all members of both."""
    files = spark.range(60).selectExpr("concat('c', id) as source", "if(id % 2 = 0, 'p', 'q') as package")
    own = spark.range(60).selectExpr("if(id % 2 = 0, 'p', 'q') as parent", "concat('T', id % 4) as name", "concat('c', id) as target_source", "id as target_id", "true as own", "true as is_static", "if(id % 3 = 0, 'PACKAGE', 'PUBLIC') as access", "if(id % 2 = 0, 'p', 'q') as home")
    inner = own.selectExpr("concat(parent, '.', name) as parent", "'I' as name", "target_source", "target_id + 100 as target_id", "own", "target_id % 5 <> 0 as is_static", "access", "home")
    down = inner.selectExpr("if(target_id % 8 < 4, 'p.T0', 'q.T1') as parent", "name", "target_source", "target_id", "false as own", "is_static", "access", "home").where("target_id % 7 < 4")
    held = own.unionByName(inner).unionByName(down)
    imports = spark.range(480).selectExpr(
        "concat('c', id % 60) as source", "id as ord", "concat(if(id % 3 = 0, 'p.T', 'q.T'), id % 4, if(id % 8 < 4, '.I', '')) as name",
        "case id % 4 when 0 then 'STATIC' when 1 then 'TYPE' when 2 then 'STATIC_ON_DEMAND' else 'TYPE_ON_DEMAND' end as kind",
    )
    decls = spark.range(60).selectExpr("concat('c', id) as source", "id as decl_id", "'TYPE' as kind", "concat('T', id % 4) as name", "cast(0 as bigint) as scope_id")
    return files, held, imports, decls


def test_types_of_imported_names_are_counted_once(spark, shared_names):
    files, held, imports, decls = shared_names
    asked = files.select("source", F.explode(F.array(F.lit("I"), F.lit("T1"))).alias("name"))
    keyed = files.select("source", F.col("package").alias("_package"))
    got = E.import_environment(asked, files, imports, decls, held).where("stage in (2, 4)")
    ways = imports.withColumn("static", F.expr("kind like 'STATIC%'"))
    may = "(not static or is_static) and (access = 'PUBLIC' or home = _package)"
    one = ways.where("kind in ('TYPE', 'STATIC')").withColumn("full", F.col("name")).drop("name")
    single = one.join(held.withColumn("full", F.concat_ws(".", "parent", "name")), "full").join(keyed, "source").where(may).where("own or static")
    single = single.join(asked, ["source", "name"]).withColumn("stage", F.lit(2))
    wide = ways.where("kind like '%DEMAND'").withColumnRenamed("name", "parent").join(asked, "source").join(held, ["parent", "name"]).join(keyed, "source").where(may)
    wide = wide.join(single, ["source", "name"], "left_anti").withColumn("stage", F.lit(4))
    columns = ["source", "name", "stage", "target_source", "target_id"]
    want = single.select(*columns).unionByName(wide.select(*columns)).distinct().groupBy("source", "name", "stage").agg(F.count("target_id"), F.sum("target_id"))
    packaged = E.package_summary(decls, files).join(keyed.withColumnRenamed("_package", "package"), "package").select("source", "name")
    want = want.join(packaged.withColumn("stage", F.lit(4)), ["source", "name", "stage"], "left_anti")
    assert rows(got.select("source", "name", "stage", "targets", "ids")) == rows(want) != []


def listed(df, most):
    """Whether any join of the run made more than ``most`` rows."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        if "Join" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        kids = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else []
        left += kids + [p.children().apply(i) for i in range(p.children().size())]
    return max(found) > most


def test_import_checks_do_not_list_types(spark, shared_names):
    files, held, imports, decls = shared_names
    every = A.materialize(held.crossJoin(spark.range(20)).withColumn("target_id", F.col("target_id") + 1000 * F.col("id")).drop("id"), "held")
    nothing = spark.createDataFrame([], "source string, ord long")
    checked = E.import_checks(imports, files, decls, every, nothing)
    assert rows(checked) == rows(E.import_checks(imports, files, decls, every.repartition(3), nothing)) != []
    assert not listed(checked, 4 * imports.count())


def test_members_of_supertypes_are_asked_by_lists(spark, monkeypatch):
    """A round holds a row for each type and supertype, however many names are asked."""
    decls = spark.range(20).selectExpr("'s' as source", "id as decl_id", "'TYPE' as kind", "'T' as name", "cast(0 as bigint) as scope_id", "id + 100 as body_scope_id")
    fields = spark.range(20).selectExpr("'s' as source", "id + 200 as decl_id", "'FIELD' as kind", "concat('v', id) as name", "id + 100 as scope_id", "cast(null as bigint) as body_scope_id")
    direct = spark.range(1, 20).selectExpr("'s' as source", "id as decl_id", "'s' as super_source", "id div 2 as super_id")
    owners = decls.select(F.col("source").alias("owner_source"), F.col("decl_id").alias("owner_id"), F.explode(F.array(*[F.lit(f"v{k}") for k in range(30)])).alias("name"))
    most, written = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label: most.append((label, (out := written(df, label)).count())) or out)
    got = rows(R.find_inherited_members(owners, decls.unionByName(fields), direct, "VARIABLE"))
    want = []
    for k in range(20):
        up = [k]
        while up[-1]:
            up.append(up[-1] // 2)
        want += [("s", k, f"v{t}", "s", 200 + t, n) for n, t in enumerate(up)]
    assert got == sorted(want)
    assert max(n for label, n in most if label == "asked") <= 20


def test_receivers_meet_one_member_of_a_name(spark, monkeypatch):
    """Fields that one type declares fifty times over are told apart once, not in each round."""
    columns = "source string, decl_id long, kind string, name string, scope_id long, body_scope_id long"
    decls = spark.createDataFrame([("s", 1, "TYPE", "T", 0, 10)] + [("s", 100 + k, "FIELD", "x", 10, None) for k in range(50)], columns)
    nodes = spark.createDataFrame([("s", 1, "THIS", None, None, 5), *(("s", k, "FIELD_ACCESS", "x", k - 1, 5) for k in range(2, 5))], "source string, node_id long, kind string, name string, receiver_id long, scope_id long")
    enclosing = spark.createDataFrame([("s", 5, 1)], "source string, scope_id long, type_id long")
    declared = spark.createDataFrame([("s", 100 + k, "s", 1 + k) for k in range(50)], "source string, decl_id long, class_source string, class_id long")
    nothing = spark.createDataFrame([], "source string, ref_id long, target_source string, target_id long")
    types = spark.createDataFrame([], "source string, ref_id long, targets long, first_source string, first_id long")
    calls, find = [], R.held_members
    monkeypatch.setattr(R, "held_members", lambda *a: calls.append(a) or find(*a))
    assert rows(R.receiver_class(nodes, nothing, types, declared, enclosing, decls)) == [("s", k, "s", 1) for k in range(1, 5)]
    assert len(calls) == 2


def test_views_find_all_they_read_of_line_items(spark, small, monkeypatch):
    """The table that a query writes once holds what the views read, and nothing else of the line items."""
    written, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(df) or write(df, label))
    views = [n for n in graph.VIEWS if n != "li" and "li" in graph._needed(n)]
    graph.once_for_each_query(lambda s, d: [graph.table(s, d, n).schema for n in views])(spark, small)
    assert [tuple(df.columns) for df in written] == [graph.LI]
