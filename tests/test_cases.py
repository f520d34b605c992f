"""Small literal cases whose results are known."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from spanwright.functions import names as N
from spanwright.operators import extract as X
from spanwright.operators import imports as B
from spanwright.operators import lines as M
from spanwright.operators import navigate as NV
from spanwright.operators import resolve as R
from spanwright.operators import scopes as SC
from spanwright.operators import segments as G
from spanwright.operators import spans as P
from spanwright.operators import text as T
from spanwright.operators import versions as V
from spanwright.sources import tables as A
from spanwright.streaming import edits as ST

LOG = "key string, revision long, seq long, deleted boolean, value string"


def test_as_of_chain_and_tombstone(spark):
    log = spark.createDataFrame([("a", 1, 1, False, "v1"), ("a", 3, 2, False, "v3"), ("b", 1, 3, False, "x"), ("b", 2, 4, True, None)], LOG)
    probes = spark.createDataFrame([("a", k) for k in (0, 1, 2, 3, 9)] + [("b", k) for k in (1, 2, 3)], "key string, at long")
    got = {(r.key, r.at): r.value for r in V.as_of_join(probes, log).collect()}
    assert got == {("a", 0): None, ("a", 1): "v1", ("a", 2): "v1", ("a", 3): "v3", ("a", 9): "v3", ("b", 1): "x", ("b", 2): None, ("b", 3): None}
    assert [r.key for r in V.heads(log).collect()] == ["a"]


def test_hot_key_is_cut_into_segments(spark):
    """One key has nine tenths of the rows: its segments are spread, and what is carried over them counts."""
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.9 else r.choice(("a", "b", None)), r.randrange(3000), n, r.random() < 0.3, f"v{n}") for n in range(4000)]
    rows = list({(k, a): (k, a, n, d, None if d else v) for k, a, n, d, v in rows}.values())
    probes = [(k, at) for k in ("hot", "a", "b", "none") for at in range(-5, 3100, 13)] + [("hot", 700)] * 500
    got = V.as_of_join(spark.createDataFrame([(k, a, n) for n, (k, a) in enumerate(probes)], "key string, at long, request long"), spark.createDataFrame(rows, LOG))
    history = {}
    for k, a, _, gone, v in sorted(rows, key=lambda x: x[1]):
        history.setdefault(k, []).append((a, None if gone else v))

    def newest(k, at):
        seen = [v for a, v in history.get(k, []) if a <= at]
        return seen[-1] if seen else None

    assert sorted((x.request, x.key, x["at"], x.value) for x in got.collect()) == [(n, k, a, newest(k, a)) for n, (k, a) in enumerate(probes)]
    log = spark.createDataFrame(rows, LOG)
    sizes = {x["key"]: x["count"] for x in G.segmented(log, "key", "revision", 8).groupBy("key", "_segment").count().groupBy("key").agg(F.count("*").alias("count")).collect()}
    assert sizes["hot"] >= 7 and sizes["a"] == sizes["b"] == sizes[None] == 1
    kept, late = ST.late_policy(log.select("key", "revision", "seq"))
    top, want = {}, set()
    for k, a, n, _, _ in sorted(rows, key=lambda x: x[2]):
        if a < top.get(k, -1):
            want.add(n)
        top[k] = max(a, top.get(k, -1))
    assert {x.seq for x in late.collect()} == want and {x.seq for x in kept.collect()} == {x[2] for x in rows} - want


def test_unknown_delete_and_same_revision(spark):
    log = spark.createDataFrame([("c", 1, 1, True, None), ("d", 1, 2, False, "p"), ("d", 1, 3, False, "q")], LOG)
    assert V.drop_noop_deletes(log).where("key = 'c'").count() == 0
    assert V.compact_same_revision(log).where("key = 'd'").first().value == "q"


def test_vacuum_leaves_snapshots(spark):
    rows = [("a", 1, 1, False, "1"), ("a", 4, 2, False, "4"), ("a", 6, 3, True, None), ("b", 2, 4, False, "2"), ("b", 3, 5, True, None), ("b", 9, 6, False, "9")]
    log = spark.createDataFrame(rows, LOG)
    kept = V.vacuum(log, 5)
    assert kept.count() < log.count()
    for r in (5, 6, 8, 9, 20):
        assert sorted(map(tuple, V.snapshot_at(kept, r).collect())) == sorted(map(tuple, V.snapshot_at(log, r).collect()))


def test_lines_and_columns(spark):
    texts = spark.createDataFrame([("t", "a\nbb\nccc"), ("u", "a😀b"), ("w", "ab\r\nc"), ("x", "abc"), ("e", "")], "source string, contents string")
    lines = T.line_table(texts)
    assert [r.start_at for r in lines.where("source = 't'").orderBy("line").collect()] == [0, 2, 5]
    points = spark.createDataFrame([("t", 4), ("t", 99), ("u", 5), ("u", 2), ("e", 0)], "source string, at long")
    got = {(r.source, r.at): (r.line, r.character) for r in T.offset_to_line_column(points, lines).collect()}
    assert got == {("t", 4): (1, 2), ("t", 99): (2, 3), ("u", 5): (0, 3), ("u", 2): (None, None), ("e", 0): (0, 0)}
    asked = [("u", 0, 2), ("u", 0, 3), ("u", 0, 4), ("w", 0, 2), ("w", 1, 0), ("w", 0, 3), ("x", 0, 4), ("x", 1, 0), ("e", 0, 0)]
    back = {(r.source, r.line, r.character): r["at"] for r in T.line_column_to_offset(spark.createDataFrame(asked, "source string, line long, character long"), lines).collect()}
    assert [back[a] for a in asked] == [None, 5, 6, 2, 4, None, None, None, 0]


def test_names(spark):
    row = spark.range(1).select(
        N.package_of(F.lit("org.acme.app.Foo$Inner")).alias("p"), N.simple_name(F.lit("org.acme.app.Foo$Inner")).alias("s"), N.package_of(F.lit("Foo")).alias("q"),
        N.uri_to_path(F.lit("file:///home/my%20project/Foo.java")).alias("u"), N.uri_to_path(F.lit("untitled:x")).alias("n"), N.path_to_uri(F.lit("SOURCE_FILE"), F.lit("/a b")).alias("b"),
        N.strip_package(F.array(F.lit("p"), F.lit("Outer")), F.array(F.lit("p"))).alias("a"), N.strip_package(F.array(F.lit("p")), F.array(F.lit("q"))).alias("z"),
    ).first()
    assert tuple(row) == ("org.acme.app", "Inner", "", "/home/my project/Foo.java", None, None, ["Outer"], None)


def test_right_edge_hits(spark):
    spans = spark.createDataFrame([("f", 0, 9000, "SCOPE", 1, 3), ("f", 10, 14, "DECLARATION", 2, 1), ("f", 10, 14, "NODE", 3, 5)], "source string, start_at long, end_at long, entity_kind string, entity_id long, ord int")
    points = spark.createDataFrame([("f", 14), ("f", 15), ("f", 10)], "source string, at long")
    got = {r["at"]: r.entity_id for r in P.tightest_containing(points, spans, ["source", "at"]).collect()}
    assert got == {14: 2, 15: 1, 10: 2}
    assert P.containing(points, spans, closed=False).where("at = 14").count() == 1


def test_tightest_by_levels(spark):
    """Spans of all widths against a walk over all of them: points that only a wide span has, or none has."""
    rng = random.Random(5)
    columns = "source string, start_at long, end_at long, entity_kind string, entity_id long, ord int"
    spans, points = [], []
    for k in range(300):
        start, width = rng.randrange(20_000), rng.choice([0, 1, 5, 63, 64, 65, 900, 1023, 1024, 5_000])
        spans.append((f"f{k % 3}", start, start + width, "NODE", k, k % 4))
    spans += [("f0", 0, 1 << 40, "SCOPE", 1000, 3), ("f0", 0, 1 << 40, "SCOPE", 1001, 2), ("f3", 10, 1 << 20, "SCOPE", 1002, 0)]
    for k in range(400):
        points.append((f"f{k % 4}", k, rng.randrange(30_000)))
    points += [("f9", 900, 5), ("f0", 901, None), (None, 902, 5), ("f0", 903, 1 << 39), ("f0", 903, 1 << 39)]
    want = {}
    for source, key, at in points:
        around = [(e - s, s, e, o, i) for src, s, e, _, i, o in spans if at is not None and src == source and s <= at <= e]
        if around:
            want[key] = min(around)[-1]
    table = spark.createDataFrame(points, "source string, request_id long, at long")
    found = P.tightest_containing(table, spark.createDataFrame(spans, columns), ["source", "request_id"]).collect()
    assert {r.request_id: r.entity_id for r in found} == want and len(found) == len(want) and want[903] == 1001
    assert P.tightest_containing(table, spark.createDataFrame([], columns), ["source", "request_id"]).count() == 0
    assert P.tightest_containing(table.limit(0), spark.createDataFrame(spans, columns), ["source", "request_id"]).count() == 0


def test_scope_chain_by_doubling(spark):
    """A deep tree, a wide one and a forest give every pair of a scope and one above, with its distance."""
    parents = {("deep", k): k - 1 if k else None for k in range(13)} | {("wide", k): 0 if k else None for k in range(20)}
    parents |= {("forest", k): k - 5 if k >= 5 else None for k in range(23)}
    want = set()
    for (source, k) in parents:
        at, steps = k, 0
        while at is not None:
            want.add((source, k, at, steps))
            at, steps = parents[source, at], steps + 1
    rows = spark.createDataFrame([(s, k, p) for (s, k), p in parents.items()], "source string, scope_id long, parent_id long")
    got = [tuple(r) for r in SC.scope_chain(rows).select("source", "scope_id", "ancestor_id", "distance").collect()]
    assert len(got) == len(want) and set(got) == want


def test_extraction(spark):
    text = 'package a . b;\nimport x.Y;\nimport static x.Y.*;\nimport z.*;\n// class No {\nclass A extends B<C> {\n String s = "class Z {";\n interface I { }\n}\n'
    texts = spark.createDataFrame([("f", text), ("g", "class Q { }")], "source string, contents string")
    assert {r.source: r.package for r in X.extract_package(texts).collect()} == {"f": "a.b", "g": None}
    assert [(r.name, r.kind) for r in X.extract_imports(texts).orderBy("ord").collect()] == [("x.Y", "TYPE"), ("x.Y", "STATIC_ON_DEMAND"), ("z", "TYPE_ON_DEMAND")]
    types = {r.name: r for r in X.extract_types(texts).collect()}
    assert set(types) == {"A", "I", "Q"} and types["A"].superclass == "B" and types["I"].enclosing_at == types["A"].header_at


def test_lexical_states(spark):
    """Marks within other states are no marks; what is not closed ends with its line or the text."""
    cases = {
        "/*\nimport x.Y;\n*/ import a.B;": (None, [("a.B", "TYPE")]),
        "// package q;\npackage a;": ("a", []),
        "package /* . */ a . /* b */ b;\nimport a.B; import static c.D.*; import module m.n;": ("a.b", [("a.B", "TYPE"), ("c.D", "STATIC_ON_DEMAND"), ("m.n", "MODULE")]),
        'String s = "import a.B;"; char c = \'"\'; import c.D;': (None, [("c.D", "TYPE")]),
        'String s = "\\" import a.B;"; import c.D;': (None, [("c.D", "TYPE")]),
        'String s = """\n import a.B; "" \\""" // \n"""; import c.D;': (None, [("c.D", "TYPE")]),
        'String s = "open // \nimport c.D;': (None, [("c.D", "TYPE")]),
        "char c = '\\'; \nimport c.D;": (None, [("c.D", "TYPE")]),
        "import c.D; /* import a.B;": (None, [("c.D", "TYPE")]),
        'import c.D; """ import a.B;': (None, [("c.D", "TYPE")]),
        "/* // */ import c.D; // /* \nimport e.F; /**/ import g.H;": (None, [("c.D", "TYPE"), ("e.F", "TYPE"), ("g.H", "TYPE")]),
        "x.import y; $import z; reimport w; import v;": (None, [("v", "TYPE")]),
        "": (None, []),
    }
    texts = spark.createDataFrame([(str(k), t) for k, t in enumerate(cases)] + [("long", "/*" + "x\n" * 100_000 + '*/ "' + "\\t" * 50_000 + '" package a;')], "source string, contents string")
    packages = {r.source: r.package for r in X.extract_package(texts).collect()}
    imports = {}
    for r in X.extract_imports(texts).orderBy("ord").collect():
        imports.setdefault(r.source, []).append((r.name, r.kind))
    for k, (text, (package, names)) in enumerate(cases.items()):
        assert (packages[str(k)], imports.get(str(k), [])) == (package, names), text
    assert packages["long"] == "a"
    lengths = texts.select(F.length("contents") == F.length(X.blanked(F.col("contents")))).distinct().collect()
    assert [r[0] for r in lengths] == [True]


def test_types_know_the_type_around_them(spark):
    text = 'class A { void m() { class L { } } /* } */ enum E { X { } ; record R(int a) { } } @interface N { String v() default "}"; } }\ninterface B { }\nclass Open {'
    rows = X.extract_types(spark.createDataFrame([("f", text)], "source string, contents string")).collect()
    by = {r.header_at: r.name for r in rows}
    assert {(r.name, r.kind, by.get(r.enclosing_at)) for r in rows} == {("A", "class", None), ("L", "class", "A"), ("E", "enum", "A"), ("R", "record", "E"), ("N", "@interface", "A"), ("B", "interface", None)}
    for r in rows:
        assert text[r.name_at :].startswith(r.name) and text[r.header_at :].startswith(r.kind) and text[r.body_at] == "{" and text[r.body_end] == "}"


def test_line_cleanup(spark):
    lines = ["x", "# Chapter 1", "", "", "", "", '<div class="a"><em>t</em> ®', '<a href="jls-6.html#p" accesskey="n">six</a>', '<div class="navfooter">', "# Chapter 2"]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(lines)], "doc long, pos long, line string")
    body = M.rewrite_links(M.clean_lines(M.slice_body(df)), [("jls-6.html", "ch06-names.md")], "jls")
    out = M.assemble(M.collapse_blanks(body)).first()
    assert out.text == "# Chapter 1\n\n\nt\n[six](ch06-names.md#p)\n"


def test_supertypes_end_on_cycles(spark):
    direct = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "type long, super long")
    got = {(r.type, r["super"]) for r in B.supertypes(direct, A.materialize).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 1), (4, 2), (4, 3)}


def test_goto(spark):
    text = "class A {\n int x;\n int y = x;\n}\n"
    lines = T.line_table(spark.createDataFrame([("/w/A.java", text)], "source string, contents string"))
    use = text.index("x;", text.index("y"))
    target = [("/w/A.java", use, text.index("x"), text.index("x") + 1)]
    known = spark.createDataFrame(target, "source string, at long, name_start long, name_end long")

    def resolve(points):
        return points.join(known, ["source", "at"]).select("request_id", "source", "at", F.col("source").alias("target_source"), F.lit(1).alias("target_id"), "name_start", "name_end")

    asked = spark.createDataFrame([(1, "file:///w/A.java", 2, 9), (2, "file:///w/A.java", 0, 0), (3, "git:x", 0, 0)], "request_id long, uri string, line long, character long")
    got = {r.request_id: r.locations for r in NV.goto_locations(asked, lines, resolve).collect()}
    assert got[2] is None and got[3] is None
    assert [(x.uri, tuple(x.start), tuple(x.end)) for x in got[1]] == [("file:///w/A.java", (1, 5), (1, 6))]


def test_files_and_trace(spark, tmp_path):
    (tmp_path / "src/my dir").mkdir(parents=True)
    (tmp_path / "src/my dir/A+.java").write_text("class A {\n}\n")
    rows = A.scan_sources(spark, f"{tmp_path}/src").collect()
    assert [(r.source.path, r.contents) for r in rows] == [(f"{tmp_path}/src/my dir/A+.java", "class A {\n}\n")]
    A.write_trace(spark.createDataFrame([("in", 1500, "m")], "dir string, at long, msg string"), f"{tmp_path}/trace")
    back = A.scan_trace(spark, f"{tmp_path}/trace").first()
    assert back.msg == "m" and back.time.timestamp() == 1.5


def _feed(tmp_path, schema, parts):
    """A stream in which each part arrives as a batch of its own, run by the given function."""

    def run(spark, name, start):
        folder = tmp_path / name
        folder.mkdir()
        names = [c.split()[0] for c in schema.split(", ")]
        for k, part in enumerate(parts):
            (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, e, strict=True))) for e in part))
            start(spark.readStream.schema(schema).json(str(folder)))

    return run


def test_edit_streams(spark, tmp_path):
    feed = _feed(tmp_path, ST.EVENTS, [[(1, "OPEN", "u", 1, ["a"]), (2, "CHANGE", "u", 2, ["b", "c"]), (3, "CHANGE", "u", 3, [])], [(4, "OPEN", "v", 1, ["z"]), (5, "CLOSE", "v", None, [])]])
    feed(spark, "in", lambda s: ST.run_batches(ST.edit_stream(s), f"{tmp_path}/c1", ST.append_versions(f"{tmp_path}/log")))
    assert sorted((r.source, r.revision, r.contents) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("u", 1, "a"), ("u", 2, "c"), ("v", 4, "z")]


LATE = [[("u", 5, 1, "five"), ("u", 3, 2, "late at once"), ("v", 1, 3, "one")], [("u", 4, 4, "late"), ("u", 5, 5, "again"), ("w", 9, 6, "w")], [("u", 4, 7, "late?"), ("v", 1, 8, "same"), ("v", 0, 9, "late")]]


def test_late_rows_go_aside(spark, tmp_path):
    feed = _feed(tmp_path, "source string, revision long, seq long, contents string", LATE)
    feed(spark, "in", lambda s: ST.run_batches(ST.heads_stream(s, every=True), f"{tmp_path}/c", ST.split_late(f"{tmp_path}/out"), "update", True))
    texts = lambda part: sorted(r.contents for r in spark.read.parquet(f"{tmp_path}/out/{part}").collect())
    assert texts("late") == ["late", "late", "late at once", "late?"]
    assert texts("kept") == ["again", "five", "one", "same", "w"]
    assert spark.conf.get(ST._PROVIDER).endswith("HDFSBackedStateStoreProvider")  # the session is as it was


def test_idle_state_expires(spark, tmp_path):
    """Timers make batches without data: the query goes on until nothing is held of u any more."""
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    names = ("source", "revision", "seq", "contents")

    def arrive(k, rows):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        (tmp_path / f"{k}.json").rename(folder / f"{k}.json")
        for _ in range(60):
            time.sleep(0.5)
            seen = [r.seq for part in ("kept", "late") for r in (spark.read.schema("seq long").parquet(f"{out}/{part}").collect() if os.path.isdir(f"{out}/{part}") else [])]
            if {r[2] for r in rows} <= set(seen):
                return
        raise AssertionError("the rows did not come")

    stream = spark.readStream.schema("source string, revision long, seq long, contents string").json(str(folder))
    before = spark.conf.get(ST._PROVIDER)
    spark.conf.set(ST._PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    heads = ST.heads_stream(stream, every=True, expire_ms=1500)
    query = heads.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").foreachBatch(ST.split_late(out)).start()
    spark.conf.set(ST._PROVIDER, before)
    try:
        arrive(0, [("u", 5, 1, "five"), ("u", 3, 2, "late")])
        time.sleep(8)
        arrive(1, [("u", 4, 3, "first again")])
    finally:
        query.stop()
    assert [r.contents for r in spark.read.parquet(f"{out}/late").collect()] == ["late"]


def test_diagnostics_follow_edits(spark, tmp_path):
    """A text's error goes when another text declares the name, and comes back when that is edited."""
    parts = [
        [(1, "OPEN", "a", 7, ["class A extends B { }"]), (2, "OPEN", "x", 1, ["class X extends A { }"])],
        [(3, "OPEN", "b", 1, ["class B { }"])],
        [(4, "CHANGE", "b", 2, ["class C { }"]), (5, "CLOSE", "x", None, [])],
    ]
    seen, asked = [], []

    def facts(texts):
        types = X.extract_types(texts)
        rows = types.select("source", F.lit("DECLARES").alias("kind"), "name", F.col("name_at").alias("start_at"), F.col("name_at").alias("end_at"))
        return rows.unionByName(types.where("superclass is not null").select("source", F.lit("WANTS").alias("kind"), F.col("superclass").alias("name"), F.col("name_at").alias("start_at"), F.col("body_at").alias("end_at")))

    def diagnose(wants, declares):
        asked.append(sorted({r.source for r in wants.collect()}))
        return wants.join(declares.select("name").distinct(), "name", "left_anti").select("source", "start_at", "end_at", F.lit("x").alias("code"), F.col("name").alias("message"))

    def start(stream):
        ST.diagnostics_stream(stream, f"{tmp_path}/c", f"{tmp_path}/d", facts, diagnose, 4)
        seen.append(sorted((r.source, r.version, r.message) for r in spark.read.parquet(f"{tmp_path}/d/published").collect()))

    # rows of the future are in the log from the start, and no batch sees them
    ahead = spark.createDataFrame([(99, "CHANGE", "a", 9, ["class A { }"])], ST.EVENTS)
    ahead.write.parquet(f"{tmp_path}/d/log/batch=50")
    _feed(tmp_path, ST.EVENTS, parts)(spark, "in", start)
    assert seen == [
        [("a", 7, "B"), ("x", 1, None)],
        [("a", 7, None), ("b", 1, None), ("x", 1, None)],
        [("a", 7, "B"), ("b", 2, None), ("x", None, None)],
    ]
    assert asked == [["a", "x"], ["a"], ["a", "x"]]  # b's edits ask for its dependants too, and only for those


def test_replacing_twice_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame(list(x), "source string, n int")
    sources = lambda *x: spark.createDataFrame([(s,) for s in x], "source string")
    now = lambda: sorted((r.source, r.n) for r in spark.read.parquet(path).collect())
    A.replace_in_buckets(path, rows(("a", 1), ("a", 2), ("b", 3), ("c", 4)), sources("a", "b", "c"), 3)
    for _ in range(2):
        A.replace_in_buckets(path, rows(("a", 9), ("z", 1)), sources("a", "b"), 3)  # z is none of the sources
        assert now() == [("a", 9), ("c", 4)]
    for _ in range(2):
        A.replace_in_buckets(path, rows(), sources("c"), 3)
        assert now() == [("a", 9)]


def test_receivers(spark):
    """``this``, created types, calls without a receiver, static access, and chains of them."""
    decls = spark.createDataFrame(
        [("f", 1, "TYPE", "A", 0, 10, None), ("f", 2, "FIELD", "b", 10, None, "B"), ("f", 3, "METHOD", "go", 10, 11, "B"), ("g", 1, "TYPE", "B", 0, 20, None), ("g", 2, "FIELD", "a", 20, None, "A")],
        "source string, decl_id long, kind string, name string, scope_id long, body_scope_id long, type_name string",
    )
    nodes = spark.createDataFrame(
        [
            ("f", 1, "THIS", None, None, 11), ("f", 2, "FIELD_ACCESS", "b", 1, 11), ("f", 3, "FIELD_ACCESS", "a", 2, 11), ("f", 4, "OBJECT_CREATION", None, None, 11), ("f", 5, "FIELD_ACCESS", "a", 4, 11),
            ("f", 6, "METHOD_CALL", "go", None, 11), ("f", 7, "FIELD_ACCESS", "a", 6, 11), ("f", 8, "NAME_REF", "B", None, 11), ("f", 9, "FIELD_ACCESS", "a", 8, 11), ("f", 10, "FIELD_ACCESS", "no", 9, 11),
        ],
        "source string, node_id long, kind string, name string, receiver_id long, scope_id long",
    )
    enclosing = spark.createDataFrame([("f", 10, 1), ("f", 11, 1), ("g", 20, 1)], "source string, scope_id long, type_id long")
    declared = spark.createDataFrame([("f", 2, "g", 1), ("f", 3, "g", 1), ("g", 2, "f", 1)], "source string, decl_id long, class_source string, class_id long")
    none = spark.createDataFrame([], "source string, ref_id long, target_source string, target_id long")
    types = spark.createDataFrame([("f", 8, 1, "g", 1)], "source string, ref_id long, targets long, first_source string, first_id long")
    created = spark.createDataFrame([("f", 4, "g", 1)], "source string, node_id long, class_source string, class_id long")
    found = R.receiver_class(nodes, none, types, declared, enclosing, decls, created)
    assert {r.node_id: (r.class_source, r.class_id) for r in found.collect()} == {1: ("f", 1), 2: ("g", 1), 3: ("f", 1), 4: ("g", 1), 5: ("f", 1), 6: ("g", 1), 7: ("f", 1), 8: ("g", 1), 9: ("f", 1)}
    members = R.resolve_members(nodes, found, enclosing, decls)
    assert {r.ref_id: (r.target_source, r.target_id) for r in members.collect()} == {2: ("f", 2), 3: ("g", 2), 5: ("g", 2), 6: ("f", 3), 7: ("g", 2), 9: ("g", 2)}


def test_members_of_the_nearest_supertypes(spark):
    decls = spark.createDataFrame(
        [("s", k, "TYPE", f"T{k}", 0, 10 * k) for k in range(1, 6)] + [("s", 100, "FIELD", "x", 20, None), ("s", 101, "FIELD", "x", 30, None), ("s", 102, "FIELD", "x", 40, None), ("s", 103, "FIELD", "y", 40, None)],
        "source string, decl_id long, kind string, name string, scope_id long, body_scope_id long",
    )
    # 1 extends 2 and 3, which extend 4; 4 extends 1
    direct = spark.createDataFrame([("s", 1, "s", 2), ("s", 1, "s", 3), ("s", 2, "s", 4), ("s", 3, "s", 4), ("s", 4, "s", 1)], "source string, decl_id long, super_source string, super_id long")
    owners = spark.createDataFrame([("s", k, n) for k in (1, 2, 4, 5) for n in "xyz"], "owner_source string, owner_id long, name string")
    got = {(r.owner_id, r.name, r.member_id, r.steps) for r in R.find_inherited_members(owners, decls, direct, "VARIABLE").collect()}
    assert got == {(1, "x", 100, 1), (1, "x", 101, 1), (1, "y", 103, 2), (2, "x", 100, 0), (2, "y", 103, 1), (4, "x", 102, 0), (4, "y", 103, 0)}
