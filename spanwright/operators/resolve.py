"""Name resolution for all occurrences of a corpus at once.

References are rows (source, ref_id, scope_id, name).  The stages of type resolution are joins whose
results meet in one union; the first stage with any result wins, also if it is ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import package_of, simple_name
from ..sources.tables import materialize
from .environment import contents, import_environment, summarise
from .pairs import by_source, paired

VARIABLES = ("LOCAL", "PARAMETER", "FIELD")


def project_classes(decls: DataFrame, files: DataFrame) -> DataFrame:
    """(source, fqn, kind) of each named top-level type."""
    top = decls.where("kind = 'TYPE' and scope_id = 0 and name is not null")
    kind = F.col("type_kind") if "type_kind" in decls.columns else F.lit("CLASS")
    kind = F.when(kind == "ANNOTATION_INTERFACE", "ANNOTATION").otherwise(kind)
    return top.join(files, "source").select("source", F.concat_ws(".", "package", "name").alias("fqn"), kind.alias("kind"))


def lookup_class(fqns: DataFrame, classes: DataFrame) -> DataFrame:
    """The class of each name (fqn) that is there; of several the one of the smallest source."""
    hit = classes.join(fqns.select("fqn").distinct(), "fqn", "left_semi")
    return hit.groupBy("fqn").agg(F.min_by("kind", "source").alias("kind"), F.min("source").alias("source"))


def classes_in_package(packages: DataFrame, classes: DataFrame) -> DataFrame:
    """All classes whose package is one of ``packages`` (package); nested binary names included."""
    return classes.withColumn("package", package_of("fqn")).join(packages.select("package").distinct(), "package")


def canonical_types(decls: DataFrame, scopes: DataFrame, files: DataFrame) -> DataFrame:
    """(source, decl_id, canonical): package and path of types; in a file the first declaration of
    a name within its parent wins.  One join for each level of nesting."""
    types = decls.where("kind = 'TYPE' and name is not null")
    owner = scopes.select("source", "scope_id", F.col("owner_id").alias("parent_type"))
    # scopes of files are few, and only bodies of types hold others
    top = types.where("scope_id = 0").join(owner.where("scope_id = 0"), ["source", "scope_id"])
    types = top.unionByName(types.where("scope_id <> 0").join(owner.where("scope_id <> 0 and parent_type is not null"), ["source", "scope_id"]))
    first = types.groupBy("source", "parent_type", "scope_id", "name").agg(F.min("decl_id").alias("decl_id"))
    level = first.where("scope_id = 0").join(files, "source").select("source", "decl_id", F.concat_ws(".", "package", "name").alias("canonical"))
    nested = materialize(first.where("parent_type is not null").select("source", "parent_type", "name", "decl_id"), "nested")
    out = level
    while True:
        parent = level.select("source", F.col("decl_id").alias("parent_type"), F.col("canonical").alias("outer"))
        level = nested.join(parent, ["source", "parent_type"]).select("source", "decl_id", F.concat_ws(".", "outer", "name").alias("canonical"))
        level = materialize(level, "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _nearest(hits: DataFrame) -> DataFrame:
    near = F.rank().over(W.partitionBy("source", "ref_id").orderBy("distance"))
    return hits.withColumn("_rank", near).where("_rank = 1").drop("_rank")


def resolve_lexical(refs: DataFrame, chain: DataFrame, decls: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """Types of the name in the nearest scope that has any: (source, ref_id, target_source, target_id).
    Where ``decls`` tell local types (is_local, start_at) and the references their place (at), a local
    type is seen only after its declaration.  ``inherited`` (source, scope_id, name, target_source,
    target_id) are types that scopes have from elsewhere.  Names that no scope of their file has do not
    meet the chain."""
    ordered = "is_local" in decls.columns and "at" in refs.columns
    more = ["is_local", "start_at"] if ordered else []
    types = decls.where("kind in ('TYPE', 'TYPE_PARAM')").select("source", F.col("scope_id").alias("ancestor_id"), "name", F.col("source").alias("target_source"), F.col("decl_id").alias("target_id"), *more)
    if inherited is not None:
        down = inherited.select("source", F.col("scope_id").alias("ancestor_id"), "name", "target_source", "target_id", *([F.lit(False).alias("is_local"), F.lit(None).cast("long").alias("start_at")] if ordered else []))
        types = types.unionByName(down)

    def run(refs, chain, types):
        asked = refs.join(types.select("source", "name").distinct(), ["source", "name"], "left_semi")
        hits = asked.hint("merge").join(chain, ["source", "scope_id"]).hint("merge").join(types, ["source", "ancestor_id", "name"])
        hits = _nearest(hits.where("not coalesce(is_local, false) or start_at <= at") if ordered else hits)
        return hits.select("source", "ref_id", "target_source", "target_id")

    return by_source([refs, chain, types], run)


def _single(imports: DataFrame) -> DataFrame:
    return imports.where("kind = 'TYPE'").select("source", F.col("name").alias("canonical"), simple_name("name").alias("name")).distinct()


def resolve_exact_imports(refs: DataFrame, imports: DataFrame, canonical: DataFrame, own: bool = False) -> DataFrame:
    """Single-type imports whose last segment is the name, as canonical types, each once.  References meet
    imports first; types of the names come last, as there may be very many, and are not shuffled again.
    ``own`` lists only types of the reference's file."""
    target = canonical.select("canonical", F.col("source").alias("target_source"), F.col("decl_id").alias("target_id")).distinct()
    asked = refs.select("source", "ref_id", "name").distinct().join(_single(imports), ["source", "name"]).select("source", "ref_id", "canonical")
    hits = asked.join(target.withColumn("source", F.col("target_source")), ["source", "canonical"]) if own else paired(asked, target, ["canonical"])
    return hits.select("source", "ref_id", "target_source", "target_id")


def count_exact_imports(refs: DataFrame, imports: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source, ref_id, targets) of references that single-type imports answer.  A type has one canonical name,
    so types are counted by name before they meet imports."""
    told = canonical.select("canonical", "source", "decl_id").distinct().groupBy("canonical").agg(F.count("decl_id").alias("n"))
    brought = _single(imports).join(told, "canonical").groupBy("source", "name").agg(F.sum("n").alias("targets"))
    return refs.select("source", "ref_id", "name").join(brought, ["source", "name"]).groupBy("source", "ref_id").agg(F.sum("targets").alias("targets"))


def resolve_same_package(refs: DataFrame, files: DataFrame, decls: DataFrame, own: bool = False) -> DataFrame:
    """All top-level types of the name in files of the same package; the unnamed one is a package.
    Null packages are replaced by a value no package has, so they spread by name over the tasks.
    ``own`` lists only types of the reference's file."""
    keyed = files.select("source", F.coalesce("package", F.lit("\0")).alias("package"))
    top = decls.where("kind = 'TYPE' and scope_id = 0").join(keyed, "source")
    target = top.select("package", "name", F.col("source").alias("target_source"), F.col("decl_id").alias("target_id")).distinct()
    asked = refs.join(keyed, "source").select("source", "ref_id", "package", "name")
    hits = asked.join(target.withColumn("source", F.col("target_source")).drop("package"), ["source", "name"]) if own else paired(asked, target, ["package", "name"])
    return hits.select("source", "ref_id", "target_source", "target_id")


def classify(refs: DataFrame, counts: DataFrame) -> DataFrame:
    """References with the number of distinct targets (``counts``: source, ref_id, targets) and UNRESOLVED,
    RESOLVED or AMBIGUOUS."""
    rows = refs.select("source", "ref_id").join(counts.select("source", "ref_id", "targets"), ["source", "ref_id"], "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    return rows.withColumn("result", F.when(F.col("targets") == 0, "UNRESOLVED").when(F.col("targets") == 1, "RESOLVED").otherwise("AMBIGUOUS"))


def resolve_type_names(refs: DataFrame, chain: DataFrame, decls: DataFrame, imports: DataFrame, files: DataFrame, canonical: DataFrame, more: list[DataFrame] | None = None, own: bool = False) -> DataFrame:
    """Candidates (.., stage) of the first stage with a result: 1 lexical, 2 exact imports, 3 same
    package, then ``more``.  Qualified names have none.  A stage is only asked for what no stage before it
    answers, so candidates, of which there may be far more than references, are listed once and not compared.  ``own``
    lists only those of them that the first stage with a result has in the reference's file."""
    refs = refs.where("name is not null and not contains(name, '.')").select("source", "ref_id", "scope_id", "name").distinct()
    inner = materialize(resolve_lexical(refs, chain, decls).distinct(), "lexical")
    left = refs.join(inner.select("source", "ref_id"), ["source", "ref_id"], "left_anti")
    brought = _single(imports).join(canonical.select("canonical"), "canonical", "left_semi").select("source", "name").distinct()
    left = materialize(left.join(brought.withColumn("_brought", F.lit(True)), ["source", "name"], "left"), "left")
    exact = resolve_exact_imports(left.where("_brought"), imports, canonical, own)
    left = left.where("_brought is null").drop("_brought")
    keyed = files.select("source", F.coalesce("package", F.lit("\0")).alias("package"))
    rows = inner.withColumn("stage", F.lit(1)).unionByName(exact.withColumn("stage", F.lit(2)))
    rows = rows.unionByName(resolve_same_package(left, files, decls, own).withColumn("stage", F.lit(3)))
    top = decls.where("kind = 'TYPE' and scope_id = 0").join(keyed, "source").select("package", "name")
    left = left.join(keyed, "source", "left").join(top, ["package", "name"], "left_anti") if more else left
    for k, s in enumerate(more or [], 4):
        s = s.join(left.select("source", "ref_id"), ["source", "ref_id"], "left_semi").select("source", "ref_id", "target_source", "target_id").distinct()
        rows = rows.unionByName((s.where("source = target_source") if own else s).withColumn("stage", F.lit(k)))
        left = left.join(s.select("source", "ref_id"), ["source", "ref_id"], "left_anti")
    return rows


def held_members(decls: DataFrame, namespace: str) -> DataFrame:
    """(owner_source, owner_id, name, member_id): the direct members of types in a namespace, all overloads."""
    kinds = ["METHOD"] if namespace == "METHOD" else list(VARIABLES) if namespace == "VARIABLE" else ["TYPE", "TYPE_PARAM"]
    body = decls.where("kind = 'TYPE'").select(F.col("source").alias("owner_source"), F.col("decl_id").alias("owner_id"), F.col("body_scope_id").alias("scope_id"))
    member = decls.where(F.col("kind").isin(kinds)).select(F.col("source").alias("owner_source"), "scope_id", "name", F.col("decl_id").alias("member_id"))
    return body.hint("merge").join(member, ["owner_source", "scope_id"]).drop("scope_id")


def find_members(owners: DataFrame, decls: DataFrame, namespace: str) -> DataFrame:
    """Owners (owner_source, owner_id, name, ..) with the direct members of that name and namespace
    (member_id), all overloads.  Owners that are listed by name are more than their table's size tells, so
    they are never sent whole to each task."""
    return owners.hint("merge").join(held_members(decls, namespace), ["owner_source", "owner_id", "name"])


def find_inherited_members(owners: DataFrame, decls: DataFrame, direct: DataFrame, namespace: str) -> DataFrame:
    """Like :func:`find_members`, and where a type has no member of the name, those of its nearest supertypes
    (``direct``: source, decl_id, super_source, super_id) that have; (.., target_source, member_id, steps).
    Each round asks one step further up, only for what is still missing; a type is asked once for each
    question, so circles end.  What a type still asks for goes up as one list, and meets the names that
    a type has; members are listed last, once."""
    asked = [c for c in owners.columns if c not in ("owner_source", "owner_id")]
    by, owner = ["_by_source", "_by_id"], ["owner_source", "owner_id"]
    held = materialize(held_members(decls, namespace).distinct(), "held")
    names = materialize(held.groupBy(*owner).agg(F.collect_set("name").alias("_has")), "names")
    edges = materialize(direct.select(F.col("source").alias("owner_source"), F.col("decl_id").alias("owner_id"), "super_source", "super_id").distinct(), "edges")
    at = owners.groupBy(*owner).agg(F.collect_set(F.struct(*asked)).alias("_asked"))
    at = materialize(at.select(F.col("owner_source").alias("_by_source"), F.col("owner_id").alias("_by_id"), *owner, "_asked"), "asked")
    seen, out, steps = at.select(*by, *owner), None, 0
    while True:
        met = at.join(names, owner, "left").withColumn("_found", F.filter("_asked", lambda q: F.coalesce(F.array_contains(F.col("_has"), q["name"]), F.lit(False))))
        met = materialize(met.select(*by, *owner, "_asked", "_found"), "found")
        hits = met.where("size(_found) > 0").select(*by, *owner, "_found", F.lit(steps).alias("steps"))
        out = hits if out is None else out.unionByName(hits)
        # what any supertype of this step has is no longer asked
        told = met.groupBy(*by).agg(F.first("_asked").alias("_asked"), F.flatten(F.collect_list("_found")).alias("_found"), F.collect_list(F.struct(*owner)).alias("_at"))
        left = told.select(*by, F.array_except("_asked", "_found").alias("_asked"), "_at").where("size(_asked) > 0").select(*by, "_asked", F.explode("_at").alias("_at")).select(*by, "_asked", "_at.*")
        up = left.join(edges, owner).select(*by, F.col("super_source").alias("owner_source"), F.col("super_id").alias("owner_id"), "_asked").dropDuplicates([*by, *owner])
        at = materialize(up.join(seen, [*by, *owner], "left_anti"), "asked")
        if at.isEmpty():
            break
        seen, steps = seen.unionByName(at.select(*by, *owner)), steps + 1
    out = out.select(*by, *owner, "steps", F.explode("_found").alias("_q")).select(*by, *owner, "steps", "_q.*")
    out = out.join(held, [*owner, "name"])
    return out.select(F.col("_by_source").alias("owner_source"), F.col("_by_id").alias("owner_id"), *asked, F.col("owner_source").alias("target_source"), "member_id", "steps")


def resolve_variables(refs: DataFrame, chain: DataFrame, decls: DataFrame) -> DataFrame:
    """Locals declared no later than the use (refs need ``at``), parameters and fields of the name in
    the nearest scope that has any; own file only."""
    d = decls.where(F.col("kind").isin(*VARIABLES)).select("source", F.col("scope_id").alias("ancestor_id"), "name", F.col("kind").alias("target_kind"), F.col("decl_id").alias("target_id"), F.col("name_start").alias("_declared"))

    def run(refs, chain, d):
        hits = refs.hint("merge").join(chain, ["source", "scope_id"]).hint("merge").join(d, ["source", "ancestor_id", "name"]).where("target_kind <> 'LOCAL' or _declared <= at")
        return _nearest(hits).select("source", "ref_id", F.col("source").alias("target_source"), "target_id", "target_kind")

    return by_source([refs, chain, d], run)


def resolve_type_refs(refs: DataFrame, chain: DataFrame, decls: DataFrame, imports: DataFrame, files: DataFrame, canonical: DataFrame, listed: bool = True) -> DataFrame:
    """Targets of written types (source, ref_id, scope_id, name, and type_primitive where it is told): none for a
    primitive, else those of the first stage with a result, the one of a resolved name and all of an ambiguous
    one, as :func:`resolve_type_names` lists them.  Of a name a package may hold very many types: without
    ``listed`` these are gathered before references meet them, and each reference with a target has one row
    (.., stage, targets, first_source, first_id, ids) that tells how many it has, the smallest, and the sum of their ids."""
    kept = refs.where("source is not null and ref_id is not null")
    kept = (kept.where("not coalesce(type_primitive, false)") if "type_primitive" in refs.columns else kept).select("source", "ref_id", "scope_id", "name")
    if listed:
        return resolve_type_names(kept, chain, decls, imports, files, canonical)
    held = materialize(contents(canonical), "contents")
    environment = import_environment(kept, files, imports.where("kind = 'TYPE'"), decls, held, None, False)
    return summarise(kept, resolve_lexical(kept, chain, decls), environment)


def receiver_class(nodes: DataFrame, variables: DataFrame, name_types: DataFrame, declared: DataFrame, enclosing: DataFrame, decls: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """(source, node_id, class_source, class_id): the class through which a member of the expression
    is looked up.  ``variables`` are targets of name references, ``name_types`` the summaries of
    their names as types, ``declared`` (source, decl_id, class_source, class_id) the first class of each
    declaration's type, ``created`` (source, node_id, class_source, class_id) that of each creation's.
    Rounds go up from the receivers: each solves the nodes whose receiver the
    round before solved, and stops when there is none.  First means smallest (source, id)."""
    first = variables.groupBy("source", "ref_id").agg(F.min("target_id").alias("decl_id"))
    names = nodes.where("kind = 'NAME_REF'").select("source", "node_id")
    by_variable = names.join(first.withColumnRenamed("ref_id", "node_id"), ["source", "node_id"]).join(declared, ["source", "decl_id"])
    only = name_types.where("targets = 1").select("source", F.col("ref_id").alias("node_id"), F.col("first_source").alias("class_source"), F.col("first_id").alias("class_id"))
    by_type = names.join(first.withColumnRenamed("ref_id", "node_id"), ["source", "node_id"], "left_anti").join(only, ["source", "node_id"])
    this = nodes.where("kind = 'THIS'").join(enclosing, ["source", "scope_id"])
    columns = ["source", "node_id", "class_source", "class_id"]
    solved = by_variable.select(*columns).unionByName(by_type.select(*columns)).unionByName(this.select("source", "node_id", F.col("source").alias("class_source"), F.col("type_id").alias("class_id")))
    if created is not None:
        solved = solved.unionByName(nodes.where("kind = 'OBJECT_CREATION'").select("source", "node_id").join(created, ["source", "node_id"]).select(*columns))
    solved = materialize(solved, "receivers")
    out = solved
    asked = nodes.where("kind in ('FIELD_ACCESS', 'METHOD_CALL')").select("source", "node_id", "kind", "name", "receiver_id", "scope_id")
    bare = asked.where("kind = 'METHOD_CALL' and receiver_id is null").join(enclosing, ["source", "scope_id"])
    frontier = bare.select("source", "node_id", "kind", "name", F.col("source").alias("owner_source"), F.col("type_id").alias("owner_id"))
    # of a type's members of a name the first counts, with the class of its type if it has one
    kinds = [held_members(decls, space).withColumn("kind", F.lit(kind)) for kind, space in (("FIELD_ACCESS", "VARIABLE"), ("METHOD_CALL", "METHOD"))]
    firsts = kinds[0].unionByName(kinds[1]).groupBy("owner_source", "owner_id", "name", "kind").agg(F.min("member_id").alias("decl_id"))
    typed = declared.select(F.col("source").alias("owner_source"), "decl_id", F.struct("class_source", "class_id").alias("_class"))
    firsts = materialize(firsts.join(typed, ["owner_source", "decl_id"], "left"), "firsts")
    while True:
        above = asked.join(solved.select("source", F.col("node_id").alias("receiver_id"), F.col("class_source").alias("owner_source"), F.col("class_id").alias("owner_id")), ["source", "receiver_id"])
        frontier = frontier.unionByName(above.select("source", "node_id", "kind", "name", "owner_source", "owner_id"))
        one = frontier.hint("merge").join(firsts, ["owner_source", "owner_id", "name", "kind"])
        one = one.groupBy("source", "node_id", "owner_source").agg(F.min(F.struct("decl_id", "_class")).alias("_m")).where("_m._class is not null")
        solved = materialize(one.select("source", "node_id", "_m._class.class_source", "_m._class.class_id"), "receivers")
        if solved.isEmpty():
            return out
        out = out.unionByName(solved)
        frontier = frontier.limit(0)


def resolve_members(nodes: DataFrame, receivers: DataFrame, enclosing: DataFrame, decls: DataFrame) -> DataFrame:
    """Targets of field accesses and calls: members of the receiver's class; a call without receiver
    looks in the enclosing type."""
    asked = nodes.where("kind in ('FIELD_ACCESS', 'METHOD_CALL')")
    through = receivers.select("source", F.col("node_id").alias("receiver_id"), F.col("class_source").alias("owner_source"), F.col("class_id").alias("owner_id"))
    owned = asked.join(through, ["source", "receiver_id"]).select("source", "node_id", "kind", "name", "owner_source", "owner_id")
    bare = asked.where("receiver_id is null").join(enclosing, ["source", "scope_id"])
    owned = owned.unionByName(bare.select("source", "node_id", "kind", "name", F.col("source").alias("owner_source"), F.col("type_id").alias("owner_id")))
    hits = find_members(owned.where("kind = 'FIELD_ACCESS'"), decls, "VARIABLE").unionByName(find_members(owned.where("kind = 'METHOD_CALL'"), decls, "METHOD"))
    return hits.select("source", F.col("node_id").alias("ref_id"), F.col("owner_source").alias("target_source"), F.col("member_id").alias("target_id"))


def resolve_expressions(variables: DataFrame, members: DataFrame, this: DataFrame, created: DataFrame) -> DataFrame:
    """Targets of all expressions: names, members, ``this`` and created types; ``created`` are other nodes than
    the rest, each target once, and may be very many."""
    columns = ["source", "ref_id", "target_source", "target_id"]
    out = variables.select(*columns)
    for part in (members, this):
        out = out.unionByName(part.select(*columns))
    return out.distinct().unionByName(created.select(*columns))
