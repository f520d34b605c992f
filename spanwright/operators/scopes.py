"""The scope tree: chains of enclosing scopes and what they declare.

Tables: ``scopes`` (source, scope_id, parent_id, owner_id, ..), ``decls`` (source, decl_id, kind, name,
scope_id, body_scope_id, type_name, name_start, ..), ``files`` (source, package)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize


def scope_chain(scopes: DataFrame) -> DataFrame:
    """(source, scope_id, ancestor_id, distance), itself at 0.  Pointer doubling: pairs at the distance
    reached so far are jumps, and each round joins them with the nearer pairs of where they end, so a tree of
    depth d takes log2 d rounds, each of them one join and one written table."""
    scopes = materialize(scopes.select("source", "scope_id", "parent_id"), "scopes")
    own = scopes.select("source", "scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    above = scopes.where("parent_id is not null").select("source", "scope_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    jumps, reach = above, 1
    while True:
        onward = above.select("source", F.col("scope_id").alias("_to"), F.col("ancestor_id").alias("_next"), F.col("distance").alias("_more"))
        more = jumps.withColumnRenamed("ancestor_id", "_to").join(onward, ["source", "_to"])
        more = materialize(more.select("source", "scope_id", F.col("_next").alias("ancestor_id"), (F.col("distance") + F.col("_more")).alias("distance")), "chains")
        if more.isEmpty():
            return own.unionByName(above)
        above, reach = above.unionByName(more), 2 * reach
        jumps = more.where(F.col("distance") == reach)


def chain_of(asked: DataFrame, scopes: DataFrame) -> DataFrame:
    """:func:`scope_chain` of some scopes (source, scope_id) only, step by step: where few are asked, the
    others' pairs are not made."""
    scopes = materialize(scopes.select("source", "scope_id", "parent_id"), "scopes")
    at = asked.select("source", "scope_id").distinct().join(scopes, ["source", "scope_id"])
    at = materialize(at.select("source", "scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("distance"), "parent_id"), "chains")
    above = scopes.where("parent_id is not null").select("source", F.col("scope_id").alias("ancestor_id"), "parent_id")
    out = at.drop("parent_id")
    while True:
        up = at.where("parent_id is not null").select("source", "scope_id", F.col("parent_id").alias("ancestor_id"), (F.col("distance") + 1).alias("distance"))
        if up.isEmpty():
            return out
        out = out.unionByName(up)
        at = materialize(up.join(above, ["source", "ancestor_id"]), "chains")


def declaration_chain(chain: DataFrame, decls: DataFrame) -> DataFrame:
    """Every declaration that each scope sees up its chain, with its distance."""
    d = decls.withColumnRenamed("scope_id", "ancestor_id")
    return chain.join(d, ["source", "ancestor_id"])


def enclosing_type(chain: DataFrame, scopes: DataFrame, decls: DataFrame) -> DataFrame:
    """(source, scope_id, type_id): the nearest type whose body encloses the scope."""
    owner = scopes.where("owner_id is not null").select("source", F.col("scope_id").alias("ancestor_id"), F.col("owner_id").alias("decl_id"))
    types = decls.where("kind = 'TYPE'").select("source", "decl_id")
    found = chain.join(owner.join(types, ["source", "decl_id"]), ["source", "ancestor_id"])
    return found.groupBy("source", "scope_id").agg(F.min_by("decl_id", "distance").alias("type_id"))


def declaration_label(decls: DataFrame, scopes: DataFrame, files: DataFrame, chain: DataFrame, keep: tuple = ()) -> DataFrame:
    """(source, decl_id, label, and the columns ``keep`` of the declaration): package, enclosing types and name
    of a type, the bare name of anything else; null without a name, also of an enclosing type.  Only types
    meet the chain, of which those of their scopes are needed."""
    types = decls.where("kind = 'TYPE'")
    owner = scopes.select("source", F.col("scope_id").alias("ancestor_id"), "owner_id")
    named = types.select("source", F.col("decl_id").alias("owner_id"), F.col("name").alias("owner_name"), F.lit(True).alias("is_type"))
    up = types.select("source", "decl_id", "scope_id").join(chain, ["source", "scope_id"]).join(owner.where("owner_id is not null"), ["source", "ancestor_id"], "left").join(named, ["source", "owner_id"], "left")
    near = W.partitionBy("source", "decl_id").orderBy("distance")
    up = up.withColumn("run", F.min(F.coalesce("is_type", F.lit(False))).over(near)).where("run")
    path = up.groupBy("source", "decl_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("distance", "owner_name")), False), lambda x: x["owner_name"]).alias("outer")
    )
    rows = decls.where("coalesce(kind, 'TYPE') = 'TYPE'").join(path, ["source", "decl_id"], "left").join(files, "source", "left")
    parts = F.concat(F.coalesce("outer", F.array().cast("array<string>")), F.array("name"))
    complete = ~F.exists(parts, lambda x: x.isNull())
    label = F.when(complete, F.concat_ws(".", "package", F.array_join(parts, ".")))
    plain = decls.where("kind <> 'TYPE'").select("source", "decl_id", F.col("name").alias("label"), *keep)
    return plain.unionByName(rows.select("source", "decl_id", label.alias("label"), *keep))


def label_at(spans: DataFrame | None, labels: DataFrame) -> DataFrame:
    """Spans (source, name_start), or without them every place where a declaration is named, with the label of
    the first declaration there; ``labels`` (source, decl_id, label, name_start)."""
    first = labels.where("name_start is not null").groupBy("source", "name_start")
    first = first.agg(F.min(F.struct("decl_id", "label")).alias("_f")).select("source", "name_start", "_f.decl_id", "_f.label")
    return first if spans is None else spans.join(first, ["source", "name_start"], "left")


def declaration_facts(decls: DataFrame) -> DataFrame:
    """Each declaration's name, namespace, declaring scope, owned type reference, and the spans of itself and
    of its name; constructors have no name, and what has none has no span of it."""
    kind = F.col("kind")
    space = F.when(kind.isin("TYPE", "TYPE_PARAM"), "TYPE").when(kind.isin("METHOD", "CONSTRUCTOR"), "METHOD").otherwise("VARIABLE")
    name = F.when(kind != "CONSTRUCTOR", F.col("name"))
    spot = F.when(name.isNotNull(), F.col("name_start"))
    return decls.select("source", "decl_id", "kind", name.alias("name"), space.alias("namespace"), "scope_id", "type_name", "start_at", "end_at", spot.alias("name_start"), (spot + F.octet_length(name)).alias("name_end"))


def declarations_by_id(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Lists of ids (request_id, source, ids) to their declarations (.., pos), in the lists' order; an id that
    the source does not have is left out, one that is listed twice comes twice."""
    rows = asked.select("request_id", "source", F.posexplode("ids").alias("pos", "decl_id"))
    return rows.join(facts, ["source", "decl_id"])
