"""Diagnostics as anti-joins over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_static_imports(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows of files that have no static import: those bring names that are not modelled."""
    return rows.join(imports.where("kind in ('STATIC', 'STATIC_ON_DEMAND')").select("source").distinct(), "source", "left_anti")


def without_superclass(rows: DataFrame, chain: DataFrame, scopes: DataFrame, decls: DataFrame) -> DataFrame:
    """Rows (source, scope_id, ..) not inside a type with a superclass."""
    owner = scopes.select("source", F.col("scope_id").alias("ancestor_id"), F.col("owner_id").alias("decl_id"))
    heirs = decls.where("kind = 'TYPE' and type_name is not null").select("source", "decl_id")
    inside = chain.join(owner.join(heirs, ["source", "decl_id"]), ["source", "ancestor_id"]).select("source", "scope_id").distinct()
    return rows.join(inside, ["source", "scope_id"], "left_anti")


def without_receivers(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names that are not the receiver of a field access or call."""
    used = nodes.where("kind in ('FIELD_ACCESS', 'METHOD_CALL') and receiver_id is not null").select("source", F.col("receiver_id").alias("node_id")).distinct()
    return names.join(used, ["source", "node_id"], "left_anti")


def unresolved_names(nodes: DataFrame, imports: DataFrame, chain: DataFrame, scopes: DataFrame, decls: DataFrame, variables: DataFrame) -> DataFrame:
    """One error for each bare name that no variable of its file answers."""
    names = without_static_imports(nodes.where("kind = 'NAME_REF'"), imports)
    names = without_receivers(without_superclass(names, chain, scopes, decls), nodes)
    missing = names.join(variables.select("source", F.col("ref_id").alias("node_id")).distinct(), ["source", "node_id"], "left_anti")
    return missing.select("source", "node_id", "start_at", "end_at", F.lit("ERROR").alias("severity"), F.lit("cannot-find-symbol").alias("code"), F.concat(F.lit("cannot find symbol: "), "name").alias("message"))


def publish_rows(diagnostics: DataFrame, places: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Diagnostics with line and character ranges (unknown ones are the zero range), the numeric
    severity, the tool's tag and the document's version."""
    rows = diagnostics.join(places, ["source", "start_at", "end_at"], "left")
    for c in ("start_line", "start_character", "end_line", "end_character"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    levels = F.create_map(*[F.lit(x) for kv in (("ERROR", 1), ("WARNING", 2), ("INFORMATION", 3), ("HINT", 4)) for x in kv])
    rows = rows.withColumn("level", levels[F.col("severity")]).withColumn("tag", F.lit("java"))
    return rows if versions is None else rows.join(versions.select("source", "version"), "source", "left")
