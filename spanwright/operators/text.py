"""Byte offsets, lines and UTF-16 columns of texts (source, contents)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_table(texts: DataFrame) -> DataFrame:
    """(source, line, start_at, text): a line starts at 0 and after each newline, also a final one."""
    lines = texts.select("source", F.posexplode(F.split("contents", "\n", -1)).alias("line", "text"))
    before = W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text").cast("long") + 1).over(before), F.lit(0))
    return lines.withColumn("start_at", start).select("source", F.col("line").cast("long").alias("line"), "start_at", "text")


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def _first_bytes(text: Column, n: Column) -> Column:
    """The first ``n`` bytes of a text, null if they end inside a character."""
    cut = F.substring(F.encode(text, "UTF-8"), F.lit(1), n.cast("int"))
    return F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string"))


def offset_to_line_column(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Points (source, at, ..) with ``line`` and ``character``: the last line that starts at or before
    the offset; an offset beyond the end counts as the end; one inside a character gives null.
    Unknown sources give null."""
    extra = [c for c in points.columns if c not in ("source", "at")]
    v = F.struct("line", "start_at", "text")
    a = lines.select("source", F.col("start_at").alias("at"), v.alias("v"), *[F.lit(None).alias(c) for c in extra], F.lit(False).alias("_point"))
    b = points.select("source", "at", F.lit(None).cast(a.schema["v"].dataType).alias("v"), *extra, F.lit(True).alias("_point"))
    order = W.partitionBy("source").orderBy("at", "_point").rowsBetween(W.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("v", F.last("v", ignorenulls=True).over(order)).where("_point")
    inside = F.least(F.col("at") - F.col("v.start_at"), F.octet_length("v.text").cast("long"))
    character = utf16_length(_first_bytes(F.col("v.text"), inside)).cast("long")
    return rows.select("source", "at", *extra, F.when(character.isNotNull(), F.col("v.line")).alias("line"), character.alias("character"))


def span_to_line_columns(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans (source, start_at, end_at) with both ends as lines and characters, in one pass."""
    ends = spans.select("source", "start_at", "end_at", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("start_at").alias("at")), F.struct(F.lit(1).alias("e"), F.col("end_at").alias("at")))).alias("p"))
    ends = ends.select("source", F.col("p.at").alias("at"), F.col("p.e").alias("e"), "start_at", "end_at")
    at = offset_to_line_column(ends, lines)

    def pick(e: int, c: str) -> Column:
        return F.max(F.when(F.col("e") == e, F.col(c)))

    return at.groupBy("source", "start_at", "end_at").agg(
        pick(0, "line").alias("start_line"), pick(0, "character").alias("start_character"), pick(1, "line").alias("end_line"), pick(1, "character").alias("end_character")
    )


def line_column_to_offset(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Points (source, line, character, ..) with ``at``; null if there is no such line, beyond its
    end (a final carriage return is not part of it), or inside a surrogate pair."""
    rows = points.join(lines, ["source", "line"], "left")
    text = F.regexp_replace("text", "\r$", "")
    folded = F.aggregate(
        F.filter(F.split(text, ""), lambda ch: ch != ""),
        F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("b")),
        lambda acc, ch: F.when(acc["u"] >= F.col("character"), acc).otherwise(
            F.struct((acc["u"] + F.when(F.octet_length(ch) == 4, 2).otherwise(1)).alias("u"), (acc["b"] + F.octet_length(ch)).alias("b"))
        ),
    )
    rows = rows.withColumn("_f", folded)
    return rows.withColumn("at", F.when(F.col("_f.u") == F.col("character"), F.col("start_at") + F.col("_f.b"))).drop("_f", "text", "start_at")


def span_text(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans with the ``text`` under their bytes."""
    part = F.substring(F.encode("contents", "UTF-8"), (F.col("start_at") + 1).cast("int"), (F.col("end_at") - F.col("start_at")).cast("int"))
    return spans.join(texts, "source").withColumn("text", F.decode(part, "UTF-8")).drop("contents")
