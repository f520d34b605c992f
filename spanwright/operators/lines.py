"""Line clean-up of converted documents: rows (doc, pos, line)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What is replaced in a line, in this order (pattern, replacement).
LINE_RULES = (
    (r"^\s*<div[^>]*>", ""),
    (r"</div>", ""),
    (r"<span[^>]*>", ""),
    (r"</span>", ""),
    (r"</?em>", ""),
    (r"\s*®", ""),
    (r"\*\*Table of Contents\*\*", "## Contents"),
    (r' accesskey="[^"]*"', ""),
    (r'<a href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)"),
)
START, STOP = "# Chapter", '<div class="navfooter">'


def slice_body(lines: DataFrame, start: str = START, stop: str = STOP) -> DataFrame:
    """From the first line that begins with ``start`` up to (without) the first that begins with
    ``stop``, which also ends a document that never started."""
    far = F.lit(2**62)
    edges = lines.groupBy("doc").agg(
        F.min(F.when(F.col("line").startswith(start), F.col("pos"))).alias("_a"), F.coalesce(F.min(F.when(F.col("line").startswith(stop), F.col("pos"))), far).alias("_b")
    )
    return lines.join(edges, "doc").where("pos >= _a and pos < _b").drop("_a", "_b")


def clean_line(line: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), LINE_RULES, line)


def clean_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", clean_line(F.col("line")))


def rewrite_links(lines: DataFrame, mapping: list[tuple[str, str]], prefix: str) -> DataFrame:
    """Plain replacement of each name in the table's order, then what is left of ``prefix-N.html#``
    becomes ``#``."""
    line = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), mapping, F.col("line"))
    return lines.withColumn("line", F.regexp_replace(line, rf"{prefix}-[0-9]+\.html#", "#"))


def collapse_blanks(lines: DataFrame, most: int = 2) -> DataFrame:
    """At most ``most`` of consecutive empty lines stay."""
    order = W.partitionBy("doc").orderBy("pos")
    island = F.sum(F.when(F.col("line") != "", 1).otherwise(0)).over(order)
    rows = lines.withColumn("_island", island)
    nth = F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(W.partitionBy("doc", "_island").orderBy("pos"))
    return rows.withColumn("_nth", nth).where(f"line <> '' or _nth <= {most}").drop("_island", "_nth")


def assemble(lines: DataFrame) -> DataFrame:
    """(doc, text, n_lines): lines joined by newlines, with a final one."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy("doc").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).alias("text"), F.count("line").alias("n_lines"))


def chapter_file(num, slug) -> Column:
    return F.format_string("ch%02d-%s.md", num, slug)


def toc(chapters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The table of contents of chapters (num, slug, title): one line each, in order."""
    line = F.format_string("%d. [%s](%s)\n", "num", "title", chapter_file("num", "slug"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("num", line.alias("line")))), lambda x: x["line"])
    return chapters.groupBy(*(by or [])).agg(F.array_join(rows, "").alias("toc"))
