"""Facts from source texts (source, contents); comments and literals are blanked first.

A text is read by its lexical states: code, a line or block comment, a string, a character, a text block.
Each leaves code at its opening mark and comes back at its end, so a scan for the first mark from where
the last state ended tells them all (:func:`lexical_pieces`); what is not closed goes to the end of its
line, or of the text.  Blanks have the length of what they stand for, so offsets stay true."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .spans import nest_tokens

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
_QUALIFIED = rf"{_NAME}(?:\s*\.\s*{_NAME})*"
#: Pieces that are no code, in the order in which they are tried at a place.
_PIECE = "|".join(
    (
        r"//[^\n]*+",
        r"/\*(?s:.*?)(?:\*/|\z)",
        r'"""[^"\\]*+(?:(?:\\(?s:.)|"(?!""))[^"\\]*+)*+(?:"""|\z)',
        r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+(?:"|\\?(?=\n|\z))',
        r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+(?:'|\\?(?=\n|\z))",
    )
)


def lexical_pieces(contents: Column) -> tuple[Column, Column]:
    """The stretches of code, and the comments and literals between them: one fewer."""
    return F.split(contents, _PIECE, -1), F.regexp_extract_all(contents, F.lit(f"({_PIECE})"), F.lit(0))


def blanked(contents: Column) -> Column:
    """Code as it stands, all else as blanks of the same length; line ends stay."""
    code, other = lexical_pieces(contents)
    blank = F.transform(other, lambda p: F.regexp_replace(p, r"[^\n]", " "))
    return F.array_join(F.zip_with(code, blank, lambda c, b: F.concat(c, F.coalesce(b, F.lit("")))), "")


def _clean(texts: DataFrame) -> DataFrame:
    return texts.select("source", blanked(F.col("contents")).alias("contents"))


def extract_package(texts: DataFrame) -> DataFrame:
    """(source, package): the dotted name of the package declaration, or null."""
    found = F.regexp_extract("contents", rf"(?<![\w$.])package\s+({_QUALIFIED})\s*;", 1)
    return _clean(texts).select("source", F.when(found != "", F.regexp_replace(found, r"\s", "")).alias("package"))


def extract_imports(texts: DataFrame) -> DataFrame:
    """(source, ord, name, kind) of each import in order; those without a name are dropped."""
    rows = _clean(texts).select("source", F.posexplode(F.regexp_extract_all("contents", F.lit(r"(?<![\w$.])import\s[^;]*;"), F.lit(0))).alias("ord", "line"))
    static, star = F.col("line").rlike(r"^import\s+static\s"), F.col("line").rlike(r"\.\s*\*\s*;")
    module = F.col("line").rlike(rf"^import\s+module\s+{_NAME}")
    name = F.regexp_replace(F.regexp_extract("line", rf"^import\s+(?:static\s+|module\s+(?={_NAME}))?({_QUALIFIED})", 1), r"\s", "")
    kind = F.when(module, "MODULE").when(static & star, "STATIC_ON_DEMAND").when(static, "STATIC").when(star, "TYPE_ON_DEMAND").otherwise("TYPE")
    return rows.select("source", F.col("ord").cast("long").alias("ord"), name.alias("name"), kind.alias("kind")).where("name <> ''")


def extract_types(texts: DataFrame) -> DataFrame:
    """Headers of classes, interfaces, enums, records and annotation interfaces with a body: kind,
    name, superclass head, where the header, the name and the body start and where the body ends, the depth of
    its brace, and the header of the type around it.  The bodies of types are brackets of their own, so the type
    around one is its parent among them: no type is paired with the others of its file.  Texts are read once, dealt
    over all tasks, as the work on one is far more than its size tells.  A header reaches its body, so it is
    looked for only between an opening brace and what ends the statement before."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    header = rf"(?:@\s*interface|(?<![\w$.])(?:class|interface|enum|record))\s+{_NAME}[^{{}};]*"
    between, braces = F.split("contents", "[{}]", -1), F.regexp_extract_all("contents", F.lit("([{}])"), F.lit(0))

    def brace(code, mark):
        head = F.when(mark == "{", F.regexp_extract(F.substring_index(code, ";", -1), header, 0)).otherwise("")
        return F.struct((F.length(code) + 1).cast("long").alias("size"), F.when(mark == "{", 1).otherwise(-1).alias("step"), head.alias("token"))

    found = _clean(texts.repartition(parts, "source")).select("source", F.posexplode(F.zip_with(F.slice(between, 1, F.size(braces)), braces, brace)).alias("n", "b"))
    found = found.select("source", (F.sum("b.size").over(W.partitionBy("source").orderBy("n")) - 1).alias("at"), "b.step", "b.token")
    bodies = nest_tokens(materialize(found, "braces").repartition("source"))
    kind = F.regexp_replace(F.regexp_extract("token", r"^(@\s*interface|\w+)", 1), r"\s", "")
    lead = F.regexp_extract("token", r"^((?:@\s*interface|\w+)\s+)", 1)
    base = F.when(kind == "class", F.regexp_extract("token", rf"\bextends\s+({_QUALIFIED})", 1))
    at = F.col("start_at") - F.length("token")
    rows = bodies.where("token <> ''").select(
        "source", at.alias("header_at"), F.col("start_at").alias("body_at"), F.col("end_at").alias("body_end"), "depth", kind.alias("kind"), F.regexp_extract("token", rf"^(?:@\s*interface|\w+)\s+({_NAME})", 1).alias("name"),
        (at + F.length(lead)).alias("name_at"), F.when(base != "", F.regexp_replace(base, r"\s", "")).alias("superclass"),
    )
    rows = materialize(rows, "types")
    bracket = F.explode(F.array(F.struct(F.col("body_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("body_end").alias("at"), F.lit(-1).alias("step")))).alias("b")
    inside = nest_tokens(rows.select("source", F.lit("").alias("token"), bracket).select("source", "token", "b.at", "b.step"))
    inside = inside.select("source", F.col("start_at").alias("body_at"), F.col("parent_at").alias("outer_body"))
    outer = rows.select("source", F.col("body_at").alias("outer_body"), F.col("header_at").alias("enclosing_at"))
    return rows.join(inside, ["source", "body_at"]).join(outer, ["source", "outer_body"], "left").drop("outer_body")
