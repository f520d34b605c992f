"""Fill-in-the-middle: documents cut at two places and put together with the middle last.

A text is n lines; two draws from a digest of the seed and the document's id cut it into prefix,
middle and suffix.  The parts change places by *displacement*: over the bytes of a round of texts a
difference array holds, where a part begins, by how much further it moves than the part before it; its
running sum is every byte's shift, and one numpy scatter writes all outputs.  :func:`restore` reads the
parts' places off the markers in an output and gathers the bytes back by the inverse shifts.

Nothing is shuffled: a task needs its own rows only, and a lost one is run again.

A null text is empty, and empty texts and texts that spell a marker stay plain.  A null id draws as an
empty one; equal ids and texts give equal outputs.  A very long text is a round of its own.  An empty
table gives no rows.  Extra columns are ignored by :func:`fill_in_middle`; :func:`restore` keeps all
columns, and gives null where an output has not the markers that its form asks for, or form is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared as S

SEED = 7
#: Of a hundred documents, how many are transformed, and how many of those have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Marks before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
#: The order in an output of prefix (0), middle (1) and suffix (2), by form.
_PARTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Which marker stands before each part.
_MARK_OF = (0, 2, 1)


def _checked(markers: tuple[str, str, str]) -> list[np.ndarray]:
    """The markers' bytes.  None may begin within another, or an output could be read in two ways."""
    for a in markers:
        for b in markers:
            if not a or (a is not b and b in a) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")
    return [np.frombuffer(m.encode(), np.uint8) for m in markers]


def _found(data: np.ndarray, off: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Where ``mark`` begins, in order, within single texts."""
    n = len(data) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:n] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    return at[at + len(mark) <= off[np.searchsorted(off, at, "right")]]


def _strings(data: np.ndarray, off: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    nulls = None if missing is None or not missing.any() else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data), nulls)


def _shifts(size: int, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The shift of each of ``size`` bytes: parts begin at ``starts``, in order, and move by ``moves``;
    of parts that begin at one byte the last is the one that has it."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, np.diff(moves, prepend=0))
    return np.cumsum(step[:-1])


def _places(sizes: np.ndarray, forms: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each part (docs x 3) and each marker lies in the outputs, and the outputs' bounds."""
    wide = np.array([len(m) for m in marks])
    plain = forms == 0
    total = sizes.sum(axis=1) + np.where(plain, 0, wide.sum())
    off = np.concatenate([[0], np.cumsum(total)])
    part, mark = np.zeros_like(sizes), np.zeros_like(sizes)
    part[plain] = off[:-1][plain, None]  # all of a plain text is its first part
    for code, form in enumerate(FORMS):
        if form == "plain":
            continue
        rows = np.flatnonzero(forms == code)
        at = off[rows].copy()
        for p in _PARTS[form]:
            mark[rows, _MARK_OF[p]] = at
            at = at + wide[_MARK_OF[p]]
            part[rows, p] = at
            at = at + sizes[rows, p]
    return part, mark, off


def _transformer(rate: int, suffix_first: int, markers: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _checked(markers)
        for batch in batches:
            data, off = S.byte_view(batch.column(1))
            draws = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)])
            for i, j in S.rounds(off):
                yield one(batch.column(0).slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i], draws[:, i:j], marks)

    def one(names, data, off, draws, marks) -> pa.RecordBatch:
        ends = np.flatnonzero(data == 10)
        first = np.searchsorted(ends, off)  # line ends before each text
        size = np.diff(off)
        last = np.zeros(len(size), bool)
        last[size > 0] = data[off[1:][size > 0] - 1] != 10
        n = np.diff(first) + last
        spelled = np.zeros(len(size), bool)
        for mark in marks:
            spelled[np.searchsorted(off, _found(data, off, mark), "right") - 1] = True
        plain = (size == 0) | spelled | (draws[2] % 100 >= rate)
        forms = np.where(plain, 0, np.where(draws[3] % 100 < suffix_first, 2, 1))
        cut = np.sort(draws[:2] % (n + 1), axis=0)

        def place(k):  # of the end of the first k lines
            inside = (k > 0) & (k < n)
            out = np.where(k <= 0, off[:-1], off[1:])
            out[inside] = ends[first[:-1][inside] + k[inside] - 1] + 1
            return out

        a, b = np.where(plain, off[1:], place(cut[0])), np.where(plain, off[1:], place(cut[1]))
        starts = np.stack([off[:-1], a, b], axis=1)
        sizes = np.stack([a - off[:-1], b - a, off[1:] - b], axis=1)
        part, mark, bounds = _places(sizes, forms, marks)
        out = np.empty(int(bounds[-1]), np.uint8)
        where = np.arange(len(data)) + _shifts(len(data), starts.ravel(), (part - starts).ravel())
        out[where] = data
        rows = np.flatnonzero(~plain)
        for m, text in enumerate(marks):
            out[mark[rows, m][:, None] + np.arange(len(text))] = text
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return pa.RecordBatch.from_arrays(
            [
                names, pa.array(n), pa.array(np.array(FORMS, object)[forms], pa.string()), pa.array(chars[a] - chars[off[:-1]], mask=plain),
                pa.array(chars[b] - chars[a], mask=plain), _strings(out, bounds),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: its lines, whether it is plain,
    psm or spm, the code points of the parts (null if plain), and the text to train on."""
    _checked(markers)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("_h"))
    draws = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")] + [T.StructField("output", T.StringType())]
    return rows.select("doc_id", "text", *draws).mapInArrow(_transformer(rate, suffix_first, markers), T.StructType(fields))


def _restorer(output: int, form: int, markers: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _checked(markers)
        for batch in batches:
            data, off = S.byte_view(batch.column(output))
            codes = np.array([FORMS.index(f) if f in FORMS else -1 for f in batch.column(form).to_pylist()])
            lost = np.asarray(batch.column(output).is_null()) | (codes < 0)
            for i, j in S.rounds(off):
                text = one(data[off[i] : off[j]], off[i : j + 1] - off[i], np.maximum(codes[i:j], 0), lost[i:j], marks)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "restored"])

    def one(data, off, forms, lost, marks) -> pa.Array:
        lost = lost.copy()
        at = np.zeros((len(forms), 3), np.int64)
        for m, mark in enumerate(marks):
            found = np.append(_found(data, off, mark), len(data))
            at[:, m] = found[np.searchsorted(found[:-1], off[:-1])]
        starts, sizes = np.zeros_like(at), np.zeros_like(at)
        plain = forms == 0
        starts[plain] = off[:-1][plain, None]
        sizes[plain, 0] = np.diff(off)[plain]
        for code, form in enumerate(FORMS):
            if form == "plain":
                continue
            rows = np.flatnonzero(forms == code)
            upto = off[:-1][rows]
            bound = [at[rows, _MARK_OF[p]] for p in _PARTS[form]] + [off[1:][rows]]
            bad = bound[0] != upto
            for k, p in enumerate(_PARTS[form]):
                starts[rows, p] = bound[k] + len(marks[_MARK_OF[p]])
                sizes[rows, p] = bound[k + 1] - starts[rows, p]
                bad |= sizes[rows, p] < 0
            lost[rows[bad]] = True
        starts[lost], sizes[lost] = 0, 0
        flat = sizes.ravel()
        begin = np.cumsum(flat) - flat
        bounds = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
        total = int(bounds[-1])
        back = np.arange(total) + _shifts(total, begin, starts.ravel() - begin)
        return _strings(data[back], bounds, lost)

    return run


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``rows`` with ``restored``, the exact text behind each output, from the output and form alone."""
    kept = rows.drop("restored")
    at = kept.columns.index
    schema = T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())])
    return kept.mapInArrow(_restorer(at(output_col), at(form_col), markers), schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS g, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || g[1:8])::BIGINT AS h1, ('0x' || g[9:16])::BIGINT AS h2, ('0x' || g[17:24])::BIGINT AS h3, ('0x' || g[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
}
