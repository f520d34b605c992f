"""Fill-in-the-middle against a plain version, odd texts and broken outputs."""

import hashlib
import re

import pytest

from spanwright.llm import fill_in_middle as M

TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "héllo\nwörld 😀\n\nend", "has <P> in it\nx", "<S>", "near <P misses\n<M", "日本\n語\n" * 50,
    "x" * 5000 + "\n" + "y" * 5000, "line\n" * 200_000, "crlf\r\nrow\r\n", "same\ntext", "same\ntext", "<\n<P\n>",
]


def plain_version(doc_id, text, seed=7, rate=100, first=50, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in markers) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    P, S, M_ = markers
    if h[3] % 100 < first:
        return n, "spm", len(p), len(m), S + s + P + p + M_ + m
    return n, "psm", len(p), len(m), P + p + S + s + M_ + m


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, output string")


@pytest.mark.parametrize("setting", [{}, {"seed": 3, "rate": 40, "suffix_first": 100}, {"markers": ("[pre]", "[after]", "[mid]")}])
def test_against_plain_version(spark, setting):
    rows = [(i * 37, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no\nid\n"), (0, None), (5, "a\nb"), (5, "a\nb")]
    made = M.fill_in_middle(frame(spark, rows), **setting)
    back = M.restore(made, markers=setting.get("markers", M.MARKERS)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    want = sorted(((i, *plain_version(i, t, setting.get("seed", 7), setting.get("rate", 100), setting.get("suffix_first", 50), setting.get("markers", M.MARKERS))) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key) == want
    assert sorted(((r.doc_id, r.restored) for r in back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)


def test_outputs_without_their_markers(spark):
    rows = spark.createDataFrame([("<P>a<S>b<M>c", "psm", 1), ("<S>a<P>b<M>c", "psm", 2), ("<P>a<M>b", "psm", 3), ("x<S>a<P>b<M>c", "spm", 4), (None, "plain", 5), ("plain", None, 6), ("t", "plain", 7), ("<S>a<P>b<M>c", "spm", 8)], "output string, form string, restored int")
    got = sorted((r.output or "", r.form or "", r.restored) for r in M.restore(rows.withColumnRenamed("restored", "k")).collect())
    assert {x[:2]: x[2] for x in got} == {("<P>a<S>b<M>c", "psm"): "acb", ("<S>a<P>b<M>c", "psm"): None, ("<P>a<M>b", "psm"): None, ("x<S>a<P>b<M>c", "spm"): None, ("", "plain"): None, ("plain", ""): None, ("t", "plain"): "t", ("<S>a<P>b<M>c", "spm"): "bca"}


def test_empty_table_and_overlapping_markers(spark):
    assert M.restore(M.fill_in_middle(frame(spark, []))).collect() == []
    for bad in (("<a>", "<a>b", "c"), ("ab", "ba", "c"), ("", "x", "y"), ("xx<", "<yy", "z")):
        with pytest.raises(ValueError):
            M.fill_in_middle(frame(spark, []), markers=bad)
