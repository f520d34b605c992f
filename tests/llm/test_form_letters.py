"""Form letters: texts of one template, each with fields of its own, too few or just enough to link."""

import random

import pytest

from spanwright.llm import jaccard_join as J

from .test_operators import frame, shingles


def letters(n, fields, seed=3, words=200):
    """Each field is one word of the letter's own; fields stand apart, so each changes five shingles."""
    r = random.Random(seed)
    template = ["t%d" % i for i in range(words)]
    places = [10 + i * (words - 20) // max(1, fields) for i in range(fields)]
    out = []
    for _ in range(n):
        text = list(template)
        for p in places:
            text[p] = "f%d" % r.randrange(10**9)
        out.append(" ".join(text))
    return out


@pytest.fixture
def met(monkeypatch):
    """Counts the rows that the pair joins make, before any pair is looked at."""
    rows = {"met": 0}
    plain = J._met

    def counted(x, y, more):
        rows["met"] += x.select("key").join(y.select("key"), "key").count()
        return plain(x, y, more)

    monkeypatch.setattr(J, "_met", counted)
    return rows


@pytest.mark.parametrize("fields", [8, 6])
def test_letters_of_one_template_make_no_pairs(spark, met, fields):
    made = []
    for n in (100, 300):
        met["met"] = 0
        got = {x.doc_id: x.component_id for x in J.jaccard_classes(frame(spark, letters(n, fields))).collect()}
        assert got == {i: i for i in range(n)}  # nothing links
        made.append(met["met"])
    assert made[1] <= 4 * max(made[0], 100), made


def test_letters_with_few_fields_are_one_component(spark, met):
    n = 300
    got = {x.doc_id: x.component_id for x in J.jaccard_classes(frame(spark, letters(n, 3))).collect()}
    assert set(got.values()) == {0} and len(got) == n
    assert met["met"] <= 4 * n * 22  # rows in proportion to the texts' lanes


def test_letters_of_mixed_sizes_against_all_pairs(spark, monkeypatch):
    """Templates, copies, letters cut short and letters with few and many fields, all keys crowded."""
    monkeypatch.setattr(J, "CROWD", 0)
    monkeypatch.setattr(J, "STARS", 1)
    r = random.Random(11)
    texts = []
    for k, fields in enumerate((2, 4, 5, 6, 8)):
        for t in letters(14, fields, k, 120):
            w = t.split()
            texts.append(" ".join(w[: len(w) - r.randrange(0, 25)]))
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    roots = [find(i) for i in range(len(sets))]
    assert 1 < len(set(roots)) < len(sets)
    assert {x.doc_id: x.component_id for x in J.jaccard_classes(frame(spark, texts)).collect()} == dict(enumerate(roots))
