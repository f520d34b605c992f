"""Each stage of the pipeline and the whole of it against brute force, on odd and repeated rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from spanwright.llm import language_id, packing, shared

from .test_operators import WORD, shingles, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>, key string, spans array<int>"


def rows_of(spark, texts):
    """Repeated rows, null ids, clashing extra columns and a map."""
    rows = [(None if k % 17 == 3 else k, t, "en", [None, "a", "b", "c"][k % 4], len(t or ""), {"k": k}, "x", [k]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:6] + [(0, texts[9], "de", "z", 1, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    r = random.Random(11)
    some = [t.text for t in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    passage = " ".join("passage%d" % k for k in range(60))
    base = some[5].split()
    texts = some + [" ".join(variants(r, base, 2)) for _ in range(3)] + [some[7] + " " + passage, passage + " " + some[8], None, "", " \n", "a", "12 34 $$", "日本語 。"]
    return rows_of(spark, texts)


def stage(name):
    return dict(pipeline.STAGES)[name]


def key(r):
    return (r.doc_id, r.text)


def written(df):
    return shared.materialize(df, "stage")


def test_language_keeps_what_is_accepted(spark, small, docs):
    out = written(stage("language_id")(spark, docs, small))
    assert out.columns == docs.columns
    learnt = spark.read.parquet(f"{small}/documents.parquet").where(shared.crc_mod("doc_id", 4) != 2)
    numbered = docs.select("text").distinct().collect()
    found = language_id.identify(spark.createDataFrame([(k, r.text) for k, r in enumerate(numbered)], "doc_id long, text string"), language_id.fit(learnt))
    ok = {numbered[r.doc_id].text for r in found.collect() if r.accepted}
    assert Counter(map(key, out.collect())) == Counter(key(r) for r in docs.collect() if r.text in ok) and None not in ok and "12 34 $$" not in ok


def test_one_document_of_each_group_stays(spark, small, docs):
    out = written(stage("jaccard_join")(spark, docs, small))
    assert out.columns == docs.columns
    rows = docs.collect()
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups, alone = defaultdict(list), Counter()
    for k, r in enumerate(rows):
        if sets[k]:
            groups[find(k)].append(r)
        else:
            alone[key(r)] += 1
    got = Counter(map(key, out.collect()))
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        stay = {key(r) for r in g if r.doc_id == (min(ids) if ids else None)}
        here = [k for k in stay if got[k]]
        assert len(here) == 1 and got[here[0]] >= 1
        alone[here[0]] += 1
    assert got == alone


def test_repeats_are_cut(spark, small, docs):
    out = written(stage("repeat_index")(spark, docs, small))
    assert out.columns == docs.columns
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    starts = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    want = Counter()
    for r, t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        if not len(t) or not gone.all():
            want[(r.doc_id, bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "replace") if gone.any() else r.text)] += 1
    got = out.collect()
    assert Counter(map(key, got)) == want and all(r.n_chars == len(r.text or "") for r in got)


def test_mix_takes_words_of_the_texts(spark, small, docs):
    out = written(stage("source_mix")(spark, docs.dropDuplicates(["doc_id", "text"]), small))
    assert out.columns == docs.columns
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    times = Counter()
    for r in out.collect():
        w = WORD.findall(r.text)
        assert w and any(Counter(w) <= Counter(WORD.findall(t or "")) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
        times[r.doc_id] += 1
    assert all(n <= 3 * len(texts[i]) for i, n in times.items())


def test_empty_tables_go_through(spark, small, docs):
    none = docs.limit(0)
    for name, f in pipeline.STAGES[:-1]:
        none = written(f(spark, none, small))
        assert none.columns == docs.columns and none.count() == 0, name
    assert stage("packing")(spark, none, small).count() == 0


def test_the_whole(spark, small):
    """Every kept text is packed whole, and two runs agree."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, f in pipeline.STAGES[:-1]:
        docs = written(f(spark, docs, small))
    pieces = pipeline.run(spark, small).groupBy("doc_id").agg({"length": "sum"}).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(plain.encode(r.text, add_special_tokens=False).ids) + 1
    assert {r.doc_id: r["sum(length)"] for r in pieces} == want
