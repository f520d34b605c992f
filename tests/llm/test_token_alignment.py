"""Token alignment against a plain version, on odd texts, and the merge path on its own."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanwright.llm import token_alignment as M

TEXTS = [
    None, "", " ", "   ", "a", "a ", "a  b", " lead", "\nnew\n\nlines \t x", "<s> </s> <unk> <|endoftext|> x<|endoftext|>", "日本語 テキスト 。", "　wide　space", "é é naïve ﬁ ①",
    "mark ▁ in text", "▁", "zero\0byte", "same text here", "same text here", "x" * 3000, "ab " * 4000, "12345 67.89 $$ ((()))", "emoji 😀😀 👩‍👩‍👧 end", "tab\tand\rcr \x0b", "a b   c",
]


@pytest.fixture(scope="module")
def models():
    a, b = M.default_tokenizers()
    tokenizer = Tokenizer.from_file(a)
    tokenizer.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    letters = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(hidden)}
    return tokenizer, letters, sentencepiece.SentencePieceProcessor(model_file=b)


def tokens(models, text):
    tokenizer, letters, pieces = models
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    spelled = [bytes(letters[c] for c in tokenizer.id_to_token(x)) for x in a]
    other = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
    if not text or b"".join(spelled) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
        return [], []
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    return list(zip(a, ends(spelled), strict=True)), list(zip(b, ends(other), strict=True))


def plain_version(models, rows):
    out, count = [], Counter()
    for i, text in rows:
        a, b = tokens(models, text or "")
        links, groups, start_a = [], [], 0
        for x, end_a in a:
            start_b = 0
            for y, end_b in b:
                if start_a < end_b and start_b < end_a:
                    links.append((x, y))
                start_b = end_b
            start_a = end_a
        last = 0
        for cut in sorted({e for _, e in a} & {e for _, e in b}):
            groups.append("|".join(",".join(str(x) for x, e in side if last < e <= cut) for side in (a, b)))
            last = cut
        count.update(links)
        out.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(i, a, b, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), text) for i, a, b, g, links, text in out]


def test_against_plain_version(spark, small, models, tmp_path):
    some = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 700").orderBy("doc_id").limit(40).collect()]
    rows = [(k, t) for k, t in enumerate(TEXTS + some)] + [(None, "null id"), (3, "again"), (3, "again")]
    rows = [r for r in rows if len(r[1] or "") < 2000]
    frame = spark.createDataFrame([(i, t, 1, b"x", "p") for i, t in rows], "doc_id long, text string, block int, links binary, pairs string").repartition(3)
    written = str(tmp_path / "aligned")
    M.align(frame).write.parquet(written)
    got = M.weigh(spark.read.parquet(written)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[7])
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got), key=key) == sorted(plain_version(models, rows), key=key)


def test_long_texts_are_cut_like_whole_ones(models):
    """Stretch by stretch, also over a block's size, ids are those of the whole text."""
    r = random.Random(3)
    words = ["w%d" % r.randrange(500) for _ in range(2000)] + ["éa", "日本", "…", "▁", "\t", "  ", "a\n", " ", " x"]
    known = M.Tokenizers(*M.default_tokenizers())
    texts = [" ".join(r.choice(words[k % 5 * 100 :]) for _ in range(n)) for k, n in enumerate((5, 50, 400, 3000))] + [" ".join(["long"] * 250_000)] + TEXTS
    texts = [t for t in texts if t]
    raw = [(" " + t).encode() for t in texts]
    good, ids, counts = known.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    at = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
    for k, t in enumerate(texts):
        a, b = tokens(models, t)
        assert bool(a) == bool(good[k])
        assert [x for x, _ in a] == ids[0][at[0][k] : at[0][k + 1]].tolist()
        assert [x for x, _ in b] == ids[1][at[1][k] : at[1][k + 1]].tolist()


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_merge_path_and_overlaps(piece):
    r = random.Random(piece)
    for n in (0, 1, 2, 10, 60):
        end = [0, *sorted(r.sample(range(1, 5 * n + 2), n)), 5 * n + 3]
        a = np.array(sorted({r.choice(end) for _ in range(n)} - {0} | {end[-1]}))
        b = np.array(sorted({r.choice(end) for _ in range(n)} - {0} | {end[-1]}))
        i, j = M.merge_path(a, b, piece)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for k, (x, y) in enumerate(zip(i, j, strict=True)):
            assert x + y == min(k * piece, len(merged)) and x == sum(s == 0 for _, s in merged[: x + y])
        link_a, link_b, group_a, group_b = M.overlaps(a, b, piece)
        starts = lambda e: np.concatenate([[0], e[:-1]])
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if starts(a)[x] < b[y] and starts(b)[y] < a[x]]
        assert sorted(zip(link_a.tolist(), link_b.tolist(), strict=True)) == want
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        assert group_a.tolist() == [sum(c < x for c in cuts) for x in a] and group_b.tolist() == [sum(c < x for c in cuts) for x in b]


def test_empty_table(spark, tmp_path):
    M.align(spark.createDataFrame([], "doc_id long, text string")).write.parquet(str(tmp_path / "none"))
    assert M.weigh(spark.read.schema(M.ALIGNED).parquet(str(tmp_path / "none"))).collect() == []
