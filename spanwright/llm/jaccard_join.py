"""N-gram Jaccard join by parity sketches.

A text's set is its distinct five-word shingles, each a 52-bit hash.  Tokens are XOR-hashed into
sketches of two grains: *lanes* (each token toggles the bits of its hash in one of ``p`` lanes) and
*bits* (each token toggles one of ``m`` bits).  The Hamming distance of either, counted in lanes or
bits, is at most the symmetric difference of the sets.  For Jaccard >= 0.8 a text of ``n`` shingles
differs from a partner in at most ``n/4`` of them, so of its non-empty lanes all but ``n/4`` agree:
the first ``n/4 + 1`` lanes, in any order both sides share, must have one in common (pigeonhole).
``p`` depends on a size band (factor four); a text near the top of its band also uses the next.  In
the lowest band each token is a lane of its own.

1. one row per text: set size, a 64-bit set signature, the bit sketch; equal sets are one class;
2. lane rows ``(key, class)``, the fullest lanes first, shuffled once by key.  Of a key that several
   classes of one task share two rows go to the key's partition, and the rest, known to be shared,
   anywhere, so that a key that is in a third of all texts makes no large task;
3. star rounds: each key has a hub, each class meets the hub that it shares most keys with; links
   are verified on the sets, and linked classes merge, so that a group of copies needs no pairs;
4. all pairs that still share a key across different components, past size and bit-sketch bounds,
   are verified.  A key that more than ``CROWD`` rows outside its main component share (a passage
   that many texts quote) makes no pairs.  Its texts meet by the finest lanes instead, one for each
   token, in one order for all: those in the fewest components first.  Of two linked texts the
   smaller differs from the larger in at most a ninth of its set, the larger from the smaller in at
   most a fifth, so the first token that both hold is among the first ``n/9 + 1`` of the one and the
   first ``n/5 + 1`` of the other, and only such rows meet.  A letter sent to many, with too much of
   its own in each copy to link, has only tokens of its own among its ninth and makes no pairs; with
   less of its own the copies link and are one component.  Two linked texts that share no other key
   are both among those of crowded keys, so no link is lost.

Nulls, empty texts: set size 0, linked with nothing.  Equal texts are one class.  Very long texts
are one round each.  Rows whose ids are null or repeated keep their own links; a null id is its own
component's name only where no id is reached.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import shared as S

WORDS = 5
FOLD = 8  # longs of the sketches that joins compare
STARS = 3  # rounds in which each class meets one hub
CROWD = 8  # rows of a key outside its main component, beyond which its texts turn to rarer lanes
WITNESSED = 1 << 20  # shared keys that a task remembers to have sent to their partitions
_U = np.uint64
_FIELD = 40  # low bits of a sort key that order a lane's value
_BAND = 31  # low bits of a key that name its size band


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds; <= CHUNK_DOCS texts."""
    low = S.lower_bytes(data)
    starts, ends, first = S.word_bounds(low, off)
    word = S.range_hash(S.prefix_hash(low), starts, ends)
    n_words = np.diff(first)
    padded = np.concatenate([word, np.zeros(WORDS, _U)])
    total = np.zeros(len(word), _U)
    for j in range(WORDS):
        total += padded[j : j + len(word)] * _U(0x9E3779B97F4A7C15 * (2 * j + 3) & (2**64 - 1))
    per_text = np.where(n_words >= WORDS, n_words - WORDS + 1, 0)
    keep = np.repeat(first[:-1], per_text) + S.ramp(per_text)
    shingle = S.mix(total[keep], WORDS)
    text = np.repeat(np.arange(len(n_words)), per_text)
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        part = np.zeros(len(short), _U)
        for j in range(WORDS - 1):
            have = n_words[short] > j
            part[have] += word[first[short[have]] + j] * _U(0x9E3779B97F4A7C15 * (2 * j + 3) & (2**64 - 1))
        shingle = np.concatenate([shingle, S.mix(part + n_words[short].astype(_U), 77)])
        text = np.concatenate([text, short])
    key = (text.astype(_U) << _U(S.HASH_BITS)) | (shingle >> _U(64 - S.HASH_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key >> _U(S.HASH_BITS), np.arange(len(n_words) + 1))
    return key & _U((1 << S.HASH_BITS) - 1), bounds


def sketch_bits(n: int) -> int:
    """Bits of a text's parity sketch: a power of two from 512 to 4096, about twice the set."""
    return int(min(4096, max(64 * FOLD, 1 << int(2 * n - 1).bit_length())))


def _sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    size = np.diff(bounds)
    bits = np.array([sketch_bits(max(int(n), 1)) for n in size], np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], size) + (h & np.repeat(bits - 1, size).astype(_U)).astype(np.int64)
    parity = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    return [packed[base[i] // 8 : base[i + 1] // 8] for i in range(len(size))]


def lane_keys(h: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> pa.RecordBatch:
    """The lanes that the chosen texts must list, fullest first: the text (its number) and the key
    (whose low bits are the band)."""
    n = np.diff(bounds)
    out = []
    n64 = n.astype(np.int64)
    band = np.zeros(len(n), np.int64)
    for k in range(1, 20):
        band[n64 >= 4**k] = k
    for use in np.unique(band[chosen]):
        for k in (use, use + 1):
            mine = chosen[(band[chosen] == use) & ((k == use) | (n64[chosen] * 5 // 4 >= 4**k))]
            if not len(mine):
                continue
            size = n64[mine]
            token = np.repeat(bounds[mine], size) + S.ramp(size)
            who = np.repeat(np.arange(len(mine)), size)
            mark = S.mix(np.array([int(k)], _U), 12)[0]
            if k <= 1:
                owner, key, count = who, S.mix(h[token] + mark, 13), np.ones(len(who), np.int64)
            else:
                lanes = 2 << (2 * int(k))
                lane = (h[token] & _U(lanes - 1)).astype(np.int64)
                order = np.argsort(who * lanes + lane, kind="stable")
                cell = (who * lanes + lane)[order]
                new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                value = np.bitwise_xor.reduceat(S.mix(h[token][order], 11), new)
                count = np.diff(np.append(new, len(cell)))
                owner = cell[new] // lanes
                key = S.mix(value + S.mix((cell[new] % lanes).astype(_U) + mark, 12) + count.astype(_U), 13)
            have = np.bincount(owner, minlength=len(mine))
            need = size // 4 + 1
            weak = np.flatnonzero(have < need)
            if len(weak):  # too few lanes for the pigeonhole (hardly ever): such texts meet each other
                owner = np.concatenate([owner, weak])
                key = np.concatenate([key, np.full(len(weak), S.mix(np.array([int(k)], _U), 14)[0])])
                count = np.concatenate([count, np.zeros(len(weak), np.int64)])
                have[weak] += 1
                need[weak] = have[weak]
            # fuller lanes are the rarer ones: they come first
            rank = (owner.astype(_U) << _U(52)) | (_U(4095) - np.minimum(count, 4095).astype(_U)) << _U(_FIELD) | key >> _U(64 - _FIELD)
            order = np.argsort(rank)
            owner, key = owner[order], key[order]
            keep = S.ramp(have) < need[owner]
            key = key[keep] & ~_U(_BAND) | _U(k)
            out.append((mine[owner[keep]], key.view(np.int64)))
    out = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["text", "key"])


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return S.mix(S.segment_sums(S.mix(h, 21), bounds), 22).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, off = S.byte_view(batch.column(1))
        for i, j in S.rounds(off):
            ids = batch.column(0).slice(i, j - i)
            yield ids, *shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _describe(batches):
    for ids, h, bounds in _texts(batches):
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(bounds)), pa.array(_signatures(h, bounds)), pa.array(_sketches(h, bounds), pa.binary())],
            ["id", "n_shingles", "sig", "bits"],
        )


class _Listed:
    """Rows (to, key, sig, known) of lanes, and one more column where it is named: ``to`` is the key, or
    any number where the key is known to be shared, since two rows of this task go to the key's partition."""

    def __init__(self):
        self.told = np.zeros(0, np.int64)

    def __call__(self, rows: pa.RecordBatch, sig: np.ndarray, *more: str) -> pa.RecordBatch:
        key, sig = rows.column("key").to_numpy(), sig[rows.column("text").to_numpy()]
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        place = S.ramp(np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))) if len(key) else key
        known = place > 1
        known[np.isin(key, self.told)] = True
        self.told = np.union1d(self.told, key[place == 1])
        if len(self.told) > WITNESSED:
            self.told = self.told[:0]
        to = np.where(known, S.mix(sig.view(_U) + key.view(_U), 15).view(np.int64), key)
        others = [rows.column(c).to_numpy()[order] for c in more]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (to, key, sig, *others, known)], ["to", "key", "sig", *more, "known"])


def _lanes(batches):
    seen, listed = np.zeros(0, np.int64), _Listed()
    for _, h, bounds in _texts(batches):
        sig = _signatures(h, bounds)
        _, fresh = np.unique(sig, return_index=True)
        fresh = np.sort(fresh[~np.isin(sig[fresh], seen) & (np.diff(bounds)[fresh] >= 4)])
        seen = np.union1d(seen, sig[fresh])  # eight bytes for each text of this task
        yield listed(lane_keys(h, bounds, fresh), sig)


def _tokens(batches):
    """Each token of a set as a lane of its own, with the set's size."""
    listed = _Listed()
    for batch in batches:
        sig = batch.column("sig").to_numpy()
        for i in range(0, batch.num_rows, 64):
            h, n = _longs(batch.column("shingles").slice(i, 64))
            n = n.astype(np.int64)
            text = np.repeat(np.arange(len(n)), n)
            rows = [pa.array(text), pa.array(h.view(np.int64)), pa.array(np.repeat(n, n).astype(np.int32))]
            yield listed(pa.RecordBatch.from_arrays(rows, ["text", "key", "size"]), sig[i : i + 64], "size")


def _sets(batches):
    for batch in batches:
        data, off = S.byte_view(batch.column(1))
        for i, j in S.rounds(off):
            h, b = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            sig = _signatures(h, b)
            raw = h.astype("<u8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig), pa.array([raw[b[t] : b[t + 1]].tobytes() for t in range(j - i)], pa.binary())], ["sig", "shingles"]
            )


def _shared_keys(batches):
    """Rows sorted by (to, key, sig): keeps those of keys of two or more classes."""
    last = hub = None  # the last row, whose key may go on, and its key's first class
    emitted = True
    for batch in batches:
        known = batch.column("known")
        batch = batch.drop_columns(["known"])
        if pc.any(known).as_py():
            yield batch.filter(known)
            batch = batch.filter(pc.invert(known))
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        k, s = (batch.column(c).to_numpy() for c in ("key", "sig"))
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        if last is not None:
            fresh[0] = not emitted
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        run = np.cumsum(head) - 1
        first = s[head]
        if last is not None:
            first[0] = hub
        many = np.zeros(run[-1] + 1, bool)
        np.logical_or.at(many, run, s != first[run])
        out = fresh & many[run]
        # the last row of a key waits if its key may still turn out to be shared
        emitted = bool(many[-1])
        out[-1] &= emitted
        last, hub = batch.slice(len(k) - 1), first[-1]
        if out.any():
            yield batch.filter(pa.array(out))


def _only_shared(lanes: DataFrame, columns: str) -> DataFrame:
    """Rows of keys that several classes list, from rows of :class:`_Listed`."""
    lanes = lanes.repartition("to").sortWithinPartitions("to", "key", "sig").drop("to")
    return lanes.mapInArrow(_shared_keys, columns)


def _longs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Longs of a column of binaries, and how many each holds."""
    data, off = S.byte_view(col)
    return np.frombuffer(data, "<u8"), np.diff(off) // 8


def common(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of binaries of distinct 52-bit tokens: their sizes, and how many both hold."""
    total = []
    for i in range(0, len(x), S.CHUNK_DOCS):
        (p, n), (q, m) = _longs(x.slice(i, S.CHUNK_DOCS)), _longs(y.slice(i, S.CHUNK_DOCS))
        pair = np.arange(len(n)).astype(_U) << _U(S.HASH_BITS)
        both = np.concatenate([np.repeat(pair, n) | p, np.repeat(pair, m) | q])
        both.sort()
        twice = (both[1:][both[1:] == both[:-1]] >> _U(S.HASH_BITS)).astype(np.int64)
        total.append((n, m, np.bincount(twice, minlength=len(n))))
    return tuple(np.concatenate(t) for t in zip(*total, strict=True)) if total else (np.zeros(0, np.int64),) * 3


def _verify(batches):
    for batch in batches:
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):  # a set may be large
            n, m, both = common(part.column("x"), part.column("y"))
            keep = pa.array(100 * both >= 80 * (n + m - both))
            yield part.select(["a", "b"]).filter(keep)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link.  Each side fetches its set by itself, so sets of no
    pair are not shuffled where ``pairs`` is a small table, and one class in many pairs is dealt by pair."""
    x = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), "a")
    y = pairs.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y")), "b")
    return x.join(y, ["a", "b"]).select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def fold(col: pa.Array, to: int | np.ndarray) -> np.ndarray:
    """Bit sketches folded to ``to`` longs each (one row of the widest; the rest is 0)."""
    x, n = _longs(col)
    to = np.broadcast_to(to, n.shape)
    first = np.cumsum(n) - n
    out = np.zeros((len(n), int(to.max(initial=1))), _U)
    for a, b in {(int(a), int(b)) for a, b in zip(n, to, strict=True)}:
        some = np.flatnonzero((n == a) & (to == b))
        out[some, :b] = np.bitwise_xor.reduce(x[first[some][:, None] + np.arange(a)].reshape(len(some), a // b, b), axis=1)
    return out


def _close(batches):
    """Candidate pairs whose bit sketches, folded to the same width, do not rule out a link."""
    for batch in batches:
        a, b = batch.column("bits_a"), batch.column("bits_b")
        width = np.minimum(_longs(a)[1], _longs(b)[1])
        far = np.bitwise_count(fold(a, width) ^ fold(b, width)).sum(axis=1)
        keep = 9 * far.astype(np.int64) <= batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of classes whose whole bit sketches do not rule out a link."""
    left = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_close, "a long, b long")


def _folded(batches):
    """The bit sketch of each class folded to FOLD longs: a lower bound of the same distance."""
    for batch in batches:
        out = fold(batch.column("bits"), FOLD).view(np.int64).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), *(pa.array(out[:, k]) for k in range(FOLD))], ["sig", "n", *(f"s{k}" for k in range(FOLD))])


def _rows_of_open_keys(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (key, sig, root) of keys with several components; ``out`` is true outside the key's most
    frequent component, ``rest`` counts those rows."""
    per = rows.groupBy("key", "root").agg(F.count("sig").alias("c"))
    main = per.groupBy("key").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("rest"), F.count("root").alias("roots")
    )
    rows = rows.join(main.where("roots > 1").drop("roots"), "key").withColumn("out", F.expr("root <> main"))
    return rows.select("key", "sig", "root", "out", "rest", *more)


_SIDE = ("root", "sig", "n", "out", *(f"s{k}" for k in range(FOLD)))
_FAR = " + ".join(f"bit_count(a_s{k} ^ b_s{k})" for k in range(FOLD))


def _met(x: DataFrame, y: DataFrame, more: str) -> DataFrame:
    """Pairs of a key's rows of ``x`` and ``y`` in different components that folded sketches and ``more`` allow."""
    x, y = (t.select("key", *(F.col(c).alias(f"{p}_{c}") for c in _SIDE)) for t, p in ((x, "a"), (y, "b")))
    near = x.join(y, "key").where(f"a_root <> b_root and {more} and 9 * ({_FAR}) <= a_n + b_n")
    return near.select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b"))


def _cross_pairs(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs of a key in different components that sizes and folded sketches allow.  One side of a
    pair is always outside the key's main component, so a group of linked copies makes no pairs."""
    rows = rows.join(info, "sig")
    fits = "(not b_out or a_root < b_root) and 5 * a_n >= 4 * b_n and 5 * b_n >= 4 * a_n"
    return _met(rows.where("out"), rows, fits).distinct()


def _rare_pairs(rows: DataFrame, info: DataFrame) -> DataFrame:
    """The same of rows of tokens: the smaller text (or one of two as large) is met in its first ninth."""
    rows = rows.join(info, "sig")
    fits = "a_n <= b_n and 5 * a_n >= 4 * b_n"
    few = rows.where("first")
    return _met(few.where("out"), rows, fits).unionByName(_met(few.where("not out"), rows.where("out"), fits)).distinct()


def _rarest(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, sig, root, first) from the tokens that several of some texts hold: those of each text's first
    fifth, tokens in the fewest components first, and whether they are in its first ninth.  Tokens that it
    shares with none come before all these and are not in ``tokens``."""
    named = _named(tokens, roots)
    spread = named.groupBy("key").agg(F.count_distinct("root").alias("df"))
    mine = W.partitionBy("sig").orderBy(F.desc("df"), F.desc("key"))
    ranked = named.join(spread, "key").withColumn("last", F.row_number().over(mine))
    ranked = ranked.where("df > 1 and last >= size - size div 5")
    return ranked.select("key", "sig", "root", F.expr("last >= size - size div 9").alias("first"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, sig, root, t): component_id is the smallest id that links
    reach, root names the component (null without words), t is the text's hash."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ids may be null or repeated: a row is found again by its id and the hash of its text
    texts = texts.withColumn("t", F.xxhash64("text"))
    rows = texts.select(F.struct("doc_id", "t").alias("id"), "text")
    rows = rows.mapInArrow(_describe, "id struct<doc_id:long,t:long>, n_shingles long, sig long, bits binary")
    rows = S.materialize(rows.select("id.doc_id", "id.t", "n_shingles", "sig", "bits"), "sets")
    classes = rows.where("n_shingles > 0").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "t")).alias("at"), F.count(F.lit(1)).alias("copies"),
        F.max("n_shingles").alias("n"), F.min("bits").alias("bits"),
    )
    classes = S.materialize(classes.select("sig", "rep", "at", "copies", "n", "bits"), "classes")
    info = classes.mapInArrow(_folded, "sig long, n long, " + ", ".join(f"s{k} long" for k in range(FOLD)))

    lanes = texts.select("doc_id", "text").mapInArrow(_lanes, "to long, key long, sig long, known boolean")
    keyed = S.materialize(_only_shared(lanes, "key long, sig long"), "keys")
    wanted = keyed.select("sig").distinct().join(classes, "sig").select(F.col("at.doc_id").alias("at_id"), F.col("at.t").alias("at_t"), "copies")
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("t") == F.col("at_t")))
    sets, again = (found.where(c).select("doc_id", "text").mapInArrow(_sets, "sig long, shingles binary") for c in ("copies = 1", "copies > 1"))
    sets = S.materialize(sets.unionByName(again.dropDuplicates(["sig"])), "shingles")  # equal rows give one set

    links = roots = None
    for turn in range(STARS):
        named = keyed.withColumn("root", F.col("sig")) if roots is None else _named(keyed, roots)
        hub = F.min(F.struct(F.xxhash64("sig", F.lit(turn)), "sig", "root"))
        hubs = named.groupBy("key").agg(hub.alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        opened = S.materialize(
            named.join(hubs, "key").select("key", "sig", "root", F.col("h.sig").alias("hub"), F.col("h.root").alias("hub_root")), "open"
        )
        S.discard(keyed)
        keyed = opened
        votes = keyed.where("root <> hub_root").groupBy("sig", "hub").count()
        star = votes.groupBy("sig").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
        star = S.materialize(_possible(star.select(F.col("sig").alias("a"), F.col("hub").alias("b")), classes), "near")
        found = S.materialize(_verified(star, sets), "star")
        S.discard(star)
        links = found if links is None else links.unionByName(found)
        if roots is not None:
            S.discard(roots)
        roots = S.components(links)
        keyed = keyed.select("key", "sig")

    rows_open = S.materialize(_rows_of_open_keys(_named(keyed, roots)), "open")
    S.discard(keyed)
    pairs = _cross_pairs(rows_open.where(f"rest <= {CROWD}"), info)
    crowded = rows_open.where(f"rest > {CROWD}").select("sig").distinct()
    tokens = sets.join(crowded, "sig", "left_semi").mapInArrow(_tokens, "to long, key long, sig long, size int, known boolean")
    tokens = S.materialize(_only_shared(tokens, "key long, sig long, size int"), "tokens")
    rare = S.materialize(_rows_of_open_keys(_rarest(tokens, roots), "first"), "rare")
    S.discard(tokens)
    pairs = pairs.unionByName(_rare_pairs(rare, info)).distinct()

    near = S.materialize(_possible(pairs, classes), "near")
    S.discard(rows_open, rare)
    rest = S.materialize(_verified(near, sets), "rest")
    S.discard(near, sets)
    before, roots = roots, S.components(links.unionByName(rest))
    S.discard(links, rest, before)
    member = _named(classes.select("sig", "rep"), roots)
    smallest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_sig = member.join(smallest, "root").select("sig", "root", "component_id")
    return (
        rows.select("doc_id", "t", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sig")).alias("sig"))
        .join(by_sig, "sig", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "sig", "root", "t")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns kept: of each component the row of
    the smallest id (null last), of equal ids the one of the smallest text hash, of rows that are
    equal in both one.  Texts without words are nobody's duplicates."""
    columns = docs.columns
    worded = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("m")
    stay = jaccard_classes(docs, id_col, text_col).where("root is not null").groupBy("root").agg(first)
    stay = stay.select(F.col("m.doc_id").alias("__id"), F.col("m.t").alias("__t")).distinct()
    rows = docs.where(worded).withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    rows = rows.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__t")))
    rest = F.xxhash64(F.to_json(F.struct(*(c for c in columns if c != text_col))))
    nth = F.row_number().over(W.partitionBy("__id", "__t").orderBy(rest))
    return rows.withColumn("__nth", nth).where("__nth = 1").select(*columns).unionByName(docs.where(~worded))


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds the component ``root`` of ``sig``; a class without links is its own."""
    return rows.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, n, hash(unnest(s)) AS t FROM sized),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared WHERE 100 * c >= 80 * (total - c)
), sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM sized
  UNION SELECT r.a, s.y FROM reach r JOIN sym s ON r.b = s.x
)
SELECT d.doc_id, d.n AS n_shingles, m.component_id
FROM sized d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLES = {"op1_jaccard_join": ORACLE}
