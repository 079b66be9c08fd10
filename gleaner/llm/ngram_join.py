"""N-gram Jaccard self-join with Bayesian pruning of MinHash candidates.

1. One pass over the texts gives each document a 128-bit key of its word
   sequence and a signature of K MinHash values over word 5-grams. Equal keys
   are copies: one node stands for them, so copies are never paired.
2. Nodes that share a band of the signature are candidates. Only buckets of two or
   more nodes go on; large ones are dealt into blocks of bounded size, and a task
   compares two blocks of one bucket. A pair counts in the first band it shares, so
   it is judged once, and the work follows the buckets, not what they connect to.
3. MinHash values are compared STEP at a time: under a uniform prior the similarity
   given m of n matches is Beta(m + 1, n - m + 1), and a pair goes once
   P(similarity >= threshold) falls below ``TOLERANCE``. This first runs on
   signatures alone; n-gram sets are made only for nodes with a surviving pair, and
   sent only to the buckets where it survived, where the rest is verified exactly.
4. A task returns, per node, its count of links and the least node it reaches
   there, never pairs; components of these give the classes.

Defined cases: words are runs of anything but U+0020 and U+0009-U+000D; a text of
1-4 words has one n-gram; texts without words (null, empty) are copies of each
other; rows with a null or repeated doc_id take part by their text; very long texts
are hashed a segment at a time; a class id is the class's least doc_id (null if all
are); an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch, ship
from .common import Batches, lean, slices
from .components import components

NGRAM = 5
K, BAND = 96, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK_NODES, BLOCK_WORDS = 256, 1 << 21
SEGMENT = 1 << 18

_U = np.uint64
_BASE, _MULT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(int(_BASE), -1, 1 << 64)
        _powers[size] = np.cumprod(np.full(size, _BASE, _U)), np.cumprod(np.full(size, inverse, _U))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of UTF-8 text, segment by segment."""
    whole = np.frombuffer(data, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        end = min(len(whole), at + SEGMENT)
        if end < len(whole):
            blank = np.flatnonzero(_BLANK[whole[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:  # a word longer than a segment
                more = next((i for i in range(end, len(whole), SEGMENT) if _BLANK[whole[i : i + SEGMENT]].any()), None)
                end = len(whole) if more is None else more + int(np.flatnonzero(_BLANK[whole[more : more + SEGMENT]])[0]) + 1
        part = whole[at:end]
        inside = ~_BLANK[part]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _power(len(part))
        total = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * power[: len(part)], out=total[1:])
        hashes.append(mix((total[b] - total[a]) * inverse[a] + (b - a).astype(_U)))
        starts.append(a + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, _U), np.zeros(0, np.int64))


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams in a run of word hashes (n-grams across texts included)."""
    out = words[: len(words) - NGRAM + 1].copy()
    for j in range(1, NGRAM):
        out = out * _MULT + words[j : len(words) - NGRAM + 1 + j]
    return mix(out)


def ngram_set(text: str | None) -> np.ndarray:
    words, _ = word_hashes((text or "").encode())
    if len(words) >= NGRAM:
        return np.unique(_grams(words))
    return _short(words)


def _short(words: np.ndarray) -> np.ndarray:
    out = np.full(min(1, len(words)), _U(len(words)))
    for w in words:
        out = out * _MULT + w
    return mix(out)


_SEEDS = np.random.default_rng(11).integers(0, 1 << 63, (2, K), dtype=np.int64).astype(_U)
_SEEDS[0] |= _U(1)


def describe(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Keys, word counts and MinHash values (rows of K; all ones without words)."""
    data = [(t or "").encode() for t in texts]
    words, starts = word_hashes(b"\n".join(data) + b"\n")
    ends = np.cumsum([len(d) + 1 for d in data])
    bound = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = np.diff(bound)
    has = np.flatnonzero(n)
    first = bound[:-1][has]
    keys = np.zeros((len(texts), 2), _U)
    if len(has):
        place = np.arange(len(words)) - np.repeat(first, n[has])
        power, inverse = _power(int(n.max()))
        keys[has, 0] = mix(np.add.reduceat(words * power[place], first) + n[has].astype(_U))
        keys[has, 1] = mix(np.add.reduceat(mix(words ^ _MULT) * inverse[place], first))
    values = np.full((len(texts), K), 0xFFFFFFFF, np.uint32)
    long = np.flatnonzero(n >= NGRAM)
    if len(long):
        grams = _grams(words)
        at, stop = bound[:-1][long], bound[1:][long] - NGRAM + 1
        own = np.concatenate([grams[a:b] for a, b in zip(at, stop)])
        begin = np.concatenate(([0], np.cumsum(stop - at)[:-1]))
        # rows of texts at a time, so that n-grams stay in the processor's cache
        cut = np.flatnonzero(np.diff(begin >> 16, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(begin)]):
            part = own[begin[lo] : begin[hi] if hi < len(begin) else len(own)]
            where = begin[lo:hi] - begin[lo]
            for k in range(K):
                values[long[lo:hi], k] = np.minimum.reduceat((part * _SEEDS[0, k] + _SEEDS[1, k]) >> _U(32), where)
    for i in np.flatnonzero((n > 0) & (n < NGRAM)):
        values[i] = (_short(words[bound[i] : bound[i + 1]]) * _SEEDS[0] + _SEEDS[1]) >> _U(32)
    return [k.tobytes() for k in keys], n, values


def band_codes(values: np.ndarray) -> np.ndarray:
    """A code for each band of each signature: nodes share a band if codes are equal."""
    pairs = np.ascontiguousarray(values).view(_U).reshape(len(values), K // BAND, BAND // 2)
    code = np.repeat(np.arange(1, K // BAND + 1, dtype=_U)[None], len(values), axis=0)
    for k in range(BAND // 2):
        code = mix(code * _MULT + pairs[:, :, k])
    return code


def _described(batches: Batches) -> Batches:
    for batch in slices(batches):
        keys, n, values = describe(batch.column("text").to_pylist())
        signatures = pa.array([v.tobytes() for v in values], pa.binary())
        bands = pa.array(band_codes(values).view(np.int64).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), signatures, bands],
            ["doc_id", "text_hash", "node", "n_words", "signature", "bands"],
        )


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """By STEP, the fewest matches with which a pair goes on: with a uniform prior
    P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, K + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving(values: np.ndarray, side: np.ndarray | None, band: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (within a block, or one of each of two, as ``side`` says) whose
    first shared band is ``band`` and that are never pruned."""
    if side is None:
        i, j = np.triu_indices(len(values), 1)
    else:
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    codes = band_codes(values)
    first = (codes[i, band] == codes[j, band]) & ~(codes[i, :band] == codes[j, :band]).any(axis=1)
    i, j = i[first], j[first]
    m = np.zeros(len(i), np.int64)
    for step, enough in enumerate(least):
        span = slice(step * STEP, (step + 1) * STEP)
        m = m + (values[i, span] == values[j, span]).sum(axis=1)
        go = m >= enough
        i, j, m = i[go], j[go], m[go]
    return i, j


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, from the sets themselves."""
    size = np.array([len(s) for s in sets])
    common = np.zeros(len(i), np.int64)
    live = np.flatnonzero(np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9)
    if len(live) > 8 * len(sets):  # many pairs: count common members for all at once, some members at a time
        members, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(inverse, kind="stable")
        inverse, owner = inverse[order], owner[order]
        total = np.zeros((len(sets), len(sets)), np.float64)
        for lo in range(0, len(members), 4096):
            a, b = np.searchsorted(inverse, (lo, lo + 4096))
            grid = np.zeros((len(sets), 4096), np.float32)
            grid[owner[a:b], inverse[a:b] - lo] = 1
            total += grid @ grid.T
        common[live] = total[i[live], j[live]]
    else:
        for p in live:
            common[p] = len(np.intersect1d(sets[i[p]], sets[j[p]], assume_unique=True))
    return common >= threshold * (size[i] + size[j] - common) - 1e-9


def _paired(group: dict[str, list], least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of one block, or between two."""
    values = np.array([np.frombuffer(s, np.uint32) for s in group["signature"]])
    lo, hi = group["lo"][0], group["hi"][0]
    return surviving(values, None if lo == hi else np.array(group["block"]) == hi, group["band"][0], least)


def _survivors(least: list[int]) -> Callable[[dict[str, list]], list[tuple]]:
    def judge(group: dict[str, list]) -> list[tuple]:
        """(node, band, code, blocks, block) of the nodes with a surviving pair."""
        i, j = _paired(group, least)
        return [tuple(group[c][x] for c in ("node", "band", "code", "blocks", "block")) for x in np.union1d(i, j)]

    return judge


def _links(least: list[int], threshold: float) -> Callable[[dict[str, list]], list[tuple]]:
    def judge(group: dict[str, list]) -> list[tuple]:
        """(node, links found here, least node reached by them)."""
        nodes = group["node"]
        i, j = _paired(group, least)
        good = verified([np.frombuffer(s, _U) for s in group["grams"]], i, j, threshold)
        i, j = i[good], j[good]
        links = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
        order = np.array(sorted(range(len(nodes)), key=nodes.__getitem__))
        label = np.empty(len(nodes), np.int64)
        label[order] = np.arange(len(nodes))
        while True:
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            if (before == label).all():
                break
        return [(nodes[x], int(links[x]), nodes[order[label[x]]]) for x in np.flatnonzero(links)]

    return judge


def _by_group(judge: Callable[[dict[str, list]], list[tuple]], kinds: dict[str, pa.DataType]) -> Callable[[Batches], Batches]:
    """``judge`` for each group of rows, which come sorted by (code, lo, hi)."""

    def run(batches: Batches) -> Batches:
        current, group = None, {}

        def emit() -> Batches:
            if current is not None and len(group["node"]) > 1 and (found := judge(group)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds.values())], list(kinds))

        for batch in slices(batches):
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for x, key in enumerate(zip(columns["code"], columns["lo"], columns["hi"])):
                if key != current:
                    yield from emit()
                    current, group = key, {c: [] for c in columns}
                for c, values in columns.items():
                    group[c].append(values[x])
        yield from emit()

    return run


def _with_sets(batches: Batches) -> Batches:
    for batch in slices(batches):
        sets = [ngram_set(t).tobytes() for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sets, pa.binary())], [*keep, "grams"])


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"))


SPOT = "struct<band: int, code: bigint, blocks: int, block: int>"


def _dealt(nodes: DataFrame, judge: Callable[[dict[str, list]], list[tuple]], kinds: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``judge`` over all pairs of blocks of all buckets that ``spots`` names."""
    spots = nodes.select("*", F.explode("spots").alias("s")).drop("spots").select("*", "s.*").drop("s")
    pairs = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other")
    return pairs.repartition("code", "lo", "hi").sortWithinPartitions("code", "lo", "hi").mapInArrow(lean(_by_group(judge, kinds)), schema)


def buckets(nodes: DataFrame) -> DataFrame:
    """node and spots: the buckets of two or more nodes that it is in, with their
    number of blocks and its own block."""
    bands = nodes.select("node", "n_words", F.posexplode("bands").alias("band", "code"))
    shared = bands.groupBy("code").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    shared = materialize(shared.where("n > 1").select("code", "blocks"), "bands")
    spot = F.struct("band", "code", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    return bands.join(shared, "code").groupBy("node").agg(F.collect_list(spot).cast(f"array<{SPOT}>").alias("spots"))


def membership(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, class (key) and n_links (other texts within the
    threshold), a row for each row of ``docs``."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        return keep(materialize(_membership(docs, threshold), "membership"))


def _membership(docs: DataFrame, threshold: float) -> DataFrame:
    least = least_matches(threshold)
    own = _own(docs)
    described = materialize(own.mapInArrow(lean(_described), "doc_id long, text_hash long, node binary, n_words long, signature binary, bands array<long>"), "described")
    # one row a text: copies go before anything is paired
    nodes = materialize(
        described.where("n_words > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("place"), F.any_value("n_words").alias("n_words"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")),
        "nodes",
    )
    signed = nodes.select("node", "signature", "place")
    rough = materialize(buckets(nodes).join(signed.drop("place"), "node"), "buckets")
    kinds = {"node": pa.binary(), "band": pa.int32(), "code": pa.int64(), "blocks": pa.int32(), "block": pa.int32()}
    survivors = _dealt(rough, _survivors(least), kinds, "node binary, band int, code long, blocks int, block int")
    spots = survivors.groupBy("node").agg(F.collect_set(F.struct("band", "code", "blocks", "block")).cast(f"array<{SPOT}>").alias("spots"))
    wanted = materialize(spots.join(signed, "node"), "survivors").select(F.col("place.doc_id").alias("at"), F.col("place.text_hash").alias("hash"), "node", "signature", "spots")
    found = own.join(wanted, own["text_hash"].eqNullSafe(wanted["hash"]) & own["doc_id"].eqNullSafe(wanted["at"]))
    # rows that repeat an id and its text name one node several times: one is enough
    sets = found.select("node", "signature", "spots", "text").dropDuplicates(["node"]).mapInArrow(lean(_with_sets), f"node binary, signature binary, spots array<{SPOT}>, grams binary")
    kinds = {"node": pa.binary(), "links": pa.int64(), "peer": pa.binary()}
    linked = materialize(_dealt(materialize(sets, "sets"), _links(least, threshold), kinds, "node binary, links long, peer binary"), "links")
    roots = components(linked.select(F.col("node").alias("a"), F.col("peer").alias("b"))).select(F.col("a").alias("member"), F.col("b").alias("class"))
    counts = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = materialize(counts.join(roots, counts["node"] == roots["member"], "left").select(F.col("node").alias("linked"), "n_links", F.coalesce("class", "node").alias("class")), "classes")
    return described.select("doc_id", "text_hash", "node").join(known, F.col("node") == F.col("linked"), "left").select(
        "doc_id", "text_hash", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``membership`` with class_id, the least doc_id of the class."""
    every = membership(docs, threshold)
    least = materialize(every.groupBy("class").agg(F.min("doc_id").alias("class_id")).withColumnRenamed("class", "named"), "class-ids")
    return every.join(least, every["class"] == least["named"]).drop("named")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The row with the least doc_id of each class, with all its columns."""
    with scratch(docs.sparkSession) as keep:
        found = membership(docs, threshold)
        kept = keep(materialize(_kept(found), "kept"))
    names = docs.columns
    # columns go by their place, so that none can clash with the keys
    own = docs.select(docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("own_hash"), *(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    joined = own.join(kept, own["own_hash"].eqNullSafe(kept["hash"]) & own["own_id"].eqNullSafe(kept["id"]), "left_semi")
    return joined.dropDuplicates(["own_id", "own_hash"]).drop("own_id", "own_hash").toDF(*names)


def _kept(found: DataFrame) -> DataFrame:
    """id and hash of the text that stays of each class."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")
    return found.groupBy("class").agg(least).select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
