"""Near copies by exact five-word Jaccard: min-hash bands propose pairs, the texts decide each link."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import components, shield, word_codes
from refaudit.session import stage_table

WIDTH = 5
THRESHOLD = 0.8
#: Minima of ``ROWS`` hashes make a band. A pair at 0.8 shares none of the bands in (1 - 0.8^5)^48 = 5e-9 of all cases.
BANDS, ROWS = 48, 5
#: Pairs that agree in a smaller share of all minima are not compared by text: 0.65 lies 5.8 standard deviations below 0.8.
FLOOR = 0.65
#: Members of a bucket that one task compares with as many others.
CELL = 2048
#: Texts are taken together up to about so many bytes, so that their hashes stay in the cache.
BLOCK = 256 << 10

_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_ODD = _rng.integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles (A-Z lower-cased); fewer words make one shingle, none an empty set."""
    codes, counts, words = word_codes([t.lower() for t in texts])
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts.tolist():
        own, at = hashes[at:at + n], at + n
        w = min(width, n)
        h = np.full(max(0, n - w + 1) if n else 0, w, np.uint64)
        for j in range(w):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[j:j + len(h)])
        out.append(np.unique(h))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set: the least value of each of the ``BANDS * ROWS`` hash functions over it; an empty set has the largest value."""
    out = np.full((len(sets), BANDS * ROWS), (1 << 32) - 1, np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(sizes) - sizes)[some]
    v, w = np.empty_like(h), np.empty_like(h)
    for k in range(out.shape[1]):
        np.bitwise_xor(h, _XOR[k], out=v)
        np.multiply(v, _ODD[0, k], out=v)
        np.right_shift(v, np.uint32(15), out=w)
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, _ODD[1, k], out=v)
        out[some, k] = np.minimum.reduceat(v, starts)
    return out


def _blocks(texts: pd.Series) -> Iterator[list[bytes]]:
    block, size = [], 0
    for t in texts:
        block.append((t or "").encode())
        size += len(block[-1])
        if size > BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _signatures(width: int):
    @F.pandas_udf("struct<bands:array<long>,sketch:binary>")
    def run(texts: pd.Series) -> pd.DataFrame:
        bands, sketches = [], []
        for block in _blocks(texts):
            for low in minima(shingle_sets(block, width)):
                parts = low.reshape(BANDS, ROWS)
                bands.append(np.array([xxhash.xxh64_intdigest(p.tobytes(), b) for b, p in enumerate(parts)], np.uint64).view(np.int64))
                sketches.append((low >> np.uint32(7)).astype(np.uint8).tobytes())
        return pd.DataFrame({"bands": pd.Series(bands, dtype=object), "sketch": pd.Series(sketches, dtype=object)})
    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets without repeats; two empty sets are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def _proposer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell. Holds one cell: up to about ``CELL`` rows a side. Proposes for each row its ``width`` likeliest partners of each other component."""
        def pairs(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            left, right = rows[rows["side"] != 1], rows[rows["side"] != 0]
            if left.empty or right.empty:
                return
            names, labels = right["node"].to_numpy(), right["label"].to_numpy()
            seen = np.frombuffer(b"".join(right["sketch"]), np.uint8).reshape(len(right), -1)
            own = np.frombuffer(b"".join(left["sketch"]), np.uint8).reshape(len(left), -1)
            found: list[tuple] = []
            for i, (node, label) in enumerate(zip(left["node"].tolist(), left["label"].tolist(), strict=True)):
                others = np.flatnonzero(labels != label)
                same = (seen[others] == own[i]).sum(axis=1)
                near = same >= FLOOR * seen.shape[1]
                found.append((np.full(near.sum(), node), names[others[near]], np.full(near.sum(), label), labels[others[near]], same[near]))
            a, b, la, lb, same = map(np.concatenate, zip(*found, strict=True))
            picked, cut = np.zeros(len(a), bool), np.zeros(len(a), bool)
            for x, lx, y in ((a, lb, b), (b, la, a)):
                order = np.lexsort((y, -same, lx, x))
                new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (lx[order][1:] != lx[order][:-1])]) if len(order) else np.zeros(0, bool)
                rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, int)
                picked[order[rank < width]] = True
            cut[:] = not picked.all()
            a, b, cut = a[picked], b[picked], cut[picked]
            for at in range(0, len(a), 100_000):
                x, y = a[at:at + 100_000], b[at:at + 100_000]
                yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y), "cut": cut[at:at + 100_000]})

        held, cell = [], None
        for batch in batches:
            rows = batch.to_pandas()
            for key, part in rows.groupby(["key", "low", "high"], sort=False):
                if key != cell:
                    if held:
                        yield from pairs(pd.concat(held))
                    held, cell = [], key
                held.append(part)
        if held:
            yield from pairs(pd.concat(held))
    return run


def _sets(width: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([own.view(np.int64) for block in _blocks(texts) for own in shingle_sets(block, width)], dtype=object)
    return run


def _length_bands(threshold: float) -> list[int]:
    """Lower ends of bands of set sizes; about ten bands lie between a size and its smallest partner's."""
    ends = [1]
    while ends[-1] < 1 << 30:
        ends.append(max(ends[-1] + 1, int(ends[-1] * threshold ** -0.1)))
    return ends


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, node, role): where sets of ``sets(node, s)`` meet if their Jaccard similarity can reach ``threshold``.

    Shingles are ordered from rare to frequent. Sets of n and m elements at the threshold t share a >= t / (1 + t) (n + m), so one of the
    shared ones is among the first n - a + 1 of the one and the first m - a + 1 of the other. The smaller set (role 0) is met in its
    own band of sizes by its first ninth (at 0.8); a larger one (role 1) looks into each band of possible partners with as many as
    that band demands. A member of a family that differs from all others in a ninth of its shingles meets nobody. Shingles of one set
    only come first and are not written at all.
    """
    share = threshold / (1 + threshold)
    counts = sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c")).filter("c > 1")
    each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("x")).join(counts, "x")
    ordered = each.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "x"))).alias("o"))
    ends = _length_bands(threshold)
    starts = F.array(*map(F.lit, ends))
    at = lambda v: F.size(F.filter(starts, lambda e: e <= v)) - 1
    n, own = F.col("n"), F.col("n") - F.size("o")  # elements that no other set has

    def first(need: Column) -> Column:
        """Shared elements among the first n - need + 1."""
        return F.slice("o", F.lit(1), F.greatest(F.lit(0), F.least(F.size("o"), n - need + 1 - own)))
    demand = lambda m: F.ceil(F.lit(share) * (n + m) - F.lit(1e-9)).cast("int")
    least = F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int")
    mine = F.transform(first(demand(n)), lambda x: F.struct(F.xxhash64(at(n), x["x"]).alias("key"), F.lit(0).alias("role")))
    seek = F.flatten(F.transform(F.sequence(at(least), at(n)), lambda b: F.transform(
        first(demand(F.greatest(least, F.get(starts, b)))), lambda x: F.struct(F.xxhash64(b, x["x"]).alias("key"), F.lit(1).alias("role")))))
    return ordered.select("node", F.inline(F.concat(mine, seek))).select("key", "node", "role")


def links(points: DataFrame, texts: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """``(node, label)`` of all linked nodes: components of the pairs of ``points(node, doc_id, sig, bands, sketch)`` whose texts are ``threshold`` alike.

    First each node is compared with the smallest node it shares a band with. Nodes in bands that still hold several components are then
    joined exactly: by the prefixes of their shingle sets, each node with its likeliest partners in each other component, of
    those not compared before, and ever more of them until none is left. A pair is linked by its shingles only.
    """
    banded = points.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("size")).filter("size > 1")
    met = stage_table(banded.join(shared, "key").select("key", "node", "first"), "shingle-buckets")
    asked = stage_table(met.filter("node > first").groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), "shingle-asked")
    same_row = points["doc_id"].eqNullSafe(texts["doc_id"]) & (points["sig"] == texts["sig"])

    def sets_of(ids: DataFrame) -> DataFrame:
        """Shingle sets of some nodes: the only place where texts are read again."""
        wanted = points.join(ids, "node", "left_semi").join(texts, same_row).select("node", "text").dropDuplicates(["node"])
        return stage_table(wanted.select("node", _sets(width)("text").alias("s")), "shingle-sets")

    def judged(asked: DataFrame, sets: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"_{c}")) for c in "ab")
        both = F.size(F.array_intersect("_a", "_b"))
        either = F.size("_a") + F.size("_b") - both
        alike = F.when(either > 0, both >= F.lit(threshold) * either).otherwise(True)  # two texts without words are equal
        return stage_table(asked.join(left, "a").join(right, "b").select("a", "b", alike.alias("alike")), "shingle-judged")

    def labelled(checked: DataFrame) -> DataFrame:
        return stage_table(components(checked.filter("alike").select("a", "b"), "shingle-cc").select("node", F.col("root").alias("label")), "shingle-labels")
    met_nodes = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct()
    sets = sets_of(met_nodes)
    checked = judged(asked, sets)
    labels = labelled(checked)
    rows = met.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key")
    open_nodes = stage_table(rows.join(mixed, "key", "left_semi").select("node").distinct(), "shingle-open")
    places = stage_table(_prefixes(sets.join(open_nodes, "node", "left_semi").filter(F.size("s") > 0), threshold), "shingle-places")
    most = 1
    while True:
        rows = places.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sides = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"))
        rows = rows.join(sides.filter("l < h and n0 > 0 and n1 > 0").drop("l", "h"), "key").join(points.select("node", "sketch"), "node")
        parts = [F.ceil(F.col(f"n{i}") / cell).cast("int") for i in (0, 1)]
        own = F.when(F.col("role") == 0, F.pmod(F.xxhash64("node"), parts[0])).otherwise(F.pmod(F.xxhash64("node"), parts[1])).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, parts[1]).otherwise(parts[0]) - 1)))
        low, high = F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))
        rows = rows.select("key", low.alias("low"), high.alias("high"), F.col("role").alias("side"), "node", "label", "sketch")
        cells = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        proposed = cells.mapInArrow(_proposer(most), "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut"))
        proposed = stage_table(proposed, "shingle-proposed")
        asked = stage_table(proposed.select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti"), "shingle-asked")
        if asked.limit(1).count():
            checked = checked.union(judged(asked, sets))
            labels = labelled(checked)
        elif not proposed.filter("cut").limit(1).count():
            return labels
        most *= 8


def near_deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """One row of each group of near copies (its smallest id) with the columns of ``docs``.

    Two rows are linked if their sets of five-word shingles have a Jaccard similarity of ``threshold`` or more. NULL text counts as
    empty; NULL ids are the largest; rows of one id and text count once.
    """
    rows, named, restore = shield(docs, ())
    text, doc_id = named(text), named(doc_id)
    rows = rows.withColumn("_sig", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = rows.select(F.col(doc_id).alias("doc_id"), F.col("_sig").alias("sig"), F.col(text).alias("text"))
    coded = texts.select("doc_id", "sig", _signatures(width)("text").alias("s")).select("doc_id", "sig", "s.bands", "s.sketch")
    once = coded.groupBy("doc_id", "sig").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    points = stage_table(once.withColumn("node", F.monotonically_increasing_id()), "shingle-points")
    labels = links(points, texts, width, threshold, cell)
    rooted = points.select("node", "doc_id", "sig").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "sig")).alias("keep")
    keep = stage_table(rooted.groupBy("label").agg(first).select(F.col("keep.id").alias("_id"), F.col("keep.sig").alias("_keep")), "shingle-keep")
    kept = rows.join(keep, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_sig") == F.col("_keep")), "left_semi")
    if rows.groupBy(doc_id).count().filter("count > 1").limit(1).count():  # ids repeat, perhaps whole rows
        kept = kept.dropDuplicates([doc_id, "_sig"])
    return restore(kept)
