"""SimHash near-duplicates (operator 1): covering locality-sensitive hashing over 64-bit fingerprints."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import components, shield, table
from refaudit.session import stage_table

BITS = 64
SHINGLE = 3
RADIUS = 3
#: Fingerprints per text and radius where near copies are to be dropped: three-word shingles, independent hashes. A pair that shares 0.85 of
#: its five-word shingles lies within four bits in at least one of them in over 90 of 100 cases, one that shares 0.9 in 99 (simulated).
DROP_PRINTS, DROP_RADIUS = 10, 4
#: A bucket with more fingerprints than this is split on further masks instead of being compared in one piece.
BUCKET = 4096
#: Buckets with so few free bits hold at most 2^SMALL different fingerprints and are always compared in one piece.
SMALL = 12
#: Linked nodes that a task remembers before their edges leave.
REMEMBERED = 500_000


def _mixed(h: np.ndarray, number: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles: number 0 is the hash itself."""
    if number == 0:
        return h
    h = h + np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(text: bytes, width: int = SHINGLE, prints: int = 1) -> list[int]:
    """Majority bits of the XXH64 (seed 42) of all word shingles of the lower-cased text; no words: 0.

    Further fingerprints take further hashes of the same shingles.
    """
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return [0] * prints
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(width, len(words))
    starts, ends = (ends - sizes)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    ones, step = np.zeros((prints, BITS), np.int64), 1 << 16
    for at in range(0, len(starts), step):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at:at + step], ends[at:at + step], strict=True)], np.uint64)
        for j in range(prints):
            ones[j] += np.unpackbits(_mixed(hashes, j).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [sum(1 << i for i in np.flatnonzero(2 * row > len(starts)).tolist()) for row in ones]


def _fingerprint_column(width: int, prints: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprints((t or "").encode(), width, prints), np.uint64).view(np.int64) for t in texts], dtype=object)
    return run


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over ``bits`` such that any ``radius`` of these bits are all left out of some mask.

    Bit i gets a vector of radius + 1 binary digits and mask v holds the bits whose vector has an odd product with v. The
    vectors of ``radius`` bits span at most that many dimensions, so some v is orthogonal to them all: two fingerprints that
    differ in those bits only agree on mask v. The digits' own vectors come first: with more than ``radius`` bits they all occur,
    so no mask is empty.
    """
    digits, vectors = [1 << i for i in range(radius + 1)], (1 << (radius + 1)) - 1
    codes = digits + sorted(set(range(1, vectors + 1)).difference(digits), key=lambda v: xxhash.xxh64_intdigest(v.to_bytes(8, "little"), 42))
    code = {bit: codes[place % vectors] for place, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (code[bit] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(prints: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (node, root) that connect what is linked among the members: fewer than there are members."""
    order = np.lexsort((nodes, prints))
    prints, nodes = prints[order], nodes[order]
    new = np.concatenate([[True], prints[1:] != prints[:-1]])
    heads = np.flatnonzero(new)
    own = heads[np.cumsum(new) - 1]
    ends, roots = nodes[~new].tolist(), nodes[own[~new]].tolist()  # equal fingerprints
    left, names = prints[heads], nodes[heads]
    while left.size > 1:
        root, queue = names[0], [left[0]]
        left, names = left[1:], names[1:]
        while queue and left.size:
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            ends += names[near].tolist()
            roots += [int(root)] * int(near.sum())
            queue += list(left[near])
            left, names = left[~near], names[~near]
    return ends, roots


def _linker(masks: list[int], radius: int, limit: int):
    masks = np.array(masks, np.uint64)
    free = BITS - np.bitwise_count(masks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket. A bucket of up to ``limit`` rows is linked here; a larger one goes on to be split.

        Holds one bucket's first rows, up to ``limit``, and for up to ``REMEMBERED`` linked nodes the smallest node each is linked to
        so far: a node that meets the same group in many tables leaves as one edge.
        """
        bucket, prints, nodes, size, splitting = None, [], [], 0, False
        far: list = []
        top: dict[int, int] = {}  # of the nodes linked so far, one that is not larger

        def find(x: int) -> int:
            while (y := top.get(x, x)) != x:
                top[x] = x = top.get(y, y)
            return x

        def link(ends: list[int], roots: list[int]):
            for a, b in zip(map(find, ends), roots, strict=True):
                b = find(b)
                top[max(a, b)] = top[min(a, b)] = min(a, b)

        def close():
            if size > 1 and not splitting:
                link(*_forest(np.concatenate(prints), np.concatenate(nodes), radius))

        def linked():
            ends = list(top)
            out = pd.DataFrame({"a": np.array(ends, np.int64), "b": np.array(list(map(find, ends)), np.int64), "fp": np.int64(0), "t": np.int32(-1)})
            top.clear()
            return out[out["a"] != out["b"]]

        for rows in batches:
            t, fp, node = (rows[c].to_numpy() for c in ("t", "fp", "node"))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            key = fp & masks[t]
            cuts = np.concatenate([[0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]])
            worth = np.flatnonzero(np.diff(cuts) > 1)
            for i in np.unique(np.concatenate([[0], worth, [len(cuts) - 2]])).tolist():  # single rows meet nobody, unless at a batch's edge
                s, e = int(cuts[i]), int(cuts[i + 1])
                if bucket != (t[s], key[s]):
                    close()
                    bucket, prints, nodes, size, splitting = (t[s], key[s]), [], [], 0, False
                prints.append(fp[s:e])
                nodes.append(node[s:e])
                size += e - s
                if size > limit:
                    if free[t[s]] > max(SMALL, radius):
                        splitting = True
                    else:  # few different fingerprints, perhaps many rows of each: link equal ones and go on with one of each
                        p, n = np.concatenate(prints), np.concatenate(nodes)
                        ones, first, inverse = np.unique(p, return_index=True, return_inverse=True)
                        link(n.tolist(), n[first][inverse].tolist())
                        prints, nodes, size = [ones], [n[first]], len(ones)
                if splitting:
                    far += [(int(t[s]), p, n) for p, n in zip(prints, nodes, strict=True)]
                    prints, nodes = [], []
            if far:
                yield pd.concat([pd.DataFrame({"a": n, "b": n, "fp": p.view(np.int64), "t": np.int32(t)}) for t, p, n in far], ignore_index=True)
                far.clear()
            if len(top) > REMEMBERED:
                yield linked()
        close()
        yield linked()
    return run


def links(points: DataFrame, radius: int = RADIUS, prints: int = 1, limit: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` that connect all ``points(node, fps)`` with a fingerprint within ``radius`` bits of each other, as forests.

    Each fingerprint enters one table per covering mask, so every pair within the radius meets in one. A bucket of a mask is
    linked in memory, giving fewer edges than members. A bucket of more than ``limit`` rows is split: its members enter a
    covering of the bits that the mask leaves free, which again loses no pair. No sub-mask is empty, so each split leaves fewer
    free bits (about half), and a bucket with f free bits holds at most 2^f different fingerprints; one with ``SMALL`` (or
    ``radius``) free bits or fewer is not split further, so this ends for any input.
    """
    covering = covering_masks(radius, list(range(BITS)))
    masks = covering * prints
    t = F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t")
    level = points.select("node", "fps", t).select("t", F.element_at("fps", F.expr(f"t div {len(covering)} + 1").cast("int")).alias("fp"), "node")
    found = None
    while True:
        key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t") + 1))
        ordered = level.repartition(F.col("t"), key).sortWithinPartitions(F.col("t"), key)
        out = stage_table(ordered.mapInPandas(_linker(masks, radius, limit), "a long, b long, fp long, t int"), "simhash-links")
        edges = out.filter("t < 0 AND a <> b").select("a", "b")
        found = edges if found is None else found.union(edges)
        full = [row[0] for row in out.filter("t >= 0").select("t").distinct().collect()]  # table numbers: as many as there are masks at most
        if not full:
            return found.distinct()
        finer = [(old, masks[old] | m) for old in full for m in covering_masks(radius, [b for b in range(BITS) if not masks[old] >> b & 1])]
        choice = out.sparkSession.createDataFrame([(old, new) for new, (old, _) in enumerate(finer)], "t int, finer int")
        level = out.filter("t >= 0").join(F.broadcast(choice), "t").select(F.col("finer").alias("t"), "fp", F.col("a").alias("node"))  # as many rows per row as masks
        masks = [m for _, m in finer]


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS, prints: int = 1, limit: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(one row per input row ``doc_id, sig, fps, component_id``, one row per component ``root, component_id, keep``).

    ``sig`` is a hash of the text and ``keep`` the (doc_id, sig) of the row that stands for the component. Fingerprints are
    computed once and written with the ids; only rows with different fingerprints are linked, so copies never meet as pairs.
    NULL text counts as empty (fingerprint 0); NULL ids are the largest and are returned as they are; repeated rows share a
    component; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    sig = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    coded = stage_table(docs.select(F.col(doc_id).alias("doc_id"), sig.alias("sig"), _fingerprint_column(width, prints)(F.col(text)).alias("fps")), "simhash-codes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "sig")).alias("first")
    points = stage_table(coded.groupBy("fps").agg(F.min("doc_id").alias("low"), first).withColumn("node", F.monotonically_increasing_id()), "simhash-points")
    joined = components(links(points.select("node", "fps"), radius, prints, limit), "simhash-cc")
    rooted = points.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("keep"))
    names = rooted.select("fps", "root").join(groups.select("root", "component_id"), "root").select("fps", "component_id")
    return coded.join(names, "fps"), groups


def near_deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = DROP_RADIUS, prints: int = DROP_PRINTS, **options) -> DataFrame:
    """One row of each component (its smallest id) with the columns of ``docs``."""
    _, groups = near_groups(docs, text, doc_id, radius=radius, prints=prints, **options)
    keep = stage_table(groups.select(F.col("keep.id").alias("_id"), F.col("keep.sig").alias("_sig")), "simhash-keep")
    rows, named, restore = shield(docs, ())
    text, doc_id = named(text), named(doc_id)
    rows = rows.withColumn("_sig", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = rows.join(keep.withColumnRenamed("_sig", "_keep"), F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_sig") == F.col("_keep")), "left_semi")
    if rows.groupBy(doc_id).count().filter("count > 1").limit(1).count():  # ids repeat, perhaps whole rows
        kept = kept.dropDuplicates([doc_id, "_sig"])
    return restore(kept)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    rows, _ = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
