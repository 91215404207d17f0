"""Exact and near de-duplication, fingerprints and sharding against brute force on small tables."""
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from refaudit.llm import exact_dedup, sharding, simhash, spotsigs
from refaudit.llm.common import components

BLANK = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, kept string, _digest int, in0 string, `a.b` int"
LONG = "word ".join(str(i) for i in range(30_000))
ROWS = [(1, "a b c", "x", 1, "y", 1), (2, "abc", "x", 2, None, 2), (3, " a\tbc\n", "x", 3, None, 3), (4, None, None, None, None, 4), (5, "", None, None, None, 5), (6, " \n ", "k", 1, "y", 6),
        (7, "A b c", "x", 1, "y", 7), (None, "abc", "x", 1, "y", 8), (8, LONG, "l", 1, "y", 9), (9, LONG + " ", "l", 1, "y", 10), (10, "only", "l", 1, "y", 11), (10, "only", "l", 1, "y", 11), (11, "d\xa0e", "q", 1, "y", 12)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def expected_groups(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(BLANK.sub("", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(c, 1, 1).cast("binary"), lambda c: F.lit(b"same")])
def test_exact_groups(docs, digest):
    """Also with digests that different contents share."""
    want = expected_groups(ROWS)
    got = exact_dedup.exact_duplicates(docs, salts=2, digest=digest)
    assert got.columns == ["doc_id", "text", "_digest", "in0", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        content = BLANK.sub("", r["text"] or "")
        assert (r["keep_id"], r["group_size"]) == want[content]
        assert r["text_sha256"] == hashlib.sha256(content.encode()).hexdigest()
    kept = [BLANK.sub("", r["text"] or "") for r in rows if r["kept"]]
    assert sorted(kept) == sorted(want)  # one row of each group, repeated rows included


def test_exact_keeps_columns_and_empty_table(docs, spark):
    out = exact_dedup.deduplicate(docs)
    assert out.schema == docs.schema and out.count() == len(expected_groups(ROWS))
    assert exact_dedup.deduplicate(docs.limit(0)).collect() == []


def brute_fingerprint(text, seed_words=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + seed_words]) for i in range(len(words) - seed_words + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def near_texts(n=60, seed=5):
    """Random texts, near copies of some (one to three words changed), short and empty ones."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = []
    for i in range(n):
        if i % 3 and texts:
            own = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 3)):
                if own:
                    own[rng.integers(len(own))] = "Changed"
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(words[rng.integers(0, 3000, rng.integers(0, 300))]))
    return [*texts, "", None, "one", "ONE", "one two"]


def test_masks_cover_every_pair():
    from itertools import combinations
    for radius, bits in ((1, range(8)), (2, range(10)), (3, range(14))):
        masks = simhash.covering_masks(radius, list(bits))
        for k in range(radius + 1):
            for flips in combinations(bits, k):
                assert any(not sum(1 << f for f in flips) & m for m in masks)


@pytest.mark.parametrize("radius,limit", [(3, 4096), (6, 4096), (3, 4)])
def test_simhash_components(spark, radius, limit):
    """Also with buckets so small that they are split on further masks."""
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, _ = simhash.near_groups(df, radius=radius, limit=limit)
    got = {r["doc_id"]: r for r in rows.collect()}
    want = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fps"][0] % (1 << 64) for i in range(len(texts))] == want
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(want, radius)


def test_simhash_dense_bucket(spark):
    """A group that holds many fingerprints of one neighbourhood, far over the bucket limit, and many equal ones."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    values = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))] + [int(x) for x in rng.integers(0, 1 << 62, 20)]
    points = spark.createDataFrame([(i, [v - (1 << 64) if v >> 63 else v]) for i, v in enumerate(values)], "node long, fps array<long>")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, 3, limit=3), "t").collect()}
    want = brute_components(values, 3)
    assert [roots.get(i, i) for i in range(len(values))] == want


def test_simhash_splits_at_the_wider_radius(spark):
    """Every sub-mask at radius 4 grows and the covering still meets every pair; a bucket over the limit is split to its end."""
    from itertools import combinations
    for n in (13, 14, 15, 30, 32):
        masks = simhash.covering_masks(4, list(range(n)))
        assert all(masks)
        assert all(any(not sum(1 << f for f in flips) & m for m in masks) for flips in combinations(range(min(n, 15)), 4))
    base = int(np.random.default_rng(2).integers(1 << 62))
    values = [base ^ (3 << i) for i in range(12)]
    points = spark.createDataFrame([(i, [v]) for i, v in enumerate(values)], "node long, fps array<long>")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, 4, limit=4), "t").collect()}
    assert [roots.get(i, i) for i in range(12)] == brute_components(values, 4)


def test_near_deduplicate(spark):
    texts = near_texts(30)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "alone in the world of words", "s")], "doc_id long, text string, _sig string")
    out = simhash.near_deduplicate(df, radius=3, prints=1)
    want = brute_components([brute_fingerprint(t) for t in texts], 3)
    assert out.schema == df.schema
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, i) for i in sorted(set(want))] + [(True, None)]
    assert simhash.near_deduplicate(df.limit(0)).collect() == []


def test_near_stage_links_by_fingerprints(spark):
    """The pipeline's stage keeps the smallest id of each component of operator 1, no more and no less."""
    texts = near_texts(30)
    out = corpus_pipeline.near(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute_components([brute_fingerprint(t) for t in texts], 3)))


def test_more_fingerprints_catch_near_copies(spark):
    """Pairs that share four fifths of their five-word shingles, most found; unrelated texts stay apart."""
    rng = np.random.default_rng(3)
    pairs = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        other = list(words)
        for at in range(20, 400, 75):
            other[at] = "new"
        pairs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.near_deduplicate(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(40))
    assert sum(2 * i + 1 not in kept for i in range(40)) >= 30


def test_fingerprints_of_edits(spark):
    texts = ["The cat of the house sat on a mat and the dog slept.", "the cat of the house sat on a mat and the dog slept", None, "", "12 34", "12 34", "x", "The cat of the house sat on a mat and the dog slept.", "Ünï çödé der Hund und die Katze " * 300, "the " * 100_000, "of"]
    df = spark.createDataFrame([(10 * i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, next_text string").repartition(3)
    rows = {r["doc_id"] // 10: r for r in spotsigs.compare_with_edits(df).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        after, tail = plain[(i + 1) % len(plain)], len(t) // 4
        r = rows[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256((t[:len(t) - tail] + after[:tail]).encode()).hexdigest()
        a, b, c = (set(re.findall("........", x)) for x in (r["fingerprint"], r["edited_fingerprint"], rows[(i + 1) % len(plain)]["fingerprint"]))
        for got, other in ((r["near_edited"], b), (r["near_next"], c)):
            assert got == pytest.approx(len(a & other) / len(a | other) if a | other else 1.0)
    assert rows[0]["fingerprint"] == rows[7]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["near_next"] == 1.0
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == "" and rows[4]["fingerprint"] == rows[5]["fingerprint"] != ""
    assert spotsigs.compare_with_edits(df.limit(0)).collect() == []
    lone = spotsigs.compare_with_edits(df.filter("doc_id = 0")).first()
    assert lone["near_next"] == 1.0


@pytest.mark.parametrize("bucket,ranges", [(4, 8), (1, 256), (2048, 256)])
def test_next_row_whatever_the_ids(spark, monkeypatch, bucket, ranges):
    """Dense ids beside the widest ones, sparse and repeated ids, rows without id."""
    monkeypatch.setattr(spotsigs, "BUCKET", bucket)
    monkeypatch.setattr(spotsigs, "RANGES", ranges)
    ids = [*range(60), *[7_000_000_000 + 10 ** k for k in range(15)], -(2 ** 63), -9 * 10 ** 18, 4 * 10 ** 18, 2 ** 63 - 1]
    rows = [(i, f"t{i}") for i in ids] + [(5, "t5"), (None, "none"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = spotsigs.with_next(df, "doc_id", ["text"], lambda d: d).collect()
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert sorted((r["text"], r["next_text"]) for r in got) == sorted(zip(order, order[1:] + order[:1]))


def test_fingerprints_of_wide_ids(spark):
    df = spark.createDataFrame([(-9 * 10 ** 18, "the red house of the old town"), (5, "a house"), (9 * 10 ** 18, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in spotsigs.compare_with_edits(df).collect()}
    assert len(rows) == 3 and rows[5]["edited_sha256"] == hashlib.sha256(b"a hous").hexdigest()
    lost = spotsigs.compare_with_edits(df.withColumn("doc_id", F.lit(None).cast("long")))
    assert lost.count() == 3


def test_spot_pairs_lose_no_link(spark):
    rng = np.random.default_rng(9)
    common = ["the", "of", "and", "is"]
    texts = []
    for i in range(40):
        if i % 2:
            words = texts[-1].split()
            words[int(rng.integers(len(words)))] = "other"
        else:
            words = [common[int(rng.integers(4))] if rng.random() < .4 else f"{chr(97 + int(x))}{chr(97 + int(y))}" for x, y in rng.integers(0, 26, (80, 2))]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, texts[0])], "doc_id long, text string")
    members, links = spotsigs.near_duplicates(df, 0.7)
    codes = {r[0]: set(r[1]) for r in spotsigs.with_signatures(df.filter("doc_id < 99"), "text", "codes").select("doc_id", "codes").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert classes[99] == 0
    ids = sorted(set(classes.values()))
    want = {(a, b) for a in ids for b in ids if a < b and len(codes[a] & codes[b]) >= 0.7 * len(codes[a] | codes[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == want and want


def brute_shards(rows, limit):
    def bits(key):
        text = "\x1f".join("n" if k is None else f"v{k}" for k in key)
        return format(int(hashlib.md5(text.encode()).hexdigest()[:15], 16), "060b")
    items = [(bits(k), n or 0) for k, n in rows]

    def walk(prefix):
        own = [x for x in items if x[0].startswith(prefix)]
        if not own:
            return {}
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) == 1:
            return {prefix: own}
        return walk(prefix + "0") | walk(prefix + "1")
    return walk(""), bits


def test_shards_match_extendible_hashing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 900))) for i in range(120)] + [(None, 50), (500, 5000), *[(777, 400)] * 9, (600, None)]
    df = spark.createDataFrame([(i, "x" * n if n is not None else None, "p") for i, n in rows], "doc_id long, text string, page string").repartition(4)
    out = sharding.shard(df, ["doc_id"], F.octet_length("text"), 1000)
    want, bits = brute_shards([((i,), n) for i, n in rows], 1000)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "text", "shard", "depth", "shard_bytes", "shard_rows", "page"]
    sizes = {}
    for r in got:
        assert r["shard"] in want and bits((r["doc_id"],)).startswith(r["shard"]) and r["depth"] == len(r["shard"])
        assert (r["shard_bytes"], r["shard_rows"]) == (sum(n for _, n in want[r["shard"]]), len(want[r["shard"]]))
        sizes.setdefault((r["shard"], r["page"]), []).append(len(r["text"] or ""))
    assert all(sum(x) <= 1000 or len(x) == 1 for x in sizes.values())
    assert max(p for _, p in sizes) == 4  # nine rows of 400 bytes: two to a page
    assert sharding.shard(df.limit(0), ["doc_id"], F.octet_length("text")).collect() == []


def test_hot_key_is_numbered_in_many_tasks(spark, monkeypatch):
    parts, stage = [], sharding.stage_table

    def watch(df, label):
        out = stage(df, label)
        if label == "shard-overflow":
            parts.append(out.select("_part").distinct().count())
        return out
    monkeypatch.setattr(sharding, "stage_table", watch)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(-7 if i % 3 == 0 else i, "x" * 10) for i in range(900)], "doc_id long, text string").repartition(6)
        pages = sharding.shard(df, ["doc_id"], F.length("text"), 100).filter("doc_id = -7").groupBy("page").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts == [6] and sorted((r["page"], r["count"]) for r in pages) == [(i, 10) for i in range(30)]


def test_deep_shards(spark, monkeypatch):
    """Prefixes longer than one pass looks at."""
    monkeypatch.setattr(sharding, "CHUNK", 3)
    rows = [(i, 10) for i in range(200)]
    df = spark.createDataFrame([(i, "x" * n) for i, n in rows], "doc_id long, text string")
    want, _ = brute_shards([((i,), n) for i, n in rows], 25)
    assert {r["shard"] for r in sharding.shard(df, ["doc_id"], F.length("text"), 25).collect()} == set(want)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "s"), ["doc_id"], F.length("text"), 400)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and back.groupBy("shard", "page").agg(F.sum(F.length("text")).alias("n")).filter("n > 400").count() == 0
