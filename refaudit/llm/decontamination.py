"""Benchmark decontamination: a prefix-filtered join of item windows with documents (operator 12, DataFrame functions only)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import lower_ascii, shield, table
from refaudit.session import stage_table

#: Anything but digits, letters and characters beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and words of the shingles by which windows and documents meet.
WINDOW, SHINGLE = 10, 5
#: Windows that are broadcast at once (about 300 bytes each); more of them are searched block by block.
BLOCK = 200_000
#: Ways in which a window's documents are dealt out.
SALTS = 16


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; NULL has none."""
    return F.array_remove(F.split(lower_ascii(text), GAPS), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from ``at``; widths never share hashes by their words alone."""
    return F.xxhash64(F.lit(width), *[F.get(words, at + i) for i in range(width)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, at, win)``: every run of ``window`` words of ``items(item, words)``; an item of fewer words, but not none, is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return items.filter(F.size("words") > 0).select("item", "words", F.explode(starts).alias("at")).select("item", "at", F.slice("words", F.col("at") + 1, window).alias("win"))


def _shingles_of(windows: DataFrame, width: int) -> DataFrame:
    """``(wid, offset, key)``: the shingles inside each window; a window of fewer words has one shingle of all of them."""
    per = []
    for w in range(1, width + 1):
        sized = windows.filter(F.size("win") == w) if w < width else windows.filter(F.size("win") >= w)
        at = sized.select("wid", "win", F.explode(F.sequence(F.lit(0), F.size("win") - w)).alias("offset"))
        per.append(at.select("wid", "offset", F.lit(w).alias("width"), _shingle(F.col("win"), F.col("offset"), w).alias("key")))
    return reduce(DataFrame.unionByName, per)


def _exploded(docs: DataFrame, widths: list[int]) -> DataFrame:
    """One row per word of a document (one with NULL ``pos`` for a document without words) and per width, with the shingle that begins there."""
    at = docs.select("row", "carry", "words", F.posexplode_outer("words").alias("pos", "_word")).drop("_word")
    keys = [_shingle(F.col("words"), F.col("pos"), w) for w in widths]
    return at.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))


def _covered(spans: Column) -> Column:
    """Number of positions in the union of ``array<struct<start, stop>>``."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["stop"]).alias("to"))
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, width: int = SHINGLE, block: int = BLOCK,
                  columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with all its columns (or those of ``columns``) and ``n_words, n_hit, items``.

    A window is ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document
    word inside any occurrence of a window is hit; ``items`` are the ids of the items with occurring windows, sorted as strings.

    Windows are sets of ``width``-word shingles ordered by rarity among the documents. An occurrence holds every shingle, so each
    window joins by its rarest one alone; the window must lie inside the document at the place which that shingle fixes, and its
    words are compared there. Windows are broadcast ``block`` at a time; documents are shuffled once, by row, without their words.

    NULL texts and texts without words are not hit, whatever the items; items without words or id occur nowhere; repeated items
    and rows are treated alike; an empty table gives none. Old columns of the three new names are left out.
    """
    rows, named, _ = shield(docs, ("n_words", "n_hit", "items"))
    kept = [c for c in docs.columns if (columns is None or c in columns) and c.lower() not in ("n_words", "n_hit", "items")]
    carry = [F.col(named(c)).alias(c) for c in kept] or [F.lit(None).alias("_")]
    split = rows.select(F.struct(*carry).alias("carry"), F.monotonically_increasing_id().alias("row"), words(F.col(named(text))).alias("words"))
    asked = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("words")).filter("item is not null")
    held = item_windows(asked, window)
    distinct = stage_table(held.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    inside = stage_table(_shingles_of(distinct, width), "window-shingles")
    total = distinct.count()
    blocks = max(1, -(-total // block))
    widths = [r[0] for r in inside.select("width").distinct().orderBy("width").collect()] or [width]  # at most ``width`` of them
    if blocks > 1:
        split = stage_table(split, "document-words")

    part = lambda df, b: df if blocks == 1 else df.filter(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b)
    plain = split.select("row", F.lit(None).cast("string").alias("carry"), "words")
    counted = [_exploded(plain, widths).join(F.broadcast(part(inside, b).select("key").distinct()), "key").select("key") for b in range(blocks)]
    # a shingle of several blocks is counted in each: divided by the blocks that hold it, the order stays that of the documents
    seen = stage_table(reduce(DataFrame.union, counted).groupBy("key").agg(F.count("*").alias("seen")), "shingle-counts")
    if blocks > 1:
        shared = inside.groupBy("key").agg(F.countDistinct(F.pmod(F.xxhash64("wid"), F.lit(blocks))).alias("_in"))
        seen = seen.join(shared, "key").select("key", (F.col("seen") / F.col("_in")).alias("seen"))
    rare = inside.join(seen, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "key")).alias("rare"))
    prefix = rare.filter("rare.seen > 0").select("wid", "rare.key", "rare.offset").join(distinct, "wid")  # a window with an unseen shingle occurs nowhere
    prefix = stage_table(prefix.select("wid", "key", "offset", "win", F.size("win").alias("length")), "window-prefixes")

    start = F.col("pos") - F.col("offset")
    found = []
    for b in range(blocks):
        at = _exploded(split.select("row", "carry" if b == 0 else F.lit(None).cast(split.schema["carry"].dataType).alias("carry"), "words"), widths)
        own = F.broadcast(part(prefix, b).withColumnRenamed("key", "_key"))
        fits = (start >= 0) & (start + F.col("length") <= F.size("words"))
        same = F.slice("words", start + 1, F.col("length")) == F.col("win")
        met = at.join(own, (F.col("key") == F.col("_key")) & fits & same, "left")
        first = (F.coalesce("pos", F.lit(0)) == 0) if b == 0 else F.lit(False)
        met = met.filter(F.col("wid").isNotNull() | first)
        span = F.when(F.col("wid").isNotNull(), F.struct(start.alias("start"), (start + F.col("length")).alias("stop")))
        found.append(met.select("row", F.when(first, F.col("carry")).alias("carry"), F.when(first, F.size("words")).alias("n"), span.alias("span"), "wid"))
    hits = reduce(DataFrame.union, found).groupBy("row").agg(F.first("carry", True).alias("carry"), F.max("n").alias("n"), F.collect_set("span").alias("spans"), F.collect_set("wid").alias("wids"))
    hits = hits.select("row", "carry", F.col("n").cast("long").alias("n_words"), _covered(F.col("spans")).cast("long").alias("n_hit"), "wids")
    hits = stage_table(hits, "document-hits")

    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    theirs = held.join(distinct, "win").select("wid", "item").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = hits.select("row", F.explode("wids").alias("wid")).withColumn("salt", salt).join(theirs, ["wid", "salt"])
    of = of.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = hits.drop("wids").join(of, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(*[F.col("carry").getField(c).alias(c) for c in kept], "n_words", "n_hit", "items")


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = contamination(docs, table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    joined = F.concat_ws(",", "items")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op12_decontamination": op12_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {"op12_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS k
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT r, s, grams.k, item FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS p FROM (SELECT DISTINCT r, s, k FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""}
