"""Sharding by extendible hashing (operator 2), DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.llm.common import shield, table
from refaudit.session import stage_table

#: Bytes of a shard in the registered query.
SHARD_BYTES = 1 << 20
#: Hash bits in use, and bits looked at in one pass over the sizes.
HASH_BITS = 60
CHUNK = 20
#: Levels whose prefixes are broadcast in the first pass: below 2^BROAD rows.
BROAD = 10


def key_hash(*columns: Column) -> Column:
    """First 60 bits of the MD5 of the columns' texts, as a non-negative long. NULL counts as a text of its own."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: Column) -> Column:
    """The first ``depth`` bits of a hash, as a long."""
    return F.call_function("shiftright", F.col(h), (F.lit(HASH_BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory for ``sizes(h, bytes, rows)``, one row per distinct hash: ``h, depth``.

    Starts from the empty prefix. A bucket over ``limit`` that holds more than one hash is split on its next bit, so
    depth grows only where it is needed: a hash's depth is the number of its prefixes that are too large. Sizes are
    first combined per prefix of ``CHUNK`` bits, and the sums of all shorter prefixes come from those: at most 2^CHUNK rows
    in the first pass however many documents there are. Only hashes in buckets still too large go on to the next bits.
    """
    done, rest, base = None, sizes.select("h", "bytes"), 0
    while True:
        top = min(base + CHUNK, HASH_BITS)
        fine = rest.groupBy(_prefix("h", F.lit(top)).alias("p")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last"))
        fine = stage_table(fine, "shard-fine")
        levels = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("d"))
        levels = levels.withColumn("q", F.call_function("shiftright", F.col("p"), (F.lit(top) - F.col("d")).cast("int")))
        large = levels.groupBy("d", "q").agg(F.sum("bytes").alias("total"), F.min("first").alias("first"), F.max("last").alias("last")).filter((F.col("total") > limit) & (F.col("first") < F.col("last")))
        large = stage_table(large.select("d", "q"), "shard-large")
        wide, narrow = F.col("d") < base + BROAD, F.col("d") >= base + BROAD  # few wide prefixes, each over many rows: at most 2^BROAD per bucket split
        met = levels.filter(wide).join(F.broadcast(large.filter(wide)), ["d", "q"]).select("p") if base == 0 else levels.filter(wide).join(large.filter(wide), ["d", "q"]).select("p")
        deep = met.union(levels.filter(narrow).join(large.filter(narrow), ["d", "q"]).select("p")).groupBy("p").agg(F.count("*").alias("over"))
        leaf = fine.select("p").join(deep, "p", "left").select("p", (F.lit(base) + F.coalesce("over", F.lit(0))).alias("depth"))
        leaf = stage_table(leaf, "shard-leaf")
        found = rest.withColumn("p", _prefix("h", F.lit(top))).join(leaf, "p")
        settled = found.filter(F.col("depth") <= top).select("h", "depth")
        done = settled if done is None else done.union(settled)
        if top == HASH_BITS:
            return done.union(found.filter(F.col("depth") > top).select("h", F.lit(HASH_BITS).cast("long").alias("depth")))
        if leaf.filter(F.col("depth") > top).limit(1).count() == 0:
            return done
        rest, base = found.filter(F.col("depth") > top).select("h", "bytes"), top + 1


def shard(docs: DataFrame, key: list[str], size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (its hash prefix as bits), ``depth``, ``shard_bytes``, ``shard_rows`` and ``page``.

    Rows of one key share a hash and cannot be told apart by further bits. Such a bucket over the limit gets overflow pages:
    its rows are numbered and each page takes as many as fit (one at least, so a row larger than the limit has a page of
    its own). ``shard_bytes`` and ``shard_rows`` count the whole bucket. Numbers within a key are a rank inside one input
    partition plus the counts of the partitions before, so a key with a third of all rows is numbered in many tasks.

    NULL keys and NULL sizes (counted as 0) are kept; repeated rows each count; an empty table gives an empty result; a
    column of the input with one of the added names is replaced.
    """
    added = ("shard", "depth", "shard_bytes", "shard_rows", "page")
    plain, _, restore = shield(docs, added)
    own = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(own, plain.columns, strict=True)], key_hash(*[F.col(c) for c in key]).alias("_h"), F.coalesce(size, F.lit(0)).cast("long").alias("_bytes"), F.spark_partition_id().alias("_part"))
    sizes = stage_table(rows.groupBy(F.col("_h").alias("h")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("rows"), F.max("_bytes").alias("most")), "shard-sizes")
    leaves = sizes.join(directory(sizes, limit), "h").withColumn("q", _prefix("h", F.col("depth")))
    buckets = leaves.groupBy("depth", "q").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("q"), F.col("depth").cast("int"), F.lit("0")))
    placed = leaves.join(buckets, ["depth", "q"]).select(F.col("h").alias("_h"), bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows",
                                                         F.when(F.col("shard_bytes") > limit, F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("most")))).alias("_fit"))
    placed = stage_table(placed, "shard-places")
    out = rows.join(placed, "_h")
    if placed.filter("_fit IS NOT NULL AND shard_rows > 1").limit(1).count() == 0:
        return restore(out.withColumn("page", F.lit(0).cast("long")))
    # Overflow pages, for the full keys only.
    single = out.filter("_fit IS NULL OR shard_rows = 1").withColumn("page", F.lit(0).cast("long"))
    over = stage_table(out.filter("_fit IS NOT NULL AND shard_rows > 1"), "shard-overflow")
    counts = over.groupBy("_h", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_h", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("_bytes")) - 1
    over = over.withColumn("_rank", rank).join(counts, ["_h", "_part"]).withColumn("page", F.floor((F.col("_rank") + F.col("_before")) / F.col("_fit")).cast("long"))
    return restore(single).unionByName(restore(over))


def write_shards(docs: DataFrame, path: str, key: list[str], size: Column, limit: int = SHARD_BYTES) -> None:
    """Write each shard and page as a folder of its own: ``shard=<bits>/page=<n>``."""
    placed = shard(docs, key, size, limit).withColumn("shard", F.concat(F.lit("b"), "shard"))
    placed.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, ["doc_id"], F.octet_length("text")).select("doc_id", "shard", "depth", "shard_bytes", "shard_rows", "page")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce('v' || CAST(doc_id AS VARCHAR), 'n')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, g.n AS n, h >> CAST({HASH_BITS} - g.n AS INTEGER) AS q FROM d, (SELECT unnest(range(0, {HASH_BITS + 1})) AS n) g),
large AS (SELECT n, q FROM p GROUP BY n, q HAVING sum(bytes) > {SHARD_BYTES} AND count(DISTINCT h) > 1),
deep AS (SELECT h, count(DISTINCT n) AS depth FROM p JOIN large USING (n, q) GROUP BY h),
leaf AS (SELECT d.*, coalesce(depth, 0) AS depth, h >> CAST({HASH_BITS} - coalesce(depth, 0) AS INTEGER) AS q FROM d LEFT JOIN deep USING (h)),
b AS (SELECT depth, q, sum(bytes) AS shard_bytes, count(*) AS shard_rows FROM leaf GROUP BY depth, q)
SELECT doc_id, right(repeat('0', 60) || CASE WHEN depth = 0 THEN '' ELSE bin(q) END, CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS depth,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows, CAST(0 AS BIGINT) AS page
FROM leaf JOIN b USING (depth, q)
"""

QUERIES = {"op2_sharding": op2_sharding}
ORACLES = {"op2_sharding": SQL}
