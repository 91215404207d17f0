"""Exact de-duplication (operator 3): local, salted and global combining, comparing full content at each stage."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.llm.common import BLANKS, shield, shielded, table
from refaudit.session import stage_table

SALTS = 32


def normal_content(text: Column) -> Column:
    """The text without blanks; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; one output row per input row.

    Texts are equal when identical after deleting blanks. Of equal texts the row with the most code points
    in the original text stays, then the smallest ``doc_id`` (NULL last).

    Three stages. Each task first combines its own rows of one content (partial aggregation). The combined
    rows meet by (digest, salt of the task), so a group of copies in every task is spread over ``salts``
    reducers. The salts' winners meet by digest. The content is a grouping key at each stage, so a digest
    shared by different contents joins nothing. Rows then look up their group by digest; where a digest has
    several contents, by digest and content.

    NULL text counts as empty and all empty texts form one group; repeated rows (same id and text) keep one
    row; an empty table gives an empty result; a column of the input with one of the added names is replaced.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    docs, named, restore = shield(docs, added)
    text, doc_id = named(text), named(doc_id)
    content = normal_content(F.col(text))
    rows = docs.select(F.col(doc_id).alias("_id"), content.alias("_content"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_len"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"))
    rows = rows.withColumn("_digest", digest(F.col("_content")))
    best = F.min(F.struct((-F.col("_len")).alias("len"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"))).alias("_best")
    salted = rows.groupBy("_digest", "_salt", "_content").agg(best, F.count("*").alias("_n"))
    whole = salted.repartition("_digest").groupBy("_digest", "_content").agg(F.min("_best").alias("_best"), F.sum("_n").alias("group_size"))
    variants = F.count("*").over(Window.partitionBy("_digest"))
    groups = whole.withColumn("_variants", variants).select(
        "_digest", F.when(F.col("_variants") > 1, F.col("_content")).alias("_content"), F.col("_best.id").alias("keep_id"), (-F.col("_best.len")).alias("_keep_len"), "group_size")
    groups = stage_table(groups, "exact-groups")

    keyed = docs.withColumn("_digest", digest(content)).withColumn("text_sha256", F.sha2(content, 256)).withColumn("_len", F.length(F.coalesce(F.col(text), F.lit(""))))
    clear, clashes = groups.filter("_content IS NULL"), groups.filter("_content IS NOT NULL")
    if clashes.limit(1).count() == 0:
        out = keyed.join(clear.drop("_content"), "_digest")
    else:
        keyed = keyed.withColumn("_content", content)
        out = keyed.join(clear.drop("_content"), "_digest").unionByName(keyed.join(clashes, ["_digest", "_content"]).select(*keyed.columns, "keep_id", "_keep_len", "group_size")).drop("_content")
    stays = F.col(doc_id).eqNullSafe(F.col("keep_id")) & (F.col("_len") == F.col("_keep_len"))
    if docs.groupBy(doc_id).count().filter("count > 1").limit(1).count():  # ids repeat: one row of each stays
        out = out.withColumn("_stays", stays)
        turn = F.row_number().over(Window.partitionBy("_digest", doc_id, "_stays", content).orderBy("_len"))
        out = out.withColumn("_turn", turn)
        stays = F.col("_stays") & (F.col("_turn") == 1)
    return restore(out.withColumn("kept", stays))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return shielded(docs, lambda d, text, doc_id: exact_duplicates(d, text, doc_id).filter("kept"), text=text, doc_id=doc_id)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
w AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": SQL}
