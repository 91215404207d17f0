"""Result tables and rendered output."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions.text import escape_html


def render_bibliography(results: DataFrame) -> DataFrame:
    """(doc_id, text, html): final entries in input order, a blank line between, one HTML paragraph each.

    results(doc_id, pos, output, output_html). One document's bibliography is bounded.
    """
    html = F.coalesce("output_html", escape_html(F.col("output")))
    g = results.select("doc_id", "pos", "output", html.alias("h")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "output", "h"))).alias("x"))
    return g.select("doc_id", F.array_join("x.output", "\n\n").alias("text"),
                    F.array_join(F.transform("x.h", lambda v: F.concat(F.lit('<p style="margin:0 0 1em">'), v, F.lit("</p>"))), "").alias("html"))


def signature(*columns: str) -> Column:
    """Content signature of a row."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def with_signature(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("signature", signature(*[c for c in df.columns if c not in key]))


def changed_only(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose (key, signature) is not stored yet; ``stored`` needs only those columns."""
    return with_signature(new, key).join(stored.select(*key, "signature"), [*key, "signature"], "left_anti")


def write_results(df: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Persist a per-document table, clustered by a document hash.

    Partitioning by document would make one directory per document; a fixed number of hash
    buckets keeps files large and still prunes by document. Task commit makes the write atomic.
    """
    bucketed = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    bucketed.repartitionByRange("bucket", "doc_id").write.mode(mode).partitionBy("bucket").parquet(path)


def document_index(docs: DataFrame) -> DataFrame:
    """Summary row per document, newest first (a range-partitioned sort)."""
    cols = [c for c in ("doc_id", "name", "format", "mode", "created_at", "updated_at") if c in docs.columns]
    return docs.select(*cols).orderBy(F.desc("updated_at"), "doc_id")
