"""Streams over request logs and bibliographies."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refaudit.operators.requests import dedupe_requests, merge_quota, quota_summary, summary_state
from refaudit.plans.verification import PreparedCatalog, prepare, verify_references
from refaudit.session import stage_table


def quota_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """Merges a micro-batch into the quota summaries and writes them to ``folder/quota/batch=N``.

    A batch is summed up per provider and minute by Spark and merged with its predecessor's summaries, one row per provider. It overwrites
    its own, so a replayed batch changes nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        new = quota_summary(batch)
        held = batch.sparkSession.read.schema(new.schema).parquet(f"{folder}/quota/batch={batch_id - 1}") if batch_id else new.limit(0)
        merge_quota(held, new).write.mode("overwrite").parquet(f"{folder}/quota/batch={batch_id}")
    return each


def quota_stream(requests: DataFrame, folder: str, checkpoint: str):
    """Quota state per provider as requests arrive; a later micro-batch holds no request older than those before.

    Starts an available-now query that fills ``folder/quota``; the caller waits for it and reads with :func:`quota_after`.
    """
    return requests.writeStream.foreachBatch(quota_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quota_after(spark: SparkSession, folder: str) -> DataFrame:
    """(provider, ts, attempt, cooldown_until) as the last micro-batch left it."""
    rows = spark.read.parquet(f"{folder}/quota")
    last = rows.agg(F.max("batch")).first()[0]  # one value
    return summary_state(rows.where(F.col("batch") == last).drop("batch"))


def fetched_batch(folder: str, ttl: str = "5 minutes") -> Callable[[DataFrame, int], None]:
    """Writes the requests of a micro-batch that reach the network to ``folder/fetched/batch=N``, by the rule of ``dedupe_requests``.

    ``folder/last/N`` keeps each URL's last fetched success that a later request may still be served from. A batch reads its predecessor's
    and overwrites its own, so a replayed batch changes nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(batch.schema).parquet(f"{folder}/last/{batch_id - 1}") if batch_id else batch.limit(0)
        rows = dedupe_requests(held.withColumn("_held", F.lit(True)).unionByName(batch.withColumn("_held", F.lit(False))), ttl)
        rows = stage_table(rows, "fetched-batch")
        rows.where("not _held").drop("_held").write.mode("overwrite").parquet(f"{folder}/fetched/batch={batch_id}")
        good = rows.where(F.col("status").between(200, 299)).drop("_held")
        last = good.groupBy("provider", "url").agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "request_id")).alias("l")).select("l.*")
        newest = batch.agg(F.max("ts").alias("t")).first()["t"]  # one value
        if newest is not None:
            last = last.where(F.col("ts") > F.lit(newest) - F.expr(f"interval {ttl}"))
        last.write.mode("overwrite").parquet(f"{folder}/last/{batch_id}")
    return each


def dedupe_stream(requests: DataFrame, folder: str, checkpoint: str, ttl: str = "5 minutes"):
    """Requests that reach the network, as they arrive; a later micro-batch holds no request older than those before.

    Starts an available-now query that fills ``folder/fetched``; the caller waits for it.
    """
    return requests.writeStream.foreachBatch(fetched_batch(folder, ttl)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_stream(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts per provider; a window is emitted once the watermark has passed it."""
    ok, limited = F.col("status").between(200, 299), F.col("status") == 429
    g = requests.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "provider").agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("responses"), F.count_if(limited).alias("waits"), F.count_if(~ok & ~limited).alias("errors"),
        F.max_by("status", "ts").alias("last_status"))
    return g.select(F.col("w.start").alias("window_start"), "provider", "requests", "responses", "waits", "errors", "last_status")


def verify_batch(catalog: PreparedCatalog, folder: str) -> Callable[[DataFrame, int], None]:
    """Decides a micro-batch and writes to ``folder/batch=N``: ``phase=0`` by the primary index alone, ``phase=1`` the leftovers by all.

    Both overwrite their own folder, so a replayed batch changes nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        first = f"{folder}/batch={batch_id}/phase=0"
        out = verify_references(batch, catalog, primary_only=True)
        out.write.mode("overwrite").parquet(first)
        rest = batch.sparkSession.read.schema(out.schema).parquet(first).where("fallback_needed").select(*batch.columns)
        verify_references(rest, catalog).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}/phase=1")
    return each


def verify_stream(refs: DataFrame, catalog: DataFrame | PreparedCatalog, folder: str, checkpoint: str):
    """Verify entries as they arrive against a catalog that is prepared once.

    Starts an available-now query that fills ``folder``; the caller waits for it and reads with :func:`decisions`.
    """
    prepared = catalog if isinstance(catalog, PreparedCatalog) else prepare(catalog)
    return refs.writeStream.foreachBatch(verify_batch(prepared, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The latest decision per entry: an entry that comes again, or falls through to the second phase, replaces its earlier one."""
    rows = spark.read.parquet(folder)
    fields = [c for c in rows.columns if c not in ("batch", "phase")]
    latest = rows.groupBy("ref_id").agg(F.max_by(F.struct(*fields), F.struct("batch", "phase")).alias("d"))
    return latest.select("d.*")
