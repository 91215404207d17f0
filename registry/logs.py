"""Request-log queries over ``events``."""
from __future__ import annotations

from pyspark.sql import functions as F

from refaudit.functions.dates import duration_ms as _duration
from refaudit.functions.dates import retry_delay_ms as _delay
from refaudit.functions.retrieval import safe_event_url as _safe
from refaudit.operators import requests as Q
from refaudit.session import checkpoint_dir

from .views import table, view, with_views



def requests(spark, sf):
    return view(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def quota_state(spark, sf):
    return Q.quota_state(requests(spark, sf)).select("provider", F.col("cooldown_until").cast("timestamp_ntz").alias("cooldown_until"), "attempt")


def dedupe_requests(spark, sf):
    """Requests of a provider's path, so that equal ones occur within minutes."""
    r = requests(spark, sf).withColumn("url", F.regexp_replace("url", "[0-9]+$", ""))
    return Q.dedupe_requests(r).select("request_id", "provider", "url")


def spacing_violations(spark, sf):
    out = Q.spacing_violations(requests(spark, sf), default=600_000)
    return out.select("request_id", F.round("gap_ms", 3).alias("gap_ms"), "interval_ms")


def event_rollup(spark, sf):
    return Q.event_rollup(requests(spark, sf))


def latest_events(spark, sf):
    return Q.latest_events(requests(spark, sf), 80).select("request_id", "provider")


def last_good_snapshot(spark, sf):
    r = requests(spark, sf).withColumn("state", F.when(F.col("status") == 200, "ok").when(F.col("status") == 429, "deferred").otherwise("blocked"))
    r = r.withColumn("url", F.regexp_replace("url", "/(view|signup|purchase|click|error)/", "/"))
    return Q.last_good_snapshot(r).select("request_id", "effective_state", "snapshot_id", "stale")


def page_state(spark, sf):
    r = requests(spark, sf)
    out = Q.page_state(r.select("request_id", "ts", "url", F.when(F.col("request_id") % 7 == 0, "https://api.example.org/").otherwise(F.col("url")).alias("final_url"), F.when(F.col("request_id") % 11 == 0, 404).otherwise(F.col("status")).alias("status"),
                                F.when(F.col("request_id") % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), "retry_after"))
    return out.select("request_id", "state", F.col("retry_at").cast("timestamp_ntz").alias("retry_at"))


def retry_delay_ms(spark, sf):
    r = requests(spark, sf)
    return r.select("request_id", _delay(F.col("retry_after"), (F.col("request_id") % 7).cast("int"), F.col("ts")).alias("delay"))


def duration_ms(spark, sf):
    r = requests(spark, sf)
    text = F.concat((F.col("request_id") % 3).cast("string"), F.lit("h"), (F.col("request_id") % 50).cast("string"), F.lit("m"), (F.col("request_id") % 7).cast("string"), F.lit(".5s"))
    return r.select("request_id", _duration(text, F.col("ts")).alias("ms"))


def safe_event_url(spark, sf):
    r = requests(spark, sf)
    return r.select("request_id", _safe(F.concat("url", F.lit("?a=1&api_key=secret"), F.col("request_id"), F.lit("&b=2"))).alias("url"))


def describe_error(spark, sf):
    from refaudit.functions.reference import describe_error as d
    return requests(spark, sf).select("request_id", d(F.col("provider"), F.col("status"), F.lit("other")).alias("message"))


def retry_due(spark, sf):
    """Every 429 waits for its provider; the final cooldown of the log decides who is due."""
    r = requests(spark, sf)
    waits = r.where("status = 429").select(
        F.col("request_id").alias("ref_id"), (F.col("request_id") % 4).alias("retry_count"), F.col("request_id").alias("pos"),
        F.array(F.struct("provider", F.col("ts").cast("timestamp").alias("retry_at"))).alias("pending_providers"), F.col("ts").cast("timestamp").alias("pending_retry_at"))
    due = Q.retry_due(waits, Q.quota_state(r), F.lit("2024-01-30 23:30:00").cast("timestamp"))
    return due.select("ref_id", "retry_count")


def pending_retry(spark, sf):
    from refaudit.operators.reports import pending_retry as p
    r = requests(spark, sf)
    waits = r.where("status = 429").groupBy(F.floor(F.col("request_id") / 50).alias("ref_id")).agg(F.collect_set(F.struct("provider", F.col("ts").cast("timestamp").alias("retry_at"))).alias("pending_providers"))
    cool = r.where("status = 503").groupBy("provider").agg(F.max(F.col("ts").cast("timestamp")).alias("cooldown_until")).where("provider < 'prov2'")
    return p(waits, cool).select("ref_id", F.col("retry_at").cast("timestamp_ntz").alias("retry_at"), F.array_join("providers", "|").alias("providers"))


def special_ip_range(spark, sf):
    """Addresses spelt from event and user numbers."""
    e = table(spark, sf, "events")
    ip = F.concat_ws(".", F.col("event_id") % 256, F.col("user_id") % 256, (F.col("event_id") * 7) % 256, F.col("user_id") % 200)
    return e.select("event_id", Q.special_ip_range(ip).alias("block"), Q.is_public_ip(ip).alias("is_public"))


def allowed_targets(spark, sf):
    r = requests(spark, sf)
    host = F.when(F.col("request_id") % 3 == 0, "https://api.crossref.org/works").when(F.col("request_id") % 3 == 1, "https://api.crossref.org:444/works").otherwise("https://api.openalex.org/works")
    rows = r.select("request_id", F.lit("Crossref").alias("provider"), F.concat(host, F.lit("/"), F.col("request_id")).alias("url"))
    return Q.allowed_targets(rows).select("request_id")


def _log_dir(spark, sf):
    import uuid
    path = f"{checkpoint_dir(spark)}/refaudit-stream/{uuid.uuid4().hex}"
    return path


def _stream(spark, sf):
    schema = requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    source = _log_dir(spark, sf) + "/in"
    schema.write.parquet(source)
    return spark.readStream.schema(schema.schema).parquet(source)


def _run(spark, df, mode):
    out = _log_dir(spark, "")
    name = "t" + out.rsplit("/", 1)[1]
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out + "/out").option("checkpointLocation", out + "/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out + "/out")
    parts = out + "/upd"
    q = (df.writeStream.outputMode(mode).queryName(name).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(parts))
         .option("checkpointLocation", out + "/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(parts)


def quota_stream(spark, sf):
    """The log in three micro-batches in order of time; the state that the last one left."""
    from refaudit.streaming.requests import quota_after
    from refaudit.streaming.requests import quota_stream as s
    folder = _log_dir(spark, sf)
    rows = requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    cuts = rows.select(F.percentile_approx(at, [0.4, 0.7])).first()[0] or [0, 0]
    part = F.when(at > cuts[1], 2).when(at > cuts[0], 1).otherwise(0)
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(folder + "/in")
        s(spark.readStream.schema(rows.schema).parquet(folder + "/in"), folder, folder + "/cp").awaitTermination()
    return quota_after(spark, folder).select("provider", F.col("cooldown_until").cast("timestamp_ntz").alias("cooldown_until"), F.col("attempt").cast("bigint").alias("attempt"))


def rollup_stream(spark, sf):
    """Every window as last updated."""
    from refaudit.streaming.requests import rollup_stream as s
    rows = _run(spark, s(_stream(spark, sf)), "update")
    counts = ("requests", "responses", "waits", "errors")
    last = rows.groupBy("window_start", "provider").agg(F.max_by(F.struct(*counts), "batch").alias("c"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "provider", *[F.col(f"c.{c}").alias(c) for c in counts])


def dedupe_stream(spark, sf):
    """The requests of :func:`dedupe_requests`, from the log as a stream."""
    from refaudit.streaming.requests import dedupe_stream as s
    folder = _log_dir(spark, sf)
    requests_in = _stream(spark, sf)
    s(requests_in.withColumn("url", F.regexp_replace("url", "[0-9]+$", "")), folder, folder + "/cp").awaitTermination()
    return spark.read.schema(requests_in.schema).parquet(folder + "/fetched").select("request_id", "provider", "url")


QUERIES = {f.__name__: f for f in (quota_state, dedupe_requests, spacing_violations, event_rollup, latest_events, last_good_snapshot, page_state, retry_delay_ms, duration_ms,
                                   safe_event_url, describe_error, retry_due, pending_retry, special_ip_range, allowed_targets, quota_stream, rollup_stream, dedupe_stream)}

_DELAY = "CASE WHEN {h} <> '' THEN greatest(1000, cast({h} AS bigint) * 1000) ELSE least(900000, 60000 * power(2, least({a}, 4)))::BIGINT END"
_QUOTA = f"""ok AS (SELECT provider, max(CASE WHEN status = 200 THEN (ts, request_id) END) AS lo FROM requests GROUP BY 1),
lim AS (SELECT r.provider, count(*) AS attempt, max(ts) AS ts, arg_max(retry_after, (ts, request_id)) AS ra FROM requests r JOIN ok USING (provider) WHERE status = 429 AND (lo IS NULL OR (ts, request_id) > lo) GROUP BY 1),
quota AS (SELECT ok.provider, date_trunc('millisecond', l.ts) + to_milliseconds({_DELAY.format(h="l.ra", a="l.attempt - 1")}) AS cooldown_until, coalesce(l.attempt, 0) AS attempt FROM ok LEFT JOIN lim l USING (provider))"""


def _q(body: str, extra: str = "") -> str:
    return with_views("", "requests").rstrip() + (", " + extra if extra else "") + " " + body


_BLOCKS = " ".join(
    f"WHEN n BETWEEN {sum(int(p) << s for p, s in zip(b.split('/')[0].split('.'), (24, 16, 8, 0)))} AND {sum(int(p) << s for p, s in zip(b.split('/')[0].split('.'), (24, 16, 8, 0))) + 2 ** (32 - int(b.split('/')[1])) - 1} THEN '{b}'"
    for b in Q.SPECIAL_IPV4)
_FETCHED = _q("""SELECT request_id, provider, url FROM walk WHERE kept""", """seq AS (SELECT request_id, provider, regexp_replace(url, '[0-9]+$', '') AS url, ts, status = 200 AS ok, row_number() OVER (PARTITION BY provider, regexp_replace(url, '[0-9]+$', '') ORDER BY ts, request_id) AS n FROM requests),
        walk AS (SELECT request_id, provider, url, n, true AS kept, CASE WHEN ok THEN ts + INTERVAL 5 MINUTE ELSE TIMESTAMP '1970-01-01' END AS until FROM seq WHERE n = 1
          UNION ALL SELECT s.request_id, s.provider, s.url, s.n, s.ts >= w.until, CASE WHEN s.ts >= w.until AND s.ok THEN s.ts + INTERVAL 5 MINUTE ELSE w.until END FROM walk w JOIN seq s ON s.provider = w.provider AND s.url = w.url AND s.n = w.n + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES = {
    "quota_state": _q("SELECT * FROM quota", _QUOTA),
    "quota_stream": _q("SELECT * FROM quota", _QUOTA),
    "dedupe_requests": _FETCHED,
    "dedupe_stream": _FETCHED,
    "spacing_violations": _q("SELECT request_id, round((epoch_us(ts) - epoch_us(p)) / 1000, 3) AS gap_ms, 600000 AS interval_ms FROM (SELECT *, lag(ts) OVER (PARTITION BY provider ORDER BY ts, request_id) AS p FROM requests) WHERE epoch_us(ts) - epoch_us(p) < 600000000"),
    "event_rollup": _q("SELECT date_trunc('hour', ts) AS window_start, provider, count(*) AS requests, count(CASE WHEN status = 200 THEN 1 END) AS responses, count(CASE WHEN status = 429 THEN 1 END) AS waits, count(CASE WHEN status = 503 THEN 1 END) AS errors, arg_max(status, (ts, request_id)) AS last_status FROM requests GROUP BY 1, 2"),
    "rollup_stream": _q("SELECT date_trunc('hour', ts) AS window_start, provider, count(*) AS requests, count(CASE WHEN status = 200 THEN 1 END) AS responses, count(CASE WHEN status = 429 THEN 1 END) AS waits, count(CASE WHEN status = 503 THEN 1 END) AS errors FROM requests GROUP BY 1, 2"),
    "latest_events": _q("SELECT request_id, provider FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, request_id DESC) AS n FROM requests) WHERE n <= 80"),
    "last_good_snapshot": _q("""SELECT request_id, CASE WHEN status = 503 AND g IS NOT NULL THEN 'ok' WHEN status = 200 THEN 'ok' WHEN status = 429 THEN 'deferred' ELSE 'blocked' END AS effective_state,
        CASE WHEN status = 503 THEN g END AS snapshot_id, status = 503 AND g IS NOT NULL AS stale FROM (SELECT *, last_value(CASE WHEN status = 200 THEN request_id END IGNORE NULLS) OVER (PARTITION BY regexp_replace(url, '/[a-z]+/([0-9]+)$', '/\\1') ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM requests)"""),
    "page_state": _q("""SELECT request_id, state, CASE WHEN state = 'deferred' THEN date_trunc('millisecond', ts) + to_milliseconds(CASE WHEN retry_after = '' THEN 60000 ELSE cast(retry_after AS bigint) * 1000 END) END AS retry_at
        FROM (SELECT *, CASE WHEN request_id % 11 = 0 THEN 'missing' WHEN status = 429 THEN 'deferred' WHEN status <> 200 THEN 'blocked' WHEN request_id % 5 = 0 THEN 'unsupported' WHEN request_id % 7 = 0 THEN 'blocked' ELSE 'ok' END AS state FROM requests)"""),
    "retry_delay_ms": _q(f"SELECT request_id, {_DELAY.format(h='retry_after', a='request_id % 7')} AS delay FROM requests"),
    "duration_ms": _q("SELECT request_id, 1000.0::DOUBLE * ((request_id % 3) * 3600 + (request_id % 50) * 60 + (request_id % 7) + 0.5) AS ms FROM requests"),
    "safe_event_url": _q("SELECT request_id, url || '?a=1&b=2' AS url FROM requests"),
    "describe_error": _q("SELECT request_id, CASE WHEN status = 429 THEN provider || ': sorgu kotası/hız sınırı (HTTP 429)' ELSE 'other' END AS message FROM requests"),
    "retry_due": _q("SELECT request_id AS ref_id, request_id % 4 AS retry_count FROM requests JOIN quota USING (provider) WHERE status = 429 AND coalesce(cooldown_until, ts) <= TIMESTAMP '2024-01-30 23:30:00'", _QUOTA),
    "pending_retry": _q("""SELECT cast(floor(request_id / 50) AS bigint) AS ref_id, min(coalesce(c.cu, ts)) AS retry_at, array_to_string(list_sort(list(DISTINCT provider)), '|') AS providers FROM requests
        LEFT JOIN (SELECT provider, max(ts) AS cu FROM requests WHERE status = 503 AND provider < 'prov2' GROUP BY 1) c USING (provider) WHERE status = 429 GROUP BY 1"""),
    "special_ip_range": f"SELECT event_id, CASE {_BLOCKS} END AS block, CASE {_BLOCKS} END IS NULL AS is_public FROM (SELECT event_id, (event_id % 256) * 16777216 + (user_id % 256) * 65536 + (event_id * 7 % 256) * 256 + user_id % 200 AS n FROM events)",
    "allowed_targets": _q("SELECT request_id FROM requests WHERE request_id % 3 = 0"),
}
