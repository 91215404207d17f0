"""Request logs: quotas, spacing, duplicates, snapshots, event summaries.

requests(request_id, ts, provider, url, status, retry_after)
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions.dates import retry_delay_ms, web_retry_at_ms
from refaudit.functions.text import let

from refaudit.session import stage_table

from .linkage import limit_per_key
from .segmented import look_back

# Minimum milliseconds between two requests to a provider (fixed); everybody else 400.
INTERVALS = {"Crossref": 1000, "PubMed": 400, "CORE": 2200, "DBLP": 1100, "OpenLibrary": 1100, "Semantic Scholar": 1000, "arXiv": 3000}
DEFAULT_INTERVAL = 400
#: Length of the pieces of time in which a busy URL is walked.
SEGMENT_US = 60_000_000
# Provider endpoints (fixed): host and path prefix.
TARGETS = {
    "Crossref": ("api.crossref.org", "/works"), "DataCite": ("api.datacite.org", "/dois/"), "OpenAlex": ("api.openalex.org", "/works"),
    "PubMed": ("eutils.ncbi.nlm.nih.gov", "/entrez/eutils/"), "Europe PMC": ("www.ebi.ac.uk", "/europepmc/webservices/rest/"),
    "DBLP": ("dblp.org", "/search/publ/api"), "ERIC": ("api.ies.ed.gov", "/eric/"), "Semantic Scholar": ("api.semanticscholar.org", "/graph/v1/paper/"),
    "CORE": ("api.core.ac.uk", "/v3/search/works"), "arXiv": ("export.arxiv.org", "/api/query"), "TR Dizin": ("search.trdizin.gov.tr", "/api/"),
    "İSAM": ("makale.isam.org.tr", "/server/api/discover/search/objects"), "Google Books": ("www.googleapis.com", "/books/v1/volumes"),
    "OpenLibrary": ("openlibrary.org", "/search.json")}
# Special-use IPv4 ranges (fixed).
SPECIAL_IPV4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
                "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")


def quota_state(requests: DataFrame) -> DataFrame:
    """Per provider: consecutive 429 answers since the last success and the end of the cooldown.

    Two aggregations instead of a running window: last success, then the failures after it.
    """
    seq = F.struct("ts", "request_id")
    ok = F.col("status").between(200, 299)
    last_ok = requests.groupBy("provider").agg(F.max(F.when(ok, seq)).alias("last_ok"))
    limited = requests.where("status = 429").join(last_ok, "provider").where(F.col("last_ok").isNull() | (seq > F.col("last_ok")))
    state = limited.groupBy("provider").agg(F.count("*").alias("attempt"), F.max_by(F.struct("ts", "retry_after"), seq).alias("l"))
    wait = retry_delay_ms(F.col("l.retry_after"), F.col("attempt") - 1, F.col("l.ts"))
    until = F.timestamp_millis(F.unix_millis(F.col("l.ts").cast("timestamp")) + wait)
    return last_ok.select("provider").join(state, "provider", "left").select(
        "provider", until.alias("cooldown_until"), F.coalesce("attempt", F.lit(0)).alias("attempt"))


def quota_summary(requests: DataFrame) -> DataFrame:
    """What a stretch of the log does to each provider's quota: ``provider, ts, ok, attempt, l``.

    ``ts`` is the last answer, ``ok`` says whether any succeeded, ``attempt`` counts the 429 answers after the last success and
    ``l`` is the last of those. Summaries of consecutive stretches merge (:func:`merge_quota`). Answers combine per provider and
    minute; of the rows themselves only those in the minute of a last success are read again, so a busy provider is spread
    over its minutes.
    """
    seq, ok, limited = F.struct("ts", "request_id"), F.col("status").between(200, 299), F.col("status") == 429
    rows = requests.select("provider", "ts", "request_id", "status", "retry_after", F.date_trunc("minute", "ts").alias("minute"))
    answer = F.struct("ts", "request_id", "retry_after")
    minutes = rows.groupBy("provider", "minute").agg(F.max("ts").alias("ts"), F.max(F.when(ok, seq)).alias("ok_at"), F.count_if(limited).alias("n"), F.max(F.when(limited, answer)).alias("l"))
    minutes = stage_table(minutes, "quota-minutes")
    last = minutes.groupBy("provider").agg(F.max("ts").alias("ts"), F.max("ok_at").alias("ok_at")).withColumn("ok_minute", F.date_trunc("minute", "ok_at.ts"))
    later = minutes.drop("ts", "ok_at").join(last, "provider").where(F.col("ok_at").isNull() | (F.col("minute") > F.col("ok_minute"))).select("provider", "n", "l")
    same = rows.where(limited).join(last.select("provider", "ok_at", F.col("ok_minute").alias("minute")), ["provider", "minute"]).where(seq > F.col("ok_at"))
    after = later.unionByName(same.groupBy("provider").agg(F.count("*").alias("n"), F.max(answer).alias("l")))
    after = after.groupBy("provider").agg(F.sum("n").alias("attempt"), F.max("l").alias("l"))
    return last.join(after, "provider", "left").select("provider", "ts", F.col("ok_at").isNotNull().alias("ok"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "l")


def merge_quota(before: DataFrame, after: DataFrame) -> DataFrame:
    """The summary of two consecutive stretches of the log; one row per provider on either side."""
    b, a = before.alias("b"), after.alias("a")
    reset = F.coalesce(F.col("a.ok"), F.lit(False))
    attempt = F.when(reset, F.col("a.attempt")).otherwise(F.coalesce("b.attempt", F.lit(0)) + F.coalesce("a.attempt", F.lit(0)))
    return b.join(a, F.col("b.provider").eqNullSafe(F.col("a.provider")), "full_outer").select(
        F.coalesce("a.provider", "b.provider").alias("provider"), F.coalesce("a.ts", "b.ts").alias("ts"), (reset | F.coalesce("b.ok", F.lit(False))).alias("ok"),
        attempt.alias("attempt"), F.when(reset, F.col("a.l")).otherwise(F.coalesce("a.l", "b.l")).alias("l"))


def summary_state(summary: DataFrame) -> DataFrame:
    """(provider, ts, attempt, cooldown_until) of a summary that begins with the log."""
    wait = retry_delay_ms(F.col("l.retry_after"), F.col("attempt") - 1, F.col("l.ts"))
    until = F.timestamp_millis(F.unix_millis(F.col("l.ts").cast("timestamp")) + wait)
    return summary.select("provider", "ts", "attempt", until.alias("cooldown_until"))


def retry_due(results: DataFrame, cooldowns: DataFrame, now: Column) -> DataFrame:
    """Waiting entries whose providers' cooldowns are over, least often retried first (``turn``).

    Cooldowns are one row per provider; the turn is a global rank of a small, due-only set, so
    ties are broken by position and nobody starves.
    """
    waits = results.where(F.col("pending_retry_at").isNotNull()).select("ref_id", "retry_count", "pos", F.explode_outer("pending_providers").alias("p"), "pending_retry_at")
    joined = waits.join(cooldowns.select(F.col("provider").alias("_p"), "cooldown_until"), F.col("p.provider") == F.col("_p"), "left")
    at = joined.groupBy("ref_id", "retry_count", "pos").agg(F.min(F.coalesce("cooldown_until", F.col("p.retry_at"), "pending_retry_at")).alias("retry_at"))
    return at.where(F.col("retry_at") <= now).orderBy("retry_count", "pos")


def _successors(good: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """(node, next): for every success the first one that comes ``ttl`` later or more; none where no such one is left.

    Time runs backwards: the latest success seen before the moment of expiry is the first one at or behind it.
    """
    moments = good.select(*keys, (-F.col("at")).alias("back"), F.lit(0).alias("kind"), "node")
    expiry = good.select(*keys, (-F.col("at") - ttl_us).alias("back"), F.lit(1).alias("kind"), "node")
    seen = look_back(moments.union(expiry), keys, ["back", "kind"], F.when(F.col("kind") == 0, F.col("node")), "next", segment=F.floor(F.col("back") / SEGMENT_US))
    return seen.where("kind = 1 and next is not null").select("node", "next")


def _fetched_successes(good: DataFrame, keys: list[str], ttl_us: int) -> DataFrame:
    """Nodes of the successes that reach the network, of ``good(*keys, at, node)`` with one success per moment.

    A success without another in the ``ttl`` before it is always fetched. From there on each fetched success leads to its successor;
    the chains are followed by doubling the pointers, so a chain of n fetches takes log2(n) rounds and a busy URL many tasks.
    """
    rows = look_back(good, keys, ["at"], F.col("at"), "_prev", segment=F.floor(F.col("at") / SEGMENT_US))
    starts = stage_table(rows.where(F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= ttl_us)).select("node"), "fetch-starts")
    jump = _successors(good, keys, ttl_us).join(starts.withColumnRenamed("node", "next"), "next", "left_anti").select("node", "next")
    found, jump = starts, stage_table(jump, "fetch-jumps")
    while jump.limit(1).count():
        found = stage_table(found.union(found.join(jump, "node").select(F.col("next").alias("node"))), "fetched")
        far = jump.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jump = stage_table(jump.join(far, "next").select("node", F.col("far").alias("next")), "fetch-jumps")
    return found


def dedupe_requests(requests: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """Requests that reach the network: those not served from the cache.

    A success is kept for ``ttl`` from its own fetch, however often it is asked for meanwhile; failures are not kept. Of successes
    at one moment the first by request id counts. A failure reaches the network unless a fetched success still covers it. Rows
    without provider or URL are no requests.
    """
    keys = ["provider", "url"]
    ttl_us = int(pd.Timedelta(ttl) / pd.Timedelta("1us"))
    numbered = requests.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("node", F.monotonically_increasing_id())
    rows = stage_table(numbered.withColumn("good", F.coalesce(F.col("status").between(200, 299), F.lit(False))), "requests")
    good = rows.where("good").groupBy(*keys, "at").agg(F.min_by("node", F.struct("request_id", "node")).alias("node"))
    fetched = _fetched_successes(good, keys, ttl_us).withColumn("fetched", F.lit(True))
    told = rows.join(fetched, "node", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    told = look_back(told, keys, ["at", "request_id", "node"], F.when(F.col("fetched"), F.col("at")), "_last", segment=F.floor(F.col("at") / SEGMENT_US))
    uncovered = F.col("_last").isNull() | (F.col("at") - F.col("_last") >= ttl_us)
    return told.where(F.when(F.col("good"), F.col("fetched")).otherwise(uncovered)).select(*requests.columns)


def spacing_violations(requests: DataFrame, intervals: dict[str, int] | None = None, default: int = DEFAULT_INTERVAL) -> DataFrame:
    """Requests closer to the provider's previous one than its minimum interval."""
    table = {**INTERVALS, **(intervals or {})}
    need = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("provider")), F.lit(default))
    rows = look_back(requests, ["provider"], ["ts", "request_id"], F.col("ts"), "_prev")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
    return rows.select("request_id", "provider", "ts", (gap / 1000).alias("gap_ms"), need.alias("interval_ms")).where(F.col("gap_ms") < F.col("interval_ms"))


def event_rollup(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Requests, waits and faults per window and provider with the last status."""
    ok, limited = F.col("status").between(200, 299), F.col("status") == 429
    g = events.groupBy(F.window("ts", window).alias("w"), "provider").agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("responses"), F.count_if(limited).alias("waits"), F.count_if(~ok & ~limited).alias("errors"),
        F.max_by("status", F.struct("ts", "request_id")).alias("last_status"))
    return g.select(F.col("w.start").alias("window_start"), "provider", "requests", "responses", "waits", "errors", "last_status")


def latest_events(events: DataFrame, n: int = 200, key: str = "provider") -> DataFrame:
    """Newest ``n`` events per key."""
    return limit_per_key(events, [key], n, [F.desc("ts"), F.desc("request_id")])


def last_good_snapshot(requests: DataFrame) -> DataFrame:
    """As-of join: a blocked page takes the latest earlier success of its URL (``stale``)."""
    good = F.col("state") == "ok"
    rows = look_back(requests, ["url"], ["ts", "request_id"], F.when(good, F.col("request_id")), "_good")
    use = (F.col("state") == "blocked") & F.col("_good").isNotNull()
    return rows.select(*requests.columns, F.when(use, "ok").otherwise(F.col("state")).alias("effective_state"),
                       F.when(use, F.col("_good")).alias("snapshot_id"), use.alias("stale"))


def page_state(responses: DataFrame) -> DataFrame:
    """State of a crawl-log row: deferred, missing, blocked, unsupported or ok.

    responses(request_id, ts, url, final_url, status, content_type, retry_after)
    """
    s = F.col("status")
    path = lambda c: F.coalesce(F.nullif(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/"))
    home = (path(F.col("final_url")) == "/") & (path(F.col("url")) != "/")
    state = (F.when(s == 429, "deferred").when(s.isin(404, 410), "missing").when(s != 200, "blocked")
             .when(~F.coalesce("content_type", F.lit("")).rlike(r"(?i)^(text/html|application/xhtml\+xml)(?![0-9a-z_])"), "unsupported")
             .when(home, "blocked").otherwise("ok"))
    retry = F.when(s == 429, F.timestamp_millis(web_retry_at_ms(F.col("retry_after"), F.col("ts"))))
    return responses.select(*responses.columns, state.alias("state"), retry.alias("retry_at"))


def allowed_targets(urls: DataFrame, provider: str = "provider", url: str = "url") -> DataFrame:
    """Rows whose https URL lies inside the provider's endpoint (14 fixed endpoints, no join)."""
    m = F.create_map(*[x for p, (h, t) in TARGETS.items() for x in (F.lit(p), F.struct(F.lit(h).alias("host"), F.lit(t).alias("path")))])
    u = F.col(url)
    part = lambda k: F.try_parse_url(u, F.lit(k))
    t = F.try_element_at(m, F.col(provider))
    plain = F.lower(part("AUTHORITY")) == F.lower(part("HOST"))
    ok = (part("PROTOCOL") == "https") & plain & part("REF").isNull() & (F.lower(part("HOST")) == t["host"]) & F.startswith(part("PATH"), t["path"])
    return urls.where(F.coalesce(ok, F.lit(False)))


def special_ip_range(ip: Column) -> Column:
    """Special-use range of an IPv4 address (prefix notation), NULL if public or not IPv4."""
    octets = F.split(ip, r"\.")
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + F.coalesce(o.try_cast("bigint"), F.lit(0).cast("bigint")))

    def find(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for block in reversed(SPECIAL_IPV4):
            base, bits = block.split("/")
            low = sum(int(p) << s for p, s in zip(base.split("."), (24, 16, 8, 0)))
            out = F.when(n.between(low, low + 2 ** (32 - int(bits)) - 1), F.lit(block)).otherwise(out)
        return out
    return F.when(valid, let(number, find))


def is_public_ip(ip: Column) -> Column:
    """Globally routable address: IPv4 outside the special ranges, or IPv6 2000::/3 without 6to4, Teredo and documentation."""
    v6 = ip.rlike("(?i)^[23][0-9a-f]{3}:") & ~ip.rlike("(?i)^2002:|^2001:(?:db8|0|10|20):")
    v4 = ip.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return F.when(v4, special_ip_range(ip).isNull() & ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")).otherwise(v6)
