"""Requests that reach the network, against a walk through each URL in order."""
import datetime
import random

from refaudit.operators.requests import dedupe_requests
from refaudit.streaming.requests import dedupe_stream, fetched_batch

SCHEMA = "request_id bigint, ts timestamp, provider string, url string, status int, retry_after string"
DAY = datetime.datetime(2024, 1, 1)


def walk(rows, ttl=300):
    until, out = {}, set()
    for i, ts, provider, url, status, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if ts >= until.get((provider, url), datetime.datetime.min):
            out.add(i)
            if status == 200:
                until[provider, url] = ts + datetime.timedelta(seconds=ttl)
    return out


def test_requests_that_reach_the_network(spark):
    """A URL with a third of the log that is never quiet, sparse ones, equal moments, failures, long pauses and exact expiries."""
    rng = random.Random(9)
    rows = [(i, DAY + datetime.timedelta(seconds=rng.randint(0, 20_000)), "p", "busy", rng.choice([200, 200, 429, 503]), "") for i in range(700)]
    rows += [(1000 + i, DAY + datetime.timedelta(seconds=100 * rng.randint(0, 900)), f"p{i % 3}", f"u{i % 40}", rng.choice([200, 200, 404]), "") for i in range(1400)]
    rows += [(5000 + i, DAY + datetime.timedelta(seconds=300 * i), "p", "exact", 200, "") for i in range(9)]
    rows += [(6000 + i, DAY, "p", "same moment", 503 if i < 2 else 200, "") for i in range(5)] + [(6100, DAY, "p", None, 200, ""), (6101, DAY, None, "u", None, "")]
    out = dedupe_requests(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert out.columns == ["request_id", "ts", "provider", "url", "status", "retry_after"]
    named = [r for r in rows if r[2] and r[3]]
    assert {r.request_id for r in out.collect() if r.provider and r.url} == walk(named)


def test_nothing_asked(spark):
    assert dedupe_requests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_same_as_they_arrive(spark, tmp_path):
    """Three arrivals, each going on from the last successes of the one before; a replayed batch changes nothing."""
    rng = random.Random(4)
    rows = [(i, DAY + datetime.timedelta(seconds=20 * i + rng.randint(0, 19)), "p", f"u{rng.randint(0, 3)}", rng.choice([200, 200, 503]), "") for i in range(300)]
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    parts = [spark.createDataFrame(rows[at:at + 100], SCHEMA) for at in (0, 100, 200)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        dedupe_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), folder, checkpoint).awaitTermination()

    def seen():
        return sorted(r.request_id for r in spark.read.schema(SCHEMA).parquet(folder + "/fetched").collect())
    first = seen()
    assert first == sorted(walk(rows))
    fetched_batch(folder)(parts[2], 2)
    assert seen() == first
