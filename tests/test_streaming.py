"""Streams end up where the batch operators do; replayed micro-batches change nothing."""
import datetime as dt

from test_linkage import RAW, WORK, work

from refaudit.operators.requests import merge_quota, quota_state, quota_summary, summary_state
from refaudit.plans.verification import prepare, verify_references
from refaudit.streaming.requests import decisions, quota_batch, quota_after, verify_batch, verify_stream

REQUEST = "request_id bigint, ts timestamp, provider string, url string, status int, retry_after string"


def _log():
    """Two providers: one that fails, recovers and fails again within and over minutes; one that never answers well."""
    day = dt.datetime(2024, 5, 1, 12)
    marks = [(0, 429), (20, 429), (30, 200), (40, 429), (41, 503), (90, 429), (150, 200), (150, 429), (155, 429)]
    rows = [(i, day + dt.timedelta(seconds=s), "a", "u", status, None if i % 2 else "7") for i, (s, status) in enumerate(marks)]
    return rows + [(20 + i, day + dt.timedelta(seconds=45 * i), "b", "u", 429, None) for i in range(7)] + [(40, day, "c", "u", 200, None)]


def _states(df):
    return {r.provider: (r.attempt, r.cooldown_until) for r in df.collect()}


def test_quota_summaries_merge(spark):
    log = sorted(_log(), key=lambda r: (r[1], r[0]))
    whole = _states(quota_state(spark.createDataFrame(log, REQUEST)))
    assert {p: a for p, (a, _) in whole.items()} == {"a": 2, "b": 7, "c": 0}
    for cut in (0, 1, 5, 9, 12, len(log)):
        parts = [quota_summary(spark.createDataFrame(log[i:j], REQUEST)) for i, j in ((0, cut), (cut, len(log)))]
        assert _states(summary_state(merge_quota(*parts))) == whole


def test_quota_batches(spark, tmp_path):
    log = sorted(_log(), key=lambda r: (r[1], r[0]))
    each = quota_batch(str(tmp_path))
    for batch_id, (i, j) in ((0, (0, 6)), (1, (6, len(log))), (1, (6, len(log)))):  # the second batch is replayed
        each(spark.createDataFrame(log[i:j], REQUEST), batch_id)
    assert _states(quota_after(spark, str(tmp_path))) == _states(quota_state(spark.createDataFrame(log, REQUEST)))


def _answers(df):
    return {r.ref_id: (r.status, r.work_id) for r in df.collect()}


def _bibliography(spark):
    refs = spark.createDataFrame([(0, RAW), (1, "Kern, A. (2020). A record of education.")], "ref_id bigint, raw string")
    return refs, spark.createDataFrame([work(1), work(2, "ERIC", "A record of education", "Kern", 2020, "")], WORK)


def test_verify_stream(spark, tmp_path):
    refs, works = _bibliography(spark)
    refs.write.parquet(str(tmp_path / "in"))
    out, prepared, want = str(tmp_path / "out"), prepare(works, 4), {0: ("verified", 1), 1: ("verified", 2)}
    stream = spark.readStream.schema(refs.schema).parquet(str(tmp_path / "in"))
    verify_stream(stream, prepared, out, str(tmp_path / "cp")).awaitTermination()
    assert _answers(decisions(spark, out)) == _answers(verify_references(refs, works)) == want
    each = verify_batch(prepared, out)
    each(refs, 0)  # replayed
    assert _answers(decisions(spark, out)) == want
    each(spark.createDataFrame([(1, "Other, B. (1999). Nothing that any catalog knows.")], refs.schema), 1)  # an entry that was edited
    assert _answers(decisions(spark, out)) == {0: ("verified", 1), 1: ("failed", None)}


def test_prepared_catalog_is_not_shuffled(spark):
    refs, works = _bibliography(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prepare(works, 4).wide.join(refs.withColumnRenamed("ref_id", "work_id"), "work_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the asked side only
