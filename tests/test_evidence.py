"""Retrieval order, batching, quote checks and verdicts."""
import pytest
from pyspark.sql import functions as F

from refaudit.operators import evidence as E
from refaudit.plans import evidence as P

PUB = "pub_id int, passages array<struct<location:string,text:string>>"
CIT = "citation_id int, pub_id int, sentence string, context array<string>"


def test_numbers_rank_first(spark):
    pub = spark.createDataFrame([(1, [("a", "Opening words."), ("b", "Depth fell by 17.5% below the datum in 2018."), ("c", "Gauges stood in the creek.")])], PUB)
    cit = spark.createDataFrame([(1, 1, "Limanda derinlik %17,5 azaldı (Kern, 2018).", [])], CIT)
    ranked = E.rank_passages(E.bm25(pub, E.query_weights(cit))).where("rank = 1").first()
    assert ranked.passage_id == "P2"


def test_late_evidence_reaches_the_first_batch(spark):
    pub = spark.createDataFrame([(1, [("1", "Notes on the weather that day. " * 1500), ("9", "We compare suction-dredge pumping schedules."), ("10", "REFERENCES\nSENTINEL")])], PUB)
    cit = spark.createDataFrame([(1, 1, "The review compares suction-dredge pumping schedules.", [])], CIT)
    chunks = E.chunk_passages(pub)
    assert chunks.where(F.col("text").contains("SENTINEL")).count() == 0
    rows = P.retrieve(cit, pub).join(chunks.select("passage_id", "text"), "passage_id").collect()
    assert len({r.batch for r in rows}) > 1 and any("pumping" in r.text for r in rows if r.batch == 0) and any(r.idx == 0 for r in rows if r.batch == 0)
    sizes = {}
    for r in rows:
        sizes[r.batch] = sizes.get(r.batch, 0) + r.n_chars
    assert max(sizes.values()) <= 12000


@pytest.mark.parametrize("quote,text,verdict", [
    ("Kıyıda 36 istasyon kuruldu.", "Kıyıda 36 istasyon kuruldu.", "supported"), ("Sebep gösterildi.", "Kıyıda 36 istasyon kuruldu.", "unassessable"),
    ("sufficient depth of 2.4 metres/tide", "sufﬁcient depth of 2.4\nmetres/tide", "supported"), ("sufficient depth of 24 metres", "sufﬁcient depth of 2.4\nmetres", "unassessable"),
    ("x" * 251, "x" * 300, "unassessable"), ("Depth", "depth", "unassessable"), (" ", "a b", "unassessable")])
def test_quotes_must_be_literal(spark, quote, text, verdict):
    claims = spark.createDataFrame([(1, 1, "supported", "P1", quote)], "citation_id int, pub_id int, verdict string, passage_id string, quote string")
    passages = spark.createDataFrame([(1, "P1", "Sayfa 1", text)], "pub_id int, passage_id string, location string, text string")
    got = E.verify_quotes(claims, passages).first()
    assert got.verdict == verdict and (got.location == "Sayfa 1") == (verdict == "supported")


def test_rollup(spark):
    sets = {1: ["supported", "supported"], 2: ["supported", "unassessable"], 3: ["supported", "contradicted"], 4: ["not_found", "unassessable"], 5: ["not_found"]}
    df = spark.createDataFrame([(k, v, v == "unassessable") for k, vs in sets.items() for v in vs], "citation_id int, verdict string, rejected boolean")
    assert {r.citation_id: r.verdict for r in E.rollup_verdict(df).collect()} == {1: "supported", 2: "partial", 3: "contradicted", 4: "unassessable", 5: "not_found"}


def test_spread_when_no_word_is_shared(spark):
    pub = spark.createDataFrame([(1, [("x", "alpha beta " * 900)])], PUB)
    cit = spark.createDataFrame([(1, 1, "s", ["zzzzz yyyyy"])], CIT)
    rows = E.select_passages(pub, cit).orderBy("passage_id").collect()
    assert [r.idx for r in rows] == [0, 3, 5] and all(len(r.text) <= 1800 for r in rows)


def test_assessor_hook(spark):
    pub = "Evidence sentence for the claim."
    cites = spark.createDataFrame([(1, "c1", "r0", None, "Claim sentence evidence.", ["Claim sentence evidence."]), (1, "c2", None, None, "x", ["x"])], "doc_id int, citation_id string, reference string, issue string, sentence string, context array<string>")
    refs = spark.createDataFrame([(1, "r0", "A, B. (2000). T.", "verified", False, False)], "doc_id int, ref_id string, raw string, status string, accepted boolean, confirmed boolean")
    texts = spark.createDataFrame([(1, "r0", False, [("p", pub)])], "doc_id int, ref_id string, needs_confirmation boolean, passages array<struct<location:string,text:string>>")
    P.register_assessor("echo", lambda c, p: p.select(F.lit(1).alias("doc_id"), F.element_at(F.split("citation_id", "/"), -1).alias("citation_id"), "batch", F.lit("k").alias("claim"), F.lit("supported").alias("verdict"), "passage_id", F.substring("text", 1, 10).alias("quote")))
    assert {r.citation_id: r.verdict for r in P.assess(cites, refs, texts, "echo").collect()} == {"c1": "supported", "c2": "unassessable"}


def test_a_passage_is_normalised_once(spark):
    """Claims meet the key of a quoted passage, not its text; a passage without text holds no quote."""
    passages = spark.createDataFrame([(1, "P1", "x", "the “calm”  sea"), (1, "P2", "y", None)], "pub_id int, passage_id string, location string, text string")
    claims = spark.createDataFrame([(1, "P1", "supported", '"calm" sea'), (1, "P1", "partial", "Calm"), (1, "P2", "supported", "­"), (1, "P3", "supported", "sea"), (1, "P1", "not_found", "sea")],
                                   "pub_id int, passage_id string, verdict string, quote string")
    out = E.verify_quotes(claims, passages)
    assert sorted((r.verdict, r.location or "", r.rejected) for r in out.collect()) == [
        ("not_found", "", False), ("supported", "x", False), ("unassessable", "", True), ("unassessable", "", True), ("unassessable", "", True)]
    assert "passage_text" not in out._jdf.queryExecution().optimizedPlan().toString()
