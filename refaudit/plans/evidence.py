"""Content audit: citations with their publications and claims in, verdicts out."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.operators import evidence as E
from refaudit.operators.reports import ready_entries
from refaudit.session import stage_table

Assessor = Callable[[DataFrame, DataFrame], DataFrame]
_ASSESSORS: dict[str, Assessor] = {}


def register_assessor(name: str, assessor: Assessor) -> None:
    """Register a claim producer: (citations, batched passages) -> claims, e.g. a ``mapInPandas`` job."""
    _ASSESSORS[name] = assessor


def retrieve(citations: DataFrame, publications: DataFrame, expansion: DataFrame | None = None) -> DataFrame:
    """Ranked passages of every citation, in batches."""
    weights = stage_table(E.query_weights(citations, expansion), "weights")
    return E.plan_batches(E.rank_passages(E.bm25(publications, weights)))


def assess(citations: DataFrame, refs: DataFrame, texts: DataFrame, claims: DataFrame | str, expansion: DataFrame | None = None, coverage: bool = False) -> DataFrame:
    """One verdict per citation; whatever blocks assessment becomes unassessable with its reason.

    citations(doc_id, citation_id, reference, issue, sentence, context)
    refs(doc_id, ref_id, raw, status, accepted, confirmed)
    texts(doc_id, ref_id, needs_confirmation, passages)
    claims(doc_id, citation_id, batch, claim, verdict, passage_id, quote), or a registered assessor.
    expansion(citation_id, terms): translated search terms, with ``doc_id/citation_id`` as the id; they weigh in when passages are
    ranked. ``coverage`` adds what was planned and read: batches, scanned_batches, early_stop, passages, characters, query_expansion.
    """
    keyed = citations.withColumn("pub_id", F.concat_ws("/", "doc_id", "reference"))
    pubs = texts.withColumn("pub_id", F.concat_ws("/", "doc_id", "ref_id"))
    clear = F.col("issue").isNull() | F.col("issue").startswith("Korunan alan") | F.col("issue").startswith("Alan kodu/korunan öğe")
    settled = ready_entries(refs).select("doc_id", F.col("ref_id").alias("reference"), F.lit(True).alias("_settled"))
    state = pubs.select("pub_id", F.col("needs_confirmation").alias("_confirm"), F.lit(True).alias("_text"))
    gated = keyed.join(settled, ["doc_id", "reference"], "left").join(state, "pub_id", "left")
    gate = (F.when(F.col("reference").isNull() | ~clear, L.GATE_UNRESOLVED).when(F.col("_settled").isNull(), L.GATE_UNVERIFIED)
            .when(F.col("_text").isNull(), L.GATE_NO_TEXT).when(F.col("_confirm"), L.GATE_CONFIRM))
    gated = stage_table(gated.withColumn("blocked", gate).drop("_settled", "_text", "_confirm"), "gated")
    open_c = gated.where(F.col("blocked").isNull())
    passages = E.chunk_passages(pubs.select("pub_id", "passages").join(open_c.select("pub_id").distinct(), "pub_id", "left_semi"))
    if coverage or isinstance(claims, str):
        batches = retrieve(open_c.select(F.concat_ws("/", "doc_id", "citation_id").alias("citation_id"), "pub_id", "sentence", "context"), pubs, expansion)
    if isinstance(claims, str):
        claims = _ASSESSORS[claims](open_c, batches.join(passages.select("pub_id", "passage_id", "location", "text"), ["pub_id", "passage_id"]))
    mine = claims.join(open_c.select("doc_id", "citation_id", "pub_id"), ["doc_id", "citation_id"])
    mine = mine.withColumn("citation_id", F.concat_ws("/", "doc_id", "citation_id"))
    checked = stage_table(E.verify_quotes(mine, passages), "checked")
    scanned = E.early_stop(E.rollup_verdict(checked, ("citation_id", "batch")))
    merged = E.merge_batches(checked.join(scanned.select("citation_id", "batch"), ["citation_id", "batch"], "left_semi"))
    answer = merged.select("citation_id", F.col("verdict").alias("_v"), F.col("explanation").alias("_e"))
    rows = gated.withColumn("_k", F.concat_ws("/", "doc_id", "citation_id")).join(answer.withColumnRenamed("citation_id", "_k"), "_k", "left")
    extra = []
    if coverage:
        read = E.evidence_coverage(batches, scanned, expansion)
        extra = [c for c in read.columns if c != "citation_id"]
        rows = rows.join(read.withColumnRenamed("citation_id", "_k"), "_k", "left")
    return rows.select("doc_id", "citation_id", *extra, F.coalesce("_v", F.lit("unassessable")).alias("verdict"),
                       F.coalesce("blocked", "_e", F.lit(L.GATE_NO_CLAIMS)).alias("explanation"))
