"""Reports, identities and decisions that combine the other inputs."""
from __future__ import annotations

from pyspark.sql import functions as F

from refaudit.operators import edits as E
from refaudit.operators import evidence as V
from refaudit.operators import reports as P
from refaudit.plans.verification import error_summary as _errors
from refaudit.plans.verification import verify_references

from . import evidence as RE
from . import forms as RF
from . import linkage as RL
from . import manuscript as RM
from .linkage import catalog, entries
from .logs import requests
from .views import table, view, with_views

C, L = F.col, F.lit


def audit_report(spark, sf):
    """Rows per section of the full report."""
    a = RM._audit(spark, sf)
    ev = RE._assessed(spark, sf)
    return P.audit_report(a.findings, ev, a.references).groupBy("section").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def publication_identity(spark, sf):
    """Each entry with a text that opens with its title, its DOI, or something else."""
    b = view(spark, sf, "bib")
    opening = F.when(C("pos") % 3 == 0, F.upper("true_title")).when(C("pos") % 3 == 1, F.concat(L("see "), F.when(C("doi") != "", C("doi")).otherwise(L("nothing")))).otherwise(L("other"))
    texts = b.select("ref_id", C("true_title").alias("title"), (C("pos") == 6).alias("alternate"), F.array(F.struct(L("1").alias("location"), opening.alias("text"))).alias("passages"))
    out = V.publication_identity(b.select("ref_id", "raw", "title"), texts)
    return out.select("ref_id", F.round("title_score", 6).alias("title_score"), "mismatch", "needs_confirmation")


def version_gate(spark, sf):
    b = view(spark, sf, "bib")
    version = F.element_at(F.array(L(""), L("vor"), L("publishedVersion"), L("submittedVersion")), (C("pos") % 4 + 1).cast("int"))
    url = F.when(C("pos") % 5 == 0, "https://arxiv.org/pdf/1").otherwise("https://h/x.pdf")
    return b.select("ref_id", V.version_gate(version, url, C("pos") % 7 == 0).alias("gated"))


def entry_patches(spark, sf):
    p = RM._paragraphs(spark, sf)
    refs = view(spark, sf, "bib").select("doc_id", F.concat(L("r"), C("pos")).alias("ref_id"), F.array(F.concat(L("b"), C("pos"))).alias("paragraphs"))
    outs = refs.select("doc_id", "ref_id", F.concat(L("New "), C("ref_id")).alias("text"))
    return E.apply_patches(p, E.entry_patches(refs, p, outs)).select("doc_id", "paragraph_id", "text")


def changed_decisions(spark, sf):
    """Every eighth status and every ninth match changed between two runs."""
    old = RF._results(spark, sf).select("doc_id", "ref_id", "status", C("ref_id").alias("work_id"))
    new = old.withColumn("status", F.when(C("ref_id") % 8 == 0, "review").otherwise(C("status"))).withColumn("work_id", F.when(C("ref_id") % 9 == 0, None).otherwise(C("work_id")))
    return E.changed_decisions(old, new).select("doc_id", "ref_id")


def error_summary(spark, sf):
    """Failed requests of the log as lookup errors of fifty-request groups."""
    r = requests(spark, sf).where("status <> 200")
    err = r.select(F.floor(C("request_id") / 50).alias("ref_id"), C("request_id").alias("seq"), "provider", "status", L("fault").alias("message"), F.when(C("status") == 429, C("ts").cast("timestamp")).alias("retry_at"))
    return _errors(err).select("ref_id", F.size("warnings").alias("n_warnings"), C("warnings")[0].alias("first_warning"), F.size("pending_providers").alias("n_pending"), C("pending_retry_at").cast("timestamp_ntz").alias("pending_retry_at"))


def errors_decide(spark, sf):
    """Entries whose lookups failed technically are 'error', not 'failed'."""
    e = entries(spark, sf)
    err = e.where("ref_id % 2 = 1").select("ref_id", L(0).alias("seq"), L("CORE").alias("provider"), L(429).alias("status"), L("").alias("message"), F.lit("2024-01-01").cast("timestamp").alias("retry_at"))
    return verify_references(e, catalog(spark, sf), errors=err).select("ref_id", "status", F.size("warnings").alias("n_warnings"))


def nfkd(spark, sf):
    from refaudit.functions.text import fold_marks
    return table(spark, sf, "documents").select("doc_id", F.md5(fold_marks(C("text"))).alias("v"))


QUERIES = {f.__name__: f for f in (audit_report, publication_identity, version_gate, entry_patches, changed_decisions, error_summary, errors_decide, nfkd)}

_SPLIT = "list_distinct(string_split(lower({c}), ' '))"
ORACLES = {
    "publication_identity": with_views(f"""SELECT ref_id, round(CASE WHEN len(string_split(true_title, ' ')) >= 4 AND starts_with(lower(title), lower(true_title) || ' ') THEN 1.0 ELSE s END, 6) AS title_score, s < 0.65 AS mismatch,
        pos = 6 OR NOT ((pos % 3 = 0 AND contains(lower(true_title), lower(title))) OR (pos % 3 = 1 AND doi <> '')) AS needs_confirmation
        FROM (SELECT *, len(list_intersect({_SPLIT.format(c='title')}, {_SPLIT.format(c='true_title')})) / greatest(len({_SPLIT.format(c='title')}), len({_SPLIT.format(c='true_title')})) AS s FROM bib)""", "bib"),
    "version_gate": with_views("SELECT ref_id, (pos % 4 = 3 OR pos % 5 = 0) AND pos % 7 <> 0 AS gated FROM bib", "bib"),
    "entry_patches": RM._sql("SELECT q.doc_id, q.paragraph_id, coalesce('New r' || b.pos, q.text) AS text FROM paragraphs q LEFT JOIN bib b ON b.doc_id = q.doc_id AND q.paragraph_id = 'b' || b.pos"),
    "changed_decisions": with_views("SELECT doc_id, ref_id FROM bib WHERE ref_id % 9 = 0 OR (ref_id % 8 = 0 AND damage NOT IN (1, 5))", "bib"),
    "error_summary": with_views("""SELECT cast(floor(request_id / 50) AS bigint) AS ref_id, count(*) AS n_warnings, arg_min(CASE WHEN status = 429 THEN provider || ': sorgu kotası/hız sınırı (HTTP 429)' ELSE 'fault' END, request_id) AS first_warning,
        count(CASE WHEN status = 429 THEN 1 END) AS n_pending, min(CASE WHEN status = 429 THEN ts END) AS pending_retry_at FROM requests WHERE status <> 200 GROUP BY 1""", "requests"),
    "errors_decide": f"""SELECT ref_id, CASE WHEN status = 'failed' AND ref_id % 2 = 1 THEN 'error' ELSE status END AS status, cast(ref_id % 2 AS int) AS n_warnings
        FROM ({RL.ORACLES["verify_references"]})""",
    "nfkd": "SELECT doc_id, md5(strip_accents(text)) AS v FROM documents",
}
