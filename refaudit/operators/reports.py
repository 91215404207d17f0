"""Counts, filters and report tables over results."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.functions.text import turkish_lower
from refaudit.functions.web import reference_url


def status_summary(results: DataFrame) -> DataFrame:
    """Entries per status and in total ('all')."""
    return results.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), "n")


def count_entries(refs: DataFrame) -> DataFrame:
    """Detected entries per document."""
    return refs.groupBy("doc_id").agg(F.count("*").alias("n"))


def finding_group() -> Column:
    return (F.when(F.col("finding_id").startswith("orphan-"), "orphan-references")
            .when(F.col("type").startswith(L.ISSUE_ORPHAN), "orphan-citations").otherwise("issues"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Issues, orphan citations and orphan references per document."""
    return findings.groupBy("doc_id", finding_group().alias("finding_group")).agg(F.count("*").alias("n"))


def verdict_summary(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations per verdict; 'pending' without evidence."""
    rows = citations.select("doc_id", "citation_id").join(evidence.select("doc_id", "citation_id", "verdict"), ["doc_id", "citation_id"], "left")
    return rows.groupBy(F.coalesce("verdict", F.lit("pending")).alias("verdict")).agg(F.count("*").alias("n"))


def blocker_distribution(evidence: DataFrame, cause: str = "explanation") -> DataFrame:
    """Share of unassessable citations by cause; the total is a one-row aggregate."""
    blocked = evidence.where(F.col("verdict") == "unassessable")
    counts = blocked.groupBy(F.col(cause).alias("cause")).agg(F.count("*").alias("n"), F.lit(1).alias("_k"))
    total = blocked.agg(F.count("*").alias("total"), F.lit(1).alias("_k"))
    return counts.join(F.broadcast(total), "_k").select("cause", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("share"))


def derived_status(status: Column, accepted: Column, confirmed: Column, similarity: Column) -> Column:
    """Settled by the user counts as verified; verified with a differing text needs correction."""
    return (F.when(status.isNotNull() & (accepted | confirmed), "verified")
            .when((status == "verified") & similarity.isNotNull() & (similarity < 100), "correction")
            .otherwise(F.coalesce(status, F.lit("pending"))))


def filter_by_status(results: DataFrame, status: str) -> DataFrame:
    return results if status == "all" else results.where(F.col("status") == status)


def search_rows(df: DataFrame, query: str, *fields: str) -> DataFrame:
    """Turkish-locale, case-insensitive substring search over concatenated fields."""
    if not query:
        return df
    haystack = turkish_lower(F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in fields]))
    return df.where(haystack.contains(turkish_lower(F.lit(query))))


def problem_records(results: DataFrame) -> DataFrame:
    """Entries that wait, need another provider or had failed requests, with reduced fields."""
    rows = results.where(F.col("pending_retry_at").isNotNull() | F.col("fallback_needed") | (F.size("warnings") > 0))
    return rows.select("ref_id", F.substring("raw", 1, 800).alias("reference"), "status", "status_text", "provider", "fallback_needed",
                       "pending_retry_at", "pending_providers", "sources_checked", "warnings")


def reference_progress(results: DataFrame, by: str = "doc_id") -> DataFrame:
    """Queried, settled and waiting entries with the percentage queried."""
    queried = F.col("status").isNotNull() & (F.col("status") != "pending")
    waiting = F.col("pending_retry_at").isNotNull() | F.coalesce("fallback_needed", F.lit(False))
    rows = results.groupBy(by).agg(F.count("*").alias("total"), F.count_if(queried).alias("queried"),
                                   F.count_if(queried & ~waiting).alias("completed"), F.count_if(waiting).alias("pending"))
    return rows.withColumn("percent", F.floor(100 * F.col("queried") / F.col("total") + 0.5).cast("int"))


def pending_retry(results: DataFrame, cooldowns: DataFrame) -> DataFrame:
    """Earliest retry per entry: a provider's current cooldown overrides the stored time."""
    rows = results.select("ref_id", F.explode("pending_providers").alias("p")).select("ref_id", "p.provider", "p.retry_at")
    joined = rows.join(cooldowns.select("provider", "cooldown_until"), "provider", "left")
    return joined.groupBy("ref_id").agg(F.min(F.coalesce("cooldown_until", "retry_at")).alias("retry_at"),
                                        F.array_sort(F.collect_set("provider")).alias("providers"))


def scoped_citations(citations: DataFrame, evidence: DataFrame | None = None, paragraph: str | None = None, citation: str | None = None,
                     matched_only: bool = False, pending_only: bool = False) -> DataFrame:
    """Citations inside a scope; filters that are off cost nothing."""
    out = citations
    if paragraph:
        out = out.where(F.col("paragraph_id") == paragraph)
    if citation:
        out = out.where(F.col("citation_id") == citation)
    if matched_only:
        out = out.where(F.col("reference").isNotNull() & F.col("issue").isNull())
    if pending_only and evidence is not None:
        out = out.join(evidence.select("doc_id", "citation_id").distinct(), ["doc_id", "citation_id"], "left_anti")
    return out


def ready_entries(refs: DataFrame) -> DataFrame:
    """Entries whose identity is settled: verified, accepted, confirmed, or a web address."""
    return refs.where((F.coalesce("status", F.lit("")) == "verified") | F.col("accepted") | F.col("confirmed") | (reference_url(F.col("raw")) != ""))


def ready_for_evidence(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations with a settled entry and no open issue (protected fields do not block)."""
    clear = F.col("issue").isNull() | F.col("issue").startswith("Korunan alan") | F.col("issue").startswith("Alan kodu/korunan öğe")
    settled = ready_entries(refs).select("doc_id", F.col("ref_id").alias("reference"))
    return citations.where(F.col("reference").isNotNull() & clear).join(settled, ["doc_id", "reference"], "left_semi")


def needs_verification(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations whose entry is unverified, not accepted or confirmed, and not a direct web link."""
    url = reference_url(F.col("raw"))
    direct = (url != "") & ~url.rlike(r"(?i)^https://(?:dx\.)?doi\.org/")
    open_refs = refs.where((F.coalesce("status", F.lit("")) != "verified") & ~F.col("accepted") & ~F.col("confirmed") & ~direct)
    return citations.join(open_refs.select("doc_id", F.col("ref_id").alias("reference")), ["doc_id", "reference"], "left_semi")


def fingerprint() -> Column:
    """What an evidence result depends on."""
    return F.sha2(F.concat_ws("\x01", F.col("sentence"), F.array_join("context", "\x02"), F.coalesce("reference", F.lit("")), F.coalesce("issue", F.lit(""))), 256)


def reusable_results(evidence: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence of citations whose sentence, context, entry and issue did not change."""
    before = old.select("doc_id", "citation_id", fingerprint().alias("fp"))
    after = new.select("doc_id", "citation_id", fingerprint().alias("fp"))
    same = before.join(after, ["doc_id", "citation_id", "fp"], "left_semi").select("doc_id", "citation_id")
    return evidence.join(same, ["doc_id", "citation_id"], "left_semi")


REPORT = ("section", "doc_id", "item_id", "label", "location", "detail")


def audit_report(findings: DataFrame, evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """One tidy table of issues, orphans, evidence and entries, independent of any filter."""
    a = findings.select(finding_group().alias("section"), "doc_id", F.col("finding_id").alias("item_id"), F.col("type").alias("label"), "location", F.col("original").alias("detail"))
    e = evidence.select(F.lit("evidence").alias("section"), "doc_id", F.col("citation_id").alias("item_id"), F.col("verdict").alias("label"),
                        F.lit(None).cast("string").alias("location"), F.col("explanation").alias("detail"))
    r = refs.select(F.lit("references").alias("section"), "doc_id", F.col("ref_id").alias("item_id"), F.lit(None).cast("string").alias("label"),
                    F.lit(None).cast("string").alias("location"), F.col("raw").alias("detail"))
    return a.unionByName(e).unionByName(r)
