"""Bibliography verification: entries in, one decision per entry out."""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.functions.apa import apa_spans, format_crossref_apa, spans_html, spans_text
from refaudit.functions.reference import describe_error, get_doi
from refaudit.functions.web import parse_web_reference
from refaudit.operators.linkage import (first_by_doi, is_primary_identity, is_strong, join_by_doi, match_by_title,
                                        prepare_catalog, prepare_references, questions)
from refaudit.operators.shaping import with_computed
from refaudit.session import checkpoint_dir, stage_table

PRIMARY = "Crossref"
DOI_ONLY = ("Crossref", "DataCite")           # stages 1 and 2
DOI_OR_TITLE = ("Europe PMC", "PubMed")       # asked for both at once
DOI_THEN_TITLE = ("OpenAlex", "Semantic Scholar")  # title search only without a direct hit
WORK_FIELDS = ("title", "author", "year", "doi", "container_title", "volume", "issue", "pages", "type", "publisher", "language", "editor", "url")
_FLAGS = ("title_match", "author_match", "year_match", "doi_match", "requires_review")


@dataclass(frozen=True)
class PreparedCatalog:
    """A catalog made ready once: ``works`` in normal form, ``by_doi`` (bucketed by DOI) and ``wide`` (bucketed by work id)."""

    works: DataFrame
    by_doi: DataFrame
    wide: DataFrame


def prepare(catalog: DataFrame, buckets: int | None = None) -> PreparedCatalog:
    """Write a catalog's normal forms and its two bucketed indexes under a new version name in the shared folder.

    Lookups by DOI and by work id shuffle the asked rows only: the catalog side of either join lies in ``buckets`` (the number of
    shuffle partitions unless given) already. The tables are Spark tables of this session; their files stay in the shared folder.
    """
    spark, version = catalog.sparkSession, uuid.uuid4().hex
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    works = stage_table(prepare_catalog(catalog), "works")

    def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
        name = f"refaudit_{label}_{version}"
        path = f"{checkpoint_dir(spark).rstrip('/')}/refaudit-catalog/{version}/{label}"
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        return spark.table(name)
    wide = catalog.select("work_id", *[F.col(c).alias(f"w_{c}") for c in WORK_FIELDS])
    return PreparedCatalog(works, bucketed(first_by_doi(works), "doi", "by_doi"), bucketed(wide, "work_id", "wide"))


def _route_stage(provider: Column, route: Column) -> Column:
    at = F.array_position(route, provider)
    return F.when(at > 0, at.cast("int") + 4)


def _staged(doi_hits: DataFrame, title_hits: DataFrame, qs: DataFrame) -> DataFrame:
    """Give every candidate the step of the cascade that would have produced it.

    Steps: 1 primary by DOI, 2 DataCite by DOI, 3 primary by title, 4 OpenAlex, 5.. the routed
    providers in order; an arXiv id sends the entry to arXiv alone.
    """
    route = qs.select("query_id", "route", "arxiv")
    p, arxiv = F.col("provider"), F.col("arxiv") != ""
    by_doi = doi_hits.join(route, "query_id").withColumn(
        "stage", F.when(arxiv, F.when(p == "arXiv", 1)).when(p == PRIMARY, 1).when(p == "DataCite", 2).when(p == "OpenAlex", 4)
        .when(p.isin(*DOI_OR_TITLE, "Semantic Scholar"), _route_stage(p, F.col("route")))).withColumn("by_title", F.lit(0))
    by_title = title_hits.join(route, "query_id").withColumn(
        "stage", F.when(arxiv, F.lit(None).cast("int")).when(p == PRIMARY, 3).when(p == "OpenAlex", 4)
        .otherwise(_route_stage(p, F.col("route")))).withColumn("by_title", F.lit(1))
    return by_doi.unionByName(by_title).where(F.col("stage").isNotNull())


def waterfall(qs: DataFrame, works: DataFrame, primary_only: bool = False, k: int = 5, by_doi: DataFrame | None = None) -> DataFrame:
    """Cascade over the providers; stops once an entry is settled.

    Exact DOI lookups run first for everybody (one equi-join); only entries they do not settle
    take part in the similarity join. The remaining steps are folded inside one row per
    question, at most ``k`` candidates for each of the (about 15) steps.
    """
    # An arXiv id is looked up at arXiv only; never by title.
    doi_hits = stage_table(join_by_doi(qs, first_by_doi(works) if by_doi is None else by_doi), "doi-hits")
    early = doi_hits.where(F.col("provider").isin(*DOI_ONLY))
    settled = (early.groupBy("query_id")
               .agg(F.min_by(is_strong(), F.struct(-F.col("score"), "provider_rank", "row_rank")).alias("strong"),
                    F.bool_or(is_primary_identity(PRIMARY)).alias("primary"))
               .where(F.col("strong") | F.col("primary")).select("query_id"))
    # A strong DataCite row behind a weaker primary row still counts: step 2 is checked after step 1.
    open_q = qs.where(F.col("arxiv") == "").join(settled, "query_id", "left_anti")
    title_works = works.where(F.col("provider") == PRIMARY) if primary_only else works.where(F.col("provider") != "arXiv")
    title_hits = match_by_title(open_q, title_works, k)

    staged = _staged(doi_hits, title_hits, qs)
    if primary_only:
        staged = staged.where((F.col("stage") <= 3))
    cand = F.struct((-F.col("score")).alias("neg"), "stage", "by_title", "provider_rank", "row_rank", "work_id", "provider",
                    is_strong().alias("strong"), is_primary_identity(PRIMARY).alias("primary"), "score", *_FLAGS)
    folded = staged.groupBy("query_id").agg(F.sort_array(F.collect_list(cand)).alias("c"))
    # Direct DOI hits replace the title search of the same provider.
    direct = F.transform(F.filter("c", lambda x: (x["by_title"] == 0) & x["provider"].isin(*DOI_THEN_TITLE)), lambda x: x["provider"])
    folded = folded.withColumn("d", direct)
    folded = with_computed(folded.select("query_id", "c", "d"), c=F.filter(
        "c", lambda x: ~((x["by_title"] == 1) & F.array_contains(F.col("d"), x["provider"]))))

    def settles(s: Column) -> Column:
        upto = F.filter("c", lambda x: x["stage"] <= s)
        return upto[0]["strong"] | F.exists(upto, lambda x: x["primary"])
    stages = F.array_sort(F.array_distinct(F.transform("c", lambda x: x["stage"])))
    folded = with_computed(folded, stop=F.array_min(F.filter(stages, settles)))
    folded = with_computed(folded, c=F.filter("c", lambda x: x["stage"] <= F.coalesce(F.col("stop"), F.lit(10_000))))
    out = qs.join(folded.select("query_id", "stop", F.col("c")[0].alias("best"), F.exists("c", lambda x: x["primary"]).alias("primary_found"),
                                F.size("c").alias("n_candidates")), "query_id", "left")
    with_doi = F.col("doi") != ""
    plan = F.when(F.col("arxiv") != "", F.array(F.struct(F.lit(1).alias("s"), F.lit("arXiv").alias("p")))).otherwise(F.filter(F.concat(
        F.array(F.struct(F.when(with_doi, 1).alias("s"), F.lit(PRIMARY).alias("p")), F.struct(F.when(with_doi, 2).alias("s"), F.lit("DataCite").alias("p")),
                F.struct(F.lit(3).alias("s"), F.lit(PRIMARY).alias("p")), F.struct(F.lit(4).alias("s"), F.lit("OpenAlex").alias("p"))),
        F.transform("route", lambda r, i: F.struct((i + 5).alias("s"), r.alias("p")))), lambda x: x["s"].isNotNull()))
    last = F.coalesce(F.col("stop"), F.lit(10_000))
    if primary_only:
        last = F.least(last, F.lit(3))
    asked = F.array_distinct(F.transform(F.filter(plan, lambda x: (x["s"] <= last) | (F.col("arxiv") != "")), lambda x: x["p"]))
    return out.select("query_id", F.col("best.*"), F.coalesce("primary_found", F.lit(False)).alias("primary_found"),
                      F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), asked.alias("sources_checked"))


def changed_fields(year: Column, doi: Column, best_year: Column, best_doi: Column, title_match: Column, status: Column) -> Column:
    """Change tags between an entry and its best candidate."""
    b = F.lower(F.coalesce(best_doi, F.lit("")))
    return F.array_compact(F.array(
        F.when(year.isNotNull() & best_year.isNotNull() & (year != best_year),
               F.concat(F.lit(L.CHANGE_YEAR + " "), year.cast("string"), F.lit(" → "), best_year.cast("string"))),
        F.when((b != "") & (doi != b), F.when(doi != "", F.lit(L.CHANGE_DOI_OTHER)).otherwise(F.lit(L.CHANGE_DOI_FOUND))),
        F.when(title_match < 0.99, F.lit(L.CHANGE_TITLE)),
        F.when(status == "verified", F.lit(L.CHANGE_FORMATTED))))


def review_reasons(year: Column, doi: Column, best_year: Column, author_match: Column, year_match: Column, doi_match: Column,
                   title_match: Column, requires_review: Column, work_type: Column) -> Column:
    """Why a candidate was not accepted automatically."""
    return F.array_compact(F.array(
        F.when(year.isNotNull() & ~year_match, F.concat(
            F.lit("Yıl uyuşmuyor: giriş "), year.cast("string"), F.lit(", bulunan "), F.coalesce(best_year.cast("string"), F.lit("bilinmiyor")))),
        F.when(~author_match, F.lit(L.REASON_AUTHOR)),
        F.when((doi != "") & ~doi_match, F.lit(L.REASON_DOI)),
        F.when(title_match < 0.8, F.lit(L.REASON_TITLE)),
        F.when(requires_review, F.when(work_type == "book", F.lit(L.REASON_BOOK)).otherwise(F.lit(L.REASON_ARCHIVE)))))


def error_summary(errors: DataFrame, key: str = "ref_id") -> DataFrame:
    """Per entry: warnings in arrival order, waiting providers, earliest retry, primary outage."""
    text = describe_error(F.col("provider"), F.col("status"), F.col("message"))
    waiting = F.when(F.col("retry_at").isNotNull(), F.struct("provider", "retry_at"))
    down = (F.col("provider") == PRIMARY) & (F.coalesce(F.col("status"), F.lit(0)).isin(0) | (F.col("status") >= 500))
    return errors.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("w")))), lambda x: x["w"]).alias("warnings"),
        F.array_sort(F.collect_set(waiting)).alias("pending_providers"),
        F.min("retry_at").alias("pending_retry_at"), F.bool_or(down).alias("primary_unavailable"))


def verify_references(refs: DataFrame, catalog: DataFrame | PreparedCatalog, primary_only: bool = False, errors: DataFrame | None = None,
                      web_meta: DataFrame | None = None, k: int = 5, google_books: bool = False) -> DataFrame:
    """Decide ``verified / review / failed / error`` for every entry and propose its APA form.

    ``refs(ref_id, raw, ...)`` keeps its columns; the result has exactly one row per entry.
    ``errors(ref_id, seq, provider, status, message, retry_at)`` reports failed lookups. A catalog that is asked more than once is
    better made ready with :func:`prepare`.
    Entries that are web links without a DOI are left to ``web_meta`` (see ``compare_web``).
    """
    if web_meta is not None:
        from refaudit.operators.webmeta import compare_web
        tagged = refs.withColumn("_web", parse_web_reference(F.col("raw"))["url"]).withColumn("_doi", get_doi(F.col("raw")))
        is_web = F.col("_web").isNotNull() & (F.col("_doi") == "")
        academic = verify_references(tagged.where(~is_web).drop("_web", "_doi"), catalog, primary_only, errors, None, k, google_books)
        web = compare_web(tagged.where(is_web).drop("_web", "_doi"), web_meta)
        return academic.unionByName(web.select(*[c for c in web.columns if c in academic.columns]), allowMissingColumns=True)

    # Parsed entries, questions and normalised works are each read by several joins below.
    prepared = stage_table(prepare_references(refs, google_books=google_books), "entries")
    qs = stage_table(questions(prepared), "questions")
    if isinstance(catalog, PreparedCatalog):
        return decide(prepared, refs.columns, waterfall(qs, catalog.works, primary_only, k, catalog.by_doi), catalog.wide, errors)
    decided = waterfall(qs, stage_table(prepare_catalog(catalog), "works"), primary_only, k)
    return decide(prepared, refs.columns, decided, catalog.select("work_id", *[F.col(c).alias(f"w_{c}") for c in WORK_FIELDS]), errors)


def format_best(answers: DataFrame) -> DataFrame:
    """APA text and HTML of each question's work, or the primary index's own variant."""
    w = F.struct(*[F.col(f"w_{c}").alias(c) for c in WORK_FIELDS])
    shown, primary = F.col("title_match") >= 0.45, F.col("provider") == PRIMARY
    spans = with_computed(answers, _spans=F.when(shown & ~primary, apa_spans(w)))
    return spans.select(
        *[c for c in answers.columns if not c.startswith("w_")],
        F.col("w_year").alias("best_year"), F.col("w_doi").alias("best_doi"), F.col("w_type").alias("best_type"), F.col("w_url").alias("url"),
        F.when(shown, F.when(primary, format_crossref_apa(w)).otherwise(spans_text(F.col("_spans")))).alias("suggested"),
        spans_html(F.col("_spans")).alias("suggested_html"))


def decide(prepared: DataFrame, keep: list[str], decided: DataFrame, wide: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Status, score, changes, reasons and output text from the best candidate of each question.

    The wide catalog columns meet only the one chosen work per question, and formatting runs
    once per question rather than once per entry.
    """
    best = decided.drop("neg", "stage", "by_title", "provider_rank", "row_rank")
    answers = format_best(best.join(wide, "work_id", "left"))
    rows = prepared.select(*keep, "query_id", "year", "doi", "title", "arxiv").join(answers, "query_id", "left")
    if errors is None:
        rows = (rows.withColumn("warnings", F.array().cast("array<string>"))
                .withColumn("pending_providers", F.array().cast("array<struct<provider:string,retry_at:timestamp>>"))
                .withColumn("pending_retry_at", F.lit(None).cast("timestamp")).withColumn("primary_unavailable", F.lit(False)))
    else:
        rows = rows.join(error_summary(errors), "ref_id", "left")
        rows = (rows.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
                .withColumn("primary_unavailable", F.coalesce("primary_unavailable", F.lit(False))))
    usable = F.col("work_id").isNotNull() & ~F.col("primary_unavailable")
    rows = with_computed(rows, _ok=usable & (F.coalesce(F.col("title_match"), F.lit(0.0)) >= 0.45))
    technical = F.size("warnings") > 0
    strong = F.coalesce(F.col("strong"), F.lit(False)) & usable
    status = (F.when(F.col("_ok"), F.when(strong, "verified").otherwise("review"))
              .otherwise(F.when(technical, "error").otherwise("failed")))
    rows = with_computed(rows, status=status)
    ok, verified = F.col("_ok"), F.col("status") == "verified"
    joined = F.array_join("warnings", "; ")
    failure = (F.when(technical, F.concat(joined, F.when(F.col("primary_unavailable"), F.lit(L.REASON_PRIMARY_DOWN)).otherwise(F.lit(L.REASON_ERROR_SUFFIX))))
               .when(F.col("title") != "", F.lit(L.REASON_FAILED)).otherwise(F.lit(L.REASON_UNPARSED)))
    reasons = review_reasons(F.col("year"), F.col("doi"), F.col("best_year"), F.col("author_match"), F.col("year_match"),
                             F.col("doi_match"), F.col("title_match"), F.col("requires_review"), F.col("best_type"))
    changes = changed_fields(F.col("year"), F.col("doi"), F.col("best_year"), F.col("best_doi"), F.col("title_match"), F.col("status"))
    labels = F.create_map(*[x for kv in L.STATUS_TEXT.items() for x in map(F.lit, kv)])
    fallback = F.when(F.col("arxiv") != "", ~strong).otherwise(~F.coalesce(F.col("primary_found"), F.lit(False)) & ~strong)
    return rows.select(
        *keep, "status", labels[F.col("status")].alias("status_text"),
        F.when(usable, F.col("score")).otherwise(0).alias("score"),
        F.when(ok, F.col("provider")).when(technical, F.lit(L.SERVICE_ERROR)).otherwise(F.array_join("sources_checked", " / ")).alias("provider"),
        F.when(ok, F.col("work_id")).alias("work_id"), F.when(ok, F.col("url")).alias("url"),
        F.when(ok, F.col("title_match")).alias("title_match"),
        F.when(ok, changes).otherwise(F.array().cast("array<string>")).alias("changes"),
        F.when(verified, F.lit(L.REASON_VERIFIED)).when(ok, F.concat(F.array_join(reasons, "; "), F.lit(L.REASON_REVIEW_SUFFIX))).otherwise(failure).alias("reason"),
        F.when(ok, F.col("suggested")).alias("suggested"), F.when(ok, F.col("suggested_html")).alias("suggested_html"),
        F.when(verified, F.col("suggested")).otherwise(F.col("raw")).alias("corrected"),
        F.when(verified, F.col("suggested_html")).alias("corrected_html"),
        F.when(ok, F.col("best_year")).alias("matched_year"),
        "warnings", "sources_checked", F.coalesce(fallback, F.lit(True)).alias("fallback_needed"), "pending_providers", "pending_retry_at")


def two_phase_verify(refs: DataFrame, catalog: DataFrame | PreparedCatalog, **options) -> DataFrame:
    """Everybody against the primary index first; only the leftovers see the other providers.

    The catalog is made ready once and the first answers are written once, so neither is computed for both phases.
    """
    catalog = catalog if isinstance(catalog, PreparedCatalog) else prepare(catalog)
    first = stage_table(verify_references(refs, catalog, primary_only=True, **options), "primary-phase")
    rest = first.where("fallback_needed").select(*refs.columns)
    return first.where("not fallback_needed").unionByName(verify_references(rest, catalog, **options))
