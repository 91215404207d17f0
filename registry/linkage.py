"""Bibliography linkage over ``bib`` (entries) and ``works`` (catalog)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refaudit.functions import reference as R
from refaudit.operators import linkage as K
from refaudit.plans import verification as P

from refaudit.session import stage_table

from .views import view, with_views


def entries(spark, sf) -> DataFrame:
    return view(spark, sf, "bib").select("ref_id", "doc_id", "pos", "raw")


def catalog(spark, sf) -> DataFrame:
    w = view(spark, sf, "works")
    author = F.array(F.struct(F.col("family"), F.col("given"), F.lit(None).cast("string").alias("literal")))
    return w.select("work_id", "provider", "provider_rank", "row_rank", "title", author.alias("author"), "year", "doi",
                    "container_title", "volume", "issue", "pages", "type", "publisher", F.lit("").alias("language"),
                    F.array().cast("array<struct<family:string,given:string,literal:string>>").alias("editor"), "requires_review", "url")


def _qs(spark, sf):
    """One question per entry here, so results can be keyed by ``ref_id``."""
    return stage_table(K.prepare_references(entries(spark, sf)).withColumn("query_id", F.col("ref_id")), "entries")


def _works(spark, sf):
    return stage_table(K.prepare_catalog(catalog(spark, sf)), "works")


# DuckDB side: entries as parsed, works in normal form, title overlap.
_Q = """q AS (SELECT b.ref_id, b.year, b.doi, lower(b.family) AS fa,
  CASE WHEN damage = 4 THEN lower(b.title || ' ' || t.journal) || ' ' || t.volume || ' ' || t.issue || ' ' || replace(t.pages, '-', ' ') ELSE lower(b.title) END AS t
  FROM bib b JOIN truth t ON b.ref_id = t.k)"""
_PAIRS = """qt AS (SELECT t, list_distinct(string_split(t, ' ')) AS l FROM (SELECT DISTINCT t FROM q)),
wt AS (SELECT t, list_distinct(string_split(t, ' ')) AS l, len(string_split(t, ' ')) AS n FROM (SELECT DISTINCT lower(title) AS t FROM works)),
tp AS (SELECT * FROM (SELECT qt.t AS a, wt.t AS b, CASE WHEN wt.n >= 4 AND starts_with(qt.t, wt.t || ' ') THEN 1.0
   ELSE len(list_intersect(qt.l, wt.l)) / greatest(len(qt.l), len(wt.l)) END AS s FROM qt, wt) WHERE s >= 0.45)"""
_SCORED = """scored AS (SELECT q.ref_id, q.year AS qy, q.doi AS qd, w.work_id, w.provider, w.provider_rank, w.row_rank, w.requires_review, m.s AS title_match,
   lower(w.family) = q.fa AS author_match, w.year = q.year AS year_match, q.doi <> '' AND q.doi = w.doi AS doi_match,
   cast(floor(60 * m.s + CASE WHEN lower(w.family) = q.fa THEN 20 ELSE 0 END + CASE WHEN w.year = q.year THEN 10 ELSE 0 END
     + CASE WHEN q.doi <> '' AND q.doi = w.doi THEN 10 ELSE 0 END + 0.5) AS int) AS score
   FROM q JOIN tp m ON m.a = q.t JOIN works w ON lower(w.title) = m.b)"""
_TOP = """hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, provider ORDER BY score DESC, provider_rank, row_rank, work_id) AS n FROM scored) WHERE n <= 5)"""
_DOI = """doi_hits AS (SELECT q.ref_id, q.year AS qy, q.doi AS qd, w.work_id, w.provider, w.provider_rank, w.row_rank, w.requires_review,
   CASE WHEN w.n >= 4 AND starts_with(q.t, w.t || ' ') THEN 1.0 ELSE len(list_intersect(list_distinct(string_split(q.t, ' ')), w.l)) / greatest(len(list_distinct(string_split(q.t, ' '))), len(w.l)) END AS title_match,
   w.fa = q.fa AS author_match, w.year = q.year AS year_match, true AS doi_match
   FROM q JOIN (SELECT *, lower(title) AS t, lower(family) AS fa, list_distinct(string_split(lower(title), ' ')) AS l, len(string_split(title, ' ')) AS n,
       row_number() OVER (PARTITION BY provider, doi ORDER BY row_rank, work_id) AS rn FROM works WHERE doi <> '') w ON w.doi = q.doi AND w.rn = 1)"""
_STRONG = """(NOT requires_review AND author_match AND year_match AND (qd = '' OR doi_match) AND (title_match >= 0.8 OR (doi_match AND title_match >= 0.7)))"""
_PRIMARY = """(provider = 'Crossref' AND title_match >= 0.8 AND (doi_match OR author_match OR year_match))"""


def _sql(body: str, *parts: str) -> str:
    head = with_views("", "bib", "works").rstrip()
    return head + ", " + ", ".join((_Q, *parts)) + " " + body


_CASCADE = (_PAIRS, _SCORED, _TOP, _DOI, f"""
staged AS (
  SELECT ref_id, qd, work_id, provider, provider_rank, row_rank, requires_review, title_match, author_match, year_match, doi_match,
     cast(floor(60 * title_match + CASE WHEN author_match THEN 20 ELSE 0 END + CASE WHEN year_match THEN 10 ELSE 0 END + 10 + 0.5) AS int) AS score, 0 AS by_title,
     CASE provider WHEN 'Crossref' THEN 1 WHEN 'DataCite' THEN 2 WHEN 'OpenAlex' THEN 4 WHEN 'Semantic Scholar' THEN 5 END AS stage FROM doi_hits
  UNION ALL
  SELECT ref_id, qd, work_id, provider, provider_rank, row_rank, requires_review, title_match, author_match, year_match, doi_match, score, 1,
     CASE provider WHEN 'Crossref' THEN 3 WHEN 'OpenAlex' THEN 4 WHEN 'Semantic Scholar' THEN 5 WHEN 'CORE' THEN 6 WHEN 'OpenLibrary' THEN CASE WHEN qd = '' THEN 7 END END FROM hits),
used AS (SELECT *, {_STRONG} AS strong, {_PRIMARY} AS primary_hit FROM staged s WHERE stage IS NOT NULL
   AND NOT (by_title = 1 AND provider IN ('OpenAlex', 'Semantic Scholar') AND EXISTS (SELECT 1 FROM staged d WHERE d.ref_id = s.ref_id AND d.provider = s.provider AND d.by_title = 0))),
upto AS (SELECT a.ref_id, a.stage AS at_stage, arg_min(b.strong, (-b.score, b.stage, b.by_title, b.provider_rank, b.row_rank, b.work_id)) OR bool_or(b.primary_hit) AS settled
   FROM (SELECT DISTINCT ref_id, stage FROM used) a JOIN used b ON a.ref_id = b.ref_id AND b.stage <= a.stage GROUP BY 1, 2),
stops AS (SELECT ref_id, min(CASE WHEN settled THEN at_stage END) AS stop FROM upto GROUP BY 1),
final AS (SELECT u.ref_id, s.stop, arg_min(u, (-u.score, u.stage, u.by_title, u.provider_rank, u.row_rank, u.work_id)) AS best, bool_or(u.primary_hit) AS primary_found, count(*) AS n_candidates
   FROM used u JOIN stops s ON u.ref_id = s.ref_id WHERE u.stage <= coalesce(s.stop, 10000) GROUP BY 1, 2),
decision AS (SELECT b.ref_id, b.doc_id, b.raw, CASE WHEN f.best.title_match >= 0.45 THEN CASE WHEN f.best.strong THEN 'verified' ELSE 'review' END ELSE 'failed' END AS status,
   coalesce(f.best.score, 0) AS score, CASE WHEN f.best.title_match >= 0.45 THEN f.best.work_id END AS work_id,
   CASE WHEN f.best.title_match >= 0.45 THEN f.best.provider END AS hit_provider, coalesce(f.primary_found, false) AS primary_found, coalesce(f.best.strong, false) AS strong
   FROM bib b LEFT JOIN final f ON b.ref_id = f.ref_id)""")

_SCORE_COLS = ("ref_id", "work_id", "provider", "title_match", "author_match", "year_match", "doi_match", "score")


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("query_id", "ref_id").select(*_SCORE_COLS).withColumn("title_match", F.round("title_match", 6))


def match_by_doi(spark, sf):
    return _scored(K.match_by_doi(_qs(spark, sf), _works(spark, sf))).drop("score")


def match_by_title(spark, sf):
    return _scored(K.match_by_title(_qs(spark, sf), _works(spark, sf)))


def match_by_title_prefix(spark, sf):
    return K.title_prefix_pairs(K._distinct_titles(_qs(spark, sf)), K._distinct_titles(_works(spark, sf)))


def title_pairs(spark, sf):
    out = K.title_pairs(K._distinct_titles(_qs(spark, sf)), K._distinct_titles(_works(spark, sf)))
    return out.withColumn("title_match", F.round("title_match", 6))


def score_candidates(spark, sf):
    """Score of every entry against the true work's rows, found by key."""
    q = K._question_columns(_qs(spark, sf))
    w = _works(spark, sf).withColumn("k", F.floor(F.col("work_id") / 10))
    pairs = q.join(w, F.col("query_id") == F.col("k")).withColumn("title_match", K.title_score(F.col("q_title_norm"), F.col("title_norm")))
    return _scored(K.score_pairs(pairs))


def best_candidate(spark, sf):
    best = K.best_candidate(K.match_by_title(_qs(spark, sf), _works(spark, sf)))
    return best.select(F.col("query_id").alias("ref_id"), "work_id", "score")


def is_strong(spark, sf):
    hits = K.match_by_title(_qs(spark, sf), _works(spark, sf))
    return hits.select(F.col("query_id").alias("ref_id"), "work_id", K.is_strong().alias("strong"))


def primary_identity_found(spark, sf):
    hits = K.match_by_title(_qs(spark, sf), _works(spark, sf))
    return K.primary_identity_found(hits).select(F.col("query_id").alias("ref_id"), "primary_found")


def union_candidates(spark, sf):
    qs, works = _qs(spark, sf), _works(spark, sf)
    a = K.match_by_doi(qs, works).withColumn("found_by", F.lit("doi"))
    b = K.match_by_title(qs, works).withColumn("found_by", F.lit("title"))
    return K.union_candidates(a, b).groupBy("found_by", "provider").agg(F.count("*").alias("n"))


def limit_per_key(spark, sf):
    w = view(spark, sf, "works")
    return K.limit_per_key(w, ["container_title"], 5, [F.desc("year"), F.col("work_id")]).select("container_title", "work_id", "year")


def route_providers(spark, sf):
    e = entries(spark, sf)
    routed = e.select("ref_id", F.posexplode(R.route_providers(F.col("raw"), R.get_doi(F.col("raw")), R.get_arxiv(F.col("raw")))).alias("rank", "provider"))
    return routed


def waterfall(spark, sf):
    qs = _qs(spark, sf)
    out = P.waterfall(qs, _works(spark, sf))
    return out.select(F.col("query_id").alias("ref_id"), "work_id", "score", "strong", "primary_found", "n_candidates",
                      F.array_join("sources_checked", "|").alias("sources"))


def verify_references(spark, sf):
    out = P.verify_references(entries(spark, sf), catalog(spark, sf))
    return out.select("ref_id", "status", "score", "work_id", "fallback_needed",
                      F.when(F.col("status").isin("verified", "review"), F.col("provider")).alias("provider"))


def verified_output(spark, sf):
    """Corrected text: the original unless verified."""
    out = P.verify_references(entries(spark, sf), catalog(spark, sf))
    return out.select("ref_id", (F.col("corrected") == F.col("raw")).alias("kept"), F.col("suggested").isNotNull().alias("proposed"))


def two_phase_verify(spark, sf):
    out = P.two_phase_verify(entries(spark, sf), catalog(spark, sf))
    return out.select("ref_id", "status", "score", "work_id")


def verify_stream(spark, sf):
    """All entries as a stream in two micro-batches; the latest decision of each."""
    import uuid

    from refaudit.session import checkpoint_dir
    from refaudit.streaming.requests import decisions
    from refaudit.streaming.requests import verify_stream as s
    folder, rows = f"{checkpoint_dir(spark)}/refaudit-stream/{uuid.uuid4().hex}", entries(spark, sf)
    prepared, half = P.prepare(catalog(spark, sf)), F.pmod(F.xxhash64("ref_id"), F.lit(2))
    for i in range(2):
        rows.where(half == i).write.mode("append").parquet(folder + "/in")
        s(spark.readStream.schema(rows.schema).parquet(folder + "/in"), prepared, folder + "/out", folder + "/cp").awaitTermination()
    return decisions(spark, folder + "/out").select("ref_id", "status", "score", "work_id")


def status_summary(spark, sf):
    from refaudit.operators.reports import status_summary as s
    return s(P.verify_references(entries(spark, sf), catalog(spark, sf)))


def changed_fields(spark, sf):
    out = P.verify_references(entries(spark, sf), catalog(spark, sf))
    return out.select("ref_id", F.array_contains("changes", "DOI bulundu").alias("doi_found"),
                      F.array_contains("changes", "Başlık farklı").alias("title_differs"),
                      F.exists("changes", lambda c: c.startswith("Yıl ")).alias("year_differs"))


def sources_checked(spark, sf):
    out = P.verify_references(entries(spark, sf), catalog(spark, sf))
    return out.select("ref_id", F.posexplode("sources_checked").alias("rank", "provider"))


_hit = "ref_id, work_id, provider, round(title_match, 6) AS title_match, author_match, year_match, doi_match"
_SOURCES = """CASE WHEN {s} = 1 THEN 'Crossref' WHEN {s} = 2 OR ({s} = 3 AND b.doi <> '') THEN 'Crossref|DataCite' WHEN {s} = 3 THEN 'Crossref'
  ELSE 'Crossref' || CASE WHEN b.doi <> '' THEN '|DataCite' ELSE '' END || '|OpenAlex' || CASE WHEN {s} = 4 THEN '' ELSE '|Semantic Scholar' END
   || CASE WHEN {s} IN (4, 5) THEN '' ELSE '|CORE' END || CASE WHEN {s} IN (4, 5, 6) OR b.doi <> '' THEN '' ELSE '|OpenLibrary' END END"""
_SRC = _SOURCES.format(s="coalesce(f.stop, 99)")

QUERIES = {f.__name__: f for f in (
    match_by_doi, match_by_title, match_by_title_prefix, title_pairs, score_candidates, best_candidate, is_strong,
    primary_identity_found, union_candidates, limit_per_key, route_providers, waterfall, verify_references, verified_output,
    two_phase_verify, verify_stream, status_summary, changed_fields, sources_checked)}

ORACLES = {
    "match_by_doi": _sql(f"SELECT {_hit} FROM doi_hits", _DOI),
    "match_by_title": _sql(f"SELECT {_hit}, score FROM hits", _PAIRS, _SCORED, _TOP),
    "match_by_title_prefix": _sql("SELECT qt.t AS q_title_norm, wt.t AS title_norm, 1.0::DOUBLE AS title_match FROM qt, wt WHERE wt.n >= 4 AND starts_with(qt.t, wt.t || ' ')", _PAIRS),
    "title_pairs": _sql("SELECT a AS q_title_norm, b AS title_norm, round(s, 6) AS title_match FROM tp", _PAIRS),
    "score_candidates": _sql("""SELECT ref_id, work_id, provider, round(title_match, 6) AS title_match, author_match, year_match, doi_match,
        cast(floor(60 * title_match + CASE WHEN author_match THEN 20 ELSE 0 END + CASE WHEN year_match THEN 10 ELSE 0 END + CASE WHEN doi_match THEN 10 ELSE 0 END + 0.5) AS int) AS score
        FROM (SELECT q.ref_id, w.work_id, w.provider, CASE WHEN len(string_split(w.title, ' ')) >= 4 AND starts_with(q.t, lower(w.title) || ' ') THEN 1.0
          ELSE len(list_intersect(list_distinct(string_split(q.t, ' ')), list_distinct(string_split(lower(w.title), ' '))))
          / greatest(len(list_distinct(string_split(q.t, ' '))), len(list_distinct(string_split(lower(w.title), ' ')))) END AS title_match,
          lower(w.family) = q.fa AS author_match, w.year = q.year AS year_match, q.doi <> '' AND q.doi = w.doi AS doi_match
        FROM q JOIN works w ON w.k = q.ref_id)"""),
    "best_candidate": _sql("SELECT ref_id, arg_min(work_id, (-score, provider_rank, row_rank, work_id)) AS work_id, max(score) AS score FROM hits GROUP BY 1", _PAIRS, _SCORED, _TOP),
    "is_strong": _sql(f"SELECT ref_id, work_id, {_STRONG} AS strong FROM hits", _PAIRS, _SCORED, _TOP),
    "primary_identity_found": _sql(f"SELECT ref_id, bool_or{_PRIMARY} AS primary_found FROM hits GROUP BY 1", _PAIRS, _SCORED, _TOP),
    "union_candidates": _sql("SELECT found_by, provider, count(*) AS n FROM (SELECT 'doi' AS found_by, provider FROM doi_hits UNION ALL SELECT 'title', provider FROM hits) GROUP BY 1, 2", _PAIRS, _SCORED, _TOP, _DOI),
    "limit_per_key": with_views("SELECT container_title, work_id, year FROM (SELECT *, row_number() OVER (PARTITION BY container_title ORDER BY year DESC, work_id) AS n FROM works) WHERE n <= 5", "works"),
    "route_providers": with_views("""SELECT ref_id, cast(row_number() OVER (PARTITION BY ref_id ORDER BY o) - 1 AS int) AS rank, provider FROM (
        SELECT ref_id, 1 AS o, 'Europe PMC' AS provider FROM bib WHERE regexp_matches(lower(raw), 'pmid|pubmed|medicine|medical|clinical|health|cancer|patient|aspirin|diabetes|hast[aı]|sağlık|tıp')
        UNION ALL SELECT ref_id, 2, 'PubMed' FROM bib WHERE regexp_matches(lower(raw), 'pmid|pubmed|medicine|medical|clinical|health|cancer|patient|aspirin|diabetes|hast[aı]|sağlık|tıp')
        UNION ALL SELECT ref_id, 3, 'DBLP' FROM bib WHERE regexp_matches(lower(raw), 'learning|computer|neural|algorithm|transformer|attention|acm|ieee|informatics')
        UNION ALL SELECT ref_id, 5, 'Semantic Scholar' FROM bib UNION ALL SELECT ref_id, 6, 'CORE' FROM bib UNION ALL SELECT ref_id, 7, 'OpenLibrary' FROM bib WHERE doi = '')""", "bib"),
    "waterfall": _sql(f"""SELECT b.ref_id, f.best.work_id AS work_id, f.best.score AS score, f.best.strong AS strong, coalesce(f.primary_found, false) AS primary_found,
        coalesce(f.n_candidates, 0) AS n_candidates, {_SRC} AS sources FROM bib b LEFT JOIN final f ON b.ref_id = f.ref_id""", *_CASCADE),
    "verify_references": _sql("SELECT ref_id, status, score, work_id, NOT primary_found AND NOT strong AS fallback_needed, hit_provider AS provider FROM decision", *_CASCADE),
    "verified_output": _sql("SELECT ref_id, status <> 'verified' AS kept, work_id IS NOT NULL AS proposed FROM decision", *_CASCADE),
    "verify_stream": _sql("SELECT ref_id, status, score, work_id FROM decision", *_CASCADE),
    "two_phase_verify": _sql("SELECT ref_id, status, score, work_id FROM decision", *_CASCADE),
    "status_summary": _sql("SELECT coalesce(status, 'all') AS status, count(*) AS n FROM decision GROUP BY ROLLUP (decision.status)", *_CASCADE),
    "changed_fields": _sql("""SELECT d.ref_id, d.work_id IS NOT NULL AND w.doi <> '' AND b.doi = '' AS doi_found,
        d.work_id IS NOT NULL AND f.best.title_match < 0.99 AS title_differs, d.work_id IS NOT NULL AND b.year <> w.year AS year_differs
        FROM decision d JOIN bib b ON d.ref_id = b.ref_id LEFT JOIN final f ON f.ref_id = d.ref_id LEFT JOIN works w ON w.work_id = d.work_id""", *_CASCADE),
    "sources_checked": _sql(f"""SELECT ref_id, cast(generate_subscripts(s, 1) - 1 AS int) AS rank, unnest(s) AS provider
        FROM (SELECT b.ref_id, string_split({_SRC}, '|') AS s FROM bib b LEFT JOIN final f ON b.ref_id = f.ref_id)""", *_CASCADE),
}
