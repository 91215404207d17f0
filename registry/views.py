"""Derived inputs: one SQL text that Spark and DuckDB both run on the given tables.

The driver tables hold no citations, so bibliographies, catalogs and manuscripts are spelt
out from ``part`` and ``lineitem`` keys, with deterministic damage by key.
"""
from __future__ import annotations

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _word(expr: str) -> str:
    return f"translate(cast({expr} as varchar(20)), '0123456789', 'aeioubdklm')"


def _cap(expr: str) -> str:
    return f"upper(substr({expr}, 1, 1)) || substr({expr}, 2)"


# One row per part: the undamaged truth about a publication.
TRUTH = f"""
SELECT p_partkey AS k,
       cast(floor(p_partkey / 20) AS bigint) AS doc_id,
       cast(p_partkey % 20 AS int) AS pos,
       {_cap(_word("1000 + (CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END) * 7"))} || 'son' AS family,
       cast(1980 + (p_partkey * 13) % 40 AS int) AS true_year,
       {_cap("p_name")} || ' ' || {_word("p_partkey * 31 % 99991")} || ' ' || {_word("p_partkey * 17 % 9973 + 10000")}
         || ' ' || {_word("p_partkey % 499 + 500")} || ' analysis' AS title,
       'Journal of ' || lower(p_type) || ' studies' AS journal,
       cast(p_partkey % 30 + 1 AS varchar(10)) AS volume,
       cast(p_partkey % 4 + 1 AS varchar(10)) AS issue,
       cast(p_partkey % 90 + 1 AS varchar(10)) || '-' || cast(p_partkey % 90 + 9 AS varchar(10)) AS pages,
       '10.' || cast(1000 + p_partkey % 9000 AS varchar(10)) || '/p.' || cast(p_partkey AS varchar(20)) AS doi,
       lower(p_name) AS name_words
FROM part"""

# Entries as a manuscript would list them; damage: 1 year off, 2 no DOI, 3 a title word lost,
# 4 journal glued to the title by a comma, 5 other author, 6 no DOI and year off, 7 other title.
BIB = f"""
SELECT k AS ref_id, doc_id, pos, year, doi, title, family, true_year, true_title, k % 10 AS damage,
       family || ', A. (' || cast(year AS varchar(10)) || '). ' || title
         || CASE WHEN k % 10 = 4 THEN ', ' ELSE '. ' END || journal || ', ' || volume || '(' || issue || '), ' || pages || '.'
         || CASE WHEN doi = '' THEN '' ELSE ' https://doi.org/' || doi END AS raw
FROM (SELECT k, doc_id, pos, true_year, title AS true_title, journal, volume, issue, pages,
             CASE WHEN k % 10 IN (1, 6) OR (k % 20 = 19) THEN true_year + 1 WHEN k % 20 = 9 THEN cast(1980 + ((k - 1) * 13) % 40 AS int) ELSE true_year END AS year,
             CASE WHEN k % 10 IN (2, 3, 6) THEN '' ELSE doi END AS doi,
             CASE WHEN k % 10 = 3 THEN replace(title, ' analysis', '') WHEN k % 10 = 7 THEN 'Unrelated matters of ' || {_word("k * 3 + 70000")} ELSE title END AS title,
             CASE WHEN k % 10 = 5 THEN 'Other' || lower(family) ELSE family END AS family
      FROM truth) d"""

# Catalog rows per provider slot; slot 6 is a decoy that shares words with the true title.
CATALOG = """
SELECT k * 10 + slot AS work_id, k,
       CASE slot WHEN 0 THEN 'Crossref' WHEN 1 THEN 'DataCite' WHEN 2 THEN 'OpenAlex' WHEN 3 THEN 'Semantic Scholar'
                 WHEN 4 THEN 'CORE' WHEN 5 THEN 'OpenLibrary' ELSE 'Crossref' END AS provider,
       slot AS provider_rank, cast(k % 5 AS int) AS row_rank,
       CASE WHEN slot = 6 THEN replace(title, ' analysis', ' survey overview') ELSE title END AS title,
       family, 'Ann' AS given, CASE WHEN slot = 6 THEN true_year + 2 ELSE true_year END AS year,
       CASE WHEN slot IN (5, 6) THEN '' ELSE doi END AS doi,
       journal AS container_title, volume, issue, pages,
       CASE WHEN slot = 5 THEN 'book' ELSE 'journal-article' END AS type,
       CASE WHEN slot = 5 THEN 'Press' ELSE '' END AS publisher,
       slot IN (4, 5) AS requires_review,
       'https://example.org/work/' || cast(k AS varchar(20)) AS url
FROM truth, (SELECT cast(0 AS int) AS slot UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) s
WHERE (slot = 0 AND k % 4 <> 3) OR (slot = 1 AND k % 8 = 3) OR (slot = 2 AND k % 4 = 3) OR (slot = 3 AND k % 5 = 0)
   OR (slot = 4 AND k % 6 = 0) OR (slot = 5 AND k % 11 = 0) OR (slot = 6 AND k % 9 = 0)"""

# Body paragraphs: one per line item, citing its part; the line number decides the citation form.
MANUSCRIPT = """
SELECT doc_id, idx, 'p' || cast(idx AS varchar(20)) AS paragraph_id, form, family, cited_year, k, protected,
       CASE WHEN form = 0 THEN 'Intro' || cast(idx AS varchar(20)) || ' sets the scene. The effect is stable (' || family || ', ' || cast(cited_year AS varchar(10)) || '). More follows.'
            WHEN form = 1 THEN family || ' (' || cast(cited_year AS varchar(10)) || ') reports result ' || cast(idx AS varchar(20)) || '. Nothing else is cited.'
            WHEN form = 2 THEN 'Two views exist (' || family || ', ' || cast(cited_year AS varchar(10)) || '; Nobody, 1999). They differ.'
            WHEN form = 3 THEN 'Plain paragraph ' || cast(idx AS varchar(20)) || ' without any source (see the 2030 target). It ends here.'
            ELSE 'As noted earlier. Sizes vary. Growth was slow. It was ' || cast(idx AS varchar(20)) || ' percent (' || family || ', ' || cast(cited_year AS varchar(10)) || ', p. 12).' END AS text
FROM (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS int) - 1 AS idx,
             cast(l_linenumber % 5 AS int) AS form, k,
             l_quantity = 13 AS protected,
             CASE WHEN l_suppkey % 17 = 3 THEN family || 'x' WHEN l_suppkey % 17 = 4 THEN 'Missing' || lower(family) ELSE family END AS family,
             CASE WHEN l_suppkey % 13 = 5 THEN year + 3 ELSE year END AS cited_year
      FROM lineitem JOIN (SELECT ref_id AS k, doc_id, family, year FROM bib) b ON l_partkey = k) m"""

# Publications: the documents table; the citation asked of each is a benchmark item.
QUESTIONS = """
SELECT doc_id AS citation_id, doc_id AS pub_id, b.text AS sentence
FROM documents JOIN benchmark b ON doc_id % 40 = b.item_id"""

# Requests: users stand in for providers, an 'error' event for HTTP 429, 'signup' for a server fault.
REQUESTS = """
SELECT event_id AS request_id, ts, 'prov' || cast(user_id % 25 AS varchar(10)) AS provider,
       'https://api.example.org/' || event_type || '/' || cast(cast(floor(value) AS bigint) AS varchar(20)) AS url,
       CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 503 ELSE 200 END AS status,
       CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN cast(30 + event_id % 90 AS varchar(10)) ELSE '' END AS retry_after
FROM events"""

VIEWS = {"truth": TRUTH, "bib": BIB, "works": CATALOG, "manuscript": MANUSCRIPT, "asked": QUESTIONS, "requests": REQUESTS}
NEEDS = {"truth": ("part",), "bib": ("truth",), "works": ("truth",), "manuscript": ("bib", "lineitem"),
         "asked": ("documents", "benchmark"), "requests": ("events",)}


def view(spark, sf_dir: str, name: str):
    """DataFrame of a derived view; its base tables become temp views on the way."""
    for need in NEEDS[name]:
        source = view(spark, sf_dir, need) if need in VIEWS else table(spark, sf_dir, need)
        if need == "part":
            source = dealt(source, "p_partkey")
        source.createOrReplaceTempView(need)
    return spark.sql(VIEWS[name])


def dealt(df, key: str):
    """Rows dealt over the session's shuffle partitions: the texts spelt out from a short file are far more work than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: the needed views as CTEs in front of ``sql``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for need in NEEDS[n]:
            if need in VIEWS:
                visit(need)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order) + " " + sql
