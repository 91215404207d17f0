"""Web pages, provider dumps and positioned lines: ``pages``, ``works`` as JSON, ``documents`` as lines."""
from __future__ import annotations

from pyspark.sql import functions as F

from refaudit.functions import text as T
from refaudit.functions import web as W
from refaudit.operators import webmeta as M
from refaudit.sources import catalog as K
from refaudit.sources import texts as X

from .views import NEEDS, VIEWS, table, view, with_views

# News-like pages of the derived works: JSON-LD on even keys, meta tags on odd ones.
VIEWS["newspages"] = """
SELECT k AS page_id, 'https://news.example.org/a/' || cast(k AS varchar(20)) AS url, title, family, true_year,
  '<html><head><title>T ' || cast(k AS varchar(20)) || '</title><meta name="og:site_name" content="Daily &amp; News">' ||
  CASE WHEN k % 2 = 0 THEN '<script type="application/ld+json">{"@type":"NewsArticle","headline":"' || title || '","author":{"@type":"Person","name":"Ann ' || family || '"},"datePublished":"' || cast(true_year AS varchar(10)) || '-03-05"}</script>'
       ELSE '<meta name="author" content="Ann ' || family || '"><meta property="article:published_time" content="' || cast(true_year AS varchar(10)) || '-03-05">' END ||
  CASE WHEN k % 3 = 0 THEN '<link rel="canonical" href="/a/' || cast(k + 1 AS varchar(20)) || '">' ELSE '' END ||
  '</head><body><nav>Menu</nav><h1>' || CASE WHEN k % 7 = 3 THEN 'Access denied' ELSE title END || '</h1><article><p>' || title || ' is the subject of this article, number ' || cast(k AS varchar(20)) || '.</p><p>Cookie notice: we use cookies here.</p><p>short</p></article></body></html>' AS html
FROM truth"""
NEEDS["newspages"] = ("truth",)
VIEWS["newsrefs"] = """
SELECT k AS ref_id, family || ', A. (' || cast(CASE WHEN k % 5 = 2 THEN true_year + 1 ELSE true_year END AS varchar(10)) || ', March 5). ' || title || '. Daily & News. https://news.example.org/a/' || cast(k AS varchar(20)) AS raw, k, title, family, true_year
FROM truth"""
NEEDS["newsrefs"] = ("truth",)


def _news(spark, sf):
    return view(spark, sf, "newspages").select("page_id", "url", "html")


def _pages(spark, sf):
    return X.read_pages(spark, f"{sf}/pages.parquet")


def page_title(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", W.h1_text(F.col("html")).alias("h1"), W.title_text(F.col("html")).alias("title"))


def plain_text(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(T.plain_text(F.col("html"))).alias("digest"))


def html_text(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(T.html_text(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1))).alias("digest"))


def main_text(spark, sf):
    return _pages(spark, sf).select("page_id", F.length(W.main_text(F.col("html"))).alias("n"))


def page_passages(spark, sf):
    return M.page_passages(_pages(spark, sf)).select("page_id", "idx", "abstract_only", F.length("text").alias("n"))


def news_passages(spark, sf):
    """Short bodies fall back to the abstract, and these pages have none: nothing is left."""
    long = _news(spark, sf).withColumn("html", F.replace("html", F.lit(" is the subject"), F.concat(F.lit(" "), F.repeat(F.lit("x"), 300), F.lit(" is the subject"))))
    return M.page_passages(long).select("page_id", "idx", "text")


def noise_blocks(spark, sf):
    """Blocks that are kept of each page: its paragraphs, one as long as its number tells, and one that opens like page furniture on every fourth page."""
    blocks = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1)
    more = F.array(F.repeat(F.lit("x"), (F.col("page_id") % 50).cast("int")), F.concat(F.when(F.col("page_id") % 4 == 0, "Subscribe").otherwise("Subscribers"), F.lit(" to our daily letter of news")))
    return _news(spark, sf).select("page_id", F.size(W.keep_blocks(F.concat(blocks, more))).alias("n"))


def page_meta(spark, sf):
    return M.page_meta(_news(spark, sf)).select("page_id", "key", "content")


def page_meta_all(spark, sf):
    """Named meta tags of the given pages, which carry a charset only, with their address and title written into the head as such."""
    named = F.concat(F.lit('<head><META  content="'), F.replace("url", F.lit('"'), F.lit("")), F.lit("\" name='X-Address'><meta name=\"empty\" content=\"\"><meta itemprop=pos content="), F.col("page_id"), F.lit(" />"))
    pages = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("<head>"), named))
    return M.page_meta(pages).select("page_id", "pos", "key", "content")


def meta_multimap(spark, sf):
    return M.meta_multimap(M.page_meta(_news(spark, sf))).select("page_id", "key", "first", F.size("contents").alias("n"))


def tag_attrs(spark, sf):
    p = _pages(spark, sf).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a [^>]*>"), 0)).alias("tag"))
    return p.select("page_id", F.element_at(T.tag_attrs(F.col("tag")), "href").alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def jsonld_nodes(spark, sf):
    return M.jsonld_nodes(_news(spark, sf)).select("page_id", "pos", "name", "headline", "published")


def resolve_jsonld_refs(spark, sf):
    """Authors replaced by a reference to a node elsewhere on the page."""
    p = _news(spark, sf).withColumn("html", F.regexp_replace("html", '"author":(\\{[^}]*)\\}', '"about":$1,"@id":"#p"},"author":{"@id":"#p"}'))
    return M.resolve_jsonld_refs(M.jsonld_nodes(p)).where("pos = 0").select("page_id", "name", "organization")


def web_meta(spark, sf):
    m = M.web_meta(_news(spark, sf))
    return m.select("page_id", "state", "title", "title_source", F.array_join(F.transform("authors", lambda a: a["name"]), ";").alias("authors"), "published", "site", "canonical", F.size("conflicts").alias("n_conflicts"))


def web_meta_pages(spark, sf):
    m = M.web_meta(_pages(spark, sf))
    return m.select("page_id", "state", F.size("authors").alias("n_authors"), F.size("conflicts").alias("n_conflicts"))


def date_conflicts(spark, sf):
    c = _news(spark, sf).select("page_id", F.explode(F.array(F.lit("2020-03-05"), F.when(F.col("page_id") % 2 == 0, F.lit("March 2020")).otherwise(F.lit("2020-04-05")))).alias("value"))
    return M.date_conflicts(c)


def longest_article_body(spark, sf):
    p = _news(spark, sf).withColumn("html", F.replace("html", F.lit('"@type":"NewsArticle"'), F.concat(F.lit('"@type":"NewsArticle","articleBody":"short","hasPart":{"articleBody":"longer text '), F.col("page_id"), F.lit('"}'))))
    return M.longest_article_body(M.jsonld_nodes(p))


def compare_web(spark, sf):
    refs = view(spark, sf, "newsrefs").select("ref_id", "raw")
    return M.compare_web(refs, M.web_meta(_news(spark, sf))).select("ref_id", "status", F.size("changes").alias("n_changes"), F.col("corrected").contains("March 5").alias("dated"))


def field_comparison(spark, sf):
    refs = view(spark, sf, "newsrefs").select("ref_id", "raw")
    return M.field_comparison(M.compare_web(refs, M.web_meta(_news(spark, sf)))).select("ref_id", "field", "matches")


def verify_extracted_fields(spark, sf):
    t = view(spark, sf, "newsrefs").select(F.col("ref_id").alias("page_id"), F.concat(F.lit("Written by Ann "), F.col("family"), F.lit(". Published: 5 March "), F.col("true_year"), F.lit(". Copyright 2030.")).alias("text"), "family", "true_year")
    def row(field, value, quote):
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), quote.alias("quote"))
    stated = F.when(F.col("page_id") % 2 == 0, F.col("true_year")).otherwise(2030)
    prop = t.select("page_id", F.inline(F.array(
        row("author", F.concat(F.lit("ANN "), F.col("family")), F.concat(F.lit("by Ann "), F.col("family"))),
        row("published", F.concat(F.col("true_year"), F.lit("-03-05")), F.concat(F.lit("Published: 5 March "), stated)),
        row("site", F.lit("2030"), F.lit("Copyright 2030")))))
    return M.verify_extracted_fields(t.select("page_id", "text"), prop).select("page_id", "field", "accepted")


def same_page(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", W.same_page(F.concat(F.regexp_replace("url", "[?].*$", ""), F.lit("/"), F.regexp_extract("url", "([?].*)$", 1)), F.col("url")).alias("slash"),
                    W.same_page(F.concat("url", F.lit("x")), F.col("url")).alias("other"))


def valid_http_url(spark, sf):
    p = _pages(spark, sf)
    bad = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit("://u:p@"))).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "(example[.][a-z]+)", "$1:8080")).otherwise(F.col("url"))
    return p.select("page_id", W.valid_http_url(F.col("url")).alias("ok"), W.valid_http_url(bad).alias("changed"))


# --- provider dumps: the derived works written in each provider's own shape ----------------

def _dump(name, provider, expr):
    def query(spark, sf):
        w = view(spark, sf, "works")
        out = K.MAPPERS[provider](K.parse_records(w.select(F.to_json(F.expr(expr)).alias("json")), provider))
        a = F.col("author")[0]
        return out.select("title", "year", "doi", "container_title", F.concat_ws("/", a["family"], a["given"], a["literal"]).alias("author"), "requires_review").groupBy("title", "year", "doi", "container_title", "author", "requires_review").agg(F.count("*").alias("n"))
    query.__name__ = name
    return query


DUMPS = {
    "works_from_crossref": ("Crossref", "named_struct('title', array(title), 'author', array(named_struct('family', family, 'given', given)), 'published', named_struct('date-parts', array(array(year, 3))), 'DOI', doi, 'container-title', array(container_title), 'page', pages, 'type', type)", "family || '/' || given", "doi", "container_title"),
    "works_from_datacite": ("DataCite", "named_struct('data', named_struct('attributes', named_struct('titles', array(named_struct('title', title)), 'creators', array(named_struct('name', concat(family, ', ', given))), 'publicationYear', year, 'doi', doi, 'publisher', named_struct('name', container_title))))", "family || '/' || given", "doi", "container_title"),
    "works_from_openalex": ("OpenAlex", "named_struct('title', title, 'authorships', array(named_struct('author', named_struct('display_name', concat(given, ' ', family)))), 'publication_year', year, 'doi', if(doi = '', null, concat('https://doi.org/', doi)), 'primary_location', named_struct('source', named_struct('display_name', container_title)))", "given || ' ' || family", "doi", "container_title"),
    "works_from_arxiv": ("arXiv", "named_struct('title', title, 'published', concat(year, '-01-02T00:00:00Z'), 'id', concat('http://arxiv.org/abs/2301.', lpad(k, 5, '0'), 'v2'), 'author', array(named_struct('name', concat(given, ' ', family))))", "family || '/' || given", "'10.48550/arxiv.2301.' || lpad(cast(k AS varchar), 5, '0')", "''"),
    "works_from_europepmc": ("Europe PMC", "named_struct('title', title, 'pubYear', year, 'doi', doi, 'authorList', named_struct('author', array(named_struct('lastName', family, 'firstName', given))), 'journalInfo', named_struct('journal', named_struct('title', container_title)))", "family || '/' || given", "doi", "container_title"),
    "works_from_pubmed": ("PubMed", "named_struct('uid', cast(work_id as string), 'title', title, 'pubdate', concat(year, ' Jan'), 'authors', array(named_struct('name', family)), 'articleids', array(named_struct('idtype', 'pii', 'value', 'x'), named_struct('idtype', 'doi', 'value', doi)), 'source', container_title)", "family", "doi", "container_title"),
    "works_from_dblp": ("DBLP", "named_struct('info', named_struct('title', title, 'year', year, 'doi', doi, 'venue', container_title, 'authors', named_struct('author', array(named_struct('text', concat(given, ' ', family))))))", "given || ' ' || family", "doi", "container_title"),
    "works_from_eric": ("ERIC", "named_struct('id', work_id, 'title', title, 'author', array(concat(family, ', ', given)), 'publicationdateyear', year, 'source', container_title)", "family || '/' || given", "''", "container_title"),
    "works_from_semanticscholar": ("Semantic Scholar", "named_struct('title', title, 'year', year, 'authors', array(named_struct('name', concat(given, ' ', family))), 'externalIds', named_struct('DOI', doi), 'venue', container_title)", "given || ' ' || family", "doi", "container_title"),
    "works_from_core": ("CORE", "named_struct('id', work_id, 'title', title, 'authors', array(named_struct('name', concat(family, ', ', given))), 'yearPublished', year, 'doi', doi, 'journals', array(named_struct('title', container_title)))", "family || '/' || given", "doi", "container_title"),
    "works_from_trdizin": ("TR Dizin", "named_struct('_source', named_struct('id', work_id, 'publicationYear', year, 'abstracts', array(named_struct('title', title), named_struct('title', '')), 'authors', array(named_struct('order', 2, 'name', 'Z'), named_struct('order', 1, 'name', concat(given, ' ', family))), 'doi', doi, 'journal', named_struct('name', container_title)))", "given || ' ' || family", "doi", "container_title"),
    "works_from_isam": ("İSAM", "named_struct('handle', work_id, 'metadata', map('dc.title', array(named_struct('value', title)), 'dc.contributor.author', array(named_struct('value', concat(family, ', ', given))), 'dc.date.issued', array(named_struct('value', concat(year, '-05'))), 'dc.identifier.doi', array(named_struct('value', if(doi = '', '', concat('https://doi.org/', doi)))), 'dc.relation.journal', array(named_struct('value', container_title))))", "family || '/' || given", "doi", "container_title"),
    "works_from_openlibrary": ("OpenLibrary", "named_struct('key', '/works/1', 'title', title, 'author_name', array(concat(given, ' ', family)), 'first_publish_year', year)", "given || ' ' || family", "''", "''"),
    "works_from_googlebooks": ("Google Books", "named_struct('id', work_id, 'volumeInfo', named_struct('title', title, 'authors', array(concat(given, ' ', family)), 'publishedDate', concat(year, '-01-01')))", "given || ' ' || family", "''", "''"),
}
_REVIEW = ("CORE", "İSAM", "OpenLibrary", "Google Books")


# --- positioned lines: five lines of a document make a page, between a running header and a page number

def _lines(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = rows.select("doc_id", F.expr("cast(pos div 5 + 1 as int)").alias("page"), (F.col("pos") % 5 + 1).alias("line_no"), (F.length("raw") - F.length(F.ltrim("raw"))).alias("indent"), F.trim("raw").alias("text"))
    pages = rows.select("doc_id", "page").distinct()
    head = pages.select("doc_id", "page", F.lit(0).alias("line_no"), F.lit(0).alias("indent"), F.concat(F.lit("Collected texts, volume "), "doc_id").alias("text"))
    foot = pages.select("doc_id", "page", F.lit(6).alias("line_no"), F.lit(0).alias("indent"), F.col("page").cast("string").alias("text"))
    return rows.unionByName(head).unionByName(foot)


def page_furniture(spark, sf):
    return X.page_furniture(_lines(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


def layout_stats(spark, sf):
    return X.layout_stats(_lines(spark, sf))


def previous_line_features(spark, sf):
    return X.previous_line_features(_lines(spark, sf)).groupBy("doc_id").agg(F.count_if("prev_empty").alias("gaps"), F.sum(F.length("prev")).alias("n_prev"))


def lines_to_paragraphs(spark, sf):
    return X.lines_to_paragraphs(_lines(spark, sf)).select("doc_id", "idx", F.md5("text").alias("digest"))


def jats_passages(spark, sf):
    """The documents as article XML: one paragraph per line, references behind."""
    d = table(spark, sf, "documents")
    para = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), T.escape_html(x), F.lit("</p>"))), "")
    xml = F.concat(F.lit("<article><article-title>T <i>"), F.col("doc_id"), F.lit("</i></article-title><body>"), para, F.lit("</body><back><p>Gone</p></back></article>"))
    return X.jats_passages(d.select(F.col("doc_id").alias("pub_id"), xml.alias("xml"))).select("pub_id", "title", "location", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (page_title, plain_text, html_text, main_text, page_passages, news_passages, noise_blocks, page_meta, page_meta_all, meta_multimap, tag_attrs, jsonld_nodes,
                                   resolve_jsonld_refs, web_meta, web_meta_pages, date_conflicts, longest_article_body, compare_web, field_comparison, verify_extracted_fields, same_page, valid_http_url,
                                   page_furniture, layout_stats, previous_line_features, lines_to_paragraphs, jats_passages)}
QUERIES |= {n: _dump(n, p, e) for n, (p, e, *_rest) in DUMPS.items()}


def _n(body: str, *views: str) -> str:
    return with_views(body, *(views or ("newspages",)))


_ENT = "replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&#039;', ''''), '&amp;', '&')"
_LN = """l0 AS (SELECT doc_id, cast(floor((i - 1) / 5) AS int) + 1 AS page, cast((i - 1) % 5 AS int) + 1 AS line_no, length(raw) - length(ltrim(raw, ' ')) AS indent, trim(raw, ' ') AS text
   FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
  ln AS (SELECT * FROM l0 UNION ALL SELECT DISTINCT doc_id, page, 0, 0, 'Collected texts, volume ' || doc_id FROM l0 UNION ALL SELECT DISTINCT doc_id, page, 6, 0, cast(page AS varchar) FROM l0)"""
ORACLES = {
    "page_title": "SELECT page_id, " + _ENT.format(c="trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g'))") + " AS h1, " + _ENT.format(c="trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g'))") + " AS title FROM pages",
    "noise_blocks": _n("SELECT page_id, 1 + CASE WHEN page_id % 50 >= 25 THEN 1 ELSE 0 END + CASE WHEN page_id % 4 <> 0 THEN 1 ELSE 0 END AS n FROM newspages"),
    "news_passages": _n("SELECT page_id, 0 AS idx, title || ' ' || repeat('x', 300) || ' is the subject of this article, number ' || page_id || '.' AS text FROM newspages"),
    "page_meta": _n("""SELECT page_id, 'og:site_name' AS key, 'Daily & News' AS content FROM newspages UNION ALL SELECT page_id, 'author', 'Ann ' || family FROM newspages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'article:published_time', true_year || '-03-05' FROM newspages WHERE page_id % 2 = 1"""),
    "page_meta_all": """SELECT page_id, 0 AS pos, 'x-address' AS key, replace(url, '"', '') AS content FROM pages
        UNION ALL SELECT page_id, 1, 'pos', page_id::VARCHAR FROM pages""",
    "meta_multimap": _n("""SELECT page_id, 'og:site_name' AS key, 'Daily & News' AS first, 1 AS n FROM newspages UNION ALL SELECT page_id, 'author', 'Ann ' || family, 1 FROM newspages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'article:published_time', true_year || '-03-05', 1 FROM newspages WHERE page_id % 2 = 1"""),
    "tag_attrs": "SELECT page_id, " + _ENT.format(c="regexp_extract(t, 'href=\"([^\"]*)\"', 1)") + " AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>')) AS t FROM pages) GROUP BY 1, 2",
    "jsonld_nodes": _n("SELECT page_id, 0 AS pos, NULL AS name, title AS headline, true_year || '-03-05' AS published FROM newspages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 1, 'Ann ' || family, NULL, NULL FROM newspages WHERE page_id % 2 = 0"),
    "resolve_jsonld_refs": _n("SELECT page_id, 'Ann ' || family AS name, false AS organization FROM newspages WHERE page_id % 2 = 0"),
    "web_meta": _n("""SELECT page_id, CASE WHEN h = 'Access denied' AND NOT art THEN 'blocked' ELSE 'ok' END AS state, CASE WHEN art THEN title ELSE h END AS title, CASE WHEN art THEN 'JSON-LD headline' ELSE 'Görünen H1' END AS title_source,
        CASE WHEN art OR page_id % 2 = 1 THEN 'Ann ' || family ELSE '' END AS authors, CASE WHEN art OR page_id % 2 = 1 THEN true_year || '-03-05' ELSE '' END AS published, 'Daily & News' AS site,
        CASE WHEN page_id % 3 = 0 THEN 'https://news.example.org/a/' || (page_id + 1) ELSE '' END AS canonical, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS n_conflicts
        FROM (SELECT *, CASE WHEN page_id % 7 = 3 THEN 'Access denied' ELSE title END AS h, page_id % 2 = 0 AND page_id % 7 <> 3 AS art FROM newspages)"""),
    "date_conflicts": _n("SELECT page_id, page_id % 2 = 1 AS conflict FROM newspages"),
    "longest_article_body": _n("SELECT page_id, 'longer text ' || page_id AS body FROM newspages WHERE page_id % 2 = 0"),
    "compare_web": _n("""SELECT ref_id, CASE WHEN k % 7 = 3 THEN 'error' WHEN y AND k % 3 <> 0 THEN 'verified' ELSE 'review' END AS status, CASE WHEN k % 7 = 3 THEN 0 WHEN y THEN 0 ELSE 1 END AS n_changes, true AS dated
        FROM (SELECT *, k % 5 <> 2 AS y FROM newsrefs)""", "newspages", "newsrefs"),
    "field_comparison": _n("""SELECT ref_id, f AS field, CASE WHEN f = 'Yayın tarihi' THEN k % 5 <> 2 ELSE true END AS matches FROM newsrefs, (SELECT unnest(['Başlık', 'Yazar', 'Yayın tarihi']) AS f) WHERE k % 7 <> 3""", "newspages", "newsrefs"),
    "verify_extracted_fields": _n("""SELECT ref_id AS page_id, f AS field, CASE f WHEN 'published' THEN ref_id % 2 = 0 ELSE true END AS accepted FROM newsrefs, (SELECT unnest(['author', 'published', 'site']) AS f)""", "newsrefs"),
    "same_page": "SELECT page_id, NOT ends_with(url, '/') AS slash, contains(url, '#') AS other FROM pages",
    "valid_http_url": "SELECT page_id, true AS ok, page_id % 3 = 2 AS changed FROM pages",
    "page_furniture": "WITH " + _LN + """, e AS (SELECT *, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS z FROM ln WHERE text <> '') WHERE a <= 2 OR z <= 2),
        r AS (SELECT e.doc_id, key FROM e JOIN (SELECT doc_id, count(DISTINCT page) AS np FROM ln GROUP BY 1) p ON p.doc_id = e.doc_id GROUP BY e.doc_id, key, np HAVING np >= 2 AND count(DISTINCT page) >= greatest(2, np * 0.3)),
        m AS (SELECT DISTINCT e.doc_id, e.page, e.text FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.key = e.key WHERE r.key IS NOT NULL OR regexp_full_match(lower(e.text), '(?:sayfa|page|s\\.)?\\s*[0-9]{1,4}(?:\\s*(?:/|of|-|–)\\s*[0-9]{1,4})?'))
        SELECT ln.doc_id, count(*) AS n FROM ln JOIN m USING (doc_id, page, text) GROUP BY 1""",
    "layout_stats": "WITH " + _LN + """, g AS (SELECT doc_id, indent, length(text) AS n FROM ln WHERE length(text) > 25), f AS (SELECT doc_id, list_sort(list(n)) AS l FROM g GROUP BY 1),
        b AS (SELECT doc_id, arg_min(indent, (-c, indent)) AS base FROM (SELECT doc_id, indent, count(*) AS c FROM g GROUP BY 1, 2) GROUP BY 1)
        SELECT f.doc_id, l[cast(floor(len(l) * 0.75) AS int) + 1] AS "full", base FROM f JOIN b USING (doc_id)""",
    "previous_line_features": "WITH " + _LN + """ SELECT doc_id, count(CASE WHEN pe THEN 1 END) AS gaps, sum(length(prev)) AS n_prev FROM (SELECT doc_id, coalesce(lag(text) OVER w = '', false) AS pe,
        coalesce(last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no)) GROUP BY 1""",
    "jats_passages": "SELECT doc_id AS pub_id, 'T ' || doc_id AS title, 'Paragraf ' || i AS location, md5(l) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)",
}
ORACLES |= {n: with_views(f"SELECT title, year, {doi} AS doi, {cont} AS container_title, {author} AS author, {str(p in _REVIEW).lower()} AS requires_review, count(*) AS n FROM works GROUP BY ALL", "works") for n, (p, _e, author, doi, cont) in DUMPS.items()}
