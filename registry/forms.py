"""Column expressions, formatting and decisions over the given and derived tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from refaudit.functions import apa as A
from refaudit.functions import dates as D
from refaudit.functions import reference as R
from refaudit.functions import retrieval as V
from refaudit.functions import text as T
from refaudit.functions import web as W
from refaudit.operators import edits as E
from refaudit.operators import reports as P
from refaudit.sources import sinks as S
from refaudit.sources import texts as X

from .linkage import catalog
from .views import table, view, with_views


def docs(spark, sf):
    return table(spark, sf, "documents")


def bib(spark, sf):
    return view(spark, sf, "bib")


def _doc(name, expr):
    def query(spark, sf):
        return docs(spark, sf).select("doc_id", expr(F.col("text")).alias("v"))
    query.__name__ = name
    return query


def _bib(name, expr):
    def query(spark, sf):
        return bib(spark, sf).select("ref_id", *expr())
    query.__name__ = name
    return query


C, L = F.col, F.lit
normalize_title = _doc("normalize_title", lambda c: F.md5(T.normalize_title(c)))
web_norm = _doc("web_norm", lambda c: F.md5(T.web_norm(c)))
clean_ws = _doc("clean_ws", lambda c: F.md5(T.clean_ws(c)))
evidence_key = _doc("evidence_key", lambda c: F.md5(T.evidence_key(c)))
escape_html = _doc("escape_html", lambda c: F.md5(T.escape_html(c)))
is_turkish = _doc("is_turkish", R.is_turkish)
decode_html_bytes = _doc("decode_html_bytes", lambda c: F.md5(T.decode_html_bytes(F.encode(c, "UTF-8"), L("text/html; charset=utf-8"))))


def preprint_notice(spark, sf):
    """By document: no notice, one in the fourth passage, one that ends in an exclamation over two passages, one in capitals without an end."""
    n, c = C("doc_id"), F.concat(L("Doc "), C("doc_id"), L(". "), C("text"))
    told = (F.when(n % 4 == 0, F.array(c, L("This is a peer reviewed article."))).when(n % 4 == 1, F.array(c, L("a"), L("b"), L("This is a non-peer reviewed preprint.")))
            .when(n % 4 == 2, F.array(L("Note. This is an non-peer"), F.concat(L("reviewed  preprint number "), n, L("! More.")), c)).otherwise(F.array(F.concat(L("THIS IS A NON-PEER REVIEWED PREPRINT no "), n))))
    return docs(spark, sf).select("doc_id", V.preprint_notice(told).alias("v"))


get_doi = _bib("get_doi", lambda: [R.get_doi(F.concat(C("raw"), L(").,"))).alias("v")])
get_arxiv = _bib("get_arxiv", lambda: [R.get_arxiv(F.concat(C("raw"), L(" arXiv: 2301."), F.lpad(C("ref_id").cast("string"), 5, "0"), L("v3"))).alias("v")])
clean_name = _bib("clean_name", lambda: [T.clean_name(F.concat(C("family"), L(" et al.’s, "))).alias("v")])
name_key = _bib("name_key", lambda: [T.name_key(F.concat(L("Şç"), C("family"), L(" ve ark."))).alias("v")])
year_key = _bib("year_key", lambda: [T.year_key(F.when(C("pos") % 3 == 0, L("T. y.")).otherwise(F.concat(C("year").cast("string"), L("A")))).alias("v")])
cited_authors = _bib("cited_authors", lambda: [F.array_join(F.transform(R.cited_authors(C("raw")), lambda a: F.concat(a["family"], L("/"), a["given"])), ";").alias("v")])
citation_authors = _bib("citation_authors", lambda: [F.array_join(R.citation_authors(F.concat(C("family"), L(", Ak ve Öz & "), C("family"))), "|").alias("v")])
aliases = _bib("aliases", lambda: [F.array_join(R.aliases(F.concat(C("family"), L(" Institute (ABC)"))), "|").alias("v")])
publication_keys = _bib("publication_keys", lambda: [F.array_join(R.publication_keys(F.concat(C("raw"), L(" http://www.Example.org/p/"), C("ref_id"), L("/?x=1"))), "|").alias("v")])
item_year = _bib("item_year", lambda: [T.item_year(F.concat(L("Jan "), C("year"), L("-04"))).alias("v")])
tidy_text = _bib("tidy_text", lambda: [T.tidy_text(F.concat(L("( "), C("family"), L(", 202 5) feed -forward (2026 b)"))).alias("v")])
reference_title = _bib("reference_title", lambda: [R.reference_title(F.concat(C("title"), L(".  https://example.org/x y"))).alias("v")])
person_apa = _bib("person_apa", lambda: [A.person_apa(F.concat(L("Ann  Bea "), C("family"))).alias("v")])
normalize_authors = _bib("normalize_authors", lambda: [F.to_json(R.normalize_authors(F.array(F.concat(C("family"), L(", Ann, B.")), C("family")))).alias("v")])
scholar_query_url = _bib("scholar_query_url", lambda: [R.scholar_query_url(C("raw")).alias("v")])
parse_model_json = _bib("parse_model_json", lambda: [V.parse_model_json(F.concat(L('```json\n{"verdict":"'), C("family"), L('"}\n```')), "verdict string")["verdict"].alias("v")])
sentence_case = _bib("sentence_case", lambda: [A.sentence_case(F.concat(F.initcap("title"), L(": "), C("family"), L(" And AI"))).alias("v")])
title_case = _bib("title_case", lambda: [A.title_case(F.concat(F.lower("title"), L(" of the "), F.lower("family"))).alias("v")])


def parse_reference(spark, sf):
    return bib(spark, sf).select("ref_id", F.inline(F.array(R.parse_reference(C("raw")))).alias("year", "doi", "title", "first_author", "arxiv"))


def reference_identity(spark, sf):
    return bib(spark, sf).select("ref_id", F.inline(F.array(R.reference_identity(C("raw")))).alias("authors", "author", "year_key", "title")).drop("authors")


def split_references(spark, sf):
    """Each document's entries as one pasted text, numbered, every entry wrapped in two lines."""
    b = bib(spark, sf)
    line = F.concat(L("["), C("pos") + 1, L("] "), F.substring_index("raw", " ", 3), L("\n"), F.expr("substring(raw, length(substring_index(raw, ' ', 3)) + 2)"))
    text = b.select("doc_id", "pos", line.alias("l")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]), "\n").alias("text"))
    return X.split_references(text)


def split_sentences(spark, sf):
    return view(spark, sf, "manuscript").select("doc_id", "idx", F.size(T.split_sentences(C("text"))).alias("n"))


def date_parts(spark, sf):
    """Ship dates in four notations, every fifth one inside a copyright line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("l_shipdate").cast("date").alias("d"))
    f = C("l_linenumber") % 4
    text = (F.when(f == 0, C("d").cast("string")).when(f == 1, F.date_format("d", "dd.MM.yyyy")).when(f == 2, F.date_format("d", "MMMM d, yyyy")).otherwise(F.date_format("d", "MMM yyyy")))
    text = F.when(C("l_suppkey") % 5 == 0, F.concat(L("© "), text)).otherwise(text)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", D.date_parts(text).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.year", "p.month", "p.day").groupBy("l_linenumber", "year", "month", "day").agg(F.count("*").alias("n"))


def bibliography_authors(spark, sf):
    """Author lists of 1 to 24 names."""
    b = bib(spark, sf)
    names = F.transform(F.sequence(L(1), (C("ref_id") % 24 + 1).cast("int")), lambda i: F.struct(F.concat(L("N"), i).alias("family"), L("Jane Bo").alias("given"), L(None).cast("string").alias("literal")))
    return b.select("ref_id", A.bibliography_authors(names).alias("v"))


def _works(spark, sf):
    c = catalog(spark, sf)
    return c.select("work_id", F.struct(*[C(k) for k in ("title", "author", "year", "doi", "container_title", "volume", "issue", "pages", "type", "publisher", "language", "editor")]).alias("w"))


def format_apa(spark, sf):
    return _works(spark, sf).select("work_id", A.format_apa(C("w")).alias("text"), A.format_apa_html(C("w")).alias("html"))


def format_crossref_apa(spark, sf):
    return _works(spark, sf).select("work_id", A.format_crossref_apa(C("w")).alias("v"))


def italic_spans(spark, sf):
    w = _works(spark, sf).select("work_id", A.format_apa_html(C("w")).alias("h"), A.format_apa(C("w")).alias("t"))
    return w.select("work_id", F.array_join(F.transform(A.italic_spans(C("h"), C("t")), lambda s: F.when(s["italic"], s["text"])), "|").alias("v"))


def web_citation(spark, sf):
    b = bib(spark, sf)
    page = F.struct(C("title").alias("title"), F.array(F.struct(F.concat(L("Ann "), C("family")).alias("name"), L("Person").alias("type"))).alias("authors"),
                    F.concat(C("year"), L("-03-05")).alias("published"), L("").alias("modified"), L("Site").alias("site"), L("https://e.org/x").alias("url"))
    return b.select("ref_id", A.web_citation(page)["html"].alias("v"))


def restore_year_suffix(spark, sf):
    b = bib(spark, sf)
    return b.select("ref_id", A.restore_year_suffix(C("raw"), C("year"), F.when(C("pos") % 2 == 0, "b").otherwise("")).alias("v"))


def parse_web_reference(spark, sf):
    b = bib(spark, sf)
    raw = F.concat(C("family"), L(". ("), C("year"), L(", May 4). "), C("title"), L(". https://example.org/a_(b)/"), C("ref_id"), L(")."))
    p = b.select("ref_id", W.parse_web_reference(raw).alias("p"))
    return p.select("ref_id", "p.url", "p.author", "p.title", "p.date.year", "p.date.month", "p.date.day")


def _results(spark, sf):
    """Verification-like results spelt out from keys."""
    b = bib(spark, sf)
    st = F.when(C("damage") == 7, "failed").when(C("damage").isin(1, 5), "review").otherwise("verified")
    return b.select("ref_id", "doc_id", "pos", "raw", st.alias("status"), F.when(st != "failed", F.concat(L("S: "), C("title"))).alias("suggested"), F.when(st != "failed", F.concat(L("S: <em>"), C("title"), L("</em>"))).alias("suggested_html"),
                    F.when(st == "verified", F.concat(L("S: "), C("title"))).otherwise(C("raw")).alias("corrected"), F.when(st == "verified", F.concat(L("S: <em>"), C("title"), L("</em>"))).alias("corrected_html"),
                    (C("damage") == 7).alias("fallback_needed"), F.when(C("ref_id") % 30 == 7, F.lit("2024-01-01").cast("timestamp")).alias("pending_retry_at"))


def choose_output(spark, sf):
    r = _results(spark, sf)
    picks = r.where(C("ref_id") % 3 == 0).select("ref_id", F.when(C("ref_id") % 2 == 0, F.concat(L(" Mine  "), C("ref_id"))).alias("draft"))
    return E.choose_output(r, picks).select("ref_id", "output", C("output_html").contains("<em>").alias("italic"))


def custom_reference(spark, sf):
    r = _results(spark, sf)
    return E.custom_reference(r, r.where(C("status") != "failed").select("ref_id", F.concat(L("New "), C("suggested"), L(" &")).alias("draft")))


def render_bibliography(spark, sf):
    r = E.choose_output(_results(spark, sf), bib(spark, sf).where("false").select("ref_id", L("").alias("draft")))
    return S.render_bibliography(r).select("doc_id", F.md5("text").alias("digest"), F.length("html").alias("n_html"))


def changed_only(spark, sf):
    r = _results(spark, sf).select("ref_id", "status", "corrected")
    stored = S.with_signature(r, ["ref_id"]).where("ref_id % 4 <> 0")
    new = r.withColumn("status", F.when(C("ref_id") % 5 == 0, "changed").otherwise(C("status")))
    return S.changed_only(new, stored, ["ref_id"]).select("ref_id", "status")


def write_results(spark, sf):
    """Written per document bucket and read back."""
    import uuid
    from refaudit.session import checkpoint_dir
    path = f"{checkpoint_dir(spark)}/refaudit-out/{uuid.uuid4().hex}"
    S.write_results(_results(spark, sf), path, buckets=8)
    return spark.read.parquet(path).select("ref_id", "status", "corrected")


def document_index(spark, sf):
    d = docs(spark, sf)
    return S.document_index(d.select("doc_id", C("source").alias("name"), (C("n_chars") % 100).alias("updated_at")))


def filter_by_status(spark, sf):
    return P.filter_by_status(_results(spark, sf), "review").select("ref_id")


def reference_progress(spark, sf):
    return P.reference_progress(_results(spark, sf))


def problem_records(spark, sf):
    r = _results(spark, sf).withColumn("warnings", F.array().cast("array<string>")).withColumn("sources_checked", F.array(L("Crossref"))).withColumn("provider", L("x")).withColumn("status_text", C("status")).withColumn("pending_providers", L(None))
    return P.problem_records(r).select("ref_id", "status", "reference")


def dice_similarity(spark, sf):
    r = _results(spark, sf)
    return E.dice_similarity(r, "ref_id", "raw", "suggested")


def derived_status(spark, sf):
    r = _results(spark, sf).join(dice_similarity(spark, sf), "ref_id")
    return r.select("ref_id", P.derived_status(C("status"), C("ref_id") % 9 == 0, L(False), C("similarity")).alias("derived"))


def _gate(spark, sf):
    r = _results(spark, sf)
    refs = r.select("doc_id", F.concat(L("r"), C("pos")).alias("ref_id"), "raw", "status", (C("pos") == 3).alias("accepted"), (C("pos") == 4).alias("confirmed"))
    refs = refs.withColumn("raw", F.when(C("ref_id") == "r5", F.concat(L("A. (2000). T. https://example.org/"), C("doc_id"))).otherwise(F.regexp_replace("raw", "https://doi.org/", "doi:")))
    li = view(spark, sf, "manuscript").select("doc_id", F.concat(L("c"), C("idx")).alias("citation_id"), F.concat(L("r"), C("k") % 20).alias("reference"), F.when(C("form") == 2, "Yıl uyuşmazlığı").when(C("form") == 3, "Korunan alan; x").alias("issue"))
    return li, refs


def ready_for_evidence(spark, sf):
    return P.ready_for_evidence(*_gate(spark, sf)).select("doc_id", "citation_id")


def needs_verification(spark, sf):
    return P.needs_verification(*_gate(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


def invalidate(spark, sf):
    cites, refs = _gate(spark, sf)
    ev = cites.select("doc_id", "citation_id")
    return E.invalidate(ev, cites, refs.where("status = 'failed'")).groupBy("doc_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    normalize_title, web_norm, clean_ws, evidence_key, escape_html, is_turkish, decode_html_bytes, preprint_notice, get_doi, get_arxiv, clean_name, name_key, year_key, cited_authors,
    citation_authors, aliases, publication_keys, item_year, tidy_text, reference_title, person_apa, normalize_authors, scholar_query_url, parse_model_json, sentence_case, title_case, parse_reference,
    reference_identity, split_references, split_sentences, date_parts, bibliography_authors, format_apa, format_crossref_apa, italic_spans, web_citation, restore_year_suffix, parse_web_reference,
    choose_output, custom_reference, render_bibliography, changed_only, write_results, document_index, filter_by_status, reference_progress, problem_records, dice_similarity, derived_status,
    ready_for_evidence, needs_verification, invalidate)}

_NORM = "trim(regexp_replace(replace(lower(strip_accents(text)), 'ı', 'i'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_WS = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}\\x0b]+"


def _b(expr: str) -> str:
    return with_views(f"SELECT ref_id, {expr} AS v FROM bib", "bib")


def _d(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS v FROM documents"


_TR = "['bir','bu','ve','ile','için','olarak','çalışma','göre','bulgular','sonuçlar','araştırma']"
_EN = "['the','a','and','of','in','to','for','is','this','with','study','according']"
_RES = """res AS (SELECT *, CASE WHEN damage = 7 THEN 'failed' WHEN damage IN (1, 5) THEN 'review' ELSE 'verified' END AS status, 'S: ' || title AS s FROM bib),
out AS (SELECT *, CASE WHEN status = 'verified' THEN s ELSE raw END AS corrected FROM res)"""
_JOURNAL = "' ' || container_title || ', ' || volume || '(' || issue || '), ' || pages || '.'"
_T1 = "upper(substr(title, 1, 1)) || lower(substr(title, 2))"


def _r(body: str, *views: str) -> str:
    return with_views("", *(views or ("bib",))).rstrip() + ", " + _RES + " " + body


def _gated(body: str) -> str:
    return _r(body, "bib", "manuscript")


# The glued journal of damage 4 stays in the parsed title.
_PARSED = "CASE WHEN damage = 4 THEN rtrim(replace(substr(raw, length(family) + 14), ' https://doi.org/' || doi, ''), '.') ELSE title END"
_SMALL = "['a','an','and','as','at','but','by','for','from','in','of','on','or','the','to','with']"
_TITLE = f"array_to_string(list_transform(string_split(title, ' '), lambda w, i: CASE WHEN i > 1 AND list_contains({_SMALL}, lower(w)) THEN lower(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
ORACLES = {
    "normalize_title": _d(f"md5({_NORM})"), "web_norm": _d(f"md5({_NORM})"),
    "clean_ws": _d(f"md5(trim(regexp_replace(text, '{_WS}', ' ', 'g')))"),
    "escape_html": _d(f"md5({_ESC.format(c='text')})"),
    "is_turkish": """SELECT doc_id, tr > en OR (tr = en AND regexp_matches(text, '[çğıöşüÇĞÖŞÜ]')) AS v FROM (SELECT doc_id, text, len(list_filter(w, lambda x: list_contains(""" + _TR + """, x))) AS tr, len(list_filter(w, lambda x: list_contains(""" + _EN + """, x))) AS en
        FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents))""",
    "decode_html_bytes": _d("md5(text)"),
    "preprint_notice": _d("""CASE doc_id % 4 WHEN 2 THEN 'This is an non-peer reviewed preprint number ' || doc_id || '!' WHEN 3 THEN 'THIS IS A NON-PEER REVIEWED PREPRINT no ' || doc_id ELSE '' END"""),
    "get_doi": _b("doi"), "get_arxiv": _b("'2301.' || lpad(cast(ref_id AS varchar), 5, '0')"), "clean_name": _b("family"), "name_key": _b("'sc' || lower(family)"),
    "year_key": _b("CASE WHEN pos % 3 = 0 THEN 'n.d.' ELSE year || 'a' END"), "cited_authors": _b("family || '/A'"),
    "citation_authors": _b("lower(family) || '|ak|oz|' || lower(family)"), "aliases": _b("family || ' Institute (ABC)|ABC|' || family || ' Institute'"),
    "publication_keys": _b("CASE WHEN doi <> '' THEN 'doi:' || doi || '|' ELSE '' END || 'url:example.org/p/' || ref_id"), "item_year": _b("year"),
    "tidy_text": _b("'(' || family || ', 2025) feed-forward (2026b)'"), "reference_title": _b("title"), "person_apa": _b("family || ', A. B.'"),
    "normalize_authors": _b("""'[{"family":"' || family || '","given":"Ann, B."},{"literal":"' || family || '"}]'"""),
    "scholar_query_url": _b(f"""'https://scholar.google.com/scholar?hl=tr&q=' || replace(replace(url_encode({_PARSED} || ' ' || family || ' ' || year), '%28', '('), '%29', ')')"""),
    "parse_model_json": _b("family"),
    "sentence_case": _b("replace(upper(substr(title, 1, 1)) || lower(substr(title, 2)), ' doi ', ' Doi ') || ': ' || family || ' and AI'"),
    "title_case": _b(f"{_TITLE} || ' of the ' || family"),
    "parse_reference": with_views(f"SELECT ref_id, year, doi, {_PARSED} AS title, family AS first_author, '' AS arxiv FROM bib", "bib"),
    "reference_identity": with_views(f"SELECT ref_id, family AS author, cast(year AS varchar) AS year_key, {_PARSED} AS title FROM bib", "bib"),
    "split_references": with_views("SELECT doc_id, pos, raw FROM bib", "bib"),
    "split_sentences": with_views("SELECT doc_id, idx, CASE form WHEN 0 THEN 3 WHEN 4 THEN 4 ELSE 2 END AS n FROM manuscript", "manuscript"),
    "date_parts": """SELECT l_linenumber, CASE WHEN l_suppkey % 5 <> 0 THEN year(l_shipdate) END AS year, CASE WHEN l_suppkey % 5 <> 0 THEN month(l_shipdate) END AS month,
        CASE WHEN l_suppkey % 5 <> 0 AND l_linenumber % 4 <> 3 THEN day(l_shipdate) END AS day, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""",
    "bibliography_authors": _b("""CASE WHEN ref_id % 24 + 1 > 20 THEN (SELECT string_agg('N' || i || ', J. B.', ', ' ORDER BY i) FROM range(1, 20) t(i)) || ', . . . N' || (ref_id % 24 + 1) || ', J. B.'
        WHEN ref_id % 24 = 0 THEN 'N1, J. B.' ELSE array_to_string(list_transform(range(1, ref_id % 24 + 1), lambda i: 'N' || i || ', J. B.'), ', ') || ', & N' || (ref_id % 24 + 1) || ', J. B.' END"""),
    "format_apa": with_views(f"""SELECT work_id, family || ', A. (' || year || '). ' || {_T1} || '.' || CASE WHEN type = 'book' THEN ' Press.' ELSE {_JOURNAL} END || CASE WHEN doi <> '' THEN ' https://doi.org/' || doi ELSE '' END AS text,
        family || ', A. (' || year || '). ' || CASE WHEN type = 'book' THEN '<em>' || {_T1} || '</em>. Press.' ELSE {_T1} || '. <em>' || container_title || '</em>, <em>' || volume || '</em>(' || issue || '), ' || pages || '.' END
        || CASE WHEN doi <> '' THEN ' https://doi.org/' || doi ELSE '' END AS html FROM works""", "works"),
    "format_crossref_apa": with_views(f"""SELECT work_id, family || ', A. (' || year || '). ' || {_TITLE} || '. ' || CASE WHEN publisher <> '' THEN publisher ELSE container_title END || '.'
        || CASE WHEN doi <> '' THEN ' https://doi.org/' || doi ELSE '' END AS v FROM works""", "works"),
    "italic_spans": with_views(f"SELECT work_id, CASE WHEN type = 'book' THEN {_T1} ELSE container_title || '|' || volume END AS v FROM works", "works"),
    "web_citation": _b("family || ', A. (' || year || ', March 5). <em>' || title || '</em>. Site. https://e.org/x'"),
    "restore_year_suffix": _b("CASE WHEN pos % 2 = 0 THEN replace(raw, '(' || year || ')', '(' || year || 'b)') ELSE raw END"),
    "parse_web_reference": with_views("SELECT ref_id, 'https://example.org/a_(b)/' || ref_id AS url, family AS author, title, year, 5 AS month, 4 AS day FROM bib", "bib"),
    "choose_output": _r("SELECT ref_id, CASE WHEN p AND status = 'review' THEN CASE WHEN ref_id % 2 = 0 THEN 'Mine ' || ref_id ELSE s END ELSE corrected END AS output, (status = 'verified') OR (p AND status = 'review' AND ref_id % 2 = 1) AS italic FROM (SELECT *, ref_id % 3 = 0 AS p FROM out)"),
    "custom_reference": _r("SELECT ref_id, 'New ' || s || ' &' AS suggested, 'New S: <em>' || title || '</em> &amp;' AS suggested_html FROM out WHERE status <> 'failed'"),
    "render_bibliography": _r("SELECT doc_id, md5(string_agg(corrected, chr(10) || chr(10) ORDER BY pos)) AS digest, sum(length(corrected) + 30 + CASE WHEN status = 'verified' THEN 9 ELSE 0 END) AS n_html FROM out GROUP BY 1"),
    "changed_only": _r("SELECT ref_id, CASE WHEN ref_id % 5 = 0 THEN 'changed' ELSE status END AS status FROM out WHERE ref_id % 4 = 0 OR ref_id % 5 = 0"),
    "write_results": _r("SELECT ref_id, status, corrected FROM out"),
    "document_index": "SELECT doc_id, source AS name, n_chars % 100 AS updated_at FROM documents",
    "filter_by_status": _r("SELECT ref_id FROM out WHERE status = 'review'"),
    "reference_progress": _r("SELECT doc_id, count(*) AS total, count(*) AS queried, count(CASE WHEN NOT w THEN 1 END) AS completed, count(CASE WHEN w THEN 1 END) AS pending, 100 AS percent FROM (SELECT *, status = 'failed' OR ref_id % 30 = 7 AS w FROM out) GROUP BY 1"),
    "problem_records": _r("SELECT ref_id, status, substr(raw, 1, 800) AS reference FROM out WHERE status = 'failed' OR ref_id % 30 = 7"),
    "dice_similarity": _r("""SELECT o.ref_id, CASE WHEN o.status = 'failed' THEN NULL ELSE least(99, cast(floor(200.0 * coalesce(x.ov, 0) / greatest(1, length(o.raw) + length(o.s) - 2) + 0.5) AS int)) END AS similarity FROM out o LEFT JOIN (
        SELECT ref_id, sum(least(na, nb)) AS ov FROM (SELECT ref_id, g, sum(na) AS na, sum(nb) AS nb FROM (SELECT ref_id, substr(raw, i, 2) AS g, 1 AS na, 0 AS nb FROM (SELECT ref_id, raw, unnest(range(1, length(raw))) AS i FROM out)
        UNION ALL SELECT ref_id, substr(s, i, 2), 0, 1 FROM (SELECT ref_id, s, unnest(range(1, length(s))) AS i FROM out WHERE status <> 'failed')) GROUP BY 1, 2) GROUP BY 1) x ON x.ref_id = o.ref_id"""),
    "derived_status": _r("SELECT ref_id, CASE WHEN ref_id % 9 = 0 THEN 'verified' WHEN status = 'verified' THEN 'correction' ELSE status END AS derived FROM out"),
    "ready_for_evidence": _gated("SELECT m.doc_id, 'c' || m.idx AS citation_id FROM manuscript m JOIN out o ON o.doc_id = m.doc_id AND o.pos = m.k % 20 WHERE m.form <> 2 AND (o.status = 'verified' OR o.pos IN (3, 4, 5))"),
    "needs_verification": _gated("SELECT m.doc_id, count(*) AS n FROM manuscript m JOIN out o ON o.doc_id = m.doc_id AND o.pos = m.k % 20 WHERE o.status <> 'verified' AND o.pos NOT IN (3, 4, 5) GROUP BY 1"),
    "invalidate": _gated("SELECT m.doc_id, count(*) AS n FROM manuscript m JOIN out o ON o.doc_id = m.doc_id AND o.pos = m.k % 20 WHERE o.status <> 'failed' GROUP BY 1"),
}
