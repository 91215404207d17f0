"""Passage retrieval and evidence over ``documents`` (publications) and ``benchmark`` (citation sentences)."""
from __future__ import annotations

from pyspark.sql import functions as F

from refaudit.functions import retrieval as RT
from refaudit.functions.labels import REJECTED_SUFFIX, VERDICT_EXPLANATION
from refaudit.functions.retrieval import EN_WORDS, STOP_WORDS, TR_WORDS
from refaudit.operators import evidence as E
from refaudit.operators import reports as R
from refaudit.plans import evidence as P
from refaudit.session import stage_table

from .views import NEEDS, VIEWS, table, view, with_views

VIEWS["claimed"] = """
SELECT doc_id, doc_id AS pub_id, doc_id AS citation_id, cast(n AS int) AS batch, 'claim ' || cast(n AS varchar(5)) AS claim,
       CASE (doc_id + n) % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'supported' WHEN 2 THEN 'partial' WHEN 3 THEN 'contradicted' ELSE 'not_found' END AS verdict,
       'P1' AS passage_id,
       CASE WHEN (doc_id + n) % 7 = 3 THEN substr(text, 11, 40) || '#altered' WHEN (doc_id + n) % 7 = 4 THEN substr(text, 1, 251) ELSE substr(text, 11, 80) END AS quote, text
FROM documents, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) c"""
NEEDS["claimed"] = ("documents",)


def publications(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("pub_id"), F.array(F.struct(F.lit("Text").alias("location"), F.col("text").alias("text"))).alias("passages"))


def citations(spark, sf):
    return view(spark, sf, "asked").select("citation_id", "pub_id", "sentence", F.array(F.col("sentence")).alias("context"))


def claims(spark, sf):
    return view(spark, sf, "claimed").drop("text")


def strip_bibliography(spark, sf):
    """Every text followed by a references page and an appendix page; only the references go."""
    d = table(spark, sf, "documents")
    page = lambda loc, t: F.struct(F.lit(loc).alias("location"), t.alias("text"))
    passages = F.array(page("A", F.col("text")), page("B", F.concat(F.lit("2. References\n"), F.col("text"))), page("C", F.concat(F.lit("more\nAPPENDIX\nkept "), F.col("doc_id"))))
    out = d.select("doc_id", F.inline(E.strip_bibliography(passages)).alias("location", "text"))
    return out.select("doc_id", "location", F.md5("text").alias("digest"))


def chunk_passages(spark, sf):
    return E.chunk_passages(publications(spark, sf)).select("pub_id", "idx", "passage_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def retrieval_terms(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(RT.retrieval_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def query_weights(spark, sf):
    return E.query_weights(citations(spark, sf))


def term_statistics(spark, sf):
    weights = E.query_weights(citations(spark, sf))
    stats, postings = E.term_statistics(E.passage_terms(publications(spark, sf), weights), weights)
    return postings.select("pub_id", "term", "df").distinct().join(stats, "pub_id").select("pub_id", "term", "df", "n", F.round("average", 6).alias("average"))


def bm25(spark, sf):
    out = E.bm25(publications(spark, sf), E.query_weights(citations(spark, sf)))
    return out.select("citation_id", "idx", "n_chars", F.round("score", 6).alias("score"))


def rank_passages(spark, sf):
    out = E.rank_passages(E.bm25(publications(spark, sf), E.query_weights(citations(spark, sf))))
    return out.select("citation_id", "idx", "rank")


def plan_batches(spark, sf):
    return P.retrieve(citations(spark, sf), publications(spark, sf)).select("citation_id", "idx", "batch")


def select_passages(spark, sf):
    return E.select_passages(publications(spark, sf), citations(spark, sf)).select("citation_id", "passage_id", "idx", "score")


def language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", RT.language(F.col("text")).alias("language"))


def cross_language_pairs(spark, sf):
    c = citations(spark, sf)
    tr = c.withColumn("sentence", F.concat(F.lit("bu ve için çok "), F.lit("göre kadar")))
    return E.cross_language_pairs(tr, publications(spark, sf), c.select("citation_id", F.lit("term").alias("term"))).select("citation_id", "source", "target", "term")


def verify_quotes(spark, sf):
    out = E.verify_quotes(claims(spark, sf), E.chunk_passages(publications(spark, sf)))
    return out.select("citation_id", "batch", "verdict", "rejected", F.col("location").isNotNull().alias("located"))


def passage_evidence(spark, sf):
    out = E.passage_evidence(claims(spark, sf).where("passage_id = 'P1'"), E.chunk_passages(publications(spark, sf)))
    return out.select("citation_id", "batch", "location", F.length("passage_text").alias("n_chars"))


def _checked(spark, sf):
    return stage_table(E.verify_quotes(claims(spark, sf), E.chunk_passages(publications(spark, sf))), "checked")


def rollup_verdict(spark, sf):
    out = E.rollup_verdict(_checked(spark, sf))
    return out.select("citation_id", "verdict", "n_claims", "rejected")


def explain_verdict(spark, sf):
    out = E.rollup_verdict(_checked(spark, sf))
    return out.select("citation_id", F.length(E.explain_verdict(F.col("verdict"), F.col("rejected"))).alias("n"))


def early_stop(spark, sf):
    return E.early_stop(E.rollup_verdict(_checked(spark, sf), ("citation_id", "batch"))).select("citation_id", "batch", "verdict")


def evidence_union(spark, sf):
    return E.evidence_union(_checked(spark, sf)).select("citation_id", "passage_id")


def merge_batches(spark, sf):
    return E.merge_batches(_checked(spark, sf)).select("citation_id", "verdict", "evidence_batches")


def evidence_coverage(spark, sf):
    batches = P.retrieve(citations(spark, sf), publications(spark, sf))
    scanned = E.early_stop(E.rollup_verdict(_checked(spark, sf), ("citation_id", "batch")))
    return E.evidence_coverage(batches, scanned).select("citation_id", "passages", "characters", "scanned_batches")


def _assessed(spark, sf, sentence="s", **options):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    refs = d.select("doc_id", F.lit("r0").alias("ref_id"), F.lit("A, B. (2000). T.").alias("raw"), F.when(F.col("doc_id") % 11 == 0, "review").otherwise("verified").alias("status"),
                    (F.col("doc_id") % 22 == 0).alias("accepted"), F.lit(False).alias("confirmed"))
    cites = d.select("doc_id", F.concat(F.lit("c"), F.col("doc_id")).alias("citation_id"), F.lit("r0").alias("reference"),
                     F.when(F.col("doc_id") % 13 == 0, "Yıl uyuşmazlığı").alias("issue"), F.lit(sentence).alias("sentence"), F.array(F.lit(sentence)).alias("context"))
    texts = d.where("doc_id % 17 <> 5").select("doc_id", F.lit("r0").alias("ref_id"), (F.col("doc_id") % 19 == 7).alias("needs_confirmation"),
                                               F.array(F.struct(F.lit("Text").alias("location"), F.col("text").alias("text"))).alias("passages"))
    c = claims(spark, sf).select("doc_id", F.concat(F.lit("c"), F.col("doc_id")).alias("citation_id"), "batch", "claim", "verdict", "passage_id", "quote")
    return P.assess(cites, refs, texts, c, **options)


def assess(spark, sf):
    return _assessed(spark, sf).select("doc_id", "citation_id", "verdict")


def assess_coverage(spark, sf):
    """Verdicts with what was planned and read of each publication."""
    out = _assessed(spark, sf, "harbour records", coverage=True)
    return out.select("doc_id", "verdict", "passages", "characters", "scanned_batches", "query_expansion")


def verdict_summary(spark, sf):
    c = citations(spark, sf).select(F.col("citation_id").alias("doc_id"), F.concat(F.lit("c"), F.col("citation_id")).alias("citation_id"))
    return R.verdict_summary(c, _assessed(spark, sf).where("doc_id % 10 <> 9"))


def blocker_distribution(spark, sf):
    ev = _assessed(spark, sf).withColumn("cause", F.when(F.col("explanation").startswith("Önce"), "unresolved").when(F.col("explanation").startswith("Kaynak kimliği"), "unverified")
                                         .when(F.col("explanation").startswith("Tam metne"), "no_text").when(F.col("explanation").startswith("PDF"), "confirm").otherwise("quotes"))
    return R.blocker_distribution(ev, "cause")


def acquire_text(spark, sf):
    """Two sources per document; the empty and the later one lose."""
    d = table(spark, sf, "documents")
    one = lambda src, t: d.select(F.col("doc_id").alias("ref_id"), F.lit(src).alias("source"), F.lit(0).alias("pos"), F.array(F.struct(F.lit("x").alias("location"), t.alias("text"))).alias("passages"))
    texts = one("abstract", F.col("text")).unionByName(one("unpaywall", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit(" ")))).unionByName(
        one("europe_pmc", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.lit(""))))
    return E.acquire_text(texts).select("ref_id", "source", "abstract_only")


def oa_locations(spark, sf):
    """Locations of a part: its suppliers' shelves, repeated and in line order."""
    li = table(spark, sf, "lineitem")
    urls = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))), lambda x: F.concat(F.lit("https://s"), x["l_suppkey"] % 20))
    return E.oa_locations(li.groupBy(F.col("l_partkey").alias("ref_id")).agg(urls.alias("urls")))


def prefer_version(spark, sf):
    li = table(spark, sf, "lineitem")
    links = li.select(F.col("l_partkey").alias("ref_id"), F.concat(F.lit("https://h/pdf/"), F.col("l_suppkey") % 5).alias("url"),
                      F.when(F.col("l_suppkey") % 5 == 3, "vor").otherwise("am").alias("content_version"), F.lit("").alias("content_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return E.prefer_version(links)


def abstract_from_inverted_index(spark, sf):
    """Texts turned into word -> positions and back."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("p", "w"))
    index = d.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy(F.col("doc_id").alias("work_id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("abstract_index"))
    return E.abstract_from_inverted_index(index).select("work_id", F.length("abstract").alias("n"), F.md5("abstract").alias("digest"))


QUERIES = {f.__name__: f for f in (
    strip_bibliography, chunk_passages, retrieval_terms, query_weights, term_statistics, bm25, rank_passages, plan_batches, select_passages, language, cross_language_pairs,
    passage_evidence, verify_quotes, rollup_verdict, explain_verdict, early_stop, evidence_union, merge_batches, evidence_coverage, assess, assess_coverage, verdict_summary, blocker_distribution,
    acquire_text, oa_locations, prefer_version, abstract_from_inverted_index)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_N = "trim(regexp_replace(replace(lower(strip_accents({c})), 'ı', 'i'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_TERMS = (f"list_concat(list_transform(list_filter(string_split({_N}, ' '), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_STOP})), lambda w: substr(w, 1, 6)), "
          "list_transform(list_filter(regexp_extract_all({c}, '[0-9]+(?:[.,][0-9]+)?'), lambda n: NOT regexp_full_match(n, '(19|20)[0-9][0-9]')), lambda n: '#' || replace(n, ',', '.')))")
_CHUNK = """pass AS (SELECT pub_id, cast(row_number() OVER (PARTITION BY pub_id ORDER BY s) - 1 AS int) AS idx, t AS text FROM (SELECT doc_id AS pub_id, s, regexp_replace(substr(text, s + 1, 2400), '^\\s+|\\s+$', '', 'g') AS t
   FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS s FROM documents)) WHERE t <> '')"""
_W = f"weights AS (SELECT citation_id, pub_id, term, CASE WHEN starts_with(term, '#') THEN 2.0 ELSE 1.0 END AS weight FROM (SELECT DISTINCT citation_id, pub_id, unnest({_TERMS.format(c='sentence')}) AS term FROM asked))"
_BM = f"""pt AS (SELECT pub_id, idx, length(text) AS n_chars, {_TERMS.format(c='text')} AS terms FROM pass),
st AS (SELECT pub_id, count(*) AS n, sum(greatest(len(terms), 1)) / count(*) AS average FROM pt GROUP BY 1),
tf AS (SELECT pub_id, idx, term, count(*) AS f FROM (SELECT pub_id, idx, unnest(terms) AS term FROM pt) GROUP BY 1, 2, 3),
df AS (SELECT pub_id, term, count(*) AS d FROM tf GROUP BY 1, 2),
sc AS (SELECT w.citation_id, t.pub_id, t.idx, sum(w.weight * ln(1 + (st.n - d.d + 0.5) / (d.d + 0.5)) * t.f * 2.2 / (t.f + 1.2 * (0.25 + 0.75 * greatest(len(p.terms), 1) / st.average))) AS score
   FROM weights w JOIN tf t USING (pub_id, term) JOIN df d USING (pub_id, term) JOIN st USING (pub_id) JOIN pt p ON p.pub_id = t.pub_id AND p.idx = t.idx GROUP BY 1, 2, 3),
bm AS (SELECT c.citation_id, p.pub_id, p.idx, p.n_chars, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT citation_id, pub_id FROM weights) c JOIN pt p USING (pub_id) LEFT JOIN sc s ON s.citation_id = c.citation_id AND s.pub_id = p.pub_id AND s.idx = p.idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY round(score, 12) DESC, idx) AS rank FROM bm)"""
_BATCH = """ord AS (SELECT citation_id, idx, n_chars, row_number() OVER (PARTITION BY citation_id ORDER BY idx <> 0, rank) AS o FROM rk),
fill AS (SELECT citation_id, idx, o, n_chars AS size, 0 AS batch FROM ord WHERE o = 1
  UNION ALL SELECT n.citation_id, n.idx, n.o, CASE WHEN f.size + n.n_chars > 12000 THEN n.n_chars ELSE f.size + n.n_chars END, CASE WHEN f.size + n.n_chars > 12000 THEN f.batch + 1 ELSE f.batch END
  FROM fill f JOIN ord n ON n.citation_id = f.citation_id AND n.o = f.o + 1)"""
_OK = """chk AS (SELECT *, CASE WHEN needs AND NOT ok THEN 'unassessable' ELSE verdict END AS v, needs AND NOT ok AS rejected, needs AND ok AS located FROM (SELECT *, verdict IN ('supported', 'partial', 'contradicted') AS needs,
   (doc_id + batch) % 7 <> 3 AND length(quote) <= 250 AND regexp_replace(quote, '\\s+', '', 'g') <> '' AS ok FROM claimed))"""


def _roll(keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN bool_or(v = 'contradicted') THEN 'contradicted' WHEN bool_and(v = 'supported') THEN 'supported' WHEN bool_or(v IN ('supported', 'partial')) THEN 'partial'
      WHEN bool_or(v = 'unassessable') THEN 'unassessable' ELSE 'not_found' END AS verdict, count(*) AS n_claims, count(CASE WHEN rejected THEN 1 END) AS rejected FROM chk"""


def _sql(body: str, *parts: str) -> str:
    return (with_views("", "asked", "claimed").rstrip() + ", " + ", ".join(parts) + " " + body).replace("WITH asked", "WITH RECURSIVE asked", 1)


_MERGE = f"""pb AS ({_roll('citation_id, batch')} GROUP BY 1, 2),
scan AS (SELECT pb.* FROM pb JOIN (SELECT citation_id, min(CASE WHEN verdict = 'supported' THEN batch END) AS stop FROM pb GROUP BY 1) s USING (citation_id) WHERE stop IS NULL OR batch <= stop)"""


def _merged(src: str, claims: str) -> str:
    return f"""(SELECT citation_id, CASE WHEN ne = 1 THEN hit WHEN ne > 1 THEN joint WHEN nb = 1 THEN first_v WHEN uncertain THEN 'unassessable' ELSE 'not_found' END AS verdict, ne AS evidence_batches FROM (
  SELECT o.citation_id, coalesce(e.ne, 0) AS ne, e.joint, h.verdict AS hit, o.nb, o.uncertain, o.first_v
  FROM (SELECT citation_id, count(*) AS nb, bool_or(verdict = 'unassessable') AS uncertain, arg_min(verdict, batch) AS first_v FROM {src} GROUP BY 1) o
  LEFT JOIN (SELECT citation_id, count(DISTINCT batch) AS ne, min(batch) AS eb, CASE WHEN bool_or(v = 'contradicted') THEN 'contradicted' WHEN bool_and(v = 'supported') THEN 'supported' ELSE 'partial' END AS joint FROM {claims} WHERE located GROUP BY 1) e ON e.citation_id = o.citation_id
  LEFT JOIN {src} h ON h.citation_id = o.citation_id AND h.batch = e.eb))"""


_GATE = """CASE WHEN doc_id % 13 = 0 THEN 'unresolved' WHEN doc_id % 11 = 0 AND doc_id % 22 <> 0 THEN 'unverified' WHEN doc_id % 17 = 5 THEN 'no_text' WHEN doc_id % 19 = 7 THEN 'confirm' END"""
_ASSESS = _MERGE + f""",
sc2 AS (SELECT c.* FROM chk c JOIN scan USING (citation_id, batch)),
ans AS (SELECT d.doc_id, {_GATE} AS gate, CASE WHEN ({_GATE}) IS NULL THEN coalesce(m.verdict, 'unassessable') ELSE 'unassessable' END AS verdict FROM documents d LEFT JOIN {_merged('scan', 'sc2')} m ON m.citation_id = d.doc_id)"""

_WORDS = lambda ws: ", ".join(f"'{w}'" for w in ws)
_LANG = f"""lang AS (SELECT doc_id, n_chars, CASE WHEN tr > en THEN 'tr' WHEN en > tr THEN 'en' ELSE '' END AS language FROM (SELECT doc_id, n_chars, length(regexp_replace(h, '[^ğışİĞŞ]', '', 'g')) + len(list_filter(w, lambda x: x IN ({_WORDS(TR_WORDS)}))) AS tr,
   len(list_filter(w, lambda x: x IN ({_WORDS(EN_WORDS)}))) AS en FROM (SELECT doc_id, length(text) AS n_chars, substr(text, 1, 6000) AS h, string_split_regex(lower(substr(text, 1, 6000)), '[^\\p{{L}}]+') AS w FROM documents)))"""
_LABELS = ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICT_EXPLANATION.items())

ORACLES = {
    "strip_bibliography": "SELECT doc_id, l AS location, md5(CASE l WHEN 'A' THEN text WHEN 'B' THEN '' ELSE 'APPENDIX\nkept ' || doc_id END) AS digest FROM documents, (SELECT 'A' AS l UNION ALL SELECT 'B' UNION ALL SELECT 'C') x",
    "chunk_passages": _sql("SELECT pub_id, idx, 'P' || (idx + 1) AS passage_id, length(text) AS n_chars, md5(text) AS digest FROM pass", _CHUNK),
    "retrieval_terms": f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TERMS.format(c='text')}) AS term FROM documents) GROUP BY 1, 2",
    "query_weights": _sql("SELECT * FROM weights", _W),
    "term_statistics": _sql("SELECT df.pub_id, df.term, df.d AS df, st.n, round(st.average, 6) AS average FROM df JOIN st USING (pub_id) JOIN (SELECT DISTINCT pub_id, term FROM weights) w USING (pub_id, term)", _CHUNK, _W, _BM),
    "bm25": _sql("SELECT citation_id, idx, n_chars, round(score, 6) AS score FROM bm", _CHUNK, _W, _BM),
    "rank_passages": _sql("SELECT citation_id, idx, rank FROM rk", _CHUNK, _W, _BM),
    "plan_batches": _sql("SELECT citation_id, idx, batch FROM fill", _CHUNK, _W, _BM, _BATCH),
    "language": None, "cross_language_pairs": None, "select_passages": None,
    "passage_evidence": _sql("SELECT c.citation_id, c.batch, CASE WHEN p.pub_id IS NOT NULL THEN 'Text' END AS location, length(p.text) AS n_chars FROM claimed c LEFT JOIN pass p ON p.pub_id = c.pub_id AND p.idx = 0", _CHUNK),
    "verify_quotes": _sql("SELECT citation_id, batch, v AS verdict, rejected, located FROM chk", _OK),
    "rollup_verdict": _sql(_roll("citation_id") + " GROUP BY 1", _OK),
    "explain_verdict": _sql(f"SELECT citation_id, length(CASE verdict {_LABELS} END || CASE WHEN rejected > 0 THEN ' ' || rejected || '{REJECTED_SUFFIX}' ELSE '' END) AS n FROM ({_roll('citation_id')} GROUP BY 1)", _OK),
    "early_stop": _sql("SELECT citation_id, batch, verdict FROM scan", _OK, _MERGE),
    "evidence_union": _sql("SELECT DISTINCT citation_id, 'P1' AS passage_id FROM chk WHERE located", _OK),
    "merge_batches": _sql(f"SELECT citation_id, verdict, evidence_batches FROM {_merged('pb', 'chk')}", _OK, _MERGE),
    "evidence_coverage": _sql("SELECT r.citation_id, count(*) AS passages, sum(n_chars) AS characters, any_value(s.k) AS scanned_batches FROM rk r LEFT JOIN (SELECT citation_id, count(*) AS k FROM scan GROUP BY 1) s ON s.citation_id = r.citation_id GROUP BY 1", _CHUNK, _W, _BM, _OK, _MERGE),
    "language": "WITH " + _LANG + " SELECT doc_id, language FROM lang",
    "cross_language_pairs": _sql("SELECT a.citation_id, 'tr' AS source, l.language AS target, 'term' AS term FROM asked a JOIN lang l ON l.doc_id = a.pub_id WHERE l.n_chars > 12000 AND l.language = 'en'", _LANG),
    "assess_coverage": _sql("""SELECT a.doc_id, a.verdict, p.passages, p.characters, CASE WHEN p.passages IS NOT NULL THEN coalesce(k.n, 0) END AS scanned_batches, CASE WHEN p.passages IS NOT NULL THEN false END AS query_expansion FROM ans a
        LEFT JOIN (SELECT pub_id, count(*) AS passages, sum(length(text)) AS characters FROM pass GROUP BY 1) p ON p.pub_id = a.doc_id AND a.gate IS NULL LEFT JOIN (SELECT citation_id, count(*) AS n FROM scan GROUP BY 1) k ON k.citation_id = a.doc_id""", _CHUNK, _OK, _ASSESS),
    "assess": _sql("SELECT doc_id, 'c' || doc_id AS citation_id, verdict FROM ans", _OK, _ASSESS),
    "verdict_summary": _sql("SELECT CASE WHEN doc_id % 10 = 9 THEN 'pending' ELSE verdict END AS verdict, count(*) AS n FROM ans GROUP BY 1", _OK, _ASSESS),
    "blocker_distribution": _sql("SELECT coalesce(gate, 'quotes') AS cause, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM ans WHERE verdict = 'unassessable' GROUP BY 1", _OK, _ASSESS),
    "acquire_text": "SELECT ref_id, source, source = 'abstract' AS abstract_only FROM (SELECT doc_id AS ref_id, CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN NULL WHEN doc_id % 5 = 0 THEN 'europe_pmc' WHEN doc_id % 3 = 0 THEN 'unpaywall' ELSE 'abstract' END AS source FROM documents) WHERE source IS NOT NULL",
    "oa_locations": "SELECT ref_id, url, rank FROM (SELECT l_partkey AS ref_id, 'https://s' || (l_suppkey % 20) AS url, row_number() OVER (PARTITION BY l_partkey ORDER BY min((l_orderkey, l_linenumber, l_suppkey))) AS rank FROM lineitem GROUP BY l_partkey, l_suppkey % 20) WHERE rank <= 8",
    "prefer_version": "SELECT l_partkey AS ref_id, 'https://h/pdf/' || (l_suppkey % 5) AS url, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey % 5 <> 3, min(l_orderkey * 10 + l_linenumber), 'https://h/pdf/' || (l_suppkey % 5)) AS rank FROM lineitem GROUP BY l_partkey, l_suppkey % 5",
    "abstract_from_inverted_index": "SELECT doc_id AS work_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ') AS t FROM documents) WHERE t <> ''",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
