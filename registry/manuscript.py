"""Manuscript audit over derived paragraphs: body text, one heading, one bibliography per document."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.operators import citations as C
from refaudit.operators import edits as E
from refaudit.operators import reports as R
from refaudit.plans import audit as A
from refaudit.session import stage_table

from .views import NEEDS, VIEWS, view, with_views

VIEWS["paragraphs"] = """
SELECT doc_id, paragraph_id, 'word/document.xml' AS part, idx, text, protected, false AS paragraph_locked, 'word/document.xml' AS grp,
       CASE WHEN form = 3 AND idx % 50 = 7 THEN 'Heading1' ELSE 'Body' END AS style FROM manuscript
UNION ALL SELECT DISTINCT doc_id, 'h0', 'word/document.xml', 100000, 'References', false, false, 'word/document.xml', 'Heading1' FROM bib
UNION ALL SELECT doc_id, 'b' || cast(pos AS varchar(10)), 'word/document.xml', 100001 + pos, raw, false, false, 'word/document.xml', 'Body' FROM bib"""
NEEDS["paragraphs"] = ("manuscript", "bib")

# Expected citations, straight from the generator's columns.
VIEWS["cited"] = """
SELECT doc_id, idx, paragraph_id, form, k, protected, 0 AS n, family AS author_text, cited_year,
       CASE form WHEN 0 THEN length('Intro' || cast(idx AS varchar(20)) || ' sets the scene. The effect is stable (') WHEN 1 THEN 0
                 WHEN 2 THEN length('Two views exist (') ELSE length('As noted earlier. Sizes vary. Growth was slow. It was ' || cast(idx AS varchar(20)) || ' percent (') END AS author_start
FROM manuscript WHERE form <> 3
UNION ALL
SELECT doc_id, idx, paragraph_id, form, k, protected, 1, 'Nobody', 1999, length('Two views exist (' || family || ', ' || cast(cited_year AS varchar(10)) || '; ')
FROM manuscript WHERE form = 2"""
NEEDS["cited"] = ("manuscript",)

_KEYS = """keys AS (SELECT doc_id, ref_id, pos, lower(family) AS a, cast(year AS varchar(10)) AS y, family, raw FROM bib)"""
_RES = _KEYS + """,
cit AS (SELECT *, lower(author_text) AS a, cast(cited_year AS varchar(10)) AS y, author_start + length(author_text) + 2 AS s FROM cited),
hit AS (SELECT c.doc_id, c.paragraph_id, c.s, count(k.a) AS n_author, count(CASE WHEN k.y = c.y THEN 1 END) AS n_exact, min(k.pos) AS any_pos, min(CASE WHEN k.y = c.y THEN k.pos END) AS exact_pos
   FROM cit c LEFT JOIN keys k ON k.doc_id = c.doc_id AND k.a = c.a GROUP BY 1, 2, 3),
fz AS (SELECT doc_id, paragraph_id, s, count(*) AS nf, min('r' || pos) AS cand FROM (SELECT DISTINCT c.doc_id, c.paragraph_id, c.s, k.pos FROM cit c JOIN keys k
   ON k.doc_id = c.doc_id AND k.y = c.y AND length(c.a) >= 5 AND levenshtein(k.a, c.a) = 1) GROUP BY 1, 2, 3),
res AS (SELECT c.*, h.n_author, h.n_exact, CASE WHEN h.n_exact = 1 THEN 'r' || h.exact_pos WHEN h.n_exact = 0 AND h.n_author = 1 THEN 'r' || h.any_pos END AS reference,
   CASE WHEN h.n_author = 0 AND f.nf = 1 THEN f.cand END AS candidate,
   CASE WHEN h.n_exact > 1 THEN 'ambiguous' WHEN h.n_exact = 1 THEN NULL WHEN h.n_author = 1 THEN 'year' WHEN h.n_author > 1 THEN 'years' WHEN f.nf = 1 THEN 'fuzzy' ELSE 'orphan' END AS kind
   FROM cit c JOIN hit h USING (doc_id, paragraph_id, s) LEFT JOIN fz f USING (doc_id, paragraph_id, s))"""
_CODE = {L.ISSUE_AMBIGUOUS: "ambiguous", L.ISSUE_YEAR: "year", L.ISSUE_YEAR_MANY: "years", L.ISSUE_FUZZY: "fuzzy", L.ISSUE_ORPHAN: "orphan", L.ISSUE_GROUP: "group"}


def _code(c):
    m = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    return F.try_element_at(m, c)


def _sql(body: str, *views: str) -> str:
    return with_views("", *(views or ("paragraphs", "cited"))).rstrip() + ", " + _RES + " " + body


def _paragraphs(spark, sf):
    return view(spark, sf, "paragraphs")


def _staged(spark, sf):
    """The paragraphs written once: an audit reads them several times, and each time their texts would be joined and spelt out anew."""
    return stage_table(_paragraphs(spark, sf), "paragraphs")


_AUDITS: dict = {}


def _audit(spark, sf, context: bool = False) -> A.Audit:
    """One staged audit per session and input, with or without sentences; the queries below read different parts of it."""
    key = (spark.sparkContext.applicationId, sf)
    if (*key, True) not in _AUDITS and (*key, context) not in _AUDITS:
        _AUDITS[*key, context] = A.analyze(_staged(spark, sf), context=context)
    return _AUDITS.get((*key, True)) or _AUDITS[*key, context]


def is_heading(spark, sf):
    p = _paragraphs(spark, sf)
    return p.groupBy("doc_id").agg(F.count_if(C.is_heading(F.col("style"), F.col("text"))).alias("n_headings"))


def bibliography_range(spark, sf):
    return C.bibliography_range(_paragraphs(spark, sf))


def extract_references(spark, sf):
    return C.extract_references(_paragraphs(spark, sf)).select("doc_id", "ref_id", "raw", "author", "year_key", F.size("authors").alias("n_authors"))


def _body(p: DataFrame) -> DataFrame:
    """Paragraphs outside the bibliography."""
    limits = C.bibliography_range(p).select("doc_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return p.join(limits, "doc_id", "left").where(~F.coalesce(F.col("idx").between(F.col("_s"), F.col("_e")), F.lit(False))).drop("_s", "_e")


def extract_citations(spark, sf):
    p = _paragraphs(spark, sf)
    out = C.extract_citations(_body(p), C.extract_references(p))
    return out.select("doc_id", "paragraph_id", "start", "end", "author_text", "author_start", "year_key", "narrative", "protected", F.array_join("authors", "|").alias("authors"))


def narrative_authors(spark, sf):
    p = _paragraphs(spark, sf)
    cands = C.citation_candidates(_body(p)).where("narrative")
    return C.narrative_authors(cands, C.extract_references(p)).select("doc_id", "paragraph_id", "author_text", "author_start")


def is_citation_segment(spark, sf):
    p = _paragraphs(spark, sf)
    return C.citation_candidates(p).groupBy("doc_id", "narrative").agg(F.count("*").alias("n"))


def citation_context(spark, sf):
    """Last sentence and context size of every citation."""
    a = _audit(spark, sf, context=True)
    return a.citations.select("doc_id", "paragraph_id", "start", "sentence", F.size("context").alias("n_context"), "location")


def citation_ordinal(spark, sf):
    p = _paragraphs(spark, sf)
    return p.where(F.col("text").contains("(")).select("doc_id", "paragraph_id", C.location_label(F.col("part"), F.col("idx")).alias("location"))


def resolve_citations(spark, sf):
    a = _audit(spark, sf)
    out = C.resolve_citations(a.citations.drop("author_key", "n_author", "reference", "candidates", "issue"), a.references)
    return out.select("doc_id", "paragraph_id", "start", "reference", _code(F.col("issue")).alias("kind"), "n_author")


def fuzzy_author(spark, sf):
    a = _audit(spark, sf)
    return a.citations.where(F.col("candidate").isNotNull()).select("doc_id", "paragraph_id", "start", "candidate", F.col("patch.replacement").alias("replacement"))


def check_author_group(spark, sf):
    """An entry and the next one as one entry of two authors; cited with the one after, alone, and alone with others."""
    at = Window.partitionBy("doc_id").orderBy("pos")
    r = C.extract_references(_paragraphs(spark, sf)).select("doc_id", "ref_id", "author", F.lead("author").over(at).alias("n1"), F.lead("author", 2).over(at).alias("n2")).where("n2 is not null")
    both, own = F.array("author", "n1"), F.lower("author")
    return r.select("doc_id", "ref_id", C.check_author_group(F.array(own, F.lower("n2")), F.concat("author", F.lit(" and "), "n2"), both).alias("other_second"),
                    C.check_author_group(F.array(own), F.col("author"), both).alias("alone"), C.check_author_group(F.array(own), F.concat("author", F.lit(" et al.")), both).alias("with_others"))


def analyze(spark, sf):
    a = A.analyze(_staged(spark, sf))
    return a.citations.select("doc_id", "paragraph_id", "start", "reference", "candidate", _code(F.col("kind")).alias("kind"),
                              F.col("issue").isNotNull().alias("reported"), F.col("patch").isNotNull().alias("has_patch"))


def orphan_references(spark, sf):
    """Entries that no paragraph cites."""
    a = _audit(spark, sf)
    return C.orphan_references(a.references, a.citations).select("doc_id", "ref_id")


def orphan_citations(spark, sf):
    return C.orphan_citations(_audit(spark, sf).citations).select("doc_id", "paragraph_id", "start", "author_text")


def duplicate_references(spark, sf):
    """Entries whose part shares name and type with another of the document, by a key URL."""
    r = view(spark, sf, "bib").select("doc_id", F.concat(F.lit("r"), F.col("pos")).alias("ref_id"),
                                      F.concat(F.col("family"), F.lit(" (2000). X. https://www.example.org/"), F.col("family"), F.lit("/?q="), F.col("pos")).alias("raw"))
    return C.duplicate_references(r).select("doc_id", "ref_id", F.array_join("related", "|").alias("related"))


def findings(spark, sf):
    a = _audit(spark, sf)
    return a.findings.groupBy("doc_id", R.finding_group().alias("finding_group"), F.col("patch").isNotNull().alias("has_patch")).agg(F.count("*").alias("n"))


def findings_summary(spark, sf):
    return R.findings_summary(_audit(spark, sf).findings)


def count_entries(spark, sf):
    return R.count_entries(C.extract_references(_paragraphs(spark, sf)))


def _patches(spark, sf) -> DataFrame:
    """Two patches of each 'p. 12' citation, a group of its own (one of them stale in every third), and an overlapping patch."""
    m = view(spark, sf, "manuscript").where("form = 4")
    lead = F.concat(F.lit("As noted earlier. Sizes vary. Growth was slow. It was "), F.col("idx").cast("string"), F.lit(" percent ("), F.col("family"), F.lit(", "))
    c = m.select("doc_id", "paragraph_id", "k", F.length(lead).alias("s"), F.col("cited_year").cast("string").alias("y"))

    def patch(group, start, end, original, replacement):
        return F.struct(start.alias("start"), end.alias("end"), original.alias("original"), F.lit(replacement).alias("replacement"), F.concat(F.lit(group + ":"), F.col("paragraph_id")).alias("group_id"))
    s, y, k = F.col("s"), F.col("y"), F.col("k")
    early = patch("g1", F.lit(0), F.lit(2), F.when(k % 3 == 0, "XX").otherwise("As"), "Like")
    over = F.when(k % 5 == 0, patch("g2", s + 2, s + 4, F.substring(y, 3, 2), "zz"))
    return c.select("doc_id", "paragraph_id", F.inline(F.array_compact(F.array(patch("g1", s, s + 4, y, "MMXX!"), early, over))))


_PAT = """, pat AS (SELECT doc_id, paragraph_id, k, protected, text, cast(cited_year AS varchar(10)) AS y,
   length('As noted earlier. Sizes vary. Growth was slow. It was ' || cast(idx AS varchar(20)) || ' percent (' || family || ', ') AS s FROM manuscript WHERE form = 4)"""


def _patch_sql(body: str, *views: str) -> str:
    return with_views("", *(views or ("manuscript",))).rstrip() + _PAT + " " + body


def apply_patches(spark, sf):
    return E.apply_patches(_paragraphs(spark, sf), _patches(spark, sf)).select("doc_id", "paragraph_id", "text")


def rejected_patches(spark, sf):
    return E.rejected_patches(_paragraphs(spark, sf), _patches(spark, sf)).groupBy("doc_id", "group_id").agg(F.count("*").alias("n"))


def running_offsets(spark, sf):
    return E.running_offsets(_patches(spark, sf)).groupBy(F.substring("group_id", 1, 2).alias("group_id"), "offset").agg(F.count("*").alias("n"))


def overlapping_patches(spark, sf):
    return E.overlapping_patches(_patches(spark, sf)).select("doc_id", "paragraph_id", "group_id", "start")


def undo(spark, sf):
    p = _patches(spark, sf)
    return E.undo(p, p.where("group_id like 'g2:%'")).groupBy(F.substring("group_id", 1, 2).alias("group_id")).agg(F.count("*").alias("n"))


def suggest_patches(spark, sf):
    return E.suggest_patches(_audit(spark, sf).citations).select("doc_id", "paragraph_id", "start", "original", "replacement")


def _matches(a: A.Audit) -> DataFrame:
    return C.orphan_citations(a.citations).where(F.col("author_text").startswith("Missing")).select("doc_id", "citation_id", F.lit("r0").alias("ref_id"))


def apply_manual_matches(spark, sf):
    """Citations of unknown 'Missing...' authors mapped to the document's first entry."""
    a = _audit(spark, sf)
    out = E.apply_manual_matches(a.citations, _matches(a), a.references, _paragraphs(spark, sf))
    return out.where(F.col("manual_patches").isNotNull()).select("doc_id", "paragraph_id", "start", "reference", F.size("manual_patches").alias("n_patches"))


def manual_patches(spark, sf):
    """Both patches (year and author) of citations mapped by hand."""
    a = _audit(spark, sf)
    out = E.apply_manual_matches(a.citations, _matches(a), a.references, _paragraphs(spark, sf))
    return E.suggest_patches(out.where(F.col("manual_patches").isNotNull())).select("doc_id", "paragraph_id", "start", "original", "replacement")


def propagate_match(spark, sf):
    """One decision per unknown author and year reaches all its citations."""
    a = _audit(spark, sf)
    one = (C.orphan_citations(a.citations).where("not protected").groupBy("doc_id", "author_key", "year_key")
           .agg(F.min("citation_id").alias("citation_id")).select("doc_id", "citation_id", F.lit("r0").alias("ref_id")))
    return E.propagate_match(a.citations, one).groupBy("doc_id").agg(F.count("*").alias("n"))


def carry_matches(spark, sf):
    """The paragraph text grew at its front, so every offset moved by seven."""
    a = _audit(spark, sf)
    new = a.citations.withColumn("start", F.col("start") + 7).withColumn("citation_id", F.concat(F.lit("c"), F.col("paragraph_id"), F.lit(":"), F.col("start")))
    return E.carry_matches(a.citations, new, _matches(a))


def refresh_result_links(spark, sf):
    """After inserting two characters at each form-4 paragraph start, citations are found again."""
    a = _audit(spark, sf, context=True)
    p = _patches(spark, sf).where("original = 'As'")
    moved = a.citations.join(p.select("doc_id", "paragraph_id").distinct().withColumn("m", F.lit(2)), ["doc_id", "paragraph_id"], "left")
    eff = moved.withColumn("start", F.col("start") + F.coalesce("m", F.lit(0))).withColumn("citation_id", F.concat(F.lit("e"), F.col("paragraph_id"), F.lit(":"), F.col("start"))).drop("m")
    return E.refresh_result_links(a.citations, eff, p).select("doc_id", "paragraph_id", "start", "effective_id")


def override_context(spark, sf):
    a = _audit(spark, sf, context=True)
    o = a.citations.select("doc_id", "citation_id", F.concat(F.lit("New lead. About "), F.col("author_text"), F.lit(".")).alias("text"))
    return E.override_context(a.citations, o).select("doc_id", "paragraph_id", "start", "sentence", F.size("context").alias("n"))


def merge_entries(spark, sf):
    r = C.extract_references(_paragraphs(spark, sf))
    out = E.merge_entries(r, r.where(F.col("pos") % 4 == 1).select("doc_id", "ref_id"))
    return out.select("doc_id", "ref_id", "raw", F.size("paragraphs").alias("n_paragraphs"))


def split_entry(spark, sf):
    r = C.extract_references(_paragraphs(spark, sf))
    merged = E.merge_entries(r, r.where(F.col("pos") % 4 == 1).select("doc_id", "ref_id"))
    out = E.split_entry(merged, merged.where(F.size("paragraphs") > 1).select("doc_id", "ref_id"), _paragraphs(spark, sf))
    return out.select("doc_id", "ref_id", "raw", "year_key")


def editable_paragraphs(spark, sf):
    p = _paragraphs(spark, sf)
    return E.editable_paragraphs(p, C.extract_references(p), C.bibliography_range(p)).groupBy("doc_id").agg(F.count("*").alias("n"))


def reanalyze(spark, sf):
    """Every second 'p. 12' citation is moved a year on, and unknown 'Missing...' authors are mapped to the first entry; anchors stay."""
    p = _staged(spark, sf)
    refs = stage_table(C.extract_references(p), "refs")
    c = view(spark, sf, "cited").withColumn("s", (F.col("author_start") + F.length("author_text") + 2).cast("int"))
    patches = c.where("form = 4 and k % 2 = 0").select("doc_id", "paragraph_id", F.col("s").alias("start"), (F.col("s") + 4).alias("end"), F.col("cited_year").cast("string").alias("original"),
                                                       (F.col("cited_year") + 1).cast("string").alias("replacement"), F.col("paragraph_id").alias("group_id"))
    matches = c.where("author_text like 'Missing%'").select("doc_id", F.concat(F.lit("c"), "paragraph_id", F.lit(":"), F.col("s").cast("string")).alias("citation_id"), F.lit("r0").alias("ref_id"))
    a = A.reanalyze(p, refs, patches, matches)
    return a.citations.select("doc_id", "paragraph_id", "start", "reference", _code(F.col("kind")).alias("kind"))


def scoped_citations(spark, sf):
    a = _audit(spark, sf)
    done = a.citations.where(F.col("protected")).select("doc_id", "citation_id")
    return R.scoped_citations(a.citations, done, matched_only=True, pending_only=True).select("doc_id", "paragraph_id", "start", "reference")


def reusable_results(spark, sf):
    """Contexts of form-1 citations changed; everything else keeps its evidence."""
    a = _audit(spark, sf, context=True)
    ev = a.citations.select("doc_id", "citation_id", F.lit("supported").alias("verdict"))
    new = a.citations.withColumn("sentence", F.when(F.col("narrative"), F.concat("sentence", F.lit("!"))).otherwise(F.col("sentence")))
    return R.reusable_results(ev, a.citations, new).groupBy("doc_id").agg(F.count("*").alias("n"))


def search_rows(spark, sf):
    return R.search_rows(_paragraphs(spark, sf), "EFFECT İS STABLE (E", "text").select("doc_id", "paragraph_id")


QUERIES = {f.__name__: f for f in (
    is_heading, bibliography_range, extract_references, extract_citations, narrative_authors, is_citation_segment, citation_context, citation_ordinal,
    resolve_citations, fuzzy_author, check_author_group, analyze, orphan_references, orphan_citations, duplicate_references, findings, findings_summary,
    count_entries, apply_patches, rejected_patches, running_offsets, overlapping_patches, undo, suggest_patches, apply_manual_matches, manual_patches, propagate_match,
    carry_matches, refresh_result_links, override_context, merge_entries, split_entry, editable_paragraphs, reanalyze, scoped_citations, reusable_results, search_rows)}

# Heading paragraphs are form 3 and hold no citation, so they matter for context only.
_HISTORY = """, sent AS (SELECT doc_id, idx, form, CASE WHEN form = 3 AND idx % 50 = 7 THEN 1 ELSE 0 END AS h,
    CASE form WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 4 END AS ns,
    CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 4 END AS upto FROM manuscript),
  sec AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM sent),
  ctx AS (SELECT doc_id, idx, upto, coalesce(sum(ns) OVER (PARTITION BY doc_id, section ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sec WHERE h = 0)"""
_SENTENCE = """CASE c.form WHEN 0 THEN 'The effect is stable (' || c.author_text || ', ' || c.y || ').' WHEN 1 THEN c.author_text || ' (' || c.y || ') reports result ' || c.idx || '.'
  WHEN 2 THEN split_part(m.text, '. ', 1) || '.' ELSE 'It was ' || c.idx || ' percent (' || c.author_text || ', ' || c.y || ', p. 12).' END"""
_GROUP = "CASE WHEN kind = 'orphan' THEN 'orphan-citations' ELSE 'issues' END"
_USED = """, used AS (SELECT DISTINCT doc_id, reference FROM res WHERE reference IS NOT NULL UNION SELECT c.doc_id, 'r' || k.pos FROM res c JOIN keys k ON k.doc_id = c.doc_id AND k.a = c.a AND k.y = c.y WHERE c.kind = 'ambiguous')"""

# Citations whose author no entry has, and of those (document, author, year) the entries one edit away.
_OPEN = """, cit AS (SELECT *, lower(author_text) AS a, cast(cited_year AS varchar(10)) AS y, author_start + length(author_text) + 2 AS s FROM cited),
names AS (SELECT DISTINCT doc_id, lower(family) AS a FROM bib),
unknown AS (SELECT c.* FROM cit c LEFT JOIN names n ON n.doc_id = c.doc_id AND n.a = c.a WHERE n.a IS NULL),
near AS (SELECT q.doc_id, q.a, q.y, count(DISTINCT b.pos) AS n, min(b.family) AS family FROM (SELECT DISTINCT doc_id, a, y FROM unknown WHERE length(a) >= 5) q
  JOIN bib b ON b.doc_id = q.doc_id AND cast(b.year AS varchar(10)) = q.y AND levenshtein(lower(b.family), q.a) = 1 GROUP BY 1, 2, 3)"""


def _open_sql(body: str) -> str:
    return with_views("", "cited").rstrip() + _OPEN + " " + body


ORACLES = {
    "is_heading": _sql("SELECT doc_id, count(CASE WHEN style = 'Heading1' THEN 1 END) AS n_headings FROM paragraphs GROUP BY 1"),
    "bibliography_range": _sql('SELECT doc_id, 100001 AS start, 100001 + max(pos) AS "end", 1 AS n_headings FROM bib GROUP BY 1'),
    "extract_references": _sql("SELECT doc_id, 'r' || pos AS ref_id, raw, family AS author, cast(year AS varchar) AS year_key, 1 AS n_authors FROM bib"),
    "extract_citations": _sql('SELECT doc_id, paragraph_id, s AS start, s + 4 AS "end", author_text, author_start, y AS year_key, form = 1 AS narrative, protected, a AS authors FROM cit'),
    "narrative_authors": _sql("SELECT doc_id, paragraph_id, author_text, 0 AS author_start FROM cit WHERE form = 1"),
    "is_citation_segment": _sql("SELECT doc_id, narrative, sum(n) AS n FROM (SELECT doc_id, form = 1 AS narrative, count(*) AS n FROM cit GROUP BY 1, 2 UNION ALL SELECT doc_id, true, count(*) FROM bib GROUP BY 1) GROUP BY 1, 2"),
    "citation_context": _sql(f"""SELECT c.doc_id, c.paragraph_id, c.s AS start, {_SENTENCE} AS sentence, least(4, least(3, x.before) + x.upto) AS n_context, 'Ana metin · paragraf ' || (c.idx + 1) AS location
        FROM cit c JOIN manuscript m USING (doc_id, idx) JOIN ctx x ON x.doc_id = c.doc_id AND x.idx = c.idx""").replace(" SELECT c.doc_id, c.paragraph_id, c.s AS start, CASE", _HISTORY + " SELECT c.doc_id, c.paragraph_id, c.s AS start, CASE", 1),
    "citation_ordinal": _sql("SELECT doc_id, paragraph_id, 'Ana metin · paragraf ' || (idx + 1) AS location FROM paragraphs WHERE contains(text, '(')"),
    "resolve_citations": _sql("SELECT doc_id, paragraph_id, s AS start, reference, CASE WHEN kind NOT IN ('orphan', 'fuzzy') THEN kind END AS kind, n_author FROM res"),
    "fuzzy_author": _sql("SELECT res.doc_id, paragraph_id, s AS start, candidate, k.family AS replacement FROM res JOIN keys k ON k.doc_id = res.doc_id AND 'r' || k.pos = candidate").replace("k.family AS replacement", "CASE WHEN NOT protected THEN k.family END AS replacement"),
    "check_author_group": _sql("""SELECT doc_id, ref_id, n1 <> n2 AS other_second, true AS alone, false AS with_others FROM (SELECT doc_id, 'r' || pos AS ref_id,
        lower(lead(family) OVER (PARTITION BY doc_id ORDER BY pos)) AS n1, lower(lead(family, 2) OVER (PARTITION BY doc_id ORDER BY pos)) AS n2 FROM bib) WHERE n2 IS NOT NULL"""),
    "analyze": _sql("SELECT doc_id, paragraph_id, s AS start, reference, candidate, kind, kind IS NOT NULL OR protected AS reported, kind = 'fuzzy' AND NOT protected IS NOT DISTINCT FROM true AS has_patch FROM res").replace("kind = 'fuzzy' AND NOT protected IS NOT DISTINCT FROM true", "coalesce(kind = 'fuzzy', false) AND NOT protected"),
    "orphan_references": _sql("SELECT b.doc_id, 'r' || b.pos AS ref_id FROM bib b WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = b.doc_id AND u.reference = 'r' || b.pos)").replace(" SELECT b.doc_id, 'r'", _USED + " SELECT b.doc_id, 'r'", 1),
    "orphan_citations": _open_sql("SELECT o.doc_id, paragraph_id, s AS start, author_text FROM unknown o LEFT JOIN near n ON n.doc_id = o.doc_id AND n.a = o.a AND n.y = o.y WHERE coalesce(n.n, 0) <> 1"),
    "duplicate_references": _sql("SELECT a.doc_id, 'r' || a.pos AS ref_id, string_agg('r' || b.pos, '|' ORDER BY 'r' || b.pos) AS related FROM bib a JOIN bib b ON a.doc_id = b.doc_id AND a.family = b.family AND a.pos <> b.pos GROUP BY 1, 2"),
    "findings": _sql(f"""SELECT doc_id, finding_group, has_patch, sum(n) AS n FROM (SELECT doc_id, {_GROUP} AS finding_group, coalesce(kind = 'fuzzy', false) AND NOT protected AS has_patch, count(*) AS n FROM res WHERE kind IS NOT NULL OR protected GROUP BY 1, 2, 3
        UNION ALL SELECT b.doc_id, 'orphan-references', false, count(*) FROM bib b WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = b.doc_id AND u.reference = 'r' || b.pos) GROUP BY 1) GROUP BY 1, 2, 3""").replace(" SELECT doc_id, finding_group, has_patch, sum(n)", _USED + " SELECT doc_id, finding_group, has_patch, sum(n)", 1),
    "findings_summary": _sql(f"""SELECT doc_id, finding_group, sum(n) AS n FROM (SELECT doc_id, {_GROUP} AS finding_group, count(*) AS n FROM res WHERE kind IS NOT NULL OR protected GROUP BY 1, 2
        UNION ALL SELECT b.doc_id, 'orphan-references', count(*) FROM bib b WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = b.doc_id AND u.reference = 'r' || b.pos) GROUP BY 1) GROUP BY 1, 2""").replace(" SELECT doc_id, finding_group, sum(n)", _USED + " SELECT doc_id, finding_group, sum(n)", 1),
    "count_entries": _sql("SELECT doc_id, count(*) AS n FROM bib GROUP BY 1"),
    "apply_patches": _patch_sql("""SELECT q.doc_id, q.paragraph_id, CASE WHEN p.protected OR p.paragraph_id IS NULL THEN q.text
        WHEN p.k % 3 <> 0 THEN 'Like' || substr(substr(p.text, 1, p.s) || 'MMXX!' || substr(p.text, p.s + 5), 3)
        WHEN p.k % 5 = 0 THEN substr(p.text, 1, p.s + 2) || 'zz' || substr(p.text, p.s + 5) ELSE q.text END AS text
        FROM paragraphs q LEFT JOIN pat p ON p.doc_id = q.doc_id AND p.paragraph_id = q.paragraph_id""", "paragraphs"),
    "rejected_patches": _patch_sql("""SELECT doc_id, 'g1:' || paragraph_id AS group_id, 2 AS n FROM pat WHERE protected OR k % 3 = 0
        UNION ALL SELECT doc_id, 'g2:' || paragraph_id, 1 FROM pat WHERE k % 5 = 0 AND (protected OR k % 3 <> 0)"""),
    "running_offsets": _patch_sql("""SELECT group_id, cast(o AS int) AS "offset", count(*) AS n FROM (SELECT 'g1' AS group_id, 0 AS o FROM pat UNION ALL SELECT 'g1', 2 FROM pat UNION ALL SELECT 'g2', 3 FROM pat WHERE k % 5 = 0) GROUP BY 1, 2"""),
    "overlapping_patches": _patch_sql("""SELECT doc_id, paragraph_id, 'g2:' || paragraph_id AS group_id, s + 2 AS start FROM pat WHERE k % 5 = 0"""),
    "undo": _patch_sql("""SELECT group_id, count(*) AS n FROM (SELECT 'g1' AS group_id FROM pat UNION ALL SELECT 'g1' FROM pat) GROUP BY 1"""),
    "suggest_patches": _open_sql("""SELECT o.doc_id, paragraph_id, author_start AS start, author_text AS original, n.family AS replacement
        FROM unknown o JOIN near n ON n.doc_id = o.doc_id AND n.a = o.a AND n.y = o.y WHERE n.n = 1 AND NOT protected"""),
    "apply_manual_matches": _open_sql("""SELECT o.doc_id, paragraph_id, s AS start, 'r0' AS reference, CASE WHEN protected THEN 0 WHEN cast(b.year AS varchar(10)) <> o.y THEN 2 ELSE 1 END AS n_patches
        FROM unknown o JOIN bib b ON b.doc_id = o.doc_id AND b.pos = 0 LEFT JOIN near n ON n.doc_id = o.doc_id AND n.a = o.a AND n.y = o.y WHERE coalesce(n.n, 0) <> 1 AND author_text LIKE 'Missing%'"""),
    "manual_patches": _sql("""SELECT r.doc_id, r.paragraph_id, r.s AS start, r.y AS original, k.y AS replacement FROM res r JOIN keys k ON k.doc_id = r.doc_id AND k.pos = 0 WHERE r.kind = 'orphan' AND r.author_text LIKE 'Missing%' AND NOT protected AND k.y <> r.y
        UNION ALL SELECT r.doc_id, r.paragraph_id, r.author_start, r.author_text, k.family FROM res r JOIN keys k ON k.doc_id = r.doc_id AND k.pos = 0 WHERE r.kind = 'orphan' AND r.author_text LIKE 'Missing%' AND NOT protected"""),
    "propagate_match": _sql("SELECT doc_id, count(*) AS n FROM res WHERE kind = 'orphan' AND NOT protected GROUP BY 1"),
    "carry_matches": _sql("SELECT doc_id, 'c' || paragraph_id || ':' || (s + 7) AS citation_id, 'r0' AS ref_id FROM res WHERE kind = 'orphan' AND author_text LIKE 'Missing%'"),
    "refresh_result_links": _sql("SELECT doc_id, paragraph_id, s AS start, 'e' || paragraph_id || ':' || (s + CASE WHEN form = 4 AND k % 3 <> 0 THEN 2 ELSE 0 END) AS effective_id FROM cit"),
    "override_context": _sql("SELECT doc_id, paragraph_id, s AS start, 'About ' || author_text || '.' AS sentence, 2 AS n FROM cit"),
    "merge_entries": _sql("""SELECT doc_id, 'r' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS ref_id, raw, n_paragraphs FROM (SELECT a.doc_id, a.pos, a.raw || coalesce(' ' || b.raw, '') AS raw, CASE WHEN b.raw IS NULL THEN 1 ELSE 2 END AS n_paragraphs
        FROM bib a LEFT JOIN bib b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND a.pos % 4 = 1 WHERE a.pos % 4 <> 2)"""),
    "split_entry": _sql("SELECT doc_id, 'r' || pos AS ref_id, raw, cast(year AS varchar) AS year_key FROM bib"),
    "editable_paragraphs": _sql("SELECT doc_id, count(*) AS n FROM paragraphs WHERE NOT protected AND idx < 100000 GROUP BY 1"),
    "reanalyze": _sql("""SELECT doc_id, paragraph_id, s AS start, CASE WHEN author_text LIKE 'Missing%' THEN 'r0' ELSE reference END AS reference,
        CASE WHEN author_text NOT LIKE 'Missing%' THEN kind END AS kind FROM res""").replace("AS y, author_start + length", "AS y0, CASE WHEN form = 4 AND k % 2 = 0 AND NOT protected THEN cast(cited_year + 1 AS varchar(10)) ELSE cast(cited_year AS varchar(10)) END AS y, author_start + length", 1),
    "scoped_citations": _sql("SELECT doc_id, paragraph_id, s AS start, reference FROM res WHERE reference IS NOT NULL AND kind IS NULL AND NOT protected"),
    "reusable_results": _sql("SELECT doc_id, count(*) AS n FROM cit WHERE form <> 1 GROUP BY 1"),
    "search_rows": _sql("SELECT doc_id, paragraph_id FROM paragraphs WHERE contains(lower(translate(text, 'İI', 'iı')), 'effect is stable (e')"),
}
