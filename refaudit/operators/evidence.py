"""Passage retrieval and evidence checks.

publications(pub_id, title, access, abstract_only, passages array<struct<location,text>>)
citations(citation_id, pub_id, sentence, context array<string>)

One publication holds at most 2,000,000 characters (about 1000 passages), so per-publication
and per-citation groups are bounded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.functions.reference import get_doi, reference_title
from refaudit.functions.retrieval import bm25_weight, language, retrieval_terms
from refaudit.functions.text import WS, evidence_key, let, normalize_title, trim_ws
from refaudit.session import stage_table

from .linkage import title_score
from .shaping import with_computed

WIDTH, STRIDE = 2400, 2000
BATCH_CHARACTERS = 12_000
VERDICTS = ("supported", "partial", "contradicted", "not_found", "unassessable")

_BIB_LINE = f"(?i)^[{WS}]*(?:(?:[IVX]+|[0-9]+)[.{WS}]+)?(?:REFERENCES|BIBLIOGRAPHY|KAYNAK[çÇ]A)[{WS}]*$"
_APPENDIX_LINE = f"(?i)^[{WS}]*(?:APPENDIX|APPENDICES|SUPPLEMENTARY MATERIAL)(?![0-9A-Za-z_])"


def strip_bibliography(passages: Column) -> Column:
    """Pages without the lines from a bibliography heading up to an appendix heading.

    The state runs across pages. Only marker lines (a handful) are searched per line, and
    publications without a bibliography heading pass through untouched.
    """
    marked = F.exists(passages, lambda p: p["text"].rlike(_BIB_LINE.replace("(?i)", "(?im)", 1)))
    lines = F.flatten(F.transform(passages, lambda p, n: F.transform(F.split(p["text"], "\n"), lambda t: F.struct(
        n.alias("page"), t.alias("text"), F.when(t.rlike(_BIB_LINE), 1).when(t.rlike(_APPENDIX_LINE), 2).otherwise(0).alias("mark")))))

    def kept(ls: Column) -> Column:
        marks = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x["mark"].alias("mark"))), lambda m: m["mark"] > 0)

        def keep(ms: Column) -> Column:
            inside = lambda i: F.coalesce(F.try_element_at(F.filter(ms, lambda m: m["i"] <= i), F.lit(-1))["mark"], F.lit(2)) == 2
            return F.filter(ls, lambda x, i: (x["mark"] != 1) & inside(i))
        return let(marks, keep)

    def rebuilt(ls: Column) -> Column:
        return F.transform(passages, lambda p, n: F.struct(p["location"].alias("location"), F.array_join(
            F.transform(F.filter(ls, lambda x: x["page"] == n), lambda x: x["text"]), "\n").alias("text")))
    plain = F.transform(passages, lambda p: F.struct(p["location"].alias("location"), p["text"].alias("text")))
    return F.when(marked, let(let(lines, kept), rebuilt)).otherwise(plain)


def _windows(text: Column, width: int, stride: int) -> Column:
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: trim_ws(F.substring(text, s + 1, F.lit(width)))), lambda t: t != "")


def chunk_passages(publications: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """Overlapping passages P1.. of each publication without its bibliography; no shuffle."""
    pages = strip_bibliography(F.col("passages"))
    chunks = F.flatten(F.transform(pages, lambda p: F.transform(_windows(p["text"], width, stride), lambda t: F.struct(p["location"].alias("location"), t.alias("text")))))
    keep = [c for c in publications.columns if c != "passages"]
    rows = publications.select(*keep, F.posexplode(chunks).alias("idx", "c"))
    return rows.select(*keep, "idx", F.concat(F.lit("P"), (F.col("idx") + 1).cast("string")).alias("passage_id"), "c.location", "c.text")


def query_weights(citations: DataFrame, expansion: DataFrame | None = None) -> DataFrame:
    """(citation_id, pub_id, term, weight): sentence 1, context .3, expansion .9, numbers twice; the largest wins."""
    own = citations.select("citation_id", "pub_id", F.explode(F.concat(
        F.array(F.struct(F.col("sentence").alias("text"), F.lit(1.0).alias("w"))),
        F.transform(F.filter(F.coalesce("context", F.array().cast("array<string>")), lambda c: c != F.col("sentence")),
                    lambda c: F.struct(c.alias("text"), F.lit(0.3).alias("w"))))).alias("x"))
    texts = own.select("citation_id", "pub_id", "x.text", "x.w")
    if expansion is not None:
        extra = expansion.join(citations.select("citation_id", "pub_id"), "citation_id").select("citation_id", "pub_id", F.col("term").alias("text"), F.lit(0.9).alias("w"))
        texts = texts.unionByName(extra)
    terms = texts.select("citation_id", "pub_id", "w", F.explode(F.array_distinct(retrieval_terms(F.col("text")))).alias("term"))
    weight = F.when(F.col("term").startswith("#"), F.col("w") * 2).otherwise(F.col("w"))
    return terms.groupBy("citation_id", "pub_id", "term").agg(F.max(weight).alias("weight"))


#: Parts of the citations of a publication that are scored apart.
SALTS = 8


def passage_terms(publications: DataFrame, weights: DataFrame) -> DataFrame:
    """Per passage of a cited publication: length in terms and characters, and its terms.

    Publications that nobody cites are dropped unread; what is asked of a publication never meets its text in one row, so a
    publication that very many citations ask about costs what any other does.
    """
    rows = chunk_passages(publications.select("pub_id", "passages").join(weights.select("pub_id").distinct(), "pub_id", "left_semi"))
    rows = with_computed(rows, terms=retrieval_terms(F.col("text")))
    return rows.select("pub_id", "idx", "passage_id", F.length("text").alias("n_chars"), F.greatest(F.size("terms"), F.lit(1)).alias("n_terms"), "terms")


def term_statistics(rows: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(publication: passages, average length), (publication, asked term: passage, ``tf``, its length and ``df``).

    Terms are counted per passage before the shuffle and only asked (publication, term) pairs stay.
    """
    stats = rows.groupBy("pub_id").agg(F.count("*").alias("n"), (F.sum("n_terms") / F.count("*")).alias("average"))
    tf = rows.select("pub_id", "idx", "n_terms", F.explode("terms").alias("term")).groupBy("pub_id", "term", "idx", "n_terms").agg(F.count("*").alias("tf"))
    tf = stage_table(tf.join(weights.select("pub_id", "term").distinct(), ["pub_id", "term"], "left_semi"), "postings")
    return stats, tf.join(tf.groupBy("pub_id", "term").agg(F.count("*").alias("df")), ["pub_id", "term"])


def bm25_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(citation_id, pub_id, idx, score) of the passages that share a term with the citation.

    An inverted-index join on (publication, term). A term that very many citations ask of one publication is dealt over
    ``SALTS`` parts of the citations; the postings, at most one per passage, are copied to each part.
    """
    stats, postings = term_statistics(rows, weights)
    thin = postings.join(stats, "pub_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = weights.withColumn("salt", F.pmod(F.xxhash64("citation_id"), F.lit(SALTS)).cast("int"))
    hits = dealt.join(thin, ["pub_id", "term", "salt"])
    part = bm25_weight(F.col("weight"), F.col("tf"), F.col("df"), F.col("n"), F.col("n_terms"), F.col("average"))
    return hits.groupBy("citation_id", "pub_id", "idx").agg(F.sum(part).alias("score"))


def bm25(publications: DataFrame, weights: DataFrame) -> DataFrame:
    """(citation_id, pub_id, idx, passage_id, n_chars, score) for every passage of the cited publication; 0 without a hit."""
    rows = stage_table(passage_terms(publications, weights), "passage-terms")
    pairs = weights.select("citation_id", "pub_id").distinct().join(rows.select("pub_id", "idx", "passage_id", "n_chars"), "pub_id")
    return pairs.join(bm25_scores(rows, weights), ["citation_id", "pub_id", "idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def rank_passages(scored: DataFrame) -> DataFrame:
    """Rank 1.. per citation by score, ties by position."""
    w = Window.partitionBy("citation_id", "pub_id").orderBy(F.desc(F.round("score", 12)), "idx")
    return scored.withColumn("rank", F.row_number().over(w))


def plan_batches(ranked: DataFrame, budget: int = BATCH_CHARACTERS) -> DataFrame:
    """Batch number per passage: the opening passage first, then by rank, filled greedily to the budget.

    Only the borders of batches are gathered as a citation's passages are read in order; a passage's batch is the number of
    borders up to its place. So time grows with the passages, not with their square.
    """
    order = F.struct((F.col("idx") != 0).alias("late"), "rank", "idx", "passage_id", "n_chars")
    lists = ranked.groupBy("citation_id", "pub_id").agg(F.array_sort(F.collect_list(order)).alias("o"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["size"] + x["n_chars"] > budget) & (acc["size"] > 0)
        return F.struct((acc["at"] + 1).alias("at"), F.when(full, x["n_chars"]).otherwise(acc["size"] + x["n_chars"]).alias("size"),
                        F.when(full, F.array_append(acc["borders"], acc["at"])).otherwise(acc["borders"]).alias("borders"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("borders"))
    cut = with_computed(lists, borders=F.aggregate("o", start, step, lambda a: a["borders"]))
    rows = cut.select("citation_id", "pub_id", "borders", F.posexplode("o").alias("at", "x"))
    return rows.select("citation_id", "pub_id", "x.idx", "x.passage_id", "x.n_chars", F.size(F.filter("borders", lambda b: b <= F.col("at"))).alias("batch"))


def select_passages(publications: DataFrame, citations: DataFrame, k: int = 3) -> DataFrame:
    """Three passages sharing most words with the context; first, middle and last if none shares any."""
    words = citations.select("citation_id", "pub_id", F.filter(F.array_distinct(F.split(normalize_title(F.array_join("context", " ")), " ")), lambda w: F.length(w) > 3).alias("words"))
    pages = F.flatten(F.transform("passages", lambda p: F.transform(_windows(p["text"], WIDTH, 1800), lambda t: F.struct(p["location"].alias("location"), t.alias("text")))))
    asked = publications.select("pub_id", "passages").join(words.select("pub_id").distinct(), "pub_id", "left_semi")
    chunks = asked.select("pub_id", F.posexplode(pages).alias("idx", "c")).select("pub_id", "idx", "c.location", "c.text")
    chunks = with_computed(chunks, terms=F.array_distinct(F.split(normalize_title(F.col("text")), " ")))
    scored = chunks.join(words, "pub_id").select("citation_id", "pub_id", "idx", "location", F.substring("text", 1, 1800).alias("text"), F.size(F.array_intersect("terms", "words")).alias("score"))
    whole = Window.partitionBy("citation_id", "pub_id")
    ranked = (scored.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "idx")))
              .withColumn("n", F.count("*").over(whole)).withColumn("top", F.max("score").over(whole)))
    blind = (F.col("top") == 0) & (F.col("n") > k)
    spread = F.when(F.col("idx") == 0, 1).when(F.col("idx") == F.floor(F.col("n") / 2), 2).when(F.col("idx") == F.col("n") - 1, 3)
    place = F.when(blind, spread).otherwise(F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.withColumn("place", place).where(F.col("place").isNotNull()).select(
        "citation_id", "pub_id", F.concat(F.lit("P"), F.col("place").cast("string")).alias("passage_id"), "idx", "location", "text", "score")


def cross_language_pairs(citations: DataFrame, publications: DataFrame, terms: DataFrame) -> DataFrame:
    """Supplied translation terms for citations whose language differs from a long publication's."""
    text = F.array_join(F.transform("passages", lambda p: p["text"]), " ")
    pubs = publications.select("pub_id", text.alias("_t"))
    pubs = with_computed(pubs, target=language(F.col("_t")), n_chars=F.length("_t")).select("pub_id", "target", "n_chars").where(F.col("n_chars") > BATCH_CHARACTERS)
    asked = with_computed(citations.select("citation_id", "pub_id", "sentence"), source=language(F.col("sentence")))
    differ = asked.join(pubs, "pub_id").where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return differ.join(terms, "citation_id").select("citation_id", "pub_id", "source", "target", "term")


# --- verdicts ----------------------------------------------------------------------------

def passage_evidence(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Location (and text) of the passage a claim points to; NULL where there is none."""
    p = passages.select("pub_id", "passage_id", "location", F.col("text").alias("passage_text"))
    return claims.join(p, ["pub_id", "passage_id"], "left")


def verify_quotes(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims whose quote is not literally in the passage become unassessable.

    Literal means after NFKC, soft hyphen, quote and blank normalisation, case kept; a quote has
    1 to 250 characters. Passages nobody quotes are dropped before any text is normalised.
    """
    needs = F.col("verdict").isin("supported", "partial", "contradicted")
    quoted = claims.where(needs).select("pub_id", "passage_id").distinct()
    pool = passages.join(quoted, ["pub_id", "passage_id"], "left_semi")
    # A passage is normalised once, however many claims quote it.
    pool = with_computed(pool, _hay=F.when(F.col("text").isNotNull(), evidence_key(F.col("text")))).select("pub_id", "passage_id", "location", "_hay")
    rows = with_computed(claims.join(pool, ["pub_id", "passage_id"], "left"), _needle=evidence_key(F.col("quote")))
    ok = (F.col("_hay").isNotNull() & (trim_ws(F.coalesce("quote", F.lit(""))) != "") & (F.length("quote") <= 250) & F.col("_hay").contains(F.col("_needle")))
    ok = F.coalesce(ok, F.lit(False))
    out = {"verdict": F.when(needs & ~ok, F.lit("unassessable")).otherwise(F.col("verdict")),
           "quote": F.when(needs & ok, F.col("quote")).otherwise(F.lit("")), "passage_id": F.when(needs & ok, F.col("passage_id")).otherwise(F.lit(""))}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in claims.columns], F.when(needs & ok, F.col("location")).alias("location"),
                       (needs & ~ok).alias("rejected"), F.when(needs & ~ok, F.lit(L.EVIDENCE_ERROR)).alias("evidence_error"))


def rollup_verdict(claims: DataFrame, keys: tuple[str, ...] = ("citation_id",)) -> DataFrame:
    """One verdict per group of claims, with the number of rejected quotes."""
    v = F.col("verdict")
    g = claims.groupBy(*keys).agg(
        F.bool_or(v == "contradicted").alias("c"), F.bool_and(v == "supported").alias("s"), F.bool_or(v.isin("supported", "partial")).alias("p"),
        F.bool_or(v == "unassessable").alias("u"), F.count("*").alias("n_claims"), F.count_if("rejected").alias("rejected"))
    verdict = (F.when(F.col("c"), "contradicted").when(F.col("s"), "supported").when(F.col("p"), "partial").when(F.col("u"), "unassessable").otherwise("not_found"))
    return g.select(*keys, verdict.alias("verdict"), "n_claims", "rejected")


def explain_verdict(verdict: Column, rejected: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in L.VERDICT_EXPLANATION.items() for x in kv])
    return F.concat(labels[verdict], F.when(rejected > 0, F.concat(F.lit(" "), rejected.cast("string"), F.lit(L.REJECTED_SUFFIX))).otherwise(F.lit("")))


def early_stop(batch_verdicts: DataFrame) -> DataFrame:
    """Batches up to and including the first fully supported one."""
    first = batch_verdicts.groupBy("citation_id").agg(F.min(F.when(F.col("verdict") == "supported", F.col("batch"))).alias("_stop"))
    return batch_verdicts.join(first, "citation_id").where(F.col("_stop").isNull() | (F.col("batch") <= F.col("_stop"))).drop("_stop")


def evidence_union(claims: DataFrame) -> DataFrame:
    """Distinct evidence passages of a citation over its batches."""
    return claims.where((F.col("passage_id") != "") & (F.col("quote") != "")).select("citation_id", "pub_id", "passage_id").dropDuplicates()


def evidence_coverage(batches: DataFrame, scanned: DataFrame, expansion: DataFrame | None = None) -> DataFrame:
    """Batches, scanned batches, early stop, passages and characters per citation."""
    size = batches.groupBy("citation_id").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("passages"), F.sum("n_chars").alias("characters"))
    seen = scanned.groupBy("citation_id").agg(F.count("*").alias("scanned_batches"), F.bool_or(F.col("verdict") == "supported").alias("_hit"))
    rows = size.join(seen, "citation_id", "left").withColumn("scanned_batches", F.coalesce("scanned_batches", F.lit(0)))
    rows = rows.withColumn("early_stop", F.coalesce("_hit", F.lit(False)) & (F.col("scanned_batches") < F.col("batches"))).drop("_hit")
    if expansion is None:
        return rows.withColumn("query_expansion", F.lit(False))
    had = expansion.select("citation_id").distinct().withColumn("query_expansion", F.lit(True))
    return rows.join(had, "citation_id", "left").withColumn("query_expansion", F.coalesce("query_expansion", F.lit(False)))


def merge_batches(claims: DataFrame) -> DataFrame:
    """Final verdict over the scanned batches of each citation.

    Evidence in one batch: that batch decides. In several: the claims that carry evidence are
    rolled up together. In none: one batch keeps its verdict, several give not_found, or
    unassessable if any of them was.
    """
    per_batch = rollup_verdict(claims, ("citation_id", "batch"))
    has = claims.where((F.col("passage_id") != "") & (F.col("quote") != ""))
    where = has.groupBy("citation_id").agg(F.count_distinct("batch").alias("n_evidence"), F.min("batch").alias("evidence_batch"))
    over = per_batch.groupBy("citation_id").agg(F.count("*").alias("n_batches"), F.bool_or(F.col("verdict") == "unassessable").alias("uncertain"),
                                                F.min_by(F.struct("verdict", "rejected"), "batch").alias("first"), F.sum("rejected").alias("all_rejected"))
    joint = rollup_verdict(has, ("citation_id",)).select("citation_id", F.col("verdict").alias("joint"))
    single = per_batch.select("citation_id", F.col("batch").alias("evidence_batch"), F.struct("verdict", "rejected").alias("hit"))
    rows = over.join(where, "citation_id", "left").join(joint, "citation_id", "left").join(single, ["citation_id", "evidence_batch"], "left")
    n = F.coalesce("n_evidence", F.lit(0))
    verdict = (F.when(n == 1, F.col("hit.verdict")).when(n > 1, F.col("joint")).when(F.col("n_batches") == 1, F.col("first.verdict"))
               .when(F.col("uncertain"), "unassessable").otherwise("not_found"))
    rejected = F.when(n == 1, F.col("hit.rejected")).when(n > 1, F.lit(0)).otherwise(F.col("first.rejected"))
    swept = (n == 0) & (F.col("n_batches") > 1)
    text = F.when(swept, F.when(F.col("uncertain"), L.EVIDENCE_UNCERTAIN).otherwise(L.EVIDENCE_NONE)).otherwise(explain_verdict(verdict, rejected))
    return rows.select("citation_id", verdict.alias("verdict"), text.alias("explanation"), F.col("n_batches").cast("int").alias("n_batches"), n.cast("int").alias("evidence_batches"))


# --- publications ------------------------------------------------------------------------

def publication_identity(refs: DataFrame, texts: DataFrame, floor: float = 0.65) -> DataFrame:
    """Title agreement of an acquired text, and whether its opening names the title or DOI.

    ``mismatch`` drops a text (title score under ``floor``); ``needs_confirmation`` asks the reader.
    """
    opening = F.array_join(F.transform(F.slice("passages", 1, 3), lambda p: p["text"]), " ")
    rows = refs.select("ref_id", "raw", reference_title(F.col("title")).alias("_want")).join(texts.select("ref_id", F.col("title").alias("_got"), opening.alias("_open"), "alternate"), "ref_id")
    rows = with_computed(rows, want=normalize_title(F.col("_want")), got=normalize_title(F.col("_got")), opening=normalize_title(F.col("_open")), doi=get_doi(F.col("raw")))
    named = ((F.col("want") != "") & F.col("opening").contains(F.col("want"))) | ((F.col("doi") != "") & F.lower("_open").contains(F.col("doi")))
    score = title_score(F.col("want"), F.col("got"))
    judged = (F.col("want") != "") & (F.col("got") != "")
    return rows.select("ref_id", F.when(judged, score).alias("title_score"), (judged & (score < floor)).alias("mismatch"), (F.col("alternate") | ~named).alias("needs_confirmation"))


def version_gate(version: Column, host_url: Column, accepted: Column) -> Column:
    """True where an alternate version (not the version of record) still needs the reader's consent."""
    v = F.coalesce(version, F.lit(""))
    alternate = ((v != "") & ~v.rlike("(?i)^(?:vor|publishedVersion)$")) | F.coalesce(host_url, F.lit("")).rlike("arxiv\\.org/")
    return alternate & ~F.coalesce(accepted, F.lit(False))


def prefer_version(links: DataFrame) -> DataFrame:
    """Distinct PDF links per reference, version of record first, then in the given order."""
    pdf = links.where(F.coalesce("content_type", F.lit("")).rlike("(?i)application/pdf") | F.col("url").rlike(r"(?i)/pdf(?:/|$|\?)"))
    vor = F.when(F.col("content_version") == "vor", 0).otherwise(1)
    first = pdf.groupBy("ref_id", "url").agg(F.min(F.struct(vor.alias("v"), F.col("pos").alias("pos"))).alias("o"))
    return first.select("ref_id", "url", F.row_number().over(Window.partitionBy("ref_id").orderBy("o.v", "o.pos", "url")).alias("rank"))


def oa_locations(locations: DataFrame, limit: int = 8) -> DataFrame:
    """First ``limit`` distinct open-access URLs per reference in order of appearance."""
    rows = locations.select("ref_id", F.posexplode("urls").alias("pos", "url")).where(F.coalesce("url", F.lit("")) != "")
    first = rows.groupBy("ref_id", "url").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("ref_id").orderBy("pos")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("ref_id", "url", "rank")


# Acquisition order (fixed): the first source with text wins.
SOURCES = ("entered_url", "europe_pmc", "unpaywall", "crossref_link", "open_access", "semantic_scholar", "doi_page", "abstract")


def acquire_text(texts: DataFrame) -> DataFrame:
    """First available text per reference by source priority, then by position in the source."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    ready = texts.where(rank > 0).where(F.exists("passages", lambda p: trim_ws(p["text"]) != ""))
    cols = [c for c in texts.columns if c != "ref_id"]
    best = ready.groupBy("ref_id").agg(F.min_by(F.struct(*cols), F.struct(rank.alias("r"), F.col("pos"))).alias("t"))
    return best.select("ref_id", "t.*", (F.col("t.source") == "abstract").alias("abstract_only"))


def abstract_from_inverted_index(works: DataFrame) -> DataFrame:
    """Abstract text from word -> positions (0..19999); one work's index is bounded by that range."""
    words = works.select("work_id", F.explode("abstract_index").alias("word", "positions")).select("work_id", "word", F.explode("positions").alias("p"))
    placed = words.where(F.col("p").between(0, 19999)).groupBy("work_id", "p").agg(F.max("word").alias("word"))
    lists = placed.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("p", "word"))).alias("x"))
    return lists.select("work_id", trim_ws(F.array_join(F.transform("x", lambda e: e["word"]), " ")).alias("abstract"))
