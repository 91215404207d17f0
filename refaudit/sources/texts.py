"""Bibliography text, manuscripts and full texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refaudit.functions.text import WS, decode_entities, let, tidy_text, trim_ws
from refaudit.operators.shaping import with_computed

_NUMBER = f"^(?:\\[[0-9]+\\]|[0-9]+[.)])[{WS}]+"
_NAME = r"\p{L}'’–-"
_ENTRY_STARTS = "|".join((
    f"^(?:\\[[0-9]+\\]|[0-9]+[.)])[{WS}]+",
    f"^(?:(?:van|von|de|der|den)[{WS}]+)*\\p{{Lu}}[{_NAME}]+(?:[{WS}]+[{_NAME}]+){{0,2}},[{WS}]*(?:\\p{{Lu}}\\.|\\p{{Lu}}\\p{{Ll}})",
    f"^\\p{{Lu}}[{_NAME}]+[{WS}]+[A-Z]{{1,4}}(?:[,{WS}]|\\.)",
    f"(?i:^[^\\n]{{1,220}}?\\([{WS}]*(?:(?:19|20)[0-9]{{2}}[a-z]?(?:[{WS}]*[,)]|$)|t\\.[{WS}]*y\\.|n\\.[{WS}]*d\\.))"))


def split_references(texts: DataFrame, text: str = "text") -> DataFrame:
    """Entries of pasted bibliographies: (doc_id, pos, raw).

    A blank line ends an entry; a line that looks like an entry start opens one; number prefixes
    go and wrapped lines are joined. Done inside the row by marking entry starts, so a text of
    any length causes no shuffle.
    """
    lines = F.split(trim_ws(F.replace(F.col(text), F.lit("\r"), F.lit(""))), "\n")

    def mark(line: Column) -> Column:
        return let(trim_ws(line), lambda t: F.when(t == "", F.lit("\x01")).otherwise(F.concat(
            F.when(t.rlike(_ENTRY_STARTS), F.lit("\x01")).otherwise(F.lit(" ")), F.regexp_replace(t, _NUMBER, ""))))
    pieces = F.split(F.array_join(F.transform(lines, mark), ""), "\x01")
    entries = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
    return texts.select("doc_id", F.posexplode(entries).alias("pos", "raw"))


# --- positioned lines --------------------------------------------------------------------

_REF_HEADING = f"(?i)^(?:[0-9]+[.)]?[{WS}]*)?(kaynak[çÇ]a|kaynaklar|references|bibliography|works cited)[{WS}]*[:.]?$"
_END_HEADING = "(?i)^(?:ekler|ek\\s*[0-9]*|appendix|appendices)(?![\\p{L}\\p{N}_])"
_PAGE_NUMBER = "(?i)^(?:sayfa|page|s\\.)?\\s*[0-9]{1,4}(?:\\s*(?:/|of|-|–)\\s*[0-9]{1,4})?$"
_ENTRY_YEAR = "(?i)\\(\\s*(?:1[89]|20)[0-9]{2}[a-z]?\\s*[,)]|\\(\\s*(?:t\\.\\s*y\\.|n\\.\\s*d\\.)\\s*\\)"
_URLISH = "(?i)(?:https?://|doi\\.org/|(?<![\\p{L}\\p{N}_])10\\.[0-9]{4,9}/)\\S*$"


def page_furniture(lines: DataFrame) -> DataFrame:
    """Running headers and footers: edge lines (two per end, digits as #) on at least max(2, 30 %) of the pages.

    lines(doc_id, page, line_no, indent, text). Returns (doc_id, page, line_no) to drop, page numbers included.
    """
    body = lines.where(F.col("text") != "").select("doc_id", "page", "line_no", "text")
    page = Window.partitionBy("doc_id", "page")
    edge = (body.withColumn("a", F.row_number().over(page.orderBy("line_no"))).withColumn("z", F.row_number().over(page.orderBy(F.desc("line_no"))))
            .where((F.col("a") <= 2) | (F.col("z") <= 2)).withColumn("key", F.regexp_replace(F.lower("text"), "[0-9]+", "#")))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    seen = edge.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n")).join(pages, "doc_id")
    repeated = seen.where((F.col("n_pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.col("n_pages") * 0.3))).select("doc_id", "key", F.lit(True).alias("_r"))
    marked = edge.join(repeated, ["doc_id", "key"], "left").where(F.col("_r") | F.col("text").rlike(_PAGE_NUMBER)).select("doc_id", "page", "text").distinct()
    # Any line of the page equal to such an edge line goes as well.
    return body.join(marked, ["doc_id", "page", "text"], "left_semi").select("doc_id", "page", "line_no")


def layout_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, full, base): 75th percentile of long line lengths and their most frequent indent."""
    long = lines.where(F.length("text") > 25).select("doc_id", "indent", F.length("text").alias("n"))
    # Lengths are few distinct values, so the order statistic comes from a histogram.
    hist = long.groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("doc_id").orderBy("n")
    run = hist.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("doc_id")))
    full = run.where(F.col("upto") > F.floor(F.col("total") * 0.75)).groupBy("doc_id").agg(F.min("n").alias("full"))
    modes = long.groupBy("doc_id", "indent").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.min_by("indent", F.struct((-F.col("c")).alias("c"), "indent")).alias("base"))
    return full.join(modes, "doc_id")


def previous_line_features(lines: DataFrame) -> DataFrame:
    """Each line with the previous non-empty line of the document and what it says about a break."""
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    rows = lines.withColumn("prev", F.coalesce(F.last(F.nullif(F.col("text"), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    return rows.withColumn("prev_empty", F.coalesce(F.lag("text").over(w) == "", F.lit(False)))


def _starts_entry(c: Column) -> Column:
    first_upper = c.rlike("^\\p{Lu}") | F.lower(F.substring(c, 1, 4)).isin("van ", "von ", "de l", "van-")
    named = c.rlike("^\\p{L}[\\p{L}\\p{N}_'’-]*(?:\\s+\\p{L}[\\p{L}\\p{N}_'’-]*){0,3},\\s*(?:\\p{L}{1,3}\\.|\\p{L}+[,.])")
    return c.rlike("^(?:\\[[0-9]{1,3}\\]|[0-9]{1,3}\\.)\\s+\\S") | (first_upper & (named | F.substring(c, 1, 160).rlike(_ENTRY_YEAR)))


def _join_lines(lines: Column) -> Column:
    """Wrapped lines as one text: hyphens closed before a lower-case letter, broken links glued."""
    def step(acc: Column, line: Column) -> Column:
        link = acc.rlike(_URLISH)
        hyphen = acc.rlike("\\p{L}-$") & line.rlike("^\\p{Ll}") & ~link
        glue = link & ~acc.rlike("[.,)]$") & ~line.rlike("^\\p{Lu}")
        return (F.when(acc == "", line).when(hyphen, F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), line))
                .when(glue, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line)))
    return F.aggregate(lines, F.lit(""), step)


def lines_to_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs rebuilt from positioned lines of one document (at most 2,000,000 characters).

    Page furniture goes; body paragraphs break at short or finished lines; bibliography entries
    break at the hanging indent, or at lines that look like an entry start.
    """
    kept = lines.join(page_furniture(lines), ["doc_id", "page", "line_no"], "left_anti")
    rows = previous_line_features(kept).join(layout_stats(kept), "doc_id", "left").fillna({"full": 80, "base": 0})
    t, prev = F.col("text"), F.col("prev")
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    opens = t.rlike(_REF_HEADING)
    closes = t.rlike(_END_HEADING) & (F.length("text") < 60)
    rows = rows.withColumn("mark", F.when(opens, 1).when(closes, 0))
    rows = rows.withColumn("in_refs", F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.lit(0)) == 1).withColumn("section", F.sum(F.when(opens, 1).otherwise(0)).over(upto))
    rows = rows.withColumn("was_in_refs", F.coalesce(F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    entry = F.col("in_refs") & ~opens & (t != "")
    sect = Window.partitionBy("doc_id", "section")
    rows = rows.withColumn("ref_base", F.first(F.when(entry, F.col("indent")), ignorenulls=True).over(sect.orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.avg(F.when(entry, (F.col("indent") > F.col("ref_base") + 2).cast("double"))).over(sect)
    rows = rows.withColumn("n_entry", F.count(F.when(entry, 1)).over(sect)).withColumn("hanging", (F.col("n_entry") >= 4) & share.between(0.25, 0.85))
    short = (prev != "") & (F.length("prev") < F.col("full") * 0.72)
    ends, comma = prev.rlike("[.!?:;\"”’)\\]]$"), prev.rlike("[,;]$")
    gap_break = F.col("prev_empty") & (prev.rlike("[.!?:\"”)\\]]$") | (short & ~comma))
    body_break = gap_break | (short & (ends | ~comma)) | (ends & (F.col("indent") > F.col("base") + 2) & (F.length("text") > 25))
    # Does the entry being collected already show its date? Its first line is taken to be the
    # latest line that looks like an entry start.
    rows = rows.withColumn("seq", F.struct("page", "line_no"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_y", F.last(F.when(F.col("in_refs") & t.rlike(_ENTRY_YEAR), F.col("seq")), ignorenulls=True).over(before))
    rows = rows.withColumn("_s", F.last(F.when(F.col("in_refs") & _starts_entry(t), F.col("seq")), ignorenulls=True).over(before))
    dated = F.coalesce(F.col("_y") >= F.col("_s"), F.col("_y").isNotNull())
    linked = prev.rlike("(?:,|&|(?<![\\p{L}\\p{N}_])and|(?<![\\p{L}\\p{N}_])ve)$") & ~F.regexp_replace(prev, ",+$", "").rlike(_URLISH)
    plain_entry = _starts_entry(t) & (short | t.rlike("^(?:\\[[0-9]|[0-9]+\\.)") | dated) & ~linked
    ref_break = F.when(F.col("hanging"), F.col("indent") <= F.col("ref_base") + 1).otherwise(plain_entry | (F.col("prev_empty") & dated))
    heading = opens | (closes & F.col("was_in_refs"))  # an appendix title ends the bibliography and is a plain line elsewhere
    text_rows = rows.withColumn("heading", heading).where(t != "")
    text_rows = text_rows.withColumn("brk", F.when(F.col("heading") | F.coalesce(F.lag(F.col("heading").cast("int")).over(w) == 1, F.lit(False)) | (prev == ""), 1)
                                     .when(F.col("in_refs"), ref_break.cast("int")).otherwise(body_break.cast("int")))
    text_rows = text_rows.withColumn("par", F.sum("brk").over(upto))
    g = text_rows.groupBy("doc_id", "par").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))).alias("x"), F.bool_or("heading").alias("heading"))
    g = with_computed(g, text=tidy_text(trim_ws(_join_lines(F.transform("x", lambda e: e["text"])))), page=F.col("x")[0]["page"]).where(F.col("text") != "")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("par")) - 1
    return g.withColumn("idx", idx).select(
        "doc_id", F.concat(F.lit("pdf:"), F.col("idx").cast("string")).alias("paragraph_id"), F.lit("word/document.xml").alias("part"), "idx", "text", F.lit(False).alias("protected"),
        F.lit(True).alias("paragraph_locked"), F.lit("word/document.xml").alias("grp"), F.when(F.col("heading"), "Heading").otherwise("").alias("style"), "page")


# --- full-text XML -----------------------------------------------------------------------

def jats_passages(articles: DataFrame, xml: str = "xml") -> DataFrame:
    """Article title and paragraph texts of full-text XML without reference list and back matter.

    articles(pub_id, xml). Tags inside a paragraph are dropped, its text is kept.
    """
    body = F.regexp_replace(F.col(xml), "(?is)<(ref-list|back)(?![0-9a-z_-])[^>]*>.*?</\\1\\s*>", "")
    strip = lambda c: F.regexp_replace(c, "<[^>]+>", "")
    title = decode_entities(strip(F.regexp_extract(body, "(?is)<article-title(?![0-9a-z_-])[^>]*>(.*?)</article-title\\s*>", 1)))
    parts = F.transform(F.regexp_extract_all(body, F.lit("(?is)<p(?![0-9a-z_-])[^>]*>(.*?)</p\\s*>"), 1), lambda p: decode_entities(strip(p)))
    rows = articles.select("pub_id", title.alias("title"), F.posexplode(parts).alias("i", "text"))
    return rows.select("pub_id", "title", F.concat(F.lit("Paragraf "), (F.col("i") + 1).cast("string")).alias("location"), "text")


def read_jats(spark: SparkSession, path: str) -> DataFrame:
    """Passages of every XML file under ``path`` (one file per article)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("pub_id"), F.col("value").alias("xml"))
    return jats_passages(files)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored web pages: (page_id, url, html), pruned to those columns."""
    return spark.read.parquet(path).select("page_id", "url", "html")
