"""Record linkage between bibliography entries and catalog works.

Entries repeat across documents, so every join below runs on *distinct questions*
(normalised title, first author, year, DOI, arXiv id) and the answers are joined back
at the end: a third of all entries citing one paper costs one question.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.functions.reference import parse_reference, route_providers
from refaudit.functions.text import normalize_simple, normalize_title

from refaudit.session import stage_table

from .shaping import with_computed

FLOOR_NUM, FLOOR_DEN = 9, 20          # reported matches share at least .45 of the longer title
PAIRED = 20                           # titles of up to so many words meet on two words
HOT_TOKEN_ROWS = 50_000               # rows of one signature per join cell before the grid grows
HOT_TITLE_WORKS = 256                 # works of one title before they are indexed by author/year/DOI
LEAF_TITLES = 16                      # work titles that share a set of words and are still compared one by one
MOST_SHARED = 5                       # sets of so many words are compared one by one however many titles share them

SCORING = ("work_id", "provider", "provider_rank", "row_rank", "title_norm", "author_norms", "year", "doi", "requires_review")


# --- preparation -------------------------------------------------------------------------

def prepare_references(refs: DataFrame, raw: str = "raw", google_books: bool = False) -> DataFrame:
    """Parse entries: adds ``parsed`` fields, normal forms, the provider route and ``query_id``."""
    out = refs.select(*refs.columns, F.inline(F.array(parse_reference(F.col(raw)))).alias("year", "doi", "title", "first_author", "arxiv"))
    out = with_computed(out, title_norm=normalize_title(F.col("title")), first_author_norm=normalize_title(F.col("first_author")),
                        route=route_providers(F.col(raw), F.col("doi"), F.col("arxiv"), google_books))
    return out.withColumn("query_id", F.md5(F.concat_ws("\x01", "title_norm", "first_author_norm", F.coalesce(F.col("year").cast("string"), F.lit("")), "doi", "arxiv", F.array_join("route", ","))))


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """Scoring columns of the catalog; titles, authors and DOIs in normal form."""
    names = F.transform("author", lambda a: normalize_simple(F.coalesce(F.nullif(a["family"], F.lit("")), a["literal"])))
    side = catalog.select("work_id", "provider", "provider_rank", "row_rank", "year", F.coalesce("requires_review", F.lit(False)).alias("requires_review"), "title", "author", "doi")
    return with_computed(side, title_norm=normalize_title(F.col("title")), author_norms=F.array_distinct(names),
                         doi=F.lower(F.coalesce("doi", F.lit("")))).select(*SCORING)


def questions(prepared: DataFrame) -> DataFrame:
    """One row per distinct question (partial aggregation before the shuffle)."""
    keep = ("title_norm", "first_author_norm", "year", "doi", "arxiv", "route")
    return prepared.groupBy("query_id").agg(*[F.first(c).alias(c) for c in keep])


# --- scores ------------------------------------------------------------------------------

def title_score(entry_norm: Column, work_norm: Column) -> Column:
    """Word overlap over the longer title; 1 if the work's (>= 4 word) title opens the entry's."""
    a, b = F.array_distinct(F.split(entry_norm, " ")), F.array_distinct(F.split(work_norm, " "))
    opens = (F.size(F.split(work_norm, " ")) >= 4) & entry_norm.startswith(F.concat(work_norm, F.lit(" ")))
    return (F.when(opens, F.lit(1.0)).when((entry_norm == "") | (work_norm == ""), F.lit(0.0))
            .otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))))


def author_match(wanted: Column, author_norms: Column) -> Column:
    """The cited first author equals, or is a whole-word part of, one of the work's names."""
    padded = F.concat(F.lit(" "), wanted, F.lit(" "))
    return (wanted != "") & F.exists(author_norms, lambda n: F.concat(F.lit(" "), n, F.lit(" ")).contains(padded))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Rank columns for pairs that carry ``title_match``, ``q_*`` and the work's scoring columns."""
    scored = (pairs
              .withColumn("author_match", author_match(F.col("q_first_author"), F.col("author_norms")))
              .withColumn("year_match", F.coalesce(F.col("q_year") == F.col("year"), F.lit(False)))
              .withColumn("doi_match", (F.col("q_doi") != "") & (F.col("q_doi") == F.col("doi"))))
    points = (F.col("title_match") * 60 + F.when(F.col("author_match"), 20).otherwise(0)
              + F.when(F.col("year_match"), 10).otherwise(0) + F.when(F.col("doi_match"), 10).otherwise(0))
    return scored.withColumn("score", F.floor(points + 0.5).cast("int"))


def is_strong() -> Column:
    """Verification rule over rank columns (``q_*`` are the entry's own year and DOI)."""
    t = F.col("title_match")
    return (~F.col("requires_review") & F.col("author_match") & (F.col("q_year").isNull() | F.col("year_match"))
            & ((F.col("q_doi") == "") | F.col("doi_match")) & ((t >= 0.8) | (F.col("doi_match") & (t >= 0.7))))


def is_primary_identity(primary: str = "Crossref") -> Column:
    """A primary-index row that identifies the entry, even if the author is spelt differently."""
    return ((F.col("provider") == primary) & (F.col("title_match") >= 0.8)
            & (F.col("doi_match") | F.col("author_match") | F.col("year_match")))


def primary_identity_found(ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """One flag per entry (partial ``bool_or``)."""
    return ranked.groupBy(key).agg(F.bool_or(is_primary_identity()).alias("primary_found"))


# --- DOI and title joins -----------------------------------------------------------------

def first_by_doi(works: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """The first work of each (provider, DOI); ``min_by`` reduces copies of one DOI on the map side."""
    side = works.where(F.col("doi") != "")
    if providers:
        side = side.where(F.col("provider").isin(providers))
    return side.groupBy("provider", "doi").agg(F.min_by(F.struct(*SCORING), F.struct("row_rank", "work_id")).alias("w")).select("w.*")


def match_by_doi(qs: DataFrame, works: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """Exact DOI lookup: the first work of each (provider, DOI), joined to the questions."""
    return join_by_doi(qs, first_by_doi(works, providers))


def join_by_doi(qs: DataFrame, first: DataFrame) -> DataFrame:
    """Questions and ``first`` (see :func:`first_by_doi`) by DOI.

    The right side holds at most one row per provider and DOI, so a popular DOI only makes the left side long (AQE splits that).
    """
    left = _question_columns(qs.where(F.col("doi") != ""))
    pairs = left.join(first, left.q_doi == first.doi)
    return score_pairs(pairs.withColumn("title_match", title_score(F.col("q_title_norm"), F.col("title_norm"))))


def _question_columns(qs: DataFrame) -> DataFrame:
    return qs.select("query_id", F.col("title_norm").alias("q_title_norm"), F.col("first_author_norm").alias("q_first_author"),
                     F.col("year").alias("q_year"), F.col("doi").alias("q_doi"))


def word_counts(*titles: DataFrame) -> DataFrame:
    """Document frequency of every title word."""
    both = reduce(DataFrame.union, [t.select("title_norm") for t in titles])
    return both.select(F.explode(F.array_distinct(F.split("title_norm", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _numbered(entry_titles: DataFrame, work_titles: DataFrame) -> DataFrame:
    """(id, title_norm, words, n, in_a, in_b): distinct titles of both sides, each with its words ``struct<df,word>`` from rare to frequent, ``word`` a number."""
    sides = entry_titles.select("title_norm", F.lit(True).alias("a")).union(work_titles.select("title_norm", F.lit(False)))
    titles = sides.groupBy("title_norm").agg(F.bool_or("a").alias("in_a"), F.bool_or(~F.col("a")).alias("in_b"))
    numbers = stage_table(word_counts(titles).withColumn("word", F.monotonically_increasing_id()), "title-words")
    words = titles.select("title_norm", F.explode(F.array_distinct(F.split("title_norm", " "))).alias("token"))
    ordered = words.join(numbers, "token").groupBy("title_norm").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("words"))
    out = titles.join(ordered, "title_norm").withColumn("n", F.size("words"))
    return stage_table(out.withColumn("id", F.monotonically_increasing_id()), "titles")


def _band(n: Column) -> Column:
    """-1 up to ``PAIRED`` words, then 0, 1, ...: a title lies in the band of its longest possible partner or in the one below."""
    limits = [PAIRED]
    while limits[-1] < 1 << 30:
        limits.append(limits[-1] * FLOOR_DEN // FLOOR_NUM)
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda t: t < n)) - 1


def _signatures(titles: DataFrame, side: str, only_long: bool = False) -> DataFrame:
    """Rows (key, cell, number, length, first and last position, title, words): where a title may meet its partners.

    A match at .45 of the longer title shares at least ceil(.45 n) words with a title of n words, two or more once either title has
    three; so the rarest shared words lie among its first words. Titles of up to ``PAIRED`` words meet on two of them, which few titles
    have in common however many use each word, and titles of at most two words on one. Where the longer title has more words, the
    titles meet on one word within a band of lengths, so that rows grow in proportion to the title.

    A key whose rarer word is frequent is spread over a cells x cells grid: each side fixes one coordinate by hash and is repeated
    along the other, so no task sees the whole key. ``only_long``: the signatures of pairs whose longer title has more than ``PAIRED`` words.
    """
    w, n = F.col("words"), F.col("n")
    need = F.floor((n * FLOOR_NUM + FLOOR_DEN - 1) / FLOOR_DEN).cast("int")

    def key(kind: str, *parts: Column) -> Column:
        return F.xxhash64(F.lit(kind), *parts).alias("key")

    def row(k: Column, at: Column, last: Column, shared: int) -> Column:
        return F.struct(k, F.get(w, at - 1)["df"].alias("df"), at.cast("int").alias("from"), last.cast("int").alias("at"), F.lit(shared).alias("shared"))
    none = F.expr("cast(array() as array<struct<key:bigint,df:bigint,from:int,at:int,shared:int>>)")
    upto = F.least(n, n - F.greatest(F.lit(2), need) + 2)
    two = F.flatten(F.transform(F.sequence(F.lit(1), upto - 1), lambda i: F.transform(F.sequence(i + 1, upto), lambda j: row(
        key("two", F.get(w, i - 1)["word"], F.get(w, j - 1)["word"]), i, j, 2))))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: row(key("one", F.get(w, i - 1)["word"]), i, i, 1))
    band = F.col("band")
    # Two titles meet under the higher one's band: in 'x' if b's is not the higher one, in 'y' if it is.
    place = lambda up, role: F.struct((band + up).alias("band"), F.lit(role).alias("role"))
    rises = n * FLOOR_DEN >= FLOOR_NUM * (PAIRED + 1)  # a partner in the band above may be close enough
    own = [F.when(band >= 0, place(0, "x"))] + ([F.when(band >= 0, place(0, "y"))] if side == "b" else [])
    bands = F.array_compact(F.array(*own, F.when(rises, place(1, "y" if side == "a" else "x"))))
    many = F.flatten(F.transform(bands, lambda b: F.transform(F.sequence(F.lit(1), n - need + 1), lambda i: row(key("many", b["band"], b["role"], F.get(w, i - 1)["word"]), i, i, 1))))
    short = [] if only_long else [F.when(n <= 2, one).otherwise(none), F.when((n >= 2) & (n <= PAIRED), two).otherwise(none)]
    rows = titles.withColumn("band", _band(n)).select("id", "n", "title_norm", "words", F.explode(F.concat(*short, many)).alias("p"))
    rows = rows.select("id", "n", "title_norm", F.col("words.word").alias("words"), "p.*").withColumn("cells", F.ceil(F.col("df") / HOT_TOKEN_ROWS).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
    rows = rows.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    line, column = ("own", "other") if side == "a" else ("other", "own")
    return rows.select("key", F.col(line).alias("line"), F.col(column).alias("col"), "shared", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "from", "at", "words")],
                       F.col("title_norm").alias("q_title_norm" if side == "a" else "title_norm"))


def title_overlaps(titles: DataFrame, only_long: bool = False) -> DataFrame:
    """(q_title_norm, title_norm, title_match): pairs of different titles that reach the floor, settled where they meet.

    A pair may share several signatures; it counts at that of its first shared words alone, so the pairs, which may be very many, are
    neither gathered to drop repeats nor joined with their words: what is shuffled grows with the titles.
    """
    cell = ("key", "line", "col")
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the pairs, which the bytes do not tell
    a = _signatures(titles.where("in_a"), "a", only_long).repartition(tasks, *cell)
    b = _signatures(titles.where("in_b"), "b", only_long).drop("shared").repartition(tasks, *cell)
    longer, shorter = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    # At a pair's first signature nothing is shared before it, so the words behind it must do.
    most = F.col("shared") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    met = a.join(b, [*cell]).where((F.col("a_id") != F.col("b_id")) & (shorter * FLOOR_DEN >= longer * FLOOR_NUM) & (most * FLOOR_DEN >= longer * FLOOR_NUM))
    met = with_computed(met, common=F.array_intersect("a_words", "b_words"), longer=longer)

    def placed(at: str, nth: Column) -> Column:
        word = F.get("common", nth)
        return (F.get("a_words", F.col(f"a_{at}") - 1) == word) & (F.get("b_words", F.col(f"b_{at}") - 1) == word)
    # two titles of at most two words that share both meet on the two as well
    once = (F.col("shared") == 2) | (F.col("longer") > PAIRED) | (F.size("common") == 1)
    hits = met.where((F.size("common") * FLOOR_DEN >= F.col("longer") * FLOOR_NUM) & once & placed("from", F.lit(0)) & placed("at", F.col("shared") - 1))
    opens = (F.size(F.split("title_norm", " ")) >= 4) & F.col("q_title_norm").startswith(F.concat("title_norm", F.lit(" ")))
    return hits.select("q_title_norm", "title_norm", F.when(opens, F.lit(1.0)).otherwise(F.size("common") / F.col("longer")).alias("title_match"))


def title_pairs(entry_titles: DataFrame, work_titles: DataFrame) -> DataFrame:
    """All (entry title, work title) pairs that reach the floor, with ``title_match``.

    Exact set-similarity join: prefix and position filters on signatures, then the words themselves. Equal titles need no search.
    Pairs that score 1 because the work's title opens the entry's come from :func:`title_prefix_pairs`.
    """
    titles = _numbered(entry_titles, work_titles)
    equal = titles.where("in_a and in_b").select(F.col("title_norm").alias("q_title_norm"), "title_norm", F.lit(1.0).alias("title_match"))
    return title_overlaps(titles).unionByName(equal).unionByName(title_prefix_pairs(entry_titles, work_titles, below_floor=True))


def title_prefix_pairs(entry_titles: DataFrame, work_titles: DataFrame, below_floor: bool = False) -> DataFrame:
    """Work titles of at least four words that open an entry title, by equality on every word prefix.

    The entry side lists its own proper prefixes, so the join is a plain equi-join on whole
    titles instead of a ``startswith`` scan. ``below_floor`` keeps the pairs word overlap misses.
    """
    words = F.split("title_norm", " ")
    n = F.size(words)
    cuts = F.when(n > 4, F.sequence(F.lit(4), n - 1)).otherwise(F.array().cast("array<int>"))
    entries = entry_titles.select(F.col("title_norm").alias("q_title_norm"), F.explode(F.transform(cuts, lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("title_norm"))
    pairs = entries.join(work_titles.select("title_norm"), "title_norm")
    if below_floor:
        a, b = F.array_distinct(F.split("q_title_norm", " ")), F.array_distinct(F.split("title_norm", " "))
        longer = F.greatest(F.size(a), F.size(b))
        pairs = pairs.where(F.size(F.array_intersect(a, b)) * FLOOR_DEN < longer * FLOOR_NUM)
    return pairs.select("q_title_norm", "title_norm", F.lit(1.0).alias("title_match"))


def _distinct_titles(df: DataFrame) -> DataFrame:
    return df.where(F.col("title_norm") != "").select("title_norm").distinct()


def _name_parts(author_norms: Column) -> Column:
    """Every contiguous word group of every author name (plus '' for 'any author')."""
    def groups(name: Column) -> Column:
        w = F.split(name, " ")
        n = F.size(w)
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
            F.sequence(i, n), lambda j: F.array_join(F.slice(w, i, j - i + 1), " "))))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(author_norms, groups))))


def _class_keys(authors: Column, year: Column, doi: Column) -> Column:
    years = F.array_distinct(F.array(F.lit(""), F.coalesce(year.cast("string"), F.lit(""))))
    dois = F.array_distinct(F.array(F.lit(""), doi))
    return F.flatten(F.flatten(F.transform(authors, lambda a: F.transform(years, lambda y: F.transform(
        dois, lambda d: F.concat_ws("\x01", a, y, d))))))


def _top_works(works: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy("provider_rank", "row_rank", "work_id")
    # ``row_number <= k`` is applied before the shuffle as well (window group limit).
    return works.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _coded(entry_titles: DataFrame, work_titles: DataFrame) -> DataFrame:
    """(id, title_norm, words, n, in_a, in_b) as in :func:`_numbered`, with each word as its number alone."""
    return _numbered(entry_titles, work_titles).withColumn("words", F.col("words.word"))


def _least(n: Column) -> Column:
    """Fewest words that a partner at the floor shares with a title of ``n`` words."""
    return F.floor((n * FLOOR_NUM + FLOOR_DEN - 1) / FLOOR_DEN).cast("int")


def _extend(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, words, key, at) of ``size`` words each: ``key`` and one later word, as far as the floor lets a shared word lie behind."""
    last = F.col("n") - F.greatest(_least(F.col("n")), F.lit(size)) + size
    after = F.when(last > F.col("at"), F.sequence(F.col("at") + 1, last)).otherwise(F.array().cast("array<int>"))
    return rows.select("id", "n", "words", "key", F.explode(after).alias("at")).withColumn("key", F.concat("key", F.array(F.get("words", F.col("at") - 1))))


def _shared_sets(titles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where two titles of up to ``PAIRED`` words may meet: ``(pairs(a_id, b_id), a_sets, b_sets)``.

    Of the words that two titles share, taken from rare to frequent, the first are a key; if more than ``LEAF_TITLES`` work titles
    have it, the first two are, and so on. At a key that few work titles have, all are compared with the entry titles: ``pairs``.
    If every set is frequent down to the last word, the shared words are a key themselves: such keys, numbered, are in ``a_sets`` and
    ``b_sets`` (id, n, shared, set). Each pair that reaches the floor is in ``pairs`` or shares just the words of a common set.
    """
    start = titles.where(F.col("n") <= PAIRED).select("id", "n", "words", "in_a", "in_b", F.expr("cast(array() as array<bigint>)").alias("key"), F.lit(0).alias("at"))
    a, b = start.where("in_a").drop("in_a", "in_b"), start.where("in_b").drop("in_a", "in_b")
    pairs, sets = [], {"a": [], "b": []}
    for size in range(1, MOST_SHARED + 1):
        a, b = _extend(a, size), _extend(b, size)
        frequent = b.groupBy("key").agg(F.count("*").alias("titles")).where(F.col("titles") > LEAF_TITLES)
        frequent = stage_table(frequent.withColumn("set", F.monotonically_increasing_id()), "frequent-words")
        if frequent.isEmpty():  # all are compared here, none goes on
            none = F.lit(None).cast("bigint").alias("titles")
            pairs.append(_met(a.select("*", none), b.select("*", none), size))
            break
        a, b = a.join(frequent, "key", "left"), b.join(frequent, "key", "left")
        if size < MOST_SHARED:
            pairs.append(_met(a.where("titles is null"), b.where("titles is null"), size))
            a, b = a.where("titles is not null").drop("titles"), b.where("titles is not null").drop("titles")
            for name, rows in (("a", a), ("b", b)):
                sets[name].append(rows.where(_least(F.col("n")) <= size).select("id", "n", F.lit(size).alias("shared"), "set"))
            a, b = a.drop("set"), b.drop("set")
        else:
            pairs.append(_met(a, b, size))
    none = titles.select("id", "n", F.lit(0).alias("shared"), F.lit(0).cast("bigint").alias("set")).limit(0)
    return reduce(DataFrame.union, pairs), reduce(DataFrame.union, sets["a"] or [none]), reduce(DataFrame.union, sets["b"] or [none])


def _met(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(a_id, b_id) of titles with one key, close enough in length, with enough words behind; a frequent key is spread over a grid of cells."""
    def placed(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.withColumn("cells", F.coalesce(F.ceil(F.col("titles") / HOT_TOKEN_ROWS), F.lit(1)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        line, column = ("own", "other") if side == "a" else ("other", "own")
        return rows.select("key", F.col(line).alias("line"), F.col(column).alias("col"), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "at")])
    longer, shorter = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    most = size + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    met = placed(a, "a").join(placed(b, "b"), ["key", "line", "col"])
    return met.where((F.col("a_id") != F.col("b_id")) & (shorter * FLOOR_DEN >= longer * FLOOR_NUM) & (most * FLOOR_DEN >= longer * FLOOR_NUM)).select("a_id", "b_id")


def _list_score(shared: Column, longer: Column, bonus: Column | int = 0) -> Column:
    return F.floor(shared / longer * 60 + bonus + 0.5).cast("int")


def _sure_scores(a_sets: DataFrame, b_sets: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(a_id, sure map<provider,score>): at least ``k`` works of the provider score so much for any question under the title.

    A set of shared words vouches for the works of all titles that have it. Taken from short to long, ``k`` of them are there at the
    length ``reach``, so each scores at least what the set's words are of the longer of ``reach`` and the question's title.
    """
    by_set = ["shared", "set", "provider"]
    longest = b_sets.select(F.col("id").alias("b_id"), F.col("n").alias("b_n"), "shared", "set").join(kept.select("b_id", "provider", "work_id"), "b_id")
    longest = longest.groupBy(*by_set, "work_id").agg(F.max("b_n").alias("b_n"))
    counted = longest.groupBy(*by_set, "b_n").agg(F.count("*").alias("works"))
    upto = counted.withColumn("works", F.sum("works").over(Window.partitionBy(*by_set).orderBy("b_n")))
    reached = upto.where(F.col("works") >= k).groupBy(*by_set).agg(F.min("b_n").alias("reach"))
    longer = F.greatest("n", "reach")
    sure = a_sets.join(reached, ["shared", "set"]).where(F.col("shared") * FLOOR_DEN >= longer * FLOOR_NUM)
    sure = sure.groupBy(F.col("id").alias("a_id"), "provider").agg(F.max(_list_score(F.col("shared"), longer)).alias("score"))
    return sure.groupBy("a_id").agg(F.map_from_entries(F.collect_list(F.struct("provider", "score"))).alias("sure"))


def match_by_title(qs: DataFrame, works: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best works per question and provider among all title matches at .45 or more.

    Deliberate difference from asking a live index: the floor is applied before ranking, so a
    weak title with matching author and year cannot displace a better one.

    Works that share one title (think "Editorial") would pair with every question under that
    title. Copies with equal metadata are first reduced to the ``k`` earliest. Titles still
    holding more than ``HOT_TITLE_WORKS`` works per provider are then indexed by every
    combination of (author words, year, DOI) they satisfy, each list cut to its ``k`` earliest.
    A work of bonus class S among a question's best ``k`` has fewer than ``k`` earlier works
    in list S, since all of those rank at least as high; so the cut loses nothing.

    Titles that share frequent words with very many others are indexed in the same way by the set of shared words and the title's length
    (see :func:`_shared_sets`): each work of list (words, length, S) shares at least those words, so it ranks at least as high as
    a later one that shares no more, and the list may be cut to its ``k`` earliest. A work found in several lists counts with its highest score,
    which is its true one wherever it is among the best ``k``. A list is not asked for providers of which ``k`` works are sure to score more
    than any of its works (see :func:`_sure_scores`): a work lost by that has a list of more shared words or is not among the best.
    Titles of works and questions with one DOI are compared one by one, so these lists know only DOIs that more than ``HOT_TITLE_WORKS`` works have. So no list of all pairs is made, except for titles of more than ``PAIRED`` words and for
    words of which more than ``MOST_SHARED`` occur together in very many titles.
    """
    works = _top_works(works.where(F.col("title_norm") != ""), ["provider", "title_norm", "author_norms", "year", "doi", "requires_review"], k)
    works = stage_table(works.withColumn("_w", F.monotonically_increasing_id()), "numbered-works")
    left = stage_table(_question_columns(qs.where(F.col("title_norm") != "")).withColumn("_q", F.monotonically_increasing_id()), "numbered-questions")
    titles_q, titles_w = left.select(F.col("q_title_norm").alias("title_norm")).distinct(), _distinct_titles(works)
    titles = _coded(titles_q, titles_w)
    number = lambda name, norm: titles.select(F.col("id").alias(name), F.col("title_norm").alias(norm))
    asked = left.join(number("a_id", "q_title_norm"), "q_title_norm").select("_q", "a_id", "q_first_author", "q_year", "q_doi")
    kept = works.join(number("b_id", "title_norm"), "title_norm").select("_w", "b_id", "provider", "provider_rank", "row_rank", "work_id", "author_norms", "year", "doi")

    hot_doi = works.where(F.col("doi") != "").groupBy("doi").count().where(F.col("count") > HOT_TITLE_WORKS).select("doi", F.lit(True).alias("hot_doi"))
    asked = stage_table(asked.join(hot_doi.withColumnRenamed("doi", "q_doi"), "q_doi", "left"), "asked-titles")
    kept = stage_table(kept.join(hot_doi, "doi", "left"), "kept-works")
    listed_doi = lambda doi: F.when(F.col("hot_doi"), doi).otherwise(F.lit(""))
    told = lambda df, side, doi: df.where((F.col(doi) != "") & F.col("hot_doi").isNull()).select(f"{side}_id", F.col(doi).alias("doi")).distinct()
    of_doi = told(asked, "a", "q_doi").join(told(kept, "b", "doi"), "doi").where(F.col("a_id") != F.col("b_id")).select("a_id", "b_id")

    # Each step is written by itself: as one plan with all that follows, planning takes longer than the work on small inputs.
    near, a_sets, b_sets = _shared_sets(titles)
    a_sets, b_sets = stage_table(a_sets, "entry-sets"), stage_table(b_sets, "work-sets")
    near = near.union(of_doi).distinct()
    words = lambda s: titles.select(F.col("id").alias(f"{s}_id"), F.col("words").alias(f"{s}_words"))
    near = near.join(words("a"), "a_id").join(words("b"), "b_id").select(
        "a_id", "b_id", F.size(F.array_intersect("a_words", "b_words")).alias("overlap"), F.greatest(F.size("a_words"), F.size("b_words")).alias("longer"))
    near = near.where(F.col("overlap") * FLOOR_DEN >= F.col("longer") * FLOOR_NUM).select("a_id", "b_id", (F.col("overlap") / F.col("longer")).alias("title_match"))
    near = stage_table(near, "near-titles")
    equal = titles.where("in_a and in_b").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("title_match"))
    long = titles.where(F.col("n") * FLOOR_DEN >= FLOOR_NUM * (PAIRED + 1))
    named = title_prefix_pairs(titles_q, titles_w)
    if not long.where(F.col("n") > PAIRED).isEmpty():
        long = _numbered(long.where("in_a"), long.where("in_b"))
        named = title_overlaps(long, only_long=True).unionByName(named)
    named = named.join(number("a_id", "q_title_norm"), "q_title_norm").join(number("b_id", "title_norm"), "title_norm").select("a_id", "b_id", "title_match")
    pairs = near.unionByName(equal).unionByName(named)

    crowded = (kept.groupBy("provider", "b_id").count().where(F.col("count") > HOT_TITLE_WORKS)
               .select("b_id").distinct().withColumn("crowded", F.lit(True)))
    flagged = kept.join(crowded, "b_id", "left")
    of_work = _class_keys(_name_parts(F.col("author_norms")), F.col("year"), F.col("doi"))
    cold = flagged.where(F.col("crowded").isNull()).withColumn("class_key", F.lit(""))
    hot = flagged.where(F.col("crowded")).withColumn("class_key", F.explode(of_work))
    indexed = cold.unionByName(_top_works(hot, ["provider", "b_id", "class_key"], k)).drop("crowded", "hot_doi")

    of_question = _class_keys(F.array_distinct(F.array(F.lit(""), F.col("q_first_author"))), F.col("q_year"), F.col("q_doi"))
    keys = F.when(F.col("crowded"), of_question).otherwise(F.array(F.lit("")))
    direct = asked.join(pairs.join(crowded, "b_id", "left"), "a_id").withColumn("class_key", F.explode(keys)).drop("crowded", "hot_doi")
    ranks = ("_q", "_w", "provider", "provider_rank", "row_rank", "work_id", "score")
    direct = score_pairs(direct.join(indexed, ["b_id", "class_key"])).select(*ranks)

    lists = b_sets.select(F.col("id").alias("b_id"), F.col("n").alias("b_n"), "shared", "set").join(kept, "b_id")
    lists = lists.withColumn("class_key", F.explode(_class_keys(_name_parts(F.col("author_norms")), F.col("year"), listed_doi(F.col("doi")))))
    lists = _top_works(lists, ["shared", "set", "class_key", "provider", "b_n"], k).select("shared", "set", "class_key", "b_n", *ranks[1:-1])
    wanted = a_sets.select(F.col("id").alias("a_id"), F.col("n").alias("a_n"), "shared", "set").join(_sure_scores(a_sets, b_sets, kept, k), "a_id", "left")
    of_list = _class_keys(F.array_distinct(F.array(F.lit(""), F.col("q_first_author"))), F.col("q_year"), listed_doi(F.col("q_doi")))
    wanted = wanted.join(asked, "a_id").select("_q", "a_n", "shared", "set", "sure", F.explode(of_list).alias("class_key"))
    part = F.split("class_key", "\x01")
    bonus = sum((F.when(part[i] != "", p).otherwise(0) for i, p in enumerate((20, 10, 10))), F.lit(0))
    most = _list_score(F.col("shared"), F.col("a_n"), bonus)
    done = F.map_keys(F.map_filter("sure", lambda _, score: score > most))
    wanted = wanted.select("_q", "a_n", "shared", "set", "class_key", bonus.alias("bonus"), F.when(F.size(done) > 0, done).alias("done"))
    longer = F.greatest("a_n", "b_n")
    listed = wanted.join(lists, ["shared", "set", "class_key"]).where((F.col("shared") * FLOOR_DEN >= longer * FLOOR_NUM) & ~F.coalesce(F.array_contains("done", F.col("provider")), F.lit(False)))
    listed = listed.withColumn("score", _list_score(F.col("shared"), longer, F.col("bonus"))).select(*ranks)

    # One shuffle by question serves the highest score of each work and the ranking.
    found = direct.unionByName(listed).repartition("_q").groupBy(*ranks[:-1]).agg(F.max("score").alias("score"))
    best = Window.partitionBy("_q", "provider").orderBy(F.desc("score"), "provider_rank", "row_rank", "work_id")
    # Rows of one work id that differ in metadata take one rank, as before.
    top = stage_table(found.withColumn("_n", F.dense_rank().over(best)).where(F.col("_n") <= k).select("_q", "_w"), "best-works")
    out = top.join(left, "_q").join(works, "_w")
    scored = score_pairs(out.withColumn("title_match", title_score(F.col("q_title_norm"), F.col("title_norm")))).drop("_q", "_w")
    return scored.dropDuplicates(["query_id", "provider", "work_id"])


def best_candidate(ranked: DataFrame, key: str = "query_id", order: tuple[str, ...] = ("provider_rank", "row_rank", "work_id")) -> DataFrame:
    """Highest score per entry, ties by arrival; an aggregate, so it combines before the shuffle."""
    cols = [c for c in ranked.columns if c != key]
    first = F.min_by(F.struct(*cols), F.struct((-F.col("score")).alias("s"), *order))
    return ranked.groupBy(key).agg(first.alias("b")).select(key, "b.*")


def union_candidates(*frames: DataFrame) -> DataFrame:
    """Append candidates of several sources; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def limit_per_key(df: DataFrame, key: list[str], n: int, order: list[Column]) -> DataFrame:
    """First ``n`` rows per key in the given order (limited before and after the shuffle)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
