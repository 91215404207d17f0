"""Document fingerprints (operator 9): SpotSigs signatures and pruned Jaccard, DataFrame functions only."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.llm.common import table
from refaudit.operators.shaping import with_computed
from refaudit.session import stage_table

# Common words of English, French, German and Spanish that anchor a signature. Fixed values.
ANCHORS = ("the of and to in is that was for it with as be on by are at this from have or not "
           "le la les des et un une du que est dans pour en il au ce qui sur "
           "der die und das den von zu mit sich auf ein eine ist dem nicht im "
           "el los las del se con por su para como al lo").split()
#: A word that begins with one of these letters opens a signature as well, so that texts poor in common words have some too.
OPENERS = "dmr"
#: Rows of one ordering bucket where ids are spread evenly.
BUCKET = 2048
#: Ranges of about equally many rows within which buckets have one width.
RANGES = 256


def _trie(words: list[str]) -> str:
    """A pattern that matches any of the words, branching once per letter."""
    branches: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        branches.setdefault(w[:1], []).append(w[1:])
    ends = branches.pop("", None) is not None
    inner = "|".join(k + _trie(v) for k, v in branches.items())
    return f"(?:{inner}){'?' if ends else ''}" if inner else ""


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted distinct 32-bit codes of the text's spot signatures (array of ints).

    Words are runs of letters, lower-cased. The text is cut behind each run of anchors and before each word that begins with
    an opening letter; each cut gives the chain of the two content words that follow (the second one, if need be, from behind
    the next cut). The start of a text is a cut. A text without letters is cut into words at blanks instead. NULL and empty texts:
    no codes. Each step is computed once per row: later steps refer to it several times.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    df = with_computed(df, _letters=F.trim(F.regexp_replace(F.lower(text_), r"[^\p{L}]+", " ")))
    blank_cut = F.trim(F.regexp_replace(text_, r"[\x20\x09-\x0D]+", " "))
    df = with_computed(df, _plain=F.when(F.col("_letters") == "", blank_cut).otherwise(F.col("_letters")))
    cut = f"(?: {_trie(ANCHORS)}(?= |$))++(?: |$)| (?=[{OPENERS}])|^ "
    df = with_computed(df, _places=F.filter(F.split(F.concat(F.lit(" "), F.col("_plain")), cut), lambda x: x != ""))
    places = F.col("_places")
    chains = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda x, y: F.hash(
        F.when(F.contains(x, F.lit(" ")), F.substring_index(x, " ", 2)).otherwise(F.concat(x, F.lit(" "), F.coalesce(F.substring_index(y, " ", 1), F.lit(""))))))
    codes = F.when(F.col("_plain") == "", F.array().cast("array<int>")).when(F.size(places) == 0, F.array(F.hash("_plain"))).otherwise(F.array_sort(F.array_distinct(chains)))  # middle: anchors alone
    return with_computed(df, **{name: codes}).drop("_letters", "_plain", "_places")


def fingerprint(codes: Column) -> Column:
    """The codes as one string of eight hexadecimal digits each."""
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def pruned_jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard likeness of two code sets; 0 without looking at them where their sizes alone keep it below ``floor``. Two empty sets: 1."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(large == 0, 1.0).when(small < F.lit(floor) * large, 0.0).otherwise(exact).cast("double")


def length_partition(codes: Column, floor: float) -> Column:
    """Partition number by set size such that sets with likeness of at least ``floor`` lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(F.size(codes), F.lit(1)).cast("double")) / F.log(F.lit(1 / floor))).cast("long")


def near_duplicates(docs: DataFrame, floor: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(``doc_id, class_id``, one row per input row; ``a, b, likeness``, pairs of classes with at least ``floor``).

    Rows with equal signature sets form a class (its smallest id), so copies never meet as pairs. Classes meet within the
    same or neighbouring length partitions on one of their rarest codes: of ``n`` codes in order of frequency the first
    ``n - ceil(floor * n) + 1`` suffice, and only a pair's first common code lets it through. NULL ids are kept apart from pairs.
    """
    rows = with_signatures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "codes").drop("text")
    coded = stage_table(rows.withColumn("key", F.sha2(fingerprint(F.col("codes")), 256)), "spot-codes")
    classes = coded.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("codes").alias("codes"))
    classes = stage_table(classes.filter("class_id IS NOT NULL AND size(codes) > 0"), "spot-classes")
    placed = classes.select("class_id", F.explode("codes").alias("code"))
    often = placed.groupBy("code").agg(F.count("*").alias("often"))
    ranked = placed.join(often, "code").withColumn("turn", F.row_number().over(Window.partitionBy("class_id").orderBy("often", "code")))
    sets = classes.select("class_id", F.size("codes").alias("n"), length_partition(F.col("codes"), floor).alias("part"))
    heads = ranked.join(sets, "class_id").filter(F.col("turn") <= F.col("n") - F.ceil(F.col("n") * floor) + 1).select("class_id", "code", "turn", "n", "part")
    left = heads.select(F.col("class_id").alias("a"), "code", F.col("n").alias("na"), F.col("turn").alias("ta"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = heads.select(F.col("class_id").alias("b"), "code", F.col("n").alias("nb"), F.col("turn").alias("tb"), "part")
    met = left.join(right, ["code", "part"]).filter("a <> b").filter(F.least("na", "nb") >= F.lit(floor) * F.greatest("na", "nb"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sided = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("codes").alias("ca")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("codes").alias("cb")), "b")
    links = sided.select("a", "b", pruned_jaccard(F.col("ca"), F.col("cb"), floor).alias("likeness")).filter(F.col("likeness") >= floor)
    return coded.join(coded.groupBy("key").agg(F.min("doc_id").alias("class_id")), "key").select("doc_id", "class_id"), links


def with_next(docs: DataFrame, order: str, carried: list[str], enrich: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by ``order`` ascending (NULL last); after the last row, the first.

    ``enrich`` adds carried columns that are costly to compute; it runs once, on rows that already know their bucket.

    Rows are ordered inside buckets of consecutive ids. Cut points, ``RANGES - 1`` at most, give ranges of about equally many rows, and
    each range is cut into buckets of one width (a power of two) with ``BUCKET`` rows on average. So dense, wide and sparse ids end in
    small buckets; at worst a bucket holds a range, a ``RANGES``-th of the rows and those of one repeated id. The first row of each bucket
    is copied behind the rows of the bucket before, so the carried columns are shuffled once and no bucket waits for another. Which bucket
    comes before is read from a table of one row per bucket.
    """
    n, low, high = docs.agg(F.count(order), F.min(order), F.max(order)).first()
    parts = min(RANGES, n // BUCKET + 1)
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx(order, shares, 100 * RANGES)).first()[0])) if shares else []
    ends = [low or 0, *cuts, (high or 0) + 1]
    shifts = [max(0, (BUCKET * (b - a) * parts // max(1, n)).bit_length() - 1) for a, b in zip(ends, ends[1:])]
    tie = F.xxhash64(carried[0])
    found = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col(order)))
    rows = with_computed(docs, _range=F.when(F.col(order).isNull(), F.lit(RANGES)).otherwise(found))
    start = F.call_function("shiftright", F.col(order).cast("long"), F.element_at(F.array(*[F.lit(min(k, 63)) for k in shifts]), F.least("_range", F.lit(len(cuts))) + 1))
    rows = rows.withColumn("_bucket", F.struct("_range", F.coalesce(start, F.lit(0).cast("long")).alias("start"))).drop("_range").withColumn("_tie", tie)
    heads = stage_table(rows.groupBy("_bucket").agg(F.min(F.struct(order, "_tie")).alias("_first")), "next-heads")
    last = heads.groupBy(F.col("_bucket._range").alias("_range")).agg(F.max("_bucket").alias("_last"))  # one row per range
    highest = F.max("_last").over(Window.partitionBy())
    last = last.select("_range", F.coalesce(F.lag("_last").over(Window.orderBy("_range")), highest).alias("_last"))
    inside = F.lag("_bucket").over(Window.partitionBy("_bucket._range").orderBy("_bucket"))
    heads = heads.withColumn("_inside", inside).join(F.broadcast(last), F.col("_bucket._range") == F.col("_range"))
    heads = heads.select(F.coalesce("_inside", "_last").alias("_before"), F.col(f"_first.{order}").alias("_order"), F.col("_first._tie").alias("_tie"))
    heads = stage_table(heads, "next-heads")
    guards = rows.join(heads, F.col(order).eqNullSafe(heads["_order"]) & (rows["_tie"] == heads["_tie"])).select(*docs.columns, heads["_before"].alias("_bucket"), rows["_tie"], F.lit(1).alias("_guard"))
    both = rows.withColumn("_guard", F.lit(0)).unionByName(guards)
    ahead = Window.partitionBy("_bucket").orderBy("_guard", F.col(order).asc_nulls_last(), "_tie")
    led = enrich(both).select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in carried])
    return led.filter("_guard = 0").drop("_bucket", "_tie", "_guard")


def compare_with_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness; likeness to the next text's fingerprint.

    The edited text has its last quarter (floor of its code points) replaced by as many first code points, or all, of the next
    document by ascending id. NULL text counts as empty (fingerprint empty, likeness 1 to another empty one); NULL ids come
    last; rows that repeat an id follow each other by a hash of their text; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text", "codes"], lambda df: with_signatures(df, "text", "codes"))
    tail = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    rows = with_signatures(with_computed(rows, edited=edited), "edited", "edited_codes")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("codes")).alias("fingerprint"),
                       fingerprint(F.col("edited_codes")).alias("edited_fingerprint"), pruned_jaccard(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
                       pruned_jaccard(F.col("codes"), F.col("next_codes")).alias("near_next"))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
