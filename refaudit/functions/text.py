"""Text normalisation, escaping and sentence splitting."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as the audited texts define it: Java's \s alone misses NBSP and friends.
WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Whitespace runs that are not already one plain blank: most blanks need no replacement.
_RUN = f"[{WS.removeprefix(chr(92) + 's')}\\t\\n\\x0B\\f\\r][{WS}]*| [{WS}]+"
# ASCII word boundary pieces; \b would be Unicode-aware on this JVM.
NOT_AFTER_WORD = r"(?<![0-9A-Za-z_])"
NOT_BEFORE_WORD = r"(?![0-9A-Za-z_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.transform(F.array(value), body)[0]


def before_each(lengths: Column, block: int = 64) -> Column:
    """Sum of the lengths before each element: totals of blocks first, so that no element adds up all before it."""
    def inside(a: Column, b: Column) -> Column:
        return F.aggregate(F.slice(lengths, a + 1, b - a), F.lit(0), lambda acc, x: acc + x)

    def placed(sums: Column) -> Column:
        return F.transform(lengths, lambda _, i: sums[(i / block).cast("int")] + inside((i / block).cast("int") * block, i))
    n = F.size(lengths)
    totals = F.transform(F.sequence(F.lit(0), (n / block).cast("int")), lambda b: inside(b * block, F.least(n, (b + 1) * block)))
    blocks = let(let(totals, lambda t: F.transform(t, lambda _, b: F.aggregate(F.slice(t, F.lit(1), b), F.lit(0), lambda acc, x: acc + x))), placed)
    few = F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda acc, x: acc + x))
    return F.when(n <= 1, F.transform(lengths, lambda _: F.lit(0))).when(n <= 16, few).otherwise(blocks)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def clean_ws(c: Column) -> Column:
    """Collapse every run of Unicode whitespace to one blank and trim; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _RUN, " "))


# --- Unicode normalisation ---------------------------------------------------------------

@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """NFKD; NULL in, NULL out."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC; NULL in, NULL out."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC; NULL in, NULL out."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


# Blocks whose characters the JVM-side table may cover.
_BLOCKS = ((0x0000, 0x024F), (0x0300, 0x036F), (0x0370, 0x03FF), (0x0400, 0x04FF), (0x1E00, 0x1EFF), (0x2010, 0x2022))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, str]:
    """(from, to, class of characters *not* covered), derived from the Unicode database.

    A character is covered when NFKD followed by dropping combining marks leaves at most
    one character, so a 1:1 ``translate`` gives the same answer without leaving the JVM.
    """
    src, dst, covered = [], [], []
    for lo, hi in _BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            out = "".join(x for x in unicodedata.normalize("NFKD", ch) if unicodedata.category(x)[0] != "M")
            if len(out) > 1 or (not out and unicodedata.category(ch)[0] != "M"):
                continue
            covered.append(cp)
            if out and out != ch:
                src.append(ch)
                dst.append(out)
    ranges, start = [], covered[0]
    for prev, cur in zip(covered, covered[1:] + [-2]):
        if cur != prev + 1:
            ranges.append(f"\\x{{{start:04X}}}-\\x{{{prev:04X}}}")
            start = cur
    return "".join(src), "".join(dst), "[^" + "".join(ranges) + "]"


# Plain ASCII has nothing to fold.
_NON_ASCII = "[^\\x00-\\x7F]"


def fold_simple(c: Column) -> Column:
    """JVM-only accent folding; exact for Latin, Greek and Cyrillic letters (usable in lambdas)."""
    src, dst, _ = _fold_table()
    return let(c, lambda v: F.when(v.rlike(_NON_ASCII), F.regexp_replace(F.translate(v, src, dst), r"\p{M}", "")).otherwise(v))


def fold_marks(c: Column) -> Column:
    """NFKD without combining marks.

    Strings made of covered characters stay in the JVM; only the others are handed to the
    Arrow UDF (it sees NULL for the rest, so next to nothing is transferred).
    """
    src, dst, uncovered = _fold_table()
    text = F.coalesce(nfkd(F.when(F.coalesce(c, F.lit("")).rlike(uncovered), c)), c)
    # Bound once: ``c`` may be a costly expression. What NFKD leaves has no letter of the table.
    return let(text, lambda v: F.when(v.rlike(_NON_ASCII), F.regexp_replace(F.translate(v, src, dst), r"\p{M}", "")).otherwise(v))


def _words_only(folded: Column) -> Column:
    lowered = F.replace(F.lower(folded), F.lit("ı"), F.lit("i"))
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N} ][^\p{L}\p{N}]*| [^\p{L}\p{N}]+", " "))


def normalize_title(c: Column) -> Column:
    """NFKD, no marks, lower case, dotless i to i, letters and digits separated by one blank."""
    return _words_only(fold_marks(F.coalesce(c, F.lit(""))))


def normalize_simple(c: Column) -> Column:
    """:func:`normalize_title` without the Arrow hop, for use inside lambdas."""
    return _words_only(fold_simple(F.coalesce(c, F.lit(""))))


def web_norm(c: Column) -> Column:
    """Normal form used to compare web fields: whitespace first, then as for titles.

    Titles squeeze blanks anyway; only U+FEFF, which is no blank to them, is made one beforehand.
    """
    return normalize_title(F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit(" ")))


def evidence_key(c: Column) -> Column:
    """Comparison key for quotes: NFKC, no soft hyphens, straight quotes, squeezed; case kept."""
    c = F.coalesce(c, F.lit(""))
    # Below U+00A0 nothing changes under NFKC; the listed letters and quotes are stable too.
    stable = "[^\\x{0000}-\\x{009F}\\x{00A1}-\\x{00A7}\\x{00A9}\\x{00AB}-\\x{00AE}\\x{00B0}\\x{00B1}\\x{00B6}\\x{00B7}\\x{00BB}\\x{00BF}-\\x{0131}\\x{0134}-\\x{013E}\\x{0141}-\\x{0148}\\x{014A}-\\x{017E}\\x{2010}\\x{2012}-\\x{2016}\\x{2018}-\\x{2022}]"
    text = F.coalesce(nfkc(F.when(c.rlike(stable), c)), c)
    text = F.translate(F.regexp_replace(text, "­", ""), "’‘“”", "''\"\"")
    return clean_ws(text)


# --- names and years ---------------------------------------------------------------------

# Year marker inside citations (fixed pattern): 1800-2099 with suffix, or an undated marker.
YEAR = r"(?:(?:18|19|20)[0-9]{2}[a-zA-Z]?|[tT]\.\s*[yY]\.|[nN]\.\s*[dD]\.)"


def year_key(c: Column) -> Column:
    """Lower case without blanks; the Turkish undated marker becomes ``n.d.``."""
    v = F.regexp_replace(F.lower(c), f"[{WS}]", "")
    return F.when(v == "t.y.", F.lit("n.d.")).otherwise(v)


def clean_name(c: Column) -> Column:
    """Name without possessive, 'et al' and its Turkish forms, or trailing punctuation."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), f"(?i)['’]s{NOT_BEFORE_WORD}", "")
    v = F.regexp_replace(
        v,
        f"(?i){NOT_AFTER_WORD}et[{WS}]+al\\.?|{NOT_AFTER_WORD}vd\\.|{NOT_AFTER_WORD}ve[{WS}]+ark\\.?|{NOT_AFTER_WORD}ve[{WS}]+di[ğĞ]erleri",
        "",
    )
    return trim_ws(F.regexp_replace(v, f"[,.{WS}]+$", ""))


def name_key(c: Column) -> Column:
    return normalize_title(clean_name(c))


def name_key_simple(c: Column) -> Column:
    return normalize_simple(clean_name(c))


def item_year(c: Column) -> Column:
    """First 19xx/20xx of a mixed date field, NULL if none."""
    y = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), f"{NOT_AFTER_WORD}((?:19|20)[0-9]{{2}}){NOT_BEFORE_WORD}", 1)
    return F.when(y != "", y.cast("int"))


# --- HTML --------------------------------------------------------------------------------

# Entities (fixed list): name -> character.
ENTITIES = {
    "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " ", "rsquo": "’", "lsquo": "‘",
    "rdquo": "”", "ldquo": "“", "ndash": "–", "mdash": "—", "hellip": "…",
}


def escape_html(c: Column) -> Column:
    """``& < > " '`` as entities."""
    v = F.coalesce(c, F.lit(""))
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        v = F.replace(v, F.lit(ch), F.lit(entity))
    return v


def _char_of(n: Column) -> Column:
    """Code point to string: UTF-32BE bytes decoded by the JVM; '' where out of range."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def decode_entities(c: Column) -> Column:
    """Named and numeric entities in one left-to-right pass (no double decoding).

    The string is cut before every entity-like token, each piece is decoded on its own and
    the pieces are glued again, so ``&amp;lt;`` gives ``&lt;``.
    """
    v = F.coalesce(c, F.lit(""))

    def decode_piece(p: Column) -> Column:
        def body(token: Column) -> Column:
            rest = F.substring(p, F.length(token) + 3, F.length(p))
            low = F.lower(token)
            number = F.when(low.startswith("#x"), F.conv(F.substring(low, 3, F.length(low)), 16, 10)).otherwise(
                F.substring(low, 2, F.length(low)))
            # More than nine digits cannot be a code point; keeps the cast from overflowing.
            n = F.when(F.length(token) <= 10, number.try_cast("bigint"))
            named = F.when(low == "amp", F.lit("&"))
            for name, ch in ENTITIES.items():
                named = named.when(low == name, F.lit(ch))
            return (F.when(token == "", p)
                    .when(low.startswith("#"), F.concat(F.coalesce(_char_of(n), F.lit("")), rest))
                    .otherwise(F.coalesce(F.concat(named.otherwise(F.lit(None)), rest), p)))
        return let(F.regexp_extract(p, r"(?i)^&(#x[0-9a-f]+|#[0-9]+|[a-z]+);", 1), body)

    pieces = F.split(v, r"(?=&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);)")
    return F.when(v.contains("&"), F.array_join(F.transform(pieces, decode_piece), "")).otherwise(v)


def html_text(c: Column) -> Column:
    """Markup to text: block ends become newlines, tags blanks, entities characters."""
    v = F.coalesce(c, F.lit(""))
    v = F.regexp_replace(v, f"(?i)<br(?![0-9a-z_])[^>]*>|</p[{WS}]*>|</div[{WS}]*>|</li[{WS}]*>", "\n")
    v = decode_entities(F.regexp_replace(v, "<[^>]+>", " "))
    v = F.regexp_replace(v, "[ \\t]+", " ")
    v = F.regexp_replace(v, f"[{WS}]*\\n[{WS}]*", "\n")
    return trim_ws(v)


def plain_text(c: Column) -> Column:
    """Page text on one line: scripts, styles and comments dropped, tags blanked, decoded."""
    v = F.coalesce(c, F.lit(""))
    v = F.regexp_replace(
        v,
        f"(?is)<script(?![0-9a-z_])[^>]*>.*?</script[{WS}]*>|<style(?![0-9a-z_])[^>]*>.*?</style[{WS}]*>|<!--.*?-->",
        " ")
    return clean_ws(decode_entities(F.regexp_replace(v, "<[^>]+>", " ")))


_ATTR = f"([\\w:-]+)[{WS}]*=[{WS}]*(?:\"([^\"]*)\"|'([^']*)'|([^{WS}>]+))"


def tag_attrs(c: Column) -> Column:
    """Attribute map of one tag: lower-case name -> decoded value, the last one wins."""
    v = F.coalesce(c, F.lit(""))

    def entry(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, _ATTR, 1))
        value = F.concat(*[F.coalesce(F.regexp_extract(t, _ATTR, g), F.lit("")) for g in (2, 3, 4)])
        return F.struct(name.alias("key"), let(value, decode_entities).alias("value"))

    def last(entries: Column) -> Column:
        """The last occurrence per name, as an object literal would keep it."""
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])))
    # Bound, so that the tag is not read again for each of its attributes.
    return let(F.transform(F.regexp_extract_all(v, F.lit(_ATTR), 0), entry), last)


def charset_of(content_type: Column, data: Column) -> Column:
    """Charset from the header, else from the first 2048 bytes, else UTF-8 (upper case)."""
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), f"(?i)charset[{WS}]*=[{WS}]*[\"']?([\\w-]+)", 1)
    head = F.decode(F.substring(data, 1, 2048), "ISO-8859-1")
    meta = F.regexp_extract(head, f"(?i)<meta[^>]+charset[{WS}]*=[{WS}]*[\"']?([\\w-]+)", 1)
    return F.upper(F.coalesce(F.nullif(header, F.lit("")), F.nullif(meta, F.lit("")), F.lit("UTF-8")))


def decode_html_bytes(data: Column, content_type: Column) -> Column:
    """Page bytes to text; NULL where the charset is unknown to the branches below."""
    cs = charset_of(content_type, data)
    # Windows-1254 and ISO-8859-9 (Turkish) differ from Latin-1 in six letters only.
    turkish = F.translate(F.decode(data, "ISO-8859-1"), "ÐÝÞðýþ", "ĞİŞğış")
    return (F.when(cs.isin("UTF-8", "UTF8"), F.try_validate_utf8(F.decode(data, "UTF-8")))
            .when(cs.isin("ISO-8859-1", "LATIN1", "WINDOWS-1252", "US-ASCII"), F.decode(data, "ISO-8859-1"))
            .when(cs.isin("ISO-8859-9", "WINDOWS-1254", "LATIN5"), turkish)
            .when(cs.isin("UTF-16", "UTF-16LE"), F.decode(data, "UTF-16LE"))
            .when(cs == "UTF-16BE", F.decode(data, "UTF-16BE")))


# --- sentences ---------------------------------------------------------------------------

# A full stop after one of these does not end a sentence (fixed list).
_ABBREVIATIONS = ("et al", "vd", "ark", "s", "pp", "p", "t", "y", "n", "d", "Dr", "Prof")
_NO_BREAK = "".join(f"(?<!{NOT_AFTER_WORD}{w}\\.)" for w in _ABBREVIATIONS)
_SENTENCE_END = f"(?:(?<=[!?])|(?<=\\.)(?<!{NOT_AFTER_WORD}[A-Z]\\.)(?<![A-Za-z0-9_][ÇĞİÖŞÜ]\\.){_NO_BREAK})(?=[{WS}])"
# Pieces between sentence ends. Splitting at the ends would compile the pattern anew for every text.
_SENTENCE = f"(?s).+?(?:{_SENTENCE_END}|\\z)"


def sentence_slices(c: Column) -> Column:
    """array<struct<text,start,end>>: sentences with 0-based code point offsets.

    ``start``/``end`` cover the untrimmed slice, so every offset of the text belongs to
    exactly one sentence.
    """
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_SENTENCE), 0)

    def located(ps: Column) -> Column:
        return let(F.transform(ps, F.length), lambda n: let(before_each(n), lambda starts: placed(ps, starts)))

    def placed(ps: Column, starts: Column) -> Column:
        def row(p: Column, i: Column) -> Column:
            return F.struct(trim_ws(p).alias("text"), starts[i].alias("start"), (starts[i] + F.length(p)).alias("end"))
        return F.filter(F.transform(ps, row), lambda s: s["text"] != "")
    return let(pieces, located)


def split_sentences(c: Column) -> Column:
    """array<string> of sentences; initials and 'et al.'-like abbreviations do not split."""
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_SENTENCE), 0)
    return F.filter(F.transform(pieces, trim_ws), lambda s: s != "")


def tidy_text(c: Column) -> Column:
    """Repair stray blanks of layout extraction: '(202 5)', '( Fedus', 'feed -forward'."""
    v = F.regexp_replace(c, r"\b((?:19|20)[0-9]) ([0-9])\b", "$1$2")
    v = F.regexp_replace(v, r"\b((?:19|20)[0-9]{2}) ([a-z])\b(?=[)\s,;])", "$1$2")
    v = F.regexp_replace(v, f"\\([{WS}]+", "(")
    v = F.regexp_replace(v, f"[{WS}]+\\)", ")")
    return F.regexp_replace(v, r"(?<=\p{L}) -(?=\p{L})", "-")


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def turkish_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))
