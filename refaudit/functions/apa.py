"""Author lists, title casing and APA 7 strings."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import date_label, date_parts
from .text import WS, clean_ws, escape_html, let, normalize_simple, trim_ws, turkish_lower, turkish_upper

AUTHOR = T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "literal")])

# Names kept as written by sentence casing (fixed list).
PROTECTED_NAMES = (
    "SWE-agent", "SWE-bench", "AI", "Türkiye", "Turkey", "Türkçe", "English", "Turkish", "Google Maps", "Google",
    "Flickr", "Airbnb", "TripAdvisor", "YouTube", "Facebook", "OpenAlex", "Crossref", "PubMed", "Europe PMC",
    "OpenLibrary", "Los Angeles", "Hong Kong", "Barcelona", "Konya", "Çatalhöyük", "Beydağları", "Ihlara", "Edirne",
    "Yogyakarta", "Banyumas", "Austria", "Serbia", "Mexico")
# Acronyms kept as written (fixed pattern).
ACRONYMS = r"(?i)^(?:APA|BERT|COVID(?:-19)?|GIS|LISA|MDIVis|TR[0-9]+|IEEE|ERIC|DBLP|CORE|DOI)$"
# Words left in lower case by title casing (fixed list).
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")

_LN = r"\p{L}\p{N}"
_HYPHENATED = f"[{_LN}]+(?:[-’'][{_LN}]+)*"
_PLAIN_WORD = f"[{_LN}]+(?:['’][{_LN}]+)*"


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def initials(given: Column) -> Column:
    """'Jane Mary-Ann' -> 'J. M. A.'."""
    parts = F.filter(F.split(_s(given), f"[{WS}-]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.substring(p, 1, 1), F.lit("."))), " ")


def author_name(a: Column) -> Column:
    """Literal name, else 'Family, G. H.'."""
    def body(i: Column) -> Column:
        return F.when(_s(a["literal"]) != "", a["literal"]).otherwise(
            F.concat(_s(a["family"]), F.when(i != "", F.concat(F.lit(", "), i)).otherwise(F.lit(""))))
    return let(initials(a["given"]), body)


def ampersand_list(names: Column) -> Column:
    """'A, B, & C' ('' for no names)."""
    n = F.size(names)
    return (F.when(n > 1, F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), F.element_at(names, -1)))
            .otherwise(_s(F.try_element_at(names, F.lit(1)))))


def bibliography_authors(authors: Column) -> Column:
    """Author part of an entry: up to twenty names, otherwise nineteen, an ellipsis and the last."""
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast(T.ArrayType(AUTHOR))), author_name), lambda v: v != "")

    def body(ns: Column) -> Column:
        return (F.when(F.size(ns) > 20, F.concat(F.array_join(F.slice(ns, 1, 19), ", "), F.lit(", . . . "), F.element_at(ns, -1)))
                .when(F.size(ns) == 0, F.lit("Yazar bilgisi bulunamadı")).otherwise(ampersand_list(ns)))
    return let(names, body)


def person_apa(name: Column) -> Column:
    """'Jane Mary Smith' -> 'Smith, J. M.'; names with a comma stay."""
    def body(t: Column) -> Column:
        parts = F.split(t, " ")
        first = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.concat(F.substring(p, 1, 1), F.lit(".")))
        return F.when(t.contains(",") | (F.size(parts) < 2), t).otherwise(
            F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(first, " ")))
    return let(clean_ws(name), body)


def sentence_case(title: Column, language: Column | None = None, proper_nouns: tuple[str, ...] = ()) -> Column:
    """Sentence case with English or Turkish letters.

    Protected names, acronyms and mixed case survive; titles already in sentence style keep
    their capitals. A protected name counts where it covers whole words.
    """
    names = sorted({*PROTECTED_NAMES, *proper_nouns}, key=len, reverse=True)
    edge_l, edge_r = f"(?<![{_LN}])(?<![{_LN}][-’'])", f"(?![{_LN}])(?![-’'][{_LN}])"
    alternatives = "|".join(re.escape(n).replace("\\ ", " ") for n in names)
    token = f"(?iu){edge_l}(?:{alternatives}){edge_r}|{_HYPHENATED}|[^{_LN}]+"
    canonical = F.create_map(*[x for n in names for x in (F.lit(n.lower()), F.lit(n))])
    lang = F.lower(_s(language)) if language is not None else F.lit("")

    def convert(s: Column) -> Column:
        t, turkish = s["t"], s["tr"]
        words = F.regexp_extract_all(t, F.lit(_HYPHENATED), 0)
        capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        flags = F.struct(
            (t == F.when(turkish, turkish_upper(t)).otherwise(F.upper(t))).alias("caps"),
            (capitals / F.greatest(F.size(words), F.lit(1)) < 0.45).alias("sentence"))

        def pieces(f: Column) -> Column:
            def one(p: Column) -> Column:
                known = F.try_element_at(canonical, F.lower(p))
                acronym = p.rlike(ACRONYMS) | (~f["caps"] & p.rlike(r"^[\p{Lu}0-9-]{2,8}$"))
                mixed = F.exists(F.split(p, "[-’']"), lambda q: q.rlike(r"\p{Ll}.*\p{Lu}"))
                keep = acronym | mixed | (f["sentence"] & p.rlike(r"^\p{Lu}"))
                lower = F.when(turkish, turkish_lower(p)).otherwise(F.lower(p))
                return F.coalesce(known, F.when(p.rlike(f"^[{_LN}]") & ~keep, lower).otherwise(p))
            return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(token), 0), one), "")

        starts = f"(?:^|[:.!?][{WS}]+|[{WS}][-–—][{WS}]+|[–—][{WS}]*)[^{_LN}]*\\p{{L}}|[{_LN}]+|(?s:.)"

        def raise_first(p: Column, i: Column) -> Column:
            opens = p.rlike(f"^[^{_LN}]*\\p{{L}}$") & ((i == 0) | (F.length(p) > 1))
            last = F.right(p, F.lit(1))
            up = F.when(turkish, turkish_upper(last)).otherwise(F.upper(last))
            return F.when(opens, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), up)).otherwise(p)
        return let(let(flags, pieces), lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit(starts), 0), raise_first), ""))

    cleaned = F.regexp_replace(trim_ws(_s(title)), r"[.]+$", "")
    return let(cleaned, lambda t: let(F.struct(
        t.alias("t"),
        (lang.rlike("^tr(?![0-9a-z_])") | ((lang == "") & t.rlike("[çğıöşüÇĞÖŞÜ]"))).alias("tr")), convert))


def title_case(title: Column) -> Column:
    """Capitalised words, small words lower except at the start or after ``. : ! ?``; AI preserved."""
    def pieces(ps: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            low = F.regexp_replace(F.lower(p), "['’]s$", "’s")
            before = F.when(i > 0, ps[i - 1]).otherwise(F.lit(""))
            is_ai = p.rlike("(?iu)^ai(?:['’]s)?$")
            ai = F.regexp_replace(F.concat(F.lit("AI"), F.substring(p, F.lit(3), F.length(p))), "['’]s$", "’s")
            small = low.isin(*SMALL_WORDS) & (i > 0) & ~before.rlike(f"[.:!?][{WS}]*$")
            return (F.when(~p.rlike(f"^[{_LN}]"), p).when(is_ai, ai).when(small, low)
                    .otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))))
        return F.array_join(F.transform(ps, one), "")
    return let(F.regexp_extract_all(_s(title), F.lit(f"{_PLAIN_WORD}|[^{_LN}]+"), 0), pieces)


def _part(text: Column, italic: bool | Column = False) -> Column:
    flag = F.lit(italic) if isinstance(italic, bool) else italic
    return F.struct(text.alias("text"), flag.alias("italic"))


def _year(w: Column) -> Column:
    return F.when(F.coalesce(w["year"], F.lit(0)) == 0, F.lit("t.y.")).otherwise(w["year"].cast("string"))


def apa_spans(w: Column, proper_nouns: tuple[str, ...] = ()) -> Column:
    """array<struct<text,italic>> of an APA 7 entry for a work struct."""
    def body(s: Column) -> Column:
        title = s["title"]
        book = _s(w["type"]) == "book"
        container, volume, issue, pages = (_s(w[k]) for k in ("container_title", "volume", "issue", "pages"))
        any_source = (container != "") | (volume != "") | (issue != "") | (pages != "")
        journal = ~book & any_source
        lead = F.when(container != "", F.lit(", ")).otherwise(F.lit(""))
        parts = F.array(
            _part(F.concat(bibliography_authors(w["author"]), F.lit(" ("), _year(w), F.lit("). "))),
            _part(title, book),
            _part(F.when(title.rlike("[.!?]$"), F.lit("")).otherwise(F.lit("."))),
            _part(F.when(book & (_s(w["publisher"]) != ""), F.concat(F.lit(" "), w["publisher"], F.lit("."))).otherwise(F.lit(""))),
            _part(F.when(journal, F.lit(" ")).otherwise(F.lit(""))),
            _part(F.when(journal, container).otherwise(F.lit("")), True),
            _part(F.when(journal & (volume != ""), lead).otherwise(F.lit(""))),
            _part(F.when(journal, volume).otherwise(F.lit("")), True),
            _part(F.when(journal & (issue != ""), F.concat(F.lit("("), issue, F.lit(")"))).otherwise(F.lit(""))),
            _part(F.when(journal & (pages != ""), F.concat(
                F.when((container != "") | (volume != "") | (issue != ""), F.lit(", ")).otherwise(F.lit("")), pages)).otherwise(F.lit(""))),
            _part(F.when(journal, F.lit(".")).otherwise(F.lit(""))),
            _part(F.when(_s(w["doi"]) != "", F.concat(F.lit(" https://doi.org/"), w["doi"])).otherwise(F.lit(""))))
        return F.filter(parts, lambda p: p["text"] != "")
    return let(F.struct(sentence_case(w["title"], w["language"], proper_nouns).alias("title")), body)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: p["text"]), "")


def spans_html(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.when(p["italic"], F.concat(F.lit("<em>"), escape_html(p["text"]), F.lit("</em>"))).otherwise(escape_html(p["text"]))), "")


def format_apa(w: Column) -> Column:
    return spans_text(apa_spans(w))


def format_apa_html(w: Column) -> Column:
    return spans_html(apa_spans(w))


def format_crossref_apa(w: Column) -> Column:
    """Title-cased entry with editor and publisher, as the primary index prints it."""
    publisher = F.when(_s(w["publisher"]) != "", w["publisher"]).otherwise(_s(w["container_title"]))
    editors = F.array_join(F.filter(F.transform(
        F.coalesce(w["editor"], F.array().cast(T.ArrayType(AUTHOR))),
        lambda e: F.coalesce(F.nullif(e["family"], F.lit("")), _s(e["literal"]))), lambda v: v != ""), ", ")
    return F.concat(
        bibliography_authors(w["author"]), F.lit(" ("), _year(w), F.lit("). "), title_case(w["title"]),
        F.when(editors != "", F.concat(F.lit(" ("), editors, F.lit(", Ed.).")))
        .when(_s(w["type"]) == "report", F.lit(" (, Ed.).")).otherwise(F.lit(".")),
        F.when(publisher != "", F.concat(F.lit(" "), publisher, F.lit("."))).otherwise(F.lit("")),
        F.when(_s(w["doi"]) != "", F.concat(F.lit(" https://doi.org/"), w["doi"])).otherwise(F.lit("")))


def web_citation(page: Column) -> Column:
    """struct<text,html> of a web entry; ``page`` has title, authors(name,type), published, modified, site, url."""
    title = F.coalesce(F.nullif(page["title"], F.lit("")), F.lit("[Başlık bulunamadı]"))
    names = F.transform(
        F.coalesce(page["authors"], F.array().cast("array<struct<name:string,type:string>>")),
        lambda a: F.when(a["type"] == "Organization", a["name"]).otherwise(person_apa(a["name"])))

    def body(s: Column) -> Column:
        author, shown, date = s["author"], s["title"], s["date"]
        has = author != ""
        same = web_norm_simple(author) == web_norm_simple(page["site"])
        site = F.when(same, F.lit("")).otherwise(_s(page["site"]))
        prefix = F.when(has, F.concat(author, F.lit(" ("), date, F.lit("). "))).otherwise(F.lit(""))
        stop = F.when(shown.rlike("[.!?]$"), F.lit("")).otherwise(F.lit("."))
        suffix = F.concat(F.when(has, stop).otherwise(F.concat(stop, F.lit(" ("), date, F.lit(")."))),
                          F.when(site != "", F.concat(F.lit(" "), site, F.lit("."))).otherwise(F.lit("")), F.lit(" "), _s(page["url"]))
        return F.struct(
            F.concat(prefix, shown, suffix).alias("text"),
            F.concat(escape_html(prefix), F.lit("<em>"), escape_html(shown), F.lit("</em>"), escape_html(suffix)).alias("html"))
    return let(F.struct(ampersand_list(names).alias("author"), title.alias("title"),
                        date_label(F.coalesce(date_parts(page["published"]), date_parts(page["modified"]))).alias("date")), body)


def web_norm_simple(c: Column) -> Column:
    return normalize_simple(clean_ws(c))


def italic_spans(html: Column, text: Column) -> Column:
    """array<struct<text,italic>> of ``<em>`` markup; one plain span where the text differs."""
    pieces = F.split(_s(html), "(?=</?em>)|(?<=<em>)|(?<=</em>)")

    def build(ps: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            value = _decode_basic(p)
            italic = F.coalesce(F.element_at(F.filter(F.concat(F.array(F.lit("</em>")), F.slice(ps, F.lit(1), i)), lambda q: q.isin("<em>", "</em>")), -1) == "<em>", F.lit(False))
            return F.when(~p.isin("<em>", "</em>", ""), F.struct(value.alias("text"), italic.alias("italic")))
        return F.array_compact(F.transform(ps, one))
    return let(let(pieces, build), lambda spans: F.when(spans_text(spans) == text, spans).otherwise(F.array(_part(text))))


def italic_html(html: Column, text: Column) -> Column:
    """HTML of an edited entry: phrases italic in the suggestion stay italic where they survive."""
    phrases = F.transform(F.regexp_extract_all(_s(html), F.lit("(?s)<em>(.*?)</em>"), 1), _decode_basic)

    def basic(c: Column) -> Column:
        for ch, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(ch), F.lit(e))
        return c

    def step(acc: Column, phrase: Column) -> Column:
        at = F.position(phrase, acc["rest"])
        hit = (phrase != "") & (at > 0)
        return F.when(hit, F.struct(
            F.concat(acc["out"], basic(F.substring(acc["rest"], F.lit(1), at - 1)), F.lit("<em>"), basic(phrase), F.lit("</em>")).alias("out"),
            F.substring(acc["rest"], at + F.length(phrase), F.length(acc["rest"])).alias("rest"))).otherwise(acc)
    start = F.struct(F.lit("").alias("out"), _s(text).alias("rest"))
    return F.aggregate(phrases, start, step, lambda a: F.concat(a["out"], basic(a["rest"])))


def _decode_basic(c: Column) -> Column:
    value = F.regexp_replace(c, "<[^>]*>", "")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(ch))
    return value


def restore_year_suffix(suggestion: Column, year: Column, suffix: Column) -> Column:
    """First '(2020)' becomes '(2020a)' where the entry carries a suffix."""
    marker = F.concat(F.lit("("), year.cast("string"), F.lit(")"))

    def body(at: Column) -> Column:
        return F.when((_s(suffix) != "") & (F.coalesce(at, F.lit(0)) > 0), F.concat(
            F.substring(suggestion, F.lit(1), at - 1), F.lit("("), year.cast("string"), suffix, F.lit(")"),
            F.substring(suggestion, at + F.length(marker), F.length(suggestion)))).otherwise(suggestion)
    return let(F.position(marker, suggestion), body)
