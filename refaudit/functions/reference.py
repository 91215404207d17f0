"""Bibliography entries: identifiers, fields, author lists, identity keys."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, YEAR, clean_name, clean_ws, let, name_key_simple,
                   normalize_simple, normalize_title, trim_ws, year_key)

_LETTERS = r"\p{L}'’–-"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def drop_unbalanced_close(c: Column) -> Column:
    """Remove the trailing ``)`` that have no ``(``; closed form instead of a loop."""
    def body(v: Column) -> Column:
        tail = F.length(v) - F.length(F.regexp_replace(v, r"\)+$", ""))
        excess = F.greatest(_count(v, ")") - _count(v, "("), F.lit(0))
        return F.substring(v, F.lit(1), F.length(v) - F.least(tail, excess))
    return let(c, body)


def get_doi(c: Column) -> Column:
    """First DOI in lower case; trailing punctuation and unbalanced brackets dropped; '' if none."""
    found = F.regexp_extract(_text(c), f"{NOT_AFTER_WORD}(10\\.[0-9]{{4,9}}/[^{WS}<>\"]+)", 1)
    return F.lower(drop_unbalanced_close(F.regexp_replace(found, r"[.,;]+$", "")))


def get_arxiv(c: Column) -> Column:
    """arXiv identifier without version, '' if none."""
    return F.regexp_extract(
        _text(c),
        f"(?i)(?:arxiv[{WS}]*:[{WS}]*|arxiv\\.org/(?:abs|pdf)/|10\\.48550/arxiv\\.)([a-z]+[-\\w]*/[0-9]{{7}}|[0-9]{{4}}\\.[0-9]{{4,5}})(?:v[0-9]+)?",
        1)


_ENTRY_YEAR = f"(?is)^(.*?){NOT_AFTER_WORD}((?:18|19|20)[0-9]{{2}})(?=[a-z]?{NOT_BEFORE_WORD})"
_INITIALS_AFTER_NAME = f"^[{_LETTERS}]+[{WS}]+[A-Z]{{1,4}}"


def _first_author(prefix: Column) -> Column:
    vancouver = F.regexp_extract(prefix, f"^([{_LETTERS}]+)[{WS}]+[A-Z]{{1,4}}(?:[{WS}]|[,.])", 1)
    word = F.regexp_extract(prefix, f"^([{_LETTERS}]+)", 1)
    return (F.when(prefix.contains(",") & ~prefix.rlike(_INITIALS_AFTER_NAME + ","), trim_ws(F.substring_index(prefix, ",", 1)))
            .otherwise(F.coalesce(F.nullif(vancouver, F.lit("")), word)))


def parse_reference(c: Column) -> Column:
    """struct<year,doi,title,first_author,arxiv> of one entry.

    Author-date entries take the title between the date and the first sentence end;
    entries without one are read as author list, title, journal, date.
    """
    raw = _text(c)
    no_doi = trim_ws(F.regexp_replace(
        raw, r"(?is)^(.*?)(?:(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?10\.[0-9]{4,9}/\S+)", "$1"))

    # Every intermediate is bound once: inside a lambda nothing else removes common subexpressions.
    def fields(rest: Column) -> Column:
        return let(F.struct(rest.alias("rest"), F.regexp_extract(rest, _ENTRY_YEAR, 1).alias("before"),
                            F.regexp_extract(rest, _ENTRY_YEAR, 2).alias("year")), dated_fields)

    def dated_fields(s: Column) -> Column:
        after = F.substring(s["rest"], F.length(s["before"]) + 5, F.length(s["rest"]))
        after = F.when(s["before"].rlike(f"\\([{WS}]*$"), F.regexp_replace(after, r"^[^)]{0,64}\)", "")).otherwise(after)
        tail = F.when(s["year"] != "", F.regexp_replace(after, f"^[a-z]?[{WS}]*\\)?[.,:]?[{WS}]*", "")).otherwise(F.lit(""))

        def dated(t: Column) -> Column:
            ok = (t != "") & ~t.rlike(f"^[{WS}]*[;:0-9]")
            title = trim_ws(F.regexp_replace(F.split(t, f"\\.[{WS}]+", 2)[0], r"[.]+$", ""))
            authors = trim_ws(F.regexp_replace(s["before"], f"\\([{WS}]*$", ""))
            return let(F.struct(F.when(ok, title).otherwise(F.lit("")).alias("title"), F.when(ok, authors).otherwise(F.lit("")).alias("authors")),
                       lambda d: F.when(d["title"] != "", chosen(s, d["title"], d["authors"])).otherwise(listed_fields(s, d["authors"])))
        return let(tail, dated)

    def listed_fields(s: Column, authors: Column) -> Column:
        def pick(parts: Column) -> Column:
            rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
                            lambda p: ~p.rlike("^[0-9]") & (F.size(F.split(normalize_simple(p), " ")) >= 3))
            title = trim_ws(F.regexp_replace(F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")), r"[.?!]+$", ""))
            several = F.size(parts) > 1
            return chosen(s, F.when(several, title).otherwise(F.lit("")), F.when(several, parts[0]).otherwise(authors))
        return let(F.split(s["rest"], f"\\.[{WS}]+"), pick)

    def chosen(s: Column, title: Column, authors: Column) -> Column:
        return F.struct(F.when(s["year"] != "", s["year"].cast("int")).alias("year"), title.alias("title"),
                        let(F.when(authors != "", authors).otherwise(s["rest"]), _first_author).alias("first_author"))

    def result(ids: Column) -> Column:
        f = ids["fields"]
        doi = F.when(ids["doi"] != "", ids["doi"]).when(ids["arxiv"] != "", F.concat(F.lit("10.48550/arxiv."), ids["arxiv"])).otherwise(F.lit(""))
        return F.struct(f["year"].alias("year"), doi.alias("doi"), f["title"].alias("title"),
                        f["first_author"].alias("first_author"), ids["arxiv"].alias("arxiv"))

    return let(F.struct(let(no_doi, fields).alias("fields"), get_doi(raw).alias("doi"), get_arxiv(raw).alias("arxiv")), result)


_LISTED_AUTHOR = (f"(?:^|[,;&][{WS}]*|{NOT_AFTER_WORD}and[{WS}]+)(\\p{{L}}[\\p{{L}}'’{WS}-]*?),[{WS}]*"
                  f"\\p{{Lu}}(?:\\.|\\p{{Lu}}*(?=[{WS}]*[,;&(]|$))")
_PAREN_DATE = f"(?s)^(.*?\\([{WS}]*)({YEAR})(?=[{WS}]*[,)])"
_PLAIN_YEAR = r"(?s)^(.*?)((?:18|19|20)[0-9]{2}[a-zA-Z]?)"


def reference_identity(c: Column) -> Column:
    """struct<authors,author,year_key,title>: everyone named before the date, the date key, the title.

    A date in parentheses is preferred; initials such as ``N. D.`` are never an undated marker.
    """
    raw = _text(c)
    in_paren = F.regexp_extract(raw, _PAREN_DATE, 2)
    plain = F.regexp_extract(raw, _PLAIN_YEAR, 2)
    prefix = (F.when(in_paren != "", F.regexp_extract(raw, _PAREN_DATE, 1))
              .when(plain != "", F.regexp_extract(raw, _PLAIN_YEAR, 1)).otherwise(raw))
    prefix = trim_ws(F.regexp_replace(prefix, f"\\([{WS}]*$", ""))
    year = F.coalesce(F.nullif(in_paren, F.lit("")), plain)

    def result(p: Column) -> Column:
        listed = F.transform(F.regexp_extract_all(p, F.lit(_LISTED_AUTHOR), 1), trim_ws)
        authors = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.regexp_replace(p, f"[,.({WS}]+$", "")))
        return let(authors, lambda a: F.struct(a.alias("authors"), a[0].alias("author")))
    return let(F.struct(let(prefix, result).alias("a"), year_key(year).alias("y"), parse_reference(raw)["title"].alias("t")),
               lambda s: F.struct(s["a"]["authors"].alias("authors"), s["a"]["author"].alias("author"),
                                  s["y"].alias("year_key"), s["t"].alias("title")))


def aliases(author: Column) -> Column:
    """Names an author or institution may be cited by."""
    a = _text(author)
    abbreviation = F.regexp_extract(a, r"\(([\p{Lu}0-9-]{2,})\)", 1)
    has = abbreviation != ""
    return F.array_compact(F.array(
        a,
        F.when(has, abbreviation),
        F.when(has, F.regexp_replace(a, f"[{WS}]*\\([^)]*\\)", "")),
        F.when(a.rlike(f"(?i)[{WS}]+AI$"), F.regexp_replace(a, f"(?i)[{WS}]+AI$", ""))))


_AUTHOR_SPLIT = f"[{WS}]*(?:,|&|{NOT_AFTER_WORD}ve{NOT_BEFORE_WORD}|{NOT_AFTER_WORD}and{NOT_BEFORE_WORD})[{WS}]*"


def citation_authors(c: Column) -> Column:
    """Normalised names of an in-text author list."""
    parts = F.split(clean_name(c), _AUTHOR_SPLIT)
    names = F.filter(F.transform(parts, name_key_simple), lambda n: n != "")
    # one plain name has nothing to clean, split or fold
    return F.when(c.rlike(r"\A(?!(?:ve|and)\z)[A-Za-z]+\z"), F.array(F.lower(c))).otherwise(names)


def cited_authors(c: Column) -> Column:
    """Family/given pairs before the date; empty unless every given name is initials."""
    prefix = F.split(_text(c), f"(?i)\\([{WS}]*(?:18|19|20)[0-9]{{2}}[a-z]?[{WS}]*\\)", 2)[0]
    prefix = F.regexp_replace(prefix, f",?[{WS}]*&[{WS}]*", ", ")
    parts = F.filter(F.transform(F.split(prefix, f"[{WS}]*,[{WS}]*"), trim_ws), lambda p: p != "")

    def pairs(ps: Column) -> Column:
        n = F.floor(F.size(ps) / 2).cast("int")
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        rows = F.transform(index, lambda i: F.struct(
            ps[i * 2].alias("family"),
            clean_ws(F.replace(ps[i * 2 + 1], F.lit("."), F.lit(" "))).alias("given"),
            ps[i * 2 + 1].rlike(f"^(?:\\p{{L}}\\.(?:[-{WS}]*|$)){{1,8}}$").alias("ok")))
        return F.when(F.forall(rows, lambda r: r["ok"]),
                      F.transform(rows, lambda r: F.struct(r["family"].alias("family"), r["given"].alias("given")))
                      ).otherwise(F.array().cast("array<struct<family:string,given:string>>"))
    return let(parts, pairs)


def publication_keys(c: Column) -> Column:
    """Identity keys of an entry: ``doi:``, ``arxiv:``, ``url:host/path``.

    Scheme, ``www.``, query and trailing slash are ignored; bare home pages and DOI or arXiv
    resolver links are not keys.
    """
    raw = _text(c)
    doi = get_doi(raw)
    arxiv = F.regexp_extract(
        raw, f"(?i)(?:arxiv[{WS}]*:[{WS}]*|arxiv\\.org/(?:abs|pdf)/|10\\.48550/arxiv\\.)([0-9]{{4}}\\.[0-9]{{4,5}})(?:v[0-9]+)?", 1)

    def url_key(u: Column) -> Column:
        v = F.regexp_replace(u, r"[.,;)]*$", "")
        host = F.lower(F.try_parse_url(v, F.lit("HOST")))
        path = F.regexp_replace(F.coalesce(F.try_parse_url(v, F.lit("PATH")), F.lit("")), "/$", "")
        keep = host.isNotNull() & (path != "") & ~host.rlike(r"(?i)doi\.org$|arxiv\.org$")
        return F.when(keep, F.concat(F.lit("url:"), F.regexp_replace(host, r"^www\.", ""), path))
    urls = F.transform(F.regexp_extract_all(raw, F.lit(f"https?://[^{WS}<>]+"), 0), url_key)
    return F.array_distinct(F.array_compact(F.concat(
        F.array(F.when(doi != "", F.concat(F.lit("doi:"), doi)), F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv))),
        urls)))


def reference_title(c: Column) -> Column:
    """Title without a trailing URL and punctuation."""
    v = F.regexp_replace(_text(c), r"(?i)https?://\S+.*$", "")
    return trim_ws(F.regexp_replace(clean_ws(v), r"[.,;:!?]+$", ""))


def normalize_authors(values: Column) -> Column:
    """array<string> names to array<struct<family,given,literal>>; 'Family, Given' is split."""
    def one(name: Column) -> Column:
        split = name.contains(",")
        return F.struct(
            F.when(split, trim_ws(F.substring_index(name, ",", 1))).alias("family"),
            F.when(split, trim_ws(F.regexp_replace(name, "(?s)^[^,]*,", ""))).alias("given"),
            F.when(~split, name).alias("literal"))
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda n: one(_text(n)))


def literal_authors(values: Column) -> Column:
    """array<string> names kept whole; empty names dropped."""
    null = F.lit(None).cast("string")
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda n: _text(n) != ""),
                       lambda n: F.struct(null.alias("family"), null.alias("given"), n.alias("literal")))


def align_arxiv_authors(names: Column, reference: Column) -> Column:
    """Structure full author names with the surnames the entry gives, position by position."""
    def row(cited_all: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            def build(name: Column) -> Column:
                # i+1 beyond the end yields NULL, and with it a NULL family.
                cited = F.try_element_at(cited_all, i + 1)
                whole, family = normalize_simple(name), normalize_simple(cited["family"])
                use = cited.isNotNull() & (family != "") & ((whole == family) | whole.endswith(F.concat(F.lit(" "), family)))
                comma = name.contains(",")
                last = F.element_at(F.split(name, " "), -1)
                spaced = name.contains(" ")
                return F.when(name != "", F.struct(
                    F.when(use, cited["family"]).when(comma, trim_ws(F.substring_index(name, ",", 1))).when(spaced, last).alias("family"),
                    F.when(use, cited["given"]).when(comma, trim_ws(F.regexp_replace(name, "^[^,]*,", "")))
                    .when(spaced, F.substring(name, F.lit(1), F.length(name) - F.length(last) - 1)).alias("given"),
                    F.when(~F.coalesce(use, F.lit(False)) & ~comma & ~spaced, name).alias("literal")))
            return let(clean_ws(value), build)
        return F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), one))
    return let(cited_authors(reference), row)


def route_providers(reference: Column, doi: Column, arxiv: Column, google_books: bool = False) -> Column:
    """Ordered provider ids worth asking about one entry (topic patterns are fixed)."""
    t = F.lower(_text(reference))
    is_arxiv = (_text(arxiv) != "") | t.rlike(
        r"arxiv\.org|arxiv\s*:\s*(?:[a-z]+[-\w]*/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})|10\.48550/arxiv\.")
    turkish = t.rlike(f"[çğıöşü]|{NOT_AFTER_WORD}(?:turkiye|turizm|tarih|ilahiyat){NOT_BEFORE_WORD}")
    medical = t.rlike("pmid|pubmed|medicine|medical|clinical|health|cancer|patient|aspirin|diabetes|hast[aı]|sağlık|tıp")
    computing = t.rlike("learning|computer|neural|algorithm|transformer|attention|acm|ieee|informatics")
    teaching = t.rlike("education|teaching|teacher|student|school|eğitim|öğret|öğrenci")
    no_doi = _text(doi) == ""
    ids = F.array(
        F.when(turkish, F.lit("TR Dizin")), F.when(turkish, F.lit("İSAM")),
        F.when(medical, F.lit("Europe PMC")), F.when(medical, F.lit("PubMed")),
        F.when(computing, F.lit("DBLP")), F.when(teaching, F.lit("ERIC")),
        F.lit("Semantic Scholar"), F.lit("CORE"),
        F.when(no_doi, F.lit("OpenLibrary")), F.when(no_doi & F.lit(google_books), F.lit("Google Books")))
    return F.when(is_arxiv, F.array(F.lit("arXiv"))).otherwise(F.array_compact(ids))


def scholar_query_url(raw: Column) -> Column:
    """Search link from title, first author and year, or from the raw text."""
    def body(p: Column) -> Column:
        query = F.when(p["title"] != "", F.concat_ws(" ", p["title"], F.nullif(p["first_author"], F.lit("")), p["year"].cast("string"))).otherwise(raw)
        return F.concat(F.lit("https://scholar.google.com/scholar?hl=tr&q="), uri_component(query))
    return let(parse_reference(raw), body)


def uri_component(c: Column) -> Column:
    """Percent-encoding of a URI component (blank as %20, ``! ' ( ) * ~`` left alone)."""
    v = F.url_encode(c)
    for old, new in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        v = F.replace(v, F.lit(old), F.lit(new))
    return v


def is_turkish(c: Column) -> Column:
    """Turkish rather than English by function words, ties broken by Turkish letters."""
    def count(low: Column, words: list[str]) -> Column:
        return F.regexp_count(low, F.lit("|".join(rf"{w}(?!\p{{L}})(?<!\p{{L}}{w})" for w in words)))
    # Word lists (fixed).
    tr = ["bir", "bu", "ve", "ile", "için", "olarak", "çalışma", "göre", "bulgular", "sonuçlar", "araştırma"]
    en = ["the", "a", "and", "of", "in", "to", "for", "is", "this", "with", "study", "according"]
    # a text with neither a Turkish letter nor one of the plain Turkish words is not Turkish, whatever else it holds
    plain = "|".join(rf"{w}(?!\p{{L}})(?<!\p{{L}}{w})" for w in tr if w.isascii())

    def decided(low: Column) -> Column:
        n_tr, n_en = count(low, tr), count(low, en)
        return F.when(low.rlike(f"[çğıöşü]|{plain}"), (n_tr > n_en) | ((n_tr == n_en) & _text(c).rlike("[çğıöşüÇĞÖŞÜ]"))).otherwise(F.lit(False))
    return decided(F.lower(_text(c)))


def describe_error(provider: Column, status: Column, message: Column) -> Column:
    """Reader-facing error text: quota, access, or the message itself."""
    return (F.when(status == 429, F.concat(provider, F.lit(": sorgu kotası/hız sınırı (HTTP 429)")))
            .when(status.isin(401, 403), F.concat(provider, F.lit(": erişim reddedildi (HTTP "), status.cast("string"), F.lit(")")))
            .otherwise(message))
