"""URL tests, web entry parsing and page field expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import date_parts
from .reference import drop_unbalanced_close
from .text import WS, clean_ws, html_text, let, plain_text, trim_ws


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


_MARKDOWN = f"(?is)^(.*?)\\[[^\\]]*\\]\\((https?://[^{WS}]+)\\)"
_PLAIN = f"(?is)^(.*?)(https?://[^{WS}<>\\]]+)"
_DATED = f"(?is)^(.*?)[{WS}]*\\(([^)]*(?:[0-9]{{4}}|t\\.y\\.|n\\.d\\.)[^)]*)\\)[{WS}]*\\.?[{WS}]*(.*)$"


def parse_web_reference(c: Column) -> Column:
    """struct<url,author,date,date_text,title> of a web entry; NULL without a URL or for a DOI link."""
    raw = _s(c)

    def body(s: Column) -> Column:
        before, url = s["before"], s["url"]
        dated = before.rlike(_DATED)
        date_text = F.when(dated, F.regexp_extract(before, _DATED, 2)).otherwise(F.lit(""))
        title = F.when(dated & (F.regexp_extract(before, _DATED, 3) != ""), F.regexp_extract(before, _DATED, 3)).otherwise(before)
        author = F.when(dated, F.regexp_extract(before, _DATED, 1)).otherwise(F.lit(""))
        return F.when((url != "") & ~url.rlike(r"(?i)^https?://(?:dx\.)?doi\.org/"), F.struct(
            url.alias("url"), F.regexp_replace(clean_ws(author), r"\.$", "").alias("author"),
            date_parts(date_text).alias("date"), date_text.alias("date_text"),
            F.regexp_replace(clean_ws(title), f"[.{WS}]+$", "").alias("title")))
    is_md = raw.rlike(_MARKDOWN)
    before = F.when(is_md, F.regexp_extract(raw, _MARKDOWN, 1)).otherwise(F.regexp_extract(raw, _PLAIN, 1))
    url = F.when(is_md, F.regexp_extract(raw, _MARKDOWN, 2)).otherwise(F.regexp_extract(raw, _PLAIN, 2))
    url = drop_unbalanced_close(F.regexp_replace(url, "[.,;]+$", ""))
    return let(F.struct(clean_ws(before).alias("before"), url.alias("url")), body)


def reference_url(c: Column) -> Column:
    """Best URL of an entry: the web link, else any https link; '' if none."""
    raw = _s(c)
    md = F.regexp_extract(raw, f"(?i)\\[[^\\]]*\\]\\((https://[^{WS})]+)\\)", 1)
    plain = F.regexp_extract(raw, f"(?i)https://[^{WS}<>\\]]+", 0)
    fallback = F.regexp_replace(drop_unbalanced_close(F.coalesce(F.nullif(md, F.lit("")), plain)), "[.,;]+$", "")
    return F.coalesce(parse_web_reference(raw)["url"], fallback)


def url_origin(u: Column) -> Column:
    """scheme://host[:port] in lower case with default ports dropped."""
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    authority = F.lower(F.regexp_replace(F.try_parse_url(u, F.lit("AUTHORITY")), "^[^@]*@", ""))
    port = F.when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
    return F.concat(scheme, F.lit("://"), F.when(authority.endswith(port), F.regexp_replace(authority, ":[0-9]+$", "")).otherwise(authority))


def url_path(u: Column) -> Column:
    return F.regexp_replace(_s(F.try_parse_url(u, F.lit("PATH"))), "/$", "")


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of an href; relative paths are joined to the base directory."""
    h = trim_ws(_s(href))
    directory = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^/])/[^/]*$", "")
    scheme = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit(":"))
    return (F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, h))
            .when(h.startswith("/"), F.concat(url_origin(base), h))
            .when(h.startswith("?") | (h == "") | h.startswith("#"), F.concat(F.regexp_replace(base, "[?#].*$", ""), h))
            .otherwise(F.concat(directory, F.lit("/"), h)))


def same_page(a: Column, b: Column) -> Column:
    """Equal origin, path without trailing slash, and query."""
    x = resolve_url(a, b)
    query = lambda u: _s(F.try_parse_url(u, F.lit("QUERY")))
    return F.coalesce((url_origin(x) == url_origin(b)) & (url_path(x) == url_path(b)) & (query(x) == query(b)), F.lit(False))


def valid_http_url(u: Column) -> Column:
    """http(s), no credentials, no explicit port, at most 8000 characters."""
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    host, authority = F.try_parse_url(u, F.lit("HOST")), F.try_parse_url(u, F.lit("AUTHORITY"))
    default = F.when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
    bare = F.when(authority.endswith(default), F.regexp_replace(authority, ":[0-9]+$", "")).otherwise(authority)
    return F.coalesce(scheme.isin("http", "https") & (_s(host) != "") & ~bare.contains("@")
                      & ~F.regexp_replace(bare, r"^\[[^\]]*\]", "").contains(":") & (F.length(u) <= 8000), F.lit(False))


def h1_text(html: Column) -> Column:
    return plain_text(F.regexp_extract(_s(html), f"(?is)<h1(?![0-9a-z_])[^>]*>(.*?)</h1[{WS}]*>", 1))


def title_text(html: Column) -> Column:
    return plain_text(F.regexp_extract(_s(html), f"(?is)<title(?![0-9a-z_])[^>]*>(.*?)</title[{WS}]*>", 1))


_FURNITURE = "script|style|noscript|svg|nav|header|footer|aside|form|dialog"
_BLOCK = f"(?is)<(?:p|h[1-6]|li|blockquote)(?![0-9a-z_])[^>]*>(.*?)</(?:p|h[1-6]|li|blockquote)[{WS}]*>"
# Openings of page furniture blocks (fixed pattern).
NOISE = "(?i)^(cookie|accept all|sign in|subscribe|advertisement)(?![0-9a-z_])"


def keep_blocks(blocks: Column) -> Column:
    """Text blocks of at least 25 characters that are not page furniture."""
    return F.filter(blocks, lambda b: (F.length(b) >= 25) & ~b.rlike(NOISE))


def main_text(html: Column) -> Column:
    """Body text of a page: article, main or body area without furniture, blocks joined by newlines."""
    h = _s(html)

    def area(tag: str) -> Column:
        return F.nullif(F.regexp_extract(h, f"(?is)<{tag}(?![0-9a-z_])[^>]*>(.*?)</{tag}[{WS}]*>", 1), F.lit(""))
    chosen = F.coalesce(area("article"), area("main"), area("body"), h)
    clean = F.regexp_replace(chosen, f"(?is)<({_FURNITURE})(?![0-9a-z_])[^>]*>.*?</\\1[{WS}]*>", " ")
    blocks = keep_blocks(F.transform(F.regexp_extract_all(clean, F.lit(_BLOCK), 1), html_text))
    return F.substring(html_text(F.array_join(blocks, "\n\n")), 1, 500000)


def pack_paragraphs(text: Column, width: int = 4000) -> Column:
    """array<string>: paragraphs packed greedily up to ``width`` characters per chunk.

    Fixing the chunk of each paragraph needs a running reset sum, so the aggregate carries
    only (chunk number, size) pairs; the texts are joined per chunk afterwards.
    """
    parts = F.filter(F.split(_s(text), r"\n{2,}"), lambda p: p != "")

    def pack(ps: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            open_ = acc["size"] > 0
            full = open_ & (acc["size"] + n > width)
            number = F.when(full, acc["number"] + 1).otherwise(acc["number"])
            size = F.when(full, n).when(open_, acc["size"] + 2 + n).otherwise(n)
            return F.struct(number.alias("number"), size.alias("size"), F.array_append(acc["of"], number).alias("of"))
        start = F.struct(F.lit(0).alias("number"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("of"))
        of = F.aggregate(F.transform(ps, F.length), start, step, lambda a: a["of"])

        def join(nums: Column) -> Column:
            tagged = F.arrays_zip(ps.alias("p"), nums.alias("n"))
            last = F.coalesce(F.array_max(nums), F.lit(-1))
            return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(
                F.transform(F.filter(tagged, lambda t: t["n"] == k), lambda t: t["p"]), "\n\n"))).otherwise(F.array().cast("array<string>"))
        return let(of, join)
    return let(parts, pack)


def is_blocked_title(title: Column, body_length: Column) -> Column:
    """Access, error or login page by its title, or no title and under 80 characters of text."""
    return ((_s(title) == "") & (body_length < 80)) | _s(title).rlike(
        "(?i)^(just a moment|access denied|attention required|page not found|404|sign in|log in|verify you are human)")
