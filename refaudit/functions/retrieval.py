"""Terms, language and small evidence expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, clean_ws, normalize_title, trim_ws

# Function words per language and further retrieval stop words (fixed lists).
TR_WORDS = ("ve bir bu ile için olarak gibi daha olan da de çok ise ancak göre kadar veya ayrıca şekilde "
            "arasında üzerinde").split()
EN_WORDS = "the and of to in that is for with are as this by from were was which their these be or on".split()
EXTRA_STOP = ("have has been also can may not but such than into between using used based study studies paper "
              "results show shows olan olarak cok icin gore kadar ayrica sekilde arasinda uzerinde calisma "
              "calismada calismalar arastirma").split()
STOP_WORDS = sorted(set(TR_WORDS) | set(EN_WORDS) | set(EXTRA_STOP))


def language(c: Column) -> Column:
    """'tr', 'en' or '' from function words and Turkish letters of the first 6000 characters."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 6000)
    words = F.split(F.lower(head), r"[^\p{L}]+")
    tr = F.length(F.regexp_replace(head, "[^ğışİĞŞ]", "")) + F.size(F.filter(words, lambda w: w.isin(TR_WORDS)))
    en = F.size(F.filter(words, lambda w: w.isin(EN_WORDS)))
    return F.when(tr > en, F.lit("tr")).when(en > tr, F.lit("en")).otherwise(F.lit(""))


def number_terms(c: Column) -> Column:
    """``#n`` tokens of the quantities in a text; years are not quantities."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+(?:[.,][0-9]+)?"), 0)
    kept = F.filter(found, lambda n: ~n.rlike("^(?:19|20)[0-9]{2}$"))
    return F.transform(kept, lambda n: F.concat(F.lit("#"), F.replace(n, F.lit(","), F.lit("."))))


def word_terms(normalized: Column) -> Column:
    """Six-letter stems of an already normalised text: longer than two letters, no numbers or stop words."""
    words = F.filter(F.split(normalized, " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    # isin on a literal list compiles to a hash-set lookup.
    kept = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.transform(kept, lambda w: F.substring(w, 1, 6))


def retrieval_terms(c: Column) -> Column:
    """Stems followed by number tokens, with repetitions."""
    return F.concat(word_terms(normalize_title(c)), number_terms(c))


def parse_model_json(c: Column, schema: str) -> Column:
    """JSON object of a model answer: code fences off, else the outermost braces; NULL if unreadable."""
    v = trim_ws(F.coalesce(c, F.lit("")))
    v = F.regexp_replace(F.regexp_replace(v, f"(?i)^```(?:json)?[{WS}]*", ""), f"[{WS}]*```$", "")
    inner = F.regexp_extract(v, r"(?s)(\{.*\})", 1)
    chosen = F.when(F.try_parse_json(v).isNotNull(), v).when(F.try_parse_json(inner).isNotNull(), inner)
    return F.from_json(chosen, schema)


def preprint_notice(texts: Column) -> Column:
    """The 'non-peer reviewed preprint' sentence of the first three passages, at most 500 characters."""
    sample = clean_ws(F.array_join(F.slice(texts, 1, 3), " "))
    return F.substring(trim_ws(F.regexp_extract(sample, r"(?i)(This is an? non-peer reviewed preprint[^.!?]*(?:[.!?]|$))", 1)), 1, 500)


def safe_event_url(c: Column) -> Column:
    """URL without credentials in its query, at most 1200 characters."""
    v = F.coalesce(c, F.lit(""))
    parts = F.split(F.substring_index(F.regexp_replace(v, "(?s)^[^?]*\\??", ""), "#", 1), "&")
    kept = F.filter(parts, lambda p: ~F.substring_index(p, "=", 1).isin("key", "api_key", "access_token"))
    query = F.array_join(kept, "&")
    fragment = F.regexp_extract(v, "(?s)(#.*)$", 1)
    base = F.regexp_replace(v, "(?s)[?#].*$", "")
    rebuilt = F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), fragment)
    has_secret = v.rlike("[?&](key|api_key|access_token)(=|&|#|$)")
    return F.substring(F.when(has_secret, rebuilt).otherwise(v), 1, 1200)


def bm25_weight(weight: Column, tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """One term's contribution: k1 = 1.2, b = .75."""
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))
