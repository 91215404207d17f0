"""Partial dates, durations and retry delays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_AFTER_WORD, NOT_BEFORE_WORD, clean_ws, let, normalize_simple

# Month names (fixed): January..December and Ocak..Aralık, normalised.
MONTHS_EN = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTHS_TR = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")
MONTH_LABELS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NO_DATE = "(?i)©|copyright|telif|all rights reserved"


def _one_of(names: list[str]):
    return lambda w: w.isin(names)


def date_parts(c: Column) -> Column:
    """struct<year,month,day> or NULL: ISO, dd.mm.yyyy, or a year with an EN/TR month name.

    Copyright lines are never dates; impossible days and months give NULL.
    """
    def body(t: Column) -> Column:
        iso = f"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:T|{NOT_BEFORE_WORD})"
        dmy = f"{NOT_AFTER_WORD}([0-9]{{1,2}})\\.([0-9]{{1,2}})\\.([0-9]{{4}}){NOT_BEFORE_WORD}"
        is_iso, is_dmy = t.rlike(iso), t.rlike(dmy)

        def group(pattern: str, g: int) -> Column:
            return F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).cast("int")

        def month_of(tokens: Column) -> Column:
            month = F.lit(0)
            for i in range(11, -1, -1):
                names = [MONTHS_EN[i], MONTHS_EN[i][:3], MONTHS_TR[i]]
                month = F.when(F.exists(tokens, _one_of(names)), F.lit(i + 1)).otherwise(month)
            return month
        month = F.when(~is_iso & ~is_dmy & t.rlike(r"\p{L}"), let(F.split(normalize_simple(t), " "), month_of)).otherwise(F.lit(0))
        free_year = group(f"{NOT_AFTER_WORD}((?:19|20)[0-9]{{2}}){NOT_BEFORE_WORD}", 1)
        no_year = F.regexp_replace(t, f"(?i){NOT_AFTER_WORD}(?:19|20)[0-9]{{2}}[a-z]?{NOT_BEFORE_WORD}", "")
        free_day = F.nullif(F.regexp_extract(no_year, f"{NOT_AFTER_WORD}([0-9]{{1,2}}){NOT_BEFORE_WORD}", 1), F.lit("")).cast("int")

        def check(d: Column) -> Column:
            y, m = d["year"], d["month"]
            # Without a month name a free-form date has no day either.
            dd = F.when(d["strict"] | (m > 0), d["day"]).otherwise(F.lit(0))
            full = F.lpad(y.cast("string"), 4, "0")
            real = F.try_to_date(F.concat(full, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(dd.cast("string"), 2, "0"))).isNotNull()
            strict_ok = ~d["strict"] | ((m > 0) & (dd > 0))
            ok = (F.coalesce(y, F.lit(0)) > 0) & (m <= 12) & (dd <= 31) & strict_ok & ((m == 0) | (dd == 0) | real) & ~t.rlike(NO_DATE)
            return F.when(F.coalesce(ok, F.lit(False)), F.struct(y.alias("year"), F.nullif(m, F.lit(0)).alias("month"), F.nullif(dd, F.lit(0)).alias("day")))
        return let(F.struct(
            F.when(is_iso, group(iso, 1)).when(is_dmy, group(dmy, 3)).otherwise(free_year).alias("year"),
            F.when(is_iso, group(iso, 2)).when(is_dmy, group(dmy, 2)).otherwise(month).alias("month"),
            F.when(is_iso, group(iso, 3)).when(is_dmy, group(dmy, 1)).otherwise(
                F.coalesce(free_day, F.lit(0))).alias("day"), (is_iso | is_dmy).alias("strict")), check)
    return let(clean_ws(c), body)


def date_label(d: Column) -> Column:
    """'2025, August 4', '2025, August', '2025' or the undated marker."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), d["month"])
    return F.when(d.isNull(), F.lit("t.y.")).otherwise(F.concat(
        d["year"].cast("string"),
        F.when(d["month"].isNotNull(), F.concat(F.lit(", "), month, F.coalesce(F.concat(F.lit(" "), d["day"].cast("string")), F.lit("")))).otherwise(F.lit(""))))


def parts_conflict(a: Column, b: Column) -> Column:
    """Both dates known and different in a part both of them state."""
    differs = F.lit(False)
    for k in ("year", "month", "day"):
        differs = differs | F.coalesce(a[k] != b[k], F.lit(False))
    return a.isNotNull() & b.isNotNull() & differs


def http_date(c: Column) -> Column:
    """RFC 1123 date to TIMESTAMP, NULL if it is not one.

    The weekday is redundant and rejected by the formatter's strict mode, so it is dropped.
    """
    body = F.regexp_extract(c, "^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1)
    return F.try_to_timestamp(F.nullif(body, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss"))


def _epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def duration_ms(c: Column, now: Column) -> Column:
    """Seconds, ``1h2m3s`` or an HTTP date as milliseconds from ``now``; NULL otherwise."""
    def body(t: Column) -> Column:
        hms = "(?i)^(?:([0-9]+(?:\\.[0-9]+)?)h)?(?:([0-9]+(?:\\.[0-9]+)?)m)?(?:([0-9]+(?:\\.[0-9]+)?)s)?$"

        def part(g: int) -> Column:
            return F.coalesce(F.nullif(F.regexp_extract(t, hms, g), F.lit("")).cast("double"), F.lit(0.0))
        return (F.when(t.rlike("^[0-9]+(\\.[0-9]+)?$"), t.try_cast("double") * 1000)
                .when((t != "") & t.rlike(hms), (part(1) * 3600 + part(2) * 60 + part(3)) * 1000)
                .otherwise((_epoch_ms(http_date(t)) - _epoch_ms(now)).cast("double")))
    return let(F.trim(F.coalesce(c, F.lit(""))), body)


def retry_delay_ms(header: Column, attempts: Column, now: Column) -> Column:
    """Wait before the next request: the header (at least 1 s) or exponential back-off up to 15 min."""
    def body(t: Column) -> Column:
        stated = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint") * 1000).when(t != "", _epoch_ms(http_date(t)) - _epoch_ms(now))
        backoff = F.least(F.lit(900000), F.lit(60000) * F.pow(F.lit(2), F.least(attempts, F.lit(4)))).cast("bigint")
        return F.coalesce(F.when(stated.isNotNull(), F.greatest(F.lit(1000).cast("bigint"), stated)), backoff)
    return let(F.trim(F.coalesce(header, F.lit(""))), body)


def web_retry_at_ms(header: Column, now: Column) -> Column:
    """Retry time for a web page: header seconds or date (at least 1 s), else one minute."""
    def body(t: Column) -> Column:
        stated = F.when(t.rlike("^[0-9]+(\\.[0-9]+)?$"), t.try_cast("double") * 1000).otherwise((_epoch_ms(http_date(t)) - _epoch_ms(now)).cast("double"))
        return (_epoch_ms(now) + F.when(stated.isNull(), F.lit(60000.0)).otherwise(F.greatest(F.lit(1000.0), stated))).cast("bigint")
    return let(F.coalesce(header, F.lit("")), body)
