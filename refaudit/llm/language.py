"""Language identification (operator 4): Bayesian fusion of text, declared language, address suffix and host priors."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.llm.common import shield, shielded, table
from refaudit.session import stage_table

LANGUAGES = ("en", "fr", "de", "es")
#: Different labelled texts per language that the text model is fitted on, the smallest by hash. Everything else covers all rows.
SAMPLE = 3000
#: Hashed character trigrams in the text model.
GRAMS = 1 << 15
#: Weight of a parent's distribution in a child's, in documents.
STRENGTH = 5.0
#: Prior share of "none of the languages", whose text model is uniform.
OTHER = 0.001
#: Hosts up to this number are broadcast; more are joined by shuffle, salted.
FEW_HOSTS = 100_000
SALTS = 16
#: Parts that each language's rows are split into when the sample is drawn.
PARTS = 64
BLOCK = 1 << 19


def gram_codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of the lower-cased letters of all texts in a row, and their number per text.

    ASCII signs and digits count as blanks; a trigram may touch one blank but not two in a row.
    """
    codes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        raw = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
        blank = (raw < 97) | ((raw > 122) & (raw < 128))
        raw = np.where(blank, 32, raw).astype(np.uint32)
        blanks = blank[:-2].astype(np.int8) + blank[1:-1] + blank[2:]
        code = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
        code = code[blanks <= 1] if len(text or "") < 3 else code[(blanks == 0) | ((blanks == 1) & ~blank[1:-1])]
        codes.append(code)
        counts[i] = len(code)
    return (np.concatenate(codes) if codes else np.empty(0, np.uint32)).astype(np.int64), counts


def _runs(texts: pd.Series):
    """Rows in runs of bounded text size."""
    ends = np.cumsum(texts.str.len().fillna(0).to_numpy())
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield at, stop
        at = stop


def fit_text_model(labelled: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log-probability of each trigram (rows) under each language and, last, under none (uniform).

    ``labelled(text, label)``: the ``sample`` different texts per language with the smallest hashes are counted; what reaches the
    driver is one count per trigram code and language. A language without labels is uniform as well.
    """
    known = labelled.filter(F.col("label").isin(*languages) & F.col("text").isNotNull()).withColumn("_hash", F.xxhash64("text"))
    ranked = known.select("label", "_hash", F.pmod("_hash", F.lit(PARTS)).alias("_salt")).distinct()
    for keys in (["label", "_salt"], ["label"]):  # the first of each part, then of those: no task orders a whole language
        ranked = ranked.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))).filter(F.col("_turn") <= sample)
    last = ranked.groupBy("label").agg(F.max("_hash")).collect()  # one row per language; only hashes were shuffled so far
    inside = F.lit(False)
    for label, limit in last:
        inside = inside | ((F.col("label") == label) & (F.col("_hash") <= limit))
    chosen = known.filter(inside).groupBy("label", "_hash").agg(F.first("text").alias("text"))

    def count(batches):
        for rows in batches:
            for label, texts in rows.groupby("label")["text"]:
                for at, stop in _runs(texts):
                    codes, _ = gram_codes(texts.iloc[at:stop].tolist())
                    found, n = np.unique(codes, return_counts=True)
                    yield pd.DataFrame({"label": label, "code": found, "n": n})

    counts = chosen.select("label", "text").mapInPandas(count, "label string, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    model = np.full((GRAMS, len(languages) + 1), -np.log(GRAMS))
    for i, language in enumerate(languages):
        own = counts[counts["label"] == language]
        if len(own):
            n = np.bincount(own["code"], own["n"], GRAMS)
            model[:, i] = np.log((n + 0.5) / (n.sum() + 0.5 * GRAMS))
    return model.astype(np.float32)


def text_likelihoods(texts: pd.Series, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x classes) log-likelihoods and the number of trigrams. A byte is seen by three trigrams, so a third of their sum counts."""
    out, counts = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts), np.int64)
    for at, stop in _runs(texts):
        codes, n = gram_codes(texts.iloc[at:stop].tolist())
        counts[at:stop] = n
        some = np.flatnonzero(n)
        if len(some):
            out[at + some] = np.add.reduceat(model[codes], (np.cumsum(n) - n)[some], axis=0, dtype=np.float64) / 3
    return out, counts


def declared_language(value: Column) -> Column:
    """Primary part of a declared language tag, lower case: en-GB gives en."""
    return F.lower(F.regexp_extract(value, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def markup_language(html: Column) -> Column:
    """The language that the page's first html tag declares, wherever it stands; NULL if none."""
    tag = F.regexp_extract(html, r"(?i)<html\b([^<>]*+)", 1)
    return F.nullif(F.regexp_extract(tag, r"(?i)\blang\s*+=\s*+[\"']?([A-Za-z-]+)", 1), F.lit(""))


def address_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _levels(host: Column) -> list[tuple[str, Column]]:
    """Address suffix, domain and host; names without a dot have a host level only."""
    dotted = F.when(F.contains(host, F.lit(".")), host)
    return [("_suffix", F.substring_index(dotted, ".", -1)), ("_domain", F.substring_index(dotted, ".", -2)), ("_host", host)]


def host_priors(evidence: DataFrame, classes: int) -> tuple[DataFrame, list[float]]:
    """``(_host, prior)`` and the prior of rows without a host, from ``evidence(_suffix, _domain, _host, best, n)``.

    Counts are summed per level; each level's shares are pulled to its parent's by ``STRENGTH`` documents: all rows, address
    suffix, domain, host.
    """
    sums = [F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(classes)]
    counts = evidence.agg(*sums).first()
    total = sum(x or 0 for x in counts)
    flat = [(1 - OTHER) / (classes - 1)] * (classes - 1) + [OTHER]
    world = [((c or 0) + STRENGTH * p) / (total + STRENGTH) for c, p in zip(counts, flat, strict=True)]

    def pulled(parent: Column) -> Column:
        whole = sum((F.col(f"c{i}") for i in range(classes)), F.lit(STRENGTH))
        return F.array(*[(F.col(f"c{i}") + STRENGTH * parent[i]) / whole for i in range(classes)])

    world_prior = F.array(*[F.lit(float(x)) for x in world])
    suffix = evidence.filter("_suffix IS NOT NULL").groupBy("_suffix").agg(*sums).select("_suffix", pulled(world_prior).alias("p1"))
    domain = evidence.filter("_domain IS NOT NULL").groupBy("_domain").agg(F.first("_suffix").alias("_suffix"), *sums).join(suffix, "_suffix").select("_domain", pulled(F.col("p1")).alias("p2"))
    host = evidence.filter("_host IS NOT NULL").groupBy("_host").agg(F.first("_domain").alias("_domain"), *sums).join(domain, "_domain", "left")
    return host.withColumn("p2", F.coalesce("p2", world_prior)).select("_host", pulled(F.col("p2")).alias("prior")), world


def identify(docs: DataFrame, text: Column, declared: Column, host: Column, label: Column | None = None, languages: tuple[str, ...] = LANGUAGES, accept: tuple[str, ...] | None = None,
             sample: int = SAMPLE, few_hosts: int = FEW_HOSTS) -> DataFrame:
    """``docs`` with ``language``, ``probability``, ``grams`` and ``accepted``.

    Posterior of each language and of none: text likelihood x P(declared | language) x prior of the host. The text model is
    fitted on a bounded sample of labelled rows (``label``, the declared language unless given). The declared language's
    reliability and the host priors are grouped counts over all rows of what the text alone says. Counts by host combine in
    each task, so a host with a third of all rows is one row per task; priors reach the rows by broadcast if there are at most
    ``few_hosts`` hosts, else by a salted join.

    A row is rejected if its text has no trigram of letters, if none of the languages is likelier than not, or if its language is
    not in ``accept`` (all by default). A text whose two likeliest classes tie by its trigrams counts as no evidence for
    reliability and priors; of equal posteriors the first language is named, and rejected. NULL or empty texts are rejected with language NULL; NULL, unknown or malformed
    declarations and NULL hosts are neutral; repeated rows each count; an empty table gives an empty result; without any
    labelled row no text can be told from another and none is accepted; a column of the input with one of the added names is
    replaced.
    """
    added = ("language", "probability", "grams", "accepted")
    plain, _, restore = shield(docs, added)
    own = [c for c in docs.columns if c.lower() not in added]
    used = (("_text", text), ("_declared", declared), ("_named", host), ("_label", declared if label is None else label))
    docs = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(own, plain.columns, strict=True)], *[c.alias(n) for n, c in used])
    text, declared, host, label = (F.col(n) for n, _ in used)
    spark, classes = docs.sparkSession, len(languages) + 1
    labelled = docs.select(text.alias("text"), declared_language(label).alias("label"))
    model = spark.sparkContext.broadcast(fit_text_model(labelled, languages, sample))

    @F.pandas_udf("int")
    def text_class(texts: pd.Series) -> pd.Series:
        likely, n = text_likelihoods(texts, model.value)
        second, first = np.partition(likely, -2, axis=1)[:, -2:].T
        return pd.Series(np.where((n > 0) & (first > second), likely.argmax(axis=1), -1))  # a tie is no evidence

    said = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in languages]), declared_language(declared)).cast("int"), F.lit(0)) - 1  # -1: nothing usable
    evidence = docs.select(*[c.alias(n) for n, c in _levels(host)], said.alias("said"), text_class(text).alias("best"))
    evidence = stage_table(evidence.groupBy("_suffix", "_domain", "_host", "said", "best").agg(F.count("*").alias("n")), "language-evidence").filter("best >= 0")  # a filter before would run the model twice
    priors, world = host_priors(evidence, classes)
    priors = stage_table(priors, "language-priors")

    table_ = np.full((classes, classes), 1.0)  # (said, class); at most this many rows come back
    for said_, best, n in evidence.filter("said >= 0").groupBy("said", "best").agg(F.sum("n")).collect():
        table_[said_, best] += n
    reliability = np.zeros((classes, classes))
    reliability[:-1] = np.log(table_[:-1] / table_[:-1].sum(axis=0))  # the last row, reached by -1, is neutral

    @F.pandas_udf("language string, probability double, grams long, accepted boolean")
    def fuse(texts: pd.Series, says: pd.Series, prior: pd.Series) -> pd.DataFrame:
        likely, n = text_likelihoods(texts, model.value)
        score = likely + reliability[says.to_numpy()] + np.log(np.stack(prior.to_numpy())) if len(texts) else likely
        share = np.exp(score - score.max(axis=1, keepdims=True)) if len(texts) else score
        share = share / share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        names = np.array([*languages, None], object)
        language = np.where(n > 0, names[best], None)
        good = (n > 0) & (best < classes - 1) & (share.max(axis=1) > 0.5)
        return pd.DataFrame({"language": language, "probability": share.max(axis=1), "grams": n, "accepted": good & np.isin(language.astype(str), list(accept or languages))})

    rows = docs.withColumn("_host", host).withColumn("_said", said)
    if priors.count() <= few_hosts:
        rows = rows.join(F.broadcast(priors), "_host", "left")
    else:
        salt = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("_salt", salt).join(priors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_salt"], "left")
    prior = F.coalesce("prior", F.array(*[F.lit(float(x)) for x in world]))
    fused = rows.withColumn("_fused", fuse(text, F.col("_said"), prior))
    return restore(fused.select("*", *[F.col(f"_fused.{a}").alias(a) for a in added]))


def known_language(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", **options) -> DataFrame:
    """The accepted rows, with the columns of ``docs``."""
    def work(plain: DataFrame, text: str, declared: str, host: str) -> DataFrame:
        return identify(plain, F.col(text), F.col(declared), F.col(host), **options).filter("accepted")
    return shielded(docs, work, text=text, declared=declared, host=host)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify(docs, F.col("text"), F.col("lang"), F.col("source")).select("doc_id", "language", "probability", "grams", "accepted")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
