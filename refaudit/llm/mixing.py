"""Mixing sources to target weights (operator 10): entropy balancing with token constraints."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.llm.common import WORD, global_index, shield, shielded, table
from refaudit.session import stage_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SALTS = 64
TOLERANCE = 1e-7
MOST_STEPS = 200


def word_count(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target`` to ``sources(_source, source_size)``.

    The sources in code-point order (NULL last) take the weights in turn and share the total size. A target
    stops at ``most`` times its source's size and the excess is shared again by weight until none is above;
    only the scalars of each round reach the driver.
    """
    numbered = global_index(sources, [F.col("_source")], "_turn", "mix-turn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    weighed = stage_table(numbered.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(rate) * F.col("_weight")
        row = weighed.agg(F.count_if(over), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, rate = row[0], (total - (row[1] or 0)) / row[2]
    return weighed.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(rate) * F.col("_weight"))).drop("_turn", "_weight", "_cap")


def tilt(sizes: DataFrame, sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Solve the dual: one multiplier per source such that the tilted rates take its target.

    ``sizes(_source, size, docs)`` counts documents; ``sources`` has ``target`` and ``largest``. A document's rate is
    ``most * q / (q + most - 1)`` with ``q = exp(m * size / largest)``: the entropy-minimal change of the rate 1 that stays
    below ``most``. The taken words grow with ``m``, so each source has one root. Every Newton step is one grouped
    aggregation over the size counts; a step that leaves the bracket found so far is replaced by its middle. The
    multipliers are written to the shared folder after each step. Raises if ``MOST_STEPS`` steps do not meet every target.
    """
    state = stage_table(sources.select("_source", "target", "largest", F.lit(0.0).alias("m"), F.lit(-1e12).alias("low"), F.lit(1e12).alias("high"), F.lit(False).alias("done")), "mix-dual")
    x = F.col("size") / F.col("largest")
    rate = F.lit(float(most)) / (1 + (most - 1) * F.exp(-F.col("m") * x))
    words = F.col("docs") * F.col("size") * rate
    for _ in range(MOST_STEPS):
        active = state.filter("NOT done")
        sums = sizes.join(active, "_source").groupBy("_source").agg(F.sum(words).alias("_taken"), F.sum(words * x * (1 - rate / most)).alias("_slope"))
        step = state.join(sums, "_source", "left")
        gap = F.col("_taken") - F.col("target")
        low = F.when(gap < 0, F.col("m")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("m")).otherwise(F.col("high"))
        newton = F.when(F.col("_slope") > 0, F.col("m") - gap / F.col("_slope"))
        middle = F.when(low < -1e11, F.least(F.lit(-1.0), high * 4)).when(high > 1e11, F.greatest(F.lit(1.0), low * 4)).otherwise((low + high) / 2)
        move = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        near = F.col("done") | F.col("_taken").isNull() | (F.abs(gap) <= TOLERANCE * F.col("target")) | (F.abs(F.col("m")) > 1e10)
        state = stage_table(step.select("_source", "target", "largest", F.when(near, F.col("m")).otherwise(move).alias("m"), F.when(near, F.col("low")).otherwise(low).alias("low"),
                                        F.when(near, F.col("high")).otherwise(high).alias("high"), near.alias("done")), "mix-dual")
        if state.filter("NOT done").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"the mix has not met every source's target after {MOST_STEPS} steps")
    return sizes.join(state.select("_source", "target", "m", "largest"), "_source").withColumn("_rate", F.round(rate, 9)).drop("m", "largest")


def _whole_copies(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Round one source's rates, largest documents first; what a size takes too much or too little moves on to the next.

        Holds one row per distinct document size of the source, not its documents.
        """
        rows = rows.sort_values("size", ascending=False)
        carry, copies = 0.0, np.zeros(len(rows), np.int64)
        for i, (size, docs, rate) in enumerate(zip(rows["size"].to_numpy(), rows["docs"].to_numpy(), rows["_rate"].to_numpy(), strict=True)):
            wish = docs * size * rate + carry
            copies[i] = min(max(int(np.floor(wish / size + 0.5)), 0), most * docs) if size else docs
            carry = wish - copies[i] * size
        return rows.assign(_all=copies)[["_source", "size", "target", "docs", "_all"]]
    return run


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, salts: int = SALTS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words taken, repeats counted).

    Sizes are word counts. The rates that meet each source's target are found on the counts of (source, size), rounded
    there to whole copies, and dealt to the documents of that size: each gets the same number, the first ones by a hash of
    ``doc_id`` one more. Their rank is the rank inside one of ``salts`` parts plus the number of rows in the parts before, so
    a group of copies or a hot source is ordered in many tasks; rows without id are dealt to parts and ordered by a hash of their text. Nothing is random: reruns agree.

    NULL text has size 0; a document of size 0 is taken once (no words). NULL is a source of its own, the last one. Repeated
    rows count each. An empty table gives an empty result; a column of the input with one of the added names is replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs, named, restore = shield(docs, added)
    text, source, doc_id = named(text), named(source), named(doc_id)
    group = F.when(F.col(source).isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col(source)))  # NULL last by code point
    # NULL adds nothing to a hash. Computed before the join, so that a caller who drops the text does not shuffle it.
    unnamed = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text)))
    part = F.pmod(F.xxhash64(F.col(doc_id), F.col("_unnamed"), F.lit(1)), F.lit(salts))
    rows = docs.withColumn("_source", group).withColumn("size", word_count(F.col(text))).withColumn("_unnamed", unnamed).withColumn("_part", part)
    parts = stage_table(rows.groupBy("_source", "size", "_part").agg(F.count("*").alias("_rows")), "mix-sizes")
    sizes = stage_table(parts.groupBy("_source", "size").agg(F.sum("_rows").alias("docs")), "mix-sizes")
    sources = sizes.groupBy("_source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.max("size").alias("_largest"))
    targets = stage_table(source_targets(sources, weights, most).withColumnRenamed("_largest", "largest"), "mix-targets")
    rated = tilt(sizes, targets.withColumn("largest", F.greatest("largest", F.lit(1))), most)
    whole = rated.groupBy("_source").applyInPandas(_whole_copies(most), "_source string, size long, target double, docs long, _all long")
    before = Window.partitionBy("_source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(whole, ["_source", "size"]).join(targets.select("_source", "source_size"), "_source")
    plan = plan.select("_source", "size", "_part", "_before", "source_size", "target", F.expr("_all div docs").alias("_each"), (F.col("_all") % F.col("docs")).alias("_more"))
    plan = stage_table(plan, "mix-plan")
    rank = F.row_number().over(Window.partitionBy("_source", "size", "_part").orderBy(F.xxhash64(F.col(doc_id), F.lit(2)), F.col(doc_id), F.col("_unnamed")))
    out = rows.join(plan, ["_source", "size", "_part"]).withColumn("_rank", rank + F.col("_before"))
    copies = F.col("_each") + F.when(F.col("_rank") <= F.col("_more"), 1).otherwise(0)
    return restore(out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    def work(plain: DataFrame, **names: str) -> DataFrame:
        taken = mix_sources(plain, **names, **options).filter("copies > 0")
        return taken.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return shielded(docs, work, text=text, source=source, doc_id=doc_id)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
