"""Small helpers shared by the training-data operators."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refaudit.session import checkpoint_dir

#: Blank characters: words are runs of anything else. ``bytes.split()`` cuts at exactly these.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shield(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """Hide a table's column names while an operator works, so that none can clash with the operator's own.

    Returns the table with plain numbered names, the new name of an old one, and the way back: all old columns under their
    names, then ``added`` (old columns of those names are left out).
    """
    docs = docs.drop(*added)
    inner = [f"in{i}" for i in range(len(docs.columns))]
    lookup = dict(zip(map(str.lower, docs.columns), inner, strict=True))
    back = [F.col(i).alias(n) for i, n in zip(inner, docs.columns, strict=True)]
    return docs.toDF(*inner), lambda name: lookup[name.lower()], lambda df: df.select(*back, *added)


def shielded(docs: DataFrame, work: Callable[..., DataFrame], **names: str) -> DataFrame:
    """``work`` on the table under plain names (given the new names of ``names``), then its rows with the old columns only."""
    plain, named, restore = shield(docs, ())
    return restore(work(plain, **{k: named(v) for k, v in names.items()}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/refaudit-llm/{label}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named by URI or plain path, and the path within it."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(values: pa.Array | pa.ChunkedArray, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, texts as bytes; NULL as empty)."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    values = values.cast(pa.large_binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(values):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, [x or b"" for x in values.slice(at, stop - at).to_pylist()]
        at = stop


def global_index(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Number all rows from 0 in the given order without putting them into one task.

    Rows are range-partitioned and sorted; the numbering inside a partition is shifted by the row counts
    of the partitions before it, a table of one row per partition. The numbered rows are written once, so
    a later retry cannot number them anew.
    """
    from refaudit.session import stage_table
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    numbered = stage_table(numbered, label)
    part = F.shiftright("_row", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    keyed = numbered.withColumn("_part", part)
    inside = F.col("_row") - F.shiftleft(F.col("_part"), 33)
    return keyed.join(starts, "_part").withColumn(name, inside + F.col("_start")).drop("_part", "_row", "_start")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root = its smallest reachable node.

    Every round each node takes the smallest label among its neighbours' and its own, then the label of
    its label (pointer jumping). Minima combine before the shuffle, so a hub's edges meet as one row per
    task; each round is written to the shared checkpoint folder. Ends when a round changes nothing.
    """
    from refaudit.session import stage_table
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage_table(both.filter("a <> b").groupBy("a", "b").agg(F.lit(1).alias("_one")).select("a", "b"), f"{label}-edges")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), label)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        step = step.join(jump, "low").select("node", F.col("root").alias("old"), F.least("low", "jump").alias("root"))
        step = stage_table(step, label)
        labels = step.select("node", "root")
        if step.filter("old <> root").limit(1).count() == 0:
            return labels


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of many texts as codes into their distinct words: (codes, number of words of each text, distinct words)."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split()
        counts[i] = len(own)
        words += own
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), counts, coded.dictionary.to_pylist()
