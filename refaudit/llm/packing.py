"""Best-fit packing with several permitted sequence lengths (operator 6)."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import table
from refaudit.llm.mixing import word_count

#: Permitted sequence lengths of the registered query, in words with one end mark per document.
LENGTHS = (512, 1024, 2048, 4096)
#: Pieces planned together: bounds the memory of a task, not the input. Every piece is packed.
WINDOW = 50_000


def bin_cost(length: int) -> float:
    """Cost of running one sequence: its places, a part that grows with the square (attention), and a fixed part."""
    return 64.0 + length + length * length / 16384.0


def _fill(order: np.ndarray, sizes: np.ndarray, lengths: Sequence[int], preferred: int, cost) -> tuple[np.ndarray, np.ndarray, float]:
    """Best-fit decreasing with bins opened at ``preferred`` places (or the least-cost length that holds the piece).

    Returns each piece's bin, each bin's final length and the total cost. ``open_at`` has bit r set where a bin with r free
    places is open, so the tightest bin is found with two integer operations.
    """
    free: dict[int, list[int]] = {}
    open_at, used = 0, []
    where = np.empty(len(sizes), np.int64)
    for i in order:
        size = int(sizes[i])
        fit = open_at >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            stack = free[room]
            b = stack.pop()
            if not stack:
                open_at &= ~(1 << room)
            used[b] += size
        else:
            room = preferred if size <= preferred else min((x for x in lengths if x >= size), key=cost)
            b = len(used)
            used.append(size)
        where[i] = b
        rest = room - size
        if rest:
            free.setdefault(rest, []).append(b)
            open_at |= 1 << rest
    final = np.asarray(lengths)[np.searchsorted(np.asarray(lengths), np.asarray(used, np.int64))] if used else np.empty(0, np.int64)
    return where, final, float(sum(cost(int(x)) for x in final))


def pack_pieces(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, cost=bin_cost) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece and length of each bin: the cheapest of the plans that open each permitted length first."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    plans = [_fill(order, sizes, lengths, x, cost) for x in lengths]
    where, final, _ = min(plans, key=lambda p: p[2])
    return where, final


def _packer(lengths: tuple[int, ...], cost, window: int):
    top = max(lengths)

    def plan(rows: pd.DataFrame, first_bin: int) -> tuple[pd.DataFrame, int]:
        sizes = rows["piece_size"].to_numpy()
        where, final = pack_pieces(sizes, lengths, cost)
        out = rows.assign(bin_id=first_bin + where, bin_length=final[where])
        out = out.sort_values("bin_id", kind="stable")
        ahead = out.groupby("bin_id")["piece_size"].cumsum() - out["piece_size"]
        return out.assign(bin_start=ahead), first_bin + len(final)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_bin = TaskContext.get().partitionId() << 33
        waiting, held = [], 0
        for rows in batches:
            pieces = np.maximum(1, -(-rows["size"].to_numpy() // top))
            at = np.repeat(np.arange(len(rows)), pieces)
            number = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(rows["size"].to_numpy()[at] - number * top, top)
            split = pd.DataFrame({"doc_id": rows["doc_id"].array.take(at), "piece": number.astype(np.int32), "piece_start": number * top, "piece_size": size})
            for low in range(0, len(split), window):
                part = split.iloc[low:low + window]
                if held + len(part) > window:
                    out, next_bin = plan(pd.concat(waiting, ignore_index=True), next_bin)
                    yield out
                    waiting, held = [], 0
                waiting.append(part)
                held += len(part)
        if held:
            out, next_bin = plan(pd.concat(waiting, ignore_index=True), next_bin)
            yield out
    return run


def pack(docs: DataFrame, size: Column, doc_id: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, cost=bin_cost, window: int = WINDOW) -> DataFrame:
    """Pack documents into sequences of the permitted lengths; one row per piece.

    ``size`` is each document's length. A document longer than the largest permitted length is cut into pieces of that length
    and a rest. Result: ``doc_id, piece, piece_start, piece_size, bin_id, bin_length, bin_start``; a piece lies whole in one
    bin, pieces of a bin do not overlap, and ``bin_length`` is the smallest permitted length that holds the bin's contents.

    Within each window of pieces, best-fit decreasing is run once for each permitted length as the one opened first; the
    plan of least total cost wins, after each bin is downsized to its contents. Only ids and sizes leave the JVM and nothing is
    shuffled: a task plans its rows in windows, so hot keys do not matter and memory is bounded. ``bin_id`` holds the partition
    number in its upper bits, so a retried task gives the same ids.

    NULL or negative sizes count as 0 and take a place-less piece; NULL and repeated ids are packed row by row; an empty table
    gives an empty result.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    return narrow.mapInPandas(_packer(tuple(sorted(lengths)), cost, window), "doc_id long, piece int, piece_start long, piece_size long, bin_id long, bin_length int, bin_start long")


def packed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Pack whole documents by their words and one end mark each."""
    return pack(docs, word_count(F.col(text)) + 1, **options)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
