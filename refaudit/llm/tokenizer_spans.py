"""Alignment of two tokenizers by byte spans, and links that the corpus confirms (operator 11)."""
from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refaudit.llm.common import shield, slices, table
from refaudit.llm.fim import ExceptionIndex
from refaudit.session import stage_table

#: Aligned chunks that a worker remembers.
REMEMBERED = 300_000
#: Id pairs that are broadcast at once (16 bytes each before hashing); more of them are looked up block by block.
BLOCK = 2_000_000
#: Chunks that are encoded as one text.
JOINED = 500
#: Links of a group above which they are counted by distinct ids.
WIDE = 4096
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A blank between two visible characters: no entry of either vocabulary reaches across it from the left.
CUT = re.compile(r"(?<=\S) (?=\S)")
ADDED = ("n_a", "n_b", "n_groups", "n_links", "groups", "group_ends", "pairs", "links")


class Aligned(NamedTuple):
    """Many texts: per text its numbers of tokens and groups as text; byte offsets behind the groups, and distinct id pairs with the
    number of their links, each as one flat array with the number of entries of every text."""
    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray
    ends: np.ndarray
    n_ends: np.ndarray
    pairs: np.ndarray
    links: np.ndarray
    n_pairs: np.ndarray


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    """A piece in UTF-8 with U+2581 as a blank; ``<0xHH>`` is that byte."""
    found = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


class Pair:
    """Both tokenizers with their entries as bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        self.size_a, self.size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        self.a_bytes = [b""] * self.size_a
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        #: Texts may be cut at single blanks if no piece continues behind a visible character with one, and the model normalises nothing.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.normalize(" a  b ﬁ ") == "▁▁a▁▁b▁ﬁ▁"
        self.names = [np.array([f"{i}{sign}" for i in range(max(self.size_a, self.size_b))], object) for sign in ",|;"]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, side), np.int64, len(side)) for side in (self.a_bytes, self.b_bytes))
        self.known: dict[str, int] = {}
        self.asked = np.zeros(0, np.int64)
        self.pool: Aligned | None = None

    def _spans(self, texts: list[str]):
        """Which texts the entries' bytes give back; of those one after another the ids and byte ends of both sides, and each text's bytes and tokens."""
        coded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        pieces = [p.pieces for p in self.b.encode(texts, return_type="proto", num_threads=1)]
        data = [(" " + t).encode() for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        n_a, n_b = (np.fromiter(map(len, side), np.int64, len(texts)) for side in (coded, pieces))
        a_ids = np.fromiter(chain.from_iterable(map(attrgetter("ids"), coded)), np.int64, n_a.sum())
        chars = np.fromiter(chain.from_iterable(chain.from_iterable(map(attrgetter("offsets"), coded))), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        b_ids, b_to = np.fromiter(chain.from_iterable(map(attrgetter("id", "end"), chain.from_iterable(pieces))), np.int64, 2 * n_b.sum()).reshape(-1, 2).T
        good = given_back(data, a_ids, n_a, self.a_bytes, self.a_sizes) & given_back(data, b_ids, n_b, self.b_bytes, self.b_sizes)
        if not good.all():
            in_a, in_b = np.repeat(good, n_a), np.repeat(good, n_b)
            data = [d for d, ok in zip(data, good.tolist(), strict=True) if ok]
            a_ids, chars, b_ids, b_to, n_a, n_b, sizes = a_ids[in_a], chars[in_a], b_ids[in_b], b_to[in_b], n_a[good], n_b[good], sizes[good]
        index = ExceptionIndex(np.frombuffer(b"".join(data), np.uint8))
        starts = np.cumsum(sizes) - sizes
        a_ends = refined(index.to_bytes(chars[:, 1] + np.repeat(index.to_chars(starts), n_a)), self.a_sizes[a_ids])
        b_ends = refined(b_to + np.repeat(starts + 1, n_b), self.b_sizes[b_ids])  # its offsets leave out the blank before the text
        return good, (a_ids, a_ends, b_ids, b_ends), sizes, n_a, n_b

    def align(self, texts: list[str]) -> tuple[np.ndarray, Aligned]:
        """Each non-empty text aligned as a blank and the text. Also tells which texts the entries' bytes give back; the others are left out."""
        good, tokens, sizes, n_a, n_b = self._spans(texts)
        return good, self._grouped(*tokens, n_a, n_b, np.cumsum(sizes))

    def align_chunks(self, chunks: list[str]) -> tuple[np.ndarray, Aligned]:
        """The same for chunks that begin and end visibly, joined into long texts; all chunks of one that does not come back are left out."""
        rows = [chunks[i:i + JOINED] for i in range(0, len(chunks), JOINED)]
        good, tokens, *_ = self._spans([" ".join(r) for r in rows])
        good = np.repeat(good, [len(r) for r in rows])
        stops = np.cumsum([len(c.encode()) + 1 for c, ok in zip(chunks, good.tolist(), strict=True) if ok], dtype=np.int64)
        n_a, n_b = (np.bincount(np.searchsorted(stops, ends), minlength=len(stops)) for ends in tokens[1::2])
        return good, self._grouped(*tokens, n_a, n_b, stops)

    def _grouped(self, a_ids, a_ends, b_ids, b_ends, n_a, n_b, stops) -> Aligned:
        """Cut both sides where they end together; every token of a group is linked to every token of its other side."""
        ends = np.intersect1d(a_ends, b_ends)
        a_in, b_in = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        in_a, in_b = np.bincount(a_in, minlength=len(ends)), np.bincount(b_in, minlength=len(ends))
        a_stop, b_stop = np.cumsum(in_a), np.cumsum(in_b)
        comma, bar, semicolon = self.names
        parts = np.empty(len(a_ids) + len(b_ids), object)  # group after group: its A ids, then its B ids, each with the sign behind it
        place = np.arange(len(a_ids))
        parts[place + (b_stop - in_b)[a_in]] = np.where(place + 1 == a_stop[a_in], bar[a_ids], comma[a_ids])
        place = np.arange(len(b_ids))
        parts[place + a_stop[b_in]] = np.where(place + 1 == b_stop[b_in], semicolon[b_ids], comma[b_ids])
        to = np.cumsum(n_a + n_b)
        groups = np.array(["".join(parts[i:j].tolist())[:-1] for i, j in zip((to - n_a - n_b).tolist(), to.tolist(), strict=True)], object)
        owner = np.searchsorted(stops, ends)

        wide = in_a * in_b > WIDE
        some = np.flatnonzero(~wide[a_in])
        reps = in_b[a_in[some]]
        total = np.cumsum(reps)
        partner = np.repeat((b_stop - in_b)[a_in[some]] - (total - reps), reps) + np.arange(int(reps.sum()))
        pairs, whose, links = [np.repeat(a_ids[some], reps) * self.size_b + b_ids[partner]], [np.repeat(owner[a_in[some]], reps)], [np.ones(len(partner), np.int64)]
        for g in np.flatnonzero(wide).tolist():  # by distinct ids and how often they occur
            (i, n), (j, m) = np.unique(a_ids[a_stop[g] - in_a[g]:a_stop[g]], return_counts=True), np.unique(b_ids[b_stop[g] - in_b[g]:b_stop[g]], return_counts=True)
            pairs.append((i[:, None] * self.size_b + j).ravel())
            whose.append(np.full(len(i) * len(j), owner[g]))
            links.append((n[:, None] * m).ravel())
        pairs, links, n_pairs = merged(np.concatenate(whose), np.concatenate(pairs), np.concatenate(links), len(stops))
        n_ends = np.bincount(owner, minlength=len(stops))
        return Aligned(n_a, n_b, groups, ends - np.repeat(np.append(0, stops)[:len(stops)], n_ends), n_ends, pairs, links, n_pairs)

    def chunks(self, needed: set[str]) -> None:
        """Remember the alignment of chunks; one that does not come back has place -1. When memory is full, those asked for once go."""
        if len(self.known) + len(needed) > REMEMBERED and self.pool:
            self._forget()
        new = [p for p in needed if p not in self.known]
        joined = [p for p in new if not (p[0].isspace() or p[-1].isspace())]
        apart = [p for p in new if p[0].isspace() or p[-1].isspace()]
        parts = [self.pool] if self.pool else []
        at = len(self.pool.n_a) if self.pool else 0
        for names, run in ((joined, self.align_chunks), (apart, self.align)):
            for i in range(0, len(names), 20_000):
                some = names[i:i + 20_000]
                good, own = run(some)
                self.known.update(zip(some, np.where(good, at + np.cumsum(good) - 1, -1).tolist(), strict=True))
                at += int(good.sum())
                parts.append(own)
                if names is joined:
                    apart += [p for p, ok in zip(some, good.tolist(), strict=True) if not ok]
        if new:
            self.pool = _stacked(parts)
            self.asked = np.append(self.asked, np.zeros(at - len(self.asked), np.int64))

    def _forget(self) -> None:
        often = self.asked > 1
        if often.sum() > REMEMBERED // 2:
            often = self.asked > np.partition(self.asked, -(REMEMBERED // 2))[-(REMEMBERED // 2)]
        place = np.where(often, np.cumsum(often) - 1, -1).tolist()
        self.known = {p: place[i] for p, i in self.known.items() if i >= 0 and place[i] >= 0}
        which = np.flatnonzero(often)
        self.pool, self.asked = _chosen(self.pool, which), np.zeros(len(which), np.int64)


def given_back(data: list[bytes], ids: np.ndarray, counts: np.ndarray, entries: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Which texts the bytes of their tokens' entries make up."""
    joined = b"".join(map(entries.__getitem__, ids.tolist()))
    to = np.append(0, np.cumsum(lengths[ids]))[np.cumsum(counts)]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    if len(joined) == sizes.sum() and (to == np.cumsum(sizes)).all() and joined == b"".join(data):
        return np.ones(len(data), bool)
    return np.array([joined[i:j] == d for i, j, d in zip([0, *to.tolist()], to.tolist(), data, strict=False)], bool)


def merged(owner: np.ndarray, pairs: np.ndarray, links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's distinct pairs in order with the sums of their links, and their number for each of ``n`` owners."""
    if not len(pairs):
        return pairs, links, np.zeros(n, np.int64)
    order = np.lexsort((pairs, owner))
    owner, pairs = owner[order], pairs[order]
    first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])))
    return pairs[first], np.add.reduceat(links[order], first), np.bincount(owner[first], minlength=n)


def refined(stops: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte offset behind each token. A span's end is a cut where the spans advance and the entries' bytes end there too; tokens that
    share a character, or have an empty span, are placed by their bytes.
    """
    by_bytes = np.cumsum(lengths)
    return np.where((np.diff(stops, prepend=0) > 0) & (stops == by_bytes), stops, by_bytes)


@functools.lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def picked(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The entries of the lists ``which``, one after another."""
    starts, n = np.cumsum(sizes) - sizes, sizes[which]
    to = np.cumsum(n)
    return flat[np.repeat(starts[which] - (to - n), n) + np.arange(int(n.sum()))]


def align_texts(pair: Pair, texts: list[bytes]) -> Aligned:
    """All texts aligned; nothing for empty ones and those whose tokens do not give them back.

    Texts are cut at single blanks, which both tokenizers cut too, and each distinct chunk is encoded once. A text with a chunk that
    does not come back is encoded whole.
    """
    whole = [t.decode() for t in texts]
    parts = [CUT.split(t) if t and pair.cuts else [] for t in whole]
    pair.chunks({p for own in parts for p in own})
    codes = [[pair.known[p] for p in own] for own in parts]
    apart = [i for i, (t, own) in enumerate(zip(whole, codes, strict=True)) if t and (not own or -1 in own)]
    for i in apart:
        codes[i] = []
    counts = np.fromiter(map(len, codes), np.int64, len(codes))
    flat, owner = np.fromiter(chain.from_iterable(codes), np.int64, counts.sum()), np.repeat(np.arange(len(codes)), counts)
    n = len(texts)
    out = Aligned(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, "", object), *[np.zeros(0, np.int64)], np.zeros(n, np.int64), *[np.zeros(0, np.int64)] * 2, np.zeros(n, np.int64))
    if len(flat):
        pool = pair.pool
        pair.asked += np.bincount(flat, minlength=len(pair.asked))
        last = pool.ends[np.cumsum(pool.n_ends) - 1][flat]  # the chunks' lengths in bytes
        to = np.cumsum(last)
        before = np.append(0, to)[np.cumsum(counts) - counts]  # bytes of all texts before
        ends = picked(pool.ends, pool.n_ends, flat) + np.repeat(to - last - np.repeat(before, counts), pool.n_ends[flat])
        sums = [np.bincount(owner, x[flat], n).astype(np.int64) for x in (pool.n_a, pool.n_b, pool.n_ends)]
        groups = np.array([";".join(pool.groups[own].tolist()) if own else "" for own in codes], object)
        merged_pairs = merged(np.repeat(owner, pool.n_pairs[flat]), picked(pool.pairs, pool.n_pairs, flat), picked(pool.links, pool.n_pairs, flat), n)
        out = Aligned(sums[0], sums[1], groups, ends, sums[2], *merged_pairs)
    if apart:
        good, own = pair.align([whole[i] for i in apart])
        out = _placed(out, own, [i for i, ok in zip(apart, good.tolist(), strict=True) if ok])
    return out


def _stacked(parts: list[Aligned]) -> Aligned:
    return parts[0] if len(parts) == 1 else Aligned(*map(np.concatenate, zip(*parts, strict=True)))


def _chosen(own: Aligned, which: np.ndarray) -> Aligned:
    return Aligned(own.n_a[which], own.n_b[which], own.groups[which], picked(own.ends, own.n_ends, which), own.n_ends[which],
                   picked(own.pairs, own.n_pairs, which), picked(own.links, own.n_pairs, which), own.n_pairs[which])


def _placed(out: Aligned, own: Aligned, rows: list[int]) -> Aligned:
    """``out`` with the texts of ``own`` at ``rows``, which it has nothing of."""
    n = len(out.n_a)
    which = np.arange(n)
    which[rows] = n + np.arange(len(rows))
    return _chosen(_stacked([out, own]), which)


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, kind))


def _aligner(text: str, a_path: str, b_path: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for batch in batches:
            for row, texts in slices(batch.column(text), 2 << 20):
                own = align_texts(pair, texts)
                n_links = np.diff(np.append(0, np.cumsum(own.links))[np.append(0, np.cumsum(own.n_pairs))])
                columns = [pa.array(x, pa.int64()) for x in (own.n_a, own.n_b, own.n_ends, n_links)] + [pa.array(own.groups, pa.string())]
                columns += [_lists(own.ends, own.n_ends, pa.int32()), _lists(own.pairs, own.n_pairs, kind), _lists(own.links, own.n_pairs, pa.int32())]
                old = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*old.columns, *columns], names=[*old.schema.names, *ADDED])
    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the alignment of two tokenizers on a blank and the text.

    ``n_a, n_b`` count the tokens, ``groups`` lists the ids of each group as ``a1,a2|b1;a3|b2``, ``group_ends`` the byte offsets
    behind the groups, and ``pairs`` the distinct linked id pairs (A's id times B's vocabulary size plus B's id) with the number of
    linked occurrences in ``links``; ``n_groups, n_links`` are totals.

    Character offsets of A and byte spans of B are coarse cuts; where a character is shared by several tokens, or falls back to
    bytes, the entries' own bytes place the cut. Special tokens' strings are plain text. Texts that are NULL or empty, or that the
    entries' bytes do not give back exactly, have no tokens: zeros, empty text and lists. Nothing is shuffled; a task holds one
    Arrow batch and a bounded memory of chunks. Old columns of the new names are left out.
    """
    pair = pair_of(a_path, b_path)
    small = pair.size_a * pair.size_b < 1 << 31
    kind = T.IntegerType() if small else T.LongType()
    rows, named, restore = shield(docs, ADDED)
    new = [T.StructField(n, T.LongType()) for n in ADDED[:4]] + [T.StructField("groups", T.StringType())]
    new += [T.StructField(n, T.ArrayType(t)) for n, t in (("group_ends", T.IntegerType()), ("pairs", kind), ("links", T.IntegerType()))]
    schema = T.StructType([*rows.schema.fields, *new])
    return restore(rows.mapInArrow(_aligner(named(text), a_path, b_path, pa.int32() if small else pa.int64()), schema))


def linked_counts(rows: DataFrame, size_b: int, block: int = BLOCK) -> DataFrame:
    """Per row of ``rows(row, pairs, links)`` with pairs: ``row, n_best, count_sum``.

    A pair's count is the number of rows that hold it; ``count_sum`` adds it up over all links, ``n_best`` counts the links whose
    count is the highest of their A id. Counts combine before the shuffle, and a row's links are summed inside its task; the table of
    pairs is broadcast, ``block`` pairs at a time.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = stage_table(counts, "pair-counts")
    a_id = F.floor(F.col("pair") / F.lit(size_b)).alias("a")
    top = counts.groupBy(a_id).agg(F.max("count").alias("top"))
    best = stage_table(counts.select("pair", "count", a_id).join(top, "a").select(F.col("pair").alias("_pair"), "count", (F.col("count") == F.col("top")).alias("best")), "pair-best")
    blocks = max(1, -(-best.count() // block))
    each = rows.select("row", "links", F.posexplode("pairs").alias("at", "pair")).select("row", "pair", F.get("links", F.col("at")).cast("long").alias("n"))
    parts = []
    for b in range(blocks):
        own = best if blocks == 1 else best.filter(F.pmod(F.xxhash64("_pair"), F.lit(blocks)) == b)
        met = each.join(F.broadcast(own), F.col("pair") == F.col("_pair"))
        parts.append(met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")))
    out = reduce(DataFrame.union, parts)
    return out if blocks == 1 else out.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op11_alignment(spark, sf_dir: str, block: int = BLOCK) -> DataFrame:
    import public_tokenizers
    a_path, b_path = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
    docs = aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), a_path, b_path)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = stage_table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "links"), "alignment")
    counted = linked_counts(rows, pair_of(a_path, b_path).size_b, block)
    out = rows.drop("pairs", "links").join(counted, "row", "left")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
