"""Token ids in Arrow stream files of equal-length sequences (operator 7)."""
from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refaudit.llm.common import filesystem, shared_folder, slices, table, word_codes
from refaudit.session import stage_table

SEQUENCE = 2048
END_ID = 2
#: Sequences in a record batch of the file.
BATCH = 64
#: Pieces of words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Words that are encoded as one text.
JOINED = 1000
VOCABULARY = "word_bpe_49k.json"
#: Letters that end in an ASCII letter, then ASCII signs (no apostrophe, which the vocabulary may join to letters).
CUT = re.compile(rb"([A-Za-z\x80-\xff]*[A-Za-z])([!-&(-/:-@\[-_{-~]*)").fullmatch


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    ends[[i for entry, i in tokenizer.get_vocab().items() if entry.endswith("</w>")]] = True
    return tokenizer, {}, ends


def _joined_ids(tokenizer, ends: np.ndarray, words: list[bytes]) -> list[bytes] | None:
    """Ids of words of ASCII letters, encoded as one text: each word ends at the next entry with an end mark. None if that does not give as many words."""
    ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
    stops = (np.flatnonzero(ends[ids]) + 1).tolist()
    if len(stops) != len(words) or stops[-1] != len(ids):
        return None
    coded = ids.tobytes()
    return [coded[4 * i:4 * j] for i, j in zip([0, *stops], stops, strict=False)]


def _pieces(word: bytes) -> tuple[bytes, ...]:
    """A word as parts that the vocabulary never joins: letters in lower case and the signs behind them; else the word itself."""
    found = None if b"<|" in word else CUT(word)
    return (found[1].lower(), found[2]) if found and found[2] else (found[1].lower(),) if found else (word,)


def encode(texts: list[bytes], path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text closed by ``end_id``; and the number of ids of each text.

    The vocabulary drops white space, ignores case and never joins across white space or from a letter to a sign, so the ids of
    a text are those of its words, and a word's those of its pieces: each distinct piece goes through the tokenizer once and its
    ids are copied to every place. Only pieces are remembered, up to a bound.
    """
    tokenizer, known, ends = _tokenizer(path)
    codes, counts, words = word_codes(texts)
    cut = [(w.lower(),) if w.isalpha() else _pieces(w) for w in words]
    needed = {p for x in cut for p in x}
    if len(known) + len(needed) > REMEMBERED:
        known.clear()
    new = [p for p in needed if p not in known]
    plain, odd = [p for p in new if p.isalpha()], [p for p in new if not p.isalpha()]
    for at in range(0, len(plain), JOINED):
        some = plain[at:at + JOINED]
        own = _joined_ids(tokenizer, ends, some)
        if own is None:
            odd += some
        else:
            known.update(zip(some, own, strict=True))
    for piece, coded in zip(odd, tokenizer.encode_batch_fast([p.decode() for p in odd], add_special_tokens=False), strict=True):
        known[piece] = array("I", coded.ids).tobytes()
    parts = [known[x[0]] if len(x) == 1 else known[x[0]] + known[x[1]] for x in cut]
    parts.append(array("I", [end_id]).tobytes())
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pool = np.frombuffer(b"".join(parts), np.uint32)
    starts = np.cumsum(sizes) - sizes
    places = np.insert(codes, np.cumsum(counts), len(parts) - 1)  # the end mark after each text's last word
    lengths = sizes[places]
    ends = np.cumsum(lengths)
    ids = pool[np.repeat(starts[places] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
    closes = np.cumsum(counts + 1) - 1
    return ids, np.diff(ends[closes], prepend=0)


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])


class SequenceFile:
    """Writes ids as fixed-size lists of ``length`` with a mask that is false on the padding of the last one."""

    def __init__(self, target: str, length: int, kind: pa.DataType, batch: int = BATCH):
        files, path = filesystem(target)
        files.create_dir(os.path.dirname(path), recursive=True)
        self.schema, self.length, self.dtype, self.batch = file_schema(length, kind), length, kind.to_pandas_dtype(), batch
        self.sink = files.open_output_stream(path, compression=None)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        full = self.length * self.batch
        if self.held >= full:
            row = np.concatenate(self.waiting)
            for at in range(0, self.held - self.held % full, full):
                self._write(row[at:at + full], full)
            self.waiting, self.held = [row[self.held - self.held % full:]], self.held % full

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.waiting)
            self._write(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to a file: ``ids(start, n)`` without copying where they lie in one batch, ``sequence(i)`` as (ids, mask)."""

    def __init__(self, target: str):
        files, path = filesystem(target)
        self.source = pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.size = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self.cached = (-1, None)

    def _batch(self, i: int) -> pa.RecordBatch:
        if self.cached[0] != i:
            self.cached = (i, self.reader.get_batch(i))
        return self.cached[1]

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        full = self.size * self.length
        while n > 0:
            values = self._batch(start // full).column("ids").flatten()
            piece = values.slice(start % full, n).to_numpy(zero_copy_only=True)
            yield piece
            start, n = start + len(piece), n - len(piece)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self._batch(i // self.size), i % self.size
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def close(self) -> None:
        self.source.close()


def _writer(folder: str, path: str, length: int, end_id: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"  # a retried task writes another file; only the index names files
        file, at = None, 0
        for batch in batches:
            for row, texts in slices(batch.column("text")):
                ids, counts = encode(texts, path, end_id)
                file = file or SequenceFile(f"{folder}/{name}", length, kind)
                file.add(ids)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.record_batch([pa.array([part] * len(texts), pa.int32()), pa.array([name] * len(texts)), batch.column("doc_id").slice(row, len(texts)), pa.array(starts), pa.array(counts)],
                                      names=["part", "file", "doc_id", "file_start", "n_tokens"])
        if file:
            file.close()
    return run


def write_tokens(docs: DataFrame, folder: str, path: str, text: str = "text", doc_id: str = "doc_id", length: int = SEQUENCE, end_id: int = END_ID, vocabulary: int = 1 << 16) -> DataFrame:
    """Encode all texts and write the ids to ``folder`` in ascending id order; returns the index of documents.

    Rows are range-partitioned by id (NULL first, repeated ids by input order) and sorted, so file after file holds the ids in
    order. Each task writes one Arrow file of fixed-size lists (ids and mask); ids take 16 bits where the vocabulary allows.
    Index: ``part, file, doc_id, file_start, n_tokens, start``, where ``start`` counts the ids of all documents before. Each
    file's name is new and the index is written by Spark's committed output, so files of lost attempts are never read.

    NULL texts count as empty and give the end id alone; an empty table gives an empty index. Other columns are not read.
    """
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    index = stage_table(rows.mapInArrow(_writer(folder, path, length, end_id, kind), "part int, file string, doc_id long, file_start long, n_tokens long"), "token-index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    totals = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(totals, "part").withColumn("start", F.col("_before") + F.col("file_start")).drop("_before")


def _checksums(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reader = SequenceReader(f"{folder}/{rows['file'].iloc[0]}")
        sums = []
        for start, n in zip(rows["file_start"], rows["n_tokens"], strict=True):
            crc = 0
            for piece in reader.ids(int(start), int(n)):
                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
            sums.append(crc)
        reader.close()
        return rows.assign(ids_crc32=np.array(sums, np.int64))[["doc_id", "start", "n_tokens", "ids_crc32"]]
    return run


def read_checksums(index: DataFrame, folder: str) -> DataFrame:
    """Per document of the index the CRC-32 of its ids (little-endian 32 bits), read from the files.

    Each task opens one file and holds its index rows, which the writing partition bounds.
    """
    return index.select("file", "doc_id", "file_start", "n_tokens", "start").groupBy("file").applyInPandas(_checksums(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = shared_folder(spark, "tokens")
    index = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return read_checksums(index, folder)


QUERIES = {"op7_token_ids": op7_token_ids}
ORACLES: dict[str, str] = {}
