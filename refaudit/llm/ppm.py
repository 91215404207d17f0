"""Language-model scores (operator 5): prediction by partial matching over bytes."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import slices, table, word_codes
from refaudit.session import stage_table

#: Longest context in bytes, the blank before the word included.
ORDER = 6
#: Bytes of text, and distinct words, that share one dictionary.
TEXT_BLOCK = 14 << 20
WORD_BLOCK = 50_000
#: Symbols: the 256 bytes and the end of the text.
END, SYMBOLS = 256, 257
FOLDS, HELD_OUT = 5, 1
#: Tokens that the pretrained model weighs against a text's own counts.
WEIGHT = 1500.0


def held_out(ids: list) -> np.ndarray:
    """True where crc32 of the id as text leaves 1 when divided by 5; a NULL id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def _packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending token numbers and their counts, as compressed byte planes of the steps between them."""
    both = np.stack([np.diff(codes, prepend=0), times]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    steps, times = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), times.astype(np.int64)


TEXT_ROWS = pa.schema([("blk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("codes", pa.binary()),
                       ("code", pa.int32()), ("token", pa.binary()), ("trained", pa.int64())])
TEXT_DDL = "blk long, doc_id long, held_out boolean, n_tokens long, codes binary, code int, token binary, trained long"


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _count_block(blk: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A block's documents as counts of token numbers, and its dictionary with the counts in training documents."""
    codes, counts, words = word_codes([t.lower() for t in texts])
    places = np.insert(codes, np.cumsum(counts), len(words))  # the end token after each text's words
    counts = counts + 1
    size = len(words) + 1
    keys, times = np.unique(np.repeat(np.arange(len(texts)), counts) * size + places, return_counts=True)
    held = held_out(ids)
    trained = np.bincount(keys % size, np.where(held[keys // size], 0, times), size).astype(np.int64)
    ends = np.cumsum(np.bincount(keys // size, minlength=len(texts))).tolist()
    packed = [_packed(keys[s:e] % size, times[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    yield _rows(TEXT_ROWS, len(texts), blk=[blk] * len(texts), doc_id=ids, held_out=held, n_tokens=counts, codes=packed)
    yield _rows(TEXT_ROWS, size, blk=[blk] * size, code=np.arange(size, dtype=np.int32), token=[*words, b""], trained=trained)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blk = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0
    for batch in batches:
        for row, part in slices(batch.column("text"), 1 << 20):
            ids += batch.column("doc_id").slice(row, len(part)).to_pylist()
            texts += part
            held += sum(map(len, part))
            if held >= TEXT_BLOCK:
                yield from _count_block(blk, ids, texts)
                blk, ids, texts, held = blk + 1, [], [], 0
    if texts:
        yield from _count_block(blk, ids, texts)


def transitions(tokens: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each token's steps as keys in a row, and their number per token.

    A token is read behind a blank and closed by one (the empty token, the end of a text, is the single symbol ``END``). A step's
    context is what was read of the token with the blank before it, at most the last ``order`` bytes. A key packs the
    context's length, its bytes and the next symbol: ``length << 57 | bytes << 9 | symbol``.
    """
    spaced = b"".join(b" " + t + b" " if t else b" \x00" for t in tokens)
    raw = np.frombuffer(spaced, np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 2 for t in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    symbol = raw.copy()
    symbol[starts[sizes == 2] + 1] = END
    context = np.zeros(len(raw), np.int64)
    for back in range(1, order + 1):
        far = place >= back
        context[far] |= raw[np.flatnonzero(far) - back] << (8 * (back - 1))
    keys = np.minimum(place, order) << 57 | context << 9 | symbol
    return keys[place > 0], sizes - 1


WORD_ROWS = pa.schema([("blk", pa.int64()), ("token", pa.binary()), ("trained", pa.int64()), ("step", pa.int64()), ("times", pa.int64())])


def _step_block(blk: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
    tokens, trained = part.column("token").to_pylist(), part.column("trained").to_numpy()
    keys, sizes = transitions(tokens)
    found, inverse = np.unique(keys, return_inverse=True)
    times = np.bincount(inverse, np.repeat(trained, sizes), len(found)).astype(np.int64)
    yield _rows(WORD_ROWS, len(tokens), blk=[blk] * len(tokens), token=tokens, trained=trained)
    yield _rows(WORD_ROWS, len(found), blk=[blk] * len(found), step=found, times=times)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of tokens, each with the distinct steps of its tokens and their counts in training."""
    blk, waiting, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= WORD_BLOCK:
            yield from _step_block(blk, pa.Table.from_batches(waiting))
            blk, waiting, held = blk + 1, [], 0
    if held:
        yield from _step_block(blk, pa.Table.from_batches(waiting))


def _length(key: Column) -> Column:
    return F.shiftright(key, 57).cast("int")


def _shorter(key: str, length: Column) -> Column:
    """The key with its context cut to its last ``length`` bytes."""
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), 8 * length.cast("int") + 9) - 1
    return F.call_function("shiftleft", length.cast("long"), F.lit(57)).bitwiseOR(F.col(key).bitwiseAND(bits))


def _node(key: str) -> Column:
    """The key without its symbol: its context."""
    return F.shiftright(key, 9)


def _share(total: str, distinct: str) -> Column:
    """Log of what one count is worth: the part not escaping, per count."""
    return F.log((2 * F.col(total) - F.col(distinct)) / (2.0 * F.col(total) * F.col(total)))


def _escape(total: str, distinct: str) -> Column:
    return F.log(F.col(distinct) / (2 * F.col(total)))


def step_scores(steps: DataFrame) -> DataFrame:
    """``(step, logp)``: natural log-probability of each step under the trie grown from all counts ``steps(step, times)``.

    Every context of the trie counts the symbols that followed it in training (T in all, q distinct). The escape has
    probability q / 2T and the symbols seen share the rest by their counts. After an escape the next shorter context is asked, with the symbols of
    the longer one excluded from its counts: what follows a context also follows its shorter forms, so only the sums over
    the longer context's symbols are subtracted. Below the empty context the symbols not seen at all are equally likely.

    All of it is joins and sums over (context, symbol) rows; nothing is held per task.
    """
    ns = [F.explode(F.sequence(F.lit(0), _length(F.col("step")))).alias("n")]
    grown = steps.filter("times > 0").select("step", "times", *ns).groupBy(_shorter("step", F.col("n")).alias("key")).agg(F.sum("times").alias("c"))
    grown = stage_table(grown.withColumn("node", _node("key")).withColumn("parent_key", _shorter("key", F.greatest(_length(F.col("key")) - 1, F.lit(0)))), "ppm-trie")
    # Per context: its own sums, those of its shorter form over the same symbols, and of its shorter form over all.
    own = grown.groupBy("node").agg(F.sum("c").alias("T"), F.count("*").alias("q"))
    over = grown.filter(_length(F.col("key")) > 0).select("node", F.col("parent_key").alias("key")).join(grown.select("key", F.col("c").alias("above"), F.col("node").alias("parent")), "key").groupBy("node").agg(F.sum("above").alias("X"), F.first("parent").alias("parent"))
    nodes = own.join(over, "node", "left")
    up = own.select(F.col("node").alias("parent"), F.col("T").alias("TU"), F.col("q").alias("qu"))
    nodes = nodes.join(up, "parent", "left").withColumn("fresh", F.col("qu") - F.col("q")).withColumn("left", F.col("TU") - F.col("X"))
    # log-probability of passing through the shorter context too; 0 where it adds no symbol
    some = F.col("fresh") > 0
    nodes = nodes.select("node", _share("T", "q").alias("share"), _escape("T", "q").alias("escape"), "q", F.when(some, _share("left", "fresh")).alias("next_share"), F.when(some, _escape("left", "fresh")).otherwise(0.0).alias("pass"))
    nodes = stage_table(nodes, "ppm-nodes")

    seen = steps.join(grown.select(F.col("key").alias("step"), "node", "c"), "step").join(nodes.select("node", "share"), "node").select("step", (F.log("c") + F.col("share")).alias("logp"))
    # Steps never seen in training: walk their shorter contexts; each has at most ORDER + 1 of them.
    new = stage_table(steps.filter("times = 0").select("step").join(grown.select(F.col("key").alias("step")), "step", "left_anti"), "ppm-new")
    walk = new.select("step", *ns).withColumn("key", _shorter("step", F.col("n"))).withColumn("node", _node("key"))
    walk = walk.join(nodes, "node").join(grown.select("key", "c"), "key", "left")  # contexts known to the trie only
    walk = stage_table(walk, "ppm-walk")
    top = walk.groupBy("step").agg(F.max("n").alias("top"), F.max(F.when(F.col("c").isNotNull(), F.col("n"))).alias("hit"))
    at = walk.join(top, "step")
    n, hit = F.col("n"), F.coalesce("hit", F.lit(-1))
    first = F.max(F.when(n == F.col("top"), F.when(hit == n, F.log("c") + F.col("share")).otherwise(F.col("escape"))))
    passed = F.sum(F.when(n > hit + 1, F.col("pass")).otherwise(0.0))  # escapes from the contexts between
    found = F.max(F.when((n == hit) & (hit < F.col("top")), F.log("c")))
    below = F.max(F.when((n == hit + 1) & (hit >= 0), F.col("next_share")))
    nothing = F.max(F.when((hit < 0) & (n == 0), F.log(F.lit(SYMBOLS) - F.col("q"))))
    missed = at.groupBy("step").agg((first + passed + F.coalesce(found + below, F.lit(0.0)) - F.coalesce(nothing, F.lit(0.0))).alias("logp"))
    # An empty trie (no training text) knows no context at all: all symbols are equally likely.
    lost = new.join(top, "step", "left_anti").select("step", F.lit(-float(np.log(SYMBOLS))).alias("logp"))
    return seen.unionByName(missed).unionByName(lost)


def _token_scores(tokens: pa.Table, steps: pa.Table) -> pa.Table:
    keys, sizes = transitions(tokens.column("token").to_pylist())
    known = pc.index_in(pa.array(keys), value_set=steps.column("step").combine_chunks())
    if known.null_count:
        raise ValueError("a step has no score")
    logs = np.asarray(steps.column("logp"))[np.asarray(known)]
    return pa.table({"token": tokens.column("token"), "trained": tokens.column("trained"), "logp": np.add.reduceat(logs, np.cumsum(sizes) - sizes)})


def _text_scores(total: int, distinct: int, weight: float):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        size = words.num_rows
        order = np.asarray(words.column("code"))
        trained, logp = np.zeros(size), np.zeros(size)
        trained[order], logp[order] = np.asarray(words.column("trained")), np.asarray(words.column("logp"))
        base = np.log10((trained + 0.5) / (total + 0.5 * (distinct + 1)))
        at, n = zip(*map(_unpacked, texts.column("codes").to_pylist()), strict=True)
        sizes = np.fromiter(map(len, at), np.int64, len(at))
        at, n, starts = np.concatenate(at), np.concatenate(n), np.cumsum(sizes) - sizes
        known = np.add.reduceat(n * (trained[at] > 0), starts)
        # A token's first place in the text is spelled by the trie; at its later ones the text's own counts weigh in.
        again = np.repeat(np.arange(len(at)), n - 1)
        seen = np.arange(len(again)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
        model = np.log(weight) + logp[at] + np.bincount(again, np.log(weight * np.exp(logp[at][again]) + seen), len(at))
        length = np.add.reduceat(n, starts)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        scale = np.add.reduceat(np.log(weight + place), np.cumsum(length) - length)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": texts.column("n_tokens"), "n_known": known.astype(np.int64),
                         "train_tokens": np.full(texts.num_rows, total, np.int64), "base_score": np.add.reduceat(n * base[at], starts), "score": (np.add.reduceat(model, starts) - scale) / np.log(10)})
    return run


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", weight: float = WEIGHT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document (log10 scores).

    Tokens are the words of the lower-cased text and one end. Documents whose crc32(id) mod 5 is 1 are held out, the others are
    learned from: the base model from their token counts, the byte model (``step_scores``) from the same counts spelled out.
    Contexts do not reach back beyond the word's own blank, so the trie's probability p of a token is computed once per distinct
    token. Along a text the model adapts: after i tokens, of which c were this one, its probability is (weight * p + c) / (weight + i),
    that is, the text's own counts are asked first and the escape ``weight / (weight + i)`` leads to the pretrained trie.
    The product over a text depends on its counts only.

    Texts are cut into blocks of about ``TEXT_BLOCK`` bytes, written as token numbers with one dictionary per block. Only dictionaries
    meet the model: by token, then back by block. Model tables are sums over all training text and stay distributed; the
    driver sees two numbers. A frequent token is one row per block.

    NULL text counts as empty (one token, the end); a NULL id counts as empty text in the crc; repeated rows each count and get
    a row each; an empty table gives an empty result; without training text every symbol is equally likely. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = stage_table(rows.mapInArrow(_count, TEXT_DDL), "ppm-texts")
    texts = counted.filter("codes IS NOT NULL").select("blk", "doc_id", "held_out", "n_tokens", "codes")
    words = counted.filter("token IS NOT NULL").select("blk", "code", "token", "trained")
    vocabulary = words.groupBy("token").agg(F.sum("trained").alias("trained"))
    blocks = stage_table(vocabulary.mapInArrow(_steps, "blk long, token binary, trained long, step long, times long"), "ppm-steps")
    tokens = blocks.filter("token IS NOT NULL").select("blk", "token", "trained")
    total, distinct = tokens.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0)).first()
    spelled = blocks.filter("step IS NOT NULL").select("blk", "step", "times")
    scores = stage_table(step_scores(stage_table(spelled.groupBy("step").agg(F.sum("times").alias("times")), "ppm-counts")), "ppm-scores")
    needed = spelled.join(scores, "step").select(F.col("blk").alias("blk"), "step", "logp")  # a column of its own: both sides come from one table
    scored = tokens.groupBy("blk").cogroup(needed.groupBy("blk")).applyInArrow(lambda t, s: _token_scores(t, s), "token binary, trained long, logp double")
    scored = stage_table(scored, "ppm-tokens")
    answers = words.select("blk", "code", "token").join(scored, "token").select(F.col("blk").alias("blk"), "code", "trained", "logp")
    return texts.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(_text_scores(int(total), int(distinct), weight), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLES: dict[str, str] = {}
