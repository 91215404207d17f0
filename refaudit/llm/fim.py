"""Fill-in-middle transformation with a sparse exception index (operator 13)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.llm.common import shield, slices, table
from refaudit.operators.shaping import with_computed

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Rows whose third hash is at or above this share of a hundred stay plain; below ``SPM`` (fourth hash) the suffix comes first.
SPLIT, SPM = 90, 20
_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


class ExceptionIndex:
    """Code-point and byte offsets of one UTF-8 text, by its multibyte characters only.

    ``chars`` are the code-point positions of the multibyte characters and ``excess`` the bytes beyond one that they and all
    before them take. A cut lies as many bytes further than code points as the excess before it; pure ASCII has empty arrays.
    """

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        size = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
        self.excess = np.cumsum(size)
        self.chars = lead - (self.excess - size)
        self.n_chars = len(data) - int(self.excess[-1]) if len(lead) else len(data)

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte offsets of code-point offsets."""
        if not len(self.chars):
            return chars
        before = np.searchsorted(self.chars, chars, side="left")
        return chars + np.where(before > 0, self.excess[before - 1], 0)

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Code-point offsets of byte offsets that lie between characters."""
        if not len(self.chars):
            return at
        before = np.searchsorted(self.chars + self.excess, at, side="left")  # past the last byte of each multibyte character
        return at - np.where(before > 0, self.excess[np.maximum(before, 1) - 1], 0)


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which units begin: a run of ASCII letters is one unit, and so is each other character."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def cut_text(text: bytes, first: int, second: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of units, and the two cuts (after ``h % (n + 1)`` units each, the smaller first) in bytes and in code points."""
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data)
    n = len(starts)
    ends = np.append(starts, len(data))
    at = ends[sorted((first % (n + 1), second % (n + 1)))]
    return n, at, ExceptionIndex(data).to_chars(at)


def _rearranged(marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    @F.arrow_udf("struct<n:long,out:string,prefix_chars:long,middle_chars:long>")
    def run(texts: pa.Array, form: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        counts, outs, prefixes, middles = [], [], [], []
        forms, h1, h2 = form.to_pylist(), first.to_pylist(), second.to_pylist()
        for row, block in slices(texts):
            for i, text in enumerate(block, row):
                n, (a, b), (ca, cb) = cut_text(text, h1[i], h2[i])
                counts.append(n)
                if forms[i] == "plain":
                    outs.append(text)
                elif forms[i] == "psm":
                    outs.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
                else:
                    outs.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                prefixes.append(None if forms[i] == "plain" else int(ca))
                middles.append(None if forms[i] == "plain" else int(cb - ca))
        columns = [pa.array(counts, pa.int64()), pa.array(outs, pa.binary()).cast(pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64())]
        return pa.StructArray.from_arrays(columns, ["n", "out", "prefix_chars", "middle_chars"])
    return run


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they lie: none holds another, and none ends as one begins."""
    for i, x in enumerate(marks):
        for j, y in enumerate(marks):
            clash = (i != j and y in x) or any(x.endswith(y[:k]) for k in range(1, len(y)))
            if not x or clash:
                raise ValueError(f"marks {marks} overlap")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = "1", split: int = SPLIT, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All rows and columns of ``docs`` with ``n, form, fim_text, prefix_chars, middle_chars``.

    A text is cut at two of its unit borders, drawn from a hash of ``seed`` and the id, into prefix, middle and suffix; ``fim_text``
    has them as ``<P>prefix<S>suffix<M>middle`` (form ``psm``) or ``<S>suffix<P>prefix<M>middle`` (``spm``). Form ``plain`` keeps the
    text: empty texts, texts that hold a mark, and ``100 - split`` of a hundred others; their two lengths are NULL.

    NULL text counts as empty, a NULL id as the empty string. Rows of one id and text come out alike; an empty table stays empty.
    Old columns of the five new names are left out. Nothing is shuffled; a task holds one Arrow batch.
    """
    _checked(marks)
    rows, named, restore = shield(docs, ("n", "form", "fim_text", "prefix_chars", "middle_chars"))
    body = F.coalesce(F.col(named(text)).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(named(doc_id)).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(body, F.lit(mark))
    form = F.when((body == "") | marked | (h[2] % 100 >= split), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    made = rows.withColumn("made", _rearranged(marks)(body, "form", h[0], h[1]))
    made = made.select(*rows.columns, "made.n", F.col("made.out").alias("fim_text"), "made.prefix_chars", "made.middle_chars")
    return restore(made)


def restored(form: Column, made: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` rearranged, from its output and form alone."""
    p, s, m = marks
    first, second = F.when(form == "psm", F.lit(p)).otherwise(F.lit(s)), F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    inner = F.substr(made, F.length(first) + 1)
    head, rest = F.split_part(inner, second, F.lit(1)), F.split_part(inner, second, F.lit(2))
    tail, middle = F.split_part(rest, F.lit(m), F.lit(1)), F.split_part(rest, F.lit(m), F.lit(2))
    whole = F.when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
    return F.when(form == "plain", made).otherwise(whole)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = with_computed(docs.drop("text"), out=F.col("fim_text"))
    back = restored(F.col("form"), F.col("out"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("out", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLES = {"op13_fill_in_middle": """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""}
