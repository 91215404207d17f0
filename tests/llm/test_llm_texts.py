"""Tokenizer alignment, decontamination and fill-in-middle against plain brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from refaudit.llm import decontamination, fim, tokenizer_spans

A_PATH, B_PATH = public_tokenizers.path(tokenizer_spans.BYTE_BPE), public_tokenizers.path(tokenizer_spans.PIECE_BPE)
SIGNS = ["a", "b", " ", "  ", "\n", "é", "日本", "🙂", " ", "　", "▁", "ﬁ", "'s", "<s>", "<|endoftext|>", "1", "23", ".", "\x1c", "ŋ", "é", " The", "word", "<P>", "ab cd"]


def odd_texts(n=300, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randint(1, 16))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill-in-middle

def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_middle(spark):
    long = "Längere Wörter 日本 ab" * 20_000
    texts = [*odd_texts(), None, "", long, "a", "é", "<", "<<S", "S>x<", "M><P", long]
    rows = [(i, t, "kept", 7, "n") for i, t in enumerate(texts)] + [(None, "no id at all", "k", 1, "x"), (5, texts[5], "kept", 7, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, in0 string, made int, FORM string").repartition(3)
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "in0", "made", "n", "form", "fim_text", "prefix_chars", "middle_chars"]
    got = out.withColumn("back", fim.restored(F.col("form"), F.col("fim_text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["fim_text"], r["prefix_chars"], r["middle_chars"]) == brute_fim(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["in0"] in ("kept", "k")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_marks_that_overlap_are_refused(spark):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([(1, "x")], "doc_id long, text string"), marks=("<a", "a<", "<M>"))


@pytest.mark.parametrize("text", ["", "plain", "é", "aé日🙂b", "🙂🙂", "x" * 50 + "ñ"])
def test_exception_index(text):
    index = fim.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    chars = np.arange(len(text) + 1)
    at = np.array([len(text[:i].encode()) for i in chars])
    assert index.to_bytes(chars).tolist() == at.tolist() and index.to_chars(at).tolist() == chars.tolist()
    assert index.n_chars == len(text) and len(index.chars) == sum(c > "\x7f" for c in text)  # nothing is kept for ASCII


# decontamination

def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(texts, items, window=10):
    out = []
    for t in texts:
        words, hit, held = doc_words(t), set(), set()
        for item, text in items:
            own = doc_words(text)
            k = min(window, len(own))
            for s in range(len(own) - k + 1 if own and item is not None else 0):
                for at in range(len(words) - k + 1):
                    if words[at:at + k] == own[s:s + k]:
                        hit.update(range(at, at + k))
                        held.add(str(item))
        out.append((len(words), len(hit), sorted(held)))
    return out


def leaky(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 10, 11, 25, 60])))) for i in range(25)]
    items += [(100, items[4][1]), (101, items[4][1].upper()), (102, "solo"), (103, "one two three four five"), (104, None), (105, " . "), (None, items[0][1]), (10, "w1 w2"), (9, "é alone")]
    texts = [None, "", "...", "solo", "Solo; SOLO solo", "É alone é alone", "one two three four fives", "one-two-three four five six"]
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            words = doc_words(rng.choice(items)[1])
            at = rng.randrange(len(words) + 1)
            parts += [", ".join(words[at:at + rng.randint(1, 40)]).title(), " ".join(rng.choices(vocabulary, k=rng.randint(0, 5)))]
        texts.append(" ".join(parts))
    texts += [items[2][1] + " " + " ".join(rng.choices(vocabulary, k=20_000)) + " " + items[3][1], texts[20]]
    return texts, items


@pytest.mark.parametrize("block", [200_000, 40])
def test_contamination(spark, block):
    """Also with the windows in many blocks."""
    texts, items = leaky()
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "s") for i, t in enumerate(texts)], "doc_id long, text string, row int, n_words int, wid int, pos string").repartition(3)
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    out = decontamination.contamination(docs, bench, block=block)
    assert out.columns == ["doc_id", "text", "row", "wid", "pos", "n_words", "n_hit", "items"]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), bench).collect() == []
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench.limit(0)).collect()) == [(0, 0, []), (0, 0, []), (2, 0, [])]
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(docs, bench).collect()) == [(0, 0, []), (0, 0, []), (2, 2, ["1"])]


def test_decontamination_uses_no_python(spark, tmp_path):
    texts, items = leaky()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# alignment

def brute_alignment(pair, text):
    """Token ids and common byte ends by the entries' bytes alone, of the whole text."""
    if not text:
        return None
    data = (" " + text).encode()
    ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    parts = [pair.a_bytes[i] for i in ids[0]], [pair.b_bytes[i] for i in ids[1]]
    if any(b"".join(p) != data for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    low, groups, links = 0, [], Counter()
    for end in sorted(set(ends[0]) & set(ends[1])):
        a, b = ([i for i, e in zip(own, to, strict=True) if low < e <= end] for own, to in zip(ids, ends, strict=True))
        groups.append((a, b, end))
        links.update((i, j) for i in a for j in b)
        low = end
    return len(ids[0]), len(ids[1]), groups, links


@pytest.fixture(scope="module")
def pair():
    return tokenizer_spans.Pair(A_PATH, B_PATH)


def aligned_texts():
    return ["", None, "aaaa" * 2000, "日本ŋ🚀" * 300, "one word and another word", "one word and another word", "x ▁ y", "\x00 z", *odd_texts(600, 8), "Many words. " * 3000]


@pytest.mark.parametrize("remembered", [300_000, 50])
def test_alignment(pair, monkeypatch, remembered):
    """Chunks, also with a memory of few of them, and whole texts give what the entries' bytes give."""
    monkeypatch.setattr(tokenizer_spans, "REMEMBERED", remembered)
    texts = aligned_texts()
    missing = 0
    for at in range(0, len(texts), 70):
        own = tokenizer_spans.align_texts(pair, [(t or "").encode() for t in texts[at:at + 70]])
        to, pairs_to = np.cumsum(own.n_ends), np.cumsum(own.n_pairs)
        for i, text in enumerate(texts[at:at + 70]):
            want = brute_alignment(pair, text)
            missing += want is None
            n_a, n_b, groups, links = want or (0, 0, [], Counter())
            assert (own.n_a[i], own.n_b[i]) == (n_a, n_b)
            assert own.groups[i] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
            assert own.ends[to[i] - own.n_ends[i]:to[i]].tolist() == [e for _, _, e in groups]
            mine = slice(pairs_to[i] - own.n_pairs[i], pairs_to[i])
            assert dict(zip(own.pairs[mine].tolist(), own.links[mine].tolist(), strict=True)) == {a * pair.size_b + b: n for (a, b), n in links.items()}
    assert 20 < missing < len(texts) / 2


def test_coarse_cuts_are_refined(pair):
    """A character that several tokens share has one span for all of them; their bytes tell them apart."""
    data = " 🚀é".encode()
    coded = pair.a.encode(data.decode(), add_special_tokens=False)
    spans = np.array(coded.offsets)
    index = fim.ExceptionIndex(np.frombuffer(data, np.uint8))
    lengths = np.array([len(pair.a_bytes[i]) for i in coded.ids])
    coarse = index.to_bytes(spans[:, 1])
    assert len(set(coarse.tolist())) < len(coarse)  # spans alone are not enough
    assert tokenizer_spans.refined(coarse, lengths).tolist() == np.cumsum(lengths).tolist()


def test_alignment_query(spark, pair, tmp_path):
    texts = aligned_texts()
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    own = [brute_alignment(pair, t) for t in texts]
    counts, tops = Counter(), defaultdict(int)
    for x in own:
        counts.update(set(x[3]) if x else ())
    for (a, _), n in counts.items():
        tops[a] = max(tops[a], n)
    for block in (tokenizer_spans.BLOCK, 30):
        got = {r["doc_id"]: r for r in tokenizer_spans.op11_alignment(spark, str(tmp_path), block).collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(own):
            n_a, n_b, groups, links = x or (0, 0, [], Counter())
            digest = sha(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)) if x else ""
            best = sum(n for (a, b), n in links.items() if counts[a, b] == tops[a])
            want = (i, n_a, n_b, len(groups), sum(links.values()), best, sum(n * counts[k] for k, n in links.items()), digest)
            assert tuple(got[i]) == want


def test_alignment_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "p"), (1, "a b", 5, "p"), (None, None, None, None)], "doc_id long, text string, row int, Pairs string")
    out = tokenizer_spans.aligned(docs, A_PATH, B_PATH)
    assert out.columns == ["doc_id", "text", "row", *tokenizer_spans.ADDED]
    rows = out.orderBy("doc_id").collect()
    assert [r["n_a"] for r in rows] == [0, 2, 2] and rows[0]["pairs"] == [] and rows[1] == rows[2]
    assert tokenizer_spans.aligned(docs.limit(0), A_PATH, B_PATH).collect() == []
    assert tokenizer_spans.linked_counts(out.limit(0), 32_000).collect() == []
