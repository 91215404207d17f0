"""Near copies by five-word Jaccard against brute force: every pair at 0.8 or more is linked, and nothing below it."""
import numpy as np
import pytest

from refaudit.llm import shingles


def brute(texts, threshold=0.8):
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        w = min(5, len(words))
        sets.append({tuple(words[i:i + w]) for i in range(len(words) - w + 1)} if words else set())
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a | b else 1) >= threshold:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return sorted({top(i) for i in range(len(texts))})


def edited(rng):
    """Texts with a block replaced, and with single words replaced, on both sides of the threshold; short, equal and empty ones; a family
    whose members lie below the threshold from its first, some of them near one another."""
    texts = []
    for size in (20, 30, 36, 40, 42, 46, 50, 60, 80, 120):
        own = [f"w{x}" for x in rng.integers(0, 50_000, 400)]
        block = own[:100] + [f"n{x}" for x in rng.integers(0, 50_000, size)] + own[100 + size:]
        spread = list(own)
        for at in range(5, 400, max(8, 3000 // size)):
            spread[at] = "Changed"
        texts += [" ".join(own), " ".join(block), " ".join(spread)]
    base = [f"b{x}" for x in rng.integers(0, 50_000, 400)]
    texts.append(" ".join(base))
    for i in range(12):
        own = list(base)
        own[20 * i:20 * i + 55] = [f"f{i // 2}_{k}" for k in range(55)]
        texts.append(" ".join(own))
    return [*texts, texts[0], "", None, "one two", "ONE two", "one two three four five six", "one two three four five seven"]


@pytest.mark.parametrize("drop,cell", [(shingles.near_deduplicate, 2048), (shingles.near_deduplicate, 4)])
def test_links_are_exact(spark, drop, cell):
    """Also with cells of four rows."""
    texts = edited(np.random.default_rng(11))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "alone in the world of words", "s")], "doc_id long, text string, _sig string").repartition(3)
    out = drop(df, cell=cell)
    assert out.schema == df.schema
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == brute(texts) and got.count(None) == 1


def test_empty_table(spark):
    assert shingles.near_deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [38, 40, 60])
def test_bands_meet_block_edits(size):
    """Pairs at 0.80 to 0.85 with one passage replaced share a band."""
    rng = np.random.default_rng(size)
    for _ in range(30):
        own = [b"w%d" % x for x in rng.integers(0, 50_000, 640)]
        other = own[:100] + [b"n%d" % x for x in rng.integers(0, 50_000, size)] + own[100 + size:]
        sets = shingles.shingle_sets([b" ".join(own), b" ".join(other)])
        assert shingles.jaccard(*sets) >= 0.8
        a, b = shingles.minima(sets).reshape(2, shingles.BANDS, shingles.ROWS)
        assert (a == b).all(axis=1).any()
