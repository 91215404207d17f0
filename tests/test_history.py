"""Sentences before a citation, and offsets of several brackets, segments and years, against plain Python."""
import random
import re

from pyspark.sql import functions as F

from refaudit.functions.reference import is_turkish
from refaudit.operators import citations as C


def test_history_of_three_paragraphs_in_one_window(spark):
    """Up to three sentences of the section from the three paragraphs before; one sort of the paragraphs, not one per window."""
    rng = random.Random(7)
    rows = []
    for doc in range(6):
        for i in range(40):
            kind = rng.choice(["h", "e", "p", "p", "p", "p"])
            text = {"h": "Part", "e": "  "}.get(kind) or " ".join(f"S{i}x{j}." for j in range(rng.randint(1, 5)))
            rows.append((doc, f"p{i}", C.BODY, i, text, "Heading 1" if kind == "h" else "Body", "g"))
    df = spark.createDataFrame(rows, "doc_id int, paragraph_id string, part string, idx int, text string, style string, grp string")
    want, before = {}, []
    for doc, par, _, i, text, style, _ in rows:
        if i == 0 or style == "Heading 1":
            before = []
        if style == "Body" and text.strip():
            want[doc, par] = [s for t in before[-3:] for s in t.split()[-3:]][-3:]
            before.append(text)
    history = C.paragraph_history(df)
    assert {(r.doc_id, r.paragraph_id): r.prior for r in history.collect()} == want
    assert history._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_places_in_brackets(spark):
    texts = ["One (Ada, 2001).", "(x) Two (Ada, 2001; Bo, 2002, 2002a) and (Ada, 2001) and ((Bo, 2002)", "Tot (Ada, 2001, 2001; tin, 12; Bo, n.d.) ) (Cy, 2003",
             "t (Nat, 1999a)", " ".join(f"k{i} (Ada, {1900 + i}; Bo, {1950 + i}, 2000)" for i in range(40))]
    df = spark.createDataFrame([(1, f"p{i}", t, False) for i, t in enumerate(texts)], "doc_id int, paragraph_id string, text string, protected boolean")
    got = {(int(r.paragraph_id[1:]), r.start, r.original) for r in C.extract_citations(df).collect()}
    want = set()
    for i, t in enumerate(texts):
        for g in re.finditer(r"\(([^()]*)\)", t):
            at = g.start() + 1
            for seg in g[1].split(";"):
                if re.fullmatch(r"\s*[A-Z][a-z]+(, (\d{4}[a-z]?|n\.d\.))+", seg):
                    want |= {(i, at + y.start(), y[0]) for y in re.finditer(r"(?:18|19|20)\d\d[a-zA-Z]?|n\.d\.", seg)}
                at += len(seg) + 1
    assert got == want and len(want) > 120


def test_language_by_words(spark):
    words = ["bir", "bu", "ve", "ile", "için", "the", "this", "is", "a", "and", "over", "Bu", "VE", "ev", "thé", "İle", "sea"]
    tr, en = {"bir", "bu", "ve", "ile", "için"}, {"the", "a", "and", "is", "this"}
    rng = random.Random(3)
    texts = ["", "ve", *[rng.choice([" ", "-", ", "]).join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(300)]]

    def turkish(t):
        found = re.findall(r"[^\W\d_]+", t.lower())
        n, m = sum(w in tr for w in found), sum(w in en for w in found)
        return n > m or (n == m and bool(re.search("[çğıöşüÇĞÖŞÜ]", t)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", is_turkish(F.col("t"))).orderBy("i").collect()] == [turkish(t) for t in texts]


def test_citations_without_context(spark):
    """An audit for readers of neither sentence nor context finds the same citations, headings and bibliography left out alike."""
    from refaudit.plans.audit import analyze
    texts = [("Introduction", "Heading 1"), ("Ada (2001) and Bo (2002) agree. It holds (Cy, 2003).", "Body"), ("Results (Ada, 2001)", "Heading 2"), ("  ", "Body"),
             ("See (Adu, 2001; Nobody, 1999).", "Body"), ("References", "Heading 1"), ("Adamson, A. (2001). One.", "Body"), ("Ada, B. (2001). Two.", "Body"), ("Bo, C. (2001). Three.", "Body")]
    rows = [(1, f"p{i}", C.BODY, i, t, i == 4, False, "g", style) for i, (t, style) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, paragraph_id string, part string, idx int, text string, protected boolean, paragraph_locked boolean, grp string, style string")
    whole, bare = analyze(df), analyze(df, context=False)
    assert not {"sentence", "context"} & set(bare.citations.columns)
    assert sorted(map(str, bare.citations.collect())) == sorted(map(str, whole.citations.drop("sentence", "context").collect())) and bare.citations.count() == 5
    assert sorted(map(str, bare.findings.collect())) == sorted(map(str, whole.findings.collect()))
