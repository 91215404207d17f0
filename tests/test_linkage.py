"""Linkage: decisions on small catalogs, and exactness of the similarity join against brute force."""
import random

from pyspark.sql import functions as F

from refaudit.operators import linkage as K
from refaudit.plans import verification as P

WORK = ("work_id bigint, provider string, provider_rank int, row_rank int, title string, author array<struct<family:string,given:string,literal:string>>, year int, doi string, container_title string, "
        "volume string, issue string, pages string, type string, publisher string, language string, editor array<struct<family:string,given:string,literal:string>>, requires_review boolean, url string")
TITLE = "Silt: Slow Filling of Old Tidal Basins along Sheltered Harbour Coasts"
RAW = "Halden, J. (2019). Silt: Slow filling of old tidal basins along sheltered harbour coasts. Shore Records."


def work(i, provider="Crossref", title=TITLE, family="Halden", year=2019, doi="10.5555/tide.77", review=False):
    return (i, provider, 0, i, title, [(family, "Mira", None)], year, doi, "Shore Records", "", "", "", "", "", "", [], review, f"https://doi.org/{doi}")


def verify(spark, raws, works, **kw):
    refs = spark.createDataFrame(list(enumerate(raws)), "ref_id bigint, raw string")
    return P.verify_references(refs, spark.createDataFrame(works, WORK), **kw).orderBy("ref_id").collect()


def test_decisions(spark):
    raws = [RAW, RAW.replace("2019", "2021"), RAW.replace("Halden", "Other"), RAW.replace(". Shore Records.", ", Shore Records, 1: 20-30."), "Kimse, A. (1999). No such work was ever written.", RAW + " https://doi.org/10.9999/incorrect"]
    rows = verify(spark, raws, [work(1, title="Something else entirely here"), work(2)])
    assert [r.status for r in rows] == ["verified", "review", "review", "verified", "failed", "review"]
    assert [r.corrected == r.raw for r in rows] == [False, True, True, False, True, True]
    assert "10.5555/tide" in rows[5].suggested and rows[0].work_id == 2 and rows[0].sources_checked == ["Crossref"]


def test_cascade_and_outage(spark):
    datacite = work(1, "DataCite", doi="10.48550/x.test")
    r = verify(spark, [RAW + " https://doi.org/10.48550/x.test"], [datacite])[0]
    assert (r.status, r.provider, r.sources_checked) == ("verified", "DataCite", ["Crossref", "DataCite"])
    eric = verify(spark, ["Kern, A. (2020). A record of education."], [work(1, "ERIC", "A record of education", "Kern", 2020, "")])[0]
    assert eric.status == "verified" and "ERIC" in eric.sources_checked and "CORE" not in eric.sources_checked
    arxiv = verify(spark, ["Kern, A. (2023). A record of education. https://arxiv.org/abs/2401.01234"], [work(1, "arXiv", "A record of education", "Kern", 2023, "10.48550/arxiv.2401.01234")])[0]
    assert (arxiv.status, arxiv.sources_checked, arxiv.fallback_needed) == ("verified", ["arXiv"], False)
    errors = spark.createDataFrame([(0, 0, "Crossref", 503, "Crossref: HTTP 503", None)], "ref_id bigint, seq int, provider string, status int, message string, retry_at timestamp")
    down = verify(spark, [RAW], [work(1)], errors=errors)[0]
    assert down.status == "error" and down.corrected == RAW and down.warnings == ["Crossref: HTTP 503"]


def test_two_phase_equals_one_phase(spark):
    refs = spark.createDataFrame([(0, RAW), (1, "Kern, A. (2020). A record of education.")], "ref_id bigint, raw string")
    works = spark.createDataFrame([work(1), work(2, "ERIC", "A record of education", "Kern", 2020, "")], WORK)
    a = {(r.ref_id, r.status, r.work_id) for r in P.verify_references(refs, works).collect()}
    assert a == {(r.ref_id, r.status, r.work_id) for r in P.two_phase_verify(refs, works).collect()}


def _random_titles(rng, n):
    common, rare = ["the", "of", "a", "study", "in"], [f"w{i}" for i in range(25)]
    return [" ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_title_pairs_are_exact(spark, monkeypatch):
    """A small threshold forces the salted grid; short and long titles, one and two shared words."""
    monkeypatch.setattr(K, "HOT_TOKEN_ROWS", 5)
    rng = random.Random(7)
    a, b = sorted(set(_random_titles(rng, 120))), sorted(set(_random_titles(rng, 120)))
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "title_norm string")
    got = {(r.q_title_norm, r.title_norm): round(r.title_match, 9) for r in K.title_pairs(df(a), df(b)).collect()}

    def score(x, y):
        if len(y.split()) >= 4 and x.startswith(y + " "):
            return 1.0
        return len(set(x.split()) & set(y.split())) / max(len(set(x.split())), len(set(y.split())))
    want = {(x, y): round(score(x, y), 9) for x in a for y in b if score(x, y) >= 0.45}
    assert got == want


def test_long_titles_are_exact(spark, monkeypatch):
    """Badly parsed entries of up to 120 words, on both sides of every border between bands of lengths."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]

    def near(base, drop, add):
        kept = rng.sample(base, len(base) - drop)
        return " ".join(kept + rng.sample([v for v in vocabulary if v not in base], add))
    bases = [rng.sample(vocabulary, n) for n in (8, 10, 19, 20, 21, 22, 44, 45, 46, 60, 97, 98, 99, 120)]
    a = {" ".join(x) for x in bases}
    b = {near(x, int(len(x) * d), int(len(x) * e)) for x in bases for d in (0, .1, .5, .56) for e in (0, .3, 1.2)} | {" ".join(bases[3]), " ".join(bases[8])}
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "title_norm string")
    got = {(r.q_title_norm, r.title_norm): round(r.title_match, 9) for r in K.title_pairs(df(a), df(b)).collect()}

    def score(x, y):
        if len(y.split()) >= 4 and x.startswith(y + " "):
            return 1.0
        return len(set(x.split()) & set(y.split())) / max(len(x.split()), len(y.split()))
    assert got == {(x, y): round(score(x, y), 9) for x in a for y in b if score(x, y) >= 0.45} and len(got) > 60


def test_signatures_grow_with_the_title(spark):
    """A title of 300 words has under 1,000 signatures, one of 3,000 words ten times as many."""
    titles = K._numbered(spark.createDataFrame([(" ".join(f"u{i}" for i in range(n)),) for n in (20, 300, 3000)], "title_norm string"),
                         spark.createDataFrame([(" ".join(f"u{i}" for i in range(n)),) for n in (20, 300, 3000)], "title_norm string"))
    for side in "ab":
        counts = dict(K._signatures(titles, side).groupBy(f"{side}_n").count().collect())
        assert counts[20] < 200 and counts[300] < 1000 and counts[3000] < 10_000


def test_crowded_titles_lose_nothing(spark, monkeypatch):
    """Works under one title, indexed by class, give the same best k as comparing everything."""
    rng = random.Random(3)
    works = [(i, "Crossref", 0, i % 50, "editorial", [rng.choice(["ann kern", "kern", "bo li"])], rng.choice([2000, 2001, None]), rng.choice(["", "10.1/a", "10.1/b"]), False) for i in range(300)]
    schema = "work_id bigint, provider string, provider_rank int, row_rank int, title_norm string, author_norms array<string>, year int, doi string, requires_review boolean"
    qs = [(f"{a}{y}{d}", "editorial", a, y, d) for a in ("kern", "ann kern", "zed", "") for y in (2000, None) for d in ("10.1/a", "")]
    q = spark.createDataFrame(qs, "query_id string, title_norm string, first_author_norm string, year int, doi string")
    w = spark.createDataFrame(works, schema)
    pick = lambda: {(r.query_id, r.work_id, r.score) for r in K.match_by_title(q, w, 5).collect()}
    monkeypatch.setattr(K, "HOT_TITLE_WORKS", 10)
    hot = pick()
    want = set()
    for qid, _t, a, y, d in qs:
        scored = []
        for (i, _p, pr, rr, _ti, names, wy, wd, _r) in works:
            s = 60 + (20 if a and any(f" {a} " in f" {n} " for n in names) else 0) + (10 if y is not None and y == wy else 0) + (10 if d and d == wd else 0)
            scored.append((-s, pr, rr, i, (tuple(names), wy, wd)))
        scored.sort()
        want |= {(qid, x[3], -x[0]) for x in scored[:5]}
    assert hot == want
    monkeypatch.setattr(K, "HOT_TITLE_WORKS", 10_000)
    assert pick() == want


def test_frequent_words_lose_no_best_work(spark, monkeypatch):
    """Titles that share frequent words with very many others: few pairs are compared, and the best k are those of comparing all."""
    monkeypatch.setattr(K, "LEAF_TITLES", 3)
    rng = random.Random(11)
    title = lambda i: " ".join([rng.choice(["hot", "blue"]), rng.choice(["rod", "gear"]), f"x{i % 90}", f"y{i % 7}", "analysis"][:rng.choice([2, 4, 5, 5, 5])] + ["more", "of", "it"][:rng.choice([0, 0, 1, 3])])
    works = [(i, rng.choice(["Crossref", "CORE"]), i % 2, i % 9, title(i), [rng.choice(["ann kern", "kern", "bo li"])], rng.choice([2000, 2001, None]), rng.choice(["", "10.1/a"]), False) for i in range(300)]
    qs = [(f"q{i}", title(i * 3), rng.choice(["kern", "zed", ""]), rng.choice([2000, None]), rng.choice(["10.1/a", ""])) for i in range(60)]
    w = spark.createDataFrame(works, "work_id bigint, provider string, provider_rank int, row_rank int, title_norm string, author_norms array<string>, year int, doi string, requires_review boolean")
    q = spark.createDataFrame(qs, "query_id string, title_norm string, first_author_norm string, year int, doi string")
    got = {(r.query_id, r.provider, r.work_id, r.score) for r in K.match_by_title(q, w, 3).collect()}
    want = set()
    for qid, t, a, y, d in qs:
        scored = {}
        for (i, p, pr, rr, wt, names, wy, wd, _r) in works:
            s, u = set(t.split()), set(wt.split())
            m = 1.0 if len(wt.split()) >= 4 and t.startswith(wt + " ") else len(s & u) / max(len(s), len(u))
            if m >= 0.45:
                n = m * 60 + (20 if a and any(f" {a} " in f" {x} " for x in names) else 0) + (10 if y is not None and y == wy else 0) + (10 if d and d == wd else 0)
                scored.setdefault(p, []).append((-int(n + 0.5), pr, rr, i))
        want |= {(qid, p, x[3], -x[0]) for p, rows in scored.items() for x in sorted(rows)[:3]}
    assert got == want and len(want) > 200

    def compared(n):
        frame = spark.createDataFrame([(f"hot rod u{i} v{i} w{i % 5} analysis",) for i in range(n)], "title_norm string")
        return K._shared_sets(K._coded(frame, frame))[0].count()
    assert compared(400) <= 2 * compared(200) + 400


def test_sure_scores_and_dois_lose_no_best_work(spark, monkeypatch):
    """Lists skip providers that are sure to have better works, and know frequent DOIs only; the best k stay those of comparing all."""
    monkeypatch.setattr(K, "LEAF_TITLES", 2)
    rng = random.Random(23)
    title = lambda i: f"{rng.choice(['hot', 'blue'])} {rng.choice(['rod', 'gear'])} x{i % 3} y{i % 40} analysis"
    works = [(i, rng.choice(["Crossref", "CORE"]), i % 2, i % 9, title(i), [rng.choice(["kern", "li"])], rng.choice([2000, 2001]), rng.choice(["", "10.1/a", f"10.1/{i % 25}"]), False) for i in range(240)]
    qs = [(f"q{i}", title(i * 3), rng.choice(["kern", "zed"]), rng.choice([2000, None]), rng.choice(["10.1/a", f"10.1/{i % 25}", ""])) for i in range(40)]
    w = spark.createDataFrame(works, "work_id bigint, provider string, provider_rank int, row_rank int, title_norm string, author_norms array<string>, year int, doi string, requires_review boolean")
    q = spark.createDataFrame(qs, "query_id string, title_norm string, first_author_norm string, year int, doi string")
    want = set()
    for qid, t, a, y, d in qs:
        scored = {}
        for (i, p, pr, rr, wt, names, wy, wd, _r) in works:
            s, u = set(t.split()), set(wt.split())
            m = len(s & u) / max(len(s), len(u))
            if m >= 0.45:
                n = m * 60 + (20 if a in names else 0) + (10 if y == wy else 0) + (10 if d and d == wd else 0)
                scored.setdefault(p, []).append((-int(n + 0.5), pr, rr, i))
        want |= {(qid, p, x[3], -x[0]) for p, rows in scored.items() for x in sorted(rows)[:2]}
    for hot in (20, 10_000):
        monkeypatch.setattr(K, "HOT_TITLE_WORKS", hot)
        assert {(r.query_id, r.provider, r.work_id, r.score) for r in K.match_by_title(q, w, 2).collect()} == want
    sets = lambda *rows: spark.createDataFrame(rows, "id bigint, n int, shared int, set bigint")
    kept = spark.createDataFrame([(i, "Crossref", i) for i in range(4)], "b_id bigint, provider string, work_id bigint")
    sure = K._sure_scores(sets((9, 6, 3, 0), (9, 6, 4, 1)), sets(*[(i, 6, 3, 0) for i in range(4)], (0, 6, 4, 1), (1, 8, 4, 1)), kept, 2)
    assert [(r.a_id, r.sure) for r in sure.collect()] == [(9, {"Crossref": 30})]
    assert K._sure_scores(sets((9, 6, 4, 1)), sets((0, 6, 4, 1), (1, 7, 4, 1)), kept, 2).first().sure == {"Crossref": 34}


def test_title_pairs_shuffle_titles_not_pairs(spark):
    """Pairs are settled where two titles meet: nothing above that join shuffles them or drops repeats, and no pair comes twice."""
    rng = random.Random(11)
    a, b = _random_titles(rng, 60) + ["x y", "y z"], _random_titles(rng, 60) + ["y x", "z q", " ".join(f"l{i}" for i in range(30))]
    a.append(" ".join(f"l{i}" for i in range(8, 34)))
    frame = spark.createDataFrame([(t, True) for t in a] + [(t, False) for t in b], "title_norm string, a boolean")
    out = K.title_overlaps(K._numbered(frame.where("a").select("title_norm"), frame.where("not a").select("title_norm")))
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Aggregate" not in above and "Repartition" not in above
    rows = [(r.q_title_norm, r.title_norm) for r in out.collect()]
    assert len(rows) == len(set(rows)) and {("x y", "y x"), (a[-1], b[-1])} <= set(rows)


def test_small_inputs_stage_no_empty_steps(spark, monkeypatch):
    """Sets of shared words are not taken further once none is frequent, and without long titles none are numbered for them."""
    staged, real = [], K.stage_table
    monkeypatch.setattr(K, "stage_table", lambda df, label: staged.append(label) or real(df, label))
    refs = spark.createDataFrame([(0, RAW), (1, "Kern, A. (2020). A record of education.")], "ref_id bigint, raw string")
    qs = K.prepare_references(refs).withColumn("query_id", F.col("ref_id").cast("string"))
    works = K.prepare_catalog(spark.createDataFrame([work(1), work(2, "ERIC", "A record of education", "Kern", 2020, "")], WORK))
    assert {(r.query_id, r.work_id) for r in K.match_by_title(qs, works).collect()} == {("0", 1), ("1", 2)}
    assert staged.count("frequent-words") == staged.count("titles") == 1
