"""Manuscript audit on golden paragraphs."""
import pytest
from pyspark.sql import functions as F

from refaudit.functions import labels as L
from refaudit.operators import citations as C
from refaudit.operators import edits as E
from refaudit.plans.audit import analyze

SCHEMA = "doc_id bigint, paragraph_id string, part string, idx int, text string, protected boolean, paragraph_locked boolean, grp string, style string"
ENTRIES = ["Almeida, T., & Brandt, K. (2018). Lake ice.", "Castell, U., Dorn, V., & Ekman, W. (2020). Snow loads.", "Castell, U. (2019). Frost heave.", "Polar Weather Union (PWU). (2017). Station list.",
           "Grimaldi AI. (2022). Annual note.", "Von Essen, H. (2016). Moraines.", "Hollis, P. (2021). First winter.", "Hollis, P. (2021). Second winter.", "Iverson, R. (n.d.). Diary.", "Jansen, O. (2014). Never used."]
# One paragraph for each rule: its text and the (author text, year, entry) that must come out of it.
CASES = {
    "two authors are found from the second": ("Almeida and Brandt (2018) agree on this.", [("Almeida and Brandt", "2018", "r0")]),
    "a complete list stops the walk": ("Earlier, Marsh, Castell, Dorn, & Ekman (2020) weighed it.", [("Castell, Dorn, & Ekman", "2020", "r1")]),
    "an incomplete list goes back to its end": ("Marsh ve Dorn (2020) did not.", [("Marsh ve Dorn", "2020", None)]),
    "a list may have its possessive": ("Castell, Dorn and Ekman's (2020) scale.", [("Castell, Dorn and Ekman's", "2020", "r1")]),
    "others are abbreviated": ("The Castell et al. (2020) series and Castell vd. (2019).", [("Castell et al.", "2020", "r1"), ("Castell vd.", "2019", "r2")]),
    "institutions by their short names": ("PWU (2017) lists it (Grimaldi, 2022, pp. 4-9).", [("PWU", "2017", "r3"), ("Grimaldi", "2022", "r4")]),
    "a small first letter": ("By von Essen’s (2016) map.", [("von Essen’s", "2016", "r5")]),
    "several in one bracket, one without date": ("Both say so (Iverson, n.d.; Almeida & Brandt, 2018).", [("Iverson", "n.d.", "r8"), ("Almeida & Brandt", "2018", "r0")]),
    "two entries of one author and year": ("It was cold (Hollis, 2021).", [("Hollis", "2021", None)]),
    "another year": ("It was mild, says Hollis (2011); von Essen (2011) too.", [("Hollis", "2011", None), ("von Essen", "2011", "r5")]),
    "one letter wrong": ("Soils rise (Casteli, 2019).", [("Casteli", "2019", None)]),
    "nobody of that name": ("Unknown hands (Zorn, 2011).", [("Zorn", "2011", None)]),
    "neither ranges nor models, letters, weights or pages": ("See 1990–1995 (winters 1990–1995), (model year 2019), (R. Dorn, personal communication, 2020), 3 kg (2018), (p. 12).", [])}
TEXTS = [t for t, _ in CASES.values()]


@pytest.fixture(scope="module")
def paragraphs(spark):
    """The cases, a bibliography between two headings, and a paragraph behind it; the unknown author's paragraph is protected."""
    tail = [("Kaynaklar", "Heading 1"), *[(e, "Body") for e in ENTRIES], ("Appendix", "Heading 1"), ("Later text without source (2030).", "Body")]
    lines = [(t, "Body") for t in TEXTS] + tail
    rows = [(1, f"p{i}", C.BODY, i, t, "Zorn" in t, False, "body", style) for i, (t, style) in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def audit(paragraphs):
    return analyze(paragraphs)


@pytest.fixture(scope="module")
def cited(audit):
    return audit.citations.collect()


@pytest.mark.parametrize("rule", CASES)
def test_rules_of_citations(cited, rule):
    text, want = CASES[rule]
    rows = sorted((r for r in cited if r.paragraph_id == f"p{TEXTS.index(text)}"), key=lambda r: r.start)
    assert [(r.author_text, r.year_key, r.reference) for r in rows] == want
    for r in rows:
        assert text[r.start:r.end] == r.original and text[r.author_start:r.author_end] == r.author_text and r.context[-1] == r.sentence


def test_issues(cited):
    by = {(r.author_text, r.year_key): r for r in cited}
    assert len(cited) == sum(len(want) for _, want in CASES.values())
    assert by["von Essen", "2011"].issue == L.ISSUE_YEAR and by["von Essen", "2011"].patch is None and by["von Essen", "2011"].review_reason
    assert by["Hollis", "2021"].candidates == ["r6", "r7"] and by["Hollis", "2021"].kind == L.ISSUE_AMBIGUOUS and by["Hollis", "2011"].kind == L.ISSUE_YEAR_MANY
    assert by["Casteli", "2019"].candidate == "r2" and by["Casteli", "2019"].patch.replacement == "Castell"
    assert by["Zorn", "2011"].issue == f"{L.ISSUE_ORPHAN} · {L.ISSUE_PROTECTED}" and by["Zorn", "2011"].patch is None
    assert by["Castell et al.", "2020"].issue is None and by["Castell, Dorn, & Ekman", "2020"].issue is None


def test_findings(audit):
    ids = {r.finding_id for r in audit.findings.collect()}
    assert {i for i in ids if i.startswith("orphan-")} == {"orphan-r9"} and not any(i.startswith("duplicate") for i in ids)


def test_duplicates(spark):
    raws = ["Ivers, N. (2025). Slow tides. arXiv:2401.01234.", "Dunn, S. (2025). Slow tides. https://arxiv.org/abs/2401.01234v3", "Kaya, D. (2025). Port news. https://harbour.example.org/2025/port/",
            "Harbour Post. (2026). Port news. https://www.harbour.example.org/2025/port/", "Aksu, A. (2025). Left. https://sea.example.net/", "Bilir, B. (2026). Right. https://sea.example.net/"]
    refs = spark.createDataFrame([(1, f"r{i}", r) for i, r in enumerate(raws)], "doc_id int, ref_id string, raw string")
    assert {r.ref_id: r.related for r in C.duplicate_references(refs).collect()} == {"r0": ["r1"], "r1": ["r0"], "r2": ["r3"], "r3": ["r2"]}


def test_patches(spark, paragraphs, audit):
    wrong = f"p{TEXTS.index('Soils rise (Casteli, 2019).')}"
    patches = E.suggest_patches(audit.citations).where(F.col("paragraph_id") == wrong)
    text = lambda p: E.apply_patches(paragraphs, p).where(F.col("paragraph_id") == wrong).first().text
    assert text(patches) == "Soils rise (Castell, 2019)."
    stale = patches.withColumn("original", F.lit("wrong"))
    assert E.rejected_patches(paragraphs, stale).count() == stale.count() == 1 and text(stale) == "Soils rise (Casteli, 2019)."
    assert E.undo(patches, patches).count() == 0


def test_similarity(spark):
    rows = spark.createDataFrame([(1, "same text", "same  text"), (2, "night", "nacht"), (3, "x", None)], "k int, a string, b string")
    assert [r.similarity for r in E.dice_similarity(rows, "k", "a", "b").orderBy("k").collect()] == [100, 25, None]


def test_refused_groups_refuse_nobody(spark):
    """A chain of overlaps is tried in order: each group only gives way to those that were applied."""
    texts = [(1, "p0", "abcdefghijklmnop", False), (1, "p1", "abcdefghijklmnop", False), (1, "p2", "locked", True)]
    par = spark.createDataFrame(texts, "doc_id bigint, paragraph_id string, text string, protected boolean")

    def patch(group, paragraph, start, end, original=None):
        return (1, paragraph, start, end, "abcdefghijklmnop"[start:end] if original is None else original, group.upper(), group)
    rows = [patch("a", "p0", 0, 4), patch("b", "p0", 2, 7), patch("c", "p0", 5, 9), patch("d", "p0", 8, 12), patch("e", "p0", 11, 13), patch("f", "p0", 12, 14),  # a c e, by turns
            patch("g", "p0", 14, 16), patch("g", "p1", 0, 3, "stale"), patch("h", "p0", 15, 16),                  # g is refused whole, so h goes through
            patch("i", "p1", 1, 4), patch("i", "p2", 0, 1, "l"), patch("j", "p1", 2, 5), patch("k", "p1", 6, 9), patch("k", "p1", 7, 10),  # locked; free; against itself
            patch("m", "p1", 10, 10, ""), patch("n", "p9", 0, 1, "x")]                                             # an insertion; no such paragraph
    patches = spark.createDataFrame(rows, "doc_id bigint, paragraph_id string, start int, `end` int, original string, replacement string, group_id string").repartition(3)
    assert sorted({r.group_id for r in E.rejected_patches(par, patches).collect()}) == ["b", "d", "f", "g", "i", "k", "n"]
    assert {r.paragraph_id: r.text for r in E.apply_patches(par, patches).collect()} == {"p0": "AeCjkEnoH", "p1": "abJfghijMklmnop", "p2": "locked"}
    assert E.apply_patches(par, patches.limit(0)).collect() == par.collect()


def test_both_patches_of_a_match(spark, paragraphs, audit):
    """A citation mapped by hand to an entry of another author and year brings two patches, applied together."""
    row = audit.citations.where("author_text = 'Hollis' and year_key = '2021'").first()
    matches = spark.createDataFrame([(1, row.citation_id, "r5")], "doc_id bigint, citation_id string, ref_id string")
    manual = E.apply_manual_matches(audit.citations, matches, audit.references, paragraphs).where("manual_patches is not null")
    patches = E.suggest_patches(manual)
    assert sorted(p.replacement for p in patches.collect()) == ["2016", "Von Essen"]
    assert E.apply_patches(paragraphs, patches).where(F.col("paragraph_id") == row.paragraph_id).first().text == "It was cold (Von Essen, 2016)."
