"""Readers: pasted text, positioned lines, full-text XML, provider dumps, sinks."""
import json

from pyspark.sql import functions as F

from refaudit.sources import catalog as K
from refaudit.sources import sinks, texts



def split(spark, text):
    df = texts.split_references(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    return [r.raw for r in df.orderBy("pos").collect()]


def test_entries_split_without_merging(spark):
    values = ["Núñez, R. (2019). Salt marshes.", "Yıldız Öztürk, S. (2024). Kıyı bitkileri.", "von den Berg, T. (2017). Dune grass.", "Castro-Páez, L. (2022). Sea walls."]
    assert split(spark, "\n".join(values)) == values
    assert split(spark, f"1. {values[0]}\ncontinued journal text\n[1000] {values[1]}") == [values[0] + " continued journal text", values[1]]
    assert split(spark, "One entry\nwrapped\n\n\nOther entry") == ["One entry wrapped", "Other entry"]
    assert split(spark, "  \n ") == []


# Running foot lines and numbers on every page; text over a page's end, a divided word, hanging indents, an annex.
PAGES = [
    ["A survey of harbour lamps", "", "Lamps were counted at night from a boat that kept to the middle of the channel, and", "each one was noted with its colour and its height (Quell, 2011).", "",
     "Two crews took turns so that no light was counted by the same person in both of the", "rounds, which began at ten and ended when the last ferry had left its mooring and the", "Harbour Letters 31", "1"],
    ["quay lay in darkness again.", "", "Fog stopped the work on nine nights. On clear ones the counts differed by less than a",
     "tenth, which is below what the makers of the lamps say about the spread of their bright-", "ness over a year, so both rounds were kept.", "", "Harbour Letters 31", "2"],
    ["Kaynaklar", "", "Quell, D. (2011). Counting lights from a moving boat in channels that carry traffic", ">at all hours. Night Work, 5, 1-19.", "Rusk, E. (2009). Colour at sea. Night Work, 3, 7-8.",
     "Sand, F. (2014). What makers say: a reading of forty data sheets on marine lamps and", ">their ageing. Night Work, 8, 44-71. https://doi.org/10.5555/nw.2014.44", "Ekler", "", "Form used by the crews.", "Harbour Letters 31", "3"]]


def test_lines_become_paragraphs(spark):
    rows = [(1, p + 1, n, 4 if t.startswith(">") else 0, t.lstrip(">")) for p, page in enumerate(PAGES) for n, t in enumerate(page)]
    out = texts.lines_to_paragraphs(spark.createDataFrame(rows, "doc_id bigint, page int, line_no int, indent int, text string")).orderBy("idx").collect()
    assert [(r.text[:18], r.text[-22:], r.style) for r in out if r.text] == [
        ("A survey of harbou", "survey of harbour lamps"[-22:], ""), ("Lamps were counted", "its height (Quell, 2011)."[-22:], ""),
        ("Two crews took tur", "quay lay in darkness again."[-22:], ""), ("Fog stopped the wo", "so both rounds were kept."[-22:], ""), ("Kaynaklar", "Kaynaklar", "Heading"),
        ("Quell, D. (2011). ", "hours. Night Work, 5, 1-19."[-22:], ""), ("Rusk, E. (2009). C", "sea. Night Work, 3, 7-8."[-22:], ""),
        ("Sand, F. (2014). W", "https://doi.org/10.5555/nw.2014.44"[-22:], ""), ("Ekler", "Ekler", "Heading"), ("Form used by the c", "Form used by the crews."[-22:], "")]
    whole = " ".join(r.text for r in out)
    assert "the spread of their brightness over a year" in whole and "left its mooring and the quay lay" in whole and "lamps and their ageing." in whole
    assert "Harbour Letters" not in whole


def test_annex_words_in_the_text_open_no_heading(spark):
    """They do behind the bibliography only."""
    lines = ["Ek olarak ölçümler", "", "Lamps were counted twice.", "", "References", "", "Rusk, E. (2009). Colour at sea. Night Work, 3, 7-8.", "Appendix", "", "Form."]
    out = texts.lines_to_paragraphs(spark.createDataFrame([(1, 1, n, 0, t) for n, t in enumerate(lines)], "doc_id bigint, page int, line_no int, indent int, text string"))
    assert [r.text for r in out.where("style = 'Heading'").orderBy("idx").collect()] == ["References", "Appendix"]


def test_full_text_xml(spark):
    xml = "<article><front><article-title>A <i>title</i></article-title></front><body><p>One &amp; <b>two</b>.</p><sec><p>Three.</p></sec></body><back><p>Thanks</p><ref-list><p>Ref</p></ref-list></back></article>"
    rows = texts.jats_passages(spark.createDataFrame([("x", xml)], "pub_id string, xml string")).orderBy("location").collect()
    assert [(r.title, r.location, r.text) for r in rows] == [("A title", "Paragraf 1", "One & two."), ("A title", "Paragraf 2", "Three.")]


RECORDS = {
    "Crossref": {"title": ["T"], "author": [{"family": "Halden", "given": "Mira"}], "published": {"date-parts": [[2019]]}, "DOI": "10.5555/tide.77", "container-title": ["Tide Days"], "page": "1-2"},
    "DataCite": {"data": {"attributes": {"titles": [{"title": "T"}], "creators": [{"familyName": "Halden", "givenName": "Mira"}, {"name": "Moss, I."}, {"name": "Org"}], "publicationYear": 2019, "doi": "10.1/x", "publisher": "arXiv"}}},
    "OpenAlex": {"title": "T", "authorships": [{"author": {"display_name": "Ida Moss"}}], "publication_year": 2020, "doi": "https://doi.org/10.1/X", "biblio": {"first_page": "1", "last_page": "9"}},
    "Europe PMC": {"title": "T", "pubYear": "2020", "doi": "10.5555/w9", "authorList": {"author": [{"lastName": "Kern", "firstName": "Rosa"}]}, "journalInfo": {"journal": {"title": "Journal"}, "volume": "3"}, "pageInfo": "1-5"},
    "PubMed": {"uid": "123", "title": "T", "pubdate": "2020 Jan", "authors": [{"name": "Kern R"}], "articleids": [{"idtype": "pii", "value": "x"}, {"idtype": "doi", "value": "10.5555/w9"}], "fulljournalname": "Journal"},
    "DBLP": {"info": {"title": "T", "year": "2020", "authors": {"author": [{"text": "Rosa Kern"}, "Udo Ahn"]}, "venue": "Conf", "url": "https://dblp.org/rec/test"}},
    "ERIC": {"id": "EJ123", "title": "T", "author": ["Kern, Rosa"], "publicationdateyear": 2020},
    "Semantic Scholar": {"title": "T", "year": 2020, "authors": [{"name": "Rosa Kern"}], "externalIds": {"DOI": "10.5555/w9"}, "url": "https://s2/p", "journal": {"name": "J"}},
    "CORE": {"id": 123, "title": "T", "authors": [{"name": "Kern, Rosa"}], "yearPublished": 2020, "journals": [{"title": "J"}]},
    "TR Dizin": {"_source": {"id": 123, "publicationYear": 2020, "abstracts": [{"title": "Kıyı"}, {"title": "T"}], "authors": [{"order": 2, "name": "Other"}, {"order": 1, "name": "Rosa Kern"}],
                             "journal": {"name": "Journal"}, "issue": {"number": "36", "volume": "0"}, "startPage": 5, "endPage": 9}},
    "İSAM": {"metadata": {"dc.title": [{"value": "T"}], "dc.contributor.author": [{"value": "Kern, Rosa"}], "dc.date.issued": [{"value": "2020"}], "dc.identifier.uri": [{"value": "https://m/handle/1"}]}},
    "OpenLibrary": {"key": "/works/OL123W", "title": "T", "subtitle": "S", "author_name": ["Rosa Kern"], "first_publish_year": 2020, "publisher": ["P"]},
    "Google Books": {"id": "1", "volumeInfo": {"title": "T", "authors": ["Rosa Kern"], "publishedDate": "2020-01-01", "publisher": "P"}},
    "arXiv": {"id": "https://arxiv.org/abs/2401.01234v2", "title": "A  record", "published": "2023-02-14T00:00:00Z", "author": [{"name": "Kern, Rosa"}]}}


def works(spark, provider):
    df = spark.createDataFrame([(json.dumps(RECORDS[provider]),)], "json string")
    return K.MAPPERS[provider](K.parse_records(df, provider)).collect()


def test_every_provider_maps(spark):
    assert set(RECORDS) == set(K.MAPPERS)
    for p in RECORDS:
        w = works(spark, p)[0]
        assert w.provider == p and w.title and w.year in (2019, 2020, 2023) and w.author, p
        assert w.requires_review == (p in ("CORE", "İSAM", "OpenLibrary", "Google Books")), p


def test_provider_details(spark):
    assert works(spark, "Crossref")[0].url == "https://doi.org/10.5555/tide.77"
    assert [(a.family, a.given, a.literal) for a in works(spark, "DataCite")[0].author] == [("Halden", "Mira", None), ("Moss", "I.", None), (None, None, "Org")]
    assert works(spark, "DataCite")[0].container_title == "arXiv"
    assert (works(spark, "OpenAlex")[0].doi, works(spark, "OpenAlex")[0].pages) == ("10.1/X", "1–9")
    assert works(spark, "PubMed")[0].doi == "10.5555/w9"
    assert [a.literal for a in works(spark, "DBLP")[0].author] == ["Rosa Kern", "Udo Ahn"]
    tr = works(spark, "TR Dizin")
    assert [w.title for w in tr] == ["Kıyı", "T"] and (tr[0].author[0].literal, tr[0].pages, tr[0].issue, tr[0].volume) == ("Rosa Kern", "5–9", "36", "")
    assert works(spark, "OpenLibrary")[0].title == "T: S"
    arxiv = works(spark, "arXiv")[0]
    assert (arxiv.arxiv, arxiv.doi, arxiv.title) == ("2401.01234", "10.48550/arxiv.2401.01234", "A record")


def test_dump_reader_and_plug_in(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(RECORDS["ERIC"]))
    assert K.read_works(spark, str(tmp_path), "ERIC").first().title == "T"
    (tmp_path / "a.xml").write_text('<feed><entry><id>http://arxiv.org/abs/2401.01234v2</id><title>A record</title><published>2023-02-14</published><author><name>Rosa Kern</name></author></entry></feed>')
    assert K.read_works(spark, str(tmp_path / "a.xml"), "arXiv").first().author[0].family == "Kern"
    K.register_provider("Mine", "t string", lambda df: K.base_item(df, "Mine", F.col("t"), F.array(), F.lit("in 2001"), F.lit("")))
    (tmp_path / "m.json").write_text('{"t": "<b>X</b>"}')
    got = K.read_works(spark, str(tmp_path / "m.json"), "Mine").first()
    assert (got.title, got.year) == ("X", 2001)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "B & b", None), (1, 0, "A", "<em>A</em>")], "doc_id int, pos int, output string, output_html string")
    out = sinks.render_bibliography(rows).first()
    assert out.text == "A\n\nB & b" and out.html == '<p style="margin:0 0 1em"><em>A</em></p><p style="margin:0 0 1em">B &amp; b</p>'
    sinks.write_results(rows, str(tmp_path / "r"))
    stored = sinks.with_signature(spark.read.parquet(str(tmp_path / "r")).drop("bucket"), ["doc_id", "pos"])
    new = rows.withColumn("output", F.when(F.col("pos") == 1, F.lit("C")).otherwise(F.col("output")))
    assert [r.pos for r in sinks.changed_only(new, stored, ["doc_id", "pos"]).collect()] == [1]


def test_entries_of_a_short_file_are_dealt_over_many_tasks(spark):
    """A file of parts is one split however many entries it spells out; parsing them must not be one task's work."""
    from pyspark.sql import functions as F

    from registry.linkage import entries
    rows = entries(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 1000
