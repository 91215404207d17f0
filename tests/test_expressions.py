"""Golden values of the column expressions."""
import pytest
from pyspark.sql import functions as F

from refaudit.functions import apa, dates, reference, retrieval, text, web


def test_normal_forms(each):
    assert each(text.normalize_title, "İzmir’de gelgit", "IZMIR DE GELGIT", "Charting a coast’s ﬁ½ buoys İıé", "") == ["izmir de gelgit"] * 2 + ["charting a coast s fi1 2 buoys iie", ""]
    assert each(text.evidence_key, "sufﬁcient depth of 2.4\nmetres “x” ’") == ["sufficient depth of 2.4 metres \"x\" '"]
    assert each(text.clean_name, "Moss et al.’s", "Toprak ve ark.", "Su vd.") == ["Moss", "Toprak", "Su"]
    assert each(text.year_key, "T. Y.", "2020A") == ["n.d.", "2020a"]


def test_sentences(each):
    got = each(text.split_sentences, "Deniz yükseldi. Ölçen R. Kern et al. 2.5 metre. Sonra durdu! Sonuç (Toprak, 2018) aynı.", "Kıyıya bakan Derya ve ark. (2017) yazdı.")
    assert [len(s) for s in got] == [4, 1]
    assert [tuple(s) for s in each(text.sentence_slices, "One. Two? Three")[0]] == [("One.", 0, 4), ("Two?", 4, 9), ("Three", 9, 15)]


def test_html(each):
    assert each(text.decode_entities, "a &amp;lt; b &#233; &#x1F600; &foo; &#99999999999;") == ["a &lt; b é 😀 &foo; "]
    assert each(text.tag_attrs, "<meta name=\"x\" CONTENT='a &amp; b' property=foo name=\"y\">") == [{"name": "y", "content": "a & b", "property": "foo"}]
    assert each(text.html_text, "<p>Hi <b>there</b></p><p>x<br>y</p>") == ["Hi there\nx\ny"]


def test_identifiers(each):
    assert each(reference.get_doi, "https://doi.org/10.5555/silt(77).", "(https://doi.org/10.5555/silt).", "none") == ["10.5555/silt(77)", "10.5555/silt", ""]
    keys = each(reference.publication_keys, "R (2025). https://arxiv.org/abs/2401.01234v2", "N. https://www.harbour.example.org/2025/port/?a=1", "A https://sea.example.net/")
    assert keys == [["arxiv:2401.01234"], ["url:harbour.example.org/2025/port"], []]


@pytest.mark.parametrize("raw,year,title,author", [
    ("von den Berg, T. (2017). Dune grass.", 2017, "Dune grass", "von den Berg"),
    ("Derya, K. (2019b). Gelgit ölçümleri. Kıyı Dergisi.", 2019, "Gelgit ölçümleri", "Derya"),
    ("Kaya, D. (2022, March 9). Small ports dig deeper basins. Harbour Post.", 2022, "Small ports dig deeper basins", "Kaya"),
    ("Halden M, Moss IR. Silt: slow filling of old basins. Shore Rec. 2016;4:11.", 2016, "Silt: slow filling of old basins", "Halden")])
def test_entry_fields(each, raw, year, title, author):
    p = each(reference.parse_reference, raw)[0]
    assert (p.year, p.title, p.first_author) == (year, title, author)


def test_identity(each):
    raw = "Ek, T., Lund, M. V. T., Berg Holm, D., Dal Nord, H., & Roe, N. D. Q. (2025). TIDE-LOG. https://doi.org/10.48550/arXiv.2401.09999"
    a, b, c = each(reference.reference_identity, raw, "Seaboard. (n.d.). Yearbook.", "Harbour & Coast Watch. (2026). Yearbook.")
    assert (a.year_key, a.authors) == ("2025", ["Ek", "Lund", "Berg Holm", "Dal Nord", "Roe"])
    assert (b.year_key, b.author, c.author) == ("n.d.", "Seaboard", "Harbour & Coast Watch")


def test_routing(each):
    route = lambda c: reference.route_providers(c, F.lit(""), F.lit(""))
    got = each(route, "Turizm araştırmaları Türkiye", "aspirin clinical patient", "neural computer learning", "https://arxiv.org/abs/2304.14163")
    assert "TR Dizin" in got[0] and "PubMed" in got[1] and "DBLP" in got[2] and got[3] == ["arXiv"] and "Google Books" not in got[0]


def test_arxiv_authors_follow_the_entry(each):
    ref = F.lit("Ek, T., Lund, M. V. T., & Berg Holm, D. (2025). x")
    got = each(lambda c: reference.align_arxiv_authors(F.split(c, ";"), ref), "Tor Ek;Mia V. T. Lund;Dag Berg Holm;Udo Ahn;Mono")[0]
    assert [a.family for a in got] == ["Ek", "Lund", "Berg Holm", "Ahn", None] and got[-1].literal == "Mono"


def test_dates(each):
    got = each(dates.date_parts, "04.08.2025", "4 Ağustos 2025", "2025-02-30", "2025-08-04T10:00:00Z", "Copyright 2026", "August 2025", "8 May", "2025-00-10")
    assert [tuple(d) if d else None for d in got] == [(2025, 8, 4), (2025, 8, 4), None, (2025, 8, 4), None, (2025, 8, None), None, None]


def test_waits(each):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert each(lambda c: dates.duration_ms(c, now), "7.5s", "1h2m3s", "90", "Mon, 01 Jan 2024 00:01:00 GMT", "x") == [7500.0, 3723000.0, 90000.0, 60000.0, None]
    assert each(lambda c: dates.retry_delay_ms(c, F.lit(2), now), "90", "0", "invalid", "") == [90000, 1000, 240000, 240000]


def test_casing(each):
    got = each(apa.sentence_case, "SILT IS ALL WE FOUND", "Harbour Research — A Slow Approach", "Charting Silt in Los Angeles Using Google Maps and GIS", "Review of SeaVis and eDNA Gauges",
               "TÜRKİYE’DE İÇ LİMANLARIN GELİŞİMİ", "SWE-agent: Gauge-Computer Links Improve Harbour Engineering")
    assert got == ["Silt is all we found", "Harbour research — A slow approach", "Charting silt in Los Angeles using Google Maps and GIS", "Review of SeaVis and eDNA gauges",
                   "Türkiye’de iç limanların gelişimi", "SWE-agent: Gauge-computer links improve harbour engineering"]
    assert each(lambda c: apa.sentence_case(c, F.lit("en"), ("Atlantis",)), "Mapping Places in Atlantis") == ["Mapping places in Atlantis"]
    assert each(apa.title_case, "the ai’s share: a record of ai's uses in THE port") == ["The AI’s Share: A Record of AI’s Uses in the Port"]


def test_retrieval(each):
    assert each(retrieval.retrieval_terms, "derinlik %17,5 azaldı (Kern, 2018).", "fell by 17.5% below") == [["derinl", "azaldi", "kern", "#17.5"], ["fell", "below", "#17.5"]]
    assert each(retrieval.language, "Bu çalışma ve bir yöntem için", "The method of the study", "12") == ["tr", "en", ""]
    got = each(lambda c: retrieval.parse_model_json(c, "verdict string"), '```json\n{"verdict":"x"}\n```', 'so {"verdict":"y"} z', "none")
    assert [g and g.verdict for g in got] == ["x", "y", None]


def test_web_entries(each):
    a, b = each(web.parse_web_reference, "Kaya, D. (2022, March 9). Silt in basins. Who digs it? Harbour Post. https://harbour.example.org/news/silt", "A. (2025). T. https://doi.org/10.1234/test")
    assert b is None and (a.url, a.author, tuple(a.date), a.title) == ("https://harbour.example.org/news/silt", "Kaya, D", (2022, 3, 9), "Silt in basins. Who digs it? Harbour Post")
    assert each(web.valid_http_url, "file:///etc/passwd", "https://u:p@example.org/", "http://example.org:8080/", "https://example.org/x") == [False, False, False, True]
    assert each(lambda c: web.pack_paragraphs(c, 10), "aaaa\n\nbbb\n\ncccc\n\ndddddddddddd\n\ne") == [["aaaa\n\nbbb", "cccc", "dddddddddddd", "e"]]


def test_folding_evaluates_its_input_once_for_the_jvm(spark, each):
    plan = spark.range(1).select(text.normalize_title(F.initcap(F.col("id").cast("string"))).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("initcap(") <= 4
    assert each(text.web_norm, "﻿ΟΔΟΣ﻿α ﬁx İı", None, "é ") == ["οδος α fix ii", "", "e"]


def test_a_tag_is_read_once(spark):
    """The last of repeated attributes stays, its entities decoded, and the tag is searched once."""
    tag = F.concat(F.lit("<meta name='a' content=\"x &amp;lt; y\" Name=b data-n="), F.col("id"), F.lit(">"))
    out = spark.range(1).select(text.tag_attrs(tag).alias("v"))
    assert out.first()["v"] == {"content": "x &lt; y", "name": "b", "data-n": "0"}
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
