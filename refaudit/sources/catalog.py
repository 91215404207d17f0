"""Provider dumps mapped to the work schema.

Each provider has a JSON schema (read with it, so only the mapped fields are parsed) and a
mapper from records to works. :func:`read_works` ties both; :func:`register_provider` adds more.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refaudit.functions.apa import AUTHOR
from refaudit.functions.reference import align_arxiv_authors, literal_authors, normalize_authors, uri_component
from refaudit.functions.text import item_year, trim_ws

AUTHORS = T.ArrayType(AUTHOR)
DASH = "–"

# Provider directory (fixed): id, mode, address of manual sources.
DESCRIPTORS = [
    ("Web", "auto", None), ("Crossref", "auto", None), ("arXiv", "auto", None), ("DataCite", "auto", None), ("OpenAlex", "auto", None),
    ("PubMed", "auto", None), ("Europe PMC", "auto", None), ("TR Dizin", "auto", None), ("İSAM", "auto", None), ("ERIC", "auto", None),
    ("DBLP", "auto", None), ("Semantic Scholar", "auto", None), ("CORE", "auto", None), ("OpenLibrary", "auto", None), ("Google Books", "key", None),
    ("ISSN", "manual", "https://portal.issn.org/"), ("SOBIAD", "manual", "https://atif.sobiad.com/"), ("TO-KAT", "manual", "https://www.toplukatalog.gov.tr/")]


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _first(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(c, F.lit(1))


def _or(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(_s(c), F.lit("")) for c in cs], F.lit(""))


def base_item(df: DataFrame, provider: str, title: Column, author: Column, year: Column, url: Column, keep: tuple[str, ...] = (), **fields: Column) -> DataFrame:
    """Work columns with defaults; tags are stripped from titles and years found in mixed fields."""
    text = {k: F.lit("") for k in ("doi", "container_title", "volume", "issue", "pages", "type", "publisher", "language", "arxiv")}
    given = {**text, **fields}
    review = given.pop("requires_review", F.lit(False))
    editor = given.pop("editor", F.array().cast(AUTHORS))
    return df.select(*keep, F.lit(provider).alias("provider"), trim_ws(F.regexp_replace(_s(title), "<[^>]+>", "")).alias("title"),
                     F.coalesce(author.cast(AUTHORS), F.array().cast(AUTHORS)).alias("author"), item_year(year).alias("year"), _s(url).alias("url"),
                     *[_s(v).alias(k) for k, v in given.items()], editor.cast(AUTHORS).alias("editor"), review.alias("requires_review"))


_PERSON = "array<struct<family:string,given:string,name:string,literal:string>>"


def _people(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array().cast(_PERSON)), lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), F.coalesce(a["literal"], a["name"]).alias("literal")))


def works_from_crossref(df: DataFrame) -> DataFrame:
    date = lambda c: F.try_element_at(F.try_element_at(F.col(f"{c}.`date-parts`"), F.lit(1)), F.lit(1))
    rows = df.withColumn("_y", F.coalesce(date("published"), date("issued")))
    url = F.when(_s("DOI") != "", F.concat(F.lit("https://doi.org/"), F.col("DOI"))).otherwise(_s("URL"))
    out = base_item(rows, "Crossref", _first("title"), _people("author"), F.lit(None), url, ("_y",), doi=F.col("DOI"), container_title=_first("container-title"),
                    volume=F.col("volume"), issue=F.col("issue"), pages=F.col("page"), publisher=F.col("publisher"), editor=_people("editor"), type=F.col("type"), language=F.col("language"))
    # The date parts are the year itself, so no 19xx/20xx search.
    return out.withColumn("year", F.col("_y")).drop("_y")


def works_from_datacite(df: DataFrame) -> DataFrame:
    a = F.col("data.attributes")

    def person(p: Column) -> Column:
        comma = (_s(p["familyName"]) == "") & _s(p["name"]).contains(",")
        family = F.when(_s(p["familyName"]) != "", p["familyName"]).when(comma, trim_ws(F.substring_index(p["name"], ",", 1)))
        given = F.when(_s(p["familyName"]) != "", _s(p["givenName"])).when(comma, trim_ws(F.regexp_replace(p["name"], "^[^,]*,", "")))
        return F.struct(family.alias("family"), given.alias("given"), F.when(family.isNull(), _s(p["name"])).alias("literal"))
    return base_item(df.where(a.isNotNull()), "DataCite", _first(a["titles"])["title"], F.transform(a["creators"], person), a["publicationYear"],
                     F.concat(F.lit("https://doi.org/"), a["doi"]), doi=a["doi"], container_title=_or(a["container"]["title"], _publisher_name(a["publisher"])),
                     volume=a["container"]["volume"], issue=a["container"]["issue"])


def _publisher_name(p: Column) -> Column:
    """Publisher as a plain string or as an object with a name (read as raw JSON text)."""
    return F.when(p.startswith("{"), F.get_json_object(p, "$.name")).otherwise(p)


def works_from_openalex(df: DataFrame) -> DataFrame:
    doi = F.regexp_replace(_s("doi"), r"(?i)^https?://doi\.org/", "")
    return base_item(df, "OpenAlex", F.col("title"), literal_authors(F.transform("authorships", lambda x: x["author"]["display_name"])), F.col("publication_year"),
                     F.coalesce("doi", "id"), doi=doi, container_title=F.col("primary_location.source.display_name"), volume=F.col("biblio.volume"), issue=F.col("biblio.issue"),
                     pages=F.concat_ws(DASH, F.nullif(F.col("biblio.first_page"), F.lit("")), F.nullif(F.col("biblio.last_page"), F.lit(""))))


def works_from_arxiv(df: DataFrame, reference: Column | None = None) -> DataFrame:
    """Feed entries; ``reference`` (the citing entry) structures the author names where given."""
    ident = F.regexp_replace(F.coalesce(F.nullif(_s("arxiv"), F.lit("")), F.regexp_extract(_s("id"), r"(?i)arxiv\.org/(?:abs|pdf)/([^?#/]+)", 1)), r"(?i)v[0-9]+$", "")
    names = F.transform("author", lambda a: a["name"])
    return base_item(df, "arXiv", F.regexp_replace("title", r"\s+", " "), align_arxiv_authors(names, reference if reference is not None else F.lit("")), F.col("published"),
                     _or(F.col("id"), F.when(ident != "", F.concat(F.lit("https://arxiv.org/abs/"), ident))), arxiv=ident, doi=F.when(ident != "", F.concat(F.lit("10.48550/arxiv."), ident)))


def works_from_europepmc(df: DataFrame) -> DataFrame:
    author = F.transform("authorList.author", lambda a: F.struct(_s(a["lastName"]).alias("family"), _s(a["firstName"]).alias("given"), F.when(_s(a["lastName"]) == "", a["fullName"]).alias("literal")))
    url = F.when(_s("doi") != "", F.concat(F.lit("https://doi.org/"), F.col("doi"))).otherwise(F.concat(F.lit("https://europepmc.org/article/"), F.col("source"), F.lit("/"), F.col("id")))
    return base_item(df, "Europe PMC", F.col("title"), author, F.col("pubYear"), url, doi=F.col("doi"), container_title=F.col("journalInfo.journal.title"), volume=F.col("journalInfo.volume"),
                     issue=F.col("journalInfo.issue"), pages=F.col("pageInfo"))


def works_from_pubmed(summaries: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Summaries of the listed ids (equi-join on uid; all summaries without a list)."""
    rows = summaries if ids is None else summaries.join(ids.select(F.col("uid").cast("string").alias("uid")).distinct(), "uid", "left_semi")
    doi = F.try_element_at(F.filter("articleids", lambda x: x["idtype"] == "doi"), F.lit(1))["value"]
    return base_item(rows, "PubMed", F.col("title"), literal_authors(F.transform("authors", lambda a: a["name"])), F.col("pubdate"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("uid"), F.lit("/")),
                     doi=doi, container_title=_or(F.col("fulljournalname"), F.col("source")), volume=F.col("volume"), issue=F.col("issue"), pages=F.col("pages"))


def works_from_dblp(df: DataFrame) -> DataFrame:
    """Author lists may be a string, an object, or a list of either; read as raw JSON text."""
    raw = F.trim(_s("info.authors.author"))
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw != "", F.array(raw)).otherwise(F.array().cast("array<string>"))
    names = F.transform(listed, lambda a: F.when(a.startswith("{"), F.get_json_object(a, "$.text")).otherwise(a))
    i = lambda k: F.col(f"info.{k}")
    return base_item(df.where(F.col("info").isNotNull()), "DBLP", i("title"), literal_authors(names), i("year"), _or(i("url"), i("ee")), doi=i("doi"), container_title=i("venue"),
                     volume=i("volume"), issue=i("number"), pages=i("pages"))


def works_from_eric(df: DataFrame) -> DataFrame:
    return base_item(df, "ERIC", F.col("title"), normalize_authors(F.col("author")), F.col("publicationdateyear"), F.concat(F.lit("https://eric.ed.gov/?id="), uri_component(F.col("id"))),
                     container_title=F.col("source"), pages=F.col("pages"))


def works_from_semanticscholar(df: DataFrame) -> DataFrame:
    return base_item(df, "Semantic Scholar", F.col("title"), literal_authors(F.transform("authors", lambda a: a["name"])), F.col("year"), F.col("url"), doi=F.col("externalIds.DOI"),
                     container_title=_or(F.col("journal.name"), F.col("venue")), volume=F.col("journal.volume"), pages=F.col("journal.pages"))


def works_from_core(df: DataFrame) -> DataFrame:
    return base_item(df, "CORE", F.col("title"), normalize_authors(F.transform("authors", lambda a: a["name"])), F.col("yearPublished"), F.concat(F.lit("https://core.ac.uk/works/"), F.col("id")),
                     doi=F.col("doi"), container_title=_first("journals")["title"], requires_review=F.lit(True))


def works_from_trdizin(df: DataFrame) -> DataFrame:
    """One work per abstract title (Turkish and English); authors by their order."""
    s = F.col("_source")
    ordered = F.array_sort(F.transform(s["authors"], lambda a: F.struct(a["order"].alias("o"), _or(a["inPublicationName"], a["name"]).alias("n"))))
    rows = df.where(s.isNotNull()).select("_id", "_source", F.explode(F.filter(s["abstracts"], lambda a: _s(a["title"]) != "")).alias("abs"))
    issue = s["issue"]
    is_object = issue.startswith("{")
    issue_volume = F.when(is_object, F.get_json_object(issue, "$.volume"))
    volume = F.when(_s(s["volume"]) != "", s["volume"]).when(issue_volume != "0", issue_volume)
    return base_item(rows, "TR Dizin", F.col("abs.title"), literal_authors(F.transform(ordered, lambda a: a["n"])), s["publicationYear"],
                     F.concat(F.lit("https://search.trdizin.gov.tr/tr/yayin/detay/"), uri_component(F.coalesce(s["id"], F.col("_id")))), doi=s["doi"], container_title=s["journal"]["name"],
                     volume=volume, issue=F.when(is_object, F.get_json_object(issue, "$.number")).otherwise(issue),
                     pages=F.concat_ws(DASH, F.nullif(s["startPage"], F.lit("")), F.nullif(s["endPage"], F.lit(""))))


def works_from_isam(df: DataFrame) -> DataFrame:
    """Dublin Core maps: key -> list of values."""
    m = F.col("metadata")
    v = lambda k: _s(_first(F.try_element_at(m, F.lit(k)))["value"])
    authors = normalize_authors(F.transform(F.try_element_at(m, F.lit("dc.contributor.author")), lambda a: a["value"]))
    return base_item(df, "İSAM", _or(v("dc.title"), F.col("name")), authors, v("dc.date.issued"), _or(v("dc.identifier.uri"), F.concat(F.lit("https://makale.isam.org.tr/handle/"), F.col("handle"))),
                     doi=F.regexp_replace(v("dc.identifier.doi"), "(?i)^https?://doi.org/", ""), container_title=_or(v("dc.relation.journal"), v("dc.relation.book")), volume=v("dc.identifier.volume"),
                     issue=v("dc.identifier.issue"), pages=v("dc.identifier.page"), requires_review=F.lit(True))


def _book(df: DataFrame, provider: str, title: Column, subtitle: Column, author: Column, year: Column, url: Column, publisher: Column) -> DataFrame:
    full = F.concat(_s(title), F.when(_s(subtitle) != "", F.concat(F.lit(": "), subtitle)).otherwise(F.lit("")))
    return base_item(df, provider, full, author, year, url, type=F.lit("book"), publisher=publisher, requires_review=F.lit(True))


def works_from_openlibrary(df: DataFrame) -> DataFrame:
    return _book(df, "OpenLibrary", F.col("title"), F.col("subtitle"), literal_authors(F.col("author_name")), F.col("first_publish_year"), F.concat(F.lit("https://openlibrary.org"), F.col("key")), _first("publisher"))


def works_from_googlebooks(df: DataFrame) -> DataFrame:
    v = lambda k: F.col(f"volumeInfo.{k}")
    return _book(df, "Google Books", v("title"), v("subtitle"), literal_authors(v("authors")), v("publishedDate"),
                 _or(v("infoLink"), F.concat(F.lit("https://books.google.com/books?id="), uri_component(F.col("id")))), v("publisher"))


_DATE = "struct<`date-parts`:array<array<int>>>"
SCHEMAS = {
    "Crossref": f"title array<string>, author {_PERSON}, editor {_PERSON}, language string, published {_DATE}, issued {_DATE}, DOI string, `container-title` array<string>, volume string, issue string, page string, publisher string, type string, URL string",
    "DataCite": "data struct<attributes:struct<titles:array<struct<title:string>>,creators:array<struct<familyName:string,givenName:string,name:string>>,publicationYear:string,doi:string,container:struct<title:string,volume:string,issue:string>,publisher:string>>",
    "OpenAlex": "title string, authorships array<struct<author:struct<display_name:string>>>, publication_year string, doi string, id string, primary_location struct<source:struct<display_name:string>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>",
    "arXiv": "id string, arxiv string, title string, published string, author array<struct<name:string>>",
    "Europe PMC": "title string, authorList struct<author:array<struct<lastName:string,firstName:string,fullName:string>>>, pubYear string, doi string, source string, id string, journalInfo struct<journal:struct<title:string>,volume:string,issue:string>, pageInfo string",
    "PubMed": "uid string, title string, authors array<struct<name:string>>, pubdate string, articleids array<struct<idtype:string,value:string>>, fulljournalname string, source string, volume string, issue string, pages string",
    "DBLP": "info struct<title:string,authors:struct<author:string>,year:string,url:string,ee:string,doi:string,venue:string,volume:string,number:string,pages:string>",
    "ERIC": "id string, title string, author array<string>, publicationdateyear string, source string, pages string",
    "Semantic Scholar": "title string, authors array<struct<name:string>>, year string, url string, externalIds struct<DOI:string>, venue string, journal struct<name:string,volume:string,pages:string>",
    "CORE": "id string, title string, authors array<struct<name:string>>, yearPublished string, doi string, journals array<struct<title:string>>",
    "TR Dizin": "_id string, _source struct<id:string,publicationYear:string,abstracts:array<struct<language:string,title:string>>,authors:array<struct<`order`:int,name:string,inPublicationName:string>>,journal:struct<name:string>,volume:string,issue:string,doi:string,startPage:string,endPage:string>",
    "İSAM": "name string, handle string, metadata map<string,array<struct<value:string>>>",
    "OpenLibrary": "key string, title string, subtitle string, author_name array<string>, first_publish_year string, publisher array<string>",
    "Google Books": "id string, volumeInfo struct<title:string,subtitle:string,authors:array<string>,publishedDate:string,infoLink:string,publisher:string>",
}
MAPPERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Crossref": works_from_crossref, "DataCite": works_from_datacite, "OpenAlex": works_from_openalex, "arXiv": works_from_arxiv, "Europe PMC": works_from_europepmc,
    "PubMed": works_from_pubmed, "DBLP": works_from_dblp, "ERIC": works_from_eric, "Semantic Scholar": works_from_semanticscholar, "CORE": works_from_core,
    "TR Dizin": works_from_trdizin, "İSAM": works_from_isam, "OpenLibrary": works_from_openlibrary, "Google Books": works_from_googlebooks}


def register_provider(name: str, schema: str, mapper: Callable[[DataFrame], DataFrame]) -> None:
    """Plug in another provider: its JSON schema and a records -> works mapping."""
    SCHEMAS[name], MAPPERS[name] = schema, mapper


def parse_records(df: DataFrame, provider: str, column: str = "json") -> DataFrame:
    """JSON text records as typed columns of the provider's schema."""
    return df.select(F.from_json(column, SCHEMAS[provider]).alias("r")).select("r.*")


def read_works(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Works of a JSON-lines dump (arXiv: Atom XML); only mapped fields are read."""
    reader = spark.read.schema(SCHEMAS[provider])
    raw = reader.format("xml").option("rowTag", "entry").load(path) if provider == "arXiv" else reader.json(path)
    return MAPPERS[provider](raw)
