"""Literature files: bibliographic XML and registered works as JSON, brought to one record form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import normalize as N
from therascape.functions import text as X

#: The elements of an article that are read.
ARTICLE = (
    "MedlineCitation STRUCT<PMID: STRING, Article: STRUCT<ArticleTitle: STRING, Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_VALUE: STRING, _Label: STRING>>>, "
    "Journal: STRUCT<ISOAbbreviation: STRING, Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>, ArticleDate: ARRAY<STRUCT<Year: STRING>>, PublicationTypeList: STRUCT<PublicationType: ARRAY<STRING>>, "
    "ELocationID: ARRAY<STRUCT<_VALUE: STRING, _EIdType: STRING>>, "
    "AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, Initials: STRING, AffiliationInfo: ARRAY<STRUCT<Affiliation: STRING>>>>>, "
    "DataBankList: STRUCT<DataBank: ARRAY<STRUCT<DataBankName: STRING, AccessionNumberList: STRUCT<AccessionNumber: ARRAY<STRING>>>>>>>, "
    "PubmedData STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_VALUE: STRING, _IdType: STRING>>>>"
)
#: The fields of a registered work that are read.
WORK = "DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING, affiliation: ARRAY<STRUCT<name: STRING>>>>, abstract STRING"

# fixed values: kinds of publication, the first that an article has counts
KINDS = {
    "Randomized Controlled Trial": "RCT",
    "Clinical Trial, Phase III": "Phase III Trial",
    "Clinical Trial, Phase II": "Phase II Trial",
    "Clinical Trial, Phase I": "Phase I Trial",
    "Clinical Trial, Phase IV": "Phase IV Trial",
    "Controlled Clinical Trial": "Controlled Trial",
    "Clinical Trial": "Clinical Trial",
    "Meta-Analysis": "Meta-Analysis",
    "Systematic Review": "Systematic Review",
    "Observational Study": "Observational",
    "Multicenter Study": "Multicenter",
    "Comparative Study": "Comparative",
    "Review": "Review",
    "Case Reports": "Case Report",
}
# fixed values: names of conferences, patterns of their DOIs and titles, kinds of presentation, phases, signs of a company
CONFERENCES = {
    "asco": ("ASCO", r"(?i)jco\.(\d{4})\.\d+\.(1[67]_suppl)\.([A-Za-z0-9]+)"),
    "aacr": ("AACR", r"(?i)\.am(\d{4})-()([A-Za-z0-9]+)"),
    "esmo": ("ESMO", r"(?i)annonc\.(\d{4})\."),
}
LATE_SUPPLEMENT = "17_suppl"
TITLE_ID = r"(?i)^\s*(LBA\d+|\d+)(MO|TiP|TPS|PD|PB|MPB|P|O)?\b"
PRESENTATIONS = {"O": "Oral", "MO": "Mini Oral", "P": "Poster", "PD": "Poster Discussion", "PB": "Poster", "MPB": "Poster", "TIP": "Trials in Progress", "TPS": "Trials in Progress"}
PHASE_WORD = r"(?i)\bphase\s*(I{1,3}V?|[1-4])\b"
PHASES = {"I": "PHASE1", "II": "PHASE2", "III": "PHASE3", "IV": "PHASE4", "1": "PHASE1", "2": "PHASE2", "3": "PHASE3", "4": "PHASE4"}
COMPANY_SIGNS = ["Inc.", "Ltd.", "LLC", "Corp.", "GmbH", "S.A.", "Therapeutics", "Pharma", "Bioscience", "Genomic", "LifeSciences", "Biotech", "Sciences"]


def joined(x: Column) -> Column:
    """Broken words joined, blanks single; null reads empty."""
    return N.strip(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"-\n\s*", ""), r"(?U)\s+", " "))


def phases(text: Column) -> Column:
    """The phases a text names, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(PHASE_WORD), F.lit(1)), lambda w: N.lookup(F.upper(w), PHASES))))


def author(raw: Column) -> Column:
    """Name, affiliation and place of "name, affiliation ..., city, country or US state"; null for an empty text."""

    def read(parts: Column) -> Column:
        n = F.size(parts)
        last = F.get(parts, n - 1)
        state = (n >= 2) & last.rlike("^[A-Z]{2}$")
        city = F.when(n >= 2, F.when(n >= 3, F.get(parts, n - 2)).otherwise(F.lit("")))
        inner = F.when(state | (n >= 3), F.slice(parts, F.lit(2), F.greatest(n - 3, F.lit(0)))).otherwise(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))))
        affiliation = F.array_join(inner, ", ")
        return F.when(
            n > 0,
            F.struct(
                F.get(parts, F.lit(0)).alias("name"),
                affiliation.alias("affiliation"),
                city.alias("city"),
                F.when(state, last).alias("region"),
                F.when(state, "USA").when(n >= 2, last).alias("country"),
                X.has_any(affiliation, COMPANY_SIGNS).alias("is_company"),
            ),
        )

    return N.let(F.filter(F.transform(F.split(joined(raw), ","), N.strip), lambda p: p != ""), read)


def _tagged(df: DataFrame) -> DataFrame:
    """Tags and links of records with title and body."""
    full = F.concat_ws(" ", "title", F.coalesce("abstract_text", F.lit("")))
    with_text = df.withColumn("__full", full)
    t = F.col("__full")
    own = F.array_distinct(F.concat(F.coalesce("__ncts", F.array().cast("array<string>")), X.trial_ids(t))) if "__ncts" in df.columns else X.trial_ids(t)
    out = {
        "status": F.when(F.col("abstract_text").isNotNull(), "available").otherwise("title_only"),
        "phases": phases(t),
        "modality_list": X.modality_list(t),
        "target_list": X.target_list(t),
        "biomarker_list": X.biomarkers(t),
        "nct_ids": own,
        "author": author(F.col("author_raw")),
    }
    tagged = with_text.withColumns(out)
    firm = N.companies(F.coalesce(F.col("author.affiliation"), F.lit("")), F.col("abstract_text"))
    return tagged.withColumns({"phase": F.get("phases", F.lit(0)), "biomarker_mentioned": F.size("biomarker_list") > 0, "companies_normalized": firm}).drop("__full", "__ncts")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07 and SRC-08: articles of XML files; what cannot be parsed reads null and goes with ``publications``."""
    return spark.read.format("xml").option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE").schema(ARTICLE).load(path)


def article_year(article: Column) -> Column:
    """SCL-S21: the year of an article's issue, else the first year in the issue's free date, else that of the article itself; "unknown" if there is none."""
    issue = article["Journal"]["JournalIssue"]["PubDate"]
    own = F.get(article["ArticleDate"], F.lit(0))["Year"]
    return F.coalesce(N.some(N.strip(issue["Year"])), N.some(F.regexp_extract(issue["MedlineDate"], r"(?:19|20)\d\d", 0)), N.some(N.strip(own)), F.lit("unknown"))


def publications(articles: DataFrame, year: int | None = None) -> DataFrame:
    """PRJ-04: one record an article that has a pmid; repeated pmids leave one record.  Without a year each article has its own, null if it tells none."""
    m, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    own = article_year(a)
    first = F.get(a["AuthorList"]["Author"], F.lit(0))
    name = joined(F.concat_ws(" ", F.coalesce(F.nullif(first["ForeName"], F.lit("")), first["Initials"]), first["LastName"]))
    affiliation = joined(F.get(first["AffiliationInfo"], F.lit(0))["Affiliation"])
    sections = F.filter(F.transform(a["Abstract"]["AbstractText"], lambda s: F.struct(joined(s["_VALUE"]).alias("t"), s["_Label"].alias("label"))), lambda s: s["t"] != "")
    body = F.array_join(F.transform(sections, lambda s: F.concat_ws(": ", F.nullif(s["label"], F.lit("")), s["t"])), " ")
    journal = a["Journal"]
    short = F.coalesce(N.some(joined(journal["ISOAbbreviation"])), N.some(joined(journal["Title"])), F.lit("Journal"))
    kinds = F.coalesce(a["PublicationTypeList"]["PublicationType"], F.array().cast("array<string>"))
    last = lambda items, kind: F.try_element_at(F.filter(items, lambda x: x[kind] == "doi"), F.lit(-1))["_VALUE"]
    doi = F.lower(N.strip(F.coalesce(last(F.col("PubmedData.ArticleIdList.ArticleId"), "_IdType"), last(a["ELocationID"], "_EIdType"))))
    banks = F.filter(a["DataBankList"]["DataBank"], lambda b: b["DataBankName"] == "ClinicalTrials.gov")
    listed = F.flatten(F.transform(banks, lambda b: F.coalesce(b["AccessionNumberList"]["AccessionNumber"], F.array().cast("array<string>"))))
    out = articles.where(a.isNotNull() & (N.strip(m["PMID"]) != "")).select(
        N.strip(m["PMID"]).alias("pmid"),
        F.concat(F.lit("pub-"), own if year is None else F.lit(str(year)), F.lit("-"), N.strip(m["PMID"])).alias("uid"),
        short.alias("conference"),
        (own.try_cast("int") if year is None else F.lit(year)).alias("year"),
        joined(a["ArticleTitle"]).alias("title"),
        N.some(body).alias("abstract_text"),
        F.coalesce(N.some(joined(journal["Title"])), short).alias("journal"),
        F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(v)) for k, v in KINDS.items()], F.lit("Journal Article")).alias("publication_type"),
        N.some(doi).alias("doi"),
        F.concat_ws(", ", name, N.some(affiliation)).alias("author_raw"),
        F.filter(F.transform(listed, N.strip), lambda x: x.rlike(r"^NCT\d{8}$")).alias("__ncts"),
    )
    return _tagged(out.dropDuplicates(["pmid"]))


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: registered works, one a line."""
    return spark.read.schema(WORK).json(path)


def abstracts(works: DataFrame, conference: str, year: int) -> DataFrame:
    """PRJ-03: one record a work that belongs to the conference's year; of works with the same id the one with the smallest DOI stays."""
    label, pattern = CONFERENCES[conference]
    doi, title = F.coalesce("DOI", F.lit("")), F.coalesce(F.get("title", F.lit(0)), F.lit(""))
    of_year = works.where(F.regexp_extract(doi, pattern, 1) == str(year))
    if conference == "esmo":
        number, kind = F.upper(F.regexp_extract(title, TITLE_ID, 1)), F.upper(F.regexp_extract(title, TITLE_ID, 2))
        of_year = of_year.where(title.rlike(TITLE_ID))
        ident, late = F.concat(number, kind), number.startswith("LB")
        shown = F.when(late, "Late-Breaking").otherwise(N.lookup(kind, PRESENTATIONS))
        heading = joined(F.regexp_replace(title, TITLE_ID, ""))
    else:
        raw = F.regexp_extract(doi, pattern, 3)
        ident = F.when(F.upper(F.left(raw, F.lit(2))).isin("LB", "TP"), F.upper(raw)).otherwise(raw)
        late = F.upper(raw).startswith("LB") | (F.lower(F.regexp_extract(doi, pattern, 2)) == LATE_SUPPLEMENT)
        shown = F.when(F.lower(ident).startswith("e"), "e-abstract")
        heading = joined(F.regexp_replace(title, r"^Abstract\s+[A-Za-z0-9]+:\s*", ""))
    first = F.get("author", F.lit(0))
    name = N.strip(F.concat_ws(" ", first["given"], first["family"]))
    place = F.rtrim(N.strip(F.regexp_replace(F.get(first["affiliation"], F.lit(0))["name"], r"^\s*\d+\s*", "")), F.lit(";"))
    out = of_year.select(
        F.concat(F.lit(f"{conference}-{year}-"), F.lower(ident)).alias("uid"),
        F.lit(label).alias("conference"),
        F.lit(year).alias("year"),
        ident.alias("abstract_id"),
        late.alias("is_lba"),
        shown.alias("presentation_type"),
        heading.alias("title"),
        N.some(X.strip_markup(F.col("abstract"))).alias("abstract_text"),
        F.concat_ws(", ", name, N.some(place)).alias("author_raw"),
        doi.alias("doi"),
    )
    one = out.withColumn("__n", F.row_number().over(Window.partitionBy("uid").orderBy("doi", "title"))).where("__n = 1").drop("__n")
    return _tagged(one)


def lead_author(authorships: Column) -> Column:
    """PRJ-08: the last corresponding author, else the last one: name, institutions, country; and the companies of all authors."""
    listed = F.array().cast("array<string>")
    corresponding = F.filter(authorships, lambda a: F.coalesce(a["is_corresponding"], F.lit(False)))
    lead = F.coalesce(F.try_element_at(corresponding, F.lit(-1)), F.try_element_at(authorships, F.lit(-1)))
    names = lambda insts: F.array_distinct(F.filter(F.transform(insts, lambda i: i["display_name"]), lambda n: n.isNotNull() & (n != "")))
    of_lead = F.coalesce(names(lead["institutions"]), listed)
    where = F.when(F.size(of_lead) > 0, of_lead).otherwise(F.slice(F.coalesce(lead["raw_affiliation_strings"], listed), F.lit(1), F.lit(1)))
    code = F.get(F.filter(F.transform(lead["institutions"], lambda i: i["country_code"]), lambda c: c.isNotNull() & (c != "")), F.lit(0))
    firms = names(F.flatten(F.array_compact(F.transform(authorships, lambda a: F.filter(a["institutions"], lambda i: i["type"] == "company")))))
    plain = F.transform(F.coalesce(firms, listed), lambda c: N.strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")))
    known = F.flatten(F.transform(plain, lambda c: N.let(N.companies(c), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(c)))))
    return F.when(F.size(authorships) > 0, F.struct(F.coalesce(lead["author"]["display_name"], F.lit("")).alias("name"), where.alias("affiliations"), N.country_of_code(code).alias("country"), F.array_distinct(F.filter(known, lambda c: c != "")).alias("companies")))
