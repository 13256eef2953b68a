import json

from pyspark.sql import functions as F

from therascape.functions import drugs
from therascape.sources import literature as L
from therascape.sources import store, studies
from therascape.sources.keyed import KeyedStore
from therascape.streaming import increments

STUDY = {
    "protocolSection": {
        "identificationModule": {"nctId": "NCT00000001", "briefTitle": "b", "officialTitle": "o"},
        "statusModule": {"overallStatus": "RECRUITING", "primaryCompletionDateStruct": {"date": "2024-06"}, "lastUpdatePostDateStruct": {"date": "2024-05-02"}},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "AstraZeneca UK Limited"}, "collaborators": [{"name": "X"}]},
        "descriptionModule": {"briefSummary": "Study of a HER2 binder"},
        "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "Cisplatin 75 mg"}, {"type": "DRUG", "name": "AZD-123 QD", "description": "an antibody-drug conjugate"}, {"type": "DRUG", "name": "cisplatin"}, {"type": "DEVICE", "name": "pump"}]},
        "conditionsModule": {"conditions": ["Breast Cancer", "Nausea"]},
        "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 7}},
        "contactsLocationsModule": {"locations": [{"country": "Spain"}, {"country": "Spain"}, {}]},
        "referencesModule": {"references": [{"pmid": "1", "type": "RESULT", "citation": "Title. Rest."}, {"pmid": "1", "type": "DERIVED"}, {"pmid": "2", "type": "BACKGROUND"}, {"type": "RESULT"}]},
    }
}
BARE = {"protocolSection": {"armsInterventionsModule": {"interventions": [{"type": "DEVICE", "name": "pump"}]}, "conditionsModule": {"conditions": ["Pain"]}}}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_studies_become_programs(spark, tmp_path):
    path = write(tmp_path / "full_2024-05-01.json", json.dumps({"studies": [STUDY, BARE, {"protocolSection": {}}]}, indent=1))
    raw = studies.read_studies(spark, path)
    assert raw.count() == 3 and studies.updated_since(raw, "2024-05-02").count() == 1
    rows = {r["brief_title"]: r for r in studies.to_programs(raw).collect()}
    a, b = rows["b"], rows[""]
    assert len(rows) == 2
    assert (a["drug_name"], a["combo_drugs"], a["company_normalized"], a["countries"], a["phase"], a["modality"], a["target"]) == ("AZD-123", ["Cisplatin"], "AstraZeneca", ["Spain"], "PHASE1/PHASE2", "ADC", "HER2")
    assert (a["cancer_categories"], a["is_oncology"], a["partnership_status"], a["moa"]) == (["Breast"], True, "partnered", "ADC targeting HER2")
    assert [tuple(x) for x in a["pubmed_links"]] == [("1", "Title", "RESULT")]
    assert (b["drug_name"], b["is_oncology"], b["phase"], b["nct_ids"], b["countries"], b["cancer_categories"]) == ("pump", False, "UNKNOWN", [], [], ["Other"])


def test_latest_snapshot(spark):
    files = spark.createDataFrame([("a/full_2024-01-02.json",), ("a/full_2024-02-01.json",), ("a/delta_2025-01-01.json",)], "path string")
    assert studies.latest_snapshot(files).first()["day"] == "2024-02-01"
    assert studies.latest_snapshot(files.limit(0)).first()["day"] is None


def test_leading_drug(spark):
    df = spark.createDataFrame([(0, ["Placebo", "Carboplatin", "Tablet", "ABC-1", "abc-1 10 mg"]), (1, []), (2, None), (3, [" ", None])], "k int, n array<string>")
    assert [r[0] for r in df.orderBy("k").select(drugs.lead_first(F.col("n"))).collect()] == [["ABC-1", "Placebo", "Carboplatin", "Tablet"], ["Unknown"], ["Unknown"], ["Unknown"]]


XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>77</PMID><Article><Journal><ISOAbbreviation>J Onc</ISOAbbreviation><Title>Journal of Onc</Title></Journal>
<ArticleTitle>A phase II and phase 3 trial of osimertinib</ArticleTitle><Abstract><AbstractText Label="AIM">EGFR.</AbstractText><AbstractText>NCT00000009 done.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName><AffiliationInfo><Affiliation>Acme Therapeutics, Boston, MA</Affiliation></AffiliationInfo></Author></AuthorList>
<DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList><AccessionNumber>NCT00000008</AccessionNumber><AccessionNumber>x</AccessionNumber></AccessionNumberList></DataBank></DataBankList>
<PublicationTypeList><PublicationType>Review</PublicationType><PublicationType>Clinical Trial, Phase II</PublicationType></PublicationTypeList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">77</ArticleId><ArticleId IdType="doi">10.1/AB</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>78</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    rows = L.publications(L.read_articles(spark, write(tmp_path / "a.xml", XML)), 2024).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["uid"], r["conference"], r["doi"], r["publication_type"], r["abstract_text"]) == ("pub-2024-77", "J Onc", "10.1/ab", "Phase II Trial", "AIM: EGFR. NCT00000009 done.")
    assert (r["nct_ids"], r["phases"], r["phase"], r["target_list"], r["companies_normalized"]) == (["NCT00000008", "NCT00000009"], ["PHASE2", "PHASE3"], "PHASE2", ["EGFR"], ["Acme Therapeutics"])
    assert r["author"].asDict() == {"name": "Jo Doe", "affiliation": "Acme Therapeutics", "city": "Boston", "region": "MA", "country": "USA", "is_company": True}


def test_years_of_articles(spark, tmp_path):
    def one(pmid, issue, own=""):
        return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate>{issue}</PubDate></JournalIssue></Journal><ArticleTitle>t</ArticleTitle>{own}</Article></MedlineCitation></PubmedArticle>"

    date = "<ArticleDate><Year>2021</Year></ArticleDate>"
    rows = [one(1, "<Year>2024</Year>", date), one(2, "<MedlineDate>Winter 1998-2000</MedlineDate>", date), one(3, "<MedlineDate>Spring</MedlineDate>", date), one(4, "<Month>May</Month>")]
    got = {r.pmid: (r.uid, r.year) for r in L.publications(L.read_articles(spark, write(tmp_path / "y.xml", f"<PubmedArticleSet>{''.join(rows)}</PubmedArticleSet>"))).collect()}
    assert got == {"1": ("pub-2024-1", 2024), "2": ("pub-1998-2", 1998), "3": ("pub-2021-3", 2021), "4": ("pub-unknown-4", None)}


def test_works(spark, tmp_path):
    works = [
        {"DOI": "10.1200/jco.2026.44.17_suppl.lba1", "title": ["Abstract 5: KRAS trial"], "author": [{"given": "A", "family": "B", "affiliation": [{"name": "1 Acme Inc., Paris, France;"}]}], "abstract": "<jats:title>x</jats:title><jats:p>Text &lt; 5</jats:p>"},
        {"DOI": "10.1200/jco.2025.44.16_suppl.e9", "title": ["old"]},
        {"DOI": "10.1200/jco.2026.44.16_suppl.e9", "title": ["new"]},
        {"DOI": "10.1016/j.annonc.2026.09.1", "title": ["12MO A title"]},
        {"DOI": None},
    ]
    df = L.read_works(spark, write(tmp_path / "w.json", "\n".join(map(json.dumps, works))))
    asco = {r["abstract_id"]: r for r in L.abstracts(df, "asco", 2026).collect()}
    assert set(asco) == {"LBA1", "e9"}
    assert (asco["LBA1"]["is_lba"], asco["LBA1"]["title"], asco["LBA1"]["abstract_text"], asco["LBA1"]["author"]["country"]) == (True, "KRAS trial", "Text < 5", "France")
    assert (asco["e9"]["presentation_type"], asco["e9"]["status"], asco["e9"]["author"]) == ("e-abstract", "title_only", None)
    esmo = L.abstracts(df, "esmo", 2026).collect()
    assert [(r["uid"], r["presentation_type"], r["title"]) for r in esmo] == [("esmo-2026-12mo", "Mini Oral", "A title")]


def test_lead_author(spark):
    kind = "array<struct<is_corresponding:boolean,author:struct<display_name:string>,institutions:array<struct<display_name:string,country_code:string,type:string>>,raw_affiliation_strings:array<string>>>"
    data = [(0, [(True, ("A",), [("Pfizer (United States)", "us", "company")], None), (None, ("B",), None, ["raw"])]), (1, [(False, ("B",), None, ["raw", "x"])]), (2, []), (3, None)]
    rows = [r[0] for r in spark.createDataFrame(data, f"k int, a {kind}").orderBy("k").select(L.lead_author(F.col("a"))).collect()]
    assert rows[0].asDict() == {"name": "A", "affiliations": ["Pfizer (United States)"], "country": "USA", "companies": ["Pfizer"]}
    assert rows[1].asDict() == {"name": "B", "affiliations": ["raw"], "country": None, "companies": []}
    assert rows[2:] == [None, None]


def test_store(spark, tmp_path):
    path = str(tmp_path / "lit")
    df = spark.createDataFrame([("a", "X", 2024), ("b", "Y", 2025)], "uid string, conference string, year int")
    store.write_partitioned(df, path, ["conference", "year"])
    store.append_missing(spark.createDataFrame([("b", "Y", 2025), ("c", "Y", 2025), ("c", "Y", 2025)], df.schema), path, "uid", ["conference", "year"])
    assert sorted(r["uid"] for r in store.read_partitions(spark, path, year=2025).collect()) == ["b", "c"]
    assert store.read_or_empty(spark, str(tmp_path / "none"), "x int").count() == 0
    assert {tuple(r) for r in store.manifest(spark.read.parquet(path), ["conference"]).collect()} == {("X", 1), ("Y", 2)}
    raw = spark.createDataFrame([('{"k1": {"confidence": 0.5}, "k2": null}',), (None,)], "value string")
    assert {tuple(r) for r in store.cached_answers(raw, "confidence: double").collect()} == {("k1", 0.5), ("k2", None)}


def test_lite_records(spark):
    kind = "uid string, abstract_text string, biomarker_list array<string>, target_list array<string>, authors array<struct<name:string,affiliation:string,affiliations:array<string>>>"
    df = spark.createDataFrame([("a", "t", ["KRAS G12C", "KRAS"], ["ErbB-2"], [("N", "Yonsei University Health System", ["Mayo Clinic, MN"]), ("M", None, None)]), ("b", None, None, None, None)], kind)
    a, b = store.lite(df, ["uid", "biomarker_list", "target_list", "authors"]).orderBy("uid").collect()
    assert (a["has_body"], a["biomarker_list"], a["target_list"], [tuple(x) for x in a["authors"]]) == (True, ["KRAS"], ["HER2"], [("N", "Yonsei University", ["Mayo Clinic"])])
    assert (b["has_body"], b["authors"]) == (False, None)


def test_increments(spark, tmp_path):
    inbox, table, check = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "check")
    inbox.mkdir()
    keyed = KeyedStore(spark, table, ["nct"], "nct string, last_update_date string", ["last_update_date"])

    def study(nct, day):
        return json.dumps({"protocolSection": {"identificationModule": {"nctId": nct}, "statusModule": {"lastUpdatePostDateStruct": {"date": day}}}})

    def run():
        stream = increments.arriving_studies(spark, str(inbox)).select(F.col("protocolSection.identificationModule.nctId").alias("nct"), F.col("protocolSection.statusModule.lastUpdatePostDateStruct.date").alias("last_update_date"))
        increments.run_available(stream, check, lambda new, _: keyed.upsert(new)).awaitTermination()

    write(inbox / "1.json", study("a", "1") + "\n" + study("b", "1"))
    run()
    write(inbox / "2.json", study("b", "2") + "\n" + study("c", "2") + "\n" + study("c", "1"))
    run()
    assert sorted(tuple(r) for r in keyed.read().collect()) == [("a", "1"), ("b", "2"), ("c", "2")]
    cur, old = spark.createDataFrame([("a",), ("b",), (None,)], "pmid string"), spark.createDataFrame([("a",)], "pmid string")
    assert [r[0] for r in increments.new_since(cur, old, "pmid").collect()] == ["b"]
    assert increments.new_since(cur, old.limit(0), "pmid").count() == 0
