import random
import re

from therascape.sources import books as B

BOOK = [
    "2026 ASCO Annual Meeting",
    "BREAST CANCER—LOCAL/REGIONAL/ADJUVANT",
    "12s",
    "509",
    "Rapid Oral Abstract Session",
    "Neoadjuvant pyrotinib vs pertuzumab therapy for HER2-positive early breast cancer: The HELEN HER-\n013 randomized clinical trial.",
    "First Author: Jiujun Zhu, Department of Breast Disease, Henan Breast Cancer Center, The Affiliated Cancer Hospital of Zhengzhou University & Henan Cancer Hospital, Zhengzhou, China",
    "Background: Docetaxel, carboplatin and trastuzumab in a phase III study.\nConclusions: an alternative neoadjuvant strategy (NCT05918328).\nResearch Sponsor: None.",
    "Visit meetings.asco.org and search by abstract for the full list\nof authors. May 12, 2026.",
    "LBA7",
    "Poster Session\nLate data of ABC-123 in lung cancer. First  Author: Ann Lee, Acme Therapeutics, Inc., Boston, MA",
    "The  full, final text of this abstract will be available at 7:00 AM",
    "Research Sponsor: Acme Therapeutics.\n\nClinical trial information: NCT00000001.",
    "LUNG CANCER",
    "DEVELOPMENTAL THERAPEUTICS",
    "TPS9",
    "not a session",
    "509",
    "poster discussion session",
    "A repeated number",
    "3001",
    "Oral Abstract Session",
    "3002",
    "Plenary Session",
    "Title without authors",
]


def frame(spark, boxes, book="a"):
    return spark.createDataFrame([(book, 7 * k, x) for k, x in enumerate(boxes)], "book string, place long, text string").repartition(3)


def test_record_of_the_schema(spark):
    rows = {r.abstract_id: r for r in B.abstracts(B.blocks(frame(spark, BOOK, "asco"))).collect()}
    assert set(rows) == {"509", "LBA7", "3001", "3002"}
    r = rows["509"]
    assert (r.uid, r.conference, r.year, r.is_lba, r.status, r.presentation_type) == ("asco-2026-509", "ASCO", 2026, False, "available", "Rapid Oral Abstract Session")
    assert r.track == "BREAST CANCER—LOCAL/REGIONAL/ADJUVANT" and r.cancer_category == ["Breast", "Cancer (NOS)"]
    assert r.title == "Neoadjuvant pyrotinib vs pertuzumab therapy for HER2-positive early breast cancer: The HELEN HER013 randomized clinical trial"
    assert r.abstract_text == "Background: Docetaxel, carboplatin and trastuzumab in a phase III study. Conclusions: an alternative neoadjuvant strategy (NCT05918328)."
    (a,) = r.authors
    assert (a["name"], a["author_key"], a["role"], a["order"], a["city"], a["region"], a["country"], a["is_company"]) == ("Jiujun Zhu", "jiujun_zhu|department_of_breast", "first", 1, "Zhengzhou", None, "China", False)
    assert r.author_raw.startswith("Jiujun Zhu, Department of Breast Disease, Henan") and r.author_raw.endswith("Zhengzhou, China")
    assert (r.phase, r.phases, r.nct_ids, r.clinicaltrials_url) == ("PHASE3", ["PHASE3"], ["NCT05918328"], "https://clinicaltrials.gov/study/NCT05918328")
    assert "HER2" in r.target_list and r.biomarker_mentioned and r.drugs_mentioned[:2] == ["pyrotinib", "pertuzumab"]
    assert (r.research_sponsor, r.companies, r.keyword_parsed, r.enrichment_status) == ("None.", [], True, "dictionary_v1")
    late = rows["LBA7"]
    assert (late.is_lba, late.status, late.abstract_text, late.enrichment_status, late.title) == (True, "embargoed", None, "embargoed", "Late data of ABC-123 in lung cancer")
    assert (late.authors[0]["region"], late.authors[0]["country"], late.authors[0]["is_company"]) == ("MA", "USA", True)
    assert (late.research_sponsor, late.companies, late.nct_ids) == ("Acme Therapeutics.", ["Acme Therapeutics"], ["NCT00000001"])
    assert late.track == "BREAST CANCER—LOCAL/REGIONAL/ADJUVANT"  # the last one named before a beginning
    assert (rows["3001"].title, rows["3001"].status, rows["3001"].authors) == ("", "embargoed", []) and rows["3002"].title == "Title without authors"


def by_hand(boxes):
    """The blocks of one book, walked box by box."""
    starts = [k for k in range(len(boxes) - 1) if re.match(r"^(LBA\d+|TPS\d+|\d{3,5})$", boxes[k]) and re.match(B.SESSION, boxes[k + 1])]
    out, track = {}, None
    for n, k in enumerate(starts):
        for x in boxes[max(0, k - 4) : k]:
            if re.match(B.TRACK, x) and not re.match(B.NUMBER, x):
                track = x
        end = starts[n + 1] if n + 1 < len(starts) else len(boxes)
        out.setdefault(boxes[k], (track, boxes[k + 1 : end]))
    return out


def test_stretches_hand_over_what_is_open(spark):
    rng = random.Random(3)
    some = ["LUNG CANCER", "BREAST CANCER", "Poster Session", "Plenary Session here", "text", "more text", "12s"]
    for size in (1, 2, 7, 1000):
        boxes = [x for _ in range(60) for x in ([rng.choice(some)] * rng.randint(0, 2) + [str(rng.randint(100, 400))] + rng.choices(some, k=rng.randint(0, 6)))]
        frames = frame(spark, boxes).union(frame(spark, boxes[::-1], "b")).union(frame(spark, ["", "  "], "c"))
        got = {(r.book, r.abstract_id): (r.track, r.block) for r in B.blocks(frames, stretch=7 * size).collect()}
        want = {("a", k): v for k, v in by_hand(boxes).items()} | {("b", k): v for k, v in by_hand(boxes[::-1]).items()}
        assert got == want


def test_boxes_are_read_by_columns(spark):
    rows = [("a", 2, 100.0, 0.0, 10.0, 5.0, "p2"), ("a", 1, 100.0, 60.0, 90.0, 99.0, "right"), ("a", 1, 100.0, 0.0, 40.0, 10.0, "low"), ("a", 1, 100.0, 5.0, 40.0, 90.4, "second"), ("a", 1, 100.0, 2.0, 40.0, 89.9, "first"), ("a", 1, 100.0, 0.0, 9.0, 50.0, "  ")]
    df = spark.createDataFrame(rows, "book string, page int, width double, x0 double, x1 double, y0 double, text string")
    assert [r.text for r in B.reading_order(df).orderBy("place").collect()] == ["first", "second", "low", "right", "p2"]
