"""Drugs, cancers and sponsors that texts name, and keys of authors, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions import dictionaries as D
from therascape.functions.normalize import let
from therascape.functions.text import has_any, java_quote

#: Endings of generic drug names.
DRUG_ENDINGS = [
    "mab", "nib", "tinib", "ciclib", "parib", "rasib", "lisib", "degib", "zomib", "metinib", "tecan", "platin", "rubicin", "taxel", "citabine", "ciloleucel",
    "leucel", "brutinib", "asib", "fenib", "limus", "sidenib",
]
#: A code name with its hyphen, and beginnings of such that are no drugs.
DRUG_CODE = r"\b([A-Z]{2,5}-\d{2,6}[A-Z]{0,2}\d{0,2})\b"
NO_DRUG = [
    "CA", "CD", "IL", "HPV", "COVID", "SARS", "GDF", "TGF", "EGF", "FGF", "VEGF", "IGG", "IGM", "IP", "HR", "CI", "OS", "PFS", "CLL", "AML", "CRC", "GI", "DIPG", "ICD", "SF", "SOC", "NSF",
    "TBCRC", "OPBC", "TTCC", "BCRF", "OPERA", "TRUCE", "GOG", "SOLTI", "CGGA", "IFCT", "FIGHT", "HIPEC", "IIT", "II", "EF", "SURE", "OMAHA", "CLIO", "EV", "EPC", "AA", "KN",
]
#: Parts of track names and the cancers they stand for, the first that fits.
TRACK_CANCER = {
    "PROSTATE": "Prostate",
    "KIDNEY": "Renal",
    "UROTHELIAL": "Bladder",
    "BLADDER": "Bladder",
    "GASTROESOPHAGEAL": "Gastric",
    "PANCREATIC": "Pancreatic",
    "HEPATOBILIARY": "Liver",
    "COLORECTAL": "Colorectal",
    "LUNG": "Lung",
    "BREAST": "Breast",
    "MELANOMA": "Melanoma",
    "SKIN": "Skin",
    "SARCOMA": "Sarcoma",
    "CENTRAL NERVOUS": "Glioma",
    "HEAD AND NECK": "Head & Neck",
    "HEMATOLOGIC": "Hematologic",
}
MOST_DRUGS = 10


def drugs(text: Column) -> Column:
    """SCL-S12: the drugs a text names, generic names first, then code names, each once whatever its case; the first ten count."""
    generic = rf"\b([A-Za-z]{{5,}}(?:{'|'.join(sorted(DRUG_ENDINGS, key=len, reverse=True))}))\b"
    found = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(1))
    codes = F.filter(found(DRUG_CODE), lambda c: ~F.substring_index(c, "-", 1).isin(NO_DRUG))
    once = lambda xs: let(F.transform(xs, F.lower), lambda low: F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))
    return F.slice(let(F.concat(found(generic), codes), once), 1, MOST_DRUGS)


def cancers(track: Column, title: Column) -> Column:
    """SCL-S09: the cancers of a title, by abbreviations in capitals that stand alone and other words anywhere; else that of the track, if any."""
    text = F.coalesce(title, F.lit(""))
    tests = []
    for name, keywords in D.CANCER.items():
        capital, other = [k for k in keywords if k.isupper()], [k for k in keywords if not k.isupper()]
        test = has_any(text, other) if other else F.lit(False)
        if capital:
            test = test | text.rlike("(?<![A-Za-z])(?:" + "|".join(map(java_quote, capital)) + ")(?![A-Za-z])")
        tests.append(F.when(test, F.lit(name)))
    upper = F.upper(F.coalesce(track, F.lit("")))
    by_track = F.coalesce(*[F.when(F.contains(upper, F.lit(k)), F.array(F.lit(v))) for k, v in TRACK_CANCER.items()], F.array().cast("array<string>"))
    return let(F.array_compact(F.array(*tests)), lambda found: F.when(F.size(found) > 0, found).otherwise(by_track))


def sponsor(raw: Column) -> Column:
    """SCL-S16: a sponsor without blanks and full stops at its end; null if none is named."""
    name = F.trim(F.regexp_replace(F.trim(raw), r"\.+$", ""))
    return F.when(~F.lower(name).isin("none", ""), name)


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the plain letters below them, by Unicode's decompositions."""
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c)[0] != c]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def author_key(name: Column, affiliation: Column) -> Column:
    """SCL-S14: letters and digits of a name without marks, and the beginning of the affiliation's first part."""
    plain = F.translate(F.regexp_replace(F.lower(name), r"\p{Mn}", ""), *_plain_letters())
    who = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))
    first = F.left(F.trim(F.lower(F.substring_index(F.coalesce(affiliation, F.lit("")), ",", 1))), F.lit(20))
    return F.concat(who, F.lit("|"), F.regexp_replace(first, "[^a-z0-9]+", "_"))
