"""The rules over names that have no SQL, held against a walk over every name of the tables in plain Python."""

import hashlib

import duckdb
import pytest
import regex

from therascape import registry
from therascape.functions import vocabulary as V

DATA = "/root/testdata/sf0.001"


def rx(pattern, flags=0):
    """A pattern of the library: with U its classes and letters are Unicode's, else ASCII's."""
    wide = "(?iU)" in pattern or "(?U)" in pattern
    return regex.compile(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""), flags if wide else flags | regex.ASCII)


def stripped(text):
    return regex.sub(r"^\s+|\s+$", "", text)


def until_same(text, step):
    while (new := step(text)) != text:
        text = new
    return text


def biomarker(raw):
    tidy = stripped(regex.sub(r"\s+", " ", raw)).strip(" ,;")
    if not tidy:
        return None
    if tidy.lower() in V.BIOMARKER_ALIAS:
        return V.BIOMARKER_ALIAS[tidy.lower()]

    def shorter(name):
        for tail in V.BIOMARKER_TAILS:
            name = rx(tail).sub("", name).strip(" ,/_-+")
        name = rx(V.BIOMARKER_JOINED).sub(r"\1", name)
        return rx(V.BIOMARKER_SMALL_TAIL).sub("", name)

    base = until_same(tidy, shorter)
    if not base:
        return tidy
    low = base.lower()
    if low in V.BIOMARKER_ALIAS:
        return V.BIOMARKER_ALIAS[low]
    gene = rx(V.GENE).search(base) and (base != low or regex.search("[0-9]", base))
    return base.upper() if gene else base


def institution(raw):
    parts = []
    for p in filter(None, (stripped(x) for x in regex.split("[;,]", raw))):
        if parts and rx(V.COMPANY_SUFFIX).search(p):
            parts[-1] += ", " + p
        else:
            parts.append(p)
    if not parts:
        return stripped(raw)
    named = lambda p: rx(V.INSTITUTION).search(p.lower()) or rx("(?iU)" + V.COMPANY_FIELD).search(p)
    pool = [p for p in parts if not rx(V.SUBUNIT).search(p)] or parts
    chosen = next((p for p in pool if "universit" in p.lower()), None) or next(filter(named, pool), pool[0])
    after = parts[parts.index(chosen) + 1 :][:1]
    if after and rx(V.MULTI_CAMPUS).search(chosen) and len(regex.split(r"\s+", after[0], flags=regex.ASCII)) <= 3 and not named(after[0]):
        chosen += ", " + after[0]
    for pattern, name in V.INSTITUTION_CANON.items():
        if rx("(?i)" + pattern).search(chosen):
            return name
    for pattern in (V.UNIVERSITY_TAIL, V.UNIVERSITY_SCHOOL):
        if (m := rx(pattern).search(chosen)) and m[1]:
            return m[1]
    return chosen


def company(segment):
    low = segment.lower()
    for name, phrases in V.COMPANIES:
        loose = [p for p in phrases if p not in V.COMPANY_WHOLE_WORDS]
        whole = [p for p in phrases if p in V.COMPANY_WHOLE_WORDS]
        if any(p in low for p in loose) or (name in V.COMPANY_PATTERNS and rx(V.COMPANY_PATTERNS[name]).search(low)):
            return name
        if any(regex.search(f"(?<![A-Za-z0-9]){regex.escape(p)}(?![A-Za-z0-9])", low) for p in whole):
            return name
    if rx(V.NOT_A_COMPANY).search(segment) or not rx(V.COMPANY_HINT).search(segment):
        return None
    name = until_same(segment.strip(", "), lambda n: rx(V.LEGAL_TAIL).sub("", n).strip(", "))
    return name if len(name) >= 2 else None


def companies(raw):
    found = [company(s) for s in map(stripped, rx(V.COMPANY_BREAK).split(raw)) if s]
    return "|".join(dict.fromkeys(x for x in found if x is not None))


@pytest.fixture(scope="module")
def names():
    c = duckdb.connect()
    for t in ("documents", "part", "supplier", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return dict(c.execute(f"{registry.NAMES_SQL} SELECT raw, n FROM v").fetchall())


@pytest.mark.parametrize(("query", "rule"), [("nrm_06_biomarker", biomarker), ("nrm_09_institution", institution), ("nrm_11_companies", companies)])
def test_every_name_of_the_tables(spark, names, query, rule):
    digest = lambda raw: hashlib.md5(raw.encode()).hexdigest()
    want = {digest(raw): (rule(raw), n) for raw, n in names.items()}
    of_tables = {r.digest: (r.name, r.n) for r in registry.QUERIES[f"{query}_tables"](spark, DATA).collect()}
    assert of_tables == want
    more = {r.digest: r.name for r in registry.QUERIES[query](spark, DATA).collect()}
    assert len(more) > len(want) and {k: more[k] for k in want} == {k: v for k, (v, _) in want.items()}
