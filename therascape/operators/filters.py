"""Conjunctive filters over programs and literature, compiled to Columns; an empty axis passes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions import normalize as N
from therascape.functions.labels import presentation_kind


def overlaps(arrays: Column, chosen: list[str]) -> Column:
    """True if any element was chosen; nulls never match."""
    return F.coalesce(F.arrays_overlap(F.array_compact(arrays), F.array(*map(F.lit, chosen))), F.lit(False))


def blob_contains(columns: list[Column], keyword: str) -> Column:
    """Case-insensitive substring of the blank-joined non-empty values; a match may straddle two of them."""
    return F.lower(F.concat_ws(" ", *columns)).contains(keyword.lower())


def any_chosen(df_columns: list[str], lists: str, one: str, chosen: list[str]) -> Column:
    """True if any element of the list column was chosen; where that is absent or empty the scalar counts."""
    if lists not in df_columns:
        return F.col(one).isin(chosen)
    full = F.coalesce(F.size(lists), F.lit(0)) > 0
    return F.when(full, overlaps(F.col(lists), chosen)).otherwise(F.col(one).isin(chosen))


def phase_chosen(phases: Column, chosen: list[str]) -> Column:
    """Any phase was chosen; the chosen NA holds for none, for UNKNOWN alone and for NA itself."""
    named = F.filter(F.coalesce(phases, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "") & (p != "UNKNOWN"))
    hit = overlaps(named, chosen)
    return hit | (F.size(named) == 0) if "NA" in chosen else hit


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & F.coalesce(test, F.lit(False))
    return out


def blob(columns: list[str], scalars: list[str], lists: list[str], keyword: str) -> Column:
    """``blob_contains`` over those of the named columns that the table has."""
    one = [F.nullif(F.col(c), F.lit("")) for c in scalars if c in columns]
    return blob_contains(one + [F.array_remove(c, "") for c in lists if c in columns], keyword)


@dataclass(frozen=True)
class ProgramFilter:
    """Axes of the program table."""

    companies: list[str] = field(default_factory=list)
    drugs: list[str] = field(default_factory=list)
    cancers: list[str] = field(default_factory=list)
    modalities: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    biomarkers: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    phases: list[str] = field(default_factory=list)
    regimen: str = "all"
    needs_review: bool = False
    oncology_only: bool = False
    start_years: tuple[int | None, int | None] = (None, None)
    completion_years: tuple[int | None, int | None] = (None, None)
    keyword: str = ""
    partnership: str = "all"
    any_company: str = ""
    trial: str = ""

    def column(self, columns: list[str] | None = None) -> Column:
        """The filter; ``columns`` are those of the table (default: the bridge's), which say what lists and texts there are.

        A chosen trial (``trial``) sets all other axes aside; ``any_company`` holds for the sponsor and its collaborators.
        """
        from therascape.functions.text import year_of

        if columns is None:
            columns = ["drug_name", "company", "cancer_category", "modality", "target", "overall_status", "phase", "nct_id", "biomarkers"]
        if self.trial:
            return F.coalesce(F.array_contains("nct_ids", self.trial), F.lit(False))
        tests = [F.col(c).isin(v) for c, v in (("company_normalized", self.companies), ("drug_name", self.drugs), ("modality", self.modalities), ("target", self.targets), ("overall_status", self.statuses)) if v]
        if self.cancers:
            tests.append(any_chosen(columns, "cancer_categories", "cancer_category", self.cancers))
        if self.partnership != "all":
            tests.append(F.col("partnership_status") == self.partnership)
        if self.any_company:
            tests.append((F.col("company") == self.any_company) | F.coalesce(F.array_contains("collaborators", self.any_company), F.lit(False)))
        if self.biomarkers:
            tests.append(overlaps(F.col("biomarkers"), self.biomarkers))
        if self.phases:
            tests.append(phase_chosen(F.col("phases") if "phases" in columns else F.split(F.coalesce("phase", F.lit("")), "/"), self.phases))
        if self.regimen != "all":
            tests.append(F.coalesce("is_combination", F.lit(False)) == (self.regimen == "combo"))
        if self.needs_review:
            tests.append(F.col("target") == "Unknown")
        if self.oncology_only:
            tests.append(F.coalesce("is_oncology", F.lit(True)))
        for column, (low, high) in (("start_date", self.start_years), ("completion_date", self.completion_years)):
            year = year_of(F.col(column))
            tests += [year >= low] if low is not None else []
            tests += [year <= high] if high is not None else []
        if self.keyword:
            scalars = ["drug_name", "company", "company_normalized", "target", "modality", "condition", "cancer_category", "official_title", "brief_title", "moa", "overall_status"]
            if "nct_ids" not in columns:
                scalars = ["drug_name", "company", "cancer_category", "modality", "target", "overall_status", "phase", "nct_id"]
            lists = ["combo_drugs", "conditions", "cancer_categories", "biomarkers", "collaborators", "primary_outcomes", "nct_ids"]
            tests.append(blob(columns, scalars, lists, self.keyword))
        return _all(tests)


@dataclass(frozen=True)
class LiteratureFilter:
    """Axes of the literature table; embargoed records are hidden unless asked for."""

    conferences: list[str] = field(default_factory=list)
    years: list[int] = field(default_factory=list)
    cancers: list[str] = field(default_factory=list)
    modalities: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    author: str = ""
    nct_id: str = ""
    keyword: str = ""
    show_embargoed: bool = False
    phases: list[str] = field(default_factory=list)
    companies: list[str] = field(default_factory=list)
    biomarkers: list[str] = field(default_factory=list)
    institutions: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    affiliation: str = ""
    author_affiliation: str = ""

    def column(self, columns: list[str] | None = None) -> Column:
        """The filter of tables; ``columns`` are those of the table (default: the bridge's)."""
        columns = columns or ["title", "author", "uid", "modality_list", "target_list", "countries", "nct_id", "cancer_category"]
        tests = [] if self.show_embargoed else [~F.col("status").eqNullSafe("embargoed")]
        tests += [F.col(c).isin(v) for c, v in (("conference", self.conferences), ("year", self.years)) if v]
        if self.cancers:
            tests.append(any_chosen(columns, "cancer_list", "cancer_category", self.cancers))
        if self.countries:
            by_name = N.country(F.col("country_raw")).isin(self.countries) if "country_raw" in columns else overlaps(F.col("countries"), self.countries)
            tests.append(by_name)
        if self.phases:  # here NA means no phase at all
            none = F.coalesce(F.size("phases"), F.lit(0)) == 0
            tests.append(overlaps(F.col("phases"), self.phases) | (none if "NA" in self.phases else F.lit(False)))
        tests += self._lists()
        tests += [F.col("author") == self.author] if self.author else []
        if self.author_affiliation:
            tests.append(F.coalesce("affiliation", F.lit("")) == self.author_affiliation)
        if self.affiliation.strip():
            tests.append(F.contains(F.lower(F.coalesce("affiliation", F.lit(""))), F.lit(self.affiliation.strip().lower())))
        if self.kinds:
            tests.append(presentation_kind(F.col("presentation_type"), F.col("abstract_id"), F.col("conference")).isin(self.kinds))
        if self.nct_id:
            tests.append(F.array_contains("nct_ids", self.nct_id) if "nct_ids" in columns else F.col("nct_id") == self.nct_id)
        if self.keyword:
            scalars, lists = ["title", "author", "abstract_id", "country_raw", "affiliation"], ["target_list", "biomarker_list", "nct_ids", "drugs_mentioned", "companies", "companies_normalized", "cancer_list"]
            if "nct_ids" not in columns:
                scalars, lists = ["title", "author", "uid"], ["modality_list", "target_list", "countries"]
            tests.append(blob(columns, scalars, lists, self.keyword))
        return _all(tests)

    def _lists(self) -> list[Column]:
        axes = (("modality_list", self.modalities), ("target_list", self.targets), ("companies_normalized", self.companies), ("biomarker_list", self.biomarkers))
        out = [overlaps(F.col(c), v) for c, v in axes if v]
        return out + ([N.institution(F.col("affiliation")).isin(self.institutions)] if self.institutions else [])

    def chart_column(self, columns: list[str]) -> Column:
        """The filter of charts: no conference, year, country, kind or embargo, no NA among phases, and a keyword over fewer fields."""
        tests = [any_chosen(columns, "cancer_list", "cancer_category", self.cancers)] if self.cancers else []
        tests += [overlaps(F.col("phases"), self.phases)] if self.phases else []
        tests += self._lists()
        if self.keyword.strip():
            tests.append(blob(columns, ["title", "author", "abstract_id"], ["target_list", "biomarker_list", "nct_ids", "drugs_mentioned", "companies_normalized", "cancer_list"], self.keyword.strip()))
        return _all(tests)
