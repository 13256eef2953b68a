"""Display labels, kinds of presentation, colours and lengths of charts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions.normalize import lookup

#: Short phase labels, in the order in which phases are shown.
PHASE_LABELS = {"EARLY_PHASE1": "Early Ph1", "PHASE1": "Ph1", "PHASE2": "Ph2", "PHASE3": "Ph3", "PHASE4": "Ph4", "NA": "N/A", "UNKNOWN": "Unknown"}
PHASE_ORDER = ["EARLY_PHASE1", "PHASE1", "PHASE2", "PHASE3", "PHASE4", "NA"]
#: Status labels in the order in which they are shown.
STATUS_LABELS = {
    "NOT_YET_RECRUITING": "Not yet recruiting",
    "RECRUITING": "Recruiting",
    "ENROLLING_BY_INVITATION": "By invitation",
    "ACTIVE_NOT_RECRUITING": "Active",
    "COMPLETED": "Completed",
    "TERMINATED": "Terminated",
    "SUSPENDED": "Suspended",
    "WITHDRAWN": "Withdrawn",
    "UNKNOWN": "Unknown",
}
#: Kinds of presentation and of publication in the order of the option list.
KINDS = [
    "Late-Breaking",
    "Trials in Progress",
    "Oral",
    "Mini Oral",
    "Poster Discussion",
    "Poster",
    "Clinical Trial",
    "Symposium",
    "Online only",
    "Presented",
    "RCT",
    "Phase III Trial",
    "Phase II Trial",
    "Phase I Trial",
    "Phase IV Trial",
    "Controlled Trial",
    "Meta-Analysis",
    "Systematic Review",
    "Observational",
    "Multicenter",
    "Comparative",
    "Review",
    "Case Report",
    "Journal Article",
]
#: Targets and modalities that suit a companion diagnostic.
CDX_TARGETS = ["HER2", "PD-L1", "TROP2", "EGFR", "CLDN18.2", "MET"]
CDX_MODALITIES = ["ADC", "Bispecific Antibody", "CAR-T", "Cell Therapy"]


def phase_label(phase: Column) -> Column:
    """SCL-S29: PHASE1/PHASE2 reads Ph1/Ph2; none reads Unknown, an unlisted phase itself."""
    parts = F.transform(F.split(phase, "/"), lambda p: F.coalesce(lookup(p, PHASE_LABELS), p))
    return F.when(F.coalesce(phase, F.lit("")) == "", "Unknown").otherwise(F.array_join(parts, "/"))


def status_label(status: Column) -> Column:
    """SCL-S34: an unlisted status reads itself."""
    return F.coalesce(lookup(status, STATUS_LABELS), status)


def presentation_kind(kind: Column, abstract_id: Column, conference: Column) -> Column:
    """SCL-S30: a named kind as it is; else, and for e-abstracts, what the number's beginning tells; null if nothing."""
    name, number = F.coalesce(kind, F.lit("")), F.upper(F.coalesce(abstract_id, F.lit("")))
    return (
        F.when((name != "") & (name != "e-abstract"), name)
        .when(number.rlike(r"^(?:LBA|LB\d)"), "Late-Breaking")
        .when(number.startswith("TPS"), "Trials in Progress")
        .when(number.startswith("CT"), "Clinical Trial")
        .when(number.rlike("^(?:SY|PL|ED|NG|ND|SS|LE)"), "Symposium")
        .when((name == "e-abstract") | (F.coalesce(conference == "ASCO", F.lit(False)) & number.rlike(r"^E\d")), "Online only")
        .when(number.rlike(r"^\d"), "Presented")
    )


def shortened(label: Column, most: int = 20) -> Column:
    """SCL-S32: at most ``most`` characters and an ellipsis."""
    return F.when(F.length(label) > most, F.concat(F.left(label, F.lit(most)), F.lit("…"))).otherwise(label)


def log_length(value: Column, largest: Column, width: float = 100.0) -> Column:
    """SCL-M03: the length of a bar on a logarithmic scale that ends at ``width`` for the largest value."""
    return F.coalesce(F.log10(value + F.lit(1.0)) / F.nullif(F.log10(largest + F.lit(1.0)), F.lit(0.0)), F.lit(0.0)) * width


def heat_colour(value: Column, largest: Column, low: tuple[int, int, int] = (255, 255, 255), high: tuple[int, int, int] = (37, 99, 235)) -> Column:
    """SCL-M04: a hex colour between two by the ratio of logarithms."""
    ratio = F.coalesce(F.log1p(value.cast("double")) / F.nullif(F.log1p(largest.cast("double")), F.lit(0.0)), F.lit(0.0))
    part = lambda a, b: F.floor(F.lit(float(a)) + ratio * float(b - a) + 0.5).cast("int")
    return F.format_string("#%02x%02x%02x", *[part(a, b) for a, b in zip(low, high, strict=True)])


def bubble_radius(value: Column, largest: Column, least: float = 3.0, most: float = 22.0) -> Column:
    """SCL-M05: a radius whose square grows with the value."""
    return F.lit(least) + F.coalesce(F.sqrt(value.cast("double") / F.nullif(largest.cast("double"), F.lit(0.0))), F.lit(0.0)) * (most - least)


def phase_cell(ongoing: Column, completed: Column, stopped: Column) -> Column:
    """PRJ-14: the counts that are not zero, as text; empty if all are."""
    word = lambda n, w: F.when(n > 0, F.concat(F.lit(w), n.cast("string")))
    return F.concat_ws(" / ", word(ongoing, "진행"), word(completed, "완료"), word(stopped, "중단"))


def cutoff(as_of: Column, days: int = 8) -> Column:
    """SCL-D05: the day so many days before, as text."""
    return F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")
