"""Whole pages of charts as one result: distributions, trends, stacked bars and summary cards in one pass over the rows.

Rows are counted by each chart's own columns before these are made into (chart, name, series) entries; a name then holds its counts by
series (years or statuses) in one small list.  Names are cut to a chart's largest in salted parts, and what is behind them is added
up on the way, so no task sees all names of a chart; what meets at the end has as many rows as the page shows, times the salts.

Defined results: null lists, null and empty names count nowhere; ties go by name; a page of no rows is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import labels as L
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.operators import links as K
from therascape.operators import pages as P

SALTS = 32


class Chart(NamedTuple):
    """``values``: the names of a row, or a column that ``of`` makes them from, once for equal ones.  ``top`` names are shown and the rest as "Other (k)"; with 0 all are, as for fixed lists.

    ``order`` places names by a list (by name if it is empty), unlisted ones last or, if ``listed``, not at all.  With ``series`` a
    chart ``<name>_by_<by>`` counts the first ``most`` names by it (0: all), each once a row if ``once``; ``grid`` names the chart
    whose names are the series filled with zeros.  ``distinct`` names the summary's entry of how many names there are.
    """

    values: Column
    top: int = 0
    order: list[str] | None = None
    listed: bool = False
    rest: bool = True
    series: Column | None = None
    by: str = ""
    most: int = 0
    once: bool = False
    grid: str = ""
    shown: bool = True
    distinct: str = ""
    of: Callable[[Column], Column] | None = None


def _strings(xs: Column) -> Column:
    return F.coalesce(xs.cast("array<string>"), F.array().cast("array<string>"))


def _by_chart(charts: dict[str, Chart], value, default: Column) -> Column:
    """The value of the row's chart; charts without one have the default."""
    some = [(k, value(c)) for k, c in charts.items() if value(c) is not None]
    return F.coalesce(reduce(lambda out, kv: out.when(F.col("chart") == kv[0], kv[1]), some, F.when(F.lit(False), default)), default) if some else default


def counted(df: DataFrame, charts: dict[str, Chart]) -> DataFrame:
    """(chart, name, count, parts): how often each chart's names are there, and by series how often and in how many rows."""

    def entries(name: str, c: Chart) -> Column:
        column = F.col(f"{name}_0")
        values = _strings(c.of(column) if c.of else column)
        series = F.lit(None).cast("string") if c.series is None else F.col(f"{name}_1").cast("string")
        first = lambda x, i: F.array_position(values, x) == i + 1 if c.once else F.lit(True)
        return F.transform(values, lambda x, i: F.struct(F.lit(name).alias("chart"), x.alias("name"), series.alias("series"), first(x, i).alias("first")))

    rows = P.by_own_columns(df, {k: [c.values] if c.series is None else [c.values, c.series] for k, c in charts.items()})
    none = F.array().cast("array<struct<chart:string,name:string,series:string,first:boolean>>")
    made = reduce(lambda c, kv: c.when(F.col("of") == kv[0], entries(*kv)), charts.items(), F.when(F.lit(False), none))
    every = rows.select(F.explode(made).alias("e"), "n").select("e.*", "n").where("name <> ''")
    by_series = every.groupBy("chart", "name", "series").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("rows"))
    return by_series.groupBy("chart", "name").agg(F.sum("n").alias("count"), F.collect_list(F.struct("series", "n", "rows")).alias("parts"))


def page(df: DataFrame, charts: dict[str, Chart], rates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(chart, place, name, series, count, is_other): all charts of a page; chart ``summary`` holds its cards.

    ``rates`` maps a card to (name of the chart, series): the percentage of that chart's count, rounded half up, that is in the series.
    """
    kept = _by_chart(charts, lambda c: F.lit(max(c.top, c.most)) if c.top else None, F.lit(0))
    top = _by_chart(charts, lambda c: F.lit(c.top) if c.top else None, F.lit(0))
    listed = lambda c: F.array_position(F.array(*map(F.lit, c.order)), F.col("name")) if c.order else None
    fixed = _by_chart(charts, listed, F.lit(0).cast("long"))
    by_list = [k for k, c in charts.items() if c.order]
    by_name = [k for k, c in charts.items() if c.order == []]
    order = [F.when(F.col("chart").isin(by_name), 0).otherwise(-F.col("count")), F.col("name")]

    # one part of a chart's names keeps its largest and adds up the rest
    rows = counted(df, charts).withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    part = Window.partitionBy("chart", "salt").orderBy(*order)
    rows = rows.withColumn("n", F.row_number().over(part)).withColumn("stays", (kept == 0) | (F.col("n") <= kept))
    own = lambda c: F.when(F.col("stays"), F.col(c))
    few = rows.groupBy("chart", "salt", own("name").alias("name")).agg(F.sum("count").alias("count"), F.count("*").alias("k"), F.first(own("parts"), ignorenulls=True).alias("parts"))

    whole = Window.partitionBy("chart").orderBy(F.col("name").isNull(), *order)
    few = few.withColumn("at", F.row_number().over(whole)).withColumn("other", F.col("name").isNull() | ((top > 0) & (F.col("at") > top)))
    few = few.withColumn("place", F.when(F.col("other"), top + 1).when(F.col("chart").isin(by_list), F.when(fixed > 0, fixed).otherwise(99)).otherwise(F.col("at")).cast("int"))
    hidden = [k for k, c in charts.items() if c.listed]
    few = few.withColumn("unlisted", F.col("chart").isin(hidden) & (F.col("place") == 99))
    # the series of each grid: the few names of one chart, beside every row that the page may show
    for g in sorted({c.grid for c in charts.values() if c.grid}):
        few = few.withColumn(f"grid_{g}", F.array_sort(F.collect_list(F.when((F.col("chart") == g) & ~F.col("unlisted"), F.col("name"))).over(Window.partitionBy())))

    entry = lambda chart, place, name, series, count, k: F.struct(F.lit(chart).alias("chart"), place.cast("int").alias("place"), name.alias("name"), series.alias("series"), count.cast("long").alias("count"), k.cast("long").alias("k"))
    none, no = F.lit(None).cast("string"), F.array().cast("array<struct<chart:string,place:int,name:string,series:string,count:bigint,k:bigint>>")
    cards = [c.distinct for c in charts.values() if c.distinct] + list(rates or {})
    card = lambda name, count: F.array(entry("summary", F.lit(cards.index(name) + 1), F.lit(name), none, count, F.lit(0)))
    made = no
    for name, c in charts.items():
        out = []
        if c.shown:
            shown = ~F.col("unlisted") & (~F.col("other") | F.lit(c.rest))
            out.append(F.when(shown, F.array(entry(name, F.col("place"), F.when(~F.col("other"), F.col("name")), none, F.col("count"), F.col("k")))))
        if c.series is not None and c.by:
            size = lambda p, c=c: p["rows"] if c.once else p["n"]
            parts = F.filter("parts", lambda p: p["series"] != "")
            if c.grid:
                of = F.map_from_entries(F.transform(parts, lambda p: F.struct(p["series"], size(p))))  # noqa: B023
                lines = F.transform(F.col(f"grid_{c.grid}"), lambda s: F.struct(s.alias("series"), F.coalesce(F.try_element_at(of, s), F.lit(0)).alias("size")))  # noqa: B023
            else:
                lines = F.transform(parts, lambda p: F.struct(p["series"].alias("series"), size(p).alias("size")))  # noqa: B023
            many = F.transform(lines, lambda s: entry(f"{name}_by_{c.by}", F.col("place" if not c.most else "at"), F.col("name"), s["series"], s["size"], F.lit(0)))  # noqa: B023
            shown = F.col("name").isNotNull() & ~F.col("unlisted")
            out.append(F.when(shown & (F.col("at") <= c.most) if c.most else shown, many))
        if c.distinct:
            out.append(card(c.distinct, F.col("k")))
        for label, (chart, series) in (rates or {}).items():
            if chart == name:
                held = F.aggregate(F.filter("parts", lambda p: p["series"] == series), F.lit(0).cast("long"), lambda s, p: s + p["n"])  # noqa: B023
                out.append(card(label, F.floor(held * 100.0 / F.col("count") + 0.5)))
        made = F.when(F.col("chart") == name, F.concat(*[F.coalesce(x, no) for x in out])).otherwise(made) if out else made
    entries = few.select(F.explode(made).alias("e")).select("e.*")
    sums = entries.groupBy("chart", "place", "name", "series").agg(F.sum("count").alias("count"), F.sum("k").alias("k"))
    named = F.coalesce("name", F.concat(F.lit("Other ("), F.col("k").cast("string"), F.lit(")")))
    return sums.select("chart", "place", named.alias("name"), "series", "count", F.col("name").isNull().alias("is_other"))


def _one(value: Column) -> Column:
    return F.array(value)


def program_page(programs: DataFrame, top: int = 10, biomarkers: int = 5) -> DataFrame:
    """QRY-01 to QRY-06's counts: companies, drugs, cancers, targets, phases by status, statuses, modalities, biomarkers and cards of programs.

    Phases stand by each status that any program has, zeros filled; statuses that the page does not know are left out of its charts.
    """
    status = F.coalesce(F.nullif("overall_status", F.lit("")), F.lit("UNKNOWN"))
    statuses = list(L.STATUS_LABELS)
    charts = {
        "company": Chart(F.col("company_normalized"), top, of=_one),
        "drug": Chart(X.known(F.col("drug_name")), top, of=_one),
        "cancer": Chart(X.known(F.col("cancer_category")), top, of=_one),
        "target": Chart(X.known(F.col("target")), top, of=_one),
        "phase": Chart(F.col("phases"), of=P.phase_options, order=L.PHASE_ORDER, series=status, by="status", grid="status"),
        "status": Chart(status, order=statuses, listed=True, of=_one),
        "modality": Chart(X.known(F.col("modality")), of=_one),
        "biomarker": Chart(F.col("biomarkers"), biomarkers, rest=False),
        "total": Chart(_one(F.lit("programs")), series=F.when(F.size("biomarkers") > 0, "mentioned").otherwise("not mentioned"), by="biomarker"),
        "sponsors": Chart(F.col("company"), 1, shown=False, distinct="companies", of=_one),
        "cancers": Chart(F.col("cancer_category"), 1, shown=False, distinct="cancers", of=_one),
    }
    return page(programs, charts, {"biomarker_pct": ("total", "mentioned")})


def _literature_charts(top: int, trends: int) -> dict[str, Chart]:
    year = F.col("year").cast("string")
    trend = {"series": year, "by": "year", "most": trends, "once": True, "grid": "year"}
    return {
        "year": Chart(year, order=[], of=_one),
        "modality": Chart(F.col("modality_list"), top, **trend),
        "target": Chart(F.col("target_list"), top, of=lambda ts: F.array_remove(_strings(ts), "Unknown"), **trend),
        "biomarker": Chart(F.col("biomarker_list"), top, **trend),
        "cancer": Chart(F.col("cancer_list"), top, distinct="cancers", **trend),
        "company": Chart(F.col("companies_normalized"), top, distinct="companies"),
        "institution": Chart(F.col("affiliation"), top, of=lambda c: _one(N.institution(c))),
        "country": Chart(F.col("country_raw"), top, of=lambda c: _one(N.country(c))),
        "total": Chart(_one(F.lit("records")), series=F.when(F.size("modality_list") > 0, "therapeutic")),
        "dataset": Chart(_one(F.when(F.col("conference") != "", F.concat_ws(" ", "conference", year))), 1, shown=False, distinct="datasets"),
    }


def conference_page(literature: DataFrame, top: int = 10, trends: int = 6) -> DataFrame:
    """QRY-07, QRY-08: distributions, trends of the ``trends`` largest names, years by conference, their totals and cards of conference records."""
    charts = _literature_charts(top, trends) | {
        "conference": Chart(_one(F.col("conference")), order=[], series=F.col("year").cast("string"), by="year"),
        "phase": Chart(F.col("phases"), of=P.phase_options, order=L.PHASE_ORDER),
    }
    return page(literature, charts, {"therapeutic_pct": ("total", "therapeutic")})


def publication_page(publications: DataFrame, top: int = 10, trends: int = 6) -> DataFrame:
    """QRY-09: as the conference page, with journals and kinds of publication in place of conferences and phases, and one series of years."""
    charts = _literature_charts(top, trends) | {"journal": Chart(F.col("journal"), top, of=_one), "publication_type": Chart(F.col("presentation_type"), top, of=_one)}
    return page(publications, charts, {"therapeutic_pct": ("total", "therapeutic")})


def landing_page(programs: DataFrame, literature: DataFrame, known: DataFrame, since: str, most: dict[str, int] | None = None, chips: int = 18, listed: int = 25) -> DataFrame:
    """QRY-16: (part, place, name, detail, count): numbers of sources, facets, counts of the news, emerging targets, newest trials and new publications.

    ``programs`` have first_post and last_update; ``known`` holds the uid of the publications of the last snapshot.  ``most`` bounds
    the facets that are ranked, as ``chips`` and ``listed`` bound the lists: features of the page.  An emerging target's detail is
    how often it is in this week's news, its count that in all sources.
    """
    most = most or {"targets": 300, "biomarkers": 300, "companies": 500}
    known_target = lambda t: F.coalesce(N.target(t), F.lit("Unknown"))
    cancers = F.when(F.size("cancer_categories") > 0, F.col("cancer_categories")).otherwise(F.array("cancer_category"))
    of_programs = {"kind": F.lit("drugs"), "cancers": cancers, "modalities": _one(F.col("modality")), "targets": _one(F.col("target")), "biomarkers": F.col("biomarkers"), "companies": _one(F.col("company_normalized"))}
    of_records = {"kind": F.when(F.col("is_pub"), "publications").otherwise("abstracts"), "cancers": F.col("cancer_list"), "modalities": F.col("modality_list"), "targets": F.col("target_list"), "biomarkers": F.col("biomarker_list"), "companies": F.col("companies_normalized")}
    both = programs.select(*[v.alias(k) for k, v in of_programs.items()]).union(literature.select(*[v.alias(k) for k, v in of_records.items()]))
    charts = {
        "kind": Chart(F.col("kind"), of=_one),
        "cancers": Chart(F.col("cancers"), order=[]),
        "modalities": Chart(F.col("modalities"), order=[]),
        "targets": Chart(F.col("targets"), most["targets"], rest=False, distinct="targets", of=lambda ts: F.array_remove(F.transform(ts, known_target), "Unknown")),
        "biomarkers": Chart(F.col("biomarkers"), most["biomarkers"], rest=False, distinct="biomarkers", of=N.biomarkers),
        "companies": Chart(F.col("companies"), most["companies"], rest=False, distinct="companies"),
    }
    none = F.lit(None).cast("string")
    facets = page(both, charts)
    stats = F.when(F.col("chart").isin("kind", "summary"), "stats").otherwise(F.concat(F.lit("facet_"), F.col("chart")))
    facets = facets.select(stats.alias("part"), F.when(~F.col("chart").isin("kind", "summary"), F.col("place")).alias("place"), "name", none.alias("detail"), "count")

    first, last = F.coalesce("first_post", F.lit("")), F.coalesce("last_update", F.lit(""))
    kind = F.when(first >= since, "new_trials").when(last >= since, "updated_trials")
    date = F.coalesce(F.nullif("first_post", F.lit("")), F.col("last_update"))
    target = known_target(F.col("target"))
    detail = F.concat_ws(" · ", F.coalesce("drug_name", F.lit("—")), F.when(target != "Unknown", target), F.when(F.col("phase") != "", L.phase_label(F.col("phase"))), F.nullif("company_normalized", F.lit("")))
    trials = programs.select(kind.alias("part"), F.get("nct_ids", F.lit(0)).alias("name"), detail.alias("detail"), date.alias("date"), target.alias("target")).where("part is not null")
    fresh = K.missing_from(literature.where("is_pub"), known, "uid")
    papers = fresh.select(F.lit("new_publications").alias("part"), "uid", F.coalesce(F.nullif("title", F.lit("")), F.col("uid")).alias("name"), F.col("journal").alias("detail"), "target_list")

    # programs by target, of all and of each list of the news: read once for the numbers of the news and the emerging targets
    in_list = lambda k: F.count_if(F.coalesce(kind == k, F.lit(False))).alias(k)
    by_target = programs.groupBy(F.col("target").alias("raw")).agg(F.count("*").alias("all"), in_list("new_trials"), in_list("updated_trials"))
    tally = by_target.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(k).alias("n")) for k in ("new_trials", "updated_trials")])).alias("t")).select("t.*").where("n > 0")
    tallies = tally.groupBy("part").agg(F.sum("n").alias("n")).union(papers.groupBy("part").agg(F.count("*").alias("n")))
    counts = tallies.select(F.lit("news").alias("part"), F.lit(None).cast("int").alias("place"), F.col("part").alias("name"), none.alias("detail"), F.col("n").alias("count"))
    salted = lambda df, *key: df.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)))
    line = lambda df: df.select("part", F.col("rank").cast("int").alias("place"), "name", "detail", F.lit(None).cast("long").alias("count"))
    newest = K.cut_to(salted(trials.where("part = 'new_trials'"), "name", "detail"), "part", [F.desc("date"), F.asc("name"), F.asc("detail")], listed)
    new_papers = K.cut_to(salted(papers, "uid"), "part", [F.asc("uid")], listed)

    in_week, zero = F.col("new_trials") + F.col("updated_trials"), F.lit(0).cast("long")
    of_lists = lambda df: df.select(F.explode("target_list").alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    seen = by_target.select("raw", in_week.alias("this_week"), F.col("all").alias("corpus_total")).union(of_lists(papers).select("raw", "n", zero)).union(of_lists(literature).select("raw", zero, "n"))
    lead = K.emerging_of_counts(seen.select(known_target(F.col("raw")).alias("target"), "this_week", "corpus_total"), chips)
    place = F.row_number().over(Window.orderBy("corpus_total", F.desc("this_week"), "target"))  # of as many rows as there are chips
    emerging = lead.select(F.lit("emerging_targets").alias("part"), place.cast("int").alias("place"), F.col("target").alias("name"), F.col("this_week").cast("string").alias("detail"), F.col("corpus_total").alias("count"))
    return reduce(DataFrame.unionByName, [facets, counts, line(newest), line(new_papers), emerging])
