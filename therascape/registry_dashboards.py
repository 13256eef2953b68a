"""Queries of whole pages, one result each, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import labels as L
from therascape.operators import dashboards as B
from therascape.registry_pages import _CANCERS, _PHASES, _l, _p, _posted, _wide

_PHASE_AT = "coalesce(list_position([" + ", ".join(f"'{p}'" for p in L.PHASE_ORDER) + "], name), 99)"
_STATUSES = "[" + ", ".join(f"'{s}'" for s in L.STATUS_LABELS) + "]"
_ROW = "CAST({} AS INTEGER) AS place, {} AS name, {} AS series, CAST({} AS BIGINT) AS \"count\", {} AS is_other".format


def _tops_sql(charts: dict[str, tuple[str, int]], table: str) -> str:
    """CTE r: each chart's names with count and rank, and the rows of those with a top and their rest."""
    every = "\nUNION ALL ".join(f"SELECT '{c}' AS chart, {n} AS cut, unnest({v}) AS name FROM {table}" for c, (v, n) in charts.items())
    return f""", e AS ({every}),
r AS (SELECT chart, cut, name, count(*) AS c, row_number() OVER (PARTITION BY chart ORDER BY count(*) DESC, name) AS rn FROM e WHERE name <> '' GROUP BY chart, cut, name),
tops AS (SELECT chart, {_ROW("rn", "name", "CAST(NULL AS VARCHAR)", "c", "false")} FROM r WHERE rn <= cut OR cut = 0
  UNION ALL SELECT chart, {_ROW("cut + 1", "'Other (' || count(*) || ')'", "NULL", "sum(c)", "true")} FROM r WHERE rn > cut AND cut > 0 GROUP BY chart, cut)"""


def _cards_sql(cards: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT 'summary' AS chart, {_ROW(k, f"'{name}'", 'NULL', f'({sql})', 'false')}" for k, (name, sql) in enumerate(cards.items(), 1))


_PROGRAM_TOPS = {"company": ("[company_normalized]", 10), "drug": ("[drug_name]", 10), "cancer": ("[cancer_category]", 10), "target": ("[target]", 10), "modality": ("[modality]", 0)}
_wide(
    "qry_02_program_page",
    _tops_sql(_PROGRAM_TOPS, "pw")
    + f""", ph AS (SELECT unnest({_PHASES}) AS name, overall_status AS s FROM pw), st AS (SELECT DISTINCT overall_status AS s FROM pw WHERE list_contains({_STATUSES}, overall_status)),
bm AS (SELECT unnest(biomarkers) AS name FROM pw)
SELECT * FROM tops
UNION ALL SELECT 'phase', {_ROW(_PHASE_AT, "name", "NULL", "count(*)", "false")} FROM ph GROUP BY name
UNION ALL SELECT 'phase_by_status', {_ROW(_PHASE_AT, "name", "st.s", "n", "false")} FROM (SELECT q.name, st.s, count(ph.s) AS n FROM (SELECT DISTINCT name FROM ph) q CROSS JOIN st LEFT JOIN ph ON ph.name = q.name AND ph.s = st.s GROUP BY 1, 2) st
UNION ALL SELECT 'status', {_ROW(f"list_position({_STATUSES}, overall_status)", "overall_status", "NULL", "count(*)", "false")} FROM pw WHERE list_contains({_STATUSES}, overall_status) GROUP BY overall_status
UNION ALL SELECT 'biomarker', {_ROW("row_number() OVER (ORDER BY count(*) DESC, name)", "name", "NULL", "count(*)", "false")} FROM bm GROUP BY name QUALIFY row_number() OVER (ORDER BY count(*) DESC, name) <= 5
UNION ALL SELECT 'total', {_ROW(1, "'programs'", "NULL", "count(*)", "false")} FROM pw
UNION ALL SELECT 'total_by_biomarker', {_ROW(1, "'programs'", "m", "count(*)", "false")} FROM (SELECT CASE WHEN len(biomarkers) > 0 THEN 'mentioned' ELSE 'not mentioned' END AS m FROM pw) GROUP BY m
UNION ALL """
    + _cards_sql(
        {
            "companies": "SELECT count(DISTINCT company) FROM pw",
            "cancers": "SELECT count(DISTINCT cancer_category) FROM pw",
            "biomarker_pct": "SELECT floor(count(*) FILTER (len(biomarkers) > 0) * 100.0 / count(*) + 0.5) FROM pw",
        }
    ),
)(lambda spark, d: B.program_page(_p(spark, d)))


def _literature_page_sql(table: str, more: dict[str, tuple[str, int]], top: int, trends: int) -> str:
    lists = {"modality": "modality_list", "target": "list_filter(target_list, lambda t: t <> 'Unknown')", "biomarker": "biomarker_list", "cancer": "cancer_list"}
    charts = {k: (v, top) for k, v in lists.items()} | {"company": ("companies_normalized", top), "institution": ("[affiliation]", top), "country": ("[country]", top)} | more
    once = "\nUNION ALL ".join(f"SELECT '{c}' AS chart, \"year\" AS y, unnest(list_distinct({v})) AS name FROM {table}" for c, v in lists.items())
    cards = {
        "cancers": f"SELECT count(DISTINCT name) FROM (SELECT unnest(cancer_list) AS name FROM {table})",
        "companies": f"SELECT count(DISTINCT name) FROM (SELECT unnest(companies_normalized) AS name FROM {table})",
        "datasets": f"SELECT count(DISTINCT conference || ' ' || \"year\") FROM {table}",
        "therapeutic_pct": f"SELECT floor(count(*) FILTER (len(modality_list) > 0) * 100.0 / count(*) + 0.5) FROM {table}",
    }
    return (
        _tops_sql(charts, table)
        + f""", o AS (SELECT chart, y, name, count(*) AS c FROM ({once}) GROUP BY ALL), ys AS (SELECT DISTINCT "year" AS y FROM {table})
SELECT * FROM tops
UNION ALL SELECT r.chart || '_by_year', {_ROW("rn", "r.name", "CAST(ys.y AS VARCHAR)", "coalesce(o.c, 0)", "false")} FROM r CROSS JOIN ys LEFT JOIN o ON o.chart = r.chart AND o.name = r.name AND o.y = ys.y WHERE rn <= {trends} AND r.chart IN ('modality', 'target', 'biomarker', 'cancer')
UNION ALL SELECT 'year', {_ROW('row_number() OVER (ORDER BY "year")', 'CAST("year" AS VARCHAR)', "NULL", "count(*)", "false")} FROM {table} GROUP BY "year"
UNION ALL SELECT 'total', {_ROW(1, "'records'", "NULL", "count(*)", "false")} FROM {table}
UNION ALL """
        + _cards_sql(cards)
    )


_wide(
    "qry_08_conference_page",
    _literature_page_sql("lc", {}, 5, 6)
    + f"""
UNION ALL SELECT 'conference', {_ROW("row_number() OVER (ORDER BY conference)", "conference", "NULL", "count(*)", "false")} FROM lc GROUP BY conference
UNION ALL SELECT 'conference_by_year', {_ROW("dense_rank() OVER (ORDER BY conference)", "conference", 'CAST("year" AS VARCHAR)', "count(*)", "false")} FROM lc GROUP BY conference, "year"
UNION ALL SELECT 'phase', {_ROW(_PHASE_AT, "name", "NULL", "count(*)", "false")} FROM (SELECT unnest({_PHASES}) AS name FROM lc) GROUP BY name""",
)(lambda spark, d: B.conference_page(_l(spark, d), 5))
_wide(
    "qry_09_publication_page",
    ", pc AS (SELECT * FROM lc WHERE is_pub)" + _literature_page_sql("pc", {"journal": ("[journal]", 10), "publication_type": ("[presentation_type]", 10)}, 10, 6),
)(lambda spark, d: B.publication_page(_l(spark, d).where("is_pub")))

_SINCE = "1998-06-01"
_MOST = {"targets": 20, "biomarkers": 5, "companies": 12}
_FACETS = {
    "cancers": (_CANCERS, "cancer_list"),
    "modalities": ("[modality]", "modality_list"),
    "targets": ("[nullif(target, 'Unknown')]", "target_list"),
    "biomarkers": ("biomarkers", "biomarker_list"),
    "companies": ("[company_normalized]", "companies_normalized"),
}
_FACET_ROWS = "\nUNION ALL ".join(f"SELECT '{a}' AS axis, unnest({p}) AS name FROM pw UNION ALL SELECT '{a}', unnest({q}) FROM lw" for a, (p, q) in _FACETS.items())
_LABELLED = "array_to_string(list_transform(string_split(phase, '/'), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.PHASE_LABELS.items()) + " ELSE x END), '/')"


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot: publications whose number's last digit is not 0 or 5."""
    return _l(spark, d).where("is_pub and right(uid, 1) not in ('0', '5')").select("uid")


_wide(
    "qry_16_landing_page",
    f""", a AS ({_FACET_ROWS}), f AS (SELECT axis, name, count(*) AS c FROM a WHERE name <> '' GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY CASE WHEN axis IN ('cancers', 'modalities') THEN 0 ELSE -c END, name) AS rn FROM f),
t AS (SELECT CASE WHEN start_date >= '{_SINCE}' THEN 'new_trials' WHEN completion_date >= '{_SINCE}' THEN 'updated_trials' END AS part, nct_id AS name, start_date AS date, target,
  concat_ws(' · ', drug_name, nullif(target, 'Unknown'), {_LABELLED}, company_normalized) AS detail FROM pw),
n AS (SELECT uid, coalesce(nullif(title, ''), uid) AS name, journal, target_list FROM lw WHERE is_pub AND right(uid, 1) IN ('0', '5')),
w AS (SELECT target, count(*) AS k FROM (SELECT target FROM t WHERE part IS NOT NULL UNION ALL SELECT unnest(target_list) FROM n) WHERE target <> 'Unknown' GROUP BY 1),
u AS (SELECT w.target, w.k, c, row_number() OVER (ORDER BY c, w.k DESC, w.target) AS rn FROM w JOIN f ON axis = 'targets' AND f.name = w.target)
SELECT 'stats' AS part, CAST(NULL AS INTEGER) AS place, 'drugs' AS name, CAST(NULL AS VARCHAR) AS detail, count(*) AS "count" FROM pw
UNION ALL SELECT 'stats', NULL, CASE WHEN is_pub THEN 'publications' ELSE 'abstracts' END, NULL, count(*) FROM lw GROUP BY is_pub
UNION ALL SELECT 'stats', NULL, axis, NULL, count(*) FROM f WHERE axis IN ('targets', 'biomarkers', 'companies') GROUP BY axis
UNION ALL SELECT 'facet_' || axis, CAST(rn AS INTEGER), name, NULL, c FROM fr WHERE rn <= CASE axis WHEN 'targets' THEN 20 WHEN 'biomarkers' THEN 5 WHEN 'companies' THEN 12 ELSE rn END
UNION ALL SELECT 'news', NULL, part, NULL, count(*) FROM t WHERE part IS NOT NULL GROUP BY part
UNION ALL SELECT 'news', NULL, 'new_publications', NULL, count(*) FROM n HAVING count(*) > 0
UNION ALL (SELECT 'new_trials', CAST(row_number() OVER (ORDER BY date DESC, name, detail) AS INTEGER) AS rn, name, detail, NULL FROM t WHERE part = 'new_trials' QUALIFY rn <= 25)
UNION ALL (SELECT 'new_publications', CAST(row_number() OVER (ORDER BY uid) AS INTEGER) AS rn, name, journal, NULL FROM n QUALIFY rn <= 25)
UNION ALL SELECT 'emerging_targets', CAST(rn AS INTEGER), target, CAST(k AS VARCHAR), c FROM u WHERE rn <= 18""",
)(lambda spark, d: B.landing_page(_posted(spark, d), _l(spark, d), _known(spark, d), _SINCE, _MOST))
