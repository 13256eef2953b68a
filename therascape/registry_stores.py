"""Queries over sources, stores and streams: conference books, pages of works, keyed tables, windows of arriving events, partitioned scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from therascape.functions import vocabulary as V
from therascape.operators import links as K
from therascape.operators import merges as M
from therascape.operators import offline as O
from therascape.operators.filters import LiteratureFilter
from therascape.plans.bridge import programs
from therascape.plans.book import BOXES_SQL, boxes
from therascape.plans.wide import wide_literature, wide_programs
from therascape.registry import _CDX_NAMED, _has_sql, query
from therascape.registry_pages import _wide
from therascape.sources import books as B
from therascape.sources import scan as C
from therascape.sources import store as S
from therascape.sources import work_pages as P
from therascape.sources.keyed import KeyedStore
from therascape.streaming import increments as I

#: White space as in the Spark side's patterns.
_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _cut_at(x: str, pattern: str) -> str:
    """Characters before the first match, null without one."""
    return f"CASE WHEN {_has(x, pattern)} THEN length(regexp_extract({x}, {_q('(?s)^(.*?)(?:' + pattern + ')')}, 1)) END"


def _joined(x: str) -> str:
    gone = f"regexp_replace({x}, '-\\n\\s*', '', 'g')"
    return _strip(f"regexp_replace({gone}, '{_WS}+', ' ', 'g')")


_SESSION_AT = B.SESSION.replace("(?i)", "(?i)")
_NO_TITLE = " OR ".join(_has("b", p) for p in (B.FOOTER, B.PAGE_NUMBER, B.NUMBER, B.TRACK)) + " OR b = ''"
_SPONSOR_SQL = "regexp_extract(regexp_replace(txt, '(?s)^.*?Research Sponsor:\\s*', ''), '(?s)^(.+?)(?:\\n\\n|Clinical trial information:|\\n?$)', 1)"
BLOCKS_SQL = f"""{BOXES_SQL},
stream AS (SELECT book, place, {_strip('text')} AS x FROM boxes WHERE {_strip('text')} <> ''),
near AS (SELECT *, lead(x) OVER w AS following, {', '.join(f'lag(x, {k}) OVER w AS x{k}' for k in range(1, B.BEFORE + 1))} FROM stream WINDOW w AS (PARTITION BY book ORDER BY place)),
opened AS (SELECT *, {_has('x', B.NUMBER)} AND coalesce({_has('following', B.SESSION)}, false) AS opens,
           CASE {' '.join(f"WHEN {_has(f'x{k}', B.TRACK)} AND NOT {_has(f'x{k}', B.NUMBER)} THEN x{k}" for k in range(1, B.BEFORE + 1))} END AS near_track FROM near),
told AS (SELECT *, max(CASE WHEN opens THEN place END) OVER w AS start, last_value(CASE WHEN opens THEN near_track END IGNORE NULLS) OVER w AS track
         FROM opened WINDOW w AS (PARTITION BY book ORDER BY place)),
starts AS (SELECT book, place AS start, x AS abstract_id, regexp_extract(following, {_q(B.SESSION)}, 1) AS session, track FROM told WHERE opens
           QUALIFY row_number() OVER (PARTITION BY book, x ORDER BY place) = 1),
blocks AS (SELECT s.book, s.start, s.abstract_id, s.session, s.track, list(t.x ORDER BY t.place) AS block
           FROM starts s JOIN told t ON t.book = s.book AND t.start = s.start AND t.place > s.start GROUP BY ALL)"""


@query(
    "win_05_book_blocks",
    f"""WITH {BLOCKS_SQL}
SELECT book, start, abstract_id, session, track, CAST(len(block) AS INTEGER) AS n_boxes, md5(array_to_string(block, '|')) AS boxes_md5 FROM blocks""",
    raw=True,
)
def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05 to WIN-07: the abstracts of a book, its track in force and its boxes."""
    out = B.blocks(boxes(spark, d))
    return out.select("book", "start", "abstract_id", "session", "track", F.size("block").alias("n_boxes"), F.md5(F.array_join("block", "|")).alias("boxes_md5"))


@query(
    "prj_02_book_abstracts",
    f"""WITH {BLOCKS_SQL},
plain AS (SELECT *, list_filter(list_transform(block, lambda b: {_strip(f"regexp_replace(b, {_q(B.SESSION)}, '')")}), lambda b: NOT ({_NO_TITLE}))[1] AS chosen,
          regexp_replace(array_to_string(list_filter(block, lambda b: NOT {_has('b', B.FOOTER)}), chr(10)), '-\\n\\s*', '', 'g') AS txt FROM blocks),
rest AS (SELECT *, coalesce(substr(txt, {_cut_at('txt', B.FIRST_AUTHOR)} + 1 + length(regexp_extract(txt, {_q(B.FIRST_AUTHOR)}))), '') AS after, {_has('txt', B.EMBARGO)} AS held FROM plain),
parts AS (SELECT *, left(after, coalesce(CASE WHEN held THEN {_cut_at('after', B.EMBARGO)} ELSE {_cut_at('after', B.BODY)} END, {B.AUTHORS_AT_MOST})) AS who,
          CASE WHEN held THEN '' ELSE coalesce(substr(after, {_cut_at('after', B.BODY)} + 1), '') END AS body FROM rest),
done AS (SELECT *, {_strip(f"regexp_replace(left(body, least(coalesce({_cut_at('body', 'Research Sponsor:[^a-z0-9A-Z]*')}, length(body)), coalesce({_cut_at('body', B.TRIAL)}, length(body)))), '{_WS}+', ' ', 'g')")} AS b FROM parts),
last AS (SELECT *, NOT held AND (length(b) >= {B.LEAST_BODY} OR {_has('b', B.BODY)}) AS told FROM done)
SELECT 'asco-2026-' || lower(abstract_id) AS uid, book, abstract_id, starts_with(abstract_id, 'LBA') AS is_lba, CASE WHEN told THEN 'available' ELSE 'embargoed' END AS status,
       session AS presentation_type, track, coalesce(rtrim({_joined(f"left(chosen, coalesce({_cut_at('chosen', B.FIRST_AUTHOR)}, length(chosen)))")}, '. '), '') AS title,
       {_joined('who')} AS author_raw, CASE WHEN told THEN b END AS abstract_text, nullif({_joined(f"CASE WHEN contains(txt, 'Research Sponsor:') THEN {_SPONSOR_SQL} ELSE '' END")}, '') AS research_sponsor,
       told AS keyword_parsed, CASE WHEN told THEN 'dictionary_v1' ELSE 'embargoed' END AS enrichment_status
FROM last""",
    raw=True,
)
def _book_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-02, SCL-S17: identity, title, authors and body of each abstract of the books."""
    return B.abstract_fields(B.blocks(boxes(spark, d))).drop("conference", "year", "__all")


#: Works of a page, and windows, of the landed pages made of the documents.
_PAGE, _WINDOWS = 50, 12
_WORKS_SQL = f"""SELECT doc_id % {_WINDOWS} AS win, doc_id // {_WINDOWS} // {_PAGE} AS page, doc_id // {_WINDOWS} % {_PAGE} AS j,
  concat('10.1200/JCO.2025.43.16_suppl.', CAST(CASE WHEN doc_id % 30 = 0 THEN doc_id - {_WINDOWS} ELSE doc_id END AS VARCHAR(19))) AS doi, text
  FROM documents WHERE NOT (doc_id % {_WINDOWS} = 3 AND doc_id % 997 = 5)"""


def _landed(spark: SparkSession, d: str) -> str:
    """Answers of the register, made of the documents: every third page came cut off at first, one window has a page that is short."""
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("landed_documents")
    works = spark.sql(_WORKS_SQL.replace("FROM documents", "FROM landed_documents").replace("//", "DIV"))
    work = F.struct("j", F.struct(F.col("doi").alias("DOI"), F.array(F.substring_index("text", "\n", 1)).alias("title"), F.col("text").alias("abstract")).alias("w"))
    pages = works.groupBy("win", "page").agg(F.transform(F.array_sort(F.collect_list(work)), lambda x: x["w"]).alias("items"))
    body = F.to_json(F.struct(F.struct("items", F.concat(F.lit("c"), F.col("page") + 1).alias("next-cursor")).alias("message")))
    cut = F.struct(F.lit(1).alias("attempt"), F.left(F.col("body"), F.lit(100)).alias("body"))
    whole = F.struct(F.lit(2).alias("attempt"), F.col("body").alias("body"))
    answers = pages.withColumn("body", body).withColumn("a", F.explode(F.when(F.col("page") % 3 == 1, F.array(cut, whole)).otherwise(F.array(whole))))
    first = F.make_date(F.lit(2025), (F.col("win") + 1).cast("int"), F.lit(1))
    path = S.new_folder(spark, "pages")
    P.land_pages(answers.select(first.alias("window_from"), F.last_day(first).alias("window_until"), F.when(F.col("page") == 0, "*").otherwise(F.concat(F.lit("c"), "page")).alias("cursor"), "a.*", "win", "page").repartition("win").sortWithinPartitions("win", "page").drop("win", "page"), path)
    return path


@query(
    "src_06_work_pages",
    f"""WITH RECURSIVE w AS ({_WORKS_SQL}),
n AS (SELECT win, page, count(*) AS n FROM w GROUP BY ALL),
reached AS (SELECT win, page, n FROM n WHERE page = 0 UNION ALL SELECT n.win, n.page, n.n FROM reached r JOIN n ON n.win = r.win AND n.page = r.page + 1 AND r.n >= {_PAGE}),
placed AS (SELECT w.*, row_number() OVER (PARTITION BY w.win, w.page ORDER BY w.j) - 1 AS place FROM w JOIN reached USING (win, page))
SELECT doi AS "DOI", make_date(2025, CAST(win + 1 AS INTEGER), 1) AS window_from, CAST(page AS INTEGER) AS page, CAST(place AS INTEGER) AS place, md5(text) AS text_md5
FROM placed QUALIFY row_number() OVER (PARTITION BY doi ORDER BY win, page, place) = 1""",
    raw=True,
)
def _work_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, SRC-08: works of the landed pages, cursor by cursor; of a DOI the first one."""
    works = P.works_of(P.read_work_pages(spark, _landed(spark, d), _PAGE), "DOI STRING, abstract STRING")
    return P.first_seen(works, "DOI").select("DOI", "window_from", "page", "place", F.md5("abstract").alias("text_md5"))


@query(
    "str_04_keyed_store",
    """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    raw=True,
)
def _keyed_store(spark: SparkSession, d: str) -> DataFrame:
    """STR-04, SNK-02: each customer's last order, from batches of orders put into a store; one batch comes twice."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    status = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    store = KeyedStore(spark, S.new_folder(spark, "orders"), ["o_custkey"], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema), ["o_orderdate", "o_orderkey"])
    done = F.col("o_orderstatus").isin("O", "P")
    for batch in (done, ~F.coalesce(done, F.lit(False)), done):
        store.upsert(orders.join(status.where(batch).select("o_orderkey"), "o_orderkey", "left_semi"))
    return store.read()


@query(
    "str_02_stream_windows",
    "SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL",
    raw=True,
)
def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """STR-02: events by day and type, counted by a stream over arriving files and kept in a store."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    inbox, check = S.new_folder(spark, "events"), S.new_folder(spark, "check")
    I.landed_in_order(events, inbox)
    store = KeyedStore(spark, S.new_folder(spark, "windows"), ["start", "event_type"], "start timestamp, event_type string, n long", ["n"])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(inbox)
    I.windows_to_store(stream, store, check).awaitTermination()
    return store.read().select(F.to_date("start").alias("day"), "event_type", "n")


_DICTIONARY = [("bm1", "BM one", False), ("bm3", None, True), ("bm0", "Zero", False), ("bm5", "ZERO", False)]


def _cleaned_sql(rows: str) -> str:
    return f"""{rows},
i AS (SELECT uid, unnest(biomarker_list) AS b, generate_subscripts(biomarker_list, 1) AS pos FROM chosen),
m AS (SELECT uid, pos, CASE b WHEN 'BM1' THEN 'BM one' WHEN 'BM0' THEN 'Zero' WHEN 'BM5' THEN 'ZERO' ELSE b END AS b FROM i WHERE b <> 'BM3'),
o AS (SELECT uid, b, pos FROM m QUALIFY row_number() OVER (PARTITION BY uid, lower(b) ORDER BY pos) = 1)
SELECT c.uid, c.conference, c."year", coalesce((SELECT string_agg(b, '|' ORDER BY pos) FROM o WHERE o.uid = c.uid), '') AS biomarkers FROM chosen c"""


def _scanned(name: str, where: str, f: LiteratureFilter) -> None:
    @_wide(name, _cleaned_sql(f", chosen AS (SELECT * FROM lw WHERE coalesce(status, '') <> 'embargoed' AND {where})"))
    def _(spark: SparkSession, d: str) -> DataFrame:
        path = S.new_folder(spark, "literature")
        C.write_literature(wide_literature(spark, d).select("uid", "conference", "year", "status", "cancer_category", "cancer_list", "biomarker_list"), path)
        known = spark.createDataFrame(_DICTIONARY, "name string, canon string, blocked boolean")
        return C.read_literature(spark, path, f, known).select("uid", "conference", "year", F.array_join("biomarker_list", "|").alias("biomarkers"))


_scanned("src_12_newest_year", '"year" = (SELECT max("year") FROM lw)', LiteratureFilter())
_scanned("src_12_chosen_partitions", "\"year\" IN (2019, 2022) AND conference IN ('src1', 'src2', 'src7')", LiteratureFilter(conferences=["src1", "src2", "src7"], years=[2019, 2022]))
_scanned("flt_37_searched_years", "list_contains(cancer_list, 'en') AND conference = 'src3'", LiteratureFilter(conferences=["src3"], cancers=["en"]))


@query(
    "nrm_08_clean_lists",
    f"""WITH bw AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS name FROM benchmark),
dict AS (SELECT name, CASE WHEN length(name) > 5 THEN upper(replace(left(name, 4), 'ß', 'SS')) END AS canon, length(name) <= 2 AS blocked FROM bw WHERE name <> ''),
i AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
s AS (SELECT doc_id, pos, {_strip('raw')} AS raw FROM i),
m AS (SELECT doc_id, pos, coalesce(canon, raw) AS shown FROM s LEFT JOIN dict ON lower(raw) = name WHERE raw <> '' AND blocked IS NOT TRUE),
o AS (SELECT doc_id, pos, shown FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, lower(shown) ORDER BY pos) = 1),
l AS (SELECT doc_id, count(*) AS n, md5(string_agg(shown, '|' ORDER BY pos)) AS names_md5 FROM o GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(names_md5, md5('')) AS names_md5 FROM documents LEFT JOIN l USING (doc_id)""",
    raw=True,
)
def _clean_lists(spark: SparkSession, d: str) -> DataFrame:
    """NRM-08: the words of every document as a list of names, cleaned by a dictionary of the benchmark's words."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.split(F.lower("text"), " ")).alias("name")).where("name <> ''").distinct()
    dictionary = words.select("name", F.when(F.char_length("name") > 5, F.upper(F.left("name", F.lit(4)))).alias("canon"), (F.char_length("name") <= 2).alias("blocked"))
    lists = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.split("text", " ").alias("names"))
    out = C.clean_lists(lists, ["doc_id"], "names", dictionary)
    return out.select("doc_id", F.size("names").alias("n"), F.md5(F.array_join("names", "|")).alias("names_md5"))


@_wide(
    "agg_34_trial_postings",
    """, e AS (SELECT DISTINCT unnest(nct_ids) AS nct_id, uid FROM lw) SELECT nct_id, uid, count(*) OVER (PARTITION BY nct_id) AS n, count(*) OVER (PARTITION BY nct_id) <= 5 AS whole FROM e WHERE nct_id <> ''""",
)
def _postings(spark: SparkSession, d: str) -> DataFrame:
    """AGG-34: the index of trials, read back from its postings; lists of more than five are cut."""
    index = K.trial_postings(wide_literature(spark, d), most=5)
    return index.select("nct_id", F.explode("uids").alias("uid"), "n", (F.col("parts") == 1).alias("whole"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Answers on drugs, made of the parts: of each drug some, with targets in several spellings."""
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(
        F.lower("p_name").alias("drug"),
        F.expr("CASE p_size % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN replace(p_brand, '#', ' #') ELSE p_brand END").alias("target"),
        F.expr("CASE WHEN p_size % 4 > 0 THEN p_name END").alias("drug_name"),
        F.expr("CASE WHEN p_size % 5 > 0 THEN p_type END").alias("modality"),
    )


_NAMES_SQL = """, told AS (SELECT lower(p_name) AS drug, CASE p_size % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN replace(p_brand, '#', ' #') ELSE p_brand END AS target,
  CASE WHEN p_size % 4 > 0 THEN p_name END AS drug_name, CASE WHEN p_size % 5 > 0 THEN p_type END AS modality FROM part),
lt AS (SELECT DISTINCT unnest(target_list) AS target FROM lw), nm AS (SELECT target AS name, count(*) AS c FROM (SELECT target FROM pw UNION ALL SELECT target FROM told UNION ALL SELECT target FROM lt) GROUP BY 1),
cn AS (SELECT name, first_value(name) OVER (PARTITION BY regexp_replace(lower(name), '[\\s\\-_/:.*·]+', '', 'g') ORDER BY c DESC, contains(name, '-') DESC, length(name), name DESC) AS canonical FROM nm)"""


@_wide("agg_45_target_canon", _NAMES_SQL + " SELECT raw, canonical FROM (SELECT DISTINCT target AS raw FROM pw UNION SELECT target FROM lt) JOIN cn ON raw = name")
def _target_canon(spark: SparkSession, d: str) -> DataFrame:
    """AGG-45: the canonical name of every spelling of a target."""
    return O.target_canon(wide_programs(spark, d), _told(spark, d), wide_literature(spark, d))


@_wide(
    "agg_45_drug_targets",
    _NAMES_SQL
    + """, t AS (SELECT drug, canonical AS target, coalesce(drug_name, drug) AS shown, coalesce(modality, 'Unknown') AS modality FROM told JOIN cn ON told.target = cn.name)
SELECT drug, target, shown, modality FROM (SELECT *, count(*) AS c FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY drug ORDER BY c DESC, target, shown, modality) = 1""",
)
def _drug_targets(spark: SparkSession, d: str) -> DataFrame:
    """AGG-45: the target, name and modality of every drug that was asked about."""
    return O.drug_targets(wide_programs(spark, d), _told(spark, d), wide_literature(spark, d))


_SAID = "CASE length(drug_name) % 3 WHEN 0 THEN 'HER2 must have been documented' WHEN 1 THEN 'exploratory analysis of KRAS in ' || cancer_category ELSE 'adults' END"
_CDX_FLAGS = """CASE WHEN soon THEN 'phase2_entry_imminent' END, CASE WHEN len(biomarkers) > 0 THEN 'biomarker_relevant' END, CASE WHEN strategy = 'exploratory' THEN 'cdx_strategy_open' END,
CASE WHEN strategy = 'none' THEN 'cdx_strategy_undefined' END, CASE WHEN priority THEN 'priority_indication' END, CASE WHEN NOT is_combination THEN 'no_partner' END, CASE WHEN target = 'Unknown' THEN 'needs_review' END"""


@query(
    "mrg_08_cdx_score_with_strategy",
    f""", r AS (SELECT *, {_SAID} AS raw FROM p),
s AS (SELECT *, CASE WHEN NOT {_CDX_NAMED} THEN 'none' WHEN {_has_sql('lower(raw)', V.CDX_CONFIRMED)} THEN 'confirmed' ELSE 'exploratory' END AS strategy,
  {_has_sql("lower(cancer_category || ' ' || raw)", V.CDX_CONDITIONS)} AS priority, coalesce(date_diff('day', DATE '1996-01-01', CAST(completion_date AS DATE)) BETWEEN 0 AND 180, false) AS soon FROM r),
t AS (SELECT *, CAST(CASE WHEN soon THEN 3 ELSE 0 END + CASE WHEN len(biomarkers) > 0 THEN 2 ELSE 0 END + CASE strategy WHEN 'exploratory' THEN 2 WHEN 'none' THEN 1 ELSE 0 END
  + CASE WHEN priority THEN 2 ELSE 0 END + CASE WHEN is_combination THEN 0 ELSE 1 END AS INTEGER) AS score, array_to_string(list_filter([{_CDX_FLAGS}], lambda x: x IS NOT NULL), ',') AS flags FROM s)
SELECT drug_name, phase, score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS level, flags, count(*) AS n FROM t GROUP BY ALL""",
)
def _cdx_with_strategy(spark: SparkSession, d: str) -> DataFrame:
    """MRG-08 with MRG-09: each program's score and flags, its strategy told by its eligibility text."""
    df = programs(spark, d).withColumn("raw", F.expr(_SAID))
    partners = F.when(F.col("is_combination"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    s = M.cdx_score(F.lit("1996-01-01").cast("date"), F.col("completion_date"), F.size("biomarkers") > 0, M.cdx_strategy(F.col("raw")), F.concat_ws(" ", "cancer_category", "raw"), partners, F.col("target"))
    rows = df.select("drug_name", "phase", s.alias("s")).select("drug_name", "phase", "s.score", "s.level", F.array_join("s.flags", ",").alias("flags"))
    return rows.groupBy("drug_name", "phase", "score", "level", "flags").agg(F.count("*").alias("n"))


@query(
    "j_21_rekeyed_cache",
    """SELECT left(sha1(p_name || '|' || p_partkey), 16) AS key, p_retailprice AS price FROM part WHERE p_size % 7 <> 0 UNION ALL SELECT 'lost-' || s_suppkey, s_acctbal FROM supplier""",
    raw=True,
)
def _rekeyed(spark: SparkSession, d: str) -> DataFrame:
    """J-21: a cache of prices under old and new keys of the parts, and of suppliers that no part knows, brought to the new keys."""
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("old", F.concat(F.lit("u"), F.col("p_partkey").cast("string")))
    new = F.left(F.sha1(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")).cast("binary")), F.lit(16))
    cache = part.where("p_size % 7 <> 0").select(F.when(F.col("p_size") % 3 == 0, new).otherwise(F.col("old")).alias("key"), F.col("p_retailprice").alias("price"))
    lost = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("lost-"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_acctbal").alias("price"))
    return K.rekeyed(cache.unionByName(lost), "key", K.new_keys(part, "old", new))
