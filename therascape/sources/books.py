"""Abstracts out of a conference book: text boxes in reading order, cut into blocks, and one record a block.

A book is a run of boxes.  A block begins where a number stands alone and the next box begins with a session's label; it ends before the next such
number, or with the book.  The track in force at a block is the last one named in the four boxes before any block's beginning up to this one.
All of this depends on order, so it is told by windows, but by none over a whole book: a book is cut into stretches of ``STRETCH`` places, and
the few boxes before and after a stretch, the block that is open at its end and the track in force are handed over as one row a stretch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import mentions as T
from therascape.functions import normalize as N
from therascape.functions import text as X
from therascape.sources import literature as L

#: What a number, a page number, a track, a session's label, a footer, an author's label, an embargo and a body look like.
NUMBER = r"^(LBA\d+|TPS\d+|\d{3,5})$"
PAGE_NUMBER = r"^\d{1,4}s$"
TRACK = r"^[A-Z][A-Z &/—\-,'()0-9]{8,}$"
SESSION = r"(?i)^(Plenary Session|Poster Session|Oral Abstract Session|Rapid Oral Abstract Session|Poster Discussion Session|Clinical Science Symposium)"
FOOTER = r"(?s)Visit meetings\.asco\.org and search by abstract for the full list.*?May 12, 2026\."
FIRST_AUTHOR = r"First\s+Author:"
EMBARGO = r"(?i)The\s+full,?\s+final\s+text\s+of\s+this\s+abstract\s+will\s+be\s+available"
BODY = r"\b(Background|Methods|Introduction|Objective|Objectives|Purpose|Rationale):"
SPONSOR = r"(?s)Research Sponsor:\s*(.+?)(?=\n\n|Clinical trial information:|\n?\z)"
TRIAL = r"Clinical trial information:\s*([^\n]+)"
#: Characters that are taken for the authors where nothing tells where their list ends.
AUTHORS_AT_MOST = 300
#: Characters that a body without a heading has at least.
LEAST_BODY = 200

#: Boxes before a beginning in which a track may stand.
BEFORE = 4
#: Places of a stretch.
STRETCH = 1 << 12


def reading_order(boxes: DataFrame) -> DataFrame:
    """(book, place, text) of boxes (book, page, width, x0, x1, y0, text): page by page, the left column first, from above, in lines of 3 points."""
    middle = (F.col("x0") + F.col("x1")) / 2
    order = Window.partitionBy("book", "page").orderBy(middle >= F.col("width") / 2, -F.bround(F.col("y0") / 3), "x0", "text")
    some = boxes.withColumn("text", N.strip(F.col("text"))).where("text != ''")
    return some.select("book", (F.col("page").cast("long") * 1_000_000 + F.row_number().over(order)).alias("place"), "text")


def _stretches(flags: DataFrame) -> DataFrame:
    """(book, stretch, before, after): for each stretch the tracks of the last boxes before it, and the label of the first box after it."""
    whole = Window.partitionBy("book", "stretch")
    ends = flags.select("book", "stretch", "place", "label", "named", F.row_number().over(whole.orderBy("place")).alias("n"), F.count("*").over(whole).alias("of"))
    late = F.col("of") - F.col("n") < BEFORE
    last = F.array_sort(F.collect_list(F.when(late, F.struct("place", F.coalesce("named", F.lit("")).alias("named")))))
    one = ends.where((F.col("n") == 1) | late).groupBy("book", "stretch").agg(F.min(F.struct("place", "label"))["label"].alias("first"), last.alias("last"))
    order = Window.partitionBy("book").orderBy("stretch")  # a row a stretch
    before = F.flatten(F.collect_list(F.transform("last", lambda x: x["named"])).over(order.rowsBetween(-BEFORE, -1)))
    return one.select("book", "stretch", before.alias("before"), F.lead("first").over(order).alias("after"))


def _marked(flags: DataFrame) -> DataFrame:
    """``flags`` with ``opened`` (start, number, session) and ``track`` at the boxes where a block begins."""
    order = Window.partitionBy("book", "stretch").orderBy("place")
    known = flags.join(_stretches(flags), ["book", "stretch"])
    label = F.coalesce(F.lead("label").over(order), F.when(F.lead("place").over(order).isNull(), F.col("after")))
    near = F.concat(F.array_repeat(F.lit(""), BEFORE), F.coalesce("before", F.array().cast("array<string>")), F.collect_list(F.coalesce("named", F.lit(""))).over(order.rowsBetween(-BEFORE, -1)))
    track = F.try_element_at(F.filter(F.slice(near, -BEFORE, BEFORE), lambda x: x != ""), F.lit(-1))
    opened = F.struct(F.col("place").alias("start"), "number", F.col("session").alias("session"))
    known = known.withColumns({"session": label, "track": track})
    opens = F.col("number").isNotNull() & F.col("session").isNotNull()
    return known.withColumns({"opened": F.when(opens, opened), "track": F.when(opens, F.col("track"))}).drop("before", "after", "session", "label", "named", "number")


def _carried(df: DataFrame, ends: DataFrame, columns: list[str]) -> DataFrame:
    """Each of the columns filled with the last value so far in its book that is not null; ``ends`` are the same rows without texts."""
    here = Window.partitionBy("book", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    ends = ends.groupBy("book", "stretch").agg(*map(last, columns))
    earlier = Window.partitionBy("book").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("book", "stretch", *[F.last(c, ignorenulls=True).over(earlier).alias(f"__{c}") for c in columns])
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"__{c}")) for c in columns}
    return df.join(ends, ["book", "stretch"]).withColumns(filled).drop(*[f"__{c}" for c in columns])


def blocks(boxes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(book, start, abstract_id, session, track, block): WIN-05 to WIN-07; boxes: (book, place, text), block: its boxes in order.

    Empty boxes count as none, and of equal numbers in a book the first block stays.  Order is told from marks of the boxes, without their texts; these move
    twice, to their stretch and to their block.
    """
    some = boxes.select("book", F.col("place").cast("long").alias("place"), N.strip(F.col("text")).alias("text")).where("text != ''")
    box = F.col("text")
    flags = some.select(
        *("book", "place", "text"),
        F.floor(F.col("place") / stretch).alias("stretch"),
        F.when(box.rlike(NUMBER), box).alias("number"),
        F.when(box.rlike(SESSION), F.regexp_extract(box, SESSION, 1)).alias("label"),
        F.when(box.rlike(TRACK) & ~box.rlike(NUMBER), box).alias("named"),
    )
    slim = _marked(flags.drop("text"))
    opened = slim.where("opened IS NOT NULL").select("book", "opened.*")
    first = opened.groupBy("book", "number").agg(F.min("start").alias("start")).select("book", "start")
    marked = flags.drop("number", "label", "named").join(slim.where("opened IS NOT NULL").select("book", "stretch", "place", "opened", "track"), ["book", "stretch", "place"], "left")
    told = _carried(marked, slim, ["opened", "track"]).where(F.col("opened").isNotNull() & (F.col("place") > F.col("opened.start")))
    told = told.select("book", F.col("opened.start").alias("start"), F.col("opened.number").alias("abstract_id"), F.col("opened.session").alias("session"), "track", "place", "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return told.join(first, ["book", "start"]).groupBy("book", "start", "abstract_id", "session", "track").agg(lines.alias("block"))


def title_of(block: Column) -> Column:
    """SCL-S17: the first box that is more than a label, a footer, a page's or a block's number or a track, up to the first author; empty if there is none."""
    plain = F.transform(block, lambda b: N.strip(F.regexp_replace(b, SESSION, "")))
    no_title = lambda b: reduce(lambda x, pattern: x | b.rlike(pattern), (FOOTER, PAGE_NUMBER, NUMBER, TRACK), b == "")
    chosen = F.get(F.filter(plain, lambda b: ~no_title(b)), F.lit(0))
    return F.coalesce(F.rtrim(L.joined(_before(chosen, FIRST_AUTHOR)), F.lit(". ")), F.lit(""))


def _place(text: Column, pattern: str) -> Column:
    """Characters before the first match, null without one."""
    return N.let(F.split(text, pattern, 2), lambda parts: F.when(F.size(parts) == 2, F.char_length(parts[0])))


def _before(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, pattern, 2), F.lit(0))


def _from(text: Column, pattern: str) -> Column:
    """The text from the first match on, null without one."""
    return F.substr(text, _place(text, pattern) + 1)


def abstract_fields(blocks: DataFrame, conference: str = "ASCO", year: int = 2026) -> DataFrame:
    """Identity, title, authors and body of each block: what tags are read from is left as ``__all``."""
    lines = F.array_join(F.filter("block", lambda b: ~b.rlike(FOOTER)), "\n")
    df = blocks.withColumns({"title": title_of(F.col("block")), "__text": F.regexp_replace(lines, r"-\n(?U)\s*", "")})
    df = df.withColumn("__after", F.coalesce(F.get(F.split("__text", FIRST_AUTHOR, 2), F.lit(1)), F.lit("")))
    after = F.col("__after")
    held = F.col("__text").rlike(EMBARGO)
    ends = F.when(held, _place(after, EMBARGO)).otherwise(_place(after, BODY))
    raw = F.when(held, F.lit("")).otherwise(F.coalesce(_from(after, BODY), F.lit("")))
    df = df.withColumns({"author_raw": L.joined(F.left(after, F.coalesce(ends, F.lit(AUTHORS_AT_MOST)))), "__raw": raw})
    cut = F.least(*[F.coalesce(_place(F.col("__raw"), p), F.char_length("__raw")) for p in (SPONSOR, TRIAL)])
    body = N.strip(F.regexp_replace(F.left("__raw", cut), r"(?U)\s+", " "))
    df = df.withColumn("__body", body)
    told = ~held & ((F.char_length("__body") >= LEAST_BODY) | F.col("__body").rlike(BODY))
    sponsor = N.some(L.joined(F.regexp_extract("__text", SPONSOR, 1)))
    return df.select(
        F.concat(F.lit(f"{conference.lower()}-{year}-"), F.lower("abstract_id")).alias("uid"),
        F.lit(conference).alias("conference"),
        F.lit(year).alias("year"),
        *("book", "abstract_id"),
        F.col("abstract_id").startswith("LBA").alias("is_lba"),
        F.when(told, "available").otherwise("embargoed").alias("status"),
        F.col("session").alias("presentation_type"),
        *("track", "title", "author_raw"),
        F.when(told, F.col("__body")).alias("abstract_text"),
        sponsor.alias("research_sponsor"),
        told.alias("keyword_parsed"),
        F.when(told, "dictionary_v1").otherwise("embargoed").alias("enrichment_status"),
        F.concat_ws(" ", "title", F.when(told, F.col("__body")), "__text").alias("__all"),
    )


def abstracts(blocks: DataFrame, conference: str = "ASCO", year: int = 2026) -> DataFrame:
    """PRJ-02: the whole record of each block; a text under embargo has no body, and its tags come from title and block alone."""
    df = abstract_fields(blocks, conference, year)
    found, firm = F.col("__all"), T.sponsor(F.col("research_sponsor"))
    out = df.withColumns(
        {
            "cancer_category": T.cancers(F.col("track"), F.col("title")),
            "author": L.author(F.col("author_raw")),
            "phases": L.phases(found),
            "modality_list": X.modality_list(found),
            "target_list": X.target_list(found),
            "biomarker_list": X.biomarkers(found),
            "nct_ids": X.trial_ids(found),
            "companies": F.array_compact(F.array(firm)),
            "drugs_mentioned": T.drugs(F.concat_ws(" ", "title", F.coalesce("abstract_text", F.lit("")))),
        }
    )
    lead = F.col("author")
    named = lead.withField("author_key", T.author_key(lead["name"], lead["affiliation"])).withField("role", F.lit("first")).withField("order", F.lit(1)).withField("source", F.lit(f"{conference.lower()}_pdf"))
    return out.withColumns(
        {
            "authors": F.array_compact(F.array(F.when(lead.isNotNull(), named))),
            "phase": F.get("phases", F.lit(0)),
            "biomarker_mentioned": F.size("biomarker_list") > 0,
            "clinicaltrials_url": F.concat(F.lit("https://clinicaltrials.gov/study/"), F.get("nct_ids", F.lit(0))),
            "companies_normalized": N.companies(F.coalesce("research_sponsor", F.lit("")), F.coalesce(lead["affiliation"], F.lit(""))),
        }
    ).drop("__all", "author")
