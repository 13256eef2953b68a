"""Links between programs and literature, inverted indexes, evidence merges and incremental work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from therascape.functions import vocabulary as V
from therascape.functions.normalize import companies as companies_of
from therascape.functions.normalize import lookup
from therascape.functions.text import token_key


def trial_index(literature: DataFrame) -> DataFrame:
    """(nct_id, n, first_year, last_year): what is known of each trial id in the literature."""
    return literature.where("nct_id <> ''").groupBy("nct_id").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def trial_postings(literature: DataFrame, most: int = 1000) -> DataFrame:
    """AGG-34: (nct_id, part, parts, n, uids): the records that name each trial, of n in all, in sorted lists of about ``most``.

    A trial that more records name is cut into parts by a hash of the record, so no list gathers them all; lists are dealt by ranges of
    (nct_id, part), as a table that is looked up by trial is best written.
    """
    named = literature.select(F.explode(F.array_distinct("nct_ids")).alias("nct_id"), "uid").where("nct_id <> ''").distinct()
    counts = named.groupBy("nct_id").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > most).withColumn("parts", F.ceil(F.col("n") / most).cast("int")).drop("n")
    cut = named.join(hot, "nct_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    lists = cut.groupBy("nct_id", "part", "parts").agg(F.array_sort(F.collect_list("uid")).alias("uids"))
    return lists.join(counts, "nct_id").select("nct_id", "part", "parts", "n", "uids").repartitionByRange("nct_id", "part")


def shared_trials(programs: DataFrame, literature: DataFrame) -> DataFrame:
    """(drug_name, uid): distinct pairs that share a trial id; both sides are made distinct before they meet."""
    left = programs.select("drug_name", "nct_id").distinct()
    return left.join(literature.select("uid", "nct_id").distinct(), "nct_id").select("drug_name", "uid").distinct()


def top_links(links: DataFrame, literature: DataFrame, k: int = 15) -> DataFrame:
    """(drug_name, rank, uid, total): a drug's newest k links, ties by uid, with the number of all its links.

    Links are cut to k in each of ``SALTS`` parts of a drug first, so no drug's links gather in one task.
    """
    dated = links.join(literature.select("uid", "year"), "uid").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    total = links.groupBy("drug_name").agg(F.count("*").alias("total"))
    return cut_to(dated, "drug_name", [F.desc("year"), F.asc("uid")], k).join(total, "drug_name").select("drug_name", "rank", "uid", "total")


#: Parts in which the rows of one key are cut to the best k before they meet.
SALTS = 64


def cut_to(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The best k rows of each key with their ``rank``; ``rows`` have a column ``salt``, by which they are cut first."""
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k).drop("salt")


#: A code name, beginnings that name targets and receptors, isotopes.
CODE = r"[A-Za-z]{2,}[- ]?\d{2,}[A-Za-z0-9]*"
NO_CODE = (
    r"^(?:pd|pdl|cd|cdk|il|her|tim|lag|ctla|nkg|hla|tgf|braf|kras|nras|egfr|fgfr|vegf|trop|muc|cldn|claudin|hpv|covid|hiv|hbv|hcv|b7|axl|met|alk|ros|ret|kit|pik|akt|mtor|parp|wee|atr"
    r"|atm|chk|aurora|plk|tyk|jak|stat|bcl|mcl|idh|flt|ezh|menin|hdac|dnmt|psma|fap|dota|gd2|cdh|hsp|cea|ror|dll|tnf|ccr|cxcr|gpc|epcam|nectin|sstr)\d"
)
ISOTOPES = ["radium223", "lu177", "yttrium90", "ga68", "y90", "i131", "ho166", "ac225", "pb212", "cu64", "zr89", "f18", "tc99m", "in111", "re188", "sm153"]
SHORTEST_CODE = 5


def code_tokens(text: Column) -> Column:
    """FLT-46, SCL-S28: the distinct code names in a text, letters and digits only, without targets and isotopes."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE), F.lit(0)), token_key)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= SHORTEST_CODE) & ~t.rlike(NO_CODE) & ~t.isin(ISOTOPES)))


def is_code(token: Column) -> Column:
    """FLT-45: five characters or more, a digit among them."""
    return (F.length(token) >= SHORTEST_CODE) & token.rlike(r"\d")


def title_tokens(title: Column) -> Column:
    """The code-like words of a title and its code names."""
    words = F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), token_key)
    return F.array_distinct(F.concat(F.filter(words, is_code), code_tokens(title)))


def name_tokens(name: Column) -> Column:
    """What a drug's name is looked for by: all of it if it is a code, and its only code name if it has two words at most."""
    name = F.coalesce(name, F.lit(""))
    whole, codes = token_key(name), code_tokens(name)
    single = (F.size(codes) == 1) & (F.size(F.split(F.trim(name), r"\s+")) <= 2)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(is_code(whole), F.array(whole)).otherwise(none), F.when(single, codes).otherwise(none)))


def drug_links(programs: DataFrame, literature: DataFrame, key: str, name: str, title: str) -> DataFrame:
    """J-10: (key, uid, by_trial): records that share a trial id with a program, or whose title has its code name; a pair is there once.

    ``programs``: key, name, nct_ids; ``literature``: uid, title, nct_ids.  Both sides are made distinct before they meet.
    """
    trials = programs.select(key, F.explode("nct_ids").alias("t")).distinct().join(literature.select("uid", F.explode("nct_ids").alias("t")).distinct(), "t")
    names = programs.select(key, name).distinct().select(key, F.explode(name_tokens(F.col(name))).alias("t")).distinct()
    titles = names.join(literature.select("uid", F.explode(title_tokens(F.col(title))).alias("t")).distinct(), "t")
    both = trials.select(key, "uid", F.lit(True).alias("by_trial")).union(titles.select(key, "uid", F.lit(False)))
    return both.groupBy(key, "uid").agg(F.max("by_trial").alias("by_trial"))


def linked_records(links: DataFrame, literature: DataFrame, key: str, k: int = 15) -> DataFrame:
    """AGG-38: (key, rank, uid, axis, venue, year, why, n_pub, n_conf, total): a program's k first links, those by trial first, then the newest, ties by uid."""
    rows = links.join(link_lite(literature), "uid").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    sums = rows.groupBy(key).agg(F.count_if(F.col("axis") == "publication").alias("n_pub"), F.count_if(F.col("axis") == "conference").alias("n_conf"), F.count("*").alias("total"))
    best = cut_to(rows, key, [F.desc("by_trial"), F.desc("year"), F.asc("uid")], k)
    why = F.when(F.col("by_trial"), "nct").otherwise("title").alias("why")
    return best.join(sums, key).select(key, "rank", "uid", "axis", "venue", "year", why, "n_pub", "n_conf", "total")


def link_lite(literature: DataFrame) -> DataFrame:
    """PRJ-07: (uid, axis, venue, year): where a record stands, the journal of a publication or the conference."""
    return literature.select("uid", F.when(F.col("is_pub"), "publication").otherwise("conference").alias("axis"), F.when(F.col("is_pub"), F.col("journal")).otherwise(F.col("conference")).alias("venue"), "year")


def evidence_links(programs: DataFrame, literature: DataFrame, key: str, name: str, title: str) -> DataFrame:
    """J-11: (drug_id, uid, by_trial) as in ``drug_links``, but by the whole name (five characters or more) as a word of the title."""
    trials = programs.select(key, F.explode("nct_ids").alias("t")).distinct().join(literature.select("uid", F.explode("nct_ids").alias("t")).distinct(), "t")
    whole = programs.select(key, token_key(F.col(name)).alias("t")).where(F.length("t") >= SHORTEST_CODE).distinct()
    words = literature.select("uid", F.explode(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), token_key)).alias("t")).where(F.length("t") >= SHORTEST_CODE).distinct()
    both = trials.select(F.col(key).alias("drug_id"), "uid", F.lit(True).alias("by_trial")).union(whole.join(words, "t").select(key, "uid", F.lit(False)))
    return both.groupBy("drug_id", "uid").agg(F.max("by_trial").alias("by_trial"))


def cross_check_candidates(programs: DataFrame, found: DataFrame, sure: float = 0.85) -> DataFrame:
    """FLT-48: programs (drug_id, is_oncology, modality, target) whose evidence can fill an Unknown or contradicts a value.

    ``found``: (drug_id, confidence, modality_list, target_list); only evidence from ``sure`` on names values.
    """
    firm = F.col("confidence") >= sure
    seen = lambda c: F.array_distinct(F.flatten(F.collect_list(F.when(firm, F.col(c)))))
    e = found.groupBy("drug_id").agg(seen("modality_list").alias("mods"), F.array_remove(seen("target_list"), "Unknown").alias("tgts"))
    mod, tgt = F.col("modality") != "Unknown", F.col("target") != "Unknown"
    other_mod = mod & (F.size("mods") > 0) & ~F.array_contains("mods", F.col("modality"))
    other_tgt = tgt & (F.size("tgts") > 0) & ~F.array_contains(F.transform("tgts", token_key), token_key(F.col("target")))
    fill = (~mod | ~tgt) & ((F.size("mods") > 0) | (F.size("tgts") > 0))
    return programs.where("is_oncology").join(e, "drug_id").where(fill | other_mod | other_tgt).drop("mods", "tgts")


def first_known_trial(programs: DataFrame, literature: DataFrame, key: str) -> DataFrame:
    """J-12, PRJ-13: (key, nct_id, conferences, n_pub): a program's first trial id that the literature knows, and where it does."""
    lit = literature.select(F.explode("nct_ids").alias("nct_id"), "conference", "is_pub").groupBy("nct_id")
    known = lit.agg(F.array_join(F.array_sort(F.collect_set(F.when(~F.col("is_pub"), F.col("conference")))), "/").alias("conferences"), F.count_if("is_pub").alias("n_pub"))
    ids = programs.select(key, F.posexplode("nct_ids").alias("pos", "nct_id")).groupBy(key, "nct_id").agg(F.min("pos").alias("pos"))
    found = ids.join(known, "nct_id")
    best = found.groupBy(key).agg(F.min_by(F.struct("nct_id", "conferences", "n_pub"), F.struct("pos", "nct_id")).alias("b"))
    return best.select(key, "b.*")


def restored_papers(programs: DataFrame, known: DataFrame, key: str, k: int = 3) -> DataFrame:
    """J-16: (key, papers): up to k distinct papers of a program's trials, of the smallest numbers; ``known``: (nct_id, pmid)."""
    pairs = programs.select(key, F.explode("nct_ids").alias("nct_id")).distinct().join(known.distinct(), "nct_id").select(key, "pmid").distinct()
    best = cut_to(pairs.withColumn("salt", F.pmod(F.xxhash64("pmid"), F.lit(SALTS))), key, [F.asc("pmid")], k)
    return best.groupBy(key).agg(F.array_sort(F.collect_list("pmid")).alias("papers"))


def trials_of_papers(literature: DataFrame, found: DataFrame) -> DataFrame:
    """J-17: (uid, nct_ids): a paper's own trial ids, then those by which it was found (uid, nct_id), sorted."""
    more = found.groupBy("uid").agg(F.array_sort(F.collect_set("nct_id")).alias("more"))
    return literature.select("uid", "nct_ids").join(more, "uid").select("uid", F.array_distinct(F.concat("nct_ids", "more")).alias("nct_ids"))


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """J-08, J-21: ``key`` replaced by the table's (old, new), itself where that knows none."""
    return rows.join(table.select(F.col("old").alias(key), F.col("new").alias("__new")), key, "left").withColumn(value, F.coalesce("__new", key)).drop("__new")


def new_keys(rows: DataFrame, old: str, new: Column) -> DataFrame:
    """(old, new): the rows' new keys by their old ones; an error if two rows would get the same new key, so that nothing is lost."""
    keyed = rows.select(F.col(old).alias("old"), new.alias("new"))
    clashes = keyed.groupBy("new").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*"), F.sum("n")).first()
    if clashes[0]:
        raise ValueError(f"{clashes[1]} rows share {clashes[0]} new keys: nothing is re-keyed")
    return keyed.where("old IS NOT NULL").groupBy("old").agg(F.min("new").alias("new"))


def rekeyed(cache: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """J-21: a cache under new keys; entries that have theirs already, or none, stay, so a second run changes nothing.

    Where an old and a new entry meet in one key, the one that had the key before stays, else the one of the smallest old key.
    """
    found = cache.join(keys.select(F.col("old").alias(key), "new"), key, "left").withColumn("__key", F.coalesce("new", key))
    order = F.struct((F.col(key) != F.col("__key")).alias("moved"), F.col(key).alias("old"))
    one = found.groupBy("__key").agg(F.min_by(F.struct(*[c for c in cache.columns if c != key]), order).alias("r"))
    return one.select(F.col("__key").alias(key), "r.*").select(*cache.columns)


def key_coverage(cache: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """One row: the cache's entries, and how many of the new keys it has."""
    has = keys.select("new").join(cache.select(F.col(key).alias("new")).distinct(), "new", "left_semi")
    return cache.agg(F.count("*").alias("entries")).crossJoin(F.broadcast(has.agg(F.count("*").alias("covered")))).crossJoin(F.broadcast(keys.agg(F.count("*").alias("keys"))))


def prefix_fixes(programs: DataFrame, fixes: list[tuple[str, dict[str, str]]], name: str = "drug_name") -> DataFrame:
    """J-22: the target of programs whose first drug begins with a prefix, by that prefix's table; the first prefix that fits decides.

    The old target stays in ``target_pre_manualfix``; ``fixes`` is a short list, unrolled to one expression.
    """
    first = F.lower(F.coalesce(F.get(F.filter(F.split(F.coalesce(name, F.lit("")), V.DRUG_BREAK), lambda p: F.trim(p) != ""), F.lit(0)), F.lit("")))
    new = F.lit(None).cast("string")
    for prefix, table in reversed(fixes):
        new = F.when(first.startswith(prefix), lookup(F.col("target"), table)).otherwise(new)
    out = programs.withColumn("__t", new)
    moa = F.when(F.col("__t").isNotNull() & (F.coalesce("modality", F.lit("Unknown")) != "Unknown"), F.concat_ws(" ", F.col("modality"), F.lit("targeting"), F.col("__t")))
    had = F.col("moa") if "moa" in programs.columns else F.lit(None).cast("string")
    return out.withColumns({"moa": F.coalesce(moa, had), "target_pre_manualfix": F.when(F.col("__t").isNotNull(), F.col("target")), "target": F.coalesce("__t", "target")}).drop("__t")


#: Beginnings and words of titles that are none.
BAD_TITLE = r"^[0-9]{0,2}[a-z]{2,}[0-9]{6,}|CLINICAL SCIENCE|SYMPOSI|^[A-Z ]{25,}"


def bad_title(title: Column) -> Column:
    """FLT-47: a grant number, a session's heading in capitals, or a length outside 8 to 300."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return t.rlike(BAD_TITLE) | (F.length(t) > 300) | (F.length(t) < 8)


def fixed_titles(literature: DataFrame, better: DataFrame, title: str = "title") -> DataFrame:
    """J-25: titles replaced by the table's (uid, new_title) where the present one is bad and the new one is not."""
    out = literature.join(better, "uid", "left")
    take = bad_title(F.col(title)) & F.col("new_title").isNotNull() & ~bad_title(F.col("new_title"))
    return out.withColumn(title, F.when(take, F.trim("new_title")).otherwise(F.col(title))).drop("new_title")


def variants(named: DataFrame, canon: DataFrame) -> DataFrame:
    """J-26: (canonical, raw): all spellings of each canonical name, sorted; ``canon``: (name, canonical)."""
    both = named.select("name").distinct().join(canon, "name", "left").select(F.coalesce("canonical", "name").alias("canonical"), "name")
    return both.groupBy("canonical").agg(F.array_sort(F.collect_set("name")).alias("raw"))


def author_badges(literature: DataFrame, least: int = 2) -> DataFrame:
    """J-20: (uid, n_author): how many records have the same author and affiliation, where these are two or more; else null."""
    counted = literature.groupBy("author", "affiliation").agg(F.count("*").alias("n_author")).where(F.col("n_author") >= least)
    same = F.col("l.author").eqNullSafe(F.col("c.author")) & F.col("l.affiliation").eqNullSafe(F.col("c.affiliation"))
    return literature.alias("l").join(counted.alias("c"), same, "left").select("l.uid", "c.n_author")


def missing_from(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows without those that come anew, and the new rows."""
    return missing_from(old, new, key).unionByName(new)


def gated_merge(rule: Column, model: Column, confidence: Column, fill: float = 0.6, adopt: float = 0.85, flag: float = 0.8, same=None) -> tuple[Column, Column]:
    """(value, action): a model's value fills an Unknown from ``fill`` on, replaces a conflict from ``adopt`` on, is flagged from ``flag`` on.

    ``same`` tells whether two values agree (default: equality; targets use ``merges.same_target``).
    """
    c = F.coalesce(confidence, F.lit(0.0))
    unknown, usable = F.coalesce(rule, F.lit("Unknown")) == "Unknown", F.coalesce(model, F.lit("Unknown")) != "Unknown"
    filled, conflict = unknown & usable & (c >= fill), ~unknown & usable & ~(same(rule, model) if same else rule == model)
    value = F.when(filled | (conflict & (c >= adopt)), model).otherwise(F.coalesce(rule, F.lit("Unknown")))
    action = F.when(filled, "filled").when(conflict & (c >= adopt), "adopted").when(conflict & (c >= flag), "flagged").otherwise("kept")
    return value, action


def author_counts(literature: DataFrame, least: int = 2) -> DataFrame:
    return literature.groupBy("author").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def emerging_targets(news: DataFrame, corpus: DataFrame, k: int = 40) -> DataFrame:
    """AGG-36: the k targets of the news (target) that are rarest in the corpus (target), with both counts; ties go to more news, then by name."""
    known = F.coalesce(F.col("target"), F.lit("Unknown")) != "Unknown"
    week = news.where(known).groupBy("target").agg(F.count("*").alias("this_week"))
    total = corpus.where(known).groupBy("target").agg(F.count("*").alias("corpus_total"))
    both = week.join(total, "target", "left").withColumn("corpus_total", F.coalesce("corpus_total", F.lit(0).cast("long")))
    return both.orderBy("corpus_total", F.desc("this_week"), "target").limit(k)


def emerging_of_counts(counts: DataFrame, k: int = 40) -> DataFrame:
    """``emerging_targets`` of (target, this_week, corpus_total), where a target may have many rows."""
    both = counts.where(F.coalesce(F.col("target"), F.lit("Unknown")) != "Unknown").groupBy("target").agg(F.sum("this_week").alias("this_week"), F.sum("corpus_total").alias("corpus_total"))
    return both.where("this_week > 0").orderBy("corpus_total", F.desc("this_week"), "target").limit(k)


def with_authorships(literature: DataFrame, found: DataFrame) -> DataFrame:
    """J-05: a record's lead author, affiliation, country and companies by its DOI, whatever its case.

    ``found``: (doi, lead, lead_affiliation, lead_country, institutions).  A record that is not found keeps its own affiliation and
    country, and its companies are read anew from that affiliation.
    """
    by = found.select(F.lower("doi").alias("__doi"), F.struct("lead", "lead_affiliation", "lead_country", "institutions").alias("__a"))
    out = literature.withColumn("__doi", F.lower("doi")).join(by, "__doi", "left")
    hit = F.col("__a").isNotNull()
    return out.withColumns(
        {
            "lead": F.col("__a.lead"),
            "affiliation": F.when(hit, F.col("__a.lead_affiliation")).otherwise(F.col("affiliation")),
            "country_raw": F.when(hit, F.col("__a.lead_country")).otherwise(F.col("country_raw")),
            "companies_normalized": companies_of(F.when(hit, F.array_join("__a.institutions", "; ")).otherwise(F.col("affiliation"))),
        }
    ).drop("__a", "__doi")


def with_affiliations(literature: DataFrame, found: DataFrame) -> DataFrame:
    """J-06: affiliations by DOI for the records that are found with one; all others stay as they are."""
    by = found.where(F.coalesce("lead_affiliation", F.lit("")) != "").select(F.lower("doi").alias("__doi"), F.col("lead_affiliation").alias("__f"))
    out = literature.withColumn("__doi", F.lower("doi")).join(by, "__doi", "left")
    return out.withColumn("affiliation", F.coalesce("__f", "affiliation")).drop("__f", "__doi")


def papers_of_trials(programs: DataFrame, papers: DataFrame, k: int = 5, shortest: int = 4) -> DataFrame:
    """SRC-09, FLT-49: (nct_id, drug_name, rank, pmid): a trial's k most cited papers, reviews aside, whose title names the drug.

    ``programs``: nct_id, drug_name; ``papers``: nct_id, pmid, title, kind, cited.  They meet by trial id; names under ``shortest``
    characters find nothing, and a paper counts once for a trial however often it names it.
    """
    pairs = programs.select("nct_id", "drug_name").where(F.length("drug_name") >= shortest).distinct().join(papers.where("kind <> 'Review'"), "nct_id")
    named = pairs.where(F.contains(F.lower("title"), F.lower("drug_name"))).select("nct_id", "drug_name", "pmid", "cited").distinct()
    named = named.withColumn("key", F.struct("nct_id", "drug_name")).withColumn("salt", F.pmod(F.xxhash64("pmid"), F.lit(SALTS)))
    return cut_to(named, "key", [F.desc("cited"), F.asc("pmid")], k).select("nct_id", "drug_name", "rank", "pmid")
