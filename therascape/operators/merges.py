"""Merges of model answers and rules into records, gap fixes and the companion-diagnostics score.

Answers join their records by key; Spark picks the join by size.  Answer tables hold one row a key (``latest`` makes
them so); a key that comes several times would repeat its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from therascape.functions import dictionaries as D
from therascape.functions import normalize as N
from therascape.functions import vocabulary as V
from therascape.functions.text import has_any, holds, may_hold, token_key, wide
from therascape.operators import links as L
from therascape.operators.links import gated_merge


def latest(answers: DataFrame, key: str, by: str) -> DataFrame:
    """The answers' newest row of each key, found by a partial aggregate instead of a sort."""
    row = F.struct(*answers.columns)
    return answers.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(F.col(by), F.xxhash64(*answers.columns))).alias("r")).select("r.*")


def same_target(a: Column, b: Column) -> Column:
    """MRG-02: letters and digits of one within the other; null counts as empty, which is within nothing but another empty one."""
    x, y = token_key(F.coalesce(a, F.lit(""))), token_key(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == ""), x == y).otherwise(F.contains(x, y) | F.contains(y, x))


def moa(modality: Column, target: Column) -> Column:
    return F.when(target != "Unknown", F.concat(modality, F.lit(" targeting "), target)).otherwise(modality)


def _or_unknown(x: Column) -> Column:
    return F.when(F.coalesce(F.size(x), F.lit(0)) > 0, x).otherwise(F.array(F.lit("Unknown")))


def merge_literature(records: DataFrame, answers: DataFrame, least: float = 0.6) -> DataFrame:
    """MRG-03: an answer (uid, modality_list, target_list, biomarkers, confidence, summary) of enough confidence replaces a record's lists.

    The rules' lists stay in ``*_rule``, so a second merge starts from them; a summary is taken whatever the confidence.
    """
    lists = ["modality_list", "target_list", "biomarker_list"]
    a = answers.select("uid", F.struct("modality_list", "target_list", F.col("biomarkers").alias("biomarker_list"), "confidence", "summary").alias("__a"))
    old = {c: F.col(f"{c}_rule") if f"{c}_rule" in records.columns else F.col(c) for c in lists}
    take = F.coalesce(F.col("__a.confidence") >= least, F.lit(False))
    new = {"modality_list": _or_unknown(F.col("__a.modality_list")), "target_list": _or_unknown(F.col("__a.target_list")), "biomarker_list": F.coalesce("__a.biomarker_list", F.array().cast("array<string>"))}
    out = {f"{c}_rule": old[c] for c in lists} | {c: F.when(take, new[c]).otherwise(F.col(c)) for c in lists}
    out["enrich_src"] = F.when(take, "llm").otherwise("rule")
    out["llm_confidence"] = F.col("__a.confidence")
    before = F.col("summary") if "summary" in records.columns else F.lit(None).cast("string")
    out["summary"] = F.coalesce(F.nullif(F.col("__a.summary"), F.lit("")), before)
    merged = records.join(a, "uid", "left").withColumns(out).drop("__a")
    if "biomarker_mentioned" in records.columns:
        merged = merged.withColumn("biomarker_mentioned", F.when(F.col("enrich_src") == "llm", F.size("biomarker_list") > 0).otherwise(F.col("biomarker_mentioned")))
    return merged


def merge_models(programs: DataFrame, answers: DataFrame) -> DataFrame:
    """J-01, MRG-01: answers (name_key, modality, target, biomarkers, confidence) fill and contest a program's modality and target and add biomarkers.

    A program's answer is that of its lower-cased, trimmed name.  The rules' values stay in ``*_rule``, from which a second merge
    starts; ``*_src`` says where a value is from, ``data_flags`` which conflicts were found and which resolved.
    """
    had = lambda c: F.col(f"{c}_rule") if f"{c}_rule" in programs.columns else F.col(c)
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    rule_mod, rule_tgt, rule_bio = known(had("modality")), known(had("target")), F.coalesce(had("biomarker_list"), F.array().cast("array<string>"))
    a = answers.select("name_key", F.struct(*[c for c in answers.columns if c != "name_key"]).alias("__a"))
    new_mod, new_tgt, conf = known(F.col("__a.modality")), known(F.col("__a.target")), F.coalesce(F.col("__a.confidence"), F.lit(0.0))
    mod, mod_did = gated_merge(rule_mod, new_mod, conf)
    tgt, tgt_did = gated_merge(rule_tgt, new_tgt, conf, same=same_target)
    more = F.filter(F.transform(F.coalesce(F.col("__a.biomarkers"), F.array().cast("array<string>")), lambda b: F.trim(b)), lambda b: b.isNotNull() & (b != ""))
    add = (F.size(more) > 0) & (conf >= 0.6)
    source = lambda did: F.when(did.isin("filled", "adopted"), "llm").otherwise("rule")
    flag = lambda did, c: F.when(did == "adopted", f"{c}_conflict_resolved").when(did == "flagged", f"{c}_conflict")
    bio = F.when(add, F.array_distinct(F.concat(rule_bio, more))).otherwise(rule_bio)
    out = {
        "modality_rule": rule_mod,
        "target_rule": rule_tgt,
        "biomarker_list_rule": rule_bio,
        "modality": mod,
        "target": tgt,
        "biomarker_list": bio,
        "modality_src": source(mod_did),
        "target_src": source(tgt_did),
        "biomarker_src": F.when(add, F.when(F.size(rule_bio) > 0, "llm+rule").otherwise("llm")).otherwise("rule"),
        "biomarker_mentioned": F.size(bio) > 0,
        "llm_confidence": F.col("__a.confidence"),
        "data_flags": F.array_compact(F.array(flag(mod_did, "modality"), flag(tgt_did, "target"))),
        "moa": moa(mod, tgt),
    }
    keyed = programs.withColumn("name_key", F.lower(F.trim("drug_name")))
    return keyed.join(a, "name_key", "left").withColumns(out).drop("__a", "name_key")


def merge_statistics(merged: DataFrame) -> DataFrame:
    """AGG-46: one row of counters over merged programs: rows, values filled and contested, Unknown before and after."""
    has = lambda c, x: F.count_if(F.array_contains("data_flags", f"{c}_{x}")).alias(f"{c}_{x}")
    filled = lambda c: F.count_if((F.col(f"{c}_rule") == "Unknown") & (F.col(c) != "Unknown")).alias(f"{c}_filled")
    unknown = lambda c, name: F.count_if(F.col(c) == "Unknown").alias(name)
    each = [x for c in ("modality", "target") for x in (filled(c), has(c, "conflict"), has(c, "conflict_resolved"), unknown(f"{c}_rule", f"{c}_unknown_before"), unknown(c, f"{c}_unknown_after"))]
    return merged.agg(F.count("*").alias("rows"), F.count("llm_confidence").alias("have_llm"), *each, F.count_if(F.col("biomarker_src") != "rule").alias("biomarkers_added"))


def merge_summaries(programs: DataFrame, answers: DataFrame) -> DataFrame:
    """MRG-04: summary and confidence of the answers that have a summary; others leave what a program has."""
    a = answers.where("summary <> ''").select("drug_id", F.struct("summary", "confidence").alias("__a"))
    had = lambda c, t: F.col(c) if c in programs.columns else F.lit(None).cast(t)
    found = F.col("__a").isNotNull()
    return programs.join(a, "drug_id", "left").withColumns({"summary": F.when(found, F.col("__a.summary")).otherwise(had("summary", "string")), "summary_confidence": F.when(found, F.col("__a.confidence")).otherwise(had("summary_confidence", "double"))}).drop("__a")


def merge_cross_source(programs: DataFrame, answers: DataFrame, fill: float = 0.7, correct: float = 0.85) -> DataFrame:
    """MRG-05: answers (drug_id, modality, target, biomarkers, confidence, conflict, evidence, note) fill Unknown values from ``fill``
    on and correct conflicts from ``correct`` on; ``action`` says filled or corrected, null where nothing changed.

    Values before a correction stay in ``*_pre_xref``.  ``changes`` makes the review report.
    """
    a = answers.select("drug_id", F.struct(*[c for c in answers.columns if c != "drug_id"]).alias("__a"))
    mod, tgt = F.col("modality"), F.col("target")
    new_mod, new_tgt = (F.coalesce(F.col(f"__a.{c}"), F.lit("Unknown")) for c in ("modality", "target"))
    conf = F.coalesce(F.col("__a.confidence"), F.lit(0.0))
    is_unknown = lambda x: F.coalesce(x == "Unknown", F.lit(False))
    gap = F.col("__a").isNotNull() & (is_unknown(mod) | is_unknown(tgt)) & (conf >= fill)
    usable_mod, usable_tgt = new_mod != "Unknown", new_tgt != "Unknown"
    conflict = F.col("__a").isNotNull() & ~gap & F.coalesce(F.col("__a.conflict"), F.lit(False)) & (conf >= correct) & (usable_mod | usable_tgt)
    take_mod = (gap & is_unknown(mod) & usable_mod) | (conflict & usable_mod & ~new_mod.eqNullSafe(mod))
    take_tgt = (gap & is_unknown(tgt) & usable_tgt) | (conflict & usable_tgt & ~same_target(tgt, new_tgt))
    changed = take_mod | take_tgt
    had = lambda c, t: F.col(c) if c in programs.columns else F.lit(None).cast(t)
    value_mod, value_tgt = F.when(take_mod, new_mod).otherwise(mod), F.when(take_tgt, new_tgt).otherwise(tgt)
    markers = F.coalesce(F.col("biomarker_list"), F.array().cast("array<string>"))
    added = F.filter(F.coalesce(F.col("__a.biomarkers"), F.array().cast("array<string>")), lambda b: b.isNotNull() & (b != ""))
    flags = F.coalesce(had("data_flags", "array<string>"), F.array().cast("array<string>"))
    out = {
        "modality": value_mod,
        "target": value_tgt,
        "modality_src": F.when(take_mod, "xref").otherwise(had("modality_src", "string")),
        "target_src": F.when(take_tgt, "xref").otherwise(had("target_src", "string")),
        "modality_pre_xref": F.when(conflict, F.coalesce(had("modality_pre_xref", "string"), mod)).otherwise(had("modality_pre_xref", "string")),
        "target_pre_xref": F.when(conflict, F.coalesce(had("target_pre_xref", "string"), tgt)).otherwise(had("target_pre_xref", "string")),
        "action": F.when(changed, F.when(gap, "filled").otherwise("corrected")),
        "data_flags": F.when(changed & conflict, F.array_append(flags, F.lit("xref_corrected"))).otherwise(flags),
        "biomarker_list": F.when(changed, F.array_distinct(F.concat(markers, added))).otherwise(F.col("biomarker_list")),
        "xref_confidence": F.when(changed, conf).otherwise(had("xref_confidence", "double")),
        "xref_evidence": F.when(changed, F.col("__a.evidence")).otherwise(had("xref_evidence", "array<string>")),
        "xref_note": F.when(changed, F.col("__a.note")).otherwise(had("xref_note", "string")),
        "moa": F.when(changed, moa(value_mod, value_tgt)).otherwise(had("moa", "string")),
    }
    return programs.join(a, "drug_id", "left").withColumns(out).drop("__a")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SNK-13: what a cross-source merge changed: (drug_id, action, before, after, confidence, note)."""
    pair = lambda alias: F.struct("modality", "target").alias(alias)
    new = after.where("action IS NOT NULL").select("drug_id", "action", pair("after"), F.col("xref_confidence").alias("confidence"), F.col("xref_note").alias("note"))
    return new.join(before.select("drug_id", pair("before")), "drug_id").select("drug_id", "action", "before", "after", "confidence", "note")


def evidence_of(programs: DataFrame, literature: DataFrame, k: int = 8) -> DataFrame:
    """``evidence`` of the records that share a program's trial or name its target.

    ``programs``: drug_id, nct_id, target.  Only a trial's and a target's k best records meet the programs, as no drug can have another one of them among its k best;
    so the pairs grow with the programs, not with programs times records.
    """
    ranked = with_confidence(literature)
    best = lambda key: L.cut_to(ranked.select(F.explode(F.array_distinct(key)).alias("key"), "uid", "confidence").distinct().withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(L.SALTS))), "key", [F.desc("confidence"), F.asc("uid")], k)
    of = lambda name: programs.select("drug_id", F.col(name).alias("key")).distinct()
    by_trial = of("nct_id").join(best(F.array("nct_id")), "key").select("drug_id", "uid", F.lit(True).alias("by_trial"))
    by_target = of("target").join(best(F.col("target_list")), "key").select("drug_id", "uid", F.lit(False).alias("by_trial"))
    return evidence(by_trial.union(by_target), literature, k)


def with_confidence(literature: DataFrame) -> DataFrame:
    """The records that name a modality or target, with their ``confidence``."""
    named = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "Unknown")
    return literature.where(named("modality_list") | named("target_list")).withColumn("confidence", F.coalesce("llm_confidence", F.lit(0.0)))


def evidence(links: DataFrame, literature: DataFrame, k: int = 8) -> DataFrame:
    """MRG-06: a drug's k best records that name a modality or target: those that share a trial id first, then by confidence, ties by uid.

    ``links`` holds (drug_id, uid, by_trial).  The k best are kept while aggregating, so no drug's links gather in one task.
    """
    useful = with_confidence(literature).select("uid", "modality_list", "target_list", "confidence")
    one = links.groupBy("drug_id", "uid").agg(F.max("by_trial").alias("by_trial")).join(useful, "uid")
    # two rounds, salted by uid: a drug that most records name is cut to k in each salt first
    order = lambda: [F.desc("by_trial"), F.desc("confidence"), F.asc("uid")]
    from pyspark.sql.window import Window

    salted = one.withColumn("__s", F.pmod(F.xxhash64("uid"), F.lit(64)))
    part = salted.withColumn("__n", F.row_number().over(Window.partitionBy("drug_id", "__s").orderBy(*order()))).where(F.col("__n") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("drug_id").orderBy(*order()))).where(F.col("rank") <= k).drop("__s", "__n")


#: Kinds that a gap fix may find, with their words.
GAP_KINDS = [("Vaccine", [*V.VACCINE_CODES, *D.MODALITY["Vaccine"]]), *((m, D.MODALITY[m]) for m in ("Fusion Protein", "Recombinant Protein"))]


def fixed_modality_of_text(text: Column, modality: Column) -> Column:
    """``fixed_modality`` of long texts: only those are looked at that hold a kind's word at all."""
    return F.when(may_hold(text, wide([w for _, words in GAP_KINDS for w in words])), fixed_modality(text, modality))


def fixed_modality(drug_name: Column, modality: Column) -> Column:
    """MRG-07: vaccine or protein kind that the first drug of a name tells of, where the present one may be replaced; null: no change."""

    def fix(name: Column) -> Column:
        kind = lambda low: F.coalesce(*[F.when(holds(low, words), F.lit(m)) for m, words in GAP_KINDS])
        now = F.coalesce(modality, F.lit(""))
        # the slower patterns are tried only where a kind is named
        vaccine = lambda found: (found == "Vaccine") & now.isin(V.VACCINE_OVER)
        protein = lambda found: (found != "Vaccine") & now.isin(V.PROTEIN_OVER) & ~name.rlike(V.ANTI_CYTOKINE)
        return N.let(N.let(F.lower(name), kind), lambda found: F.when((found != now) & (vaccine(found) | protein(found)) & ~name.rlike(V.PREVENTIVE), found))

    text = F.coalesce(drug_name, F.lit(""))
    some = lambda p: F.when(N.strip(p) != "", p)
    head = some(F.regexp_extract(text, rf"(?s)^(.*?)(?:{V.DRUG_BREAK}|\z)", 1))
    # a text without breaks is its own first part, and one is split as a whole only where its first part is blank
    first = F.coalesce(head, F.get(F.filter(F.split(text, V.DRUG_BREAK), lambda p: N.strip(p) != ""), F.lit(0)), text)
    return N.let(N.let(N.wide_folded(text), lambda low: F.when(holds(low, V.DRUG_BREAK_PARTS), first).otherwise(text)), fix)


def fix_modality(programs: DataFrame) -> DataFrame:
    """MRG-07 on programs; the value before the first fix stays in ``modality_pre_gapfix``."""
    new = fixed_modality(F.col("drug_name"), F.col("modality"))
    had = lambda c: F.col(c) if c in programs.columns else F.lit(None).cast("string")
    out = programs.withColumn("__m", new)
    hit = F.col("__m").isNotNull()
    return out.withColumns(
        {
            "modality_pre_gapfix": F.when(hit, F.coalesce(had("modality_pre_gapfix"), F.col("modality"))).otherwise(had("modality_pre_gapfix")),
            "modality_src": F.when(hit, "rule_modality_fix").otherwise(had("modality_src")),
            "moa": F.when(hit & (F.col("target") != "Unknown") & (F.col("target") != ""), F.concat("__m", F.lit(" targeting "), "target")).otherwise(had("moa")),
            "modality": F.coalesce("__m", "modality"),
        }
    ).drop("__m")


def cdx_strategy(eligibility: Column) -> Column:
    """MRG-09: confirmed if a biomarker stands beside words of selection, exploratory if it is only named, else none."""
    told = lambda low: F.when(~holds(low, D.BIOMARKER + D.BIOMARKER_WORDS), "none").when(holds(low, V.CDX_CONFIRMED), "confirmed").otherwise("exploratory")
    return N.let(F.lower(F.coalesce(eligibility, F.lit(""))), told)


def day_of(text: Column) -> Column:
    """The date that starts a text of a day, a month or a year; null if it is none of them."""
    parse = lambda n, rest: F.when(F.length(F.substring(text, 1, n)) == n, F.concat(F.substring(text, 1, n), F.lit(rest)).try_cast("date"))
    return F.coalesce(parse(10, ""), parse(7, "-01"), parse(4, "-01-01"))


def cdx_score(as_of: Column, completion: Column, mentioned: Column, strategy: Column, condition: Column, collaborators: Column, target: Column) -> Column:
    """MRG-08: (score, level, flags) of a program's chance for a companion diagnostic, as of a day."""
    left = F.datediff(day_of(completion), as_of)
    points = lambda said: [
        (F.coalesce(left.between(0, 180), F.lit(False)), 3, "phase2_entry_imminent"),
        (F.coalesce(mentioned, F.lit(False)), 2, "biomarker_relevant"),
        (said == "exploratory", 2, "cdx_strategy_open"),
        (said == "none", 1, "cdx_strategy_undefined"),
        (has_any(F.coalesce(condition, F.lit("")), V.CDX_CONDITIONS), 2, "priority_indication"),
        (F.coalesce(F.size(collaborators), F.lit(0)) <= 0, 1, "no_partner"),
        (F.coalesce(target == "Unknown", F.lit(False)), 0, "needs_review"),
    ]
    weights = [(n, name) for _, n, name in points(F.lit("none"))]
    # each test is made once, for the score and the flag
    held = N.let(F.coalesce(strategy, F.lit("none")), lambda said: F.array(*[test for test, _, _ in points(said)]))

    def scored(tests: Column) -> Column:
        score = sum((F.when(tests[i], F.lit(n)).otherwise(F.lit(0)) for i, (n, _) in enumerate(weights) if i), F.when(tests[0], F.lit(weights[0][0])).otherwise(F.lit(0)))
        flags = F.array_compact(F.array(*[F.when(tests[i], F.lit(name)) for i, (_, name) in enumerate(weights)]))
        return N.let(score, lambda s: F.struct(s.alias("score"), F.when(s >= 7, "high").when(s >= 4, "medium").otherwise("low").alias("level"), flags.alias("flags")))

    return N.let(held, scored)


def renormalize(programs: DataFrame) -> DataFrame:
    """MRG-10: targets and biomarkers in their usual forms; a target that is one of the program's own drugs is Unknown."""
    names = F.transform(F.array_append(F.coalesce("combo_drugs", F.array().cast("array<string>")), F.coalesce("drug_name", F.lit(""))), F.lower)
    tgt = N.let(N.model_target(F.col("target")), lambda t: F.when(F.array_contains(names, F.lower(t)), "Unknown").otherwise(t))
    out = programs.withColumns({"target": tgt, "biomarker_list": N.plain_biomarkers(F.col("biomarker_list"))})
    return out.withColumns({"biomarker_mentioned": F.size("biomarker_list") > 0, "moa": moa(F.col("modality"), F.col("target"))})
