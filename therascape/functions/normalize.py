"""Names of targets, biomarkers, institutions, countries and companies brought to one form; Column expressions only.

Null and empty names give null unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions import dictionaries as D
from therascape.functions import vocabulary as V
from therascape.functions.text import folded, holds, holds_word, java_quote, let, may_hold, single_blanks, token_key, wide

#: Letters beside ASCII's that match one of them where a pattern ignores case in Unicode.
ODD_LETTERS = {"\u017f": "s", "\u0131": "i", "\u0130": "i", "\u212a": "k"}
#: Longer names are looked at from their end first.
LONG = 200


def wide_folded(text: Column) -> Column:
    """The text in lower case as patterns of ``(?iU)`` see its ASCII letters."""
    for odd, plain in ODD_LETTERS.items():
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def until_stable(text: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` again and again until the text stays as it is; a step may only take away, so the text's length bounds the rounds.

    Most texts stay at the first step and need no rounds.
    """
    again = lambda acc: let(step(acc["x"]), lambda n: F.struct(n.alias("x"), (n == acc["x"]).alias("done")))
    start = lambda x: F.struct(x.alias("x"), F.lit(False).alias("done"))
    rounds = lambda x: F.aggregate(F.sequence(F.lit(0), F.length(x)), start(x), lambda acc, _: F.when(acc["done"], acc).otherwise(again(acc)), lambda acc: acc["x"])
    return let(text, lambda t: let(step(t), lambda first: F.when(first == t, first).otherwise(rounds(first))))


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value of a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def strip(text: Column) -> Column:
    """Without blanks around; a text that neither begins nor ends with one is not searched."""
    return let(text, lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))


def some(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def _first_contained(text: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in table.items()])


def target(raw: Column) -> Column:
    """NRM-01: a target's usual symbol; words that name no target give Unknown, other names stay."""
    return let(
        some(strip(raw)),
        lambda t: F.when(F.upper(t).isin(V.TARGET_JUNK), "Unknown").otherwise(
            F.coalesce(
                lookup(t, V.TARGET_SYNONYMS),
                F.when(t.rlike(V.KRAS_MUTATION), "KRAS"),
                lookup(F.regexp_extract(t, V.ERBB, 1), V.ERBB_TARGET),
                lookup(F.upper(t), {k.upper(): v for k, v in V.TARGET_SYNONYMS.items()}),
                t,
            )
        ),
    )


def targets(raw: Column) -> Column:
    """NRM-03: the list's targets, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(raw, F.array().cast("array<string>")), target)))


def model_target(raw: Column) -> Column:
    """NRM-04: the target meant by a model's answer, which may be a drug, a sentence or a long name with its abbreviation; Unknown if none."""
    in_brackets = r"\(([A-Za-z0-9/\-]{2,14})\)"

    def read(s: Column) -> Column:
        low = F.lower(s)
        sentence = (F.length(s) > 40) & low.rlike("|".join(map(java_quote, V.SENTENCE_MARKS)))
        inside = some(F.regexp_extract(s, in_brackets, 1))
        of_sentence = F.coalesce(_first_contained(low, V.TARGET_RESCUE), lookup(token_key(inside), V.TARGET_CANON), inside, F.lit("Unknown"))
        short = let(F.coalesce(some(F.regexp_extract(s, in_brackets + r"\s*$", 1)), s), lambda n: F.coalesce(lookup(token_key(n), V.TARGET_CANON), F.when((F.length(n) > 28) & F.contains(n, F.lit(" ")), F.coalesce(_first_contained(F.lower(n), V.TARGET_RESCUE), F.lit("Unknown"))), n))
        named = F.coalesce(lookup(token_key(s), V.DRUG_AS_TARGET), F.when(sentence, of_sentence).otherwise(short))
        return F.when(low.isin("unknown", "", "n/a", "none"), "Unknown").otherwise(let(named, lambda n: F.coalesce(target(n), n)))

    return let(F.coalesce(F.btrim(strip(raw), F.lit(".")), F.lit("")), read)


def model_targets(raw: Column) -> Column:
    """The list's targets by ``model_target``; [Unknown] for an empty list."""
    found = F.array_distinct(F.transform(F.coalesce(raw, F.array().cast("array<string>")), model_target))
    return F.when(F.size(found) == 0, F.array(F.lit("Unknown"))).otherwise(found)


def plain_biomarker(raw: Column) -> Column:
    """NRM-05: synonyms joined, words that name no biomarker dropped."""
    return let(some(strip(raw)), lambda s: F.when(~F.lower(s).isin(V.BIOMARKER_JUNK), F.coalesce(lookup(token_key(s), V.BIOMARKER_CANON), s)))


def _each_once(of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    # Spark hands a place and more to a function that takes over one value
    return lambda raw: F.array_distinct(F.array_compact(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: of(x))))


plain_biomarkers = _each_once(plain_biomarker)


def _tidy(raw: Column, blanks: Callable[[Column], Column] = lambda x: F.regexp_replace(x, r"(?U)\s+", " ")) -> Column:
    return F.btrim(strip(blanks(F.coalesce(raw, F.lit("")))), F.lit(" ,;"))


def tidy_text(raw: Column) -> Column:
    """``_tidy`` of long texts."""
    return _tidy(raw, single_blanks)


def _without_endings(name: Column) -> Column:
    for tail in V.BIOMARKER_TAILS:
        name = F.btrim(F.regexp_replace(name, tail, ""), F.lit(" ,/_-+"))
    name = F.regexp_replace(name, V.BIOMARKER_JOINED, "$1")
    return F.regexp_replace(name, V.BIOMARKER_SMALL_TAIL, "")


def _may_end() -> str:
    """A wider pattern of every ending that ``without_state`` takes away, behind which blanks and signs may stand, over the bytes of a text as it came."""
    words = V.BIOMARKER_STATE_WORDS.replace("wild[- ]?type", "type").replace("copy number", "number")
    loose = rf"viii|(?:exon|ex|del|ins|ihc){_BYTES_OF_BLANKS}[0-9\x80-\xff]+\+?|ihc\+?|cps|tps|fish|[0-3]\+"
    for c in "isk":
        words, loose = words.replace(c, wide([c])), loose.replace(c, wide([c]))
    exact = r"(?-i:[A-Z][0-9]{2,4}[A-Z*]?(?:fs|del|dup|ins)?|[A-Z](?:mut|mt|amp|del|wt|m))"
    return rf"(?:(?:^|[^0-9a-z_])(?:{words})|{loose}|{exact})\.?[\x00-\x20\x80-\xff,;/_+\-]*$"


_BYTES_OF_BLANKS = r"[\x00-\x20\x80-\xff]*"


def without_state(name: Column, rounds: int | None = None) -> Column:
    """The name without endings such as "mutation", "exon 14" or "G12C", however many; or ``rounds`` times at most."""
    if rounds is None:
        ended = lambda bare: F.right(bare, F.lit(LONG // 2)).rlike(V.BIOMARKER_MAY_END)
        return let(name, lambda n: let(F.btrim(n, F.lit(" ,/_-+")), lambda bare: F.when((F.length(bare) > LONG) & ~ended(bare), bare).otherwise(until_stable(n, _without_endings))))
    for _ in range(rounds):
        name = _without_endings(name)
    return name


def biomarker_of_text(text: Column) -> Column:
    """``biomarker`` of long texts: endings are taken away only from those that may have one."""
    tidied = tidy_text(text)
    return F.when(may_hold(F.coalesce(text, F.lit("")), _may_end()), biomarker(text, lambda _: tidied)).otherwise(biomarker(text, lambda _: tidied, lambda s: F.btrim(s, F.lit(" ,/_-+"))))


def biomarker(raw: Column, tidy: Callable[[Column], Column] = _tidy, bare: Callable[[Column], Column] = without_state) -> Column:
    """NRM-06: the gene or marker behind a biomarker's name; descriptions that are no gene stay as they are."""
    # a letter of an alias stands for one of three bytes at most, so longer names have none
    assert 3 * max(map(len, V.BIOMARKER_ALIAS)) <= LONG
    alias = lambda x: F.when(F.octet_length(x) <= LONG, lookup(F.lower(x), V.BIOMARKER_ALIAS))

    def read(s: Column) -> Column:
        symbol = lambda b: F.when(b.rlike(V.GENE) & ((b != F.lower(b)) | b.rlike(r"\d")), F.coalesce(alias(b), F.upper(b)))
        based = let(bare(s), lambda b: F.when(b == "", s).otherwise(F.coalesce(alias(b), symbol(b), b)))
        return F.coalesce(alias(s), based)

    return let(some(tidy(raw)), lambda s: F.when(s.isNotNull(), read(s)))


biomarkers = _each_once(biomarker)


def biomarker_state(raw: Column, tidy: Callable[[Column], Column] = _tidy) -> Column:
    """NRM-07: the state that a biomarker's name tells of, null if none; ``biomarker`` gives the gene."""
    def found(s: Column, low: Column, state: str, pattern: str) -> Column:
        may = holds(low, V.BIOMARKER_STATE_PARTS[state])
        may = may | s.rlike(r"(?U)\d") if state == "mutation" else may  # a change is told by its number, too
        return may & s.rlike("(?iU)" + pattern)

    return let(tidy(raw), lambda s: let(wide_folded(s), lambda low: F.coalesce(*[F.when(found(s, low, k, p), F.lit(k)) for k, p in V.BIOMARKER_STATES.items()])))


def clean_biomarkers(raw: Column, blocked: Column, canon: Column) -> Column:
    """NRM-08: a list without blocked names, each by its canonical name, once by lower case, in order.

    ``blocked`` is an array and ``canon`` a map, both keyed by lower-case names: columns of a one-row lookup table, or literals.
    """

    def step(acc: Column, x: Column) -> Column:
        key = F.lower(strip(x))
        name = F.coalesce(F.try_element_at(canon, key), strip(x))
        seen = F.exists(acc, lambda y: F.lower(y) == F.lower(name))
        skip = x.isNull() | (key == "") | F.array_contains(blocked, key) | seen
        return F.when(F.coalesce(skip, F.lit(True)), acc).otherwise(F.array_append(acc, name))

    return F.aggregate(F.coalesce(raw, F.array().cast("array<string>")), F.array().cast("array<string>"), step)


def institution(raw: Column) -> Column:
    """NRM-09: the institution of an affiliation: the broadest named part, a university before others; text without parts stays, trimmed."""
    named = lambda low: holds(low, V.INSTITUTION.split("|"))
    in_field = lambda p: let(wide_folded(p), lambda low: holds(low, V.COMPANY_FIELD_PARTS)) & p.rlike("(?iU)" + V.COMPANY_FIELD)
    is_inst = lambda p: let(F.lower(p), named) | in_field(p)
    is_university = lambda p: F.contains(F.lower(p), F.lit("universit"))

    def joined(ps: Column) -> Column:
        """The parts, a legal form behind a name joined to it."""
        form = lambda p: p.rlike(V.COMPANY_SUFFIX)
        begins = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: (i == 1) | ~form(F.get(ps, i - 1)))
        return F.when(F.size(ps) > 1, let(begins, lambda bs: F.transform(bs, lambda b, k: F.array_join(F.slice(ps, b, F.coalesce(F.get(bs, k + 1), F.size(ps) + 1) - b), ", ")))).otherwise(ps)

    def choose(parts: Column) -> Column:
        kept = F.filter(parts, lambda p: ~p.rlike(V.SUBUNIT))
        pool = F.when(F.size(kept) > 0, kept).otherwise(parts)
        return let(pool, lambda q: F.coalesce(F.get(F.filter(q, is_university), F.lit(0)), F.get(F.filter(q, is_inst), F.lit(0)), F.get(q, F.lit(0))))

    def with_campus(chosen: Column, parts: Column) -> Column:
        after = F.get(parts, F.array_position(parts, chosen).cast("int"))
        campus = after.isNotNull() & (F.size(F.split(after, r"\s+")) <= 3) & ~is_inst(after)
        return F.when(chosen.rlike(V.MULTI_CAMPUS) & campus, F.concat_ws(", ", chosen, after)).otherwise(chosen)

    def final(name: Column) -> Column:
        known = lambda low: F.coalesce(*[F.when(holds(low, V.INSTITUTION_CANON_PARTS[v]) & low.rlike(p), F.lit(v)) for p, v in V.INSTITUTION_CANON.items()])
        university = F.when(F.contains(wide_folded(name), F.lit("universit")), F.coalesce(*[some(F.regexp_extract(name, p, 1)) for p in (V.UNIVERSITY_TAIL, V.UNIVERSITY_SCHOOL)]))
        return F.coalesce(let(folded(name), known), university, name)

    segments = F.filter(F.transform(F.split(raw, "[;,]"), strip), lambda p: p != "")
    found = let(let(segments, joined), lambda ps: let(let(choose(ps), lambda c: with_campus(c, ps)), final))
    return F.coalesce(found, strip(raw))


def country(raw: Column) -> Column:
    """NRM-10: a country's usual name; states count as USA, territories keep their names, an empty name stays."""
    read = lambda s: F.coalesce(F.when(F.upper(s).isin(V.US_STATES), "USA"), lookup(F.upper(s), V.US_TERRITORIES), lookup(s, V.COUNTRIES), s)
    undotted = F.when(F.right(raw, F.lit(1)).rlike(r"(?U)[.\s]"), F.regexp_replace(raw, r"(?U)[.\s]+$", "")).otherwise(raw)
    return let(some(strip(undotted)), lambda s: F.when(s.isNull(), raw).when(F.length(s) > LONG, s).otherwise(read(s)))


def country_of_code(code: Column) -> Column:
    """NRM-15: the country of a two-letter code; an unknown code stays, in capitals."""
    return F.coalesce(lookup(F.upper(code), V.COUNTRY_CODES), F.upper(code))


def known_modality(raw: Column) -> Column:
    """NRM-12: one of the known kinds of drug, else Unknown."""
    return F.coalesce(lookup(F.lower(strip(raw)), {k.lower(): k for k in D.MODALITY}), F.lit("Unknown"))


def _company_test(low: Column, name: str, phrases: list[str]) -> Column:
    loose = [p for p in phrases if p not in V.COMPANY_WHOLE_WORDS]
    whole = [p for p in phrases if p in V.COMPANY_WHOLE_WORDS]
    tests = [holds(low, loose)] if loose else []
    if name in V.COMPANY_PATTERNS:
        tests.append(holds(low, V.COMPANY_PATTERN_PARTS[name]) & low.rlike(V.COMPANY_PATTERNS[name]))
    return reduce(lambda a, b: a | b, tests + ([holds_word(low, whole)] if whole else []))


def company(segment: Column, may_be_known: bool = True, may_be_barred: bool = True) -> Column:
    """The company that one segment of a sponsor text names: a known one, else the segment without its legal form if it looks like a company."""

    def shorter(n: Column) -> Column:
        # a legal form stands at the end, so the whole is searched only where the end has one
        ended = F.right(n, F.lit(64)).rlike(V.LEGAL_TAIL) | F.right(n, F.lit(1)).rlike(r"(?U)\s")
        return F.when(ended, F.btrim(F.regexp_replace(n, V.LEGAL_TAIL, ""), F.lit(", "))).otherwise(F.btrim(n, F.lit(", ")))

    def other(s: Column) -> Column:
        hinted = s.rlike(V.COMPANY_HINT)
        named = hinted & ~s.rlike(V.NOT_A_COMPANY) if may_be_barred else hinted
        return F.when(named, let(until_stable(F.btrim(s, F.lit(", ")), shorter), lambda n: F.when(F.length(n) >= 2, n)))

    known = lambda low: F.coalesce(*[F.when(_company_test(low, n, p), F.lit(n)) for n, p in V.COMPANIES])
    return F.coalesce(let(F.lower(segment), known), let(segment, other)) if may_be_known else let(segment, other)


def companies(*texts: Column, may_be_known: bool = True, may_be_barred: bool = True) -> Column:
    """NRM-11: the companies that the texts name, each once, in order; texts that hold no known name or no word that bars one need no search for it."""
    segments = F.flatten(F.array(*[F.split(F.coalesce(t, F.lit("")), V.COMPANY_BREAK) for t in texts]))
    of = lambda s: company(s, may_be_known, may_be_barred)
    return F.array_distinct(F.array_compact(F.transform(F.filter(F.transform(segments, strip), lambda s: s != ""), of)))


def _ascii_edges(pattern: str) -> str:
    """A wider pattern over bytes of one of ``(?iU)``, where ends of words are those of ASCII."""
    pattern = pattern.removeprefix("(?iU)").replace(r"\w*", r"[0-9a-z_\x80-\xff]*")
    for c in "isk":
        pattern = pattern.replace(c, wide([c]))
    pattern = re.sub(r"\[([à-ÿ])([a-z])\]", r"(?:\1|\2)", pattern)
    # the second byte of these letters is less by 0x20 in capitals
    pattern = re.sub("[à-ÿ]", lambda m: rf"\xc3[\x{m[0].encode()[1]:02x}\x{m[0].encode()[1] - 32:02x}]", pattern)
    pattern = pattern.replace(r"\b(", r"(?:^|[^0-9a-z_])(").replace(r")\b", r")(?:[^0-9a-z_]|$)")
    assert r"\b" not in pattern and pattern.isascii()
    return pattern


def companies_of_text(text: Column) -> Column:
    """``companies`` of long texts: only those are taken apart that hold a name or a hint at all."""
    known = may_hold(text, wide([w for name, words in V.COMPANIES for w in [*words, *V.COMPANY_PATTERN_PARTS.get(name, [])]]))
    hinted, barred = may_hold(text, _ascii_edges(V.COMPANY_HINT)), may_hold(text, _ascii_edges(V.NOT_A_COMPANY))
    found = F.when(known, companies(text)).when(hinted & barred, companies(text, may_be_known=False)).when(hinted, companies(text, may_be_known=False, may_be_barred=False))
    return found.otherwise(F.array().cast("array<string>"))
