"""Dictionary tagging and cleaning of text as Column expressions; columns of long texts are searched by Arrow, a batch at once."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions import dictionaries as D


def java_quote(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/&-])", r"\\\1", word)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where the value is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """The text with its ASCII letters in lower case; the two other letters whose lower case holds an ASCII letter become a sign that no word has."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd")))


def holds(low: Column, words: list[str]) -> Column:
    """Substring of any word in a folded text; a search of bytes a word, which on long texts takes a fraction of the time of an alternation."""
    assert all(map(str.isascii, words))
    return F.exists(F.array(*[F.lit(w) for w in dict.fromkeys(w.lower() for w in words)]), lambda w: F.contains(low, w))


def holds_word(low: Column, words: list[str]) -> Column:
    """Any word in a folded text that touches no other ASCII letter or digit; only words that are there at all are looked at closely."""
    alone = [F.contains(low, F.lit(w)) & low.rlike(f"(?<![a-z0-9]){java_quote(w)}(?![a-z0-9])") for w in dict.fromkeys(w.lower() for w in words)]
    return reduce(lambda a, b: a | b, alone)


#: Letters beside ASCII's whose lower case holds an ASCII letter or that a pattern of ``(?iU)`` takes for one, as bytes.
_WIDE = {"i": r"(?:i|\xc4[\xb0\xb1])", "s": r"(?:s|\xc5\xbf)", "k": r"(?:k|\xe2\x84\xaa)"}


def wide(words: list[str]) -> str:
    """A pattern over bytes for ``may_hold``: any of the words (ASCII) in whatever case."""
    assert all(map(str.isascii, words))
    return "|".join("".join(_WIDE.get(c, re.escape(c)) for c in w.lower()) for w in dict.fromkeys(words))


def may_hold(text: Column, pattern: str) -> Column:
    """The bytes of the text hold the pattern of RE2, ASCII letters in any case; a test before slower rules, one pass however many words it has.

    Not inside of lambdas, as it runs in Python workers.
    """

    @F.arrow_udf("boolean")
    def search(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts.cast(pa.binary()), "(?i)" + pattern)

    return search(text)


def held(low: Column, tests: list[tuple[str, str]]) -> Column:
    """The names of all tests whose pattern the bytes of a folded text hold, in order; none for null.

    All patterns are sought at once, and one by one only in texts that hold any.  Not inside of lambdas.
    """
    whole = "|".join(f"(?:{p})" for _, p in tests)

    @F.arrow_udf("array<string>")
    def search(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.binary()).fill_null(b"")
        some = np.flatnonzero(pc.match_substring_regex(texts, whole).to_numpy(zero_copy_only=False))
        few = texts.take(pa.array(some))
        found = np.array([pc.match_substring_regex(few, p).to_numpy(zero_copy_only=False) for _, p in tests]).T
        ends = np.zeros(len(texts) + 1, np.int32)
        ends[some + 1] = found.sum(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array([n for n, _ in tests]).take(pa.array(np.nonzero(found)[1])))

    return search(low)


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in dict.fromkeys(w.lower() for w in words))


def _word(words: list[str]) -> str:
    return f"(?:^|[^a-z0-9])(?:{_any(words)})(?:[^a-z0-9]|$)"


def text_tags(text: Column) -> dict[str, Column]:
    """``modality``, ``target``, ``biomarkers`` and ``cancer_category`` of long texts, equal to these."""
    low = folded(text)
    first = lambda tests, default: F.coalesce(F.get(held(low, tests), F.lit(0)), F.lit(default))
    return {
        "modality": first([(k, _any(v)) for k, v in D.MODALITY.items()], "Unknown"),
        "target": first([(k, _any(v)) for k, v in D.TARGET.items()] + [(k, _word(v)) for k, v in D.TARGET_WORDS.items()], "Unknown"),
        "biomarkers": held(low, [(k, _any([k])) for k in D.BIOMARKER] + [(k, _word([k])) for k in D.BIOMARKER_WORDS]),
        "cancer": first([(k, _word(v)) for k, v in D.CANCER.items()], "Other"),
    }


def single_blanks(text: Column) -> Column:
    """Blanks of Unicode in a row as one blank; null for null.  Not inside of lambdas."""
    white = r"\t-\r\x{85}\p{Z}"

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, rf" *[\t-\r\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}][{white}]*|  [{white}]*", " ")

    return replace(text)


def has_any(text: Column, words: list[str]) -> Column:
    """Case-insensitive substring of any word."""
    return let(folded(text), lambda low: holds(low, words))


def has_word(text: Column, words: list[str]) -> Column:
    """Case-insensitive, not touching other ASCII letters or digits."""
    return let(folded(text), lambda low: holds_word(low, words))


def first_of(tests: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first test that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests], F.lit(default))


def all_of(tests: list[tuple[str, Column]]) -> Column:
    """The names of all tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def _target_tests(low: Column) -> list[tuple[str, Column]]:
    return [(k, holds(low, v)) for k, v in D.TARGET.items()] + [(k, holds_word(low, v)) for k, v in D.TARGET_WORDS.items()]


def modality(text: Column) -> Column:
    return let(folded(text), lambda low: first_of([(k, holds(low, v)) for k, v in D.MODALITY.items()], "Unknown"))


def modality_list(text: Column) -> Column:
    found = let(folded(text), lambda low: all_of([(k, holds(low, v)) for k, v in D.MODALITY.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("Unknown"))).otherwise(found)


def target(text: Column) -> Column:
    return let(folded(text), lambda low: first_of(_target_tests(low), "Unknown"))


def target_list(text: Column) -> Column:
    found = let(folded(text), lambda low: F.array_distinct(all_of(_target_tests(low))))
    return F.when(F.size(found) == 0, F.array(F.lit("Unknown"))).otherwise(found)


def biomarkers(text: Column) -> Column:
    return let(folded(text), lambda low: all_of([(k, holds(low, [k])) for k in D.BIOMARKER] + [(k, holds_word(low, [k])) for k in D.BIOMARKER_WORDS]))


def cancer_category(condition: Column) -> Column:
    return let(folded(condition), lambda low: first_of([(k, holds_word(low, v)) for k, v in D.CANCER.items()], "Other"))


def cancer_categories(conditions: Column) -> Column:
    """Categories of many conditions; Other only where nothing else is found."""
    found = F.array_distinct(F.transform(conditions, cancer_category))
    return F.when(F.size(found) > 1, F.array_remove(found, "Other")).otherwise(found)


def trial_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bNCT\d{8}\b"), F.lit(0)))


def token_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def format_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s\-_/:.*·]+", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markup(html: Column) -> Column:
    """Tags become blanks, five entities their characters, blanks single."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?s)<jats:title>.*?</jats:title>", " "), r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def status_bucket(status: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    return F.when(s.isin(D.ONGOING), "ongoing").when(s.isin(D.COMPLETED), "completed").when(s.isin(D.STOPPED), "stopped").otherwise("unknown")


def phase_bucket(phase: Column) -> Column:
    p = F.upper(F.coalesce(phase, F.lit("")))
    return reduce(lambda c, kv: c.when(p == kv[0], kv[1]), D.PHASE.items(), F.when(F.lit(False), "")).otherwise("NA")


def phase_weight(bucket: Column) -> Column:
    return reduce(lambda c, kv: c.when(bucket == kv[0], F.lit(kv[1])), D.PHASE_WEIGHT.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))


def year_of(date: Column) -> Column:
    return F.regexp_extract(date, r"\d{4}", 0).try_cast("int")


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def known(x: Column) -> Column:
    """Null and empty read Unknown."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("Unknown"))
