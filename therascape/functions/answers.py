"""Answers of a model: JSON that was cut off, and fields of the wrong type (SCL-S31, SCL-J01), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from therascape.functions.normalize import let, strip

#: Items that are kept of a list in an answer that was cut off, as a model that runs away names ever more.
CUT_LIST = 20
_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def _closers(outside: Column) -> Column:
    """What closes the brackets that are open at the end, the innermost first."""

    def step(open_: Column, bracket: Column) -> Column:
        return F.when(bracket == "[", F.concat(F.lit("]"), open_)).when(bracket == "{", F.concat(F.lit("}"), open_)).otherwise(F.substring(open_, 2, 1 << 30))

    return F.aggregate(F.regexp_extract_all(outside, F.lit(r"[\[\]{}]"), F.lit(0)), F.lit(""), step)


def _closed(raw: Column) -> Column:
    """The text with its last string, value and brackets closed."""
    # whole strings do not count; a quote that is left opens the string that was cut
    outside = F.regexp_replace(raw, "(?s)" + _STRING, "")
    in_string = F.contains(outside, F.lit('"'))
    text = F.rtrim(F.regexp_replace(F.concat(raw, F.when(in_string, '"').otherwise("")), r"(?U)\s+\z", ""))
    text = F.concat(text, F.when(F.endswith(text, F.lit(":")), "null").otherwise(""))
    return F.concat(F.regexp_replace(text, r",+\z", ""), _closers(F.substring_index(outside, '"', 1)))


def _alone(raw: Column) -> Column:
    """Whether nothing follows the text's first value."""
    outside = F.regexp_replace(raw, "(?s)" + _STRING, '""')

    def step(s: Column, bracket: Column) -> Column:
        depth = s["depth"] + F.when(bracket.isin("[", "{"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (s["ends"] + (depth == 0).cast("int")).alias("ends"))

    one = F.aggregate(F.regexp_extract_all(outside, F.lit(r"[\[\]{}]"), F.lit(0)), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends")), step, lambda s: (s["ends"] == 1) & (s["depth"] == 0))
    return F.when(outside.rlike(r"^[\[{]"), one & outside.rlike(r"[\]}]\z")).otherwise(~outside.rlike(r"\s"))


def _parsed(text: Column) -> Column:
    return F.when(_alone(text), F.try_parse_json(text))


def repaired(raw: Column) -> Column:
    """SCL-S31: struct(data, truncated): the answer as a variant; one that cannot be read is closed where it was cut, and null if that does not help.

    Brackets are followed only outside strings, and closed only where the answer cannot be read as it is.  An object that has a key twice is not read.
    """
    plain = strip(F.coalesce(raw, F.lit("")))

    def read(text: Column) -> Column:
        whole = _parsed(text)
        return F.when(whole.isNotNull(), F.struct(whole.alias("data"), F.lit(False).alias("truncated"))).otherwise(F.struct(let(_closed(text), _parsed).alias("data"), F.lit(True).alias("truncated")))

    return let(plain, read)


def text_list(data: Column, field: str, truncated: Column) -> Column:
    """SCL-J01: a field's items as texts, each once, without empty ones; empty if the field is no list."""
    items = F.try_variant_get(data, f"$.{field}", "array<variant>")
    texts = F.filter(F.transform(items, lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")
    return F.array_distinct(F.coalesce(F.when(truncated, F.slice(texts, 1, CUT_LIST)).otherwise(texts), F.array().cast("array<string>")))


def _kind(data: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(data, f"$.{field}", "variant"))


def number(data: Column, field: str) -> Column:
    """SCL-J01: a field's number; 0 if it is none."""
    kind = F.regexp_extract(_kind(data, field), "^[A-Z]+", 0)
    return F.coalesce(F.when(kind.isin(*_NUMBERS), F.try_variant_get(data, f"$.{field}", "double")), F.lit(0.0))


def text(data: Column, field: str) -> Column:
    """SCL-J01: a field's text without blanks around; empty if it is none."""
    return F.coalesce(F.when(_kind(data, field) == "STRING", strip(F.try_variant_get(data, f"$.{field}", "string"))), F.lit(""))


def abstract_answer(raw: Column) -> Column:
    """What a model said of an abstract: its lists, summary and confidence; ``unparsed`` if nothing can be read of it."""

    def fields(a: Column) -> Column:
        data, cut = a["data"], a["truncated"]
        lists = [text_list(data, k, cut).alias(k) for k in ("modality_list", "target_list", "biomarkers")]
        return F.struct(*lists, text(data, "summary_ko").alias("summary"), number(data, "confidence").alias("confidence"), cut.alias("truncated"), data.isNull().alias("unparsed"))

    return let(repaired(raw), fields)
