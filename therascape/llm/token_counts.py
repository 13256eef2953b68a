"""Token counts with offset-mapped attribution (operator 10).

Whole documents are encoded once.  Token lengths in bytes give every token's span; the spans are joined to the
sections of the text (here its lines) as intervals, and a token that crosses a boundary is allocated by
``rule``: "first" gives it to the section that holds its first byte, "most" to the one that holds most of its
bytes (the earlier one in a tie).  Section counts therefore sum to the document's count, which counting sections
one by one would not.

The vocabulary is read on the driver from ``vocabulary`` (a file of base64 tokens and ranks) and broadcast; it is a fixed file
of about a megabyte.  Defined results: null and empty texts have no tokens and no sections; repeated rows count alike.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's text is split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_made: dict[str, tuple] = {}
#: Runs of white space (of Unicode) that are handed to the merges as the one piece that the pattern makes of them.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _encoder(key: str, sent) -> tuple:
    """The encoding and its tokens' lengths, made once in a worker."""
    if key not in _made:
        import tiktoken

        ranks = sent.value
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, k in ranks.items():
            lengths[k] = len(token)
        _made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _made[key]


def encode(encoding, text: str) -> list[int]:
    """The tokens of a whole text.

    The pattern takes a run of white space but for its last character as one piece (at the end of a text all of it).  Its matcher
    runs out of stack on very long ones, so these pieces are cut out here, where the pattern cuts anyway.
    """
    out, at = [], 0
    for m in LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at < len(text) else out


def section_ends(text: bytes) -> np.ndarray:
    """Where the lines of a text end, line breaks included."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) or not text else np.append(ends, len(text))


def attribute(ends: np.ndarray, lengths: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, from the sections' ends and the tokens' lengths in bytes."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, side="right")
    if rule == "most" and len(ends):
        last = np.searchsorted(ends, stop - 1, side="right")
        for k in np.flatnonzero(last > first):
            cut = ends[first[k] : last[k] + 1]
            parts = np.diff(np.concatenate(([start[k]], np.minimum(cut, stop[k]))))
            first[k] += int(parts.argmax())
    return np.bincount(first, minlength=len(ends))


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first", text_col: str = "text") -> DataFrame:
    """(row, n_tokens, sections) for every input row; sections holds the tokens of each line."""
    if rule not in ("first", "most"):
        raise ValueError("rule must be first or most")
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoder(vocabulary, sent)
        for batch in batches:
            counts, sections = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                size = lengths[encode(encoding, text)] if text else np.zeros(0, np.int64)
                counts.append(len(size))
                sections.append(attribute(section_ends(text.encode()), size, rule))
            yield pa.record_batch({"row": batch.column("row"), "n_tokens": pa.array(counts, pa.int64()), "sections": pa.array(sections, pa.list_(pa.int64()))})

    src = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, T.StructType([src.schema["row"]]).add("n_tokens", "long").add("sections", T.ArrayType(T.LongType())))


def op10_token_counts(spark, sf_dir):
    """Every document of ``documents``: its tokens, by line as well."""
    out = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", F.size("sections").cast("long").alias("n_sections"), F.coalesce(F.array_max("sections"), F.lit(0)).cast("long").alias("most_in_section"), "sections")
