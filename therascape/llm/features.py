"""Sparse hashed text features for the classifiers, computed from whole texts inside tasks."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
SIZE = 1 << BITS
#: Letters, capitals and digits by class; other bytes stay.
_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


def word_slots(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct slots of a text's word unigrams, word bigrams and word-end shapes."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int64)
    ends = {w[-3:].translate(_SHAPE) for w in set(words)}
    words = [w.lower() for w in words]
    found = {crc32(w) for w in set(words)}
    found.update(crc32(b"\x01" + x) for x in ends)
    found.update(crc32(b"%b %b" % x) for x in set(zip(words, words[1:])))
    return np.unique(np.fromiter(found, np.int64, len(found)) & ((1 << bits) - 1))


#: Lengths in bytes of the word beginnings that count as features beside whole words.
STEMS = (4, 5, 6, 7)


def word_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct slots of a text's words (letters and digits only, A-Z folded) and of their beginnings, how often each occurs."""
    words = (text or b"").translate(_LETTERS).split()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    found: dict[bytes, int] = dict(seen)
    for n in STEMS:
        mark = b"%d\x01" % n
        for w, k in seen.items():
            if len(w) > n:
                stem = mark + w[:n]
                found[stem] = found.get(stem, 0) + k
    slots = np.fromiter((crc32(w) & (SIZE - 1) for w in found), np.int64, len(found))
    unique, back = np.unique(slots, return_inverse=True)
    return unique, np.bincount(back, np.fromiter(found.values(), np.int64, len(found)), len(unique))


_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def held_out(id_col: str = "doc_id"):
    """The fold kept from training: crc32 of the id as text leaves 2 modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list:
    """(label, text) of at most ``most`` labelled rows outside the held-out fold, the same ones in every run.

    The bound is a parameter of the classifiers; ids with several labels count by their largest one.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return text.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
