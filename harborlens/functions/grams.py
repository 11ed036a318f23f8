"""Word and n-gram counts over Arrow batches of word lists.

A batch is one flat run of word numbers with document offsets, so all documents of a batch are
counted together by sorting; n-grams are numbered exactly, not hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _flat(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of each word, number of each word, distinct words)."""
    coded = words.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(words)), sizes), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def profile_hits(words: Column, profiles: list[list[str]]) -> Column:
    """array<int>: how many of the words are in each profile."""

    @F.arrow_udf("array<int>")
    def count(batch: pa.Array) -> pa.Array:
        doc, word, distinct = _flat(batch)
        hits = np.zeros((len(batch), len(profiles)), dtype=np.int32)
        for i, profile in enumerate(profiles):
            listed = pc.is_in(distinct, pa.array(profile)).to_numpy(zero_copy_only=False)
            hits[:, i] = np.bincount(doc[listed[word]] if len(word) else doc, minlength=len(batch))
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(profiles)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(hits.ravel()))

    return count(words)


def ngram_letters(words: Column, top: list[int], repeated: list[int]) -> Column:
    """Struct of letter counts per document.

    ``top_n``: count times letters of the most frequent n-gram (ties: the longest), 0 when none
    repeats. ``dup_n``: letters of words inside n-grams that occurred before, each word once.
    """
    names = [f"top_{n}" for n in top] + [f"dup_{n}" for n in repeated]

    @F.arrow_udf(", ".join(f"{name} BIGINT" for name in names))
    def count(batch: pa.Array) -> pa.Array:
        docs = len(batch)
        doc, word, distinct = _flat(batch)
        letters = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[word]
        upto = np.concatenate([[0], np.cumsum(letters)])
        end = np.cumsum(np.bincount(doc, minlength=docs))[doc]
        width = len(distinct) + 1
        result = {name: np.zeros(docs, dtype=np.int64) for name in names}
        at = np.arange(len(word))
        gram = np.unique(doc * width + word, return_inverse=True)[1]
        for n in range(2, max(top + repeated) + 1):
            fits = at + n <= end[at]
            at, gram = at[fits], gram[fits]
            if not len(at):
                break
            _, first, gram, counts = np.unique(
                gram * width + word[at + n - 1], return_index=True, return_inverse=True, return_counts=True
            )
            times = counts[gram]
            if n in top:
                size = upto[at + n] - upto[at]
                best = np.zeros(docs, dtype=np.int64)
                np.maximum.at(best, doc[at], np.where(times > 1, (times << 32) + size, 0))
                result[f"top_{n}"] = (best >> 32) * (best & 0xFFFFFFFF)
            if n in repeated:
                later = np.ones(len(at), dtype=bool)
                later[first] = False
                edges = np.bincount(at[later], minlength=len(word) + 1) - np.bincount(at[later] + n, minlength=len(word) + 1)
                covered = np.cumsum(edges)[: len(word)] > 0
                result[f"dup_{n}"] = np.bincount(doc, weights=letters * covered, minlength=docs).astype(np.int64)
            # A repeated (n+1)-gram starts with a repeated n-gram, so the others can go.
            at, gram = at[times > 1], gram[times > 1]
        return pa.StructArray.from_arrays([pa.array(result[name]) for name in names], names=names)

    return count(words)
