"""WordPiece ids for encoder models.

Text is lower-cased and split at spaces only.  A word is cut greedily into the longest
pieces of the vocabulary, ``##`` before all but the first; a word with a part that is no
piece is unknown.  The row ends before the first word that would not fit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of the special pieces of the vocabularies in use.
PAD, UNKNOWN, FIRST, LAST = 0, 100, 101, 102
LENGTH = 128

SCHEMA = "input_ids array<long>, attention_mask array<long>, token_type_ids array<long>"


def load_vocabulary(lines: list[str]) -> dict[str, int]:
    """Line number to id; blank lines take a number but give no piece."""
    return {line.strip(): k for k, line in enumerate(lines) if line.strip()}


def word_ids(word: str, vocabulary: dict[str, int]) -> list[int]:
    ids, start = [], 0
    while start < len(word):
        lead = "##" if start else ""
        for end in range(len(word), start, -1):
            found = vocabulary.get(lead + word[start:end])
            if found is not None:
                ids.append(found)
                start = end
                break
        else:
            return [UNKNOWN]
    return ids


def encode_text(text: str | None, vocabulary: dict[str, int], length: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    ids = [FIRST]
    for word in (text or "").lower().split(" "):
        if not word:
            continue
        pieces = word_ids(word, vocabulary)
        if len(ids) + len(pieces) > length - 1:
            break
        ids += pieces
    ids.append(LAST)
    rest = length - len(ids)
    return ids + [PAD] * rest, [1] * len(ids) + [0] * rest, [0] * length


def wordpiece(text: Column, vocabulary: dict[str, int], length: int = LENGTH) -> Column:
    """Struct of ids, mask and types, by Arrow batches.

    The vocabulary is fixed by its file (tens of thousands of entries) and travels with the
    function.
    """
    @F.pandas_udf(SCHEMA)
    def encode(rows: pd.Series) -> pd.DataFrame:
        coded = [encode_text(t, vocabulary, length) for t in rows]
        return pd.DataFrame(coded, columns=["input_ids", "attention_mask", "token_type_ids"])

    return encode(text)
