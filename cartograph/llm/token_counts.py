"""Token counts of whole texts by count-only Viterbi.

An Aho-Corasick automaton over a unigram vocabulary enumerates all pieces in a text; one
pass over their ends carries the best score and the number of pieces of the best path, and
no path is kept.  Ties go as in the tokenizer: of equal scores the piece that starts first
wins, an unknown character comes last, and it costs its penalty once and counts as its
bytes (as one piece if the vocabulary has no bytes, adjacent ones together).

The segmentation falls apart at spaces if no piece reaches across one, and then the counts
of the parts are remembered up to a bound; otherwise the pass goes over the whole text.

Scores are whole numbers of 1/1024, so sums are exact at any length; a tokenizer that adds
32-bit floats rounds them beyond 2 ** 14 and may then take another of two near paths.

Defined results: a null or empty text has 0 tokens.  Repeated rows each keep their row; an
empty table gives no rows.  Very long texts are counted whole; parts of over ``LONGEST``
characters are not remembered.  Other columns stay, but for one named like the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .batches import steps
from .vocabulary import MODEL_PATH, Remembered, Vocabulary, worker_vocabulary

#: Parts of texts that a worker remembers in each of two generations.
REMEMBERED = 250_000
LOWEST = -(1 << 60)


def count_pieces(vocabulary: Vocabulary, unit: str) -> tuple[int, int]:
    """``(number of pieces, score in 1/1024)`` of the best segmentation of ``unit``."""
    size = len(unit)
    best, count = [LOWEST] * (size + 1), [0] * (size + 1)
    best[0] = 0
    loose = [False] * (size + 1)  # the best path ends in an unknown character
    for at, (length, score, k) in vocabulary.arcs(unit):
        start = at + 1 - length
        value = best[start] + score
        if value > best[at + 1]:
            best[at + 1], loose[at + 1] = value, k < 0
            if k >= 0:
                more = 1
            elif vocabulary.has_bytes:
                more = len(unit[at].encode("utf-8", "surrogatepass"))
            else:
                more = not loose[start]
            count[at + 1] = count[start] + more
    return count[size], best[size]


def token_counts(
    docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", model_path: str = MODEL_PATH,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``docs`` with ``out_col``, the number of tokens of each whole text.  No shuffle."""
    with open(model_path, "rb") as file:  # on the driver; tasks carry its bytes
        raw = file.read()
    names = [c for c in docs.columns if c != out_col]
    schema = StructType([*(docs.schema[c] for c in names), StructField(out_col, LongType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_vocabulary(raw)
        known = Remembered(lambda part: count_pieces(vocabulary, vocabulary.unit(part))[0], remembered)
        for batch in batches:
            counts = []
            for part in steps(batch):
                for text in part.column(at).to_pylist():
                    counts.append(sum(map(known.__getitem__, vocabulary.parts(text))) if text else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*names, out_col])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
