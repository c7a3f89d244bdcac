"""Quality classifier by compression.

zstandard dictionaries are trained from text labelled good and from text labelled bad; the
labelled rows are dealt to a few pairs of dictionaries, since a trained dictionary keeps only
what it found most useful.  A text is cut into windows of fixed length, all of it, and every
window is compressed once with each dictionary.  The difference of the summed sizes, bad less
good, over the size of the text is the only feature, and a logistic curve fitted on labelled
rows that the dictionaries never saw turns it into a score from 0 to 1.

Defined results: a null or empty text has feature 0 and the score that the curve gives
for 0; without labels of both classes, every score is the share of good labels (0.5
without any label).  A label other than 0 and 1, a null id, or an id with both labels is
ignored; of rows that repeat a labelled id one takes part in the fit.  Repeated rows each
keep their score and row.  An empty table gives no rows.  Very long texts are scored whole,
and calibrated whole.  Columns that the caller names do not clash with those made here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import steps

#: Labelled rows of each class that a fit reads at most, those of smallest hash.
FIT_ROWS = 3000
WINDOW_BYTES = 512
#: Windows of one text that a dictionary is trained from at most, spread evenly.
TRAIN_WINDOWS = 16
DICTIONARY_BYTES = 65536
LEVEL = 3
#: Pairs of dictionaries at most, and labelled texts of a class that one needs.
PAIRS = 4
PAIR_ROWS = 50


@dataclass(frozen=True)
class QualityModel:
    good: tuple[bytes, ...]
    bad: tuple[bytes, ...]
    slope: float
    intercept: float
    window: int = WINDOW_BYTES
    level: int = LEVEL

    def curve(self, feature):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * feature + self.intercept, -500, 500)))


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=data, level=level, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Feature:
    """The difference of compressed sizes a byte of text; higher is nearer to good text."""

    def __init__(self, good: tuple[bytes, ...], bad: tuple[bytes, ...], window: int, level: int):
        self.window = window
        self.good = [_compressor(d, level) for d in good]
        self.bad = [_compressor(d, level) for d in bad]

    def __call__(self, text: str | None) -> float:
        if not text or not self.good:
            return 0.0
        raw = text.encode("utf-8", "surrogatepass")
        difference = 0
        for at in range(0, len(raw), self.window):
            piece = raw[at : at + self.window]
            difference += sum([len(c.compress(piece)) for c in self.bad]) - sum([len(c.compress(piece)) for c in self.good])
        return difference / (len(raw) * len(self.good))


def windows_of(text: str | None, window: int) -> list[bytes]:
    """Up to ``TRAIN_WINDOWS`` windows, spread evenly over the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = -(-len(raw) // window)
    step = max(1, -(-count // TRAIN_WINDOWS))
    return [raw[k * window : (k + 1) * window] for k in range(0, count, step)]


def _train(samples: list[bytes], size: int) -> bytes:
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: the text itself serves
        return b"".join(samples)[-size:].rjust(8, b" ")


def _of_picked(texts: DataFrame, picked: DataFrame, value, kind: str) -> list:
    """``(y, value(text))`` of the picked ids, by a hash of the id; one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = value()
        for batch in batches:
            for part in steps(batch):
                made = [make(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.float64() if kind == "double" else pa.list_(pa.binary()))], ["o", "y", "v"])

    rows = texts.join(F.broadcast(picked), "i").select("o", "y", "t")  # the fit's rows at most
    made = rows.mapInArrow(run, f"o long, y int, v {kind}")
    return [(r["y"], r["v"]) for r in made.groupBy("o", "y").agg(F.min("v").alias("v")).orderBy("o").collect()]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps on one feature with a weak ridge on the slope."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    ridge = np.array([1e-2, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", fit_rows: int = FIT_ROWS, window: int = WINDOW_BYTES,
    dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL,
) -> QualityModel:
    """Fit on ``labels`` (the caller has taken held-out rows away).

    At most ``fit_rows`` rows of each class take part, those whose id hashes lowest, so the
    driver's memory is bounded at any size of input: of three quarters of them windows spread
    over the whole text come to the driver and train the dictionaries, of the last quarter the
    features, which executors compute from whole texts as they do for scores.
    """
    known = (
        labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
        .groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    )
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())

    def constant() -> QualityModel:
        share = (totals.get(1, 0) + 0.5) / (n + 1) if n else 0.5
        return QualityModel((), (), 0.0, math.log(share / (1 - share)), window, level)

    if len(totals) < 2:
        return constant()
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(fit_rows)
        picked = part if picked is None else picked.union(part)
    picked = picked.select("i", "y", F.xxhash64("i", F.lit(5)).alias("o"))
    calibrates = F.pmod(F.xxhash64("i", F.lit(11)), F.lit(4)) == 0
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = _of_picked(texts, picked.where(~calibrates), lambda: lambda t: windows_of(t, window), "array<binary>")
    samples = {y: [v for label, v in rows if label == y and v] for y in (0, 1)}
    tiny = not samples[0] or not samples[1]
    if tiny:  # both uses share the rows
        rows = _of_picked(texts, picked, lambda: lambda t: windows_of(t, window), "array<binary>")
        samples = {y: [v for label, v in rows if label == y and v] for y in (0, 1)}
    pairs = max(1, min(PAIRS, min(len(samples[0]), len(samples[1])) // PAIR_ROWS))
    good, bad = (tuple(_train([w for v in samples[y][k::pairs] for w in v], dictionary_bytes) for k in range(pairs)) for y in (1, 0))
    if not all(good) or not all(bad):
        return constant()
    feature = lambda: Feature(good, bad, window, level)
    found = [] if tiny else _of_picked(texts, picked.where(calibrates), feature, "double")
    if {y for y, _ in found} != {0, 1}:
        found = _of_picked(texts, picked, feature, "double")
    y, x = np.array([y for y, _ in found], float), np.array([v for _, v in found])
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    slope, intercept = _logistic(x, y, weight * len(y) / weight.sum())
    return QualityModel(good, bad, max(slope, 0.0), intercept, window, level)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: the calibrated score of each whole text.  No shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in docs.columns if c != out_col]
    schema = StructType([*(docs.schema[c] for c in names), StructField(out_col, DoubleType())])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = Feature(model.good, model.bad, model.window, model.level)
        for batch in batches:
            found = []
            for part in steps(batch):
                found += [feature(t) for t in part.column(at).to_pylist()]
            score = model.curve(np.array(found, dtype=float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, out_col])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
