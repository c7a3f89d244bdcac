"""Embedders: text to unit vectors.

``HashEmbedder`` is deterministic and needs no model; it sees shared words only and is no
substitute for a semantic one.  ``OnnxEmbedder`` runs an encoder from a model folder with
mean pooling.  Both work on batches inside a Python worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where model folders are looked for, after an explicit one.
MODEL_VARIABLE = "CARTOGRAPH_MODEL_DIR"


class HashEmbedder:
    """Signed feature hashing of words and their character trigrams."""

    def __init__(self, size: int = 384):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.size))
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                features = [(word, 1.0)] + [(f"#{word[i : i + 3]}", 0.25) for i in range(len(word) - 2)]
                for feature, weight in features:
                    h = xxhash.xxh64_intdigest(feature)
                    out[k, h % self.size] += weight if h >> 63 else -weight
        return pool_normalize(out)


class OnnxEmbedder:
    """An encoder with ``vocab.txt`` and an ONNX file; a quantized file goes first."""

    def __init__(self, folder: str, length: int = 128):
        self.folder, self.length = folder, length
        self._session = None

    def __getstate__(self):
        return {"folder": self.folder, "length": self.length, "_session": None}

    def _open(self):
        if self._session is None:
            import onnxruntime

            from .wordpiece import load_vocabulary

            names = sorted((n for n in os.listdir(self.folder) if n.endswith(".onnx")), key=lambda n: ("quant" not in n, n))
            if not names:
                raise FileNotFoundError(f"no .onnx file in {self.folder}")
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark's tasks are the parallelism
            self._session = onnxruntime.InferenceSession(os.path.join(self.folder, names[0]), options)
            with open(os.path.join(self.folder, "vocab.txt"), encoding="utf-8") as lines:
                self._vocabulary = load_vocabulary(lines.read().split("\n"))
        return self._session

    def embed(self, texts: list[str]) -> np.ndarray:
        from .wordpiece import encode_text

        session = self._open()
        coded = [encode_text(t, self._vocabulary, self.length) for t in texts]
        ids, mask, kinds = (np.array([c[k] for c in coded], np.int64) for k in range(3))
        wanted = {i.name for i in session.get_inputs()}
        feed = {n: v for n, v in (("input_ids", ids), ("attention_mask", mask), ("token_type_ids", kinds)) if n in wanted}
        hidden = session.run(None, feed)[0].astype(np.float64)
        weights = mask[:, :, None].astype(np.float64)
        return pool_normalize((hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1))


def pool_normalize(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.where(length > 1e-9, rows / np.maximum(length, 1e-9), rows)


def find_model(folder: str | None = None) -> str | None:
    """An explicit folder, then the variable's, then ``models/*`` here and in eight parents."""
    options = [folder, os.environ.get(MODEL_VARIABLE)]
    here = os.getcwd()
    for _ in range(9):
        top = os.path.join(here, "models")
        options += sorted(os.path.join(top, n) for n in os.listdir(top)) if os.path.isdir(top) else []
        here = os.path.dirname(here)
    for option in options:
        if option and os.path.isdir(option) and any(n.endswith(".onnx") for n in os.listdir(option)):
            return option
    return None


def default_embedder(folder: str | None = None):
    found = find_model(folder)
    return OnnxEmbedder(found) if found else HashEmbedder()


def embed_column(text: Column, embedder) -> Column:
    """Vectors of a text column; one embedder a worker, Arrow batches."""
    @F.pandas_udf("array<float>")
    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            parts = [embedder.embed([t or "" for t in rows[k : k + 64]]) for k in range(0, len(rows), 64)]
            yield pd.Series([v.astype(np.float32) for part in parts for v in part])

    return over(text)
