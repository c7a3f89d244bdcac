"""SentencePiece encoding and decoding with N-best segmentations.

The pieces that occur in a text span a lattice.  A forward Viterbi pass gives the best score
of a path from the start to every position.  These scores are exact heuristics for an A-star
search that walks backwards from the end: the agenda's best hypothesis is always on a path
of the score that it promises, so hypotheses reach the start in order of their scores, and
the first N are the N best segmentations.

If no piece reaches across a space, the lattice is a chain of small ones.  Then the forward
pass of each part carries its two best scores; the N best of the whole text differ from the
best one only in the N - 1 parts that lose least by their second path, so the search runs
in those parts, and their results are merged.  This is exact: every segmentation that
changes another part loses at least as much as N - 1 that do not.

Ties: of equal scores the piece that starts first is the better one, as in the tokenizer.
Unknown characters become bytes (or the unknown piece, without bytes).

Defined results: a null or empty text has no pieces, one segmentation, score 0.  Decoding
gives back every text except one that holds the space symbol U+2581 itself, or unknown
characters under a vocabulary without bytes.  Repeated rows each keep their row; an empty
table gives no rows.  Very long texts are segmented whole, in memory proportional to the
text: what is remembered of other texts is forgotten once its characters are too many.
Columns other than the id and the text are ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import steps
from .vocabulary import MODEL_PATH, UNIT, Remembered, Vocabulary, worker_vocabulary

BEST = 4
#: Parts of texts that a worker remembers at most, about 250 bytes each.
REMEMBERED = 500_000
#: And characters of them, in parts of this many on average.
PART = 12
FAR = 1 << 60


def best_path(vocabulary: Vocabulary, unit: str) -> tuple[list[int], int, int]:
    """Ids and score of the best path, and how much less the second best one scores (``FAR``
    if there is none).  One pass over the pieces, which come by end and longest first,
    carries the two best scores of each position."""
    size = len(unit)
    best, second, back = [-FAR] * (size + 1), [-FAR] * (size + 1), [0] * (size + 1)
    length_to = [1] * (size + 1)
    best[0] = 0
    for at, (length, score, k) in vocabulary.arcs(unit):
        end = at + 1
        start = end - length
        value, top = best[start] + score, best[end]
        if value > top:
            other = second[start] + score
            best[end], second[end] = value, other if other > top else top
            back[end], length_to[end] = k, length
        elif value > second[end]:
            second[end] = value
    ids: list[int] = []
    end = size
    while end:
        k = back[end]
        if k >= 0:
            ids.append(k)
            end -= length_to[end]
        else:
            end -= 1
            ids += reversed(vocabulary.unknown_ids(unit[end]))
    ids.reverse()
    return ids, best[size], best[size] - second[size] if second[size] > -FAR // 2 else FAR


def forward(vocabulary: Vocabulary, unit: str) -> tuple[list[int], list[list[tuple]]]:
    """Best scores by position, and the pieces by end as ``(start, score, id)``."""
    ends: list[list[tuple]] = [[] for _ in range(len(unit) + 1)]
    best = [-FAR] * (len(unit) + 1)
    best[0] = 0
    for at, (length, score, k) in vocabulary.arcs(unit):
        start = at + 1 - length
        ends[at + 1].append((start, score, k))
        if best[start] + score > best[at + 1]:
            best[at + 1] = best[start] + score
    return best, ends


def _ids(vocabulary: Vocabulary, unit: str, start: int, k: int) -> list[int]:
    return [k] if k >= 0 else vocabulary.unknown_ids(unit[start])


def n_best(vocabulary: Vocabulary, unit: str, n: int) -> list[tuple[int, list[int]]]:
    """The ``n`` best segmentations ``(score, ids)`` of ``unit``, best first."""
    best, ends = forward(vocabulary, unit)
    out: list[tuple[int, list[int]]] = []
    # (-promise, position, number, score so far, arc, rest): nearer to the start goes first.
    agenda: list[tuple] = [(-best[-1], len(unit), 0, 0, None)]
    number = 0
    while agenda and len(out) < n:
        _, at, _, behind, chain = heapq.heappop(agenda)
        if at == 0:
            ids: list[int] = []
            while chain is not None:
                (start, k), chain = chain
                ids += _ids(vocabulary, unit, start, k)
            out.append((behind, ids))
            continue
        for start, score, k in ends[at]:
            number += 1
            heapq.heappush(agenda, (-(best[start] + score + behind), start, number, behind + score, ((start, k), chain)))
    return out


_ENCODERS: dict[tuple, "Encoder"] = {}


def worker_encoder(raw: bytes, n: int) -> "Encoder":
    """One encoder a Python process, so that what it remembers serves later tasks."""
    vocabulary = worker_vocabulary(raw)
    if (vocabulary.key, n) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.key, n] = Encoder(vocabulary, n)
    return _ENCODERS[vocabulary.key, n]


class _Slots(dict):
    """Part to its number; a part that is met first is segmented."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, part: str) -> int:
        slot = self[part] = self.add(part)
        return slot


class Encoder:
    """Encodes whole texts.  Segmentations of parts are remembered in arrays, so that a text
    is a gather over the numbers of its parts; all is forgotten once there are too many."""

    def __init__(self, vocabulary: Vocabulary, n: int = BEST, remembered: int = REMEMBERED):
        self.vocabulary, self.n, self.remembered = vocabulary, n, remembered
        self.searched = Remembered(lambda part: n_best(vocabulary, vocabulary.unit(part), n), max(1, remembered // 60))
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots(self._add)
        self.about = np.zeros((1024, 4), np.int64)  # score, loss, start, length
        self.ids = np.zeros(8192, np.int32)
        self.size = self.used = self.characters = 0
        self.new_about: list[int] = []
        self.new_ids: list[int] = []

    def _add(self, part: str) -> int:
        ids, score, loss = best_path(self.vocabulary, self.vocabulary.unit(part))
        self.new_about += (score, loss, self.used + len(self.new_ids), len(ids))
        self.new_ids += ids
        self.characters += len(part)
        return len(self.slots)

    def _take_in(self) -> None:
        """Move new parts into the arrays."""
        if not self.new_about:
            return
        rows, ids = np.array(self.new_about, np.int64).reshape(-1, 4), np.array(self.new_ids, np.int32)
        while self.size + len(rows) > len(self.about):
            self.about = np.concatenate([self.about, np.zeros_like(self.about)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.about[self.size : self.size + len(rows)] = rows
        self.ids[self.used : self.used + len(ids)] = ids
        self.size, self.used = self.size + len(rows), self.used + len(ids)
        self.new_about, self.new_ids = [], []

    def __call__(self, text: str | None) -> tuple[np.ndarray, int, list[tuple[int, dict[int, list[int]]]]]:
        """``(ids of the best, score, segmentations)``; a segmentation is its score and the
        parts, by position, that differ from the best one."""
        keys = self.vocabulary.parts(text or "")
        if not keys:
            return np.zeros(0, np.int32), 0, [(0, {})]
        if len(self.slots) >= self.remembered or self.characters >= PART * self.remembered:
            self._forget()
        slots = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        self._take_in()
        about = self.about[slots]
        score, loss, start, length = int(about[:, 0].sum()), about[:, 1], about[:, 2], about[:, 3]
        found: list[tuple[int, dict[int, list[int]]]] = [(score, {})]
        wanted = self.n - 1
        if wanted:
            near = np.flatnonzero(loss <= np.partition(loss, wanted - 1)[wanted - 1]) if len(loss) > wanted else np.arange(len(loss))
            for at in near[np.argsort(loss[near], kind="stable")][:wanted].tolist():
                if loss[at] >= FAR:
                    break
                ways = self.searched[keys[at]]
                top = ways[0][0]
                merged = [(s + way[0] - top, change | ({at: way[1]} if k else {})) for s, change in found for k, way in enumerate(ways)]
                merged.sort(key=lambda x: -x[0])
                found = merged[: self.n]
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) + np.repeat(start - ends + length, length)
        self.ends = ends  # of the parts of the last text
        return self.ids[place], score, found

    def spell(self, ids: np.ndarray, change: dict[int, list[int]]) -> np.ndarray:
        """All ids of a segmentation of the text that was encoded last, ``ids`` being its best."""
        pieces, done = [], 0
        for at in sorted(change):
            pieces += [ids[done : self.ends[at - 1] if at else 0], np.array(change[at], np.int32)]
            done = self.ends[at]
        return np.concatenate([*pieces, ids[done:]])


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH, n: int = BEST,
    alternatives: bool = False, decoded: bool = False, digests: bool = False,
) -> DataFrame:
    """``(id_col, ids, n_pieces, score, best_scores)`` of whole texts.  No shuffle.

    ``best_scores`` has the scores of the N best segmentations.  With ``alternatives`` their
    ids follow as ``best_ids``, with ``decoded`` the text that the ids decode to.  With
    ``digests`` the ids are replaced by SHA-256 digests of their 32-bit little-endian form:
    ``ids_sha256``, and ``best_sha256`` of the ids of the N best, one after the other;
    ``decoded_sha256`` is that of the decoded text and ``decoded_equal`` says if it is the text.
    """
    import hashlib

    with open(model_path, "rb") as file:
        raw = file.read()
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [f"`{id_col}` {id_type}"]
    fields.append("ids_sha256 string" if digests else "ids array<int>")
    fields += ["n_pieces long", "score double", "best_scores array<double>"]
    fields += ["best_ids array<array<int>>"] * alternatives + ["best_sha256 string"] * digests + ["decoded string"] * decoded
    fields += ["decoded_sha256 string", "decoded_equal boolean"] * digests
    names = [f.split(" ")[0].strip("`") for f in fields]
    names[0] = id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(raw, n)
        vocabulary = encoder.vocabulary
        for batch in batches:
            for part in steps(batch, 128, 2 << 20):
                texts = part.column(1).to_pylist()
                done, spelled = [], []
                for t in texts:
                    done.append(found := encoder(t))
                    if alternatives or digests:
                        spelled.append([found[0] if not change else encoder.spell(found[0], change) for _, change in found[2]])
                counts = [len(d[0]) for d in done]
                columns = [part.column(0)]
                if digests:
                    columns.append(pa.array([hashlib.sha256(d[0].astype("<i4").tobytes()).hexdigest() for d in done]))
                else:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int32)))
                columns += [
                    pa.array(counts, pa.int64()), pa.array([d[1] / UNIT for d in done], pa.float64()),
                    pa.array([[s / UNIT for s, _ in d[2]] for d in done], pa.list_(pa.float64())),
                ]
                if alternatives:
                    columns.append(pa.array(spelled, pa.list_(pa.list_(pa.int32()))))
                if digests:
                    columns.append(pa.array([hashlib.sha256(b"".join(x.astype("<i4").tobytes() for x in some)).hexdigest() for some in spelled]))
                if decoded or digests:
                    back = [vocabulary.decode(d[0].tolist()) for d in done]
                    columns += [pa.array(back, pa.string())] * decoded
                    if digests:
                        columns.append(pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back]))
                        columns.append(pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ", ".join(fields))
