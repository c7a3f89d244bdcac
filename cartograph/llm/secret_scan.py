"""Secret scans.

Three fixed patterns give the base spans.  Beyond them, every run of 16 or more characters
that a key could be made of is scored by two character Markov models of order 1, one of
random strings and one of ordinary identifiers; the run is a span of kind ``markov`` if its
log-likelihood ratio passes the threshold.  Labelled samples train the models: runs of the
corpus that a base pattern covers, and digests of numbers in usual encodings, are random;
all other runs of 6 or more such characters are ordinary.  All documents are read, each
different run counts once, and the counts are bounded by the alphabet (69 ** 2 a label).
Four fifths of the runs are counted; on the last fifth the threshold is set where no more
than ``FALSE_RATE`` of the ordinary runs pass, from ``LEAST`` upwards.

Offsets are code points.  They come from the parts between matches, as split by the same
pattern that extracts the matches.  Time is linear in the text and nearly so in its matches.
All of it is DataFrame expressions, without a shuffle but for the fit.

Defined results: a null text is empty and has no spans; a digest of no span is that of the
empty string.  Repeated rows each keep their row.  Without held-out ordinary runs the threshold is
``LEAST``.  An empty table gives no rows, and models of the made strings alone.  Very long
texts are scanned whole.  Columns that the caller names do not clash with those made here,
but for ``base_spans`` and ``all_spans``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markov import Alphabet, gram_counts, ratio_table, score

#: The base patterns, the group that is the secret, and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]{16,}+"
TRAIN_RUN = r"[A-Za-z0-9+/_=-]{6,}+"
ALPHABET = Alphabet("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: Strings made from digests of numbers, of each encoding.
FIT_STRINGS = 1000
#: Log-odds, in nats, that a run must show for itself at least: random runs are rare.
LEAST = 12.0
#: Share of ordinary held-out runs that may pass.
FALSE_RATE = 0.001
#: Scores of held-out runs are counted in steps of 1 / STEPS, up to FAR either way.
STEPS, FAR = 10, 100
#: Values of one chunk of a fold.
CHUNK = 64

_SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratios and threshold; shares of held-out ordinary and random runs that pass."""

    table: tuple[float, ...]
    threshold: float
    false_rate: float | None = None
    found_rate: float | None = None


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is asked for."""
    return F.get(F.transform(F.array(value), use), 0)


def _gather(values: Column, kind: str, turn) -> Column:
    """Fold ``values`` with ``turn(at, value) -> (at, element or null)`` from 0 to ``(at, chunks)``,
    chunks of up to ``CHUNK`` elements.  A fold copies at each step all that it carries, so over the
    whole array that is a number a chunk, and inside a chunk its elements."""

    def cut(own: Column) -> Column:
        last = F.greatest(F.ceil(F.size(own) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * CHUNK + 1, F.lit(CHUNK)))

    def begins(chunks: Column) -> Column:
        after = lambda at, chunk: F.aggregate(chunk, at, lambda now, value: turn(now, value)[0])
        return F.aggregate(chunks, F.array(F.lit(0)), lambda all_at, chunk: F.concat(all_at, F.array(after(F.element_at(all_at, -1), chunk))))

    def elements(chunk: Column, at: Column) -> Column:
        def step(state: Column, value: Column) -> Column:
            following, element = turn(state["at"], value)
            return F.struct(following.alias("at"), F.concat(state["now"], F.array(element)).alias("now"))

        found = F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(kind).alias("now")), step, lambda s: s["now"])
        return F.filter(found, lambda e: e.isNotNull())

    def folded(chunks: Column, at: Column) -> Column:
        found = F.transform(chunks, lambda chunk, k: elements(chunk, F.get(at, k)))
        return F.struct(F.element_at(at, -1).alias("at"), found.alias("chunks"))

    return _bound(_bound(values, cut), lambda chunks: _bound(begins(chunks), lambda at: folded(chunks, at)))


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Spans of ``pattern`` for which ``keep(group)`` holds, as structs in text order."""
    regex = F.lit(pattern)

    def turn(at: Column, part: Column) -> tuple[Column, Column]:
        begin = at + F.length(part["0"])
        end = begin + F.coalesce(F.length(part["1"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return end, F.when(part["1"].isNotNull() & keep(part["2"]), span)

    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, regex, 0), F.regexp_extract_all(text, regex, group))
    found = F.flatten(_gather(parts, _SPAN, turn)["chunks"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def fit_secrets(docs: DataFrame, text_col: str = "text", false_rate: float = FALSE_RATE) -> SecretModel:
    """Models of random and of ordinary runs, and their threshold."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    marked = texts.select(F.regexp_replace("t", ASSIGN, " $1 \u0001$2 ").alias("t"))
    runs = marked.select(F.explode(F.regexp_extract_all("t", F.lit("\u0001?" + TRAIN_RUN), 0)).alias("run")).distinct()
    value = F.regexp_replace("run", "^\u0001", "")
    random = (F.col("run").startswith("\u0001") & (F.length("run") > ASSIGN_LEAST)) | value.rlike(f"^(?:{ACCESS}|{HEX})$")
    corpus = runs.select(random.cast("int").alias("label"), value.alias("value"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(FIT_STRINGS).select(
        F.explode(F.array(
            F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.upper(F.substring(digest, 5, 32)),
            F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("k"), F.col("id").cast("string")), 256))), "+/=", "-_"),
            F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")), 1, 16)),
        )).alias("value")
    ).select(F.lit(1).alias("label"), "value")
    samples = corpus.union(made)
    held = F.pmod(F.xxhash64("value", F.lit(3)), F.lit(5)) == 0
    table = ratio_table(gram_counts(samples.where(~held), ALPHABET, 1), ALPHABET, 1)
    step = F.floor(F.greatest(F.least(score(F.col("value"), table, ALPHABET, 1), F.lit(float(FAR))), F.lit(-float(FAR))) * STEPS)
    tested = samples.where(held & (F.length("value") >= 16)).groupBy("label", step.cast("int").alias("step")).agg(F.count("*").alias("n")).collect()
    total = {label: sum(r["n"] for r in tested if r["label"] == label) for label in (0, 1)}
    passing = lambda label, at: sum(r["n"] for r in tested if r["label"] == label and r["step"] >= at)
    if not total[0]:
        return SecretModel(tuple(table), LEAST)
    at = int(LEAST * STEPS)
    while passing(0, at) > false_rate * total[0] and at < FAR * STEPS:
        at += 1
    return SecretModel(tuple(table), at / STEPS, passing(0, at) / total[0], passing(1, at) / total[1] if total[1] else None)


def find_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (start, kind, end) in order."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    always = lambda value: F.lit(True)
    found = docs.withColumn("__assign", _spans(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_LEAST, 2))
    found = found.withColumn(
        "__base", F.array_sort(F.concat("__assign", _spans(text, ACCESS, 1, always), _spans(text, HEX, 2, always)))
    ).withColumn("__more", _spans(text, RUN, 3, lambda v: score(v, list(model.table), ALPHABET, 1) >= model.threshold))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("base_spans", "all_spans")]
    return found.select(*names, F.col("__base").alias("base_spans"), F.array_sort(F.concat("__base", "__more")).alias("all_spans"))


def spell(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans by one."""
    names = docs.columns
    kept = docs.select(*[F.col(f"`{c}`").alias(f"__own_{c}") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text"))
    found = find_secrets(kept, model, "__text").withColumnRenamed("all_spans", "__spans")
    text = F.col("__text")

    def turn(at: Column, span: Column) -> tuple[Column, Column]:
        """What stands before a span that does not overlap those before it."""
        gap = F.struct(at.alias("start"), span["start"].alias("end"))
        return F.greatest(at, span["end"]), F.when(span["start"] >= at, gap)

    def spelled(chunk: Column) -> Column:
        """A substring walks from the start, so those of a chunk are taken from its own part of the text."""
        base, end = F.get(chunk, 0)["start"], F.element_at(chunk, -1)["end"]
        piece = lambda own, gap: F.concat(F.substring(own, gap["start"] - base + 1, gap["end"] - gap["start"]), F.lit(mark))
        once = F.transform(F.array(F.substring(text, base + 1, end - base)), lambda own: F.array_join(F.transform(chunk, lambda gap: piece(own, gap)), ""))
        return F.get(once, 0)

    cut = F.transform(
        F.array(_gather(F.col("__spans"), "array<struct<start:int,end:int>>", turn)),
        lambda s: F.concat(F.array_join(F.transform(s["chunks"], spelled), ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    new = F.when(F.size("__spans") > 0, F.get(cut, 0)).otherwise(text)
    return found.select(*[new.alias(c) if c == text_col else F.col(f"`__own_{c}`").alias(c) for c in names])
