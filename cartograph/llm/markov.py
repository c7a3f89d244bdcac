"""Character Markov models as tables of log-likelihood ratios, for use in column expressions.

Counts are made by Spark aggregations.  An alphabet of A symbols and an order of k bound the
table to A ** (k + 1) numbers, whatever the size of the input; the table is a constant of the
plan, and a score is a fold over the characters of a value.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Alphabet:
    """Symbols by number: 0 starts a value, 1 is any other character."""

    def __init__(self, symbols: str):
        self.symbols = symbols
        self.size = len(symbols) + 2

    def codes(self, value: Column) -> Column:
        """Array of the numbers of the characters of ``value``."""
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        return F.transform(chars, lambda c: F.instr(F.lit(self.symbols), c) + F.lit(1))


def gram_counts(values: DataFrame, alphabet: Alphabet, order: int) -> list[tuple]:
    """``(label, gram, n)`` rows for ``values(label, value)``: grams of 1 to ``order + 1`` symbols.

    A gram is a number in base A whose last digit is the symbol that follows its context.
    """
    size = alphabet.size
    codes = values.select("label", alphabet.codes(F.col("value")).alias("codes")).where("size(codes) > 0")

    def gram(i: Column) -> Column:
        whole = F.lit(0).cast("long")
        for back in range(order, -1, -1):
            whole = whole * size + F.coalesce(F.get(F.col("codes"), i - back), F.lit(0))
        return whole

    grams = codes.select("label", F.explode(F.transform(F.sequence(F.lit(0), F.size("codes") - 1), gram)).alias("gram"))
    return [(r["label"], r["gram"], r["n"]) for r in grams.groupBy("label", "gram").agg(F.count("*").alias("n")).collect()]


def ratio_table(counts: list[tuple], alphabet: Alphabet, order: int) -> list[float]:
    """Log-likelihood ratio, label 1 against label 0, of every gram of ``order + 1`` symbols.

    Orders are blended from the lowest up: a context of n observations with d different
    followers trusts its own counts n / (n + d), its shorter context the rest.
    """
    size = alphabet.size
    models = []
    for label in (0, 1):
        probability = [1.0 / size] * size
        for width in range(1, order + 2):
            seen: dict[int, int] = defaultdict(int)
            for which, gram, n in counts:
                if which == label:
                    seen[gram % size**width] += n
            total, kinds = defaultdict(int), defaultdict(int)
            for gram, n in seen.items():
                total[gram // size] += n
                kinds[gram // size] += 1
            lower = size ** (width - 1)
            probability = [
                (seen.get(g, 0) + (kinds[g // size] or 1) * probability[g % lower if width > 1 else g])
                / (total[g // size] + (kinds[g // size] or 1))
                for g in range(size**width)
            ]
        models.append(probability)
    return [round(math.log(b) - math.log(a), 4) for a, b in zip(*models)]


def score(value: Column, table: list[float], alphabet: Alphabet, order: int) -> Column:
    """Sum of the ratios over the characters of ``value``."""
    fixed = F.from_json(F.lit(json.dumps(table)), "array<double>")
    size, span = alphabet.size, alphabet.size**order

    start = F.struct(F.lit(0).cast("long").alias("context"), F.lit(0.0).alias("sum"))

    def turn(state: Column, code: Column) -> Column:
        gram = state["context"] * size + code
        return F.struct(F.pmod(gram, F.lit(span)).cast("long").alias("context"), (state["sum"] + F.get(fixed, gram.cast("int"))).alias("sum"))

    return F.aggregate(alphabet.codes(value), start, turn, lambda s: s["sum"])
