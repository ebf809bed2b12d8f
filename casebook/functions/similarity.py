"""Sequence similarity as expressions, with its cheap exact bounds.

The ratio itself needs Python; it runs as an Arrow-batched pandas UDF on pairs
that native bounds could not rule out.  The bounds never rule out a true match.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from casebook.functions.judges import ratio

TINY = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two texts; the order of arguments matters on long texts.

    Pairs that occur again in a batch are worked out once.
    """
    seen: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        score = seen.get((x, y))
        if score is None:
            score = seen[x, y] = ratio(x, y)
        out.append(score)
    return pd.Series(out, dtype="float64")


def length_bound(a: Column, b: Column, threshold: Column | float) -> Column:
    """2 * shorter / (sum of lengths) can still reach the threshold."""
    la, lb = F.length(a), F.length(b)
    return 2 * F.least(la, lb) >= _number(threshold) * (la + lb) * (1 - 1e-12)


def histogram(text: Column) -> Column:
    """How often each letter, digit and the space occur in a folded text, and how many other characters."""
    counts = F.transform(
        F.array(*[F.lit(c) for c in LETTERS]), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    known = F.aggregate(counts, F.lit(0), lambda total, n: total + n)
    return F.concat(counts, F.array(F.length(text) - known))


def histogram_bound(a: Column, b: Column, joint: Column, threshold: Column | float) -> Column:
    """Letters that both texts hold, twice over their joint length, can still reach the threshold.

    a, b: histograms.  Characters counted as one class only raise the bound.
    """
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda total, n: total + n)
    return 2 * common >= _number(threshold) * joint * (1 - 1e-12)


def shared_grams(joint: Column, threshold: Column | float) -> Column:
    """Numbered grams that two texts of this joint length share if they reach the threshold (see `probe_size`)."""
    return 3 * F.ceil(_number(threshold) * joint / 2 - 1e-9) - joint - 1


def aligned_grams(length: Column, threshold: float) -> Column:
    """The same for a text of this length and its shortest possible partner."""
    return F.ceil(F.lit(1.5 * threshold - 1.0) * (length * F.lit(2.0 / (2.0 - threshold))) - 1 - 1e-9)


def _number(threshold: Column | float) -> Column:
    return threshold if isinstance(threshold, Column) else F.lit(threshold)


def grams(text: Column) -> Column:
    """Numbered two-letter grams ('ab1', 'ab2', ...), so repeats count apart.

    Texts of up to three letters also carry their single letters, because two
    such texts can be similar without sharing a gram.
    """
    plain = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))
    )
    numbered = F.flatten(F.transform(
        F.array_distinct(plain),
        lambda g: F.transform(
            F.sequence(F.lit(1), F.size(F.filter(plain, lambda x: x == g))), lambda n: F.concat(g, n.cast("string"))),
    ))
    letters = F.transform(F.split(text, ""), lambda c: F.concat(F.lit("~"), c))
    return F.when(F.length(text) <= TINY, F.array_distinct(F.concat(numbered, letters))).otherwise(numbered)


def probe_size(length: Column, threshold: float) -> Column:
    """How many of a text's grams must be looked up so no match is missed.

    With M matched letters in k blocks of texts of joint length T, k <= T - 2M + 1
    because two blocks are always parted by an unmatched letter; a block of m
    letters holds m - 1 grams, so at least M - k >= 3M - T - 1 grams are shared,
    and M >= threshold * T / 2.  The shortest possible partner gives the bound.
    """
    joint = length * F.lit(2.0 / (2.0 - threshold))
    shared = F.ceil(F.lit(1.5 * threshold - 1.0) * joint - 1 - 1e-9)
    return F.when(length <= TINY, F.lit(2 * TINY)).otherwise(length - 1 - F.greatest(shared, F.lit(1)) + 1)


def fuzzy_name(a: Column, b: Column, score: Column, threshold: float) -> Column:
    """Equal, contained, or similar enough; empty names never match."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a) | (score >= threshold))
