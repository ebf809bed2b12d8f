"""Quality rules as weak supervision.

Each rule looks at the counts of one document and votes good (1), bad (-1) or
abstains (0).  Expectation-maximisation over the votes of all documents that pass
the base test estimates how often each rule is right and how common good documents are; a
document is kept if its posterior probability of being good reaches a bound.

The counts are made once per document inside an Arrow UDF, on its whole text.
The votes are integer expressions over them, so documents fall into at most
3 ** 10 vote patterns: the counts of these patterns are all that training reads,
whatever the number of documents.

Defined cases: a null or empty text has no words, gets no votes and fails the
base test; repeated rows count once each; an empty table gives an empty result
with the starting accuracies.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casebook.llm.common import SPACES, as_bytes, stored

# Fixed values of the base test.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended", "n_distinct", "n_upper", "n_lower", "n_bang",
    "n_stops", "n_symbol_words",
]
BASE_COUNTS = COUNTS[:5]
COUNTS_TYPE = StructType([StructField(name, LongType()) for name in COUNTS])

ROUNDS = 25
START_PRIOR = 0.8
START_GOOD, START_BAD = 0.95, 0.5  # how often a vote on a good, a bad document is right
GOOD_BOUNDS, BAD_BOUNDS, PRIOR_BOUNDS = (0.6, 0.999), (0.05, 0.99), (0.05, 0.95)
MIN_POSTERIOR = 0.5

_SYMBOL_WORD = re.compile(rb"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur at least twice, distinct words)."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(words) < 3:
        return 0, len(numbers)
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, window, seen = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = seen[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= again
    return int(covered.sum()), len(numbers)


def text_counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one UTF-8 text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats, distinct = repeat_words(words)
    points = len(text) - _continuation_bytes(text)
    spaces, symbols = _count(text, SPACES), _count(text, SYMBOLS)
    return (
        len(words),
        points - spaces,
        symbols,
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines),
        distinct,
        _count(text, UPPER),
        _count(text, LOWER),
        text.count(b"!"),
        _count(text, b".!?"),
        sum(1 for _ in _SYMBOL_WORD.finditer(text)) if symbols else 0,
    )


def _count(text: bytes, members: bytes) -> int:
    return len(text) - len(text.translate(None, members))


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuation_bytes(text: bytes) -> int:
    return 0 if text.isascii() else _count(text, _CONTINUATION)


@F.arrow_udf(COUNTS_TYPE)
def _counts_udf(text: pa.Array) -> pa.Array:
    rows = [text_counts(t) for t in as_bytes(text)]
    columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


def counts_of(text: Column) -> Column:
    """Struct of COUNTS; evaluated once per row (not pushed below, not repeated)."""
    return _counts_udf.asNondeterministic()(text)


def base_failed(counts: str = "counts") -> Column:
    n, repeats = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PCT * n)


# Each rule: name, condition for good, condition for bad, over COUNTS, in SQL
# that both engines read.  Without words every rule abstains.
RULES: list[tuple[str, str, str]] = [
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("symbol_chars", "200 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    ("symbol_words", "50 * n_symbol_words <= n_words", "5 * n_symbol_words > n_words"),
    ("repeats", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    ("copied_lines", "n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 9 * n_words",
     "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    ("shouting", "5 * n_upper <= n_upper + n_lower", "2 * n_upper > n_upper + n_lower"),
    ("exclamation", "20 * n_bang <= n_words", "10 * n_bang > 3 * n_words"),
    ("variety", "n_distinct * n_distinct >= 25 * n_words", "n_distinct * n_distinct < 9 * n_words"),
    ("sentences", "40 * n_stops >= n_words", "100 * n_stops < n_words"),
]
VOTES = [f"vote_{name}" for name, _, _ in RULES]


def vote_sql(good: str, bad: str) -> str:
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END"


def votes(counts: str = "counts") -> list[Column]:
    """One Column per rule, from a struct of COUNTS."""

    def vote(good: str, bad: str) -> Column:
        text = vote_sql(good, bad)
        for name in COUNTS:
            text = _named(text, name, f"{counts}.{name}")
        return F.expr(text)

    return [vote(good, bad).alias(name) for name, (_, good, bad) in zip(VOTES, RULES, strict=True)]


def _named(text: str, name: str, full: str) -> str:
    return re.sub(rf"\b{name}\b", full, text)


@dataclass(frozen=True)
class VoteModel:
    """Prior of good documents and, per rule, how often its vote is right on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, right, caught in zip(VOTES, self.on_good, self.on_bad, strict=True):
            total = total + F.when(F.col(name) == 1, math.log(right / (1 - caught))).when(
                F.col(name) == -1, math.log((1 - right) / caught)).otherwise(0.0)
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation on distinct vote patterns (rows) and how often each occurs.

    Good and bad documents have accuracies of their own: bad ones are rare and
    break few rules each, so a vote against tells far more than a vote for.
    """
    prior = START_PRIOR
    on_good, on_bad = np.full(len(VOTES), START_GOOD), np.full(len(VOTES), START_BAD)
    good, bad = patterns == 1, patterns == -1
    total = counts.sum()
    for _ in range(rounds if total else 0):
        odds = math.log(prior / (1 - prior)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        posterior = 1 / (1 + np.exp(-odds))
        as_good, as_bad = counts * posterior, counts * (1 - posterior)
        on_good = np.clip((as_good @ good + START_GOOD) / (as_good @ (good | bad) + 1), *GOOD_BOUNDS)
        on_bad = np.clip((as_bad @ bad + START_BAD) / (as_bad @ (good | bad) + 1), *BAD_BOUNDS)
        prior = float(np.clip(as_good.sum() / total, *PRIOR_BOUNDS))
    return VoteModel(prior, tuple(map(float, on_good)), tuple(map(float, on_bad)))


def train(voted: DataFrame) -> VoteModel:
    """Fit on all rows of a DataFrame with the VOTES columns (at most 3 ** 10 groups reach the driver)."""
    rows = voted.groupBy(*VOTES).agg(F.count("*").alias("_n")).collect()
    patterns = np.array([[r[v] for v in VOTES] for r in rows], np.int64).reshape(-1, len(VOTES))
    counts = np.array([r["_n"] for r in rows], np.float64)
    order = np.lexsort(patterns.T) if len(rows) else slice(None)
    return fit_votes(patterns[order], counts[order])


def judge(docs: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """doc_id, the COUNTS, base_failed, the votes, posterior and kept, for every document."""
    counted = stored(docs.select("doc_id", counts_of(F.col("text")).alias("counts")), "quality-counts")
    voted = counted.select("doc_id", "counts", base_failed().alias("base_failed"), *votes())
    model = train(voted.where(~F.col("base_failed")))
    return voted.withColumn("posterior", model.posterior()).select(
        "doc_id", "counts.*", "base_failed", *VOTES, "posterior",
        (~F.col("base_failed") & (F.col("posterior") >= min_posterior)).alias("kept"),
    )


def keep_good(docs: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The documents that `judge` keeps, with all their columns.

    Counts are made twice, so that no text is shuffled or stored.
    """
    rows = docs.select(F.struct("*").alias("row"))
    counted = rows.withColumn("counts", counts_of(F.col("row.text")))
    model = train(counted.where(~base_failed()).select(*votes()))
    kept = counted.select("row", base_failed().alias("failed"), *votes())
    return kept.where(~F.col("failed") & (model.posterior() >= min_posterior)).select("row.*")
