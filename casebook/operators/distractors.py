"""The incidents nearest in time to a record that tell of other cases, found place by place.

The incidents of a place and some days, with those up to `max_days` before and after, meet the records
of these days in one task, after one shuffle of both.  The incidents around a moment are put in order
once, the titles of a place are compared once for each two different ones, and a record is judged
against the incidents left in this order until it has its k.  No pair is stored or shuffled.  A task
holds the incidents of one place and span, up to WHOLE_ROWS of them with WHOLE_LETTERS letters; records
pass by one after another, those of a crowded place in several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.judges import Matcher, matches_needed
from casebook.session import cut

WHOLE_ROWS = 20_000
WHOLE_LETTERS = 20_000_000
PART_ROWS = 50_000  # records of a place and span that one task reads
SHORT = 200  # letters up to which the answer for two texts is kept
MOST_VERDICTS = 10_000_000  # answers for two titles that a task keeps for a place
TITLE_RATIO = 0.7
FIRST_STEP = 16  # incidents that a title is compared with at once; then twice as many more each time
DAY = 86_400_000_000  # microseconds
RESULT = "r_id long, u_id long, gap_days int, rank int"
FOUND = pa.schema([("r_id", pa.int64()), ("u_id", pa.int64()), ("gap_days", pa.int32()), ("rank", pa.int32())])
BLOCK = ["slot", "place"]


def _slot(day: Column, max_days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01")) / (2 * max_days + 1)).cast("long")


def placed(records: DataFrame, incidents: DataFrame, max_days: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with place and slot; an incident once for each slot that its days reach."""
    known = F.col("city").isNotNull() & F.col("event_date").isNotNull()
    day = F.to_date("event_date")
    reach = F.sequence(_slot(F.date_sub(day, max_days), max_days), _slot(F.date_add(day, max_days), max_days))
    left, right = (df.where(known).withColumn("place", F.lower("city")) for df in (records, incidents))
    return left.withColumn("slot", _slot(day, max_days)), right.withColumn("slot", F.explode(reach))


def crowded(incidents: DataFrame) -> DataFrame:
    """Blocks of `placed` incidents that no task holds whole."""
    letters = F.length(F.concat_ws(" ", "summary", "title", "description"))
    sizes = incidents.groupBy(*BLOCK).agg(F.count("*").alias("_n"), F.sum(letters).alias("_letters"))
    return cut(sizes.where((F.col("_n") > WHOLE_ROWS) | (F.col("_letters") > WHOLE_LETTERS)).select(*BLOCK))


def nearest(records: DataFrame, incidents: DataFrame, folded: Callable[[Column], Column], k: int, min_days: int, max_days: int) -> DataFrame:
    """(r_id, u_id, gap_days, rank) of `placed` rows, records with ids of their own; folded: of texts."""
    parts = cut(records.groupBy(*BLOCK).agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts")).where("_parts > 1"))
    if parts.isEmpty():
        records, incidents = (df.withColumn("part", F.lit(0).cast("long")) for df in (records, incidents))
    else:  # at most one row for PART_ROWS records
        records, incidents = (df.join(F.broadcast(parts), BLOCK, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for df in (records, incidents))
        records = records.withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
        incidents = incidents.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    nothing = F.lit(None)
    given = [*BLOCK, "part"]
    moment = F.col("event_date").cast("timestamp_ntz").alias("at")
    title, told = folded(F.col("title")).alias("title"), folded(F.col("description")).alias("told")
    both = incidents.select(
        *given, F.lit(0).alias("side"), moment, F.col("id").cast("long").alias("id"), nothing.cast("long").alias("own"), title, told,
        folded(F.col("summary")).alias("summary"), nothing.cast("array<string>").alias("names"),
    ).unionByName(records.select(
        *given, F.lit(1).alias("side"), moment, F.col("id").cast("long").alias("id"), F.col("unique_event_id").cast("long").alias("own"), title, told,
        nothing.cast("string").alias("summary"), F.col("names").alias("names"),
    ))
    return both.repartition(*given).sortWithinPartitions(*given, "side", "at").mapInArrow(_worker(k, min_days, max_days), RESULT)


def _worker(k: int, min_days: int, max_days: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function over rows sorted by block and part, incidents before records, both by time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = None, Place(k, min_days, max_days)
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for key, side, rows in _stretches(batch):
                if key != current:
                    current, place = key, Place(k, min_days, max_days)
                if side == 0:
                    place.add(rows)
                else:
                    place.judge(rows, out)
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return run


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Runs of rows of one block, part and side, with these."""
    if not batch.num_rows:
        return
    slot, part, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "part", "side"))
    names = batch.column("place").dictionary_encode()
    place = names.indices.to_numpy(zero_copy_only=False)
    new = np.zeros(len(slot), bool)
    new[0] = True
    for column in (slot, place, part, side):
        new[1:] |= column[1:] != column[:-1]
    edges = [*np.flatnonzero(new).tolist(), len(slot)]
    for a, b in zip(edges, edges[1:]):
        yield (int(slot[a]), names.dictionary[int(place[a])].as_py(), int(part[a])), int(side[a]), batch.slice(a, b - a)


@dataclass
class Walk:
    """How far the order of a moment was looked through for a title."""

    unlike: list[int] = field(default_factory=list)  # incidents of other titles so far
    at: int = 0
    step: int = FIRST_STEP


class Place:
    """The incidents of a block and the records judged against them, one moment after another."""

    def __init__(self, k: int, min_days: int, max_days: int) -> None:
        self.k, self.min_days, self.max_days = k, min_days, max_days
        self.batches: list[pa.RecordBatch] = []
        self.ready = False

    def add(self, rows: pa.RecordBatch) -> None:
        self.batches.append(rows)

    def _prepare(self) -> None:
        rows = pa.Table.from_batches(self.batches) if self.batches else None
        column = lambda c: rows.column(c).to_pylist() if rows else []
        self.at = rows.column("at").cast(pa.int64()).to_numpy() if rows else np.zeros(0, np.int64)
        self.day, self.ids = self.at // DAY, np.array(column("id"), np.int64)
        self.id_of, self.told = self.ids.tolist(), column("told")
        code: dict[str, int] = {}
        titles, summaries = column("title"), column("summary")
        self.code = np.array([code.setdefault(t, len(code)) for t in titles], np.int64)
        self.titles = list(code)
        self.whole = [joined(s, t, d) for s, t, d in zip(summaries, titles, self.told, strict=True)]
        self.heads = [pairs_of(words(s.split(",", 1)[0])) for s in summaries]
        self.verdicts: dict[str, np.ndarray] = {}
        self.batches, self.ready = [], True
        self.moment, self.order, self.walks = None, np.zeros(0, np.int64), {}

    def judge(self, rows: pa.RecordBatch, out: list[tuple[int, int, int, int]]) -> None:
        if not self.ready:
            self._prepare()
        if not self.id_of:
            return
        moments = rows.column("at").cast(pa.int64()).to_pylist()
        rest = [rows.column(c).to_pylist() for c in ("id", "own", "title", "told", "names")]
        for at, own_id, own, title, told, names in zip(moments, *rest, strict=True):
            if at != self.moment:
                self.moment, self.order, self.walks = at, self._around(at), {}
            walk = self.walks.get(title)
            if walk is None:
                walk = self.walks[title] = Walk()
            found, whole, i = 0, None, 0
            while found < self.k:
                if i == len(walk.unlike):
                    if walk.at >= len(self.order):
                        break
                    self._look_on(title, walk)
                    continue
                at_u = walk.unlike[i]
                i += 1
                if self.id_of[at_u] == own:
                    continue
                if whole is None:
                    whole = joined(title, told)
                if self._other(at_u, told, whole, names):
                    found += 1
                    out.append((own_id, self.id_of[at_u], abs(int(self.day[at_u]) - at // DAY), found))

    def _around(self, at: int) -> np.ndarray:
        """The incidents near a moment, by nearness and id."""
        reach = self.max_days * DAY
        low, high = np.searchsorted(self.at, at - reach, "left"), np.searchsorted(self.at, at + reach, "right")
        gap = np.abs(self.day[low:high] - at // DAY)
        order = np.lexsort((self.ids[low:high], gap))
        return low + order[gap[order] >= self.min_days]

    def _look_on(self, title: str, walk: Walk) -> None:
        """Takes the next incidents of the order whose title is unlike this one."""
        part = self.order[walk.at : walk.at + walk.step]
        walk.at, walk.step = walk.at + len(part), 2 * walk.step
        known = self.verdicts.get(title)
        if known is None:
            if (len(self.verdicts) + 1) * len(self.titles) > MOST_VERDICTS:
                self.verdicts.clear()
            known = self.verdicts[title] = np.full(len(self.titles), -1, np.int8)
        codes = self.code[part]
        for c in set(codes[known[codes] < 0].tolist()):
            known[c] = not same_title(title, self.titles[c])
        walk.unlike.extend(part[known[codes] == 1].tolist())

    def _other(self, at: int, told: str, whole: str, names: list | None) -> bool:
        """Whether names and descriptions tell of another case."""
        around = self.whole[at]
        if any(named(name, around) for name in names or () if name) or any(p in whole for p in self.heads[at]):
            return False
        return not (told and self.told[at] and reaches(told, self.told[at], fixed.DESCRIPTION_RATIO))


def joined(*texts: str) -> str:
    """Folded texts after one another, as their joint text is folded."""
    return " ".join(t for t in texts if t)


def words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def pairs_of(parts: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(parts, parts[1:])]


def named(name: str, text: str) -> bool:
    """Whether a text holds a name, two words of it in a row, or its first and its last word."""
    if name in text:
        return True
    parts = words(name)
    return len(parts) >= 2 and (any(p in text for p in pairs_of(parts)) or (parts[0] in text and parts[-1] in text))


def same_title(a: str, b: str) -> bool:
    return bool(a and b) and (a in b or b in a or reaches(a, b, TITLE_RATIO))


def reaches(a: str, b: str, threshold: float) -> bool:
    return (_reaches_again if max(len(a), len(b)) <= SHORT else _reaches)(a, b, threshold)


def _reaches(a: str, b: str, threshold: float) -> bool:
    need = matches_needed(len(a) + len(b), threshold)
    if min(len(a), len(b)) < need or sum(min(a.count(c), b.count(c)) for c in set(a)) < need:
        return False
    return Matcher(b).reaches(a, need)


_reaches_again = lru_cache(maxsize=100_000)(_reaches)
