"""Hierarchical multi-length packing of token sequences.

Documents are routed to context tiers by length: as many whole windows of the
longest tier as they fill, and the rest to the shortest tier that holds it.
Tiers are packed from the longest down.  A rest opens a window of its tier; the
gap behind it is filled with the longest piece of a shorter tier that fits,
again and again, and at the end with the head of a longer piece, whose tail goes
back to its tier.  A window that nothing is left to fill is cut at the next
shorter length: its head is then a full window there, and its tail moves down.
The shortest tier runs its pieces together.  So every window is full and its
length is a power of two, except one tail per task.  Full windows are dealt to
step groups of equal tokens, by attention cost in serpentine order, so that
groups also do equal work.

Each task packs the documents of its own partition in bounded pools and hands
what is left in the pools to the next pool; nothing is shuffled, nothing grows
with the table, and a lost task is redone alone.  Sequence ids are the task's
number in the high bits and a running number.

Defined cases: null text is empty and is packed as the end mark alone; a null
id is carried as null; repeated rows are packed each; an empty table or task
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.tokens import WordTokenizer, shared_tokenizer
from casebook.session import apply_settings

TIERS = (256, 512, 1024, 2048)
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
POOL_TOKENS = 2_000_000  # documents packed together
STEP_TOKENS = 32_768  # tokens of a step group
TASK_BITS = 33  # running numbers below the task's number

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int32()), ("step_group", pa.int64()),
])
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Piece:
    """`length` ids of document `doc` from `start`."""

    __slots__ = ("doc", "start", "length")

    def __init__(self, doc: Document, start: int, length: int):
        self.doc, self.start, self.length = doc, start, length

    def split(self, head: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, head), Piece(self.doc, self.start + head, self.length - head)


class Document:
    __slots__ = ("doc_id", "ids", "tokens")

    def __init__(self, doc_id: int | None, ids: bytes):
        self.doc_id, self.ids, self.tokens = doc_id, ids, len(ids) // 4


class Shelf:
    """Pieces by length, with a bit set of the lengths at hand."""

    def __init__(self, longest: int):
        self.by_length: list[list[Piece]] = [[] for _ in range(longest + 1)]
        self.lengths = 0

    def put(self, piece: Piece) -> None:
        self.by_length[piece.length].append(piece)
        self.lengths |= 1 << piece.length

    def take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            self.lengths ^= 1 << length
        return piece

    def longest_up_to(self, bound: int) -> int:
        """0 if there is none."""
        return max(0, (self.lengths & ((1 << (bound + 1)) - 1)).bit_length() - 1)

    def shortest_from(self, bound: int, below: int) -> int:
        """The shortest length of at least `bound` and at most `below`, 0 if there is none."""
        found = (self.lengths & ((1 << (below + 1)) - 1)) >> bound
        return (found & -found).bit_length() - 1 + bound if found else 0


class Packer:
    """Packs pools of documents; `windows` collects (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.shelf = Shelf(tiers[-1])
        self.windows: list[tuple[int, list[Piece]]] = []
        self.tail: list[Piece] = []  # unfinished window of the shortest tier

    def add(self, doc: Document) -> None:
        longest, at = self.tiers[-1], 0
        while doc.tokens - at >= longest:
            self.windows.append((longest, [Piece(doc, at, longest)]))
            at += longest
        if at < doc.tokens:
            self.shelf.put(Piece(doc, at, doc.tokens - at))

    def pack(self) -> None:
        """Pack all pieces on the shelf but an unfinished shortest window."""
        for tier, shorter in zip(self.tiers[:0:-1], self.tiers[-2::-1], strict=True):
            while (length := self.shelf.longest_up_to(tier)) > shorter:
                self._open(tier, shorter, self.shelf.take(length))
        self._run_together(self.tiers[0])

    def _open(self, tier: int, shorter: int, piece: Piece) -> None:
        window, gap = [piece], tier - piece.length
        while gap and (length := self.shelf.longest_up_to(min(gap, shorter))):
            window.append(self.shelf.take(length))
            gap -= length
        if gap and (length := self.shelf.shortest_from(gap + 1, shorter)):
            head, rest = self.shelf.take(length).split(gap)
            window.append(head)
            self.shelf.put(rest)
            gap = 0
        if not gap:
            self.windows.append((tier, window))
            return
        for extra in window[1:]:
            self.shelf.put(extra)
        head, rest = piece.split(shorter)
        self.windows.append((shorter, [head]))
        self.shelf.put(rest)

    def _run_together(self, tier: int) -> None:
        room = tier - sum(p.length for p in self.tail)
        while length := self.shelf.longest_up_to(tier):
            fits = self.shelf.longest_up_to(room)
            piece = self.shelf.take(fits or length)
            if piece.length > room:
                piece, rest = piece.split(room)
                self.shelf.put(rest)
            self.tail.append(piece)
            room -= piece.length
            if not room:
                self.windows.append((tier, self.tail))
                self.tail, room = [], tier

    def close(self) -> None:
        if self.tail:
            self.windows.append((self.tiers[-1], self.tail))
            self.tail = []

    def take_windows(self) -> list[tuple[int, list[Piece]]]:
        windows, self.windows = self.windows, []
        return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number per window: equal tokens within one window of a tier, balanced attention cost."""
    groups, used = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: -sum(p.length * p.length for p in windows[i][1]))
        count = max(1, round(len(own) * tier / step_tokens))
        for rank, i in enumerate(own):
            turn, at = divmod(rank, count)
            groups[i] = used + (count - 1 - at if turn % 2 else at)
        used += count
    return groups


def _rows(windows: list[tuple[int, list[Piece]]], first_sequence: int, first_group: int) -> pa.RecordBatch:
    groups = step_groups(windows)
    columns: list[list] = [[] for _ in SCHEMA]
    for number, ((tier, pieces), group) in enumerate(zip(windows, groups, strict=True)):
        offset = 0
        for p in pieces:
            ids = memoryview(p.doc.ids)[4 * p.start : 4 * (p.start + p.length)]
            for column, value in zip(columns, (
                p.doc.doc_id, p.start, p.length, zlib.crc32(ids), p.doc.tokens,
                first_sequence + number, offset, tier, first_group + group,
            ), strict=True):
                column.append(value)
            offset += p.length
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def _pack_task(batches: Iterator[pa.RecordBatch], vocabulary: str, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    tokenizer = shared_tokenizer(WordTokenizer, vocabulary)
    end = np.array([END_ID], "<u4").tobytes()
    first = TaskContext.get().partitionId() << TASK_BITS
    packer, tokens, sequences, groups = Packer(tiers), 0, first, first

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal tokens, sequences, groups
        tokens = 0
        if windows := packer.take_windows():
            rows = _rows(windows, sequences, groups)
            sequences += len(windows)
            groups += len(windows)
            yield rows

    for batch in batches:
        ids = tokenizer.encode(batch.column("text"))
        for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
            doc = Document(doc_id, own + end)
            packer.add(doc)
            tokens += doc.tokens
            if tokens >= POOL_TOKENS:
                packer.pack()
                yield from emit()
    packer.pack()
    packer.close()
    yield from emit()


def pack(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    apply_settings(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(partial(_pack_task, vocabulary=vocabulary, tiers=tiers), COLUMNS)
