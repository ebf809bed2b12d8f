"""Pure-Python pair tests that run inside tasks (no Spark objects)."""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

MOST_BITS = 1 << 23  # of the number of equal places of two texts


def ratio(a: str, b: str) -> float:
    """2M/T over matching blocks, on all letters whatever the length of the texts."""
    joint = len(a) + len(b)
    return 2.0 * Matcher(b).matches(a) / joint if joint else 1.0


def matches_needed(joint: int, threshold: float) -> int:
    """The least M for which 2M / joint, as computed, reaches the threshold."""
    need = max(0, math.ceil(threshold * joint / 2) - 1)
    while joint and 2.0 * need / joint < threshold:
        need += 1
    return need


class Matcher:
    """Tests of many first texts against one second text, with the matching blocks of `difflib.SequenceMatcher`.

    The places where both texts hold the same letter are the bits of one number, a row for each letter of the
    first text.  A block is a diagonal run of bits, so the runs of 2n letters are those of n letters and a shifted
    copy of them, and the lowest bit of the longest runs is the block that starts earliest in the first text, then in
    the second.  Pairs of long texts, whose number would be large, go through `SequenceMatcher` itself.
    """

    def __init__(self, second: str) -> None:
        self.second, self.length = second, len(second)
        self.bytes = len(second) // 8 + 1  # of a row; its last bit stays free, so that no run goes on in the next row
        self.width = 8 * self.bytes
        places: dict[str, int] = {}
        for j, letter in enumerate(second):
            places[letter] = places.get(letter, 0) | 1 << j
        self.rows = {letter: at.to_bytes(self.bytes, "little") for letter, at in places.items()}
        self.none = bytes(self.bytes)

    def reaches(self, first: str, need: int) -> bool:
        """Whether the matching blocks hold `need` letters; stops once that is sure or out of reach."""
        return min(len(first), self.length) >= need and self._found(first, need) >= need

    def matches(self, first: str) -> int:
        """The letters of all matching blocks."""
        return self._found(first, None)

    def _found(self, first: str, need: int | None) -> int:
        longest = self._longest_of(first)
        found, possible = 0, min(len(first), self.length)
        open_ = [(0, len(first), 0, self.length)]
        while open_ and (need is None or found < need <= found + possible):
            alo, ahi, blo, bhi = open_.pop()
            possible -= min(ahi - alo, bhi - blo)
            i, j, size = longest(alo, ahi, blo, bhi)
            if size:
                found += size
                sides = [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
                sides = [s for s in sides if s[0] < s[1] and s[2] < s[3]]
                possible += sum(min(s[1] - s[0], s[3] - s[2]) for s in sides)
                open_ += sorted(sides, key=lambda s: min(s[1] - s[0], s[3] - s[2]))
        return found

    def _longest_of(self, first: str) -> Callable[[int, int, int, int], tuple[int, int, int]]:
        """The longest common block of a part of the first text and a part of the second, as (start, start, size)."""
        width = self.width
        if len(first) * width > MOST_BITS:
            return SequenceMatcher(None, first, self.second, autojunk=False).find_longest_match
        get, none = self.rows.get, self.none
        same = int.from_bytes(b"".join([get(letter, none) for letter in first]), "little")

        def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
            part = same if alo == 0 else same >> alo * width
            if blo > 0 or bhi < self.length:
                column = ((1 << bhi) - (1 << blo)).to_bytes(self.bytes, "little")
                part &= int.from_bytes(column * (ahi - alo), "little")
            elif ahi < len(first):
                part &= (1 << (ahi - alo) * width) - 1
            if not part:
                return alo, blo, 0
            runs, size = [part], 1  # starts of runs of 1, 2, 4, ... letters
            while longer := runs[-1] & runs[-1] >> size * (width + 1):
                runs.append(longer)
                size *= 2
            best = runs.pop()
            while runs:
                shorter = runs.pop()
                if longer := best & shorter >> size * (width + 1):
                    best = longer
                    size += 1 << len(runs)
            i, j = divmod((best & -best).bit_length() - 1, width)
            return alo + i, j, size

        return longest


def reaches(a: str, b: str, threshold: float) -> bool:
    """ratio(a, b) >= threshold."""
    return Matcher(b).reaches(a, matches_needed(len(a) + len(b), threshold)) if a or b else threshold <= 1.0
