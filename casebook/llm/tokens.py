"""Subword ids of whole texts, through a cache of words.

No id spans white space, so a text's ids are those of its words one after
another.  The ids of words met before are kept.  Of new words, those of letters
only go through a byte-pair encoder that holds the vocabulary as ranks, which is
several times faster and gives the same ids; the others go through the
vocabulary's own tokenizer.
"""

from __future__ import annotations

import base64
import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

from casebook.llm.common import as_bytes

SEPARATOR = "<|startoftext|>"
CACHE_WORDS = 600_000  # of either half of a cache in two halves
FEW_CACHE_WORDS = 250_000  # the same where more must fit beside it
CALL_WORDS = 20_000  # words encoded in one call
MARKS = frozenset(".,!?;:")
LATIN_END, DOTTED_I = "\u0180", "\u0130"
WORD_END = "\0"  # stands for a word's end where words hold letters only


class WordTokenizer:
    """Encoder of a word-level cached vocabulary; ids are little-endian unsigned 32-bit."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        ranks = letter_ranks(vocabulary)
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in MARKS}
        self.letters = ranks and tiktoken.Encoding("letters", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def encode(self, texts: pa.Array) -> list[bytes]:
        return self.encode_bytes(as_bytes(texts))

    def encode_bytes(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for text in texts:
            words, cache = text.split(), self.cache
            try:
                out.append(b"".join([cache[w] for w in words]))
            except KeyError:
                self._learn({w for w in words if w not in cache})
                out.append(b"".join([cache[w] for w in words]))
                if len(cache) > self.cache_words:  # frequent words come back from the older half
                    self.cache, self.older = {}, cache
        return out

    def _known(self, word: bytes) -> bytes | None:
        if (ids := self.cache.get(word)) is None and (ids := self.older.get(word)) is not None:
            self.cache[word] = ids
        return ids

    def _learn(self, words: set[bytes]) -> None:
        cache, older, letters, others = self.cache, self.older, self.letters, []
        for word in words:
            if (ids := older.get(word)) is not None:
                cache[word] = ids
            elif letters is not None and (plain := _letters(word)):
                body, mark = plain
                ids = letters.encode_ordinary(body + WORD_END)
                if mark:
                    ids += self.marks[mark]
                cache[word] = array("I", ids).tobytes()
            else:
                others.append(word)
        for at in range(0, len(others), CALL_WORDS):
            self._encode(others[at : at + CALL_WORDS])

    def _encode(self, words: list[bytes]) -> None:
        separator = SEPARATOR.encode()
        plain = []
        for w in words:
            if separator in w:
                self.cache[w] = self._ids(w.decode())
            else:
                plain.append(w)
        ids = np.frombuffer(self._ids(separator.join(plain).decode()), "<u4")
        cuts = np.flatnonzero(ids == self.separator)
        raw = ids.tobytes()
        starts = np.concatenate(([0], cuts + 1)) * 4
        ends = np.concatenate((cuts, [len(ids)])) * 4
        self.cache.update(zip(plain, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=False))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _letters(word: bytes) -> tuple[str, str] | None:
    """(letters in lower case, mark behind them or none) of a word of Latin letters, else None.

    The vocabulary ignores case, and a mark behind a letter is always an id of
    its own.  Beyond extended Latin, case and composition have rules of their
    own, so such words are left to the vocabulary's tokenizer.
    """
    text, mark = word.decode(), ""
    if text[-1] in MARKS:
        text, mark = text[:-1], text[-1]
    if not text.isalpha() or not word.isascii() and (max(text) >= LATIN_END or DOTTED_I in text):
        return None
    return text.lower(), mark


def letter_ranks(vocabulary: str) -> dict[bytes, int] | None:
    """Ids by bytes, a word's end written as WORD_END, if lower ids always merge first.

    Such a vocabulary needs no merge list: joining the pair with the lowest id
    first gives the same ids.  None for any other vocabulary.
    """
    with open(vocabulary) as source:
        model = json.load(source)["model"]
    ids, end = model["vocab"], model.get("end_of_word_suffix")
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if not end or [ids[m] for m in joined] != list(range(len(ids) - len(joined), len(ids))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that byte-level vocabularies write as they are
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {
        bytes(byte_of[c] for c in token.removesuffix(end)) + WORD_END.encode() * token.endswith(end): i
        for token, i in ids.items()
    }


class ByteTokenizer:
    """Byte-level ids of words, each taken with a space before it; the id after the last is free for an end mark."""

    def __init__(self, vocabulary: str, cache_words: int = FEW_CACHE_WORDS):
        import public_tokenizers

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.size = len(ranks) + 1
        self.starts_word = [0] * self.size
        for piece, rank in ranks.items():
            self.starts_word[rank] = int(piece.startswith(b" "))
        self.starts_word[self.end] = 1
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def encode_word(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode())

    def encode_words(self, words: list[bytes]) -> bytes:
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            for w in words:
                if w not in cache:
                    cache[w] = self.older.get(w) or array("I", self.encode_word(w)).tobytes()
            ids = b"".join([cache[w] for w in words])
            if len(cache) > self.cache_words:  # frequent words come back from the older half
                self.cache, self.older = {}, cache
            return ids


@lru_cache
def shared_tokenizer(kind: type, vocabulary: str) -> WordTokenizer | ByteTokenizer:
    """One tokenizer per process, so that the tasks of a worker share what it has learnt."""
    return kind(vocabulary)
