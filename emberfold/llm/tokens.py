"""Token ids of whole texts, by a public tokenizer, each distinct piece of text encoded once.

A byte-level tokenizer without prefix space never joins characters across the place where white space
begins after other characters, nor across a letter and a sign. There texts are cut into pieces, equal
pieces are found by Arrow, and the tokenizer encodes those it has not seen yet. A tokenizer of another
kind encodes every text as a whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: What a generation of pieces holds at most.
KNOWN_PIECES = 500_000
KNOWN_SIZE = 12_000_000  # characters and ids
LEARNED = 4096  # pieces given to the tokenizer at once

#: Kinds of bytes. The last bytes of white-space characters beyond ASCII, and of others, are UNSURE: no text
#: is cut behind these. Signs are the ASCII characters that are no letter, digit or white space, but for the
#: apostrophe, which starts contractions, and for those that spell special tokens.
OTHER, SPACE, UNSURE, LETTER, SIGN = range(5)
KINDS = np.zeros(256, np.uint8)
KINDS[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = UNSURE
KINDS[[*range(9, 14), 32]] = SPACE
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^`{}~"]] = SIGN
#: Letters below this are letters in every version of Unicode.
LATIN = "\u0250"
#: The first byte of U+00C0 to U+00FF, and the second bytes of the two among them that are no letters.
ACCENTED, TIMES, DIVIDED = 0xC3, 0x97, 0xB7


def cuts_at_spaces(settings: str) -> bool:
    """Whether a tokenizer, given as JSON, treats pieces as described above."""
    parts = json.loads(settings)
    before = parts.get("pre_tokenizer") or {}
    plain = all(not a.get(k) for a in parts.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word"))
    spaceless = all(not any(c.isspace() for c in a["content"]) for a in parts.get("added_tokens", ()))
    signs = "".join(a["content"] for a in parts.get("added_tokens", ()))
    plain = plain and all(KINDS[b] != SIGN for b in signs.encode())
    return (before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and parts.get("normalizer") is None and parts["model"].get("dropout") is None and plain and spaceless)


class Pieces:
    """Ids of pieces of text that were seen, as long as they fit."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.used = self.held = 0

    def full(self) -> bool:
        return len(self.known) > KNOWN_PIECES or self.held > KNOWN_SIZE

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Pieces, their ids one after the other, and how many each has."""
        first, count, total = len(self.known), len(pieces), len(ids)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + count > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.ids[self.used : self.used + total] = ids
        self.starts[first : first + count] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + count] = sizes
        self.used += total
        self.held += total + sum(map(len, pieces))
        self.known.update(zip(pieces, range(first, first + count)))

    def places(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, one after the other, and how many each has."""
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        source = np.repeat(self.starts[place] - ends + sizes, sizes)
        source += np.arange(len(source))
        return self.ids[source], sizes


class Tokens:
    """Encodes texts; `settings` is the tokenizer's JSON.

    What was seen lives in two generations: pieces of the older one that come again move to the younger,
    which takes the other's place when it is full.
    """

    def __init__(self, settings: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(settings)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = cuts_at_spaces(settings)
        self.young, self.old = Pieces(), Pieces()

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of pieces that are not among the younger ones."""
        known = self.old.known
        again = [piece for piece in pieces if piece in known]
        if again:
            self.young.add(again, *self.old.of(self.old.places(again)))
            pieces = [piece for piece in pieces if piece not in known]
        words, others = [], []
        for piece in pieces:
            word = piece.removeprefix(" ").isalpha() and (piece.isascii() or max(piece) < LATIN)
            (words if word else others).append(piece)
        # One word is one unit of the pre-tokenizer, so the model itself can take it. No list is kept for
        # a word, as the garbage collector would walk through all of them again and again.
        ids, sizes, tokenize = [], [], self.tokenizer.model.tokenize
        for word in spelled_words(words):
            found = [token.id for token in tokenize(word)]
            ids += found
            sizes.append(len(found))
        self.young.add(words, np.array(ids, np.int32), np.array(sizes, np.int64))
        for start in range(0, len(others), LEARNED):
            some = others[start : start + LEARNED]
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.young.add(some, np.concatenate(found), np.array([len(f) for f in found], np.int64))

    def encode(self, bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between consecutive `bounds` of `data`, one after the other, and their numbers."""
        if not self.by_piece:
            body = data.tobytes()
            texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return (np.concatenate([np.array(f, np.int32) for f in found] or [np.zeros(0, np.int32)]),
                    np.array([len(f) for f in found], np.int64))
        if self.young.full():
            self.young, self.old = Pieces(), self.young
        at = cuts(bounds, data)
        pieces = pa.LargeStringArray.from_buffers(max(len(at) - 1, 0), pa.py_buffer(at), pa.py_buffer(data))
        distinct = pieces.dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        young = self.young
        self._learn([w for w in words if w not in young.known])
        ids, sizes = young.of(young.places(words)[distinct.indices.to_numpy()])
        before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, bounds)]
        return ids, np.diff(before)


def _signs() -> list[str]:
    """The sign that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    free = itertools.count(256)
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else chr(next(free)) for b in range(256)]


SIGNS = dict(enumerate(_signs()))
SPELLED = np.array([ord(sign) for sign in SIGNS.values()], "<u2")


def spelled(piece: str) -> str:
    """A piece as the byte-level model reads it."""
    return SPELLED.take(np.frombuffer(piece.encode(), np.uint8)).tobytes().decode("utf-16-le")


def spelled_words(words: list[str]) -> list[str]:
    """Words as the byte-level model reads them; none has a line end."""
    return spelled("\n".join(words)).split(SIGNS[ord("\n")]) if words else []


def cuts(bounds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where pieces begin, and the end of `data`: at texts, at white space, and where words meet signs."""
    kinds = KINDS.take(data)
    accented = np.flatnonzero(data[:-1] == ACCENTED)
    second = data[accented + 1]
    accented = accented[(second != TIMES) & (second != DIVIDED)]
    kinds[accented] = kinds[accented + 1] = LETTER
    before, after = kinds[:-1], kinds[1:]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (after == SPACE) & (before != SPACE) & (before != UNSURE)
    begins[1:-1] |= (before == LETTER) & (after == SIGN)
    begins[1:-1] |= (before == SIGN) & (after == LETTER)
    # A single line end or tab is a piece of its own; a longer run is read with what follows.
    alone = (before == SPACE) & (data[:-1] != 32) & ((after == LETTER) | (after == SIGN))
    alone[1:] &= begins[1:-2]
    begins[1:-1] |= alone
    begins[bounds] = True
    return np.flatnonzero(begins)


@functools.lru_cache(1)
def shared(settings: str) -> Tokens:
    """The encoder of this process: workers that are used again keep what they have seen."""
    return Tokens(settings)
