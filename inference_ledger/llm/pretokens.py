"""Pre-tokens of a slice of texts, cut side by side as ranges of one flat byte array.

The two kinds of public tokenizer files cut texts by a pattern over character classes. Both
patterns only look at a character, its neighbours and the ends of the text, so that all places of a
slice are decided at once by comparing shifted arrays.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, NONE = range(5)
QUOTE, BLANK = ord("'"), ord(" ")


CHUNK = 1 << 12


@functools.cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(ends, classes) of the runs of code points of one class, by the regular expressions of the
    tokenizers library itself (others follow other versions of Unicode). Takes two seconds, so that
    the driver does it once and sends the runs, a few KB, with the tasks."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        split = Split(Regex(pattern), "removed", invert=True)
        for low in range(0, 0x110000, CHUNK):
            if 0xD800 <= low < 0xE000:               # surrogates stand in no text
                continue
            every = "".join(map(chr, range(low, min(low + CHUNK, 0xD800 if low < 0xD800 else 0x110000))))
            for _, (a, b) in split.pre_tokenize_str(every):
                kinds[low + a:low + b] = kind
    ends = np.append(np.flatnonzero(np.diff(kinds)) + 1, len(kinds))
    return ends, kinds[ends - 1]


_CLASSES: list[np.ndarray] = []


def use_classes(runs: tuple[np.ndarray, np.ndarray]) -> None:
    """Take the classes that the driver sent."""
    if not _CLASSES:
        ends, kinds = runs
        _CLASSES.append(np.repeat(kinds, np.diff(ends, prepend=0)))


def char_classes() -> np.ndarray:
    """Class of every code point."""
    if not _CLASSES:
        use_classes(class_runs())
    return _CLASSES[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points, byte position of each or None where every byte is one)."""
    if not len(data) or int(data.max()) < 0x80:
        return data, None
    text = data.tobytes().decode("utf-8")
    return np.frombuffer(text.encode("utf-32-le"), "<u4"), np.flatnonzero((data & 0xC0) != 0x80)


class Cut:
    """Characters of a slice with their classes; ``first`` marks where a text begins."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.chars, self.at = code_points(data)
        n = len(self.chars)
        self.first = np.zeros(n + 3, bool)         # three beyond the end, so that neighbours can be read
        inner = bounds if self.at is None else np.searchsorted(self.at, bounds)
        self.first[inner] = True
        self.first[n:] = True
        self.kind = char_classes()[self.chars]
        first = self.first[:n]
        self.before = np.empty(n, np.uint8)
        self.before[1:] = self.kind[:-1]
        self.before[first] = NONE
        self.run = self.before != self.kind        # a run of one class begins
        self.space = self.kind == SPACE

    def contractions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(quotes of ``at`` that begin one of 's 't 'm 'd 're 've 'll, the places after them)."""
        chars = np.append(self.chars, np.zeros(3, self.chars.dtype))
        one = np.where(self.first[at + 1], 0, chars[at + 1])
        two = np.where(self.first[at + 1] | self.first[at + 2], 0, chars[at + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.int64) << 32 | two
        long = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        found = short | long
        return at[found], (at + np.where(short, 2, 3))[found]

    def byte_places(self, start: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(start)
        return at if self.at is None else self.at[at]


def byte_level(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte positions where a pre-token of byte-level BPE begins. Runs of letters, numbers or other
    characters take one blank before them; a run of white space before anything else gives up
    its last character; contractions stand alone."""
    if not len(data):
        return np.empty(0, np.int64)
    c = Cut(data, bounds)
    n = len(c.chars)
    after = np.empty(n, np.uint8)
    after[:-1] = c.kind[1:]
    after[c.first[1:n + 1]] = SPACE                # a text's end is like white space
    joined = np.zeros(n, bool)                     # the blank before it belongs to it
    joined[1:] = c.chars[:-1] == BLANK
    joined[c.first[:n]] = False
    start = c.run & (c.space | ~joined) | c.space & (after != SPACE)
    quotes, stops = c.contractions(np.flatnonzero(c.run & ~joined & (c.chars == QUOTE)))
    start[quotes + 1] = False
    start[stops[stops < n]] = True
    return c.byte_places(start)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Copy with the capitals up to U+00FF in lower case (they keep their length)."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    out[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def word_level(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte positions where a unit begins, bytes that belong to units) for tokenizers of
    lower-case words. A unit is a pre-token in lower case, or, where it holds a character
    beyond U+00FF, what stands between white space as it is (the library normalises it)."""
    if not len(data):
        return data, np.empty(0, np.int64), np.empty(0, bool)
    c = Cut(data, bounds)
    n = len(c.chars)
    lowered = lower_latin(data)
    c.chars = np.where((c.chars >= 65) & (c.chars <= 90), c.chars + 32, c.chars)
    start = (c.run | (c.kind == NUMBER)) & ~c.space
    quotes, stops = c.contractions(np.flatnonzero(c.run & (c.chars == QUOTE)))
    start[quotes + 1] = False
    stops = stops[stops < n]
    start[stops[~c.space[stops]]] = True
    keep = ~c.space
    if c.at is not None and (c.chars > 0xFF).any():
        begin = keep & ((c.before == SPACE) | (c.before == NONE))
        unit = np.cumsum(begin) - 1
        odd = np.zeros(int(begin.sum()), bool)
        odd[unit[(c.chars > 0xFF) & keep]] = True
        inside = keep & odd[np.maximum(unit, 0)]
        start = np.where(inside, begin, start)
        size = np.diff(np.append(c.at, len(data)))
        raw = np.repeat(inside, size)
        lowered[raw] = data[raw]
    if c.at is not None:
        keep = np.repeat(keep, np.diff(np.append(c.at, len(data))))
    return lowered, c.byte_places(start), keep


def distinct(data: np.ndarray, start: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct units, which of them each unit is); units lie one after another in ``data``."""
    offsets = np.append(start, len(data)).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
