"""Token ids by a public tokenizer file, with a memory of what was met before.

``Encoder.encode_column`` equals encoding every whole text with the tokenizers
library, ``encode(text, add_special_tokens=False)``: the file's added tokens
(``<|endoftext|>``) are one id wherever a text spells them. A whole slice of texts is cut at once into
the tokenizer's own pre-tokens (``pretokens``), its distinct pre-tokens are looked up once in a
bounded dictionary, and the library encodes those not met before, many to a call.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import pretokens
from .columns import flat_bytes, ranges_within, slices
from .worker import kept

WORDS_KEPT = 400_000    # entries the dictionary takes (about 60 MB)
STALE_MISSES = 4_000_000   # misses of a full dictionary after which it starts anew
SEEN_SLOTS = 1 << 22    # in a half full dictionary a unit is kept from the second time on (one byte per slot)
SLICE = 2 << 20         # bytes of text handled at once
PER_CALL = 4096         # units of one call of the library
_SAFE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")     # every tokenizer here cuts at it, before the blank


class Encoder:
    """One per worker process and tokenizer file (see ``encoder``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        if hasattr(self.lib.model, "_resize_cache"):
            self.lib.model._resize_cache(0)      # only units that are new come here
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = bool(spec.get("normalizer"))
        size = self.lib.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        #: byte-level: ids of tokens that begin with a blank; word-level: of tokens that end a word
        self.edge = np.zeros(size, bool)
        for token, k in spec["model"]["vocab"].items():
            self.edge[k] = token.endswith("</w>") if self.lower else token.startswith("Ġ")
        self.line = self.lib.token_to_id("Ċ")
        added = spec.get("added_tokens") or []
        self.added = {t["content"].encode(): np.array([t["id"]], self.kind).tobytes() for t in added}
        # the longest of two that start together, as the library takes them
        self.at_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        # others than these (none in the public files) are met only after normalising, or take blanks with them
        self.plain = all(re.search(r"[a-z][^a-z]|[^a-z][a-z]", t["content"]) and not re.search(r"[\sA-Z]", t["content"])
                         and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        self.words: dict[bytes, bytes] = {}
        self.seen = bytearray(SEEN_SLOTS)
        self.misses = 0

    # ------------------------------------------------------------ the library

    def _single(self, units: list[bytes]) -> list[bytes]:
        """Ids of units by the library, one text each."""
        return [np.array(e.ids, self.kind).tobytes() for e in
                self.lib.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]

    def _joined(self, units: list[bytes], between: bytes) -> list[bytes]:
        """Ids of units that the tokenizer keeps apart when they follow each other in one text."""
        out: list[bytes] = []
        for k in range(0, len(units), PER_CALL):
            some = units[k:k + PER_CALL]
            text = between.join(some) if self.lower else between + between.join(some)
            ids = np.array(self.lib.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.kind)
            if self.lower:
                ends = np.flatnonzero(self.edge[ids]) + 1
                begins = np.append(0, ends[:-1])
            elif between:
                begins = np.flatnonzero(ids == self.line) + 1
                ends = np.append(begins[1:] - 1, len(ids))
            else:
                begins = np.flatnonzero(self.edge[ids])
                ends = np.append(begins[1:], len(ids))
            out += [ids[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())] \
                if len(begins) == len(some) else self._single(some)
        return out

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Ids of units not met before."""
        found: dict[bytes, bytes] = {}
        if self.lower:
            many, alone = [], []
            for u in units:
                (many if max(u) < 0xC4 else alone).append(u)        # lead bytes up to U+00FF
            groups = [(many, b" ")]
        else:
            blank, other, alone = [], [], []
            for u in units:
                text = u[1:] if u[:1] == b" " else u
                (alone if not text or text.isspace() or text.decode()[0].isspace()
                 else other if text is u else blank).append(u)
            groups = [(blank, b""), (other, b"\n")]
        for some, between in groups:
            if some:
                found.update(zip(some, self._joined(some, between)))
        if alone:
            found.update(zip(alone, self._single(alone)))
        return [found[u] for u in units]

    # ------------------------------------------------------------ the dictionary

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        words, seen = self.words, self.seen
        if len(words) >= WORDS_KEPT:
            self.misses += len(missing)
            if self.misses > STALE_MISSES:        # other text than it was filled from
                words.clear()
                self.misses = 0
        ids = self.ids_of(missing)
        for u, x in zip(missing, ids):
            if len(words) >= WORDS_KEPT:
                break
            if len(words) < WORDS_KEPT // 2:
                words[u] = x
                continue
            slot = hash(u) % SEEN_SLOTS
            if seen[slot]:
                words[u] = x
            else:
                seen[slot] = 1
        return ids

    def _lookup(self, units: list[bytes]) -> list[bytes]:
        found = list(map(self.words.get, units))
        where = [k for k, x in enumerate(found) if x is None]
        if where:
            for k, x in zip(where, self._learn([units[k] for k in where])):
                found[k] = x
        return found

    # ------------------------------------------------------------ texts

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, offsets of each text's ids); null is empty."""
        if not self.plain:
            ids = [np.array(self.lib.encode(t or "", add_special_tokens=False).ids, "<u4") for t in column.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])
        data, offsets = flat_bytes(column)
        parts = self._safe_parts(data, offsets)
        if len(parts) == 2:
            return self._encode_flat(data, offsets)
        got = [self._encode_flat(data[a:b], np.array([0, b - a])) for a, b in zip(parts, parts[1:])]
        n = np.append(0, np.cumsum([len(ids) for ids, _ in got]))
        return np.concatenate([ids for ids, _ in got]), n[np.searchsorted(parts, offsets)]

    @staticmethod
    def _safe_parts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """[0, ..., length]: a slice, or the parts of a text longer than two slices."""
        if len(data) <= 2 * SLICE:
            return [0, len(data)]
        parts = {0, len(data), *offsets.tolist()}
        at = SLICE
        while (m := _SAFE_CUT.search(data, at)) is not None:
            parts.add(m.start())
            at = m.start() + SLICE
        return sorted(parts)

    def _encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = [m.span() for m in self.at_added.finditer(data)] if self.added else []
        if marks:
            a, b = np.array(marks).T
            whole = np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left")
            marks = np.stack([a[whole], b[whole]], axis=1)     # those that lie in one text
        bounds = np.unique(np.concatenate([offsets, *np.array(marks, np.int64).reshape(-1, 2).T]))
        bounds = bounds[bounds < len(data)]
        if self.lower:
            data, start, keep = pretokens.word_level(data, bounds)
        else:
            start, keep = pretokens.byte_level(data, bounds), None
        if len(marks):       # an added token is one unit
            drop = np.searchsorted(marks[:, 0], start, "left") - 1
            start = start[(drop < 0) | (start >= marks[np.maximum(drop, 0), 1]) | (start == marks[np.maximum(drop, 0), 0])]
        per_text = np.searchsorted(start, offsets)
        if keep is not None:
            start = np.append(0, np.cumsum(keep))[start] if len(start) else start
            data = data[keep]
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(offsets), np.int64)
        units, which = pretokens.distinct(data, start)
        if len(marks):
            self.words.update(self.added)
        found = self._lookup(units)
        n = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        begin, count = (np.cumsum(n) - n)[which], n[which]
        ids = flat[np.repeat(begin, count) + ranges_within(count)].astype("<u4")
        return ids, np.append(0, np.cumsum(count))[per_text]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one whole text (null: empty) as little-endian uint32."""
        return self.encode_column(pa.array([text], pa.string()))[0]


def encoder(path: str, classes=None) -> Encoder:
    """The worker process's encoder for this file (kept between tasks); ``classes`` are the driver's ``class_runs()``."""
    if classes is not None:
        pretokens.use_classes(classes)
    return kept(("encoder", path), lambda: Encoder(path))


def encoded(batches, enc: Encoder, end_id: int | None = None, name: str = "text") -> Iterator[tuple]:
    """(part of a batch, its texts' ids as uint32, their offsets) for every Arrow batch; ``end_id``
    follows the ids of every text."""
    for batch in batches:
        for part in slices(batch, name, SLICE):
            ids, offsets = enc.encode_column(part.column(part.schema.get_field_index(name)))
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            yield part, ids, offsets


def texts(batches, name: str = "text"):
    """(batch of a few MB, its texts as Python strings) for every Arrow batch."""
    for batch in batches:
        for part in slices(batch, name):
            yield part, part.column(part.schema.get_field_index(name)).to_pylist()


def id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column of each text's ids, little-endian uint32."""
    at = offsets * 4
    if int(at[-1]) < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [
            None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [
        None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer file (the files are not part of this repository)."""
    import public_tokenizers
    return public_tokenizers.path(name)
