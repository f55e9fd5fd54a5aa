"""Operator 13: BPE encoding by a dynamic programme over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that its encoding ends with. The
programme finds it from left to right: an automaton over the vocabulary gives the tokens that
end at a place, longest first, and the first of them that is compatible with the last token
of the prefix before it is stored. Two tokens are compatible if encoding their joint bytes gives these
two tokens again, which undoing their merges decides. Following the stored
tokens back from the end gives the ids. Texts are cut into the tokenizer's own
pre-tokens first, and each distinct pre-token of a slice is encoded once, all of them side by side.

Works for byte-level files without normaliser whose every merge makes a token of its own; other
files raise ``ValueError`` on the driver.

Cases: null and empty texts have no ids (``n_tokens`` 0, both hashes of the empty string). The
file's added tokens are one id where a text spells them. Repeated rows and rows with equal or null
doc_id each give a row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ranges_within
from .encode import Encoder, encoded
from .pretokens import class_runs, use_classes
from .worker import kept

LANE_BYTES = 1 << 18        # bytes of pre-tokens that go side by side
LONG = 256                  # a pre-token of more bytes is handled alone
PAIR_SLOTS = 1 << 18        # compatibility results that are remembered (a newer pair takes the slot)


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level files: printable Latin-1 characters for
    themselves, the other bytes from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens in the order of their merges ("ranks": bytes first), their ids and parts."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if spec.get("normalizer") or model.get("type") != "BPE" or model.get("end_of_word_suffix") \
                or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" \
                or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("not a byte-level BPE file without normaliser")
        alphabet = byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        if any(c not in vocab for c in alphabet):
            raise ValueError("the vocabulary lacks some bytes")
        letters = sorted(alphabet, key=alphabet.get)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        rank = {c: k for k, c in enumerate(letters)}
        left, right = list(range(256)), list(range(256))
        for a, b in merges:
            if a + b in rank or a not in rank or b not in rank:
                raise ValueError("a merge makes a known token or joins unknown ones")
            left.append(rank[a])
            right.append(rank[b])
            rank[a + b] = len(rank)
        names = list(rank)
        self.ids = np.array([vocab[t] for t in names], np.int64)
        self.bytes = [bytes(alphabet[c] for c in t) for t in names]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.size = len(names)
        keys = self.left[256:] * self.size + self.right[256:]
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(256 + order, 0)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b merge to, or a rank beyond all."""
        key = a * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.size + 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of a and b together are encoded as a, b. Merges are undone from the
        latest: a merge across the border that comes before the parts at the border are merged
        away (with equal pairs, the left one goes first) would have joined them."""
        ok = np.ones(len(a), bool)
        on = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), self.size, np.int64)
        while len(on):
            clash = self.merged(x, y) < limit
            ok[on[clash]] = False
            go = ~clash & ((x >= 256) | (y >= 256))
            on, x, y = on[go], x[go], y[go]
            undo = x > y
            limit = np.where(undo, x, y + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok


class SuffixAutomaton:
    """After any bytes, its state stands for their longest suffix that begins a token.

    ``longest[state]`` is the longest token that ends there, ``shorter[token]`` the next shorter one that
    is a suffix of it. States without followers share the transitions of their own longest proper suffix."""

    def __init__(self, tokens: list[bytes]):
        size = np.array([len(t) for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        begin = np.cumsum(size) - size
        node = np.zeros(len(tokens), np.int64)
        levels, count = [], 1
        for d in range(int(size.max())):               # the states, by length
            on = np.flatnonzero(size > d)
            key, at = np.unique(node[on] * 256 + flat[begin[on] + d], return_inverse=True)
            levels.append((key // 256, key % 256, count + np.arange(len(key))))
            node[on] = count + at
            count += len(key)
        inner = np.zeros(count, bool)
        for parent, _, _ in levels:
            inner[parent] = True
        self.row = np.full(count, -1, np.int32)
        self.row[inner] = np.arange(int(inner.sum()))
        self.next = np.zeros((int(inner.sum()), 256), np.int32)
        own = np.full(count, -1, np.int64)
        own[node] = np.arange(len(tokens))
        suffix = np.zeros(count, np.int64)
        self.longest = own.copy()
        for parent, byte, child in levels:
            top = parent == 0
            suffix[child] = np.where(top, 0, self.next[self.row[suffix[parent]], byte])
            with_followers = np.unique(parent[~top])
            self.next[self.row[with_followers]] = self.next[self.row[suffix[with_followers]]]
            self.next[self.row[parent], byte] = child
            leaf = child[~inner[child]]
            self.row[leaf] = self.row[suffix[leaf]]
            self.longest[child] = np.where(own[child] >= 0, own[child], self.longest[suffix[child]])
        self.shorter = self.longest[suffix[node]]


class PrefixCoder:
    """Encodes pre-tokens; one per worker process and tokenizer file."""

    def __init__(self, spec: dict):
        self.vocab = v = Vocabulary(spec)
        self.automaton = SuffixAutomaton(v.bytes)
        self.size = np.array([len(t) for t in v.bytes], np.int64)
        self.pair = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.compatible`` with a memory of earlier results."""
        key = a * self.vocab.size + b
        slot = (key * np.int64(0x9E3779B97F4A7C1 | 1) >> np.int64(20)) & (PAIR_SLOTS - 1)
        new = np.flatnonzero(self.pair[slot] != key)
        ok = self.pair_ok[slot]
        if len(new):
            ok[new] = got = self.vocab.compatible(a[new], b[new])
            # one write a slot, so that key and result belong together
            at, which = np.unique(slot[new], return_index=True)
            self.pair[at], self.pair_ok[at] = key[new][which], got[which]
        return ok

    def encode(self, units: list[bytes], kind: str) -> list[bytes]:
        """Ids of every unit, as bytes of ``kind``."""
        out: list[bytes] = [b""] * len(units)
        size = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            widest = int(size[order[at]])
            lanes = max(1, LANE_BYTES // max(widest, 1)) if widest <= LONG else 1
            some = order[at:at + lanes]
            some = some[size[some] <= max(2 * widest, 8)] if widest <= LONG else some
            at += len(some)
            if widest > LONG:
                k = int(some[0])
                out[k] = self.vocab.ids[self._alone(units[k])].astype(kind).tobytes()
                continue
            ids, n = self._side_by_side([units[k] for k in some], size[some])
            flat = self.vocab.ids[ids].astype(kind).tobytes()
            ends = (np.cumsum(n) * np.dtype(kind).itemsize).tolist()
            for k, a, b in zip(some.tolist(), [0, *ends], ends):
                out[k] = flat[a:b]
        return out

    def _side_by_side(self, units: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks of the tokens of all units, tokens of each)."""
        lanes, width = len(units), int(size.max())
        data = np.zeros((width, lanes), np.uint8)
        flat = np.frombuffer(b"".join(units), np.uint8)
        data[ranges_within(size), np.repeat(np.arange(lanes), size)] = flat
        last = np.full((width + 1, lanes), -1, np.int32)      # last token of each prefix
        state = np.zeros(lanes, np.int64)
        auto = self.automaton
        for p in range(width):
            live = int(np.searchsorted(size, p, "right"))      # units are sorted by size
            on = np.arange(live, lanes)
            state[live:] = auto.next[auto.row[state[live:]], data[p, live:]]
            token = auto.longest[state[live:]]
            while len(on):
                before = p + 1 - self.size[token]
                previous = last[before, on].astype(np.int64)
                ok = before == 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.compatible(previous[ask], token[ask])
                last[p + 1, on[ok]] = token[ok]
                on, token = on[~ok], auto.shorter[token[~ok]]
        lane, place, found = np.arange(lanes), size.copy(), []
        while len(lane):                                       # back from the ends
            token = last[place, lane].astype(np.int64)
            found.append((lane, token))
            place = place - self.size[token]
            more = place > 0
            lane, place = lane[more], place[more]
        step = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
        lane = np.concatenate([x for x, _ in found])
        token = np.concatenate([x for _, x in found])
        order = np.lexsort((-step, lane))
        return token[order], np.bincount(lane, minlength=lanes)

    def _alone(self, unit: bytes) -> np.ndarray:
        """One long unit, place by place, with its own memory of pairs."""
        auto, size = self.automaton, self.size.tolist()
        known: dict[tuple[int, int], bool] = {}
        last = np.full(len(unit) + 1, -1, np.int32)
        state = 0
        for p, byte in enumerate(unit, 1):
            state = auto.next[auto.row[state], byte]
            token = int(auto.longest[state])
            while (before := p - size[token]) > 0:
                pair = (int(last[before]), token)
                if pair not in known:
                    if len(known) > PAIR_SLOTS:
                        known.clear()
                    known[pair] = bool(self.vocab.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair]:
                    break
                token = int(auto.shorter[token])
            last[p] = token
        ids, place = [], len(unit)
        while place:
            ids.append(int(last[place]))
            place -= size[ids[-1]]
        return np.array(ids[::-1], np.int64)


class PrefixEncoder(Encoder):
    """An ``Encoder`` whose new pre-tokens go through the dynamic programme, not the library."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.coder = PrefixCoder(spec)
        if not self.plain:
            raise ValueError("added tokens that need normalising are not supported")
        pieces: dict[int, bytes] = {int(k): t for k, t in zip(self.coder.vocab.ids, self.coder.vocab.bytes)}
        alphabet = byte_alphabet()
        for t in spec.get("added_tokens") or []:
            known = all(c in alphabet for c in t["content"])
            pieces[t["id"]] = bytes(alphabet[c] for c in t["content"]) if known else t["content"].encode()
        spelled = [pieces.get(k, b"") for k in range(max(pieces) + 1)]
        self.spelled_size = np.array([len(t) for t in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        numbers = [b"%d," % k for k in range(len(spelled))]
        self.number_size = np.array([len(t) for t in numbers], np.int64)
        self.number = np.frombuffer(b"".join(t.ljust(11) for t in numbers), np.uint8).reshape(-1, 11)[
            :, :int(self.number_size.max())].copy()

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        return self.coder.encode(units, self.kind)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) that the ids of each text stand for."""
        size = self.spelled_size[ids]
        out = self.spelled[np.repeat(self.spelled_at[ids], size) + ranges_within(size)]
        return out, np.append(0, np.cumsum(size))[offsets]

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the ids as decimals, each with a comma after it; offsets)."""
        size = self.number_size[ids]
        rows = self.number[ids]
        return rows[np.arange(rows.shape[1]) < size[:, None]].tobytes(), np.append(0, np.cumsum(size))[offsets]


def prefix_encoder(path: str, classes=None) -> PrefixEncoder:
    if classes is not None:
        use_classes(classes)
    return kept(("prefix encoder", path), lambda: PrefixEncoder(path))


def lossy(data: bytes) -> bytes:
    """Decoded text as UTF-8: bytes that are none become U+FFFD, as the library's decoder does."""
    try:
        data.decode("utf-8")
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode("utf-8")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids stand for)."""
    _checked(tokenizer_path)
    classes = class_runs()

    def rows(batches):
        enc = prefix_encoder(tokenizer_path, classes)
        for part, ids, offsets in encoded(batches, enc):
            out, at = enc.decode(ids, offsets)
            at, data = at.tolist(), out.tobytes()
            lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([
                part.column(0), lists.cast(pa.list_(pa.int32())),
                pa.array([lossy(data[a:b]).decode() for a, b in zip(at, at[1:])], pa.string())],
                names=["doc_id", "ids", "decoded"])

    return _slim(docs).mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded text)."""
    _checked(tokenizer_path)
    classes = class_runs()

    def rows(batches):
        enc, sha = prefix_encoder(tokenizer_path, classes), hashlib.sha256
        for part, ids, offsets in encoded(batches, enc):
            out, at = enc.decode(ids, offsets)
            numbers, number_at = enc.decimals(ids, offsets)
            at, data, number_at = at.tolist(), out.tobytes(), number_at.tolist()
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(offsets)),
                pa.array([sha(numbers[a:max(a, b - 1)]).hexdigest() for a, b in zip(number_at, number_at[1:])]),
                pa.array([sha(lossy(data[a:b])).hexdigest() for a, b in zip(at, at[1:])])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _checked(path: str) -> None:
    """Refuse a file of another kind before any job starts."""
    with open(path, encoding="utf-8") as f:
        Vocabulary(json.load(f))
