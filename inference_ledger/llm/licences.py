"""Operator 1: licence scan with a positional index of rare words.

Each template is a run of words with mandatory key phrases. The index holds the places of every template
word in a file. A template is entered through the file's own rarest of its mandatory words: the one with
the fewest places there, of equals that with the highest inverse document frequency over all documents. Every
place of that word proposes alignments; the places of the template's other words are intersected with them
by relative position, mandatory words first. An alignment counts if every mandatory phrase stands there in
full and the matched words hold ``ENOUGH`` of the template's weight. As an alignment that counts holds all
mandatory words, the entry misses none, whatever the other words are and whatever the corpus
holds. The base phrases are templates that are mandatory as a whole.

Words: A-Z in lower case, then maximal runs of digits, a-z and non-ASCII characters.

Cases: null and empty texts have no words and no labels, score 0, null places. Word frequencies
count every row, repeated rows too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import flat_bytes, lower_ascii, slices, word_bounds

ENOUGH = 0.6

# fixed values: phrases and labels of the contract
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, words, mandatory phrases) of this operator's own notices
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-2.0", "gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     ["copy modify and or distribute"]),
]


class Template:
    def __init__(self, label: str, text: str, mandatory: list[str], base: bool):
        self.label, self.words, self.base = label, text.split(), base
        self.needed = np.zeros(len(self.words), bool)
        for phrase in mandatory:
            part = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i:i + len(part)] == part)
            self.needed[at:at + len(part)] = True


def templates() -> list[Template]:
    return [Template(label, text, [text], True) for text, label in BASE.items()] + \
        [Template(label, text, need, False) for label, text, need in NOTICES]


class Vocabulary:
    """Word numbers of the templates' words, found by their first eight bytes."""

    def __init__(self, words: list[str]):
        raw = sorted({w.encode() for w in words}, key=lambda w: int.from_bytes(w[:8], "little"))
        self.words = [w.decode() for w in raw]
        self.raw = raw
        self.number = {w: i for i, w in enumerate(self.words)}
        self.heads = np.array([int.from_bytes(w[:8], "little") for w in raw], np.uint64)
        self.mask = np.array([(1 << (8 * min(n, 8))) - 1 for n in range(9)], np.uint64)

    def numbers(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of every word, -1 if it is in no template."""
        out = np.full(len(starts), -1, np.int32)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        head = eight[starts] & self.mask[np.minimum(length, 8)]
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        for i in np.flatnonzero(self.heads[at] == head):
            k = int(at[i])
            word = bytes(data[starts[i]:starts[i] + length[i]])
            while k < len(self.raw) and self.heads[k] == head[i]:
                if self.raw[k] == word:
                    out[i] = k
                    break
                k += 1
        return out


def _words(column: pa.Array, vocabulary: Vocabulary):
    """(word numbers, words per row) of all texts of a column."""
    data, offsets = flat_bytes(column)
    data = lower_ascii(data)
    is_word = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    starts, ends, count = word_bounds(is_word, offsets)
    return vocabulary.numbers(data, starts, ends - starts), count


def word_weights(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Inverse document frequency of every template word, over all documents."""

    def count(batches):
        for batch in batches:
            seen = np.zeros(len(vocabulary.words), np.int64)
            for part in slices(batch, "text"):
                number, words = _words(part.column(0), vocabulary)
                at = np.flatnonzero(number >= 0)
                row = np.repeat(np.arange(len(words)), words)[at]
                pairs = np.unique(row * len(seen) + number[at])
                seen += np.bincount(pairs % len(seen), minlength=len(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, len(seen))), pa.array(np.append([batch.num_rows], seen))],
                names=["number", "docs"])

    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "number long, docs long")
            .groupBy("number").agg(F.sum("docs").alias("docs")).collect())    # one row per template word
    found = {r.number: r.docs for r in rows}
    n = found.get(-1, 0)
    return np.array([math.log((n + 1) / (found.get(i, 0) + 1)) + 1e-3 for i in range(len(vocabulary.words))])


class Index:
    """Positional index of a slice of files: template word -> its places, file by file."""

    def __init__(self, all_templates: list[Template], vocabulary: Vocabulary, weights: np.ndarray):
        self.weights, self.templates = weights, []
        for t in all_templates:
            numbers = np.array([vocabulary.number[w] for w in t.words])
            weight = weights[numbers]
            # mandatory words first, of them the rarest first
            order = np.lexsort((-weight, ~t.needed))
            self.templates.append((t, numbers, weight, order, order[:int(t.needed.sum())]))

    def scan(self, number: np.ndarray, words: np.ndarray):
        """For every alignment that counts: (row, first word, template, score)."""
        begin = np.cumsum(words) - words
        hits = np.flatnonzero(number >= 0)
        row_of_hit = np.repeat(np.arange(len(words)), words)[hits]
        # postings: hits by (template word, file), places ascending
        key = number[hits].astype(np.int64) * max(len(words), 1) + row_of_hit
        order_of_hits = np.argsort(key, kind="stable")
        key, places = key[order_of_hits], hits[order_of_hits]
        rows = np.unique(row_of_hit)
        for t, numbers, weight, order, mandatory in self.templates:
            keys = numbers[mandatory][:, None] * len(words) + rows      # mandatory is ordered rarest first, so ties go there
            lo, hi = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            rarest = np.argmin(hi - lo, axis=0)
            at = np.arange(len(rows))
            lo, n = lo[rarest, at], (hi - lo)[rarest, at]               # none, if a mandatory word is not in the file
            row = np.repeat(rows, n)
            place = places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            start = place - np.repeat(mandatory[rarest], n)
            score = np.zeros(len(place))
            alive = np.ones(len(place), bool)
            for k in order:                      # intersect by relative position
                there = start + k
                inside = (there >= begin[row]) & (there < begin[row] + words[row])
                same = inside & (number[np.clip(there, 0, max(len(number) - 1, 0))] == numbers[k])
                score += weight[k] * same
                if t.needed[k]:
                    alive &= same
            score /= weight.sum()
            alive &= score >= ENOUGH
            for i in np.flatnonzero(alive):
                yield int(row[i]), int(start[i] - begin[row[i]]), t, float(score[i])


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    places: every alignment (label, first word, score)."""
    all_templates = templates()
    vocabulary = Vocabulary([w for t in all_templates for w in t.words])
    weights = word_weights(docs, vocabulary)

    def scan(batches):
        index = Index(all_templates, vocabulary, weights)
        for batch in batches:
            for part in slices(batch, "text"):
                number, words = _words(part.column(1), vocabulary)
                found = {}
                for row, first, t, score in index.scan(number, words):
                    found.setdefault(row, []).append((t, first, score))
                out = []
                for row, n in enumerate(words):
                    got = found.get(row, [])
                    base = sorted({(first, t.label) for t, first, _ in got if t.base})
                    out.append({
                        "n_words": int(n), "n_base": len(base),
                        "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
                        "base_labels": ",".join(sorted({x for _, x in base})),
                        "labels": ",".join(sorted({t.label for t, _, _ in got})),
                        "score": min(max((s for _, _, s in got), default=0.0), 1.0),
                        "places": [{"label": t.label, "first_word": f, "score": s}
                                   for t, f, s in sorted(got, key=lambda x: (x[1], x[0].label))]})
                rows = pa.array(out, pa.struct(_FIELDS))
                yield pa.RecordBatch.from_arrays([part.column(0), *rows.flatten()],
                                                 names=["doc_id", *(f[0] for f in _FIELDS)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, """doc_id long, n_words long, n_base long, first_word long, last_word long,
        base_labels string, labels string, score double,
        places array<struct<label: string, first_word: long, score: double>>""")


_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
           ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
           ("places", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                          ("score", pa.float64())])))]
