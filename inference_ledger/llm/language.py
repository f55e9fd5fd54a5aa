"""Operator 2: language identification by cross-parsing.

A suffix automaton per language, of a bounded sample of labelled text, tells where the longest
match from any place of a text ends. A text is cut greedily into such matches (phrases);
the language whose automaton needs the fewest phrases per character wins, the first name on a tie.

Letters are lower-cased. The sample's ``ALPHABET`` most frequent ones are a symbol each; every other letter is spelled
by three digits of its code point, so that no two letters are taken for each other, in any script. A run of
other characters is one blank. Texts are parsed in segments of ``SEGMENT`` symbols, all
segments of an Arrow slice side by side: one table look-up per symbol and language.

The sample: of each language's labelled documents outside the held-out fifth, the
``SAMPLE_DOCS`` with the least hash give one stretch of ``SAMPLE_CHARS`` characters each, at a place
set by the hash; all languages together use ``TRAIN_CHARS`` characters at most.
Only this sample goes to the driver and back to the tasks.

Cases: null text and text without a letter give ``und`` and score 0. Without any labelled document every text is
``und``. A null doc_id counts as the empty string, so such rows are held out.
Repeated rows are predicted each. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import ranges_within, slices
from .worker import kept

SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_CHARS = 128, 256, 1 << 17
ALPHABET = 62
SEGMENT = 1024
BLANK, LETTER, DIGIT, SPELLED = 0, 2, 64, 255      # first symbols of letters and digits; mark of a spelled letter
WIDTH = DIGIT + 64
UNKNOWN = "und"


def held_out(column: str = "doc_id"):
    return F.expr(f"crc32(coalesce(CAST({column} AS STRING), '')) % 5 = 0")


def training_sample(docs: DataFrame) -> dict[str, str]:
    """Language -> sample text (blanks between stretches). Bounded by the parameters above."""
    labelled = (docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
                .select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"),
                        F.expr(f"substring(text, 1 + CAST(pmod(xxhash64(text), greatest(length(text) - {SAMPLE_CHARS}, 0)"
                               f" + 1) AS INT), {SAMPLE_CHARS})").alias("stretch")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "stretch"))
    rows = labelled.withColumn("k", place).filter(f"k <= {SAMPLE_DOCS}").orderBy("lang", "k").collect()
    langs = sorted({r.lang for r in rows})
    most = TRAIN_CHARS // max(len(langs), 1)
    sample = {x: " ".join(r.stretch for r in rows if r.lang == x)[:most] for x in langs}
    return {x: s for x, s in sample.items() if any(c.isalpha() for c in s)}


class SuffixAutomaton:
    """States of the automaton of one symbol string: transitions per state."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            self.next.append({})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    self.next.append(dict(self.next[q]))
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def parser(self, width: int) -> np.ndarray:
        """Table [state, symbol] of a greedy parse: (4 * width * next state + phrases ended)."""
        root = self.next[0]
        table = np.empty((len(self.next), width), np.int32)
        # no transition: the phrase ends, and the symbol starts the next (or is one by itself)
        fresh = np.array([4 * width * root[c] + 1 if c in root else 2 for c in range(width)])
        table[:] = fresh
        table[0] = [4 * width * root[c] if c in root else 1 for c in range(width)]
        for state, edges in enumerate(self.next):
            for c, to in edges.items():
                table[state, c] = 4 * width * to
        return table


class Model:
    """Symbol classes and parse tables of all languages, as one flat table."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        count = Counter(c for s in sample.values() for c in s.lower() if c.isalpha() and len(c) == 1)
        alphabet = {c: LETTER + k for k, (c, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])}
        self.width = WIDTH
        self.classes = np.zeros(0x110000, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                small = c.lower()
                if len(small) == 1:
                    self.lower[cp] = ord(small)
                self.classes[cp] = alphabet.get(small, SPELLED)
        most = TRAIN_CHARS // max(len(self.langs), 1)
        tables, self.base, at = [], [], 0
        for x in self.langs:
            table = SuffixAutomaton(self.symbols(sample[x])[0][:most].tolist()).parser(self.width)
            tables.append(table.ravel())
            self.base.append(at)
            at += table.size
        self.table = np.concatenate(tables) if tables else np.empty(0, np.int32)

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text and whether it has a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        s = self.classes[points]
        if not len(s):
            return s, False
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
        s = s[keep]
        spelled = s == SPELLED
        if spelled.any():
            points = self.lower[points[keep][spelled]]
            size = np.where(spelled, 3, 1)
            at = (np.cumsum(size) - size)[spelled]
            s = np.repeat(s, size)
            for k, digit in enumerate((points >> 12, points >> 6, points)):
                s[at + k] = DIGIT + (digit & 63)
        return s, bool(s.any())

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per symbol [language, text], texts with a letter)."""
        parts, letters = zip(*(self.symbols(t) for t in texts))
        n = np.array([len(p) for p in parts])
        flat = np.concatenate([*parts, np.zeros(SEGMENT, np.uint8)])
        lanes = -(-n // SEGMENT)
        text = np.repeat(np.arange(len(n)), lanes)
        inside = ranges_within(lanes) * SEGMENT
        start, length = (np.cumsum(n) - n)[text] + inside, np.minimum(n[text] - inside, SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, text = start[order], length[order], text[order]
        base = np.array(self.base, np.int64)[:, None]
        state = np.zeros((len(base), len(start)), np.int64)
        ended = np.ones((len(base), len(start)), np.int64)          # the last phrase of a segment
        active = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
        for t in range(int(length[0]) if len(length) else 0):
            k = active[t]
            got = self.table[base + state[:, :k] + flat[start[:k] + t]]
            ended[:, :k] += got & 3
            state[:, :k] = got >> 2
        total = np.zeros((len(base), len(n)))
        for row, e in zip(total, ended):
            np.add.at(row, text, e)
        return total / np.maximum(n, 1), np.array(letters)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: how many of the second best's phrases the best saves."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rate, letters = self.phrases([t or "" for t in texts])
        best = rate.argmin(axis=0)
        if len(self.langs) == 1:
            score = np.ones(len(texts))
        else:
            two = np.partition(rate, 1, axis=0)
            score = 1 - two[0] / np.maximum(two[1], 1e-12)
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
        return names, np.where(letters, np.clip(score, 0, 1), 0.0)


def model(sample: tuple[tuple[str, str], ...]) -> Model:
    """The worker process's model for this sample (kept between tasks)."""
    return kept(("language", sample), lambda: Model(dict(sample)))


def with_language(docs: DataFrame, sample: dict[str, str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; only ``text`` is looked at."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()),
                           T.StructField(score, T.DoubleType())])
    frozen = tuple(sorted(sample.items()))
    text_at = docs.columns.index("text")

    def predict(batches):
        m = model(frozen)
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = m.predict(part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)],
                                                 names=[*part.schema.names, lang, score])
    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sample = training_sample(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return with_language(rows, sample).drop("text")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is known (not ``und``)."""
    sample = training_sample(docs)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    return with_language(docs, sample, lang, score).filter(F.col(lang) != UNKNOWN).drop(lang, score)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if the table has such a column."""
    while name in df.columns:
        name = "_" + name
    return name
