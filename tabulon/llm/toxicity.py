"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textblocks as tb
from tabulon.llm.common import columns_of, prepare

#: Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros")
#: What letters are written as to hide a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()
for _c, _l in LEET.items():
    _PLAIN[ord(_c)] = ord(_l)
_SPACE = ~tb._IS_WORD
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CORE = _LETTER | _DIGIT
_CORE[[ord("@"), ord("$")]] = True
#: Kinds of lexicon: whole words, words without disguise, and first five and four bytes.
KINDS = 4
#: Words from a lexicon hit in which a pronoun counts as near.
NEAR = 3
FEATURES = 1 + 3 * KINDS + 2 + 7


@dataclass
class Words:
    """The words of a block of texts: the row of each, and its hashes, one for each kind of lexicon."""

    rows: np.ndarray
    hashes: list[np.ndarray]
    upper: np.ndarray
    hidden: np.ndarray


def words_of(body: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends, firsts = tb.words(body, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    core = np.flatnonzero(_CORE[body])
    if not len(core):
        none = np.empty(0, np.int64)
        return Words(none, [none.astype(np.uint64)] * KINDS, none.astype(bool), none.astype(bool))
    low, high = np.searchsorted(core, starts), np.searchsorted(core, ends)
    some = high > low
    starts, ends, rows = core[low[some]], core[high[some] - 1] + 1, rows[some]
    lower = _LOWER[body]
    hashes = [tb.span_hashes(lower, starts, ends)]
    # without disguise: look-alikes as letters, other marks left out, repeated letters once
    plain = _PLAIN[body]
    keep = _LETTER[plain]
    keep[1:] &= (plain[1:] != plain[:-1]) | ~_LETTER[plain[:-1]] | (plain[1:] >= 128)
    at = np.concatenate([[0], np.cumsum(keep)])
    hashes.append(tb.span_hashes(plain[keep], at[starts], at[ends]))
    for size in (5, 4):
        hashes.append(tb.span_hashes(lower, starts, np.minimum(starts + size, ends)) ^ np.uint64(size))
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letter, upper, other = count(_LETTER[body]), count((body >= 65) & (body <= 90)), count(~_LETTER[body])
    letters = letter[ends] - letter[starts]
    return Words(rows, hashes, (letters >= 2) & (upper[ends] - upper[starts] == letters), (letters > 0) & (other[ends] - other[starts] > 0))


def pronoun_hashes() -> np.ndarray:
    raw = [w.encode() for w in SECOND_PERSON]
    body = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(tb.span_hashes(body, np.concatenate([[0], ends[:-1]]), ends))


@dataclass
class Seen:
    """Which texts hold which words of one kind: distinct hashes, and for each word of a text the hash's number and the text's."""

    found: np.ndarray
    which: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Seen:
        """parts: (hash, text) of blocks of texts, no text in two of them. They are used up."""
        rows = np.concatenate([r for _, r in parts] or [np.empty(0, np.int32)])
        hashes = np.concatenate([h for h, _ in parts] or [np.empty(0, np.uint64)])
        parts.clear()
        found, which = np.unique(hashes, return_inverse=True)
        return cls(found, which.astype(np.int32), rows)

    def lexicon(self, toxic: np.ndarray, low: int = 0, high: int = 0, floor: int = 6, least: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that more toxic texts have than others, sorted, and the logarithm of how many times more; without texts low to high.

        A hash counts from floor toxic texts on, or from a tenth of them, three at least, where they are few.
        """
        use = np.ones(len(toxic), bool)
        use[low:high] = False
        bad_texts = int(toxic[use].sum())
        floor = min(floor, max(3, bad_texts // 10))
        kept = use[self.rows]
        which, rows = self.which[kept], self.rows[kept]
        all_ = np.bincount(which, minlength=len(self.found))
        bad = np.bincount(which, toxic[rows], len(self.found))
        rate = lambda x, n: (x + 0.5) / (n + 1)
        score = np.log(rate(bad, bad_texts)) - np.log(rate(all_ - bad, int(use.sum()) - bad_texts))
        keep = (bad >= floor) & (score >= least)
        return self.found[keep], score[keep]


def _once(words: Words, kind: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of a block, each pair once; its first text's number is first."""
    own, at = np.unique(words.hashes[kind], return_inverse=True)
    width = int(words.rows.max(initial=0)) + 1
    pairs = np.unique(at * width + words.rows)
    return own[pairs // width], (pairs % width + first).astype(np.int32)


def learn_lexicon(words: Words, toxic: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The lexicon of one block of texts."""
    return Seen.of([_once(words, kind)]).lexicon(toxic)


def features(body: np.ndarray, offsets: np.ndarray, lexicons: list[tuple[np.ndarray, np.ndarray]], pronouns: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    n = len(offsets) - 1
    words = words_of(body, offsets)
    total = np.bincount(words.rows, minlength=n)
    per = 1 / np.maximum(total, 1)
    out = np.zeros((n, FEATURES))
    out[:, 0] = np.log1p(total)
    hit = np.zeros(len(words.rows), bool)
    for k, (found, score) in enumerate(lexicons):
        weight = np.zeros(len(words.rows))
        if len(found) and len(weight):
            at = np.minimum(np.searchsorted(found, words.hashes[k]), len(found) - 1)
            weight = np.where(found[at] == words.hashes[k], score[at], 0)
        strong = np.zeros(n)
        np.maximum.at(strong, words.rows, weight)
        out[:, 1 + 3 * k] = np.bincount(words.rows, weight, n) * per
        out[:, 2 + 3 * k] = strong
        out[:, 3 + 3 * k] = np.log1p(np.bincount(words.rows, weight > 2.5, n))
        if k < 2:
            hit |= weight > 2.5
    at = np.minimum(np.searchsorted(pronouns, words.hashes[0]), len(pronouns) - 1)
    place = np.flatnonzero(pronouns[at] == words.hashes[0]) if len(words.rows) else np.empty(0, np.int64)
    hits = np.flatnonzero(hit)
    near = np.zeros(len(hits), bool)
    if len(place):
        for side in (np.searchsorted(place, hits) - 1, np.searchsorted(place, hits)):
            other = place[np.clip(side, 0, len(place) - 1)]
            near |= (np.abs(other - hits) <= NEAR) & (words.rows[other] == words.rows[hits])
    k = 1 + 3 * KINDS
    out[:, k] = np.bincount(words.rows[hits], near, n) * per
    out[:, k + 1] = np.bincount(words.rows[hits], near, n) / np.maximum(np.bincount(words.rows[hits], minlength=n), 1)
    sizes = np.diff(offsets)

    def rate(mask: np.ndarray, over: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(over, 1)

    letters = rate(_LETTER[body], np.ones(n))
    out[:, k + 2] = rate((body >= 65) & (body <= 90), letters)
    out[:, k + 3] = np.bincount(words.rows, words.upper, n) * per
    out[:, k + 4] = rate(body == ord("!"), sizes)
    out[:, k + 5] = rate(body == ord("?"), sizes)
    out[:, k + 6] = rate(~_CORE[body] & ~_SPACE[body], sizes)
    out[:, k + 7] = rate(_DIGIT[body], sizes)
    out[:, k + 8] = np.bincount(words.rows, words.hidden, n) * per
    return out


@dataclass
class BoostedTrees:
    """Logistic gradient boosting of trees of a fixed depth over binned features."""

    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    leaf: float = 2.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b, n = self._bin(x), len(y)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            inner, leaves = (1 << self.depth) - 1, 1 << self.depth
            column, cut, value = np.zeros(inner, np.int64), np.full(inner, self.bins + 1), np.zeros(leaves)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                for k in range(x.shape[1]):
                    cell = (at - first) * self.bins + b[:, k]
                    gs = np.bincount(cell, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(cell, h, width * self.bins).reshape(width, -1).cumsum(1)
                    g0, h0 = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (g0 - gs) ** 2 / (h0 - hs + 1) - g0**2 / (h0 + 1)
                    gain[(hs < self.leaf) | (h0 - hs < self.leaf)] = 0
                    top = gain.argmax(1)
                    value_ = gain[np.arange(width), top]
                    better = value_ > best + 1e-12
                    best[better] = value_[better]
                    column[first : first + width][better] = k
                    cut[first : first + width][better] = top[better]
                at = 2 * at + 1 + (b[np.arange(n), column[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
            self.nodes.append((column, cut, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        b, every = self._bin(x), np.arange(len(x))
        for column, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[every, column[at]] > cut[at])
            out += value[at - len(cut)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step values nearest to y (pool adjacent violators), as points to interpolate."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1, r, r])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, _, high = pools.pop()
            v1, n1, low, _ = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, low, high])
    return np.array([x for p in pools for x in (p[2], p[3])]), np.array([p[0] for p in pools for _ in range(2)])


@dataclass
class ToxicityModel:
    lexicons: list[tuple[np.ndarray, np.ndarray]]
    trees: BoostedTrees
    points: tuple[np.ndarray, np.ndarray]

    def score(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(offsets) - 1:
            return np.empty(0)
        raw = self.trees.raw(features(body, offsets, self.lexicons, pronoun_hashes()))
        step = np.interp(raw, *self.points) if len(self.points[0]) else np.zeros(len(raw))
        # the raw score orders texts within a step
        return np.clip(0.999 * step + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = 8000, folds: int = 5) -> ToxicityModel:
    """Learn from the rows labelled documents with the smallest hash of doc_id that aren't held out: the bounded sample.

    Each row serves the lexicons, the trees and the calibration: a fold's features come from lexicons of the other folds,
    its raw scores from trees of the other folds, and calibration sees those. The model's own lexicons and trees are of
    all rows. Null labels and texts are left out. labels: doc_id and toxic (0 or 1).
    """
    known = labels.where(labels["toxic"].isNotNull() & ~F.coalesce(held_out, F.lit(True))).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "toxic").limit(rows)
    texts = columns_of(docs, "doc_id", "text").where("text is not null")
    table = texts.join(F.broadcast(chosen), texts["doc_id"] == F.col("id")).select("id", "text", "toxic").toArrow().sort_by([("id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
    order = np.random.default_rng(11).permutation(len(table))
    table = table.take(pa.array(order)).combine_chunks()
    y = np.asarray(table.column("toxic").combine_chunks(), np.float64) if len(table) else np.empty(0)
    column = table.column("text").combine_chunks().cast(pa.large_string()) if len(table) else pa.array([], pa.large_string())
    body, offsets, _ = tb.column_bytes(column)
    del table
    parts: list[list] = [[] for _ in range(KINDS)]
    for low, high in tb.blocks(offsets):
        part = words_of(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        for k in range(KINDS):
            parts[k].append(_once(part, k, low))
    seen = [Seen.of(p) for p in parts]
    lexicons = [s.lexicon(y) for s in seen]
    edges = [len(y) * f // folds for f in range(folds + 1)]
    outside = [np.concatenate([y[:low], y[high:]]) for low, high in zip(edges, edges[1:], strict=False)]
    if len(y) < 20 or any(len(set(part.tolist())) < 2 for part in outside):
        return ToxicityModel(lexicons, BoostedTrees(base=-9.0, cuts=[np.empty(0)] * FEATURES), (np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.0])))
    pronouns, x = pronoun_hashes(), np.zeros((len(y), FEATURES))
    for first, last in zip(edges, edges[1:], strict=False):
        own = [s.lexicon(y, first, last) for s in seen]
        at = offsets[first : last + 1]
        for low, high in tb.blocks(at - at[0]):
            x[first + low : first + high] = features(body[at[low] : at[high]], at[low : high + 1] - at[low], own, pronouns)
    raw = np.zeros(len(y))
    for (first, last), rest in zip(zip(edges, edges[1:], strict=False), outside, strict=True):
        raw[first:last] = BoostedTrees().fit(np.concatenate([x[:first], x[last:]]), rest).raw(x[first:last])
    return ToxicityModel(lexicons, BoostedTrees().fit(x, y), isotonic(raw, y))


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every whole text.

    Input: doc_id and text; other columns are ignored. Returns for each input row, repeated ones too: doc_id, score
    (0 to 1, higher where the label 1 is likelier). A null text counts as empty, and an empty one has a score too; long
    texts are scored whole, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets, _ = tb.column_bytes(batch.column(1))
            parts = [model.score(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) for low, high in tb.blocks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.empty(0)]), pa.float64())], names=["doc_id", "score"])

    return columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
