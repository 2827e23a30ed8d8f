"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

import unicodedata
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.llm import textblocks as tb
from tabulon.llm.common import held, lean, prepare

#: Classes of characters: 0 what isn't a letter, 1 a letter that training text lacks, then one for each letter it has.
GAP, RARE, ALPHABET = 0, 1, 96
#: Characters that are parsed at once from an empty match; a text is the sum of its stretches.
STRETCH = 256
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring of text."""
    longest, link, step, last = [0], [-1], [{}], 0
    for c in text:
        now = len(step)
        longest.append(longest[last] + 1)
        link.append(0)
        step.append({})
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = now
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if longest[to] == longest[at] + 1:
                link[now] = to
            else:
                copy = len(step)
                longest.append(longest[at] + 1)
                link.append(link[to])
                step.append(dict(step[to]))
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = copy
                    at = link[at]
                link[to] = link[now] = copy
        last = now
    return step


class CrossParser:
    """Automata of labelled text per language, as tables: from a state and a character to the next state and whether a phrase ended.

    A phrase is the longest match that starts where the last one ended; at its end the next begins with the character
    that didn't fit.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        seen: dict[str, int] = {}
        for text in samples.values():
            for c in text.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
        kept = sorted(seen, key=lambda c: (-seen[c], c))[: ALPHABET - 2]
        table = np.where(letters(), np.uint8(RARE), np.uint8(GAP))
        for k, c in enumerate(sorted(kept), 2):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    table[ord(form)] = k
        self.table, self.width = table, len(kept) + 2
        self.next = [self._transducer(samples[name]) for name in self.languages]
        #: Bits that name a place in a language's sample: what one phrase says.
        self.bits = np.array([math.log2(max(2, len(self.classes(samples[name])))) for name in self.languages])

    def classes(self, text: str) -> np.ndarray:
        """One class for each letter and one gap for each run of others."""
        found = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        return found[np.append(True, (found[1:] != GAP) | (found[:-1] != GAP))] if len(found) else found

    def _transducer(self, text: str) -> np.ndarray:
        step = suffix_automaton(self.classes(text).tolist())
        out = np.full((len(step), self.width), -1, np.int32)
        for state, moves in enumerate(step):
            for c, to in moves.items():
                out[state, c] = to
        start = np.where(out[0] < 0, 0, out[0])
        missing = out < 0
        out = np.where(missing, start[None, :], out) * self.width
        return (out * 2 + missing).astype(np.int32).ravel()

    def phrases(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row (rows x languages), for classes of all rows one after the other."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // STRETCH)
        row = np.repeat(np.arange(len(sizes)), pieces)
        first = np.cumsum(pieces) - pieces
        start = offsets[:-1][row] + (np.arange(len(row)) - first[row]) * STRETCH
        length = np.minimum(STRETCH, offsets[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        alive = np.searchsorted(-length, -np.arange(STRETCH), "left")
        total = np.zeros((len(sizes), len(self.languages)))
        padded = np.append(codes, np.uint8(0))
        for k, moves in enumerate(self.next):
            state = np.zeros(len(row), np.int32)
            count = np.ones(len(row), np.int32)
            for j in range(STRETCH):
                n = alive[j]
                if not n:
                    break
                move = moves[state[:n] + padded[start[:n] + j]]
                count[:n] += move & 1
                state[:n] = move >> 1
            total[:, k] = np.bincount(row, count, len(sizes))
        return total


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts."""
    return F.crc32(doc_id.cast("string")) % parts


def training_sample(docs: DataFrame, docs_per_language: int, chars: int, held_out: Column) -> dict[str, str]:
    """Up to chars characters of labelled text per language.

    The documents are those with the smallest hash of doc_id, docs_per_language of each language; each gives an equal
    stretch from its middle. This is the classifier's bounded sample; its bound is docs_per_language and chars.
    """
    each = max(1, chars // docs_per_language)
    known = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~F.coalesce(held_out, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_language)
    ids = sorted({(r["doc_id"], r["lang"]) for r in chosen.select("doc_id", "lang").collect()})
    if not ids:
        return {}
    size = F.length("text")
    middle = F.col("text").substr(F.greatest(F.lit(1), F.floor((size - each) / 2).cast("int") + 1), F.lit(each))
    rows = known.where(F.col("doc_id").isin([x for x, _ in ids])).select("doc_id", "lang", middle.alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    joined = {k: "\n".join(v)[: chars + docs_per_language] for k, v in out.items()}
    return {k: v for k, v in joined.items() if any(c.isalpha() for c in v)}


def language_id(docs: DataFrame, samples: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text.

    Input: doc_id and text; other columns are ignored. samples: text per language, as training_sample() gives it.
    Returns for each input row, repeated ones too: doc_id, lang_pred (the language whose automaton needs the fewest
    normalised phrases for the text; ties go to the first by name; 'und' for null texts and those without a letter, and
    without samples), score (0 to 1: one less the ratio of the fewest to the second fewest; 1 with a single language, 0
    for 'und'), phrase_rate (phrases a character of the language chosen; null for 'und'),
    and the input's columns named in keep, which must not have those names. Case is ignored, and every run
    of other characters than letters counts as one gap. A phrase counts as the logarithm of its sample's length, the bits
    that name a place in it, since longer samples match longer phrases by chance alone; so the count over the text's
    length is the cross-parsing entropy, and languages with little labelled text aren't put at a disadvantage. Long texts are parsed in stretches of STRETCH characters, all of
    them, so work is one table look-up a character and language, and memory a block of texts.
    """
    prepare(docs.sparkSession)
    frozen = tuple(sorted(samples.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(("language ID", frozen), lambda: CrossParser(dict(frozen))) if frozen else None
        for batch in batches:
            body, offsets, _ = tb.column_bytes(batch.column(1))
            rows = len(offsets) - 1
            names, score, rate = np.full(rows, "und", object), np.zeros(rows), np.full(rows, np.nan)
            for low, high in tb.blocks(offsets) if parser else ():
                part = body[offsets[low] : offsets[high]]
                text = part.tobytes().decode("utf-8")
                found = parser.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
                at = np.searchsorted(np.flatnonzero((part & 0xC0) != 0x80), offsets[low : high + 1] - offsets[low])
                parsed = np.ones(len(found), bool)
                parsed[1:] = (found[1:] != GAP) | (found[:-1] != GAP)
                sums = np.concatenate([[0], np.cumsum(parsed)])
                letter = np.concatenate([[0], np.cumsum(found != GAP)])
                codes, at2 = found[parsed], sums[at]
                counts = parser.phrases(codes, at2)
                total = counts * parser.bits
                has = letter[at[1:]] > letter[at[:-1]]
                best = np.argmin(total, 1)
                fewest = total[np.arange(len(best)), best]
                second = np.partition(total, 1, axis=1)[:, 1] if total.shape[1] > 1 else np.full(len(best), np.inf)
                where = low + np.flatnonzero(has)
                names[where] = np.array(parser.languages, object)[best[has]]
                score[where] = (1 - fewest / np.maximum(second, 1))[has]
                rate[where] = (counts[np.arange(len(best)), best] / np.maximum(np.diff(at2), 1))[has]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64(), mask=np.isnan(rate)), *batch.columns[2:]], names=["doc_id", "lang_pred", "score", "phrase_rate", *keep])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("_text"), *[docs[c] for c in keep])
    kind = StructType([*StructType.fromDDL("doc_id long, lang_pred string, score double, phrase_rate double").fields, *rows.schema.fields[2:]])
    return rows.mapInArrow(lean(run), kind)
