"""Byte-level BPE ids of whole columns: texts are cut into pre-tokens with NumPy, and each distinct one is encoded once."""

from __future__ import annotations

import itertools
import json
import os
import unicodedata

import numpy as np
import pandas as pd

from tabulon.llm import textblocks as tb

#: White space of the tokenizer's pattern (Unicode's White_Space property).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Distinct pre-tokens that a worker remembers.
CACHE = 300_000
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(WHITE)] = SPACE
        _classes.append(table)
    return _classes[0]


def split(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of all rows, and the index of each row's first (one more entry than rows).

    The pattern: contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers or of other marks with one space
    before them if there is one, and white space, whose last character before a word stands apart.
    """
    if not len(body):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((body & 0xC0) != 0x80)
    code = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    n = len(code)
    rows = np.searchsorted(at, offsets)
    first = np.zeros(n + 1, bool)
    first[rows] = True
    white = kind == SPACE
    start = first[:n].copy()
    # against the character before, in the same row
    same, white_before = kind[1:] == kind[:-1], white[:-1]
    start[1:] |= ~white[1:] & np.where(white_before, code[:-1] != 32, ~same)
    start[1:] |= white[1:] & ~white_before
    last_white = white[:-1] & ~white[1:] & ~first[1:n]
    start[:-1] |= last_white
    # contractions
    marks = np.flatnonzero((code == 39) & start)
    if len(marks):
        padded = np.concatenate([code, np.zeros(3, code.dtype)])
        inside = np.concatenate([~first[:n], np.zeros(3, bool)])
        one, two = padded[marks + 1], padded[marks + 2]
        short = inside[marks + 1] & np.isin(one, [ord(c) for c in "stmd"])
        pair = inside[marks + 1] & inside[marks + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for found, size in ((marks[short], 2), (marks[pair], 3)):
            start[found + 1] = False
            after = found + size
            after = after[after < n]
            start[after[~white[after]]] = True
    begins = np.flatnonzero(start)
    edges = np.append(at[begins], len(body))
    return edges[:-1], edges[1:], np.searchsorted(begins, rows)


def _ranked(path: str):  # noqa: ANN202
    """The file's merges as ranks, for tiktoken's faster merging of one pre-token; None where merges aren't in the order of ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    singles = [c for c in byte_of if c in model["vocab"]]
    if ids != sorted(ids) or len(singles) < 256 or ids and max(model["vocab"][c] for c in singles) > ids[0]:
        return None
    ranks = {bytes(byte_of[c] for c in m): model["vocab"][m] for m in itertools.chain(singles, merged)}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})._core_bpe


class Encoder:
    """Ids of a byte-level BPE tokenizer file for blocks of texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[int, list[int]] = {}
        self.pieces = _ranked(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]

    def block(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and where each row's begin (one more entry than rows)."""
        raw = body.tobytes()
        if any(s in raw for s in self.special):
            return self._whole(raw, offsets)
        starts, ends, rows = split(body, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        which, distinct = pd.factorize(tb.span_hashes(body, starts, ends))
        where = np.empty(len(distinct), np.int64)
        where[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.cache) > CACHE:
            self.cache.clear()
        keys = distinct.tolist()
        missing = [k for k, key in enumerate(keys) if key not in self.cache]
        if missing:
            spans = where[missing]
            texts = [raw[s:e] for s, e in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]
            if self.pieces is not None:
                found = map(self.pieces.encode_single_piece, texts)
            else:
                found = (e.ids for e in self.tokenizer.encode_batch([x.decode("utf-8") for x in texts], add_special_tokens=False))
            self.cache.update(zip([keys[k] for k in missing], found, strict=True))
        lists = [self.cache[key] for key in keys]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        size = sizes[which]
        ends_at = np.cumsum(size)
        take = np.repeat(begin[which] - (ends_at - size), size) + np.arange(int(ends_at[-1]))
        return flat[take], np.concatenate([[0], ends_at])[rows]

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a special token's string are encoded by the library as they stand."""
        texts = [raw[s:e].decode("utf-8") for s, e in itertools.pairwise(offsets.tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
