"""SentencePiece encoding and decoding by suffix-array matching of all pieces."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textblocks as tb
from tabulon.llm.common import columns_of, prepare

MARK = "▁"
#: Units that a worker remembers, and pairs of pieces.
CACHE, PAIRS = 200_000, 600_000
#: Characters of new units that are indexed at once.
INDEXED = 1 << 18
#: Bytes of text whose new units are indexed together: each index is searched for all pieces, so smaller blocks cost more.
BLOCK = 1 << 21
_models: dict[str, Pieces] = {}


def _before(x: np.ndarray, y: np.ndarray, equal: bool) -> np.ndarray:
    """Row by row, whether x stands before y in lexicographic order (or equals it)."""
    out = np.full(len(x), equal)
    for k in range(x.shape[1] - 1, -1, -1):
        out = (x[:, k] < y[:, k]) | (x[:, k] == y[:, k]) & out
    return out


class Pieces:
    """A SentencePiece BPE model, read through the library; its texts are encoded here.

    Unknown characters become byte pieces where the model has them. The model's normalisation must be the identity, with
    or without the removal of extra spaces.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.normalizer_spec.precompiled_charsmap or spec.trainer_spec.model_type != 2 or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation and spaces before words is needed")
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.squeeze = spec.normalizer_spec.remove_extra_whitespaces
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [self.unknown] * 256
        self.score: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                self.bytes_of[i] = name.replace(MARK, " ").encode()
                self.score[name] = (model.get_score(i), i)
        # characters as classes from 1; 0 is every character that no piece has
        letters = sorted({c for name in self.score for c in name})
        self.table = np.zeros(0x110000, np.uint16)
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.table[32] = self.table[ord(MARK)]
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        self.class_of = {c: k for k, c in enumerate(letters, 1)}
        self.letters = ["", *letters]
        for name in self.score:
            for a, b in itertools.pairwise(name):
                self.beside[self.class_of[a], self.class_of[b]] = True
        # pieces that merging can reach, each with the two parts of its last merge, and single characters that aren't pieces
        self.parts: dict[str, tuple[str, str]] = {}
        self.known = []
        for name, (_, i) in self.score.items():
            if len(name) == 1:
                self.known.append((name, i))
            elif len(self.merged(name, 2)) == 2 and self.merged(name) == [name]:
                self.parts[name] = tuple(self.merged(name, 2))
                self.known.append((name, i))
        self.known += [(c, -k) for k, c in enumerate(letters, 1) if c not in self.score]
        self.width = max([4, *(len(n) for n, _ in self.known)])
        self.width += -self.width % 4
        self.lengths = np.array([len(n) for n, _ in self.known], np.int64)
        self.ids = np.array([i for _, i in self.known], np.int64)
        classes = np.zeros((len(self.known), self.width), np.uint16)
        for k, (name, _) in enumerate(self.known):
            classes[k, : len(name)] = [self.class_of[c] for c in name]
        self.low = self._keys(classes)
        self.high = self._keys(np.where(classes == 0, np.uint16(0xFFFF), classes))
        self.fits: dict[int, bool] = {}
        self.cache: dict[int, list[int]] = {}
        self.body = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.edges = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])

    @staticmethod
    def _keys(classes: np.ndarray) -> np.ndarray:
        """Rows of 16-bit numbers as fewer 64-bit numbers of the same order."""
        return np.ascontiguousarray(classes).astype(">u2").view(">u8").astype(np.uint64)

    def merged(self, text: str, most: int = 1) -> list[str]:
        """The pieces of a short text by merging the best adjacent pair, the leftmost of equals, while there is one and more than most."""
        parts = list(text)
        while len(parts) > most:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.score.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stand(self, a: str, b: str) -> bool:
        """Whether merging the joint text of two pieces gives just them.

        Their merges are undone from the last one back. If what then touches could have merged before the merge that was
        undone (for equal scores: if it stands to the left of it), the pieces would not have come about.
        """
        score, parts = self.score, self.parts
        floor, left_wins = float("-inf"), False
        while True:
            joint = score.get(a + b)
            if joint is not None and (joint[0] > floor or left_wins and joint[0] == floor):
                return False
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and score[a][0] < score[b][0]:
                floor, left_wins, a = score[a][0], False, x[1]
            else:
                floor, left_wins, b = score[b][0], True, y[0]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces (-1: the beginning) can stand side by side: merging their joint text gives just them."""
        n = len(self.known)
        pair = left * n + right
        distinct, which = np.unique(pair, return_inverse=True)
        if len(self.fits) > PAIRS:
            self.fits.clear()
        out = np.empty(len(distinct), bool)
        for k, key in enumerate(distinct.tolist()):
            if key < 0:
                out[k] = True
                continue
            found = self.fits.get(key)
            if found is None:
                a, b = self.known[key // n][0], self.known[key % n][0]
                found = self.fits[key] = self.stand(a, b)
            out[k] = found
        return out[which]

    def encode_units(self, units: list[np.ndarray]) -> list[list[int]]:
        """Ids of units of known characters, given as classes."""
        sizes = np.array([len(u) for u in units], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(units) + self.width, np.uint16)
        inside = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[inside] = np.concatenate(units)
        # the suffix array, by as many characters as the longest piece has
        keys = self._keys(sliding_window_view(text, self.width)[inside])
        order = np.lexsort(keys.T[::-1])
        keys, order = keys[order], inside[order]
        lows, highs = self._bound(keys, self.low, False), self._bound(keys, self.high, True)
        # an edge for each occurrence of a piece
        count = highs - lows
        piece = np.repeat(np.arange(len(self.known)), count)
        begin = order[np.repeat(lows - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        unit_start = np.zeros(len(text), np.int64)
        unit_start[inside] = np.repeat(starts, sizes)
        end = begin + self.lengths[piece]
        reach = end - unit_start[begin]
        by = np.argsort((reach << 40) + (end << 8) - self.lengths[piece])
        piece, begin, end, reach = piece[by], begin[by], end[by], reach[by]
        # relax: of the edges that end at a position, the longest that fits the best path to its beginning
        last = np.full(len(text) + 1, -1, np.int64)
        bounds = np.searchsorted(reach, np.arange(1, int(reach[-1]) + 2)) if len(reach) else np.zeros(1, np.int64)
        for low, high in itertools.pairwise(bounds.tolist()):  # edges that end as many characters after their unit's start
            todo = np.arange(low, high)
            while len(todo):
                first = np.append(True, end[todo[1:]] != end[todo[:-1]])
                head = todo[first]
                left = np.where(begin[head] == unit_start[begin[head]], -1, last[begin[head]])
                good = np.where(left < 0, begin[head] == unit_start[begin[head]], self._fit(left, piece[head]))
                last[end[head[good]]] = piece[head[good]]
                group = np.cumsum(first) - 1
                todo = todo[~first & ~good[group]]
        # back from the ends of all units at once; a unit's pieces come last one first
        at, unit, found, of = starts + sizes, np.arange(len(units)), [], []
        while len(unit):
            ends = last[at]
            found.append(ends)
            of.append(unit)
            at = at - self.lengths[ends]
            unit, at = unit[at > starts[unit]], at[at > starts[unit]]
        found, of = np.concatenate(found)[::-1], np.concatenate(of)[::-1]
        ids = self.ids[found[np.argsort(of, kind="stable")]].tolist()
        edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(units)))]).tolist()
        out = [ids[a:b] for a, b in itertools.pairwise(edges)]
        for k in np.unique(of[self.ids[found] < 0]).tolist():  # characters that no piece spells out become bytes
            out[k] = [x for i in out[k] for x in ([i] if i >= 0 else [self.byte_ids[b] for b in self.letters[-i].encode()])]
        return out

    @staticmethod
    def _bound(keys: np.ndarray, wanted: np.ndarray, equal: bool) -> np.ndarray:
        """For each key wanted, how many of the sorted keys stand before it (or equal it)."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            ahead = np.zeros(len(wanted), bool)
            ahead[open_] = _before(keys[mid[open_]], wanted[open_], equal)
            low = np.where(open_ & ahead, mid + 1, low)
            high = np.where(open_ & ~ahead, mid, high)
        return low

    def normalised(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts without extra spaces, if the model removes them."""
        if not self.squeeze or not len(body):
            return body, offsets
        if MARK.encode() in body.tobytes():
            raw = body.tobytes()
            rows = [b" ".join(x for x in raw[a:b].split(b" ") if x) for a, b in itertools.pairwise(offsets.tolist())]
            for k, row in enumerate(rows):
                while row.endswith((MARK.encode(), b" ")):
                    row = row[:-1] if row.endswith(b" ") else row[:-3]
                rows[k] = row
            return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        blank = body == 32
        follows = np.append(False, blank[:-1])
        heads = offsets[:-1][offsets[:-1] < len(body)]
        follows[heads] = True
        keep = ~(blank & follows)
        at = np.concatenate([[0], np.cumsum(keep)])
        body, offsets = body[keep], at[offsets]
        # one space may be left at the end of a text
        last = offsets[1:][np.diff(offsets) > 0] - 1
        last = last[body[last] == 32]
        if len(last):
            keep = np.ones(len(body), bool)
            keep[last] = False
            at = np.concatenate([[0], np.cumsum(keep)])
            body, offsets = body[keep], at[offsets]
        return body, offsets

    def block(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised texts one after the other, and where each text's begin (one more entry than texts)."""
        if not len(body):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.prefix:
            some = np.diff(offsets) > 0
            body = np.insert(body, offsets[:-1][some], np.uint8(32))
            offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        at = np.flatnonzero((body & 0xC0) != 0x80)
        code = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.table[code]
        rows = np.searchsorted(at, offsets)
        # a unit ends where no piece has the next two characters side by side
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~self.beside[kind[:-1], kind[1:]]
        cut[rows] = True
        begins = np.flatnonzero(cut[:-1])
        sizes = np.diff(np.append(begins, len(code)))
        edges = np.append(at[begins], len(body))
        which, distinct = pd.factorize(tb.span_hashes(body, edges[:-1], edges[1:]))
        where = np.empty(len(distinct), np.int64)
        where[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.cache) > CACHE:
            self.cache.clear()
        keys = distinct.tolist()
        new: list[tuple[int, np.ndarray]] = []
        for k in [k for k, key in enumerate(keys) if key not in self.cache]:
            b = int(begins[where[k]])
            if kind[b]:
                new.append((keys[k], kind[b : b + int(sizes[where[k]])]))
            else:
                self.cache[keys[k]] = [self.byte_ids[x] for x in chr(int(code[b])).encode()]
        low, held = 0, 0
        for k, (_, unit) in enumerate(new):
            held += len(unit) + 1
            if held >= INDEXED or k == len(new) - 1:
                part = new[low : k + 1]
                self.cache.update(zip([x for x, _ in part], self.encode_units([u for _, u in part]), strict=True))
                low, held = k + 1, 0
        lists = [self.cache[key] for key in keys]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(length.sum()))
        first = np.cumsum(length) - length
        size = length[which]
        ends = np.cumsum(size)
        take = np.repeat(first[which] - (ends - size), size) + np.arange(int(ends[-1]))
        return flat[take], np.concatenate([[0], ends])[np.searchsorted(begins, rows)]

    def spelt(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts' ids one after the other, and where each text's begin, without the space that the model puts before a text."""
        first = self.edges[ids]
        size = self.edges[ids + 1] - first
        stop = np.cumsum(size)
        body = self.body[np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        at = np.concatenate([[0], stop])[ends]
        if self.prefix:
            heads = at[:-1][at[:-1] < at[1:]]
            drop = np.zeros(len(body), bool)
            drop[heads] = body[heads] == 32
            body, at = body[~drop], at - np.concatenate([[0], np.cumsum(drop)])[at]
        return body, at

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.bytes_of[i] if 0 <= i < len(self.bytes_of) else b"" for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _model(path: str) -> Pieces:
    return _models.get(path) or _models.setdefault(path, Pieces(path))


def encode(docs: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """Ids of every whole text by a SentencePiece BPE model, equal to the library's.

    Input: doc_id (integer) and text; other columns are ignored. model: the path of the model's file. Returns a row for
    each input row, repeated ones too: doc_id, ids (array<int>; empty for null and empty texts), ids_crc32 (of the ids as
    little-endian 32-bit numbers), normalised (what decode() gives back: the text, null as empty, without extra spaces if the model removes
    them, and with U+2581 as a space). With digest: doc_id, n_ids, ids_crc32 and round_trip, whether decoding the ids, done
    in the same task, gives that text.

    A block of texts is cut into units, between any two characters that no piece has side by side, so merges never cross
    a cut. Distinct units that the worker doesn't remember are joined to one text; its suffix array is searched for every
    piece, each occurrence is an edge, edges are sorted by where they end, and relaxed in that order. A merge order has
    one last piece for each beginning of a text: the one that can stand beside the last piece before it. Memory is that
    of a block and of two bounded caches.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            body, offsets, _ = tb.column_bytes(batch.column(1))
            for low, high in tb.blocks(offsets, BLOCK):
                part, at = pieces.normalised(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                ids, ends = pieces.block(part, at)
                raw = ids.astype("<i4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(ends.tolist())]
                if digest:
                    whole, (back, sides) = part.tobytes(), pieces.spelt(ids, ends)
                    back = back.tobytes()
                    spans = zip(itertools.pairwise(sides.tolist()), itertools.pairwise(at.tolist()), strict=True)
                    same = [back[a:b] == whole[c:d].replace(MARK.encode(), b" ") for (a, b), (c, d) in spans]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])
                    continue
                texts = pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists, pa.array(crc, pa.int64()), texts.cast(pa.string())], names=["doc_id", "ids", "ids_crc32", "normalised"])

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    if digest:
        return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
    out = rows.mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, normalised string")
    return out.withColumn("normalised", F.translate("normalised", MARK, " "))


def decode(rows: DataFrame, model: str) -> DataFrame:
    """rows with the column decoded: the text of their ids. A null list gives null, ids that the model lacks nothing, bytes that aren't UTF-8 U+FFFD."""
    prepare(rows.sparkSession)
    names = [c for c in rows.columns if c != "decoded"]
    where = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                texts = [None if ids is None else pieces.decode(ids) for ids in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    rows = rows.select(*names)
    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("").cast("string")).schema)
