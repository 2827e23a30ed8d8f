"""Packing: token ids of documents in sequences of bounded length, by bounded-space online best fit."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textblocks as tb
from tabulon.llm.common import columns_of, held, lean, prepare, stored
from tabulon.llm.pretokens import Encoder

_PIECE = "doc_id long, start long, length long, payload binary, doc_tokens long, sequence_id long, offset long, part long, tail boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("payload", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("tail", pa.bool_())])


class Packer:
    """Windows of size tokens, at most open_windows of them open at once.

    A piece goes into the open window that it fills best. If none holds it, a new window opens; with all windows open,
    the fullest is filled with the head of the piece and emitted, and the rest of the piece is placed anew. So windows
    leave full, and a document is cut only where nothing fits. finish() merges the open windows; at most one is left
    that isn't full.
    """

    def __init__(self, size: int, open_windows: int, emit: Callable[[list], None]) -> None:
        self.size, self.limit, self.emit = size, open_windows, emit
        self.free: list[tuple[int, int]] = []
        self.windows: dict[int, list] = {}
        self.opened = 0

    def add(self, key: tuple, ids: np.ndarray, start: int = 0) -> None:
        """key: (doc_id, doc_tokens); start: where the ids begin in the document."""
        n, at = len(ids), 0
        while n - at >= self.size:
            self.emit([(key, start + at, ids[at : at + self.size])])
            at += self.size
        while at < n:
            k = bisect.bisect_left(self.free, (n - at, -1))
            if k == len(self.free) and len(self.free) < self.limit:
                self.opened += 1
                self.windows[self.opened] = []
                bisect.insort(self.free, (self.size, self.opened))
                k = len(self.free) - 1
            room, window = self.free.pop(min(k, len(self.free) - 1) if k < len(self.free) else 0)
            piece = ids[at : at + room]
            self.windows[window].append((key, start + at, piece))
            at += len(piece)
            if len(piece) == room:
                self.emit(self.windows.pop(window))
            else:
                bisect.insort(self.free, (room - len(piece), window))

    def finish(self) -> list:
        """Merge the open windows one after the other; the pieces of the last, unless it is full."""
        left, room = [], self.size
        for _, window in sorted(self.free):
            for key, start, ids in self.windows[window]:
                at = 0
                while at < len(ids):
                    part = ids[at : at + room]
                    left.append((key, start + at, part))
                    at += len(part)
                    room -= len(part)
                    if not room:
                        self.emit(left)
                        left, room = [], self.size
        self.free, self.windows = [], {}
        return left


class _Output:
    """Pieces as record batches. Payloads of emitted pieces are made by digest; those of a tail are its ids."""

    def __init__(self, part: int, level: int, digest: bool) -> None:
        self.part, self.digest, self.rows = part, digest, []
        self.next = (level << 56) | (part << 28)

    def window(self, pieces: list, tail: bool = False) -> None:
        offset = 0
        for (doc, total), start, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            payload = zlib.crc32(raw).to_bytes(4, "big") if self.digest and not tail else raw
            self.rows.append((doc, start, len(ids), payload, total, self.next, offset, self.part, tail))
            offset += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, open_windows: int = 64, separator: int = 0, payload: str = "ids", fan_in: int = 16) -> DataFrame:
    """Pack all documents in sequences of at most size tokens.

    Input: doc_id (integer) and text; other columns are ignored. tokenizer: a byte-level BPE file of the tokenizers
    library. A document's ids are those of its whole text followed by separator; a null text is empty, so it and an
    empty one are the separator alone. Repeated rows are packed once each; an empty table gives an empty result.
    Returns a row for each piece: doc_id, start (ids of its document before it), length, ids (array<int>) or, with
    payload="crc32", ids_crc32 (CRC-32 of the ids as unsigned little-endian 32-bit numbers), doc_tokens, sequence_id,
    offset (in its sequence, gapless from 0).

    Each partition packs online with open_windows open windows and merges those at its end. What is left, less than one
    window a partition, is merged fan_in partitions at a time until one window is left, so no task ever sees more than
    fan_in windows and only the very last sequence may be shorter than size.
    """
    spark = docs.sparkSession
    prepare(spark)
    digest = payload == "crc32"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("packing", tokenizer), lambda: Encoder(tokenizer))
        out = _Output(TaskContext.get().partitionId(), 0, digest)
        packer = Packer(size, open_windows, out.window)
        stop = np.array([separator], np.uint32)
        for batch in batches:
            body, offsets, _ = tb.column_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for low, high in tb.blocks(offsets):
                ids, at = encoder.block(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for k in range(high - low):
                    own = np.concatenate([ids[at[k] : at[k + 1]], stop])
                    packer.add((names[low + k], len(own)), own)
                if len(out.rows) >= 4096:
                    yield out.batch()
        out.window(packer.finish(), tail=True)
        yield out.batch()

    def merge(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = packer = None
            for batch in batches:
                for doc, start, _, raw, total, _, _, part, _ in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                    if out is None or out.part != part // fan_in:
                        if out is not None:
                            out.window(packer.finish(), tail=True)
                            yield out.batch()
                        out = _Output(part // fan_in, level, digest)
                        packer = Packer(size, open_windows, out.window)
                    packer.add((doc, total), np.frombuffer(raw, "<u4"), start)
            if out is not None:
                out.window(packer.finish(), tail=True)
                yield out.batch()

        return run

    done = stored(columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(first), _PIECE), "packed")
    parts, level, result = (done.where("tail").agg(F.max("part")).first()[0] or 0) + 1, 0, done.where("not tail")
    tails = done.where("tail")
    while parts > 1:
        level += 1
        groups = tails.repartition(max(1, -(-parts // fan_in)), F.floor(F.col("part") / fan_in)).sortWithinPartitions("part", "offset")
        merged = stored(groups.mapInArrow(lean(merge(level)), _PIECE), "packed")
        result = result.unionByName(merged.where("not tail"))
        tails, parts = merged.where("tail"), -(-parts // fan_in)
    if digest:
        # the last window's payload is still its ids
        body = lambda df, tail: df.withColumn("ids_crc32", F.crc32("payload") if tail else F.conv(F.hex("payload"), 16, 10).cast("long"))
        result = body(result, False).unionByName(body(tails, True))
        last = "ids_crc32"
    else:
        ids_of = lambda batches: _ids(batches)
        result = result.unionByName(tails).mapInArrow(ids_of, "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")
        last = "ids"
    return result.select("doc_id", "start", "length", last, "doc_tokens", "sequence_id", "offset")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b.column(3)
        lists = [np.frombuffer(x, "<i4") for x in raw.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lists, pa.list_(pa.int32())), b.column(4), b.column(5), b.column(6)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
