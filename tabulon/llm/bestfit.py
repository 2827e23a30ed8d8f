"""Best-fit packing: whole documents in as few sequences as can be, certified by lower bounds from dual-feasible functions."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textblocks as tb
from tabulon.llm.common import columns_of, discard, prepare, ranked, stored
from tabulon.llm.pretokens import Encoder

#: Pieces that are packed together.
GROUP = 8192
#: Of this many sequences of a group, one with the shortest pieces is given to the next exchange.
SPARE = 64
_PIECE = "doc_id long, piece int, start long, length long, payload binary"
_PLACED = "key long, length long, sequence_id long, offset long, open boolean"
_encoders: dict[str, Encoder] = {}


# --- lower bounds


@functools.cache
def _families(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual-feasible functions as rows of whole numbers: values of the lengths 0..size and what a full sequence counts.

    f is dual feasible if the values of lengths that fit into one sequence never add up to more than a full one's. So the
    values of all pieces, divided by that and rounded up, are a number of sequences that no packing goes below.
    """
    s = np.arange(size + 1)
    values, full = [s], [size]
    for low in range(1, size // 2 + 1):  # short pieces count nothing, pieces beside which only those fit count all
        values.append(np.where(s > size - low, size, np.where(s >= low, s, 0)))
        full.append(size)
    for k in range(1, 65):  # rounding to multiples of 1 / k; exact multiples of 1 / (k + 1) stay as they are
        many = (k + 1) * s
        values.append(np.where(many % size == 0, s * k, many // size * size))
        full.append(size * k)
    for low in range(2, size // 2 + 1):  # pieces from low up to half a sequence count alike
        q = size // low
        values.append(np.where(2 * s > size, q - (size - s) // low, np.where(s >= low, 1, 0)))
        full.append(q)
    return np.array(values, np.int64), np.array(full, np.int64)


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that pieces need at least; counts: how many there are of each length, 0 to the length of a sequence."""
    values, full = _families(len(counts) - 1)
    return int(np.max(-(-(values @ counts) // full)))


# --- one group


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence of each piece, its place there, and the number of sequences: the longest piece first, each where least room stays."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    there, count = 0, 0  # bit r of there: a sequence has r tokens of room
    for at, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = there >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            found = by_room[room].pop()
            if not by_room[room]:
                there ^= 1 << room
        else:
            found, room = count, size
            count += 1
        bins[at], offsets[at] = found, size - room
        left = room - length
        if left:
            by_room[left].append(found)
            there |= 1 << left
    return bins, offsets, count


def _packer(size: int, level: int) -> Callable[[pa.Table], pa.Table]:
    """A function that packs one group; open: pieces of sequences that take part in the next exchange.

    If the group needs more sequences than its bound, all that aren't full are open. If it meets its bound, only the one
    with most room is, for the bound says nothing of what the rooms of several groups hold together. Those with the
    shortest pieces, one in SPARE, are open besides: short pieces fill rooms that long ones leave.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, lengths, group = table["key"].to_numpy(), table["length"].to_numpy(), table["part"][0].as_py()
        order = np.argsort(keys)
        keys, lengths = keys[order], lengths[order]
        bins, offsets, count = best_fit_decreasing(lengths, size)
        room = size - np.bincount(bins, lengths, count).astype(np.int64)
        again = room > 0
        if count == lower_bound(np.bincount(lengths, minlength=size + 1)):
            again &= np.arange(count) == np.argmax(room)
        shortest = np.full(count, size)
        np.minimum.at(shortest, bins, lengths)
        again[np.argsort(shortest, kind="stable")[: -(-count // SPARE)]] = True
        ids = (level << 56) | (group << 24) | bins
        return pa.table([pa.array(keys), pa.array(lengths), pa.array(ids), pa.array(offsets), pa.array(again[bins])], names=["key", "length", "sequence_id", "offset", "open"])

    return run


def pack_pieces(pieces: DataFrame, size: int, group: int = GROUP, rounds: int = 12) -> DataFrame:
    """Sequences for pieces (key, a unique long below 2 ** 56; length, 1 to size): key, length, sequence_id, offset.

    Pieces are dealt in turn, in the order of their lengths, to groups of about group pieces, so that all groups have
    nearly the same lengths; each is packed best fit decreasing. A lower bound from dual-feasible functions certifies a
    group's number of sequences. Groups with a gap exchange the pieces of all their sequences with room, certified ones
    those of their emptiest, and both some short ones; these are dealt anew and packed again, until the sequences are as
    few as the bound of all pieces allows, an exchange saves nothing, or rounds are over. Neither a group nor what is
    counted of all pieces (one number a length) grows with the data.
    """
    prepare(pieces.sparkSession)
    alone = pieces.where(F.col("length") == size).select("key", "length", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = pieces.where(F.col("length") < size).select("key", "length")
    counts = np.zeros(size + 1, np.int64)
    for r in pool.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most size rows
        counts[r["length"]] = r["n"]
    best, settled, level, sequences, now = lower_bound(counts), [alone], 0, None, None
    while True:
        n = pool.count() if level else int(counts.sum())
        if not n:
            break
        level += 1
        order = ranked(pool.withColumn("order", F.xxhash64("key", F.lit(level))), ("length", "order"), "order")
        dealt = order.select("key", "length", (F.col("rank") % -(-n // group)).alias("part"))
        after = stored(dealt.groupBy("part").applyInArrow(_packer(size, level), _PLACED), "bestfit")
        made = after.agg(F.count_distinct("sequence_id")).first()[0]
        if now is None:
            sequences = made
        else:
            were = now.where("open").agg(F.count_distinct("sequence_id")).first()[0]
            if made >= were:
                discard(after)
                settled.append(now.where("open"))
                now = None
                break
            sequences += made - were
        settled.append(after.where("not open"))
        now, pool = after, after.where("open").select("key", "length")
        if sequences == best or level == rounds:
            break
    if now is not None:
        settled.append(now.where("open"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part.select("key", "length", "sequence_id", "offset"))
    return out


# --- whole tables


def cut(docs: DataFrame, tokenizer: str, size: int, separator: int, digest: bool) -> DataFrame:
    """Documents' ids in pieces of size tokens, the first of which may be shorter: doc_id, piece, start, length, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        stop = np.array([separator], np.uint32)
        for batch in batches:
            body, offsets, _ = tb.column_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for low, high in tb.blocks(offsets):
                ids, at = encoder.block(body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                rows = []
                for k in range(high - low):
                    own = np.concatenate([ids[at[k] : at[k + 1]], stop]).astype("<u4")
                    edges = [0, *range((len(own) - 1) % size + 1, len(own) + 1, size)]
                    for piece, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
                        raw = own[start:end].tobytes()
                        rows.append((names[low + k], piece, start, end - start, zlib.crc32(raw).to_bytes(4, "big") if digest else raw))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "payload"])

    return columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)


def pack_best_fit(docs: DataFrame, tokenizer: str, size: int = 2048, separator: int = 0, payload: str = "ids", group: int = GROUP) -> DataFrame:
    """Pack documents, uncut where they fit, into as few sequences of at most size tokens as it can.

    Input: doc_id (integer) and text; other columns are ignored. tokenizer: a byte-level BPE file of the tokenizers
    library. A document's ids are those of its whole text followed by separator; one with more than size ids is cut into
    pieces of size, of which the first may be shorter. Returns a row for each piece: doc_id, piece (from 0), start (ids of
    its document before it), length, ids (array<int>) or, with payload="crc32", ids_crc32 (CRC-32 of the ids as unsigned
    little-endian 32-bit numbers), sequence_id, offset (in its sequence, gapless from 0).

    A null text is empty, so it and an empty one are the separator alone. Repeated rows and rows with a null doc_id are
    packed once each; pieces of equal length are placed in the order of rows; an empty table gives an empty result. See
    pack_pieces() for the method. Only lengths are exchanged; each piece's payload moves once, to meet its place.
    """
    prepare(docs.sparkSession)
    digest = payload == "crc32"
    pieces = stored(cut(docs, tokenizer, size, separator, digest).withColumn("key", F.monotonically_increasing_id()), "pieces")
    places = pack_pieces(pieces.select("key", "length"), size, group).drop("length")
    found = pieces.join(places, "key")
    if digest:
        last = F.conv(F.hex("payload"), 16, 10).cast("long").alias("ids_crc32")
        return found.select("doc_id", "piece", "start", "length", last, "sequence_id", "offset")
    shown = found.select("doc_id", "piece", "start", "length", "payload", "sequence_id", "offset")
    return shown.mapInArrow(_ids, "doc_id long, piece int, start long, length long, ids array<int>, sequence_id long, offset long")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = pa.array([np.frombuffer(x, "<i4") for x in b.column(4).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], lists, *b.columns[5:]], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])
