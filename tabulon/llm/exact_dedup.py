"""Exact deduplication with a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import SPACE, columns_of, prepare, text_or_empty

SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Live digests: a cuckoo filter in front of buckets of stored keys.

    The filter keeps a 16-bit fingerprint for each live key in one of two buckets of four slots. A fingerprint that is
    found is verified against the keys stored for it, so answers are exact; one that isn't found needs no look at the
    keys. When an insertion finds no place after KICKS moves, or the load passes 0.9, the table is doubled and filled
    anew from the stored keys. Keys are bytes of at least 12 evenly spread bytes (digests).
    """

    def __init__(self, capacity: int = 1024) -> None:
        self.content: dict[int, dict[bytes, list[int]]] = {}
        self.size = 0
        self._empty(capacity)

    def _empty(self, capacity: int) -> None:
        self.bits = max(4, (capacity * 10 // (9 * SLOTS)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.table = [0] * (SLOTS << self.bits)

    @staticmethod
    def _mark(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._mark(key)
        one = int.from_bytes(key[:8], "little") & self.mask
        return mark, one, (one ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, key: bytes) -> bool:
        """Whether the filter holds the key's fingerprint: false only for keys that aren't live."""
        mark, one, two = self._places(key)
        return mark in self.table[one * SLOTS : one * SLOTS + SLOTS] or mark in self.table[two * SLOTS : two * SLOTS + SLOTS]

    def get(self, key: bytes) -> list[int] | None:
        """What is stored with a live key."""
        return self.content.get(self._mark(key), {}).get(key) if self.maybe(key) else None

    def insert(self, key: bytes, value: list[int]) -> None:
        """Add a key that isn't live."""
        self.content.setdefault(self._mark(key), {})[key] = value
        self.size += 1
        if self.size * 10 > len(self.table) * 9 or not self._place(key):
            self._grow()

    def delete(self, key: bytes) -> bool:
        """Remove a live key and its fingerprint; false if it isn't live."""
        if self.get(key) is None:
            return False
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[slot] == mark:
                    self.table[slot] = 0
                    del self.content[mark][key]
                    self.size -= 1
                    return True
        raise AssertionError("a live key without a fingerprint")

    def _place(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        bucket = one
        for step in range(KICKS):
            for at in (one, two) if not step else (bucket,):
                for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.table[slot]:
                        self.table[slot] = mark
                        return True
            slot = bucket * SLOTS + step % SLOTS
            mark, self.table[slot] = self.table[slot], mark
            bucket = (bucket ^ (mark * 0x5BD1E995)) & self.mask
        return False

    def _grow(self) -> None:
        capacity = len(self.table) * 2
        while True:
            self._empty(capacity)
            if all(self._place(key) for keys in self.content.values() for key in keys):
                return
            capacity *= 2

    def items(self) -> Iterator[tuple[bytes, list[int]]]:
        for keys in self.content.values():
            yield from keys.items()


_GROUPS = "digest binary, keep_id long, group_size long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge rows (digest, keep_id, group_size, live) of one partition in an index; rows that aren't live take their digest out."""
    index, gone = CuckooIndex(), []
    for batch in batches:
        for key, keep, size, live in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if not live:
                gone.append((key, size))
                continue
            held = index.get(key)
            if held is None:
                index.insert(key, [keep, size])
            else:
                held[0] = min(held[0], keep)
                held[1] += size
    for key, size in gone:
        held = index.get(key)
        if held is not None:
            held[1] -= size
            if held[1] <= 0:
                index.delete(key)
    rows = list(index.items())
    for k in range(0, len(rows), 50_000):
        part = rows[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1][0] for x in part], pa.int64()), pa.array([x[1][1] for x in part], pa.int64())], names=["digest", "keep_id", "group_size"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256): SHA-256, in lowercase hex, of each text with runs of white space as one space; null as empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.sha2(F.regexp_replace(text_or_empty(docs), SPACE, " "), 256).alias("text_sha256"))


def build_index(seen: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The live digests (digest, keep_id, group_size) of rows (doc_id, text_sha256), less those of removed.

    Each partition folds its rows in an index of its own first, so a digest that a third of all rows share reaches the
    shuffle as one row for each partition. removed (text_sha256, n) takes n copies of a digest out; a digest whose last
    copy goes leaves the index, while keep_id of one that stays is not changed.
    """
    rows = seen.select(F.unhex("text_sha256").alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("live"))
    groups = rows.mapInArrow(_fold, _GROUPS).withColumn("live", F.lit(True))
    if removed is not None:
        out = removed.groupBy("text_sha256").agg(F.sum("n").cast("long").alias("n"))
        groups = groups.unionByName(out.select(F.unhex("text_sha256").alias("digest"), F.lit(None).cast("long").alias("keep_id"), F.col("n").alias("group_size"), F.lit(False).alias("live")))
    return groups.repartition("digest").select("digest", "keep_id", "group_size", "live").mapInArrow(_fold, _GROUPS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are equal up to runs of white space.

    Input: doc_id (unique, integer) and text; other columns are ignored. Returns one row for each input row: doc_id,
    keep_id (the smallest doc_id with that text), group_size, kept (doc_id = keep_id), text_sha256. Null texts count as
    empty, and all empty texts form one group; an empty table gives an empty result; texts of any length are hashed
    whole. A row with a null doc_id isn't counted and never the one kept: it has the keep_id and group_size of the documents
    with its text, both null where there are none.
    """
    prepare(docs.sparkSession)
    rows = digests(columns_of(docs, "doc_id", "text"))
    index = build_index(rows.where("doc_id is not null"))
    found = rows.join(index.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size"), "text_sha256", "left")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
