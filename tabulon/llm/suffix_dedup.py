"""Suffix-array dedup: sparse suffix arrays over minimiser positions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textblocks as tb
from tabulon.llm.common import columns_of, lean, prepare, stored

#: Bytes of a word's hash in the contexts that are compared.
GRAIN = 3
#: Ids of a broadcast relation at most; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def selected(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the first smallest gram of each window of them: the same place in equal windows, wherever they stand."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    low = sliding_window_view(grams, window).argmin(1) + np.arange(len(grams) - window + 1)
    return low[np.append(True, low[1:] != low[:-1])]


def thinned(at: np.ndarray, hashes: np.ndarray, size: int, wide: int) -> np.ndarray:
    """Selected positions without most of those inside a text that goes on repeating itself.

    Neighbours that are alike in their size words and in wide words on either side match whatever the others match, over as
    much; of these one is kept every wide words, so what they cover stays covered.
    """
    inner = (at >= wide) & (at + size + wide <= len(hashes))
    if inner.sum() < 2:
        return at
    whole = np.zeros(len(at), np.uint64)
    whole[inner] = tb.run_hashes(hashes, at[inner] - wide, np.full(inner.sum(), size + 2 * wide))
    alike = np.append(False, inner[1:] & inner[:-1] & (whole[1:] == whole[:-1]) & (at[1:] - at[:-1] < wide))
    if not alike.any():
        return at
    keep, last = ~alike, 0
    for k in np.flatnonzero(alike | np.append(alike[1:], False)).tolist():
        follows = k + 1 < len(at) and alike[k + 1]
        # the last of a run, and the last one that is still within wide words of the one kept before
        if not alike[k] or not follows or at[k + 1] - at[last] > wide:
            keep[k], last = True, k
    return at[keep]


def _texts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashes of its words, hashes of its runs of size words)."""
    body, offsets, _ = tb.column_bytes(batch.column(column))
    for low, high in tb.blocks(offsets):
        part = tb.lower_ascii(body[offsets[low] : offsets[high]])
        starts, ends, rows = tb.words(part, offsets[low : high + 1] - offsets[low])
        hashes = tb.span_hashes(part, starts, ends)
        many = max(0, len(hashes) - size + 1)
        grams = tb.run_hashes(hashes, np.arange(many), np.full(many, size)) if many else np.empty(0, np.uint64)
        for j in range(high - low):
            yield low + j, hashes[rows[j] : rows[j + 1]], grams[rows[j] : max(rows[j], rows[j + 1] - size + 1)]


def _batch(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def anchors(texts: DataFrame, size: int, window: int) -> DataFrame:
    """(key, doc_id, pos): the suffixes that are kept, by the hash of their first size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            keys, docs, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row, hashes, grams in _texts(batch, 1, size):
                at = thinned(selected(grams, window), hashes, size, window - 1)
                keys.append(grams[at])
                docs.append(np.full(len(at), ids[row]))
                places.append(at)
            yield _batch(["key", "doc_id", "pos"], [np.concatenate(keys).view(np.int64), np.concatenate(docs), np.concatenate(places)], [pa.int64(), pa.int64(), pa.int32()])

    return texts.mapInArrow(lean(run), "key long, doc_id long, pos int")


def repeated(found: DataFrame) -> DataFrame:
    """Those whose key another has, and the first and last of each sorted partition, whose neighbours stand elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, first = None, False, True
        for batch in batches:
            if not len(batch):
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            key = np.asarray(whole.column(0))
            same = key[1:] == key[:-1]
            keep = np.append(known, same) | np.append(same, False)
            if first:
                keep[0], first = True, False
            yield whole.slice(0, len(whole) - 1).filter(pa.array(keep[:-1]))
            held, known = whole.slice(len(whole) - 1), bool(same[-1]) if len(same) else known
        if held is not None:
            yield held

    return found.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(lean(run), "key long, doc_id long, pos int")


_SUFFIX = "key long, after binary, before binary, doc_id long, pos int"
#: A row of a swept partition is a mark, a copy of another suffix (left and right as a mark's, that one's document in
#: first_doc and position in h), one that meets other partitions (with its hashes), or the first of a hash in its partition
#: (left: the hash's number, right: how many have it).
MARK, COPY, MEETS, HEAD = range(4)
_MARK = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("first_doc", pa.int64()), ("again", pa.bool_()), ("kind", pa.int32()), ("part", pa.int32()), ("h", pa.int64()), ("hashes", pa.list_(pa.int64()))])
_MARKS = "doc_id long, pos int, left int, right int, first_doc long, again boolean, kind int, part int, h long, hashes array<long>"


def _row(kind: int, n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    own = {"kind": np.full(n, kind)} | columns
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in own else own[f.name] if isinstance(own[f.name], pa.Array) else pa.array(own[f.name], f.type) for f in _MARK], schema=_MARK)


def _grid(column: pa.Array) -> np.ndarray:
    """Binary values of one length as the rows of a matrix, without copying them."""
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(n, -1)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading words of two contexts are equal; the end of a text equals nothing."""
    x, y = (z.reshape(len(z), z.shape[1] // GRAIN, GRAIN) for z in (x, y))
    same = (x == y).all(2) & (x != 0).any(2)
    return np.where(same.all(1), same.shape[1], same.argmin(1))


def _earliest(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each row, the row of the smallest rank so far among those with its key."""
    start = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(start) - 1
    # ranks of later groups are made smaller than all of earlier ones, so that a running minimum starts anew
    low = np.minimum.accumulate(rank - group * (len(key) + 1))
    where = np.empty(len(key), np.int64)
    where[rank] = np.arange(len(key))
    return where[low + group * (len(key) + 1)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _splits(key: np.ndarray, after: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(j, rows, hashes) for each j: hashes of the key, the j words before and the rest of the context's length after.

    Two suffixes match over a context's length beyond their first words if, and only if, they are equal in one of them.
    Rows whose text ends within those words have none.
    """
    n, wide = len(key), after.shape[1] // GRAIN

    def running(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = grid.reshape(n, wide, GRAIN).astype(np.uint64) @ (np.uint64(256) ** np.arange(GRAIN, dtype=np.uint64))
        sums = np.zeros((wide + 1, n), np.uint64)
        for k in range(wide):
            sums[k + 1] = _mixed(sums[k] + codes[:, k] + np.uint64(k + 1))
        return sums, np.where((codes == 0).any(1), (codes == 0).argmax(1), wide)

    (left, words_left), (right, words_right) = running(before), running(after)
    for j in range(wide + 1):
        rows = np.flatnonzero((words_left >= j) & (words_right >= wide - j))
        base = _mixed(key[rows].astype(np.int64).view(np.uint64) + np.uint64(j))
        yield j, rows, _mixed(_mixed(base + left[j, rows]) ^ right[wide - j, rows])


def _matches(rows: pa.Table, size: int, least: int, reach: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Marks of sorted suffixes, and their keys.

    Each is compared with reach neighbours on either side, and with the earliest of its key before and behind it; where
    more share a key that can't go on in other partitions, also with the earliest of those that are equal over least words, for each place of these words. Of
    a pair that matches over least words, the later one (by doc_id, then position) stands again.
    """
    n = len(rows)
    key, doc, pos = (np.asarray(rows.column(c).combine_chunks()) if n else np.empty(0, np.int64) for c in (0, 3, 4))
    after, before = (_grid(rows.column(c).combine_chunks()) for c in (1, 2)) if n else (None, None)
    order = np.lexsort((pos, doc))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    if n:
        front = _earliest(key, rank)
        back = n - 1 - _earliest(key[::-1], rank[::-1])[::-1]
    else:
        front = back = np.empty(0, np.int64)
    best = np.full((n, 4), -1, np.int32)
    first = np.full(n, np.iinfo(np.int64).max)
    every = np.arange(n)
    partners = [(every[gap:], every[:-gap]) for gap in range(1, min(reach, n - 1) + 1)] + [(every, front), (every, back)]
    for one, two in partners:
        near = (key[one] == key[two]) & (rank[one] != rank[two]) & ((doc[one] != doc[two]) | (pos[one] != pos[two]))
        one, two = one[near], two[near]
        for low in range(0, len(one), 1 << 15):
            i, j = one[low : low + (1 << 15)], two[low : low + (1 << 15)]
            right, left = _agree(after[i], after[j]), _agree(before[i], before[j])
            span = left + right + size
            # a passage that overlaps itself is no other, but in copies in a row each run of least words stands apart
            good = (span >= least) & ((doc[i] != doc[j]) | (np.abs(pos[i] - pos[j]) >= least))
            i, j, left, right = i[good], j[good], left[good], right[good]
            swap = rank[i] < rank[j]
            later, sooner = np.where(swap, j, i), np.where(swap, i, j)
            for at, c in ((sooner, 0), (later, 2)):
                np.maximum.at(best[:, c], at, left)
                np.maximum.at(best[:, c + 1], at, right)
            np.minimum.at(first, later, doc[sooner])
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else every
    sizes = np.diff(np.append(starts, n))
    crowded = (sizes > reach + 1) & (starts > 0) & (starts + sizes < n)
    many = np.flatnonzero(np.repeat(crowded, sizes))
    # parts of many with whole keys
    bounds = np.append(0, np.cumsum(sizes[crowded]))
    bounds = bounds[np.append(True, np.diff(bounds >> 15) > 0)]
    for j, at, hashes in itertools.chain.from_iterable(((j, part[own], h) for part in [many[low:high]] for j, own, h in _splits(key[part], after[part], before[part])) for low, high in itertools.pairwise([*bounds.tolist(), len(many)])):
        order = np.lexsort((rank[at], hashes))
        at, hashes = at[order], hashes[order]
        start = np.append(True, hashes[1:] != hashes[:-1])[: len(at)]
        sooner = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
        good = (at != sooner) & ((doc[at] != doc[sooner]) | (pos[at] - pos[sooner] >= least))
        at, sooner = at[good], sooner[good]
        for who, c in ((sooner, 0), (at, 2)):
            best[who, c] = np.maximum(best[who, c], j)
            best[who, c + 1] = np.maximum(best[who, c + 1], least - size - j)
        first[at] = np.minimum(first[at], doc[sooner])
    parts = []
    for c, again in ((0, False), (2, True)):
        k = np.flatnonzero(best[:, c] >= 0)
        parts.append((doc[k], pos[k], best[k, c], best[k, c + 1], first[k] if again else doc[k], np.full(len(k), again)))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return _row(MARK, len(columns[0]), **dict(zip(_MARK.names, columns, strict=False))), key


def marks(texts: DataFrame, some: DataFrame, size: int, least: int, reach: int) -> DataFrame:
    """(doc_id, pos, left, right, first_doc, again) of suffixes that match another over least words.

    left and right: how far the match goes beyond the first size words; again: with an earlier suffix, in first_doc.
    """
    wide = least - size

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                ids, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for row, hashes, grams in _texts(batch, 1, size):
                    at = np.unique(np.array(places[row], np.int64))
                    at = at[at < len(grams)]
                    if not len(at):
                        continue
                    grain = hashes.view(np.uint8).reshape(-1, 8)[:, :GRAIN] | np.array([1] + [0] * (GRAIN - 1), np.uint8)
                    padded = np.concatenate([np.zeros((wide, GRAIN), np.uint8), grain, np.zeros((wide, GRAIN), np.uint8)])
                    after = padded[at[:, None] + wide + size + np.arange(wide)].reshape(len(at), -1)
                    before = padded[at[:, None] + wide - 1 - np.arange(wide)].reshape(len(at), -1)
                    out[0] += grams[at].view(np.int64).tolist()
                    out[1] += [x.tobytes() for x in after]
                    out[2] += [x.tobytes() for x in before]
                    out[3] += [ids[row]] * len(at)
                    out[4] += at.tolist()
                yield _batch(["key", "after", "before", "doc_id", "pos"], out, [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()])

    def edge(rows: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        """What sorted suffixes whose first words other partitions may have as well say to these.

        The first of those alike in all their contexts stands for all that don't overlap it: they match whatever it
        matches, over as much, so they are marked here as its copies. Those that are left are hashed for each place of
        the least words; of those with one hash only the first goes to other partitions, for all of them.
        """
        n, t = len(rows), rows.combine_chunks()
        key, after, before, doc, pos = (t.column(c).combine_chunks() for c in range(5))
        after, before = _grid(after), _grid(before)
        keys, docs, places = (np.asarray(x) for x in (key, doc, pos))
        new = np.append(True, (keys[1:] != keys[:-1]) | (after[1:] != after[:-1]).any(1) | (before[1:] != before[:-1]).any(1))
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        copy = (head != np.arange(n)) & ((docs != docs[head]) | (places - places[head] >= least))
        at = np.flatnonzero(copy)
        right, left = _agree(after[at], after[at]), _agree(before[at], before[at])
        whole = left + right + size >= least
        at, left, right = at[whole], left[whole], right[whole]
        yield _row(COPY, len(at), doc_id=docs[at], pos=places[at], left=left, right=right, first_doc=docs[head[at]], again=np.full(len(at), True), h=places[head[at]])
        who, k = np.unique(head[at], return_index=True)
        yield _row(MARK, len(who), doc_id=docs[who], pos=places[who], left=left[k], right=right[k], first_doc=docs[who], again=np.full(len(who), False))
        own = np.flatnonzero(~copy)
        # earlier places first
        own = own[np.lexsort((places[own], docs[own]))]
        for low in range(0, len(own), 1 << 15):
            some = own[low : low + (1 << 15)]
            table, has = np.zeros((len(some), wide + 1), np.int64), np.zeros((len(some), wide + 1), bool)
            for j, rows_, hashes in _splits(keys[some], after[some], before[some]):
                table[rows_, j], has[rows_, j] = hashes.view(np.int64), True
                found, first, many = np.unique(hashes, return_index=True, return_counts=True)
                first = some[rows_[first]]
                yield _row(HEAD, len(found), doc_id=docs[first], pos=places[first], left=np.full(len(found), j), right=many, part=np.full(len(found), part), h=found.view(np.int64))
            meets = np.flatnonzero(has.any(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(meets) + 1) * (wide + 1), pa.int32()), pa.array(table[meets].ravel(), mask=~has[meets].ravel()))
            yield _row(MEETS, len(meets), doc_id=docs[some[meets]], pos=places[some[meets]], part=np.full(len(meets), part), hashes=lists)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        found, key = _matches(rows, size, least, reach)
        yield found
        # keys at the ends may go on in other partitions
        yield from edge(rows.filter(pa.array((key == key[0]) | (key == key[-1]))), TaskContext.get().partitionId())

    def told(key: tuple, mine: pa.Table, firsts: pa.Table) -> pa.Table:
        """The marks of a partition's suffixes that stand again, by the earliest place of each of their hashes."""
        h = np.asarray(firsts.column("h").combine_chunks()) if len(firsts) else np.empty(0, np.int64)
        cdoc, cpos = (np.asarray(firsts.column(c).combine_chunks()) if len(firsts) else np.empty(0, np.int64) for c in ("cdoc", "cpos"))
        doc, pos = (np.asarray(mine.column(c).combine_chunks()) for c in ("doc_id", "pos"))
        n = len(doc)
        lists = mine.column("hashes").combine_chunks().flatten()
        known = np.asarray(lists.is_valid()).reshape(n, wide + 1)
        table = np.asarray(lists.fill_null(0)).reshape(n, wide + 1)
        order = np.argsort(h, kind="stable")
        h, cdoc, cpos = h[order], cdoc[order], cpos[order]
        left, right, first = np.full(n, -1), np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        for j in range(wide + 1 if len(h) else 0):
            at = np.minimum(np.searchsorted(h, table[:, j]), len(h) - 1)
            good = known[:, j] & (h[at] == table[:, j]) & ((doc != cdoc[at]) | (pos - cpos[at] >= least))
            left[good], right[good] = j, np.maximum(right[good], wide - j)
            first[good] = np.minimum(first[good], cdoc[at[good]])
        some = np.flatnonzero(left >= 0)
        return pa.table({"doc_id": pa.array(doc[some], pa.int64()), "pos": pa.array(pos[some], pa.int32()), "left": pa.array(left[some], pa.int32()), "right": pa.array(right[some], pa.int32()), "first_doc": pa.array(first[some], pa.int64()), "again": pa.array(np.full(len(some), True))})

    per_doc = some.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    ids = stored(some.select("doc_id").distinct(), "ids")
    chosen = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    suffixes = chosen.join(per_doc, "doc_id").select("doc_id", "text", "places").mapInArrow(lean(contexts), _SUFFIX)
    order = ["key", "after", "before", "doc_id", "pos"]
    # more partitions than a shuffle has otherwise, as each is held in memory with its contexts
    parts = 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = stored(suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lean(sweep), _MARKS), "marks")
    plain = ["doc_id", "pos", "left", "right", "first_doc", "again"]
    heads = swept.where(f"kind = {HEAD}").select("h", F.col("left").alias("j"), "right", "part", "doc_id", "pos")
    groups = heads.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("c"), F.sum("right").alias("n"), F.max("j").alias("j")).where("n > 1")
    groups = stored(groups.select("h", "j", F.col("c.doc_id").alias("cdoc"), F.col("c.pos").alias("cpos")), "heads")
    # a hash is sent to each partition that has it once
    firsts = heads.select("h", "part").distinct().join(groups, "h").select("part", "h", "cdoc", "cpos")
    mine = swept.where(f"kind = {MEETS}").select(F.col("part").alias("own"), "doc_id", "pos", "hashes")
    met = mine.groupBy("own").cogroup(firsts.groupBy("part")).applyInArrow(told, "doc_id long, pos int, left int, right int, first_doc long, again boolean")
    met = stored(met, "met")
    sooner = groups.groupBy(F.col("cdoc").alias("doc_id"), F.col("cpos").alias("pos")).agg(F.max("j").alias("left"), (wide - F.min("j")).cast("int").alias("right"))
    sooner = sooner.select("doc_id", "pos", "left", "right", F.col("doc_id").alias("first_doc"), F.lit(False).alias("again"))
    earlier = met.select(F.col("doc_id").alias("first_doc"), F.col("pos").cast("long").alias("h"), F.col("first_doc").alias("earlier"))
    copies = swept.where(f"kind = {COPY}").join(earlier, ["first_doc", "h"], "left").select("doc_id", "pos", "left", "right", F.least("first_doc", "earlier").alias("first_doc"), "again")
    return swept.where(f"kind = {MARK}").select(*plain).unionByName(met).unionByName(sooner).unionByName(copies)


def _spans(rows: list[dict], size: int, keep: bool) -> list[tuple[int, int, int]]:
    """United (start, end, first document) of a document's marks that stand here first, or that stand again."""
    out: list[list[int]] = []
    for start, end, first in sorted((r["pos"] - r["left"], r["pos"] + size + r["right"], r["first_doc"]) for r in rows if r["again"] != keep):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] = min(out[-1][2], first)
        else:
            out.append([start, end, first])
    return [tuple(x) for x in out]


def _minus(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for start, end, first in spans:
        for a, b, _ in others:
            if b <= start or a >= end:
                continue
            if a > start:
                out.append((start, a, first))
            start = max(start, b)
        if start < end:
            out.append((start, end, first))
    return out


def repeated_passages(docs: DataFrame, least: int = 50, size: int | None = None, reach: int = 4) -> DataFrame:
    """Passages of at least least words that stand more than once, in different documents or in one.

    Input: doc_id (integer) and text; other columns are ignored. Words are runs of other bytes than ASCII white space,
    with A-Z lower-cased. Returns a row for each maximal span of repeated words: doc_id, start_word, n_words,
    first_doc_id (the smallest document with which it was matched; its own where it is kept), kept (false for words that
    match an earlier place, by doc_id, then position; true for words that only later places match, so one copy of each
    word of a passage is kept). A passage that overlaps itself isn't another;
    of copies in a row all but the first are cut. Null and short texts hold no passages, rows of one doc_id are
    one document (repeated rows don't repeat its passages), a null doc_id is ignored, and an empty table gives an empty
    result.

    Of each window of least - size + 1 runs of size words, the suffix at the smallest hash is retained, so each passage
    holds one. Retained suffixes are sorted by their first words over all partitions; those with a repeated key come
    with up to least - size words on either side, are sorted by all of these and compared with reach neighbours and with
    the earliest one of their first words, and matches are extended to the left and to the right. Where more share their
    first words, each also meets the earliest one that is equal in the j words before and the least - size - j after, for
    each j, so every match over least words counts however many there are. The sort key ends with doc_id and position, so
    a passage that a third of all documents share is spread over as many partitions as it needs; of suffixes whose first
    words stand at a partition's ends, one of those alike in all words around them is hashed for each j, the first of each
    hash in its partition meets those of other partitions by a grouped minimum, and each partition is told the earliest
    place of its hashes. In a text that goes on repeating itself, one suffix every least - size words is kept.
    """
    prepare(docs.sparkSession)
    size = size or max(1, least // 2)
    texts = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    some = stored(repeated(anchors(texts, size, least - size + 1)), "anchors")
    found = stored(marks(texts, some, size, least, reach), "marks")
    placed = found.select("doc_id", F.struct("pos", "left", "right", "first_doc", "again").alias("mark"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                again = _spans(rows, size, False)
                out += [(doc, a, b - a, f, False) for a, b, f in again]
                out += [(doc, a, b - a, f, True) for a, b, f in _minus(_spans(rows, size, True), again)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield _batch(["doc_id", "start_word", "n_words", "first_doc_id", "kept"], columns, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])

    return placed.groupBy("doc_id").agg(F.collect_set("mark").alias("marks")).mapInArrow(lean(unite), "doc_id long, start_word long, n_words long, first_doc_id long, kept boolean")


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of spans that aren't kept cut out of text, together with the white space after them.

    All columns of docs stay; rows without such spans stay as they are. spans: as repeated_passages() returns it.
    """
    prepare(docs.sparkSession)
    gone = spans.where("not kept").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("__cut"))
    gone = stored(gone.withColumnRenamed("doc_id", "__id"), "cuts")
    names = docs.columns
    near = F.broadcast(gone.select("__id")) if gone.count() <= BROADCAST_IDS else gone.select("__id")
    touched = docs.join(near, docs["doc_id"] == F.col("__id"), "left_semi").join(gone, docs["doc_id"] == F.col("__id")).select(*names, "__cut")
    others = docs.join(near, docs["doc_id"] == F.col("__id"), "left_anti")
    where = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets, _ = tb.column_bytes(batch.column(where))
            texts = []
            for row, spans in enumerate(batch.column(len(names)).to_pylist()):
                part = body[offsets[row] : offsets[row + 1]]
                starts, _, _ = tb.words(part, np.array([0, len(part)]))
                keep = np.ones(len(part), bool)
                edge = np.append(starts, len(part))
                for s in spans:
                    a, b = min(s["start_word"], len(starts)), min(s["start_word"] + s["n_words"], len(starts))
                    keep[edge[a] : edge[b]] = False
                texts.append(part[keep].tobytes().decode("utf-8"))
            columns = [batch.column(k) for k in range(len(names))]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return touched.mapInArrow(lean(cut), docs.schema).unionByName(others)


