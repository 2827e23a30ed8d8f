"""N-gram Jaccard join: size-aware, with fixed-size subsets for small sets and inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textblocks as tb
from tabulon.llm.common import columns_of, components, discard, lean, prepare, stored

#: Cells of the frequency sketch that orders shingles, and cells in one of its rows.
CELLS, ROW = 1 << 20, 1 << 12
#: Members of a broadcast relation at most; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Prefixes above this length count alike when the boundary is chosen.
LONGEST_LIGHT = 64


def shingle_sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its word k-shingles); a text of fewer words has all of them as one."""
    body, offsets, _ = tb.column_bytes(batch.column(column))
    for low, high in tb.blocks(offsets):
        part = tb.lower_ascii(body[offsets[low] : offsets[high]])
        starts, ends, rows = tb.words(part, offsets[low : high + 1] - offsets[low])
        count = np.diff(rows)
        hashes = tb.span_hashes(part, starts, ends)
        made = np.where(count >= k, count - k + 1, count > 0)
        at = np.concatenate([[0], np.cumsum(made)])
        first = np.repeat(rows[:-1] - at[:-1], made) + np.arange(at[-1])
        found = tb.run_hashes(hashes, first, np.repeat(np.minimum(count, k), made))
        for j in range(high - low):
            yield low + j, np.unique(found[at[j] : at[j + 1]])


def sketch(texts: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle of each cell, over all documents: CELLS counts, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, found in shingle_sets(batch, 1, k):
                np.add.at(total, (found >> np.uint64(44)).astype(np.int64), 1)
        grid = total.reshape(-1, ROW)
        used = np.flatnonzero(grid.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([grid[r].tobytes() for r in used], pa.binary())], names=["line", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[line] = sums.get(line, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["line", "counts"])

    out = np.zeros((CELLS // ROW, ROW), np.int64)
    kind = "line int, counts binary"
    for r in texts.mapInArrow(lean(count), kind).repartition("line").mapInArrow(lean(add), kind).collect():
        out[r["line"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def prefix_length(n, percent: int):  # noqa: ANN001, ANN201
    """Tokens of which two sets with the similarity must share one, of a set of n in any common order."""
    return n - (n * percent + 99) // 100 + 1


def summary(found: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of about half as many ranges, one byte each (255: or more)."""
    bits = min(max(4, (len(found) // 2).bit_length()), 20)
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


#: Bits of a set's parity sketch.
ODD = 512


def parities(found: np.ndarray) -> np.ndarray:
    """For each of ODD cells, whether an odd number of the set's hashes fall in it, as ODD / 64 numbers.

    An element that only one of two sets has changes one bit, so the bits that differ are no more than such elements.
    """
    bits = np.bincount((found & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_in_common(one: bytes, two: bytes) -> float:
    """No fewer elements than two sets with these summaries have in common."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    if (x == 255).any() or (y == 255).any():
        return float("inf")
    x, y = x.astype(np.int64), y.astype(np.int64)
    size = min(len(x), len(y))
    return float(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())


def described(texts: DataFrame, k: int, percent: int, often: np.ndarray) -> DataFrame:
    """For each document: size of its set, a 128-bit identity and a summary of the set, its rarest tokens and what scanning their lists costs."""
    counts = texts.sparkSession.sparkContext.broadcast(often.astype(np.int32 if often.max(initial=0) < 2**31 else np.int64))
    level = float(often.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in (whole.slice(low, 1024) for whole in batches for low in range(0, len(whole), 1024)):
            size, one, two, rare, cost, bulk, odd = [], [], [], [], [], [], []
            for _, found in shingle_sets(batch, 1, k):
                n = len(found)
                size.append(n)
                one.append(int(found.sum(dtype=np.uint64).view(np.int64)) if n else 0)
                two.append(int(tb.mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                p = prefix_length(n, percent) + 1 if n else 0
                seen = table[(found >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((found, seen))[: min(p, n)]
                rare.append(found[order].view(np.int64))
                cost.append(float(np.maximum(seen[order][: p - 1] - level, 1).sum()) if n else 0.0)
                bulk.append(summary(found))
                odd.append(parities(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(cost, pa.float64()), pa.array(bulk, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n", "f1", "f2", "rare", "cost", "bulk", "odd"])

    return texts.mapInArrow(lean(run), "doc_id long, n long, f1 long, f2 long, rare array<long>, cost double, bulk binary, odd array<long>")


def boundary(reps: DataFrame, percent: int) -> int:
    """The largest prefix length up to which listing subsets of two tokens costs no more than scanning inverted lists."""
    p = F.least(prefix_length_column("n", percent), F.lit(LONGEST_LIGHT + 1))
    mean = {r["p"]: r["cost"] for r in reps.groupBy(p.alias("p")).agg(F.avg("cost").alias("cost")).collect()}
    best = 1
    for p in range(2, LONGEST_LIGHT + 1):
        if p in mean and (p + 1) * p / 2 > mean[p]:
            break
        best = p if p in mean else best
    return best


def prefix_length_column(n: str, percent: int):  # noqa: ANN201
    return (F.col(n) - F.expr(f"({n} * {percent} + 99) div 100") + 1).cast("long")


def postings(reps: DataFrame, percent: int, limit: int) -> DataFrame:
    """(key, rep, n): subsets of two rare tokens of light sets; single rare tokens of heavy sets and of light ones that a heavy set can match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, reps, sizes = [], [], []
            for rep, n, rare in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                tokens = np.array(rare, np.int64).view(np.uint64)
                p = prefix_length(n, percent)
                if p <= limit:
                    i, j = np.triu_indices(len(tokens), 1)
                    a, b = np.minimum(tokens[i], tokens[j]), np.maximum(tokens[i], tokens[j])
                    keys.append(tb.mix(a * np.uint64(0xD6E8FEB86659FD93) + b))
                    reps.append(np.full(len(i), rep))
                    sizes.append(np.full(len(i), n))
                # at 50% a set of one can link with a set of two by their one common token, which is no subset of two
                if p > limit or prefix_length(n * 100 // percent, percent) > limit or percent <= 50 and n <= 2:
                    keys.append(tokens[:p])
                    reps.append(np.full(len(tokens[:p]), rep))
                    sizes.append(np.full(len(tokens[:p]), n))
                if sum(map(len, keys)) > 200_000:
                    yield _rows(keys, reps, sizes)
                    keys, reps, sizes = [], [], []
            yield _rows(keys, reps, sizes)

    return reps.select("rep", "n", "rare").mapInArrow(lean(run), "key long, rep long, n long")


def _rows(keys: list, *numbers: list) -> pa.RecordBatch:
    one = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
    rest = [np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in numbers]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (one, *rest)], names=["key", "rep", "n"])


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that, by sizes and summaries, may have the similarity; none that has it is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [most_in_common(x, y) * (100 + percent) >= percent * (m + n) for m, x, n, y in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bulk").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have the similarity: first by summaries, then by their whole sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                found = [x.view(np.int64) for _, x in shingle_sets(part, 1, k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    pairs = stored(possible(pairs, reps, percent), "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidates")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    whole = stored(texts.join(chosen, "doc_id", "left_semi").mapInArrow(lean(sets), "doc_id long, tokens array<long>"), "sets")
    one = whole.select(F.col("doc_id").alias("a"), F.col("tokens").alias("s"))
    two = whole.select(F.col("doc_id").alias("b"), F.col("tokens").alias("t"))
    near = pairs.join(one, "a").join(two, "b")
    both, total = F.size(F.array_intersect("s", "t")), F.size("s") + F.size("t")
    near = near.select("a", "b", both.alias("i"), total.alias("u")).where(F.col("i") * (100 + percent) >= F.col("u") * percent)
    out = stored(near.select("a", "b").distinct(), "links")
    for t in (whole, ids, pairs):
        discard(t)
    return out


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, limit: int | None = None) -> DataFrame:
    """Groups of documents that are linked, directly or not, by similar sets of word shingles.

    Input: doc_id (integer) and text; other columns are ignored. Words are runs of other bytes than ASCII white space,
    with A-Z lower-cased; a set holds the distinct k-word shingles of the whole text, all words as one where there are
    fewer than k, none where there is no text. Two documents link when 100 * intersection >= percent * union, for sets
    that aren't empty (percent from 50 to 100). Returns a row for each input row, repeated ones too: doc_id, n_shingles,
    component_id (the smallest doc_id that links reach; its own doc_id without links). Rows of one doc_id are one node;
    a null doc_id has n_shingles and no component; an empty table gives an empty result.

    Equal sets become one representative by an aggregation. Tokens are ordered by a frequency sketch over all documents;
    in that order similar sets share a token of their prefixes, and two of prefixes longer by one. Sets with prefixes up
    to the boundary list their subsets of two; longer ones enter inverted lists of single tokens. The boundary is limit, or
    chosen by cost if None.
    Members of a list or subset are first compared with its smallest member, in one join. What this links falls into
    one component, and only members of one list in different components are compared further, unless their sizes or
    parity sketches (fewer differing bits than elements) rule it out inside the join. Pairs whose sizes and summaries
    (an upper bound of what they have in common) rule the similarity out go; the rest are compared exactly, on whole sets; every list is worked on by equi-joins whose large keys Spark can split, and none is cut short.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent lies between 50 and 100")
    spark = docs.sparkSession
    prepare(spark)
    texts = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    about = stored(described(texts, k, percent, sketch(texts, k)).withColumn("row", F.monotonically_increasing_id()), "sets")
    same = ["n", "f1", "f2"]
    least = 100 // (100 - percent) - 1 if percent < 100 else 1 << 62
    # one representative of each set; the smallest sets can only equal each other
    groups = about.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("one"))
    groups = stored(groups.select(*same, F.col("one.doc_id").alias("rep"), F.col("one.row").alias("row")), "groups")
    # summaries and tokens pass by a table of ids, which is all that is held or sorted
    kept = groups.where(F.col("n") >= least).select("row", "rep").hint("shuffle_hash")
    reps = stored(about.drop("doc_id", "f1", "f2").join(kept, "row").drop("row"), "reps")
    lists = postings(reps, percent, boundary(reps, percent) if limit is None else limit)
    heads = lists.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("head")).where("size > 1")
    shared = stored(lists.join(heads, "key"), "lists")
    pairs = stored(shared.where("rep > head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    node = texts.where("doc_id is not null")
    links = verified(pairs, reps, node, k, percent)
    found = stored(components(links), "components")
    # members of one list in different components
    placed = shared.where("size > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "head", F.coalesce("component", "rep").alias("component"))
    placed = stored(placed, "lists")
    discard(shared)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = placed.where("rep > head").join(mixed, "key").join(reps.select("rep", "odd"), "rep")
    left = rest.select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = rest.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    differ = " + ".join(f"bit_count(oa[{i}] ^ ob[{i}])" for i in range(ODD // 64))
    fits = f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na and ({differ}) * {100 + percent} <= (na + nb) * {100 - percent}"
    more = left.join(right, "key").where(f"a < b and ca <> cb and {fits}").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = stored(more, "pairs")
    if more.limit(1).count():
        links = links.unionByName(verified(more, reps, node, k, percent))
        found = stored(components(links), "components")
    member = about.where("n > 0").join(groups.select(*same, "rep"), same).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rows = member.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return rows.unionByName(about.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
