"""Embedding near-dedup by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tabulon.llm.common import columns_of, components, prepare, stored

#: Bits of a pass's hash, and vectors of a component that are compared with each other in one task.
BITS, BLOCK = 32, 2048
#: Vectors that the splits of a width are learned from, the least of them a group is split by, and trials of a pair to meet.
SAMPLE, LEAST, TRIED, TRIALS = 16_384, 16, 512, 32


def directions(seed: int, d: int, number: int) -> np.ndarray:
    """The random directions of a pass."""
    return np.random.default_rng([seed, d, number]).standard_normal((d, BITS))


def split(shares: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, cuts) of rows projected on a pass's directions.

    Each direction cuts a group, the rows alike in the bits before, at its own median, so that a crowd in one direction is
    split as evenly as the rest. Groups that would have fewer than LEAST sample rows aren't divided further: the bits
    after that are cut at their medians there. cuts: as learned from a sample, or None to learn them from these rows.
    """
    n, learn = len(shares), cuts is None
    depth = int(math.log2(max(1, n // LEAST))) if learn else cuts.shape[1].bit_length() - 1
    cuts = np.zeros((BITS, 1 << depth), np.float32) if learn else cuts
    shares = shares.astype(np.float32)
    group, code = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(BITS):
        if learn:
            order = np.lexsort((shares[:, level], group))
            sizes = np.bincount(group, minlength=1 << depth)
            some = np.flatnonzero(sizes)
            cuts[level, some] = shares[order[(np.cumsum(sizes) - sizes + sizes // 2)[some]], level]
        bit = shares[:, level] >= cuts[level, group]
        code = 2 * code + bit
        if level < depth:
            group = 2 * group + bit
    return code, cuts


def passes_for(x: np.ndarray, vectors: int, window: int, cosine: float, recall: float, seed: int) -> int:
    """Passes after which a pair at the threshold has met in a window with probability recall, wherever it lies.

    x: unit vectors, a sample of vectors ones. Some get a partner at the threshold, half of them in a random direction and
    half in that of a vector near by, and TRIALS passes are tried on the sample. A partner has met as well if it meets
    another vector that links with both. The fifth of either half, by how crowded it is there, that meets least counts.
    """
    if vectors <= window + 1 or len(x) < 2:
        return 1
    rng = np.random.default_rng([seed, x.shape[1]])
    tried = rng.permutation(len(x))[:TRIED]
    about = x[tried] @ x.T
    kth = max(0, len(x) - 1 - math.ceil(len(x) / 100))
    near = np.argpartition(about, kth, axis=1)[:, kth]
    crowd, inward = about[np.arange(len(tried)), near], np.arange(len(tried)) % 2 == 1
    aside = np.where(inward[:, None], x[near], rng.standard_normal((len(tried), x.shape[1])))
    aside -= (aside * x[tried]).sum(1, keepdims=True) * x[tried]
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    partners = cosine * x[tried] + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(aside, size, out=np.zeros_like(aside), where=size > 0)
    linked = (about >= cosine) & (partners @ x.T >= cosine)
    linked[np.arange(len(tried)), tried] = True
    who, whom = np.nonzero(linked)
    met = np.zeros(len(tried))
    for number in range(TRIALS):
        planes = directions(seed, x.shape[1], number)
        code, cuts = split(x @ planes)
        own, ranked = split(partners @ planes, cuts)[0][who], np.sort(code)
        low, high = np.minimum(own, code[whom]), np.maximum(own, code[whom])
        apart = np.searchsorted(ranked, high, "right") - np.searchsorted(ranked, low, "left")
        met[np.unique(who[apart <= window * len(x) / vectors])] += 1
    chances = [max(met[part].mean(), 0.5 / len(part)) / TRIALS for part in np.array_split(np.lexsort((crowd, inward)), 10) if len(part)]
    return max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - min(min(chances), 0.999))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Forest:
    """Union-find over the rows of a task, to pass on only links that join something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _neighbours(names: np.ndarray, x: np.ndarray, window: int, cosine: float) -> list[tuple[int, int]]:
    """Links, direct or over others, of rows at most window apart that join something not joined yet."""
    forest, out = _Forest(), []
    rough = x.astype(np.float32)
    for low in range(0, len(names) - 1, window):
        high, wide = min(low + window, len(names)), min(low + 2 * window, len(names))
        one, two = np.nonzero(rough[low:high] @ rough[low:wide].T >= cosine - 1e-4)
        later = two > one
        one, two = one[later], two[later]
        sure = np.concatenate([np.einsum("ij,ij->i", x[low + one[k : k + 65_536]], x[low + two[k : k + 65_536]]) >= cosine for k in range(0, len(one), 65_536)] or [np.empty(0, bool)])
        near = np.zeros((high - low, wide - low), bool)
        near[one[sure], two[sure]] = True
        fresh = np.ones(wide - low, bool)
        for start in np.flatnonzero(near.any(1)).tolist():
            if not fresh[start]:
                continue
            now = np.array([start])
            fresh[start] = False
            while len(now):
                found = near[now[now < high - low]].any(0)
                found[: high - low] |= near[:, now].any(1)
                now = np.flatnonzero(found & fresh)
                fresh[now] = False
                a = names[low + start].item()
                out += [(a, b) for b in names[low + now].tolist() if forest.join(a, b)]
    return out


def _edge(number: pa.DataType) -> pa.Schema:
    return pa.schema([("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int64()), ("place", pa.int64()), ("pass", pa.int32()), ("v", pa.list_(number))])


def _runs(batches: Iterator[pa.RecordBatch], key: list[int], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted rows in runs with equal key columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
        low = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[low]:
                if held and now != keys[low]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(low, k - low))
                now, low = keys[low], k
    if held:
        yield pa.Table.from_batches(held)


def _links(pairs: list[tuple[int, int]], kind: pa.Schema) -> pa.RecordBatch:
    n = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), *(pa.nulls(n, f.type) for f in list(kind)[2:])], schema=kind)


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, window: int = 512, passes: int | None = None, recall: float = 0.995, seed: int = 7) -> DataFrame:
    """Groups of vectors linked, directly or not, by a cosine of at least the threshold.

    Input: vec_id (integer) and embedding (array of numbers); other columns are ignored. Returns a row for each input
    row: vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id that links reach), kept
    (vec_id = component_id). Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    so do vectors of different lengths with each other. Rows repeated with the same vec_id and vector count once, and
    get a row each; a null vec_id links with nothing, has no component and isn't kept; an empty table gives an empty
    result.

    Equal vectors become one with a weight. In each pass the vectors are sorted by BITS random projections, each cut at
    the medians that a sample has among the vectors alike so far, as one number, over all partitions, and each is
    compared with its window successors, across partition bounds too. passes: as passes_for() finds on the sample for
    recall if None. Every link is verified in double precision. Links of all passes are united
    to components; the vectors of a component are then compared with each other for n_links, BLOCK against BLOCK, each
    pair of blocks a group of its own that returns a count per vector and no pairs.
    """
    spark = vectors.sparkSession
    prepare(spark)
    # components of a column of float32 stay such between steps; any other numbers are doubles
    held = "float" if vectors.schema["embedding"].dataType.elementType == FloatType() else "double"
    kind = _edge(pa.float32() if held == "float" else pa.float64())
    rows = columns_of(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{held}>"))
    fine = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("f1", F.when(F.expr(fine), F.xxhash64("embedding"))).withColumn("f2", F.when(F.col("f1").isNotNull(), F.xxhash64(F.lit(seed), "embedding")))
    usable = rows.where("f1 is not null").groupBy("vec_id", "f1", "f2").agg(F.first("embedding").alias("v"))
    groups = usable.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    reps = stored(groups.withColumn("d", F.size("v")), "vectors")
    counts = reps.groupBy("d").agg(F.count("*").alias("n"))
    lot = F.pmod(F.xxhash64("f1", "f2"), F.lit(1 << 30)) < F.lit(SAMPLE * (1 << 30)) / F.col("n")
    sampled = reps.join(F.broadcast(counts), "d").where(lot).select("d", "n", "rep", "v").toArrow().sort_by("rep")
    splits: dict[int, list[np.ndarray]] = {}
    total = 0
    for d, n in sorted(set(zip(sampled.column("d").to_pylist(), sampled.column("n").to_pylist(), strict=True))):
        own = sampled.filter(pa.array(np.asarray(sampled.column("d")) == d))
        x = unit(matrix(own.column("v").combine_chunks(), d))
        many = passes or passes_for(x, n, window, cosine, recall, seed)
        splits[d] = [split(x @ directions(seed, d, number))[1] for number in range(many)]
        total += n * many
    alone = [np.zeros((BITS, 1), np.float32)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column(2))
            for d in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == d))
                for low in range(0, len(own), 2048):
                    part = own.slice(low, 2048)
                    x = unit(matrix(part.column(1), d))
                    for number, cuts in enumerate(splits.get(d, alone)):
                        code = split(x @ directions(seed, d, number), cuts)[0]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number, np.int32)), part.column(2), pa.array(code), part.column(0), part.column(1)], names=["pass", "d", "code", "rep", "v"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        head: list[tuple] = []
        count, tail = 0, []
        for table in _runs(_sliced(batches), [0, 1]):
            d, p = table.column(1)[0].as_py(), table.column(0)[0].as_py()
            names = np.asarray(table.column(3).combine_chunks())
            raw = table.column(4).combine_chunks()
            n = len(names)
            for low in range(0, n, 1 << 14):
                high = min(n, low + (1 << 14) + window)
                x = unit(matrix(raw.slice(low, high - low), d))
                yield _links(_neighbours(names[low:high], x, window, cosine), kind)
            take = lambda a, b: [(names[k].item(), p, raw[k].as_py(), count + k) for k in range(a, b)]  # noqa: B023, E731
            if len(head) < window:
                head += take(0, min(n, window - len(head)))
            tail = (tail + take(max(0, n - window), n))[-window:]
            count += n
        for seam, side in ((me - 1, head), (me, tail)):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in side], pa.int64()), pa.nulls(len(side), pa.int64()), pa.array([seam] * len(side), pa.int64()), pa.array([x[3] if seam == me else x[3] + (1 << 40) for x in side], pa.int64()), pa.array([x[1] for x in side], pa.int32()), pa.array([x[2] for x in side], kind.field("v").type)], schema=kind)

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, [0, 1, 2]):
            d = table.column(2)[0].as_py()
            x = unit(matrix(table.column(4).combine_chunks(), d))
            pairs = _neighbours(np.asarray(table.column(3).combine_chunks()), x, window, cosine)
            yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in pairs], pa.int64()), pa.array([q[1] for q in pairs], pa.int64())], names=["a", "b"])

    coded = reps.select("rep", "v", "d").mapInArrow(project, f"pass int, d int, code long, rep long, v array<{held}>")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 * window)))
    swept = stored(coded.repartitionByRange(parts, "pass", "d", "code", "rep").sortWithinPartitions("pass", "d", "code", "rep").mapInArrow(sweep, f"a long, b long, seam long, place long, pass int, v array<{held}>"), "sweeps")
    over = swept.where("seam is not null").select("seam", "pass", F.size("v").alias("d"), F.col("a").alias("rep"), "v", "place")
    over = over.repartition("seam", "pass", "d").sortWithinPartitions("seam", "pass", "d", "place").drop("place").mapInArrow(seams, "a long, b long")
    links = swept.where("seam is null").select("a", "b").unionByName(over)
    found = stored(components(links), "components")

    placed = reps.join(found.withColumnRenamed("node", "rep"), "rep")
    sizes = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = placed.join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "weight", "d", "v")

    def count(table: pa.Table) -> pa.Table:
        i, j, d = (table.column(c)[0].as_py() for c in ("i", "j", "d"))
        x = unit(matrix(table.column("v").combine_chunks(), d))
        own, weight, names = (np.asarray(table.column(c).combine_chunks()) for c in ("own", "weight", "rep"))
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = np.zeros(len(names), np.int64)
        for low in range(0, len(one), 512):
            rows = one[low : low + 512]
            near = x[rows] @ x[two].T >= cosine
            near &= rows[:, None] != two[None, :]
            links[rows] += near @ weight[two]
            if i != j:
                links[two] += weight[rows] @ near
        return pa.table({"rep": pa.array(names), "links": pa.array(links)})

    counted = dealt.groupBy("component", "i", "j").applyInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    about = reps.select("f1", "f2", "rep", "weight").join(counted, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    about = about.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "f1", "f2").join(about, ["f1", "f2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)
