"""How quality filters interact: for each order of the filters, what each removes, shares with others and costs."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import SPACE, columns_of, discard, stored

FILTERS = "ABCDE"
#: Code points of a text's first block; each further one is GROWTH times as long, so that LAST of them hold any string.
BLOCK, GROWTH, LAST = 256, 8, 9
#: Rows of a side that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def _start(k: int) -> int:
    return BLOCK * (GROWTH**k - 1) // (GROWTH - 1)


def block_hashes(text: Column, hashed=F.xxhash64) -> Column:  # noqa: ANN001
    """The hash of each block of a text."""
    size = F.length(text)
    return F.array_compact(F.array(*[F.when(size > _start(k), hashed(F.substring(text, _start(k) + 1, min(BLOCK * GROWTH**k, 2**31 - 1)))) for k in range(LAST)]))


def _refined(size: Column, blocks: Column) -> Column:
    """The class of a text that all of its blocks have refined."""
    return F.aggregate(blocks, size.cast("long"), lambda now, h: F.xxhash64(now, h))


def _within(df: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    return df.join(F.broadcast(classes) if count <= BROADCAST_ROWS else classes, "class", "left_semi")


def duplicate_classes(texts: DataFrame) -> DataFrame:
    """Classes of texts that more than one row shares, by refining a partition of the rows: class, n.

    texts: n_code_points and blocks (their hashes). Rows are split by length, then by the hash of one block after the
    other; after each step, classes of one row go. A class's rows are never brought together: they are counted with
    partial sums, and classes of more than one are joined back.
    """
    live = texts.select(F.col("n_code_points").cast("long").alias("class"), "blocks")
    done = before = None
    for k in range(LAST + 1):
        if k:
            live = live.select(F.xxhash64("class", F.get("blocks", F.lit(k - 1))).alias("class"), "blocks")
        held = stored(live.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("blocks")).where("n > 1"), "classes")
        whole = held.where(F.col("blocks") <= k).select("class", "n")
        done = whole if done is None else done.unionByName(whole)
        open_ = held.where(F.col("blocks") > k).select("class")
        count = open_.count()
        if not count:
            break
        live = stored(_within(live, open_, count), "live")
        if before is not None:
            discard(before)
        before = live
    return done


def keepers(docs: DataFrame, marked: DataFrame, hashed=F.xxhash64) -> tuple[DataFrame, DataFrame | None]:  # noqa: ANN001
    """(class, keep_id) for classes whose texts are all equal; (class, text, keep_id) where hashes of different ones meet, or None.

    Whole texts of the classes that survive are compared: they are grouped by themselves, copies being folded in each
    task before anything moves.
    """
    classes = stored(duplicate_classes(marked), "duplicates")
    text = F.coalesce("text", F.lit(""))
    every = docs.select("doc_id", text.alias("text")).withColumn("class", _refined(F.length("text"), block_hashes(F.col("text"), hashed)))
    groups = _within(every, classes.select("class"), classes.count()).groupBy("class", "text").agg(F.min("doc_id").alias("keep_id"))
    told = stored(groups.groupBy("class").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id")), "keepers")
    odd = told.where("texts > 1").select("class")
    n = odd.count()
    return told.where("texts = 1").select("class", "keep_id"), _within(groups, odd, n) if n else None


def marks(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:  # noqa: ANN001
    """What each filter says of each row (fails_A to fails_D), with the text's length and block hashes; one look at the text.

    A: under 200 words. B: 100 * distinct words < 50 * words. C: 100 * [A-Z] characters > 2 * code points. D: holds one
    of #$%&*|. Words are runs of anything but ASCII white space, and case counts. A null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    seen = docs.select("doc_id", "part", F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct"), upper.alias("upper"), F.length(text).alias("n_code_points"), F.rlike(text, F.lit(r"[#$%&*|]")).alias("fails_D"), block_hashes(text, hashed).alias("blocks"))
    return seen.select(
        "doc_id", "part", "n_code_points", "blocks",
        (F.col("words") < 200).alias("fails_A"), (100 * F.col("distinct") < 50 * F.col("words")).alias("fails_B"),
        (100 * F.col("upper") > 2 * F.col("n_code_points")).alias("fails_C"), "fails_D",
    )


def failures(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:  # noqa: ANN001
    """doc_id, part and a bit mask of the filters that each row fails (A is bit 0; E, identical to a smaller doc_id's text, bit 4)."""
    seen = stored(marks(docs, hashed), "marks")
    seen = seen.withColumn("class", _refined(F.col("n_code_points"), F.col("blocks")))
    same, odd = keepers(docs, seen, hashed)
    found = seen.join(F.broadcast(same) if same.count() <= BROADCAST_ROWS else same, "class", "left")
    if odd is not None:
        # different texts of equal hashes: these rows are told apart by their texts
        mixed = stored(odd.select("class").distinct(), "mixed")
        found = found.join(mixed, "class", "left_anti")
        again = docs.withColumn("text", F.coalesce("text", F.lit("")))
        again = again.withColumn("class", _refined(F.length("text"), block_hashes(F.col("text"), hashed))).join(odd, ["class", "text"])
        apart = marks(again.select("doc_id", F.struct("part", "keep_id").alias("part"), "text"), hashed)
        found = found.unionByName(apart.select("doc_id", "part.part", "part.keep_id", *[c for c in apart.columns if c not in ("doc_id", "part")], F.lit(0).cast("long").alias("class")))
    found = found.withColumn("fails_E", F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False)))
    mask = sum((F.when(F.col(f"fails_{x}"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    return found.select("doc_id", "part", mask.alias("mask"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters and each of its steps, from the number of documents by mask.

    counts: part, mask (bit k: fails filters[k]), n, good, toxic; a row for each mask of a part at most. Returns a row
    for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A part's masks, 2 ** len(filters) at most, are one array, and its rows are made from that.
    """
    orders = ["".join(p) for p in itertools.permutations(filters)]
    bit = F.create_map(*itertools.chain.from_iterable((F.lit(x), F.lit(1 << k)) for k, x in enumerate(filters)))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    letters = F.split(F.substr("filter_order", F.lit(1), F.col("step") - 1), "")
    rows = rows.withColumn("own", bit[F.substr("filter_order", F.col("step"), F.lit(1))])
    rows = rows.withColumn("before", F.aggregate(letters, F.lit(0), lambda s, x: s + F.coalesce(bit[x], F.lit(0))))

    def total(value, condition) -> Column:  # noqa: ANN001
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(condition(m["mask"]), value(m)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    n = lambda m: m["n"]
    every = len(orders)
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda m: m["good"], here).alias("good_lost"),
        total(lambda m: m["toxic"], here).alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in every k-th order
        total(lambda m: F.floor(m["n"] * every / F.bit_count(m["mask"])), fails).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", hashed=F.xxhash64) -> DataFrame:  # noqa: ANN001
    """Counts of what five filters (see marks(); E: identical to a smaller doc_id's text) remove, in each of their 120 orders.

    docs: doc_id, text and part; labels: doc_id, quality, toxic; other columns are ignored. Returns for each value of
    part (null as an empty string), filter_order and step the documents kept after the step, removed by it, redundant
    (they fail its filter but were removed before), unique_fails (they fail its filter only), good_lost and toxic_lost
    (removed by it, with quality or toxic 1) and shapley (removed by its filter, summed over all orders).

    Null texts are empty, and all empty texts are equal. Rows with a null doc_id are counted, but are no copies and have
    none, for there is no order between them and others. Rows of one doc_id are counted once each, and the same text
    under the same doc_id is no copy; labels with one doc_id count as one that is good or toxic if any of them is.
    Tables without rows give no rows. Duplicates are found by partition refinement (duplicate_classes) and whole texts
    compared (keepers); texts that occur once don't move.
    """
    rows = columns_of(docs, "doc_id", "text", part).select("doc_id", "text", F.coalesce(F.col(part), F.lit("")).alias("part"))
    failed = failures(rows, hashed)
    good = labels.groupBy(labels["doc_id"].alias("__doc")).agg(F.max(labels["quality"]).alias("quality"), F.max(labels["toxic"]).alias("toxic"))
    told = failed.join(good, F.col("doc_id") == F.col("__doc"), "left")
    one = lambda c: F.count(F.when(F.col(c) == 1, 1))
    counts = told.groupBy("part", "mask").agg(F.count("*").alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))
    return interactions(counts)


#: The same in DuckDB's SQL.
SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from d),
m as (
  select doc_id, part, (len(words) < 200)::int as a, (100 * len(list_distinct(words)) < 50 * len(words))::int as b,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::int as c,
    regexp_matches(text, '[#$%&*|]')::int as d, coalesce(doc_id > first_id, false)::int as e
  from w),
l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
t as (
  select part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as f, a + b + c + d + e as fails, count(*) as n,
    count(*) filter (coalesce(good, false)) as good, count(*) filter (coalesce(toxic, false)) as toxic
  from m left join l on l.doc_id = m.doc_id group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
long as (
  select part, f, fails, n, good, toxic, x, struct_extract(f, 'A') * (x = 'A')::int + struct_extract(f, 'B') * (x = 'B')::int + struct_extract(f, 'C') * (x = 'C')::int
    + struct_extract(f, 'D') * (x = 'D')::int + struct_extract(f, 'E') * (x = 'E')::int as v from t, x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as x from o, range(1, 6) r(step)),
-- what each mask has failed before a step
g as (
  select t.part, t.f, t.fails, t.n, t.good, t.toxic, s.filter_order, s.step, s.x, v.v,
    (select sum(y.v) from long y where y.part = t.part and y.f = t.f and position(y.x in substr(s.filter_order, 1, s.step - 1)) > 0) as earlier
  from t cross join s join long v on v.part = t.part and v.f = t.f and v.x = s.x),
r as (
  select part, filter_order, step, x,
    coalesce(sum(n) filter (coalesce(earlier, 0) = 0 and v = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (coalesce(earlier, 0) = 0 and v = 1), 0)::bigint as removed,
    coalesce(sum(n) filter (coalesce(earlier, 0) > 0 and v = 1), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = 1 and v = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (coalesce(earlier, 0) = 0 and v = 1), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (coalesce(earlier, 0) = 0 and v = 1), 0)::bigint as toxic_lost
  from g group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley
from r"""
