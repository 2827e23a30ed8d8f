"""Merkle manifest of a dataset: a hash tree for each group of rows and one over the groups, with a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import columns_of, discard, ranked, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a side that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def leaf(columns: Sequence[Column]) -> Column:
    """H of the columns: SHA-256, in lowercase hex, of each value's UTF-8 length, a colon and the value, or - if it is null."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]).cast("binary"), 256)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _levels(nodes: DataFrame, largest: int, fanout: int, *more: str) -> list[DataFrame]:
    """The levels above nodes (tree, idx, n, h), n nodes in each tree and largest the most: tree, idx, n, h, kids.

    A row's kids are its idx, h and, on the lowest level, the columns named in more, in order. Trees of one node have none.
    """
    levels, below, extra = [], nodes, more
    while largest > 1:
        kid = F.struct("idx", "h", *extra)
        runs = below.where("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("__run"), F.ceil(F.col("n") / fanout).alias("__n")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        level = runs.select("tree", F.col("__run").alias("idx"), F.col("__n").alias("n"), _digest(F.concat_ws("", F.col("kids")["h"])).alias("h"), "kids")
        below = stored(level, "level")
        levels.append(below)
        largest, extra = -(-largest // fanout), ()
    return levels


def _proofs(tops: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """From each tree's top down to the leaves: what is in the kids of the lowest level, tree, root and path.

    tops: tree, root (carried along) and path of each tree. path: an array of (left, right), the digests beside a node on
    either side in its run, its own run's first. A node's kids get its path with their own siblings put in front.
    """
    now = None
    for k, level in reversed(list(enumerate(levels))):
        own = level.where("n = 1").select("tree", "idx", "kids").join(tops, "tree")
        if now is None:
            runs = own
        else:
            runs = own.unionByName(level.where("n > 1").select("tree", "idx", "kids").join(now.select("tree", "idx", "root", "path"), ["tree", "idx"]))
        each = runs.select("tree", "root", "path", F.col("kids")["h"].alias("__hs"), F.posexplode("kids").alias("__pos", "__kid"))
        beside = F.struct(
            F.array_join(F.slice("__hs", F.lit(1), F.col("__pos")), "").alias("left"),
            F.array_join(F.slice("__hs", F.col("__pos") + 2, F.lit(fanout)), "").alias("right"),
        )
        now = each.select("tree", "root", F.concat(F.array(beside), "path").alias("path"), "__kid.*")
    return now


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, columns: Sequence[str] = COLUMNS, group: str = "source", key: str = "doc_id", fanout: int = 3) -> DataFrame:
    """Hash tree of a table, with a proof for each row.

    Each row is a leaf, the digest of columns (see leaf()). The leaves of a group ascend by key; while several nodes are
    left, every fanout consecutive ones become the digest of their digests. What is left is the group's subroot; subroots,
    ordered by group (null first, by UTF-8 bytes), give the root likewise. altered: expressions in place of columns, for
    a leaf as a changed table would have it.

    Returns for each row: key, leaf, altered_leaf (null if nothing is altered or it is the same), subroot, root, path
    (array of left, right: the digests beside the row's node on either side, from its own run up to the root).

    A null group is a group of its own; rows with a null key come first; rows with equal keys are ordered by their
    digests, and rows that are equal throughout each have a place and a proof. Texts may be empty or of any length:
    they are read once and don't move. Extra columns are ignored; an empty table gives an empty result.

    Rows are numbered within sorted ranges, so no task holds a group, and each level is a table of a third of the one
    below it. Proofs go down the levels with one join for each, so a digest moves once for each run below it and not
    once for each row.
    """
    altered = altered or {}
    rows = columns_of(docs, *dict.fromkeys([*columns, key, group]))
    own, other = leaf([F.col(c) for c in columns]), leaf([altered.get(c, F.col(c)) for c in columns])
    hashed = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), own.alias("h"), (other if altered else F.lit(None).cast("string")).alias("alt"))
    leaves = stored(hashed.withColumn("alt", F.when(F.col("alt") != F.col("h"), F.col("alt"))), "leaves")
    table = ranked(leaves, ("grp", "key", "h"), "ranked")
    discard(leaves)
    groups = stored(ranked(table.groupBy("grp").agg(F.min("rank").alias("start"), F.count("*").alias("n")), ("grp",), "groups").withColumnRenamed("rank", "tree"), "trees")
    count, largest = groups.agg(F.count("*"), F.max("n")).first()
    side = F.broadcast(groups) if count <= BROADCAST_ROWS else groups
    side = side.withColumnRenamed("grp", "__grp")
    nodes = table.join(side, F.col("grp").eqNullSafe(F.col("__grp"))).select("tree", (F.col("rank") - F.col("start")).alias("idx"), "n", "h", "key", "alt")
    levels = _levels(nodes, largest or 0, fanout, "key", "alt")

    lone = nodes.where("n = 1")
    tops = lone.select("tree", "h")
    for level in levels:
        tops = tops.unionByName(level.where("n = 1").select("tree", "h"))
    # the tree over the groups' subroots is tree 0 of one
    forest = stored(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "h"), "subroots")
    above = _levels(forest, count, fanout)
    no_path = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    if above:
        root = above[-1].select(F.col("tree"), F.col("h").alias("root"), no_path.alias("path"))
        subroots = _proofs(root, above, fanout).select(F.col("idx").alias("tree"), F.struct("root", F.col("h").alias("subroot")).alias("root"), "path")
    else:
        subroots = forest.select(F.col("idx").alias("tree"), F.struct(F.col("h").alias("root"), F.col("h").alias("subroot")).alias("root"), no_path.alias("path"))
    subroots = stored(subroots, "subroot-paths")
    if count <= BROADCAST_ROWS:
        subroots = F.broadcast(subroots)
    found = lone.select("tree", "h", "key", "alt").join(subroots, "tree").select("h", "key", "alt", "root", "path")
    if levels:
        found = found.unionByName(_proofs(subroots, levels, fanout).select("h", "key", "alt", "root", "path"))
    return found.select(F.col("key").alias(key), F.col("h").alias("leaf"), F.col("alt").alias("altered_leaf"), "root.subroot", "root.root", "path")


def proof_digest(path: Column) -> Column:
    """H of the digests beside a row's nodes, level by level, left to right."""
    return _digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda now, x: _digest(F.concat(x["left"], now, x["right"])))


def verified_rows(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and how it tells rows whose text lost its line breaks.

    Tampering takes the \\n of text where 2 divides the unsigned CRC-32 of the decimal doc_id; a null text or a null
    doc_id stays. Returns doc_id, leaf, subroot, root, proof_sha256 (all of the original table), folded_root (from the
    tampered leaf and the original siblings) and verified (whether that is the root).
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(F.coalesce(hit, F.lit(False)), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    rows = manifest(docs, altered)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("altered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in DuckDB's SQL. It has no CRC-32, so that is folded bit by bit from its polynomial.
SQL = r"""
with recursive rows_ as (
  select doc_id, source, text, doc_id::varchar as d,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
  from documents),
crc as (
  select *, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(d, ''), lambda c: ascii(c)::UBIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) as crc
  from rows_),
changed as (select *, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as other from crc),
leaves as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) as other
  from changed),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n,
    dense_rank() over (order by source nulls first) - 1 as tree from leaves),
nodes as (
  select 0 as level, tree, idx, n, leaf as h from placed
  union all
  select level + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from nodes where n > 1 group by level, tree, idx // 3, n),
subroots as (select tree, h from nodes where n = 1),
tops as (
  select 0 as level, tree as idx, (select count(*) from subroots) as n, h from subroots
  union all
  select level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from tops where n > 1 group by level, idx // 3, n),
runs as (select level, tree, idx // 3 as run, list(h order by idx) as hs from nodes where n > 1 group by level, tree, idx // 3),
top_runs as (select level, idx // 3 as run, list(h order by idx) as hs from tops where n > 1 group by level, idx // 3),
up as (
  select 0 as level, doc_id, leaf, tree, idx, n, '' as proof, other as fold from placed
  union all
  select up.level + 1, doc_id, leaf, up.tree, idx // 3, (n + 2) // 3, proof || array_to_string(list_concat(hs[1:idx % 3], hs[idx % 3 + 2:]), ''),
    sha256(array_to_string(hs[1:idx % 3], '') || fold || array_to_string(hs[idx % 3 + 2:], ''))
  from up join runs on runs.level = up.level and runs.tree = up.tree and runs.run = idx // 3 where n > 1),
over_ as (
  select 0 as level, doc_id, leaf, tree, tree as idx, (select count(*) from subroots) as n, proof, fold from up where n = 1
  union all
  select over_.level + 1, doc_id, leaf, tree, idx // 3, (n + 2) // 3, proof || array_to_string(list_concat(hs[1:idx % 3], hs[idx % 3 + 2:]), ''),
    sha256(array_to_string(hs[1:idx % 3], '') || fold || array_to_string(hs[idx % 3 + 2:], ''))
  from over_ join top_runs on top_runs.level = over_.level and top_runs.run = idx // 3 where n > 1)
select o.doc_id, o.leaf, s.h as subroot, t.h as root, sha256(o.proof) as proof_sha256, o.fold as folded_root, o.fold = t.h as verified
from over_ o join subroots s on s.tree = o.tree join (select h from tops where n = 1) t on true
where o.n = 1"""
