"""Line dedup: exact copies by hash, then a segment-partition edit join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import columns_of, components, discard, stored

#: Characters whose counts, odd or even, make up a line's signature: an edit changes at most two of its bits.
SIGNED = "etaoinsrhldcumpg"
#: Ids of a broadcast relation at most; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Steps of the search for what two lines begin or end with alike: up to 4,096 characters it is exact but for one.
HALVINGS = 12


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h1, h2): the lines of each text that aren't blank, without white space at their ends, from 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\x0b\x0c\r"))).where("line <> ''")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def signature(line: Column) -> Column:
    bits = [F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))) % 2, k) for k, c in enumerate(SIGNED)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _segment(length: Column, k: Column | int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k (from 0) of edits + 1; the last segments take what is left over."""
    k = k if isinstance(k, Column) else F.lit(k)
    rest = length % (edits + 1)
    base = ((length - rest) / (edits + 1)).cast("int")
    shorter = edits + 1 - rest
    return base * k + F.greatest(F.lit(0), k - shorter), base + F.when(k >= shorter, 1).otherwise(0)


def places(edits: int, own: bool) -> list[tuple[int, int, int]]:
    """(less, k, shift): where segment k of a line that is shorter by less can stand in this one; own: its own segments only.

    If k segments before a segment took a edits and those behind it b, with a + b at most edits, the substring is shifted
    by no more than a, and by no more than b from the difference of the lengths; one segment of edits + 1 has none, and
    can be chosen so that a is at most k and b at most edits - k.
    """
    if own:
        return [(0, k, 0) for k in range(edits + 1)]
    return [(less, k, shift) for less in range(edits + 1) for k in range(edits + 1) for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1)]


def entries(lines: DataFrame, edits: int, own: bool) -> DataFrame:
    """(key, id, mark) of lines (id, line, n): a row for each segment, or for each substring that can match another line's.

    The mark is what entries of one key are compared by before they become a pair. For one edit it holds hashes of the
    two halves of what the segment leaves of the line: the half before the edit stands where it does in the other line,
    the half behind it is shifted by less, so the marks agree in the upper or in the lower 32 bits. For more edits it is
    the signature. Places come before keys, one row each, so that one small expression makes all of them.
    """
    spots = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("less", "k", "shift"), spot, strict=True)]) for spot in places(edits, own)])
    signed = lines if edits == 1 else lines.withColumn("mark", signature(F.col("line")))
    rows = signed.withColumn("at", F.explode(spots)).select(*signed.columns, "at.less", "at.k", "at.shift")
    start, size = _segment(F.col("n") - F.col("less"), F.col("k"), edits)
    rows = rows.withColumn("start", start + F.col("shift")).withColumn("size", size).where("start >= 0 and start + size <= n")
    key = F.xxhash64(F.col("n") - F.col("less"), "k", F.substr("line", F.col("start") + 1, F.col("size")))
    if edits > 1:
        return rows.select(key.alias("key"), "id", "mark")
    # the part in front of the second segment or behind the first
    rows = rows.select("id", "less", key.alias("key"), F.expr("if(k = 0, substr(line, start + size + 1), substr(line, 1, start))").alias("part"), F.expr("if(k = 0, n - size - start, start) - less").alias("m"))
    rows = rows.withColumn("half", F.shiftright("m", 1))
    mark = F.expr("shiftleft(bigint(hash(substr(part, 1, half))), 32) | (bigint(hash(substr(part, half + 1 + less, m - half))) & 4294967295)")
    return rows.select("key", "id", mark.alias("mark"))


def fits(one: str, two: str, edits: int) -> Column:
    """Whether the marks of two lines that share a segment leave room for a distance of at most edits."""
    differ = F.col(one).bitwiseXOR(F.col(two))
    if edits > 1:
        return F.bit_count(differ) <= 2 * edits
    return (F.shiftright(differ, 32) == 0) | (differ.bitwiseAND(F.lit(0xFFFFFFFF)) == 0)


def within(one: str, two: str, edits: int) -> Column:
    """Whether two strings are within edits insertions, deletions and substitutions, by a banded bit-parallel automaton.

    Bit j of state d says that some prefix of one, j - edits characters longer than the prefix of two read so far, turns
    into it by d edits. A character of two moves all 2 * edits + 1 diagonals of a state at once.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    side = F.array_repeat(F.lit(""), edits)
    a = F.concat(side, F.split(F.col(one), ""), side, side)
    at = F.split(F.col(two), "")
    # match masks, one for each character of two
    padded = F.transform(at, lambda c, i: F.struct(c.alias("c"), F.slice(a, i + 1, band).alias("s")))
    masks = F.transform(padded, lambda x: F.aggregate(F.transform(x["s"], lambda y, j: F.when(y == x["c"], F.call_function("shiftleft", F.lit(1), j)).otherwise(0)), F.lit(0), lambda s, y: s + y))
    start = F.struct(*[F.lit(((1 << (d + 1)) - 1 << edits) & full).alias(f"r{d}") for d in range(edits + 1)])

    def step(state: Column, m: Column) -> Column:
        out: list[Column] = []
        for d in range(edits + 1):
            now = state[f"r{d}"].bitwiseAND(m)
            if d:
                last = state[f"r{d - 1}"]
                now = now.bitwiseOR(last).bitwiseOR(F.shiftright(last, 1)).bitwiseOR(F.shiftleft(out[d - 1], 1)).bitwiseAND(F.lit(full))
            out.append(now)
        return F.struct(*[x.alias(f"r{d}") for d, x in enumerate(out)])

    end = F.aggregate(masks, start, step)[f"r{edits}"]
    off = F.length(one) - F.length(two) + edits
    return (off >= 0) & (off < band) & (F.call_function("shiftright", end, off.cast("int")).bitwiseAND(F.lit(1)) == 1)


def _in_front(one: Column, two: Column, least: Column) -> Column:
    """Characters that two strings begin with alike, or up to least / 2 ** HALVINGS (rounded up) fewer; least: the shorter length."""

    def step(at: Column, j: Column) -> Column:
        size = F.call_function("shiftright", least + F.call_function("shiftleft", F.lit(1), j) - 1, j)
        return at + F.when((at + size <= least) & (F.substr(one, at + 1, size) == F.substr(two, at + 1, size)), size).otherwise(0)

    return F.aggregate(F.array(*[F.lit(j) for j in range(1, HALVINGS + 1)]), F.lit(0), step)


def middles(pairs: DataFrame, edits: int) -> DataFrame:
    """pairs (a, b, one, two) with what is left of one and two between what they begin and end with alike, behind a space.

    Their distance is that of the whole strings. For one edit, all but a character is alike: where more is left than that
    and what halving can miss, both are null.
    """
    rows = pairs.withColumn("least", F.least(F.length("one"), F.length("two")))
    rows = rows.withColumn("front", _in_front(F.col("one"), F.col("two"), F.col("least")))
    rows = rows.select("a", "b", "least", F.substr("one", F.col("front") + 1).alias("one"), F.substr("two", F.col("front") + 1).alias("two"), (F.col("least") - F.col("front")).alias("rest"))
    rows = rows.withColumn("back", _in_front(F.reverse("one"), F.reverse("two"), F.col("rest")))
    left = F.greatest(F.length("one"), F.length("two")) - F.col("back")
    fine = left <= 1 + 2 * F.ceil(F.col("least") / (1 << HALVINGS)) if edits == 1 else F.lit(True)
    cut = lambda c: F.when(fine, F.concat(F.lit(" "), F.substr(c, F.lit(1), F.length(c) - F.col("back")))).alias(c)
    return rows.select("a", "b", cut("one"), cut("two"))


def plausible(one: str, two: str, edits: int) -> Column:
    """Whether all but edits of 4 * (edits + 1) segments of one stand somewhere in two, as they do for strings within edits."""
    length, many = F.length(one), 4 * (edits + 1)
    missing = F.lit(0)
    for k in range(many):
        start, size = _segment(length, k, many - 1)
        missing = missing + F.when(F.contains(F.col(two), F.col(one).substr(start + 1, size)), 0).otherwise(1)
    return missing <= edits


def line_classes(docs: DataFrame, edits: int = 1, min_chars: int = 16) -> DataFrame:
    """Classes of lines that are equal, or linked, directly or not, by at most edits edits.

    Input: doc_id (integer) and text; other columns are ignored. Lines end at a newline; white space at their ends is
    left out of account, and blank lines are no lines. Returns a row for each line: doc_id, line_no (from 0, blank ones
    counted), rep_doc_id and rep_line_no (the line of its class with the smallest doc_id, then line_no), copies (lines
    equal to it), kept (whether it is that line). Lines shorter than min_chars characters are in one class only if equal.
    Null and empty texts have no lines. Repeated rows repeat their lines: rows of one (doc_id, line_no) that is the first
    of its class are all kept, and each counts as a copy. Lines of a null doc_id are never the first unless all are; an
    empty table gives an empty result.

    Equal lines become one by an aggregation and get a number. A line is cut into edits + 1 segments, of which one stands
    unchanged in any line within edits; an equi-join of segments with the substrings at the few places where they can
    stand, for each length, finds candidates. The join itself leaves out pairs that their marks rule out: for one edit,
    what the shared segment leaves of a line is cut into halves, of which one must be unchanged as well; for more, the
    signatures of letter counts differ by no more than two bits an edit. A key that many lines share is split by adaptive
    execution. Of the rest, what both lines begin and end with alike is cut off, which changes no distance; pairs with too
    few finer segments in common go, and what is left is verified.
    """
    rows = lines_of(columns_of(docs, "doc_id", "text"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "line")
    distinct = rows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("copies"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "copies", "first.none", "first.doc_id", "first.line_no", "first.line")
    distinct = stored(distinct, "lines")

    long = distinct.select("id", "line", F.length("line").alias("n")).where(F.col("n") >= min_chars)
    index = entries(long, edits, True).select("key", F.col("id").alias("a"), F.col("mark").alias("ma"))
    probe = entries(long, edits, False).select("key", F.col("id").alias("b"), F.col("mark").alias("mb"))
    pairs = index.join(probe, "key").where((F.col("a") != F.col("b")) & fits("ma", "mb", edits))
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    chosen = long.select("id", "line").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    chosen = stored(chosen, "chosen")
    both = pairs.join(chosen.select(F.col("id").alias("a"), F.col("line").alias("one")), "a").join(chosen.select(F.col("id").alias("b"), F.col("line").alias("two")), "b")
    between = stored(middles(both, edits), "middles")
    links = between.where("one is not null").where(F.when(plausible("one", "two", edits), within("one", "two", edits)).otherwise(False))
    links = stored(links.select("a", "b"), "links")
    for t in (between, chosen, ids, pairs):
        discard(t)
    found = stored(components(links), "components")
    discard(links)

    linked = distinct.select("id", "none", "doc_id", "line_no").join(found, F.col("id") == F.col("node"))
    heads = linked.groupBy("component").agg(F.min(F.struct("none", "doc_id", "line_no")).alias("head"))
    heads = found.join(heads, "component").select(F.col("node").alias("id"), "head")
    classes = distinct.select("id", "h1", "h2", "copies", "doc_id", "line_no").join(heads, "id", "left")
    classes = classes.select("h1", "h2", "copies", F.when(F.col("head").isNull(), F.struct("doc_id", "line_no")).otherwise(F.struct("head.doc_id", "head.line_no")).alias("rep"))
    out = rows.select("doc_id", "line_no", "h1", "h2").join(classes, ["h1", "h2"])
    out = out.select("doc_id", "line_no", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.line_no").alias("rep_line_no"), "copies")
    kept = F.col("doc_id").eqNullSafe(F.col("rep_doc_id")) & (F.col("line_no") == F.col("rep_line_no"))
    return out.withColumn("kept", kept)


def without_repeated_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs with the lines that aren't kept left out of text; all columns stay, and rows without such lines as they are."""
    gone = classes.where("not kept and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, docs["doc_id"] == F.col("__id"), "left")
    cut = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.select(*[F.when(F.col("__gone").isNull(), docs[c]).otherwise(cut).alias(c) if c == "text" else docs[c] for c in docs.columns])
