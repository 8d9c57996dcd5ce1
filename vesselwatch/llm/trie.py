"""The trie of conversations: a node for each distinct sequence of first turns.

Turns are encoded by a dictionary, a number for each distinct (role, text); texts don't move after that. Conversations
then go through MSD radix partitioning: a bucket holds those that share their first ``d`` turns, and a round splits the large
buckets by the number of turn ``d + 1``. A bucket of at most ``LOCAL`` turns goes to one task, where multikey
quicksort finishes it and the recursion emits its nodes; one with a single conversation is a chain and needs no task of
its own. Sums over subtrees go up from there through the few nodes of large buckets.

A conversation lies in segments of ``SEGMENT`` turns, and places within it are differences of global places, so
that no row and no task holds a whole long conversation outside a local bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vesselwatch.llm.common import bounded_batches, group_join, materialize

#: Turns and conversations of a bucket that one task finishes; turns of a row.
LOCAL, SEGMENT = 10_000, 512
#: Fixed values of the rebuilding: a family of conversations has a common beginning of up to WIDEST - 1 turns.
FAMILY, WIDEST = 5, 9

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()

# --- turns to numbers -----------------------------------------------------------------------------------------


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, number, bytes): turns in order, numbered by a dictionary of distinct (role, text).

    Order: turn, null first; of one turn by the SHA-256 digest of role and text. Rows are dealt to ranges of the order and
    numbered there; a place is the difference to the conversation's first row, wherever that lies.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    turns = materialize(turns, "turns")
    words = materialize(turns.groupBy("digest").agg(F.count("*").alias("uses")).withColumn("number", F.monotonically_increasing_id()), "dictionary")
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest")]
    ranged = group_join(turns, words, "digest", "uses", nulls=False).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("conv_id", "number", "bytes", F.monotonically_increasing_id().alias("row")), "placed")
    part = F.shiftright("row", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part", before.alias("before")))  # a row for each shuffle partition
    at = F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("part", part).join(offsets, "part").select("conv_id", "number", "bytes", at.alias("at"))
    firsts = placed.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("length"))
    met = group_join(placed, firsts, "conv_id", "length", nulls=False)
    return materialize(met.select("conv_id", (F.col("at") - F.col("first")).alias("place"), "number", "bytes"), "encoded")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, number, bytes) of the rebuilt conversations, and (conv_id, total) of all, turnless ones too.

    With ``h`` from its number's checksum a conversation begins with the first ``h`` turns of its family's first one and goes on with its
    own turns behind the first ``h``.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % WIDEST
    plan = lengths.select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("source"), h.alias("h"))
    sources = lengths.select(F.col("conv_id").alias("source"), F.col("length").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    plan = plan.join(sources, "source", "left").withColumn("taken", taken).withColumn("total", F.col("taken") + F.greatest(F.lit(0), F.col("length") - F.col("h")))
    plan = materialize(plan.select("conv_id", "source", "h", "taken", "length", "total"), "plan")
    own = group_join(turns, plan.select("conv_id", "h", "taken", "length"), "conv_id", "length", nulls=False).where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "number", "bytes")
    heads = turns.where(F.col("place") < WIDEST - 1).select(F.col("conv_id").alias("source"), "place", "number", "bytes")
    begun = plan.where("taken > 0").select("conv_id", "source", "taken").join(heads, "source").where("place < taken")
    return own.unionByName(begun.select("conv_id", "place", "number", "bytes")), plan.select("conv_id", "total")


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, segment, numbers, sizes): up to ``segment`` turns a row."""
    rows = turns.groupBy("conv_id", F.floor(F.col("place") / segment).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("place", "number", "bytes"))).alias("t"))
    return materialize(rows.select("conv_id", "segment", F.col("t.number").alias("numbers"), F.col("t.bytes").alias("sizes")), "segments")


# --- buckets in one task --------------------------------------------------------------------------------------


class Bucket:
    """Conversations that share their first ``depth`` turns, in rising order of their ids, with their further turns."""

    def __init__(self, depth: int, parent: int | None, size: int, ids: list[int], numbers: list[list[int]], sizes: list[list[int]]):
        self.depth, self.parent, self.size, self.ids, self.numbers, self.sizes = depth, parent, size, ids, numbers, sizes

    def nodes(self) -> list[list]:
        """Rows of ``NODE`` and, before them, the place of a node's parent in the list (-1 for the bucket's own).

        Multikey quicksort: members at a node are split in three by their next turn's number; the equal ones are a child, the
        others go on at the same depth. Splits keep the order of ids, so a node's first member is its smallest.
        """
        out: list[list] = []
        todo = [(list(range(len(self.ids))), 0, -1, True)]
        while todo:
            members, d, above, fresh = todo.pop()
            if fresh:
                size = (self.sizes[members[0]][d - 1] if d else self.size) or 0
                parent = self.parent if above < 0 else out[above][1]
                ended = ",".join(str(self.ids[m]) for m in members if len(self.numbers[m]) == d)
                out.append([above, self.ids[members[0]], self.depth + d, parent, len(members), 0, 0, (len(members) - 1) * size, hashlib.sha256(ended.encode()).hexdigest() if ended else _EMPTY])
                if above >= 0:
                    out[above][5] += 1
                above = len(out) - 1
                members = [m for m in members if len(self.numbers[m]) > d]
            if not members:
                continue
            pivot = self.numbers[members[len(members) // 2]][d]
            less, equal, more = [], [], []
            for m in members:
                number = self.numbers[m][d]
                (equal if number == pivot else less if number < pivot else more).append(m)
            todo += [(rest, d, above, False) for rest in (less, more) if rest]
            todo.append((equal, d + 1, above, True))
        for row in reversed(out):  # children stand behind their parents
            row[6] = row[6] or 1
            if row[0] >= 0:
                out[row[0]][6] += row[6]
                out[row[0]][7] += row[7]
        return out


def _finish(segment: int):
    """Arrow batches of buckets' rows, ordered by bucket, conversation and segment, to nodes (``top``: the bucket's own)."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")] + [("top", pa.bool_())])

    def batch(rows: list[list]) -> pa.RecordBatch:
        columns = [*zip(*(r[1:] for r in rows), strict=True), [r[0] < 0 for r in rows]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "depth", "parent", "bytes", "conv_id", "numbers", "sizes"]
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        out: list[list] = []
        for (_, depth, parent, size), group in groupby(rows, itemgetter(0, 1, 2, 3)):
            ids, numbers, sizes = [], [], []
            for conv, segments in groupby(group, itemgetter(4)):
                parts = list(segments)
                ids.append(conv)
                skip = depth % segment  # the first segment at hand holds the next turn
                numbers.append([x for r in parts for x in r[5] or ()][skip:])
                sizes.append([x for r in parts for x in r[6] or ()][skip:])
            out += Bucket(depth, parent, size, ids, numbers, sizes).nodes()
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids that come in order, node by node: a node's ids run through the hash and are never held."""
    now, digest = None, None
    done: list[tuple] = []
    for batch in batches:
        for bucket, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("bucket", "depth", "conv_id")), strict=True):
            if (bucket, depth) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (bucket, depth), hashlib.sha256(b"%d" % conv)
            else:
                digest.update(b",%d" % conv)
    if now is not None:
        done.append((*now, digest.hexdigest()))
    if done:
        columns = list(zip(*done, strict=True))
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["conv_id", "depth", "ends"])


# --- the trie -------------------------------------------------------------------------------------------------


def _rounds(members: DataFrame, segments: DataFrame, local: int, segment: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(splits, ends): conversations with the bucket that each round gave them, and those that end at a large bucket's node.

    Rows of a split: bucket (its smallest conversation), depth, parent (that of the bucket before), bytes of the last turn, n_convs,
    size (turns to come and conversations), conv_id, total.
    """
    root = members.agg(F.min("conv_id"), F.count("*"), F.coalesce(F.sum("total"), F.lit(0)) + F.count("*")).first()
    long = lambda value: F.lit(value).cast("long")
    now = members.select(
        long(root[0]).alias("bucket"), long(0).alias("depth"), long(None).alias("parent"), long(0).alias("bytes"), long(root[1]).alias("n_convs"), long(root[2]).alias("size"), "conv_id", "total"
    )
    splits, ends, depth = [materialize(now, "split-0")], [], 0
    while True:
        large = splits[-1].where((F.col("n_convs") > 1) & (F.col("size") > local))
        if large.isEmpty():
            return splits, ends
        ends.append(large.where(F.col("total") == depth).select("bucket", "depth", "conv_id"))
        here = segments.where(F.col("segment") == depth // segment).select("conv_id", F.col("numbers")[depth % segment].alias("digit"), F.col("sizes")[depth % segment].alias("bytes"))
        going = large.where(F.col("total") > depth).select("bucket", "conv_id", "total").join(here, "conv_id")
        going = materialize(going.select(F.struct("bucket", "digit").alias("key"), "bytes", "conv_id", "total"), "going")
        depth += 1
        kids = materialize(going.groupBy("key").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"), (F.sum(F.col("total") - depth) + F.count("*")).alias("size")), "kids")
        met = group_join(going, kids.select("*", F.col("n_convs").alias("uses")), "key", "uses", nulls=False)
        now = met.select(F.col("first").alias("bucket"), F.lit(depth).cast("long").alias("depth"), F.col("key.bucket").alias("parent"), "bytes", "n_convs", "size", "conv_id", "total")
        splits.append(materialize(now, f"split-{depth}"))


def _chains(single: DataFrame) -> DataFrame:
    """Nodes from a bucket's own one to the end of its only conversation."""
    nodes = single.select("conv_id", "parent", "total", F.col("depth").alias("top"), F.explode(F.sequence(F.col("depth"), F.col("total"))).alias("depth"))
    last = F.col("depth") == F.col("total")
    return nodes.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"), (F.col("depth") == F.col("top")).alias("top"),
    )


def prefix_trie(conversations: DataFrame, local: int = LOCAL, segment: int = SEGMENT) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie; columns as in ``NODE``.

    Defined cases: rows with a null conv_id are ignored; null roles and texts are empty ones; a null turn comes first, rows of one turn
    follow by the SHA-256 digest of role and text, repeated rows are turns of their own; conversations left without turns are
    members of the root only; ids may be negative (their family's first one is the multiple of five towards zero); an empty
    table has no nodes; other columns are ignored.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    turns, members = rebuilt(encoded_turns(conversations))
    segments = _segments(turns, segment)
    splits, ends = _rounds(members, segments, local, segment)
    single, small = F.col("n_convs") == 1, (F.col("n_convs") > 1) & (F.col("size") <= local)
    every = reduce(DataFrame.unionByName, splits)
    rest = every.where(small).join(segments, "conv_id", "left").where(F.col("segment").isNull() | (F.col("segment") >= F.floor(F.col("depth") / segment)) | (F.col("total") <= F.col("depth")))
    skipped = F.col("total") <= F.col("depth")  # nothing to come: the segments at hand are behind
    blank = lambda c: F.when(~skipped, F.col(c)).alias(c)
    rest = rest.select("bucket", "depth", "parent", "bytes", "conv_id", "segment", blank("numbers"), blank("sizes"))
    rest = rest.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "segment")
    below = rest.mapInArrow(_finish(segment), f"{NODE}, top boolean").unionByName(_chains(every.where(single)))
    if not ends:
        return below.drop("top")
    below = materialize(below, "below")
    upper = _upward(splits, ends, below.where("top"), (F.col("n_convs") > 1) & ~small)
    return reduce(DataFrame.unionByName, upper, below.drop("top"))


def _upward(splits: list[DataFrame], ends: list[DataFrame], below: DataFrame, large: Column) -> list[DataFrame]:
    """Nodes of the large buckets, level by level from the deepest, with the sums of what lies below them."""
    cells = ["bucket", "depth"]
    hashed = reduce(DataFrame.unionByName, ends).repartition(*cells).sortWithinPartitions(*cells, "conv_id").mapInArrow(_hash_ends, "conv_id long, depth long, ends string")
    hashed, levels = materialize(hashed, "ends"), []
    carried = ["parent_conv_id", "depth", "n_leaves", "saved_tokens"]
    for depth in reversed(range(len(ends))):
        nodes = splits[depth].where(large).groupBy(F.col("bucket").alias("conv_id")).agg(*(F.min(c).alias(c) for c in ("parent", "n_convs", "bytes")))
        children = below.where(F.col("depth") == depth + 1).select(*carried)
        if levels:
            children = children.unionByName(levels[-1].select(*carried))
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        found = nodes.join(sums, "conv_id", "left").join(hashed.where(F.col("depth") == depth).drop("depth"), "conv_id", "left")
        none = F.lit(0).cast("long")
        level = found.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"),
            F.coalesce("n_leaves", none + 1).alias("n_leaves"), (F.coalesce("saved", none) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
        )
        levels.append(materialize(level, f"level-{depth}"))
    return levels
