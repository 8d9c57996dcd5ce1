"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gets a signature of ``SLOTS`` b-bit minima. The signature distance
of two documents is the number of slots that differ; two sets of similarity s differ in a slot with
probability 1 - s at most. The signature is split into ``CHUNKS`` chunks. If at most ``DISTANCE``
slots differ, some chunk has at most one wrong slot (pigeonhole: 2 * CHUNKS > DISTANCE), so one
key for each chunk and each slot left out of it finds *every* pair within the distance.

At similarity 0.8 the distance is Binomial(100, 0.2): over 39 in 4 of 1,000,000 pairs, and quickly rarer
above 0.8. ``exact`` closes that gap too: classes also get keys for the rarest fifth of their shingles, of which two sets
at the threshold share one. Pairs found are confirmed on the full shingle sets; hashes only propose.

Work is kept linear in large groups: texts of equal words become one class; each key links its
members to its smallest member only (a star); once these stars are confirmed and joined to components,
only keys that still hold several components are paired in full, in blocks of members of like size.

Before a pair's texts are fetched it must pass two bounds. Sizes: a similarity of s needs sizes within a
factor s. Odd sketches: a bit for each bin that holds an odd number of a set's shingles; two sketches differ
in at most as many bits as the sets differ in shingles, so no pair over the threshold is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches, connected_components, group_join, materialize, semi_join
from vesselwatch.session import discard

SLOTS, CHUNKS, DISTANCE = 100, 20, 39
#: Bits of a slot; a chunk's slots lie side by side in one 64-bit number.
BITS, WIDE = 12, SLOTS // CHUNKS
#: Members of a key that are compared with as many others in one group.
BLOCK = 2048
#: Classes whose shingles say which are frequent, and how many of these are told apart. They only steer the work.
FREQUENT_SAMPLE, FREQUENT = 20_000, 100_000
#: Numbers of 64 bits in an odd sketch.
ODD = 16
SKETCH = [f"o{k}" for k in range(ODD)]

_rng = np.random.Generator(np.random.PCG64(20240501))
_MUL = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_POSITION = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, separated by space and \\t..\\r; null: none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _WordHashes(dict):
    """64-bit hashes of words, remembered; forgotten when there are too many."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(ws: list[bytes], width: int, known: dict) -> np.ndarray:
    """Distinct sorted 64-bit hashes of the shingles of ``width`` words; fewer words: one shingle."""
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - width + 1
    if n < 1:
        return _mix((h * _POSITION[1 : len(h) + 1]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[:n] * _POSITION[0]
    for j in range(1, width):
        total += h[j : j + n] * _POSITION[j]
    total = _mix(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The chunks of non-empty sets: [len(sets), CHUNKS] of WIDE slots of BITS bits."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.empty((len(sets), SLOTS), np.uint32)
    first, block = 0, 1 << 15
    while first < len(sets):
        last, rows = first, 0
        while last < len(sets) and (last == first or rows + sizes[last] <= block):
            rows += sizes[last]
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum(sizes[first : last - 1])))
        for j in range(SLOTS):
            hashed = ((values * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)
            out[first:last, j] = np.minimum.reduceat(hashed, starts)
        first = last
    # the minimum itself is small: its bits are mixed before the low ones are kept
    mixed = out * np.uint32(0x9E3779B1)
    slots = ((mixed ^ (mixed >> np.uint32(15))) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    return (slots.reshape(-1, CHUNKS, WIDE) << np.arange(0, BITS * WIDE, BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Parities of the number of distinct shingles in each of 64 * ODD bins."""
    bins = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(54)  # 10 bits: 1024 bins
    return np.packbits((np.bincount(bins.astype(np.int64), minlength=64 * ODD) & 1).astype(np.uint8)).tobytes()


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1024):
                all_words = [words(t) for t in texts[at : at + 1024].to_pylist()]
                sets = [shingle_hashes(ws, width, known) for ws in all_words]
                full = [k for k, s in enumerate(sets) if len(s)]
                chunks = signatures([sets[k] for k in full])
                text_ids, packed, odd = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for row, k in enumerate(full):
                    text_ids[k] = hashlib.blake2b(b" ".join(all_words[k]), digest_size=16).digest()
                    packed[k] = chunks[row].tobytes()
                    odd[k] = odd_sketch(sets[k])
                yield pa.record_batch(
                    [ids[at : at + 1024], pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (text_ids, packed, odd))],
                    names=["id", "n_shingles", "text_id", "chunks", "odd"],
                )

    return run


_KEYS = [(chunk, left_out) for chunk in range(CHUNKS) for left_out in range(WIDE)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and key."""
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            ids = part.column(0).to_numpy()
            chunks = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, CHUNKS)
            keys = np.empty((len(ids), len(_KEYS)), np.uint64)
            for k, (chunk, left_out) in enumerate(_KEYS):
                others = np.uint64(~(((1 << BITS) - 1) << (BITS * left_out)) & (2**64 - 1))
                keys[:, k] = _mix((chunks[:, chunk] & others) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            yield pa.record_batch(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, len(_KEYS)))], names=["key", "cls"]
            )


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and sketch of each class as columns of longs."""
    for batch in batches:
        longs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, ODD)
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(ODD))], names=["cls", "n", *SKETCH])


def _candidate(percent: int) -> Column:
    """Whether the sides _a and _b may reach the threshold by sizes and sketches."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    # 100 |A & B| >= percent |A | B| means: the sets differ in at most (100 - percent) / (100 + percent) of |A| + |B|
    most = F.floor((100 - percent) * (n_a + n_b) / (100 + percent))
    bits = sum((F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in SKETCH), F.lit(0))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (bits <= most)


def _confirm(width: int, percent: int):
    def shingles(text: str | None) -> set:
        ws = words(text)
        return set(zip(*(ws[j:] for j in range(width)), strict=False)) if len(ws) >= width else {tuple(ws)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            keep = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2)
            for k, other in enumerate(batch.column(3)):
                if a[k] != last:
                    last, mine = a[k], shingles(texts[k].as_py())
                theirs = shingles(other.as_py())
                both = len(mine & theirs)
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    keep.append(k)
            yield pa.record_batch([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return run


def confirm_pairs(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets reach ``percent`` per cent; docs: (id, text)."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = semi_join(docs, ids, "id")
    return (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_confirm(width, percent), "a long, b long")
    )


def _rare_keys(width: int, percent: int, frequent):
    """A key for each of the rarest shingles of a class: as many as it can differ by from a set at the threshold, and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                keys, owners = [], []
                for cls, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    hashes = shingle_hashes(words(text), width, known)
                    # any order common to all sets serves: frequent ones last, so that they are seldom keys
                    place = np.minimum(np.searchsorted(frequent.value, hashes), max(len(frequent.value) - 1, 0))
                    often = frequent.value[place] == hashes if len(frequent.value) else np.zeros(len(hashes), bool)
                    first = np.concatenate([hashes[~often], hashes[often]])[: len(hashes) - -(-percent * len(hashes) // 100) + 1]
                    keys.append(_mix(first + np.uint64(0x2545F4914F6CDD1D)))
                    owners.append(np.full(len(first), cls))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).astype(np.int64))], names=["key", "cls"])

    return run


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for text in batch.column(0):
                yield pa.record_batch([pa.array(shingle_hashes(words(text.as_py()), width, known).view(np.int64))], names=["shingle"])

    return run


def rare_shingle_keys(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, cls): two classes at or above the threshold share a key (prefix filter)."""
    texts = docs.withColumnRenamed("id", "cls").join(classes.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    sample = texts.orderBy(F.xxhash64("cls")).limit(FREQUENT_SAMPLE).select("text").mapInArrow(_shingle_rows(width), "shingle long")
    often = sample.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(FREQUENT)  # at most so many rows
    frequent = np.sort(np.array([r["shingle"] for r in often.collect()], np.int64).view(np.uint64))
    return texts.select("cls", "text").mapInArrow(_rare_keys(width, percent, docs.sparkSession.sparkContext.broadcast(frequent)), "key long, cls long")


def _open_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs of different labels in the keys of ``rest`` (key, cls, label, n, sketch)."""
    largest = rest.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    if largest > BLOCK:
        return _pairs_in_blocks(rest, percent)
    a, b = (rest.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "label", "n", *SKETCH))) for s in "ab")
    pairs = a.join(b, "key").where((F.col("cls_a") < F.col("cls_b")) & (F.col("label_a") != F.col("label_b")) & _candidate(percent))
    return pairs.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def _pairs_in_blocks(rest: DataFrame, percent: int) -> DataFrame:
    """The same where some key is large.

    In a key the members outside its largest component (_a) meet all others (_b): of one large component with
    few strangers, only these are copied. Only sizes within the threshold meet: those of one band or of neighbouring
    ones. Both sides of a key and band are cut into blocks, and each pair of blocks is a group of its own.
    """
    columns = ("cls", "label", "n", *SKETCH)
    main = rest.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = rest.join(main, "key").withColumn("band", F.floor(F.log("n") / float(np.log(100.0001 / percent))))
    some = rest.where(F.col("label") != F.col("main")).withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    cut = lambda side, name: side.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))
    blocks = cut(some, "blocks_a").join(cut(rest, "blocks_b"), ["key", "band"])

    def dealt(side: DataFrame, name: str, other: str) -> DataFrame:
        """Rows with their own block, copied to every block of the other side."""
        mine, every = F.pmod(F.xxhash64("cls"), f"blocks_{name}").alias(f"block_{name}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks_{other}") - 1)).alias(f"block_{other}")
        return side.join(blocks, ["key", "band"]).select("key", "band", mine, every, *(F.col(c).alias(f"{c}_{name}") for c in columns), F.col("main").alias(f"main_{name}"))

    met = dealt(some, "a", "b").join(dealt(rest, "b", "a"), ["key", "band", "block_a", "block_b"])
    once = (F.col("label_b") == F.col("main_b")) | (F.col("cls_a") < F.col("cls_b"))
    pairs = met.where(once & (F.col("label_a") != F.col("label_b")) & _candidate(percent))
    return pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``width``-word
    shingles (words lower-cased in A-Z; fewer words: the whole sequence is the one shingle).
    ``component_id`` is the smallest id reachable over links, ``kept`` marks that document. ``exact``: no link is
    lost, whatever the signatures' distance; it costs a key for each of the rarest fifth of a class's shingles.

    Defined cases: a null or empty text, or one of white space only, has an empty set and links with
    nothing. Texts with equal words are one class whatever their number. Rows with a null id are one
    another's strangers: each is returned with a null component and kept. Repeated ids are repeated
    rows of one document. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = materialize(
        docs.mapInArrow(_features(width), "id long, n_shingles long, text_id binary, chunks binary, odd binary"), "shingles"
    )
    known = features.where("n_shingles > 0 and id is not null")
    first = [F.first(c).alias(c) for c in ("chunks", "odd", "n_shingles")]
    classes = materialize(known.groupBy("text_id").agg(F.min("id").alias("cls"), F.count("*").alias("copies"), *first), "classes")
    keys = classes.select("cls", "chunks").mapInArrow(_keys, "key long, cls long")
    if exact:
        keys = keys.union(rare_shingle_keys(classes, docs, width, percent))
    columns = ["n", *SKETCH]
    numbers = materialize(
        classes.select("cls", "n_shingles", "odd").mapInArrow(_numbers, ", ".join(f"{c} long" for c in ["cls", *columns])), "numbers"
    )
    side = lambda s: numbers.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    shared = keys.groupBy("key").agg(F.min("cls").alias("rep"), F.max("cls").alias("top")).where("rep < top")
    members = materialize(keys.join(shared.select("key", "rep"), "key"), "members")

    # first the stars: each member against the smallest of its key
    stars = members.where("cls > rep").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct()
    tried = materialize(stars.join(side("a"), "a").join(side("b"), "b").where(_candidate(percent)).select("a", "b"), "stars")
    linked = materialize(confirm_pairs(tried, docs, width, percent), "links")
    labels = connected_components(linked)

    # then all pairs in keys whose members are not yet in one component
    placed = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("label"))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    rest = materialize(placed.join(open_keys, "key").join(numbers, "cls"), "open")
    pairs = materialize(_open_pairs(rest, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = materialize(confirm_pairs(pairs, docs, width, percent), "links")
    joined = materialize(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "joined")
    discard(members, tried, linked, rest, pairs, more, numbers)
    labels = connected_components(joined)

    # texts of many copies are looked up apart
    roots = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("text_id", F.coalesce("component", "cls").alias("root"), "copies")
    return group_join(features.select("id", "n_shingles", "text_id"), roots, "text_id", "copies").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("root", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
