"""Candidate pairs from keyed rows, without all pairs of a bucket.

Raw rows (key, id, size, a few small numbers) travel to their part of the key space as
packed columns, and rows whose key nobody shares end there.  The others, the index, are
plain rows, and so are all pairs: joins and counts of them are Spark's own.

First the star pass pairs each bucket's hub (the member of least rank; a large bucket has
a few more) with the other members: as many pairs as rows, or a few times as many.  When these are verified and their components are known,
the cross pass pairs members of different components only.  Members that a verified
chain connects need no more comparisons, since only components are asked for; every
other pair that passes the caller's filters is made, so no link is lost.  In a bucket
the rows outside its largest component meet all rows, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import components
from .workspace import Workspace, partitions

#: Parts of the key space in a task, and raw bytes of a part.
PARTS_EACH, PART_BYTES = 4, 32 << 20
#: Rows of a bucket with one hub, and hubs of a larger one.
SMALL, HUBS = 16, 8
#: Rows of a bucket in a block, pairs of one id in a verification cell, pairs of a part of the cells.
BLOCK, CELL, PART_PAIRS = 4096, 64, 4096
#: Bits of the table that keeps most texts without a pair from being sent: so many for each pair, between these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27

Columns = dict[str, np.ndarray]
#: (left, right), each a function of a column's name -> whether a pair can be a link
Filter = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
#: (shared buckets, sizes of both) -> whether the pair can be a link
Enough = Callable[[Column, Column, Column], Column]

SQL_KINDS = {np.uint64: "long", np.int64: "long", np.uint32: "long", np.int32: "int", np.uint8: "int"}


def parts_of(spark: SparkSession, total_bytes: float) -> int:
    """Parts of the key space for so many bytes of raw rows."""
    return max(PARTS_EACH * partitions(spark), -(-int(total_bytes) // PART_BYTES))


def planes(column: np.ndarray) -> bytes:
    return column.view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def pack(rows: Columns, parts: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a batch by part of the key space, as bytes: column by column, and in a column byte by byte, so that high bytes compress to nothing."""
    part = ((rows["key"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    used, start = np.unique(part[order], return_index=True)
    ordered = [rows[k][order] for k in rows]
    for p, a, b in zip(used, start, [*start[1:], len(part)]):
        yield int(p), b"".join(planes(c[a:b]) for c in ordered)


def unpack(blob: bytes, kinds: Sequence[tuple[str, type]]) -> Columns:
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    n, at, out = len(blob) // width, 0, {}
    for name, t in kinds:
        size = np.dtype(t).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n)
        at += n * size
    return out


def packed_batch(rows: Columns, parts: int) -> pa.RecordBatch:
    got = list(pack(rows, parts))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "rows"])


def tables_by_part(batches: Iterator[pa.RecordBatch], kinds: Sequence[tuple[str, type]]) -> Iterator[Columns]:
    """All rows of each part of a task, part by part."""
    got: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got.setdefault(part, []).append(blob)
    for part in sorted(got):
        pieces = [unpack(b, kinds) for b in got.pop(part)]
        yield {k: np.concatenate([p[k] for p in pieces]) for k, _ in kinds}


def sorted_buckets(table: Columns, order: Sequence[str]) -> tuple[Columns, np.ndarray]:
    """Rows sorted by key and then by the named columns, and the first row of each bucket (one more at the end)."""
    at = np.lexsort([*(table[c] for c in reversed(order)), table["key"]])
    table = {k: v[at] for k, v in table.items()}
    key = table["key"]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return table, np.concatenate([first, [len(key)]]).astype(np.int64)


def without_singles(table: Columns, first: np.ndarray) -> tuple[Columns, np.ndarray]:
    """Only buckets with two rows or more."""
    size = np.diff(first)
    keep = np.repeat(size > 1, size)
    return {k: v[keep] for k, v in table.items()}, np.concatenate([[0], np.cumsum(size[size > 1])]).astype(np.int64)


def as_batch(table: Columns, kinds: Sequence[tuple[str, type]]) -> pa.RecordBatch:
    """Plain rows, unsigned numbers as the next signed ones."""
    wide = {np.uint64: np.int64, np.uint32: np.int64, np.uint8: np.int32}
    cast = lambda v, t: v.view(np.int64) if t is np.uint64 else v.astype(wide.get(t, t))
    return pa.RecordBatch.from_arrays([pa.array(cast(table[k], t)) for k, t in kinds], names=[k for k, _ in kinds])


def side(name: str) -> Callable[[str], Column]:
    return lambda c: F.col(f"{name}.{c}")


class Buckets:
    """The index of one join, stored once and read by both passes."""

    def __init__(self, place: Workspace, name: str, packed: DataFrame, kinds: Sequence[tuple[str, type]], rank: Sequence[str], test: Filter, parts: int, sided: bool = False, enough: Enough | None = None):
        """kinds: columns of the rows, key first, then id and size; rank: columns that order a bucket's members, the hub first; test: pair filter; parts: of the key space in packed.

        enough: condition on the number of buckets that a pair shares.  The star pass sees
        some of them only and does not ask; the cross pass counts all buckets of each pair
        that is still apart.

        sided: column ``look`` is 1 for rows that only look for others; two of them are no pair.
        """
        self.place, self.name, self.kinds, self.rank, self.test, self.sided, self.enough = place, name, list(kinds), list(rank), test, sided, enough
        kinds_, tasks = self.kinds, max(partitions(place.spark), -(-parts // PARTS_EACH))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in tables_by_part(batches, kinds_):
                table, first = sorted_buckets(table, ["id", *(k for k, _ in kinds_[2:])])
                new = np.ones(len(table["id"]), bool)  # equal rows of a bucket come from repeated texts
                if len(new):
                    same = table["key"][1:] == table["key"][:-1]
                    for k, _ in kinds_[1:]:
                        same &= table[k][1:] == table[k][:-1]
                    new[1:] = ~same
                table, first = without_singles(*sorted_buckets({k: v[new] for k, v in table.items()}, ["id"]))
                if sided and len(table["id"]):
                    found = np.repeat(np.minimum.reduceat(table["look"], first[:-1]) == 0, np.diff(first))
                    table = {k: v[found] for k, v in table.items()}
                yield as_batch(table, kinds_)

        schema = ", ".join(f"{k} {SQL_KINDS[t]}" for k, t in kinds_)
        self.rows = place.table(name, packed.repartition(tasks, "part").mapInArrow(gather, schema))

    def _may(self, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
        apart = left("id") != right("id")
        if self.sided:
            apart &= left("look") + right("look") < 2
        return apart & self.test(left, right)

    def star(self) -> DataFrame:
        """(a, b): each bucket's hubs and its other members, where the filter lets them.  A large bucket has several hubs, drawn by hashes of the ids, so that members of other buckets meet the same ones."""
        others = [k for k, _ in self.kinds if k not in ("key", "id", *self.rank)]
        least = F.min(F.struct(*self.rank, "id", *others)).alias("hub")
        large = self.rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("key")
        drawn = self.rows.join(large, "key").withColumn("draw", F.explode(F.array(*map(F.lit, range(1, HUBS)))))
        first = ["look"] if self.sided else []
        more = drawn.groupBy("key", "draw").agg(F.min(F.struct(*first, F.xxhash64("id", "draw").alias("order"), "id", *(k for k, _ in self.kinds if k not in ("key", "id", *first)))).alias("hub"))
        fields = [k for k, _ in self.kinds if k != "key"]
        plain = lambda hubs: hubs.select("key", *(F.col(f"hub.{k}").alias(k) for k in fields))
        # a table of its own, so that adaptive execution can split the join at a hot key
        hubs = self.place.table(f"{self.name}-hubs", plain(self.rows.groupBy("key").agg(least)).unionByName(plain(more)).distinct())
        hub, row = side("h"), side("r")
        pairs = self.rows.alias("r").join(hubs.alias("h"), (F.col("r.key") == F.col("h.key")) & self._may(hub, row))
        return pairs.select(F.least(hub("id"), row("id")).alias("a"), F.greatest(hub("id"), row("id")).alias("b")).distinct()

    def cross(self, members: DataFrame) -> DataFrame:
        """(a, b) of different components that share a bucket, where the filters let them; members: (node, component) of the star pass's links."""
        named = self.rows.join(members.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        runs = named.groupBy("key", "component").agg(F.count("*").alias("k"))
        mixed = runs.groupBy("key").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("n")).where(F.col("main.k") < F.col("n"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        mixed = mixed.select("key", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.k")).alias("rows"), blocks(F.col("n")).alias("columns"))
        live = named.join(self.place.table(f"{self.name}-mixed", mixed), "key")
        live = self.place.table(f"{self.name}-live", live)
        block = F.pmod(F.xxhash64("id"), F.col("rows"))
        left = live.where("component <> main").withColumn("i", block.cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
        right = live.withColumn("j", F.pmod(F.xxhash64("id"), F.col("columns")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        x, y = side("x"), side("y")
        once = (y("component") == y("main")) | (x("component") < y("component"))
        meet = (x("key") == y("key")) & (x("i") == y("i")) & (x("j") == y("j")) & (x("component") != y("component")) & once & self._may(x, y)
        return self._counted(left.alias("x").join(right.alias("y"), meet), x, y)

    def _counted(self, pairs: DataFrame, x: Callable[[str], Column], y: Callable[[str], Column]) -> DataFrame:
        """(a, b) with a < b of joined rows, those that share enough buckets."""
        first = x("id") < y("id")
        ends = [F.least(x("id"), y("id")).alias("a"), F.greatest(x("id"), y("id")).alias("b")]
        if self.enough is None:
            return pairs.select(*ends).distinct()
        sizes = [F.when(first, x("size")).otherwise(y("size")).alias("na"), F.when(first, y("size")).otherwise(x("size")).alias("nb")]
        total = pairs.select(*ends, *sizes).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
        return total.where(self.enough(F.col("n"), F.col("na"), F.col("nb"))).select("a", "b")


def bit_table(ids: DataFrame, bits: int) -> DataFrame:
    """Bits of ids (column id: hashes, of which the low bits are taken) as words: a table of a size that the caller sets, which is broadcast."""
    bit, one = F.col("id").bitwiseAND(bits - 1), F.lit(1).cast("long")
    return ids.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, (F.col("_bit") % 64).cast("int"))).alias("_bits"))


def marked(rows: DataFrame, key: Column, table: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """rows with the bit table's words, and whether a row's bit is set."""
    bit, one = key.bitwiseAND(bits - 1), F.lit(1).cast("long")
    seen = rows.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(table), "_word", "left")
    return seen, F.coalesce(F.call_function("shiftright", F.col("_bits"), (bit % 64).cast("int")).bitwiseAND(one) == 1, F.lit(False))


def bit_words(table: DataFrame, bits: int) -> np.ndarray:
    """A bit table as an array, for Python workers."""
    rows, words = table.toArrow(), np.zeros(bits // 64, np.uint64)
    words[rows.column("_word").to_numpy()] = rows.column("_bits").to_numpy().view(np.uint64)
    return words


def has_bit(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = ids.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits_for(n: int) -> int:
    """Size of a bit table for n ids; beyond MOST_BITS full tables only let more rows pass."""
    bits = LEAST_BITS
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    return bits


def verify(pairs: DataFrame, texts: DataFrame, test: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray], place: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) that pass the test on their texts; texts: (id, text).

    Pairs meet their texts in cells, by their lesser id; an id of many pairs has several
    cells.  A text is sent once to each part of the cells that needs it, and the number of
    parts grows with the pairs.
    test: (texts, left, right) -> whether each pair of places in the texts is a link.
    """
    pairs = place.table(f"{name}-pairs", pairs)
    n = pairs.count()
    parts = max(PARTS_EACH * partitions(place.spark), -(-n // PART_PAIRS))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("k")).where("k > 1")
    salted = pairs.join(many, "a", "left")
    cell = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1))))
    cells = place.table(f"{name}-cells", salted.select("a", "b", F.pmod(cell, F.lit(parts)).cast("int").alias("part")))
    wanted = cells.select(F.col("a").alias("id"), "part").unionByName(cells.select(F.col("b").alias("id"), "part")).distinct()
    bits = bits_for(2 * n)
    table = place.table(f"{name}-bits", bit_table(wanted, bits))
    seen, may = marked(texts, F.col("id"), table, bits)
    sent = wanted.join(seen.where(may).select("id", "text"), "id").select("part", "id", "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").to_numpy()
        known, at = np.unique(ids, return_index=True)
        column = right.column("text").combine_chunks().take(pa.array(at)) if len(at) else pa.array([], pa.string())
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        i, j = np.searchsorted(known, a), np.searchsorted(known, b)
        good = np.flatnonzero((known[np.minimum(i, len(known) - 1)] == a) & (known[np.minimum(j, len(known) - 1)] == b)) if len(known) else np.zeros(0, np.int64)
        good = good[test(column, i[good], j[good])]
        return pa.table({"a": pa.array(a[good], pa.int64()), "b": pa.array(b[good], pa.int64())})

    found = cells.select(F.col("part").alias("cell"), "a", "b").groupBy("cell").cogroup(sent.groupBy("part")).applyInArrow(check, "a long, b long")
    found = place.table(f"{name}-links", found)
    for x in ("pairs", "cells", "bits"):
        place.drop(f"{name}-{x}")
    return found


def linked(buckets: Buckets, texts: DataFrame, test: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray], place: Workspace, given: DataFrame | None = None) -> DataFrame:
    """(node, component) over all links of the buckets' members; given: links (a, b) that need no test."""
    links = verify(buckets.star(), texts, test, place, "star")
    early = components(links if given is None else links.unionByName(given), place, "early")
    rest = verify(buckets.cross(early), texts, test, place, "cross")
    return components(early.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), place, "late")
