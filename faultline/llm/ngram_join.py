"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a grouped prefix join.

Shingles are ordered by corpus frequency (rare first).  Two sets of Jaccard similarity t
share a shingle among their first |x| - ceil(t |x|) + 1, so only these prefixes are
joined.  Documents of equal sets collapse into one member, members of equal prefix and
size into one group; groups meet in the buckets of their prefix shingles, pass the size
and position filters, expand to members, and members are verified on their whole texts.

The order needs the frequent shingles only: those in at least ``HEAVY_SHARE`` of a
task's documents are counted over all documents.  Their number is bounded by the mean
set size over that share, whatever the size of the corpus; any order gives the same
result, a poor one only more candidates.

Edge cases: a null or empty text, or one without words, has an empty set and no link; a
text of fewer words than a shingle has one shingle; rows of a null id are returned and
not linked; rows are linked one by one, and rows with words that share an id are one
document, so an id with several texts links all that any of them is like; an empty table
gives an empty result; other columns are ignored.  Shingles are compared by 64-bit
hashes, and a row is named by a 64-bit hash of its id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import buckets as bk, textscan as ts
from .workspace import Workspace, partitions

#: Words of a shingle and similarity in per cent, unless a caller says otherwise.
WIDTH, PERCENT = 5, 80
#: Least share of a task's documents for a frequent shingle, least number in a task, and greatest number of frequent shingles.
HEAVY_SHARE, HEAVY_LEAST, HEAVY_MOST = 0.0002, 2, 1 << 17
#: Shingles that the exact test compares at once.
ELEMENTS = 1 << 20


def sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of each text, bounds) for blocks of texts."""
    for row, data, offsets in ts.blocks(column):
        low = ts.LOWER[data]
        starts, ends, first = ts.words(low, offsets, ts.SPACE_WORD)
        hashes = ts.range_hashes(ts.prefix_hashes(ts.BYTE_VALUES[low]), starts, ends)
        key, _, text = ts.windows(hashes, first, width)
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        key, text = key[new], text[new]
        yield row, key, np.searchsorted(text, np.arange(len(offsets)))


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - -(-percent * size // 100) + 1, 0)


def frequent(docs: DataFrame, width: int, place: Workspace, text: str = "text") -> np.ndarray:
    """Sorted hashes of the most frequent shingles and their counts, as two rows of HEAVY_MOST at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for _, k, _ in sets(batch.column(0), width)]
            if not keys:
                continue
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            often = count >= max(HEAVY_LEAST, HEAVY_SHARE * batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(count[often])], names=["key", "n"])

    counted = docs.select(text).mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = place.table("frequent", counted.where(F.col("n") > HEAVY_LEAST))
    how_many, least = 0, 1 << 62  # the counts of counts are few: each count above the square root of the rows is rare
    sizes = counted.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("k"))
    for r in sorted(sizes.collect(), key=lambda r: -r.n):
        how_many += r.k
        if how_many > HEAVY_MOST:
            break
        least = r.n
    rows = counted.where(F.col("n") >= least).toArrow()
    place.drop("frequent")
    key, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(key)
    return np.stack([key[order], n[order].astype(np.uint64)])


def signatures(docs: DataFrame, heavy: np.ndarray, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (hash of id and text), n, two 64-bit sums that stand for the set, one hash of the prefix, and the packed prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            out: dict[str, list] = {"n": [], "s1": [], "s2": [], "p": [], "prefix": []}
            for _, key, bounds in sets(batch.column(1), width):
                size = np.diff(bounds)
                owner = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                count = np.where(known[at] == key, often[at], 0) if len(known) else np.zeros(len(key), np.uint64)
                order = np.lexsort((key, count, owner))
                ordered = key[order]
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(key + np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 0x1234567)]
                out["n"].append(size)
                for name, total in zip(("s1", "s2"), sums):
                    out[name].append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                take = prefix_length(size, percent)
                out["p"].append(ts.range_hashes(ts.prefix_hashes(ordered | np.uint64(1)), bounds[:-1], bounds[:-1] + take).view(np.int64))
                out["prefix"] += [ordered[a : a + k].tobytes() for a, k in zip(bounds, take)]
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(join(out["n"]), pa.int64()), pa.array(join(out["s1"]), pa.int64()), pa.array(join(out["s2"]), pa.int64()), pa.array(join(out["p"]), pa.int64()), pa.array(out["prefix"], pa.binary())], names=["doc_id", "node", "n", "s1", "s2", "p", "prefix"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.withColumn("node", F.xxhash64("doc_id", "text")).mapInArrow(sign, "doc_id long, node long, n long, s1 long, s2 long, p long, prefix binary")


def index_rows(groups: DataFrame, parts: int) -> DataFrame:
    """Packed rows (key, id, size, place in the prefix) of the groups' prefixes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n").to_numpy()
            data, offsets = ts.string_buffers(batch.column("prefix").cast(pa.large_binary()).view(pa.large_string()))
            key = np.frombuffer(data.tobytes(), np.uint64)
            count = np.diff(offsets) // 8
            owner = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            ids = batch.column("gid").to_numpy()
            yield bk.packed_batch({"key": key, "id": ids[owner], "size": size[owner].astype(np.int32), "place": place.astype(np.int32)}, parts)

    return groups.select("gid", "n", "prefix").mapInArrow(spread, "part int, rows binary")


def own_rows(several: DataFrame, parts: int) -> DataFrame:
    """Packed rows of the members of each group, keyed by the group."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, member = (batch.column(c).to_numpy() for c in ("gid", "member"))
            zero = np.zeros(len(gid), np.int32)
            yield bk.packed_batch({"key": ts.mix(gid.view(np.uint64)), "id": member, "size": zero, "place": zero}, parts)

    return several.select("gid", "member").mapInArrow(spread, "part int, rows binary")


PLACED = (("key", np.uint64), ("id", np.int64), ("size", np.int32), ("place", np.int32))
#: lost: shingles of the group's prefix before this one that no other group holds; held: those of the whole prefix that others hold; odd0 to odd3: which of 256 classes hold an odd number of them.
ODD = tuple(f"odd{k}" for k in range(4))
KINDS = (*PLACED, ("lost", np.int32), ("held", np.int32), *((c, np.int64) for c in ODD))


def shared_rows(packed: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Rows of shingles that two groups or more hold, each with the number of its group's shingles before it that no other group holds."""

    def without_lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bk.tables_by_part(batches, PLACED):
            table, _ = bk.without_singles(*bk.sorted_buckets(rows, ["id"]))
            yield bk.packed_batch({"key": ts.mix(table["id"].view(np.uint64)), "id": table["id"], "size": table["size"], "place": table["place"], "shingle": table["key"]}, parts)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bk.tables_by_part(batches, (*PLACED, ("shingle", np.uint64))):
            table, first = bk.sorted_buckets(rows, ["id", "place"])
            held = np.diff(first)
            rank = np.arange(len(table["id"])) - np.repeat(first[:-1], held)
            odd = odd_classes(table["shingle"], first)
            yield bk.packed_batch({"key": table["shingle"], "id": table["id"], "size": table["size"], "place": table["place"], "lost": (table["place"] - rank).astype(np.int32), "held": np.repeat(held, held).astype(np.int32)} | {c: np.repeat(x, held) for c, x in zip(ODD, odd)}, parts)

    kind = "part int, rows binary"
    return packed.repartition(tasks, "part").mapInArrow(without_lone, kind).repartition(tasks, "part").mapInArrow(ranked, kind)


def odd_classes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of keys, 256 bits as four numbers: which of 256 classes hold an odd number of its keys."""
    kind = (keys >> np.uint64(24)) & np.uint64(255)
    out = np.zeros((len(ODD), len(first) - 1), np.int64)
    if len(keys):
        bit = np.uint64(1) << (kind & np.uint64(63))
        for k in range(len(ODD)):
            out[k] = np.bitwise_xor.reduceat(np.where(kind >> np.uint64(6) == k, bit, np.uint64(0)), first[:-1]).view(np.int64)
    return out


def size_and_place(percent: int) -> bk.Filter:
    """Whether a shared shingle leaves room for the similarity.

    By the sizes and its places: before it the sets share at most the shingles that others
    hold, behind it at most the shorter rest.  By the classes: a class that is odd in one
    prefix only holds a shingle that the prefixes don't share.
    """
    enough = shares_enough(percent)

    def test(left, right) -> Column:
        before = F.least(left("place") - left("lost"), right("place") - right("lost"))
        shared = before + F.least(left("size") - left("place"), right("size") - right("place"))
        room = 100 * shared.cast("long") >= percent * (left("size") + right("size") - shared).cast("long")
        apart = sum((F.bit_count(left(c).bitwiseXOR(right(c))) for c in ODD), F.lit(0))
        return room & enough(F.floor((left("held") + right("held") - apart) / 2), left("size"), right("size"))

    return test


def shares_enough(percent: int) -> bk.Enough:
    """Whether two sets that share so many prefix shingles can be alike: all else they share lies behind the prefix of one of them."""

    def behind(size: Column) -> Column:
        return F.ceil(percent * size.cast("long") / F.lit(100)) - 1

    def test(shared: Column, x: Column, y: Column) -> Column:
        both = shared + F.greatest(behind(x), behind(y))
        return 100 * both >= percent * (x.cast("long") + y.cast("long") - both)

    return test


def alike(width: int, percent: int):
    """Exact test of pairs on the texts' sets."""

    def test(texts: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, key, bounds in sets(texts, width):
            keys.append(key)
            sizes.append(np.diff(bounds))
        size = np.concatenate(sizes)
        first = np.cumsum(size) - size
        distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
        place = np.repeat(np.arange(len(size)), size) * len(distinct) + code  # ascending: texts in order, and their keys in order
        good = np.zeros(len(left), bool)
        load = np.cumsum(size[right])
        k = 0
        while k < len(left):
            end = max(k + 1, int(np.searchsorted(load, (load[k - 1] if k else 0) + ELEMENTS, "right")))
            x, y = left[k:end], right[k:end]
            wanted = np.repeat(x * len(distinct), size[y]) + code[ts.ragged(first[y], size[y])]
            at = np.minimum(np.searchsorted(place, wanted), max(0, len(place) - 1))
            found = np.concatenate([[0], np.cumsum(place[at] == wanted)]) if len(place) else np.zeros(1, np.int64)
            ends = np.cumsum(size[y])
            both = found[ends] - found[ends - size[y]]
            good[k:end] = (both > 0) & (100 * both >= percent * (size[x] + size[y] - both))
            k = end
        return good

    return test


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark = docs.sparkSession
    place = Workspace(spark, "ngram-join")
    signed = place.table("signed", signatures(docs, frequent(docs, width, place, text), width, percent, doc_id, text))
    ids = place.table("ids", signed.select("doc_id", "node", "n", "s1", "s2", "p"))
    able = ids.where("n > 0 and doc_id is not null")
    members = place.table("members", able.groupBy("n", "s1", "s2", "p").agg(F.min("node").alias("member"), F.min("doc_id").alias("least")))
    several = members.groupBy("n", "p").agg(F.min("member").alias("gid"), F.count("*").alias("k")).where("k > 1").drop("k")
    several = place.table("several", members.join(several, ["n", "p"]).select("gid", "member"))
    groups = signed.where("n > 0 and doc_id is not null").groupBy("n", "p").agg(F.min("node").alias("gid"), F.first("prefix").alias("prefix"))
    in_prefixes = signed.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0]
    parts = bk.parts_of(spark, 3 * in_prefixes)
    index = bk.Buckets(place, "index", shared_rows(index_rows(groups, parts), parts, max(partitions(spark), -(-parts // bk.PARTS_EACH))), KINDS, ["place"], size_and_place(percent), parts, enough=shares_enough(percent))
    place.drop("signed")
    own = bk.Buckets(place, "own", own_rows(several, parts), PLACED, ["place"], lambda x, y: F.lit(True), parts)
    place.release()
    set_of = able.select("doc_id", "n", "s1", "s2").join(members.drop("p", "least"), ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "member")
    set_of = place.table("sets", set_of)
    # an id with several sets links them
    twice = set_of.groupBy("doc_id").agg(F.min("member").alias("a"), F.max("member").alias("z")).where("a <> z")
    given = set_of.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("member").alias("b")).where("a <> b")
    texts = docs.select(F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("id"), F.col(text).alias("text")).where(F.col(doc_id).isNotNull() & F.col("text").isNotNull())
    linked = bk.linked(Expanded(index, own, several), texts, alike(width, percent), place, given)
    nodes = members.select("member", "least").join(linked.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    classes = place.table("classes", nodes)
    names = place.table("names", classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k"))
    for name in ("index", "index-hubs", "index-mixed", "index-live", "own", "own-hubs", "own-mixed", "own-live", "several", "members"):
        place.drop(name)
    place.release()
    called = classes.join(names, "component", "left").select("member", F.coalesce("component_id", "least").alias("component_id"))
    found = set_of.join(called, "member").select("doc_id", "n_shingles", "component_id")
    alone = ids.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


class Expanded:
    """Pairs of groups as pairs of members; a group's own members meet in a bucket of their own."""

    def __init__(self, groups: bk.Buckets, own: bk.Buckets, members: DataFrame):
        """members: (gid, member) of the groups of several members, their least member too."""
        self.groups, self.own, self.members = groups, own, members

    def star(self) -> DataFrame:
        """Each least member meets all members of the other group."""
        pairs = self.groups.star()
        right = pairs.join(self.members.select(F.col("gid").alias("b"), F.col("member").alias("y")), "b").select("a", F.col("y").alias("b"))
        left = pairs.join(self.members.select(F.col("gid").alias("a"), F.col("member").alias("x")), "a").select(F.col("x").alias("a"), "b")
        return pairs.unionByName(left).unionByName(right).unionByName(self.own.star()).distinct()

    def cross(self, early: DataFrame) -> DataFrame:
        """A group whose members are in several components meets every group of its buckets."""
        named = self.members.join(early.select(F.col("node").alias("member"), "component"), "member", "left").withColumn("component", F.coalesce("component", "member"))
        mixed = F.when(F.min("component") == F.max("component"), F.min("component")).otherwise(F.xxhash64(F.lit("several components"), "gid"))
        several = named.groupBy("gid").agg(mixed.alias("component")).select(F.col("gid").alias("node"), "component")
        nodes = early.join(several, "node", "left_anti").unionByName(several)
        pairs = self.groups.cross(nodes)
        wide = pairs.join(self.members.select(F.col("gid").alias("a"), F.col("member").alias("x")), "a", "left").join(self.members.select(F.col("gid").alias("b"), F.col("member").alias("y")), "b", "left")
        wide = wide.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        ends = wide.join(early.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(early.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").unionByName(self.own.cross(early)).distinct()
