"""Line deduplication by a segment-partition edit join.

Lines are linked when at most ``EDITS`` insertions, deletions and substitutions of code
points separate them.  A line is cut into EDITS + 1 even segments; by the pigeonhole
principle a similar line holds one of them unchanged, near its place.  Segments are
indexed by (length of the line, number, content); a line probes, for each length up to
EDITS shorter, only the substrings whose places the multi-match rule allows.  Candidates
are verified by a banded bit-parallel edit distance, all pairs of a task at once.

Lines of fewer than ``least`` code points, in which two edits may change the sense, are
linked with exact copies only, down to ``short`` code points; the queries set it to
``SHORT``, by default they take no part.

Of each class of linked lines the first occurrence, by (document, line), stays; the
others are removed from their texts.

Tables that grow with the corpus are joined by sorting at every size, never broadcast.

Edge cases: empty lines, and blank ones of fewer than ``least`` code points, are never
removed, so paragraphs stay apart; a null text stays null and an empty one empty; rows of
a null id pass unchanged; a row's lines are named by its id and a hash of its text, so
rows that share an id but not the text are documents of their own, in order of that hash,
and rows equal in both are one document and lose the same lines; a document may lose all
lines and is then empty; an empty table gives an empty result; other columns pass
unchanged, n_lines and n_removed are replaced.
A line is named by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import buckets as bk, textscan as ts
from .workspace import Workspace

#: Edits that separate linked lines, code points of the shortest line that edits may link, and of the shortest one whose exact copies the queries remove.
EDITS, LEAST, SHORT = 2, 24, 1
#: Keys that a task packs at once.
PACKED = 1 << 18
#: Code points of strings whose equal ends are cut off before they are compared, and columns between looks at pairs that can be dropped.
LONG, CHECKED = 256, 16
#: Columns that dedup() adds.
ADDED = ("n_lines", "n_removed")
#: Bytes of segment keys for each byte of text, about.
KEY_BYTES = 2

_CODES = ts.mix(np.arange(1 << 16, dtype=np.uint64)) | np.uint64(1)
_BLANK = np.array([chr(c).isspace() for c in range(1 << 16)])
#: True for ASCII bytes that are no white space.
_FILLED = np.concatenate([~_BLANK[:128], np.zeros(128, bool)])

KINDS = (("key", np.uint64), ("id", np.int64), ("size", np.int32), ("look", np.uint8), ("mark", np.uint64))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block, and the first of each text."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return codes, at[offsets]


def code_values(codes: np.ndarray) -> np.ndarray:
    low = _CODES[codes & 0xFFFF]
    wide = codes > 0xFFFF
    if wide.any():
        low[wide] = ts.mix(codes[wide].astype(np.uint64)) | np.uint64(1)
    return low


def segment(length: np.ndarray, number: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of a line's segment; the last ones are longer by one where the length isn't divisible."""
    base, longer = length // count, length % count
    extra = np.maximum(0, number - (count - longer))
    return base * number + extra, base + (number >= count - longer)


def marks(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits of each line: which of 64 classes hold an odd number of its pairs of neighbouring code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pair = code_values(codes)
    pair = ts.mix(pair[:-1] * np.uint64(3) + pair[1:]) >> np.uint64(58) if len(pair) > 1 else pair[:0]
    several = lengths > 1
    out = np.zeros(len(starts), np.uint64)
    counts = lengths[several] - 1
    if len(counts):
        bits = np.uint64(1) << pair[ts.ragged(starts[several], counts)]
        out[several] = np.bitwise_xor.reduceat(bits, np.cumsum(counts) - counts)
    return out


def line_keys(prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, edits: int, least: int, mark: np.ndarray | None = None) -> bk.Columns:
    """Rows (key, id, size, look, mark) of the lines' own segments and of the substrings they look for."""
    mark = np.zeros(len(ids), np.uint64) if mark is None else mark
    count = edits + 1
    out: dict[str, list[np.ndarray]] = {k: [] for k, _ in KINDS}

    def add(rows: np.ndarray, at: np.ndarray, width: np.ndarray, length: np.ndarray, number: int, look: int) -> None:
        h = ts.range_hashes(prefix, starts[rows] + at, starts[rows] + at + width)
        out["key"].append(ts.mix(h ^ ts.mix(length.astype(np.uint64) * np.uint64(count) + np.uint64(number))))
        out["id"].append(ids[rows])
        out["size"].append(lengths[rows].astype(np.int32))
        out["look"].append(np.full(len(rows), look, np.uint8))
        out["mark"].append(mark[rows])

    every = np.arange(len(starts))
    for number in range(count):
        at, width = segment(lengths, number, count)
        add(every, at, width, lengths, number, 0)
        for shorter in range(edits + 1):
            length = lengths - shorter
            at, width = segment(length, number, count)
            low, high = max(-number, shorter - (edits - number)), min(number, shorter + (edits - number))
            for move in range(low, high + 1):
                if shorter == 0 and move == 0:
                    continue  # the line's own segment stands for this look
                rows = np.flatnonzero((length >= least) & (at + move >= 0) & (at + move + width <= lengths))
                add(rows, at[rows] + move, width[rows], length[rows], number, 1)
    return {k: np.concatenate(v) for k, v in out.items()}


def line_spans(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, end, code points, id, text, line number) of the lines of at least so many code points, in bytes; and the code points before each byte."""
    starts, ends, first = ts.lines(data, offsets)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    length = before[ends] - before[starts]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.arange(len(starts)) - first[text]
    keep = length >= least
    starts, ends, length, text, number = starts[keep], ends[keep], length[keep], text[keep], number[keep]
    ids = ts.range_hashes(ts.prefix_hashes(ts.BYTE_VALUES[data]), starts, ends).view(np.int64)
    return starts, ends, length, ids, text, number, before


def new_lines(ids: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each id that is not seen yet, and all seen ids."""
    ids, at = np.unique(ids, return_index=True)
    new = ~np.isin(ids, seen, assume_unique=True)
    return at[new], np.concatenate([seen, ids[new]])


def stacked(pieces: list[bk.Columns]) -> bk.Columns:
    return {k: np.concatenate([p[k] for p in pieces]) for k, _ in KINDS}


def keys_of(docs: DataFrame, edits: int, least: int, parts: int) -> DataFrame:
    """Packed rows of all lines; a line that repeats inside a batch is sent once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.int64)
            got: list[bk.Columns] = []
            for _, data, offsets in ts.blocks(batch.column(0)):
                starts, _, lengths, ids, _, _, before = line_spans(data, offsets, least)
                at, seen = new_lines(ids, seen)
                codes, _ = code_points(data, offsets)
                prefix, first, lengths = ts.prefix_hashes(code_values(codes)), before[starts[at]], lengths[at]
                got.append(line_keys(prefix, first, lengths, ids[at], edits, least, marks(codes, first, lengths)))
                if sum(len(x["key"]) for x in got) >= PACKED:
                    yield bk.packed_batch(stacked(got), parts)
                    got = []
            if got:
                yield bk.packed_batch(stacked(got), parts)

    return docs.mapInArrow(spread, "part int, rows binary")


def lines_of(docs: DataFrame, least: int, words: np.ndarray | None = None) -> DataFrame:
    """(id, text) of the lines that take part, or of those whose bit is set; a line that repeats inside a batch comes once."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            seen = np.zeros(0, np.int64)
            for _, data, offsets in ts.blocks(batch.column(0)):
                starts, ends, _, ids, _, _, _ = line_spans(data, offsets, least)
                if words is not None:
                    use = bk.has_bit(words, ids)
                    starts, ends, ids = starts[use], ends[use], ids[use]
                at, seen = new_lines(ids, seen)
                a, b = starts[at], ends[at]
                body = data[ts.ragged(a, b - a)].tobytes()
                bounds = np.concatenate([[0], np.cumsum(b - a)])
                column = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(body)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), column], names=["id", "text"])

    return docs.mapInArrow(texts, "id long, text string")


def all_lines(data: np.ndarray, offsets: np.ndarray, least: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, text, line number) of the lines that take part, short ones with them unless they are blank."""
    starts, ends, lengths, ids, text, number, before = line_spans(data, offsets, short)
    filled = np.concatenate([[0], np.cumsum(_FILLED[data])])
    keep = (lengths >= least) | (filled[ends] > filled[starts])
    if not keep.all():  # lines of other than ASCII characters
        codes, _ = code_points(data, offsets)
        wide = np.concatenate([[0], np.cumsum((codes > 0xFFFF) | ~_BLANK[codes & 0xFFFF])])
        keep |= wide[before[ends]] > wide[before[starts]]
    return ids[keep], text[keep], number[keep]


def places_of(docs: DataFrame, least: int, short: int) -> DataFrame:
    """(doc_id, row, line, id) of all lines that take part; docs: text, id and row."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in ts.blocks(batch.column(0)):
                ids, text, number = all_lines(data, offsets, least, short)
                at = pa.array(text + row)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(number.astype(np.int64)), pa.array(ids)], names=["doc_id", "row", "line", "id"])

    return docs.mapInArrow(places, "doc_id long, row long, line long, id long")


def within(codes: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, edits: int) -> np.ndarray:
    """Whether the strings codes[a : a + m] and codes[b : b + n] are at most so many edits apart, pair by pair.

    Bit-parallel dynamic programming on a band (after Hyyro, 2003): the top bit of a word
    is the row ``edits`` below the diagonal, and the band moves down one row a column.
    Equal ends of long strings, which don't change the distance, are cut off first, and
    pairs whose whole band is beyond the edits are dropped every ``CHECKED`` columns.
    All strings must be longer than ``edits``.
    """
    a, m, b, n = (x.astype(np.int64) for x in (a, m, b, n))
    near = np.flatnonzero(np.abs(m - n) <= edits)
    for i in near[np.minimum(m, n)[near] > LONG]:
        a[i], m[i], b[i], n[i] = without_ends(codes, int(a[i]), int(m[i]), int(b[i]), int(n[i]), edits + 1)
    order = near[np.argsort(-n[near], kind="stable")]
    good = np.zeros(len(a), bool)
    a, m, b, n = a[order], m[order], b[order], n[order]
    one, top = np.uint64(1), np.uint64(1) << np.uint64(63)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    vp = np.full(len(a), full << np.uint64(63 - edits), np.uint64)
    vn = np.zeros(len(a), np.uint64)
    distance = np.full(len(a), edits, np.int64)
    row = np.full(len(a), np.uint64(1) << np.uint64(62), np.uint64)
    live = len(a)
    for j in range(int(n.max()) if live else 0):
        while live and n[live - 1] <= j:
            live -= 1
        if not live:
            break
        s = slice(0, live)
        if j % CHECKED == CHECKED - 1:
            least = value = distance[s]  # bottom of the band in the column before; its steps upwards begin at bit 62
            for k in range(2 * edits):
                value = value - (vp[s] >> np.uint64(62 - k) & one).astype(np.int64) + (vn[s] >> np.uint64(62 - k) & one).astype(np.int64)
                least = np.minimum(least, value)
            keep = (least <= edits) | (j >= m[s] - edits)
            if not keep.all():
                a, m, b, n, vp, vn, distance, row, order = (x[:live][keep] for x in (a, m, b, n, vp, vn, distance, row, order))
                live = len(a)
                if not live:
                    break
                s = slice(0, live)
        symbol = codes[b[s] + j]
        x = np.zeros(live, np.uint64)
        for k in range(-edits, edits + 1):
            if j + k >= 0:
                same = (j + k < m[s]) & (codes[np.minimum(a[s] + j + k, len(codes) - 1)] == symbol)
                x |= same.astype(np.uint64) << np.uint64(63 - edits + k)
        p, q = vp[s], vn[s]
        d = (((x & p) + p) ^ p) | x | q
        hp, hn = q | ~(d | p), d & p
        slanted = j < m[s] - edits
        distance[s] += np.where(slanted, (d & top) == 0, ((hp & row[s]) != 0).astype(np.int64) - ((hn & row[s]) != 0))
        row[s] = np.where(slanted, row[s], row[s] >> one)
        d >>= one
        vp[s], vn[s] = hn | ~(d | hp), hp & d
        done = n[s] == j + 1  # the last ones, since longer pairs stand first
        if done.any():
            good[order[s][done]] = distance[s][done] <= edits
    return good


def without_ends(codes: np.ndarray, a: int, m: int, b: int, n: int, left: int) -> tuple[int, int, int, int]:
    """Two strings without their common ends, but with so many equal code points on each side."""
    size = min(m, n)
    apart = codes[a : a + size] != codes[b : b + size]
    head = int(apart.argmax()) if apart.any() else size
    head = max(0, min(head, size - left) - left)
    a, m, b, n, size = a + head, m - head, b + head, n - head, size - head
    apart = codes[a + m - size : a + m][::-1] != codes[b + n - size : b + n][::-1]
    tail = int(apart.argmax()) if apart.any() else size
    tail = max(0, min(tail, size - 2 * left))
    return a, m - tail, b, n - tail


def alike(edits: int):
    """Exact test of pairs on the lines' texts."""

    def test(texts: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(left):
            return np.zeros(0, bool)
        codes, at = code_points(*ts.string_buffers(texts))
        size = np.diff(at)
        return within(codes, at[left], size[left], at[right], size[right], edits)

    return test


def near_size(edits: int) -> bk.Filter:
    """Whether lengths and classes of neighbours leave room: an edit changes the length by one at most, and four pairs of neighbours: two go and two come."""

    def test(left, right) -> Column:
        return (F.abs(left("size") - right("size")) <= edits) & (F.bit_count(left("mark").bitwiseXOR(right("mark"))) <= 4 * edits)

    return test


def row_hash(text: str) -> Column:
    return F.xxhash64(F.col(text))


def repeated(docs: DataFrame, place: Workspace, edits: int = EDITS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", short: int | None = None) -> DataFrame:
    """(doc_id, row, line) of every occurrence that isn't its class's first; row: hash of the text."""
    spark = docs.sparkSession
    bodies = docs.select(F.col(text).alias("t"), F.col(doc_id).cast("long").alias("i"), row_hash(text).alias("r")).where("i is not null and t is not null")
    total = bodies.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = bk.parts_of(spark, KEY_BYTES * total)
    index = bk.Buckets(place, "index", keys_of(bodies.select("t"), edits, least, parts), KINDS, ["look"], near_size(edits), parts, sided=True)
    # only lines of the index can be in a pair: one pass over the texts fetches them
    bits = bk.bits_for(index.rows.count())
    words = bk.bit_words(place.table("bits", bk.bit_table(index.rows.select("id"), bits)), bits)
    texts = place.table("texts", lines_of(bodies.select("t"), least, words).dropDuplicates(["id"]))
    linked = bk.linked(index, texts, alike(edits), place)
    for name in ("bits", "texts", "index", "index-hubs", "index-mixed", "index-live"):
        place.drop(name)
    place.release()
    found = places_of(bodies, least, least if short is None else min(short, least)).join(linked.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    found = place.table("places", found.select("doc_id", "row", "line", F.coalesce("component", "id").alias("class")))
    # a table of its own, so that adaptive execution can split the join at a very common line
    first = place.table("first", found.groupBy("class").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("k")).where("k > 1"))
    return found.join(first.hint("merge"), "class").where(F.struct("doc_id", "row", "line") != F.col("first")).select("doc_id", "row", "line").distinct()


def dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", short: int | None = None) -> DataFrame:
    """docs with the text of the lines that stay, n_lines before and n_removed."""
    spark = docs.sparkSession
    place = Workspace(spark, "line-dedup")
    docs = docs.drop(*ADDED)
    lost = repeated(docs, place, edits, least, doc_id, text, short).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("line")).alias("_lost"))
    lost = place.table("lost", lost.withColumnsRenamed({"doc_id": "_doc", "row": "_row"}))
    for name in ("places", "first"):
        place.drop(name)
    place.release()
    # only documents that may lose lines travel to their lists: a bit table, which is broadcast, lets the others stay
    bits = bk.bits_for(lost.count())
    table = place.table("table", bk.bit_table(lost.select(F.xxhash64("_doc", "_row").alias("id")), bits))
    key, row = F.col(doc_id).cast("long"), row_hash(text)
    seen, may = bk.marked(docs, F.xxhash64(key, row), table, bits)
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    untouched = seen.where(~may).select(*docs.columns, (F.coalesce(feeds, F.lit(0)) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    joined = seen.where(may).select(*docs.columns).join(lost.hint("merge"), (key == F.col("_doc")) & (row == F.col("_row")), "left").drop("_doc", "_row")
    where = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, gone = batch.column(where), batch.column(batch.num_columns - 1).fill_null([])
            total, removed, pieces = [], [], []
            for row, data, offsets in ts.blocks(body):
                starts, ends, first = ts.lines(data, offsets)
                mine = gone.slice(row, len(offsets) - 1)
                count = mine.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(count)), count)
                keep = np.ones(len(starts), bool)
                keep[first[owner] + mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = False
                text_of = np.repeat(np.arange(len(count)), np.diff(first))[keep]
                a, b = starts[keep], ends[keep]
                joins = np.zeros(len(a), bool)  # a line end before each line but a text's first that stays
                joins[1:] = text_of[1:] == text_of[:-1]
                size = b - a + joins
                at = np.cumsum(size) - size
                out = np.full(int(size.sum()), 0x0A, np.uint8)
                out[ts.ragged(at + joins, b - a)] = data[ts.ragged(a, b - a)]
                bounds = np.concatenate([at, [len(out)]])[np.searchsorted(text_of, np.arange(len(count) + 1))]
                pieces.append(pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())))
                total.append(np.diff(first))
                removed.append(count)
            if not pieces:
                continue
            texts = pa.concat_arrays(pieces).cast(pa.string())
            if body.null_count:
                texts = pc.if_else(body.is_null(), pa.scalar(None, pa.string()), texts)
            columns = list(batch.columns[:-1])
            columns[where] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(total)), pa.array(np.concatenate(removed))], names=[*schema.names])

    return joined.mapInArrow(cut, schema).unionByName(untouched)
