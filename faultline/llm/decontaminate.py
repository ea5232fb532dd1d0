"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: a segment holds, for a run of whole texts, the
sorted positions of each of their terms, so one index serves any benchmark.  Segments
are stored as a table, and a search is one pass over them without a shuffle: for each
test phrase it starts from the positions of the term that is rarest in the whole corpus
and intersects them with the offset-adjusted positions of the next rarest, until all
terms agree (an exact match), or looks for all other terms near them (a proximity match).

Test phrases are broadcast in blocks of at most ``BLOCK_LIMIT`` bytes of test text, and
an item beyond that is cut into overlapping pieces; the blocks' hits are merged per
document.

Edge cases: a null or empty text has no words and no hits; a null item text or item
id is no test item; equal passages in several items count for each; texts of any length
are indexed whole; repeated rows give repeated results; an empty table gives an empty
result; columns other than the id and the text are ignored.  Terms are 64-bit hashes of
their bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts
from .workspace import Workspace, small_batches

#: Words of a test window, bytes of test text in one broadcast, and words around a phrase's rarest term that a proximity match may use.
WINDOW, BLOCK_LIMIT, SLOP = 10, 4 << 20, 15
#: Candidate positions that a search holds at once.
CANDIDATES = 1 << 18

SEGMENT = "segment long, doc_ids array<long>, word_counts array<int>, terms array<long>, counts array<int>, postings array<int>"
MATCHES = "segment long, doc int, doc_id long, n_words long, starts array<int>, lengths array<int>, items array<string>, near_items array<string>"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the first word of each text."""
    low = ts.LOWER[data]
    starts, ends, first = ts.words(low, offsets, ts.ALNUM_WORD)
    return ts.range_hashes(ts.prefix_hashes(ts.BYTE_VALUES[low]), starts, ends), first


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the index."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("word_counts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("postings", pa.list_(pa.int32()))])
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, data, offsets in ts.blocks(batch.column(1)):
                hashes, first = term_hashes(data, offsets)
                order = np.argsort(hashes, kind="stable")
                terms, counts = np.unique(hashes[order], return_counts=True)
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                ids = batch.column(0).slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(ids, None), one(np.diff(first).astype(np.int32), pa.int32()), one(terms.view(np.int64), pa.int64()), one(counts.astype(np.int32), pa.int32()), one(order.astype(np.int32), pa.int32())], schema=schema)
                number += 1

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(segments, SEGMENT)


def member(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array; a small bit table answers most."""
    if not len(known):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 16, bool)
    table[known >> np.uint64(48)] = True
    out = table[values >> np.uint64(48)]
    at = np.flatnonzero(out)
    found = np.searchsorted(known, values[at])
    out[at] = known[np.minimum(found, len(known) - 1)] == values[at]
    return out


@dataclass
class Phrases:
    """Distinct test phrases as term hashes, with the items that hold each."""

    terms: np.ndarray  # phrases x width, padded with the last term
    lengths: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray

    @classmethod
    def of_items(cls, item_ids: list[str], texts: list[str | None], window: int) -> "Phrases":
        column = pa.array(texts, pa.string())
        terms, lengths, items, keys = [np.zeros((0, window), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row, data, offsets in ts.blocks(column):
            hashes, first = term_hashes(data, offsets)
            key, at, item = ts.windows(hashes, first, window)
            length = np.minimum(window, np.diff(first)[item])
            terms.append(hashes[at[:, None] + np.minimum(np.arange(window), length[:, None] - 1)] if len(at) else terms[0])
            lengths.append(length)
            items.append(item + row)
            keys.append(key)
        key, length, item, term = (np.concatenate(x) for x in (keys, lengths, items, terms))
        pairs, at = np.unique(np.stack([key, item.astype(np.uint64)], 1), axis=0, return_index=True)
        _, start, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        return cls(term[at[start]], length[at[start]], np.concatenate([start, [len(pairs)]]), np.asarray(item_ids, object)[item[at]] if len(at) else np.zeros(0, object))

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms)

    def by_rarity(self, terms: np.ndarray, counts: np.ndarray) -> "tuple[np.ndarray, np.ndarray]":
        """Terms and offsets of each phrase, rarest in the corpus first."""
        width = self.terms.shape[1]
        if not len(terms):
            return self.terms, np.broadcast_to(np.arange(width), self.terms.shape)
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        frequency = np.where(terms[at] == self.terms, counts[at], 0)
        offset = np.minimum(np.arange(width), self.lengths[:, None] - 1)
        order = np.argsort(frequency, axis=1, kind="stable")
        return np.take_along_axis(self.terms, order, 1), np.take_along_axis(offset, order, 1)


class Segment:
    """One stored segment; positions of a term are found as a range of sorted keys."""

    def __init__(self, row: dict[str, np.ndarray], known: np.ndarray | None = None):
        """known: sorted terms that will be asked for."""
        terms, counts, postings = row["terms"].view(np.uint64), row["counts"], row["postings"]
        if known is not None:
            use = member(known, terms)
            ends = np.cumsum(counts, dtype=np.int64)[use]
            terms, counts = terms[use], counts[use]
            postings = postings[ts.ragged(ends - counts, counts)]
        self.terms = terms
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.postings = postings.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(row["word_counts"], dtype=np.int64)])
        self.size = int(self.first[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), counts) * self.size + self.postings

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position) of the given term of each phrase, in bounded chunks."""
        counts = self.ends[codes] - self.starts[codes]
        i = 0
        while i < len(codes):
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(counts[i:]), CANDIDATES, "right")))
            yield np.repeat(np.arange(i, j), counts[i:j]), self.postings[ts.ragged(self.starts[codes[i:j]], counts[i:j])]
            i = j

    def exact(self, terms: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of each occurrence inside one text; terms rarest first."""
        codes = self.codes(terms)
        alive = np.flatnonzero((codes >= 0).all(1))
        codes, offsets = codes[alive], offsets[alive]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, at in self.candidates(codes[:, 0]):
            start = at - offsets[phrase, 0]
            for k in range(1, codes.shape[1]):
                inside = (start >= 0) & (start + offsets[phrase, k] < self.size - 1)
                phrase, start = phrase[inside], start[inside]
                key = codes[phrase, k] * self.size + start + offsets[phrase, k]
                hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                phrase, start = phrase[hit], start[hit]
            whole = (start >= 0) & (start + lengths[alive[phrase]] < self.size)
            phrase, start = phrase[whole], start[whole]
            inside = self.text_of(start) == self.text_of(start + lengths[alive[phrase]] - 1)
            found.append((alive[phrase[inside]], start[inside]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def near(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest term) where every term of the phrase is within slop words in the same text."""
        codes = self.codes(terms)
        alive = np.flatnonzero((codes >= 0).all(1))
        codes = codes[alive]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, at in self.candidates(codes[:, 0]):
            for k in range(1, codes.shape[1]):
                text = self.text_of(at)
                low = codes[phrase, k] * self.size + np.maximum(at - slop, self.first[text])
                high = codes[phrase, k] * self.size + np.minimum(at + slop, self.first[text + 1] - 1)
                hit = np.searchsorted(self.keys, high, "right") > np.searchsorted(self.keys, low, "left")
                phrase, at = phrase[hit], at[hit]
            found.append((alive[phrase], at))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def term_counts(index: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corpus frequency of the known terms, the vocabulary of one block of phrases, which bounds it."""
    shared = index.sparkSession.sparkContext.broadcast(known)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            use = member(shared.value, terms)
            yield pa.RecordBatch.from_arrays([pa.array(terms[use].view(np.int64)), pa.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)[use].astype(np.int64))], names=["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(pick, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    terms = rows["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], rows["n"].to_numpy(np.int64)[order]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, np.ndarray], pa.Array]]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name).slice(i, 1).flatten() for name in ("doc_ids", "word_counts", "terms", "counts", "postings")}
        ids = row.pop("doc_ids")
        yield {k: v.to_numpy(zero_copy_only=False) for k, v in row.items()} | {"segment": batch.column("segment")[i].as_py()}, ids


def search(index: DataFrame, phrases: Phrases, slop: int = SLOP) -> DataFrame:
    """One row per document of the index (see MATCHES), also those without a match: words and items of exact matches, items of proximity matches."""
    known = phrases.vocabulary()
    counted, frequency = term_counts(index, known) if len(phrases.lengths) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    terms, offsets = phrases.by_rarity(counted, frequency)
    names, code = np.unique(phrases.items.astype(str), return_inverse=True)
    shared = index.sparkSession.sparkContext.broadcast((known, terms, np.ascontiguousarray(offsets), phrases.lengths, phrases.item_starts, names, code))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms, offsets, lengths, item_starts, names, code = shared.value
        labels = pa.array(names.tolist(), pa.string())

        def items_of(phrase: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
            """Distinct items of the phrases found in each text."""
            counts = item_starts[phrase + 1] - item_starts[phrase]
            pairs = np.unique(np.repeat(text, counts) * len(names) + code[ts.ragged(item_starts[phrase], counts)])
            bounds = np.searchsorted(pairs, np.arange(n + 1) * len(names))
            return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), labels.take(pa.array(pairs % max(1, len(names)))))

        for batch in batches:
            for row, ids in _rows(batch):
                segment = Segment(row, known)
                n = len(ids)
                phrase, start = segment.exact(terms, offsets, lengths)
                text = segment.text_of(start)
                order = np.lexsort((phrase, start, text))
                phrase, start, text = phrase[order], start[order], text[order]
                close, at = segment.near(terms, slop)
                bounds = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["segment"]), pa.int64()), pa.array(np.arange(n), pa.int32()), ids.cast(pa.int64()), pa.array(np.diff(segment.first), pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(start - segment.first[text], pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(lengths[phrase], pa.int32())),
                    items_of(phrase, text, n), items_of(close, segment.text_of(at), n),
                ], names=["segment", "doc", "doc_id", "n_words", "starts", "lengths", "items", "near_items"])

    return index.mapInArrow(look, MATCHES)


def pieces_of(tests: DataFrame, window: int, limit: int) -> DataFrame:
    """(item, text) with texts beyond the limit cut into pieces, so that each window of words is in one."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if len(text.encode()) <= limit:
                    items.append(item)
                    texts.append(text)
                    continue
                spans, first, size = [m.span() for m in word.finditer(text)], 0, 0
                for k, (a, b) in enumerate(spans):
                    size += len(text[a:b].encode()) + 1
                    if k + 1 == len(spans) or (size >= limit and k + 1 - first >= window):
                        items.append(item)
                        texts.append(text[spans[first][0] : b])
                        first, size = k + 2 - window, 0
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return tests.mapInArrow(cut, "item string, text string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_limit: int = BLOCK_LIMIT, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int = SLOP) -> DataFrame:
    """Per document: doc_id, n_words, word ranges (starts, lengths) of test windows, items whose windows occur, items with a proximity match, n_hit words inside the ranges."""
    tests = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    place = Workspace(docs.sparkSession, "decontaminate")
    with small_batches(docs.sparkSession):  # the hits are stored, so that all of it runs here
        index = place.table("index", build_index(docs, doc_id, text), large_rows=True)
        tests = place.table("tests", pieces_of(tests, window, block_limit))
        total = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n = max(1, -(-total // block_limit))
        hits = None
        for k in range(n):
            rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
            block = search(index, Phrases.of_items([r.item for r in rows], [r.text for r in rows], window), slop)
            hits = block if hits is None else hits.unionByName(block)
        if n > 1:
            items = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
            hits = hits.groupBy("segment", "doc").agg(*(F.first(c).alias(c) for c in ("doc_id", "n_words")), *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths")), *items)
        hits = place.table("hits", hits)
        place.drop("index")
    return hits.withColumn("n_hit", covered("starts", "lengths")).drop("segment", "doc")


def covered(starts: str, lengths: str):
    """Words inside the union of the ranges."""
    ranges = F.array_sort(F.arrays_zip(F.col(starts).alias("s"), F.col(lengths).alias("l")))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["s"] + x["l"] - F.greatest(acc["end"], x["s"]))).cast("long").alias("n"), F.greatest(acc["end"], x["s"] + x["l"]).cast("long").alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.when(F.size(starts) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(ranges, zero, step)["n"])


def items_digest(items: list[str]) -> str:
    """Lowercase hex of the sorted, comma-joined item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
