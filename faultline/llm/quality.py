"""Quality rules: counting rules and distribution divergence.

Each document's histogram of character classes and of common words is compared to
the references of all languages by Jensen-Shannon distance (base 2, 0 to 1).  The
closest reference counts.  References are mean histograms over all labelled documents
that have MIN_WORDS words and few symbols; each document weighs the same.  A text
without any common word is as far from a reference as a histogram of other words only;
the greatest distance of words is a share of that distance.

Edge cases: a null or empty text has no words and fails the base rules; a document
shorter than a guard is not judged by that histogram; documents without a language
take no part in the references and are judged by the closest; a language has a reference
from ``LEAST_DOCS`` usual documents on, whatever the size of the table, and documents of
a language without one are judged by the base rules alone; texts of any length are read
whole; repeated rows give repeated results; an empty table gives an empty result; other
columns pass unchanged and verdict columns of the same name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import textscan as ts
from .workspace import Workspace

#: Base rules: least words, and the greatest per cent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Greatest distance of the character classes, the common words' greatest share of the distance of a text without any, and the least characters and words that are judged.
MAX_CHAR_DISTANCE, MAX_WORD_SHARE, GUARD_CHARS, GUARD_WORDS = 0.2, 0.95, 200, 60
#: Common words that a text of its length should hold before it is judged by them: with fewer, chance puts clean texts that far.
GUARD_COMMON = 20
#: Common words of a language, a common word's least share of the language's words, its least occurrences in texts of MIN_WORDS words, least documents of a reference.
COMMON, WORD_SHARE, LEAST_USES, LEAST_DOCS = 48, 0.0005, 5, 10
#: Cells of the histograms of words that are compared at once.
CELLS = 1 << 20
#: Weight of a document in its language's reference, whatever its length.
WEIGHT = 1 << 32
#: A document with more than a symbol in so many words, or fewer than MIN_WORDS words, is no part of a reference.
MAX_SYMBOLS = 20

#: Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other mark, 7 symbol, 8 control, 9 first byte of a non-ASCII character, 10 later byte (not counted).
CLASSES = np.full(256, 8, np.uint8)
for _chars, _class in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r", 4), (".,;:'\"?-", 5), ("!()/_[]", 6), ("#*$%&|<>@+=^~`{}\\", 7)):
    CLASSES[[ord(c) for c in _chars]] = _class
CLASSES[0x80:0xC0], CLASSES[0xC0:] = 10, 9
N_CLASSES = 10
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

#: Columns that judge() adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "closest_lang", "char_distance", "word_distance", "kept")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rank of each key among the equal keys of its text, in order: 0 for the first; and how many there are."""
    order = np.lexsort((np.arange(len(keys)), keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    rank, count = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    rank[order] = np.arange(len(k)) - start[group] if len(k) else 0
    count[order] = np.bincount(group)[group] if len(k) else 0
    return np.stack([rank, count])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = ts.words(data, offsets, ts.SPACE_WORD)
    prefix = ts.prefix_hashes(ts.BYTE_VALUES[data])
    hashes = ts.range_hashes(prefix, starts, ends)
    out = {"n_words": np.diff(first)}
    inside = ts.SPACE_WORD[data] & ((data & 0xC0) != 0x80)
    out["word_chars"], out["n_symbols"] = per_text(inside, offsets), per_text(SYMBOL[data], offsets)
    line_start, line_end, line_first = ts.lines(data, offsets)
    keys = ts.range_hashes(prefix, line_start, line_end)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(line_first))
    out["n_dup_lines"] = per_text(has_word & (repeated(keys, text)[0] > 0), line_first)
    key, at, text = ts.windows(hashes, first, 3)
    full = np.diff(first)[text] >= 3
    key, at, text = key[full], at[full], text[full]
    twice = at[repeated(key, text)[1] > 1]
    edge = np.bincount(twice, minlength=len(hashes) + 3)[: len(hashes) + 3] - np.bincount(twice + 3, minlength=len(hashes) + 3)[: len(hashes) + 3]
    out["n_repeat_words"] = per_text(np.cumsum(edge)[: len(hashes)] > 0, first)
    return out


def base_failed(c: dict[str, np.ndarray], min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> np.ndarray:
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(text * 11 + CLASSES[data], minlength=11 * (len(offsets) - 1)).reshape(-1, 11)[:, :N_CLASSES]


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = ts.LOWER[data]
    starts, ends, first = ts.words(low, offsets, ts.ALNUM_WORD)
    return ts.range_hashes(ts.prefix_hashes(ts.BYTE_VALUES[low]), starts, ends), first


@dataclass
class References:
    languages: list[str]
    classes: np.ndarray  # languages x N_CLASSES, shares
    vocabulary: np.ndarray  # sorted hashes of all languages' common words
    words: np.ndarray  # languages x (vocabulary + 1), shares; the last is all other words

    def without_common(self) -> np.ndarray:
        """Distance of a text without common words to each language."""
        other = np.zeros((1, len(self.vocabulary) + 1))
        other[0, -1] = 1
        return distances(other, self.words)[0]


def fit(docs: DataFrame, common: int = COMMON, text: str = "text", lang: str = "lang") -> References:
    """Sums over all documents with a language; what reaches the driver is bounded by the languages, classes and common words."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).dictionary_encode()
            codes, names = labels.indices.to_numpy(zero_copy_only=False), labels.dictionary.to_pylist()
            kinds, used = np.zeros((len(names), N_CLASSES), np.int64), np.zeros(len(names), np.int64)
            seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
            for row, data, offsets in ts.blocks(batch.column(0)):
                mine = codes[row : row + len(offsets) - 1].astype(np.int64)
                hashes, first = plain_words(data, offsets)
                length = np.diff(first)
                usual = (length >= MIN_WORDS) & (per_text(SYMBOL[data], offsets) * MAX_SYMBOLS <= length)
                own = class_counts(data, offsets)
                used += np.bincount(mine[usual], minlength=len(names))
                np.add.at(kinds, mine[usual], (own * WEIGHT // np.maximum(1, own.sum(1, keepdims=True)))[usual])
                owner = np.repeat(np.where(usual, mine, -1), length)
                weight = np.repeat(WEIGHT // np.maximum(1, length), length)
                for k in range(len(names)):
                    seen[k].append((hashes[owner == k], weight[owner == k]))
            if not names:
                continue
            who, what, key, n = [], [], [], []
            for k in range(len(names)):
                words, place = np.unique(np.concatenate([h for h, _ in seen[k]]) if seen[k] else np.zeros(0, np.uint64), return_inverse=True)
                counts = np.bincount(place, np.concatenate([w for _, w in seen[k]]) if seen[k] else None, len(words)).astype(np.int64)
                what.append(np.repeat(np.arange(4), [1, 1, N_CLASSES, len(words)]))
                who.append(np.full(len(what[-1]), k))
                key.append(np.concatenate([[0, 0], np.arange(N_CLASSES), words.view(np.int64)]))
                n.append(np.concatenate([[used[k], counts.sum()], kinds[k], counts]))
            texts = [pa.array(names, pa.string()).take(pa.array(np.concatenate(who))), pa.array(["docs", "words", "class", "word"]).take(pa.array(np.concatenate(what)))]
            yield pa.RecordBatch.from_arrays([*texts, pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(n), pa.int64())], names=["lang", "what", "key", "n"])

    sums = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string")).mapInArrow(tally, "lang string, what string, key long, n long").groupBy("lang", "what", "key").agg(F.sum("n").alias("n"))
    place = Workspace(docs.sparkSession, "quality")
    sums = place.table("sums", sums)
    try:
        heads = {r.lang: {} for r in sums.where((F.col("what") == "docs") & (F.col("n") >= LEAST_DOCS)).collect()}
        langs = sorted(heads)
        kept = sums.where(F.col("lang").isin(langs) & (F.col("what") != "docs")) if langs else sums.limit(0)
        shares = kept.where("what = 'words'").select("lang", F.col("n").alias("all_words"))
        words = kept.where("what = 'word'").join(F.broadcast(shares), "lang")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
        often = (F.col("n") >= WORD_SHARE * F.col("all_words")) & (F.col("n") >= LEAST_USES * WEIGHT // MIN_WORDS)
        top = words.where(often).withColumn("rank", rank).where(F.col("rank") <= common).select("key").distinct()
        rows = kept.where("what <> 'word'").unionByName(words.join(F.broadcast(top), "key").select(sums.columns)).collect()
    finally:
        place.drop()
    for r in rows:
        heads[r.lang].setdefault(r.what, {})[r.key] = r.n
    vocabulary = np.unique(np.array([w for x in langs for w in heads[x].get("word", {})], np.int64).view(np.uint64))
    classes, words = np.zeros((len(langs), N_CLASSES)), np.zeros((len(langs), len(vocabulary) + 1))
    for i, x in enumerate(langs):
        for k, n in heads[x].get("class", {}).items():
            classes[i, k] = n
        own = heads[x].get("word", {})
        for j, w in enumerate(vocabulary.view(np.int64)):
            words[i, j] = own.get(int(w), 0)
        words[i, -1] = max(0, heads[x]["words"][0] - words[i, :-1].sum())
    normal = lambda m: m / np.maximum(1, m.sum(1, keepdims=True))
    return References(langs, normal(classes), vocabulary, normal(words))


def distances(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to each reference."""
    p = counts / np.maximum(1, counts.sum(1, keepdims=True))

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.sum(x * np.log2(np.where(x > 0, x, 1)), -1)

    own = entropy(p)
    return np.stack([np.sqrt(np.maximum(0, entropy((p + q) / 2) - (own + entropy(q)) / 2)) for q in references], 1) if len(references) else np.zeros((len(p), 0))


def divergences(data: np.ndarray, offsets: np.ndarray, refs: References) -> dict[str, np.ndarray]:
    """Closest language and its distances, as judged after the guards."""
    n = len(offsets) - 1
    kinds = class_counts(data, offsets)
    hashes, first = plain_words(data, offsets)
    width = len(refs.vocabulary) + 1
    at = np.searchsorted(refs.vocabulary, hashes)
    if width > 1:
        near = np.minimum(at, width - 2)
        at = np.where(refs.vocabulary[near] == hashes, near, width - 1)
    by_class, by_word, step = distances(kinds, refs.classes), np.zeros((n, len(refs.languages))), max(1, CELLS // width)
    for k in range(0, n, step):
        m = min(n, k + step) - k
        text = np.repeat(np.arange(m), np.diff(first[k : k + m + 1]))
        counts = np.bincount(text * width + at[first[k] : first[k + m]], minlength=m * width).reshape(m, width)
        by_word[k : k + m] = distances(counts, refs.words)
    if not refs.languages:
        return {"language": np.full(n, -1), "char_distance": np.zeros(n), "word_distance": np.zeros(n), "diverges": np.zeros(n, bool)}
    best = np.argmin(by_class + by_word, 1)
    length = np.diff(first)
    judged_c, judged_w = kinds.sum(1) >= GUARD_CHARS, (length >= GUARD_WORDS) & (length * (1 - refs.words[best, -1]) >= GUARD_COMMON)
    rows = np.arange(n)
    c, w = by_class[rows, best], by_word[rows, best]
    return {"language": best, "char_distance": c, "word_distance": w, "diverges": (judged_c & (c > MAX_CHAR_DISTANCE)) | (judged_w & (w > MAX_WORD_SHARE * refs.without_common()[best]))}


def judge(docs: DataFrame, refs: References | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of docs, then the base counts, base_failed, closest_lang, the two distances and kept."""
    refs = fit(docs, text=text, lang=lang) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    added = [*ADDED]
    docs = docs.drop(*added)
    where, tongue = docs.columns.index(text), docs.columns.index(lang) if lang in docs.columns else None
    kinds = [*[T.LongType()] * 5, T.BooleanType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(added, kinds))])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            known = np.ones(batch.num_rows, bool)
            if tongue is not None:
                spoken = batch.column(tongue).cast(pa.string())
                known = pc.or_(pc.is_null(spoken), pc.is_in(spoken, pa.array(refs.languages, pa.string()))).to_numpy(zero_copy_only=False)
            for row, data, offsets in ts.blocks(batch.column(where)):
                c = base_counts(data, offsets)
                d = divergences(data, offsets, refs)
                failed = base_failed(c)
                for k, v in (c | d | {"base_failed": failed, "kept": ~failed & ~(d["diverges"] & known[row : row + len(failed)])}).items():
                    parts.setdefault(k, []).append(v)
            if not parts:
                continue
            got = {k: np.concatenate(v) for k, v in parts.items()}
            names = pa.array([*refs.languages, None], pa.string())
            columns = [pa.array(got[k], pa.int64()) for k in COUNTS]
            columns += [pa.array(got["base_failed"]), names.take(pa.array(got["language"] % len(names))), pa.array(got["char_distance"]), pa.array(got["word_distance"]), pa.array(got["kept"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return docs.mapInArrow(rate, schema)
