"""Exact histogram of encoded lengths, and suffix sums that answer every context limit.

Each batch is encoded on the executors and summed to a histogram before the shuffle;
the vocabulary (its size is checked) is broadcast from the driver.  Suffix sums are
taken inside ranges of lengths and added to the sums of the ranges beyond, so no task
holds the whole histogram; the histogram is stored first, so texts are encoded once.

Edge cases: null and empty texts have length 0 and are counted; special-token strings
inside a text are ordinary text; very long runs of white space, on which the pattern's
look-ahead fails, are cut out and encoded as the pieces that the pattern would make; repeated rows count each; an empty table gives an empty
histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .workspace import Workspace

#: Default vocabulary (rank file), its greatest size, and the pattern that cuts texts before merging (fixed value of that vocabulary).
VOCABULARY, VOCABULARY_LIMIT = "/opt/tokenizers/byte_bpe_50k.tiktoken", 64 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in a range.
RANGE = 256
#: White space of the pattern, in runs that are encoded apart; every such run is a piece but for its last character, if more follows.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_LIMIT + 1)
    if len(data) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} is larger than {VOCABULARY_LIMIT} bytes")
    return data


def token_count(enc, text: str | None) -> int:
    """Tokens of a text."""
    if not text:
        return 0
    total, at = 0, 0
    for run in LONG_BLANK.finditer(text):
        piece = run.end() - (run.end() < len(text))
        total += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : piece]))
        at = piece
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def with_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_tokens of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            lengths = [token_count(enc, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lengths, pa.int64())], names=[*keep, "n_tokens"])

    rows = docs.select(F.col(text), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "n_tokens long"])
    return rows.mapInArrow(encode, schema)


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            lengths = np.array([token_count(enc, t) for t in batch.column(0).to_pylist()], np.int64)
            values, counts = np.unique(lengths, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["n_tokens", "n_docs"])

    return docs.select(text).mapInArrow(tally, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs: documents and tokens of at least this length, the corpus total when each document is cut to it, and the share of documents that fit."""
    hist = Workspace(hist.sparkSession, "token-counts").table("histogram", hist)
    hist = hist.withColumn("range", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    beyond = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(beyond), zero).alias("d_beyond"), F.coalesce(F.sum("t").over(beyond), zero).alias("t_beyond"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)}).join(ranges, "range")
    rows = rows.withColumns({"docs_at_least": F.col("d") + F.col("d_beyond"), "tokens_at_least": F.col("t") + F.col("t_beyond")})
    return rows.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("docs_share_fitting"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """Totals of the corpus when each document is cut to the limit: one row."""
    cut = F.least(F.col("n_tokens"), F.lit(limit))
    return hist.agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.sum(cut * F.col("n_docs")).alias("truncated_total"), F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias("docs_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """Least length that at least the share q of documents does not exceed."""
    return sums.where(F.col("docs_share_fitting") >= q).agg(F.min("n_tokens").alias("n_tokens"))
