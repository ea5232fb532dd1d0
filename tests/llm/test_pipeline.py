"""The pipeline against a version in plain Python, and the queries that have SQL against DuckDB."""

from __future__ import annotations

import collections
import os
import random

import duckdb
import pytest

import plain
from faultline.llm import packing, queries, token_counts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and ids[-1]
    assert ids[4] == ids[5]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(tuple, docs.collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in is it for on with as at by from that this be are was or an not".split()


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else f"w{rng.randrange(100_000)}" for _ in range(n))


def fixture(rng):
    """Clean documents, noise, repeated lines, near copies, copies of benchmark passages, and edge cases."""
    lines = [prose(rng, 9) for _ in range(4)]
    docs = [(i, "\n".join(prose(rng, 12) for _ in range(8))) for i in range(60)]
    docs += [(100 + i, "\n".join([prose(rng, 40), rng.choice(lines), "All rights reserved.", prose(rng, 40), rng.choice(lines)[:-1] + rng.choice("xy")])) for i in range(12)]
    for k in range(6):
        base = prose(rng, 90).split()
        for c in range(k + 1):
            docs.append((200 + 10 * k + c, " ".join([*base[:c], *base[c + 1 :]])))
    passages = [prose(rng, 14) for _ in range(3)]
    docs += [(300 + i, f"{prose(rng, 40)} {passages[i % 3].upper() if i % 2 else passages[i % 3]} {prose(rng, 40)}") for i in range(5)]
    docs += [(400, " ".join("".join(rng.choice("bcdfgh") for _ in range(6)) for _ in range(90))), (401, "a b c " * 40), (402, None), (403, ""), (404, "short"), (405, " ".join(f"{w}$$##" for w in prose(rng, 80).split()))]
    docs += [(406, " ".join([prose(rng, 5000)])), (407, docs[0][1]), (408, docs[0][1])]
    return docs, [("q1", passages[0]), ("q2", passages[1] + " " + prose(rng, 3)), ("q3", passages[2]), ("q4", None), (None, passages[0]), ("q5", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_run_equals_plain_python(spark, tmp_path, seed):
    docs, items = fixture(random.Random(seed))
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SCHEMA)
    table = table.selectExpr("*", "'clash' as kept", "7 as n_lines", "'x' as component_id", "array(1) as items")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for (i, t), v in zip(docs, plain.quality_verdicts([(t, "en") for _, t in docs])) if v[-1]]
    cleaned = plain.dedup_lines(left)
    left = [(i, cleaned[i]) for i, t in left if cleaned[i] == t or plain.words(cleaned[i])]
    root = plain.near_copies(left, 5, 80)
    left = [(i, t) for i, t in left if root[i] == i]
    left = [(i, t) for i, t in left if not plain.benchmark_hits(t, [x for x in items if None not in x], 10)[1]]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    coder = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY), token_counts.PATTERN)
    want = {i: len(coder.encode_ordinary(t)) + 1 for i, t in left}
    got, pieces = collections.Counter(), []
    for r in rows:
        got[r.doc_id] += r.n_tokens
        pieces.append(r.n_tokens)
    assert got == want and 40 < len(want) < len(docs) - 20
    groups = packing.plan(collections.Counter(pieces))
    assert collections.Counter(r.bin_size for r in {r.bin_id: r for r in rows}.values()) == sum((collections.Counter({g.size: g.bins}) for g in groups), collections.Counter())


def test_stages_survive_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, ids with several texts, clashing columns, nothing at all."""
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(5)
    text = "\n".join(prose(rng, 12) for _ in range(6))
    rows = [(None, text), (1, None), (2, ""), (3, text), (3, text), (4, text), (5, "word"), (5, text + " more"), (6, "\n\n"), (7, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).selectExpr("*", "1 as kept", "'a' as n_removed", "2.5 as n_words")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "pack":
            assert got.columns == docs.columns and {(r.kept, r.n_removed) for r in got.collect()} <= {(1, "a")}
        ids = sorted(r.doc_id or -1 for r in got.collect())
        expected = {"quality_rules": [-1, 3, 3, 4, 5], "line_dedup": [-1, 1, 2, 3, 3, 6, 7], "ngram_join": [-1, 1, 2, 3, 3, 6, 7], "decontaminate": [-1, 1, 2, 3, 3, 4, 5, 5, 6, 7]}
        if name in ("quality_rules", "decontaminate"):
            assert ids == expected[name]
        assert name != "pack" or set(ids) == {-1, 1, 2, 3, 4, 5, 6, 7}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    plain = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and plain(got) == plain(want)
