"""Columnar kernels against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from faultline.llm import buckets, chat, langid, line_dedup, ngram_join, packing, textscan as ts, url_filter
from faultline.llm.workspace import Workspace

TEXTS = ["The quick  brown\n\nfox", None, "", "é ü x\x0b\n", "a\nb", "\n", " lead the quick brown", "𝄞 b\u00a0c", "x" * 3000]


@pytest.mark.parametrize("limit", [1, 40, 1 << 19])
def test_words_and_lines(limit):
    words, lines = [], []
    for _, data, offsets in ts.blocks(pa.array(TEXTS), limit):
        s, e, first = ts.words(data, offsets, ts.SPACE_WORD)
        words += [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])]
        s, e, first = ts.lines(data, offsets)
        lines += [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(first, first[1:])]
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert lines == [(t or "").split("\n") for t in TEXTS]


def test_hashes_depend_on_content_only():
    data = np.frombuffer(b"abc abd abc ab", np.uint8)
    s, e, _ = ts.words(data, np.array([0, len(data)]), ts.SPACE_WORD)
    h = ts.range_hashes(ts.prefix_hashes(ts.BYTE_VALUES[data]), s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng: random.Random, s: str, k: int) -> str:
    s = list(s)
    for _ in range(k):
        i, how = rng.randrange(len(s)), rng.random()
        if how < 0.33:
            s[i] = rng.choice("abé")
        elif how < 0.66:
            s.insert(i, rng.choice("abé"))
        elif len(s) > 6:
            s.pop(i)
    return "".join(s)


@pytest.mark.parametrize("long, checked", [(256, 16), (6, 1), (20, 3)])
@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance_and_segment_filter(limit, long, checked, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG", long)
    monkeypatch.setattr(line_dedup, "CHECKED", checked)
    rng = random.Random(limit)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 90)))
        pairs.append((a, changed(rng, a, rng.randrange(0, 6)) if rng.random() < 0.9 else "".join(rng.choice("abé") for _ in range(rng.randrange(6, 90)))))
    codes = np.frombuffer("".join(a + b for a, b in pairs).encode("utf-32-le"), "<u4")
    at = np.cumsum([0] + [len(x) for p in pairs for x in p])
    a, b = at[0:-1:2], at[1::2]
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    got = line_dedup.within(codes, a, m, b, n, limit)
    assert got.tolist() == [edits(x, y) <= limit for x, y in pairs]
    mark = line_dedup.marks(codes, at[:-1], np.diff(at))
    for k, near in enumerate(got):
        assert not near or int(mark[2 * k] ^ mark[2 * k + 1]).bit_count() <= 4 * limit
    for (x, y), near in zip(pairs, got):
        if near and x != y:
            both = np.frombuffer((x + y).encode("utf-32-le"), "<u4")
            rows = line_dedup.line_keys(ts.prefix_hashes(line_dedup.code_values(both)), np.array([0, len(x)]), np.array([len(x), len(y)]), np.array([1, 2]), limit, limit + 1)
            keys = lambda i, look: set(rows["key"][(rows["id"] == i) & (rows["look"] <= look)].tolist())
            assert keys(1, 0) & keys(2, 1) or keys(1, 1) & keys(2, 0)


@pytest.mark.parametrize("block", [4096, 7])
def test_cross_pairs_are_all_pairs_of_different_components(spark, monkeypatch, block):
    """Also of a bucket that is cut into blocks, and of one that one component nearly fills."""
    monkeypatch.setattr(buckets, "BLOCK", block)
    rng = np.random.default_rng(0)
    kinds = (("key", np.uint64), ("id", np.int64), ("size", np.int32))
    rows = {(int(k) << 40, int(i)) for k, i in zip(rng.integers(0, 6, 120), rng.integers(0, 60, 120))} | {(99 << 40, i) for i in range(60)} | {(98 << 40, i) for i in range(30)}
    component = {i: -1 if i < 28 else -2 - i % 4 for i in range(50)}  # the others are their own
    at = sorted(rows)
    table = {"key": np.array([k for k, _ in at], np.uint64), "id": np.array([i for _, i in at]), "size": np.ones(len(at), np.int32)}
    packed = spark.createDataFrame([(p, bytearray(b)) for p, b in buckets.pack(table, 8)], "part int, rows binary")
    index = buckets.Buckets(Workspace(spark, "t"), "index", packed, kinds, [], lambda x, y: F.lit(True), 8)
    got = [(r.a, r.b) for r in index.cross(spark.createDataFrame(list(component.items()), "node long, component long")).collect()]
    want = {(i, j) for k, i in rows for m, j in rows if k == m and i < j and component.get(i, i) != component.get(j, j)}
    assert len(got) == len(set(got)) and set(got) == want
    star = {(r.a, r.b) for r in index.star().collect()}
    every = {(i, j) for k, i in rows for m, j in rows if k == m and i < j}
    assert {(min(i for m, i in rows if m == k), j) for k, j in rows if j != min(i for m, i in rows if m == k)} <= star <= every


def test_equal_sets_have_one_signature(spark):
    """Wherever a text stands in its block, and whatever its ids, case and blanks are."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(90)}" for _ in range(80))
    rows = [(i, text if i % 3 else text.upper().replace(" ", "  ")) for i in range(0, 1000, 2)] + [(i, f"{text} {i} tail of {rng.random()}") for i in range(1, 1000, 2)]
    docs = spark.createDataFrame(sorted(rows), "doc_id long, text string").repartition(5)
    signed = ngram_join.signatures(docs, np.zeros((2, 0), np.uint64), 5, 80)
    assert dict(signed.schema["s1"].jsonValue())["type"] == "long"
    got = signed.where("doc_id % 2 = 0").select("n", "s1", "s2", "p").distinct().collect()
    assert len(got) == 1 and signed.select("s1", "s2").distinct().count() == 501


def test_pack_round_trip():
    rows = {"key": np.arange(1000, dtype=np.uint64) << np.uint64(54), "id": np.arange(1000) - 500, "size": np.arange(1000, dtype=np.int32)}
    kinds = (("key", np.uint64), ("id", np.int64), ("size", np.int32))
    back = [buckets.unpack(b, kinds) for _, b in buckets.pack(rows, 7)]
    assert sorted(np.concatenate([x["id"] for x in back]).tolist()) == rows["id"].tolist()
    assert all((x["id"] + 500 == x["size"]).all() for x in back)


@pytest.mark.parametrize("text", ["", "\\", "a\\\\b", "<|im_start|>x<|im_end|>", "</s>[INST] ok [/INST]", "<s<s></s>>", "\\n\n", "<<SYS>>\\<s>", "[[INST]", "é</s>𝄞"])
def test_escapes_are_reversible(text):
    for line_ends in (False, True):
        out, at = chat.escape(*ts.string_buffers(pa.array(["[IN", text, "ST]"])), line_ends=line_ends)
        inside = out[at[1] : at[2]].tobytes().decode()
        assert chat.unescape(inside, line_ends) == text
        assert not any(c.decode() in inside for c in chat.CONTROLS) and not (line_ends and "\n" in inside)


def test_gradients_by_difference():
    rng = np.random.default_rng(5)
    net = langid.Network.random(["a", "b", "c"], rng, 4)
    for name in ("embed", "recur", "inner", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    windows = rng.integers(97, 123, (10, 6)).astype(np.int16)
    windows[7:, 2:] = langid.PAD
    target = rng.integers(0, 3, 6)
    _, grads = net.gradients(windows, target)
    for w, g in zip(net.weights(), grads):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, e = w[i], 1e-3
        w[i] = old + e
        up, _ = net.gradients(windows, target)
        w[i] = old - e
        down, _ = net.gradients(windows, target)
        w[i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[i], rel=0.02, abs=1e-4)


def best_fit(lengths: list[int], sizes: list[int]) -> int:
    """Bins of sequential best-fit decreasing with the largest size."""
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            free[free.index(min(fit))] -= n
        else:
            free.append(max(sizes) - n)
    return len(free)


def test_plan_holds_everything_and_matches_best_fit():
    rng = random.Random(7)
    for _ in range(20):
        lengths = [rng.randrange(1, 65) for _ in range(300)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        groups = packing.plan(histogram, [64])
        placed: dict[int, int] = {}
        for g in groups:
            assert g.used() <= g.size == 64
            for n, k in g.items:
                placed[n] = placed.get(n, 0) + k * g.bins
        assert placed == histogram
        assert sum(g.bins for g in groups) == best_fit(lengths, [64])


def test_plan_uses_and_shrinks_to_several_sizes():
    groups = packing.plan({100: 3, 30: 2, 7: 1}, [16, 32, 128], cost=lambda s: s + 1)
    assert {g.size for g in groups} <= {16, 32, 128}
    assert all(g.used() <= g.size and not any(s >= g.used() and s < g.size for s in (16, 32, 128)) for g in groups)
    assert sum(g.bins * g.size for g in groups) <= 3 * 128 + 2 * 32


def test_viterbi_splits_names():
    model = url_filter.fit({"example": 5, "tionsh": 50})
    assert model.segment("cheappills") == ["cheap", "pills"] and model.segment("tionsh") == ["tionsh"]
    assert model.score(["casino", "win"]) > 0.5 > model.score(["tionsh"]) and model.segment("") == []
    assert "".join(model.segment("q" * 1300)) == "q" * 1300


def test_rules_longest_wins():
    rules = url_filter.Rules.of([("block", "com/en/"), ("allow", "example.com/en/7")])
    fit = lambda host, path: next((r[1] for r in rules.candidates(host) if path.startswith(r[0])), None)
    assert fit("a.example.com", "/en/77") == "example.com/en/7" and fit("notexample.com", "/en/77") == "com/en/"
    assert fit("com", "/en/") == "com/en/" and fit("xcom", "/en/") is None and fit("", "") is None
