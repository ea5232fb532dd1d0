"""Small cases of the operators that SQL cannot express, and edge cases of the others."""

from __future__ import annotations

import http.server
import json
import math
import threading
import urllib.parse
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators import drain, driver, graph, joins, learned, promql, ranking, series, stats, traces
from faultline.sources import files, paged, sinks
from faultline.streaming import streams


def test_energy_distance_is_the_pairwise_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, 30), rng.normal(1, 2, 20)
    rows = spark.createDataFrame([("k", float(v), 1) for v in x] + [("k", float(v), 0) for v in y], "k string, value double, fail int")
    mean = lambda a, b: np.abs(a[:, None] - b[None]).mean()
    want = math.sqrt(2 * mean(x, y) - mean(x, x) - mean(y, y))
    got = stats.energy_distance(rows, ["k"], "value", "fail").first()
    assert got.epsilon == pytest.approx(want) and (got.n_fault, got.n_normal) == (30, 20)
    tested = stats.permutation_test(rows, ["k"], "value", "fail", permutations=200).first()
    assert tested.epsilon == pytest.approx(want) and tested.p_value < 0.05


def test_linkage_matches_the_general_algorithm():
    rng = np.random.default_rng(1)
    for _ in range(30):
        scores, cut = rng.random(9), 0.25
        groups = [[i] for i in range(9)]
        while len(groups) > 1:
            pairs = [(max(abs(scores[i] - scores[j]) for i in a for j in b), x, y) for (x, a), (y, b) in combinations(enumerate(groups), 2)]
            d, x, y = min(pairs)
            if d > cut:
                break
            groups[x] += groups.pop(y)
        want = {frozenset(g) for g in groups}
        got = stats.linkage_1d(scores, cut)
        assert {frozenset(np.flatnonzero(got == k)) for k in set(got)} == want


def test_gap_clusters_reset_at_each_new_top(spark):
    rows = spark.createDataFrame([("r", i, s, 0.2) for i, s in enumerate([1.0, 0.9, 0.75, 0.7, 0.5])], "k string, i int, score double, t double")
    got = {r.i: r.cluster for r in stats.gap_clusters(rows, "k", "i", "score", "t").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}


def test_page_rank_matches_the_linear_system():
    rng = np.random.default_rng(2)
    m = rng.random((6, 6)) * (rng.random((6, 6)) < 0.5)
    m[3] = 0
    start = rng.random(6)
    p = start / start.sum()
    step = np.where(m.sum(1, keepdims=True) > 0, m / np.maximum(1e-300, m.sum(1, keepdims=True)), p[None])
    want = np.linalg.solve(np.eye(6) - 0.85 * step.T, 0.15 * p)
    assert np.allclose(graph.page_rank(m, start), want, atol=1e-9)


def test_pc_finds_a_collider():
    rng = np.random.default_rng(3)
    a, c = rng.normal(size=2000), rng.normal(size=2000)
    b = a + c + 0.3 * rng.normal(size=2000)
    arrow, open_ = graph.pc_graph(np.stack([a, b, c], 1), 0.01)
    assert arrow[0, 1] and arrow[2, 1] and not arrow[1].any() and not open_.any()


def test_prune_columns():
    x = np.random.default_rng(4).normal(size=(50, 2))
    values = np.column_stack([x, x[:, 0], np.ones(50), x.sum(1)])
    kept, names = graph.prune_columns(values, list("abcde"))
    assert "c" not in names and "d" not in names and len(names) == 2 and kept.shape == (50, 2)


def test_random_walk_stays_on_the_graph():
    share = graph.walk_shares(np.array([[0, 1.0, 0], [0, 0, 1], [0, 0, 0]]), np.array([0.2, 0.5, 0.9]), 0, steps=2000)
    assert share.sum() == pytest.approx(1) and share[2] > share[0]


def test_birch_counts_levels():
    assert graph.birch_count(np.array([0.1] * 20 + [0.1001] * 5), 0.045) == 1
    assert graph.birch_count(np.array([0.1] * 20 + [0.5] * 5), 0.045) == 2


def test_birch_by_hand():
    """Radii after each point: .02 (joins), .0411 (joins), far (new), .01 (joins), .0357 (joins), .0697 with the first cluster (new)."""
    values = [0.0, 0.04, 0.1, 0.5, 0.52, 0.04, 0.2]
    assert [graph.birch_count(np.array(values[:k]), 0.045) for k in range(1, 8)] == [1, 1, 1, 2, 2, 2, 3]


def test_pc_of_chains_forks_and_colliders():
    """Chains and forks share a skeleton without direction; a collider is directed, and so is what follows from it."""
    rng = np.random.default_rng(11)
    noise = lambda: rng.normal(size=4000)
    a = noise()
    b = a + noise()
    c = b + noise()
    arrow, open_ = graph.pc_graph(np.stack([a, b, c], 1), 0.001)
    assert not arrow.any() and sorted(zip(*np.nonzero(open_))) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    b = noise()
    a, c = b + noise(), b + noise()
    arrow, open_ = graph.pc_graph(np.stack([a, b, c], 1), 0.001)
    assert not arrow.any() and sorted(zip(*np.nonzero(open_))) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    a, c = noise(), noise()
    b = a + c + noise()
    d = b + noise()
    arrow, open_ = graph.pc_graph(np.stack([a, b, c, d], 1), 0.001)
    assert sorted(zip(*np.nonzero(arrow))) == [(0, 1), (1, 3), (2, 1)] and not open_.any()


def test_permutation_test_against_all_permutations(spark):
    rng = np.random.default_rng(12)
    for shift in (0.0, 1.0, 3.0):
        values = np.concatenate([rng.normal(shift, 1, 5), rng.normal(0, 1, 6)])
        own = stats._energy(values[:5], values[5:])
        every = [stats._energy(values[list(x)], np.delete(values, list(x))) for x in combinations(range(11), 5)]
        exact = np.mean([e >= own - 1e-12 for e in every])
        rows = spark.createDataFrame([("k", float(v), int(i < 5)) for i, v in enumerate(values)], "k string, value double, fail int")
        got = stats.permutation_test(rows, ["k"], "value", "fail", permutations=3000).first()
        assert got.epsilon == pytest.approx(own) and got.p_value == pytest.approx(exact, abs=0.04)


def test_walk_shares_match_the_stationary_chain():
    """Two services that blame each other: the chain over (before, now) solved exactly."""
    adjacency, corr = np.array([[0, 1, 1], [0, 0, 1], [1, 0, 0]], float), np.array([0.2, 0.5, 0.9])
    shares = graph.walk_shares(adjacency, corr, 0, steps=60_000)
    pull = adjacency * corr
    first = pull / pull.sum(1, keepdims=True)

    def step(before, now):
        q = first[before, now] if before != now and first[before, now] > 0 else corr[now]
        w = np.where(adjacency[now] > 0, 0.5 * q + 0.5 * first[now], 0) + np.where((adjacency[:, now] > 0) & (adjacency[now] == 0), 0.5 * (0.5 * q + 0.5 * corr), 0)
        w[now] = max(0.0, 0.5 * q + 0.5 * corr[now] - w.max())
        return w / w.sum()

    chain = np.zeros((9, 9))
    for b in range(3):
        for n in range(3):
            for k, p in enumerate(step(b, n)):
                chain[3 * b + n, 3 * n + k] += p
    state = np.full(9, 1 / 9)
    for _ in range(4000):
        state = 0.5 * state + 0.5 * state @ chain
    assert shares == pytest.approx([state[[k, 3 + k, 6 + k]].sum() for k in range(3)], abs=0.02)


def test_drain_by_hand(spark):
    """Leaves by length and first two tokens (tokens with a digit are one kind); half of the tokens must agree; lines in order of text."""
    lines = ["get user 1 ok", "get user 2 ok", "get user 2 ok", "get user x failed badly", "put user 1 ok", "get item a b", "get item c d", "get 7 a b", "get 8 a c", "  get user 3 ok ", None]
    want = {("get user <*> ok", 4), ("get user x failed badly", 1), ("put user 1 ok", 1), ("get item <*> <*>", 2), ("get <*> a <*>", 2)}
    for parts in (1, 7):
        got = {(r.template, r.n) for r in drain.templates(spark.createDataFrame([(x,) for x in lines], "message string").repartition(parts)).collect()}
        assert got == want


def test_drain_templates(spark):
    lines = [f"user {n} logged in from host{n}" for n in range(6)] + ["disk full on sda", "disk full on sdb", None, "  "]
    got = {(r.template, r.n) for r in drain.templates(spark.createDataFrame([(x,) for x in lines], "message string")).collect()}
    assert ("user <*> logged in from <*>", 6) in got and ("disk full on <*>", 2) in got


def test_call_paths_end_at_orphans_and_cycles(spark):
    rows = [("t", 1, None, "a", 5), ("t", 2, 1, "a", 4), ("t", 3, 2, "b", 3), ("t", 4, 99, "c", 2), ("u", 1, 2, "x", 1), ("u", 2, 1, "y", 1)]
    df = spark.createDataFrame(rows, "trace_id string, span_id long, parent_span_id long, service string, duration_us long")
    got = {(r.trace_id, r.span_id): r.path for r in traces.call_paths(df).collect()}
    assert got["t", 2] == ["a"] and got["t", 3] == ["a", "b"] and got["t", 4] == ["c"]
    assert set(got["u", 1]) == {"x", "y"}
    assert traces.call_paths(df.limit(0)).count() == 0


def test_deep_and_branching_traces_by_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [("deep", i, i - 1 if i else None, "ab"[i // 3 % 2], 1) for i in range(500)]
    for t in range(12):
        for i in range(30):
            rows.append((f"t{t}", i, int(rng.integers(0, 34)) if i else None, "abc"[int(rng.integers(0, 3))], 1))
    known = {(t, i): (p, s) for t, i, p, s, _ in rows}

    def walk(t, i):
        """Chain from a span up; None if it leads into a cycle."""
        chain = []
        while (t, i) in known:
            if i in chain:
                return None
            chain.append(i)
            i = known[t, i][0]
        return chain

    df = spark.createDataFrame(rows, "trace_id string, span_id long, parent_span_id long, service string, duration_us long").repartition(5)
    got = {(r.trace_id, r.span_id): (r.path, r.depth) for r in traces.call_paths(df).collect()}
    assert got.keys() == known.keys()
    for (t, i), (path, depth) in got.items():
        chain = walk(t, i)
        if chain is not None:
            services = [known[t, k][1] for k in reversed(chain)]
            assert depth == len(chain) and path == [s for k, s in enumerate(services) if not k or services[k - 1] != s]
        assert len(path) >= 1 and path[-1] == known[t, i][1]
    assert {r.depth for r in traces.ancestors(df.where("trace_id = 'deep'")).collect()} == set(range(1, 501))


def test_running_total_and_left_tail(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 400, 1000) / 4
    rows = spark.createDataFrame([(float(v), int(n)) for v, n in zip(values, rng.integers(0, 9, 1000))], "v double, n long")
    pairs = [(r.v, r.n) for r in rows.collect()]
    for r in series.running_total(rows, "v", "n", "upto", parts=7).collect():
        assert r.upto == sum(n for v, n in pairs if v <= r.v)
    assert series.running_total(rows.limit(0), "v", "n", "upto").count() == 0


def test_paged_logs_lose_and_repeat_nothing():
    rng = np.random.default_rng(7)
    times = sorted(int(t) for t in rng.integers(0, 200, 700)) + [77] * 40
    store = sorted(((t, {"pod": f"p{i % 3}"}, f"line {i % 90}") for i, t in enumerate(times)), key=lambda r: (r[0], r[1]["pod"], r[2]))
    asked = []

    def fetch(start, end, limit):
        asked.append(limit)
        return [r for r in store if start <= r[0] <= end][:limit]

    key = lambda r: (r[0], r[1]["pod"], r[2])
    for page in (10, 64, 5000):
        got = [key(r) for a, b in paged.slices(0, 220, 50) for r in paged.logs_of(fetch, a, b, page)]
        assert len(got) == len(set(got)) and set(got) == {key(r) for r in store}


def test_trace_windows_split_until_answers_are_whole():
    rng = np.random.default_rng(8)
    store = [{"traceID": str(i), "at": int(t)} for i, t in enumerate(rng.integers(0, 10**9, 900))]
    fetch = lambda a, b, limit: [t for t in store if a <= t["at"] <= b][:limit]
    got = [t["traceID"] for t in paged.traces_of(fetch, 0, 10**9, limit=20, least=10)]
    assert sorted(got) == sorted(t["traceID"] for t in store)


def test_paged_sources_over_http(spark):
    """Both data sources against a server that answers in pages."""
    lines = [(i * 10**9, f"line {i}") for i in range(120)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urllib.parse.urlparse(self.path)
            o = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            a, b, limit = int(o["start"]), int(o["end"]), int(o["limit"])
            if "loki" in url.path:
                values = [[str(t), x] for t, x in lines if a <= t <= b][:limit]
                body = {"status": "success", "data": {"result": [{"stream": {"pod": "p", "node_name": "n"}, "values": values}]}}
            else:
                body = {"data": [{"traceID": str(i), "processes": {"p": {"serviceName": "s"}}, "spans": [{"spanID": "1", "processID": "p", "operationName": "op", "startTime": t // 1000, "duration": 5}]} for i, (t, _) in enumerate(lines) if a <= t // 1000 <= b][:limit]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        paged.register(spark)
        url = f"http://127.0.0.1:{server.server_port}"
        logs = spark.read.format("paged_logs").options(url=url, start=0, end=119 * 10**9, slice=30 * 10**9, page=7).load()
        assert sorted((r.ts_ns, r.node, r.pod, r.log) for r in logs.collect()) == [(t, "n", "p", x) for t, x in lines]
        answers = spark.read.format("split_traces").options(url=url, service="s", start=0, end=119 * 10**6, slice=60 * 10**6, limit=10).load()
        assert {(r.trace_id, r.service) for r in files.spans_of(answers).collect()} == {(str(i), "s") for i in range(120)}
    finally:
        server.shutdown()


def test_trace_model_gradients_and_likelihood():
    rng = np.random.default_rng(9)
    model = learned.Model.random(5, rng, hidden=6, latent=2)
    x, mask, eps = rng.normal(size=(8, 5)), (rng.random((8, 5)) < 0.8) * 1.0, rng.normal(size=(8, 2))
    x *= mask
    _, grads = model.step(x, mask, eps)
    for w, g in zip(model.weights, grads):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = w[i]
        w[i] = old + 1e-5
        up, _ = model.step(x, mask, eps)
        w[i] = old - 1e-5
        down, _ = model.step(x, mask, eps)
        w[i] = old
        assert (up - down) / 2e-5 == pytest.approx(g[i], rel=1e-3, abs=1e-6)
    # one latent unit and a flat grid give the same likelihood as the samples
    model = learned.Model.random(3, rng, hidden=4, latent=1)
    x, mask = rng.normal(size=(4, 3)), np.ones((4, 3))
    z = np.linspace(-8, 8, 4001)[:, None]
    _, mean, raw = model.decode(z)
    var = 1e-4 + learned.soft(raw)
    for k in range(4):
        log_px = -0.5 * (learned.LOG_2PI + np.log(var) + (x[k] - mean) ** 2 / var).sum(1) - 0.5 * (learned.LOG_2PI + z[:, 0] ** 2)
        want = np.log(np.exp(log_px).sum() * (z[1, 0] - z[0, 0]))
        got = model.log_likelihood(x[k : k + 1], mask[k : k + 1], np.random.default_rng(k), 4000)[0]
        assert got == pytest.approx(want, abs=0.1)


def test_many_likelihoods_at_once_equal_single_ones():
    rng = np.random.default_rng(12)
    model = learned.Model.random(40, rng)
    rows = [sorted(rng.choice(40, k, replace=False).tolist()) for k in (3, 0, 1, 7, 0, 40, 2)]
    dims, values = pa.array(rows, pa.list_(pa.int64())), pa.array([rng.normal(size=len(r)).tolist() for r in rows], pa.list_(pa.float64()))
    x, mask = learned.matrices(dims, values, 40)
    want = [model.log_likelihood(x[i : i + 1], mask[i : i + 1], np.random.default_rng(i))[0] for i in range(len(rows))]
    eps = np.stack([np.random.default_rng(i).normal(size=(learned.SAMPLES, learned.LATENT)) for i in range(len(rows))])
    counts, at, z = learned.present(dims, values)
    got = model.log_likelihoods(counts, at, z, eps)
    assert got == pytest.approx(want, rel=1e-9)
    # a row's result is the same bit by bit beside other rows
    for i in range(len(rows)):
        alone = learned.present(dims.slice(i, 1), values.slice(i, 1))
        assert model.log_likelihoods(*alone, eps[i : i + 1])[0] == got[i]


def test_trace_model_tells_odd_vectors(spark):
    rng = np.random.default_rng(10)
    usual = [(f"n{i}", d, float(v)) for i in range(300) for d, v in enumerate(rng.normal() * np.array([1, -1, 0.5]) + rng.normal(0, 0.1, 3))]
    odd = [(f"x{i}", d, float(v)) for i in range(30) for d, v in enumerate(rng.normal(0, 4, 3))]
    stats_ = spark.createDataFrame([(d, 0.0, 1.0) for d in range(3)], "dim long, mean double, sigma double")
    rows = lambda x: learned.normalized(spark.createDataFrame(x, "trace_id string, dim long, duration double"), stats_)
    model = learned.fit(rows(usual), 3)
    back = learned.from_table(learned.as_table(spark, model))
    assert all((a == b).all() for a, b in zip(model.weights, back.weights))
    score = {r.trace_id: r.score for r in learned.likelihoods(rows(usual + odd), model, 3).collect()}
    limit = np.quantile([s for t, s in score.items() if t[0] == "n"], 0.05)
    assert np.mean([s < limit for t, s in score.items() if t[0] == "x"]) > 0.8
    again = {r.trace_id: r.score for r in learned.likelihoods(rows(usual + odd).repartition(9), model, 3).collect()}
    assert again == score


def test_localization_prefers_the_anomalous_service(spark):
    edges = [("c", "front", "cart"), ("c", "cart", "db"), ("c", "cart", "h"), ("c", "front", "h")]
    nodes = [("c", "front", "service", True), ("c", "cart", "service", True), ("c", "db", "service", False), ("c", "h", "host", False)]
    corr = [("c", "cart", "cpu", 0.9), ("c", "front", "cpu", 0.1), ("c", "cart", "h", 0.4)]
    frame = lambda x, k: spark.createDataFrame(x, k)
    args = frame(edges, "case string, src string, dst string"), frame(nodes, "case string, node string, kind string, anomalous boolean"), frame(corr, "case string, node string, resource string, corr double")
    got = {r.node: r.score for r in graph.localize(*args, "case").collect()}
    # by hand: weights front-cart .55, cart-db .55, cart-h .4, front-h 0; restart to cart alone (.55 * .9), as front has no caller
    at = {v: i for i, v in enumerate(["cart", "db", "front", "h"])}
    m = np.zeros((4, 4))
    for s, d, w in (("front", "cart", 0.55), ("cart", "db", 0.55), ("cart", "h", 0.4)):
        m[at[d], at[s]] = w
    want = graph.page_rank(m, np.array([1.0, 0, 0, 0]))
    assert got == pytest.approx({v: want[at[v]] for v in ("cart", "db", "front")}) and max(got, key=got.get) == "cart"
    none = graph.localize(args[0], frame([(*n[:3], False) for n in nodes], "case string, node string, kind string, anomalous boolean"), args[2], "case")
    assert none.count() == 3


def test_driver_runs_days_alone_only_after_a_failure(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "day string, v int")
    whole, failed = driver.by_day(rows, "day", lambda d: d.select("day", (F.col("v") + 1).alias("v")), "t")
    assert failed == [] and whole.count() == 3
    spark.conf.set("spark.sql.ansi.enabled", "true")
    done, failed = driver.by_day(rows, "day", lambda d: d.select("day", F.expr("10 div v").alias("v")), "t")
    assert {r.day for r in done.collect()} == {"a", "c"} and [f[:2] for f in failed] == [("b", "error")]


def test_asof_takes_the_latest_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60)], "k string, u int, v int")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None}


def test_closed_windows_share_their_ends(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' ts, 1 id")
    windows = spark.sql("select 'x' w, timestamp_ntz'2024-01-01 09:00:00' window_start, timestamp_ntz'2024-01-01 10:00:00' window_end union all select 'y', timestamp_ntz'2024-01-01 10:00:00', timestamp_ntz'2024-01-01 11:00:00'")
    assert sorted(r.w for r in joins.in_windows(rows, windows).collect()) == ["x", "y"]


def test_fill_and_grid(spark):
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("b", 0, None)], "k string, bucket int, value double")
    got = {(r.k, r.bucket): r.value for r in series.filled(rows, ["k"]).collect()}
    assert got == {("a", 0): 2.0, ("a", 1): 2.0, ("a", 2): 2.0, ("b", 0): 0.0}


def test_increase_counts_resets(spark):
    rows = spark.createDataFrame([(i, i, v) for i, v in enumerate([1.0, 4.0, 2.0, 3.0])], "event_id int, s int, value double").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit("x"))
    got = [r.increase for r in promql.increase(rows, ["k"], 10).orderBy("event_id").collect()]
    assert got == [0.0, 3.0, 5.0, 6.0]


def test_histogram_quantile_infinite_bucket(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", float("inf"), 10.0)], "k string, le double, value double")
    assert promql.histogram_quantile(rows, ["k"], 0.9).first().quantile == 1.0


def test_hits_count_a_missing_ranking_as_a_miss(spark):
    ranks = spark.createDataFrame([("x", "a", 1), ("x", "b", 2)], "run string, service string, rank long")
    truth = spark.createDataFrame([("x", "b"), ("y", "a")], "run string, target string")
    got = {r.run: (r.top1, r.top3) for r in ranking.hits(ranks, truth, ["run"], "service", "target").collect()}
    assert got == {"x": (0, 1), "y": (0, 0)}


def test_text_expressions_on_nulls(spark):
    row = spark.createDataFrame([(None,)], "x string").select(
        text.service_name(F.col("x")).alias("a"), text.log_level(F.col("x")).alias("b"), text.template_name(F.col("x")).alias("c"), text.seconds(F.col("x")).alias("d"), F.size(text.tags_map(F.col("x"))).alias("e")
    ).first()
    assert tuple(row) == (None, "UNKNOWN", "unknown", None, 0)


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"status":"success","data":{"result":[{"metric":{"__name__":"up","pod":"a-0"},"values":[[1700000000,"1.5"],[1700000005,"x"]]}]}}')
    got = files.flattened(files.prometheus_json(spark, str(tmp_path / "p.json")), "kpi").collect()
    assert [(r.entity, r.metric, r.value) for r in got] == [("a-0", "up", 1.5), ("a-0", "up", None)]
    (tmp_path / "j.json").write_text('{"data":[{"traceID":"t","processes":{"p":{"serviceName":"s"}},"spans":[{"spanID":"1","processID":"p","operationName":"o","startTime":5,"duration":6,"references":[],"tags":[{"key":"a","type":"int64","value":3}]},{"spanID":"1","processID":"q"}]}]}')
    assert files.jaeger_json(spark, str(tmp_path / "j.json"), "f").count() == 1
    (tmp_path / "l.json").write_text('{"status":"success","data":{"result":[{"stream":{"node_name":"n","pod":"p"},"values":[["1","x"],["1","x"]]}]}}')
    assert [tuple(r) for r in files.loki_json(spark, str(tmp_path / "l.json")).collect()] == [(1, "n", "p", "", "x")]
    (tmp_path / "t.json").write_text('{"services":[{"name":"a","depends_on":["b"]},{"name":"b","depends_on":[]}]}')
    assert {tuple(r) for r in files.topology_json(spark, str(tmp_path / "t.json")).collect()} == {("a", "b"), ("b", None)}
    (tmp_path / "m.csv").write_text("timestamp,pod,metric,value,labels\n2024-01-01 00:00:00,a,m,1,\n2024-01-01 00:00:00,a,m,1,\nbad,a,m,2,\n2024-01-01 00:00:05,a,m,NaN,\n")
    assert files.metrics_csv(spark, str(tmp_path / "m.csv")).count() == 1


def test_yaml_leaves():
    flat = files.flat_yaml("kind: NetworkChaos\nmetadata:\n  name: x\n  namespace: n\nspec:\n  selector:\n    namespaces:\n      - a\n      - b\n  delay:\n    latency: '200ms' # slow\n  action: delay\n")
    assert flat == {"kind": "NetworkChaos", "metadata.name": "x", "metadata.namespace": "n", "spec.selector.namespaces": "a,b", "spec.delay.latency": "200ms", "spec.action": "delay"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "e", [1, 2])], "day string, exp_id string, xs array<int>")
    sinks.write_cases(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().xs == "[1,2]"
    made = []
    for _ in range(2):
        sinks.reused(spark, f"file://{tmp_path}/r", lambda: made.append(1) or df, a=1)
    assert len(made) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.into_memory(streams.bucket_stats(stream, ["k"], size="10 seconds"), "buckets", "complete").start().awaitTermination(120)
    want = {(r.w.start, r.k): r.n for r in rows.groupBy(F.window("ts", "10 seconds").alias("w"), "k").agg(F.count("*").alias("n")).collect()}
    assert {(r.window_start, r.k): r.n for r in spark.table("buckets").collect()} == want
