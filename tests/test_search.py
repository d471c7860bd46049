"""Search, index, update and cache against brute force and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbita.config import Config, auto_depth, read_yaml
from orbita.functions import thresholds, vec
from orbita.operators import clustering, index, metrics, search, shapes, update
from orbita.plans import pruned, ranks
from orbita.plans import tables as cut
from orbita.sources import tables
from orbita.streaming.cache import Cache

KEYS, QUERIES = "kv_head int, key_id long, key array<double>", "query_id long, q_head int, q array<double>, threshold double"


def data(spark, n, d, heads=2, seed=0, blobs=False):
    r = random.Random(seed)
    rows = [(h, i, [r.gauss(0, 1) + (5 * (i % 3 - 1) if blobs else 0) for _ in range(d)]) for h in range(heads) for i in range(n)]
    return spark.createDataFrame(rows, KEYS), rows


def asked(spark, d, thresholds_, heads=2, seed=9, **how):
    r = random.Random(seed)
    rows = [(k, h, [r.gauss(0, 1) for _ in range(d)], t) for k, t in enumerate(thresholds_) for h in range(heads)]
    return search.queries(spark.createDataFrame(rows, QUERIES), **how), rows


def brute(keys, queries):
    return {(q, h, i): s for q, h, v, t in queries for g, i, k in keys if g == h and (s := sum(a * b for a, b in zip(v, k, strict=True))) >= t}


def found(df):
    return {(x["query_id"], x["q_head"], x["key_id"]): x["score"] for x in df.collect()}


def same(got, want):
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize(("levels", "bf", "d", "balanced"), [(1, 4, 4, False), (2, 4, 4, False), (3, 8, 8, False), (6, 2, 3, False), (2, 8, 4, True), (3, 3, 4, True)])
def test_tree_equals_flat_scan(spark, levels, bf, d, balanced):
    k, rows = data(spark, 65, d)
    q, asks = asked(spark, d, (-1.0, 0.0, 1.5, 99.0))
    i = index.build(k, levels, bf, iterations=0 if balanced else 1, balanced=balanced, arrow=True)
    want = brute(rows, asks)
    same(found(search.tree_search(i, q)), want)
    same(found(search.flat_scan(k, q)), want)
    same(found(search.flat_scan(k, q, arrow=True)), want)
    assert index.broken_bounds(i).isEmpty()
    if levels > 1:
        assert i.leaf.count() == k.count() == i.leaf.distinct().count()
        assert not balanced or i.leaf.groupBy("kv_head", "parent_id").count().agg(F.max("count")).first()[0] <= bf
        assert not i.nodes.filter("level = 1").isEmpty()


def test_gates_and_ties(spark):
    k = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0], [0.0, 0.0]])], KEYS)
    for t, n in ((-1.0, 5), (0.0, 4), (0.5, 1), (1.0, 1), (1.1, 0)):
        for scale in (2.0, 0.5):
            q = search.queries(spark.createDataFrame([(0, 0, [scale, 0.0], t * scale)], QUERIES))
            i = index.build(k, 2, 1)
            assert search.tree_search(i, q).count() == search.flat_scan(k, q).count() == n
            assert search.tree_search(i, q, "scan").count() == {(-1.0): 4, 0.0: 1, 0.5: 1, 1.0: 0, 1.1: 0}[t]
    with pytest.raises(ValueError):
        search.gate("other")


def test_duplicates_small_and_empty(spark):
    k = spark.createDataFrame([(0, i, [1.0, 1.0]) for i in range(20)], KEYS)
    i = index.build(k, 3, 3, balanced=True)
    assert i.level(1).agg(F.max("radius")).first()[0] == 0
    q = search.queries(spark.createDataFrame([(0, 0, [1.0, 0.0], 1.0)], QUERIES))
    assert search.tree_search(i, q).count() == 20
    one = k.limit(1)
    assert search.tree_search(index.build(one, 3, 4), q).count() == 1
    assert search.flat_scan(k.limit(0), q).count() == 0


@pytest.mark.parametrize("levels", [2, 3])
def test_updates(spark, levels):
    k, rows = data(spark, 90, 4, seed=3, blobs=True)
    q, asks = asked(spark, 4, (0.0, 3.0))
    base, new, last = k.filter("key_id < 50"), k.filter("key_id >= 50 and key_id < 80"), k.filter("key_id >= 80 and kv_head = 0 or key_id >= 85")
    rest = [x for x in rows if x[1] < 80 or (x[0] == 0 or x[1] >= 85)]
    for add, balanced in ((update.append_forest, False), (update.fill_slots, True)):
        i = index.build(base, levels, 4, balanced=balanced)
        for part in (new, last, k.limit(0)):
            i = add(i, part)
            assert index.broken_bounds(i).isEmpty()
            assert i.leaf.count() == i.leaf.select("kv_head", "key_id").distinct().count() == i.keys.count()
        same(found(search.tree_search(i, q)), brute(rest, asks))
        if balanced:
            assert i.leaf.groupBy("kv_head", "parent_id").count().agg(F.max("count")).first()[0] <= 4
    same(found(search.tree_search(update.compact(i), q)), brute(rest, asks))


def test_head_maps():
    assert search.head_map(6, 2) == [0, 0, 0, 1, 1, 1] and search.head_map(2, 3, [2, 0]) == [2, 0]
    for bad in ((3, 2, None), (2, 2, [0]), (1, 1, [1])):
        with pytest.raises(ValueError):
            search.head_map(*bad)


def test_cache_and_stream(spark, tmp_path):
    k, rows = data(spark, 40, 4, heads=1)
    q, asks = asked(spark, 4, (0.5,), heads=1)
    cache = Cache(Config(update_every=3, num_levels=3, branching_factor=4), layers=2, shared=1)
    layer = cache.layers[0]
    assert len(cache.layers) == 1 and layer.sequence_length == 0
    for b, (lo, hi, queued) in enumerate(((0, 30, 0), (30, 32, 2), (32, 33, 0), (33, 35, 2))):
        cache.update(k.filter(f"key_id >= {lo} and key_id < {hi}"), 0, b)
        cache.update(k.filter(f"key_id >= {lo} and key_id < {hi}"), 0, b)
        assert layer.queued_len == queued and layer.sequence_length == hi
        same(found(cache.search(q, 0)), brute([x for x in rows if x[1] < hi], asks))
    assert layer.mask_sizes(5) == (40, 0) and layer.max_shape == -1
    cache.reset()
    assert layer.sequence_length == 0
    k.withColumn("layer", F.lit(0)).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("kv_head int, key_id long, key array<double>, layer int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cache.attach(stream, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    same(found(cache.search(q, 0)), brute(rows, asks))


@pytest.mark.parametrize("kind", shapes.KINDS)
def test_shapes(spark, kind):
    k, rows = data(spark, 60, 3, heads=1, blobs=True)
    members, centers = shapes.random_clusters(k.select("key_id", "key"), 8)
    made = shapes.MAKE[kind](members, centers)
    last = 101.0
    for t in (-1e6, -3.0, 0.0, 3.0, 1e6):
        q, asks = asked(spark, 3, (t,), heads=1)
        pct = shapes.intersecting(kind, made, q).first()["pct"]
        assert pct <= last and (t > -1e5 or pct == 100) and (t < 1e5 or pct == 0)
        last = pct
        hit = {i for _, _, i in brute(rows, asks)}
        need = {x["cluster_id"] for x in members.collect() if x["key_id"] in hit}
        assert pct >= 100 * len(need) / 8 - 1e-9


def test_thresholds(spark):
    rows = [(0, float(x)) for x in (5, 1, 3, 3, 2, 9)] + [(1, 4.0)]
    df = spark.createDataFrame(rows, "g int, score double")
    get = lambda d: dict(d.select("g", "threshold").collect())
    assert get(thresholds.topk(df, ["g"], 3)) == {0: 3.0, 1: 4.0}
    assert get(thresholds.nth(df, ["g"], 1)) == {0: 5.0, 1: 4.0}
    assert get(thresholds.tau(df, ["g"], 0.5)) == {0: 3.0, 1: 4.0}
    assert get(thresholds.midpoint(df, ["g"])) == {0: 3.0, 1: 4.0}
    assert get(thresholds.quantile(df, ["g"], 0.5)) == {0: 3.0, 1: 4.0}


def test_metrics_and_vectors(spark):
    k, rows = data(spark, 64, 4)
    q, asks = asked(spark, 4, (1.0,))
    i = index.build(k, 3, 4)
    assert {x["recall"] for x in metrics.recall(search.flat_scan(k, q), search.tree_search(i, q)).collect()} == {1.0}
    assert all(0 <= x["fraction"] <= 1 for x in metrics.scanned_fraction(i, q).collect())
    assert search.dense(k, q, search.flat_scan(k, q), -7.0).filter("score = -7").count() == 128 - len(brute(rows, asks))
    row = spark.createDataFrame([([3.0, 4.0],)], "a array<double>").select(vec.norm("a").alias("n"), vec.normalized("a").alias("u"), vec.is_padding("a").alias("p")).first()
    assert (row["n"], row["u"], row["p"]) == (5.0, [0.6, 0.8], False)
    with pytest.raises(Exception, match="a vector of 3"):
        spark.createDataFrame([([3.0, 4.0],)], "a array<double>").select(vec.checked("a", 3)).collect()
    got = clustering.greedy_capacity(k, clustering.seeds(k, lambda n: F.lit(16), 1, ["kv_head"]), 4, ["kv_head"])
    assert got.groupBy("kv_head", "node_id").count().agg(F.max("count")).first()[0] == 4 and got.count() == 128


def test_sources_and_config(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"input":" ","question":"q1"}\n\n{"prompt":"p2"}\n{"other":1}\n')
    assert [r[0] for r in tables.json_prompts(spark, f"{tmp_path}/p.jsonl").collect()] == ["q1", "p2"]
    (tmp_path / "p.txt").write_text(" a \n\n b\n")
    assert [r[0] for r in tables.text_prompts(spark, f"{tmp_path}/p.txt").collect()] == ["a", "b"]
    k, _ = data(spark, 10, 2, heads=1)
    tables.save(k, f"{tmp_path}/k", {"n": 10})
    assert tables.keys(spark, f"{tmp_path}/k", 4).count() == 4 and tables.about(spark, f"{tmp_path}/k") == {"n": 10}
    (tmp_path / "c.yml").write_text("num_levels: 3\nbranching_factor: 8\n")
    assert Config.from_yaml(f"{tmp_path}/c.yml").branching_factor == 8
    (tmp_path / "e.yml").write_text("")
    assert read_yaml(f"{tmp_path}/e.yml") == {}
    with pytest.raises(ValueError):
        Config.from_dict({"nope": 1})
    assert auto_depth(1000, 10) == math.ceil(math.log(1000) / math.log(10))


def test_the_query_set_is_every_50th_vector(spark):
    from orbita import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id % 50 = 0")
    want = {r["vec_id"] for r in rows.select("vec_id").collect()}
    for name, heads in (("all_scores", 1), ("threshold_topk", 1), ("knn_radius", queries.HEADS)):
        got = {r["query_id"] for r in queries.Q[name](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()}
        assert got == {i * heads + h for i in want for h in range(heads)}
        assert queries.ASKED in queries.SQL[name]


def test_large_heads_are_assigned_to_the_nearest_center(spark):
    n, bf = 66_000, 4096
    keys = spark.range(n).selectExpr("cast(if(id < 20, 1, 0) as int) kv_head", "id key_id", "array(cast(pmod(xxhash64(id), 1000) as double), cast(pmod(xxhash64(id, 1), 1000) as double)) key")
    keys = cut.saved(keys, "keys")
    tree = index.build(keys, 2, bf, arrow=True)
    center = {(r["kv_head"], r["node_id"]): np.array(r["center"]) for r in tree.level(1).collect()}
    rows = keys.join(tree.leaf, ["kv_head", "key_id"]).collect()
    assert len(rows) == n and sum(h == 0 for h, _ in center) == (n - 20) // bf and sum(h == 1 for h, _ in center) == 1
    for head in (0, 1):
        some = [r for r in rows if r["kv_head"] == head]
        x, c = np.array([r["key"] for r in some]), np.array([v for (h, _), v in center.items() if h == head])
        own = np.array([center[head, r["parent_id"]] for r in some])
        assert np.allclose(((x - own) ** 2).sum(1), ((x[:, None] - c[None]) ** 2).sum(2).min(1))


def test_nearest_agrees_with_the_join(spark):
    """Ties, near ties and heads without centers, in Arrow batches and by join."""
    r = np.random.default_rng(3)
    points = [(h, i, [float(x) for x in r.integers(-2, 3, 4)]) for h in range(3) for i in range(60)] + [(0, 100, [1e6, 1e6, 1e6, 1e6])]
    centers = [(h, n, [float(x) for x in r.integers(-2, 3, 4)]) for h in (0, 2) for n in range(9)] + [(0, 50, [1e6, 1e6, 1e6, 1e6 + 1e-4]), (0, 51, [1e6, 1e6, 1e6, 1e6])]
    p = spark.createDataFrame(points, "kv_head int, key_id long, key array<double>")
    c = spark.createDataFrame(centers, "kv_head int, node_id long, center array<double>")
    join, arrow = (sorted(tuple(x) for x in clustering.nearest_assign(p, c, ["kv_head"], arrow=a).select("kv_head", "key_id", "node_id", "dist2").collect()) for a in (False, True))
    assert [x[:3] for x in join] == [x[:3] for x in arrow] and len(join) == 121
    assert np.allclose([x[3] for x in join], [x[3] for x in arrow])


def test_queries_of_another_size_are_an_error(spark):
    rows = spark.createDataFrame([(1, 0, [0.5, 1.0])], "query_id long, q_head int, q array<double>")
    assert search.queries(rows, 0.1, size=2).count() == 1
    with pytest.raises(Exception, match="vector of 3 numbers"):
        search.queries(rows, 0.1, size=3).collect()


def test_prompts_lose_all_white_space(spark):
    rows = spark.createDataFrame([("\t\u3000\n", " \x0bquestion\u00a0\x1f", "other")], "a string, b string, c string")
    assert rows.select(tables.prompt(F.col("a"), F.col("b"), F.col("c")).alias("p")).first()["p"] == "question"


@pytest.mark.parametrize("window", [0, 1 << 20])
def test_places_and_running_sums(spark, window):
    """One group with nearly all rows, equal order keys told apart by ids, and a group of one."""
    rows = [(0 if i % 50 else i % 3, i % 7, i, i % 11) for i in range(4000)] + [(9, 1, 5000, 4)]
    df = spark.createDataFrame(rows, "g int, o int, id long, v long").repartition(5)
    got = {(r["g"], r["id"]): r["k"] for r in ranks.numbered(df, ["g"], [-F.col("o"), "id"], "k", window).collect()}
    sums = {(r["g"], r["id"]): r["s"] for r in ranks.running(df, ["g"], [-F.col("o"), "id"], "v", "s", window).collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for k, (_, o, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            assert got[g, i] == k and sums[g, i] == total
            total += v
    assert ranks.numbered(df.limit(0), ["g"], ["id"], "k", window).count() == 0


def test_seeds_and_balanced_children_without_windows(spark, monkeypatch):
    k = spark.createDataFrame([(0 if i < 700 else 1, i, [float(i * 37 % 101), float(i * 53 % 89)]) for i in range(720)], KEYS)
    get = lambda: (sorted(map(str, (c := clustering.seeds(k, lambda n: F.ceil(n / 8), 3, ["kv_head"])).collect())), sorted(tuple(r) for r in clustering.balanced_assign(k, c, 8, 3, ["kv_head"]).select("kv_head", "key_id", "node_id", "slot").collect()))
    want = get()
    monkeypatch.setattr(ranks, "WINDOW_ROWS", 0)
    assert get() == want and len(want[1]) == 720


def _doubles(r, n):
    kinds = (lambda: r.gauss(0, 1), lambda: float(r.randrange(5)), lambda: 10.0 ** r.randrange(-300, 300), lambda: -(10.0 ** r.randrange(-300, 300)), lambda: r.choice((0.0, -0.0, 1e-310, float("inf"), float("-inf"))))
    return [r.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("few", [0, 3, 4096])
def test_selection_without_sorting(spark, few):
    r = random.Random(few)
    groups = {0: _doubles(r, 900), 1: _doubles(r, 7), 2: [2.5] * 40, 3: [1.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [(1, None), (4, None)], "g int, score double").repartition(3)
    places = {"first": lambda n: F.lit(1), "last": lambda n: n, "third": lambda n: F.floor((n + 2) / 3), "seventh": lambda n: F.lit(7)}
    got = {x["g"]: x for x in thresholds.selected(df, ["g"], places, few).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        s = sorted(xs)
        assert (got[g]["n"], got[g]["first"], got[g]["last"], got[g]["third"]) == (len(s), s[0], s[-1], s[(len(s) + 2) // 3 - 1])
        assert got[g]["seventh"] == (s[6] if len(s) > 6 else None)


@pytest.mark.parametrize("how", [{}, {"block_rows": 4, "share_rows": 7}, {"pivots": 3}])
def test_pruned_nearest_is_exact(spark, how):
    """Ties, equal centers, a cell with a third of all rows, groups without centers or with one."""
    r = np.random.default_rng(5)
    blob = lambda n: r.integers(0, 4, (n, 1)) * 40 + r.integers(-6, 7, (n, 3))
    points = [(h, i, [float(v) for v in x]) for h, n in ((0, 400), (1, 50), (2, 9), (3, 5)) for i, x in enumerate(blob(n))]
    points += [(0, 1000 + i, points[0][2]) for i in range(200)]
    centers = [(h, i, [float(v) for v in x]) for h, n in ((0, 130), (1, 60), (3, 1)) for i, x in enumerate(blob(n))]
    centers += [(0, 500 + i, centers[3][2]) for i in range(60)]
    p, c = spark.createDataFrame(points, KEYS).repartition(3), spark.createDataFrame(centers, "kv_head int, node_id long, center array<double>")
    got = {(x["kv_head"], x["key_id"]): (x["dist2"], x["node_id"]) for x in pruned.nearest(p, c, ["kv_head"], **how).collect()}
    want = {(h, i): min((sum((a - b) ** 2 for a, b in zip(x, y)), n) for g, n, y in centers if g == h) for h, i, x in points if h != 2}
    assert got == want


def test_pruned_nearest_measures_few(spark):
    """10^6 keys in one head and 10^5 centers: distances stay well under all of them."""
    blob = lambda n, seed: spark.range(n).selectExpr("0 kv_head", "id", f"pmod(xxhash64(id, {seed}), 2000) b").selectExpr("kv_head", "id", f"array(10 * sin(b * 12.9) + 0.1 * rand({seed}), 10 * sin(b * 78.2) + 0.1 * rand({seed + 1}), 10 * sin(b * 37.7) + 0.1 * rand({seed + 2})) v")
    keys = cut.saved(blob(1_000_000, 1).selectExpr("kv_head", "id key_id", "v key"), "keys")
    centers = cut.saved(blob(100_000, 7).selectExpr("kv_head", "id node_id", "v center"), "centers")
    found = cut.saved(pruned.nearest(keys, centers, ["kv_head"]), "found")
    n, measured = found.agg(F.count("node_id"), F.sum("measured")).first()
    assert n == 1_000_000 and measured < 0.02 * 1_000_000 * 100_000
    some = found.join(keys, ["kv_head", "key_id"]).filter("key_id % 5000 = 0").collect()
    c = centers.orderBy("node_id").collect()
    ids, y = np.array([r["node_id"] for r in c]), np.array([r["center"] for r in c])
    for r in some:
        d = ((np.array(r["key"]) - y) ** 2).sum(1)
        assert r["node_id"] == ids[d.argmin()] and r["dist2"] == pytest.approx(d.min())


@pytest.mark.parametrize("mode", ["exact", "scan"])
def test_cache_goes_on_after_a_lost_driver(spark, tmp_path, mode):
    """A stream dies between two layers of a batch; a new cache on the same folder and checkpoint takes each batch once."""
    k, rows = data(spark, 40, 4, heads=2, seed=4)
    q, asks = asked(spark, 4, (0.5, -1.0))
    config = Config(mode=mode, update_every=12, num_levels=3, branching_factor=4)
    for b in range(4):
        part = k.filter(f"key_id >= {10 * b} and key_id < {10 * b + 10}")
        part.withColumn("layer", F.lit(0)).unionByName(part.withColumn("layer", F.lit(1))).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    files = f"{tmp_path}/in/*"
    open_ = lambda: Cache(config, 2, folder=f"file://{tmp_path}/state")
    stream = lambda c: c.attach(spark.readStream.schema("kv_head int, key_id long, key array<double>, layer int").option("maxFilesPerTrigger", 1).parquet(files), f"{tmp_path}/cp").trigger(availableNow=True).start()
    first = open_()
    taken = []

    def dies(keys, batch_id=None, real=first.layers[1].update):
        taken.append(batch_id)
        if len(taken) == 3:
            raise RuntimeError("the driver is lost")
        return real(keys, batch_id)

    first.layers[1].update = dies
    with pytest.raises(Exception, match="the driver is lost"):
        stream(first).awaitTermination(300)
    half = open_()
    assert (half.layers[0].sequence_length, half.layers[1].sequence_length) == (30, 20)
    again = open_()
    stream(again).awaitTermination(300)
    for layer in again.layers:
        assert layer.sequence_length == 40 and layer.state["batch"] == 3
        made = layer.indexed
        assert made.keys.count() + (layer.queue.count() if layer.queue is not None else 0) == 80
        assert index.broken_bounds(made).isEmpty()
        if mode == "exact":
            same(found(layer.search(q)), brute(rows, asks))
        else:
            assert set(brute(rows, asks)) <= set(found(layer.search(q)))
    gone = again.layers[0].clean()
    assert gone and again.layers[0].clean() == []
    if mode == "exact":
        same(found(open_().search(q, 0)), brute(rows, asks))


def test_flushes_write_what_they_add(spark, tmp_path):
    k, rows = data(spark, 24, 4, heads=1, seed=6)
    q, asks = asked(spark, 4, (0.2,), heads=1)
    cache = Cache(Config(update_every=1, num_levels=2, branching_factor=4), 1, folder=f"file://{tmp_path}/s")
    layer, written = cache.layers[0], 0
    for b in range(6):
        cache.update(k.filter(f"key_id >= {4 * b} and key_id < {4 * b + 4}"), 0, b)
        assert len(layer.state["segments"]) <= 3 * 3
    for name in layer._opened().tables():
        if "segment" in name:
            written += spark.read.parquet(f"{layer.folder}/{name}/blocks").count()
    assert 24 < written <= 24 * 3  # once as added, and again as often as fours have come together
    same(found(cache.search(q, 0)), brute(rows, asks))
    with pytest.raises(RuntimeError, match="another driver"):
        Cache(layer.config, 1, folder=f"file://{tmp_path}/s").layers[0]._opened().commit({**layer.state})
    cache.reset()
    assert Cache(layer.config, 1, folder=f"file://{tmp_path}/s").layers[0].sequence_length == 0


def test_leaf_blocks_are_read_by_need(spark):
    """Folders read fall with the parents in reach; updates keep blocks, and results stay."""
    k, rows = data(spark, 400, 3, heads=1, blobs=True)
    tree = index.laid_out(index.build(k.filter("key_id < 300"), 3, 8), block_keys=20)

    def read(df):
        """Bytes of the files that a scan reads."""
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return plan.collectLeaves().apply(0).metrics().apply("filesSize").value()

    parents = tree.level(1).select("kv_head", F.col("node_id").alias("parent_id"))
    some = parents.orderBy("parent_id").limit(3)
    reach = index.blocks_in_reach(tree, some)
    assert reach.count() == tree.leaf.join(some, ["kv_head", "parent_id"]).count()
    folders = [r["block"] for r in tree.places.join(some, ["kv_head", "parent_id"]).select("block").distinct().collect()]
    assert len(folders) <= 3 < tree.n_blocks
    assert 0 < read(tree.blocks.filter(F.col("block").isin(folders))) < 0.4 * read(tree.blocks)
    text = reach._jdf.queryExecution().executedPlan().toString()
    assert any("block" in part.split("]")[0] for part in text.split("PartitionFilters: [")[1:])
    last = k.filter("key_id >= 300")
    grown = update.append_forest(tree, last)
    assert grown.n_blocks > tree.n_blocks and grown.blocks.count() == 400
    q, asks = asked(spark, 3, (4.0, 0.0), heads=1)
    same(found(search.tree_search(grown, q)), brute(rows, asks))
    full = index.laid_out(index.build(k.filter("key_id < 300"), 3, 8, balanced=True), block_keys=20)
    full = update.fill_slots(full, last)
    assert full.blocks.select("key_id").distinct().count() == full.blocks.count() == 400
    same(found(search.tree_search(full, q)), brute(rows, asks))
    assert search.probe(full, q, 2).count() == search.probe(index.Index(full.keys, full.leaf, full.nodes, 3, 8), q, 2).count()


def test_one_pass_answers_all_thresholds(spark):
    r = random.Random(2)
    rows = [("s" if i % 3 else "t", i % 5, i, r.choice((-1.0, 0.0, 0.5, r.gauss(0, 1)))) for i in range(400)]
    steps = [0.5, -1.0, 0.0, 3.5, 0.5]
    got = {(x["shape"], x["query_id"], x["threshold"]): (x["clusters"], x["hit"]) for x in shapes.sweep(spark.createDataFrame(rows, "shape string, query_id long, cluster_id long, bound double"), steps, ["shape"]).collect()}
    own = lambda s, q: [b for x, y, _, b in rows if (x, y) == (s, q)]
    assert got == {(s, q, t): (len(own(s, q)), sum(b >= t for b in own(s, q))) for s in "st" for q in range(5) for t in set(steps)}


def test_mixture_and_distances(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(-3, 0.5, 300), r.normal(2, 1.5, 700), [1.25] * 60])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    parts, loglik, n = metrics.mixture(df, 2, 8)
    w, m, s2 = np.array([0.5, 0.5]), v.min() + (v.max() - v.min()) * np.array([0.25, 0.75]), np.full(2, v.var())
    density = lambda: w / np.sqrt(2 * np.pi * s2) * np.exp(-((v[:, None] - m) ** 2) / (2 * s2))
    for _ in range(8):
        share = density() / density().sum(1, keepdims=True)
        w, m = share.mean(0), (share * v[:, None]).sum(0) / share.sum(0)
        s2 = (share * (v[:, None] - m) ** 2).sum(0) / share.sum(0)
    assert np.allclose(parts, np.c_[w, m, s2]) and n == len(v) and loglik == pytest.approx(np.log(density().sum(1)).sum())
    got = {x["name"]: x["ks"] for x in metrics.fit_distances(df, 2, 8).collect()}
    u = np.sort(v)
    phi = lambda z: 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    up, down = np.searchsorted(u, u, "right") / n, np.searchsorted(u, u, "left") / n
    for name, f in (("normal", phi((u - v.mean()) / v.std())), ("uniform", (u - u[0]) / (u[-1] - u[0])), ("mixture", sum(w[j] * phi((u - m[j]) / np.sqrt(s2[j])) for j in (0, 1)))):
        assert got[name] == pytest.approx(max((up - f).max(), (f - down).max()), abs=3e-7)
    with pytest.raises(ValueError):
        metrics.mixture(df.filter("v = 1.25"))


def test_enclosing_shapes_of_spread_clusters(spark):
    """Every member inside, the ball within a hundredth of the smallest; one cluster has most members, one is flat, one a point."""
    r = np.random.default_rng(7)
    sets = {0: r.normal(size=(3000, 3)) * [3, 1, 0.2], 1: r.normal(size=(40, 1)) * np.ones(3), 2: np.ones((5, 3)), 3: r.uniform(-1, 1, (200, 3)) + 9}
    members = spark.createDataFrame([(c, c * 10_000 + i, [float(v) for v in row]) for c, x in sets.items() for i, row in enumerate(x)], "cluster_id long, key_id long, key array<double>").repartition(4)
    balls = {x["cluster_id"]: x for x in shapes.exact_balls(members).collect()}
    bodies = {x["cluster_id"]: x for x in shapes.ellipsoids(members).collect()}
    assert set(balls) == set(bodies) == set(sets)
    for c, x in sets.items():
        far = np.sqrt(((x - np.array(balls[c]["center"])) ** 2).sum(1)).max()
        assert far <= balls[c]["radius"] + 1e-9 and balls[c]["radius"] <= 1.01 * shapes.smallest_ball(x, 20_000)[1] + 1e-9
        a, center = np.array(bodies[c]["inv_shape"]), np.array(bodies[c]["center"])
        d = x - center
        assert (np.einsum("ij,jk,ik->i", d, np.linalg.pinv(a), d) <= 1 + 1e-6).all()
        if c in (0, 3):
            _, best = shapes.covering_ellipsoid(x, 1e-7, 20_000)
            assert np.sqrt(np.linalg.det(a) / np.linalg.det(best)) < 1.1


def test_two_level_rates(spark):
    k, _ = data(spark, 50, 3)
    q, _ = asked(spark, 3, (1.0,))
    tree = index.build(k, 2, 5)
    for x in metrics.rates(tree, q).collect():
        assert x["parents_total"] == 10 and x["children_total"] == 50
        assert x["parent_rate"] == x["parents_passed"] / 10 and x["child_rate"] == x["children_scored"] / 50


def test_archives_are_read_and_written_by_parts(spark, tmp_path):
    from orbita.sources import npz

    x = np.random.default_rng(1).normal(size=(5000, 6)).astype(np.float32)
    np.savez(tmp_path / "plain.npz", keys=x, other=np.arange(3))
    np.savez_compressed(tmp_path / "packed.npz", keys=np.asfortranarray(x[:50]))
    np.savez(tmp_path / "wide.npz", keys=x[:40].astype(np.float64).reshape(2, 20, 6))
    for name, want, parts in (("plain", x, 6), ("packed", x[:50], 1), ("wide", x[:40], 1)):
        got = npz.read(spark, f"{tmp_path}/{name}.npz", part_bytes=1000 * 24)
        assert got.rdd.getNumPartitions() >= min(parts, 5)
        rows = sorted(got.collect(), key=lambda r: r["key_id"])
        assert [r["key_id"] for r in rows] == list(range(len(want))) and np.array_equal(np.array([r["key"] for r in rows], np.float32), want)
    keys = npz.read(spark, f"{tmp_path}/plain.npz", kv_head=2)
    (tmp_path / "out").mkdir()
    npz.write(keys.repartition(3), f"{tmp_path}/out", file_bytes=20_000)
    npz.write(keys.limit(10), f"{tmp_path}/out")
    back = npz.read(spark, f"{tmp_path}/out")
    assert back.count() == 5010 and back.select("key_id").distinct().count() == 5010
    total = lambda d: d.selectExpr("sum(aggregate(key, 0D, (s, v) -> s + v)) s").first()["s"]
    assert total(back) == pytest.approx(total(keys) + total(keys.limit(10)))
    (tmp_path / "out" / "part-stray.npz").write_bytes(b"left by a lost run")
    assert npz.read(spark, f"{tmp_path}/out").count() == 5010
    npz.write(keys.limit(7), f"{tmp_path}/out", "overwrite")
    assert npz.read(spark, f"{tmp_path}/out").count() == 7
    assert tables.npz_keys(spark, f"{tmp_path}/plain.npz").count() == 5000


def test_dimensions_are_checked_by_default(spark):
    k, _ = data(spark, 5, 3, heads=1)
    for bad, why in (([1.0, 2.0], "different dimensions"), ([1.0, None, 2.0], "numbers only"), ([1.0, float("nan"), 0.0], "numbers only")):
        q = search.queries(spark.createDataFrame([(0, 0, bad, 0.0)], QUERIES))
        for run in (lambda: search.flat_scan(k, q).collect(), lambda: search.all_scores(k, q).collect()):
            with pytest.raises(Exception, match=why):
                run()


def test_sampled_thresholds(spark):
    k, rows = data(spark, 60, 3)
    q, asks = asked(spark, 3, (0.0, 1.0))
    scores = {(i, h): sorted((sum(a * b for a, b in zip(v, x)) for g, _, x in rows if g == h), reverse=True) for i, h, v, _ in asks}
    for method, pick in (("topk", lambda s: s[4]), ("sample_max", lambda s: s[0]), ("sample_mean_topk", lambda s: sum(s[:5]) / 5)):
        got = {(r["query_id"], r["q_head"]): r["threshold"] for r in thresholds.sampled(Config(threshold_method=method), k, q, 5).collect()}
        assert got == pytest.approx({key: pick(s) for key, s in scores.items()})
        some = {(r["query_id"], r["q_head"]): r["threshold"] for r in thresholds.sampled(Config(threshold_method=method, sample_size=12), k, q, 5).collect()}
        assert all(scores[key][-1] <= t <= scores[key][0] + 1e-9 for key, t in some.items()) and len(some) == 4
    with pytest.raises(ValueError):
        Config(threshold_method="other")
