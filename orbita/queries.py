"""Registered queries of the search library and their SQL oracles.

Search queries are held against the brute-force predicate, whatever the tree;
structural ones against the same construction in SQL.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import thresholds, vec
from .operators import clustering, hull, index, metrics, search, shapes, update
from .plans import tables as cuts
from .sources import generators, tables
from .streaming.cache import Cache

HEADS, BF = 8, 4
ASKED = "vec_id % 50 = 0"  # the vectors that are queries
Q: dict = {}
SQL: dict[str, str] = {}


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _wide(spark, sf):
    return _embeddings(spark, sf).select(F.lit(0).alias("kv_head"), F.col("vec_id").alias("key_id"), F.col("embedding").alias("key"))


def _keys(spark, sf):
    return tables.heads(_embeddings(spark, sf), HEADS)


def _wide_queries(spark, sf, threshold=0.3, **how):
    return search.queries(_embeddings(spark, sf).filter(ASKED).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("q_head"), F.col("embedding").alias("q")), threshold, **how)


def _head_queries(spark, sf, threshold=0.15, q_heads=HEADS, mapping=None, **how):
    """Slices of the first vectors; several query heads may look at one kv head."""
    mapping = mapping or search.head_map(q_heads, HEADS)
    rows = _embeddings(spark, sf).filter(ASKED).select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(q_heads - 1))).alias("q_head"), "embedding")
    rows = rows.withColumn("kv_head", F.element_at(F.array(*map(F.lit, mapping)), F.col("q_head") + 1))
    return search.queries(rows.select("query_id", "q_head", "kv_head", F.slice("embedding", F.col("kv_head") * 8 + 1, 8).alias("q")), threshold, **how)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _shown(df: DataFrame) -> DataFrame:
    return _rounded(df.select("query_id", "q_head", "key_id", "score"), "score")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DOT = "list_inner_product({}, {})"
_K1 = "k1 AS (SELECT 0 AS kv_head, vec_id AS key_id, embedding::DOUBLE[] AS key FROM embeddings)"
_K8 = "k8 AS (SELECT h::INT AS kv_head, vec_id AS key_id, list_slice(embedding, h * 8 + 1, h * 8 + 8)::DOUBLE[] AS key FROM embeddings, range(8) t(h))"
_Q1 = f"q1 AS (SELECT vec_id AS query_id, 0 AS q_head, 0 AS kv_head, embedding::DOUBLE[] AS q FROM embeddings WHERE {ASKED})"


def _q8(q_heads: int = 8, kv: str = "h") -> str:
    return f"q8 AS (SELECT vec_id AS query_id, h::INT AS q_head, ({kv})::INT AS kv_head, list_slice(embedding, ({kv}) * 8 + 1, ({kv}) * 8 + 8)::DOUBLE[] AS q FROM embeddings, range({q_heads}) t(h) WHERE {ASKED})"


def _brute(q: str, k: str, threshold: str, score: str = "s", where: str = "true") -> str:
    return f"SELECT query_id, q_head, key_id, round({score}, 6) AS score FROM (SELECT query_id, q_head, key_id, {_DOT.format('q', 'key')} AS s FROM {q} JOIN {k} USING (kv_head)) WHERE s >= {threshold} AND {where}"


BRUTE1 = f"WITH {_K1}, {_Q1} {_brute('q1', 'k1', '0.3')}"
BRUTE8 = f"WITH {_K8}, {_q8()} {_brute('q8', 'k8', '0.15')}"


@query(BRUTE1)
def flat_scan(spark, sf):
    return _shown(search.flat_scan(_wide(spark, sf), _wide_queries(spark, sf)))


@query(BRUTE8)
def flat_scan_arrow(spark, sf):
    return _shown(search.flat_scan(_keys(spark, sf), _head_queries(spark, sf), arrow=True))


@query(f"WITH {_K1}, {_Q1} {_brute('q1', 'k1', '0.3', 's * (query_id + 0.5)')}")
def flat_scan_scaled(spark, sf):
    return _shown(search.flat_scan(_wide(spark, sf), _wide_queries(spark, sf, scaling=F.col("query_id") + 0.5)))


@query(f"WITH {_K1}, {_Q1} {_brute('q1', 'k1', '-1e9')}")
def all_scores(spark, sf):
    return _shown(search.all_scores(_wide(spark, sf), _wide_queries(spark, sf)))


@query(f"WITH {_K1}, {_Q1} SELECT query_id, q_head, key_id, CASE WHEN s >= 0.3 THEN round(s, 6) ELSE 0 END AS score FROM (SELECT query_id, q_head, key_id, {_DOT.format('q', 'key')} AS s FROM q1, k1)")
def dense_scores(spark, sf):
    k, q = _wide(spark, sf), _wide_queries(spark, sf)
    return _shown(search.dense(k, q, search.flat_scan(k, q)))


@query(BRUTE8)
def tree_search_2l(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 2, BF, arrow=True), _head_queries(spark, sf)))


@query(BRUTE8)
def tree_search_3l(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 3, BF, arrow=True), _head_queries(spark, sf)))


@query(BRUTE8)
def tree_search_multi(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 5, BF, iterations=1, arrow=True), _head_queries(spark, sf)))


@query(BRUTE8)
def tree_search_balanced(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 3, 8, balanced=True, arrow=True), _head_queries(spark, sf)))


@query(f"WITH {_K8}, {_q8(16, 'h // 2')} {_brute('q8', 'k8', '0.15')}")
def gqa_default(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 2, BF, arrow=True), _head_queries(spark, sf, q_heads=16)))


@query(f"WITH {_K8}, {_q8(4, '[1, 0, 1, 0][h + 1]')} {_brute('q8', 'k8', '0.15')}")
def gqa_explicit_map(spark, sf):
    return _shown(search.flat_scan(_keys(spark, sf), _head_queries(spark, sf, q_heads=4, mapping=search.head_map(4, HEADS, [1, 0, 1, 0]))))


@query(f"WITH {_K8}, {_q8()} {_brute('q8', 'k8', '0.1', where='key_id % 3 = 1')}")
def masked_exact_filter(spark, sf):
    k = _keys(spark, sf)
    return _shown(search.masked_filter(k, k.filter("key_id % 3 = 1").select("kv_head", "key_id"), _head_queries(spark, sf, 0.1)))


def _seeds(table: str, count: str, seed: int, name: str, by: str = "kv_head") -> str:
    return f"{name} AS (SELECT {by}, key_id AS node_id, key AS center FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || key_id), key_id) AS k FROM {table}) WHERE k <= {count})"


_D2 = "list_sum(list_transform(list_zip(key, center), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _near(points: str, centers: str, name: str, by: str = "kv_head") -> str:
    return f"{name} AS (SELECT {by}, key_id, arg_min(node_id, (d, node_id)) AS node_id, min(d) AS dist2 FROM (SELECT p.{by}, key_id, node_id, {_D2} AS d FROM {points} p JOIN {centers} c ON p.{by} = c.{by}) GROUP BY ALL)"


_TREE = f"{_K8}, {_seeds('k8', 'greatest(1, n // 4)', 8, 's1')}, {_near('k8', 's1', 'a1')}, r1 AS (SELECT kv_head, node_id, max(sqrt(dist2)) AS radius FROM a1 GROUP BY ALL), n1 AS (SELECT * FROM s1 JOIN r1 USING (kv_head, node_id))"
_TREE2 = f"{_TREE}, p1 AS (SELECT kv_head, node_id AS key_id, center AS key FROM n1), {_seeds('p1', 'greatest(1, n // 4)', 9, 's2')}, {_near('p1', 's2', 'a2')}, r2 AS (SELECT a2.kv_head, a2.node_id, max(sqrt(dist2) + radius) AS radius FROM a2 JOIN n1 ON n1.kv_head = a2.kv_head AND n1.node_id = a2.key_id GROUP BY ALL), n2 AS (SELECT * FROM s2 JOIN r2 USING (kv_head, node_id))"
_GATE = f"{_DOT.format('q', 'center')} + sqrt({_DOT.format('q', 'q')}) * radius"


@query(f"WITH {_TREE}, {_q8()}, act AS (SELECT query_id, q_head, kv_head, node_id, q FROM q8 JOIN n1 USING (kv_head) WHERE {_GATE} > 0.2) SELECT query_id, q_head, a1.key_id, round({_DOT.format('q', 'key')}, 6) AS score FROM act JOIN a1 USING (kv_head, node_id) JOIN k8 ON k8.kv_head = a1.kv_head AND k8.key_id = a1.key_id")
def scan_mode_2l(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 2, BF), _head_queries(spark, sf, 0.2), "scan"))


@query(
    f"WITH {_TREE2}, {_q8()}, act2 AS (SELECT query_id, q_head, kv_head, node_id, q FROM q8 JOIN n2 USING (kv_head) WHERE {_GATE} > 0.2), "
    f"act1 AS (SELECT query_id, q_head, a2.kv_head, a2.key_id AS node_id, q FROM act2 JOIN a2 USING (kv_head, node_id) JOIN n1 ON n1.kv_head = a2.kv_head AND n1.node_id = a2.key_id WHERE {_DOT.format('q', 'n1.center')} + sqrt({_DOT.format('q', 'q')}) * n1.radius > 0.2) "
    f"SELECT query_id, q_head, a1.key_id, round({_DOT.format('q', 'key')}, 6) AS score FROM act1 JOIN a1 USING (kv_head, node_id) JOIN k8 ON k8.kv_head = a1.kv_head AND k8.key_id = a1.key_id"
)
def scan_mode_3l(spark, sf):
    return _shown(search.tree_search(index.build(_keys(spark, sf), 3, BF), _head_queries(spark, sf, 0.2), "scan"))


def _scores(spark, sf):
    return thresholds.Pairs(_keys(spark, sf), _head_queries(spark, sf))


_S8 = f"{_K8}, {_q8()}, s AS (SELECT query_id, q_head, {_DOT.format('q', 'key')} AS score FROM q8 JOIN k8 USING (kv_head)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q_head ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY query_id, q_head) AS n FROM s)"
_BY = ["query_id", "q_head"]


def _threshold(df):
    return _rounded(df.select(*_BY, "threshold"), "threshold")


@query(f"WITH {_S8} SELECT query_id, q_head, round(score, 6) AS threshold FROM r WHERE k = 10")
def threshold_topk(spark, sf):
    return _threshold(thresholds.topk(_scores(spark, sf), _BY, 10))


@query(f"WITH {_S8} SELECT query_id, q_head, round(score, 6) AS threshold FROM r WHERE k = 11")
def threshold_nth(spark, sf):
    return _threshold(thresholds.nth(_scores(spark, sf), _BY, 10))


@query(f"WITH {_S8} SELECT query_id, q_head, round(quantile_cont(score, 0.75), 6) AS threshold FROM s GROUP BY ALL")
def threshold_quantile(spark, sf):
    return _threshold(thresholds.quantile(_scores(spark, sf), _BY, 0.75))


@query(f"WITH {_S8} SELECT query_id, q_head, round(score, 6) AS threshold FROM r WHERE k = CAST(floor((1 - 0.9::DOUBLE) * n) AS BIGINT) + 1")
def threshold_tau(spark, sf):
    return _threshold(thresholds.tau(_scores(spark, sf), _BY, 0.9))


@query(f"WITH {_S8} SELECT query_id, q_head, round(avg(score), 6) AS threshold FROM r WHERE k IN (n // 2, n // 2 + 1) GROUP BY ALL")
def threshold_midpoint(spark, sf):
    return _threshold(thresholds.midpoint(_scores(spark, sf), _BY))


@query(f"WITH {_S8} SELECT query_id, q_head, key_id, round(s, 6) AS score FROM (SELECT q8.query_id, q8.q_head, key_id, {_DOT.format('q', 'key')} AS s, t.score AS t FROM q8 JOIN k8 USING (kv_head) JOIN (SELECT * FROM r WHERE k = 10) t ON t.query_id = q8.query_id AND t.q_head = q8.q_head) WHERE s >= t")
def topk_search(spark, sf):
    k, q = _keys(spark, sf), _head_queries(spark, sf)
    t = thresholds.topk(thresholds.Pairs(k, q), _BY, 10)
    return _shown(search.tree_search(index.build(k, 3, BF, arrow=True), q.drop("threshold").join(t, _BY)))


@query(f"WITH {_TREE} SELECT kv_head, key_id, node_id, round(dist2, 6) AS dist2 FROM a1")
def nearest_assign(spark, sf):
    k = _keys(spark, sf)
    return _rounded(clustering.nearest_assign(k, clustering.seeds(k, lambda n: F.greatest(F.lit(1), F.floor(n / BF)), 8, ["kv_head"]), ["kv_head"]), "dist2")


@query(f"WITH {_TREE} SELECT kv_head, node_id, round(radius, 6) AS radius FROM n1")
def parent_radius(spark, sf):
    return _rounded(index.build(_keys(spark, sf), 2, BF).level(1).select("kv_head", "node_id", "radius"), "radius")


@query(f"WITH {_TREE2} SELECT kv_head, node_id, round(radius, 6) AS radius FROM n2")
def grandparent_radius(spark, sf):
    return _rounded(index.build(_keys(spark, sf), 3, BF).level(2).select("kv_head", "node_id", "radius"), "radius")


@query(
    f"WITH {_K8}, {_seeds('k8', 'ceil(n / 8)', 8, 's1')}, {_near('k8', 's1', 'a1')}, rk AS (SELECT *, row_number() OVER (PARTITION BY kv_head, node_id ORDER BY dist2, key_id) AS slot FROM a1), "
    "placed AS (SELECT * FROM rk WHERE slot <= 8), used AS (SELECT kv_head, node_id, max(slot) AS used FROM placed GROUP BY ALL), "
    "free AS (SELECT kv_head, node_id, slot, row_number() OVER (PARTITION BY kv_head ORDER BY node_id, slot) AS k FROM (SELECT kv_head, node_id, unnest(range(coalesce(used, 0) + 1, 9)) AS slot FROM s1 LEFT JOIN used USING (kv_head, node_id))), "
    "l AS (SELECT kv_head, key_id, row_number() OVER (PARTITION BY kv_head ORDER BY md5('9:' || key_id), key_id) AS k FROM rk WHERE slot > 8) "
    "SELECT kv_head, key_id, node_id FROM placed UNION ALL SELECT l.kv_head, key_id, node_id FROM l JOIN free ON l.kv_head = free.kv_head AND l.k = free.k"
)
def balanced_children(spark, sf):
    k = _keys(spark, sf)
    centers = clustering.seeds(k, lambda n: F.ceil(n / 8), 8, ["kv_head"])
    return clustering.balanced_assign(k, centers, 8, 8, ["kv_head"]).select("kv_head", "key_id", "node_id")


@query(
    f"WITH {_TREE}, m AS (SELECT a1.kv_head, node_id, i, avg(key[i]) AS x FROM a1 JOIN k8 ON k8.kv_head = a1.kv_head AND k8.key_id = a1.key_id, range(1, 9) t(i) GROUP BY ALL) SELECT kv_head, node_id, round(x, 6) AS x, i::INT AS i FROM m"
)
def lloyd_1iter(spark, sf):
    k = _keys(spark, sf)
    first = clustering.seeds(k, lambda n: F.greatest(F.lit(1), F.floor(n / BF)), 8, ["kv_head"])
    got = clustering.lloyd(k, first, 1, ["kv_head"]).select("kv_head", "node_id", F.posexplode("center").alias("i", "x"))
    return _rounded(got.withColumn("i", F.col("i") + 1), "x")


@query()
def greedy_children(spark, sf):
    k = _keys(spark, sf)
    return clustering.greedy_capacity(k, clustering.seeds(k, lambda n: F.ceil(n / 8), 8, ["kv_head"]), 8, ["kv_head"])


def _split(spark, sf):
    k = _keys(spark, sf)
    return k.filter("key_id % 10 < 7"), k.filter("key_id % 10 >= 7")


@query(BRUTE8)
def update_append_search(spark, sf):
    base, new = _split(spark, sf)
    return _shown(search.tree_search(update.append_forest(index.build(base, 3, BF, arrow=True), new, arrow=True), _head_queries(spark, sf)))


@query(BRUTE8)
def update_fill_search(spark, sf):
    base, new = _split(spark, sf)
    return _shown(search.tree_search(update.fill_slots(index.build(base, 3, 8, balanced=True, arrow=True), new, arrow=True), _head_queries(spark, sf)))


@query(
    f"WITH {_K8}, b AS (SELECT * FROM k8 WHERE key_id % 10 < 7), nw AS (SELECT * FROM k8 WHERE key_id % 10 >= 7), {_seeds('b', 'ceil(n / 8)', 8, 's1')}, {_near('b', 's1', 'a1')}, {_near('nw', 's1', 'a2')}, "
    "c AS (SELECT kv_head, node_id, least(8, count(*)) AS first FROM a1 GROUP BY ALL), m AS (SELECT kv_head, count(*) AS n FROM b GROUP BY ALL), "
    "cap AS (SELECT s1.kv_head, node_id, coalesce(first, 0) AS first, 8 - coalesce(first, 0) AS room FROM s1 LEFT JOIN c USING (kv_head, node_id)), "
    "run AS (SELECT *, sum(room) OVER (PARTITION BY kv_head ORDER BY node_id) AS upto, n - sum(first) OVER (PARTITION BY kv_head) AS spare FROM cap JOIN m USING (kv_head)), "
    "held AS (SELECT kv_head, node_id, first + greatest(0, least(room, spare - (upto - room))) AS held FROM run), "
    "want AS (SELECT kv_head, node_id, count(*) AS want FROM a2 GROUP BY ALL) "
    "SELECT kv_head, CAST(sum(least(want, 8 - held)) AS BIGINT) AS placed, CAST(sum(want - least(want, 8 - held)) AS BIGINT) AS orphans FROM want JOIN held USING (kv_head, node_id) GROUP BY ALL"
)
def slot_fill_counts(spark, sf):
    base, new = _split(spark, sf)
    old = index.build(base, 2, 8, balanced=True)
    counts = old.leaf.groupBy("kv_head", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("held"))
    got = update.place(new, old.level(1), counts, 8)
    return got.groupBy("kv_head").agg(F.count("node_id").alias("placed"), F.sum(F.col("node_id").isNull().cast("long")).alias("orphans"))


def _flat_queries(spark, sf, threshold):
    q = _head_queries(spark, sf, threshold)
    return q.withColumn("query_id", F.col("query_id") * HEADS + F.col("q_head")).withColumn("q_head", F.lit(0))


def _flat_keys(spark, sf):
    """The slices of all heads, as one set of vectors."""
    return _keys(spark, sf).select((F.col("key_id") * HEADS + F.col("kv_head")).alias("key_id"), "key")


def _pct(spark, sf, kind, clusters, threshold=0.1):
    members, centers = clusters
    return _rounded(shapes.intersecting(kind, shapes.MAKE[kind](members, centers), _flat_queries(spark, sf, threshold)), "pct")


_FLAT = f"{_K8}, f AS (SELECT 0 AS one, key_id * 8 + kv_head AS key_id, key FROM k8), {_seeds('f', '100', 42, 'c', 'one')}, {_near('f', 'c', 'm', 'one')}, mm AS (SELECT f.key_id, key, node_id AS cluster_id FROM m JOIN f USING (key_id)), {_q8()}, q AS (SELECT query_id * 8 + q_head AS query_id, q FROM q8)"
_PCT = "SELECT query_id, count(*) AS clusters, CAST(sum(CASE WHEN bound >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS hit, round(100.0::DOUBLE * sum(CASE WHEN bound >= 0.1 THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM b GROUP BY ALL"
_BOX = "x AS (SELECT cluster_id, i, min(key[i]) AS lo, max(key[i]) AS hi FROM mm, range(1, 9) t(i) GROUP BY ALL), b AS (SELECT query_id, cluster_id, sum(CASE WHEN q[i] >= 0 THEN hi ELSE lo END * q[i]) AS bound FROM x, q GROUP BY ALL)"
_HULL = f"b AS (SELECT query_id, cluster_id, max({_DOT.format('q', 'key')}) AS bound FROM mm, q GROUP BY ALL)"


@query(f"WITH {_FLAT}, r AS (SELECT node_id, max(sqrt(dist2)) AS radius FROM m GROUP BY ALL), b AS (SELECT query_id, {_DOT.format('q', 'center')} + sqrt({_DOT.format('q', 'q')}) * radius AS bound FROM c JOIN r USING (node_id), q) {_PCT}")
def random_ball_pct(spark, sf):
    return _pct(spark, sf, "ball", shapes.random_clusters(_flat_keys(spark, sf)))


@query(f"WITH {_FLAT}, {_BOX} {_PCT}")
def random_box_pct(spark, sf):
    return _pct(spark, sf, "box", shapes.random_clusters(_flat_keys(spark, sf)))


@query(f"WITH {_FLAT}, {_BOX}, p AS ({_PCT}) SELECT count(*) AS queries, round(avg(pct), 6) AS mean, round(stddev_pop(pct), 6) AS std, min(pct) AS low, max(pct) AS high FROM p")
def random_box_summary(spark, sf):
    members, centers = shapes.random_clusters(_flat_keys(spark, sf))
    return _rounded(shapes.summary(_pct(spark, sf, "box", (members, centers))), "mean", "std")


@query(f"WITH {_FLAT}, {_HULL} {_PCT}")
def random_hull_pct(spark, sf):
    return _pct(spark, sf, "hull", shapes.random_clusters(_flat_keys(spark, sf)))


for _kind in ("exact_ball", "ellipsoid"):
    Q[f"random_{_kind}_pct"] = lambda spark, sf, k=_kind: _pct(spark, sf, k, shapes.random_clusters(_flat_keys(spark, sf)))
for _kind in ("ball", "box", "hull", "ellipsoid"):
    Q[f"kmeans_{_kind}_pct"] = lambda spark, sf, k=_kind: _pct(spark, sf, k, shapes.kmeans_clusters(_flat_keys(spark, sf), 100, 5))


def _means(points: str, near: str, name: str, by: str) -> str:
    return f"{name} AS (SELECT {by}, node_id, list(x ORDER BY i) AS center FROM (SELECT {near}.{by}, node_id, i, avg(key[i]) AS x FROM {near} JOIN {points} USING ({by}, key_id), range(1, 9) t(i) GROUP BY ALL) GROUP BY ALL)"


_ROUNDS = ", ".join(f"{_near('f', f'c{i}', f'm{i}', 'one')}, {_means('f', f'm{i}', f'c{i + 1}', 'one')}" for i in range(5))
_KMEANS = f"{_K8}, f AS (SELECT 0 AS one, key_id * 8 + kv_head AS key_id, key FROM k8), {_seeds('f', '100', 42, 'c0', 'one')}, {_ROUNDS}, c AS (SELECT * FROM c5), {_near('f', 'c', 'm', 'one')}, mm AS (SELECT f.key_id, key, node_id AS cluster_id FROM m JOIN f USING (key_id)), {_q8()}, q AS (SELECT query_id * 8 + q_head AS query_id, q FROM q8)"
_BALL = f"r AS (SELECT node_id, max(sqrt(dist2)) AS radius FROM m GROUP BY ALL), b AS (SELECT query_id, node_id AS cluster_id, {_DOT.format('q', 'center')} + sqrt({_DOT.format('q', 'q')}) * radius AS bound FROM c JOIN r USING (node_id), q)"
SQL |= {f"kmeans_{kind}_pct": f"WITH {_KMEANS}, {made} {_PCT}" for kind, made in (("ball", _BALL), ("box", _BOX), ("hull", _HULL))}

SWEEP = [-0.1, 0.0, 0.05, 0.1, 0.2, 0.4]
_UNIT = f"list_transform(key, lambda x: x / greatest(sqrt({_DOT.format('key', 'key')}), 1e-12))"
_SWEPT = " UNION ALL ".join(f"(WITH {_FLAT.replace('AS key_id, key FROM k8', f'AS key_id, {_UNIT} AS key FROM k8') if data == 'unit' else _FLAT}, {made} SELECT '{kind}' AS shape, '{data}' AS data, query_id, cluster_id, bound FROM b)" for data in ("raw", "unit") for kind, made in (("ball", _BALL), ("box", _BOX), ("hull", _HULL)))


@query(
    f"WITH bounds AS ({_SWEPT}), p AS (SELECT shape, data, query_id, t AS threshold, 100.0::DOUBLE * sum((bound >= t)::INT) / count(*) AS pct FROM bounds, (SELECT unnest({SWEEP})::DOUBLE AS t) GROUP BY ALL) "
    "SELECT shape, data, threshold, count(*) AS queries, round(avg(pct), 6) AS mean, round(stddev_pop(pct), 6) AS std, round(min(pct), 6) AS low, round(max(pct), 6) AS high FROM p GROUP BY ALL"
)
def threshold_sweep(spark, sf):
    """Shapes, thresholds and two distributions of keys: shares of clusters that a query can't exclude."""
    q, found = _flat_queries(spark, sf, 0.0), []
    for data in ("raw", "unit"):
        keys = _flat_keys(spark, sf)
        members, centers = shapes.random_clusters(keys.withColumn("key", vec.normalized("key")) if data == "unit" else keys)
        found += [shapes.bounds(kind, shapes.MAKE[kind](members, centers), q).select(F.lit(kind).alias("shape"), F.lit(data).alias("data"), "query_id", "cluster_id", "bound") for kind in ("ball", "box", "hull")]
    pct = shapes.sweep(reduce(DataFrame.unionByName, found), SWEEP, ["shape", "data"])
    return _rounded(shapes.summary(pct, ["shape", "data", "threshold"]), "mean", "std", "low", "high")


_PARTS = "f AS (SELECT key_id * 8 + kv_head AS key_id, key FROM k8), parts AS (SELECT s::INT AS sub, key_id, list_slice(key, s * 2 + 1, s * 2 + 2) AS key FROM f, range(4) t(s))"
_PQ = (
    f"{_K8}, {_PARTS}, {_seeds('parts', '8', 42, 'w', 'sub')}, "
    "book AS (SELECT sub, row_number() OVER (PARTITION BY sub ORDER BY md5('42:' || node_id), node_id) - 1 AS node_id, center FROM w), "
    f"{_near('parts', 'book', 'e', 'sub')}, codes AS (SELECT key_id, list(node_id ORDER BY sub) AS codes FROM e GROUP BY ALL), ids AS (SELECT codes, min(key_id) AS cluster_id FROM codes GROUP BY ALL), mm AS (SELECT key_id, key, cluster_id FROM codes JOIN ids USING (codes) JOIN f USING (key_id)), {_q8()}, q AS (SELECT query_id * 8 + q_head AS query_id, q FROM q8)"
)


@query(f"WITH {_PQ} SELECT sub, node_id::INT AS code, count(*) AS n FROM e GROUP BY ALL")
def pq_codes_hist(spark, sf):
    k = _flat_keys(spark, sf)
    codes = clustering.pq_encode(k, clustering.pq_train(k, 4, 3), 4)
    return codes.select(F.posexplode("codes").alias("sub", "code")).groupBy("sub", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PQ}, u AS (SELECT sub, node_id, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT book.sub, coalesce(n, 0) AS n FROM book LEFT JOIN u USING (sub, node_id)) SELECT sub, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS low, max(n) AS high, CAST(sum((n = 0)::INT) AS BIGINT) AS empty FROM z GROUP BY ALL")
def pq_cluster_sizes(spark, sf):
    k = _flat_keys(spark, sf)
    book = clustering.pq_train(k, 4, 3)
    uses = clustering.pq_encode(k, book, 4).select(F.posexplode("codes").alias("sub", "code"))
    return _rounded(metrics.cluster_sizes(uses, book), "mean", "std")


@query(
    f"WITH {_PQ}, ce AS (SELECT cluster_id, list(x ORDER BY i) AS center FROM (SELECT cluster_id, i, avg(key[i]) AS x FROM mm, range(1, 9) t(i) GROUP BY ALL) GROUP BY ALL), r AS (SELECT cluster_id, center, max(sqrt({_D2})) AS radius FROM mm JOIN ce USING (cluster_id) GROUP BY ALL), b AS (SELECT query_id, {_DOT.format('q', 'center')} + sqrt({_DOT.format('q', 'q')}) * radius AS bound FROM r, q) {_PCT}"
)
def pq_ball_pct(spark, sf):
    return _pct(spark, sf, "ball", shapes.pq_clusters(_flat_keys(spark, sf), 4, 3))


@query(f"WITH {_PQ}, {_BOX} {_PCT}")
def pq_box_pct(spark, sf):
    return _pct(spark, sf, "box", shapes.pq_clusters(_flat_keys(spark, sf), 4, 3))


@query(f"WITH {_PQ}, {_HULL} {_PCT}")
def pq_hull_pct(spark, sf):
    return _pct(spark, sf, "hull", shapes.pq_clusters(_flat_keys(spark, sf), 4, 3))


@query(f"WITH {_FLAT}, r AS (SELECT node_id, max(sqrt(dist2)) AS radius FROM m GROUP BY ALL), d AS (SELECT query_id, {_DOT.format('q', 'center')} - 0.1 AS d, radius FROM c JOIN r USING (node_id), q) SELECT query_id, CASE WHEN d >= radius THEN 'inside' WHEN d <= -radius THEN 'outside' ELSE 'crossing' END AS side, count(*) AS balls FROM d GROUP BY ALL")
def ball_class(spark, sf):
    return metrics.ball_classes(shapes.balls(*shapes.random_clusters(_flat_keys(spark, sf))), _flat_queries(spark, sf, 0.1))


@query(f"WITH {_K8}, {_q8()}, q AS (SELECT query_id * 8 + q_head AS query_id, q FROM q8), f AS (SELECT key_id * 8 + kv_head AS key_id, key FROM k8), d AS (SELECT query_id, {_D2.replace('center', 'q')} AS d, key_id FROM q, f) SELECT query_id, round(sqrt(d), 6) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, key_id) AS k FROM d) WHERE k = 6")
def knn_radius(spark, sf):
    return _rounded(metrics.knn_radius(_flat_keys(spark, sf), _flat_queries(spark, sf, 0.1), 5), "radius")


_ACT = f"{_TREE}, {_q8()}, act AS (SELECT query_id, q_head, kv_head, node_id FROM q8 JOIN n1 USING (kv_head) WHERE {_GATE} > 0.2)"


@query(
    f"WITH {_ACT}, k AS (SELECT query_id, q_head, count(*) AS active FROM act GROUP BY ALL), z AS (SELECT query_id, q_head, count(*) AS active FROM act JOIN a1 USING (kv_head, node_id) GROUP BY ALL), t1 AS (SELECT kv_head, count(*) AS total FROM n1 GROUP BY ALL), t0 AS (SELECT kv_head, count(*) AS total FROM k8 GROUP BY ALL) "
    "SELECT query_id, q_head, 1 AS level, total, coalesce(active, 0) AS active FROM q8 JOIN t1 USING (kv_head) LEFT JOIN k USING (query_id, q_head) UNION ALL SELECT query_id, q_head, 0, total, coalesce(active, 0) FROM q8 JOIN t0 USING (kv_head) LEFT JOIN z USING (query_id, q_head)"
)
def traversal_stats(spark, sf):
    return metrics.traversal(index.build(_keys(spark, sf), 2, BF), _head_queries(spark, sf, 0.2), "scan")


@query(
    f"WITH {_ACT}, k AS (SELECT query_id, q_head, count(*) AS active FROM act GROUP BY ALL), z AS (SELECT query_id, q_head, count(*) AS active FROM act JOIN a1 USING (kv_head, node_id) GROUP BY ALL), t1 AS (SELECT kv_head, count(*) AS total FROM n1 GROUP BY ALL), t0 AS (SELECT kv_head, count(*) AS total FROM k8 GROUP BY ALL) "
    "SELECT query_id, q_head, t1.total AS parents_total, coalesce(k.active, 0) AS parents_passed, round(coalesce(k.active, 0) / t1.total, 6) AS parent_rate, t0.total AS children_total, coalesce(z.active, 0) AS children_scored, round(coalesce(z.active, 0) / t0.total, 6) AS child_rate FROM q8 JOIN t1 USING (kv_head) JOIN t0 USING (kv_head) LEFT JOIN k USING (query_id, q_head) LEFT JOIN z USING (query_id, q_head)"
)
def two_level_rates(spark, sf):
    return _rounded(metrics.rates(index.build(_keys(spark, sf), 2, BF), _head_queries(spark, sf, 0.2), "scan"), "parent_rate", "child_rate")


@query(f"WITH {_ACT}, z AS (SELECT query_id, q_head, count(*) AS active FROM act JOIN a1 USING (kv_head, node_id) GROUP BY ALL) SELECT query_id, q_head, round(coalesce(active, 0) / (SELECT count(*) FROM embeddings), 6) AS fraction FROM q8 LEFT JOIN z USING (query_id, q_head)")
def scanned_fraction(spark, sf):
    return _rounded(metrics.scanned_fraction(index.build(_keys(spark, sf), 2, BF), _head_queries(spark, sf, 0.2), "scan"), "fraction")


@query(f"WITH {_K8}, {_q8()}, s AS (SELECT query_id, q_head, {_DOT.format('q', 'key')} AS s FROM q8 JOIN k8 USING (kv_head)) SELECT DISTINCT query_id, q_head, 1.0::DOUBLE AS recall FROM s WHERE s >= 0.15")
def search_recall(spark, sf):
    k, q = _keys(spark, sf), _head_queries(spark, sf)
    return metrics.recall(search.flat_scan(k, q), search.tree_search(index.build(k, 3, BF, arrow=True), q))


@query(
    "WITH v AS (SELECT i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT i, avg(v) AS mu FROM v GROUP BY i), p AS (SELECT i, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 3) AS m3, avg((v - mu) ** 4) AS m4 FROM v JOIN m USING (i) GROUP BY i) "
    "SELECT (i - 1)::INT AS dim, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, round(median(v), 6) AS median, round(any_value(m3 / m2 ** 1.5), 6) AS skew, round(any_value(m4 / m2 ** 2 - 3), 6) AS kurt FROM v JOIN p USING (i) GROUP BY i"
)
def vector_moments(spark, sf):
    return _rounded(metrics.moments(_wide(spark, sf)), "mean", "std", "low", "high", "median", "skew", "kurt")


@query(f"WITH {_K8}, n AS (SELECT kv_head, sqrt({_DOT.format('key', 'key')}) AS n FROM k8) SELECT kv_head, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(min(n), 6) AS low, round(max(n), 6) AS high FROM n GROUP BY ALL")
def norm_stats(spark, sf):
    return _rounded(metrics.norm_stats(_keys(spark, sf), ["kv_head"]), "mean", "std", "low", "high")


@query("WITH v AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT count(*) AS n, avg(v) AS mu, var_pop(v) AS var, min(v) AS lo, max(v) AS hi FROM v), f AS (SELECT 'normal' AS name, mu AS a, sqrt(var) AS b, -n / 2.0::DOUBLE * (ln(2 * pi() * var) + 1) AS loglik, n FROM s UNION ALL SELECT 'uniform', lo, hi, -n * ln(hi - lo), n FROM s) SELECT name, round(a, 6) AS a, round(b, 6) AS b, round(loglik, 4) AS loglik, round(4 - 2 * loglik, 4) AS aic, round(2 * ln(n) - 2 * loglik, 4) AS bic FROM f")
def distribution_fits(spark, sf):
    got = metrics.normal_fit(_values(spark, sf))
    return got.select("name", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), *(F.round(c, 4).alias(c) for c in ("loglik", "aic", "bic")))


_V = "v AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT count(*) AS n, avg(v) AS mu, stddev_pop(v) AS std, var_pop(v) AS var, min(v) AS lo, max(v) AS hi FROM v)"


def _em(rounds: int) -> str:
    """Two components; a CTE a round: parameters, then shares of each value."""
    steps = ["p0 AS (SELECT 0.5::DOUBLE AS w0, lo + 0.25 * (hi - lo) AS m0, var AS v0, 0.5::DOUBLE AS w1, lo + 0.75 * (hi - lo) AS m1, var AS v1 FROM s)"]
    log = lambda j: f"ln(w{j}) - 0.5 * (ln(2 * pi() * v{j}) + (v - m{j}) ** 2 / v{j})"
    for t in range(rounds):
        steps.append(f"r{t} AS (SELECT v, p{t}.*, 1 / (1 + exp(({log(1)}) - ({log(0)}))) AS r FROM v, p{t})")
        sums = ", ".join(f"any_value(m{j}) AS o{j}, sum({r}) AS n{j}, sum({r} * (v - m{j})) AS f{j}, sum({r} * (v - m{j}) ** 2) AS q{j}" for j, r in ((0, "r"), (1, "(1 - r)")))
        steps.append(f"p{t + 1} AS (SELECT " + ", ".join(f"n{j} / (n0 + n1) AS w{j}, o{j} + f{j} / n{j} AS m{j}, q{j} / n{j} - (f{j} / n{j}) ** 2 AS v{j}" for j in (0, 1)) + f" FROM (SELECT {sums} FROM r{t}))")
    steps.append(f"e AS (SELECT p{rounds}.*, sum(ln(exp({log(0)}) + exp({log(1)}))) AS loglik FROM v, p{rounds} GROUP BY ALL)")
    return ", ".join(steps)


@query(
    f"WITH {_V}, {_em(10)} SELECT j::INT AS part, round(CASE j WHEN 0 THEN w0 ELSE w1 END, 5) AS weight, round(CASE j WHEN 0 THEN m0 ELSE m1 END, 5) AS mean, round(sqrt(CASE j WHEN 0 THEN v0 ELSE v1 END), 5) AS std, round(loglik, 3) AS loglik, round(10 - 2 * loglik, 3) AS aic, round(5 * ln(n) - 2 * loglik, 3) AS bic FROM e, s, range(2) t(j)"
)
def mixture_fit(spark, sf):
    """Two normals over all components of all vectors, ten rounds of EM."""
    got = metrics.mixture_fit(_values(spark, sf), 2, 10)
    return got.select("part", *(F.round(c, 5).alias(c) for c in ("weight", "mean", "std")), *(F.round(c, 3).alias(c) for c in ("loglik", "aic", "bic")))


def _phi(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    tail = f"exp(-(({z}) ** 2) / 2) / sqrt(2 * pi()) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query(
    f"WITH {_V}, {_em(10)}, d AS (SELECT v, count(*) AS c FROM v GROUP BY v), k AS (SELECT v, c, sum(c) OVER (ORDER BY v) AS upto FROM d), "
    f"f AS (SELECT upto / n AS high, (upto - c) / n AS low, {_phi('((v - mu) / std)')} AS normal, (v - lo) / (hi - lo) AS uniform, w0 * ({_phi('((v - m0) / sqrt(v0))')}) + w1 * ({_phi('((v - m1) / sqrt(v1))')}) AS mixture FROM k, s, e) "
    + " UNION ALL ".join(f"SELECT '{x}' AS name, round(max(greatest(high - {x}, {x} - low)), 6) AS ks FROM f" for x in ("normal", "uniform", "mixture"))
)
def fit_distances(spark, sf):
    """Kolmogorov-Smirnov distances of the fits."""
    return _rounded(metrics.fit_distances(_values(spark, sf), 2, 10), "ks")


def _values(spark, sf):
    return _wide(spark, sf).select(F.explode("key").alias("v")).select(F.col("v").cast("double").alias("v"))


@query(f"WITH {_K8}, n AS (SELECT kv_head, key_id, list_transform(key, lambda x: x / greatest(sqrt({_DOT.format('key', 'key')}), 1e-12)) AS u FROM k8) SELECT kv_head, key_id, round({_DOT.format('u', 'u')}, 6) AS length FROM n")
def normalized_keys(spark, sf):
    return _keys(spark, sf).select("kv_head", "key_id", F.round(vec.dot(vec.normalized("key"), vec.normalized("key")), 6).alias("length"))


@query(f"WITH {_TREE}, c AS (SELECT kv_head, node_id, count(*) AS n FROM a1 GROUP BY ALL) SELECT kv_head, node_id, n, CAST(sum(n) OVER (PARTITION BY kv_head ORDER BY node_id) - n AS BIGINT) AS \"offset\" FROM c")
def child_offsets(spark, sf):
    leaf = index.build(_keys(spark, sf), 2, BF).leaf
    return metrics.offsets(leaf.groupBy("kv_head", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")), "kv_head", "node_id", "n")


@query(
    f"WITH {_TREE}, {_q8()}, b AS (SELECT query_id, q_head, kv_head, node_id, q, row_number() OVER (PARTITION BY query_id, q_head ORDER BY {_GATE} DESC, node_id) AS k FROM q8 JOIN n1 USING (kv_head)) SELECT query_id, q_head, a1.key_id, round({_DOT.format('q', 'key')}, 6) AS score FROM b JOIN a1 USING (kv_head, node_id) JOIN k8 ON k8.kv_head = a1.kv_head AND k8.key_id = a1.key_id WHERE k <= 3"
)
def probe_parents(spark, sf):
    return _shown(search.probe(index.build(_keys(spark, sf), 2, BF), _head_queries(spark, sf), 3))


@query("SELECT l_returnflag AS flag, arg_min(l_linenumber, (cost, l_linenumber)) AS line, round(min(cost), 4) AS cost FROM (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS cost FROM lineitem GROUP BY ALL) GROUP BY ALL")
def best_choice(spark, sf):
    costs = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line")).agg(F.avg("l_extendedprice").alias("cost"))
    return metrics.best_by(costs, "flag", "line", "cost").select("flag", "line", F.round("cost", 4).alias("cost"))


@query(BRUTE8)
def cache_flush_search(spark, sf):
    """Four batches; the last stays queued."""
    cache, k = Cache(Config(update_every=1, num_levels=3, branching_factor=BF, max_iterations=0), 1, arrow=True), _keys(spark, sf)
    for i, part in enumerate(("key_id % 4 < 2", "key_id % 4 = 2")):
        cache.update(k.filter(part), 0, i)
    layer = cache.layers[0]
    layer.config = Config(update_every=1 << 40, num_levels=3, branching_factor=BF, max_iterations=0)
    cache.update(k.filter("key_id % 4 = 3"), 0, 2)
    cache.update(k.filter("key_id % 4 = 3"), 0, 2)  # delivered twice, taken once
    return _shown(cache.search(_head_queries(spark, sf), 0))


@query(BRUTE8)
def cache_reopened_search(spark, sf):
    """State in a folder: half is taken by one cache, the rest by another that finds what the first left."""
    config = Config(update_every=1, num_levels=2, branching_factor=BF, max_iterations=0)
    k, folder = _keys(spark, sf), f"{cuts.folder(spark)}/orbita-tables/state-{uuid.uuid4().hex}"
    Cache(config, 1, arrow=True, folder=folder).update(k.filter("key_id % 2 = 0"), 0, 0)
    again = Cache(config, 1, arrow=True, folder=folder)
    for batch, part in ((0, "key_id % 2 = 0"), (1, "key_id % 4 = 1"), (2, "key_id % 4 = 3")):
        again.update(k.filter(part), 0, batch)
    return _shown(again.search(_head_queries(spark, sf), 0))


@query(BRUTE8)
def leaf_block_search(spark, sf):
    return _shown(search.tree_search(index.laid_out(index.build(_keys(spark, sf), 3, BF, arrow=True), block_keys=512), _head_queries(spark, sf)))


@query(f"SELECT conv_id, turn, CASE WHEN trim(text, '{tables.SPACES}') != '' THEN trim(text, '{tables.SPACES}') ELSE trim(role, '{tables.SPACES}') END AS prompt FROM conversations WHERE trim(coalesce(text, ''), '{tables.SPACES}') != '' OR trim(coalesce(role, ''), '{tables.SPACES}') != ''")
def prompt_pick(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.select("conv_id", "turn", tables.prompt(F.col("text"), F.col("role")).alias("prompt")).filter("prompt is not null")


@query("SELECT key_id FROM (SELECT vec_id AS key_id, row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id) AS k FROM embeddings) WHERE k <= 100")
def row_sample(spark, sf):
    return tables.sample(_wide(spark, sf), 100, 3).select("key_id")


@query("SELECT l_returnflag AS flag, count(*) AS hits FROM lineitem WHERE (l_quantity / 50) * 0.5 + (l_extendedprice / 105000) * 0.5 + (l_discount / 0.1) * 0.5 + (l_tax / 0.08) * 0.5 >= 1.5 GROUP BY ALL")
def lineitem_halfspace(spark, sf):
    """A half-space over four columns: by the same scan, with columns as vector."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    key = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000, F.col("l_discount") / 0.1, F.col("l_tax") / 0.08)
    keys = rows.select(F.lit(0).alias("kv_head"), "l_returnflag", key.alias("key"))
    return keys.filter(vec.dot("key", F.array(*[F.lit(0.5)] * 4)) >= 1.5).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("hits"))


@query()
def hull_fraction(spark, sf):
    """Share of the vectors that are hull vertices, in their first 2, 3, 4 and 6 dimensions."""
    e = _embeddings(spark, sf)
    return reduce(DataFrame.unionByName, (hull.vertex_fraction(e.select(F.slice("embedding", 1, d).alias("key"))).withColumn("dim", F.lit(d)) for d in (2, 3, 4, 6)))


@query("SELECT vec_id AS key_id, concat_ws('-', vec_id % 8, (vec_id // 8) % 8, (vec_id // 64) % 8) AS codes FROM embeddings")
def bit_unpack(spark, sf):
    """Three fields of three bits in the two low bytes of an id."""
    code = F.array((F.col("vec_id") % 256).cast("int"), (F.floor(F.col("vec_id") / 256) % 256).cast("int"))
    return _embeddings(spark, sf).select(F.col("vec_id").alias("key_id"), F.array_join(vec.unpacked(code, 3, 3), "-").alias("codes"))


def _generated(make):
    def run(spark, sf):
        return make(spark).groupBy("kv_head").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vec.norm("key")), 6).alias("norm"))

    return run


for _name, _make in {
    "gaussian": lambda s: generators.gaussian(s, 2000, 16), "cube": lambda s: generators.cube(s, 2000, 16), "sphere": lambda s: generators.sphere(s, 2000, 16), "anisotropic": lambda s: generators.anisotropic(s, 2000, 16), "mixture": lambda s: generators.mixture(s, 2000, 16),
    "zipf_clusters": lambda s: generators.zipf_clusters(s, 2000, 16), "zipf_scaled": lambda s: generators.zipf_scaled(s, 2000, 16), "low_rank": lambda s: generators.low_rank(s, 2000, 16),
}.items():
    Q[f"generate_{_name}"] = _generated(_make)
