"""Operators that SQL doesn't express, or not whole, against brute force on small clouds."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from splatframe.operators import densify, ranks, scene, spatial
from splatframe.plans import views
from splatframe.plans.governance import SplatError
from splatframe.sources import glb

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)


def cloud(spark, p, ids=None):
    ids = np.arange(len(p)) if ids is None else ids
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, p)], "splat_id long, x double, y double, z double")


def brute_nearest(ids, p, k):
    out = {}
    for i in range(len(p)):
        e = p[i] - p
        d = np.sqrt(e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2])
        d[i] = np.inf
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d))[: min(k, len(p) - 1)]]
    return out


def clouds():
    far = RNG.normal(0, 1, (1200, 3))
    far[0], far[1] = [1e7, 0, 0], [1e7, 1e7, -1e7]
    dense = np.concatenate([RNG.normal(0, 1e-4, (700, 3)), RNG.uniform(-5, 5, (300, 3)), np.zeros((700, 3))])
    flat = np.round(RNG.uniform(0, 1, (900, 3)), 2)
    flat[:, 2] = 0
    return {"outliers": far, "dense and piled": dense, "ties in a plane": flat, "line": np.arange(1300.0)[:, None] * [1, 0, 0], "few": RNG.uniform(0, 1, (3, 3)), "one": np.zeros((1, 3)), "none": np.zeros((0, 3))}  # fmt: skip # noqa: E501


@pytest.mark.parametrize("name", list(clouds()))
def test_nearest(spark, name):
    p = clouds()[name]
    ids = RNG.permutation(len(p))
    got = {}
    for r in spatial.knn(cloud(spark, p, ids), 8).orderBy("splat_id", "rank").collect():
        got.setdefault(r["splat_id"], []).append((r["other"], r["d"]))
    expected = {k: v for k, v in brute_nearest(ids, p, 8).items() if v}
    assert got == expected


def test_median_and_percentiles(spark):
    values = [(int(v), None if k == 3 else float(v)) for k, v in enumerate(RNG.integers(-5, 50, 301))]
    df = spark.createDataFrame([(k % 3, v) for k, v in values], "g long, v double")
    positive = sorted(v for _, v in values if v is not None and v > 0)
    assert spatial.upper_median(df, "v") == positive[len(positive) // 2]
    assert spatial.upper_median(df.filter("v > 1000"), "v") is None
    got = {r["g"]: r["q"] for r in ranks.percentile(df, ["g"], "v", 0.9, "q").collect()}
    for g in range(3):
        assert got[g] == pytest.approx(np.percentile([v for k, v in values if k % 3 == g and v is not None], 90))


def test_running_totals_over_partitions(spark):
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 2003).alias("o"), (F.col("id") % 5).alias("v")).repartition(7)
    got = ranks.running(df, ["o", "id"], F.col("v"), "t").orderBy("o", "id").collect()
    assert [r["t"] for r in got] == list(itertools.accumulate(r["v"] for r in got))


def greedy(points, distance):
    kept = []
    for k, p in points:
        if all(np.linalg.norm(p - q) >= distance for _, q in kept):
            kept.append((k, p))
    return [k for k, _ in kept]


def test_greedy_separation(spark):
    p = np.concatenate([RNG.uniform(0, 1, (300, 3)), RNG.uniform(0, 0.1, (100, 3))])
    df = cloud(spark, p).withColumnRenamed("splat_id", "candidate_id")
    got = sorted(r[0] for r in densify.greedy_separation(df, 0.15).collect())
    assert got == greedy(list(enumerate(p)), 0.15)


def test_pca_normals(spark):
    p = RNG.normal(0, 1, (200, 3)) * [1, 1, 0.01]
    rows = {r["splat_id"]: np.array([r["nx"], r["ny"], r["nz"]]) for r in spatial.pca_normals(cloud(spark, p), 8).collect()}
    near = brute_nearest(np.arange(len(p)), p, 8)
    for k, n in rows.items():
        some = p[[k, *(j for j, _ in near[k])]]
        values, axes = np.linalg.eigh(np.cov(some.T, bias=True))
        if values[1] > 2 * values[0]:
            assert abs(abs(n @ axes[:, 0]) - 1) < 1e-6
            assert n @ (p[k] - some.mean(axis=0)) >= -1e-9


def brute_filled(rows, config):
    """fill_holes on rows of {splat_id, p, q (wxyz), s (log)}, one by one."""
    rows, added, n0 = [dict(r) for r in rows], 0, len(rows)
    for _ in range(config.iterations):
        ids, p = np.array([r["splat_id"] for r in rows]), np.array([r["p"] for r in rows])
        near = brute_nearest(ids, p, config.k)
        at = {int(i): x for i, x in zip(ids, p)}
        mean = {k: np.mean([d for _, d in v]) for k, v in near.items()}
        gap = {k: at[k] - np.mean([at[j] for j, _ in v], axis=0) for k, v in near.items()}
        spacing = sorted(v for v in mean.values() if v > 0)
        median = spacing[len(spacing) // 2]
        found = []
        for r in sorted(rows, key=lambda r: r["splat_id"]):
            k, g = r["splat_id"], gap[r["splat_id"]]
            size = np.sqrt((g * g).sum())
            if size > config.boundary * mean[k]:
                if size > 0:
                    found.append((k * 4 + 1, k, r["p"] + g / size * (median * config.spacing), g / size))
            elif mean[k] > config.sparse * median:
                w, x, y, z = np.array(r["q"]) / np.linalg.norm(r["q"])
                m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
                for side in (-1, 1):
                    found.append((k * 4 + side + 1, k, r["p"] + side * 0.5 * mean[k] * m[:, int(np.argmax(r["s"]))], np.zeros(3)))
        radius, fit = median * config.hole, []
        for c, k, x, way in found:
            d = np.linalg.norm(p - x, axis=1)
            ahead = not way.any() or bool((((p - x) @ way)[d <= radius] > 1e-6).any())
            if (d[d <= radius].min() if (d <= radius).any() else np.inf) >= median * config.separation and ahead:
                fit.append((c, x, k))
        kept = set(greedy([(c, x) for c, x, _ in sorted(fit, key=lambda f: f[0])], median * config.separation))
        new = [(x, k) for c, x, k in sorted(fit, key=lambda f: f[0]) if c in kept][: int(config.growth * n0) - added]
        if not new:
            break
        last, source = int(ids.max()), {r["splat_id"]: r for r in rows}
        rows += [dict(source[k], splat_id=last + 1 + j, p=x, s=np.minimum(source[k]["s"], np.log(1.5 * median))) for j, (x, k) in enumerate(new)]
        added += len(new)
        if added >= int(config.growth * n0):
            break
    return rows


def test_fill_holes(spark):
    p = np.array([(i, j, 0.0) for i in range(9) for j in range(9) if not (3 <= i <= 5 and 3 <= j <= 5)]) + RNG.normal(0, 0.03, (72, 3))
    p = np.concatenate([p, RNG.uniform(15, 40, (12, 3))])
    q, s = RNG.normal(0, 1, (len(p), 4)), RNG.uniform(-3, 2, (len(p), 3))
    columns = "splat_id long, x double, y double, z double, scale_0 double, scale_1 double, scale_2 double, rot_0 double, rot_1 double, rot_2 double, rot_3 double, opacity double"
    df = spark.createDataFrame([(k, *map(float, (*p[k], *s[k], *q[k])), 0.5) for k in range(len(p))], columns)
    for config in (densify.Config(iterations=2), densify.Config(iterations=2, sparse=1.2, growth=0.4)):
        out, stats = densify.fill_holes(df, config)
        got = {r["splat_id"]: np.array([r[n] for n in ("x", "y", "z", "scale_0", "scale_1", "scale_2")]) for r in out.collect()}
        expected = brute_filled([{"splat_id": k, "p": p[k], "q": q[k], "s": s[k]} for k in range(len(p))], config)
        assert set(got) == {r["splat_id"] for r in expected} and stats.added == len(expected) - len(p) > 0
        for r in expected:
            assert np.allclose(got[r["splat_id"]], np.concatenate([r["p"], r["s"]]), atol=1e-9)


def test_transform_primitive(spark):
    """The covariance of transformed splats is A Sigma A^T, in single precision."""
    a = np.array([[1.0, 0.5, 0.0], [-0.25, 2.0, 0.125], [0.0, 0.75, 1.5]])
    before = views.cloud_canonical(spark, SF).orderBy("splat_id").limit(40)
    after, losses = scene.transform_primitive(before, a.ravel().tolist(), [1.0, 0.0, 0.0], 3)

    def sigma(r):
        x, y, z, w = (r[n] for n in ("qx", "qy", "qz", "qw"))
        m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        return m @ np.diag([r[n] ** 2 for n in ("sx", "sy", "sz")]) @ m.T

    old = {r["splat_id"]: r for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(old) and losses == []
    for r in rows:
        o = old[r["splat_id"]]
        expected = a @ sigma(o) @ a.T
        assert np.abs(sigma(r) - expected).max() < 1e-5 * np.abs(expected).max()
        assert np.allclose([r[n] for n in "xyz"], a @ [o[n] for n in "xyz"] + [1, 0, 0], atol=1e-5)


def test_deep_chain_and_trees(spark):
    nodes = spark.range(40).selectExpr("id as node", "struct(array(1D,0D,0D,0D,1D,0D,0D,0D,1D) as linear, array(1D,0D,0D) as translation) as transform")
    edges = spark.range(1, 40).selectExpr("id - 1 as parent", "id as child")
    root = spark.range(1).selectExpr("id as node")
    got = {r["node"]: (r["transform"]["translation"][0], r["depth"]) for r in scene.flatten(nodes, edges, root).collect()}
    assert got == {k: (k + 1.0, k) for k in range(40)}
    scene.require_tree(nodes, edges, root)
    for extra in ("39 as parent, 20 as child", "5 as parent, 99 as child", "3 as parent, 0 as child"):
        with pytest.raises(SplatError):
            scene.require_tree(nodes, edges.union(spark.sql(f"select cast(a as long), cast(b as long) from values ({extra.split()[0]}, {extra.split()[3]}) t(a, b)")), root)


def test_document_references():
    glb.check_references({"scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"children": [1, 2]}, {}, {"mesh": 0}], "meshes": [{"primitives": []}]})
    bad = [
        {"nodes": [{"children": [1]}, {"children": [0]}]}, {"nodes": [{"children": [0]}]}, {"nodes": [{"children": [2]}, {"children": [2]}, {}]},
        {"nodes": [{"children": [4]}]}, {"nodes": [{"mesh": 0}]}, {"scene": 1, "scenes": [{}]}, {"accessors": [{"bufferView": 0}]}, {"bufferViews": [{"buffer": 0}]},
        {"meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}]}, {"scenes": [{"nodes": [True]}], "nodes": [{}, {}]},
    ]
    for document in bad:
        with pytest.raises(SplatError):
            glb.check_references(document)


def test_big_cloud_is_whole(spark):
    assert entry.queries()["knn_big"](spark, SF).count() == views.cloud_big(spark, SF).count()


def turned(q):
    """Matrix of a quaternion (x, y, z, w)."""
    x, y, z, w = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def test_projected_discs(spark):
    """The conic and radius of each splat from the projection's derivative, taken by differences."""
    from splatframe.operators import render

    camera = render.perspective(1.0, 48, 32, 0.1, 100.0, 3.0)
    rows = views.cloud_train(spark, SF).orderBy("splat_id").limit(60)
    source = {r["splat_id"]: r for r in rows.collect()}
    view = np.array(camera.view).reshape(4, 4).T
    limit = [render.MARGIN * np.tan(f / 2) for f in camera.fov]
    seen = render.project(rows, camera).collect()
    assert len(seen) > 30
    for r in seen:
        o = source[r["splat_id"]]
        q = np.array([o[f"rot_{k}"] for k in (1, 2, 3, 0)])
        m = turned(q / np.linalg.norm(q)) @ np.diag(np.exp([o[f"scale_{k}"] for k in range(3)]))
        t = (view @ [o["x"], o["y"], o["z"], 1])[:3]
        t = np.array([np.clip(t[0] / t[2], -limit[0], limit[0]) * t[2], np.clip(t[1] / t[2], -limit[1], limit[1]) * t[2], t[2]])
        screen = lambda p: np.array([camera.focal[0] * p[0] / p[2], camera.focal[1] * p[1] / p[2]])
        jac = np.stack([(screen(t + e) - screen(t - e)) / 2e-6 for e in np.eye(3) * 1e-6], axis=1)
        flat = jac @ view[:3, :3] @ m @ m.T @ view[:3, :3].T @ jac.T + np.eye(2) * render.BLUR
        conic = np.linalg.inv(flat)
        assert np.allclose([r["conic_xx"], r["conic_xy"], r["conic_yy"]], [conic[0, 0], conic[0, 1], conic[1, 1]], rtol=1e-4, atol=1e-7)
        mid = np.trace(flat) / 2
        assert r["radius"] == pytest.approx(3 * np.sqrt(mid + np.sqrt(max(0.1, mid * mid - np.linalg.det(flat)))), abs=1.01)


def test_mesh_discs(spark):
    """Enhanced splats: half the mean spacing, thin along the normal, which the rotation gives."""
    from splatframe.operators import mesh

    source = {r["splat_id"]: r for r in views.vertices(spark, SF).collect()}
    ids = np.array(sorted(source))
    p = np.array([[source[k][a] for a in "xyz"] for k in ids], dtype=float)
    near = brute_nearest(ids, p, 8)
    out = mesh.enhanced(views.vertices(spark, SF)).collect()
    assert sorted(r["splat_id"] for r in out) == ids.tolist()
    for r in out:
        v, k = source[r["splat_id"]], r["splat_id"]
        scale = np.clip(0.5 * np.mean([d for _, d in near[k]]) * 0.5, 0.001, 0.1)
        assert np.allclose(np.exp([r[f"scale_{j}"] for j in range(3)]), [scale, scale, 0.3 * scale])
        assert 1 / (1 + np.exp(-r["opacity"])) == pytest.approx(0.95)
        assert [r[a] for a in "xyz"] == [v[a] for a in "xyz"]
        axis = turned([r[f"rot_{j}"] for j in (1, 2, 3, 0)])[:, 2]
        if v["nx"] is not None:
            assert np.allclose(axis, [v["nx"], v["ny"], v["nz"]], atol=1e-6)
        else:
            some = p[[int(np.flatnonzero(ids == j)[0]) for j in (k, *(j for j, _ in near[k]))]]
            values, axes = np.linalg.eigh(np.cov(some.T, bias=True))
            assert values[1] < 2 * values[0] or abs(abs(axis @ axes[:, 0]) - 1) < 1e-5


def test_inspection_document(spark):
    import json

    queries = entry.queries()
    document = json.loads(queries["inspect_json"](spark, SF).first()["document"])
    assert list(document) == ["schema", "cloud"] and document["schema"] == "splat.inspect.v1"
    row = queries["inspect_cloud"](spark, SF).first().asDict()
    assert document["cloud"] == row and list(document["cloud"]) == list(row)


@pytest.mark.parametrize("name", list(clouds()))
def test_brute_is_bounded(spark, name):
    """All pairs in blocks: the same neighbours, and no plan that joins rows with rows."""
    p = clouds()[name]
    ids = RNG.permutation(len(p))
    found = spatial.knn_brute(cloud(spark, p, ids), 8)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("splat_id", "rank").collect():
        got.setdefault(r["splat_id"], []).append((r["other"], r["d"]))
    assert got == {k: v for k, v in brute_nearest(ids, p, 8).items() if v}


def test_crowded_separation(spark):
    """Piles and crowds, with orders at random and along an axis: thinned without pairs."""
    crowd = np.concatenate([RNG.normal(0, 0.1, (1500, 3)), np.tile([[0.02, 0.0, -0.3]], (400, 1)), RNG.uniform(-1, 1, (200, 3))])
    for p in (crowd, crowd[np.argsort(crowd[:, 0])]):
        df = cloud(spark, p).withColumnRenamed("splat_id", "candidate_id")
        kept, undecided = densify._thinned(df, 0.15)
        assert undecided.count() < 300
        assert sorted(r[0] for r in densify.greedy_separation(df, 0.15).collect()) == greedy(list(enumerate(p)), 0.15)


def test_views_are_not_shuffled_by_view(spark):
    """A join with a row for each view doesn't gather the pixels of a view in one task."""
    queries = entry.queries()
    for name in ("unproject", "depth_mask", "depth_scale", "border_trim"):
        plan = queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name


def test_support_search_grows(spark, monkeypatch):
    """The wide search is left to candidates that the narrow ones don't settle; results are those of all pairs."""
    p = RNG.normal(0, 0.12, (1200, 3))
    q, way = RNG.normal(0, 0.2, (300, 3)), RNG.normal(0, 1, (300, 3)) * (np.arange(300) % 3 > 0)[:, None]
    columns = "candidate_id long, x double, y double, z double, dirx double, diry double, dirz double"
    asked, met = [], spatial._met
    monkeypatch.setattr(spatial, "_met", lambda c, cloud, r: asked.append((r, c.count())) or met(c, cloud, r))
    df = spark.createDataFrame([(k, *map(float, (*q[k], *way[k]))) for k in range(300)], columns)
    got = {r["candidate_id"]: (r["min_dist"], r["supported"]) for r in spatial.nearest_and_support(df, cloud(spark, p), 0.2).collect()}
    assert len(asked) > 1 and asked[-1][0] == 0.2 and asked[-1][1] < 200
    for k in range(300):
        d = np.sqrt(((p - q[k]) ** 2).sum(axis=1))
        near = d <= 0.2
        assert got[k][0] == pytest.approx(d[near].min() if near.any() else np.inf)
        assert got[k][1] == (not way[k].any() or bool((((p - q[k]) @ way[k])[near] > 1e-6).any()))


def test_stats_stay_in_their_rows(spark):
    """Means are taken of a point's own list: neighbours aren't dealt out as rows and gathered again."""
    p = RNG.normal(0, 1, (700, 3))
    out = spatial.knn_stats(cloud(spark, p), 8)
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()
    near = brute_nearest(np.arange(len(p)), p, 8)
    for r in out.collect():
        k = r["splat_id"]
        assert r["mean_d"] == pytest.approx(np.mean([d for _, d in near[k]]))
        assert np.allclose([r["gx"], r["gy"], r["gz"]], p[k] - np.mean([p[j] for j, _ in near[k]], axis=0))


@pytest.fixture(scope="module")
def spread(tmp_path_factory):
    """A folder with embeddings, and their places, of which some are alone in their blocks."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = RNG.normal(0, 1, (1600, 64)).astype(np.float32)
    v[:900, :3] = RNG.uniform(0, 1, (900, 3))
    v[900:1500, :3] = RNG.uniform(2, 6, (600, 3))
    v[1500:, :3] = RNG.normal(0, 40, (100, 3))
    folder = tmp_path_factory.mktemp("spread")
    pq.write_table(pa.table({"vec_id": pa.array(range(1600), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder), v[:, :3].astype(np.float64)


@pytest.mark.parametrize("name", ["rim_filter", "sparse_filter"])
def test_filters_of_stats(spark, spread, name):
    """A filter of means, which Spark may evaluate early, meets points whose lists are empty before the wide search."""
    folder, p = spread
    expected, near = set(), brute_nearest(np.arange(len(p)), p, 8)
    for k in near:
        mean_d, gap = np.mean([d for _, d in near[k]]), np.linalg.norm(p[k] - np.mean([p[j] for j, _ in near[k]], axis=0))
        if gap > 0.3 * mean_d if name == "rim_filter" else not gap > 0.3 * mean_d and mean_d > 2.5 * 0.05:
            expected.add(k)
    assert 50 < len(expected) < 1550
    got = [r[0] for r in entry.queries()[name](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
