import os
import subprocess
import sys

import numpy as np
import pytest

from vocaris.operators import binary_keys, clustering, similarity
from vocaris.plans import pipelines


def planted(seed, k, per=25, dim=24, noise=0.08):
    rnd = np.random.default_rng(seed)
    centres = np.linalg.qr(rnd.normal(size=(dim, dim)))[0][:k]
    truth = np.repeat(np.arange(k), per)
    return centres[truth] + noise * rnd.normal(size=(k * per, dim)), truth


def same(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_speaker_counts_and_partitions(k):
    x, truth = planted(k, k)
    assert same(clustering.auto_spectral(x), truth)
    assert same(clustering.auto_spectral(x, k), truth)
    assert same(clustering.spectral(x, k), truth)
    assert same(clustering.agglomerative(x, k), truth)
    assert same(clustering.agglomerative(x, None, 0.5), truth)


def dense_graph(affinity, p):
    keep = np.argsort(affinity, axis=1)[:, ::-1][:, :p]
    x = np.zeros_like(affinity)
    np.put_along_axis(x, keep, 1.0, axis=1)
    return 0.5 * (x + x.T)


def dense_laplacian(graph):
    a = graph.copy()
    np.fill_diagonal(a, 0)
    return np.diag(a.sum(1)) - a


@pytest.mark.parametrize("p", [3, 12, 60])
def test_lanczos_equals_the_whole_decomposition(p):
    x, _ = planted(7, 5, 60)
    affinity = clustering._minmax(clustering._cosines(x))
    graph = clustering.Graph(clustering._neighbours(clustering.Affinity.of(x), p, strip=17))
    lap = dense_laplacian(dense_graph(affinity, p))
    v = np.random.default_rng(0).normal(size=(len(x), 3))
    assert np.allclose(graph.laplacian(v, edges=100), lap @ v)
    values, vectors = clustering.lowest(graph, 6, whole=0)
    want = np.linalg.eigvalsh(lap)
    assert np.allclose(values, want[:6], atol=1e-6 * want[-1]) and clustering.highest(graph) == pytest.approx(want[-1], rel=1e-4)
    assert np.allclose(lap @ vectors, vectors * values, atol=1e-5 * want[-1]) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-8)


def test_repeated_eigenvalues_of_separate_parts_are_all_found():
    n = 400
    neighbours = np.array([[i // 50 * 50 + (i + d) % 50 for d in range(1, 6)] for i in range(n)])  # eight rings
    values, _ = clustering.lowest(clustering.Graph(neighbours), 9, whole=0)
    assert np.allclose(values[:8], 0, atol=1e-6) and values[8] > 1e-3
    assert not clustering.Graph(neighbours).connected()


def test_least_connecting_count_by_bisection():
    x, _ = planted(3, 3, 20)
    ranked = np.argsort(clustering._cosines(x), axis=1, kind="stable")[:, ::-1]
    found = clustering.least_connecting(ranked, 1)
    assert clustering.Graph(ranked[:, :found]).connected() and not clustering.Graph(ranked[:, : found - 1]).connected()
    assert clustering.least_connecting(ranked, found + 3) == found + 3


def brute_average_linkage(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, groups, out = 1 - u @ u.T, [[i] for i in range(len(x))], []
    while len(groups) > 1:
        height, a, b = min((d[np.ix_(p, q)].mean(), a, b) for a, p in enumerate(groups) for b, q in enumerate(groups) if a < b)
        out.append((height, sorted(groups[a] + groups[b])))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    return out


def test_chains_give_the_dendrogram_of_brute_force():
    x = np.random.default_rng(5).normal(size=(45, 6))
    parts = {i: [i] for i in range(45)}
    got = []
    for a, b, height in clustering.dendrogram(x):
        both = sorted(parts[int(a)] + parts[int(b)])
        for i in both:
            parts[i] = both
        got.append((height, both))
    want = brute_average_linkage(x)
    assert np.allclose([h for h, _ in got], [h for h, _ in want]) and [g for _, g in got] == [g for _, g in want]


def test_equal_and_zero_windows_cluster():
    x = np.array([[1.0, 0], [1, 0], [1, 0], [0, 1], [0, 1], [0, 0]])
    assert same(clustering.agglomerative(x, None, 0.3), [0, 0, 0, 1, 1, 2])
    assert same(clustering.agglomerative(x, 6), range(6)) and same(clustering.agglomerative(x, 1), [0] * 6)


_LARGE = """
import resource, sys, time
import numpy as np
from vocaris.operators import clustering
rnd = np.random.default_rng(0)
truth = np.repeat(np.arange(6), 10_000 // 6 + 1)[:10_000]
x = np.linalg.qr(rnd.normal(size=(64, 64)))[0][truth] + 0.08 * rnd.normal(size=(10_000, 64))
start = time.time()
labels = clustering.METHODS[sys.argv[1]](x, *eval(sys.argv[2]))
assert len(set(zip(labels, truth))) == len(set(labels)) == 6, len(set(labels))
print(time.time() - start, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""


@pytest.mark.parametrize("method,given", [("auto_spectral", "()"), ("agglomerative", "(None, 0.5)")])
def test_ten_thousand_windows_in_a_gigabyte(method, given):
    out = subprocess.run([sys.executable, "-c", _LARGE, method, given], capture_output=True, text=True, timeout=600, env=os.environ | {"OMP_NUM_THREADS": "2", "OPENBLAS_NUM_THREADS": "2"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout.split()[1]) < 1000


def test_single_windows():
    for fit in clustering.METHODS.values():
        assert fit(np.ones((1, 4))).tolist() == [0]


def test_graph_operators_equal_numpy(spark):
    x, _ = planted(1, 3, 6, 8)
    df = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(x)], "rec long, k int, embedding array<float>")

    def matrix(d):
        out = np.zeros((18, 18))
        for r in d.collect():
            out[r.i, r.j] = r.w
        return out

    a = similarity.affinity_half(similarity.pairs(df))
    m = matrix(a)
    u = np.array(x, dtype=np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert np.allclose(m, (u @ u.T + 1) / 2)
    assert np.allclose(matrix(similarity.enhance(a)), clustering._enhanced(m))
    assert np.allclose(matrix(similarity.affinity_minmax(similarity.pairs(df))), clustering._minmax(u @ u.T))
    g = matrix(similarity.p_graph(a, 4))
    assert np.allclose(g, dense_graph(m, 4))
    np.fill_diagonal(g, 0)
    assert np.allclose(matrix(similarity.laplacian(similarity.p_graph(a, 4))), np.diag(g.sum(1)) - g)


def test_counts_from_eigenvalues(spark):
    up = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate([0.0, 0.01, 0.02, 0.9, 1.0])] + [(2, 1, 0.0)], "rec long, k int, v double")
    assert {r.rec: r.speakers for r in similarity.eigengap_count(up).collect()} == {1: 3}
    down = spark.createDataFrame([(1, k + 1, v) for k, v in enumerate([4.0, 3.0, 0.5, 0.2, 0.001])] + [(2, 1, 0.001)], "rec long, k int, v double")
    assert {r.rec: r.speakers for r in similarity.eigenratio_count(down).collect()} == {1: 4, 2: 1}
    assert clustering.ratio_count(np.array([4.0, 3.0, 0.5, 0.2, 0.001])) == 4


def test_binary_keys(spark):
    assert binary_keys.pool_plan(3000) == (2, 1400, 140) and binary_keys.pool_plan(200)[0] == 1
    with pytest.raises(ValueError):
        binary_keys.pool_plan(100)
    means = np.array([[1.0, 0], [0.9, 0.1], [0, 1], [-1, 0]])
    assert binary_keys.farthest_first(means, 0, 3) == [0, 3, 2]
    frames = spark.createDataFrame([(1, i, [float(i >= 10) + 0.01 * i, 1.0]) for i in range(20)], "rec long, i int, mfcc array<double>")
    labels = spark.createDataFrame([(1, i, 1 if i < 10 else 2) for i in range(20) if i not in (3, 15)], "rec long, i int, label int")
    assert [r.label for r in binary_keys.resegment(frames, labels, 3).orderBy("i").collect()] == [1] * 10 + [2] * 10


def test_diarize_planted_speakers(spark):
    x, truth = planted(7, 2, 10)
    rows = [(1, k, k * 12000, k * 12000 + 24000, v.tolist()) for k, v in enumerate(x)]
    turns = pipelines.diarize(spark.createDataFrame(rows, "rec long, k int, s long, e long, embedding array<float>")).orderBy("seg").collect()
    assert [(r.label, r.s, r.e) for r in turns] == [("1", 0.0, 7.875), ("2", 7.875, 15.75)]


def test_blur_keeps_mass_and_small_recordings_are_counted():
    a = np.zeros((21, 21))
    a[10, 10] = 1
    b = clustering.blur(a)
    assert abs(b.sum() - 1) < 1e-9 and b[10, 10] == b.max() and np.allclose(b, b.T)
    assert np.allclose(clustering.blur(np.ones((5, 5))), 1)
    x, truth = planted(3, 2, 20)
    assert clustering.anchored_count(x) >= 1
    assert same(clustering.by_size(x, 2), truth)
    assert len(set(clustering.by_size(x[:5]))) >= 1


def test_binary_key_pipeline_splits_planted_speakers(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate((rnd.normal(0, 1, (600, 8)) + 6, rnd.normal(0, 1, (600, 8)) - 6))
    frames = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, i, v.tolist()) for i, v in enumerate(x[:50])], "rec long, i int, mfcc array<double>")
    rows = binary_keys.diarize(frames, window=50, least=100, segment=100, context=0, speakers=2).collect()
    one = [r.label for r in sorted((r for r in rows if r.rec == 1), key=lambda r: r.i)]
    assert np.mean(np.array(one) == np.repeat([1, 2], 600)) > 0.95 and {r.label for r in rows if r.rec == 2} == {1}


def test_legacy_diarize_reads_whole_vectors(spark, tmp_path, monkeypatch):
    from vocaris.plans import catalog

    x = np.random.default_rng(8).normal(0, 1, (50, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(binary_keys, "diarize", lambda frames, **_: frames)
    got = [r.mfcc for r in catalog.QUERIES["legacy_diarize"](spark, str(tmp_path)).orderBy("i").collect()]
    assert np.array_equal(np.array(got), x.astype(np.float64))


def test_resegmentation_has_mixtures_and_stays_inside_runs(spark):
    rnd = np.random.default_rng(9)
    # label 1 has two modes around the one of label 2, so that its single Gaussian would be broad and centred there
    x = np.concatenate((rnd.normal(-5, 0.5, (100, 2)), rnd.normal(5, 0.5, (100, 2)), rnd.normal(0, 2, (200, 2))))
    own = np.repeat([1, 1, 2, 2], 100)
    wide = np.abs(x[200:]).max(1) > 3
    assert wide.sum() > 10
    weights, mu, var = binary_keys.mixture(x[:200], 2, np.random.default_rng(0))
    assert np.allclose(np.sort(mu[:, 0]), [-5, 5], atol=0.3) and np.allclose(weights, 0.5, atol=0.05) and var.max() < 1
    got = binary_keys.relabel(x, np.arange(400), own, 1, 2)
    assert (got[200:][~wide] == 2).all() and (got[:200] == 1).mean() > 0.95
    one = binary_keys.relabel(x, np.arange(400), own, 1, 1)
    assert (got != own).sum() < (one != own).sum()
    # a pause between frames 9 and 50: smoothing doesn't cross it
    scores = np.concatenate((np.zeros((1, 10)), np.ones((1, 10))), axis=1)
    i = np.concatenate((np.arange(10), np.arange(50, 60)))
    assert (binary_keys.smooth_runs(scores, i, 9) == scores).all()
    assert not (binary_keys.smooth_runs(scores, np.arange(20), 9) == scores).all()


def test_diarize_ends_with_resegmentation(spark):
    rnd = np.random.default_rng(5)
    # the speaker changes at 650, inside the segment 600 to 699
    x = np.concatenate((rnd.normal(0, 1, (650, 8)) + 6, rnd.normal(0, 1, (550, 8)) - 6))
    frames = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "rec long, i int, mfcc array<double>")
    rows = binary_keys.diarize(frames, window=50, least=100, segment=100, context=0, speakers=2, smooth=5).orderBy("i").collect()
    change = [r.i for a, r in zip(rows, rows[1:]) if a.label != r.label]
    assert len(change) == 1 and abs(change[0] - 650) <= 5


def test_affinity_rows_fuse_scales():
    x, _ = planted(4, 3, 8)
    coarse = (x[::2] + x[1::2]) / 2
    mapping = np.arange(24) // 2
    got = clustering.Affinity([(coarse, mapping, 1.0), (x, np.arange(24), 3.0)], strip=5)
    fine, wide = (clustering._minmax(clustering._cosines(y)) for y in (x, coarse))
    want = (3 * fine + wide[np.ix_(mapping, mapping)]) / 4
    at = np.array([3, 0, 20])
    assert np.allclose(got.rows(np.arange(24)), want) and np.allclose(got.rows(at, at), want[np.ix_(at, at)])


def test_nearest_middle_takes_the_first_of_equals():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        base, other = rnd.integers(0, 12, 20) / 2, rnd.integers(0, 12, 6) / 2
        assert clustering.nearest_middle(base, other).tolist() == [int(np.abs(other - b).argmin()) for b in base]


def test_scales_together_find_what_the_finest_alone_misses(spark):
    rnd = np.random.default_rng(8)
    truth = np.repeat([0, 1, 2], 40)
    centres = np.linalg.qr(rnd.normal(size=(24, 24)))[0][:3]
    fine = centres[truth] + 0.35 * rnd.normal(size=(120, 24))
    coarse = centres[truth[::4]] + 0.05 * rnd.normal(size=(30, 24))
    rows = [(1, 1, k, k * 10, k * 10 + 10, v.tolist()) for k, v in enumerate(fine)] + [(1, 0, k, k * 40, k * 40 + 40, v.tolist()) for k, v in enumerate(coarse)]
    rows += [(2, 1, 0, 0, 10, fine[0].tolist()), (3, 0, 0, 0, 10, fine[0].tolist())]  # one window; no fine scale
    df = spark.createDataFrame(rows, "rec long, scale int, k int, s long, e long, embedding array<double>")
    got = clustering.cluster_scales(df, {0: 3.0, 1: 1.0}, 3).collect()
    assert same([r.label for r in sorted(got, key=lambda r: r.k) if r.rec == 1], truth)
    assert [(r.k, r.label) for r in got if r.rec == 2] == [(0, 1)] and not [r for r in got if r.rec == 3]
    alone = clustering.cluster_scales(df, {1: 1.0}, 3).where("rec = 1").orderBy("k").collect()
    agree = lambda rows_: sum(a == b for a, b in zip([r.label for r in rows_], truth + 1))
    assert not same([r.label for r in alone], truth) or agree(alone) <= 120


def test_pool_and_top_gaussians_in_blocks(spark):
    rnd = np.random.default_rng(6)
    x = {r: rnd.normal(size=(30 + 17 * r, 3)) for r in (1, 2)}
    x[1][:, 2] = 5.0  # a dimension without spread
    df = spark.createDataFrame([(r, i, v.tolist()) for r in x for i, v in enumerate(x[r])], "rec long, i int, x array<double>")
    pool = binary_keys.pool(df, 10, 4, block=3)
    got = {(r.rec, r.g): (np.array(r.mu), np.array(r.sd)) for r in pool.collect()}
    assert set(got) == {(r, g) for r in x for g in range((len(x[r]) - 10) // 4 + 1)}
    for (r, g), (mu, sd) in got.items():
        assert np.allclose(mu, x[r][4 * g : 4 * g + 10].mean(0)) and np.allclose(sd, x[r][4 * g : 4 * g + 10].std(0))
    found = {}
    for r in binary_keys.top_gaussians(df, pool, 3, block=7).collect():
        found.setdefault((r.rec, r.i), {})[r.r] = r.g
    for (r, i), best in found.items():
        ll = {}
        for (rec, g), (mu, sd) in got.items():
            if rec == r:
                own = sd > 0
                ll[g] = float((-0.5 * (np.log(2 * np.pi * sd[own]) + (x[r][i][own] - mu[own]) ** 2 / sd[own])).sum())
        assert [best[k] for k in (1, 2, 3)] == sorted(ll, key=lambda g: (-round(ll[g], 9), g))[:3]
    assert len(found) == sum(map(len, x.values()))


def test_segments_stay_inside_runs():
    i = np.array([0, 1, 2, 3, 4, 10, 11, 12, 20])
    got = [a.tolist() for a in binary_keys.segment_bounds(i, 2, 1)]
    assert got == [[0, 2, 5], [1, 3, 6], [0, 1, 5], [2, 4, 7]]


def test_products_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MATRIX_BLOCK", 4)
    rnd = np.random.default_rng(4)
    x = {"a": rnd.normal(size=(11, 3)), "b": rnd.normal(size=(2, 3)), "c": np.zeros((1, 3))}
    df = spark.createDataFrame([(r, k, v.tolist()) for r in x for k, v in enumerate(x[r])], "rec string, k int, embedding array<float>")
    got = {(r.rec, r.i, r.j): r.c for r in similarity.pairs(df).collect()}
    assert len(got) == 121 + 4 + 1
    for (r, i, j), c in got.items():
        u = x[r] / np.maximum(np.linalg.norm(x[r], axis=1, keepdims=True), 1e-300)
        assert abs(c - u[i] @ u[j]) < 1e-6
    half = similarity.affinity_half(similarity.pairs(df)).where("rec = 'a'")
    m = np.zeros((11, 11))
    for r in half.collect():
        m[r.i, r.j] = r.w
    assert all(abs(r.w - (m @ m.T)[r.i, r.j]) < 1e-9 for r in similarity.diffuse(half).collect())
