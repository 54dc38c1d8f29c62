import os

import numpy as np
import pytest

from vocaris.operators import similarity, vector_index


def made(spark, n=3000, dim=32, groups=40):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(groups, dim))
    v = centres[rnd.integers(groups, size=n)] + 0.7 * rnd.normal(size=(n, dim))
    v[::10] = v[0]  # copies: a third of a cell
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "point long, vector array<float>")


def test_recall_and_whole_probing(spark, tmp_path):
    points = made(spark)
    queries = points.where("point % 50 = 7").withColumnRenamed("point", "query")
    config = vector_index.IndexConfig(cells=24, sample=800, block=100)
    centres = vector_index.build(points, str(tmp_path / "ix"), config)
    assert np.allclose(centres, vector_index.centroids(spark, str(tmp_path / "ix")))
    kept = spark.read.parquet(str(tmp_path / "ix" / "points"))
    assert kept.count() == 3000 and kept.select("point").distinct().count() == 3000
    exact = similarity.top_k(queries, points, 10)
    key = lambda df: sorted((r.query, r.rank, r.point, round(r.score, 9)) for r in df.collect())
    assert key(vector_index.search(queries, str(tmp_path / "ix"), 10, 24, config)) == key(exact)
    found = vector_index.search(queries, str(tmp_path / "ix"), 10, 6, config)
    assert vector_index.recall(found, exact) >= 0.9
    one = vector_index.recall(vector_index.search(queries, str(tmp_path / "ix"), 10, 1, config), exact)
    assert 0.2 < one < 1


def test_null_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    points = spark.createDataFrame(rows, "point long, vector array<float>")
    vector_index.build(points, str(tmp_path / "a"), vector_index.IndexConfig(cells=5))
    queries = points.withColumnRenamed("point", "query")
    assert sorted((r.query, r.point) for r in vector_index.search(queries, str(tmp_path / "a"), 1).collect()) == [(1, 1), (3, 3)]
    assert vector_index.search(queries.limit(0), str(tmp_path / "a"), 1).count() == 0
    with pytest.raises(ValueError):
        vector_index.fit(points, vector_index.IndexConfig(cells=100_000))
    assert os.path.isdir(tmp_path / "a" / "points")
