import numpy as np

from talus.operators import nearest


def test_nearest_in_group_shuffles_no_vector_more_than_once(spark, monkeypatch):
    """The nearest of brute force over many blocks; what is written and shuffled doesn't hold vectors once a block."""
    monkeypatch.setattr(nearest, "GROUP_BLOCK", 16)
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8)).round(1)
    v[7], v[9], v[11] = 0, v[8], v[8]  # no direction; equal ones tie by id
    rows = [(i, None if i == 290 else "ab"[i % 7 == 0], None if i == 299 else v[i].tolist(), [(i * 3) % 300, 10**6] if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>, s array<long>").repartition(3)
    got = nearest.nearest_in_group(df, ["g"], "id", "v", 3, "s")
    want = []
    for i, g, x, s in rows:
        near = [(-float(np.dot(v[i], v[j]) / np.linalg.norm(v[i]) / np.linalg.norm(v[j])), j) for j, h, y, _ in rows if i not in (7, 290, 299) and j not in (i, 7, 290, 299) and g == h and j not in (s or ())]
        want += [(i, j) for _, j in sorted((round(a, 9), j) for a, j in near)[:3]]
    assert sorted((x.a, x.b) for x in got.select("a", "b").collect()) == sorted(want)
    # Before, each pair of blocks was shuffled with the vectors of both its sides.
    assert "side" not in got._jdf.queryExecution().optimizedPlan().toString()
