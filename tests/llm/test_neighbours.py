"""Nearest neighbours against brute force: exact scores and order, recall of at least 0.9."""

import numpy as np
import pytest

from tickloom.llm import neighbours


def brute(ids, vectors):
    """{(query id, its row): [(score, vec_id)]} of every row but the query's own."""
    ok = [k for k, v in enumerate(vectors) if ids[k] is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    seen, rows = set(), []
    for k in ok:
        key = (ids[k], tuple(vectors[k]))
        if key not in seen:
            seen.add(key)
            rows.append((ids[k], np.array(vectors[k], float)))
    out = []
    for i, v in rows:
        if i % 50 == 0:
            others = [(-float(v @ u / (np.sqrt(v @ v) * np.sqrt(u @ u))), j) for j, u in rows if len(u) == len(v) and not (j == i and np.array_equal(u, v))]
            out.append((i, sorted(others)))
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(100, 24)), 15, 0) + 0.1 * x
    frame = spark.createDataFrame([(k, v, 1, 2) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id bigint, embedding array<float>, point int, q int")
    got = neighbours.nearest(frame, k=12, reverse=12, beam=48).toPandas().sort_values(["query_id", "rank"])
    x = x.astype(np.float32).astype(float)
    want = dict(brute(list(range(1500)), list(x)))
    assert set(got.query_id) == set(want) and len(got) == 5 * len(want)
    hits = 0
    for q, rows in got.groupby("query_id"):
        exact = {j: -s for s, j in want[q]}
        assert list(rows["rank"]) == [1, 2, 3, 4, 5] and q not in set(rows.vec_id)
        assert np.allclose(rows.score, [exact[j] for j in rows.vec_id], atol=1e-12) and (np.diff(rows.score) <= 0).all()
        hits += len(set(rows.vec_id) & {j for _, j in want[q][:5]})
    assert hits / len(got) >= 0.9


def test_defined_cases(spark):
    """Copies, ties, unusable vectors, null ids, several lengths, repeated rows: small enough that all is found."""
    rng = np.random.default_rng(4)
    rows = [(k, list(map(float, rng.integers(-3, 4, 3)))) for k in range(0, 60)]
    rows += [(100 + k, [1.0, 2.0, 3.0]) for k in range(40)] + [(150, [2.0, 4.0, 6.0])]  # copies of a third of all rows, and a multiple
    rows += [(200, None), (250, []), (300, [0.0, 0.0, 0.0]), (350, [1.0, None, 2.0]), (400, [1.0, float("nan"), 2.0]), (450, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [1.0] * 7)]  # a pair of two, one alone
    rows += [rows[0], (50, [3.0, -1.0, 2.0]), (600, [1e200, 1e200, 0.0]), (601, [1e-200, 1e-200, 0.0])]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id bigint, embedding array<double>, id int, data int").repartition(3)
    got = sorted(neighbours.nearest(frame).collect(), key=lambda r: (r["query_id"], r["rank"]))
    scaled = [(i, [x / 1e200 for x in v] if v and i == 600 else [x * 1e200 for x in v] if v and i == 601 else v) for i, v in rows]
    want = brute([i for i, _ in scaled], [v for _, v in scaled])
    by_query = {}
    for i, found in want:
        by_query.setdefault(i, []).append([round(-s, 12) for s, _ in found[:5]])
    have = {}
    for r in got:
        if r["rank"] == 1:
            have.setdefault(r["query_id"], []).append([])
    assert {i for i, f in by_query.items() if any(f)} == set(have) and 550 not in have
    for i in have:
        assert sorted(round(r["score"], 12) for r in got if r["query_id"] == i) == sorted(s for f in by_query[i] for s in f)
    copies = [r["vec_id"] for r in got if r["query_id"] == 100]
    assert copies == [101, 102, 103, 104, 105]
    assert [r["vec_id"] for r in got if r["query_id"] == 150] == [100, 101, 102, 103, 104]


def test_no_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(50, [1.0])], "vec_id bigint, embedding array<float>")).count() == 0
