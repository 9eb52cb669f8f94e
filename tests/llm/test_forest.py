"""Operator 11 against brute force: recall, exact scores, ranks and ties."""

import numpy as np
import pytest

from quarry.llm import forest
from quarry.llm.queries import op11_nearest_neighbours

VECS = "vec_id long, embedding array<double>, label int, q long, vec string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, "v", "s") for i, e in rows], VECS)


def asked(df, every=20):
    return df.filter(f"vec_id % {every} = 0").withColumnRenamed("vec_id", "query_id")


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def brute(rows, q, k):
    """The k nearest of query row ``q``: (vec_id, score), null ids last among ties."""
    x = np.array(q[1])
    some = [(i, float(x @ np.array(e))) for i, e in {(i, tuple(e)) for i, e in rows} if i != q[0]]
    return sorted(some, key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:k]


def recall(got, rows, queries, k):
    hit = total = 0
    for q in queries:
        want = brute(rows, q, k)
        mine = got[q[0]]
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        scores = [s for _, _, s in mine]
        assert scores == sorted(scores, reverse=True)
        vec = {i: np.array(e) for i, e in rows}
        for _, i, s in mine:
            assert s == pytest.approx(float(vec[i] @ np.array(q[1])), abs=1e-12)
        hit += len({i for i, _ in want} & {i for _, i, _ in mine})
        total += len(want)
    return hit / total


def test_a_walk_meets_every_leaf_in_the_order_of_the_shared_queue():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    f = forest.grow(x, float(np.sqrt((x * x).sum(axis=1).max())), trees=3, leaf=10)
    at = f.leaf_of(x)
    assert len(np.unique(at)) == f.leaves and (np.bincount(at.reshape(-1)) <= 10).all()
    for q in x[:20]:
        margins = f.margins(q[None])[0]
        far = {}
        for root in f.roots:
            todo = [(root, -np.inf)]
            while todo:
                node, d = todo.pop()
                if node < 0:
                    far[-1 - node] = d
                else:
                    low, high = f.kids[node].tolist()
                    todo += [(low, max(d, margins[node])), (high, max(d, -margins[node]))]
        met = list(f.walk(margins))
        assert sorted(met) == list(range(f.leaves))
        assert [far[i] for i in met] == sorted(far.values())
    # A vector as long as the longest meets its own leaves first, at no distance.
    longest = int((x * x).sum(axis=1).argmax())
    first = list(f.walk(f.margins(x[longest][None])[0]))[:3]
    assert set(first) == set(at[longest].tolist())


def test_equal_vectors_are_no_endless_split():
    f = forest.grow(np.ones((500, 4)), 2.0, trees=2, leaf=8)
    assert f.leaves == 2 and f.leaf_of(np.ones((3, 4))).tolist() == [[0, 1]] * 3


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths"])
def test_recall_over_shards(spark, kind):
    """More rows than the sample, several shards and large leaves."""
    rng = np.random.default_rng(5)
    n, d = 1500, 16
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.05 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 1, (n, 1))
    rows = [(i, [float(c) for c in e]) for i, e in enumerate(x)]
    df = table(spark, rows)
    got = by_query(forest.nearest(df, asked(df), k=10, sample=300, leaf=20, shard_bytes=16_000))
    queries = [r for r in rows if r[0] % 20 == 0]
    assert recall(got, rows, queries, 10) >= 0.9


def test_the_tables_vectors(spark):
    sf = "/root/testdata/sf0.001"
    got = op11_nearest_neighbours(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(r.vec_id, [float(c) for c in r.embedding])
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    assert len(queries) >= 20 and recall(by_query(got), rows, queries, 20) >= 0.9


def test_one_vector_holds_a_third_of_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [4.0, 2.0, 1.0]) if i % 3 == 0 else (i, [float(c) for c in rng.normal(size=3)])
            for i in range(600)]
    df = table(spark, rows)
    got = by_query(forest.nearest(df, asked(df), k=20, recall=1.0))
    for q in (r for r in rows if r[0] % 20 == 0):
        want = brute(rows, q, 20)
        assert [i for _, i, _ in got[q[0]]] == [i for i, _ in want]
    # The common vector's nearest: the smallest ids of its rows, without the query's.
    assert [i for _, i, _ in got[60]] == [*range(0, 60, 3)]
    assert [i for _, i, _ in got[0]] == [*range(3, 63, 3)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]),
            (None, [1.0, 0.0]), (20, [0.0, -2.0])]
    bad = [(40, None), (60, []), (80, [0.0, 0.0]), (100, [None, 1.0]), (120, [nan, 1.0]),
           (140, [inf, 1.0]), (4, [0.0, 0.0]), (5, None)]
    other = [(160, [3.0]), (6, [2.0]), (180, [1.0, 1.0, 1.0])]
    df = table(spark, good + bad + other)
    got = by_query(forest.nearest(df, asked(df)))
    assert got == {
        0: [(1, 2, 1.0), (2, None, 1.0), (3, 1, 0.0), (4, 20, 0.0), (5, 3, -1.0)],
        20: [(1, 0, 0.0), (2, 2, 0.0), (3, 3, 0.0), (4, None, 0.0), (5, 1, -2.0)],
        160: [(1, 6, 6.0)]}
    two = table(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])])
    assert sorted(tuple(r) for r in forest.nearest(two, asked(two)).collect()) == [
        (0, 1, 1, 1.0), (0, 1, 1, 1.0)]
    missing = df.selectExpr("cast(null as long) AS query_id", "embedding").filter(
        "embedding = array(-1d, 0d)")
    assert [r.vec_id for r in forest.nearest(df, missing).collect()][-3:] == [20, 0, 2]


def test_empty_tables(spark):
    df = table(spark, [(0, [1.0])])
    none = table(spark, [])
    assert forest.nearest(none, asked(none)).count() == 0
    assert forest.nearest(df, asked(df)).count() == 0
    assert forest.nearest(df, asked(df).limit(0)).count() == 0
    assert forest.nearest(none, asked(df)).count() == 0
    with pytest.raises(ValueError):
        many = table(spark, [(20 * i, [1.0] * i) for i in range(1, 19)])
        forest.nearest(many, asked(many))


def test_small_tables_dont_become_a_file_per_shuffle_partition(spark, monkeypatch):
    """With 64 shuffle partitions that adaptive execution leaves apart, as many files would be
    written of the queries, the classes and the result: now no more than there are cores."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(2000)]
    df = table(spark, rows)
    files = {}

    def counted(df, name, stored=forest.stored):
        out = stored(df, name)
        files[name] = len(out.inputFiles())
        return out
    monkeypatch.setattr(forest, "stored", counted)
    held = {"spark.sql.shuffle.partitions": "64",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in held}
    try:
        for c, v in held.items():
            spark.conf.set(c, v)
        out = forest.nearest(df, asked(df, 5), k=5)
        counted(out, "result")
        assert recall(by_query(out), rows, [r for r in rows if r[0] % 5 == 0], 5) >= 0.9
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    cores = spark.sparkContext.defaultParallelism
    assert files.pop("result") <= cores + 1     # and the empty table that lengths are added to
    assert max(files.values()) <= cores and {"forest-queries", "forest-classes"} <= set(files)
    # Larger ones keep a task for every TASK_BYTES.
    wide = spark.range(100).repartition(50)
    assert forest._few(wide, 20 * forest.TASK_BYTES).rdd.getNumPartitions() == 20
    assert forest._few(wide, 10 ** 12).rdd.getNumPartitions() == 50


def test_classes_hold_the_smallest_ids_of_equal_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i == 40 else int(i), [a, b]) for i, a, b in zip(
        rng.integers(0, 41, 2000), rng.choice([1.0, 2.0], 2000).tolist(),
        rng.choice([0.0, -0.0, 1.0], 2000).tolist())] + [(None, [5.0, 5.0])]
    want = {}
    for i, e in {(i, tuple(e)) for i, e in rows}:
        want.setdefault(e, set()).add(i)
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    for ids in (7, 100):
        got = [(tuple(r.vec), r.members) for r in forest._classes(df, ids).collect()]
        assert len(got) == len(want) == 5 and dict(got) == {
            e: sorted(x, key=lambda i: (i is None, i or 0))[:ids] for e, x in want.items()}
