import numpy as np

from tablewright.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double, members string"


def brute(rows, k, query):
    """{query id: [(id, distance)]} over the rows that take part."""
    kept = [
        (vec_id, np.array([np.float32(x) for x in v], float))
        for vec_id, v, *_ in rows
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    sizes = [len(v) for _, v in kept]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    kept = [(i, v) for i, v in kept if len(v) == width]
    out = {}
    for place, (q, own) in enumerate(kept):
        if query(q):
            d = [(float(np.sqrt(((v - own) ** 2).sum())), i) for k_, (i, v) in enumerate(kept) if k_ != place]
            out.setdefault(q, []).append([(i, s) for s, i in sorted(d)[:k]])
    return {q: lists[0] if len(lists) == 1 else sorted(lists) for q, lists in out.items()}


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_exact_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(6).astype("float32").tolist(), None, None) for k in range(60)]
    rows += [(100 + k, rows[0][1], 1.0, "same") for k in range(20)]
    rows += [rows[3], (200, None, None, None), (210, [0.0] * 6, None, None), (220, [1.0, None, 1.0, 1.0, 1.0, 1.0], None, None)]
    rows += [(230, [float("nan")] + [1.0] * 5, None, None), (240, [float("inf")] + [1.0] * 5, None, None), (250, [1.0, 2.0], None, None), (None, [1.0] * 6, None, None), (260, [], None, None)]
    want = brute(rows, 10, lambda i: i % 10 == 0)
    mine = got(ann.neighbours(spark.createDataFrame(rows, SCHEMA), lambda c: c % 10 == 0, k=10))
    assert mine.keys() == want.keys()
    for q in want:
        assert [i for i, _ in mine[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in mine[q]], [s for _, s in want[q]], rtol=1e-12)


def test_fewer_rows_than_asked_for_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], None, None), (1, [0.0, 1.0], None, None)], SCHEMA)
    assert {q: [i for i, _ in v] for q, v in got(ann.neighbours(df, lambda c: c >= 0)).items()} == {0: [1], 1: [0]}
    assert ann.neighbours(spark.createDataFrame([], SCHEMA), lambda c: c >= 0).collect() == []


def test_recall_with_many_leaves_and_split_leaves(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32))
    vectors = centres[rng.integers(0, 20, 4000)] + 0.3 * rng.standard_normal((4000, 32))
    rows = [(k, v.astype("float32").tolist(), None, None) for k, v in enumerate(vectors)]
    want = brute(rows, 10, lambda i: i % 100 == 0)
    mine = got(ann.neighbours(spark.createDataFrame(rows, SCHEMA), lambda c: c % 100 == 0, leaf_rows=100, block_rows=40))
    whole = got(ann.neighbours(spark.createDataFrame(rows, SCHEMA), lambda c: c % 100 == 0, leaf_rows=100, block_rows=450))
    assert whole == mine
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in mine[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    assert all(len(v) == 10 for v in mine.values())


def test_queue_goes_to_the_nearest_leaves_first():
    rng = np.random.default_rng(2)
    sample = rng.standard_normal((500, 8))
    forest = ann.Forest.fit(sample, trees=3, depth=4, seed=0)
    own = forest.leaves(sample[:5])
    for k in range(5):
        found = forest.search(sample[k], 10)
        assert len(set(found)) == 10
        assert [(t, int(own[k, t])) for t in range(3)] == sorted(found[:3])
        assert len(forest.search(sample[k], 1000)) == 3 * 16


def test_rows_that_share_an_id_all_count(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 7 * 10, rng.standard_normal(4).astype("float32").tolist(), None, None) for k in range(40)] + [(5, [1.0, 2.0, 3.0, 4.0], None, None)] * 3
    want = brute(rows, 6, lambda i: True)
    found = ann.neighbours(spark.createDataFrame(rows, SCHEMA), lambda c: c >= 0, k=6).collect()
    assert len(found) == 43 * 6
    for q, lists in want.items():
        mine = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in found if r.query_id == q)
        assert mine == sorted((n + 1, i, round(s, 9)) for one in lists for n, (i, s) in enumerate(one))


def test_queries_in_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(8).astype("float32").tolist(), None, None) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (got(ann.neighbours(df, lambda c: c % 3 == 0, leaf_rows=100, ask_rows=n)) for n in (1000, 30))
    assert one == many and len(one) == 200


def test_recall_at_production_parameters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = brute(rows, 10, lambda i: i % 100 == 0)
    mine = got(ann.neighbours(df, lambda c: c % 100 == 0))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in mine[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
