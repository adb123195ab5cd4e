import duckdb
import numpy as np
import pytest

from seqspark.llm import bitsliced as B


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in B.op2_exact_top_k(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(B.ORACLE).fetchall()) and len(got) == 50


def test_search_against_matrix_product():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (1000, 9)), rng.integers(-300, 300, (70, 9))
    x[500:520] = x[7]
    ids = np.arange(1000) * 2
    got = B.search(ids, *B.slices(x), np.array([14, *range(1, 139, 2)][:70]), q, 12)
    for i, own in enumerate([14, *range(1, 139, 2)][:70]):
        s = q[i] @ x.T
        want = sorted((-s[r], ids[r]) for r in range(1000) if ids[r] != own)[:12]
        mine = sorted((-sc, v) for a, v, sc in zip(*got) if a == own)
        assert mine == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (50, [0.1, 0.1]), (100, None), (150, [0.1, None]), (200, [nan, 1.0]), (3, [inf, 1.0]), (4, [-0.001, 0.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, part int").repartition(3)
    got = [tuple(r) for r in B.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and i not in (100, 150, 200, 3)]
    want = []
    for i, q in (r for r in ok if r[0] % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert B.top_k(df.limit(0), df.limit(0)).count() == 0


def test_components_beyond_64_bit_scores_raise(spark):
    rows = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        B.top_k(rows, rows).collect()
