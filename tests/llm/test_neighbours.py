"""Neighbours against all products."""

import duckdb
import numpy as np
import pytest

from loomsift.llm.neighbours import OP5_SQL, Block, Heaps, join_tile, nearest
from loomsift.llm.suite import queries


def test_op5_whole_table(spark, sf):
    rows = sorted(map(tuple, queries()["op5_nearest_neighbours"](spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(OP5_SQL).fetchall())
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in rows], [r[3] for r in want], rtol=1e-14)


@pytest.mark.parametrize("kind", ["normal", "ties", "scales"])
def test_tiles_are_exact_and_prune(kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    if kind == "ties":
        x[::3] = x[0]
    if kind == "scales":
        x *= 10.0 ** rng.integers(-8, 8, (3000, 1))
    ids = rng.permutation(3000)
    q = Block(ids[:200], x[:200])
    heaps = Heaps(200, 20)
    exact = sum(join_tile(q, Block.from_bytes(pa_buffer(Block(ids[a:a + 1100], x[a:a + 1100]))), heaps) for a in range(0, 3000, 1100))
    score = x[:200] @ x.T
    for i in range(200):
        mine = heaps.query == i
        own = np.lexsort((ids, -score[i]))
        want = [ids[j] for j in own if j != i]
        if kind == "normal":
            assert heaps.ids[mine].tolist() == want[:20]
        got = score[i][[int(np.flatnonzero(ids == v)[0]) for v in heaps.ids[mine]]]
        best = np.sort(np.delete(score[i], i))[::-1][:20]
        assert np.allclose(got, best, rtol=1e-12)
    if kind == "normal":
        assert exact < 200 * 3000 / 4


def pa_buffer(block):
    import pyarrow as pa
    return pa.py_buffer(block.to_bytes())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [0.0, 0.0]),
            (6, [inf, 1.0]), (7, [1.0, None]), (None, [5.0, 5.0]), (40, [1.0, 2.0, 3.0]), (8, [1.0, 1.0, 1.0]), (9, []), (-20, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = sorted(tuple(r) for r in nearest(df).collect())
    assert got == [(-20, 1, 1, 4.0), (-20, 2, 2, 4.0), (-20, 3, 0, 2.0), (-20, 4, 20, 2.0), (0, 1, -20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0),
                   (0, 4, 20, 0.0), (20, 1, -20, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 0, 0.0), (40, 1, 8, 6.0)]
    assert nearest(df.limit(0)).collect() == []
