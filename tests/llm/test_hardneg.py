"""Hard negatives against all products."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomsift.llm import hardneg
from loomsift.llm.hardneg import OP11_SQL, Best, Block, hard_negatives, product, threshold_scan
from loomsift.llm.suite import queries

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=50, positives=5, negatives=3, scale=256, low=50, high=95):
    """Of unique, whole rows (id, label, vector)."""
    x = {i: (lab, [int(np.floor(scale * c)) for c in v]) for i, lab, v in rows}
    out = []
    for a, (lab, v) in x.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, (other, w) in x.items() if i != a and len(w) == len(v))
        for s, p, _ in [t for t in scores if t[2] == lab][:positives]:
            inside = [t for t in scores if t[2] != lab and low * -s <= 100 * -t[0] <= high * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(inside[:negatives])]
    return sorted(out)


def test_op11_whole_table(spark, sf):
    df = queries()["op11_hard_negatives"](spark, sf)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                         ("positive_score", "bigint"), ("negative_score", "bigint")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(OP11_SQL).fetchall()) != []


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "sparse", "huge"])
def test_scan_is_exact_over_blocks(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-90, 90, (900, 12))
    if kind == "ties":
        x = np.sign(x)
    if kind == "copies":
        x[::3] = x[0]
    if kind == "sparse":
        x[rng.random(x.shape) < 0.9] = 0
    if kind == "huge":
        x = x << 22
    ids = rng.permutation(900)
    blocks = [Block.from_bytes(pa.py_buffer(Block(ids[a:a + 250], ids[a:a + 250] % 4, x[a:a + 250]).to_bytes())) for a in range(0, 900, 250)]
    scored = 0
    for i in range(40):
        best, score = Best(5), x.astype(object) @ x[i].astype(object)
        for block in blocks:
            scored += threshold_scan(block, x[i], (block.labels == ids[i] % 4) & (block.ids != ids[i]), [best])
        order = [j for j in np.lexsort((ids, -score.astype(np.int64))) if j != i]
        assert best.ids.tolist() == [ids[j] for j in order if ids[j] % 4 == ids[i] % 4][:5]
        windows = [Best(3, int(s)) for s in best.score]
        for block in blocks:
            threshold_scan(block, x[i], block.labels != ids[i] % 4, windows)
        for w in windows:
            inside = [j for j in order if ids[j] % 4 != ids[i] % 4 and 50 * w.positive <= 100 * score[j] <= 95 * w.positive]
            assert w.ids.tolist() == [ids[j] for j in inside[:3]]
    assert kind != "sparse" or scored < 40 * 900 / 4


def test_scan_stops_early():
    # One long vector in the anchor's direction: the threshold falls below it at once.
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 6, (4000, 4))
    x[7] = 100
    block, best = Block(np.arange(4000), np.zeros(4000, np.int64), x), Best(1)
    assert threshold_scan(block, np.array([3, 3, 3, 3]), np.ones(4000, bool), [best]) < 400 and best.ids.tolist() == [7]
    # An anchor of zeros ties with everything: the smallest ids.
    best = Best(2)
    threshold_scan(block, np.zeros(4, np.int64), np.arange(4000) > 5, [best])
    assert best.ids.tolist() == [6, 7] and best.score.tolist() == [0, 0]


def test_products_are_exact():
    big = np.array([[1 << 40, 1]])
    assert product(big, np.array([1 << 30, 1])).tolist() == [(1 << 70) + 1]
    assert product(np.array([[1 << 30, 3]]), np.array([1 << 30, 1])).tolist() == [(1 << 60) + 3]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, i % 3, [round(float(c), 2) for c in rng.normal(size=4)]) for i in range(0, 120)]
    good += [(200, 1, [0.0, 0.0, 0.0, 0.0]), (201, 1, [0.5, 0.5, 0.5, 0.5]), (202, 2, [0.5, 0.5, 0.5, 0.5]), (203, 2, [0.25] * 4), (204, 2, [0.25] * 4),
             (250, 1, [1.0, 1.0, 1.0]), (251, 1, [1.0, 1.0, 1.0]), (252, 0, [0.75, 0.75, 0.75]), (-50, 2, [0.1, 0.2, -0.3, 0.4])]
    odd = [(None, 1, [9.0] * 4), (300, None, [9.0] * 4), (350, 1, None), (301, 1, [nan] * 4), (302, 1, [inf, 1.0, 1.0, 1.0]), (303, 1, [None, 1.0, 1.0, 1.0]),
           (304, 1, []), *good[:7], *[good[3]] * 5, (5, 0, [9e9] * 4)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in [*good, *odd]], SCHEMA + ", rank int, score int, windows string")
    got = sorted(map(tuple, hard_negatives(df).collect()))
    assert got == brute(good) and {r[0] for r in got} >= {0, 50, 100, 250}
    assert hard_negatives(df.limit(0)).collect() == []


def test_small_blocks_are_put_together(tmp_path, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_NUMBERS", 100)
    x = np.random.default_rng(1).integers(-9, 9, (57, 4))
    paths = []
    for a in range(0, 57, 5):
        paths.append(str(tmp_path / f"{a}.blk"))
        hardneg.store(paths[-1], Block(np.arange(a, min(57, a + 5)), np.zeros(min(5, 57 - a), np.int64), x[a:a + 5]).to_bytes())
    blocks = list(hardneg._blocks(paths))
    assert [len(b.ids) for b in blocks] == [25, 25, 7] and (np.concatenate([b.x for b in blocks]) == x).all()
    assert all((np.diff(b.x[b.order[d], d]) >= 0).all() for b in blocks for d in range(4))


def test_one_label_holds_most_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0 if i % 10 else 1, [float(c) for c in rng.normal(size=6)]) for i in range(600)]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    alone = [(i, i, [1.0, float(i)]) for i in range(120)]
    assert hard_negatives(spark.createDataFrame(alone, SCHEMA)).collect() == []  # no positives
