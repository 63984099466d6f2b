"""Hard negatives against all pairs, boxes against what they hold, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import hard_negatives
from lodeworks.llm.queries import QUERIES


def plain(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """rows: [(vec_id, label, whole numbers)] -> sorted result rows; every row counts on its own."""
    out = []
    for i, (a, label, x) in enumerate(rows):
        if not anchor(a):
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), -v, lab) for j, (v, lab, y) in enumerate(rows) if j != i and len(y) == len(x)]
        scored.sort(reverse=True)
        for p, minus, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(a, -minus, rank, -v, p, n) for rank, (n, v, _) in enumerate(fits, 1)]
    return sorted(out)


def rows_of(frame):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in frame.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = []
    for r in spark.read.parquet(f"{path}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, np.floor(256 * np.array(r.embedding, float)).astype(int).tolist()))
    want = plain(rows, lambda v: v % 100 == 0)
    assert rows_of(QUERIES["op13_hard_negatives"](spark, path)) == want and want


def test_tree_holds_its_rows_in_its_boxes():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 1025, 5000):
        x = np.floor(rng.normal(0, 40, (n, 7)))
        order = hard_negatives.str_order(x)
        assert sorted(order.tolist()) == list(range(n))
        tree = hard_negatives.Tree(order, x[order])
        anchors = np.floor(rng.normal(0, 40, (20, 7)))
        least, greatest = tree.intervals(anchors)
        scores = anchors @ x[order].T

        def rows(box):
            if len(tree.levels) == 1 or box < tree.levels[1]:
                return list(range(box * 64, min(box * 64 + 64, n)))
            return [r for child in tree.children(box) for r in rows(child)]

        for box in range(len(tree.low)):
            own = scores[:, rows(box)]
            assert (least[:, box] <= own.min(axis=1)).all() and (greatest[:, box] >= own.max(axis=1)).all()
        assert sorted(rows(len(tree.low) - 1)) == list(range(n))


def test_queue_prunes_and_loses_nothing():
    """Around a few centres in few dimensions boxes are tight: most pages stay shut, and the rows are those of a full search."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 100, (40, 4))
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 3, (8000, 4)))
    order = hard_negatives.str_order(x)
    tree = hard_negatives.Tree(order, x[order])
    opened = 0
    for anchor in np.floor(rng.normal(0, 100, (30, 4))):
        scores = (x @ anchor).astype(int).tolist()
        top = max(scores)
        windows = [(0, -(2**63), 2**63 - 1), (1, 0, int(0.6 * top)), (2, int(0.3 * top), int(0.31 * top))]
        search = hard_negatives.Search(10)
        least, greatest = (v[0].tolist() for v in tree.intervals(anchor[None]))
        search.through(tree, anchor, least, greatest, windows)
        opened += search.opened
        for number, low, high in windows:
            want = sorted(((s, -i) for i, s in enumerate(scores) if low <= s <= high), reverse=True)[:10]
            assert sorted(search.best.get(number, []), reverse=True) == want
    assert opened < 0.4 * 30 * 125


def test_odd_rows(spark):
    """Nulls anywhere, other widths, repeated rows and anchors, ties, huge and negative numbers, clashing columns."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.integers(-2, 3, 3)], int(i) % 3) for i in range(60)]
    rows += [(0, rows[0][1], 0), (0, rows[0][1], 0), (10, [1.0, 1.0, 1.0], 1), (70, [1.0, 2.0], 0), (71, [0.5, 2.0], 0), (72, [0.5, 1.0], 1), (80, [], 0), (81, [], 0), (82, [], 1)]
    rows += [(90, [2.0**70, 1.0, 0.0], 0), (91, [3.0, 2.0**40, 1.5], 1), (100, [-(2.0**33), 0.25, 0.0], 2)]
    bad = [(None, [1.0, 1.0, 1.0], 0), (20, None, 0), (30, [1.0, 1.0, 1.0], None), (40, [1.0, None, 1.0], 0), (50, [1.0, float("nan"), 1.0], 0), (61, [float("inf"), 1.0, 1.0], 0)]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows + bad], "vec_id long, embedding array<double>, label long, x string, anchor int").repartition(5)
    got = rows_of(hard_negatives.mine(frame, F.col("label"), F.col("vec_id") % 10 == 0, positives=3, negatives=4, scale=2))
    whole = [(v, lab, [int(np.floor(2 * e)) for e in x]) for v, x, lab in rows]
    ends = 2**63 - 1
    clipped = []
    for i, (a, label, x) in enumerate(whole):
        if a % 10:
            continue
        scored = [(max(-ends - 1, min(ends, sum(p * q for p, q in zip(x, y)))), -v, lab) for j, (v, lab, y) in enumerate(whole) if j != i and len(y) == len(x)]
        scored.sort(reverse=True)
        for p, minus, _ in [s for s in scored if s[2] == label][:3]:
            fits = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:4]
            clipped += [(a, -minus, rank, -v, p, n) for rank, (n, v, _) in enumerate(fits, 1)]
    assert got == sorted(clipped) and len({g[0] for g in got}) > 5
    assert hard_negatives.mine(frame.limit(0), F.col("label"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame, F.col("label"), F.col("vec_id") < 0).count() == 0
