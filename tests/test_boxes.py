"""Box operators on groups of many boxes: no pairs are listed that the result doesn't hold."""

import random

import numpy as np
import pytest

from sylva.functions import boxes as k
from sylva.functions import polygons as p
from sylva.operators import clean, evaluate
from sylva.operators.spatial_join import near_join

PRED = "tile long, pid long, x0 double, y0 double, x1 double, y1 double, conf double"
ANNOT = "tile long, aid long, x0 double, y0 double, x1 double, y1 double"


def some(n, seed, span=20):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = r.randrange(span), r.randrange(span)
        out.append((float(x), float(y), float(x + r.randrange(1, 12)), float(y + r.randrange(1, 12))))
    return out


def iou(a, b):
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    return both / (area(a) + area(b) - both)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def layers(spark):
    preds = spark.createDataFrame([(0, i, *b, i % 8 / 8) for i, b in enumerate(some(60, 1))], PRED)
    return preds, spark.createDataFrame([(0, i, *b) for i, b in enumerate(some(50, 2))], ANNOT)


def test_prompt_boxes_are_fitted_without_a_list_of_pairs(spark):
    preds, annots = layers(spark)
    found = evaluate.fit_prompt_boxes(annots, preds, "tile", 0.6, 0.5, 8.0)
    assert "b_aid" not in plan(found)
    assert {r["aid"] for r in found.filter("action = 'keep'").collect()} == {aid for aid, a in enumerate(some(50, 2)) if max(iou(b, a) for b in some(60, 1)) >= 0.6}


def test_borders_are_traced_in_the_part_of_a_mask_that_is_set():
    """Work grows with what is set, not with the mask."""
    import time

    mask = np.zeros((600, 600), bool)
    mask[500:504, 500:505] = True
    began = time.process_time()
    assert p.contours(mask) == [[(500.0, 500.0), (504.0, 500.0), (504.0, 503.0), (500.0, 503.0), (500.0, 500.0)]]
    assert time.process_time() - began < 0.2


def test_many_boxes_have_one_union():
    """A list of all pairs of 20,000 boxes doesn't fit into memory."""
    n = 20_000
    x = np.arange(n) % 97.0
    y = np.arange(n) // 97 % 89.0
    parts = k.box_union(np.stack([x, y, x + 2, y + 1], axis=1))
    assert ((parts[:, 2] - parts[:, 0]) * (parts[:, 3] - parts[:, 1])).sum() == 98 * 89
    assert not len(k.box_union(np.array([[0.0, 0.0, 0.0, 5.0]])))


@pytest.mark.parametrize("difference", [1.0, 0.5])
def test_the_suppression_lists_no_pairs(spark, difference):
    kept = clean.greedy_suppress(layers(spark)[0], iou=0.4, area_difference=difference)
    assert "_gx" not in plan(kept) and kept.count() < 60


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_the_greedy_match_is_the_plain_loop_and_lists_no_pairs(spark, least):
    preds, annots = layers(spark)
    used, expected = set(), set()
    for pid, b in enumerate(some(60, 1)):
        near = sorted((-iou(b, a), aid) for aid, a in enumerate(some(50, 2)) if aid not in used and iou(b, a) >= least)
        if pid % 8 / 8 >= 0.5 and near:
            used.add(near[0][1])
            expected.add((pid, near[0][1]))
    found = evaluate.threshold_grid(preds, annots, "tile", [0.3, 0.6], [0.25, 0.5])
    assert "Join Inner, ((((" not in plan(found)
    assert {r["tp"] for r in found.filter(f"iou_t = {least} AND conf_t = 0.5").collect()} == {len(expected)}
    match = evaluate.greedy_match(preds, annots, "tile", [least], [0.5])
    assert {(r["pid"], r["aid"]) for r in match.collect()} == expected and "_gx" not in plan(match)


def test_predictions_without_a_confidence_take_nothing(spark):
    box = (0.0, 0.0, 4.0, 4.0)
    preds = spark.createDataFrame([(0, 0, *box, None), (0, 1, 50.0, 50.0, 54.0, 54.0, 0.9)], PRED)
    [row] = evaluate.threshold_grid(preds, spark.createDataFrame([(0, 0, *box)], ANNOT), "tile", [0.5], [0.5]).collect()
    assert (row["tp"], row["fp"], row["fn"]) == (0, 1, 1)


def test_macro_f1_lists_no_pairs(spark):
    preds, annots = layers(spark)
    found = evaluate.macro_f1(evaluate.threshold_grid(preds, annots, "tile", [0.3, 0.6], [0.25]), ["conf_t"])
    assert "_gx" not in plan(found) and len(found.collect()) == 1


def test_micro_f1_sums_the_groups(spark):
    preds, annots = layers(spark)
    grid = evaluate.threshold_grid(preds, annots, "tile", [0.3], [0.25])
    [row], [one] = evaluate.micro_f1(grid, ["iou_t", "conf_t"]).collect(), grid.collect()
    assert (row["tp"], row["fp"], row["fn"], row["f1"]) == (one["tp"], one["fp"], one["fn"], one["f1"]) and "_gx" not in plan(grid)


def test_boxes_that_meet_are_found_by_a_semi_join(spark):
    preds, annots = layers(spark)
    found = evaluate.match_intersects(preds, annots, "tile", 8.0)
    assert "LeftSemi" in plan(found)
    hit = [any(iou(b, a) > 0 for b in some(60, 1)) for a in some(50, 2)]
    assert [(r["tp"], r["fn"]) for r in found.collect()] == [(sum(hit), 50 - sum(hit))]


def test_the_best_crossing_box_is_that_of_all_pairs(spark):
    preds, annots = layers(spark)
    best = {aid: max((iou(b, a), -pid) for pid, b in enumerate(some(60, 1))) for aid, a in enumerate(some(50, 2))}
    found = evaluate.best_iou(preds, annots, "tile", 8.0)
    assert "b_aid" not in plan(found)  # no list of pairs
    got = {r["aid"]: (r["iou"], r["pid"]) for r in found.collect()}
    assert got == {aid: (v, -pid if v > 0 else None) for aid, (v, pid) in best.items()}


def test_a_box_without_an_area_crosses_others(spark):
    preds = spark.createDataFrame([(0, 7, 2.0, 1.0, 2.0, 3.0, 0.5)], PRED)
    annots = spark.createDataFrame([(0, 1, 0.0, 0.0, 4.0, 4.0)], ANNOT)
    [row] = evaluate.best_iou(preds, annots, "tile", 8.0).collect()
    assert (row["pid"], row["iou"]) == (7, 0.0)


def test_boxes_without_a_side_can_be_near(spark):
    """They touch nothing, so a join of boxes that touch leaves them out."""
    rows = [(0, 0, 1.0, 1.0, 1.0, 5.0, 0.5), (0, 1, 1.0005, 1.0, 1.0005, 5.0, 0.5), (0, 2, 1.0, 1.0, 1.002, 5.0, 0.5)]
    df = spark.createDataFrame(rows, PRED)
    assert {(r["a_pid"], r["b_pid"]) for r in near_join(df, df, ("tile",)).collect()} == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0)}


def test_containment_lists_no_pairs(spark):
    preds = layers(spark)[0]
    found = clean.containment_pairs(preds, "tile", "pid", 0.9, 4.0)
    assert "Join" not in plan(found)
    area = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    both = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    boxes = list(enumerate(some(60, 1)))
    assert {(r["outer"], r["inner"]) for r in found.collect()} == {(i, j) for i, a in boxes for j, b in boxes if i != j and both(a, b) / area(b) >= 0.9}


def test_crowns_are_joined_in_cells_of_their_size():
    from sylva.plans import vectors

    assert vectors.CROWN_CELL <= 8.0  # crowns have sides of 1 to 7.25; wider cells list boxes that are far apart


def test_close_pairs_are_found_without_a_join(spark):
    rows = [(i % 2, i, *b) for i, b in enumerate(some(300, 5, 60))]
    crowns = spark.createDataFrame(rows + [(None, 900, 0.0, 0.0, 9.0, 9.0), (None, 901, 0.0, 0.0, 9.0, 9.0), (0, 902, None, 0.0, 9.0, 9.0)], "tile long, pid long, x0 double, y0 double, x1 double, y1 double")
    found = clean.close_pairs(crowns, "tile", "pid", 0.1, 8.0, 4.0)
    assert "Join" not in plan(found)
    expected = sorted((a[1], b[1], iou(a[2:], b[2:])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a[2:], b[2:]) >= 0.1)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 100
    boxes = np.array([r[2:] for r in rows])
    parts = list(k.near_pairs(np.arange(len(boxes)), boxes, 0.1, (0.0, 0.0, 99.0, 99.0), 4.0, 50))
    assert len(parts) > 20 and len({(i, j) for p in parts for i, j in zip(p[0].tolist(), p[1].tolist(), strict=True)}) == sum(len(p[0]) for p in parts)
