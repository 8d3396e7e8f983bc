import random

import pandas as pd
import pytest

from tracelens.operators import match
from tracelens.operators.match import match_one_to_one, match_summary

WINDOW = 30


def brute(left, right):
    pairs = sorted(
        (abs(lt - rt), lp, rp)
        for lk, lt, lp in left
        for rk, rt, rp in right
        if lk == rk and abs(lt - rt) <= WINDOW
    )
    used_l, used_r, out = set(), set(), set()
    for gap, lp, rp in pairs:
        if lp not in used_l and rp not in used_r:
            used_l.add(lp)
            used_r.add(rp)
            out.add((lp, rp, gap))
    return out


def frames(spark, left, right):
    schema = "key long, ts_ms long, pos long"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


@pytest.mark.parametrize("seed,span", [(1, 4000), (2, 300), (4, 60)])
def test_matches_equal_brute_force(spark, seed, span):
    rng = random.Random(seed)
    left = [(rng.choice([1, 1, 1, 2]), rng.randrange(span), i) for i in range(60)]
    right = [(rng.choice([1, 1, 1, 2]), rng.randrange(span), i) for i in range(60)]
    got = match_one_to_one(*frames(spark, left, right), WINDOW).collect()
    assert {tuple(r) for r in got} == brute(left, right)
    assert len(got) == len(brute(left, right))


def test_window_is_inclusive(spark):
    left, right = [(5, 0, 0), (6, 0, 1)], [(5, 30, 0), (6, 31, 1)]
    got = match_one_to_one(*frames(spark, left, right), WINDOW).collect()
    assert [tuple(r) for r in got] == [(0, 0, 30)]


def test_hot_moment_is_matched_in_rank_order(spark):
    left = [(1, 100, i) for i in range(50)]
    right = [(1, 100, i) for i in range(40)] + [(1, 101, 40 + i) for i in range(5)]
    got = match_one_to_one(*frames(spark, left, right), WINDOW).collect()
    assert {tuple(r) for r in got} == brute(left, right)


def test_summary_counts_both_sides(spark):
    left, right = frames(spark, [(5, 0, 0), (6, 0, 1), (None, 0, 2)], [(5, 30, 0), (6, 31, 1)])
    assert tuple(match_summary(left, right, match_one_to_one(left, right, WINDOW)).first()) == (1, 2, 1, 2)


@pytest.mark.parametrize("seed,span", [(1, 4000), (4, 60), (9, 12)])
def test_long_sessions_go_by_rounds_with_the_same_pairs(spark, monkeypatch, seed, span):
    monkeypatch.setattr(match, "TASK_ROWS", 0)
    rng = random.Random(seed)
    left, right = ([(rng.choice([1, 1, 1, 2]), rng.randrange(span), i) for i in range(40)] for _ in range(2))
    got = match_one_to_one(*frames(spark, left, right), WINDOW).collect()
    assert {tuple(r) for r in got} == brute(left, right)


def test_sessions_of_usual_size_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(match, "_parallel_rounds", None)
    left = [(k, 20 * t, 100 * k + t) for k in range(40) for t in range(20)]
    right = [(k, 20 * t + 10, 100 * k + t) for k in range(40) for t in range(20)]
    got = match_one_to_one(*frames(spark, left, right), WINDOW).collect()
    assert len(got) == 800
    assert {tuple(r) for r in got} == brute(left, right)


def test_greedy_equals_brute_force_in_dense_and_sparse_sessions():
    for seed in range(300):
        rng = random.Random(seed)
        span, n = rng.choice([3, 10, 40, 200, 1500]), rng.randrange(1, 40)
        left, right = ([(1, rng.randrange(span), i) for i in range(rng.randrange(1, n + 1))] for _ in range(2))
        rows = sorted((ts, side, pos) for side, part in enumerate((left, right)) for _, ts, pos in part)
        got = match._greedy(pd.DataFrame(rows, columns=["ts_ms", "side", "pos"]).assign(session=0), WINDOW)
        assert {tuple(map(int, r)) for r in got.itertuples(index=False)} == brute(left, right)
