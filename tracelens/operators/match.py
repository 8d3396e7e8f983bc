"""One-to-one matching of two event sets: equal key, time gap within a window, nearest pairs first."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracelens.operators.scan import running_last, with_neighbours, with_row_index
from tracelens.operators.skew import null_spread_join
from tracelens.session import materialise

CHUNK = 65_536                # ranks expanded per row when runs of matches become pairs
TASK_ROWS = 1_000_000         # rows of a session that one task may hold; longer sessions are matched by rounds


def match_one_to_one(left: DataFrame, right: DataFrame, window_ms: int) -> DataFrame:
    """Pairs ``(left_pos, right_pos, gap_ms)``.

    Both inputs carry ``(key, ts_ms, pos)`` with ``pos`` unique per side.  Pairs are taken in the
    total order ``(gap_ms, left_pos, right_pos)`` and each row is used at most once.

    Rows of one key whose neighbours in time are within the window form a session; no pair
    crosses sessions.  Sessions with a single row on one side are a plain aggregate.  Others of up to
    ``TASK_ROWS`` rows are each matched inside a task, longer ones, of whatever size, are reduced side
    by side by taking all locally best pairs per round until nothing is left.  No step lists all pairs.
    Tables that grow with the input are joined by their keys: as compressed files they can look small
    enough for a broadcast that the driver cannot hold.
    """
    rows = _sessions(left, right, window_ms)
    sizes = rows.groupBy("session").agg(
        F.sum(1 - F.col("side")).alias("n_left"), F.sum("side").alias("n_right")
    ).filter("n_left > 0 and n_right > 0")
    sizes = materialise(sizes)
    pairs = _single_sided(rows, sizes.filter("least(n_left, n_right) = 1"))
    several = sizes.filter("least(n_left, n_right) > 1")
    of = lambda some: rows.join(some.select("session").hint("merge"), "session")
    pairs = pairs.unionByName(_in_tasks(of(several.filter(F.col("n_left") + F.col("n_right") <= TASK_ROWS)), window_ms))
    long = several.filter(F.col("n_left") + F.col("n_right") > TASK_ROWS)
    if long.isEmpty():
        return pairs
    return pairs.unionByName(_parallel_rounds(of(long), window_ms))


def match_summary(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: rows of the left side that a pair confirms, those that none does, and rows of the right side alone; rows without key or time count."""
    counted = pairs.agg(F.count(F.lit(1)).alias("confirmed"))
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return counted.select("confirmed", (n(left) - F.col("confirmed")).alias("uncorroborated"), (n(right) - F.col("confirmed")).alias("only_right"), n(right).alias("n_right"))


def _sessions(left: DataFrame, right: DataFrame, window_ms: int) -> DataFrame:
    def side(df: DataFrame, code: int) -> DataFrame:
        return df.select("key", "ts_ms", F.lit(code).alias("side"), "pos").filter("key is not null and ts_ms is not null")

    rows = with_row_index(side(left, 0).unionByName(side(right, 1)), ["key", "ts_ms", "side", "pos"])
    rows = with_neighbours(rows, {"_prev_key": ("key", -1), "_prev_ts": ("ts_ms", -1)})
    starts = ~F.col("key").eqNullSafe(F.col("_prev_key")) | (F.col("ts_ms") - F.col("_prev_ts") > window_ms)
    return materialise(running_last(rows, {"session": F.when(starts, F.col("_g"))}).drop("_prev_key", "_prev_ts"))


def _single_sided(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Sessions with one row on a side: its partner is the nearest row of the other side.

    The single row's time is first put beside the session, so the long side is reduced by a
    map-side combined ``min``; the session itself may be of any length.
    """
    small_left = F.col("n_left") == 1
    lone = (
        rows.join(single.hint("merge"), "session")
        .filter(F.when(small_left, F.col("side") == 0).otherwise(F.col("side") == 1))
        .select("session", F.col("side").alias("lone_side"), F.col("ts_ms").alias("lone_ts"), F.col("pos").alias("lone_pos"))
    )
    gap = F.abs(F.col("ts_ms") - F.col("lone_ts"))
    left_pos = F.when(F.col("lone_side") == 0, F.col("lone_pos")).otherwise(F.col("pos"))
    right_pos = F.when(F.col("lone_side") == 0, F.col("pos")).otherwise(F.col("lone_pos"))
    best = (
        rows.join(lone.hint("merge"), "session")
        .filter("side <> lone_side")
        .groupBy("session")
        .agg(F.min(F.struct(gap.alias("gap_ms"), left_pos.alias("left_pos"), right_pos.alias("right_pos"))).alias("b"))
    )
    # neighbours in a session are within the window, so the nearest partner always is
    return best.select("b.left_pos", "b.right_pos", "b.gap_ms")


def _in_tasks(rows: DataFrame, window_ms: int) -> DataFrame:
    """Match sessions each inside one task, which reads them one after the other in the order of the row index."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"left_pos {kinds['pos']}, right_pos {kinds['pos']}, gap_ms {kinds['ts_ms']}"

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = batch["session"].iloc[-1]
            if held and held[-1]["session"].iloc[-1] == last:
                held.append(batch)
                continue
            cut = int(np.searchsorted(batch["session"].to_numpy(), last))
            yield _greedy(pd.concat([*held, batch.iloc[:cut]]), window_ms)
            held = [batch.iloc[cut:]]
        if held:
            yield _greedy(pd.concat(held), window_ms)

    # session is the index of its first row, so that rows in the order of the index are sessions in their order
    ordered = rows.repartition("session").sortWithinPartitions("_g").select("session", "ts_ms", "side", "pos")
    return ordered.mapInPandas(match, schema)


def _greedy(rows: pd.DataFrame, window_ms: int) -> pd.DataFrame:
    """The pairs of whole sessions, given by session, time, side and position: the best pair of adjacent moments is taken until none is left."""
    session, ts, side = (rows[c].to_numpy() for c in ("session", "ts_ms", "side"))
    pos = rows["pos"].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (session[1:] != session[:-1]) | (ts[1:] != ts[:-1]) | (side[1:] != side[:-1])
    first = np.flatnonzero(new)
    n = len(first)
    session, ts, is_left = session[first].tolist(), ts[first].tolist(), (side[first] == 0).tolist()
    used, end = first.tolist(), np.append(first[1:], len(rows)).tolist()
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]

    def gap(a: int, b: int) -> int | None:
        """The time between two neighbours that may be paired."""
        if a < 0 or b < 0 or is_left[a] == is_left[b] or session[a] != session[b]:
            return None
        return ts[b] - ts[a] if ts[b] - ts[a] <= window_ms else None

    def entry(a: int, b: int) -> tuple | None:
        apart = gap(a, b)
        if apart is None:
            return None
        left, right = (a, b) if is_left[a] else (b, a)
        return apart, pos[used[left]], pos[used[right]], a, b, used[a], used[b]

    queue = [e for e in (entry(a, a + 1) for a in range(n - 1)) if e]
    heapify(queue)
    runs = []
    while queue:
        apart, _, _, a, b, at_a, at_b = heappop(queue)
        if used[a] != at_a or used[b] != at_b or after[a] != b:
            continue
        rivals = gap(before[a], a), gap(b, after[b])
        clear = all(r is None or r > apart for r in rivals)
        k = min(end[a] - at_a, end[b] - at_b) if clear else 1
        runs.append((at_a, at_b, k, apart) if is_left[a] else (at_b, at_a, k, apart))
        used[a], used[b] = at_a + k, at_b + k
        low, high = a, b
        if used[a] == end[a]:
            low = before[a]
        if used[b] == end[b]:
            high = after[b]
        if low >= 0:
            after[low] = high
        if high >= 0:
            before[high] = low
        # a head that moved changes its entries on both sides
        ends = {(low, high)} | ({(before[a], a)} if low == a else set()) | ({(b, after[b])} if high == b else set())
        for pair in ends:
            again = entry(*pair)
            if again:
                heappush(queue, again)
    left, right, count, apart = (np.array(c, dtype=np.int64) for c in (zip(*runs) if runs else ([], [], [], [])))
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return pd.DataFrame({"left_pos": pos[np.repeat(left, count) + step], "right_pos": pos[np.repeat(right, count) + step], "gap_ms": np.repeat(apart, count)})


def _parallel_rounds(rows: DataFrame, window_ms: int) -> DataFrame:
    """Match sessions by rounds over *moments*: rows of one side with equal key and time.

    A moment is a queue in ``pos`` order of which the first ``used`` rows are taken.  In each
    round every pair of adjacent moments that is best for both ends matches: as many rows as the
    shorter queue holds when its gap is strictly the smallest, otherwise (equal gaps, ordered by
    position) only the two heads.  That is the order the total order prescribes, so the result
    does not depend on how the rounds are cut.
    """
    moment = ["session", "ts_ms", "side"]
    first = rows.groupBy(*moment).agg(F.min("_g").alias("start"), F.count(F.lit(1)).alias("n"))
    ranked = materialise(
        null_spread_join(
            rows.withColumn("mid", F.struct(*moment)), first.select(F.struct(*moment).alias("mid"), "start").hint("merge"), "mid", "inner"
        ).select(F.col("start").alias("moment"), (F.col("_g") - F.col("start")).alias("rank"), "pos")
    )
    live = materialise(first.select("session", "ts_ms", "side", F.col("start").alias("moment"), "n", F.lit(0).cast("long").alias("used")))
    runs = None
    while True:
        heads = live.join(
            ranked.withColumnsRenamed({"rank": "used", "pos": "head"}).hint("merge"), ["moment", "used"], "inner"
        )
        found = materialise(_best_runs(heads, window_ms))
        if found.isEmpty():
            break
        runs = found if runs is None else runs.unionByName(found)
        taken = found.select(F.col("l_moment").alias("moment"), "k").unionByName(found.select(F.col("r_moment").alias("moment"), "k"))
        live = materialise(
            live.join(taken.hint("merge"), "moment", "left")
            .withColumn("used", F.col("used") + F.coalesce("k", F.lit(0)))
            .drop("k")
            .filter("used < n")
        )
    if runs is None:
        return rows.limit(0).selectExpr("pos as left_pos", "pos as right_pos", "ts_ms as gap_ms")
    chunks = runs.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / CHUNK))))
    spread = chunks.repartition("l_moment", "c")
    each = spread.withColumn(
        "i",
        F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("k"), (F.col("c") + 1) * CHUNK) - 1)),
    ).select("gap_ms", "l_moment", (F.col("l_used") + F.col("i")).alias("l_rank"), "r_moment", (F.col("r_used") + F.col("i")).alias("r_rank"))
    left = ranked.toDF("l_moment", "l_rank", "left_pos")
    right = ranked.toDF("r_moment", "r_rank", "right_pos")
    return each.join(left.hint("merge"), ["l_moment", "l_rank"]).join(right.hint("merge"), ["r_moment", "r_rank"]).select("left_pos", "right_pos", "gap_ms")


def _best_runs(heads: DataFrame, window_ms: int) -> DataFrame:
    """Adjacent moments that are each other's best partner, with the number of rows to match.

    A moment's rivals are the nearest moments of the other side before and after it.  Two
    moments that choose each other are adjacent, so comparing a row with its successor is enough.
    """
    laid_out = with_row_index(heads, ["session", "ts_ms", "side"], "_h")
    spot = F.struct("_h", "session", "ts_ms", "head")
    mirrored = F.struct((-F.col("_h")).alias("_h"), "session", "ts_ms", "head")
    is_left = F.col("side") == 0
    seen = running_last(laid_out, {"before_l": F.when(is_left, spot), "before_r": F.when(~is_left, spot)}, "_h")
    seen = running_last(seen, {"after_l": F.when(is_left, mirrored), "after_r": F.when(~is_left, mirrored)}, "_h", True)

    def pairing(way: str) -> Column:
        other = F.when(is_left, F.col(f"{way}_r")).otherwise(F.col(f"{way}_l"))
        gap = F.abs(other["ts_ms"] - F.col("ts_ms"))
        return F.when(
            (other["session"] == F.col("session")) & (gap <= window_ms),
            F.struct(
                gap.alias("gap_ms"),
                F.when(is_left, F.col("head")).otherwise(other["head"]).alias("l"),
                F.when(is_left, other["head"]).otherwise(F.col("head")).alias("r"),
            ),
        )

    choices = seen.withColumns({"back": pairing("before"), "ahead": pairing("after")}).select(
        "_h", "session", "side", "moment", "n", "used", "back", "ahead", F.least("back", "ahead").alias("best")
    )
    near = with_neighbours(
        choices, {f"{c}_next": (c, 1) for c in ("best", "ahead", "moment", "used", "n")}, "_h"
    )
    mutual = near.filter((F.col("best") == F.col("ahead")) & (F.col("best") == F.col("best_next")))
    gap = F.col("best.gap_ms")
    clear = (F.col("back").isNull() | (F.col("back.gap_ms") > gap)) & (
        F.col("ahead_next").isNull() | (F.col("ahead_next.gap_ms") > gap)
    )
    rest = F.least(F.col("n") - F.col("used"), F.col("n_next") - F.col("used_next"))

    def by_side(left: str, right: str) -> Column:
        return F.when(is_left, F.col(left)).otherwise(F.col(right))

    return mutual.select(
        gap.alias("gap_ms"),
        by_side("moment", "moment_next").alias("l_moment"),
        by_side("used", "used_next").alias("l_used"),
        by_side("moment_next", "moment").alias("r_moment"),
        by_side("used_next", "used").alias("r_used"),
        F.when(clear, rest).otherwise(F.lit(1).cast("long")).alias("k"),
    )
