"""Closed tours, planned for all tours at once.

Distances stand in a table of matrices, a row for each tour: ``mat`` is the flat directed distance
matrix of its n nodes (index i * n + j, node 0 the base).  A matrix is made in its tour's row from
the tour's stops, right before the step that needs it, and never written; only road distances come
as pairs.  Tours of few nodes are planned many at a time, all starts of a tour together; the starts
of larger ones (``ord``, the nodes, base first) are dealt over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import params as P
from ..functions.geo import haversine_m
from .rounds import checkpointed

ACCEPT = 1e-6
FEW_NODES = 64  # tours of so many nodes are planned many at a time
CELLS = 200_000  # of the distance matrices of orders that are improved at a time


def stop_pairs(stops: DataFrame, base_lat: float, base_lng: float, most: int | None = None) -> DataFrame:
    """(tour_id, n, i, j, meters): straight distances between all nodes of a tour; node 0 is the base.

    ``stops``: tour_id, id, lat, lng.  ``most``: a limit of stops, such as that of online routing, beyond which tours are left out; there is none otherwise.
    """
    w = Window.partitionBy("tour_id")
    own = stops.withColumn("n", F.count("*").over(w) + 1)
    own = own.filter(F.col("n") <= most + 1) if most is not None else own
    own = own.select("tour_id", "n", F.row_number().over(w.orderBy("id")).cast("long").alias("i"), "lat", "lng")
    base = own.select("tour_id", "n").distinct().select("tour_id", "n", F.lit(0).cast("long").alias("i"), F.lit(base_lat).alias("lat"), F.lit(base_lng).alias("lng"))
    nodes = own.unionByName(base)
    other = nodes.select("tour_id", F.col("i").alias("j"), F.col("lat").alias("lat_j"), F.col("lng").alias("lng_j"))
    both = nodes.join(other, "tour_id")
    return both.select("tour_id", "n", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(haversine_m(F.col("lat"), F.col("lng"), F.col("lat_j"), F.col("lng_j"))).alias("meters"))


def fill_matrix(pairs: DataFrame, roads: DataFrame) -> DataFrame:
    """Road distance where there is one, else the straight one.  ``roads``: tour_id, i, j, road."""
    return pairs.join(roads, ["tour_id", "i", "j"], "left").withColumn("meters", F.coalesce("road", "meters")).drop("road")


def filled_matrices(lists: DataFrame, roads: DataFrame, base_lat: float, base_lng: float) -> DataFrame:
    """``straight_matrices`` with the road distance where there is one.  ``roads``: tour_id, road, a flat matrix as mat is, null where there is none.

    Roads that are dealt by tour, as the lists are, meet them without a shuffle; the lists, which are small, are held, and no matrix is sorted.
    """
    own = straight_matrices(lists.hint("shuffle_hash").join(roads.select("tour_id", "road"), "tour_id", "left"), base_lat, base_lng)
    return own.withColumn("mat", F.transform("mat", lambda m, x: F.coalesce(F.get("road", x), m)))


def matrices(pairs: DataFrame) -> DataFrame:
    """(tour_id, n, mat) from the pairs."""
    cell = F.struct(F.col("i"), F.col("j"), F.col("meters"))
    return pairs.groupBy("tour_id", F.col("n").cast("int").alias("n")).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["meters"]).alias("mat"))


def stop_lists(stops: DataFrame, *more: str) -> DataFrame:
    """(tour_id, n, s): the stops of a tour in one row, in the order of their ids, with n nodes, the base included.  ``s``: id, lat, lng and ``more``."""
    return stops.groupBy("tour_id").agg((F.count("*") + 1).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("id", "lat", "lng", *more))).alias("s"))


def straight_matrices(lists: DataFrame, base_lat: float, base_lng: float) -> DataFrame:
    """The rows of ``stop_lists`` with mat, the straight distances that ``stop_pairs`` gives."""
    base = F.struct(F.lit(base_lat).cast("double").alias("lat"), F.lit(base_lng).cast("double").alias("lng"))
    own = lists.withColumn("_at", F.concat(F.array(base), F.transform("s", lambda x: F.struct(x["lat"].cast("double").alias("lat"), x["lng"].cast("double").alias("lng")))))
    leg = lambda a, i, b, j: F.when(i == j, 0.0).otherwise(haversine_m(a["lat"], a["lng"], b["lat"], b["lng"]))
    return own.withColumn("mat", F.flatten(F.transform("_at", lambda a, i: F.transform("_at", lambda b, j: leg(a, i, b, j))))).drop("_at")


def _d(a: Column, b: Column) -> Column:
    return F.get("mat", a * F.col("n") + b)


def tour_length(order: Column) -> Column:
    """Length of the closed tour."""
    legs = F.transform(order, lambda x, i: _d(x, F.get(order, (i + 1) % F.size(order))))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)


def seed_tours(tours: DataFrame) -> DataFrame:
    """Adds ord: always to the nearest node not yet visited, the lowest index in a tie."""
    nodes = F.sequence(F.lit(0), F.col("n") - 1)

    def step(done: Column, _: Column) -> Column:
        left = F.filter(nodes, lambda j: ~F.array_contains(done, j))
        last = F.element_at(done, -1)
        return F.concat(done, F.array(F.array_min(F.transform(left, lambda j: F.struct(_d(last, j).alias("d"), j.alias("j"))))["j"]))

    return tours.withColumn("ord", F.aggregate(F.slice(nodes, 2, F.greatest(F.col("n") - 1, F.lit(0))), F.array(F.lit(0)), step))


def _apart(edges: Sequence[list[int] | slice], n: int) -> list[int]:
    """Which of the moves, the best first, may be made together: no two of them touch one edge of the tour."""
    used, chosen = np.zeros(n, bool), []
    for i, own in enumerate(edges):
        if not used[own].any():
            used[own] = True
            chosen.append(i)
    return chosen


def _best_per_row(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best move of each row that shortens the tour, the best rows first."""
    column = gain.argmin(1)
    best = gain[np.arange(len(gain)), column]
    rows = np.flatnonzero(best < -ACCEPT)
    rows = rows[np.argsort(best[rows], kind="stable")]
    return rows, column[rows]


def reverse_moves(m: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order after a round of reversals of stretches i..k, each of which shortens the directed tour."""
    n = len(order)
    nxt = np.roll(order, -1)
    ahead, back = m[order, nxt], m[nxt, order]
    ahead_sum, back_sum = (np.concatenate([[0.0], np.cumsum(x[:-1])]) for x in (ahead, back))
    i, k = np.arange(1, n - 1), np.arange(n)
    gain = m[order[i - 1][:, None], order] + m[order[i][:, None], nxt] - ahead[i - 1][:, None] - ahead + (back_sum - back_sum[i][:, None]) - (ahead_sum - ahead_sum[i][:, None])
    gain[k <= i[:, None]] = np.inf
    rows, last = _best_per_row(gain)
    first = i[rows]
    out = order.copy()
    for j in _apart([slice(f - 1, e + 1) for f, e in zip(first.tolist(), last.tolist(), strict=True)], n):
        out[first[j] : last[j] + 1] = order[first[j] : last[j] + 1][::-1]
    return out


def stop_moves(m: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order after a round of moves of single stops, each of which shortens the tour."""
    n = len(order)
    nxt, prev = np.roll(order, -1), np.roll(order, 1)
    ahead = m[order, nxt]
    i = np.arange(1, n)
    without = m[prev, nxt][i] - ahead[i - 1] - ahead[i]
    gain = m[order, order[i][:, None]] + m[order[i][:, None], nxt] - ahead + without[:, None]
    gain[np.arange(n - 1), i] = gain[np.arange(n - 1), i - 1] = np.inf
    rows, after = _best_per_row(gain)
    stop = i[rows]
    place = np.arange(n, dtype=float)
    for j in _apart([[s - 1, s, a] for s, a in zip(stop.tolist(), after.tolist(), strict=True)], n):
        place[stop[j]] = after[j] + 0.5
    return order[np.argsort(place, kind="stable")]


def _length(m: np.ndarray, order: np.ndarray) -> float:
    return float(m[order, np.roll(order, -1)].sum())


def _until_still(m: np.ndarray, order: np.ndarray, moves: Callable) -> np.ndarray:
    """Rounds of moves until none shortens the tour; every round but the last makes it shorter."""
    while len(order) >= 4:
        after = moves(m, order)
        if _length(m, after) >= _length(m, order) - ACCEPT / 2:
            break
        order = after
    return order


def _sum_of_legs(m: np.ndarray, order: np.ndarray) -> float:
    """``tour_length``: the legs one after the other."""
    return float(np.cumsum(m[order, np.roll(order, -1)])[-1])


def _seed(m: np.ndarray) -> np.ndarray:
    """``seed_tours`` of one matrix."""
    n = len(m)
    left, order = m.copy(), np.zeros(n, np.int64)
    left[:, 0] = np.inf
    for k in range(1, n):
        order[k] = left[order[k - 1]].argmin()
        left[:, order[k]] = np.inf
    return order


def seeded(tours: DataFrame) -> DataFrame:
    """(tour_id, n, ord, meters): the tours of ``seed_tours`` and their lengths, without the matrices."""
    kind = tours.schema["tour_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, meters = [], []
            for n, mat in zip(b.column("n").to_pylist(), b.column("mat"), strict=True):
                m = mat.values.to_numpy(zero_copy_only=False).reshape(n, n)
                out.append(_seed(m).astype(np.int32))
                meters.append(_sum_of_legs(m, out[-1]))
            yield pa.RecordBatch.from_arrays([b.column("tour_id"), b.column("n"), pa.array(out, pa.list_(pa.int32())), pa.array(meters, pa.float64())], ["tour_id", "n", "ord", "meters"])

    return tours.select("tour_id", F.col("n").cast("int").alias("n"), "mat").mapInArrow(run, f"tour_id {kind}, n int, ord array<int>, meters double")


def _chosen(gain: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    """(order, rows, columns) of the best move of each row that shortens the tour, the best rows first, for each of many orders."""
    column = gain.argmin(2)
    best = np.take_along_axis(gain, column[:, :, None], 2)[:, :, 0]
    ranked = np.argsort(best, axis=1, kind="stable")
    count = (best < -ACCEPT).sum(1)
    column = np.take_along_axis(column, ranked, 1)
    for b in np.flatnonzero(count).tolist():
        yield b, ranked[b, : count[b]].tolist(), column[b, : count[b]].tolist()


def _reversed_many(own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``reverse_moves`` of many orders; ``own``: the matrix of each, in its order."""
    size, n = order.shape
    turn = np.roll(own, -1, axis=2)  # [., i, k]: from i to the one after k
    here = np.arange(n)
    ahead, back = turn[:, here, here], np.roll(own, -1, axis=1)[:, here, here]
    ahead_sum, back_sum = (np.concatenate([np.zeros((size, 1)), np.cumsum(x[:, :-1], axis=1)], axis=1) for x in (ahead, back))
    i = np.arange(1, n - 1)
    gain = own[:, : n - 2] + turn[:, 1 : n - 1]
    gain -= ahead[:, i - 1, None]
    gain -= ahead[:, None]
    gain += back_sum[:, None] - back_sum[:, i, None]
    gain -= ahead_sum[:, None] - ahead_sum[:, i, None]
    gain[:, here <= i[:, None]] = np.inf
    place = np.tile(here, (size, 1))
    for b, rows, last in _chosen(gain):
        used = 0
        for f, e in zip(rows, last, strict=True):  # row f begins at f + 1
            edges = (1 << (e + 1)) - (1 << f)
            if not used & edges:
                used |= edges
                place[b, f + 1 : e + 1] = here[f + 1 : e + 1][::-1]
    return np.take_along_axis(order, place, 1)


def _moved_many(own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``stop_moves`` of many orders; ``own``: the matrix of each, in its order."""
    size, n = order.shape
    turn = np.roll(own, -1, axis=2)
    here = np.arange(n)
    ahead = turn[:, here, here]
    i = np.arange(1, n)
    without = own[:, i - 1, (i + 1) % n] - ahead[:, i - 1] - ahead[:, i]
    gain = own.transpose(0, 2, 1)[:, 1:] + turn[:, 1:]
    gain -= ahead[:, None]
    gain += without[:, :, None]
    gain[:, i - 1, i] = gain[:, i - 1, i - 1] = np.inf
    place = np.tile(here.astype(float), (size, 1))
    for b, rows, after in _chosen(gain):
        used = 0
        for r, a in zip(rows, after, strict=True):  # row r moves stop r + 1
            edges = 1 << r | 1 << (r + 1) | 1 << a
            if not used & edges:
                used |= edges
                place[b, r + 1] = a + 0.5
    return np.take_along_axis(order, np.argsort(place, axis=1, kind="stable"), 1)


def _improve_many(flat: np.ndarray, of: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orders, meters) after the phases of ``improve_tours``: order b belongs to the matrix ``flat[of[b]]``; each order goes its own way."""
    n = orders.shape[1]
    flat = flat.reshape(len(flat), n * n)
    length = lambda of, order: flat[of[:, None], order * n + np.roll(order, -1, axis=1)].sum(1)
    orders = orders.copy()
    for moves in (_reversed_many, _moved_many, _reversed_many) if n >= 4 else ():
        open_ = np.arange(len(orders))
        meters = length(of, orders)
        while len(open_):
            now, mine = orders[open_], of[open_]
            after = moves(flat[mine[:, None, None], now[:, :, None] * n + now[:, None]], now)
            new = length(mine, after)
            better = new < meters[open_] - ACCEPT / 2
            open_ = open_[better]
            orders[open_], meters[open_] = after[better], new[better]
    return orders, length(of, orders)


def _shuffled(n: Column, restarts: int | None, seed: int) -> Column:
    """The shuffled starts of a tour: see ``starts``."""
    many = F.lit(restarts) if restarts is not None else F.when(n <= 12, 40).when(n <= 40, 12).otherwise(4)
    key = lambda x, r: F.xxhash64(F.lit(seed), F.col("tour_id"), x, r)
    one = lambda r: F.concat(F.array(F.lit(0)), F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), n - 1), lambda x: F.struct(key(x, r).alias("h"), x.alias("x")))), lambda s: s["x"]))
    return F.when((many > 0) & (n > 1), F.transform(F.sequence(F.lit(1), many), one)).otherwise(F.array().cast("array<array<int>>"))


def _planned_few(tours: DataFrame, restarts: int | None, seed: int = 7) -> DataFrame:
    """(tour_id, ids, ord, meters) of tours of few nodes (tour_id, n, ids, first, mat): what ``improve_tours`` and ``priority_reorder`` make of them."""
    rows = tours.select("tour_id", "n", "ids", "first", "mat", _shuffled(F.col("n"), restarts, seed).alias("again"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def planned(n: int, mats: np.ndarray, again: list[np.ndarray], firsts: list[list]) -> Iterator[tuple[np.ndarray, float]]:
        for lo in range(0, len(mats), step := max(1, CELLS // (n * n * (1 + len(again[0]))))):
            part = slice(lo, lo + step)
            own = [np.concatenate([_seed(m)[None], a]) for m, a in zip(mats[part], again[part], strict=True)]
            of = np.repeat(np.arange(len(own)), [len(a) for a in own])
            orders, meters = _improve_many(mats[part], of, np.concatenate(own))
            edges = np.append(0, np.cumsum([len(a) for a in own])).tolist()
            for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                best = i + int(np.argmin(np.round(meters[i:j], 6)))  # the first of equal ones
                m = mats[lo + k]
                order = np.array(_prioritized(m, firsts[lo + k], orders[best].tolist()), np.int32)
                yield order, _sum_of_legs(m, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("n").to_numpy()
            out: list = [None] * b.num_rows
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                some = b.take(pa.array(own))
                mats = some.column("mat").flatten().to_numpy(zero_copy_only=False).reshape(-1, n, n)
                again = some.column("again").flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1, n).astype(np.int64)
                for i, got in zip(own.tolist(), planned(n, mats, list(again), some.column("first").to_pylist()), strict=True):
                    out[i] = got
            orders = pa.array([x[0] for x in out], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("tour_id"), b.column("ids"), orders, pa.array([x[1] for x in out], pa.float64())], ["tour_id", "ids", "ord", "meters"])

    return rows.mapInArrow(run, f"tour_id {kinds['tour_id']}, ids {kinds['ids']}, ord array<int>, meters double")


def _prioritized(m: np.ndarray, first: list, order: list[int]) -> list[int]:
    """``order`` after passes of ``priority_round`` until one changes nothing."""
    n, changed = len(order), True
    while changed and n >= 3:
        changed = False
        for p in range(1, n - 1):
            x, y = order[p], order[p + 1]
            if first[y] and first[x] is False:
                a, b = order[p - 1], order[(p + 2) % n]
                budget = m[a, x] * P.PRIORITY_TOLERANCE
                if m[a, y] - m[a, x] <= budget and m[a, y] + m[x, b] - m[a, x] - m[y, b] <= budget:
                    order[p], order[p + 1] = y, x
                    changed = True
    return order


def _improved(orders: DataFrame, tours: DataFrame, phases: Sequence[Callable]) -> DataFrame:
    """``orders`` (tour_id, restart, ord) after the phases, and meters."""
    kind = orders.schema["tour_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, meters = [], []
            for n, mat, order in zip(b.column("n").to_pylist(), b.column("mat"), b.column("ord"), strict=True):
                m, own = mat.values.to_numpy(zero_copy_only=False).reshape(n, n), order.values.to_numpy(zero_copy_only=False)
                for moves in phases:
                    own = _until_still(m, own, moves)
                out.append(own.astype(np.int32))
                meters.append(_length(m, own))
            yield pa.RecordBatch.from_arrays([b.column("tour_id"), b.column("restart"), pa.array(out, pa.list_(pa.int32())), pa.array(meters, pa.float64())], ["tour_id", "restart", "ord", "meters"])

    both = orders.join(tours.select("tour_id", "n", "mat"), "tour_id").select("tour_id", "restart", "n", "mat", "ord")
    return both.mapInArrow(run, f"tour_id {kind}, restart int, ord array<int>, meters double")


def starts(tours: DataFrame, restarts: int | None = None, seed: int = 7) -> DataFrame:
    """(tour_id, restart, ord): the nearest-node tour as restart 0, and shuffled ones.

    Their number follows the tour's size unless given: 40 to 12 nodes, 12 to 40, else 4.
    """
    own = seed_tours(tours).select("tour_id", "n", "ord", F.lit(0).alias("restart"))
    many = F.lit(restarts) if restarts is not None else F.when(F.col("n") <= 12, 40).when(F.col("n") <= 40, 12).otherwise(4)
    again = own.withColumn("restart", F.explode(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))))
    key = lambda x: F.xxhash64(F.lit(seed), F.col("tour_id"), x, F.col("restart"))
    rest = F.array_sort(F.transform(F.slice("ord", 2, F.greatest(F.col("n") - 1, F.lit(0))), lambda x: F.struct(key(x).alias("h"), x.alias("x"))))
    again = again.withColumn("ord", F.concat(F.array(F.lit(0)), F.transform(rest, lambda s: s["x"])))
    return own.unionByName(again).select("tour_id", "restart", "ord")


def improve_tours(tours: DataFrame, restarts: int | None = None, seed: int = 7) -> DataFrame:
    """(tour_id, n, mat, ord, meters): the best of a nearest-node seed and shuffled restarts, each improved until nothing shortens it.

    Reversals of stretches, moves of single stops, and reversals again.  A round makes all moves
    that touch no common edge, so that their gains add up; the rounds of an order end when it has no
    move left, however many they are.  Work of a round and memory of a task grow with a tour's
    matrix; tours and their restarts are dealt over the tasks.
    """
    orders = checkpointed(starts(tours, restarts, seed))
    parts = max(orders.sparkSession.sparkContext.defaultParallelism, orders.rdd.getNumPartitions())
    done = _improved(orders.repartition(parts, "tour_id", "restart"), tours, (reverse_moves, stop_moves, reverse_moves))
    best = done.groupBy("tour_id").agg(F.min_by(F.struct("ord", "meters"), F.struct(F.round("meters", 6).alias("m"), F.col("restart").alias("r"))).alias("b"))
    return tours.select("tour_id", "n", "mat").join(best.select("tour_id", "b.*"), "tour_id")


def priority_round(df: DataFrame) -> DataFrame:
    """One pass over the order: a parcel stop goes ahead of the other kind before it when that costs little.

    ``first``: a boolean for each node.  Left to right, each swap seen by the next.
    """
    n = F.col("n")

    def step(order: Column, p: Column) -> Column:
        a, x, y, b = F.get(order, p - 1), F.get(order, p), F.get(order, p + 1), F.get(order, (p + 2) % n)
        budget = _d(a, x) * P.PRIORITY_TOLERANCE
        near = _d(a, y) - _d(a, x)
        loop = _d(a, y) + _d(x, b) - _d(a, x) - _d(y, b)
        swap = F.get("first", y) & ~F.get("first", x) & (near <= budget) & (loop <= budget)
        return F.when(swap, F.concat(F.slice(order, F.lit(1), p), F.array(y, x), F.slice(order, p + 3, n))).otherwise(order)

    after = F.aggregate(F.sequence(F.lit(1), n - 2), F.col("ord"), step)
    return df.withColumn("_after", after).withColumn("changed", F.col("_after") != F.col("ord")).withColumn("ord", F.col("_after")).drop("_after")


def priority_reorder(df: DataFrame) -> DataFrame:
    """Passes of ``priority_round`` over every tour until one changes nothing; each swap brings a parcel stop ahead of another, so they end."""
    columns = [c for c in df.columns if c not in ("n", "mat", "first", "ord")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n", "first", "ord")), b.column("mat"), strict=True)
            out = [_prioritized(mat.values.to_numpy(zero_copy_only=False).reshape(n, n), first, order) for n, first, order, mat in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), b.column("n"), pa.array(out, pa.list_(pa.int32()))], [*columns, "n", "ord"])

    own = df.select(*columns, F.col("n").cast("int").alias("n"), "mat", "first", F.col("ord").cast("array<int>").alias("ord"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*columns, "n", "ord")))


def plan_tours(stops: DataFrame, base_lat: float, base_lng: float, roads: DataFrame | None = None, restarts: int | None = None) -> DataFrame:
    """(tour_id, id, position, meters, provider, skipped): planned order of every tour's stops.

    ``stops``: tour_id, id, lat, lng, priority.  A stop without coordinates is skipped: it has no
    position.  Tours whose stops are all skipped have 0 meters.
    """
    usable = stops.filter("lat is not null and lng is not null")
    own = checkpointed(stop_lists(usable, "priority"))
    if roads is None:
        own = straight_matrices(own, base_lat, base_lng)
    else:
        own = own.join(matrices(fill_matrix(stop_pairs(usable, base_lat, base_lng, None), roads)).select("tour_id", "mat"), "tour_id")
    own = own.select("tour_id", "n", F.transform("s", lambda x: x["id"]).alias("ids"), F.concat(F.array(F.lit(False)), F.transform("s", lambda x: x["priority"])).alias("first"), "mat")
    done = _planned_few(own.filter(F.col("n") <= FEW_NODES), restarts)
    many = own.filter(F.col("n") > FEW_NODES)
    if not many.isEmpty():
        many = checkpointed(many)
        best = improve_tours(many.select("tour_id", "n", "mat"), restarts).join(many.select("tour_id", "ids", "first"), "tour_id")
        best = priority_reorder(best.drop("meters"))
        best = best.join(many.select("tour_id", "mat"), "tour_id")
        done = done.unionByName(best.select("tour_id", "ids", "ord", tour_length(F.col("ord")).alias("meters")))
    own = checkpointed(done)
    order = own.select("tour_id", "meters", "ids", F.posexplode("ord").alias("position", "node")).filter("node > 0")
    placed = order.select("tour_id", F.get("ids", F.col("node") - 1).alias("id"), F.col("position").cast("long").alias("position"), "meters", F.lit(False).alias("skipped"))
    left = stops.filter("lat is null or lng is null").select("tour_id", "id").join(own.select("tour_id", "meters"), "tour_id", "left")
    left = left.select("tour_id", "id", F.lit(None).cast("long").alias("position"), F.coalesce("meters", F.lit(0.0)).alias("meters"), F.lit(True).alias("skipped"))
    return placed.unionByName(left).withColumn("provider", F.lit("straight" if roads is None else "osrm"))


def provider_ladder(tours: DataFrame) -> DataFrame:
    """(tour_id, provider): the first way that a tour can take.

    ``tours``: tour_id, stops, and whether optimized, road and trip results are there.
    """
    way = F.when(F.col("optimized") & (F.col("stops") <= P.MAX_JOBS), "ors").when(F.col("road") & (F.col("stops") <= P.MAX_OWN_STOPS), "osrm").when(F.col("trip"), "trip").otherwise("straight")
    return tours.select("tour_id", way.alias("provider"))
