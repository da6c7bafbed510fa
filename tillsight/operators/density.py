"""DBSCAN on Spark DataFrames, without a neighbour list of the points.

Points that lie at one place are counted once.  Places fall into cells of side
eps / sqrt(d), so any two in a cell are neighbours:

* a cell of at least ``min_samples`` points is dense; all its points are core, and its
  places never meet their own cell or another dense one point by point;
* a cell holds fewer than ``min_samples`` points otherwise.  Only these sparse places
  count their neighbours: up to ``KEYED_DIMS`` dimensions in the cells around, in a join
  that splits hot cells.  In more dimensions a place has most cells around it, so pairs of
  cells are never listed: blocks of places of bounded size meet in tasks of their own, which
  compare them tile by tile and send back one row per place or cell;
* the core places of one cell belong together, so clusters are components of a graph of
  cells.  Two dense cells are joined if their nearest places are within eps.  That is
  found by descent: boxes around the places are halved level by level; two boxes wholly
  within eps settle their cells, boxes wholly beyond eps drop out, the rest go on.

The comparison on every level is (difference squared, summed in column order) <= eps^2, and box bounds round
the same way as the points within them, so the result is that of comparing all points.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.plans.graph import component_roots
from tillsight.plans.ranking import global_rank
from tillsight.session import materialize

#: Dimensions whose surrounding cells are enumerated; the others are a condition of the join.
KEYED_DIMS = 3
#: Places of a cell that one join key holds.
CELL_ROWS = 4096
#: Blocks of places: as many as ``BLOCKS`` if that leaves ``SMALL_BLOCK`` rows to each, more only beyond ``LARGE_BLOCK`` rows.
SMALL_BLOCK, BLOCKS, LARGE_BLOCK = 4096, 12, 131_072
#: Places of a tile, within a task, and places that a tile is compared with at a time.
TILE, CHUNK = 256, 1024
#: Squared distances from the middle of a block, in eps, up to which its places are compared around that middle.
FAR = 256.0


def _far(lo_a: str, hi_a: str, lo_b: str, hi_b: str, d: int, least: bool) -> Column:
    """Squared least or greatest distance of two boxes given as arrays of bounds."""
    terms = []
    for i in range(d):
        one, two = F.col(lo_a)[i] - F.col(hi_b)[i], F.col(lo_b)[i] - F.col(hi_a)[i]
        gap = F.greatest(one, two, F.lit(0.0)) if least else F.greatest(-one, -two)
        terms.append(gap * gap)
    return reduce(lambda x, y: x + y, terms)


def _boxes(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Tight bounds of the places per key."""
    return df.groupBy(*keys).agg(F.array(*[F.min(c) for c in cols]).alias("lo"),
                                 F.array(*[F.max(c) for c in cols]).alias("hi"))


def _around(boxes: DataFrame, d: int, reach: int, eps2: float) -> DataFrame:
    """``(a, b, lo_a, hi_a, lo_b, hi_b)``: cells whose boxes come within eps, both ways, a <> b."""
    keyed = min(d, KEYED_DIMS)
    a = boxes.select(F.col("cell").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    for i in range(keyed):  # one small generator per dimension: all steps in one array are code beyond the compiler's limit
        a = a.withColumn(f"s{i}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    a = a.select("a", "lo_a", "hi_a", F.array(*[F.col("a")[i] + F.col(f"s{i}") for i in range(keyed)]).alias("k"))
    b = boxes.select(F.col("cell").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                     F.slice("cell", 1, keyed).alias("k"))
    near = _far("lo_a", "hi_a", "lo_b", "hi_b", d, True) <= F.lit(eps2)
    return a.join(b, "k").where((F.col("a") != F.col("b")) & near).drop("k")


def _touching(pairs: DataFrame, places: DataFrame, cols: list[str], side: float, eps2: float) -> DataFrame:
    """``(a, b)``: those pairs of cells, given with their boxes, that hold two places within eps."""
    d = len(cols)
    open_ = materialize(pairs.select("a", "b", F.col("a").alias("ka"), F.col("b").alias("kb"), "lo_a", "hi_a", "lo_b", "hi_b"))
    found, level, finer = None, 0, places.select("cell", F.col("cell").alias("key"), *cols)
    while True:
        judged = open_.withColumn("all_in", _far("lo_a", "hi_a", "lo_b", "hi_b", d, False) <= F.lit(eps2))
        settled = materialize(judged.where("all_in").select("a", "b").distinct())
        found = settled if found is None else found.unionByName(settled)
        left = materialize(open_.join(settled, ["a", "b"], "left_anti"))
        if not left.limit(1).count():
            return found
        # halve every box that is still asked for; a single place is its own box for good
        level += 1
        child = F.array(*[F.floor(F.col(c) / F.lit(side / 2.0 ** level)).cast("double") for c in cols])
        asked = left.select(F.col("ka").alias("key")).unionByName(left.select(F.col("kb").alias("key"))).distinct()
        finer = materialize(finer.join(asked, "key", "left_semi").select("cell", F.col("key").alias("parent"),
                                                                         child.alias("key"), *cols))
        parts = materialize(_boxes(finer, ["parent", "key"], cols))
        finer = finer.drop("parent")

        def side_of(s: str) -> DataFrame:
            return parts.select(F.col("parent").alias(f"k{s}"), F.col("key").alias(f"n{s}"),
                                F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))

        halves = left.select("a", "b", "ka", "kb").join(side_of("a"), "ka").join(side_of("b"), "kb")
        open_ = materialize(halves.where(_far("lo_a", "hi_a", "lo_b", "hi_b", d, True) <= F.lit(eps2)).select(
            "a", "b", F.col("na").alias("ka"), F.col("nb").alias("kb"), "lo_a", "hi_a", "lo_b", "hi_b"))


def _tiles(x: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Rows of ``x`` in tiles, halved along their longest side, and the tiles' bounds."""
    parts, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= TILE:
            parts.append(rows)
            continue
        here, half = x[rows], (len(rows) + TILE) // (2 * TILE) * TILE  # of full tiles, all but one
        order = np.argpartition(here[:, np.argmax(here.max(axis=0) - here.min(axis=0))], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return parts, np.array([x[p].min(axis=0) for p in parts]), np.array([x[p].max(axis=0) for p in parts])


def _exactly(x: np.ndarray, y: np.ndarray, eps2: float) -> np.ndarray:
    """Whether row i of ``x`` and row i of ``y`` are within eps."""
    sides = [x[:, i] - y[:, i] for i in range(x.shape[1])]
    return reduce(np.add, [s * s for s in sides]) <= eps2


def _factors(x: np.ndarray, mid: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left, right, squares)``: in units of eps and around ``mid``, row i of ``left`` times row j of
    ``right`` is the squared distance of rows i and j less 1; single precision."""
    x = (x - mid) / eps
    squares, ones = np.einsum("ij,ij->i", x, x), np.ones(len(x))
    return (np.column_stack([-2 * x, squares - 1, ones]).astype(np.float32),
            np.column_stack([x, ones, squares]).astype(np.float32), squares)


def _compared(x, y, i: np.ndarray, j: np.ndarray, eps2: float, at: np.ndarray, room: list) -> np.ndarray:
    """``mask[a, b]``: rows ``i[a]`` of x and ``j[b]`` of y are within eps.  Both come as coordinates and
    ``_factors``; ``at`` is a point amid those of x.

    One product of matrices gives all distances in single precision; pairs within its rounding error
    of eps are compared one by one."""
    m, r = len(i), len(j)
    left, right, top = x[1][i], y[2][j], x[3][i].max() + y[3][j].max()
    if not top < FAR:  # too far out for single precision: around their own middle
        (left, _, one), (_, right, two) = (_factors(c, at, math.sqrt(eps2)) for c in (x[0][i], y[0][j]))
        top = one.max() + two.max()
    doubt = np.float32(_doubt(x[0].shape[1], top))  # else the comparisons run in double precision
    gap = np.matmul(left, right.T, out=room[0][:m * r].reshape(m, r))
    within, beyond = room[1][:m * r].reshape(m, r), room[2][:m * r].reshape(m, r)
    np.less(gap, -doubt, out=within)
    np.greater(gap, doubt, out=beyond)
    settled = np.bitwise_count(np.packbits(within, axis=1) ^ np.packbits(beyond, axis=1)).sum(axis=1)
    odd = np.flatnonzero(settled < r)
    if len(odd):
        a, b = np.nonzero(~(within[odd] | beyond[odd]))
        within[odd[a], b] = _exactly(x[0][i[odd[a]]], y[0][j[b]], eps2)
    return within


def _doubt(d: int, squares):
    """Bound of the rounding error of a product of ``_factors`` whose squares have that sum."""
    return (d + 8) * 2.0 ** -22 * (squares + 1)


def _near_tiles(x: np.ndarray, y: np.ndarray, eps2: float, wanted=None):
    """``(rows of x, rows of y, mask)`` for tiles within eps, the nearest rows of y first; ``mask`` tells which
    of their places are within eps, or is None where all are.  The rows of both sides that still
    matter are asked of ``wanted(rows of x, rows of y)``, which returns rows and a mask, before they are compared."""
    (px, lx, hx), (py, ly, hy) = _tiles(x), _tiles(y)
    ask = wanted or (lambda i, j: (i, j))
    d, eps, mid = x.shape[1], math.sqrt(eps2), np.median(y, axis=0)
    order, lens = np.concatenate(py), [len(p) for p in py]
    xs, ys = (x, *_factors(x, mid, eps)), (y[order], *_factors(y[order], mid, eps))
    rounding = _doubt(d, ys[3]).astype(np.float32)
    room = [np.empty(TILE * CHUNK, np.float32), np.empty(TILE * CHUNK, bool), np.empty(TILE * CHUNK, bool)]

    def ask(i: np.ndarray, j: np.ndarray):
        if wanted is None:
            return i, j
        i, keep = wanted(i, order[j])
        return i, j[keep]

    for t, rows in enumerate(px):
        one, two = lx[t] - hy, ly - hx[t]
        gap, reach = np.maximum(np.maximum(one, two), 0.0), np.maximum(-one, -two)
        least, most = (reduce(np.add, [g[:, i] * g[:, i] for i in range(d)]) for g in (gap, reach))
        kind = np.where(most <= eps2, 2, least <= eps2)
        if not kind.any():
            continue
        if (kind == 2).any():
            i, j = ask(rows, np.flatnonzero(np.repeat(kind == 2, lens)))
            if len(i) and len(j):
                yield i, order[j], None
        # rows of the tiles around that may be within eps of this one's farthest place from its middle
        at = lx[t] / 2 + hx[t] / 2
        wide = math.sqrt(((x[rows] - at) ** 2).sum(axis=1).max()) / eps
        middle, _, square = _factors(at[None, :], mid, eps)
        far = ys[2] @ middle[0] - rounding
        within_reach = ~(far > np.float32((1 + wide) ** 2 * (1 + 1e-6) + _doubt(d, square[0]) - 1))
        some = np.flatnonzero(within_reach & np.repeat(kind == 1, lens))
        if wanted and len(some) > CHUNK:  # the nearest settle most
            some = some[np.argpartition(far[some], CHUNK)]
        for start in range(0, len(some), CHUNK):
            i, j = ask(rows, some[start:start + CHUNK])
            if len(i) and len(j):
                yield i, order[j], _compared(xs, ys, i, j, eps2, at, room)


def _blocks(left: DataFrame, right: DataFrame, cols: list[str], sizes: tuple[int, int], fn, schema: str) -> DataFrame:
    """``fn(left block, right block)`` of every two blocks; ``sizes`` are the rows of both sides."""
    nl, nr = (max(1, min(-(-n // SMALL_BLOCK), BLOCKS), -(-n // LARGE_BLOCK)) for n in sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    l = left.withColumn("_i", at(nl)).withColumn("_j", every(nr))
    r = right.withColumn("_j", at(nr)).withColumn("_i", every(nl))
    return l.groupBy("_i", "_j").cogroup(r.groupBy("_i", "_j")).applyInPandas(fn, schema)


def _counts(cols: list[str], eps2: float):
    def fn(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(l), dtype=np.int64)
        if len(l) and len(r):
            n = r["n"].to_numpy(np.int64)
            for a, b, mask in _near_tiles(l[cols].to_numpy(float), r[cols].to_numpy(float), eps2):
                if mask is None:
                    found[a] += n[b].sum()
                    continue
                found[a] += np.bitwise_count(np.packbits(mask, axis=1)).sum(axis=1, dtype=np.int64)
                many = np.flatnonzero(n[b] != 1)  # places that several points share
                if len(many):
                    found[a] += np.where(mask[:, many], n[b[many]] - 1, 0).sum(axis=1)
        return pd.DataFrame({"pid": l["pid"], "found": found})
    return fn


def _links(cols: list[str], eps2: float):
    """Edges of a forest over the cells that hold places within eps."""
    def fn(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([l["cid"].to_numpy(np.int64), r["cid"].to_numpy(np.int64)]))
        root = np.arange(len(ids))

        def hook(p: np.ndarray, q: np.ndarray):
            """Each larger root below the least it is paired with; every node points at a root again."""
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root[:] = root[root]

        if len(l) and len(r):
            ca, cb = np.searchsorted(ids, l["cid"].to_numpy(np.int64)), np.searchsorted(ids, r["cid"].to_numpy(np.int64))

            def apart(a: np.ndarray, b: np.ndarray):
                """Rows of one tree on both sides need no look."""
                ra = root[ca[a]]
                return a, (root[cb[b]] != ra[0] if (ra == ra[0]).all() else np.ones(len(b), bool))

            for a, b, mask in _near_tiles(l[cols].to_numpy(float), r[cols].to_numpy(float), eps2, apart):
                while True:
                    ra, rb = root[ca[a]], root[cb[b]]
                    meets = ra[:, None] != rb[None, :]
                    if mask is not None:
                        meets &= mask
                    i, j = np.flatnonzero(meets.any(axis=1)), np.flatnonzero(meets.any(axis=0))
                    if not len(i):
                        break
                    hook(np.concatenate([ra[i], ra[meets[:, j].argmax(axis=0)]]), np.concatenate([rb[meets[i].argmax(axis=1)], rb[j]]))
        tied = root != np.arange(len(ids))
        return pd.DataFrame({"ca": ids[tied], "cb": ids[root[tied]]})
    return fn


def _least_labels(cols: list[str], eps2: float):
    def fn(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        none = np.iinfo(np.int32).max
        best = np.full(len(l), none, dtype=np.int64)
        if len(l) and len(r):
            label = r["label"].to_numpy(np.int64)

            def better(a: np.ndarray, b: np.ndarray):
                """Only rows whose label can still fall, only places that can lower one."""
                a = a[best[a] > label[b].min()]
                return a, label[b] < best[a].max(initial=0)

            for a, b, mask in _near_tiles(l[cols].to_numpy(float), r[cols].to_numpy(float), eps2, better):
                if mask is None:
                    best[a] = np.minimum(best[a], label[b].min())
                    continue
                for one in np.unique(label[b]) if len(b) else ():
                    best[a[mask[:, label[b] == one].any(axis=1) & (best[a] > one)]] = one
        hit = best < none
        return pd.DataFrame({"pid": l["pid"].to_numpy()[hit], "label": best[hit]})
    return fn


def dbscan(df: DataFrame, eps: float, min_samples: int, id_col: str = "id", cols=None) -> DataFrame:
    """``(id_col, label)``: labels 0..k-1 by the smallest member id among the core points,
    noise -1.

    A core point has at least ``min_samples`` points within ``eps``, itself included; a
    point that is not core takes the smallest label among the core points within
    ``eps``.  Repeated places and rows count each.  Coordinates must be finite; a null one
    makes the point noise.  An empty table gives no rows.
    """
    cols = cols or [c for c in df.columns if c.startswith("s_")]
    d, eps2 = len(cols), float(eps) * float(eps)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.ceil(eps / side)
    points = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in cols])
    cell = F.array(*[F.floor(F.col(c) / F.lit(side)).cast("double") for c in cols])
    places = materialize(points.dropna(subset=cols).groupBy(*cols)
                         .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).withColumn("cell", cell))
    cells = materialize(places.groupBy("cell").agg(
        F.sum("n").alias("points"), F.count(F.lit(1)).alias("places"),
        F.array(*[F.min(c) for c in cols]).alias("lo"), F.array(*[F.max(c) for c in cols]).alias("hi"))
        .withColumn("dense", F.col("points") >= min_samples).withColumn("cid", F.monotonically_increasing_id()))
    wide = d > KEYED_DIMS
    near = materialize(_around(cells.where("dense") if wide else cells, d, reach, eps2))

    sparse = places.join(cells.where(~F.col("dense")).select("cell", "cid"), "cell")
    if wide:  # ids of places and cells instead of arrays; a place's own cell is within eps
        sparse = materialize(sparse.withColumn("pid", F.monotonically_increasing_id()))
        sizes = sparse.count(), places.count()
        found = _blocks(sparse.select("pid", *cols), places.select("n", *cols), cols, sizes, _counts(cols, eps2), "pid long, found long")
        counted = materialize(sparse.join(found.groupBy("pid").agg(F.sum("found").alias("found")), "pid")
                              .withColumn("core", F.col("found") >= min_samples))
    else:
        sparse = materialize(sparse)
        # sparse places against the cells around; hot cells are cut by place
        cuts = F.ceil(F.col("places") / F.lit(CELL_ROWS)).cast("int")
        kinds = cells.select("cell", "dense", cuts.alias("cuts"))
        probes = (sparse.select(F.col("cell").alias("a"), *[F.col(c).alias(f"p_{c}") for c in cols])
                  .join(near.select("a", F.col("b").alias("cell")), "a").join(kinds, "cell")
                  .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))))
        dealt = places.join(kinds, "cell").withColumn("cut", F.pmod(F.xxhash64(*cols), F.col("cuts")).cast("int"))
        d2 = reduce(lambda x, y: x + y, [(F.col(f"p_{c}") - F.col(c)) * (F.col(f"p_{c}") - F.col(c)) for c in cols])
        here = [f"p_{c}" for c in cols]
        met = probes.drop("dense").join(dealt.drop("cuts"), ["cell", "cut"]).where(d2 <= F.lit(eps2))
        others = met.groupBy(*here).agg(F.sum("n").alias("others")).select(*[F.col(f"p_{c}").alias(c) for c in cols], "others")
        own = cells.select("cell", "points")
        counted = materialize(sparse.join(own, "cell").join(others, cols, "left").withColumn(
            "core", F.col("points") + F.coalesce("others", F.lit(0)) >= min_samples))

    # cells that hold core places are the nodes
    sparse_core = materialize(counted.where("core").select("cell", "cid", *cols))
    core_cells = cells.where("dense").select("cell").unionByName(sparse_core.select("cell").distinct())
    dense = cells.where("dense").select("cell")
    dense_pairs = (near.where(F.col("a") < F.col("b")).join(dense.withColumnRenamed("cell", "a"), "a", "left_semi")
                   .join(dense.withColumnRenamed("cell", "b"), "b", "left_semi"))
    dense_places = places.join(dense, "cell", "left_semi")
    from_dense = _touching(dense_pairs, dense_places, cols, side, eps2)
    if wide:
        core_places = materialize(dense_places.join(cells.select("cell", "cid"), "cell").select("cell", "cid", *cols)
                                  .unionByName(sparse_core))
        cores = core_places.count()
        ties = materialize(_blocks(sparse_core.select("cid", *cols), core_places.select("cid", *cols), cols,
                                   (sparse_core.count(), cores), _links(cols, eps2), "ca long, cb long").distinct())
        from_sparse = (ties.join(cells.select(F.col("cid").alias("ca"), F.col("cell").alias("a")), "ca")
                       .join(cells.select(F.col("cid").alias("cb"), F.col("cell").alias("b")), "cb").select("a", "b"))
    else:
        core_places = (dealt.where("dense").select("cell", "cut", *cols)
                       .unionByName(sparse_core.select("cell", F.lit(0).alias("cut"), *cols)))
        every = (sparse.select(F.col("cell").alias("a"), *[F.col(c).alias(f"p_{c}") for c in cols])
                 .join(near.select("a", F.col("b").alias("cell")), "a").join(kinds, "cell")
                 .withColumn("cut", F.explode(F.sequence(F.lit(0), F.when(F.col("dense"), F.col("cuts") - 1).otherwise(0)))))
        reached = materialize(every.drop("dense", "cuts").join(core_places, ["cell", "cut"]).where(d2 <= F.lit(eps2))
                              .select(*[F.col(f"p_{c}").alias(c) for c in cols], "a", F.col("cell").alias("b")).distinct())
        from_sparse = reached.join(sparse_core.select(*cols), cols, "left_semi").select("a", "b")
    edges = from_dense.unionByName(from_sparse).unionByName(core_cells.select(F.col("cell").alias("a"), F.col("cell").alias("b")))
    roots = materialize(component_roots(edges))

    # a cluster is named by the smallest id among its core points
    core_first = dense_places.select("cell", "first").unionByName(
        counted.where("core").select("cell", "first")).groupBy("cell").agg(F.min("first").alias("first"))
    names = (core_first.join(roots.withColumnRenamed("node", "cell"), "cell").groupBy("root").agg(F.min("first").alias("first")))
    named = materialize(global_rank(names, ["first"], ["root"], rank_col="rank", n_col=None))
    by_cell = materialize(roots.join(named, "root").select(F.col("node").alias("cell"), (F.col("rank") - 1).cast("int").alias("label")))
    if wide:
        fringe = counted.where(~F.col("core")).select("pid", *cols)
        least = _blocks(fringe, core_places.join(by_cell, "cell").select("label", *cols), cols, (fringe.count(), cores),
                        _least_labels(cols, eps2), "pid long, label long")
        border = (least.groupBy("pid").agg(F.min("label").cast("int").alias("label")).join(fringe, "pid").select(*cols, "label"))
    else:
        border_cells = reached.select(*cols, F.col("b").alias("cell")).unionByName(
            # an own cell with a core place is in reach as well
            counted.where(~F.col("core")).join(sparse_core.select("cell").distinct(), "cell", "left_semi").select(*cols, "cell"))
        border = (border_cells.join(counted.where(~F.col("core")).select(*cols), cols, "left_semi").join(by_cell, "cell")
                  .groupBy(*cols).agg(F.min("label").alias("label")))
    labels = (dense_places.select("cell", *cols).unionByName(sparse_core.select("cell", *cols))
              .join(by_cell, "cell").select(*cols, "label").unionByName(border))
    return points.join(labels, cols, "left").select(
        F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
