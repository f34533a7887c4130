"""Near vectors found through pivots, so that only cells that can hold a neighbour are compared.

Every vector is at home in the cell of its nearest pivot. By the triangle inequality a neighbour within r of x
is in a cell only if x is no farther from its pivot than the cell's radius plus r, and no more than 2 r
farther than from its own pivot. Cells are gathered to at most PARTS parts, and x goes once to every part with
such a cell, so that what is shuffled grows with the vectors also where the pivots save nothing. Within a part x
is compared by matrix products with those cells only, and what leaves a task is one row for each
vector that asks there, whatever the number of its neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photoflow.operators.graph import connected_components
from photoflow.scratch import materialize

#: vectors of a block, and the most pivots: what the driver and every task hold of them is at most MOST_PIVOTS vectors
BLOCK, MOST_PIVOTS = 1000, 4096
#: vectors of a cell on average, while there are fewer than MOST_PIVOTS
PER_CELL = 100
#: most parts, and slices in which the vectors that ask in a part are dealt out to tasks
PARTS, SLICES = 32, 4


def _rows(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, payload) of a block."""
    rows = cell.values
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    return ids, rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1), rows.field("f").to_numpy(zero_copy_only=False)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of prepared vectors: unit ones for cosine."""
    return 1 - x @ y.T if metric == "cosine" else euclidean(x, y)


@dataclass
class Cells:
    """Vectors (id, v, f, cell, at) at home in the cells of pivots; v is prepared for the metric."""

    homes: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    slack: float
    metric: str
    #: number of parts, the part of every share of a cell, and the first share of each cell and one behind the last
    parts: int
    part: np.ndarray
    first: np.ndarray

    def reach(self, eps: float) -> float:
        """The Euclidean distance that a distance of the metric is at most."""
        return (math.sqrt(2 * max(eps, 0)) if self.metric == "cosine" else eps) + self.slack


def cells(vectors: DataFrame, metric: str, most_pivots: int = MOST_PIVOTS) -> Cells:
    """Deal vectors (id, v, f) out to the cells of one in PER_CELL of them, those of the smallest hashes of ids."""
    n = vectors.count()
    take = min(most_pivots, max(1, math.ceil(n / PER_CELL)))
    chosen = vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(take).collect()
    pivots = np.array([r.v for r in chosen], float) if chosen else np.zeros((0, 1))
    pivots = unit(pivots) if metric == "cosine" else pivots

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = unit(x) if metric == "cosine" else x
            d = euclidean(x, pivots)
            cell = d.argmin(1)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, batch.column(2), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])], names=["id", "v", "f", "cell", "at"])

    homes = materialize(vectors.select("id", "v", F.col("f").cast("long").alias("f")).mapInArrow(home, "id long, v array<double>, f long, cell int, at double"), "homes")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in homes.groupBy("cell").agg(F.max("at").alias("r"), F.count("*").alias("n")).collect():  # a row for each pivot
        radius[r.cell], size[r.cell] = r.r, r.n
    slack = 1e-6 * (1 + float(np.linalg.norm(pivots, axis=1).max(initial=0) + radius.max(initial=0)))
    parts = min(PARTS, max(1, math.ceil(n / (4 * BLOCK))))
    shares = np.maximum(1, np.ceil(size * parts / max(n, 1))).astype(np.int64)  # of a cell that would be more than a part
    of = np.repeat(np.arange(len(pivots)), shares)
    return Cells(homes, pivots, radius, size, slack, metric, parts, _gather(pivots[of], (size / shares)[of], parts), np.concatenate([[0], np.cumsum(shares)]))


def _gather(x: np.ndarray, size: np.ndarray, parts: int) -> np.ndarray:
    """The part of every weighted point: halves along the direction in which points differ most, until there are `parts`."""
    out = np.zeros(len(x), np.int64)

    def cut(rows: np.ndarray, first: int, parts: int) -> None:
        out[rows] = first
        if parts == 1 or len(rows) < 2:
            return
        y = x[rows] - x[rows].mean(0)
        rows = rows[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")]
        done = np.cumsum(size[rows])
        at = min(max(int(np.searchsorted(done, done[-1] * (parts // 2) / parts)) + 1, 1), len(rows) - 1)
        cut(rows[:at], first, parts // 2)
        cut(rows[at:], first + parts // 2, parts - parts // 2)

    cut(np.arange(len(x)), 0, parts)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _near_cells(c: Cells, x: np.ndarray, home: np.ndarray, r: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether a cell of `among` can hold a vector within r of each x, whose home is given."""
    d = euclidean(x, c.pivots[among])
    own = np.linalg.norm(x - c.pivots[home], axis=1)
    to = (c.size[among] > 0)[None] & (d <= c.radius[among][None] + r[:, None]) & (d <= own[:, None] + 2 * r[:, None] + c.slack)
    return to | (among[None] == home[:, None])


def guests(c: Cells, radius: float | None = None) -> DataFrame:
    """(id, v, f, cell, r, own, parts): every vector of c.homes with its part and the parts that can hold one within radius (or within their column `r`)."""
    rows = c.homes.select("id", "v", "f", "cell", "r" if radius is None else F.lit(float(radius)).alias("r"))
    light = _bare(c)
    every, at = np.arange(len(c.pivots)), np.repeat(np.arange(len(c.pivots)), np.diff(c.first))
    holds = np.zeros((len(c.pivots), c.parts), np.float32)
    holds[at, c.part] = 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(s, BLOCK)
                ids, x, home, r = batch.column(0).to_numpy(), _vectors(batch.column(1)), batch.column(3).to_numpy(), batch.column(4).to_numpy()
                share = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.diff(light.first)[home]
                to = _near_cells(light, x, home, r, every).astype(np.float32) @ holds > 0
                who, part = np.nonzero(to)
                ends = np.searchsorted(who, np.arange(len(ids) + 1)).astype(np.int32)
                columns = [*batch.columns, pa.array(light.part[light.first[home] + share], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(part, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "f", "cell", "r", "own", "parts"])

    return rows.mapInArrow(place, "id long, v array<double>, f long, cell int, r double, own int, parts array<int>")


def _bare(c: Cells) -> Cells:
    """What tasks need of the cells."""
    return replace(c, homes=None)


def _blocks(rows: DataFrame) -> DataFrame:
    """(cell, blk, m): rows (cell, id, v, f) of each cell dealt out to blocks of about BLOCK."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    dealt = rows.join(sizes, "cell").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")))
    return dealt.groupBy("cell", "blk").agg(F.collect_list(F.struct("id", "v", "f")).alias("m"))


def meet_parts(c: Cells, homes: DataFrame, asked: DataFrame, where: str, begin: Callable, meet: Callable, end: Callable, schema: str) -> DataFrame:
    """Rows of end(state) for blocks of `asked`; state = begin(ids, vectors, f), and meet(state, ids, vectors, f) for blocks of the homes near them.

    Both are rows of guests. Each asks in its own part, in all its parts, or in those other than or above its own
    (`where`). A task holds the homes of one part; those that ask there pass by, sorted by cells.
    """
    light, slices = _bare(c), 1 if where == "own" or c.parts == 1 else SLICES
    at = {"own": F.array("own"), "all": F.col("parts"), "others": F.filter("parts", lambda p: p != F.col("own")), "above": F.filter("parts", lambda p: p > F.col("own"))}[where]
    columns = ["cell", "id", "v", F.col("f").cast("long").alias("f"), "r"]
    there = homes.select(F.col("own").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), *columns)
    asks = asked.select(F.explode(at).alias("part"), F.pmod(F.col("cell") + F.col("own"), F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), *columns)
    both = there.unionByName(asks).repartition(c.parts * slices, "part", "slice").sortWithinPartitions("part", "slice", "kind", "cell")

    def ask(home: tuple, rows: tuple) -> Iterator[pa.RecordBatch]:
        hcell, hids, hx, hf = home
        among, no = np.unique(hcell, return_inverse=True)
        for s in range(0, len(rows[0]), BLOCK):
            cell, ids, x, f, r = (c[s : s + BLOCK] for c in rows)
            to = _near_cells(light, x, cell, r, among)
            if to[:, to.any(0)].mean() > 0.5 if to.any() else True:
                groups = [np.ones(len(ids), bool)]
            else:
                groups = [cell == k for k in np.unique(cell)]
            for own in groups:
                near = np.flatnonzero(to[own].any(0)[no])
                state = begin(ids[own], x[own], f[own])
                for t in range(0, len(near), 2 * BLOCK):
                    some = near[t : t + 2 * BLOCK]
                    meet(state, hids[some], hx[some], hf[some])
                if (out := end(state)) is not None:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, home = None, [], None
        for batch in batches:
            code = batch.column(0).to_numpy().astype(np.int64) * slices + batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(code * 2 + kind)) + 1
            for a, b in zip([0, *edges], [*edges, len(code)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                rows = tuple(_vectors(part.column(k)) if k == 5 else part.column(k).to_numpy() for k in range(3, 8))
                if code[a] != key:
                    key, held, home = code[a], [], None
                if kind[a] == 0:
                    held.append(rows[:4])
                elif held:
                    home = home or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    yield from ask(home, rows)

    return both.mapInArrow(run, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def compared(c: Cells, eps: float) -> tuple[int, int]:
    """(pairs of vectors whose cells meet, all pairs), for a look at what the pivots save."""
    light, r, every = _bare(c), c.reach(eps), np.arange(len(c.pivots))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = _near_cells(light, _vectors(batch.column(0)), batch.column(1).to_numpy(), np.full(batch.num_rows, r), every)
                yield _batch(n=np.array([int((to @ light.size).sum())]))

    met = c.homes.select("v", "cell").mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
    return int(met or 0), int(c.size.sum()) ** 2


def degrees(c: Cells, placed: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, n): weight f of all vectors within eps of each, itself included; counting stops beyond `least`.

    Only vectors that their own part does not make core ask in others.
    """
    metric = c.metric

    def begin(ids, x, w):
        return {"id": ids, "x": x, "n": w.copy(), "w": w}

    def meet(s, ids, y, w):
        if (s["n"] >= least).all():
            return
        near = distances(s["x"], y, metric) <= eps
        near[s["id"][:, None] == ids[None]] = False
        s["n"] += (near @ w.astype(float)).astype(np.int64)

    def end(s):
        return _batch(id=s["id"], n=s["n"])

    def more(s):
        return _batch(id=s["id"], n=s["n"] - s["w"])

    own = meet_parts(c, placed, placed, "own", begin, meet, end, "id long, n long")
    if c.parts == 1:
        return own
    own = materialize(own, "degrees")
    asked = placed.join(own.where(F.col("n") < least).select("id"), "id", "left_semi")
    seen = meet_parts(c, placed, asked, "others", begin, meet, more, "id long, n long")
    return own.unionByName(seen).groupBy("id").agg(F.sum("n").alias("n"))


def _bipartite(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a 0/1 matrix the number of the first row of their component; the number of rows where there is none."""
    none = len(a)
    low = np.where(a.any(1), np.arange(none), none)
    while True:
        col = np.where(a, low[:, None], none).min(0, initial=none)
        new = np.minimum(low, np.where(a, col[None], none).min(1, initial=none))
        if (new == low).all():
            return low, col
        low = new


def links(c: Cells, placed: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """(a, b): links between cores (id) within eps, as many as connect what blocks hold together, not all pairs.

    Cores of one part are linked first. Those of different parts are compared only where the links so far leave
    them in different components.
    """
    metric = c.metric
    rows = materialize(placed.join(core.select("id"), "id", "left_semi"), "placed-cores")

    def begin(ids, x, f):
        return {"id": ids, "x": x, "f": f, "a": [], "b": []}

    def meet(s, ids, y, _):
        low, col = _bipartite(distances(s["x"], y, metric) <= eps)
        own = np.append(s["id"], 0)
        a, b = np.concatenate([s["id"], ids]), own[np.concatenate([low, col])]
        kept = (np.concatenate([low, col]) < len(s["id"])) & (a != b)
        s["a"].append(a[kept])
        s["b"].append(b[kept])

    def end(s):
        return _batch(a=np.concatenate(s["a"]), b=np.concatenate(s["b"])) if sum(map(len, s["a"])) else None

    own = meet_parts(c, rows, rows, "own", begin, meet, end, "a long, b long")
    if c.parts == 1:
        return own
    own = materialize(own, "links")
    comp = connected_components(own)
    rows = rows.join(comp, F.col("id") == F.col("node"), "left").withColumn("f", F.coalesce("component", "id")).drop("node", "component")
    rows = materialize(rows, "part-components")
    over: dict[int, int] = {}  # of a task: the component that another one was found to belong to

    def root(k: int) -> int:
        while k in over:
            k = over[k]
        return k

    def roots(f: np.ndarray) -> np.ndarray:
        some, no = np.unique(f, return_inverse=True)
        return np.array([root(int(k)) for k in some])[no]

    def across(s, ids, y, f):
        ra, rb = roots(s["f"]), roots(f)
        most, number = np.unique(np.concatenate([ra, rb]), return_counts=True)
        great = most[number.argmax()]  # two of the greatest component need no comparison
        for rows, cols in ((np.flatnonzero(ra != great), np.arange(len(rb))), (np.flatnonzero(ra == great), np.flatnonzero(rb != great))):
            if not len(rows) or not len(cols):
                continue
            i, j = np.nonzero((distances(s["x"][rows], y[cols], metric) <= eps) & (ra[rows][:, None] != rb[cols][None]))
            _, one = np.unique(np.stack([ra[rows][i], rb[cols][j]]), axis=1, return_index=True)
            for p, q in zip(rows[i[one]], cols[j[one]], strict=True):
                u, v = root(int(ra[p])), root(int(rb[q]))
                if u != v:
                    over[max(u, v)] = min(u, v)
                    s["a"].append(s["id"][p : p + 1])
                    s["b"].append(ids[q : q + 1])

    return own.unionByName(meet_parts(c, rows, rows, "above", begin, across, end, "a long, b long"))


def smallest_label(c: Cells, placed: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """(id, low): the smallest label of the cores (id, label) within eps of each vector that is none, if there is any."""
    metric, none = c.metric, np.iinfo(np.int64).max

    def begin(ids, x, _):
        return ids, x, np.full(len(ids), none)

    def meet(s, ids, y, label):
        near = distances(s[1], y, metric) <= eps
        np.minimum(s[2], np.where(near, label[None], none).min(1), out=s[2])

    def end(s):
        found = s[2] < none
        return _batch(id=s[0][found], low=s[2][found]) if found.any() else None

    homes = placed.drop("f").join(core.select("id", F.col("label").cast("long").alias("f")), "id")
    asked = placed.join(core.select("id"), "id", "left_anti")
    return meet_parts(c, homes, asked, "all", begin, meet, end, "id long, low long").groupBy("id").agg(F.min("low").alias("low"))


def kth_distance(vectors: DataFrame, k: int) -> DataFrame:
    """(id, f, d): Euclidean distance of each vector (id, v, f), which stands for f equal ones, to its k-th nearest, itself first.

    The k nearest of its own part bound the search, or the farthest vector of the nearest cell that holds k.
    Only parts with cells within that radius are visited, and a visit returns one row.
    Where there are fewer than k vectors the distance is that to the farthest.
    """
    c = cells(vectors, "euclidean")

    def begin(ids, x, _):
        return {"id": ids, "x": x, "best": np.full((len(ids), k), np.inf)}

    def meet(s, ids, y, w):
        d = distances(s["x"], y, "euclidean")
        d[s["id"][:, None] == ids[None]] = 0
        if (w > 1).any():
            d = np.repeat(d, np.minimum(w, k), axis=1)
        d = np.concatenate([s["best"], d], axis=1)
        s["best"] = np.partition(d, k - 1, axis=1)[:, :k]

    def end(s):
        flat = pa.array(np.sort(s["best"], axis=1).ravel())
        return pa.RecordBatch.from_arrays([pa.array(s["id"]), pa.ListArray.from_arrays(pa.array(np.arange(len(s["id"]) + 1, dtype=np.int32) * k), flat)], names=["id", "best"])

    here = guests(c, math.inf)  # all of its own part
    near = materialize(meet_parts(c, here, here, "own", begin, meet, end, "id long, best array<double>"), "nearest-at-home")
    finite = F.filter("x", lambda d: d < F.lit(float("inf")))
    if c.parts > 1:
        pivots, most, slack = c.pivots, np.where(c.size >= k, c.radius, np.inf), c.slack

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    r = np.minimum((euclidean(_vectors(batch.column(1)), pivots) + most[None]).min(1), batch.column(4).to_numpy()) + slack
                    yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(r)], names=["id", "v", "f", "cell", "r"])

        known = c.homes.join(near, "id").select("id", "v", "f", "cell", F.element_at("best", k).alias("r"))
        c.homes = known.mapInArrow(bound, "id long, v array<double>, f long, cell int, r double")
        placed = materialize(guests(c), "radii")
        near = near.unionByName(meet_parts(c, placed, placed, "others", begin, meet, end, "id long, best array<double>"))
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("x"))  # as many lists as visits
    return best.select("id", F.array_max(finite).alias("d")).join(c.homes.select("id", "f"), "id")
