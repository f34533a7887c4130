"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors with one label are dealt into overlapping clusters around sampled centers, again and again until
every cluster is small. In each cluster every vector gets its nearest neighbours, pruned so that those
kept point in different directions; the lists of all clusters are united into one graph. The search for a
vector starts at the medoid of its home cluster and at the vector itself, walks greedily towards it and
then expands everything within the range (and a margin); the cosine of what it meets is computed in double
precision. Where an edge of what was found leads out of the home cluster and may reach the range, the search
goes on over the united graph, in rounds of joins over all vectors at once.
Equal vectors are one node with a weight, so a group of copies costs one search. Clusters that no centers
split are compared whole, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoflow.operators.graph import connected_components
from photoflow.scratch import materialize, partitions

#: size from which a cluster is split, centers of a split, clusters that a vector joins, vectors of a block
CLUSTER, CENTERS, OVERLAP, BLOCK = 3000, 64, 3, 1000
#: cosine below which centers stay; share of a cluster's size below which a part must fall to be split again
APART, SHRINK = 0.8, 0.8
#: nearest neighbours considered, kept, and the factor by which a kept neighbour must be nearer to what it shades
NEAREST, DEGREE, ALPHA = 96, 32, 1.2
#: width of the greedy walk and margin of the range's expansion, as cosine
BEAM, MARGIN = 8, 0.06


def _links(v: str) -> Column:
    """Whether a vector can link: all of its components are finite numbers and one of them is not 0."""
    return F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, node key), (nodes: key, label, cid, mult, v): v has length 1; rows that take no part have a null key."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    t = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    takes = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & _links("v"), F.lit(False))
    # 128 bits name a vector of a label
    name = F.concat_ws(":", F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64(F.lit(1), "v", "label")))
    t = t.withColumn("key", F.when(takes, name))
    nodes = t.where("key is not null").groupBy("key", "label", "v").agg(F.min("id").alias("cid"), F.count("*").alias("mult"))
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda c: c / F.col("top"))
    unit = nodes.withColumn("top", top).withColumn("v", scaled).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))
    return t.select("id", "key"), unit.select("key", "label", "cid", "mult", F.transform("v", lambda c: c / F.col("norm")).alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centers(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sid, size, centers): sampled centers of every large cluster, without those near to another: they would tear a tight group."""
    own = members.join(sizes, "sid").withColumn("h", F.pmod(F.xxhash64("cid"), F.lit(1_000_003)))
    parts = F.greatest(F.lit(2), F.least(F.lit(CENTERS), F.ceil(F.col("size") * 2 * OVERLAP / CLUSTER) + 1))
    sampled = own.where(F.col("h") < F.lit(1_000_003) * parts * 3 / F.col("size"))
    centers = sampled.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "v"))), F.lit(1), F.max(parts).cast("int")).alias("c"))
    centers = sizes.join(centers, "sid", "left").select("sid", "size", F.coalesce(F.transform("c", lambda c: c["v"]), F.array().cast("array<array<double>>")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for row in b.column("c").to_pylist():
                c, apart = np.array(row), [0] if row else []
                for k in range(1, len(c)):
                    if (c[k] @ c[apart].T).max() < APART:
                        apart.append(k)
                kept.append([row[k] for k in apart])
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("size"), pa.array(kept, pa.list_(pa.list_(pa.float64())))], names=["sid", "size", "centers"])

    return centers.mapInArrow(run, "sid string, size long, centers array<array<double>>")


def _split(members: DataFrame, centers: DataFrame) -> DataFrame:
    """Members of too large clusters, each in the clusters of its nearest centers."""
    own = members.join(centers.select("sid", "size"), "sid")
    blocks = own.withColumn("blk", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK))).groupBy("sid", "blk").agg(F.collect_list(F.struct("key", "cid", "mult", "home", "v")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                sid, m = b.column("sid")[row].as_py(), b.column("m")[row].values
                x, c = _matrix(m.field("v")), np.array(b.column("centers")[row].as_py())
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP]
                n = near.shape[1]
                own = np.asarray(m.field("home").to_numpy(zero_copy_only=False), bool)
                place = np.tile(np.arange(n), len(x))
                # a guest goes to one cluster less, so repeated splits do not multiply it
                kept = np.repeat(own, n) | (place < max(1, OVERLAP - 1))
                take = pa.array(np.repeat(np.arange(len(x)), n)[kept])
                home = (np.repeat(own, n) & (place == 0))[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{sid}/{c}" for c in near.ravel()[kept]]), *[m.field(c).take(take) for c in ("key", "cid", "mult")], pa.array(home), m.field("v").take(take)], names=["sid", "key", "cid", "mult", "home", "v"]
                )

    return blocks.join(centers, "sid").select("sid", "m", "centers").mapInArrow(run, "sid string, key string, cid long, mult long, home boolean, v array<double>")


def clusters(nodes: DataFrame) -> DataFrame:
    """(sid, key, cid, mult, home, v, whole): every node once with home, and further times in neighbouring clusters.

    whole marks the large clusters that stay: too few centers are apart, or a split left nearly all in one part.
    """
    members = nodes.select(F.concat_ws(":", "label", F.size("v").cast("string")).alias("sid"), "key", "cid", "mult", F.lit(True).alias("home"), "v", F.lit(False).alias("whole"))
    members = materialize(members, "clusters-0")
    before = None
    for level in range(1, 12):
        sizes = members.where("not whole").groupBy("sid").agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > CLUSTER)
        if large.isEmpty():
            return members
        large = materialize(_centers(members, large), "centers")
        stays = F.size("centers") <= OVERLAP
        if before is not None:
            of = before.select(F.col("sid").alias("of"), F.col("size").alias("was"))
            large = large.join(of, F.regexp_replace("sid", "/[0-9]+$", "") == F.col("of"), "left")
            stays = stays | F.coalesce(F.col("size") > F.col("was") * SHRINK, F.lit(False))
        large = materialize(large.select("sid", "size", "centers", stays.alias("stays")), "large")
        before = large.where("not stays").select("sid", "size", "centers")
        rest = members.join(large.select("sid", "stays"), "sid", "left").where("stays is null or stays")
        rest = rest.withColumn("whole", F.col("whole") | F.coalesce("stays", F.lit(False))).drop("stays")
        parts = _split(members, before).dropDuplicates(["sid", "key"]).withColumn("whole", F.lit(False))
        members = materialize(rest.select(*parts.columns).unionByName(parts), f"clusters-{level}")
    last = members.groupBy("sid").agg((F.count("*") > CLUSTER).alias("large"))
    return members.join(last, "sid").withColumn("whole", F.col("whole") | F.col("large")).drop("large")


def _between(ci: np.ndarray, cj: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of both sides the smallest cid that is reached by the links between them."""
    none = np.iinfo(np.int64).max
    while True:
        low = np.minimum(ci, np.where(good, cj[None], none).min(1))
        other = np.minimum(cj, np.where(good, low[:, None], none).min(0))
        if (low == ci).all() and (other == cj).all():
            return low, other
        ci, cj = low, other


def _compared(members: DataFrame, placed: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(cid, n_links, with) as from _search, of clusters compared whole, every member at home with every member; and (cid, n_links) to add for guests.

    A guest gets its links to those at home here that are no members of its own cluster (placed: cid, the
    cluster `at` that it is at home in and all clusters `ins` that it is in), where they are not met.
    """
    members = members.join(placed, "cid")
    sizes = members.groupBy("sid").agg(F.count("*").alias("size"))
    blocks = members.join(sizes, "sid").withColumn("blk", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)))
    blocks = materialize(blocks.groupBy("sid", "home", "blk").agg(F.collect_list(F.struct("cid", "mult", "v", "at", "ins")).alias("m")), "whole-blocks")
    side = lambda x, *more: blocks.select("sid", *[F.col(c).alias(f"{c}_{x}") for c in ("home", "blk", *more)])
    plan = side("i").join(side("j"), "sid").where("home_i and (not home_j or blk_i <= blk_j)")
    pairs = plan.join(side("i", "m"), ["sid", "home_i", "blk_i"]).join(side("j", "m"), ["sid", "home_j", "blk_j"])
    pairs = pairs.repartition(partitions(members.sparkSession), "sid", "blk_i", "home_j", "blk_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (ci, mi, x), (cj, mj, y) = ((m.field("cid").to_numpy(), m.field("mult").to_numpy(), _matrix(m.field("v"))) for m in (b.column(c)[row].values for c in ("m_i", "m_j")))
                same, home = b.column("same")[row].as_py(), b.column("home_j")[row].as_py()
                good = x @ y.T >= limit
                if same:
                    good &= ci[:, None] != cj[None]
                n = (good @ mj.astype(float)).astype(np.int64) + (mi - 1 if same else 0)
                low, other = _between(ci, cj, good)
                yield pa.RecordBatch.from_arrays([pa.array(ci), pa.array(n), pa.array(low), pa.array(np.zeros(len(ci), bool))], names=["cid", "n", "with", "guest"])
                if not same:
                    apart = good if home else good & ~_known(b.column("m_i")[row].values.field("ins"), b.column("m_j")[row].values.field("at").to_numpy())
                    back = (apart.T @ mi.astype(float)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cj), pa.array(back), pa.array(other), pa.array(np.full(len(cj), not home))], names=["cid", "n", "with", "guest"])

    same = F.col("home_j") & (F.col("blk_i") == F.col("blk_j"))
    out = pairs.select("m_i", "m_j", "home_j", same.alias("same")).mapInArrow(run, "cid long, n long, with long, guest boolean")
    out = materialize(out.where("not guest or n > 0 or cid <> with"), "compared")
    counts = out.where("not guest").groupBy("cid").agg(F.sum("n").alias("n_links")).withColumn("with", F.col("cid"))
    rows = counts.unionByName(out.where("cid <> with").select("cid", F.lit(-1).cast("long").alias("n_links"), "with").distinct())
    return rows, out.where("guest").groupBy("cid").agg(F.sum("n").alias("n_links"))


def _known(ins: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """For lists of clusters and clusters `at` whether the list holds the cluster."""
    row = np.repeat(np.arange(len(ins)), ins.value_lengths().to_numpy(zero_copy_only=False))
    flat = ins.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ins), len(at)), bool)
    for c in np.unique(at):
        out[np.ix_(row[flat == c], np.flatnonzero(at == c))] = True
    return out


def pruned_neighbours(x: np.ndarray) -> list[np.ndarray]:
    """Of each row its nearest others, nearest first, without those that a kept one shades (within DEGREE)."""
    n = len(x)
    out = []
    k = min(NEAREST, n - 1)
    for s in range(0, n, 512):
        cos = x[s : s + 512] @ x.T
        cos[np.arange(len(cos)), np.arange(s, s + len(cos))] = -2
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(cos), 0), int)
        for i in range(len(cos)):
            cand = near[i][np.argsort(-cos[i, near[i]], kind="stable")]
            away = 1 - cos[i, cand]
            between = 1 - x[cand] @ x[cand].T
            alive, kept = np.ones(len(cand), bool), []
            for j in range(len(cand)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == DEGREE:
                        break
                    alive &= ~(ALPHA * between[j] <= away)
            out.append(cand[kept])
    return out


def _edges(table: pa.Table) -> pa.Table:
    """Pruned lists in both directions, with cosines: a vector that nobody keeps is reached through those that it keeps."""
    cid, x = table.column("cid").to_numpy(), _matrix(table.column("v"))
    lists = pruned_neighbours(x) if len(cid) > 1 else []
    src = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
    dst = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    both = np.unique(np.concatenate([src * len(cid) + dst, dst * len(cid) + src])) if len(src) else src
    one, other = both // max(1, len(cid)), both % max(1, len(cid))
    cos = np.concatenate([np.einsum("ij,ij->i", x[one[s : s + 65536]], x[other[s : s + 65536]]) for s in range(0, len(one), 65536)] or [np.zeros(0)])
    cuts = np.searchsorted(one, np.arange(len(lists) + 1)).astype(np.int32)
    edges = pa.StructArray.from_arrays([pa.array(cid[other]), pa.array(cos)], ["to", "cos"])
    return pa.table({"cid": cid[: len(lists)], "near": pa.ListArray.from_arrays(pa.array(cuts), edges)})


def _may_reach(to_x, edge, limit: float):
    """Whether a vector at cosine `edge` from one at cosine `to_x` may lie within the limit (angles add up at most)."""
    angle = lambda c: np.arccos(np.clip(c, -1, 1))
    return angle(edge) <= angle(to_x) + np.arccos(limit) + 1e-9


def _search(table: pa.Table, limit: float) -> pa.Table:
    """Range search for every vector at home in the cluster: weight in range, and links enough to connect what is linked.

    Rows with `beyond` are vectors outside the cluster that an edge of what was found may reach.
    """
    table = table.sort_by("cid")
    cid, mult, home, x = table.column("cid").to_numpy(), table.column("mult").to_numpy(), table.column("home").to_numpy(), _matrix(table.column("v"))
    n = len(cid)
    lists = table.column("near").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    edges = lists.flatten()
    named, edge = edges.field("to").to_numpy(zero_copy_only=False), edges.field("cos").to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(cid, named), n - 1)
    inside = cid[at] == named  # the list also names members of other clusters
    flat = at[inside]
    ends = np.append(0, np.cumsum(lens)).astype(np.int64)
    off = np.append(0, np.cumsum(inside))[ends]
    out = ~inside & (edge >= np.cos(min(np.pi, 2 * np.arccos(limit - MARGIN))))
    out_to, out_cos, out_off = named[out], edge[out], np.append(0, np.cumsum(out))[ends]
    beyond: list[tuple[np.ndarray, np.ndarray]] = []

    def around(front: np.ndarray, seen: np.ndarray) -> np.ndarray:
        size = off[front + 1] - off[front]
        met = np.zeros(n, bool)
        met[flat[np.repeat(off[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(met & ~seen)

    medoid = int(np.argmax(x @ x.mean(0)))
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = np.zeros(n, np.int64)
    for q in np.flatnonzero(home):
        seen = np.zeros(n, bool)
        found, value = np.array([medoid]), x[[medoid]] @ x[q]
        seen[medoid] = True
        frontier, best = found, value
        while len(frontier):  # greedily towards q
            new = around(frontier, seen)
            seen[new] = True
            if not len(new):
                break
            cos = x[new] @ x[q]
            found, value = np.append(found, new), np.append(value, cos)
            ahead = np.argsort(-cos)[:BEAM]
            ahead = ahead[cos[ahead] > best.min()]
            frontier, best = new[ahead], np.sort(np.append(best, cos))[-BEAM:]
        frontier = np.append(found[value >= limit - MARGIN], [] if seen[q] else [q]).astype(int)
        found, value = (found, value) if seen[q] else (np.append(found, q), np.append(value, 1.0))
        seen[q] = True
        while len(frontier):  # everything in range
            new = around(frontier, seen)
            seen[new] = True
            cos = x[new] @ x[q]
            found, value = np.append(found, new), np.append(value, cos)
            frontier = new[cos >= limit - MARGIN]
        wide = value >= limit - MARGIN
        size = out_off[found[wide] + 1] - out_off[found[wide]]
        if size.any():
            rows = np.repeat(out_off[found[wide]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            other = np.unique(out_to[rows][_may_reach(np.repeat(value[wide], size), out_cos[rows], limit)])
            beyond.append((np.full(len(other), cid[q]), other))
        inside = found[(value >= limit) & (found != q)]
        links[q] = mult[inside].sum() + mult[q] - 1
        roots = {root(int(r)) for r in np.unique(parent[np.append(inside, q)])}
        low = min(roots)
        for r in roots:
            parent[r] = low
    top = np.array([root(i) for i in range(n)], int)
    asked = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in beyond)])
    other = np.concatenate([np.zeros(0, np.int64), *(y for _, y in beyond)])
    return pa.table({
        "cid": np.append(cid, asked), "n_links": np.append(np.where(home, links, -1), np.full(len(asked), -1)), "with": np.append(cid[top], asked),
        "beyond": pa.array(np.append(np.zeros(n, np.int64), other), mask=np.arange(n + len(asked)) < n),
    })


def _beyond(asked: DataFrame, nodes: DataFrame, graph: DataFrame, members: DataFrame, limit: float) -> DataFrame:
    """(cid, n_links, with): what the search finds outside the home clusters, from (q, y) on, one row per link.

    Every round scores its pairs, and follows the edges of those in range (and the margin) to vectors that
    the query has met neither in its cluster nor here.
    """
    at_home = members.where("home").select(F.col("cid").alias("q"), "sid")
    inside = members.select("sid", F.col("cid").alias("y"))
    new, seen, hits = asked, asked, None
    while not new.isEmpty():
        q, y = nodes.select(F.col("cid").alias("q"), F.col("v").alias("qv")), nodes.select(F.col("cid").alias("y"), F.col("v").alias("yv"), "mult")
        cos = F.aggregate(F.zip_with("qv", "yv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        near = materialize(new.join(q, "q").join(y, "y").select("q", "y", "mult", cos.alias("cos")).where(F.col("cos") >= limit - MARGIN), "near-beyond")
        hits = near if hits is None else hits.unionByName(near)
        step = near.join(graph.withColumnRenamed("cid", "y"), "y").select("q", "cos", F.explode("near").alias("e"))
        reach = F.acos(F.least(F.col("e.cos"), F.lit(1.0))) <= F.acos(F.least(F.col("cos"), F.lit(1.0))) + float(np.arccos(limit)) + 1e-9
        step = step.where(reach).select("q", F.col("e.to").alias("y")).where("q <> y").distinct()
        step = step.join(at_home, "q").join(inside, ["sid", "y"], "left_anti").select("q", "y").join(seen, ["q", "y"], "left_anti")
        new = materialize(step, "beyond")
        seen = seen.unionByName(new)
    if hits is None:
        return asked.select(F.col("q").alias("cid"), F.lit(0).cast("long").alias("n_links"), F.col("y").alias("with"))
    links = hits.where(F.col("cos") >= limit).select("q", "y")
    # in a cluster that is compared whole both sides of a link between one at home and any member are counted there
    whole = members.where("whole").select("sid", F.col("cid").alias("q"))
    links = links.join(members.where("home and whole").select(F.col("cid").alias("y"), "sid"), "y", "left").join(whole.withColumn("_met", F.lit(True)), ["sid", "q"], "left")
    links = materialize(links.where("_met is null").select("q", "y"), "links-beyond")
    # a link that only one of the two has found counts for the other too, unless it was met at home
    back = links.select(F.col("y").alias("q"), F.col("q").alias("y")).join(at_home, "q").join(inside, ["sid", "y"], "left_anti").select("q", "y")
    weight = nodes.select(F.col("cid").alias("y"), F.col("mult").alias("n_links"))
    return links.unionByName(back).distinct().join(weight, "y").select(F.col("q").alias("cid"), "n_links", F.col("y").alias("with"))


def _shards(whole: DataFrame) -> DataFrame:
    """Members of clusters that stay large in shards of about CLUSTER by two hashes, so that every shard overlaps those of the other hash."""
    sizes = whole.groupBy("sid").agg(F.ceil(F.count("*") / CLUSTER).alias("shards"))
    dealt = [F.concat(F.lit(f"{k}:"), F.pmod(F.xxhash64(F.lit(k), "key"), F.col("shards")).cast("string")) for k in (1, 2)]
    return whole.join(sizes, "sid").withColumn("shard", F.explode(F.array(*dealt))).withColumn("sid", F.concat_ws("#", "sid", "shard")).drop("shards", "shard")


def _rim(whole: DataFrame, graph: DataFrame, members: DataFrame, limit: float) -> DataFrame:
    """(q, y): vectors at home in a cluster that is compared whole, and those outside it that their own edges may reach within twice the range."""
    edges = whole.where("home").select("sid", F.col("cid").alias("q")).join(graph.withColumnRenamed("cid", "q"), "q").select("sid", "q", F.explode("near").alias("e"))
    far = float(np.cos(min(np.pi, 2 * np.arccos(limit - MARGIN))))
    edges = edges.where(F.col("e.cos") >= far).select("sid", "q", F.col("e.to").alias("y"))
    return edges.join(members.select("sid", F.col("cid").alias("y")), ["sid", "y"], "left_anti").select("q", "y").distinct()


def components(vectors: DataFrame, limit: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept (the id is its component's smallest).

    Only vectors of equal labels (and lengths) are compared. Rows with a null id, label or vector, with a
    zero vector or a null or non-finite component link with nothing and are their own component. Every link
    reported has a cosine of at least `limit`; the search may miss some (see audit). Repeated rows are
    vectors each and link with one another. Other columns are ignored.
    """
    rows, nodes = _nodes(vectors, id_col, vec_col, label_col)
    nodes = materialize(nodes, "nodes")
    every = clusters(nodes)
    members = every.where("not whole").drop("whole")
    whole = every.where("whole").drop("whole")
    near = members.unionByName(_shards(whole)).groupBy("sid").applyInArrow(_edges, "cid long, near array<struct<to:bigint,cos:double>>")
    united = materialize(near.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    searched = members.join(united, "cid", "left").groupBy("sid").applyInArrow(lambda t: _search(t, limit), "cid long, n_links long, with long, beyond long")
    searched = materialize(searched, "searched")
    found, credits = searched.where("beyond is null").drop("beyond"), None
    asked = searched.where("beyond is not null").select(F.col("cid").alias("q"), F.col("beyond").alias("y"))
    asked = materialize(asked.unionByName(_rim(whole, united, every, limit)).distinct(), "asked")
    further = materialize(_beyond(asked, nodes, united, every, limit), "found-beyond")
    if not whole.isEmpty():
        of = F.xxhash64("sid")
        placed = every.groupBy("cid").agg(F.max(F.when(F.col("home"), of)).alias("at"), F.collect_set(of).alias("ins"))
        compared, credits = _compared(whole, placed, limit)
        found = found.unionByName(compared)
    # links found beyond count for those that asked, and connect
    more = further.select("cid", "n_links") if credits is None else further.select("cid", "n_links").unionByName(credits)
    more = more.groupBy("cid").agg(F.sum("n_links").alias("more"))
    found = found.join(more, "cid", "left").withColumn("n_links", F.when(F.col("n_links") >= 0, F.col("n_links") + F.coalesce("more", F.lit(0))).otherwise(F.col("n_links"))).drop("more")
    found = found.unionByName(further.select("cid", F.lit(-1).cast("long").alias("n_links"), "with"))
    found = materialize(found, "found")
    comp = connected_components(found.where("cid <> with"), "cid", "with")
    of_node = nodes.select("key", "cid").join(found.where("n_links >= 0").select("cid", "n_links"), "cid").join(comp, F.col("cid") == F.col("node"), "left")
    of_node = materialize(of_node.select("key", "n_links", F.coalesce("component", "cid").alias("component_id")), "of-nodes")
    out = rows.join(of_node, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, result: DataFrame, limit: float = 0.93, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(found, true): links of the rows whose id `every` divides, as reported and by comparing them with all rows of their label.

    Blocks of these rows meet all blocks of their label, a matrix product and one count for each two blocks; the
    products grow with the square of a label's rows. Vectors that components leaves out are left out here too.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("v"))
    v = v.where("id is not null and label is not null").where(_links("v")).select(F.struct("label", F.size("v").alias("n")).alias("g"), "id", "v")
    asks = F.col("id") % every == 0
    sizes = v.groupBy("g").agg(F.count("*").alias("all"), F.count_if(asks).alias("asking")).where("asking > 0")
    dealt = lambda t, size: t.join(sizes, "g").withColumn("blk", F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK))).groupBy("g", "blk").agg(F.collect_list(F.struct("id", "v")).alias("m"))
    one, other = materialize(dealt(v.where(asks), "asking"), "asking-blocks"), materialize(dealt(v, "all"), "all-blocks")
    side = lambda t, x, *more: t.select("g", *[F.col(c).alias(f"{c}_{x}") for c in ("blk", *more)])
    plan = side(one, "i").join(side(other, "j"), "g")
    pairs = plan.join(side(one, "i", "m"), ["g", "blk_i"]).join(side(other, "j", "m"), ["g", "blk_j"]).repartition(partitions(vectors.sparkSession), "g", "blk_i", "blk_j")
    dot = lambda a, b: np.cumsum(a * b)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (i, x), (j, y) = ((m.field("id").to_numpy(), _matrix(m.field("v"))) for m in (b.column(c)[row].values for c in ("m_i", "m_j")))
                x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
                cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                good = cos >= limit
                for p, q in np.argwhere(np.abs(cos - limit) < 1e-12):  # not by the order in which the product adds
                    good[p, q] = dot(x[p], y[q]) >= limit * np.sqrt(dot(x[p], x[p])) * np.sqrt(dot(y[q], y[q]))
                yield pa.RecordBatch.from_arrays([pa.array([int((good & (i[:, None] != j[None])).sum())], pa.int64())], names=["n"])

    hits = pairs.select("m_i", "m_j").mapInArrow(run, "n long")
    true = hits.agg(F.lit(1).alias("_k"), F.coalesce(F.sum("n"), F.lit(0)).alias("true"))
    found = result.where(F.col(id_col) % every == 0).agg(F.lit(1).alias("_k"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))
    return true.join(found, "_k").select("found", "true")
