"""Near-duplicate vectors by search on a robust-pruned flat graph.

Vectors are assigned to their nearest clusters, several each, so that the shards of clusters overlap. In every shard a
graph is built: a vector's nearest ones, pruned so that none is kept which a kept one leads to. The adjacency lists that
a vector has in its shards are united. A shard then walks the part of the united graph whose vectors it holds: a greedy
search from the shard's medoids leads every vector to its surroundings, and a range expansion from there, and from the
vector's own node, goes on from neighbour to neighbour until none within range is left. Links are verified in double
precision, among all that the search linked together in a shard, so that both ends count the same links; a pair counts
in the smallest shard that holds both. An audit measures recall against brute force on a bounded sample, and a search
that misses too much is repeated with wider overlap.

Equal vectors are one node. A shard too large for a task is cut into blocks, and every two blocks of a shard ask one
another.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected, local_roots
from quire.llm.shared import drop_written, written

log = logging.getLogger(__name__)

THRESHOLD = 0.9
SAMPLE = 20_000  # vectors that clusters are fitted on
SHARD = 1_500  # vectors for each cluster, before overlap
MAX_CLUSTERS = 4_096  # clusters of a level
OVERLAP = 4  # clusters of a vector
BLOCK = 6_000  # vectors of a shard that one task holds
DEGREE = 16
CANDIDATES = 48
ENTRIES = 64  # medoids of runs of a block that a search may begin from
ALPHA = 1.2  # how much nearer a kept neighbour must be for another to be pruned
BEAM = 16
AUDIT = 400  # vectors that recall is measured on
AIM = 0.98
LEAST = 0.9
TILE = 512
SLACK = 0.06  # how far below the threshold the range expansion still goes on, without accepting


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of packed floats or doubles, as doubles of length 1."""
    x = np.array([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8") for b in raw], np.float64).reshape(len(raw), dim)
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


NODE = "vec_id long, dim int, node long, vec binary"
_NODE = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("node", pa.int64()), ("vec", pa.binary())])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that can be compared: node is a hash of the components, vec packs them."""
    for batch in batches:
        rows = []
        for vec_id, x in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            if vec_id is None or not x or any(v is None for v in x):
                continue
            wide = np.array(x, np.float64) + 0.0
            if not np.isfinite(wide).all() or not wide.any():
                continue
            short = wide.astype("<f4")
            packed = short.tobytes() if np.array_equal(short.astype(np.float64), wide) else wide.astype("<f8").tobytes()
            node = int.from_bytes(hashlib.blake2b(wide.tobytes(), digest_size=8).digest(), "little", signed=True)
            rows.append((vec_id, len(x), node, packed))
        yield _batch(rows, _NODE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def clusters(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from rows in order; x: unit rows. A cluster that runs empty keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def robust_pruned(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each row of x (unit rows): out of its nearest candidates, nearest first, a row is kept unless one kept
    before is alpha times nearer to it than the row itself is. Edges lead both ways."""
    n = len(x)
    most = min(candidates, n - 1)
    if most < 1:
        return [np.zeros(0, np.int64)] * n
    out, into = [], []
    for a in range(0, n, TILE):
        own = np.arange(a, min(a + TILE, n))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -2
        pick = np.argpartition(-near, most - 1, axis=1)[:, :most]
        close = np.take_along_axis(near, pick, 1)
        order = np.argsort(-close, axis=1, kind="stable")
        pick, close = np.take_along_axis(pick, order, 1), np.take_along_axis(close, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * close, 0))
        of = x[pick]
        between = np.sqrt(np.maximum(2 - 2 * (of @ of.transpose(0, 2, 1)), 0))
        alive = np.ones(pick.shape, bool)
        row = np.arange(len(own))
        for _ in range(min(degree, most)):
            has = alive.any(1)
            if not has.any():
                break
            nearest = alive.argmax(1)  # candidates are in order
            out.append(own[has])
            into.append(pick[row, nearest][has])
            alive &= ~((alpha * between[row, nearest] <= far) & has[:, None])
            alive[row, nearest] = False
    # the way back is kept for the nearest: a centre of many would else be led to by all
    back, to = np.concatenate(into), np.concatenate(out)
    close = np.concatenate([np.einsum("ij,ij->i", x[back[a : a + 65536]], x[to[a : a + 65536]]) for a in range(0, len(back), 65536)])
    order = np.lexsort((-close, back))
    back, to = back[order], to[order]
    rank = np.arange(len(back)) - np.searchsorted(back, back, "left")
    edges = np.unique(np.concatenate([np.concatenate(out) * n + np.concatenate(into), (back * n + to)[rank < degree]]))
    a, b = edges // n, edges % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def padded(lists: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lists), max([1, *map(len, lists)])), -1, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class Ways:
    """Edges that lead both ways, by row."""

    def __init__(self, near: np.ndarray) -> None:
        a, k = np.nonzero(near >= 0)
        b, n = near[a, k], len(near)
        edges = np.unique(np.concatenate([a * n + b, b * n + a]))
        self.to = edges % n
        self.at = np.searchsorted(edges // n, np.arange(n + 1))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in rows, and the rows that those lead to."""
        size = self.at[rows + 1] - self.at[rows]
        place = np.repeat(np.arange(len(rows)), size)
        return place, self.to[np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[rows], size)]


def medoids(x: np.ndarray, entries: int = ENTRIES) -> np.ndarray:
    """The row nearest to the mean, of all rows and of each of some runs of them."""
    runs = [np.arange(len(x)), *np.array_split(np.arange(len(x)), min(entries, -(-len(x) // 8)))]
    return np.unique([r[(x[r] @ x[r].mean(0)).argmax()] for r in runs])


def range_search(x: np.ndarray, near: np.ndarray, queries: np.ndarray, seeds: np.ndarray, threshold: float, own: np.ndarray | None = None, beam: int = BEAM) -> np.ndarray:
    """True for each row of x found within threshold of a query: greedy from the medoids that are nearest to it, then
    expanding within range. near: padded neighbour lists; seeds: padded lists of rows that each query also begins from;
    own: the queries' own rows, where they have one."""
    n, out = len(x), np.zeros((len(queries), len(x)), bool)
    entry, both_ways = medoids(x), Ways(near)
    beam = min(beam, len(entry)) if len(entry) > 1 else 1
    for a in range(0, len(queries), TILE):
        q = queries[a : a + TILE]
        seen = np.zeros((len(q), n), bool)
        row = np.arange(len(q))
        close = q @ x[entry].T
        top = np.argpartition(-close, beam - 1, axis=1)[:, :beam]
        ids, sims = entry[top], np.take_along_axis(close, top, 1)
        done = np.zeros((len(q), beam), bool)
        seen[:, entry] = True
        found = out[a : a + TILE]
        live = row
        while len(live):
            best = np.where(done[live], -4.0, sims[live]).argmax(1)
            done[live, best] = True
            reach = near[ids[live, best]]
            new = (reach >= 0) & ~seen[live[:, None], reach]
            r, c = np.nonzero(new)
            to = reach[r, c]
            seen[live[r], to] = True
            close = np.full(reach.shape, -3.0)
            close[r, c] = np.einsum("ij,ij->i", q[live[r]], x[to])
            hit = close[r, c] >= threshold
            found[live[r[hit]], to[hit]] = True
            every = np.concatenate([sims[live], close], 1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(every, top, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], reach], 1), top, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], close < -2], 1), top, 1)
            live = live[(~done[live]).any(1)]
        found[:, entry] |= (q @ x[entry].T) >= threshold
        r, c = np.nonzero(found)
        i, j = np.nonzero((sims >= threshold - SLACK) & (sims < threshold))  # of the beam, what lies just out of range
        r, c = np.append(r, i), np.append(c, ids[i, j])
        i, k = np.nonzero(seeds[a : a + TILE] >= 0)
        j = seeds[a + i, k]
        close = np.einsum("ij,ij->i", q[i], x[j])
        found[i, j] |= close >= threshold
        on = (close >= threshold - SLACK) & ~seen[i, j]
        seen[i, j] = True
        r, c = np.append(r, i[on]), np.append(c, j[on])
        while len(r):
            more_r, more_c = [], []
            for b in range(0, len(r), 16384):
                way, to = both_ways.of(c[b : b + 16384])
                way = r[b : b + 16384][way]
                new = ~seen[way, to]
                at = np.unique(way[new] * n + to[new])
                i, j = at // n, at % n
                seen[i, j] = True
                close = np.einsum("ij,ij->i", q[i], x[j])
                hit, on = close >= threshold, close >= threshold - SLACK
                found[i[hit], j[hit]] = True
                more_r.append(i[on])
                more_c.append(j[on])
            r, c = np.concatenate(more_r), np.concatenate(more_c)
        if own is not None:
            found[row, own[a : a + TILE]] = False
    return out


COARSE = 2  # cells of a vector, where clusters are in two levels
FINE_BITS = 20
PART = 50_000  # vectors of a cell that one task assigns
PLACED = "node long, dim int, vec binary, copies long, shards array<long>"


def _drawn(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About `most` of n rows, by a hash of node."""
    return rows.filter(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, most / max(n, 1)))))


def _nearest(x: np.ndarray, centres: np.ndarray, many: int) -> np.ndarray:
    many = min(many, len(centres))
    return np.sort(np.argpartition(-(x @ centres.T), many - 1, axis=1)[:, :many], axis=1).astype(np.int64)


def place(nodes: DataFrame, overlap: int) -> DataFrame:
    """Every node in its nearest clusters' shards, and in one block of each; vectors of different length share none.

    The few vectors of a rare length are one shard. Clusters of a common length are fitted on the driver on a bounded
    sample; beyond MAX_CLUSTERS of them they are cells only, and each cell is clustered again by tasks of its own."""
    rare, large = -1, {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().filter(F.col("count") > SHARD).collect()}
    centres, base, taken = {}, {}, 0
    for dim, n in sorted(large.items()):
        found = _drawn(nodes.filter(F.col("dim") == dim), n, SAMPLE, "clusters").select("node", "vec").collect()
        sample = unit([bytes(r["vec"]) for r in sorted(found, key=lambda r: r["node"])], dim)
        centres[dim] = clusters(sample, max(1, min(-(-n // SHARD), MAX_CLUSTERS, len(sample))))
        base[dim], taken = taken, taken + len(centres[dim])
    deep = {dim for dim, n in large.items() if n > SHARD * MAX_CLUSTERS}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b["dim"].to_numpy(), b["vec"].to_pylist()
            shards: list[list[int]] = [[rare - d] for d in dims.tolist()]
            for dim in set(dims.tolist()) & centres.keys():
                of = np.flatnonzero(dims == dim)
                top = _nearest(unit([raw[i] for i in of], dim), centres[dim], COARSE if dim in deep else overlap) + base[dim]
                for i, x in zip(of.tolist(), top.tolist(), strict=True):
                    shards[i] = x
            yield pa.RecordBatch.from_arrays([b["node"], b["dim"], b["vec"], b["copies"], pa.array(shards, pa.list_(pa.int64()))], names=["node", "dim", "vec", "copies", "shards"])

    placed = written(nodes.select("node", "dim", "vec", "copies").mapInArrow(assign, PLACED), "vectors-placed")
    if deep:
        in_cells = placed.filter(F.col("dim").isin(*deep))
        placed = placed.filter(~F.col("dim").isin(*deep)).unionByName(written(_in_two_levels(in_cells, overlap), "vectors-placed"))
    rows = placed.withColumn("shard", F.explode("shards"))
    many = rows.groupBy("shard").count().filter(F.col("count") > BLOCK).select("shard", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(many, "shard", "left").withColumn("blocks", F.coalesce("parts", F.lit(1))).drop("parts")
    return rows.withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))


def _in_two_levels(cells: DataFrame, overlap: int) -> DataFrame:
    """Nodes of cells in shards of the clusters that each cell has of its own; tasks hold a cell's centres and PART vectors."""
    rows = cells.withColumn("cell", F.explode("shards")).drop("shards")
    sizes = written(rows.groupBy("cell").count(), "vectors-cells")
    rate = F.pmod(F.xxhash64("node", F.lit("fine")), F.lit(1 << 40)) * F.col("count") < F.lit((1 << 40) * SAMPLE)

    def fit(table: pa.Table) -> pa.Table:
        dim, n = table["dim"][0].as_py(), table["count"][0].as_py()
        sample = unit(table["vec"].to_pylist(), dim)[np.argsort(table["node"].to_numpy())]
        found = clusters(sample, max(1, min(-(-n // SHARD), MAX_CLUSTERS, len(sample))))
        return pa.table({"cell": table["cell"][:1], "centres": pa.array([found.tobytes()], pa.binary())})

    centres = written(rows.join(sizes, "cell").filter(rate.cast("boolean")).groupBy("cell").applyInArrow(fit, "cell long, centres binary"), "vectors-centres")
    parts = sizes.select("cell", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    spread = centres.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def assign(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"node": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "vec": pa.array([], pa.binary()), "copies": pa.array([], pa.int64()), "shards": pa.array([], pa.list_(pa.int64()))})
        dim, cell = table["dim"][0].as_py(), table["cell"][0].as_py()
        top = _nearest(unit(table["vec"].to_pylist(), dim), np.frombuffer(found["centres"][0].as_py()).reshape(-1, dim), overlap) + ((cell + 1) << FINE_BITS)
        return table.select(["node", "dim", "vec", "copies"]).append_column("shards", pa.array(top.tolist(), pa.list_(pa.int64())))

    fine = dealt.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInArrow(assign, PLACED)
    # COARSE lists of `overlap` shards each
    return fine.groupBy("node").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.first("copies").alias("copies"), F.flatten(F.collect_list("shards")).alias("shards"))


def build(rows: DataFrame) -> DataFrame:
    """node and neighbors: the united adjacency lists. Each block of a shard is built
    alone, and together with the one before, so that blocks overlap too."""

    def graph(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        lists = robust_pruned(unit(table["vec"].to_pylist(), table["dim"][0].as_py()))
        return pa.table({"node": nodes, "neighbors": pa.array([nodes[x].tolist() for x in lists], pa.list_(pa.int64()))})

    both = F.array(2 * F.col("block"), 2 * F.col("block") + 1, 2 * ((F.col("block") + 1) % F.col("blocks")) + 1)
    ways = F.when(F.col("blocks") > 1, both).otherwise(F.array(F.col("block")))
    dealt = rows.select("node", "dim", "vec", "shard", F.explode(F.array_distinct(ways)).alias("built"))
    lists = dealt.groupBy("shard", "built").applyInArrow(graph, "node long, neighbors array<long>")
    # a node has as many lists as it has places, each of bounded length
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbors"))).alias("neighbors"))


FOUND = "node long, n long, root long"
_FOUND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def search(rows: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """For each node and task: how many vectors it links with of those that no smaller shard holds beside it, and the smallest
    node of what the task links. A task holds a block of a shard, or two blocks that ask one another."""

    def find(table: pa.Table) -> pa.Table:
        shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
        nodes, vectors = table["node"].to_numpy(), unit(table["vec"].to_pylist(), dim)
        block = table["block"].to_numpy()
        lists = table["neighbors"].to_pylist()
        sides = [np.flatnonzero(block == b) for b in np.unique(block)]
        if table["low"][0].as_py() != table["high"][0].as_py() and len(sides) < 2:
            return pa.Table.from_batches([_batch([], _FOUND)])
        a, b = [], []
        for held in sides:
            asks = sides[1] if len(sides) == 2 and held is sides[0] else sides[0]
            number = {v: i for i, v in enumerate(nodes[held].tolist())}
            ways = lambda of: padded([np.array([number[v] for v in lists[i] or () if v in number], np.int64) for i in of])
            own = np.arange(len(held)) if len(sides) == 1 else None
            found = range_search(vectors[held], ways(held), vectors[asks], own[:, None] if own is not None else ways(asks), threshold, own)
            for t in range(0, len(asks), TILE):
                i, j = np.nonzero(found[t : t + TILE])
                if len(i):
                    p, r = local_roots(asks[t + i], held[j])
                    a.append(p)
                    b.append(r)
        label, count = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        if a:
            p, r = local_roots(np.concatenate(a), np.concatenate(b))
            label[p] = r
            count = _counts(label, vectors, sides, _smaller(table["shards"], shard), table["copies"].to_numpy(), threshold)
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        return pa.table({"node": nodes, "n": count, "root": least[label]})

    both = rows.join(graph, "node")
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = both.withColumn("other", pair).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.select("shard", "low", "high", "block", "node", "dim", "vec", "copies", "shards", "neighbors")
    return dealt.groupBy("shard", "low", "high").applyInArrow(find, FOUND)


def _smaller(shards: pa.ChunkedArray, shard: int) -> np.ndarray:
    """1 where a node (row) is also in a smaller shard (column) than this one."""
    lists = shards.to_pylist()
    others = {x: k for k, x in enumerate(sorted({x for own in lists for x in own if x < shard}))}
    out = np.zeros((len(lists), len(others)), np.float32)
    for i, own in enumerate(lists):
        for x in own:
            if x < shard:
                out[i, others[x]] = 1
    return out


def _counts(label: np.ndarray, vectors: np.ndarray, sides: list[np.ndarray], smaller: np.ndarray, copies: np.ndarray, threshold: float) -> np.ndarray:
    """Links of every row inside what the search linked together, all of them checked, but for those with rows that a smaller
    shard holds too: those are counted there. Of two sides only links from one to the other count."""
    count = np.zeros(len(label), np.int64)
    order = np.argsort(label, kind="stable")
    side = np.zeros(len(label), bool)
    side[sides[-1]] = len(sides) == 2
    for members in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(members) < 2:
            continue
        ways = [(members[~side[members]], members[side[members]])] if len(sides) == 2 else [(members, members)]
        for mine, theirs in ways:
            for t in range(0, len(mine), TILE):
                x = mine[t : t + TILE]
                near = vectors[x] @ vectors[theirs].T >= threshold
                near &= x[:, None] != theirs
                if smaller.shape[1]:
                    near &= smaller[x] @ smaller[theirs].T < 0.5
                count[x] += near @ copies[theirs]
                if len(sides) == 2:
                    count[theirs] += copies[x] @ near
    return count


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, queries: int = AUDIT) -> tuple[int, int, int, int]:
    """Of a sample of about `queries` nodes: links by brute force over all nodes and how many of them counts (node, n) has,
    nodes with links and how many of them have all."""
    asked = _drawn(nodes, nodes.count(), queries, "audit").select("node", "dim", "vec").collect()
    by_dim = {}
    for dim in {r["dim"] for r in asked}:
        own = [r for r in asked if r["dim"] == dim]
        by_dim[dim] = unit([bytes(r["vec"]) for r in own], dim), np.array([r["node"] for r in own])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: np.zeros(len(ids), np.int64) for dim, (_, ids) in by_dim.items()}
        for b in batches:
            for a in range(0, len(b), 2048):
                part = b.slice(a, 2048)
                for dim, (q, ids) in by_dim.items():
                    of = part.filter(pa.array(part["dim"].to_numpy() == dim))
                    if len(of):
                        near = q @ unit(of["vec"].to_pylist(), dim).T >= threshold
                        near &= ids[:, None] != of["node"].to_numpy()[None, :]
                        total[dim] += near @ of["copies"].to_numpy()
        rows = [(int(i), int(t)) for dim, n in total.items() for i, t in zip(by_dim[dim][1], n, strict=True) if t]
        yield _batch(rows, pa.schema([("node", pa.int64()), ("true", pa.int64())]))

    if not asked:
        return 0, 0, 0, 0
    true = nodes.select("node", "dim", "vec", "copies").mapInArrow(brute, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    got = F.least("true", F.coalesce("n", F.lit(0)))
    return tuple(x or 0 for x in true.join(counts, "node", "left").agg(F.sum("true"), F.sum(got), F.count("*"), F.count_if(got == F.col("true"))).first())


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of threshold or more), component_id (smallest vec_id that links reach)
    and kept of every row of vectors.

    vectors has vec_id and embedding, an array of numbers; other columns aren't read. Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing, and so do those without vec_id (component_id null, not kept).
    Vectors of any length link with those of equal length. Equal vectors and repeated rows link with one another; rows that
    repeat a vec_id are counted each. Empty table: no rows. The recall that the audit measures is logged; a search that
    stays under LEAST raises an error."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = rows.mapInArrow(_vectors, NODE)
    named = written(usable.select("vec_id", "node"), "vectors-named")
    nodes = usable.groupBy("node").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("copies"))
    nodes = written(nodes, "vectors-nodes")
    for wider in range(3):
        placed = place(nodes, overlap + 2 * wider)
        graph = written(build(placed), "vectors-graph")
        found = written(search(placed, graph, threshold), "vectors-found")
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        true, got, asked, whole = audit(nodes, counts, threshold)
        log.info("recall of links %.4f of %d, vectors with all their links %.4f of %d", got / max(true, 1), true, whole / max(asked, 1), asked)
        drop_written(graph)
        if got >= AIM * true and whole >= AIM * asked:
            break
    if got < LEAST * true:
        raise RuntimeError(f"near vectors: {got} of {true} links found on the audited sample, less than {LEAST:.0%}")
    roots = connected(found.filter("node != root"), "node", "root")
    firsts = named.groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = firsts.join(counts, "node", "left").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    classes = written(classes.select("node", "first", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("class")), "vectors-classes")
    smallest = written(classes.groupBy("class").agg(F.min("first").alias("component_id")), "vectors-components").withColumnRenamed("class", "of")
    answers = written(classes.join(smallest, F.col("class") == F.col("of")).select("node", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"), "vectors-answers")
    for done in (nodes, found, roots, classes, smallest):
        drop_written(done)
    answered = named.join(answers, "node").select("vec_id", "n_links", "component_id")
    alone = rows.mapInArrow(_others, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = answered.unionAll(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that _vectors leaves out."""
    for batch in batches:
        out = []
        for vec_id, x in zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True):
            usable = vec_id is not None and bool(x) and not any(v is None for v in x)
            if usable:
                wide = np.array(x, np.float64)
                usable = bool(np.isfinite(wide).all() and wide.any())
            if not usable:
                out.append((vec_id,))
        yield _batch(out, pa.schema([("vec_id", pa.int64())]))
