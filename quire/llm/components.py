"""Connected components of a link table, by local contraction and large-star / small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import drop_written, written

LINKS = "node long, root long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a[i], b[i]), and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, as one link from each node to its smallest: folded whenever a million have gathered."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def fold() -> None:
        nonlocal n
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        differ = nodes != roots
        held[:] = [(nodes[differ], roots[differ])]
        n = 0

    for batch in batches:
        held.append((batch["node"].to_numpy(), batch["root"].to_numpy()))
        n += len(batch)
        if n > 1_000_000:
            fold()
    if held:
        fold()
        nodes, roots = held[0]
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000]), pa.array(roots[at : at + 50_000])], names=["node", "root"])


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root of every linked node: root is the smallest node reachable, itself included.

    links has two bigint columns; rows with a null end and links of a node to itself don't count, repeated links count
    once. Empty table: no rows. Every round contracts the links inside each task, then links all neighbours of a node to
    the smallest of them, larger neighbours first (large star), then smaller ones (small star). Each round is written
    to the shared folder; the rounds end when every node has one link, to a node that has none."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = links.filter((x != y) & x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("node"), F.least(x, y).alias("root"))
    now = written(now.repartition(F.col("node")).mapInArrow(_contract, LINKS), "links")
    while True:
        per_node = now.groupBy("node").agg(F.count("*").alias("n"))
        loose = per_node.filter("n > 1").select(F.lit(1).alias("x"))
        inner = now.select("root").join(per_node, now["root"] == per_node["node"], "left_semi").select(F.lit(1).alias("x"))
        if loose.unionAll(inner).isEmpty():
            return now
        both = now.unionAll(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select(F.col("node").alias("at"), F.least("least", "node").alias("least"))
        large = both.filter("root > node").join(least, F.col("node") == F.col("at")).select(F.col("root").alias("node"), F.col("least").alias("root"))
        low = large.groupBy("node").agg(F.min("root").alias("least")).withColumnRenamed("node", "at")
        small = large.join(low, F.col("node") == F.col("at"))
        small = small.select(F.greatest("root", "least").alias("node"), F.col("least").alias("root")).filter("node != root").unionAll(low.select(F.col("at").alias("node"), F.col("least").alias("root")))
        before, now = now, written(small.distinct().repartition(F.col("node")).mapInArrow(_contract, LINKS), "links")
        drop_written(before)
