"""Connected components of an edge list, by alternating large and small stars over tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCHEMA = "node long, root long"


def local_stars(batches):
    """The edges of one task as stars: each node with the smallest node that the task's own edges reach."""
    for batch in batches:
        a, b = (np.asarray(batch.column(k)) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label, u, v = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
        while True:  # hooking and pointer jumping
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = np.minimum(new[new], new)
            if (new == label).all():
                break
            label = new
        far = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], ["node", "root"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of the edges' first two columns that isn't its component's smallest.

    Each round is written to the shared folder; their number grows with the logarithm of the number of nodes.
    """
    stars = materialise(edges.mapInArrow(local_stars, SCHEMA).distinct(), name)
    while True:
        # large star: all larger neighbours of a node, and the node itself, to its smallest neighbour
        both = stars.select("node", F.col("root").alias("other")).unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("other")))
        low = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"))
        large = both.where("other > node").join(low, "node").select(F.col("other").alias("node"), F.col("low").alias("root")).where("node <> root").distinct()
        # small star: all smaller neighbours of a node, and the node, to the smallest of them
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root")).unionByName(low.select("node", F.col("low").alias("root"))).where("node <> root").distinct()
        new = materialise(small, name)
        changed = new.join(stars, ["node", "root"], "left_anti").isEmpty() and new.count() == stars.count()
        if changed:
            return new
        stars = new
