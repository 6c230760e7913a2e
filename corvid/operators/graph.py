"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.plans.scratch import materialise


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest reachable node for every node of ``edges(src, dst)``.

    Each round takes the smallest label among a node and its neighbours, then
    jumps to the label of that label, so a path of n nodes needs about log(n)
    rounds. Edges stay as they came: no node gathers its component's rows.
    Both joins read written tables, so Spark can split a frequent key.
    Self-loops and repeated edges are allowed; rows with a null end are
    ignored; labels that have not settled after ``max_rounds`` raise. Returns ``(node, component)``, one row per node.
    """
    known = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    both = known.select("src", "dst").unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = materialise(both.distinct(), "links")
    labels = materialise(links.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("label")), "labels")
    for _ in range(max_rounds):
        heard = links.join(labels, links.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        lower = materialise(labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")), "labels")
        if not lower.where("moved").limit(1).count():
            break
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialise(lower.join(target, "label").select("node", F.col("further").alias("label")), "labels")
    else:
        raise RuntimeError(f"labels have not settled in {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
