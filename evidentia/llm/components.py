"""Connected components of a table of links: least labels spread over links, then labels jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import discard, written


#: A label's rows are dealt to so many keys.
SALTS = 16


def with_label(rows: DataFrame, of_label: DataFrame, label: str) -> DataFrame:
    """rows joined with a table of one row a label; the rows of a giant component are dealt to SALTS keys, its one row is copied."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = of_label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [label, "_salt"]).drop("_salt")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node of its component) of every node of links; a chain of n nodes takes about log n rounds."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("l"))
        spread = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        # every label is a node, and its own label is never greater; only nodes that are labels are looked up
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("l2")).join(labels.select("label").distinct(), "label", "left_semi")
        new = with_label(spread, jump, "label").select("node", F.least("label", "l2").alias("label"), (F.least("label", "l2") != F.col("old")).alias("moved"))
        new = written(new, "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        if not moved:
            discard(both)
            return labels
