"""Connected components of an edge table by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


SALTS = 8
BROADCAST_BYTES = 8 << 20


def follow(rows: DataFrame, key: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``table`` that has their key, without a task that gets all rows of a busy key.

    A table that is small by the size of its files is broadcast; for any other, rows are dealt
    over SALTS tasks a key, and the table is repeated for these.
    """
    if int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(SALTS)).cast("int")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b); label is the least id of the component.

    Each round points every vertex at its least neighbour, shortens these chains twice by
    joining the pointers with themselves, and contracts the edges onto what is pointed at.  Joins
    on what many point at are salted, so a hub's component is no one task's.
    Rounds are written to the shared folder, so lineage stays short.
    """
    edges = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        point = materialize(point, "pointers")
        for _ in range(2):
            onward = point.select(F.col("id").alias("to"), F.col("to").alias("further"))
            point = follow(point, "to", onward).select("id", F.col("further").alias("to"))
        point = materialize(point, "pointers")
        if labels is None:
            labels = point.select("id", F.col("to").alias("label"))
        else:
            labels = follow(labels, "label", point.select(F.col("id").alias("label"), "to"), "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = materialize(labels, "labels")
        one = follow(edges, "a", point.select(F.col("id").alias("a"), F.col("to").alias("x")))
        two = follow(one, "b", point.select(F.col("id").alias("b"), F.col("to").alias("y")))
        edges = materialize(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels
