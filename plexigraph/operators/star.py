"""Star reads around a center, by the prefixes of edge handles (blocks, transactions, addresses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import Snapshot

BLOCK_TX, TX_OUT, CONSUMED_BY = "BLOCK_TX_", "TXOUT_", "CTX_"


def get_block(snap: Snapshot, blocks: DataFrame | None = None, prefix: str = BLOCK_TX) -> DataFrame:
    """(handle, txs array, num_nodes_read): a block's transactions; 1 node read if there is none, else 2 + their number."""
    rows = snap.nodes.rows.select("handle") if blocks is None else snap.nodes.rows.join(blocks, "handle", "left_semi").select("handle")
    ties = snap.edges.rows.filter(F.col("handle").startswith(prefix)).groupBy(F.col("src").alias("block")).agg(F.sort_array(F.collect_set("dst")).alias("txs"))
    out = rows.join(ties, rows["handle"] == ties["block"], "left").select("handle", F.coalesce("txs", F.array().cast("array<string>")).alias("txs"))
    return out.withColumn("num_nodes_read", F.when(F.size("txs") == 0, 1).otherwise(F.size("txs") + 2).cast("bigint"))


def get_tx(snap: Snapshot, txs: DataFrame | None = None) -> DataFrame:
    """(src, handle, dst, consumed): a transaction's edges; an output edge names the transaction that consumes it.

    Output TXOUT_x and consumption CTX_x are edges of one node with the same suffix.
    """
    own = snap.edges.rows.select("src", "handle", "dst")
    if txs is not None:
        own = own.join(txs.select(F.col("handle").alias("src")), "src", "left_semi")
    spent = own.filter(F.col("handle").startswith(CONSUMED_BY)).select("src", F.substring("handle", len(CONSUMED_BY) + 1, 1 << 30).alias("x"), F.col("dst").alias("consumed"))
    outs = own.filter(F.col("handle").startswith(TX_OUT)).withColumn("x", F.substring("handle", len(TX_OUT) + 1, 1 << 30))
    joined = outs.join(spent, ["src", "x"], "left").select("src", "handle", "dst", "consumed")
    return joined.unionByName(own.filter(~F.col("handle").startswith(TX_OUT)).withColumn("consumed", F.lit(None).cast("string")))


def get_address(snap: Snapshot, addresses: DataFrame | None = None) -> DataFrame:
    """(address, tx): the distinct transactions next to each address."""
    rows = snap.edges.rows if addresses is None else snap.edges.rows.join(addresses.select(F.col("handle").alias("src")), "src", "left_semi")
    return rows.select(F.col("src").alias("address"), F.col("dst").alias("tx")).distinct()
