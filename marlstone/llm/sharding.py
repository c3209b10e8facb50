"""Sharding: vector bin packing of groups of documents by bytes, tokens and rows at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import sized, staged, table

DIMENSIONS = ["size", "tokens", "rows"]
#: What the dimensions count for in the dot product. The last groups to be placed are short texts,
#: which are rows above all; the weights let them even out bytes and tokens.
WEIGHTS = (30.0, 10.0, 1.0)


def place(
    vectors: np.ndarray, room: np.ndarray, scale: np.ndarray | None = None, first: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each row of ``vectors``, placed largest first, and the room that is left.

    A vector goes where its dot product with the residual capacity is highest. ``room`` has the
    capacity of each shard in each dimension; both are divided by ``scale``, by default the mean
    capacity, and weighted by WEIGHTS where the dimensions are its. Ties go to the shard that comes
    first, counting from ``first``.
    """
    mean = room.mean(axis=0) if scale is None else scale
    mean = np.where(mean > 0, mean, 1.0)
    scaled, residual = vectors / mean, np.roll(room / mean, -first, axis=0)
    weighted = scaled * (WEIGHTS if vectors.shape[1] == len(WEIGHTS) else 1.0)
    out = np.empty(len(vectors), dtype=np.int64)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        best = int(np.argmax(residual @ weighted[i]))
        residual[best] -= scaled[i]
        out[i] = (best + first) % len(room)
    return out, np.roll(residual, first, axis=0) * mean


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    tokens: Column | None = None,
    items_a_bin: int = 50_000,
    most_bins: int = 4096,
    rows_a_slice: int = 100_000,
) -> DataFrame:
    """Put every document into one of ``shards`` shards whose sizes are near equal.

    Documents of equal text form a group, and a group stays together unless it holds more than a
    whole shard in any of the dimensions bytes, tokens and rows; then its rows are dealt by hash into
    parts of about 1 / 64 of a shard. The rows of groups of more than a quarter of a shard are dealt
    so as well, but only to spread the work: their parts go to one shard. Groups and parts that weigh enough to matter to a bin,
    at most 96 for each bin and shard of eight, are placed by :func:`place` first. All others are
    dealt by hash into bins of about ``items_a_bin``; each bin is packed in one task into an equal
    part of the room that is left. However many bins there are, no more is placed first, on the
    driver, than ``most_bins`` of them would have; that is less than a 16,000th of a shard each.

    ``tokens`` counts the tokens of a row; by default they are runs of non-space characters.

    Returns one row per input row: doc_id, size (UTF-8 bytes plus 1), tokens, text_crc32 (unsigned),
    shard, slot (gapless from 0 in each shard, by slices of about ``rows_a_slice``). Null and empty
    texts form one group of size 1 a row; texts are measured whole; null and repeated doc_ids are
    sharded row by row; columns of other names play no part; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            (tokens if tokens is not None else F.regexp_count(text, F.lit(r"\S+"))).cast("long").alias("tokens"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("group"),
            # numbered when written; ids may be null or repeated
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = groups.agg(F.count(F.lit(1)).alias("groups"), *[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    totals = np.array([float(total[d] or 0) for d in DIMENSIONS])
    bins = max(1, -(-total.groups // items_a_bin))
    share = F.greatest(*[F.col(d) / F.lit(max(1.0, x)) for d, x in zip(DIMENSIONS, totals.tolist(), strict=True)])
    huge = groups.filter(share * (4 * shards) > 1).select(
        "group", F.ceil(share * (64 * shards)).alias("parts"), (share * shards <= 1).alias("whole")
    )

    parted = rows.join(sized(staged(huge, "shard-huge")), "group", "left").withColumn(
        "part",
        F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(
            F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts"))
        ),
    )
    items = staged(
        parted.groupBy("group", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("part")).alias("part"))
        .agg(
            F.sum("size").alias("size"),
            F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.max(F.when(F.col("whole"), F.col("parts"))), F.lit(1)).alias("parts"),
        )
        .withColumn("heavy", share * (shards * max(64, 4 * min(bins, most_bins))) > 1),
        "shard-items",
    )
    heavy = items.filter("heavy").orderBy("group", "part").toPandas()
    room = np.tile(totals / shards, (shards, 1))
    where, room = place(heavy[DIMENSIONS].to_numpy(dtype=np.float64).reshape(-1, 3), room)
    rows_placed = [
        (bytes(g), int(p) + k, int(w))
        for g, p, n, w in zip(heavy["group"], heavy["part"], heavy["parts"], where, strict=True)
        for k in range(int(n))
    ]
    room, mean = room / bins, totals / shards / bins

    def fill(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["group", "part"], kind="stable")
        found, _ = place(own[DIMENSIONS].to_numpy(dtype=np.float64), room, mean, int(own["bin"].iloc[0]) % shards)
        return own[["group", "part"]].assign(shard=found)

    kind = "group binary, part long, shard int"
    light = items.filter("NOT heavy").withColumn("bin", F.pmod(F.xxhash64("group", "part"), F.lit(bins)))
    placed = light.groupBy("bin").applyInPandas(fill, kind).unionByName(docs.sparkSession.createDataFrame(rows_placed, kind))

    slices = max(1, -(-(total["rows"] or 0) // rows_a_slice))
    sharded = staged(
        parted.join(placed, ["group", "part"]).select(
            "doc_id",
            "size",
            "tokens",
            "text_crc32",
            "shard",
            F.pmod(F.xxhash64("row", F.lit("slice")), F.lit(slices)).alias("slice"),
        ),
        "shard-placed",
    )
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sharded.groupBy("shard", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    nth = F.row_number().over(W.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size"))
    return (
        sharded.withColumn("nth", nth)
        .join(offsets, ["shard", "slice"])
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all ``documents`` into shards 0 to 7 of near equal size."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
