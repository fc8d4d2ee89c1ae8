"""Exact dedup: two passes of Bloom filtering decide which rows shuffle at all.

Pass 1 reads the texts and fills a counting Bloom filter of ``SLOTS_PER_ROW`` counters a row: each
partition counts the slots its hashes fall into, the counters are merged by slot, and slots that no
row falls into take no space. Neither texts nor hashes travel. The slots counted twice or more go
into a blocked Bloom filter (blocks of 32,768 bits, four bits a slot). Pass 2 reads the texts again
and probes that filter by a join on the block number. Rows that miss it are unique and pass straight
through. Rows that hit it, true repeats and a few false positives, are grouped by SHA-256 and decided
exactly, so the filters never change a result.

The second filter is broadcast; it grows with the slots counted twice up to ``max_filter_blocks``
(4 KiB each). Beyond that it fills up and lets more unique rows through to the exact decision.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, ascii_lower, kept_rows, replace_columns, table, text_or_empty

BLOCK_BITS = 32_768
PROBES = 4
#: Counters of pass 1 for each row: about 1.6 % of unique rows share one with another row.
SLOTS_PER_ROW = 64
#: Bits of the filter for each slot counted twice: about 0.3 % false positives at four probes.
BITS_PER_SLOT = 16
#: 64 MiB of filter at most.
MAX_FILTER_BLOCKS = 16_384
#: Groups with a HOT_GROUPS-th of all repeated rows, and HOT_LEAST rows, are dealt to SALTS partitions.
HOT_GROUPS, HOT_LEAST, SALTS = 500, 1000, 64

OUTPUTS = ["keep_id", "group_size", "kept", "text_sha256"]


def _probe_bits(key: Column) -> list[Column]:
    """The bits of a slot inside its block, from 15-bit slices of a hash."""
    second = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(second, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(PROBES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(blocks).cast("bigint"))


def _bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit.bitwiseAND(7)).cast("int")) != 0


def build_filter(slots: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row a non-empty block: its number and a 4 KiB bitmap."""
    bits = F.explode(F.array(*_probe_bits(F.col(key))))
    return (
        slots.select(_block(F.col(key), blocks).alias("__block"), bits.alias("__bit"))
        .groupBy("__block")
        .agg(F.bitmap_construct_agg(F.col("__bit")).alias("__bitmap"))
    )


def annotate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_filter_blocks: int = MAX_FILTER_BLOCKS,
    slots_per_row: float = SLOTS_PER_ROW,
    hot_least: int = HOT_LEAST,
) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest id of a group stays. A null id sorts below all others. Rows that repeat both text and
    id are copies like any other: exactly one of them is kept. Input columns named like an output
    are replaced. ``docs`` must be a stable scan, such as a Parquet table, because it is read twice.
    """
    docs = replace_columns(docs, OUTPUTS)
    text = text_or_empty(text_col)
    # Equal under A-Z lower-casing implies equal under full lower-casing, which is cheaper.
    scratch = Scratch(docs.sparkSession)
    width = max(1, math.ceil(math.log2(max(1, docs.count()) * slots_per_row + 1)))
    slot = F.shiftrightunsigned(F.xxhash64(F.lower(text)), 64 - width)
    counters = docs.select(slot.alias("__slot")).groupBy("__slot").agg(F.count(F.lit(1)).alias("n"))
    twice = scratch.put("twice", counters.where("n > 1").select("__slot"))
    blocks = min(max(1, math.ceil(twice.count() * BITS_PER_SLOT / BLOCK_BITS)), max_filter_blocks)

    rows = docs.withColumns({"__slot": slot, "__row": F.monotonically_increasing_id()})
    bloom = F.broadcast(build_filter(twice, "__slot", blocks))
    hit = F.col("__bitmap").isNotNull()
    for bit in _probe_bits(F.col("__slot")):
        hit = hit & _bit_is_set(F.col("__bitmap"), bit)
    probed = rows.withColumn("__block", _block(F.col("__slot"), blocks)).join(bloom, "__block", "left")
    marked = probed.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__block", "__bitmap")

    digest = F.sha2(ascii_lower(text).cast("binary"), 256)
    columns = [F.col(c) for c in docs.columns]
    straight = marked.where(~F.col("__hit")).select(
        *columns,
        F.col(id_col).alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        digest.alias("text_sha256"),
    )
    suspects = marked.where("__hit").withColumn("text_sha256", digest)
    groups = scratch.put(
        "groups",
        suspects.groupBy("text_sha256").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("__best"),
        ),
    )
    # Fewer than HOT_GROUPS groups can hold that share of the rows, which bounds the broadcast.
    rows_in_groups = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") >= max(hot_least, -(-rows_in_groups // HOT_GROUPS))
    known_hot = F.broadcast(groups.where(hot).select("text_sha256", F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod("__row", F.lit(SALTS))).otherwise(F.lit(0).cast("bigint"))
    spread = F.when(hot, F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))
    salted = groups.withColumn("__salt", F.explode(spread))
    decided = (
        suspects.join(known_hot, "text_sha256", "left")
        .withColumn("__salt", salt)
        .join(salted, ["text_sha256", "__salt"])
        .select(
            *columns,
            F.col("__best.id").alias("keep_id"),
            "group_size",
            (F.col("__row") == F.col("__best.row")).alias("kept"),
            "text_sha256",
        )
    )
    return straight.unionByName(decided)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return kept_rows(docs, lambda d: annotate(d, id_col, text_col), OUTPUTS, "kept")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the copy that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs).select("doc_id", *OUTPUTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_exact_dedup": op1_exact_dedup}

ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """
}
