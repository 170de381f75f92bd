"""What the corpus operators share: stored tables, distributed numbering, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.session import write_table

#: A word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: monotonically_increasing_id() counts the rows of a partition in its low 33 bits.
ROW_BITS = (1 << 33) - 1


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table below the shared folder: a lost executor costs no recomputation. See also `discard`."""
    return write_table(df.sparkSession, df, name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


#: Bits of a sieve: 1 MB, whatever the number of keys.
SIEVE_BITS = 1 << 23


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits the rows into those whose key may be among the wanted ones, and those whose key is surely not.

    Hashes of the wanted keys set bits of a bitmap of fixed size, so what is broadcast is bounded. Rows
    whose bit is not set need no join and no shuffle. The more keys are wanted, the more other rows
    come with the first part; a join decides about them, so the result is the same at every size.
    """

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS)).cast("long")

    bits = (
        wanted.select(place(F.col(key)).alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    )
    at = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    marked = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(F.col(key))) == F.col("_bucket"), "left").withColumn("_maybe", maybe)
    return marked.filter("_maybe").select(*rows.columns), marked.filter("not _maybe").select(*rows.columns)


def numbered(df: DataFrame, group: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds `_index`, gapless from 0 within the group, in the given order.

    With a value column also `_before`: the sum of the values ahead of the row in its group.
    No task holds a whole group: rows are dealt by range of (group, order), each block
    counts its own, and the counts of the blocks ahead are added. The only table that
    windows see by group has one row per group and block. Rows that tie on all the
    order columns are dealt by an arbitrary id, so they can be split as well.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    dealt = stored(
        tied.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_block", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))),
        "numbered",
    )
    sums = [F.sum(value).alias("_sum")] if value else []
    blocks = dealt.groupBy(*group, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"), *sums)
    ahead = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_block").alias("_b"),
        "_first",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_skip"),
        *([F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_skip_sum")] if value else []),
    )
    condition = dealt["_block"] == offsets["_b"]
    for i, g in enumerate(group):
        condition = condition & dealt[g].eqNullSafe(offsets[f"_g{i}"])
    if value:
        inside = Window.partitionBy("_block", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        condition = dealt["_block"] == offsets["_b"]
        for i, g in enumerate(group):
            condition = condition & dealt[g].eqNullSafe(offsets[f"_g{i}"])
    out = dealt.join(offsets, condition).withColumn("_index", F.col("_skip") + F.col("_at") - F.col("_first"))
    if value:
        out = out.withColumn("_before", F.col("_skip_sum") + F.col("_inside"))
    return out.drop("_block", "_at", "_b", "_first", "_skip", "_skip_sum", "_inside", *[f"_g{i}" for i in range(len(group))])


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The values of the key, without null, that have the smallest hashes: `rows` at most, whatever the layout of the table.

    Rows are counted, and keys above the hash that some four times as many would lie below are dropped where they are read, so
    no task collects more than a few times `rows` keys. Of a key that repeats, fewer different values are drawn.
    """
    total = df.count()
    share = min(1.0, 4.0 * rows / max(total, 1))
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    hashed = df.select(key, F.xxhash64(key).alias("_draw")).filter(F.col(key).isNotNull() & (F.col("_draw") <= F.lit(limit)))
    return hashed.sort("_draw", key).limit(rows).select(key).distinct()
