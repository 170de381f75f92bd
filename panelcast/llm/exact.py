"""Exact duplicates by distributed MSD radix partitioning of the texts' bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import stored, text_or_empty

#: Bytes that the first digit covers, the factor from digit to digit, and the widest digit.
FIRST_DIGIT, GROWTH, WIDEST = 64, 8, 1 << 20


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """Groups of equal texts; the row with the largest doc_id of a group stays.

    Most significant digit first: each round splits every group by the next bytes of
    its texts. A group of one row is done, as is a group whose texts have ended, for its
    rows agree in every byte; all others go on with what is left of their texts. A digit
    is a run of bytes that grows from round to round, so a text of n bytes takes about
    log(n) rounds. Bytes are compared themselves, no digest decides.

    Group sizes are partial aggregates, so a text that a third of the rows share is combined
    on the map side, and the join back to the rows is a skewed join that adaptive execution splits.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256. A null text
    counts as empty, and empty texts are equal to each other. Rows with the same doc_id and
    text are copies as well: one of them stays. A null doc_id is smaller than any other.
    An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.encode(text_or_empty(), "UTF-8").alias("rest")).select(
        "doc_id", F.sha2("rest", 256).alias("text_sha256"), F.substring("rest", 1, first_digit).alias("digit"), "rest"
    )
    shared = rows.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("digit").alias("group"))
    after = F.expr(f"substring(rest, {first_digit + 1})")
    table = stored(
        rows.join(shared, rows["digit"] == shared["group"], "left").select(
            "doc_id",
            "text_sha256",
            "group",
            F.when(F.col("group").isNotNull(), after).alias("rest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "radix",
    )
    alone = table.filter("group is null")
    done = [
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    ]
    alive, width = table.filter("group is not null"), first_digit
    while not alive.isEmpty():
        width = min(width * growth, widest)
        table = stored(_split(alive, width), "radix")
        done.append(table.filter("done").select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
        alive = table.filter("not done").select("doc_id", "text_sha256", "group", "rest", "row")
    return reduce(DataFrame.unionByName, done)


def _split(alive: DataFrame, width: int) -> DataFrame:
    """One round: the groups by the next `width` bytes, and which of them need no further round."""
    rows = alive.withColumn("digit", F.substring("rest", 1, width))
    sizes = rows.groupBy("group", "digit").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top"))
    return rows.join(sizes, ["group", "digit"]).select(
        "doc_id",
        "text_sha256",
        "row",
        "group_size",
        F.col("top.doc_id").alias("keep_id"),
        (F.col("row") == F.col("top.row")).alias("kept"),
        ((F.col("group_size") == 1) | (F.octet_length("digit") < width)).alias("done"),
        F.col("top.row").cast("string").cast("binary").alias("group"),
        F.expr(f"substring(rest, {width + 1})").alias("rest"),
    )
