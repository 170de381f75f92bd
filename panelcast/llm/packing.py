"""Packing into optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import numbered, text_or_empty, word_count

#: Longest sequence, buckets, and padded tokens of a batch.
LONGEST, BUCKETS, BATCH_TOKENS = 2048, 16, 65536


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding in all.

    Dynamic programming over the lengths that occur: the best cover of the first j lengths with k
    buckets ends in a bucket from some i to j, padded to length j. Padded tokens of that
    bucket are length j times its rows; subtracting the tokens themselves is a
    constant. Of equal totals, the fewest buckets and the earliest cut are taken.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    rows = np.concatenate([[0], np.cumsum([histogram[int(n)] for n in lengths])]).astype(np.int64)
    best = np.concatenate([[0], lengths * rows[1:]])
    cuts = [np.zeros(len(lengths) + 1, dtype=np.int64)]
    totals = [int(best[-1])]
    for _ in range(1, min(buckets, len(lengths))):
        now, cut = np.zeros_like(best), np.zeros(len(best), dtype=np.int64)
        for j in range(1, len(best)):
            costs = best[:j] + lengths[j - 1] * (rows[j] - rows[:j])
            cut[j] = int(np.argmin(costs))
            now[j] = costs[cut[j]]
        best = now
        cuts.append(cut)
        totals.append(int(best[-1]))
    level, j, ends = int(np.argmin(totals)), len(lengths), []
    while j > 0:
        ends.append(int(lengths[j - 1]))
        j = int(cuts[level][j])
        level -= 1
    return ends[::-1]


def packed(
    docs: DataFrame,
    tokens: Column | None = None,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """Every token of every document in one sequence of one batch.

    tokens counts a document's tokens, by default its words. A document longer than
    `longest` becomes several sequences, so no token is lost. The histogram of sequence lengths has
    at most `longest` entries whatever the corpus, and is all that the driver sees; the bucket
    ends follow from it. A batch holds as many rows of one bucket as fit into `batch_tokens`
    when padded to the bucket's end, at least one.

    One row per sequence: doc_id, piece, start (first token), n_tokens, bucket, bucket_len,
    batch (numbered within the bucket), place (in the batch), padding. A null, empty or blank
    text has no tokens: one row with piece 0, n_tokens 0 and null bucket, batch and place. Repeated rows are packed as often as they occur. An
    empty table gives no rows. Other columns are not read.
    """
    count = word_count(text_or_empty()) if tokens is None else F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.floor((F.col("_total") - 1) / F.lit(longest)), F.lit(0)).cast("long")
    pieces = (
        docs.select("doc_id", count.alias("_total"))
        .select("doc_id", "_total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * longest).alias("start"),
            F.least(F.col("_total") - F.col("piece") * longest, F.lit(longest)).cast("long").alias("n_tokens"),
        )
    )
    histogram = {r[0]: r[1] for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}
    ends = boundaries(histogram, buckets)
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for place, end in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(place)).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(size)
    full = F.col("n_tokens") > 0
    rows = pieces.select("*", F.when(full, bucket).alias("bucket"), F.when(full, size).alias("bucket_len"))
    fit = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_len")), F.lit(1)).cast("long")
    return numbered(rows, ["bucket"], ["doc_id", "piece"]).select(
        "doc_id",
        "piece",
        "start",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(F.col("_index") / fit).cast("long").alias("batch"),
        F.when(F.col("bucket").isNotNull(), F.col("_index") % fit).cast("long").alias("place"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
