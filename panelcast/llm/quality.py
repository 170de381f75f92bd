"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import words
from panelcast.llm.common import sieved, stored

#: Buckets of the hashed words and word pairs.
BUCKETS = 16384
#: Share of the trusted documents that may fall below the threshold, and the step in which scores are counted.
BELOW, STEP = 0.001, 0.001
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _buckets(hashed: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and word pair, with the row it belongs to."""
    pairs = words.grams(hashed, 2)
    inside = owner[1:] == owner[:-1]
    found = np.concatenate([hashed, pairs[inside]])
    return (found % np.uint64(size)).astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a text column: rows, bytes, offsets, and words with their row."""
    data, offsets = words.texts(column)
    for first, last in words.chunks(data, offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        start, end, ahead = words.spans(part, at)
        owner = np.repeat(np.arange(last - first), np.diff(ahead))
        yield first, last, part, at, start, end, ahead, owner


def bucket_counts(docs: DataFrame, size: int = BUCKETS) -> np.ndarray:
    """n-grams by bucket in the documents. Each task adds up its own buckets and hands on at most `size` rows; the driver gets `size` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, part, _, start, end, _, owner in _parts(batch.column(0)):
                total += np.bincount(_buckets(words.hashes(part, start, end, lower=True), owner, size)[0], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    parts = docs.select(F.col("text").alias("body")).mapInArrow(count, "bucket long, n long")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def corpus_counts(docs: DataFrame, trusted: DataFrame, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket in all documents, and in the trusted ones.

    trusted: doc_id, of any number of rows. All documents are counted where they are read; only texts that a sieve of the
    trusted ids leaves are shuffled for the join.
    """
    some = sieved(docs.select("doc_id", "text"), "doc_id", trusted)[0]
    return bucket_counts(docs, size), bucket_counts(some.join(trusted.select("doc_id"), "doc_id", "left_semi"), size)


def ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw), one added to each count; 0 everywhere without trusted text."""
    if not good.sum():
        return np.zeros(len(raw))
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def _repeats(hashed: np.ndarray, ahead: np.ndarray, width: int = 8) -> np.ndarray:
    """For each row, the words inside windows of `width` words that the row has twice or more."""
    out = np.zeros(len(ahead) - 1, np.int64)
    windows = words.grams(hashed, width)
    for row in np.flatnonzero(np.diff(ahead) > width):
        first, last = ahead[row], ahead[row + 1]
        own = windows[first : last - width + 1]
        order = np.sort(own)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(own, twice))
            edge = np.zeros(last - first + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
            out[row] = int((np.cumsum(edge)[:-1] > 0).sum())
    return out


def _copied_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen, copies = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            copies += bool(line.split())
        else:
            seen.add(line)
    return copies


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, the counts in MEASURES and `score`: the mean ratio of the text's words and word pairs, null without words."""
    size = len(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, part, at, start, end, ahead, owner in _parts(batch.column(1)):
                n = last - first
                hashed = words.hashes(part, start, end)
                found, row = _buckets(words.hashes(part, start, end, lower=True), owner, size)
                total = np.bincount(row, model[found], minlength=n)
                many = np.bincount(row, minlength=n)
                blank = (part == 32) | ((part >= 9) & (part <= 13))
                points = np.concatenate([[0], np.cumsum(((part & 0xC0) != 0x80) & ~blank)])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[part])])
                lines = [_copied_lines(part[at[i] : at[i + 1]].tobytes()) for i in range(n)]
                score = pa.array(total / np.maximum(many, 1), mask=many == 0)
                counts = [np.diff(ahead), np.diff(points[at]), np.diff(symbols[at]), np.array(lines, np.int64), _repeats(hashed, ahead)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *[pa.array(c, pa.int64()) for c in counts], score], names=["doc_id", *MEASURES, "score"]
                )

    rows = docs.select("doc_id", F.col("text").alias("body"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {', '.join(f'{m} long' for m in MEASURES)}, score double"
    return rows.mapInArrow(measure, schema)


def judged(docs: DataFrame, trusted: DataFrame, size: int = BUCKETS, below: float = BELOW) -> DataFrame:
    """The verdict on every document: base rules first, then its score against one threshold.

    Two multinomials over hashed words and word pairs are counted, one over the trusted documents, one over all. A
    document's score is the log of their ratio, divided by its n-grams. The threshold is the
    largest score, in steps of STEP, below which at most `below` of the trusted documents lie that
    pass the base rules; the same threshold holds for every document, without chance.

    trusted: doc_id of all trusted documents (see `trusted_labels`), however many; repeated ones count once. Without any, the
    score of all is 0 and the base rules decide.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under 20 words, or over 30 % of them repeated), score, threshold, kept. A null text
    is empty, fails the base rules and has no score. Repeated rows are judged each and alike. An empty
    table gives no rows. Windows and n-grams are compared by 64-bit hashes. Other columns are not read.
    """
    model = ratios(*corpus_counts(docs, trusted, size))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stored(measured(docs, model).withColumn("base_failed", failed), "measured")
    known = rows.join(trusted.select("doc_id"), "doc_id", "left_semi").filter(~F.col("base_failed"))
    steps = known.groupBy(F.floor(F.col("score") / STEP).cast("long").alias("step")).count().sort("step").collect()
    allowed, cut = below * sum(r["count"] for r in steps), None
    for r in steps:
        cut = r["step"] * STEP
        allowed -= r["count"]
        if allowed < 0:
            break
    limit = F.lit(cut).cast("double")
    kept = ~F.col("base_failed") & (F.lit(cut is None) | F.coalesce(F.col("score") >= limit, F.lit(False)))
    return rows.withColumn("threshold", limit).withColumn("kept", kept)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()
