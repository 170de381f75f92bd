"""Periodic runs of words: enhanced suffix arrays and the branching-tandem test on their LCP intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import WORD, text_or_empty

#: Repeats of the period, and words, that a run has at least.
EXPONENT, LENGTH = 4, 6
#: Bytes of text whose suffixes are sorted together, unless one text alone is longer.
CHUNK = 1 << 20


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and the ranks by the first 1, 2, 4, ... codes, of sequences that share no code.

    Prefix doubling. ends: for each place the end of its sequence; a suffix ends there. Only suffixes that
    are not yet alone in their rank are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    alone = fresh & np.concatenate([fresh[1:], [True]])
    slots = np.flatnonzero(~alone)
    while len(slots):
        places = order[slots]
        after = places + width
        second = np.where(after < ends[places], rank[np.minimum(after, n - 1)] + 1, 0)
        keys = rank[places] * (n + 1) + second
        by = np.argsort(keys, kind="stable")
        places, keys = places[by], keys[by]
        order[slots] = places
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[places] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        levels.append(rank.astype(np.int32))
        slots = slots[~(fresh & np.concatenate([fresh[1:], [True]]))]
        width *= 2
    return order, rank, levels


def common_prefixes(order: np.ndarray, ends: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each slot the longest common prefix of its suffix and the one ahead of it; 0 for the first.

    Two suffixes agree in the next 2^k codes if their ranks of level k are the same, from the largest k down.
    """
    n = len(order)
    a, b, length = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a + length, b + length
        inside = (p + (1 << k) <= ends[a]) & (q + (1 << k) <= ends[b])
        same = inside & (levels[k][np.minimum(p, n - 1)] == levels[k][np.minimum(q, n - 1)])
        length += np.where(same, 1 << k, 0)
    return np.concatenate([[0], length])


def _smaller_ahead(values: np.ndarray) -> np.ndarray:
    """For each place of a positive value the last place ahead of it whose value is smaller. values[0] is below all others.

    Pointers jump over what is known not to be smaller, all at a time, until only a few are left.
    """
    at = np.maximum(np.arange(len(values)) - 1, 0)
    alive = np.flatnonzero((values > 0) & (values[at] >= values))
    while len(alive) > 64:
        at[alive] = at[at[alive]]
        alive = alive[values[at[alive]] >= values[alive]]
    for i in alive.tolist():
        j, value = int(at[i]), values[i]
        while values[j] >= value:
            j = int(at[j])
        at[i] = j
    return at


def branching_squares(order: np.ndarray, inverse: np.ndarray, common: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that cannot be moved one word to the right.

    An LCP interval of depth d holds the suffixes that share d words; its children are the parts between the places where
    the common prefix is d itself. A square of period d at i moves no further if i and i + d are in different
    children of an interval of depth d. Of each interval all children but the largest are searched: for each of their suffixes
    the inverse array says in which slots the suffixes d ahead and d behind it are. A suffix is in a smaller child at most
    log n times.
    """
    n = len(order)
    value = np.concatenate([[-1], common[1:]])  # boundary p is ahead of slot p
    bounds = np.flatnonzero(value > 0)
    if not len(bounds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _smaller_ahead(value)[bounds]
    high = n - _smaller_ahead(np.concatenate([[-1], common[:0:-1]]))[n - bounds]
    by = np.lexsort((bounds, value[bounds], low))
    bounds, low, high = bounds[by], low[by], high[by]
    depth = value[bounds]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])])
    last = np.concatenate([new[1:], [True]])
    interval = np.cumsum(new) - 1
    # children: one that ends at each boundary, and one after the last boundary of each interval
    first = np.where(new, low, np.concatenate([[0], bounds[:-1]]))
    start, stop = np.concatenate([first, bounds[last]]), np.concatenate([bounds, high[last]])
    owner = np.concatenate([interval, interval[last]])
    low, high, depth = low[new], high[new], depth[new]
    size = stop - start
    by = np.lexsort((-size, owner))
    largest = by[np.concatenate([[True], owner[by][1:] != owner[by][:-1]])]
    small = np.ones(len(owner), bool)
    small[largest] = False
    start, stop, size, owner = start[small], stop[small], size[small], owner[small]
    child = np.repeat(np.arange(len(size)), size)
    slot = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + start[child]
    place, d = order[slot], depth[owner[child]]
    found = []
    for other, ahead in ((place + d, False), (place - d, True)):
        inside = (other >= begins[place]) & (other < ends[place])
        at = inverse[np.clip(other, 0, n - 1)]
        hit = inside & (at >= low[owner[child]]) & (at < high[owner[child]]) & ((at < start[child]) | (at >= stop[child]))
        found.append(np.stack([other[hit] if ahead else place[hit], d[hit]], 1))
    squares = np.unique(np.concatenate(found), axis=0)
    return squares[:, 0], squares[:, 1]


def _moved(codes: np.ndarray, start: int, period: int, least: int) -> int:
    """The first place to which the square can be moved to the left, word by word, not before `least`."""
    step = 64
    while start > least:
        low = max(least, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return start


def runs_of(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of the maximal runs of sequences that share no code, by start, then period.

    begins, ends: for each place those of its sequence. Runs have `exponent` periods and `length` codes at least. The last
    square of a run is branching; moved left as far as it goes, it spans the run. Squares of a multiple
    of a run's period span the same run, so of those with one end the shorter periods come first and
    the longer ones that they divide are left out.
    """
    if not len(codes):
        return []
    order, inverse, levels = suffix_array(codes, ends)
    start, period = branching_squares(order, inverse, common_prefixes(order, ends, levels), begins, ends)
    reach = (exponent - 2) * period  # a long enough run goes on so far ahead of its last square
    fits = start - reach >= begins[start]
    for back in (np.minimum(reach, 1), np.minimum(reach, period), reach):
        at = np.maximum(start - back, 0)
        fits &= codes[at] == codes[at + period]
    start, period = start[fits], period[fits]
    by = np.argsort(period, kind="stable")
    known: dict[int, list[tuple[int, int]]] = {}
    for i, d in zip(start[by].tolist(), period[by].tolist(), strict=True):
        stop = i + 2 * d
        same = known.setdefault(stop, [])
        if not any(d % q == 0 and i >= s for s, q in same):
            same.append((_moved(codes, i, d, int(begins[i])), d))
    found = [(s, stop - s, q) for stop, runs in known.items() for s, q in runs if stop - s >= max(length, exponent * q)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def _of_texts(texts: list[bytes], exponent: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Words, runs and collapsed text of each text."""
    words = [text.split() for text in texts]  # bytes split at the six ASCII blanks alone
    codes, bounds = [], [0]
    for own in words:
        known: dict[bytes, int] = {}
        base = bounds[-1]
        codes += [known.setdefault(word, base + at) for at, word in enumerate(own)]  # a code is the place of the word's first use
        bounds.append(base + len(own))
    edges = np.array(bounds)
    sizes = np.diff(edges)
    runs = runs_of(np.array(codes, np.int64), np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes), exponent, length)
    at = 0
    for own, begin, end in zip(words, bounds[:-1], bounds[1:], strict=True):
        mine = []
        while at < len(runs) and runs[at][0] < end:
            mine.append((runs[at][0] - begin, runs[at][1], runs[at][2]))
            at += 1
        kept = own
        if mine:
            mask = np.ones(len(own), bool)
            for start, long, period in mine:
                mask[start + period : start + long] = False
            kept = [own[i] for i in np.flatnonzero(mask).tolist()]
        yield len(own), mine, b" ".join(kept)


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, length: int = LENGTH) -> DataFrame:
    """The periodic runs of words of every whole text, and the texts with all but the first period of each run taken out.

    Words are runs of anything but the ASCII blanks and are numbered from 0. A run is a stretch of words that repeats with a
    smallest period q (words q apart are identical), spans `exponent` periods and `length` words at least, and that
    neither neighbouring word extends. Runs of one text may overlap.

    One row per input row: doc_id, n_words (long), runs (array of start, length, period, longs, by start, then period), collapsed
    (the kept words joined by one space; a word goes if a run contains it after that run's first period). A null,
    empty or blank text has no words, no runs and an empty collapsed text. Repeated rows are searched each. A null doc_id is
    handed on. An empty table gives no rows. Other columns are not read. A text is searched in one task: its
    memory is some 100 bytes a word, more by 4 for each doubling of its longest repeat.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            column, first = batch.column(1), 0
            sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
            while first < batch.num_rows:
                last, room = first + 1, CHUNK - sizes[first]
                while last < batch.num_rows and room >= sizes[last]:
                    room -= sizes[last]
                    last += 1
                texts = [x or b"" for x in column.slice(first, last - first).cast(pa.binary()).to_pylist()]
                found = list(_of_texts(texts, exponent, length))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in x[1]] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array(runs, kind),
                        pa.array([x[2] for x in found], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                first = last

    rows = docs.select("doc_id", F.col("text").alias("body"))
    runs = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.mapInArrow(search, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, runs {runs}, collapsed string")


def planted(doc_id: Column) -> Column:
    """The text, with a run of words planted into one in ten: those whose crc32 of the doc_id ends in the digit 0.

    From word a on, the text becomes repeats of its next p words. A null doc_id and a text without words are left alone.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    # the lambda binds the words, so that they are split once
    words = F.array(F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0)))
    changed = F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)), changed).otherwise(F.col("text"))
