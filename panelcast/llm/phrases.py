"""Phrase collocations: multikey three-way quicksort of suffix pointers, whose equal partitions are counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.llm.common import stored

#: Words of a phrase at most, occurrences at least, rows of a language in the report, share (in hundredths) of a longer phrase that drops a shorter one.
DEPTH, LEAST, TOP, WITHIN = 3, 10, 2000, 50
#: Bytes of text that are split at a time, unless one text alone is longer.
CHUNK = 4 << 20
#: Bits of a sieve of words (1 MB) or of pairs (8 MB), and occurrences of a first word for each task that its suffixes are dealt to.
SIEVE, PAIR_SIEVE, HOT = 1 << 23, 1 << 26, 250_000
#: Suffixes that a task of the sort gets on average, at most.
ROOM = 1_000_000
#: 0: part of a word, 1: between words, 2: end of a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: CRC-32 a byte at a time, and bytes of a word up to which all words are taken together.
_CRC, SHORT = np.array([zlib.crc32(bytes([255 - k])) ^ 0xFF000000 for k in range(256)], np.uint32), 64


def _crc32(words: pa.Array, begin: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, carried on from that of the bytes ahead of it, as `zlib.crc32(word, begin)`."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size, out = np.diff(bounds), begin.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    alive = np.flatnonzero(size <= SHORT)
    for at in range(SHORT):
        alive = alive[size[alive] > at]
        if not len(alive):
            break
        now = out[alive]
        out[alive] = _CRC[(now ^ raw[bounds[alive] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = zlib.crc32(raw[bounds[k] : bounds[k + 1]], int(begin[k]))
    return out.astype(np.int64)


def _renumbered(joint: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, all below `size`, in order, and for each number its place among them."""
    if size > 8 * len(joint) + 1024:
        return np.unique(joint, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[joint] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[joint]


class Words:
    """The words of some texts: a code for each word, where pieces end, and each code's language and word.

    codes[i] is the i-th word; ends[i] says that the i-th word is the last of its piece. Equal words of different
    languages have different codes.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        raw = _LOWER[raw]
        kind = _CLASS[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        stop = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        row = np.searchsorted(offsets, start, "right") - 1
        self.ends = np.ones(len(start), bool)
        self.ends[:-1] = (row[1:] != row[:-1]) | (breaks[start[1:]] != breaks[stop[:-1]])
        bounds = np.stack([start, stop], 1).ravel() if len(start) else np.zeros(0, np.int64)
        # a binary array of words and what lies between, of which every other one is a word
        both = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), max(len(bounds) - 1, 0), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
        )
        words = both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        lang = langs.fill_null("und").dictionary_encode()
        names = len(words.dictionary)
        joint = lang.indices.to_numpy().astype(np.int64)[row] * names + words.indices.to_numpy()
        known, self.codes = _renumbered(joint, len(lang.dictionary) * names)
        self.langs = lang.dictionary.take(pa.array(known // max(names, 1)))
        self.words = words.dictionary.take(pa.array(known % max(names, 1))).cast(pa.binary())

    def hashes(self) -> np.ndarray:
        """For each code the CRC-32 of its language and word."""
        lang = self.langs.dictionary_encode()
        ahead = np.array([zlib.crc32(name.encode() + b"\n") for name in lang.dictionary.to_pylist()], np.uint32)
        return _crc32(self.words, ahead[lang.indices.to_numpy()])


def _set(bits: bytes, place: np.ndarray) -> np.ndarray:
    """Whether the bits at the places are set."""
    return (np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7)) & 1 == 1


def _split(batch: pa.RecordBatch) -> Iterator[Words]:
    """The words of a batch of lang and text, some texts at a time."""
    sizes = np.cumsum([x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()])
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + CHUNK, "right"))
        last = max(last, first + 1)
        yield Words(batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first))
        first = last


def multikey_quicksort(keys: np.ndarray, weights: np.ndarray, least: np.ndarray | int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The equal partitions of suffixes at each depth: depth, one suffix of each, and its weight.

    keys: suffixes x depth, the number of the word at each place, 0 where the suffix has ended. Every partition
    is split three ways, by the word of its middle suffix at the partition's depth: less and greater stay at the depth,
    equal goes one deeper, and its weight is the count of the words so far. All partitions are split at the same time. A
    partition that weighs less than `least` holds no phrase that often, and is abandoned. `least` may differ by
    suffix, if suffixes that share the first words have the same.
    """
    least = np.broadcast_to(np.asarray(least, np.int64), len(keys))
    pointer = np.arange(len(keys))
    begin, depth = np.zeros(min(len(keys), 1), np.int64), np.zeros(min(len(keys), 1), np.int64)
    while len(begin):
        size = np.diff(np.append(begin, len(pointer)))
        weight = np.add.reduceat(weights[pointer], begin)
        alive = weight >= np.minimum.reduceat(least[pointer], begin)
        pointer = pointer[np.repeat(alive, size)]
        size, depth = size[alive], depth[alive]
        begin = np.cumsum(size) - size
        if not len(begin):
            return
        part, at = np.repeat(np.arange(len(size)), size), np.repeat(depth, size)
        word = keys[pointer, at]
        pivot = word[begin + size // 2]
        side = part * 3 + np.sign(word - pivot[part]) + 1
        by = np.argsort(side, kind="stable")
        pointer, side, word = pointer[by], side[by], word[by]
        begin = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        equal = side[begin] % 3 == 1
        depth = depth[side[begin] // 3] + equal
        size = np.diff(np.append(begin, len(pointer)))
        weight = np.add.reduceat(weights[pointer], begin)
        ended = equal & (word[begin] == 0)
        counted = equal & ~ended & (weight >= least[pointer[begin]])
        for d in np.unique(depth[counted]).tolist():
            these = counted & (depth == d)
            yield d, pointer[begin[these]], weight[these]
        alive = ~ended & (depth < keys.shape[1])
        pointer = pointer[np.repeat(alive, size)]
        size, depth = size[alive], depth[alive]
        begin = np.cumsum(size) - size


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, words (an array of one) and a, its occurrences: first counted in each task, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _split(batch):
                times = np.bincount(found.codes, minlength=len(found.words))
                yield pa.RecordBatch.from_arrays([found.langs, found.words.cast(pa.string()), pa.array(times)], names=["lang", "word", "a"])

    counted = docs.mapInArrow(count, "lang string, word string, a long")
    return counted.groupBy("lang", "word").agg(F.sum("a").alias("a")).select("lang", F.array("word").alias("words"), "a")


def _word_hash(place: int) -> Column:
    return F.crc32(F.concat(F.col("lang"), F.lit("\n"), F.col("words")[place]).cast("binary"))


def _pair_place(one: Any, two: Any) -> Any:
    """A pair's bit from the hashes of its words, before it is cut to the size of the sieve; of numbers or columns."""
    return one * 5 + two * 3


def _sieve(place: Column, size: int, words: DataFrame) -> bytes:
    """A bitmap of `size` bits of the places of the rows, as large whatever their number."""
    placed = words.select((F.pmod(place, F.lit(size)).cast("long") + 1).alias("h"))  # bit 0 has number 1
    parts = placed.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    bits = bytearray(size // 8)
    for bucket, part in parts.collect():
        at = (bucket - 1) * len(part)
        bits[at : at + len(part)] = part
    return bytes(bits)


def _equal_once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of numbers, and how often each occurs."""
    base = int(keys.max()) + 1
    if base ** keys.shape[1] < 1 << 63:
        packed, weight = np.unique(keys @ (base ** np.arange(keys.shape[1])[::-1]), return_counts=True)
        columns = []
        for _ in range(keys.shape[1]):
            packed, digit = np.divmod(packed, base)
            columns.append(digit)
        return np.stack(columns[::-1], 1), weight
    keys = keys[np.lexsort(keys.T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _hot_words(frequent: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, ascending, of words of `hot` occurrences or more, and the number of tasks for each: one row for `hot` words of the input, at most."""
    found = frequent.filter(F.col("a") >= hot).groupBy(_word_hash(0).alias("hash")).agg(F.max("a").alias("a")).collect()
    rows = np.array(sorted((row["hash"], -(-row["a"] // hot)) for row in found), np.int64).reshape(-1, 2)
    return rows[:, 0], rows[:, 1]


def _suffixes(docs: DataFrame, sieves: tuple[bytes, bytes | None], hot: tuple[np.ndarray, np.ndarray], parts: int, shortest: int, depth: int) -> DataFrame:
    """The suffixes of pieces, cut to `depth` words and ahead of what is surely rare, packed by task and language: part, lang, w0, w1 and so on, weights.

    sieves: of frequent words, and of frequent pairs, if they are known. Only suffixes of `shortest` words or more. Equal ones of some
    texts are one suffix, with their number. A row has all suffixes of some texts that one task of the sort gets of a language: in wk their words
    at place k, space-joined, empty where a suffix has ended; in weights their numbers, four bytes each. Suffixes go by their first word; those of a
    `hot` one by the others of the first `shortest` as well, so suffixes that share these words always meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast((*sieves, *hot))  # 9 MB and the hot words

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, pairs, heavy, spread = shared.value
        for batch in batches:
            for found in _split(batch):
                if len(found.codes) < shortest:
                    continue
                hashes = found.hashes()
                likely = _set(often, hashes % SIEVE)[found.codes]
                # whether word i + 1 may follow word i
                goes = ~found.ends[:-1] & likely[:-1] & likely[1:]
                if pairs is not None:
                    at = np.flatnonzero(goes)
                    own = hashes[found.codes]
                    goes[at] = _set(pairs, _pair_place(own[at], own[at + 1]) % PAIR_SIEVE)
                begin = np.arange(len(found.codes) - shortest + 1)
                for k in range(1, shortest):
                    begin = begin[goes[begin + k - 1]]
                if not len(begin):
                    continue
                keys = np.zeros((len(begin), depth), np.int64)
                keys[:, :shortest] = found.codes[begin[:, None] + np.arange(shortest)] + 1
                alive = np.arange(len(begin))
                for k in range(shortest, depth):
                    last = begin[alive] + k - 1
                    alive = alive[(last < len(goes)) & goes[np.minimum(last, len(goes) - 1)]]
                    keys[alive, k] = found.codes[begin[alive] + k] + 1
                keys, weight = _equal_once(keys)
                place = hashes[keys[:, 0] - 1]
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, place), len(heavy) - 1)
                    others = sum(hashes[keys[:, k] - 1] * (2 * k + 1) for k in range(1, shortest))
                    place = place + others % np.where(heavy[at] == place, spread[at], 1)
                lang = found.langs.dictionary_encode()
                cell = place % parts * len(lang.dictionary) + lang.indices.to_numpy()[keys[:, 0] - 1]
                by = np.argsort(cell, kind="stable")
                keys, weight, cell = keys[by], weight[by], cell[by]
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                bounds = np.append(first, len(cell)).astype(np.int32)
                part, name = np.divmod(cell[first], len(lang.dictionary))
                words = pa.concat_arrays([pa.array([""]), found.words.cast(pa.string())])
                held = [pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.take(pa.array(keys[:, k]))), " ") for k in range(depth)]
                numbers = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds * 4), pa.py_buffer(weight.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), lang.dictionary.take(pa.array(name)), *held, numbers], names=names)

    names = ["part", "lang", *[f"w{k}" for k in range(depth)], "weights"]
    return docs.mapInArrow(cut, f"part int, lang string, {', '.join(f'w{k} string' for k in range(depth))}, weights binary")


def _unpacked(held: pa.Table, depth: int) -> tuple[pa.Array, np.ndarray, list[pa.Array], np.ndarray, np.ndarray]:
    """Packed suffixes one by one: languages, the number of each one's language, words of each place, suffixes x depth of their numbers, weights.

    Word i of a place has number i + 1; 0: the suffix has ended.
    """
    packed = held.column("weights").to_pylist()
    lang = held.column("lang").dictionary_encode().combine_chunks()
    own = np.repeat(lang.indices.to_numpy().astype(np.int64), [len(x) // 4 for x in packed])
    weights = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
    keys, known = np.zeros((len(weights), depth), np.int64), []
    for k in range(depth):
        lists = pc.split_pattern(held.column(f"w{k}"), " ").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        keys[:, k] = coded.indices.to_numpy()
        keys[:, k] += 1
        ended = pc.index(coded.dictionary, "").as_py()
        if ended >= 0:
            keys[keys[:, k] == ended + 1, k] = 0
        known.append(coded.dictionary)
    return lang.dictionary, own, known, keys, weights


def _maybe_frequent(keys: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
    """Whether a suffix's words may weigh `least` together: weights are added by a hash of the words, so no frequent phrase is missed."""
    bits = max(10, (2 * len(keys)).bit_length())
    place = np.zeros(len(keys), np.uint64)
    for k in range(keys.shape[1]):
        place = (place + keys[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        place ^= place >> np.uint64(32)
    place = (place >> np.uint64(8)).astype(np.int64) & ((1 << bits) - 1)
    return np.bincount(place, weights)[place] >= least


def _sorted_counts(routed: DataFrame, shortest: int, depth: int, least: int) -> DataFrame:
    """The phrases of `shortest` words and more that occur `least` times, of each task's suffixes, by quicksort: lang, words, a.

    All suffixes with the same first `shortest` words are in one task, so a partition that weighs too little is abandoned
    there; those whose first `shortest` words surely weigh too little are not even sorted.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(batch.num_rows for batch in got):
            return
        langs, own, known, keys, weights = _unpacked(pa.Table.from_batches(got), depth)
        del got
        base = len(known[0]) + 1
        keys[:, 0] += own * base
        kept = np.flatnonzero(_maybe_frequent(keys[:, :shortest], weights, least))
        keys, weights, own = keys[kept], weights[kept], own[kept]
        # the words of all places, one after the other
        ahead = np.cumsum([0, *[len(words) for words in known[:-1]]])
        words = pa.concat_arrays(known)
        for d, suffix, weight in multikey_quicksort(keys, weights, least):
            if d < shortest:
                continue
            these = keys[suffix, :d] - 1
            these[:, 0] %= base
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(own[suffix])),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(suffix) + 1) * d).astype(np.int32)), words.take(pa.array((these + ahead[:d]).ravel()))),
                    pa.array(weight),
                ],
                names=["lang", "words", "a"],
            )

    return routed.mapInArrow(sort, "lang string, words array<string>, a long")


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, hot: int = HOT, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to `depth` words that occur `least` times (lang, words, a), and the words of each lang (lang, n)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    single = stored(word_counts(docs), "words")
    totals = single.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = single.filter(F.col("a") >= least)
    size = frequent.agg(F.sum("a")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // room))
    often, heavy = _sieve(_word_hash(0), SIEVE, frequent), _hot_words(frequent, hot)

    def counted(pairs: bytes | None, shortest: int, longest: int) -> DataFrame:
        routed = _suffixes(docs, (often, pairs), heavy, parts, shortest, longest).repartitionById(parts, F.col("part"))
        return stored(_sorted_counts(routed, shortest, longest, least), "phrases")

    pairs = counted(None, 2, 2)
    found = frequent.unionByName(pairs)
    if depth > 2:
        found = found.unionByName(counted(_sieve(_pair_place(_word_hash(0), _word_hash(1)), PAIR_SIEVE, pairs), 3, depth))
    return found, totals


def collocations(
    docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, within: int = WITHIN, hot: int = HOT, room: int = ROOM
) -> DataFrame:
    """The `top` phrases of two to `depth` words of each language whose words attract each other most.

    Texts are lower-cased by A-Z and end a piece at each of . , ; : ! ? and the ASCII line ends; words are what blanks
    and tabs part. A phrase's words follow each other in a piece. Counts, overlaps included, come from sorted suffixes:

    1. Words are counted. Those under `least` end a suffix, as no phrase with one is frequent; a sieve of 1 MB tells them
       (some rare words pass, at the cost of a longer suffix only).
    2. Every suffix of a piece is routed by its first word to a task, equal ones of some texts once with
       their number. Those that begin with a word of `hot` occurrences or more are dealt by the next words to several tasks. What some texts send
       to a task travels as one row a language, so a word costs its letters and no row of its own.
    3. Each task sorts its suffix pointers by multikey three-way quicksort. The weights
       of the equal partitions are the counts; partitions under `least` are abandoned. Tasks grow in number with the input.
    4. Steps 2 and 3 run for pairs, then, to the full depth, for the suffixes that a sieve of the frequent pairs leaves three words.

    score = floor(1000000 a a / (l r)) for a phrase of a occurrences whose two parts have l and r, at the cut with the lowest score,
    the first of equal ones. A phrase whose words lie within a longer one of `within` hundredths of its occurrences or more
    is left out. Products are decimals of 38 digits, enough for 3 x 10^15 occurrences.

    Returns lang, rank, phrase (space-joined), a, l, r, n (words of the language), score, ordered in each language by score and a
    descending, then phrase by bytes. A null lang is `und`, a null text is empty; repeated rows
    count each. Empty tables and texts give no rows. Other columns are not read.
    """
    counts, totals = phrase_counts(docs, depth, least, hot, room)
    size = F.size("words")
    candidates = counts.filter(size > 1)

    def part(name: str) -> DataFrame:
        return counts.select("lang", F.col("words").alias(f"{name}_words"), F.col("a").alias(name))

    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    halves = cuts.withColumn("l_words", F.slice("words", F.lit(1), F.col("k"))).withColumn("r_words", F.slice("words", F.col("k") + 1, size - F.col("k")))
    rated = halves.join(part("l"), ["lang", "l_words"]).join(part("r"), ["lang", "r_words"])

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    rated = rated.withColumn("above", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", wide("l") * wide("r"))
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    scored = rated.groupBy("lang", "words").agg(F.first("a").alias("a"), lowest)
    longer = candidates.filter(size > 2).select("lang", "words", F.col("a").alias("often"), F.explode(F.sequence(F.lit(2), size - 1)).alias("long"))
    longer = longer.select("lang", "often", "words", "long", F.explode(F.sequence(F.lit(1), size - F.col("long") + 1)).alias("from"))
    inner = longer.select("lang", F.slice("words", F.col("from"), F.col("long")).alias("words"), "often").groupBy("lang", "words").agg(F.max("often").alias("often"))
    left = scored.join(inner, ["lang", "words"], "left").filter(F.coalesce(100 * F.col("often") < within * F.col("a"), F.lit(True)))
    flat = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of 64 parts first, so that no task sees all phrases of a language
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    best = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("at", first).filter(F.col("at") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
