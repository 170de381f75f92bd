"""Near duplicates: circulant MinHash, banding, and exact Jaccard similarities on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import minhash, words
from panelcast.llm.common import numbered, sieved, stored
from panelcast.llm.graph import components
from panelcast.session import discard

#: Least similarity in hundredths.
SIMILARITY = 75
#: Shingles in a block of sets that is compared with another in one piece, and what a set counts besides its shingles.
BLOCK, SET = 100_000, 256
#: Columns of the incidence matrices that are multiplied at a time.
SLICE = 8192


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = words.texts(column)
    for first, last in words.chunks(data, offsets):
        yield first, last, *minhash.shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])


def _lists_of(column: pa.Array) -> list[np.ndarray]:
    """The sorted shingle set of every text."""
    return [shingles[a:b] for _, _, shingles, begins in _sets(column) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def text_hash(name: str) -> Column:
    """128 bits that name a text; null for a null one."""
    return F.unhex(F.substring(F.sha2(name, 256), 1, 32))


def signed(docs: DataFrame, bands: int = minhash.BANDS, width: int = minhash.WIDTH) -> DataFrame:
    """id, text_hash, n_shingles, name (of the shingle set) and keys (one for each band) of every row of id and text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, shingles, begins in _sets(batch.column(2)):
                keys = minhash.band_keys(minhash.signatures(shingles, begins, bands * width), bands, width).view(np.int64)
                names = [minhash.identity(shingles[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
                offsets = pa.array(np.arange(last - first + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.array(np.diff(begins)),
                        pa.array(names, pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    names=["id", "text_hash", "n_shingles", "name", "keys"],
                )

    rows = docs.select("id", text_hash("text").alias("text_hash"), F.col("text").alias("body"))
    return rows.mapInArrow(sign, f"id {dict(rows.dtypes)['id']}, text_hash binary, n_shingles long, name binary, keys array<long>")


def _bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and body: one text of each node."""
    texts, _ = sieved(docs.select(text_hash("text").alias("text_hash"), F.col("text").alias("body")), "text_hash", nodes)
    return texts.groupBy("text_hash").agg(F.first("body").alias("body")).join(nodes.select("node", "text_hash"), "text_hash").select("node", "body")


def _leader_links(pairs: DataFrame, bodies: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs of a member and the first member of its bucket that are links, by their full sets.

    Texts are shuffled and become sets in the task, as a text packs better than its hashes.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, theirs = None, np.zeros(0, np.uint64)
        for batch in batches:
            leaders, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.concatenate([[leader is None or leaders[0] != leader], leaders[1:] != leaders[:-1]]) if len(leaders) else np.zeros(0, bool)
            heads = iter(_lists_of(batch.column(3).filter(pa.array(fresh))))
            linked = np.zeros(len(leaders), bool)
            for i, mine in enumerate(_lists_of(batch.column(2))):
                if fresh[i]:
                    leader, theirs = leaders[i], next(heads)
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                linked[i] = 100 * both >= similarity * (len(mine) + len(theirs) - both)
            yield pa.RecordBatch.from_arrays([pa.array(leaders[linked]), pa.array(nodes[linked])], names=["a", "b"])

    one = bodies.select("node", F.col("body").alias("mine"))
    other = bodies.select(F.col("node").alias("leader"), F.col("body").alias("theirs"))
    return pairs.join(one, "node").join(other, "leader").select("leader", "node", "mine", "theirs").mapInArrow(compare, "a long, b long")


def _lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of array<struct<node, label, body>>: nodes, labels, all shingles and the place of the set each is in."""
    out = []
    for row in range(len(column)):
        if not column[row].is_valid:
            out.append(None)
            continue
        items = column[row].values
        lists = _lists_of(items.field(2))
        lengths = [len(x) for x in lists]
        out.append((items.field(0).to_numpy(), items.field(1).to_numpy(), np.concatenate(lists), np.repeat(np.arange(len(lengths)), lengths)))
    return out


def _overlaps(a: np.ndarray, a_set: np.ndarray, n: int, b: np.ndarray, b_set: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the intersections of n sets with m others, by products of 0/1 matrices over the shingles that both sides have."""
    common = np.intersect1d(a, b)
    total = np.zeros((n, m), np.float32)
    a_at, b_at = np.searchsorted(common, a), np.searchsorted(common, b)
    a_in = (a_at < len(common)) & (common[np.minimum(a_at, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    b_in = (b_at < len(common)) & (common[np.minimum(b_at, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    a_at, a_set, b_at, b_set = a_at[a_in], a_set[a_in], b_at[b_in], b_set[b_in]
    for low in range(0, len(common), SLICE):
        width = min(SLICE, len(common) - low)
        left, right = np.zeros((n, width), np.float32), np.zeros((m, width), np.float32)
        here = (a_at >= low) & (a_at < low + width)
        left[a_set[here], a_at[here] - low] = 1
        here = (b_at >= low) & (b_at < low + width)
        right[b_set[here], b_at[here] - low] = 1
        total += left @ right.T
    return total


def _spanning(one: tuple, two: tuple, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links found, only those that join labels which the links ahead of them have not joined: under one for each label."""
    pairs, first = np.unique(np.stack([one[1][x], two[1][y]], 1), axis=0, return_index=True)
    above: dict[int, int] = {}

    def root(label: int) -> int:
        while label in above:
            label = above[label]
        return label

    kept = []
    for (p, q), at in zip(pairs.tolist(), first.tolist(), strict=True):
        p, q = root(p), root(q)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append(at)
    return one[0][x[kept]], two[0][y[kept]]


def _block_links(members: DataFrame, bodies: DataFrame, similarity: int) -> DataFrame:
    """Links between members of a bucket that still have different labels.

    A bucket is cut into blocks of about BLOCK shingles, and each pair of its blocks is one row of work that
    any task can take. What leaves the task are not the pairs but links that connect the same labels as all
    links of the two blocks do, under one for each label. Most buckets are one block.
    """
    cut = numbered(members.withColumn("cost", F.col("n_shingles") + SET), ["key"], ["node"], "cost")
    placed = stored(cut.select("key", "node", "label", F.floor(F.col("_before") / BLOCK).cast("long").alias("block")), "placed")
    last = placed.groupBy("key").agg(F.max("block").alias("last"))
    many = last.filter("last > 0")

    def filled(rows: DataFrame) -> DataFrame:
        return rows.join(bodies, "node").groupBy("key", "block").agg(F.collect_list(F.struct("node", "label", "body")).alias("items"))

    alone = filled(placed.join(many, "key", "left_anti"))
    single = alone.select("items", F.lit(None).cast(alone.schema["items"].dataType).alias("others"))
    blocks = stored(filled(placed.join(many, "key", "left_semi")), "blocks")
    work = blocks.select("key", "block").join(many, "key").select("key", "block", F.explode(F.sequence("block", "last")).alias("other"))
    other = blocks.select(F.col("key").alias("k"), F.col("block").alias("b"), F.col("items").alias("others"))
    pairs = work.join(blocks, ["key", "block"]).join(
        other, (F.col("key") == F.col("k")) & (F.col("other") == F.col("b")) & (F.col("other") != F.col("block")), "left"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs in zip(_lists(batch.column(0)), _lists(batch.column(1)), strict=True):
                one = mine
                two = theirs if theirs is not None else mine
                both = _overlaps(one[2], one[3], len(one[0]), two[2], two[3], len(two[0]))
                n, m = np.bincount(one[3], minlength=len(one[0])), np.bincount(two[3], minlength=len(two[0]))
                close = 100 * both.astype(np.int64) >= similarity * (n[:, None] + m[None, :] - both.astype(np.int64))
                close &= one[1][:, None] != two[1][None, :]
                a, b = _spanning(one, two, *np.nonzero(close))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = pairs.select("items", "others", "key", "block", "other").repartition("key", "block", "other").select("items", "others")
    return dealt.unionByName(single).mapInArrow(compare, "a long, b long")


def near_groups(
    docs: DataFrame, similarity: int = SIMILARITY, bands: int = minhash.BANDS, width: int = minhash.WIDTH, key: str = "doc_id"
) -> DataFrame:
    """Groups of documents that links of similar shingle sets hold together.

    Two documents are linked if 100 x intersection >= similarity x union of their sets of distinct five-word
    shingles. The steps:

    1. Every text is signed; rows with the same set become one node, combined on the map side.
    2. Nodes that share a band key are a bucket. Each member is compared with the bucket's first member, exactly, on
       full sets: n - 1 comparisons for n members. Verified links make first components.
    3. A bucket whose other members are all in one component needs no more: a link among them could not change
       any component. In the rest, members of different components are compared exactly, in blocks.
    4. Components of all links.

    So no bucket is cut or left out, and links within a component are not listed. Bands of `width` coordinates
    miss a pair of similarity s with the chance (1 - s^width)^bands: 5 in a million at 0.75 by default,
    and less above. Sets are compared by 64-bit shingle hashes, named by 128-bit digests.

    One row per input row: doc_id, n_shingles, component_id (smallest doc_id of the component), kept
    (doc_id is component_id). A text of one to four words has one shingle, all of them. A null, empty or
    blank text has none and is linked with nothing. Equal rows are linked with each other. Rows with the same
    doc_id and different texts are nodes of their own. A null doc_id has a component of null if no other row is in it. An
    empty table gives no rows. Other columns are not read. `key`: the column that names the rows, if not doc_id.
    """
    docs = docs.select(F.col(key).alias("id"), "text")
    first_rows = stored(signed(docs, bands, width), "signed")
    full = first_rows.filter("n_shingles > 0")
    grouped = full.groupBy("name").agg(
        F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")
    )
    keyed = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "keyed")
    rows = stored(first_rows.drop("keys", "text_hash"), "rows")
    discard(first_rows)
    banded = keyed.select("node", F.explode("keys").alias("key"))
    buckets = stored(banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("key", "leader"), "buckets")
    shared, _ = sieved(banded, "key", buckets)
    members = stored(shared.join(buckets, "key"), "members")
    nodes = stored(keyed.drop("keys"), "nodes")
    discard(keyed, buckets)
    sizes = nodes.select("node", "n_shingles")
    pairs = members.filter("node <> leader").select("node", "leader").distinct()
    pairs = pairs.join(sizes, "node").join(sizes.select(F.col("node").alias("leader"), F.col("n_shingles").alias("l")), "leader")
    pairs = stored(pairs.filter(100 * F.least("n_shingles", "l") >= similarity * F.greatest("n_shingles", "l")).select("node", "leader"), "pairs")
    bodies = stored(_bodies(docs, nodes.join(members.select("node").distinct(), "node", "left_semi")), "bodies")
    links = stored(_leader_links(pairs, bodies, similarity), "links")
    labels = components(links)
    discard(pairs, links)
    labelled = members.filter("node <> leader").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    # buckets with the same members are one: their number of members and two sums of 64 bits are its name
    marks = [F.expr(f"bit_xor(xxhash64({seed}, node))") for seed in (1, 2)]
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(marks)])
    split = split.filter("low <> high").groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    open_members = stored(labelled.join(split, "key", "left_semi").join(sizes, "node"), "open")
    rest = stored(_block_links(open_members, bodies, similarity), "links")
    if not rest.isEmpty():
        known = labels.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b"))
        labels = components(known.unionByName(rest.distinct()))
    discard(members, bodies, open_members, rest)
    named = nodes.join(labels, "node", "left").select("name", "least", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = named.join(smallest, "label").select("name", "component_id")
    some = rows.filter("n_shingles > 0").join(groups, "name").select("id", "n_shingles", "component_id")
    empty = rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    found = some.unionByName(empty).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return found.withColumnRenamed("id", key)
