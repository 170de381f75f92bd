"""Near duplicates of vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact cosines."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import sieved, stored
from panelcast.llm.graph import components

#: Least cosine of a link.
SIMILARITY = 0.9
#: Hash tables, cross-polytope hashes that make a key, and keys that each vector takes in a table.
TABLES, HASHES, PROBES = 8, 2, 4
#: Coordinates of a rotated vector among which the probes choose, and bits of a sketch.
CHOICES, BITS = 4, 256
#: Members of a bucket up to which one task compares its sketches, and members of a block of vectors that one task compares.
SMALL, BLOCK = 1 << 15, 512
#: Pairs whose keys are compared at a time, and close pairs held until they are joined.
PAIRS, HELD = 1 << 15, 1 << 20
#: Parts of a hash table: a vector goes once to each part that it has keys in. Bits of a key below the table's number.
CELLS, CODE = 128, 55
#: Rows that are rotated at a time, and columns up to which a rotation is a product with its matrix.
ROWS, WIDE = 1024, 256
#: Columns up to which marks are grains and not sketches, and the step of a grain in deviations of a coordinate.
FINE, STEP = 64, 0.335
#: Members of a bucket up to which its pairs are listed, places of such buckets at a time, and the sides of a tile of a larger one.
FEW, SOME, TILE = 48, 1 << 15, (256, 2048)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the number of columns is a power of two."""
    rows, n = x.shape
    width = 1
    while width < n:
        halves = x.reshape(rows, n // (2 * width), 2, width)
        x = np.concatenate([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], -1).reshape(rows, n)
        width *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform. `number` names it."""
    for sign in _signs(number, x.shape[1]):
        x = hadamard(x * sign)
    return x


@functools.lru_cache(maxsize=256)
def _signs(number: int, width: int) -> np.ndarray:
    return np.random.default_rng([number, width]).choice(np.array([-1.0, 1.0]), (3, width))


@functools.lru_cache(maxsize=256)
def _matrix(number: int, width: int) -> np.ndarray:
    return rotated(np.eye(width), number)


def _turned(x: np.ndarray, number: int) -> np.ndarray:
    """`rotated`, by one product where that is cheaper. Always of ROWS rows, so a row's result does not depend on those beside it."""
    if x.shape[1] > WIDE:
        return rotated(x, number)
    full = np.zeros((-(-len(x) // ROWS) * ROWS, x.shape[1]))
    full[: len(x)] = x
    return np.concatenate([full[at : at + ROWS] @ _matrix(number, x.shape[1]) for at in range(0, len(full), ROWS)] or [full])[: len(x)]


def _padded(unit: np.ndarray) -> np.ndarray:
    size = 1 << (unit.shape[1] - 1).bit_length()
    return np.pad(unit, ((0, 0), (0, size - unit.shape[1])))


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """rows x tables x probes keys of unit vectors, ascending within a table; the table's number is in the key.

    A cross-polytope hash is the vertex nearest to the rotated vector: its coordinate of the largest size, and
    the sign of it. Where other vertices are almost as near, near neighbours may have them, so a vector
    takes the `probes` combinations of vertices that lose least, its own first.
    """
    x = _padded(unit)
    size = x.shape[1]
    choices = min(CHOICES, size)
    combinations = np.array(list(itertools.product(range(choices), repeat=hashes)))
    keys = np.zeros((len(x), tables, min(probes, len(combinations))), np.int64)
    for table in range(tables):
        loss, code = np.zeros((len(x), len(combinations))), np.zeros((len(x), len(combinations)), np.int64)
        for k in range(hashes):
            y = _turned(x, table * hashes + k)
            near = np.argpartition(-np.abs(y), choices - 1, axis=1)[:, :choices]
            near = np.take_along_axis(near, np.argsort(-np.abs(np.take_along_axis(y, near, 1)), axis=1, kind="stable"), 1)
            value = np.take_along_axis(y, near, 1)
            lost = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            loss += lost[:, combinations[:, k]]
            code = code * (2 * size) + (2 * near + (value < 0))[:, combinations[:, k]]
        first = np.argsort(loss, axis=1, kind="stable")[:, : keys.shape[2]]
        keys[:, table] = np.sort(np.take_along_axis(code, first, 1) % (1 << CODE), 1) + (table << CODE)
    return keys


def sketches(unit: np.ndarray) -> np.ndarray:
    """rows x BITS / 64 words: the signs of BITS rotated coordinates. Those of two vectors differ as their angle does."""
    x = _padded(unit)
    needed = -(-BITS // x.shape[1])
    signs = np.concatenate([_turned(x, (1 << 20) + k) < 0 for k in range(needed)], 1)[:, :BITS]
    return np.ascontiguousarray(np.packbits(signs, axis=1)).view(np.uint64)


def grains(unit: np.ndarray) -> np.ndarray:
    """The rotated coordinates in four bits each, two a byte, and two last bytes that the lengths of what they leave out are within: of
    the first half of the coordinates, and of all."""
    x = _padded(unit)
    x = np.pad(x, ((0, 0), (0, x.shape[1] % 2)))
    step = STEP / math.sqrt(x.shape[1])
    y = _turned(x, 1 << 20)
    level = np.clip(np.floor(y / step) + 8, 0, 15).astype(np.uint8)
    left = y - (level - 7.5) * step
    within = [np.ceil((np.linalg.norm(left[:, :n], axis=1, keepdims=True) + 1e-6) * 255) for n in (x.shape[1] // 2, x.shape[1])]
    return np.concatenate([level[:, ::2] << 4 | level[:, 1::2], *[w.clip(0, 255).astype(np.uint8) for w in within]], 1)


def ungrained(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grained coordinates in single precision, and the lengths that they leave out: of the first half, and of all."""
    size = 2 * (marks.shape[1] - 2)
    values = (np.arange(16, dtype=np.float32) - 7.5) * np.float32(STEP / math.sqrt(size))
    # two coordinates are taken at once, as a complex number
    both = np.stack([np.repeat(values, 16), np.tile(values, 16)], 1).view(np.complex64)[:, 0]
    left = marks[:, -2:] / np.float32(255)
    return both.take(marks[:, :-2]).view(np.float32), left[:, 0], left[:, 1]


def most_bits(similarity: float, bits: int = BITS) -> int:
    """Bits in which the sketches of a linked pair differ at most: the mean and seven deviations (misses under 1 in 10^10)."""
    share = math.acos(similarity) / math.pi
    return math.ceil(bits * share + 7 * math.sqrt(bits * share * (1 - share)))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column by their length: places of the rows, and the rows as a matrix in double precision.

    Rows that are null, empty or zero, or hold a null or a non-finite component, are left out.
    """
    offsets = column.offsets.to_numpy()
    # a slice of a column still has the values of all rows
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64())
    offsets = offsets - offsets[0]
    missing = np.asarray(flat.is_null())
    values = np.where(missing, np.nan, flat.fill_null(0.0).to_numpy())
    lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
    for width in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == width)
        rows = values[offsets[places][:, None] + np.arange(width)]
        fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
        if fine.any():
            yield places[fine], rows[fine]


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _named(vectors: DataFrame) -> DataFrame:
    """id, name (128-bit digest of the components, null for a vector that links with nothing) and vector of every row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[bytes | None] = [None] * batch.num_rows
            for places, rows in _by_width(batch.column(1)):
                for place, row in zip(places.tolist(), rows + 0.0, strict=True):
                    names[place] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), batch.column(1)], names=["id", "name", "vector"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(name, f"id {kinds['id']}, name binary, vector {kinds['vector']}")


def _codes(width: int, hashes: int) -> int:
    """How many codes of a hash table a cell has, for vectors of a length. Codes that begin with the same vertex are together."""
    size = 1 << (width - 1).bit_length()
    return -(-min((2 * size) ** hashes, 1 << CODE) // CELLS)


def _marks(unit: np.ndarray) -> np.ndarray:
    """Bytes of every vector that tell which pairs may be linked: grains, which take fewer bytes of short vectors, or a sketch."""
    return grains(unit) if _padded(unit).shape[1] <= FINE else sketches(unit).view(np.uint8)


def _dealt(nodes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """Every vector's keys and marks, packed, a row for each cell that a batch has keys in.

    A cell is a part of a hash table. A row has the nodes with keys in it, marks and a number of keys (counts) for each, and
    of each key what the cell leaves open (rests), so a vector's marks travel once for all its keys in the cell.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for places, rows in _by_width(batch.column(1)):
                units = [_unit(rows[at : at + ROWS]) for at in range(0, len(rows), ROWS)]
                keys = np.concatenate([bucket_keys(unit, tables, hashes, probes).reshape(len(unit), -1) for unit in units])
                mark = np.concatenate([_marks(unit) for unit in units])
                codes, many = _codes(rows.shape[1], hashes), keys.shape[1]
                code = keys & ((1 << CODE) - 1)
                cell = ((keys >> CODE) * CELLS + code // codes).ravel().astype(np.min_scalar_type(tables * CELLS))
                order = np.argsort(cell, kind="stable")
                cell, vector = cell[order], order // many
                rests = (code % codes).ravel()[order].astype(np.min_scalar_type(codes - 1))
                starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (vector[1:] != vector[:-1])]))
                counts = np.diff(starts, append=len(cell)).astype(np.min_scalar_type(many))
                own, marks, of = ids[places][vector[starts]], mark[vector[starts]], cell[starts]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                bounds = list(zip(first.tolist(), [*first[1:].tolist(), len(of)], strict=True))
                ends = [*starts.tolist(), len(cell)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(first), rows.shape[1], np.int32)),
                        pa.array(of[first].astype(np.int32)),
                        pa.array([own[a:b].tobytes() for a, b in bounds], pa.binary()),
                        pa.array([marks[a:b].tobytes() for a, b in bounds], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in bounds], pa.binary()),
                        pa.array([rests[ends[a] : ends[b]].tobytes() for a, b in bounds], pa.binary()),
                    ],
                    names=["dim", "cell", "nodes", "marks", "counts", "rests"],
                )

    kind = "dim int, cell int, nodes binary, marks binary, counts binary, rests binary"
    return nodes.select("node", "vector").mapInArrow(hashed, kind)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows that come sorted by dim and cell, a cell at a time: dim, cell, the other columns joined."""
    here, held = (0, 0), []

    def joined() -> list[bytes]:
        return [b"".join(x for rows in held for x in rows.column(k).to_pylist()) for k in range(2, held[0].num_columns)]

    for batch in batches:
        dims, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bounds = [0, *(np.flatnonzero((dims[1:] != dims[:-1]) | (cells[1:] != cells[:-1])) + 1).tolist(), len(dims)]
        for a, b in itertools.pairwise(bounds):
            if a == b:
                continue
            place = (int(dims[a]), int(cells[a]))
            if held and place != here:
                yield *here, joined()
                held = []
            here = place
            held.append(batch.slice(a, b - a))
    if held:
        yield *here, joined()


class _Joined:
    """Groups that pairs of places join: `label` has the least place of each place's group, `near` whether it is in a pair."""

    def __init__(self, places: int) -> None:
        self.label, self.near = np.arange(places), np.zeros(places, bool)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.near[x] = self.near[y] = True
        apart = self.label[x] != self.label[y]
        if apart.any():
            self.held.append((x[apart], y[apart]))
            self.many += len(self.held[-1][0])
        if self.many > HELD:
            self.fold()

    def fold(self) -> np.ndarray:
        """Joins the pairs held; the labels."""
        x, y = (np.concatenate([pair[k] for pair in self.held]) if self.held else np.zeros(0, np.int64) for k in range(2))
        self.held, self.many = [], 0
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return self.label
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (above := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = above


class _Grains:
    """Which pairs of vectors may be linked, by their grains; no linked pair is ruled out.

    With a = a' + e and b = b' + f it is ab <= a'b' + |e| + |f| + |e||f|, so a last coordinate of 1 + |e| takes what grains leave out.
    Ahead of that, half of the coordinates rule out most pairs of a tile: linked vectors are no farther apart there than in all, d, and
    |a' - b'|^2 <= (d + |e| + |f|)^2 <= d^2 + g(e) + g(f) with g(e) = 2d|e| + 2|e|^2.
    """

    def __init__(self, marks: np.ndarray, similarity: float) -> None:
        values, left, all_left = ungrained(marks)
        size = values.shape[1]
        self.all = np.concatenate([values, 1 + all_left[:, None]], 1)
        self.limit = np.float32(similarity + 1 - 1e-5)
        self.near = np.empty((len(values), size // 2 + 2), np.float32)
        self.near[:, :-2] = half = values[:, : size // 2]
        apart = math.sqrt(max(0.0, 2 - 2 * similarity))
        self.near[:, -2] = apart * left + left * left - (half * half).sum(1) / 2
        self.near[:, -1] = 1
        self.far = self.near[:, [*range(size // 2), -1, -2]]
        self.least = np.float32(-apart * apart / 2 - 1e-5)
        self.products = np.empty(min(len(values), TILE[0]) * min(len(values), TILE[1]), np.float32)

    def listed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.all[x], self.all[y]) >= self.limit

    def tile(self, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        shape = x.stop - x.start, y.stop - y.start
        out = self.products[: shape[0] * shape[1]].reshape(shape)
        np.matmul(self.near[x], self.far[y].T, out=out)
        p, q = np.divmod(np.flatnonzero(out >= self.least), shape[1])
        if len(p) > out.size >> 6:
            np.matmul(self.all[x], self.all[y].T, out=out)
            return out >= self.limit
        fine = self.listed(p + x.start, q + y.start)
        return p[fine], q[fine]


class _Sketches:
    """Which pairs of vectors may be linked, by their sketches. The first half of one rules out most pairs of a tile."""

    def __init__(self, marks: np.ndarray, similarity: float) -> None:
        self.words = np.ascontiguousarray(np.ascontiguousarray(marks).view(np.uint64).T)
        self.half, self.most = most_bits(similarity, BITS // 2), most_bits(similarity)

    def listed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(word[x] ^ word[y]).astype(np.int64) for word in self.words) <= self.most

    def tile(self, x: slice, y: slice) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        half = self.words[: len(self.words) // 2]
        bits = sum(np.bitwise_count(word[x][:, None] ^ word[y]) for word in half)
        p, q = np.divmod(np.flatnonzero(bits <= self.half), bits.shape[1])
        fine = self.listed(p + x.start, q + y.start)
        return p[fine], q[fine]


def _sifter(marks: np.ndarray, dim: int, similarity: float) -> _Grains | _Sketches:
    return (_Grains if 1 << (dim - 1).bit_length() <= FINE else _Sketches)(marks, similarity)


def _few(sifter: _Grains | _Sketches, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a bucket that may be linked; the places are sorted by bucket, and buckets are small."""
    for step in itertools.count(1):
        x = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(x):
            return
        x = x[sifter.listed(x, x + step)]
        yield x, x + step


def _many(sifter: _Grains | _Sketches, n: int, split: int | None = None) -> _Joined:
    """What pairs of n places that may be linked join; with a split, pairs of one ahead of it and one from it on."""
    found = _Joined(n)
    last = n if split is None else split
    for row in range(0, last, TILE[0]):
        for column in range(row if split is None else split, n, TILE[1]):
            close = sifter.tile(slice(row, min(row + TILE[0], last)), slice(column, min(column + TILE[1], n)))
            if isinstance(close, np.ndarray):
                if split is None and column < row + TILE[0]:
                    close &= np.arange(row, row + len(close))[:, None] < np.arange(column, column + close.shape[1])
                # a first partner of every place, then what that has not joined: near copies are not listed pair by pair
                x, y = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
                found.add(np.concatenate([x, close[:, y].argmax(0)]) + row, np.concatenate([close[x].argmax(1), y]) + column)
                label = found.fold()
                close &= label[row : row + len(close), None] != label[column : column + close.shape[1]]
                close = np.nonzero(close)
            x, y = close[0] + row, close[1] + column
            if split is None:
                x, y = x[x < y], y[x < y]
            if len(x):
                found.add(x, y)
    found.fold()
    return found


def _plausible(dealt: DataFrame, similarity: float, hashes: int) -> tuple[DataFrame, DataFrame]:
    """The members of buckets that have a partner there whose marks are near enough, dim, key, node; and edges a, b that connect them.

    Members of a bucket that such pairs connect have an edge to the same one of them. Marks meet here, not vectors. A pair is near enough
    in all buckets that it shares or in none. A bucket of over SMALL members is dealt into blocks, and any task can take a pair of blocks.
    """
    small = SMALL
    kind = "dim int, key long, node long, root long, nodes binary, marks binary, split long"

    def output(dim: int, key: np.ndarray, node: np.ndarray, root: np.ndarray, piece: tuple[bytes, bytes, int] | None = None) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(key), dim, np.int32)), pa.array(key), pa.array(node), pa.array(root)]
        more = piece or (None, None, None)
        columns += [pa.array([x] * len(key), t) for x, t in zip(more, (pa.binary(), pa.binary(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "key", "node", "root", "nodes", "marks", "split"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, cell, (nodes, marks, counts, rests) in _cells(batches):
            codes = _codes(dim, hashes)
            node = np.frombuffer(nodes, np.int64)
            mark = np.frombuffer(marks, np.uint8).reshape(len(node), -1)
            rest = np.frombuffer(rests, np.min_scalar_type(codes - 1))
            count = np.frombuffer(counts, np.dtype(f"u{len(counts) // len(node)}"))
            order = np.argsort(rest, kind="stable")
            owner, rest = np.repeat(np.arange(len(node)), count)[order], rest[order]
            key = (cell // CELLS << CODE) + cell % CELLS * codes + rest.astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
            sizes = np.diff(starts, append=len(rest))
            found = _Joined(len(rest))
            few = (sizes > 1) & (sizes <= min(FEW, small))
            part = np.cumsum(np.where(few, sizes, 0)) // SOME
            for k in np.unique(part[few]).tolist():
                places = np.flatnonzero(np.repeat(few & (part == k), sizes))
                for x, y in _few(_sifter(mark[owner[places]], dim, similarity), rest[places]):
                    found.add(places[x], places[y])
            for at, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
                own = owner[at : at + n]
                if 1 < n <= small:
                    joined = _many(_sifter(mark[own], dim, similarity), n)
                    found.label[at : at + n], found.near[at : at + n] = joined.label + at, joined.near
                elif n > small:
                    blocks = [own[k : k + small] for k in range(0, n, small)]
                    for i, j in itertools.combinations_with_replacement(range(len(blocks)), 2):
                        two = blocks[i] if i == j else np.concatenate([blocks[i], blocks[j]])
                        piece = node[two].tobytes(), mark[two].tobytes(), len(blocks[i])
                        yield output(dim, key[at : at + 1], node[two[:1]], node[two[:1]], piece)
            label, near = found.fold(), np.flatnonzero(found.near)
            if len(near):
                yield output(dim, key[near], node[owner[near]], node[owner[label[near]]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, key, nodes, marks, split in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                node = np.frombuffer(nodes, np.int64)
                sifter = _sifter(np.frombuffer(marks, np.uint8).reshape(len(node), -1), dim, similarity)
                found = _many(sifter, len(node), split if split < len(node) else None)
                label, near = found.label, np.flatnonzero(found.near)
                yield output(dim, np.full(len(near), key, np.int64), node[near], node[label[near]])

    sifted = stored(dealt.repartition("dim", "cell").sortWithinPartitions("dim", "cell").mapInArrow(sift, kind), "near")
    light, heavy = (sifted.filter(f"marks is {which}null") for which in ("", "not "))
    if heavy.isEmpty():
        return light.select("dim", "key", "node"), _edges(light)
    dealt_again = heavy.select("dim", "key", "nodes", "marks", "split").repartition(F.xxhash64("nodes"))
    near = stored(light.unionByName(dealt_again.mapInArrow(pieces, kind)).select("dim", "key", "node", "root"), "near")
    # a member of several blocks' pairs comes with a root of each
    return stored(near.select("dim", "key", "node").distinct(), "near"), _edges(near)


def _edges(near: DataFrame) -> DataFrame:
    return near.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def _first_met(here: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether `here` is the first bucket that the vectors of each pair share; keys: tables x probes x vectors."""
    table = here >> CODE
    left = np.arange(len(x))
    for k in range(table + 1):
        p, q = x[left], y[left]
        one, two = [own[p] for own in keys[k]], [own[q] for own in keys[k]]
        met = np.zeros(len(left), bool)
        for a in one:
            for b in two:
                met |= (a == b) & (a < here) if k == table else a == b
        left = left[~met]
    first = np.zeros(len(x), bool)
    first[left] = True
    return first


def _work(near: DataFrame, labels: DataFrame) -> DataFrame:
    """What is compared together: dim, key, node, blocks. Dim is 0 and key a label where it is a whole group of connected nodes.

    A group is compared as a whole where that is fewer pairs than its buckets have together, as in a group of near copies, which meet
    in many buckets: every vector is fetched once then, and every pair is seen once. In a long chain the buckets are fewer pairs.
    Of buckets with the same members only the first is looked into: it is the one in which their pairs count.
    """
    inside = near.join(labels, "node")
    met = inside.groupBy("label", "dim", "key").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum(F.col("n") * F.col("n")).alias("met"))
    groups = labels.groupBy("label").agg(F.count("*").alias("n")).join(met, "label")
    groups = stored(groups.select("label", "n", (F.col("n") * F.col("n") <= F.col("met")).alias("whole")), "groups")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    whole = labels.join(groups.filter("whole"), "label").select(F.lit(0).alias("dim"), F.col("label").alias("key"), "node", blocks)
    chains = groups.filter("not whole").select("label")
    if chains.isEmpty():
        return whole
    parts = inside.join(chains, "label").select("dim", "key", "node")
    marks = [F.expr(f"bit_xor(xxhash64({seed}, node))").alias(f"m{seed}") for seed in (1, 2)]
    sizes = parts.groupBy("dim", "key").agg(F.count("*").alias("n"), *marks).filter("n > 1")
    sizes = sizes.groupBy("dim", "n", "m1", "m2").agg(F.min("key").alias("key")).select("dim", "key", blocks)
    return whole.unionByName(parts.join(sizes, ["dim", "key"]).select("dim", "key", "node", "blocks"))


def _verified(work: DataFrame, vectors: DataFrame, similarity: float, tables: int, hashes: int, probes: int) -> DataFrame:
    """Exact cosines of what is compared together. Rows of a node and its links, a and links, or of two linked nodes, a and b.

    It is dealt into blocks by a hash of the node, and a pair of blocks is one piece of work that any task
    can take, so no task holds a bucket. In buckets a linked pair counts in the first one that it shares, found from the vectors alone,
    so no pair is counted twice and none has to be listed: what leaves a task are counts, and edges that connect the
    same nodes as all links of the piece do, fewer than its nodes.
    """
    placed = work.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = placed.join(vectors.select("node", "copies", "vector"), "node")
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))
    )
    dealt = full.withColumn("piece", F.explode(pieces))
    dealt = dealt.groupBy("dim", "key", "piece").agg(F.collect_list(F.struct("node", "copies", "block", "vector")).alias("items"))
    dealt = dealt.select("key", (F.col("piece.i") == F.col("piece.j")).alias("alone"), (F.col("dim") == 0).alias("whole"), "items")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for here, alone, whole, items in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids, copies, block = (items.values.field(k).to_numpy() for k in range(3))
                unit = _unit(next(_by_width(items.values.field(3)))[1])
                one = np.arange(len(ids)) if alone.as_py() else np.flatnonzero(block == block.min())
                two = one if alone.as_py() else np.flatnonzero(block != block.min())
                x, y = np.nonzero(unit[one] @ unit[two].T >= similarity)
                x, y = one[x], two[y]
                if alone.as_py():
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                if not whole.as_py():
                    # the buckets of the vectors that have a link here
                    some, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                    keys = np.concatenate([bucket_keys(unit[some[at : at + ROWS]], tables, hashes, probes) for at in range(0, len(some), ROWS)])
                    keys, place = np.ascontiguousarray(keys.transpose(1, 2, 0)), place.reshape(2, -1)
                    first = [_first_met(here.as_py(), keys, *place[:, at : at + PAIRS]) for at in range(0, len(x), PAIRS)]
                    x, y = x[np.concatenate(first)], y[np.concatenate(first)]
                links, joined = np.zeros(len(ids), np.int64), _Joined(len(ids))
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                joined.add(x, y)
                label, some = joined.fold(), np.flatnonzero(links)
                below = np.flatnonzero(label != np.arange(len(ids)))
                out.append((ids[some], links[some], ids[below], ids[label[below]]))
            if out:
                nodes, links, a, b = (np.concatenate([o[k] for o in out]) for k in range(4))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([nodes, np.minimum(a, b)])),
                        pa.array(np.concatenate([links, np.maximum(a, b)]), mask=np.arange(len(nodes) + len(a)) < len(nodes)),
                        pa.array(np.concatenate([links, np.zeros(len(a), np.int64)])),
                    ],
                    names=["a", "b", "links"],
                )

    return dealt.mapInArrow(compare, "a long, b long, links long")


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark deletes the files of a stored table's exchanges as soon as it is written, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _grouped(table: DataFrame, similarity: float, tables: int, hashes: int, probes: int) -> tuple[DataFrame, DataFrame]:
    """id, n_links and label of every row, a label of null for a row that has no link; label and component_id."""
    rows = stored(_named(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    able = rows.filter("name is not null")
    # rows of equal vectors: the first of them stands for all
    copied = able.groupBy("name").agg(F.count("*").alias("copies"), F.min("row").alias("node"))
    copied = stored(copied.filter("copies > 1"), "copied")
    maybe, _ = sieved(able.select("name", "row"), "name", copied.select("name"))
    again = stored(maybe.join(copied, "name").filter(F.col("row") != F.col("node")).select("row", F.col("node").alias("first")), "again")
    nodes = able.select(F.col("row").alias("node"), "vector")
    if not again.isEmpty():
        gone = again.select(F.col("row").alias("node"))
        some, sure = sieved(nodes, "node", gone)
        nodes = some.join(gone, "node", "left_anti").unionByName(sure)
    near, edges = _plausible(_dealt(nodes, tables, hashes, probes), similarity, hashes)
    labels = components(edges)
    work = _work(near, labels)
    vectors, _ = sieved(able.select(F.col("row").alias("node"), "vector"), "node", labels.select("node"))
    vectors = vectors.join(copied.select("node", "copies"), "node", "left")
    vectors = vectors.select("node", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "vector")
    found = stored(_verified(work, vectors, similarity, tables, hashes, probes), "links")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("b is not null").select("a", "b").distinct())
    sized = groups.join(links, "node").join(copied.select("node", "copies"), "node", "full")
    n_links = F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    sized = sized.select("node", n_links.alias("n_links"), F.coalesce("label", "node").alias("label"))
    of = rows.select("id", "row").join(again, "row", "left").select("id", F.coalesce("first", "row").alias("node"))
    placed = stored(of.join(sized, "node", "left").select("id", "n_links", "label"), "placed")
    return placed, stored(placed.filter("label is not null").groupBy("label").agg(F.min("id").alias("component_id")), "smallest")


def near_vectors(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    similarity: float = SIMILARITY,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
) -> DataFrame:
    """Links and groups of vectors whose cosine, in double precision, is `similarity` or more.

    Equal vectors become one node with a number of copies. Every node takes `probes` buckets in each of `tables` tables
    (cross-polytope hashes after fast Hadamard rotations, multiprobe on both sides); sketches rule out most
    members of a bucket before vectors are fetched, and what is left is compared exactly, in blocks.
    In 64 dimensions a pair at a cosine of 0.9 is missed with a chance of about 1 in 100,000 by default, a closer one
    less often; no pair below is linked. Take more `hashes` where buckets grow large, that is where the
    vectors are many more than (2 x dimensions) ^ hashes, and more tables with them.

    One row per input row: the key, n_links (long: other rows linked directly, copies included), component_id (smallest
    key reachable, itself included), kept (key is component_id). Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing, nor do vectors of different lengths with each other. Rows with the
    same key and different vectors are rows of their own. A null key has a component of null if no
    other row is in it. An empty table gives no rows. Other columns are not read.
    """
    with _tidy(table.sparkSession):
        placed, smallest = _grouped(table.select(F.col(key).alias("id"), F.col(vector).alias("vector")), similarity, tables, hashes, probes)
    linked = placed.filter("label is not null").join(smallest, "label").select("id", "n_links", "component_id")
    alone = placed.filter("label is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = linked.unionByName(alone)
    return rows.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
