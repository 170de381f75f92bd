"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled rows to learn from for each language, and the length beyond which a row is only drawn where shorter ones lack.
ROWS, LENGTH = 40, 8000
#: Characters of a block, parsed at the same time as other blocks; and characters parsed together.
BLOCK, CHUNK = 1024, 2_000_000
UNKNOWN = "und"
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: States x letters up to which an automaton is also laid out as a plain table (32 MB); a faster layout of the same steps.
PLAIN = 1 << 23
#: Parses that go on one by one, as arrays would not be faster.
FEW = 16


class Automaton:
    """Suffix automaton of a text: every substring is a path from state 0, in at most 2 states and 3 steps a character.

    Characters are integers from 0 to `letters` - 1, however many. The steps are one hash table with open places, from state and
    character to state, so memory follows the text and not states x letters.
    """

    def __init__(self, codes: list[int], letters: int):
        self.letters = letters
        step: dict[int, int] = {}
        edges: list[list[int]] = [[]]
        longest, link = [0], [-1]
        last = 0
        for c in codes:
            now = len(longest)
            longest.append(longest[last] + 1)
            link.append(0)
            edges.append([])
            p = last
            while p != -1 and p * letters + c not in step:
                step[p * letters + c] = now
                edges[p].append(c)
                p = link[p]
            if p != -1:
                q = step[p * letters + c]
                if longest[p] + 1 == longest[q]:
                    link[now] = q
                else:
                    twin = len(longest)
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    edges.append(edges[q].copy())
                    for e in edges[q]:
                        step[twin * letters + e] = step[q * letters + e]
                    while p != -1 and step.get(p * letters + c) == q:
                        step[p * letters + c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        self.size = len(longest)
        self._place(np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))

    def _place(self, keys: np.ndarray, states: np.ndarray) -> None:
        """Each key takes the first free place from its hash on; tables are at most two thirds full."""
        self.bits = max(4, int(1.5 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.states = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        at = self._hash(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.states[at[first]] = keys[first], states[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, states, at = keys[left], states[left], (at[left] + 1) % size
        self.root = np.full(self.letters, -1, np.int32)
        self.root[:] = self.next(np.zeros(self.letters, np.int64), np.arange(self.letters))

    def plain(self) -> np.ndarray | None:
        """The steps as a table by state and letter, if it is small; built once in a process."""
        if "table" not in self.__dict__:
            self.table = None
            if self.size * self.letters <= PLAIN:
                self.table = np.full(self.size * self.letters, -1, np.int32)
                used = self.keys >= 0
                self.table[self.keys[used]] = self.states[used]
        return self.table

    def step(self, state: int, code: int) -> int:
        """`next` of one character."""
        key = state * self.letters + code
        if self.__dict__.get("table") is not None:
            return self.table.item(key)
        at = ((key * int(_HASH)) & ((1 << 64) - 1)) >> (64 - self.bits)
        while (seen := self.keys.item(at)) != key:
            if seen < 0:
                return -1
            at = (at + 1) % len(self.keys)
        return self.states.item(at)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that the characters lead to; -1 where no substring goes on."""
        key = state * self.letters + code
        table = self.__dict__.get("table")
        if table is not None:
            return table.take(key)
        at = self._hash(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.states[at], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.states[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def _plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and each text's end."""
    lowered = [text.lower() for text in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([len(text) for text in lowered], dtype=np.int64)


class Alphabet:
    """Codes of characters: 0 any letter that the samples lack, 1 what is no letter, from 2 on the letters of the samples."""

    def __init__(self, samples: list[str]):
        self.letters = np.array(sorted({ord(ch) for text in samples for ch in text.lower() if ch.isalpha()}), np.uint32)
        self.size = len(self.letters) + 2
        kinds = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        self.table = np.where(kinds, 0, 1).astype(np.min_scalar_type(self.size))
        self.table[self.letters] = np.arange(2, self.size)

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts, each run of other characters as one blank, and where each text ends."""
        points, ends = _plain(texts)
        codes = self.table[points]
        del points  # four bytes a character
        blank = codes == 1
        first = np.zeros(len(codes), bool)
        first[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]] = True
        kept = ~blank | first | ~np.concatenate([[False], blank[:-1]])
        sizes = np.zeros(len(ends), np.int64)
        some = np.diff(ends, prepend=0) > 0
        if some.any():
            sizes[some] = np.add.reduceat(kept, np.concatenate([[0], ends[:-1]])[some], dtype=np.int64)
        return codes[kept], np.cumsum(sizes)


def _lanes(codes: np.ndarray, automaton: Automaton, begin: np.ndarray, stop: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Greedy parses of the ranges, each from a phrase that begins with it; sets the flags of the places where phrases begin.

    Returns the state of each at its stop: 0 if a phrase ends there. All go on by one character at a time. Where the automaton has no
    step, the phrase ends and the next begins with this character; a character that the learned text lacks is a phrase.
    """
    order = np.argsort(begin - stop, kind="stable")
    begin, lengths = begin[order], (stop - begin)[order]
    state = np.zeros(len(begin), np.int64)
    if not len(begin) or not lengths[0]:
        return state
    grid = np.zeros((lengths[0], len(begin)), np.min_scalar_type(automaton.letters))
    for lane, (at, size) in enumerate(zip(begin.tolist(), lengths.tolist(), strict=True)):
        grid[:size, lane] = codes[at : at + size]
    flags[begin[lengths > 0]] = True
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    automaton.plain()
    for at in range(lengths[0]):
        n = alive[at]
        code = grid[at, :n]
        now = automaton.next(state[:n], code).astype(np.int64)
        stuck = np.flatnonzero(now < 0)
        if len(stuck):
            ended = stuck[state[stuck] > 0]
            flags[begin[ended] + at] = True
            fresh = automaton.root[code[stuck]]
            unknown = stuck[fresh < 0]
            flags[begin[unknown[lengths[unknown] > at + 1]] + at + 1] = True
            now[stuck] = np.maximum(fresh, 0)
        state[:n] = now
    out = np.empty_like(state)
    out[order] = state
    return out


def _carried_one(codes: np.ndarray, automaton: Automaton, place: int, state: int, stop: int, known: np.ndarray) -> tuple[list[int], int, int]:
    """The same as `_carried` for one parse, without arrays."""
    begun: list[int] = []
    while place < stop:
        code = codes.item(place)
        now = automaton.step(state, code)
        if now < 0 and state > 0:
            if known[place]:
                return begun, place, -1
            begun.append(place)
            now = automaton.root.item(code)
        place += 1
        if now < 0 and place < stop:
            if known[place]:
                return begun, place, -1
            begun.append(place)
        state = max(now, 0)
    return begun, place, state


def _carried(
    codes: np.ndarray, automaton: Automaton, place: np.ndarray, state: np.ndarray, stop: np.ndarray, known: np.ndarray, twins: bool
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Phrases under way at the places are carried on until one begins where it is known that one does, or to the stop.

    With `twins`, what is known is a parse in which a phrase begins at each of the places. It goes along, and once both are in the
    same state of the automaton they remain so: the known parse is met there as well.
    Returns the places where other phrases begin, and where and in which state each parse was left; -1: it met the known one.
    """
    begun, lane = [], np.arange(len(place))
    twin = np.zeros(len(place) if twins else 0, np.int64)
    place, left, last = place.copy(), state.copy(), place.copy()
    while len(lane):
        if len(lane) <= FEW:
            for k, at, now in zip(lane.tolist(), place.tolist(), state.tolist(), strict=True):
                own, last[k], left[k] = _carried_one(codes, automaton, at, now, int(stop[k]), known)
                begun.append(np.array(own, np.int64))
            break
        code = codes[place]
        now = automaton.next(state, code).astype(np.int64)
        ends = (now < 0) & (state > 0)
        met = ends & known[place]
        unknown = (now < 0) & ~ends
        begun.append(place[ends & ~met])
        again = ends & ~met
        now[again] = automaton.root[code[again]]
        unknown |= again & (now < 0)
        place = np.where(met, place, place + 1)
        state = np.maximum(now, 0)
        over = place >= stop[lane]
        other = unknown & ~over
        met |= other & known[np.minimum(place, len(known) - 1)]
        begun.append(place[other & ~met])
        if twins:
            twin = automaton.next(twin, code).astype(np.int64)
            fresh = twin < 0
            twin[fresh] = np.maximum(automaton.root[code[fresh]], 0)
            met |= (twin == state) & (state > 0) & ~met
        done = met | over
        last[lane[done]] = place[done]
        left[lane[done]] = np.where(met[done], -1, state[done])
        lane, place, state = lane[~done], place[~done], state[~done]
        twin = twin[~done] if twins else twin
    return begun, last, left


def phrases(codes: np.ndarray, ends: np.ndarray, automaton: Automaton, block: int = BLOCK) -> np.ndarray:
    """For each text the number of phrases of its greedy parse into longest matches.

    Blocks of a text are parsed at the same time, each as if a phrase began with it. Then the phrase under way at the end of a block
    is carried on into the next, and the phrases after it, until one begins at a place where that block's own parse
    begins one: from there on both parses are the same. So the count is that of one parse of the whole text.
    """
    if not len(codes):
        return np.zeros(len(ends), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    many = -(-(ends - starts) // block)
    text = np.repeat(np.arange(len(ends)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = starts[text] + number * block
    stop = np.minimum(begin + block, ends[text])
    flags = np.zeros(len(codes) + 1, bool)
    state = _lanes(codes, automaton, begin, stop, flags)
    follows = np.append(number[1:] > 0, False)  # the block after this one is of the same text
    todo, twins = np.flatnonzero(follows & (state > 0)), True
    while len(todo):
        after = todo + 1
        begun, last, left = _carried(codes, automaton, begin[after], state[todo], stop[after], flags, twins)
        twins = False  # from now on a block may hold another parse than its own
        for a, b in zip(begin[after].tolist(), last.tolist(), strict=True):
            flags[a:b] = False
        for places in begun:
            flags[places] = True
        # parses that went through a whole block leave it in another state than its own did
        through = left >= 0
        state[after[through]] = left[through]
        todo = after[through & follows[after]]
        # those that end with a phrase leave the next block as it is, whose first place must then begin one
        whole = todo[state[todo] == 0]
        flags[begin[whole + 1]] = True
        todo = todo[state[todo] > 0]
    flags[-1] = False
    return np.add.reduceat(flags, starts, dtype=np.int64) * (ends > starts)


def samples(docs: DataFrame, learn: Column, rows: int = ROWS, length: int = LENGTH) -> dict[str, str]:
    """Whole texts of `rows` labelled documents for each language, at most.

    Texts up to `length` characters come first, then the smallest hashes of doc_id, so the draw does not depend on the layout
    of the table, and a language of long texts has a sample too. Each of 64 parts of a language hands on `rows` rows, so no task
    sees a language. Rows without a doc_id are not drawn. The driver holds languages x rows texts.
    """
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sized = labelled.select("lang", "doc_id", (F.length("text") > length).alias("long"), F.xxhash64("doc_id").alias("draw"), F.xxhash64("text").alias("tie"))
    order = ["long", "draw", "doc_id", "tie"]
    part = F.pmod(F.col("draw"), F.lit(64))
    first = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    some = sized.withColumn("at", first).filter(F.col("at") <= rows).drop("at")
    drawn = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("at") <= rows)
    drawn = drawn.select("lang", "doc_id", "tie").distinct()
    # bounded: languages x rows
    texts = labelled.withColumn("tie", F.xxhash64("text")).join(F.broadcast(drawn), ["lang", "doc_id", "tie"])
    texts = texts.groupBy("lang", "doc_id", "tie").agg(F.min("text").alias("text")).sort("lang", F.xxhash64("doc_id"), "doc_id", "tie").collect()
    found: dict[str, list[str]] = {}
    for row in texts:
        found.setdefault(row["lang"], []).append(row["text"])
    joined = {lang: " ".join(own) for lang, own in found.items()}
    return {lang: text for lang, text in joined.items() if any(ch.isalpha() for ch in text)}


class Model:
    """The automata of all languages over one alphabet."""

    def __init__(self, learned: dict[str, str]):
        self.names = sorted(learned)
        self.alphabet = Alphabet(list(learned.values()))
        self.automata = [Automaton(self.alphabet.coded([learned[name]])[0].tolist(), self.alphabet.size) for name in self.names]

    def predict(self, texts: list[str | None], block: int = BLOCK) -> tuple[list[str], list[float]]:
        codes, ends = self.alphabet.coded([text or "" for text in texts])
        lengths = np.diff(ends, prepend=0)
        spoken = np.zeros(len(texts), bool)
        if len(codes):
            spoken = np.add.reduceat(np.append(codes != 1, False), np.concatenate([[0], ends[:-1]]), dtype=np.int64) * (lengths > 0) > 0
        costs = np.zeros((len(self.names), len(texts)))
        for k, automaton in enumerate(self.automata):
            costs[k] = phrases(codes, ends, automaton, block) / np.maximum(lengths, 1)
        langs, scores = [], []
        for i in range(len(texts)):
            if not spoken[i] or not self.names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            ranked = np.argsort(costs[:, i], kind="stable")
            best = costs[ranked[0], i]
            other = costs[ranked[1], i] if len(ranked) > 1 else 1.0
            langs.append(self.names[ranked[0]])
            scores.append(float(np.clip(1 - best / other, 0, 1)) if other > 0 else 0.0)
        return langs, scores


def identified(docs: DataFrame, learned: dict[str, str], block: int = BLOCK, carry: list[str] | None = None) -> DataFrame:
    """The language in whose text a document needs the fewest phrases per character.

    A document is parsed, against each language's suffix automaton, into the longest pieces that occur in the
    language's text. Whole texts are parsed by one rule; blocks of `block` characters only let a long text
    take many lanes. Letters are lower-cased, runs of other characters are one blank. All letters of all samples
    have a code of their own. Ties go to the language first by name.

    The automata are built once and broadcast: some 40 bytes for each character of the samples.

    Returns the carried columns (doc_id by default; a carried text passes through a task once), lang_pred and score: 1 minus the phrases of the best over
    those of the second best language, 0 for a tie. A null text, and one without a letter, is `und`
    with score 0; so is everything when no language was learned. Repeated rows are predicted each. An empty
    table gives no rows. No other column is read.
    """
    carry = carry or ["doc_id"]
    others, whole = [c for c in carry if c != "text"], "text" in carry
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col("text").alias("body"))
    handed = [*[f"c{i}" for i in range(len(others))], *["body"] * whole]
    shared = docs.sparkSession.sparkContext.broadcast(Model(learned))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, size = [], 0
                while first + len(texts) < batch.num_rows and size < CHUNK:
                    texts.append(batch.column(len(others))[first + len(texts)].as_py())
                    size += len(texts[-1] or "")
                part = batch.slice(first, len(texts))
                langs, scores = model.predict(texts, block)
                first += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(handed)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*handed, "lang_pred", "score"]
                )
            batch = part = texts = None  # before the next one is read

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in handed], "lang_pred string", "score double"])
    found = rows.mapInArrow(predict, schema)
    return found.select(*[F.col("body" if c == "text" else f"c{others.index(c)}").alias(c) for c in carry], "lang_pred", "score")


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
