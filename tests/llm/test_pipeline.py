"""The pipeline's stages and its result, against plain loops."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from panelcast.llm import language, lines, mixing, packing
from panelcast.llm.queries import WEIGHTS
from tests.llm.test_operators import WORD, near_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, input int"
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
ENGLISH = "the river house morning friend walks through quiet street with three small dogs every winter day before breakfast under grey clouds".split()
GERMAN = "der Fluss Haus Morgen Freund geht durch stille Strasse mit drei kleinen Hunden jeden Winter Tag vor dem Essen unter grauen Wolken".split()


def speech(words: list[str], seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(words, n))


def table() -> list[tuple]:
    shared = speech(ENGLISH, 900, 30)
    texts = [(speech(ENGLISH if k % 3 else GERMAN, k, 25 + 7 * k), "en" if k % 3 else "de") for k in range(24)]
    texts += [(f"{speech(ENGLISH, 30 + k, 12)}\n{shared}\n{speech(ENGLISH, 40 + k, 15)}", None) for k in range(4)]
    texts += [(shared, "en"), (None, "en"), ("", None), (" \n\t", "de"), ("12 34 - 56", None), ("the river", None), ("the river", None)]
    near = speech(ENGLISH, 70, 120).split()
    texts += [(" ".join([*near[:k], "changed", *near[k + 1 :]]), "en") for k in (3, 60, 61)]
    texts += [(speech(GERMAN, 80, 5000), "de")]
    rows = [(k, t, lang, [None, "s-1", "s-2", "odd"][k % 4], len(t) if t else None, "x", k) for k, (t, lang) in enumerate(texts)]
    return [*rows, rows[5], rows[5], rows[-1], rows[33], (None, None, None, None, None, None, None)]


def languages_by_hand(rows: list[tuple], learned: dict[str, str]) -> list[tuple]:
    def plain(text: str) -> str:
        return re.sub(r"[\W\d_]+", " ", text.lower())

    def phrases(text: str, known: str) -> int:
        count, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in known:
                size += 1
            count, at = count + 1, at + size
        return count

    kept, known = [], {lang: plain(text) for lang, text in sorted(learned.items())}
    for row in rows:
        text = plain(row[1] or "")
        if text.strip():
            cost = {lang: phrases(text, sample) for lang, sample in known.items()}
            kept.append((*row[:2], min(cost, key=lambda lang: (cost[lang], lang)), *row[3:]))
    return kept


def lines_by_hand(rows: list[tuple]) -> list[tuple]:
    """The texts without later copies of runs of lines; rows have different doc_ids unless all their columns are equal."""
    first, seen, kept = {}, set(), []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        text = row[1]
        words = len(WORD.findall(text or ""))
        if row in seen and words >= lines.LEAST_WORDS:
            continue
        if text is None or row in seen:
            kept.append(row)
            continue
        seen.add(row)
        split = text.split("\n")
        ahead = np.concatenate([[0], np.cumsum([len(WORD.findall(s)) for s in split])])
        runs = set()
        for a in range(len(split)):
            runs |= {(a, b) for b in range(a + 1, len(split) + 1) if ahead[b] - ahead[a] >= lines.LEAST_WORDS > ahead[b - 1] - ahead[a]}
            runs |= {(b, a + 1) for b in range(a + 1) if ahead[a + 1] - ahead[b] >= lines.LEAST_WORDS > ahead[a + 1] - ahead[b + 1]}
        gone = set()
        for a, b in sorted(runs):
            if first.setdefault(tuple(split[a:b]), (row, a)) != (row, a):
                gone |= set(range(a, b))
        left = "\n".join(s for k, s in enumerate(split) if k not in gone)
        if not gone:
            kept.append(row)
        elif WORD.search(left):
            kept.append((row[0], left, *row[2:4], len(left), *row[5:]))
    return kept


def near_kept_by_hand(rows: list[tuple]) -> list[tuple]:
    """The first row of each group of near duplicates by doc_id (null last) and digest; groups are of rows, not of doc_ids."""
    groups = near_by_hand([(i, row[1]) for i, row in enumerate(rows)])
    members = defaultdict(list)
    for row, (_, n, group) in zip(rows, groups, strict=True):
        members[group if n else (group, "alone")].append(row)
    return [min(own, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest() if r[1] else "")) for own in members.values()]


def shares_by_hand(budget: int, children: dict) -> dict:
    """Names to (supply, weight): takes short children out until all others have enough of the level."""
    got, open_, left = {}, dict(children), budget
    level = 0.0
    while open_:
        weight = sum(w for _, w in open_.values())
        level = left / weight
        short = [c for c, (s, w) in open_.items() if s <= level * w]
        if not short:
            break
        for c in short:
            got[c] = open_.pop(c)[0]
            left -= got[c]
    got |= {c: int(level * w) for c, (_, w) in open_.items()}
    rest = min(budget, sum(s for s, _ in children.values())) - sum(got.values())
    for c in sorted(open_, key=lambda c: (open_[c][0] / open_[c][1], c is not None, c))[:rest]:
        got[c] += 1
    return got


def mix_by_hand(rows: list[tuple]) -> list[tuple]:
    def path(row):
        number = re.search("([0-9]+)$", row[3] or "")
        return ("web", "books", "forum")[int(number[1]) % 3 if number else 0], row[2], row[3]

    def tokens(row):
        return len(WORD.findall(row[1] or ""))

    leaves = defaultdict(list)
    for row in rows:
        leaves[path(row)].append(row)
    supply = Counter()
    for leaf, members in leaves.items():
        for depth in range(4):
            supply[leaf[:depth]] += mixing.EPOCHS * sum(map(tokens, members))
    budgets = {(): supply[()] // mixing.EPOCHS}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in {leaf[:depth] for leaf in leaves}:
            names = {leaf[depth] for leaf in leaves if leaf[:depth] == parent}
            children = {n: (supply[(*parent, n)], WEIGHTS[level].get(n, 1.0)) for n in names}
            budgets |= {(*parent, n): share for n, share in shares_by_hand(budgets[parent], children).items()}
    chosen = []
    for leaf, members in leaves.items():
        size = sum(map(tokens, members))
        full, part = divmod(budgets[leaf], size) if size else (0, 0)
        chosen += members * full
        order = lambda r: (hashlib.md5(f"{mixing.SEED}:{full}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0], tokens(r))
        for row in sorted(members, key=order):
            take = min(part, tokens(row))
            part -= take
            if take and take == tokens(row):
                chosen.append(row)
            elif take:
                text = row[1][: list(WORD.finditer(row[1]))[take - 1].end()]
                chosen.append((row[0], text, *row[2:4], len(text), *row[5:]))
    return chosen


def pieces_by_hand(rows: list[tuple]) -> Counter:
    found = Counter()
    for row in rows:
        n = len(WORD.findall(row[1] or ""))
        for piece in range(max(1, -(-n // packing.LONGEST))):
            start = piece * packing.LONGEST
            found[row[0], piece, start, min(n - start, packing.LONGEST)] += 1
    return found


def least_padding(lengths: Counter, buckets: int) -> int:
    sizes = sorted(lengths)

    @functools.cache
    def cost(j: int, k: int) -> float:
        if j == 0 or k == 0:
            return 0 if j == 0 else float("inf")
        return min(cost(i, k - 1) + sum((sizes[j - 1] - n) * lengths[n] for n in sizes[i:j]) for i in range(j))

    return cost(len(sizes), buckets)


def check_packed(found: list, rows: list[tuple]) -> None:
    expected = pieces_by_hand(rows)
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in found) == expected
    lengths = Counter()
    for (_, _, _, n), times in expected.items():
        if n:
            lengths[n] += times
    assert sum(r.padding or 0 for r in found) == least_padding(lengths, packing.BUCKETS)
    ends = sorted({r.bucket_len for r in found if r.bucket_len})
    buckets = defaultdict(list)
    for r in found:
        if r.n_tokens:
            assert r.bucket_len == min(e for e in ends if e >= r.n_tokens)
            buckets[r.bucket_len].append(r)
    for end, members in buckets.items():
        fit = max(1, packing.BATCH_TOKENS // end)
        members.sort(key=lambda r: (r.batch, r.place))
        assert [(r.batch, r.place) for r in members] == [divmod(k, fit) for k in range(len(members))]
        ids = [(r.doc_id is not None, r.doc_id, r.piece) for r in members]
        assert ids == sorted(ids)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(table(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def clashing() -> list[tuple]:
    """Rows that share a doc_id, or have none, with like and unlike texts."""
    near = speech(ENGLISH, 71, 100).split()
    texts = [(5, speech(ENGLISH, 501, 40)), (5, speech(GERMAN, 502, 40)), (None, speech(ENGLISH, 503, 40)), (None, speech(GERMAN, 504, 40))]
    texts += [(6, " ".join(near)), (6, " ".join([*near[:50], "other", *near[51:]])), (None, " ".join([*near[:20], "other", *near[21:]])), (7, None), (7, None), (8, "")]
    return [(i, t, "en", "s-1", len(t) if t else None, None, k) for k, (i, t) in enumerate(texts)]


def test_language_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    learned = language.samples(docs, ~language.held_out())
    made = corpus_pipeline.identify_language(spark, docs, folder)
    assert made.columns == COLUMNS
    assert bag(made.collect()) == bag(languages_by_hand(table(), learned))


@pytest.mark.parametrize("name, loop", [("line_dedup", lines_by_hand), ("near_dedup", near_kept_by_hand), ("mixing", mix_by_hand)])
@pytest.mark.parametrize("rows", [table, clashing, lambda: [*clashing(), *table()], lambda: [r for r in table() if r[0] is not None]])
def test_stage(spark, folder, name, loop, rows):
    given = rows()
    if name == "line_dedup":  # its loop takes the first copy by doc_id, so doc_ids differ unless rows are equal
        given = [row for k, row in enumerate(given) if not any(row[0] == r[0] and row != r for r in given[:k])]
    if name == "mixing":  # a leaf's last document may be cut; of documents that tie in order, either may be
        given = [row for k, row in enumerate(given) if not any(row[0] == r[0] for r in given[:k])]
    made = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(given, SCHEMA).repartition(2), folder)
    assert made.columns == COLUMNS
    assert bag(made.collect()) == bag(loop(given))


def test_mixing_takes_as_many_tokens_from_tied_rows(spark, folder):
    given = [*clashing(), *table(), *clashing()]
    made = corpus_pipeline.mix_sources(spark, spark.createDataFrame(given, SCHEMA).repartition(2), folder).collect()

    def tokens(rows) -> Counter:
        found = Counter()
        for row in rows:
            found[row[2], row[3], row[0]] += len(WORD.findall(row[1] or ""))
        return +found

    assert tokens(made) == tokens(mix_by_hand(given))


def test_packing_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check_packed(corpus_pipeline.pack(spark, docs, folder).collect(), table())


def test_run(spark, folder):
    learned = language.samples(spark.read.parquet(f"{folder}/documents.parquet"), ~language.held_out())
    left = mix_by_hand(near_kept_by_hand(lines_by_hand(languages_by_hand(table(), learned))))
    check_packed(corpus_pipeline.run(spark, folder).collect(), left)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
