"""Vector near duplicates, periodic runs and collocations against plain loops, on awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import periods, phrases, queries, vectors


def test_hadamard_keeps_lengths_and_rotations_differ():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(vectors.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    assert not np.allclose(vectors.rotated(x, 3), vectors.rotated(x, 4))


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(rng, n, d, cosine):
    a = unit(rng, n, d)
    b = rng.normal(size=(n, d))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b


@pytest.mark.parametrize("width", [48, 64])
def test_pairs_at_the_limit_share_a_bucket_and_near_sketches(width):
    a, b = pairs_at(np.random.default_rng(1), 4000, width, 0.9)
    x, y = vectors.bucket_keys(a), vectors.bucket_keys(b)
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    assert met.mean() > 0.999
    bits = np.bitwise_count(vectors.sketches(a) ^ vectors.sketches(b)).sum(1)
    assert bits.max() <= vectors.most_bits(0.9)


def brute_links(rows, similarity=0.9):
    links = [0] * len(rows)
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    def norm(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    units = [norm(v) for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= similarity:
                links[i] += 1
                links[j] += 1
                above[max(root(i), root(j))] = min(root(i), root(j))
    smallest = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        smallest[root(i)].append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in smallest.items()}
    return Counter((key, links[i], least[root(i)], key == least[root(i)]) for i, (key, _) in enumerate(rows))


def vector_rows(rng, width=32):
    rows = [[float(x) for x in v] for v in unit(rng, 150, width)]
    a, b = pairs_at(rng, 30, width, 0.93)
    rows += [[float(x) for x in v] for v in np.concatenate([a, b, 3.0 * a[:5]])]
    hot = unit(rng, 1, width)[0]
    rows += [[float(x) for x in hot + 0.02 * e] for e in rng.normal(size=(40, width))] + [[float(x) for x in hot]] * 12
    rows = [(1000 - i, v) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1)]
    rows += [(i, v) for i, v in enumerate(odd)]
    rows += [(None, rows[3][1]), (None, [1e30] * width), (7, [1e30] * width), (7, [1e30] * width), (8, [1.0] * 7), (9, [1.0] * 7), (10, [-0.0] + [1.0] * 6), (11, [0.0] + [1.0] * 6)]
    return rows


@pytest.mark.parametrize("small, block", [(4096, 512), (8, 6)])
def test_near_vectors_against_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(vectors, "SMALL", small)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows(np.random.default_rng(5))
    schema = "vec_id long, embedding array<double>, label int, name string, node long, key long, items string"
    table = spark.createDataFrame([(k, v, 1, "n", 1, 1, "i") for k, v in rows], schema).repartition(3)
    found = vectors.near_vectors(table)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in found.collect()) == brute_links(rows)


def chain(rng, n, d, cosine):
    x = unit(rng, n, d)
    for i in range(1, n):
        side = x[i] - (x[i] @ x[i - 1]) * x[i - 1]
        x[i] = cosine * x[i - 1] + np.sqrt(1 - cosine * cosine) * side / np.linalg.norm(side)
    return x


@pytest.mark.parametrize("width", [1, 2, 5, 33, 64])
def test_grains_rule_out_no_linked_pair_and_most_others(width):
    rng = np.random.default_rng(3)
    a, b = pairs_at(rng, 3000, width, 0.9) if width > 1 else (unit(rng, 3000, 1),) * 2
    c = unit(rng, 500, width) ** 5
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    sifter = vectors._Grains(vectors.grains(np.concatenate([a, b, c, c])), 0.9 - 1e-9)
    x = np.concatenate([np.arange(3000), 6000 + np.arange(500)])
    y = np.concatenate([3000 + np.arange(3000), 6500 + np.arange(500)])
    assert sifter.listed(x, y).all()
    assert (np.einsum("ij,ij->i", sifter.near[x], sifter.far[y]) >= sifter.least).all()
    found = vectors._many(sifter, 7000)
    assert found.near[x].all() and found.near[y].all() and (found.label[x] == found.label[y]).all()
    if width == 64:
        # sketches of 256 bits let pairs from a cosine of 0.6 on pass, of which a large table is full
        u, v = pairs_at(rng, 3000, width, 0.62)
        assert vectors._Grains(vectors.grains(np.concatenate([u, v])), 0.9).listed(np.arange(3000), 3000 + np.arange(3000)).mean() < 0.01


@pytest.mark.parametrize("small, block, width", [(1 << 15, 512, 32), (8, 6, 32), (8, 6, 100)])
def test_near_vectors_of_chains_and_groups(spark, monkeypatch, small, block, width):
    monkeypatch.setattr(vectors, "SMALL", small)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(11)
    hot = unit(rng, 1, width) + 0.03 * rng.normal(size=(40, width)) / np.sqrt(width / 32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([chain(rng, 300, width, 0.93), hot, unit(rng, 60, width), hot[:5]]))]
    rows += [(None, rows[3][1]), (2, rows[310][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    assert Counter(tuple(r) for r in vectors.near_vectors(table).collect()) == brute_links(rows)
    assert spark.conf.get(name) == before


def test_vectors_of_a_group_are_fetched_once(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([unit(rng, 1, 64) + 0.01 * rng.normal(size=(50, 64)), chain(rng, 300, 64, 0.93)])
    nodes = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "node long, vector array<double>")
    near, edges = vectors._plausible(vectors._dealt(nodes, 8, 2, 4), 0.9, 2)
    work = vectors._work(near, vectors.components(edges)).collect()
    assert Counter(r["node"] for r in work if r["node"] < 50) == Counter(range(50))
    # a chain is compared bucket by bucket
    assert {r["dim"] for r in work if r["node"] >= 50} == {64}


def test_a_slice_of_a_column_reads_its_own_values():
    column = pa.array([[1.0, 2.0], None, [3.0, None], [4.0, 5.0], [], [0.0, 0.0], [6.0, 7.0]], pa.list_(pa.float32()))
    for part in (column, column[2:], column[3:5], column[4:4], column[5:]):
        plain = [(i, v) for i, v in enumerate(part.to_pylist()) if v and None not in v and any(v)]
        assert [(i, v) for places, rows in vectors._by_width(part) for i, v in zip(places.tolist(), rows.tolist(), strict=True)] == plain


def test_near_vectors_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(table).collect() == []
    lone = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_vectors(lone).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_vector_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in table.collect()]
    assert Counter(tuple(r) for r in queries.op11_vector_dedup(spark, sf).collect()) == brute_links(rows)


def brute_runs(words, exponent=4, length=6):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def run_rows():
    rng = np.random.default_rng(3)
    texts = [None, "", " \t\n\x0b", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "a\x1ca a a ü ü ü ü ü ü", "b " * 3000]
    texts += [" ".join(f"w{i % 250}" for i in range(1100)), " ".join("ab"[i % 2] for i in range(9)) + " " + "c " * 7 + "ab " * 6]
    for _ in range(60):
        n, k = rng.integers(1, 70), rng.integers(1, 5)
        words = [str(x) for x in rng.integers(0, k, n)]
        if rng.random() < 0.6:
            a = int(rng.integers(0, n))
            p = int(rng.integers(1, max(2, (n - a) // 3)))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(" ".join(words))
    return list(enumerate(texts)) + [(None, "z z z z z z z"), (5, "q q q q q q"), (5, "q q q q q q")]


def test_periodic_runs_against_loops(spark):
    rows = run_rows()
    schema = "doc_id long, text string, body string, runs int, collapsed string, n_words string"
    docs = spark.createDataFrame([(i, t, "b", 1, "c", "n") for i, t in rows], schema).repartition(3)
    found = periods.periodic_runs(docs)
    mine = Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in found.collect())
    expected = Counter()
    for i, text in rows:
        words = split_words(text)
        runs = brute_runs(words)
        expected[(i, len(words), tuple(runs), brute_collapsed(words, runs))] += 1
    assert mine == expected
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_periodic_runs_of_other_bounds():
    for exponent, length in [(2, 2), (3, 9)]:
        for _, text in run_rows()[12:]:
            words = split_words(text)
            (n, runs, _), *_ = periods._of_texts([" ".join(words).encode()], exponent, length)
            assert (n, runs) == (len(words), brute_runs(words, exponent, length))


def test_runs_of_a_long_periodic_text():
    words = ["a", "b", "c"] * 100_000
    assert list(periods._of_texts([" ".join(words).encode()], 4, 6)) == [(300_000, [(0, 300_000, 3)], b"a b c")]


def test_planted_runs_and_their_digests(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(str(x) for x in rng.integers(0, 9, rng.integers(0, 60)))) for i in range(200)] + [(None, "a b c"), (20, None)]
    folder = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(folder)
    expected = Counter()
    for i, text in rows:
        words = split_words(text)
        n, h = len(words), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute_runs(words)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest())
        expected[(i, len(runs), *top, milli, *digests)] += 1
    assert Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()) == expected


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_phrases(rows, depth, least, top, within):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, depth + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                dropped.update(p[i : i + n] for i in range(len(p) - n + 1) if 100 * a >= within * own[p[i : i + n]])
        best = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(11)
    rows = [(None, None), ("en", None), ("en", ""), ("en", " .,\n\t"), ("", "one two one two"), (None, "Ünder the bridge\x0bunder the Bridge, under  the\tbridge")]
    for lang in ["en", "de", None]:
        for _ in range(25):
            words = [f"w{int(x)}" for x in rng.zipf(1.5, 80) if x < 40]
            marks = rng.choice(["", "", "", ".", ",", "\n", "!"], len(words))
            rows.append((lang, " ".join(w.upper() if k % 7 == 0 else w + m for k, (w, m) in enumerate(zip(words, marks, strict=True)))))
    rows += [("en", "the very same. " * 2000 + "end " * 300)] * 2
    return rows


@pytest.mark.parametrize("depth, least, top, hot, room", [(3, 3, 2000, 1 << 60, 1 << 20), (3, 3, 12, 20, 500), (2, 2, 2000, 50, 100), (4, 4, 50, 1, 1 << 20)])
def test_collocations_against_counts(spark, depth, least, top, hot, room):
    rows = phrase_rows()
    schema = "doc_id long, text string, lang string, words string, a int, hot string, n string"
    docs = spark.createDataFrame([(1, t, l, "w", 1, "h", "n") for l, t in rows], schema).repartition(3)
    found = phrases.collocations(docs, depth, least, top, hot=hot, room=room)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, depth, least, top, 50)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).collect() == []


def test_word_hashes_are_crc32():
    rng = np.random.default_rng(5)
    texts = ["a" * 300 + " " + " ".join("x" * int(n) + str(n) for n in rng.integers(0, 90, 50)), "ünï a", None, "", "b" * 64 + " " + "b" * 65]
    found = phrases.Words(pa.array(["en", "de", "en", "en", None]), pa.array(texts))
    pairs = zip(found.langs.to_pylist(), found.words.to_pylist(), strict=True)
    assert found.hashes().tolist() == [zlib.crc32(lang.encode() + b"\n" + word) for lang, word in pairs]
    assert phrases.Words(pa.array([], pa.string()), pa.array([], pa.string())).hashes().tolist() == []


def test_tasks_sort_only_what_may_be_frequent():
    """Of many rare pairs few are sorted; none that weighs enough is left out."""
    rng = np.random.default_rng(6)
    keys = np.concatenate([rng.integers(1, 20_000, (40_000, 2)), np.repeat([[7, 8], [8, 7]], 30, 0), [[9, 9]]])
    weights = np.concatenate([np.ones(40_060, np.int64), [10]])
    kept = phrases._maybe_frequent(keys, weights, 10)
    totals = Counter()
    for pair, weight in zip(map(tuple, keys.tolist()), weights.tolist(), strict=True):
        totals[pair] += weight
    assert all(k for k, pair in zip(kept.tolist(), map(tuple, keys.tolist()), strict=True) if totals[pair] >= 10)
    assert kept.sum() < 1000


def test_suffixes_travel_packed(spark, monkeypatch):
    """What a task sends to another is a row a language, and suffixes that share their first words meet in one task."""
    rng = np.random.default_rng(8)
    texts = [(lang, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, 4000), 500))) for lang in ["en", "de", None] for _ in range(4)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    seen, sort = [], phrases._sorted_counts
    monkeypatch.setattr(phrases, "_sorted_counts", lambda routed, *rest: seen.append(routed) or sort(routed, *rest))
    phrases.phrase_counts(docs, least=3, hot=400, room=2000)
    counts = defaultdict(Counter)
    for lang, text in texts:
        words = text.split()
        for n in (1, 2, 3):
            counts[n].update((lang or "und", *words[i : i + n]) for i in range(len(words) - n + 1))
    for routed, shortest in zip(seen, (2, 3), strict=True):
        tasks = routed.rdd.getNumPartitions()
        assert tasks > 8
        rows = routed.withColumn("task", F.spark_partition_id()).collect()
        assert len(rows) <= 2 * 3 * tasks
        found, met, spread = Counter(), defaultdict(set), defaultdict(set)
        for row in rows:
            places = [row[f"w{k}"].split(" ") for k in range(shortest)]
            for weight, *words in zip(np.frombuffer(row["weights"], "<u4").tolist(), *places, strict=True):
                found[(row["lang"], *words)] += weight
                met[(row["lang"], *words)].add(row["task"])
                spread[(row["lang"], words[0])].add(row["task"])
        assert all(found[p] == a for p, a in counts[shortest].items() if a >= 3)
        assert all(a <= counts[shortest][p] for p, a in found.items())
        assert {len(at) for at in met.values()} == {1}
        assert all(len(at) <= -(-counts[1][w] // 400) for w, at in spread.items())
        assert max(len(at) for at in spread.values()) > 4


def test_quicksort_partitions():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 5, (500, 3))
    keys[keys[:, 0] == 0] = 0
    keys[keys[:, 1] == 0, 1:] = 0
    weights = rng.integers(1, 9, 500)
    expected = Counter()
    for key, weight in zip(keys.tolist(), weights.tolist(), strict=True):
        for d in (1, 2, 3):
            if key[d - 1]:
                expected[tuple(key[:d])] += weight
    found = {tuple(keys[s, :d].tolist()): w for d, at, many in phrases.multikey_quicksort(keys, weights, 30) for s, w in zip(at.tolist(), many.tolist(), strict=True)}
    assert found == {k: w for k, w in expected.items() if w >= 30}
    assert list(phrases.multikey_quicksort(np.zeros((0, 3), np.int64), np.zeros(0, np.int64), 1)) == []


@pytest.mark.parametrize("key", ["op11_vector_dedup", "op12_periodic_runs", "op13_collocations"])
def test_new_queries_like_their_sql(spark, key):
    from panelcast.llm.oracles import ORACLES
    from tests.compare import connect

    sf = "/root/testdata/sf0.001"
    con = connect(sf)
    found = queries.QUERIES[key](spark, sf)
    result = con.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert Counter(tuple(r) for r in found.select(*[F.col(n) for n in names]).collect()) == Counter(result.fetchall())
