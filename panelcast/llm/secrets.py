"""Secret scanning: fixed patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import smallest_hashes, stored, text_or_empty

#: Fixed patterns of the base rules, with the group whose length counts and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of 16 or more: shorter runs would be dropped
BASE = [("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16)]
#: Strings the models judge, the letters they know, and the mean log-likelihood ratio of a step that makes a secret.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 0.5
#: Documents whose strings are learned from, at most, and the share of held-out ordinary strings that may be called secrets.
SAMPLE, MOST_WRONG = 2000, 0.01
#: The order of kinds among spans with the same start.
KINDS = ["assign", "access", "hex", "markov"]


SPANS = "array<struct<start:int,end:int,value:string>>"


def _kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once.

    The optimizer would copy a column's expression into every place, even into a lambda that runs for each element, where
    it is used; it does not reach through a generator, here of one row.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def hits_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def placed(gaps: Column, hits: Column, values: Column) -> Column:
    """The matches as array of start, end (code points) and value, from the texts between, in and of the group of them.

    split() gives what lies between the matches that regexp_extract_all() gives, so the
    positions are running sums of the lengths of both.
    """
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(part["hit"].isNull(), done["found"]).otherwise(F.concat(done["found"], one)).alias("found"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")), step)["found"]


def with_base(rows: DataFrame) -> DataFrame:
    """Adds the spans of each base rule, the matches that are long enough, to the texts."""
    found = rows.select(
        "*",
        *[hits_of(F.col("text"), pattern).alias(f"{kind}_hits") for kind, pattern, _, _ in BASE],
        hits_of(F.col("text"), ASSIGN, 2).alias("assign_values"),
    )
    found, nothing = _kept(found), F.array().cast(SPANS)

    def spans_of(kind: str, pattern: str, group: int, least: int) -> Column:
        hits, values = F.col(f"{kind}_hits"), F.col(f"{kind}_{'values' if group else 'hits'}")
        some = F.exists(values, lambda v: F.length(v) >= least)
        spans = F.filter(placed(F.split("text", pattern, -1), hits, values), lambda m: F.length(m["value"]) >= least)
        return F.when(some, spans).otherwise(nothing).alias(kind)

    return _kept(found.select(*rows.columns, *[spans_of(*rule) for rule in BASE]))


def drawn_texts(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id and text of `rows` documents at most: those with the smallest hashes of doc_id.

    Only ids are sorted (see `smallest_hashes`); then the texts of the drawn ids are fetched, of rows with one id the smallest.
    """
    ids = smallest_hashes(docs, "doc_id", rows)
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")  # bounded: `rows` ids
    return stored(found.groupBy("doc_id").agg(F.min("text").alias("text")), "drawn")


def _identifiers(texts: DataFrame) -> DataFrame:
    """Names as people write them, of each two to four words in a row: camelCase, snake_case, kebab-case, paths, constants.

    texts: words, an array. Groups of words become rows before anything is made of them.
    """
    words = _kept(texts.filter(F.size("words") > 3))
    groups = F.transform(F.sequence(F.lit(1), F.size("words") - 3, F.lit(4)), lambda i: F.slice("words", i, 2 + i % 3))
    rows = words.select(F.explode(groups).alias("w"))
    camel = F.array_join(F.transform("w", F.initcap), "")
    forms = [camel, F.array_join("w", "_"), F.array_join("w", "-"), F.concat(F.lit("/"), F.array_join("w", "/")), F.upper(F.array_join("w", "_"))]
    return rows.select(F.explode(F.array(*forms)).alias("value"))


def samples(docs: DataFrame, names: DataFrame | None = None, rows: int = SAMPLE) -> DataFrame:
    """Labelled strings: value, random, and `held` for the third that the threshold is set on and the models do not see.

    Ordinary are the words of the drawn texts, once the base rules' matches are taken out, the identifiers that are made of
    them (camelCase, snake_case, kebab-case, paths, constants), and `names` (value), known identifiers as hosts and paths. Random are the
    values of the base rules' matches, and digests of the doc_ids in the alphabets of hexadecimal, base 64, and capitals or small letters
    with digits.
    """
    drawn = drawn_texts(docs, rows)
    bare = F.col("text")
    for _, pattern, _, _ in BASE[:2]:
        bare = F.regexp_replace(bare, pattern, " ")
    bare = F.regexp_replace(bare, "[0-9a-f]{16,}", " ")
    words = drawn.select(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]{2,}"), F.lit(0)).alias("words"))
    plain = drawn.select(F.explode(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("value"))
    ordinary = plain.unionByName(_identifiers(words))
    if names is not None:
        ordinary = ordinary.unionByName(names.select("value"))
    made = []
    for salt in range(4):
        digest = F.sha2(F.concat_ws(":", F.lit(str(salt)), F.col("doc_id").cast("string")), 256)
        coded = F.base64(F.unhex(digest))
        letters = F.regexp_replace(coded, "[^A-Za-z0-9]", "")
        made += [digest, coded, F.upper(letters), F.lower(letters), letters]
    seen = with_base(drawn).select(F.explode(F.concat(*[F.transform(kind, lambda m: m["value"]) for kind, _, _, _ in BASE])).alias("value"))
    random = drawn.select(F.explode(F.array(*made)).alias("value")).unionByName(seen)
    both = ordinary.withColumn("random", F.lit(False)).unionByName(random.withColumn("random", F.lit(True)))
    held = F.pmod(F.xxhash64(F.lower("value")), F.lit(3)) == 0
    return stored(both.filter(F.col("value").isNotNull()).withColumn("held", held), "labelled")


def learned(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio, random over ordinary, of each step from letter to letter.

    Steps are counted in one aggregate; both models are first-order chains over LETTERS (see `_chances`). The driver gets at most 2 x 67 x 67 counts. Null values, and letters outside, are left out. Without samples
    every ratio is 0, and nothing is a secret.
    """
    steps = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.col("value").substr(i, F.lit(2)))
    if "held" in labelled.columns:
        labelled = labelled.filter(~F.col("held"))
    counts = labelled.filter(F.length("value") > 1).select("random", F.explode(steps).alias("step")).groupBy("random", "step").count().collect()
    n, place = len(LETTERS), {ch: k for k, ch in enumerate(LETTERS)}
    tables = {True: [[0.0] * n for _ in range(n)], False: [[0.0] * n for _ in range(n)]}
    for random, step, count in counts:
        if len(step) == 2 and step[0] in place and step[1] in place:
            tables[random][place[step[0]]][place[step[1]]] += count
    if not any(map(sum, tables[True])) or not any(map(sum, tables[False])):
        return [0.0] * (n * n)
    chances = {random: _chances(table) for random, table in tables.items()}
    return [math.log(chances[True][a][b]) - math.log(chances[False][a][b]) for a in range(n) for b in range(n)]


def _chances(counts: list[list[float]]) -> list[list[float]]:
    """The chance of each step: half from its own counts, half from those of its letters' classes.

    Classes are capitals, small letters, digits and signs: the chance that one class follows another, times the letter's share of its
    class. A step that the samples lack is thus as likely as its classes make it, so words of another vocabulary are not taken for random.
    """
    n = len(counts)
    classes = [0 if ch.isupper() else 1 if ch.islower() else 2 if ch.isdigit() else 3 for ch in LETTERS]
    letter = [1.0 + sum(counts[a][b] for a in range(n)) for b in range(n)]
    size = [sum(letter[b] for b in range(n) if classes[b] == k) for k in range(4)]
    follow = [[1.0 + sum(counts[a][b] for a in range(n) for b in range(n) if (classes[a], classes[b]) == (i, j)) for j in range(4)] for i in range(4)]
    out = []
    for a in range(n):
        total = sum(counts[a])
        after = follow[classes[a]]
        broad = [after[classes[b]] / sum(after) * letter[b] / size[classes[b]] for b in range(n)]
        out.append([0.5 * counts[a][b] / total + 0.5 * broad[b] if total else broad[b] for b in range(n)])
    return out


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the value's steps. The model is a constant array, read by place."""
    n = len(LETTERS)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    places = ["0"] * 128
    for k, ch in enumerate(LETTERS):
        places[ord(ch)] = str(k)
    code = F.split(F.lit(",".join(places)), ",").cast("array<int>")

    def step(done: Column, letter: Column) -> Column:
        now = F.get(code, F.ascii(letter))
        gain = F.when(done["last"] < 0, F.lit(0.0)).otherwise(F.get(table, done["last"] * n + now))
        return F.struct(now.alias("last"), (done["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step)["sum"] / (F.length(value) - 1)


def calibrated(labelled: DataFrame, model: list[float], most: float = MOST_WRONG) -> tuple[float, float, float]:
    """The threshold that `most` of the held-out ordinary strings reach, the share that did, and the share of random ones found.

    Only strings that the scan would judge, of 16 letters of LETTERS and more, different ones once each. Without any the threshold is THRESHOLD.
    """
    judged = labelled.filter(F.col("held") & F.col("value").rlike(f"^{CANDIDATE}$")).select("value", "random").distinct()
    rated = judged.withColumn("ratio", ratio(F.col("value"), model))
    cut = rated.filter(~F.col("random")).agg(F.percentile("ratio", 1 - most)).first()[0]
    cut = THRESHOLD if cut is None else max(0.0, math.nextafter(cut, math.inf))
    over = F.avg((F.col("ratio") >= cut).cast("double"))
    shares = {r["random"]: r["share"] for r in rated.groupBy("random").agg(over.alias("share")).collect()}
    return cut, shares.get(False, 0.0), shares.get(True, 0.0)


def scanned(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Every secret of every whole text, by column expressions alone.

    The base rules give the kinds assign, access and hex. The models add the kind markov: strings of 16 and more
    letters of LETTERS that overlap no base span and are likelier random than ordinary by
    `threshold` per step.

    One row per input row: doc_id, found: array of (start, kind, end), kind as its place in KINDS, sorted by
    start and kind; positions are code points, the end exclusive. A null text is empty and has no
    span. Repeated rows are scanned each. An empty table gives no rows. Other columns are not read.
    """
    rows = with_base(docs.select("doc_id", text_or_empty().alias("text")))
    base = F.concat(*[F.col(kind) for kind, _, _, _ in BASE])
    rows = _kept(rows.select("*", base.alias("base"), hits_of(F.col("text"), CANDIDATE).alias("strings")))
    some = F.exists("strings", lambda v: ratio(v, model) >= threshold)
    spans = placed(F.split("text", CANDIDATE, -1), F.col("strings"), F.col("strings"))
    rows = _kept(rows.select("*", F.when(some, spans).otherwise(F.array().cast(SPANS)).alias("judged")))
    likely = F.filter(
        "judged",
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & (ratio(m["value"], model) >= threshold),
    )
    rows = _kept(rows.select("doc_id", *[kind for kind, _, _, _ in BASE], likely.alias("markov")))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    spans = [named(kind) for kind in KINDS]
    return _kept(rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("found")))


def written(found: Column) -> Column:
    """The spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])), ",")
