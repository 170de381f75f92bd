"""Repeated runs of lines, by a suffix array over line ids from distributed prefix doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType
from pyspark.sql.window import Window

from panelcast.llm.common import WORD, sieved, stored, text_or_empty, word_count
from panelcast.session import discard

#: Words that a repeated run of lines has at least.
LEAST_WORDS = 20


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that occur more than once, with numbers that rise in their order."""
    repeated = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return stored(repeated.sort(*key).withColumn("order", F.monotonically_increasing_id()), "ranks")


def _lines(keyed: DataFrame, least: int) -> DataFrame:
    """Every line: its id, and where the shortest run of `least` words that begins, or ends, with it has its other end.

    `stop` is the line after the run that begins here, `start` the first line of the run that ends here; null if
    the document has too few words on that side.
    """
    split = keyed.select("row", "doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "content"))
    counted = split.select(
        "row", "doc_id", "line", F.unhex(F.md5("content")).alias("id"), F.regexp_count("content", F.lit(WORD)).cast("long").alias("words")
    )
    by = Window.partitionBy("row").orderBy("line")
    summed = counted.withColumn("upto", F.sum("words").over(by)).withColumn("ahead", F.col("upto") - F.col("words"))
    stop = F.count("*").over(Window.partitionBy("row").orderBy("ahead").rangeBetween(Window.unboundedPreceding, least - 1))
    start = F.count("*").over(Window.partitionBy("row").orderBy("upto").rangeBetween(Window.unboundedPreceding, -least))
    total = F.sum("words").over(Window.partitionBy("row"))
    return summed.select(
        "row",
        "doc_id",
        "line",
        "id",
        F.when(total - F.col("ahead") >= least, stop).alias("stop"),
        F.when(F.col("upto") >= least, start).alias("start"),
    )


def repeated_runs(keyed: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The maximal runs of lines, row, start and stop (exclusive), that have `least` words and occurred earlier.

    keyed: row (unique), doc_id, text. Documents are in the order of doc_id, then row; lines follow
    each other in them. A run lies within one document.

    Prefix doubling: round k ranks the suffixes of all documents' line-id sequences by their first 2^k lines,
    from the pairs of ranks, at i and at i + 2^(k-1), of the round before. Sorted by rank, suffixes of the same rank are an interval
    of the suffix array whose longest common prefix is 2^k lines or more; a suffix that is
    alone in its interval, or ends, leaves the array, as it repeats nothing that long. An interval of prefix length n, between
    2^k and 2^(k+1), is the pair of ranks at i and at i + n - 2^k.

    A repeated run of `least` words is covered by the shortest such runs that begin, or end, with one of its lines. Their
    intervals are looked up in the round of their length; in each, all but the first occurrence are later
    copies. Merged where they touch or overlap, they are the maximal repeated runs. Rounds stop at the longest of the shortest runs.
    """
    lines = stored(_lines(keyed, least), "lines")
    ranks = _ranked(lines, ["id"])
    array = suffixes = stored(lines.join(ranks, "id").drop("id").withColumnRenamed("order", "rank"), "suffixes")
    discard(lines, ranks)
    units = stored(
        array.filter("stop is not null")
        .select("row", "doc_id", F.col("line").alias("first"), (F.col("stop") - F.col("line")).cast("long").alias("length"))
        .unionByName(
            array.filter("start is not null").select(
                "row", "doc_id", F.col("start").cast("int").alias("first"), (F.col("line") - F.col("start") + 1).cast("long").alias("length")
            )
        )
        .distinct(),
        "units",
    )
    longest = units.agg(F.max("length")).first()[0] or 0
    array = array.select("row", "line", "rank")
    found, width = [], 1
    while width <= longest:
        # the result of a round is small; stored, it leaves one round's plan to run at a time
        found.append(stored(_later(units.filter((F.col("length") >= width) & (F.col("length") < 2 * width)), array, width), "later"))
        if 2 * width > longest:
            break
        second = F.first("rank").over(Window.partitionBy("row").orderBy("line").rangeBetween(width, width))
        pairs = stored(array.select("row", "line", "rank", second.alias("second")).filter("second is not null"), "pairs")
        ranks = _ranked(pairs, ["rank", "second"])
        discard(suffixes)
        suffixes = stored(pairs.join(ranks, ["rank", "second"]).select("row", "line", F.col("order").alias("rank")), "suffixes")
        array = suffixes
        discard(pairs, ranks)
        width *= 2
    discard(suffixes, units)
    if not found:
        return keyed.select("row", F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    spans = reduce(DataFrame.unionByName, found)
    by = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _later(units: DataFrame, array: DataFrame, width: int) -> DataFrame:
    """Those of the runs, `width` to under 2 x `width` lines long, that are not the first of their interval."""
    head = array.select("row", F.col("line").alias("first"), F.col("rank").alias("head"))
    tail = array.select("row", F.col("line").alias("at"), F.col("rank").alias("tail"))
    placed = units.join(head, ["row", "first"]).withColumn("at", F.col("first") + F.col("length") - width).join(tail, ["row", "at"])
    place = F.struct("doc_id", "row", "first")
    placed = placed.select("length", "head", "tail", place.alias("place"))
    firsts = placed.groupBy("length", "head", "tail").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = placed.join(firsts, ["length", "head", "tail"]).filter(F.col("place") != F.col("earliest"))
    return later.select(F.col("place.row").alias("row"), F.col("place.first").alias("start"), (F.col("place.first") + F.col("length")).cast("int").alias("stop"))


def _name(docs: DataFrame) -> Column:
    """128 bits that name a row: of a SHA-256 over every column's null flag, length and text, so no two rows read alike.

    Nested columns are written as JSON with their nulls.
    """
    whole = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    parts = []
    for field in docs.schema.fields:
        nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
        value = F.to_json(F.struct(docs[field.name]), whole) if nested else docs[field.name].cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _distinct(docs: DataFrame) -> DataFrame:
    """Each different row once: row (its name), input (the columns) and copies.

    The name stays the same however often the documents are read, so no numbered copy of the texts is
    written. Only rows whose name may be repeated are shuffled.
    """
    named = docs.select(_name(docs).alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("input"))
    repeats = stored(named.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeats")
    if repeats.isEmpty():
        return named.withColumn("copies", F.lit(1).cast("long"))
    some, sure = sieved(named, "row", repeats)
    some = some.join(repeats, "row", "left")
    once = some.filter("copies is null").withColumn("copies", F.lit(1).cast("long"))
    many = some.filter("copies is not null").groupBy("row").agg(F.first("input").alias("input"), F.first("copies").alias("copies"))
    return sure.withColumn("copies", F.lit(1).cast("long")).unionByName(once).unionByName(many)


def without_copies(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Deletes every later copy of a run of lines that has `least` words or more.

    Lines end at \\n and are equal if all their characters are. The first copy, in the order of doc_id, stays whole.
    Deleted lines go with one line end each, so what is left are the other lines as they were.

    One row per input row with all its columns in `input` (a struct), and text (null stays null), n_lines, removed_lines,
    removed (runs as start-stop, exclusive, comma-joined). A null text has no lines, an empty text one without words. Of repeated
    rows all but one lose their runs. A null doc_id comes before all others. An empty table gives no rows. Other
    columns are handed on unread, whatever their names.
    """
    keyed = _distinct(docs)
    texts = keyed.select("row", F.col("input.doc_id").alias("doc_id"), F.col("input.text").alias("text"))
    runs = stored(repeated_runs(texts.filter("text is not null"), least), "runs")
    sorted_runs = F.array_sort(F.collect_list(F.struct("start", "stop")))
    per_doc = runs.groupBy("row").agg(sorted_runs.alias("runs"))
    touched, whole = sieved(keyed, "row", runs)
    hit = touched.join(per_doc, "row", "left")
    none = F.lit(None).cast(per_doc.schema["runs"].dataType)
    joined = hit.unionByName(whole.withColumn("runs", none)).withColumn("text", F.col("input.text"))
    lines = F.split("text", "\n")
    spare = F.transform(
        F.sequence(F.lit(0), F.size("runs")),
        lambda i: F.slice(
            F.col("lines"),
            F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["stop"]) + 1,
            F.when(i == F.size("runs"), F.size("lines")).otherwise(F.get("runs", i)["start"]) - F.when(i == 0, 0).otherwise(F.get("runs", i - 1)["stop"]),
        ),
    )
    with_lines = joined.withColumn("lines", lines)
    cut = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(spare), "\n"))
    gone = F.aggregate(F.col("runs"), F.lit(0), lambda n, r: n + r["stop"] - r["start"])
    done = with_lines.select(
        "input",
        F.col("input.doc_id").alias("doc_id"),
        cut.alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(gone, F.lit(0)).alias("removed_lines"),
        F.coalesce(F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"], r["stop"])), ","), F.lit("")).alias("removed"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    again = (F.col("copy") > 1) & F.coalesce(word_count(F.col("input.text")) >= least, F.lit(False))
    return done.select(
        "input",
        "doc_id",
        F.when(again, "").otherwise(F.col("text")).alias("text"),
        "n_lines",
        F.when(again, F.col("n_lines")).otherwise(F.col("removed_lines")).alias("removed_lines"),
        F.when(again, F.concat_ws("-", F.lit(0), "n_lines")).otherwise(F.col("removed")).alias("removed"),
    )
