"""The corpus pipeline: documents in, packed sequences out, one stored table after each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import language, lines, mixing, near, packing
from panelcast.llm.common import sieved, stored
from panelcast.llm.queries import WEIGHTS, documents, domain_of

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(docs: DataFrame):
    return F.struct(*[docs[c] for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language. Documents of no language go: null texts, and texts without a letter.

    Rows without such a text are all kept, repeated ones too; an empty table stays empty.
    """
    learned = language.samples(docs, ~language.held_out())
    named = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("input"), "text")
    found = language.identified(named, learned, carry=["input", "text"]).filter(F.col("lang_pred") != language.UNKNOWN)
    new = {"lang": F.col("lang_pred"), "text": F.col("text")}
    return found.select(*[new.get(c, F.col("input")[c]).alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines. A document of which nothing but blanks is left goes.

    n_chars follows the text. A document that was null or blank before is kept as it is.
    """
    cut = lines.without_copies(docs)
    left = cut.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("input")["n_chars"])}
    return left.select(*[new.get(c, F.col("input")[c]).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id, of those the smallest SHA-256 of its text.

    Groups are of rows, whatever their doc_ids: rows with the same doc_id, or none, and texts that are not alike all stay. Of equal
    rows with words one stays. A null doc_id comes after all others. A document without words is in no group and stays.
    """
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), _row(docs).alias("input")), "near")
    grouped = near.near_groups(keyed.select("row", F.col("input.text").alias("text")), key="row").select("row", F.col("component_id").alias("group"))
    groups = stored(grouped, "groups")
    many = groups.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    members = groups.join(many, "group")
    order = keyed.select("row", F.struct(F.col("input.doc_id").isNull().alias("none"), F.col("input.doc_id").alias("id"), F.sha2("input.text", 256).alias("text"), "row").alias("place"))
    placed = stored(members.join(order, "row"), "places")
    first = placed.groupBy("group").agg(F.min("place").alias("first"))
    gone = stored(placed.join(first, "group").filter(F.col("row") != F.col("first.row")).select("row"), "gone")
    some, sure = sieved(keyed, "row", gone)
    kept = some.join(gone, "row", "left_anti").select("input").unionByName(sure.select("input"))
    return kept.select(*[F.col("input")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, once for each epoch; the last of a leaf may be cut at a word's end.

    The order of an epoch follows from doc_id, so the same documents are selected however the table is laid out.
    """
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), _row(docs).alias("input")), "mix")
    fields = keyed.select("row", *[F.col("input")[c].alias(c) for c in ("doc_id", "text", "lang", "source")])
    chosen = mixing.mixed(fields, key="row", order="doc_id", domain=domain_of(F.col("source")), weights=WEIGHTS).select("row", "n_tokens", "taken")
    joined = keyed.join(chosen, "row")
    whole = F.col("taken") >= F.col("n_tokens")
    text = F.when(whole, F.col("input")["text"]).otherwise(mixing.cut_to(F.col("input")["text"], F.col("taken")))
    new = {"text": text, "n_chars": F.when(whole, F.col("input")["n_chars"]).otherwise(F.length(text).cast("long"))}
    return joined.select(*[new.get(c, F.col("input")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in a sequence of a batch."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language identification and the seeded mix have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
