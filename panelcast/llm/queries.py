"""The registered query of each operator, and the pipeline's, on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import chat, exact, language, lines, mixing, near, packing, periods, phrases, quality, secrets, sharding, vectors
from panelcast.llm.common import smallest_hashes

#: Domains of the mix by the number in the source's name, and the weights of its nodes.
WEIGHTS = {
    "domain": {"web": 5.0, "books": 3.0, "forum": 2.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {},
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    place = F.pmod(F.when(number != "", number.cast("decimal(38,0)")).otherwise(0), F.lit(3))
    return F.when(place == 0, "web").when(place == 1, "books").when(place == 2, "forum").otherwise("web")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), domain=domain_of(F.col("source")), weights=WEIGHTS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = language.samples(docs, ~language.held_out())
    return language.identified(docs, learned).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(documents(spark, sf_dir), quality.trusted_labels(labels)).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", "score", "threshold"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_copies(documents(spark, sf_dir)).drop("input")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{tricky}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat.read_back(chat.formatted(turns.unionByName(extra)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # hosts, paths and names in the addresses of crawled pages are ordinary identifiers
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    drawn = smallest_hashes(pages, "page_id", secrets.SAMPLE)
    addresses = pages.select("page_id", "url").join(F.broadcast(drawn), "page_id")  # bounded: SAMPLE ids
    names = addresses.select(F.explode(F.regexp_extract_all("url", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("value"))
    labelled = secrets.samples(docs, names)
    model = secrets.learned(labelled)
    found = secrets.scanned(docs, model, secrets.calibrated(labelled, model)[0])
    base = F.filter("found", lambda m: m["kind"] < 3)

    def many(kind: str) -> Column:
        return F.size(F.filter("found", lambda m: m["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [many(kind) for kind, _, _, _ in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periods.periodic_runs(docs.select("doc_id", periods.planted(F.col("doc_id")).alias("text")))
    by_length = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    top = found.withColumn("top", by_length)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.n div -top.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat": op8_chat,
    "op9_near_dedup": op9_near_dedup,
    "op10_secrets": op10_secrets,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
