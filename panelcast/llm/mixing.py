"""Mixing sources to target weights through a domain, language, source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.llm.common import numbered, text_or_empty, word_count

LEVELS = ["domain", "language", "source"]
#: Share of the corpus' tokens to select, how often a document may be used, and the seed of the epochs' orders.
SHARE, EPOCHS, SEED = 1.0, 4, 42


def weights_of(column: Column, table: dict[str, float], other: float = 1.0) -> Column:
    """The weight of a node by its name; names that the table lacks, and null, have the weight `other`."""
    out = F.lit(float(other))
    for name, weight in sorted(table.items()):
        out = F.when(column == name, F.lit(float(weight))).otherwise(out)
    return out


def _filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares the `budget` of each parent among its children by `weight`, none above its `supply`.

    Water filling in closed form: children are ordered by supply over weight. A child whose supply
    is below its share of what is left takes all of it, and its shortage stays with its siblings; the
    first child that has enough fixes the level for all after it. Whole tokens: shares
    are rounded down, and the tokens left over go one by one to the first children that
    have more.
    """
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf")))
    ranked = nodes.withColumn("_ratio", ratio)
    by = Window.partitionBy(*parent).orderBy("_ratio", name)
    ahead = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("supply").over(ahead), F.lit(0))
    weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", F.when(weight > 0, left / weight))
    short = F.col("supply") <= F.col("_level") * F.col("weight")
    ranked = ranked.withColumn("_short", F.coalesce(short, F.lit(False)))
    level = F.min(F.when(~F.col("_short"), F.struct("_ratio", name, "_level"))).over(whole)["_level"]
    share = F.when(F.col("_short"), F.col("supply")).otherwise(F.floor(F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    ranked = ranked.withColumn("_share", F.least(share, F.col("supply")).cast("long"))
    rest = F.least(F.col("budget"), F.sum("supply").over(whole)) - F.sum("_share").over(whole)
    ranked = ranked.withColumn("_rest", rest).withColumn("_more", (F.col("supply") > F.col("_share")) & (F.col("weight") > 0))
    turn = F.row_number().over(Window.partitionBy(*parent, "_more").orderBy("_ratio", name))
    extra = F.when(F.col("_more") & (turn <= F.col("_rest")), 1).otherwise(0)
    return ranked.withColumn("_share", F.col("_share") + extra)


def budgets(leaves: DataFrame, total: Column, epochs: int = EPOCHS) -> DataFrame:
    """The tokens to take from each leaf, from its `tokens` and the weights of its nodes.

    leaves: domain, language, source, domain_weight, language_weight, source_weight, tokens.
    The total goes down the tree level by level. A node's supply is what all its leaves could give in
    `epochs` epochs, so a shortage of a leaf stays with the leaves beside it as long as
    they have tokens, and goes up to the language's siblings, then the domain's, only when the whole
    subtree is short.
    """
    spread = leaves.withColumn("supply", F.col("tokens") * epochs)
    everything = Window.partitionBy(F.lit(0))
    above = spread.withColumn("budget", F.least(F.lit(total), F.sum("supply").over(everything)).cast("long"))
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = above.groupBy(*path).agg(
            F.max("budget").alias("budget"), F.sum("supply").alias("supply"), F.max(f"{level}_weight").alias("weight")
        )
        got = _filled(nodes, path[:-1] or [F.lit(0)], level).select(*[F.col(p).alias(f"_{p}") for p in path], "_share")
        condition = F.lit(True)
        for p in path:
            condition = condition & F.col(p).eqNullSafe(F.col(f"_{p}"))
        above = above.join(got, condition).withColumn("budget", F.col("_share")).drop("_share", *[f"_{p}" for p in path])
    return above.select(*LEVELS, "tokens", "budget")


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    order: str | None = None,
    domain: Column | None = None,
    language: Column | None = None,
    source: Column | None = None,
    weights: dict[str, dict[str, float]] | None = None,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Selects from each leaf of the tree the tokens that its weights call for.

    An epoch is all documents of a leaf in an order seeded by (seed, epoch, the order column: by default the key). The leaf's
    selection is the prefix of its epochs, one after the other, that holds its budget of tokens:
    whole epochs first, then the documents of one more epoch up to a last one that may be cut
    inside. The running sum of that epoch is taken over blocks of rows, so a leaf with a
    third of the corpus is spread over many tasks.

    One row per document and epoch that is used: the key, domain, language, source, epoch (from 0),
    n_tokens, taken (tokens from the document's start). A null text has no tokens; a
    document without tokens is selected in whole epochs only, with taken 0. Null names of a level
    are one node of its own. Documents with equal values of the order column are ordered among each other by their size. An empty
    table gives no rows. Other columns are not read.
    """
    weights = weights or {}
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(order or key).alias("_seed"),
        (F.lit("all") if domain is None else domain).alias("domain"),
        (F.col("lang") if language is None else language).alias("language"),
        (F.col("source") if source is None else source).alias("source"),
        word_count(text_or_empty()).alias("n_tokens"),
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    for level in LEVELS:
        leaves = leaves.withColumn(f"{level}_weight", weights_of(F.col(level), weights.get(level, {})))
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)))
    plan = budgets(leaves.withColumn("_total", total), F.col("_total"), epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.select(
        *[F.col(level).alias(f"_{level}") for level in LEVELS],
        full.alias("_full"),
        (F.col("budget") - full * F.col("tokens")).alias("_part"),
    )
    condition = F.lit(True)
    for level in LEVELS:
        condition = condition & F.col(level).eqNullSafe(F.col(f"_{level}"))
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("_seed").cast("string"), F.lit(""))))
    known = rows.join(plan, condition).drop(*[f"_{level}" for level in LEVELS]).withColumn("_order", seeded)
    run = numbered(known, LEVELS, ["_order", "_seed", "n_tokens"], "n_tokens")
    cut = F.greatest(F.least(F.col("_part") - F.col("_before"), F.col("n_tokens")), F.lit(0))
    used = F.when(cut > 0, F.col("_full")).otherwise(F.col("_full") - 1)
    return (
        run.withColumn("_cut", cut)
        .withColumn("_last", used)
        .filter("_last >= 0")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("epoch"))
        .select(
            F.col("_key").alias(key),
            *LEVELS,
            "epoch",
            "n_tokens",
            F.when(F.col("epoch") < F.col("_full"), F.col("n_tokens")).otherwise(F.col("_cut")).alias("taken"),
        )
    )


def cut_to(text: Column, tokens: Column) -> Column:
    """The text up to the end of its n-th word, blanks ahead of the words kept."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), tokens.cast("int")), "")
