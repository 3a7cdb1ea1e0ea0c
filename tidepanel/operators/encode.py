"""Categorical encodings whose vocabulary and statistics come from training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.operators.identifiers import dense_ids

UNSEEN = -1
LABEL_DELAY_DAYS = 14


def fit_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): ordinal codes of the values observed in training, in sort order from 0."""
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    values = train.select(melted.alias("m")).select("m.*").filter(F.col("value").isNotNull()).distinct()
    numbered = dense_ids(values, ["column", "value"], "_id", start=0)
    first = numbered.groupBy("column").agg(F.min("_id").alias("_first"))
    return numbered.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("_id") - F.col("_first")).cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_code``; values never seen in training become -1."""
    for c in columns:
        lookup = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        df = df.join(lookup, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(UNSEEN)))
    return df


def ordered_target_means(df: DataFrame, column: str, target: str, prior_weight: float = 1.0) -> DataFrame:
    """(column, week, <column>_encoded): mean of the category's earlier targets, blended with that of all rows.

    A row at week W may use targets that were complete by W, i.e. rows of weeks up to W - 14 days. Both running means
    run over one row per (category, week) and per week, not over the rows of a category.
    """
    value = F.col(target)
    cells = df.groupBy(column, "week").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))

    def known(w):
        return w.orderBy(F.datediff("week", F.lit("1970-01-01").cast("date"))).rangeBetween(
            Window.unboundedPreceding, -LABEL_DELAY_DAYS)

    own, everything = known(Window.partitionBy(column)), known(Window.partitionBy())
    per_category = cells.select(column, "week", F.coalesce(F.sum("_s").over(own), F.lit(0.0)).alias("_cs"),
                                F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_cn"))
    weeks = cells.groupBy("week").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    overall = weeks.select("week", ratio(F.sum("_s").over(everything), F.sum("_n").over(everything)).alias("_prior"))
    blended = (F.col("_cs") + prior_weight * F.col("_prior")) / (F.col("_cn") + prior_weight)
    return per_category.join(F.broadcast(overall), "week").select(column, "week", blended.alias(f"{column}_encoded"))


def ordered_target_encoding(df: DataFrame, column: str, target: str, prior_weight: float = 1.0) -> DataFrame:
    return df.join(ordered_target_means(df, column, target, prior_weight), [column, "week"], "left")


def lookup_embeddings(df: DataFrame, vectors: DataFrame, entity: str, dim: int) -> DataFrame:
    """Add ``<entity>_emb_i`` from a table (entity, vector); unknown entities get the mean vector."""
    cols = [f"{entity}_emb_{i}" for i in range(dim)]
    flat = vectors.select(F.col("entity").alias(entity), *[F.get("vector", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    mean = flat.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    joined = df.join(flat, entity, "left").withColumn("_mean", mean)
    return joined.withColumns({c: F.coalesce(c, F.col(f"_mean.{c}")) for c in cols}).drop("_mean")
