"""Metrics over runs: speed, consistency, length, cost, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .quantiles import exact_quantiles

# Sequence lengths that close a length class.
LENGTH_EDGES = [1024, 2048, 4096, 8192]


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def latency(
    df: DataFrame, start: str, end: str, by: Sequence[str], qs: Sequence[float] = (0.5, 0.95)
) -> DataFrame:
    """Runs, mean and exact quantiles of ``end - start`` in seconds, per ``by``."""
    timed = df.select(*by, (_seconds(F.col(end)) - _seconds(F.col(start))).alias("_s"))
    stats = timed.groupBy(*by).agg(
        F.count("_s").alias("n_runs"),
        F.avg("_s").alias("mean_s"),
        F.min("_s").alias("min_s"),
        F.max("_s").alias("max_s"),
    )
    spots = exact_quantiles(timed, by, "_s", qs)
    wide = spots.groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(f"p{round(q * 100)}_s") for q in qs]
    )
    # A group may be NULL.
    names = {c: f"_of_{c}" for c in by}
    wide = wide.withColumnsRenamed(names)
    same = F.lit(True)
    for c, other in names.items():
        same = same & F.col(c).eqNullSafe(F.col(other))
    return stats.join(wide, same, "left").drop(*names.values())


def throughput(df: DataFrame, ts: str, by: Sequence[str]) -> DataFrame:
    """Items, elapsed seconds and items per second; NULL when no time passed."""
    at = _seconds(F.col(ts))
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_items"), (F.max(at) - F.min(at)).alias("elapsed_s"))
        .withColumn("items_per_s", F.when(F.col("elapsed_s") > 0, F.col("n_items") / F.col("elapsed_s")))
    )


def length_class(length: Column, edges: Sequence[int] = LENGTH_EDGES) -> Column:
    """Smallest edge that holds the length; NULL above the last one."""
    out = None
    for edge in edges:
        out = F.when(length <= edge, F.lit(edge)) if out is None else out.when(length <= edge, F.lit(edge))
    return out


def by_length_bucket(
    df: DataFrame, length: str, value: str, edges: Sequence[int] = LENGTH_EDGES
) -> DataFrame:
    return df.groupBy(length_class(F.col(length), edges).alias("seq_len")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"mean_{value}")
    )


def consistency(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Share of runs equal to the first run of their key, in percent.

    ``score`` divides by all runs, ``score_of_rest`` by the runs after the first.
    Equal values are counted first; the value seen earliest is the first run's.
    """
    counts = df.groupBy(*key, value).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    same = F.min_by("_n", "_first") - 1
    return (
        counts.groupBy(*key)
        .agg(F.sum("_n").alias("n_runs"), same.alias("n_same"))
        .withColumn("score", F.col("n_same") / F.col("n_runs") * 100.0)
        .withColumn(
            "score_of_rest",
            F.when(F.col("n_runs") > 1, F.col("n_same") / (F.col("n_runs") - 1) * 100.0),
        )
    )


def attention_flops(length: Column, d_model: int = 1024, heads: int = 8) -> Column:
    """``4 L^2 (d div h) h`` as a double."""
    length = length.cast("double")
    return F.lit(4.0) * length * length * F.lit(float(d_model // heads * heads))


def attention_tflops(length: Column, seconds: Column, d_model: int = 1024, heads: int = 8) -> Column:
    return F.when(seconds > 0, attention_flops(length, d_model, heads) / seconds / 1e12)


def cost_report(
    rows: DataFrame, by: Sequence[str], length: str, d_model: int = 1024, heads: int = 8
) -> DataFrame:
    """Sequences, ids and attention cost per group of sequences."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum(F.col(length).cast("bigint")).alias("n_ids"),
        F.sum(attention_flops(F.col(length), d_model, heads)).alias("flops"),
    )


def loss_summary(
    log: DataFrame, every: int = 100, step: str = "step", loss: str = "loss", by: Sequence[str] = ()
) -> DataFrame:
    """Per ``every`` steps: the loss logged first, the mean, and the last loss."""
    return log.groupBy(*by, F.expr(f"{step} div {int(every)}").alias("window_no")).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max(F.when(F.col(step) % every == 0, F.col(loss))).alias("logged_loss"),
        F.avg(loss).alias("mean_loss"),
        F.max_by(loss, step).alias("last_loss"),
    )
