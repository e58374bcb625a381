"""Feedback-driven ranking: popularity, features, scorers, trials, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First weights and bias of the linear scorer, by feature.
FEATURES = ("bm25", "vector", "recency", "overlap", "same_project", "from_vectors", "popularity")
WEIGHTS = (0.40, 0.40, 0.20, 0.80, 0.60, 0.10, 0.30)
BIAS = -0.5
E_FOLD_DAYS = 14
WINDOW_DAYS = 30


def seconds_before(ts: Column, as_of: str) -> Column:
    return F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)


def popularity(feedback: DataFrame, as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """(turn_id, popularity): weights of the last days, decaying by a factor of e in two weeks."""
    age = seconds_before(F.col("ts"), as_of)
    recent = feedback.filter((F.col("ts") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")) & (age >= 0))
    return recent.groupBy("turn_id").agg(F.sum(F.col("weight") * F.exp(-age / F.lit(E_FOLD_DAYS * 86400.0))).alias("popularity"))


def boost(score: Column, popularity_: Column) -> Column:
    p = F.coalesce(popularity_, F.lit(0.0))
    return score * (1 + F.when(p > 0, F.log1p(p)).otherwise(0.0))


def overlap(query_words: Column, text_words: Column) -> Column:
    q = F.array_distinct(query_words)
    return F.size(F.array_intersect(q, text_words)) / F.greatest(F.size(q), F.lit(1))


def recency(ts: Column, as_of: str) -> Column:
    """0 for now, falling with the logarithm of the age in days; 0 where there is no time."""
    return F.coalesce(-F.log1p(F.greatest(seconds_before(ts, as_of) / 86400.0, F.lit(0.0))), F.lit(0.0))


def linear_score(features: Sequence[Column], weights: Sequence[float] = WEIGHTS, bias: float = BIAS) -> Column:
    z = F.lit(bias)
    for f, w in zip(features, weights, strict=True):
        z = z + f * w
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(-z))


def fit_linear(rows: DataFrame, features: Sequence[str], label: str = "label", l2: float = 0.001, epochs: int = 200) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=l2, maxIter=epochs, standardization=False).fit(data)
    return [float(w) for w in model.coefficients], float(model.intercept)


def topic_reweight(score: Column, hit_topic: Column, query_topic: Column) -> Column:
    """Less for hits on the query's own topic, more for others; hits without a topic stay."""
    known = F.coalesce(hit_topic, F.lit("")) != ""
    return F.when(known & (query_topic != ""), score * F.when(hit_topic == query_topic, 0.7).otherwise(1.3)).otherwise(score)


def trials(hits: DataFrame, champion: Column, challenger: Column, by: Sequence[str] = ()) -> DataFrame:
    """Ranks of each hit under two scores, from 0."""
    ranks = {n: F.row_number().over(Window.partitionBy(*by).orderBy(c.desc(), F.asc("id"))) - 1 for n, c in (("champion_rank", champion), ("challenger_rank", challenger))}
    return hits.withColumns(ranks)


def arbiter(decided: DataFrame, window: int, promote_n: int = 1000, promote: float = 0.60, demote_n: int = 500, demote: float = 0.50) -> DataFrame:
    """One row over the newest ``window`` trials (champion_rank, challenger_rank, ts, id): wins, losses,
    ties, win_rate and decision. Ties count in neither direction."""
    last = decided.orderBy(F.desc("ts"), F.desc("id")).limit(window)
    better = F.col("challenger_rank") < F.col("champion_rank")
    worse = F.col("challenger_rank") > F.col("champion_rank")
    sums = last.agg(F.count_if(better).alias("wins"), F.count_if(worse).alias("losses"), F.count_if(~better & ~worse).alias("ties"))
    n = F.col("wins") + F.col("losses")
    rate = F.when(n > 0, F.col("wins") / n).otherwise(0.0)
    decision = F.when((n >= promote_n) & (rate >= promote), "promote").when((n >= demote_n) & (rate < demote), "demote").otherwise("hold")
    return sums.select("wins", "losses", "ties", rate.alias("win_rate"), decision.alias("decision"))


def threshold_sweep(outcomes: DataFrame, thresholds: Sequence[float], least: int = 25) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) for each threshold, from ``outcomes`` (sim, outcome).

    ``accepted`` at or above a threshold is a true positive, ``rejected`` a false one; ``corrected`` below
    it is missed. No rows with fewer than ``least`` outcomes. One pass: the thresholds are columns.
    """
    sums = [F.count("*").alias("n")]
    for i, t in enumerate(thresholds):
        over = F.col("sim") >= t
        sums += [
            F.count_if(over & (F.col("outcome") == "accepted")).alias(f"tp{i}"),
            F.count_if(over & (F.col("outcome") == "rejected")).alias(f"fp{i}"),
            F.count_if(~over & (F.col("outcome") == "corrected")).alias(f"fn{i}"),
        ]
    rows = [F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn")]) for i, t in enumerate(thresholds)]
    flat = outcomes.agg(*sums).filter(F.col("n") >= least).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = flat.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def retrieval_metrics(ranked: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Recall at 1 and 5 and mean reciprocal rank of ``ranked`` (query_id, rank from 1, relevant)."""
    first = ranked.groupBy(*by).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    hit = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0))
    return first.agg(hit(1).alias("recall_at_1"), hit(5).alias("recall_at_5"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p of McNemar's test on discordant counts."""
    from math import comb

    n = b + c
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def bootstrap_mean(rows: DataFrame, value: str, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(low, high): the 95 % interval of a mean, by Poisson weights: one pass, no resample is stored."""
    numbers = F.sequence(F.lit(0), F.lit(resamples - 1))
    u = F.abs(F.xxhash64(F.lit(seed), F.col("_row"), F.col("s")) % 1_000_000) / 1_000_000.0
    weight = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).otherwise(4)
    spread = rows.select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("_row")).select("v", "_row", F.explode(numbers).alias("s"))
    means = spread.groupBy("s").agg((F.sum(F.col("v") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
