"""Evaluation over labelled messages: confusion, sweeps, cutoffs, rates, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Over how many salts the rows of one key are dealt.
SALTS = 16


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """``tp fp tn fn`` and the rates from them, 0 where a rate has no rows; one partial aggregation."""
    n = lambda x: F.count_if(x).alias
    counts = df.groupBy(*by).agg(n(predicted & actual)("tp"), n(predicted & ~actual)("fp"), n(~predicted & ~actual)("tn"), n(~predicted & actual)("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rated = counts.withColumn("accuracy", _share(tp + tn, tp + fp + tn + fn)).withColumn("precision", _share(tp, tp + fp)).withColumn("recall", _share(tp, tp + fn))
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))).withColumn("fpr", _share(fp, fp + tn))


def sweep(df: DataFrame, values: list[float], name: str, predicted, actual: Column) -> DataFrame:
    """``confusion`` for each value of a threshold, from one scan: ``predicted(value)`` is a column.

    Each row takes part once per value; the values are few and stated.
    """
    spread = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return confusion(spread, predicted(F.col(name)), actual, name)


def best_threshold(swept: DataFrame, name: str, fpr_limit: float | None = None) -> DataFrame:
    """The value with the best f1, or the best recall within the limit of false positives; the lowest on ties."""
    if fpr_limit is None:
        return swept.orderBy(F.desc("f1"), name).limit(1)
    within = F.col("fpr") <= fpr_limit
    return swept.orderBy(F.desc(within), F.desc("recall"), name).limit(1)


def precision_above(scores: DataFrame, score: str = "score", actual: str = "is_positive") -> DataFrame:
    """``(score, precision, support)`` at or above each observed score.

    Scores are first counted (a score has three decimals, so their number is bounded
    whatever the rows), then accumulated in one ordered pass over the counts.
    """
    by = scores.groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(actual)).alias("p"))
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return by.select(score, (F.sum("p").over(w) / F.sum("n").over(w)).alias("precision"), F.sum("n").over(w).alias("support"))


def cutoffs(above: DataFrame, targets: tuple[float, ...] = (0.5, 0.75, 0.9), support: int = 20, score: str = "score") -> DataFrame:
    """``(target, cutoff)``: the lowest observed score that reaches the precision with the support; null if none does."""
    rows = above.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    ok = (F.col("precision") >= F.col("target")) & (F.col("support") >= support)
    return rows.groupBy("target").agg(F.min(F.when(ok, F.col(score))).alias("cutoff"))


def counts_by_label(df: DataFrame, what: str, actual: str = "is_positive") -> DataFrame:
    """``(what, positives, negatives, positive_share, negative_share)``; shares of all rows of a label, in percent."""
    by = df.groupBy(what).agg(F.count_if(F.col(actual)).alias("positives"), F.count_if(~F.col(actual)).alias("negatives"))
    whole = Window.partitionBy(F.lit(1))  # over the few values of ``what``
    share = lambda x: F.round(100 * _share(F.col(x), F.sum(x).over(whole)), 2)
    return by.select(what, "positives", "negatives", share("positives").alias("positive_share"), share("negatives").alias("negative_share"))


def top_combinations(df: DataFrame, n: int = 15, actual: str = "is_positive") -> DataFrame:
    """The most frequent sets of evidence in tiers 2 and 3 each: ``(action_tier, combo, total, positives)``, ties by name."""
    by = df.where(F.col("action_tier") >= 2).groupBy("action_tier", F.array_join("evidence_groups", " + ").alias("combo")).agg(F.count("*").alias("total"), F.count_if(F.col(actual)).alias("positives"))
    w = Window.partitionBy("action_tier").orderBy(F.desc("total"), "combo")
    return by.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def leak_free_split(df: DataFrame, key: Column, actual: Column, fraction: float = 0.2, seed: str = "42", id_col: str = "row_id") -> DataFrame:
    """``(id, is_validation)``: rows of one key stay together, per stratum of the keys' majority label.

    Keys are ordered by a hash with the seed and taken while the rows before are fewer
    than the fraction.  The running count is made in two steps (by hash range, then over
    the ranges), so no task orders all keys.  Rows are joined to their key over salts, since
    all null and blank texts share one.
    """
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt")
    rows = df.select(F.col(id_col).alias("id"), F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(seed))).alias("k"), F.coalesce(actual, F.lit(False)).alias("y"), salt)
    keys = rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if("y").alias("p"), F.collect_set("salt").alias("salts")).withColumn("stratum", F.col("p") * 2 >= F.col("n")).withColumn("range", F.substring("k", 1, 3))
    per = keys.groupBy("stratum", "range").agg(F.sum("n").alias("m"))  # two strata, 4096 ranges
    w = Window.partitionBy("stratum").orderBy("range")
    per = per.withColumn("before", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy("stratum")))
    inner = Window.partitionBy("stratum", "range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.join(F.broadcast(per.drop("m")), ["stratum", "range"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    # a key stands once for each salt that its rows have, SALTS at most
    taken = placed.select("k", F.explode("salts").alias("salt"), (F.col("at") < F.round(F.col("total") * fraction)).alias("is_validation"))
    return rows.join(taken, ["k", "salt"]).select(F.col("id").alias(id_col), "is_validation")


def three_way_split(df: DataFrame, actual: Column, parts: tuple[float, float] = (0.6, 0.2), seed: str = "42", id_col: str = "row_id") -> DataFrame:
    """``(id, is_positive, part)`` with train, validation and test per label, cut at whole rows by hash order."""
    rows = df.select(F.col(id_col), actual.alias("is_positive"), F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed))).alias("h"))
    rows = rows.withColumn("range", F.substring("h", 1, 3))
    per = rows.groupBy("is_positive", "range").agg(F.count("*").alias("m"))
    w = Window.partitionBy("is_positive").orderBy("range")
    per = per.withColumn("before", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy("is_positive"))).drop("m")
    inner = Window.partitionBy("is_positive", "range").orderBy("h", id_col)
    at = rows.join(F.broadcast(per), ["is_positive", "range"]).withColumn("at", F.col("before") + F.row_number().over(inner))
    first, second = F.floor(F.col("total") * parts[0]), F.floor(F.col("total") * parts[1])
    return at.select(id_col, "is_positive", F.when(F.col("at") <= first, "train").when(F.col("at") <= first + second, "validation").otherwise("test").alias("part"))


def fixed_sample(df: DataFrame, n: int, seed: str = "42", id_col: str = "row_id") -> DataFrame:
    """``n`` rows by the order of a hash of their id: the same rows for the same seed (a top-k, never a full sort)."""
    return df.withColumn("_h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))).orderBy("_h", id_col).limit(n).drop("_h")
