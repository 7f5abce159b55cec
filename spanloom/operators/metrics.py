"""Scores of predictions: AUC, average precision, confusion suite, cluster bootstrap, folds, models."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def roc_auc(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, n, auc): rank-sum AUC, ties half; null where a class is missing.

    Rows are first counted by score, so the window runs over the distinct scores of a key.
    """
    cells = df.select(*by, F.col(score).alias("__s"), F.col(label).cast("double").alias("__y")).groupBy(*by, "__s").agg(
        F.sum("__y").alias("__p"), F.count("*").alias("__n"))
    rank = F.sum("__n").over(Window.partitionBy(*by).orderBy("__s")) - (F.col("__n") - 1) / 2
    pos, n = F.sum("__p"), F.sum("__n")
    return cells.withColumn("__r", rank).groupBy(*by).agg(n.alias("n"), ((F.sum(F.col("__p") * F.col("__r")) - pos * (pos + 1) / 2)
                                                                         / F.nullif(pos * (n - pos), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, ap): step sum of precision over recall, one step for each distinct score."""
    steps = df.groupBy(*by, score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    total = F.sum("pos").over(Window.partitionBy(*by))
    part = F.col("pos") / F.nullif(total, F.lit(0)) * F.sum("pos").over(w) / F.sum("n").over(w)
    return steps.select(*by, part.alias("part")).groupBy(*by).agg(F.sum("part").alias("ap"))


def confusion_suite(df: DataFrame, by: Sequence[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Sensitivity, specificity, balanced accuracy, precision, F1, MCC, Brier and log loss at a threshold."""
    y, p = F.col(label), F.col(score)
    hit = (p >= threshold).cast("int")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    cells = df.groupBy(*by).agg(
        F.sum(y * hit).alias("tp"), F.sum((1 - y) * hit).alias("fp"), F.sum(y * (1 - hit)).alias("fn"),
        F.sum((1 - y) * (1 - hit)).alias("tn"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))
    ratio = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = cells.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp),
                             "f1": ratio(2 * tp, 2 * tp + fp + fn),
                             "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


#: Distribution of a Poisson variable of mean 1, from which a cluster's weight in a replicate is drawn.
POISSON = [round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 12) for k in range(9)]


def drawn_rows(rows: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """`rows` once for each replicate that draws their cluster, with rep and weight: how often it is drawn there. Rows without a cluster are never drawn.

    Weights are Poisson variables of mean 1 whose chance is the digest of seed, replicate and key, so
    the same draws come again on any cluster and for both arms of a comparison, and no cluster has to be
    numbered, counted or joined to its draws: every row makes its own. (Spark takes an exploded table for as small as what it was exploded from, and
    would send a table of draws to every executor by way of the driver.)
    """
    @F.pandas_udf("array<tinyint>")
    def weights(keys: pd.Series) -> pd.Series:
        at, names = pd.factorize(keys)
        heads = (int.from_bytes(hashlib.md5(f"{seed}-{rep}-{name}".encode()).digest()[:6], "big") for name in names for rep in range(replicates))
        chances = np.fromiter(heads, np.int64, len(names) * replicates).reshape(len(names), replicates) / float(1 << 48)
        return pd.Series(list(np.searchsorted(POISSON, chances, "right").astype(np.int8)[at]))

    # grouped rows are few bytes, which adaptive execution would gather in one task
    spread = rows.where(F.col(key).isNotNull()).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    # the outer form: of the plain one Spark infers a filter on the array, which it pushes below the grouping, where every row would make its draws
    drawn = spread.withColumn("__w", weights(F.col(key).cast("string"))).select(*rows.columns, F.posexplode_outer("__w").alias("rep", "weight"))
    return drawn.where("weight > 0").withColumn("weight", F.col("weight").cast("int"))


def bootstrap_weights(clusters: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(key, rep, weight): how often each cluster is drawn in each replicate, 0 left out."""
    return drawn_rows(clusters.select(key).distinct(), key, replicates, seed)


def bootstrap_interval(df: DataFrame, cluster: str, value: str, replicates: int = 1000, seed: int = 20260826) -> DataFrame:
    """(mean, low, high): a mean with the 95 % interval of a cluster bootstrap."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    reps = drawn_rows(sums, cluster, replicates, seed).groupBy("rep").agg(
        (F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("m"))
    q = reps.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(q).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_spearman(df: DataFrame, cluster: str, x: str, y: str, replicates: int = 200, seed: int = 20260826) -> DataFrame:
    """(rho, low, high): Spearman's correlation with the 95 % interval of a cluster bootstrap.

    In a replicate a row counts as often as its cluster is drawn: ranks are weighted mean ranks, from sums over the
    distinct values, and the correlation is that of the weighted ranks. Rows are counted by cluster and values before
    they meet the replicates.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(cluster, F.col(x).alias("x"), F.col(y).alias("y"))
    cells = rows.groupBy(cluster, "x", "y").agg(F.count("*").alias("n"))
    drawn = drawn_rows(cells, cluster, replicates, seed).select("rep", (F.col("weight") * F.col("n")).alias("weight"), "x", "y")
    every = cells.select(F.lit(-1).alias("rep"), F.col("n").alias("weight"), "x", "y").union(drawn)

    def ranks(column: str) -> DataFrame:
        steps = every.groupBy("rep", column).agg(F.sum("weight").alias("n"))
        below = F.sum("n").over(Window.partitionBy("rep").orderBy(column)) - F.col("n")
        return steps.select("rep", column, (below + (F.col("n") + 1) / 2).alias(f"r{column}"))

    w, a, b = F.col("weight"), F.col("rx"), F.col("ry")
    sums = every.join(ranks("x"), ["rep", "x"]).join(ranks("y"), ["rep", "y"]).groupBy("rep").agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    n = F.col("n")
    spread = F.sqrt((n * F.col("aa") - F.col("a") * F.col("a")) * (n * F.col("bb") - F.col("b") * F.col("b")))
    rho = sums.select("rep", ((n * F.col("ab") - F.col("a") * F.col("b")) / F.nullif(spread, F.lit(0.0))).alias("rho"))
    return rho.agg(F.max(F.when(F.col("rep") == -1, F.col("rho"))).alias("rho"), F.percentile(
        F.when(F.col("rep") >= 0, F.col("rho")), F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("rho", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_bootstrap_auc(df: DataFrame, cluster: str, label: str, first: str, second: str, replicates: int = 200,
                         seed: int = 20260824) -> DataFrame:
    """(delta, low, high): difference of the AUCs of two scores, with a paired cluster bootstrap.

    A replicate weighs rows by the draws of their cluster. AUC with weights: the share of weighted
    positive-negative pairs in order, ties half. Rows are summed by cluster and score before they meet
    the replicates.
    """
    rows = df.select(cluster, F.col(label).cast("double").alias("y"), F.col(first).alias("__a"), F.col(second).alias("__b"))
    cells = rows.unpivot([cluster, "y"], ["__a", "__b"], "arm", "score").groupBy(cluster, "arm", "score").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    drawn = drawn_rows(cells, cluster, replicates, seed)
    every = cells.withColumn("rep", F.lit(-1)).withColumn("weight", F.lit(1)).select(*drawn.columns).union(drawn)
    steps = every.groupBy("rep", "arm", "score").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in "pq"])
    below = F.sum("q").over(Window.partitionBy("rep", "arm").orderBy("score")) - F.col("q") / 2
    auc = steps.withColumn("__s", F.col("p") * below).groupBy("rep", "arm").agg(
        (F.sum("__s") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc"))
    delta = auc.groupBy("rep").agg((F.max(F.when(F.col("arm") == "__b", F.col("auc"))) - F.max(F.when(F.col("arm") == "__a", F.col("auc")))).alias("d"))
    return delta.agg(F.max(F.when(F.col("rep") == -1, F.col("d"))).alias("delta"), F.percentile(
        F.when(F.col("rep") >= 0, F.col("d")), F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(
        "delta", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold): groups dealt over folds, those of like size and label rate to different folds."""
    stats = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
    order = Window.orderBy(F.desc("n"), F.desc("rate"), group)
    at = F.row_number().over(order) - 1
    turn = F.floor(at / folds) % 2
    return stats.select(group, F.when(turn == 0, at % folds).otherwise(folds - 1 - at % folds).cast("int").alias("fold"))


def fold_leaks(rows: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that stand in more than one fold."""
    return rows.groupBy(group).agg(F.countDistinct(fold).alias("n")).where("n > 1")


def out_of_fold_scores(df: DataFrame, fold: str, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None = None,
                       l2: float = 1.0, steps: int = 30, indicators: bool = False) -> DataFrame:
    """(keys, fold, label, score): every row scored by a model of all other folds.

    Ridge logistic regression by Newton steps, the intercept free, classes weighed to balance. Missing features
    take the median of the training rows, and with `indicators` whether each is missing is a feature too; features are standardised on them. Rows stay where
    they are: every step is one aggregation of gradient and curvature by fold, of which the driver
    gets a few numbers for each fold. Folds are a parameter of few values.
    """
    if indicators:
        gone = {f"__{c}_missing": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in features}
        df, features = df.withColumns(gone), [*features, *gone]
    d = len(features)
    names = [r[0] for r in df.select(fold).distinct().collect()]
    rows = df.select(*keys, fold, F.col(label).cast("double").alias("__y"), label, F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features]).alias("__x"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"))
    # every row trains the models of all other folds
    train = rows.withColumn("__f", F.explode(F.array(*map(F.lit, names)))).where(~F.col("__f").eqNullSafe(F.col(fold)) & F.col("__y").isNotNull())
    middle = {r["__f"]: [0.0 if v is None else v for v in r["m"]] for r in train.groupBy("__f").agg(
        F.array(*[F.median(F.col("__x")[i]) for i in range(d)]).alias("m")).collect()}

    def chosen(values: dict, kind: str) -> Column:
        """The entry of a fold's model, as a literal: as many as there are folds."""
        out = F.lit(None).cast(kind)
        for f, v in values.items():
            out = F.when(F.col("__f") == f, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).otherwise(out)
        return out

    filled = F.zip_with("__x", chosen(middle, "array<double>"), lambda x, m: F.coalesce(x, m))
    train = train.withColumn("__x", filled)
    moments = train.groupBy("__f").agg(F.avg("__y").alias("rate"), F.array(*[F.avg(F.col("__x")[i]) for i in range(d)]).alias("c"),
                                       F.array(*[F.stddev_pop(F.col("__x")[i]) for i in range(d)]).alias("s")).collect()
    center, scale, rate = {r["__f"]: r["c"] for r in moments}, {r["__f"]: [s or 1.0 for s in r["s"]] for r in moments}, {r["__f"]: r["rate"] for r in moments}

    def standard(df: DataFrame) -> DataFrame:
        z = F.zip_with(F.zip_with("__x", chosen(center, "array<double>"), lambda x, c: x - c), chosen(scale, "array<double>"), lambda x, s: x / s)
        return df.withColumn("__z", F.concat(z, F.array(F.lit(1.0))))

    def probability(b: dict[object, list[float]]) -> Column:
        dot = F.aggregate(F.zip_with("__z", chosen(b, "array<double>"), lambda z, c: z * c), F.lit(0.0), lambda acc, v: acc + v)
        return 1 / (1 + F.exp(-F.least(F.greatest(dot, F.lit(-30.0)), F.lit(30.0))))

    fitted = {f: [0.0] * (d + 1) for f, p in rate.items() if 0 < p < 1}
    share = F.when(F.col("__y") == 1, chosen({f: 0.5 / rate[f] for f in fitted}, "double")).otherwise(chosen({f: 0.5 / (1 - rate[f]) for f in fitted}, "double"))
    ready = standard(train).withColumn("__w", F.col("__w") * share)
    penalty = np.diag([*[l2] * d, 1e-9])
    for _ in range(steps if fitted else 0):
        p = ready.withColumn("__p", probability(fitted))
        slope, curve = F.col("__w") * (F.col("__y") - F.col("__p")), F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        z = lambda i: F.col("__z")[i]
        sums = p.where(F.col("__f").isin(*fitted)).groupBy("__f").agg(F.array(*[F.sum(slope * z(i)) for i in range(d + 1)]).alias("g"),
                                                                       F.array(*[F.sum(curve * z(i) * z(j)) for i in range(d + 1) for j in range(d + 1)]).alias("h")).collect()
        most = 0.0
        for r in sums:
            b = np.array(fitted[r["__f"]])
            change = np.linalg.solve(np.array(r["h"]).reshape(d + 1, d + 1) + penalty, np.array(r["g"]) - penalty @ b)
            fitted[r["__f"]] = (b + change).tolist()
            most = max(most, float(np.abs(change).max()))
        if most < 1e-10:
            break
    test = standard(rows.withColumn("__f", F.col(fold)).withColumn("__x", filled))
    score = F.coalesce(probability(fitted), chosen(rate, "double")) if fitted else chosen(rate, "double")
    return test.select(*keys, fold, label, score.alias("score"))


def fold_checks(rows: DataFrame, key: str, group: str, fold: str, label: str, folds: int) -> DataFrame:
    """(check, n): how many groups or rows lie in two folds, rows lack a fold or group, folds have one class or are missing."""
    several = lambda by, n: rows.groupBy(by).agg(n.alias("n")).where("n > 1").agg(F.count("*").alias("n"))
    whole = rows.agg(F.count_if(F.col(fold).isNull()).alias("a"), F.count_if(F.col(group).isNull()).alias("b"),
                     (folds - F.countDistinct(F.when(F.col(fold).between(0, folds - 1), F.col(fold)))).alias("c"))
    classes = rows.groupBy(fold).agg(F.countDistinct(label).alias("n")).agg(F.count_if(F.col("n") < 2).alias("n"))
    named = {"group_in_two_folds": several(group, F.countDistinct(fold)), "row_in_two_folds": several(key, F.count("*")), "row_without_fold": whole.select(F.col("a").alias("n")),
             "row_without_group": whole.select(F.col("b").alias("n")), "fold_of_one_class": classes, "fold_missing": whole.select(F.col("c").alias("n"))}
    parts = [df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n")) for name, df in named.items()]
    return functools.reduce(DataFrame.union, parts)


def fold_priors(rows: DataFrame, fold: str, label: str) -> DataFrame:
    """(fold, n, prior): the label rate of all other folds, from the totals less the fold's own."""
    own = rows.groupBy(fold).agg(F.count(label).alias("n"), F.sum(label).alias("__s"))
    every = Window.partitionBy()    # over folds
    return own.select(fold, "n", ((F.sum("__s").over(every) - F.col("__s")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0))).alias("prior"))


def out_of_fold_trees(df: DataFrame, fold: str, keys: Sequence[str], features: Sequence[str], label: str, kind: str = "forest", seed: int = 20260826) -> DataFrame:
    """(keys, fold, label, score): every row scored by trees grown on all other folds, a random forest or boosted ("boosted").

    One distributed fit for each fold; folds are a parameter of few values. A fold whose training rows have one class scores their rate.
    """
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(df.withColumn("__y", F.col(label).cast("double")))
    make = RandomForestClassifier if kind == "forest" else GBTClassifier
    parts = []
    for r in df.groupBy(fold).agg(F.count("*")).collect():
        mine = F.col(fold).eqNullSafe(F.lit(r[0]))
        train, test = ready.where(~mine & F.col("__y").isNotNull()), ready.where(mine)
        rate = train.agg(F.avg("__y")).first()[0]
        if rate is None or not 0 < rate < 1:
            parts.append(test.select(*keys, fold, label, F.lit(rate).cast("double").alias("score")))
            continue
        model = make(featuresCol="__x", labelCol="__y", probabilityCol="__p", seed=seed).fit(train)
        parts.append(model.transform(test).select(*keys, fold, label, vector_to_array("__p")[1].alias("score")))
    return functools.reduce(DataFrame.union, parts)
