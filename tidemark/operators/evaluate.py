"""Agreement of signals and outcomes: correlations, classes, states, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Null below `least` complete pairs or where a side is constant (corr fails on those)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    ok = (F.count_if(both) >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12)
    return F.when(ok, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def average_ranks(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    for x in columns:
        first = F.rank().over(Window.partitionBy(*keys).orderBy(x))
        df = df.withColumn(f"rank_{x}", first + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / F.lit(2.0))
    return df


def standardised(x: str, w: WindowSpec) -> Column:
    """Null below three values, 0 if they are constant."""
    s = F.stddev_pop(x).over(w)
    return F.when(F.count(x).over(w) >= 3, F.when(s > 1e-12, (F.col(x) - F.avg(x).over(w)) / s).otherwise(0.0))


def terciles(df: DataFrame, x: str, name: str, keys: list[str]) -> DataFrame:
    """C up to the first tercile bound, E from the second, S between."""
    bounds = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("bounds"))
    state = F.when(F.col(x) <= F.get("bounds", F.lit(0)), "C").when(F.col(x) >= F.get("bounds", F.lit(1)), "E").otherwise("S")
    return df.join(bounds, keys).withColumn(name, state).drop("bounds")


def confusion(df: DataFrame, truth: str, pred: str, labels: list[str], keys: list[str]) -> DataFrame:
    """Balanced accuracy over the labels that occur, and macro F1 with 0 where undefined."""
    counts = [(F.count_if(F.col(truth) == k), F.count_if(F.col(pred) == k), F.count_if((F.col(truth) == k) & (F.col(pred) == k))) for k in labels]
    wide = df.groupBy(*keys).agg(*[x.alias(f"{n}{i}") for i, c in enumerate(counts) for n, x in zip("tph", c, strict=True)])
    recall = [F.try_divide(F.col(f"h{i}"), F.col(f"t{i}")) for i in range(len(labels))]
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(f"h{i}"), F.col(f"t{i}") + F.col(f"p{i}")), F.lit(0.0)) for i in range(len(labels))]
    some = F.filter(F.array(*recall), lambda x: x.isNotNull())
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return wide.select(*keys, F.try_divide(fold(some), F.size(some)).alias("balanced_accuracy"), (fold(F.array(*f1)) / len(labels)).alias("macro_f1"), sum((F.col(f"h{i}") for i in range(1, len(labels))), F.col("h0")).alias("n_correct"))


def stability(df: DataFrame, state: str, score: str, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("before", F.lag(state).over(w)).withColumn("score_before", F.lag(score).over(w)).where("before is not null")
    flip = ((F.col(state) == "C") & (F.col("before") == "E")) | ((F.col(state) == "E") & (F.col("before") == "C"))
    share = lambda x: F.avg(x.cast("double"))
    return rows.groupBy(*keys).agg(share(F.col(state) == F.col("before")).alias("persistence"), share(F.col(state) != F.col("before")).alias("churn"), share(flip).alias("direct_flips"), pearson(score, "score_before").alias("acf1"), F.avg(F.abs(F.col(score) - F.col("score_before"))).alias("mean_move"))


def in_windows(df: DataFrame, windows: DataFrame, day: str) -> DataFrame:
    """Rows inside windows (event, first_day, last_day), a small dimension table of fixed size."""
    return df.join(F.broadcast(windows), F.col(day).between(F.col("first_day"), F.col("last_day")))


def outside_windows(df: DataFrame, windows: DataFrame, day: str) -> DataFrame:
    return df.join(F.broadcast(windows), F.col(day).between(F.col("first_day"), F.col("last_day")), "left_anti")


def lead_times(signals: DataFrame, ids: DataFrame, windows: DataFrame, keys: list[str], weeks: int) -> DataFrame:
    """Weeks from the first signal within so many weeks before each event to the event; null without one."""
    before = windows.select("event", F.col("first_day").alias("start"), F.date_sub("first_day", 7 * weeks).alias("first_day"), F.col("first_day").alias("last_day"))
    found = in_windows(signals, before, "week").groupBy(*keys, "event").agg(F.min("week").alias("signal"))
    grid = ids.crossJoin(F.broadcast(windows.select("event", "first_day")))
    return grid.join(found, [*keys, "event"], "left").select(*keys, "event", F.floor(F.datediff("first_day", "signal") / 7).alias("lead_weeks"))


def false_alarms(signals: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    marked = signals.join(F.broadcast(windows.select("first_day", "last_day", F.lit(True).alias("near"))), F.col("week").between(F.col("first_day"), F.col("last_day")), "left").groupBy(*keys, "week").agg(F.bool_or("near").alias("near"))
    n_false = F.count_if(F.col("near").isNull())
    return marked.groupBy(*keys).agg(F.count("*").alias("n_signals"), n_false.alias("n_false"), F.try_divide(n_false, F.count("*")).alias("share"))


def lead_lag(df: DataFrame, signal: str, target: str, keys: list[str], order: str, lags: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.select("*", *[F.lag(signal, k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    wide = rows.groupBy(*keys).agg(*[pearson(target, f"l{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("pearson")) for k in range(1, lags + 1)])).alias("x")).select(*keys, "x.lag", "x.pearson")


def ks(df: DataFrame, x: str, cdf: str, keys: list[str], tie: str) -> DataFrame:
    """Largest gap between the empirical and the given distribution function."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(x, tie)), F.count("*").over(w)
    rows = df.withColumn("i", i).withColumn("n", n)
    return rows.groupBy(*keys).agg(F.max(F.greatest(F.col("i") / F.col("n") - F.col(cdf), F.col(cdf) - (F.col("i") - 1) / F.col("n"))).alias("ks"))
