"""Parts of the state model in columns, and the alignments that each object of an evaluation needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, query
from tidemark.functions import quantiles as Q
from tidemark.queries.distribution import FORECAST, QS, RAW, forecast, raw_scores
from tidemark.operators import states as ST
from tidemark.queries.modelling import MU, SD, STAY, fixed_states, hmm_filter
from tidemark.queries.series import ID, WEEKLY_RETURNS, by_week, forward_drawdown, r6, weekly_features, weekly_returns_df


@query(f"{FORECAST} SELECT a.series_id AS first_id, b.series_id AS second_id, a.week, round(a.q4, 6) AS first_q50, round(b.q4, 6) AS second_q50, round(a.y, 6) AS y FROM fc a JOIN fc b ON a.week = b.week AND a.series_id < b.series_id")
def aligned_forecasts(spark, d):
    """Two forecast series on their common weeks, for each pair of series."""
    f = forecast(spark, d)
    a = f.select(F.col("series_id").alias("first_id"), "week", "q4", "y")
    b = f.select(F.col("series_id").alias("second_id"), "week", F.col("q4").alias("other"))
    return a.join(b, "week").where("first_id < second_id").select("first_id", "second_id", "week", r6(F.col("q4"), "first_q50"), r6(F.col("other"), "second_q50"), r6(F.col("y"), "y"))


@query(f"{RAW}, fd AS ({ORACLES['forward_drawdown']}) SELECT s.series_id, s.week, round(raw, 4) AS score, forward_risk, forward_drawdown FROM s JOIN fd USING (series_id, week) WHERE forward_risk IS NOT NULL AND forward_drawdown IS NOT NULL")
def aligned_labels(spark, d):
    """A score series on the weeks that have labels."""
    return raw_scores(spark, d).join(forward_drawdown(spark, d).dropna("any"), ["series_id", "week"]).select("series_id", "week", F.round("raw", 4).alias("score"), "forward_risk", "forward_drawdown")


@query(f"{FORECAST}, sf AS ({ORACLES['weekly_features']}), h AS (SELECT week, count(*) AS n_features, sum(scaled) AS total FROM sf GROUP BY 1) SELECT series_id, week, n_features, round(total, 6) AS total FROM fc JOIN h USING (week) WHERE n_features = 5")
def outputs_with_features(spark, d):
    """Outputs with the scaled features of their week; weeks without all of them are left out."""
    h = weekly_features(spark, d).groupBy("week").agg(F.count("*").alias("n_features"), F.sum("scaled").alias("total")).where("n_features = 5")
    return forecast(spark, d).select("series_id", "week").join(h, "week").select("series_id", "week", "n_features", r6(F.col("total"), "total"))


@query(f"{FORECAST.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, hf AS ({ORACLES['hmm_filter']}) SELECT fc.series_id, fc.week, p1, p2, p3, round(q4, 6) AS x, round(y, 6) AS y FROM fc JOIN hf ON hf.series_id = fc.series_id AND hf.week = fc.week")
def posteriors_with_rows(spark, d):
    """The state path on the rows that the panel regression is fitted to."""
    return forecast(spark, d).select("series_id", "week", "q4", "y").join(hmm_filter(spark, d), ["series_id", "week"]).select("series_id", "week", "p1", "p2", "p3", r6(F.col("q4"), "x"), r6(F.col("y"), "y"))


def gauss_sql(m: float, s: float) -> str:
    return f"(-0.5::DOUBLE * ((r - ({m}::DOUBLE)) / {s}::DOUBLE) * ((r - ({m}::DOUBLE)) / {s}::DOUBLE) - ln({s}::DOUBLE) - 0.5::DOUBLE * ln(2 * pi()))"


def lse_sql(names: list[str]) -> str:
    top = f"greatest({', '.join(names)})"
    return f"({top} + ln({' + '.join(f'exp({n} - {top})' for n in names)}))"


def log_sum_exp(xs: list[Column]) -> Column:
    """Stable whatever the size of the terms."""
    top = F.greatest(*xs)
    return top + F.ln(Q.total([F.exp(x - top) for x in xs]))


LS = ["l1", "l2", "l3"]
EMITTED = f"{WEEKLY_RETURNS}, e AS (SELECT series_id, week, r, {', '.join(f'{gauss_sql(m, s)} AS {n}' for n, m, s in zip(LS, MU, SD, strict=True))} FROM r WHERE r IS NOT NULL)"


def emitted(spark, d) -> DataFrame:
    z = [(F.col("r") - m) / s for m, s in zip(MU, SD, strict=True)]
    rows = weekly_returns_df(spark, d).where("r is not null")
    return rows.select("series_id", "week", "r", *[(-0.5 * x * x - F.ln(F.lit(s)) - 0.5 * F.ln(2 * F.pi())).alias(n) for n, x, s in zip(LS, z, SD, strict=True)])


@query(f"{EMITTED} SELECT series_id, week, {', '.join(f'round({n}, 6) AS {n}' for n in LS)}, round({lse_sql(LS)}, 6) AS total, {', '.join(f'round(exp({n} - {lse_sql(LS)}), 6) AS w{k + 1}' for k, n in enumerate(LS))} FROM e")
def emission_weights(spark, d):
    """Gaussian log densities of each state, their stable log sum and the soft assignment that follows."""
    total = log_sum_exp([F.col(n) for n in LS])
    return emitted(spark, d).select("series_id", "week", *[r6(F.col(n), n) for n in LS], r6(total, "total"), *[r6(F.exp(F.col(n) - total), f"w{k + 1}") for k, n in enumerate(LS)])


HAZARD = [(-2.0, 0.05, 0.4), (-1.5, 0.02, -0.3), (-2.5, 0.1, 0.2)]
DWELL_SQL = f"{WEEKLY_RETURNS}, c AS (SELECT series_id, week, r, CASE WHEN r > 0.05 THEN 3 WHEN r < -0.05 THEN 1 ELSE 2 END AS state FROM r WHERE r IS NOT NULL), g AS (SELECT *, CASE WHEN lag(state) OVER o IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS new FROM c WINDOW o AS (PARTITION BY series_id ORDER BY week)), i AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY week) AS run FROM g), w AS (SELECT *, row_number() OVER (PARTITION BY series_id, run ORDER BY week) AS dwell FROM i)"


@query(
    f"""{DWELL_SQL}, p AS (SELECT series_id, week, state, dwell, {', '.join(f"greatest(1e-12, least(1 - 1e-12, 1 / (1 + exp(-greatest(-50, least(50, {a}::DOUBLE + {b}::DOUBLE * (CASE WHEN state = {k} THEN dwell ELSE 1 END) + {g}::DOUBLE * r)))))) AS p{k}" for k, (a, b, g) in enumerate(HAZARD, 1))} FROM w)
SELECT series_id, week, CAST(state AS INT) AS state, dwell, {', '.join(f'round(CASE WHEN {i} = {j} THEN 1 - p{i} ELSE p{i} / 2 END, 6) AS t{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3))} FROM p"""
)
def transition_matrix(spark, d):
    """Each week's transition matrix: a state's hazard of leaving grows with its dwell time and a covariate; what leaves is split evenly."""
    from tidemark.operators import windows as W

    state = F.when(F.col("r") > 0.05, 3).when(F.col("r") < -0.05, 1).otherwise(2)
    rows = W.islands(weekly_returns_df(spark, d).where("r is not null").withColumn("state", state), "state", ID, "week")
    leave = []
    for k, (a, b, g) in enumerate(HAZARD, 1):
        eta = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), a + b * F.when(F.col("state") == k, F.col("dwell")).otherwise(1) + g * F.col("r")))
        leave.append(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-eta)))))
    cells = [r6(1 - p if i == j else p / 2, f"t{i}{j}") for i, p in enumerate(leave, 1) for j in (1, 2, 3)]
    return rows.select("series_id", "week", "state", F.col("dwell").cast("bigint").alias("dwell"), *cells)


MOVE = (1 - STAY) / 2
AHEAD = [f"(e{k} * b{k})" for k in (1, 2, 3)]
BACK_SQL = ", ".join(f"{STAY}::DOUBLE * {AHEAD[k]} + {MOVE!r}::DOUBLE * ({' + '.join(a for j, a in enumerate(AHEAD) if j != k)}) AS n{k + 1}" for k in range(3))


@query(
    f"""{WEEKLY_RETURNS.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, hf AS ({ORACLES['hmm_filter']}), n AS (SELECT r.series_id, r.week, r, p1, p2, p3, row_number() OVER (PARTITION BY r.series_id ORDER BY r.week DESC) AS i FROM r JOIN hf ON hf.series_id = r.series_id AND hf.week = r.week WHERE r IS NOT NULL),
e AS (SELECT *, {', '.join(f"exp(-0.5::DOUBLE * ((r - ({m}::DOUBLE)) / {s}::DOUBLE) * ((r - ({m}::DOUBLE)) / {s}::DOUBLE)) / {s}::DOUBLE AS e{k}" for k, (m, s) in enumerate(zip(MU, SD, strict=True), 1))} FROM n),
b AS (SELECT series_id, i, 1::DOUBLE AS b1, 1::DOUBLE AS b2, 1::DOUBLE AS b3 FROM e WHERE i = 1 UNION ALL SELECT series_id, i + 1, n1 / (n1 + n2 + n3), n2 / (n1 + n2 + n3), n3 / (n1 + n2 + n3) FROM (SELECT b.series_id, b.i, {BACK_SQL} FROM b JOIN e ON e.series_id = b.series_id AND e.i = b.i) x)
SELECT e.series_id, e.week, {', '.join(f'round(p{k} * b{k} / (p1 * b1 + p2 * b2 + p3 * b3), 4) AS s{k}' for k in (1, 2, 3))} FROM e JOIN b ON b.series_id = e.series_id AND b.i = e.i"""
)
def hmm_smoother(spark, d):
    """Smoothed probabilities of the three fixed states, from the filtered ones as hmm_filter reports them, to five places."""
    out = fixed_states(weekly_returns_df(spark, d).where("r is not null"))
    both = [F.round(f, 5) * F.coalesce(F.try_divide(s, f), F.lit(0.0)) for f, s in zip(ST.FILTERED, ST.SMOOTHED, strict=True)]
    return out.select("series_id", "week", *[F.round(v / Q.total(both), 4).alias(s) for v, s in zip(both, ST.SMOOTHED, strict=True)])


TS = [f"t{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
NEXT = ", ".join(f"({' + '.join(f'a{i} * t{i}{j}' for i in (1, 2, 3))}) * e{j} AS n{j}" for j in (1, 2, 3))
BEFORE = ", ".join(f"{' + '.join(f't{i}{j} * e{j} * b{j}' for j in (1, 2, 3))} AS n{i}" for i in (1, 2, 3))
BOTH = " + ".join(f"a{i} * b{i}" for i in (1, 2, 3))
PAIR_SUM = " + ".join(f"l{i} * t{i}{j} * e{j} * b{j}" for i in (1, 2, 3) for j in (1, 2, 3))


@query(
    f"""{EMITTED.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, tm AS ({ORACLES['transition_matrix']}),
m AS (SELECT e.series_id, e.week, {', '.join(f'lag({t}) OVER o AS {t}' for t in TS)}, {', '.join(f'exp(l{k} - greatest(l1, l2, l3)) AS e{k}' for k in (1, 2, 3))}, greatest(l1, l2, l3) AS top, row_number() OVER o AS i, count(*) OVER (PARTITION BY e.series_id) AS n FROM e JOIN tm ON tm.series_id = e.series_id AND tm.week = e.week WINDOW o AS (PARTITION BY e.series_id ORDER BY e.week)),
f AS (SELECT series_id, i, e1 / (e1 + e2 + e3) AS a1, e2 / (e1 + e2 + e3) AS a2, e3 / (e1 + e2 + e3) AS a3, top + ln((e1 + e2 + e3) / 3) AS ll FROM m WHERE i = 1 UNION ALL
SELECT series_id, i, n1 / (n1 + n2 + n3), n2 / (n1 + n2 + n3), n3 / (n1 + n2 + n3), ll + top + ln(n1 + n2 + n3) FROM (SELECT m.series_id, m.i, m.top, f.ll, {NEXT} FROM f JOIN m ON m.series_id = f.series_id AND m.i = f.i + 1) x),
b AS (SELECT series_id, i, 1::DOUBLE AS b1, 1::DOUBLE AS b2, 1::DOUBLE AS b3 FROM m WHERE i = n UNION ALL
SELECT series_id, i - 1, n1 / (n1 + n2 + n3), n2 / (n1 + n2 + n3), n3 / (n1 + n2 + n3) FROM (SELECT b.series_id, b.i, {BEFORE} FROM b JOIN m ON m.series_id = b.series_id AND m.i = b.i WHERE b.i > 1) x)
SELECT m.series_id, m.week, {', '.join(f'round(f.a{k}, 4) AS f{k}' for k in (1, 2, 3))}, {', '.join(f'round(f.a{k} * b{k} / (f.a1 * b1 + f.a2 * b2 + f.a3 * b3), 4) AS s{k}' for k in (1, 2, 3))}, {', '.join(f'round(l.a{i} * t{i}{j} * e{j} * b{j} / ({PAIR_SUM.replace("l1", "l.a1").replace("l2", "l.a2").replace("l3", "l.a3")}), 4) AS x{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3))}, round(f.ll, 3) AS loglik
FROM m JOIN f ON f.series_id = m.series_id AND f.i = m.i JOIN b ON b.series_id = m.series_id AND b.i = m.i LEFT JOIN f l ON l.series_id = m.series_id AND l.i = m.i - 1"""
)
def hazard_posteriors(spark, d):
    """Filtered and smoothed states, pairs of successive states and log likelihood under the weekly transition matrices, in
    which dwell time and a covariate move the hazards of leaving."""
    rows = emitted(spark, d).join(transition_matrix(spark, d), ["series_id", "week"])
    into = rows.select("series_id", "week", *LS, *[F.lag(t).over(by_week()).alias(t) for t in TS])
    out = ST.posteriors(into, "series_id", "week", [F.col(x) for x in LS], [F.col(t) for t in TS])
    return out.select("series_id", "week", *[F.round(x, 4).alias(x) for x in [*ST.FILTERED, *ST.SMOOTHED, *ST.PAIRS]], F.round("loglik", 3).alias("loglik"))
