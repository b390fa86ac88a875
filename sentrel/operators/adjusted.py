"""Covariate-adjusted sensitivity estimates of drug-event pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions import statistics as st
from sentrel.functions.normalize import stratum

from .contingency import Terms, in_bits, listed, tables, unfolded

MINIMUM_STRATUM, PRIOR, DRAWS, SEED = 4, 10.0, 10_000, 42


def profiles(obs: DataFrame, terms: Terms | None = None) -> DataFrame:
    """One row a report: report_id, drugs, events, shown (in upper case), age_group, sex, year, stratum.

    A report's first row (by ``position``) gives its covariates; missing ones count as unknown. Rows
    without a drug or an event show none. With ``terms`` (in upper case) drugs and events of the rows are
    numbers of these, and a report has the columns of ``contingency.in_bits`` instead of shown pairs.
    """
    first = F.min(F.struct("position", "age_group", "sex", "year")).alias("first")
    rows = obs.where("report_id is not null").groupBy("report_id")
    if terms:
        rows = rows.agg(*in_bits(terms), first).where("drug_bits <> 0").select("*", listed("drug_bits", terms.drugs).alias("drugs"), listed("event_bits", terms.events).alias("events"))
        sets = [c for c in rows.columns if c not in ("report_id", "first")]
    else:
        pair = F.when(F.col("drug").isNotNull() & F.col("event").isNotNull(), F.struct(F.upper("drug").alias("drug"), F.upper("event").alias("event")))
        rows, sets = unfolded(rows.agg(F.collect_set(pair).alias("_entries"), first), "_entries", "report_id", "first"), ["drugs", "events", "shown"]
    known = lambda c: F.coalesce(f"first.{c}", F.lit("unknown")).alias(c)
    rows = rows.select("report_id", *sets, known("age_group"), known("sex"), "first.year")
    return rows.withColumn("stratum", stratum(F.col("age_group"), F.col("sex"), F.col("year")))


def crude(cells: DataFrame) -> DataFrame:
    lower, upper = st.bounds(st.ror(), st.ror_error())
    return cells.select("drug", "event", "a", "b", "c", "d", st.ror().alias("ror"), lower.alias("lower_bound"), upper.alias("upper_bound"))


def stratum_tables(reports: DataFrame, terms: Terms | None = None) -> DataFrame:
    """stratum, drug, event, cells, n of every pair of ``profiles`` in every stratum of at least four reports."""
    return tables(reports, by=["stratum"], pairs="report", minimum=MINIMUM_STRATUM, terms=terms)


def mantel_haenszel(cells: DataFrame) -> DataFrame:
    """drug, event, estimate, lower_bound, upper_bound: common odds ratio with Robins-Breslow-Greenland bounds.

    Cells of a stratum get 0.5 if any is 0. Without information the estimate is 1 from 0 to infinity.
    """
    a, b, c, d = st.corrected()
    rows = cells.select("drug", "event", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).withColumn("t", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    a, b, c, d, t = (F.col(x) for x in "abcdt")
    r, s, tt = a * d, b * c, t * t
    sums = rows.groupBy("drug", "event").agg(F.sum(r / t).alias("r"), F.sum(s / t).alias("s"), F.sum((a + d) * r / tt).alias("x"), F.sum(((a + d) * s + (b + c) * r) / tt).alias("y"), F.sum((b + c) * s / tt).alias("z"))
    known = (F.col("r") > 0) & (F.col("s") > 0)
    r, s = F.nullif("r", F.lit(0.0)), F.nullif("s", F.lit(0.0))
    error = F.sqrt(F.greatest(F.col("x") / (2 * r * r) + F.col("y") / (2 * r * s) + F.col("z") / (2 * s * s), F.lit(0.0)))
    lower, upper = st.bounds(r / s, error)
    return sums.select("drug", "event", F.when(known, r / s).otherwise(1.0).alias("estimate"), F.when(known, lower).otherwise(0.0).alias("lower_bound"), F.when(known, upper).otherwise(F.lit(math.inf)).alias("upper_bound"))


def stratum_estimates(cells: DataFrame) -> DataFrame:
    """stratum, drug, event, reports, cases, ror, lower_bound, upper_bound, prr."""
    lower, upper = st.bounds(st.ror(), st.ror_error())
    return cells.select("stratum", "drug", "event", F.col("n").alias("reports"), F.col("a").alias("cases"), st.ror().alias("ror"), lower.alias("lower_bound"), upper.alias("upper_bound"), st.prr().alias("prr"))


def heterogeneity(estimates: DataFrame) -> DataFrame:
    """drug, event, q, df: Cochran's Q around the weighted mean (two passes); 0 and 0 below two usable strata."""
    pairs = estimates.select("drug", "event").distinct()
    error = (F.ln("upper_bound") - F.ln("lower_bound")) / (2 * st.Z)
    rows = estimates.where("ror > 0 and lower_bound > 0").select("drug", "event", F.ln("ror").alias("x"), error.alias("e")).where("e > 0").withColumn("w", 1 / (F.col("e") * F.col("e")))
    means = rows.groupBy("drug", "event").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mean"), F.count("*").alias("k"))
    spread = rows.join(means, ["drug", "event"]).groupBy("drug", "event").agg(F.sum(F.col("w") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("q"), (F.first("k") - 1).alias("df"))
    enough = F.coalesce(F.col("df") >= 1, F.lit(False))
    return pairs.join(spread, ["drug", "event"], "left").select("drug", "event", F.when(enough, F.col("q")).otherwise(0.0).alias("q"), F.when(enough, F.col("df")).otherwise(0).alias("df"))


def _upper_tail(q: pd.Series, df: pd.Series) -> pd.Series:
    """Wilson-Hilferty upper tail of chi-square (Spark has no error function)."""
    k = df.where(df > 0).astype(float)
    z = ((q / k) ** (1 / 3) - (1 - 2 / (9 * k))) / np.sqrt(2 / (9 * k))
    return z.map(lambda v: None if pd.isna(v) else min(max(0.5 * math.erfc(v / math.sqrt(2)), 0.0), 1.0))


def heterogeneity_p(spread: DataFrame) -> DataFrame:
    """``heterogeneity`` with p (null where df is 0)."""
    return spread.withColumn("p", F.pandas_udf(_upper_tail, "double")("q", "df"))


def active_comparator(reports: DataFrame, comparators: DataFrame) -> DataFrame:
    """Odds ratio of a drug against reports of its comparator drugs (rows drug, comparator).

    drug, event, cells, estimate, bounds, reports_used; only drugs that have comparators, with the
    events of their own reports. A report of both counts for the drug.
    """
    wanted = comparators.select(F.upper("drug").alias("drug"), F.upper("comparator").alias("comparator"))
    roles = wanted.select("drug", F.col("drug").alias("name"), F.lit(1).alias("exposed")).union(wanted.select("drug", "comparator", F.lit(0))).distinct()
    taken = reports.select("report_id", "events", F.explode("drugs").alias("name"))
    arms = taken.join(roles, "name").groupBy("report_id", "drug").agg(F.max("exposed").alias("exposed"), F.first("events").alias("events"))
    sizes = arms.groupBy("drug").agg(F.sum("exposed").alias("n1"), F.count("*").alias("n"))
    cases = arms.select("drug", "exposed", F.explode("events").alias("event")).groupBy("drug", "event").agg(F.sum("exposed").alias("a"), F.sum(1 - F.col("exposed")).alias("c")).where("a > 0")
    cells = cases.join(sizes, "drug").select("drug", "event", "a", (F.col("n1") - F.col("a")).alias("b"), "c", (F.col("n") - F.col("n1") - F.col("c")).alias("d"), F.col("n").alias("reports_used"))
    lower, upper = st.bounds(st.ror(), st.ror_error())
    return cells.select("*", st.ror().alias("estimate"), lower.alias("lower_bound"), upper.alias("upper_bound"))


def logistic_fit(exposed: np.ndarray, groups: list[np.ndarray], cases: np.ndarray, reports: np.ndarray, strength: float = 1.0) -> float:
    """Odds ratio of ``exposed`` in an L2-penalised logistic model with full one-hot covariates.

    The intercept is penalised like the rest. Newton's method on grouped counts.
    """
    if cases.sum() in (0, reports.sum()):
        return 1.0
    columns = [exposed.astype(float)] + [(g == v).astype(float) for g in groups for v in np.unique(g)]
    x = np.column_stack([*columns, np.ones(len(cases))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = w + strength * (x.T @ (reports * p - cases))
        step = np.linalg.solve(np.eye(len(w)) + strength * (x.T * (reports * p * (1 - p))) @ x, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(w[0]))


def penalized_logistic(reports: DataFrame) -> DataFrame:
    """drug, event, estimate, reports_used: the adjusted odds ratio of every pair of the same report.

    Spark counts reports and cases by covariates. A fit gets one row: the counts of its drug, its event
    and both in the groups where they occur, so it depends on the number of covariate combinations
    (bands, sexes and years: a few hundred, broadcast), not on reports.
    """
    spark, keys = reports.sparkSession, ["age_group", "sex", "year"]
    label = F.to_json(F.struct(*keys)).alias("label")
    groups = sorted((r.label, r.age_group, r.sex, str(r.year), r.n) for r in reports.groupBy(*keys).agg(F.count("*").alias("n")).select("*", label).collect())
    shared = spark.sparkContext.broadcast(groups)
    told = reports.select("drugs", "events", label)
    drugs, events = told.select("label", F.explode("drugs").alias("drug"), "events", "drugs"), told.select("label", F.explode("events").alias("event"), "events", "drugs")
    pairs = drugs.select("label", "drug", F.explode("events").alias("event"))

    def counted(df: DataFrame, by: list[str], name: str) -> DataFrame:
        sums = df.groupBy(*by, "label").agg(F.count("*").alias("k"))
        return sums.groupBy(*by).agg(F.collect_list(F.struct("label", "k")).alias(name))

    rows = counted(pairs, ["drug", "event"], "both").join(counted(drugs, ["drug"], "with_drug"), "drug").join(counted(events, ["event"], "with_event"), "event")

    def fitted(batches):
        labels, *columns, n = zip(*shared.value, strict=True)
        place, n = {x: i for i, x in enumerate(labels)}, np.array(n, float)
        cov = [np.tile(np.array(c, object), 2) for c in columns]
        exposed = np.repeat([1, 0], len(n))

        def spread(cells) -> np.ndarray:
            out = np.zeros(len(n))
            for c in cells:
                out[place[c["label"]]] = c["k"]
            return out

        for g in batches:
            out = []
            for r in g.itertuples():
                nd, ne, a = spread(r.with_drug), spread(r.with_event), spread(r.both)
                estimate = logistic_fit(exposed, cov, np.concatenate([a, ne - a]), np.concatenate([nd, n - nd]))
                out.append((r.drug, r.event, estimate, int(n.sum())))
            yield pd.DataFrame(out, columns=["drug", "event", "estimate", "reports_used"])

    return rows.mapInPandas(fitted, "drug string, event string, estimate double, reports_used long")


def beta_binomial(cells: DataFrame, seed: int = SEED) -> DataFrame:
    """drug, event, estimate, lower_bound, upper_bound: odds ratio shrunk towards the overall rate.

    Median and 95 % interval of 10,000 draws, drawn anew from ``seed`` for every pair.
    """

    def drawn(batches):
        for g in batches:
            out = []
            for r in g.itertuples():
                rate = (r.a + r.c) / (r.a + r.b + r.c + r.d)
                alpha, beta, rng = 1 + PRIOR * rate, 1 + PRIOR * (1 - rate), np.random.default_rng(seed)
                x, y = rng.beta(alpha + r.a, beta + r.b, DRAWS), rng.beta(alpha + r.c, beta + r.d, DRAWS)
                odds = (x / (1 - x)) / (y / (1 - y))
                out.append((r.drug, r.event, float(np.median(odds)), *map(float, np.quantile(odds, [0.025, 0.975]))))
            yield pd.DataFrame(out, columns=["drug", "event", "estimate", "lower_bound", "upper_bound"])

    return cells.select("drug", "event", "a", "b", "c", "d").mapInPandas(drawn, "drug string, event string, estimate double, lower_bound double, upper_bound double")
