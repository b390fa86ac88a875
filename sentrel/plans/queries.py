"""One query for each operator over the star-schema tables, and the SQL that DuckDB checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.functions import normalize as nz
from sentrel.operators import adjusted, audit, backtest, bitmaps, cohort, contingency, detectors, evidence, forest, quality, reference, serve, temporal

from sentrel.sources.scratch import Scratch, written

from .mapping import numbered, observations, observations_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Fixed constants of the demonstration: reference signals (id, quarter, brand, segment, how matched).
REFERENCES = [
    ("r1", "1996-Q2", "BRAND#11", "BUILDING", "exact"), ("r2", "1997-Q1", "BRAND#23", "MACHINERY", "exact"), ("r3", "1997-Q1", "BRAND#23", "MACHINERY", "manual"), ("r4", "1998-Q3", "BRAND#45", "FURNITURE", "manual"),
    ("r5", "1999-Q4", "BRAND#52", "AUTOMOBILE", "exact"), ("r6", "2000-Q2", "BRAND#34", "HOUSEHOLD", "exact"), ("r7", "2031-Q1", "BRAND#11", "BUILDING", "exact"), ("r8", "1998-Q1", None, None, "unmatched"),
]
K = 40


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Floats to six places, as the SQL gives them."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- contingency and detectors ------------------------------------------------------------------

def cells_sql(obs: str, by: str = "", dense: bool = False, where: str = "") -> str:
    """CTEs ending in t (by, drug, event, a, b, c, d, n)."""
    k = f"{by}, " if by else ""
    using = f"{by}, " if by else ""
    universe = f"SELECT DISTINCT {k}drug, event FROM obs" if not dense else f"SELECT * FROM (SELECT DISTINCT drug, event FROM {dense if isinstance(dense, str) else 'obs'}) CROSS JOIN (SELECT DISTINCT {by} FROM obs)"
    return f"""
    obs AS ({obs}),
    rd AS (SELECT DISTINCT {k}report_id, drug FROM obs), re AS (SELECT DISTINCT {k}report_id, event FROM obs),
    ab AS (SELECT {k}drug, event, count(*) AS a FROM rd JOIN re USING ({using}report_id) GROUP BY ALL),
    nd AS (SELECT {k}drug, count(*) AS nd FROM rd GROUP BY ALL), ne AS (SELECT {k}event, count(*) AS ne FROM re GROUP BY ALL),
    nn AS (SELECT {k}count(DISTINCT report_id) AS n FROM obs {'GROUP BY ' + by if by else ''}),
    u AS ({universe}),
    t AS (SELECT {k}drug, event, coalesce(a, 0) AS a, coalesce(nd, 0) - coalesce(a, 0) AS b, coalesce(ne, 0) - coalesce(a, 0) AS c,
                 n - coalesce(nd, 0) - coalesce(ne, 0) + coalesce(a, 0) AS d, n
          FROM u LEFT JOIN ab USING ({using}drug, event) LEFT JOIN nd USING ({using}drug) LEFT JOIN ne USING ({using}event) {'JOIN nn USING (' + by + ')' if by else 'CROSS JOIN nn'} {where})"""


FIXED = "(SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h FROM {0})"
ROR = "(a + h) * (d + h) / ((b + h) * (c + h))"
ROR_SE = "sqrt(1 / (a + h) + 1 / (b + h) + 1 / (c + h) + 1 / (d + h))"
PRR = "((a + h) / (a + b + 2 * h)) / ((c + h) / (c + d + 2 * h))"
PRR_SE = "sqrt(1 / (a + h) - 1 / (a + b + 2 * h) + 1 / (c + h) - 1 / (c + d + 2 * h))"
CHI = """CASE WHEN n = 0 OR (a + b)::DOUBLE * (c + d) * (a + c) * (b + d) = 0 THEN 0
      ELSE n * (a::DOUBLE * d - b::DOUBLE * c) * (a::DOUBLE * d - b::DOUBLE * c) / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)) END"""

SIGNALS = f"""
    scored AS (
        SELECT 'ror' AS detector, drug, event, s AS score, exp(ln(s) - 1.96 * se) AS lower_bound, exp(ln(s) + 1.96 * se) AS upper_bound, a, b, c, d, NULL::DOUBLE AS chi_square
        FROM (SELECT *, {ROR} AS s, {ROR_SE} AS se FROM {FIXED.format('t')})
        UNION ALL
        SELECT 'prr', drug, event, s, exp(ln(s) - 1.96 * se), exp(ln(s) + 1.96 * se), a, b, c, d, {CHI}
        FROM (SELECT *, {PRR} AS s, {PRR_SE} AS se FROM {FIXED.format('t')})),
    signals AS (SELECT *, CASE WHEN detector = 'ror' THEN a >= 3 AND lower_bound > 1 ELSE a >= 3 AND score >= 2 AND chi_square >= 4 END AS is_potential_signal,
                       a >= 5 AND lower_bound > 1 AS passes_stability_rule FROM scored)"""
SIGNAL_COLUMNS = "detector, drug, event, round(score, 6) AS score, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound, a, b, c, d, round(chi_square, 6) AS chi_square, is_potential_signal, passes_stability_rule"
SIGNAL_ORDER = "is_potential_signal DESC, passes_stability_rule DESC, score DESC, detector, drug, event"


def _cells(spark, sf, event="segment"):
    obs, terms = numbered(spark, sf, "brand", event)
    return contingency.contingency(obs, terms=terms)


@query("contingency_cells", f"WITH {cells_sql(observations_sql('brand', 'flag'))} SELECT * FROM t")
def contingency_cells(spark, sf):
    return _cells(spark, sf, "flag")


@query("bitmap_cells", f"WITH {cells_sql(observations_sql('part', 'flag'))} SELECT * FROM t")
def bitmap_cells(spark, sf):
    store = Scratch(spark)
    obs = store.written(observations(spark, sf, "part", "flag").select("report_id", "drug", "event"), "bitmap-rows")  # read three times
    return bitmaps.cells(store.written(bitmaps.built(obs, store), "report-bitmaps"), obs)


@query("signals_ror", f"WITH {cells_sql(observations_sql())}, {SIGNALS} SELECT {SIGNAL_COLUMNS} FROM signals WHERE detector = 'ror'")
def signals_ror(spark, sf):
    return rounded(detectors.reporting_odds_ratio(_cells(spark, sf)), "score", "lower_bound", "upper_bound", "chi_square")


@query("signals_prr", f"WITH {cells_sql(observations_sql('part'))}, {SIGNALS} SELECT {SIGNAL_COLUMNS} FROM signals WHERE detector = 'prr'")
def signals_prr(spark, sf):
    return rounded(detectors.proportional_reporting_ratio(contingency.contingency(observations(spark, sf, "part"))), "score", "lower_bound", "upper_bound", "chi_square")


@query("signals_ranked", f"WITH {cells_sql(observations_sql())}, {SIGNALS} SELECT {SIGNAL_COLUMNS} FROM signals")
def signals_ranked(spark, sf):
    return rounded(detectors.ranked(detectors.score(_cells(spark, sf))), "score", "lower_bound", "upper_bound", "chi_square")


@query("signals_filtered_topn", f"WITH {cells_sql(observations_sql('part'))}, {SIGNALS} SELECT {SIGNAL_COLUMNS} FROM (SELECT * FROM signals WHERE detector = 'ror' AND event = 'BUILDING' AND is_potential_signal ORDER BY {SIGNAL_ORDER} LIMIT 20)")
def signals_filtered_topn(spark, sf):
    scores = detectors.score(contingency.contingency(observations(spark, sf, "part")))
    return rounded(serve.answers("signals", scores, 20, detector="ror", event="building", potential=True), "score", "lower_bound", "upper_bound", "chi_square")


@query("signal_totals", f"WITH {cells_sql(observations_sql())}, {SIGNALS} SELECT count(*) AS scores, count(DISTINCT (drug, event)) AS pairs, count_if(is_potential_signal) AS potential_signals, count_if(passes_stability_rule) AS stable_signals FROM signals")
def signal_totals(spark, sf):
    return detectors.totals(detectors.score(_cells(spark, sf)))


@query("review_queue", f"WITH {cells_sql(observations_sql())}, {SIGNALS} SELECT detector, drug, event, CASE WHEN is_potential_signal THEN 'potential' ELSE 'observed' END AS status FROM signals WHERE (contains(drug, '#1') OR contains(event, '#1') OR contains(upper(detector), '#1')) AND NOT is_potential_signal")
def review_queue(spark, sf):
    return serve.queue(detectors.score(_cells(spark, sf)), "#1", "observed").select("detector", "drug", "event", "status")


# ---- normalisation and quality ------------------------------------------------------------------

@query("normalize_term", "SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || chr(9) || chr(10) || p_type || ' ', '[[:space:]]+', ' ', 'g'))) AS term FROM part")
def normalize_term(spark, sf):
    return table(spark, sf, "part").select("p_partkey", nz.normalize_term(F.concat(F.lit("  "), "p_name", F.lit("\t\n"), "p_type", F.lit(" "))).alias("term"))


@query("age_band", """
    WITH y AS (SELECT event_id, TRY_CAST(value AS DOUBLE) * CASE event_id % 7 WHEN 0 THEN 1 / 8760::DOUBLE WHEN 1 THEN 1 / 365::DOUBLE WHEN 2 THEN 1 / 52.1429::DOUBLE WHEN 3 THEN 1 / 12::DOUBLE WHEN 4 THEN 1 WHEN 5 THEN 10 END AS y FROM events),
    z AS (SELECT event_id, CASE WHEN y BETWEEN 0 AND 130 THEN y END AS y FROM y)
    SELECT event_id, round(y, 6) AS years, CASE WHEN y IS NULL THEN 'unknown' WHEN y < 2 THEN '0-1' WHEN y < 18 THEN '2-17' WHEN y < 45 THEN '18-44' WHEN y < 65 THEN '45-64' ELSE '65+' END AS band FROM z""")
def age_band(spark, sf):
    unit = F.when(F.col("event_id") % 7 < 6, (F.col("event_id") % 7 + 800).cast("string"))
    years = nz.age_years(F.col("value").cast("string"), unit)
    return table(spark, sf, "events").select("event_id", F.round(years, 6).alias("years"), nz.age_band(years).alias("band"))


@query("role_sex_map", """
    SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'primary_suspect' WHEN 2 THEN 'secondary_suspect' WHEN 3 THEN 'concomitant' WHEN 4 THEN 'interacting' ELSE 'unknown' END AS role,
           CASE l_linenumber % 4 WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex, CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false END AS serious FROM lineitem""")
def role_sex_map(spark, sf):
    n = F.col("l_linenumber").cast("string")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", nz.drug_role(n).alias("role"), nz.patient_sex((F.col("l_linenumber") % 4).cast("string")).alias("sex"), nz.serious(n).alias("serious"))


VERSIONS = "SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 4 AS version FROM events"
KINDS = f"""
    v AS ({VERSIONS}),
    k AS (SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
                 row_number() OVER (PARTITION BY user_id ORDER BY version DESC, event_id) AS place FROM v)"""


def versions(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", (F.floor("value") % 4).alias("version"))


@query("latest_version", f"WITH {KINDS} SELECT event_id, user_id, version FROM k WHERE place = 1")
def latest_version(spark, sf):
    return quality.latest(versions(spark, sf), "user_id", "version", ["event_id"])


@query("dedupe_counts", f"WITH {KINDS} SELECT CASE WHEN best IS NULL THEN 'first' WHEN best = version THEN 'duplicate' ELSE 'followup' END AS kind, count(*) AS n FROM k GROUP BY ALL")
def dedupe_counts(spark, sf):
    return quality.classified(versions(spark, sf), "user_id", "version", ["event_id"]).groupBy("kind").agg(F.count("*").alias("n"))


def reports_json(spark, sf):
    """Orders as raw report records, some of them broken in ways that the order key decides."""
    k = F.col("o_orderkey")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p"), "l_returnflag", "l_linestatus"))).alias("lines"))
    drug = lambda x: F.concat(F.lit('{"medicinalproduct":" part  '), x["p"], F.lit('","drugcharacterization":"'), x["l_linenumber"].cast("string"), F.lit('"}'))
    reaction = lambda x: F.concat(F.lit('{"reactionmeddrapt":"'), x["l_returnflag"], F.lit(" "), x["l_linestatus"], F.lit('"}'))
    payload = F.concat(
        F.lit('{"safetyreportid":'), F.when(k % 11 == 0, F.lit('" "')).when(k % 11 == 1, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"'))),
        F.when(k % 13 == 0, F.lit(',"safetyreportversion":null')).when(k % 13 == 1, F.lit(',"safetyreportversion":"2.5"')).when(k % 13 < 5, F.lit(',"safetyreportversion":"2"')).otherwise(F.lit("")),
        F.lit(',"receivedate":"'), F.when(k % 17 == 0, F.lit("19960230")).otherwise(F.date_format("o_orderdate", "yyyyMMdd")), F.lit('","serious":"1","patient":{"drug":['),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.array_join(F.transform("lines", drug), ",")), F.lit('],"reaction":['), F.array_join(F.transform("lines", reaction), ","), F.lit("]}}"),
    )
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("page-0").alias("page"), k.alias("index"), payload.alias("payload"))


FAULTS = """
    f AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS received_date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    r AS (SELECT k, unnest(list_filter([
            CASE WHEN k % 11 < 2 THEN 'safetyreportid: blank or not a string' END, CASE WHEN k % 13 < 2 THEN 'safetyreportversion: not a whole number from 1' END,
            CASE WHEN k % 17 = 0 THEN 'receivedate: not a calendar day' END, CASE WHEN k % 19 = 0 THEN 'patient.drug: no entry' END], lambda x: x IS NOT NULL)) AS reason FROM f)"""


@query("reject_reasons", f"WITH {FAULTS} SELECT k AS index, reason FROM r")
def reject_reasons(spark, sf):
    return quality.validate_reports(reports_json(spark, sf)).select("index", F.explode("reasons").alias("reason"))


@query("curated_pairs", f"""
    WITH {FAULTS}, ok AS (SELECT * FROM f WHERE k NOT IN (SELECT k FROM r)),
    d AS (SELECT DISTINCT l_orderkey AS k, 'PART ' || l_partkey AS drug_name, CASE l_linenumber WHEN 1 THEN 'primary_suspect' WHEN 2 THEN 'secondary_suspect' WHEN 3 THEN 'concomitant' WHEN 4 THEN 'interacting' ELSE 'unknown' END AS drug_role FROM lineitem),
    e AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || ' ' || l_linestatus AS reaction FROM lineitem)
    SELECT CAST(k AS VARCHAR) AS report_id, CASE WHEN k % 13 BETWEEN 2 AND 4 THEN 2 ELSE 1 END AS version, received_date, drug_name, drug_role, reaction FROM ok JOIN d USING (k) JOIN e USING (k)""")
def curated_pairs(spark, sf):
    out = quality.process_reports(reports_json(spark, sf), "2024-01-01")["curated"]
    return out.select("report_id", "version", "received_date", "drug_name", "drug_role", "reaction")


@query("quality_checks", f"""
    WITH {FAULTS}, c AS (SELECT count(*) AS n, count_if(k NOT IN (SELECT k FROM r)) AS valid, least(round(avg((k % 19 <> 0)::INT), 4), 1.0) AS least, max(received_date) FILTER (k NOT IN (SELECT k FROM r)) AS newest FROM f),
    p AS (SELECT count(*) AS rows FROM (SELECT DISTINCT l_orderkey, l_partkey, least(l_linenumber, 5) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM r)) d JOIN (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) e USING (l_orderkey))
    SELECT 'non_empty_input' AS name, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, n::DOUBLE AS observed, '> 0' AS threshold FROM c
    UNION ALL SELECT 'schema_validity_rate', CASE WHEN valid / n >= 0.95 THEN 'pass' ELSE 'warn' END, round(valid / n, 4), '>= 0.95' FROM c
    UNION ALL SELECT 'required_field_completeness', CASE WHEN least >= 0.95 THEN 'pass' ELSE 'warn' END, least, '>= 0.95 for every required field' FROM c
    UNION ALL SELECT 'curated_output', CASE WHEN rows > 0 THEN 'pass' ELSE 'fail' END, rows, '> 0' FROM p
    UNION ALL SELECT 'snapshot_freshness', 'observed', date_diff('day', newest, DATE '2024-01-01'), NULL FROM c""")
def quality_checks(spark, sf):
    return quality.process_reports(reports_json(spark, sf), "2024-01-01")["checks"]


@query("completeness", """
    SELECT 'text' AS field, round(avg((coalesce(text, '') <> '')::INT), 4) AS share FROM documents UNION ALL SELECT 'lang', round(avg((coalesce(lang, '') <> '')::INT), 4) FROM documents
    UNION ALL SELECT 'quality', round(avg((l.doc_id IS NOT NULL)::INT), 4) FROM documents d LEFT JOIN labels l USING (doc_id)""")
def completeness(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return quality.completeness(rows, {"text": F.col("text") != "", "lang": F.col("lang") != "", "quality": F.col("quality").isNotNull()})


def samples_json(spark, sf):
    k, v = F.col("event_id"), F.round("value", 2)
    payload = F.to_json(F.struct(
        (k % 5000).cast("string").alias("record_id"), F.concat(F.lit("site "), (F.col("user_id") % 40).cast("string")).alias("site"), F.when(k % 29 == 0, F.lit(" ")).otherwise(F.lit("ca ")).alias("state_territory"), F.lit("cdc  nwss").alias("source"),
        F.col("user_id").cast("string").alias("sample_id"), F.date_format("ts", "yyyy-MM-dd").alias("sample_collect_date"), F.lower("event_type").alias("pcr_target"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date_updated"),
        F.when(k % 31 == 0, F.lit("-1")).when(k % 3 > 0, v.cast("string")).alias("pcr_target_avg_conc"), F.when(k % 2 == 0, "Yes").when(k % 3 == 0, "no").alias("pcr_target_detect"),
    ))
    return table(spark, sf, "events").select(F.lit("page-0").alias("page"), k.alias("index"), payload.alias("payload"))


@query("wastewater_curated", """
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_id % 5000 ORDER BY date_trunc('second', ts) DESC, event_id) AS place FROM events WHERE event_id % 29 <> 0 AND event_id % 31 <> 0)
    SELECT CAST(event_id % 5000 AS VARCHAR) AS record_id, 'site ' || (user_id % 40) AS site_id, 'CA' AS state_territory, 'CDC NWSS' AS reporting_source, CAST(user_id AS VARCHAR) AS sample_id, CAST(ts AS DATE) AS sample_collect_date,
           upper(event_type) AS pathogen, CASE WHEN event_id % 3 > 0 THEN round(value, 2) END AS concentration, CASE WHEN event_id % 2 = 0 THEN true WHEN event_id % 3 = 0 THEN false END AS target_detected
    FROM s WHERE place = 1""")
def wastewater_curated(spark, sf):
    out = quality.process_samples(samples_json(spark, sf), "2024-03-01")["curated"]
    return out.select("record_id", "site_id", "state_territory", "reporting_source", "sample_id", "sample_collect_date", "pathogen", "concentration", "target_detected")


# ---- temporal -----------------------------------------------------------------------------------

QUARTERLY = "SELECT *, year(received_date) || '-Q' || quarter(received_date) AS quarter FROM ({0})"


def features_sql(drug: str = "brand") -> str:
    return f"""{cells_sql(QUARTERLY.format(observations_sql(drug)), 'quarter', True)},
    grave AS (SELECT quarter, drug, event, count(DISTINCT report_id) AS grave FROM obs WHERE serious GROUP BY ALL),
    features AS (SELECT drug, event, quarter, last_day(make_date(left(quarter, 4)::INT, right(quarter, 1)::INT * 3, 1)) AS quarter_end, a AS report_count, n AS total_reports, a / n AS reporting_share,
        (a - lag(a, 1, 0) OVER w) / greatest(lag(a, 1, 0) OVER w, 1) AS growth, CASE WHEN a > 0 THEN coalesce(grave, 0) / a ELSE 0 END AS serious_proportion, {ROR} AS ror, {PRR} AS prr
        FROM {FIXED.format('t')} LEFT JOIN grave USING (quarter, drug, event) WINDOW w AS (PARTITION BY drug, event ORDER BY quarter))"""


FLOATS = ["reporting_share", "growth", "serious_proportion", "ror", "prr"]


@query("quarter_features", f"WITH {features_sql()} SELECT drug, event, quarter, quarter_end, report_count, total_reports, {', '.join(f'round({x}, 6) AS {x}' for x in FLOATS)} FROM features")
def quarter_features(spark, sf):
    return rounded(temporal.quarterly_features(*numbered(spark, sf)), *FLOATS)


@query("dense_zero_quarters", f"WITH {features_sql('part')} SELECT quarter, count(*) AS pairs, count_if(report_count = 0) AS empty_pairs, round(sum(growth), 4) AS growth FROM features GROUP BY quarter")
def dense_zero_quarters(spark, sf):
    rows = temporal.quarterly_features(observations(spark, sf, "part"))
    return rows.groupBy("quarter").agg(F.count("*").alias("pairs"), F.count_if(F.col("report_count") == 0).alias("empty_pairs"), F.round(F.sum("growth"), 4).alias("growth"))


CHANGES = """
    h AS (SELECT x.drug, x.event, x.quarter, x.report_count, y.report_count AS past FROM features x LEFT JOIN features y ON x.drug = y.drug AND x.event = y.event AND y.quarter < x.quarter),
    m AS (SELECT drug, event, quarter, any_value(report_count) AS report_count, count(past) AS n, median(past::DOUBLE) AS mid FROM h GROUP BY ALL),
    s AS (SELECT m.drug, m.event, m.quarter, any_value(m.report_count) AS report_count, any_value(n) AS n, any_value(mid) AS mid, median(abs(past - mid)) AS mad FROM m JOIN h USING (drug, event, quarter) GROUP BY ALL),
    changes AS (SELECT drug, event, quarter, CASE WHEN n >= 3 THEN (report_count - mid) / greatest(1.4826 * mad, 1) ELSE 0 END AS change_score, n AS baseline_quarters FROM s)"""


@query("change_points", f"WITH {features_sql()}, {CHANGES} SELECT drug, event, quarter, round(change_score, 6) AS change_score, change_score >= 3.5 AS is_change_point, baseline_quarters FROM changes")
def change_points(spark, sf):
    return rounded(temporal.change_points(temporal.quarterly_features(*numbered(spark, sf))), "change_score")


def _features(spark, sf):
    """Quarterly features, made once: what scales, scores and ranks them reads them several times."""
    return written(temporal.quarterly_features(*numbered(spark, sf)), "features")


@query("temporal_filtered", f"WITH {features_sql()}, {CHANGES} SELECT drug, event, quarter, round(change_score, 6) AS change_score, baseline_quarters FROM changes WHERE drug = 'BRAND#11' AND change_score >= 3.5 ORDER BY quarter, drug, event LIMIT 50")
def temporal_filtered(spark, sf):
    rows = serve.answers("temporal", temporal.change_points(temporal.quarterly_features(*numbered(spark, sf))), 50, drug="brand#11", changes=True)
    return rounded(rows, "change_score").select("drug", "event", "quarter", "change_score", "baseline_quarters")


VECTOR = "report_count::DOUBLE AS report_count, reporting_share, growth, serious_proportion, ln(1 + ror) AS log_ror, ln(1 + prr) AS log_prr"


@query("robust_scale", f"""WITH {features_sql()}, v AS (SELECT drug, event, quarter, {VECTOR} FROM features),
    q AS (SELECT {', '.join(f'quantile_cont({x}, [0.25, 0.5, 0.75]) AS q_{x}' for x in temporal.FEATURES)} FROM v)
    SELECT drug, event, quarter, {', '.join(f'round(({x} - q_{x}[2]) / CASE WHEN q_{x}[3] = q_{x}[1] THEN 1 ELSE q_{x}[3] - q_{x}[1] END, 6) AS scaled_{x}' for x in temporal.FEATURES)} FROM v CROSS JOIN q""")
def robust_scale(spark, sf):
    return rounded(temporal.robust_scale(_features(spark, sf)), *[f"scaled_{x}" for x in temporal.FEATURES])


SCALED = f"""{features_sql()}, v AS (SELECT drug, event, quarter, {VECTOR} FROM features),
    q AS (SELECT {', '.join(f'quantile_cont({x}, [0.25, 0.5, 0.75]) AS q_{x}' for x in temporal.FEATURES)} FROM v)"""


@query("feature_contributions", f"""WITH {SCALED}, e AS (
    {' UNION ALL '.join(f"SELECT drug, event, quarter, {i} AS feature, '{x}' AS name, round(abs(({x} - q_{x}[2]) / CASE WHEN q_{x}[3] = q_{x}[1] THEN 1 ELSE q_{x}[3] - q_{x}[1] END), 6) AS value FROM v CROSS JOIN q" for i, x in enumerate(temporal.FEATURES))})
    SELECT drug, event, quarter, (row_number() OVER (PARTITION BY drug, event, quarter ORDER BY value DESC, feature) - 1)::INT AS place, name, value FROM e""")
def feature_contributions(spark, sf):
    rows = temporal.contributions(temporal.robust_scale(_features(spark, sf)))
    return rows.select("drug", "event", "quarter", F.posexplode("contributions").alias("place", "c")).select("drug", "event", "quarter", "place", "c.name", "c.value")


# all rows judged by a forest of all rows, and each quarter by a forest of the quarters before
WHOLE = f"""fits AS (SELECT 'all' AS point, drug, event, quarter, {VECTOR} FROM features), rows AS (SELECT * FROM fits)"""
PAST = f"""v AS (SELECT drug, event, quarter, {VECTOR} FROM features),
    points AS (SELECT DISTINCT x.quarter AS point FROM features x WHERE (SELECT count(*) FROM features y WHERE y.quarter < x.quarter) >= {forest.MINIMUM_TRAINING_ROWS}),
    fits AS (SELECT point, v.* FROM points JOIN v ON v.quarter < point), rows AS (SELECT point, v.* FROM points JOIN v ON v.quarter = point)"""


def forest_sql(rows: str) -> str:
    """CTEs ending in isolation (point, drug, event, quarter, isolation): trees of ``fits`` are grown level by level, and ``rows`` walk them."""
    names, levels = temporal.FEATURES, range(8)
    scaled = ", ".join(f"round(({x} - q_{x}[2]) / CASE WHEN q_{x}[3] = q_{x}[1] THEN 1 ELSE q_{x}[3] - q_{x}[1] END, {forest.PLACES})" for x in names)
    draw = lambda of, first: f"('0x' || substr(md5('{forest.SEED}:' || {of}), {first}, 8))::BIGINT"
    path = lambda n: f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.57721566490153286) - 2 * ({n} - 1) / {n}::DOUBLE END"
    node = "tree || ':' || node"
    split = f"""CASE WHEN size > 1 AND len(able) > 0 AND level < depth THEN able[1 + {draw(node, 1)} % len(able)] END"""
    ends = lambda f: ", ".join(f"{f}(x[{i + 1}])" for i in range(len(names)))
    below = lambda rows: f"2 * {rows}.node + ({rows}.x[n.feature] > n.cut)::INT"
    grown = ", ".join(
        f"""n{i} AS MATERIALIZED (SELECT point, tree, node, size, feature, lo[feature] + ({draw(node, 9)} + 0.5) / 4294967296 * (hi[feature] - lo[feature]) AS cut FROM (
            SELECT *, {split} AS feature FROM (SELECT *, list_filter(range(1, {len(names) + 1}), lambda f: hi[f] > lo[f]) AS able, {i} AS level FROM (
            SELECT point, tree, node, count(*) AS size, [{ends('min')}] AS lo, [{ends('max')}] AS hi FROM g{i} GROUP BY ALL) JOIN sizes USING (point)))),
        g{i + 1} AS MATERIALIZED (SELECT g.point, g.tree, {below('g')} AS node, g.x FROM g{i} g JOIN n{i} n ON n.point = g.point AND n.tree = g.tree AND n.node = g.node WHERE n.feature IS NOT NULL)"""
        for i in [*levels, 8]
    )
    walked = ", ".join(
        f"""w{i + 1} AS (SELECT w.point, w.drug, w.event, w.quarter, w.tree, w.x, CASE WHEN n.feature IS NULL THEN w.node ELSE {below('w')} END AS node
            FROM w{i} w LEFT JOIN n{i} n ON n.point = w.point AND n.tree = w.tree AND n.node = w.node)"""
        for i in levels
    )
    return f"""{features_sql()}, {rows},
    q AS (SELECT point, count(*) AS fitted, {', '.join(f'quantile_cont({x}, [0.25, 0.5, 0.75]) AS q_{x}' for x in names)} FROM fits GROUP BY point),
    sizes AS (SELECT point, least(fitted, {forest.SUBSAMPLE}) AS drawn, ceil(log2(least(fitted, {forest.SUBSAMPLE}))) AS depth FROM q),
    pool AS MATERIALIZED (SELECT point, [{scaled}] AS x, row_number() OVER (PARTITION BY point ORDER BY ('0x' || left(md5('{forest.SEED}:' || drug || ':' || event || ':' || quarter), 15))::BIGINT, drug, event, quarter) AS place
             FROM fits JOIN q USING (point) QUALIFY place <= {forest.POOL}),
    deals AS (SELECT i AS tree, 1 + {draw('i', 1)} % {forest.PRIME - 1} AS a, {draw('i', 9)} AS b FROM range({forest.TREES}) r(i)),
    g0 AS MATERIALIZED (SELECT point, tree, 1 AS node, x FROM pool CROSS JOIN deals QUALIFY row_number() OVER (PARTITION BY point, tree ORDER BY (place * a + b) % {forest.PRIME}) <= {forest.SUBSAMPLE}),
    {grown},
    nodes AS ({' UNION ALL '.join(f'SELECT point, tree, node, size FROM n{i}' for i in [*levels, 8])}),
    w0 AS (SELECT point, drug, event, quarter, tree, [{scaled}] AS x, 1 AS node FROM rows JOIN q USING (point) CROSS JOIN deals),
    {walked},
    isolation AS (SELECT point, drug, event, quarter, pow(2, -avg(floor(log2(node)) + {path('size')}) / any_value({path('drawn')})) AS isolation FROM w8 JOIN nodes USING (point, tree, node) JOIN sizes USING (point) GROUP BY point, drug, event, quarter)"""


# equal rows' means differ in the last bits by the order of DuckDB's sums, so the threshold is compared to nine places
ANOMALIES = f"""{forest_sql(WHOLE)}, anomalies AS (SELECT drug, event, quarter, round(isolation - cut, 6) + 0 AS anomaly_score, round(isolation, 9) > round(cut, 9) AS is_anomaly
    FROM isolation CROSS JOIN (SELECT quantile_cont(isolation, {1 - forest.CONTAMINATION}) AS cut FROM isolation))"""


@query("isolation_forest", f"WITH {ANOMALIES} SELECT * FROM anomalies")
def isolation_forest(spark, sf):
    return rounded(forest.isolation_forest(_features(spark, sf)), "anomaly_score")


@query("temporal_anomalies", f"""WITH {ANOMALIES}, {CHANGES} SELECT drug, event, quarter, round(change_score, 6) AS change_score, change_score >= 3.5 AS is_change_point, baseline_quarters, anomaly_score, is_anomaly
    FROM changes JOIN anomalies USING (drug, event, quarter) WHERE drug = 'BRAND#11' AND is_anomaly ORDER BY quarter, drug, event LIMIT 50""")
def temporal_anomalies(spark, sf):
    """Anomalies of one drug in the order of the temporal answers."""
    features = _features(spark, sf)
    rows = temporal.change_points(features).join(forest.isolation_forest(features), ["drug", "event", "quarter"])
    return rounded(serve.answers("temporal", rows, 50, drug="brand#11", anomalies=True), "change_score", "anomaly_score")


@query("walk_forward_forest", f"WITH {forest_sql(PAST)} SELECT quarter, drug, event, round(isolation - {forest.OFFSET}, 6) + 0 AS score FROM isolation")
def walk_forward_forest(spark, sf):
    return rounded(forest.walk_forward(_features(spark, sf)), "score")


# ---- backtest -----------------------------------------------------------------------------------

def references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REFERENCES)], "entry int, reference_id string, signal_quarter string, drug string, event string, match_method string")


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


REFERENCE_SQL = f"""refs AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(_literal(v) for v in (i, *r)) + ')' for i, r in enumerate(REFERENCES))}) AS x(entry, reference_id, signal_quarter, drug, event, match_method))"""
BACKTEST = f"""{features_sql()}, {REFERENCE_SQL},
    inw AS (SELECT * FROM refs WHERE match_method <> 'unmatched' AND signal_quarter IN (SELECT quarter FROM features)),
    sc AS (SELECT quarter, 'report_count' AS detector, drug, event, report_count::DOUBLE AS score FROM features UNION ALL SELECT quarter, 'ror', drug, event, ror FROM features UNION ALL SELECT quarter, 'prr', drug, event, prr FROM features),
    rk AS (SELECT *, row_number() OVER (PARTITION BY quarter, detector ORDER BY round(score, 9) DESC, drug, event) AS rank FROM sc),
    al AS (SELECT * FROM rk WHERE rank <= {K}),
    qm AS (SELECT g.quarter, g.detector, true AS available, {K} AS k, count(DISTINCT i.reference_id) AS eligible, count(al.rank) AS hits, least({K}, any_value(g.n)) AS alerts
           FROM (SELECT quarter, detector, count(*) AS n FROM sc GROUP BY ALL) g LEFT JOIN inw i ON i.signal_quarter = g.quarter LEFT JOIN al ON al.quarter = g.quarter AND al.detector = g.detector AND al.drug = i.drug AND al.event = i.event GROUP BY g.quarter, g.detector),
    ld AS (SELECT detector, reference_id, left(signal_quarter, 4)::INT * 4 + right(signal_quarter, 1)::INT - (left(min(quarter), 4)::INT * 4 + right(min(quarter), 1)::INT) AS lead_quarters FROM al JOIN inw USING (drug, event) WHERE quarter <= signal_quarter GROUP BY detector, reference_id, signal_quarter)"""


def _scored(spark, sf):
    features = _features(spark, sf)
    # ranks are by nine places, so that ties don't depend on the last bit of a float
    scores = backtest.detector_scores(features).withColumn("score", F.round("score", 9))
    return features, scores, backtest.in_window(references(spark), features)


@query("rank_by_detector", f"WITH {BACKTEST} SELECT quarter, detector, rank, drug, event, round(round(score, 9), 6) AS score, len(ids) > 0 AS is_reference_signal, array_to_string(ids, ',') AS matched FROM (SELECT rk.*, (SELECT coalesce(list(reference_id ORDER BY entry), []) FROM inw i WHERE i.signal_quarter = rk.quarter AND i.drug = rk.drug AND i.event = rk.event) AS ids FROM rk)")
def rank_by_detector(spark, sf):
    _, scores, refs = _scored(spark, sf)
    return rounded(backtest.rankings(scores, refs), "score").withColumn("matched", F.array_join("matched_reference_ids", ",")).drop("matched_reference_ids")


@query("recall_precision_at_k", f"WITH {BACKTEST} SELECT quarter, detector, available, k, eligible, hits, alerts, CASE WHEN eligible > 0 THEN round(hits / eligible, 6) END AS recall_at_k, CASE WHEN eligible > 0 AND alerts > 0 THEN round(hits / alerts, 6) END AS precision_at_k FROM qm")
def recall_precision_at_k(spark, sf):
    return rounded(backtest.quarter_metrics(*_scored(spark, sf), K, list(backtest.STATISTICS)), "recall_at_k", "precision_at_k")


@query("lead_time", f"WITH {BACKTEST} SELECT * FROM ld")
def lead_time(spark, sf):
    _, scores, refs = _scored(spark, sf)
    return backtest.lead_times(scores, refs, K)


@query("lead_time_all", f"WITH {BACKTEST} SELECT detector, reference_id, left(signal_quarter, 4)::INT * 4 + right(signal_quarter, 1)::INT - (left(min(quarter), 4)::INT * 4 + right(min(quarter), 1)::INT) AS lead_quarters FROM sc JOIN inw USING (drug, event) WHERE quarter <= signal_quarter GROUP BY detector, reference_id, signal_quarter")
def lead_time_all(spark, sf):
    """Every scored pair is an alert, not only the best of its quarter."""
    _, scores, refs = _scored(spark, sf)
    return backtest.lead_times(scores, refs, None)


@query("detector_summary", f"""WITH {BACKTEST} SELECT q.*, coalesce(l.n, 0) AS detected_with_lead_time, l.median_lead_quarters, CASE WHEN eligible_references > 0 THEN round(hits / eligible_references, 6) END AS recall_at_k, CASE WHEN alert_burden > 0 THEN round(hits / alert_burden, 6) END AS precision_at_k
    FROM (SELECT detector, count(*) AS evaluated_quarters, sum(eligible)::BIGINT AS eligible_references, sum(hits)::BIGINT AS hits, sum(alerts)::BIGINT AS alert_burden FROM qm GROUP BY detector) q LEFT JOIN (SELECT detector, count(*) AS n, median(lead_quarters::DOUBLE) AS median_lead_quarters FROM ld GROUP BY detector) l USING (detector)""")
def detector_summary(spark, sf):
    return rounded(backtest.detector_summary(*_scored(spark, sf), K, list(backtest.STATISTICS)), "recall_at_k", "precision_at_k")


@query("match_coverage", f"WITH {features_sql()}, {REFERENCE_SQL} SELECT match_method, count(*) AS entries, count_if(match_method <> 'unmatched' AND signal_quarter NOT IN (SELECT quarter FROM features)) AS out_of_window FROM refs GROUP BY match_method")
def match_coverage(spark, sf):
    return backtest.coverage(references(spark), _features(spark, sf))


# ---- adjusted -----------------------------------------------------------------------------------

PROFILE_SQL = """SELECT o.report_id, upper(drug) AS drug, upper(event) AS event, 'age=' || age_group || '|sex=' || sex || '|year=' || year AS stratum, age_group, sex, year FROM ({0}) o""".format(observations_sql("brand", "flag"))
PAIRS = "(SELECT DISTINCT x.drug, y.event FROM obs x JOIN obs y USING (report_id))"
STRATA = cells_sql(PROFILE_SQL, "stratum", PAIRS, "WHERE n >= 4")
BOUNDS = "round(exp(ln({0}) - 1.96 * {1}), 6) AS lower_bound, round(exp(ln({0}) + 1.96 * {1}), 6) AS upper_bound"


def _profiles(spark, sf):
    """Reports of brands and flags, and their terms."""
    obs, terms = numbered(spark, sf, "brand", "flag", upper=True)
    return adjusted.profiles(obs, terms), terms


def _pooled(spark, sf):
    """Cells of all strata together."""
    reports, terms = _profiles(spark, sf)
    return contingency.tables(reports, pairs="report", terms=terms)


@query("crude_ror", f"WITH {cells_sql(PROFILE_SQL)} SELECT drug, event, a, b, c, d, round({ROR}, 6) AS ror, {BOUNDS.format(ROR, ROR_SE)} FROM {FIXED.format('t')}")
def crude_ror(spark, sf):
    return rounded(adjusted.crude(_pooled(spark, sf)), "ror", "lower_bound", "upper_bound")


@query("stratum_tables", f"WITH {STRATA} SELECT stratum, drug, event, n AS reports, a AS cases, round({ROR}, 6) AS ror, {BOUNDS.format(ROR, ROR_SE)}, round({PRR}, 6) AS prr FROM {FIXED.format('t')}")
def stratum_tables(spark, sf):
    return rounded(adjusted.stratum_estimates(adjusted.stratum_tables(*_profiles(spark, sf))), "ror", "lower_bound", "upper_bound", "prr")


@query("mantel_haenszel", f"""WITH {STRATA}, z AS (SELECT drug, event, a + h AS a, b + h AS b, c + h AS c, d + h AS d, a + b + c + d + 4 * h AS t FROM {FIXED.format('t')}),
    y AS (SELECT drug, event, sum(a * d / t) AS r, sum(b * c / t) AS s, sum((a + d) * a * d / (t * t)) AS x1, sum(((a + d) * b * c + (b + c) * a * d) / (t * t)) AS x2, sum((b + c) * b * c / (t * t)) AS x3 FROM z GROUP BY ALL)
    SELECT drug, event, round(r / s, 6) AS estimate, {BOUNDS.format('(r / s)', 'sqrt(x1 / (2 * r * r) + x2 / (2 * r * s) + x3 / (2 * s * s))')} FROM y""")
def mantel_haenszel(spark, sf):
    return rounded(adjusted.mantel_haenszel(adjusted.stratum_tables(*_profiles(spark, sf))), "estimate", "lower_bound", "upper_bound")


@query("adjusted_filtered", f"WITH {cells_sql(PROFILE_SQL)}, p AS (SELECT drug, event, round({ROR}, 6) AS ror FROM {FIXED.format('t')}) SELECT * FROM p WHERE drug = 'BRAND#23' ORDER BY drug, event LIMIT 10")
def adjusted_filtered(spark, sf):
    return rounded(serve.answers("adjusted", adjusted.crude(_pooled(spark, sf)), 10, drug="Brand#23").select("drug", "event", "ror"), "ror")


HETEROGENEITY = f"""{STRATA}, w AS (SELECT drug, event, ln({ROR}) AS x, 1 / ({ROR_SE} * {ROR_SE}) AS w FROM {FIXED.format('t')}),
    mm AS (SELECT drug, event, sum(x * w) / sum(w) AS mean, count(*) - 1 AS df FROM w GROUP BY ALL),
    het AS (SELECT drug, event, sum(w * (x - mean) * (x - mean)) AS q, any_value(df) AS df FROM w JOIN mm USING (drug, event) GROUP BY ALL)"""


@query("heterogeneity_q", f"WITH {HETEROGENEITY} SELECT drug, event, CASE WHEN df >= 1 THEN round(q, 5) ELSE 0 END AS q, CASE WHEN df >= 1 THEN df ELSE 0 END AS df FROM het")
def heterogeneity_q(spark, sf):
    return adjusted.heterogeneity(adjusted.stratum_estimates(adjusted.stratum_tables(*_profiles(spark, sf)))).withColumn("q", F.round("q", 5))


# the normal distribution's tail by Simpson's rule over 2,000 steps, which is exact to more places than are compared
@query("heterogeneity_p", f"""WITH {HETEROGENEITY}, zz AS (SELECT drug, event, q, df, (pow(q / df, 1 / 3::DOUBLE) - (1 - 2 / (9::DOUBLE * df))) / sqrt(2 / (9::DOUBLE * df)) AS z FROM het WHERE df >= 1),
    pp AS (SELECT drug, event, 0.5 - z / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(i * z / 2000) * (i * z / 2000) / 2))) / sqrt(2 * pi()) AS p FROM zz)
    SELECT drug, event, CASE WHEN df >= 1 THEN round(q, 5) ELSE 0 END AS q, CASE WHEN df >= 1 THEN df ELSE 0 END AS df, round(least(greatest(p, 0), 1), 6) AS p FROM het LEFT JOIN pp USING (drug, event)""")
def heterogeneity_p(spark, sf):
    rows = adjusted.heterogeneity_p(adjusted.heterogeneity(adjusted.stratum_estimates(adjusted.stratum_tables(*_profiles(spark, sf)))))
    return rows.withColumns({"q": F.round("q", 5), "p": F.round("p", 6)})


@query("active_comparator", f"""WITH obs AS ({PROFILE_SQL}), cmp AS (SELECT * FROM (VALUES ('BRAND#11', 'BRAND#12'), ('BRAND#11', 'BRAND#13'), ('BRAND#23', 'BRAND#24')) AS x(drug, comparator)),
    rd AS (SELECT DISTINCT report_id, drug FROM obs), re AS (SELECT DISTINCT report_id, event FROM obs),
    arms AS (SELECT report_id, c.drug, max((rd.drug = c.drug)::INT) AS exposed FROM rd JOIN cmp c ON rd.drug = c.drug OR rd.drug = c.comparator GROUP BY ALL),
    sz AS (SELECT drug, sum(exposed) AS n1, count(*) AS n FROM arms GROUP BY drug),
    ca AS (SELECT drug, event, sum(exposed) AS a, sum(1 - exposed) AS c FROM arms JOIN re USING (report_id) GROUP BY ALL),
    pr AS (SELECT DISTINCT rd.drug, re.event FROM rd JOIN re USING (report_id) WHERE rd.drug IN (SELECT drug FROM cmp)),
    t AS (SELECT drug, event, coalesce(a, 0)::BIGINT AS a, (n1 - coalesce(a, 0))::BIGINT AS b, coalesce(c, 0)::BIGINT AS c, (n - n1 - coalesce(c, 0))::BIGINT AS d, n AS reports_used FROM pr LEFT JOIN ca USING (drug, event) JOIN sz USING (drug))
    SELECT drug, event, a, b, c, d, reports_used, round({ROR}, 6) AS estimate, {BOUNDS.format(ROR, ROR_SE)} FROM {FIXED.format('t')}""")
def active_comparator(spark, sf):
    sets = spark.createDataFrame([("brand#11", "Brand#12"), ("brand#11", "Brand#13"), ("brand#23", "Brand#24")], "drug string, comparator string")
    return rounded(adjusted.active_comparator(_profiles(spark, sf)[0], sets), "estimate", "lower_bound", "upper_bound")


@query("bitmap_comparator", ORACLE["active_comparator"])
def bitmap_comparator(spark, sf):
    store = Scratch(spark)
    obs = store.written(observations(spark, sf, "brand", "flag").select("report_id", F.upper("drug").alias("drug"), F.upper("event").alias("event")), "bitmap-rows")  # read twice
    sets = spark.createDataFrame([("brand#11", "Brand#12"), ("brand#11", "Brand#13"), ("brand#23", "Brand#24")], "drug string, comparator string")
    return rounded(bitmaps.active_comparator(store.written(bitmaps.built(obs, store), "report-bitmaps"), sets), "estimate", "lower_bound", "upper_bound")


@query("penalized_logistic")
def penalized_logistic(spark, sf):
    return adjusted.penalized_logistic(_profiles(spark, sf)[0])


@query("beta_binomial")
def beta_binomial(spark, sf):
    return adjusted.beta_binomial(_pooled(spark, sf))


# ---- evidence, references, cohorts, audit -------------------------------------------------------

WORDS_SQL = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
PROMPTS = "(VALUES ('The idiot', 'of them'), ('released under', 'MIT License'), ('Der und', 'nicht die'), ('zzz', 'qqq9')) AS p(drug, event)"


def _prompts(spark):
    return spark.createDataFrame([("The idiot", "of them"), ("released under", "MIT License"), ("Der und", "nicht die"), ("zzz", "qqq9")], "drug string, event string")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("content"))


EVIDENCE = f"""
    pq AS (SELECT drug, event, {WORDS_SQL.format("drug || ' ' || event")} AS words FROM {PROMPTS}),
    ev AS (SELECT drug, event, doc_id AS document_id, len(list_intersect(words, {WORDS_SQL.format("concat_ws(' ', source, text)")})) / len(words) AS relevance, text FROM pq CROSS JOIN documents),
    top AS (SELECT *, row_number() OVER (PARTITION BY drug, event ORDER BY relevance DESC, document_id) AS rank FROM ev WHERE relevance > 0)"""


@query("evidence_top5", f"WITH {EVIDENCE} SELECT drug, event, rank, document_id, round(relevance, 6) AS relevance, sha256(left(text, 600)) AS excerpt FROM top WHERE rank <= 5")
def evidence_top5(spark, sf):
    rows = evidence.retrieve(_documents(spark, sf), _prompts(spark))
    return rounded(rows, "relevance").withColumn("excerpt", F.sha2("excerpt", 256))


@query("brief_status", f"WITH {EVIDENCE} SELECT p.drug, p.event, CASE WHEN count(rank) > 0 THEN 'generated' ELSE 'abstained' END AS status, least(count(rank), 5) AS claims, left(sha256(upper(p.drug) || chr(0) || upper(p.event)), 20) AS brief_key FROM {PROMPTS} LEFT JOIN top USING (drug, event) GROUP BY p.drug, p.event")
def brief_status(spark, sf):
    rows = evidence.fail_closed(evidence.template_briefs(_prompts(spark), evidence.retrieve(_documents(spark, sf), _prompts(spark))))
    return rows.select("drug", "event", "status", F.size("claims").cast("long").alias("claims"), "brief_key")


@query("brief_lookup", f"WITH {EVIDENCE} SELECT p.drug, p.event, least(count(rank), 5) AS claims FROM {PROMPTS} LEFT JOIN top USING (drug, event) WHERE upper(p.drug) = 'RELEASED UNDER' AND upper(p.event) = 'MIT LICENSE' GROUP BY p.drug, p.event")
def brief_lookup(spark, sf):
    briefs = evidence.template_briefs(_prompts(spark), evidence.retrieve(_documents(spark, sf), _prompts(spark)))
    return serve.brief(briefs, "Released Under", "mit license").select("drug", "event", F.size("claims").cast("long").alias("claims"))


@query("brief_validation", r"SELECT item_id, regexp_matches(text || CASE item_id % 6 WHEN 0 THEN ' It Causes harm.' WHEN 1 THEN ' proven' WHEN 2 THEN ' change your dose' WHEN 3 THEN ' they are unsafe' ELSE '' END, '(?i)\bcauses?\b|\bproves?\b|\bstop taking\b|\b(start|change) (a |your )?(dose|treatment)\b|\b(is|are) (safe|unsafe)\b') AS unsafe, item_id % 5 = 0 AS unknown_citation FROM benchmark")
def brief_validation(spark, sf):
    k = F.col("item_id")
    text = F.concat("text", F.when(k % 6 == 0, " It Causes harm.").when(k % 6 == 1, " proven").when(k % 6 == 2, " change your dose").when(k % 6 == 3, " they are unsafe").otherwise(""))
    claims = F.array(F.struct(text.alias("text"), F.array(F.when(k % 5 == 0, "other").otherwise("known")).alias("citation_ids")))
    briefs = table(spark, sf, "benchmark").select("item_id", F.lit("generated").alias("status"), F.lit("Head").alias("headline"), F.lit("Unsure").alias("uncertainty"), claims.alias("claims"), F.array(F.lit("known")).alias("evidence_ids"))
    return evidence.violations(briefs).select("item_id", F.array_contains("errors", "causal, safety or treatment language").alias("unsafe"), F.exists("errors", lambda e: e.startswith("claim ")).alias("unknown_citation"))


@query("brief_key", "SELECT DISTINCT p_brand, p_type, left(sha256(upper(p_brand) || chr(0) || upper(p_type)), 20) AS brief_key FROM part")
def brief_key(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type", nz.brief_key(F.col("p_brand"), F.col("p_type")).alias("brief_key")).distinct()


def _entries(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.cast("string").alias("reference_id"), nz.quarter_label(F.col("o_orderdate")).alias("publication_quarter"), F.when(k % 3 == 0, "seeded_unverified").when(k % 3 == 1, "independently_reviewed").otherwise("rejected").alias("review_status"),
        F.when(k % 4 == 0, "unmatched").otherwise("exact").alias("match_method"),
    )


ELIGIBLE = "CASE WHEN o_orderkey % 3 <> 1 THEN 'not_independently_reviewed' WHEN o_orderkey % 4 = 0 THEN 'unmatched_terminology' WHEN year(o_orderdate) * 4 + quarter(o_orderdate) > 1998 * 4 + 2 THEN 'not_yet_published' ELSE 'eligible' END"


@query("benchmark_eligibility", f"SELECT CAST(o_orderkey AS VARCHAR) AS reference_id, {ELIGIBLE} AS reason FROM orders")
def benchmark_eligibility(spark, sf):
    return _entries(spark, sf).select("reference_id", reference.eligibility("1998-Q2").alias("reason"))


@query("eligibility_counts", f"SELECT {ELIGIBLE} AS reason, count(*) AS entries FROM orders GROUP BY ALL")
def eligibility_counts(spark, sf):
    return reference.eligibility_counts(_entries(spark, sf), "1998-Q2")


def _people(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.to_date("o_orderdate")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("person_id"), F.col("l_returnflag").alias("cohort"), day.alias("observation_start"), F.date_add(day, (F.col("l_quantity") * 8).cast("int") - 5).alias("exposure_start"),
        F.date_add(day, 380).alias("observation_end"), F.date_add(F.to_date("l_shipdate"), 60).alias("outcome_date"), (F.col("l_linenumber") * 22 - 20).alias("age"),
    )


PEOPLE = """p AS (SELECT l_orderkey || '-' || l_linenumber AS person_id, l_returnflag AS cohort, CAST(o_orderdate AS DATE) AS os, CAST(o_orderdate AS DATE) + (CAST(trunc(l_quantity * 8) AS INT) - 5) AS xs, CAST(o_orderdate AS DATE) + 380 AS oe,
    CAST(l_shipdate AS DATE) + 60 AS od, l_linenumber * 22 - 20 AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("cohort_violations", f"""WITH {PEOPLE} SELECT person_id, 'exposure outside observation' AS violation FROM p WHERE xs < os OR xs > oe UNION ALL SELECT person_id, 'outcome outside follow-up' FROM p WHERE od < xs OR od > oe
    UNION ALL SELECT person_id, 'age out of range' FROM p WHERE age < 0 OR age > 130""")
def cohort_violations(spark, sf):
    return cohort.timeline_violations(_people(spark, sf))


@query("cohort_set_rules", f"""WITH {PEOPLE}, s AS (SELECT count(*) AS n, count(DISTINCT person_id) AS u, count(DISTINCT cohort) AS c, count_if(xs - os < 180) AS b FROM p)
    SELECT 'repeated person' AS violation, n - u AS found FROM s WHERE u < n UNION ALL SELECT 'not two cohorts', c FROM s WHERE n > 0 AND c <> 2 UNION ALL SELECT 'short baseline', b FROM s WHERE b > 0""")
def cohort_set_rules(spark, sf):
    return cohort.set_violations(_people(spark, sf))


@query("audit_chain", """WITH l AS (SELECT conv_id, turn, conv_id || ':' || turn || ':' || role || ':' || text || chr(10) AS line FROM conversations),
    a AS (SELECT conv_id, turn, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM l)
    SELECT conv_id, turn, CASE WHEN past IS NOT NULL THEN sha256(past) END AS previous_digest FROM a""")
def audit_chain(spark, sf):
    line = F.concat(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text"), F.lit("\n"))
    return audit.chained(table(spark, sf, "conversations").withColumn("line", line), "conv_id", ["turn"], "line").select("conv_id", "turn", "previous_digest")
