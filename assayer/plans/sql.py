"""DuckDB SQL with the rows and columns of the registered queries."""

from __future__ import annotations


def r(x: str, places: int = 6) -> str:
    scale = float(10**places)
    return f"(round_even(({x}) * {scale!r}, 0) / {scale!r} + 0.0)"


RAW = """raw AS (
  SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS JOB_CODE, user_id AS ANALYSED_BY_USER_ID,
    CASE WHEN event_id % 101 <> 0 THEN event_type END AS ANALYTE_CODE,
    CASE event_id % 5 WHEN 0 THEN 'Blank' WHEN 1 THEN 'Standard' WHEN 2 THEN 'Replicate' WHEN 3 THEN 'Duplicate' ELSE 'MatrixSpike' END AS ANALYTICAL_TYPE,
    ts AS ANALYSED_DATE, CAST(value AS DOUBLE) AS NUMERIC_FINAL_VALUE,
    CASE WHEN event_id % 5 IN (2, 3) THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS PARENT_NUMERIC_FINAL_VALUE,
    CAST(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 5 = 1 THEN 35.0 WHEN event_id % 5 = 4 THEN 50.0 END AS DOUBLE) AS INTERNAL_TARGET_VALUE,
    CAST(CASE event_id % 5 WHEN 0 THEN -1.0 WHEN 1 THEN 5.0 END AS DOUBLE) AS INTERNAL_MIN_VALUE,
    CAST(CASE event_id % 5 WHEN 0 THEN 60.0 WHEN 1 THEN 120.0 END AS DOUBLE) AS INTERNAL_MAX_VALUE,
    CAST(NULL AS DOUBLE) AS INTERNAL_MIN_WARNING_VALUE, CAST(NULL AS DOUBLE) AS INTERNAL_MAX_WARNING_VALUE,
    CASE WHEN event_id % 5 = 1 THEN CASE WHEN event_id % 17 = 0 THEN 'Failure' WHEN event_id % 13 = 0 THEN 'Warning' ELSE 'Pass' END END AS STANDARD_STATUS,
    CASE WHEN event_id % 5 IN (2, 3) THEN CASE WHEN event_id % 17 = 0 THEN 'Failure' WHEN event_id % 19 = 0 THEN 'IgnoreFailure' WHEN event_id % 13 = 0 THEN 'Warning' ELSE 'Pass' END END AS PRECISION_STATUS,
    CAST(CASE WHEN event_id % 5 IN (2, 3) THEN 10.0 + 5 * (event_id % 2) END AS DOUBLE) AS LIM_REP_VALUE, CAST(CASE WHEN event_id % 5 IN (2, 3) THEN 15.0 END AS DOUBLE) AS LIM_REP_DUP_VALUE,
    CAST(CASE WHEN event_id % 5 IN (2, 3) THEN 0.025 END AS DOUBLE) AS STAT_DL_VALUE, CAST(CASE WHEN event_id % 5 IN (2, 3) THEN 0.05 END AS DOUBLE) AS STAT_DL_DUP_VALUE,
    'MG_KG' AS UNIT_CODE
  FROM events)"""
#: RAW with missing dates and values, negative targets and warning limits.
EDGE = RAW.replace("raw AS (", "plain AS (") + """, raw AS (
  SELECT * REPLACE (CASE WHEN row_id % 23 <> 0 THEN ANALYSED_DATE END AS ANALYSED_DATE, CASE WHEN row_id % 29 <> 0 AND row_id % 31 <> 0 THEN NUMERIC_FINAL_VALUE END AS NUMERIC_FINAL_VALUE,
    CASE WHEN row_id % 37 <> 0 THEN PARENT_NUMERIC_FINAL_VALUE END AS PARENT_NUMERIC_FINAL_VALUE, CASE WHEN row_id % 11 = 0 THEN -5.0::DOUBLE ELSE INTERNAL_TARGET_VALUE END AS INTERNAL_TARGET_VALUE,
    CASE WHEN row_id % 9 = 0 THEN 10.0::DOUBLE END AS INTERNAL_MIN_WARNING_VALUE, CASE WHEN row_id % 9 = 0 THEN 30.0::DOUBLE END AS INTERNAL_MAX_WARNING_VALUE) FROM plain)"""
NORM = """norm AS (
  SELECT row_id, coalesce(JOB_CODE, 'JOB-UNKNOWN') || '-' || row_id AS SampleID,
    CASE ANALYTICAL_TYPE WHEN 'Replicate' THEN 'Duplicate samples' WHEN 'Duplicate' THEN 'Duplicate samples' WHEN 'Blank' THEN 'Blank samples' WHEN 'Standard' THEN 'Standard samples' ELSE coalesce(ANALYTICAL_TYPE, 'Unknown') END AS SampleType,
    ANALYSED_DATE AS AnalysisDate, NUMERIC_FINAL_VALUE AS Value, INTERNAL_TARGET_VALUE AS ExpectedValue, INTERNAL_MIN_VALUE AS LowerLimit, INTERNAL_MAX_VALUE AS UpperLimit,
    INTERNAL_MIN_WARNING_VALUE AS WarningLower, INTERNAL_MAX_WARNING_VALUE AS WarningUpper, PARENT_NUMERIC_FINAL_VALUE AS ParentValue,
    coalesce(ANALYTE_CODE, 'Unknown') AS Analyte, coalesce(JOB_CODE, 'JOB-UNKNOWN') AS JobCode, coalesce(STANDARD_STATUS, '') AS StandardStatus, coalesce(PRECISION_STATUS, '') AS PrecisionStatus,
    CASE WHEN ANALYTICAL_TYPE IN ('Replicate', 'Duplicate') THEN coalesce(JOB_CODE, 'JOB-UNKNOWN') || '-' || coalesce(ANALYTE_CODE, 'Unknown') END AS DuplicateGroup
  FROM raw)"""
EXP = """expected AS (
  SELECT * REPLACE (coalesce(ExpectedValue, ParentValue, median(Value) OVER (PARTITION BY Analyte, SampleType), median(Value) OVER (PARTITION BY Analyte), (SELECT median(Value) FROM norm)) AS ExpectedValue) FROM norm)"""
LIM = """lim0 AS (
  SELECT *, CASE WHEN LowerLimit IS NOT NULL THEN 'Real' ELSE 'Proxy' END AS LowerLimitSource, CASE WHEN UpperLimit IS NOT NULL THEN 'Real' ELSE 'Proxy' END AS UpperLimitSource,
    coalesce(LowerLimit, ExpectedValue * 0.9::DOUBLE) AS lo, coalesce(UpperLimit, ExpectedValue * 1.1::DOUBLE) AS hi FROM expected),
lim AS (
  SELECT * EXCLUDE (lo, hi) REPLACE (lo AS LowerLimit, hi AS UpperLimit, coalesce(WarningLower, lo + (hi - lo) * 0.1::DOUBLE) AS WarningLower, coalesce(WarningUpper, hi - (hi - lo) * 0.1::DOUBLE) AS WarningUpper)
  FROM lim0 WHERE AnalysisDate IS NOT NULL AND Value IS NOT NULL)"""
RULE = """ruled0 AS (
  SELECT *, CASE WHEN Value < LowerLimit OR Value > UpperLimit OR lower(StandardStatus) LIKE '%failure%' OR lower(PrecisionStatus) LIKE '%failure%' THEN 'Red'
    WHEN Value < WarningLower OR Value > WarningUpper OR lower(StandardStatus) LIKE '%warning%' OR lower(PrecisionStatus) LIKE '%warning%' THEN 'Yellow' ELSE 'Green' END AS RuleFlag FROM lim),
ruled AS (SELECT *, CASE RuleFlag WHEN 'Red' THEN 2 WHEN 'Yellow' THEN 1 ELSE 0 END AS RuleFlagScore FROM ruled0)"""
FEAT = """feat AS (
  SELECT *, Value - ExpectedValue AS Deviation, coalesce((Value - ExpectedValue) / nullif(ExpectedValue, 0) * 100, 0) AS DeviationPct,
    CASE WHEN ParentValue IS NOT NULL AND abs((Value + ParentValue) / 2) > 1e-9 THEN abs(Value - ParentValue) / abs((Value + ParentValue) / 2) * 100 END AS RPD,
    CASE WHEN SampleType = 'MatrixSpike' AND abs(ExpectedValue) > 1e-9 THEN Value / ExpectedValue * 100 END AS RecoveryPct,
    avg(Value) OVER w AS RollingMean, coalesce(stddev_samp(Value) OVER w, 0) AS RollingStd
  FROM ruled WINDOW w AS (PARTITION BY Analyte ORDER BY AnalysisDate, row_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
RISK = f"""risk0 AS (
  SELECT *, {r('''least(greatest(abs(DeviationPct), 0), 40) / 40 * 30 + least(greatest(RollingStd / (SELECT greatest(stddev_samp(RollingStd), 1.0) FROM feat), 0), 3) / 3 * 20
    + least(greatest(coalesce(RPD, 0), 0), 50) / 50 * 20 + least(greatest(CASE WHEN SampleType = 'MatrixSpike' THEN abs(coalesce(RecoveryPct, 100) - 100) ELSE 0 END - 10, 0), 40) / 40 * 15
    + CASE RuleFlag WHEN 'Red' THEN 15 WHEN 'Yellow' THEN 7.5::DOUBLE ELSE 0 END''', 2)} AS RiskScore FROM feat),
risk AS (SELECT *, CASE WHEN RiskScore > -0.01 AND RiskScore <= 30 THEN 'Low' WHEN RiskScore > 30 AND RiskScore <= 60 THEN 'Medium' WHEN RiskScore > 60 AND RiskScore <= 100 THEN 'High' END AS RiskLevel FROM risk0)"""
PAIR_COLUMNS = "NUMERIC_FINAL_VALUE, PARENT_NUMERIC_FINAL_VALUE, ANALYSED_DATE, ANALYTE_CODE, STAT_DL_VALUE, STAT_DL_DUP_VALUE, LIM_REP_VALUE, LIM_REP_DUP_VALUE, UNIT_CODE, PRECISION_STATUS"
PAIRS = f"""pairs AS (SELECT row_id, JOB_CODE, {PAIR_COLUMNS} FROM raw WHERE lower(trim(ANALYTICAL_TYPE)) = 'duplicate')"""
SIGNED = """signed AS (
  SELECT *, abs(NUMERIC_FINAL_VALUE - PARENT_NUMERIC_FINAL_VALUE) AS ABS_DIFF, (NUMERIC_FINAL_VALUE + PARENT_NUMERIC_FINAL_VALUE) / 2 AS MEAN_CONC,
    abs(NUMERIC_FINAL_VALUE - PARENT_NUMERIC_FINAL_VALUE) / nullif((NUMERIC_FINAL_VALUE + PARENT_NUMERIC_FINAL_VALUE) / 2, 0) * 100 AS RPD,
    CASE WHEN (NUMERIC_FINAL_VALUE + PARENT_NUMERIC_FINAL_VALUE) / 2 > 0 THEN ln((NUMERIC_FINAL_VALUE + PARENT_NUMERIC_FINAL_VALUE) / 2) END AS LOG_MEAN FROM pairs),
clicks AS (SELECT * FROM signed WHERE ANALYTE_CODE = 'click'), usable AS (SELECT * FROM clicks WHERE RPD IS NOT NULL AND LOG_MEAN IS NOT NULL)"""
PREPARED = f"WITH {RAW}, {NORM}, {EXP}, {LIM} "
RULED = f"WITH {RAW}, {NORM}, {EXP}, {LIM}, {RULE} "
ALL = f"WITH {RAW}, {NORM}, {EXP}, {LIM}, {RULE}, {FEAT}, {RISK} "
W_RAW = f"WITH {RAW} "
W_PAIRS = f"WITH {RAW}, {PAIRS}, {SIGNED} "
DRILL = "SELECT row_id, ANALYSED_DATE, 'NUMERIC_FINAL_VALUE' AS measure, NUMERIC_FINAL_VALUE AS reading FROM raw WHERE {w} UNION ALL SELECT row_id, ANALYSED_DATE, 'INTERNAL_TARGET_VALUE', INTERNAL_TARGET_VALUE FROM raw WHERE {w}"
IN_2024 = "ANALYSED_DATE >= TIMESTAMP '2024-01-01' AND ANALYSED_DATE < TIMESTAMP '2025-01-01'"
RESULT_COLUMNS = (
    "row_id JOB_CODE ANALYSED_BY_USER_ID ANALYTE_CODE ANALYTICAL_TYPE ANALYSED_DATE NUMERIC_FINAL_VALUE PARENT_NUMERIC_FINAL_VALUE INTERNAL_TARGET_VALUE INTERNAL_MIN_VALUE INTERNAL_MAX_VALUE "
    "INTERNAL_MIN_WARNING_VALUE INTERNAL_MAX_WARNING_VALUE STANDARD_STATUS PRECISION_STATUS LIM_REP_VALUE LIM_REP_DUP_VALUE STAT_DL_VALUE STAT_DL_DUP_VALUE UNIT_CODE"
).split()


def missing(places: int) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS MissingCount, count(*) AS n FROM raw" for c in RESULT_COLUMNS)
    return f"{W_RAW} SELECT column_name, MissingCount, {r('MissingCount::DOUBLE / n * 100', places)} AS MissingPercent FROM ({each}) WHERE MissingCount > 0"


def describe(head: str, table: str, columns: list[str], places: int) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(x) AS n, {r('avg(x)', places)} AS mean, {r('stddev_samp(x)', places)} AS std, {r('min(x)', places)} AS low, "
        + ", ".join(f"{r(f'quantile_cont(x, {q})', places)} AS {n}" for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")))
        + f", {r('max(x)', places)} AS high FROM (SELECT {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL)"
        for c in columns
    )
    return f"{head} {each}"


def histogram(head: str, table: str, column: str, bins: int) -> str:
    return f"""{head} {"," if head else "WITH"} v AS (SELECT {column}::DOUBLE AS x FROM {table} WHERE {column} IS NOT NULL),
s AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS a, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS b FROM v),
c AS (SELECT least(floor((x - a) / ((b - a) / {bins})), {bins - 1})::INT AS bin, count(*) AS n FROM v, s GROUP BY 1)
SELECT k::INT AS bin, {r(f"a + (b - a) / {bins} * k")} AS bin_start, coalesce(n, 0) AS n FROM s, range({bins}) g(k) LEFT JOIN c ON c.bin = k"""


def box(table: str, columns: list[str]) -> str:
    each = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r('any_value(q1)')} AS q1, {r('any_value(med)')} AS med, {r('any_value(q3)')} AS q3, {r('min(x) FILTER (ok)')} AS whisker_low, {r('max(x) FILTER (ok)')} AS whisker_high, count(*) FILTER (NOT ok) AS outliers "
        f"FROM (SELECT x, q1, med, q3, x >= q1 - (q3 - q1) * 1.5::DOUBLE AND x <= q3 + (q3 - q1) * 1.5::DOUBLE AS ok FROM (SELECT {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL), (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS med, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table}))"
        for c in columns
    )
    return each


def profile_by(columns: list[str], places: int) -> str:
    cells = ", ".join(f"count({c}) AS {c}_count, {r(f'avg({c})', places)} AS {c}_mean, {r(f'median({c})', places)} AS {c}_median, {r(f'min({c})', places)} AS {c}_min, {r(f'max({c})', places)} AS {c}_max" for c in columns)
    return f"{RULED} SELECT RuleFlag, {cells} FROM ruled GROUP BY RuleFlag"


def rounded(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"{r(c, places)} AS {c}" for c in columns)


FEATURES = ["Value", "ExpectedValue", "Deviation", "DeviationPct", "RollingMean", "RollingStd", "RPD", "RecoveryPct", "RuleFlagScore"]
MODEL = f"""SELECT row_id, ANALYTE_CODE, ANALYSED_DATE, NUMERIC_FINAL_VALUE, PARENT_NUMERIC_FINAL_VALUE, abs(NUMERIC_FINAL_VALUE - PARENT_NUMERIC_FINAL_VALUE) AS ABS_DIFF,
  (NUMERIC_FINAL_VALUE + PARENT_NUMERIC_FINAL_VALUE) / 2 AS MEAN_CONC, {r("abs(NUMERIC_FINAL_VALUE - PARENT_NUMERIC_FINAL_VALUE) / nullif((NUMERIC_FINAL_VALUE + PARENT_NUMERIC_FINAL_VALUE) / 2, 0) * 100", 2)} AS RPD,
  PRECISION_STATUS, STAT_DL_VALUE, STAT_DL_DUP_VALUE, LIM_REP_VALUE, LIM_REP_DUP_VALUE, UNIT_CODE FROM """
REPS = PAIRS.replace("'duplicate'", "'replicate'")

ORACLES = {
    "qc_normalised": f"WITH {RAW}, {NORM} SELECT * FROM norm",
    "qc_expected_value": f"WITH {RAW}, {NORM}, {EXP} SELECT row_id, {rounded(['ExpectedValue'])} FROM expected",
    "qc_limits": f"{PREPARED} SELECT row_id, {rounded(['ExpectedValue', 'LowerLimit', 'UpperLimit', 'WarningLower', 'WarningUpper'])}, LowerLimitSource, UpperLimitSource FROM lim",
    "qc_rule_flags": f"{RULED} SELECT row_id, SampleType, RuleFlag, RuleFlagScore FROM ruled",
    "qc_rule_summary": f"{RULED} SELECT RuleFlag, count(*) AS n FROM ruled GROUP BY RuleFlag",
    "qc_features": f"{ALL} SELECT row_id, {rounded(['Deviation', 'DeviationPct', 'RPD', 'RecoveryPct'])} FROM feat",
    "qc_rolling": f"{ALL} SELECT row_id, {rounded(['RollingMean', 'RollingStd'])} FROM feat",
    "qc_risk_scores": f"{ALL} SELECT row_id, SampleID, SampleType, Analyte, RuleFlag, RiskScore, RiskLevel FROM risk",
    "qc_risk_summary": f"{ALL} SELECT l.RiskLevel, count(k.row_id) AS Count, {r('count(k.row_id)::DOUBLE / (SELECT count(*) FROM risk) * 100', 2)} AS Percent, risk_rank FROM (VALUES ('Low', 0), ('Medium', 1), ('High', 2)) l(RiskLevel, risk_rank) LEFT JOIN risk k ON k.RiskLevel = l.RiskLevel GROUP BY l.RiskLevel, risk_rank",
    "qc_top10_risk": f"{ALL} SELECT SampleID, SampleType, Analyte, AnalysisDate, Value, RuleFlag, RiskScore, RiskLevel FROM risk ORDER BY RiskScore DESC NULLS LAST, row_id LIMIT 10",
    "qc_risk_by_sample_type": f"{ALL} SELECT SampleType, RiskLevel, count(*) AS n, {r('avg(RiskScore)', 4)} AS mean_score FROM risk GROUP BY SampleType, RiskLevel",
    "feature_imputed": f"{ALL} SELECT row_id, " + ", ".join(f"{r(f'coalesce({c}, (SELECT median({c}) FROM feat), 0)')} AS {c}" for c in FEATURES) + " FROM feat",
    "qc_edge_rows": f"WITH {EDGE}, {NORM}, {EXP}, {LIM}, {RULE}, {FEAT}, {RISK} SELECT row_id, {rounded(['ExpectedValue', 'LowerLimit', 'UpperLimit', 'WarningLower', 'WarningUpper', 'DeviationPct', 'RollingMean'])}, RuleFlag, RiskScore, RiskLevel FROM risk",
    "dup_extract": f"WITH {RAW}, {PAIRS} SELECT * FROM pairs",
    "rep_extract": f"WITH {RAW}, {REPS} SELECT * FROM pairs",
    "dup_model": f"WITH {RAW}, {PAIRS} {MODEL} pairs",
    "rep_model": f"WITH {RAW}, {REPS} {MODEL} pairs",
    "dup_signed_rpd": f"{W_PAIRS} SELECT row_id, {rounded(['ABS_DIFF', 'MEAN_CONC', 'RPD'])} FROM signed",
    "analyte_subset": f"WITH {RAW}, {PAIRS} SELECT * FROM pairs WHERE ANALYTE_CODE = 'click'",
    "log_mean_features": f"{W_PAIRS} SELECT row_id, {rounded(['RPD', 'LOG_MEAN'])} FROM usable",
    "excluded_rows": f"{W_PAIRS} SELECT count(*) AS total, (SELECT count(*) FROM usable) AS usable, count(*) - (SELECT count(*) FROM usable) AS excluded FROM clicks",
    "standardised_features": f"{W_PAIRS} SELECT row_id, {r('coalesce((RPD - avg(RPD) OVER ()) / nullif(stddev_pop(RPD) OVER (), 0), 0)', 5)} AS RPD_z, {r('coalesce((LOG_MEAN - avg(LOG_MEAN) OVER ()) / nullif(stddev_pop(LOG_MEAN) OVER (), 0), 0)', 5)} AS LOG_MEAN_z FROM usable",
    "profile_by_flag": profile_by(["Value", "ExpectedValue"], 5),
    "status_by_flag": f"{RULED} SELECT RuleFlag, PrecisionStatus, count(*) AS n FROM ruled GROUP BY ALL",
    "missing_profile_2dp": missing(2),
    "missing_profile_1dp": missing(1),
    "missing_ranked": f"SELECT column_name, MissingCount, row_number() OVER (ORDER BY MissingCount DESC, column_name) AS place FROM ({missing(2)})",
    "describe_values": describe(PREPARED, "lim", ["Value", "ExpectedValue", "LowerLimit", "UpperLimit"], 2),
    "numeric_columns_describe": describe(W_RAW, "raw", ["ANALYSED_BY_USER_ID", "NUMERIC_FINAL_VALUE", "PARENT_NUMERIC_FINAL_VALUE", "INTERNAL_TARGET_VALUE", "INTERNAL_MIN_VALUE", "INTERNAL_MAX_VALUE", "LIM_REP_VALUE", "LIM_REP_DUP_VALUE", "STAT_DL_VALUE", "STAT_DL_DUP_VALUE"], 4),
    "sample_type_counts": f"{PREPARED} SELECT SampleType, count(*) AS n FROM lim GROUP BY SampleType",
    "analyte_counts": f"{W_RAW} SELECT ANALYTE_CODE, count(*) AS n FROM raw WHERE ANALYTE_CODE IS NOT NULL GROUP BY ANALYTE_CODE",
    "status_counts_with_null": f"{W_RAW} SELECT PRECISION_STATUS, count(*) AS n FROM raw GROUP BY PRECISION_STATUS",
    "hist_30": histogram(PREPARED, "lim", "Value", 30),
    "hist_100": histogram("", "lineitem", "l_extendedprice", 100),
    "box_stats": box("part", ["p_retailprice", "p_size"]),
    "box_stats_results": f"{W_RAW} " + box("raw", ["ANALYSED_BY_USER_ID", *[c for c in RESULT_COLUMNS if c.endswith("_VALUE") and "WARNING" not in c]]),
    "hist_100_blank": histogram(f"WITH {RAW}, year AS (SELECT * FROM raw WHERE ANALYTICAL_TYPE = 'Blank' AND {IN_2024})", "year", "NUMERIC_FINAL_VALUE", 100),
    "hist_100_standard": histogram(f"WITH {RAW}, year AS (SELECT * FROM raw WHERE ANALYTICAL_TYPE = 'Standard' AND {IN_2024})", "year", "NUMERIC_FINAL_VALUE", 100),
    "identity_extent": f"WITH {RAW}, {PAIRS} SELECT least(min(NUMERIC_FINAL_VALUE), min(PARENT_NUMERIC_FINAL_VALUE)) AS low, greatest(max(NUMERIC_FINAL_VALUE), max(PARENT_NUMERIC_FINAL_VALUE)) AS high FROM pairs",
    "date_range": f"{W_RAW} SELECT min(ANALYSED_DATE) AS first, max(ANALYSED_DATE) AS last FROM raw",
    "value_diff": f"{W_RAW} SELECT row_id, {r('NUMERIC_FINAL_VALUE - INTERNAL_TARGET_VALUE')} AS value_diff FROM raw",
    "minmax_norm": f"{W_RAW} SELECT row_id, {r('(NUMERIC_FINAL_VALUE - min(NUMERIC_FINAL_VALUE) OVER ()) / (max(NUMERIC_FINAL_VALUE) OVER () - min(NUMERIC_FINAL_VALUE) OVER () + 1e-9)')} AS norm FROM raw",
    "year_filter_blank": W_RAW + DRILL.format(w=f"ANALYTICAL_TYPE = 'Blank' AND {IN_2024}"),
    "year_filter_standard": W_RAW + DRILL.format(w=f"ANALYTICAL_TYPE = 'Standard' AND {IN_2024}"),
    "user_drilldown": W_RAW + DRILL.format(w=f"ANALYTICAL_TYPE = 'Blank' AND {IN_2024} AND ANALYSED_BY_USER_ID = 5"),
    "user_analyte_drilldown": W_RAW + DRILL.format(w=f"ANALYTICAL_TYPE = 'Standard' AND {IN_2024} AND ANALYSED_BY_USER_ID = 5 AND ANALYTE_CODE = 'click'"),
    "common_users": f"{W_RAW} SELECT ANALYSED_BY_USER_ID FROM raw WHERE ANALYTICAL_TYPE = 'Blank' INTERSECT SELECT ANALYSED_BY_USER_ID FROM raw WHERE ANALYTICAL_TYPE = 'Standard'",
    "common_users_by_analyte": f"{W_RAW} SELECT ANALYSED_BY_USER_ID FROM raw WHERE ANALYTICAL_TYPE = 'Blank' AND ANALYTE_CODE = 'click' INTERSECT SELECT ANALYSED_BY_USER_ID FROM raw WHERE ANALYTICAL_TYPE = 'Standard' AND ANALYTE_CODE = 'click'",
    "op_csv_roundtrip": f"{W_RAW} SELECT row_id, JOB_CODE, ANALYTE_CODE, ANALYSED_DATE, NUMERIC_FINAL_VALUE, PARENT_NUMERIC_FINAL_VALUE FROM raw",
    "op_preview": f"{W_RAW} SELECT row_id, ANALYTE_CODE, NUMERIC_FINAL_VALUE FROM raw ORDER BY row_id LIMIT 10",
    "op_shape": f"{W_RAW} SELECT count(*) AS n_rows, {len(RESULT_COLUMNS)} AS n_columns FROM raw",
    "op_schema_info": W_RAW + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS type, count({c}) AS non_null FROM raw" for c, t in (("row_id", "bigint"), ("JOB_CODE", "string"), ("ANALYTE_CODE", "string"), ("NUMERIC_FINAL_VALUE", "double"), ("PARENT_NUMERIC_FINAL_VALUE", "double"), ("STANDARD_STATUS", "string"))),
    "op_project_drop_reorder": f"{W_RAW} SELECT NUMERIC_FINAL_VALUE AS value, ANALYTE_CODE AS analyte, row_id FROM raw",
    "op_predicates": f"{W_RAW} SELECT row_id, NUMERIC_FINAL_VALUE FROM raw WHERE (NUMERIC_FINAL_VALUE < 5 OR NUMERIC_FINAL_VALUE > 90 OR PARENT_NUMERIC_FINAL_VALUE IS NULL) AND ANALYTE_CODE IS NOT NULL AND ANALYSED_DATE IS NOT NULL AND NUMERIC_FINAL_VALUE IS NOT NULL AND PARENT_NUMERIC_FINAL_VALUE IS NULL",
    "op_conditionals": f"{W_RAW} SELECT row_id, CASE WHEN PARENT_NUMERIC_FINAL_VALUE > 50 THEN 'high' ELSE 'low' END AS side, nullif(PARENT_NUMERIC_FINAL_VALUE, 0) AS safe, {r('NUMERIC_FINAL_VALUE / nullif(PARENT_NUMERIC_FINAL_VALUE, 0)')} AS share FROM raw",
    "op_casts": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN value END AS number, CASE WHEN event_id % 4 <> 0 THEN date_trunc('day', ts)::TIMESTAMP END AS day, trunc(value)::INT AS whole, event_id::VARCHAR AS id_text FROM events",
    "op_strict_timestamp": "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS read_back FROM events",
    "op_finite": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS kept FROM events",
    "op_text_codes": "SELECT event_id AS row_id, CASE WHEN event_id % 10 = 0 THEN 'NA' ELSE lpad(user_id::VARCHAR, 6, '0') END AS INSTRUMENT_ID FROM events",
    "op_date_parts": "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1",
    "op_math": f"{W_RAW} SELECT row_id, {r('abs(NUMERIC_FINAL_VALUE - PARENT_NUMERIC_FINAL_VALUE)')} AS gap, {r('least(greatest(NUMERIC_FINAL_VALUE, 10), 40)')} AS clipped, {r('greatest(NUMERIC_FINAL_VALUE - 10, 0)')} AS over, {r('NUMERIC_FINAL_VALUE', 2)} AS cents FROM raw",
    "op_strings": "SELECT event_id, event_type AS clean, event_type || '-' || event_id AS tag, lower(event_type) = 'click' AS is_click, lower(event_type) LIKE '%ic%' AS has_ic FROM events",
    "op_scalar_aggs": f"{W_RAW} SELECT {r('stddev_samp(NUMERIC_FINAL_VALUE)')} AS std, min(NUMERIC_FINAL_VALUE) AS low, max(NUMERIC_FINAL_VALUE) AS high, count(*) - count(PARENT_NUMERIC_FINAL_VALUE) AS missing FROM raw",
    "op_distinct": f"{W_RAW} SELECT DISTINCT ANALYTE_CODE FROM raw",
    "op_group_size": f"{W_RAW} SELECT ANALYTICAL_TYPE, count(*) AS n FROM raw GROUP BY ANALYTICAL_TYPE",
    "op_partition_median": f"WITH {RAW}, {NORM} SELECT row_id, {r('median(Value) OVER (PARTITION BY Analyte, SampleType)')} AS middle FROM norm",
    "op_sort_date": f"{PREPARED} SELECT row_id, Analyte, row_number() OVER (PARTITION BY Analyte ORDER BY AnalysisDate, row_id) AS place FROM lim",
    "op_sort_desc": f"{W_RAW} SELECT row_id, PARENT_NUMERIC_FINAL_VALUE, row_number() OVER (ORDER BY PARENT_NUMERIC_FINAL_VALUE DESC NULLS LAST, row_id) AS place FROM raw QUALIFY place <= 20",
    "op_rowid_writeback": f"{W_PAIRS} SELECT row_id, CASE WHEN RPD IS NOT NULL AND LOG_MEAN IS NOT NULL THEN true END AS has_features FROM clicks",
    "export_rows": "SELECT row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS row_id, event_id AS LOT, event_type AS ANALYTE_CODE, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN value END AS NUMERIC_FINAL_VALUE, user_id + CASE WHEN event_id % 97 = 1 THEN 0.5::DOUBLE ELSE 0 END AS SHARE, event_id % 3 = 0 AS OK, date_trunc('day', ts)::TIMESTAMP AS SEEN, CASE WHEN event_id % 89 = 5 THEN 'repeat' ELSE (event_id % 7)::VARCHAR END AS REMARK FROM events QUALIFY event_id % 50 <> 7",
    "export_types": "SELECT * FROM (VALUES ('LOT', 'bigint'), ('ANALYTE_CODE', 'string'), ('NUMERIC_FINAL_VALUE', 'double'), ('SHARE', 'double'), ('OK', 'boolean'), ('SEEN', 'timestamp_ntz'), ('REMARK', 'string')) t(column_name, type)",
    "export_unreadable": """WITH e AS (SELECT row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS row_id, event_id % 2 AS k, event_id % 50 = 7 AS broken, event_id || ',extra' AS lot, event_type AS code,
  CASE WHEN event_id % 11 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN '<' || value ELSE value::VARCHAR END AS v, user_id || CASE WHEN event_id % 97 = 1 THEN '.5' ELSE '' END AS share, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS ok,
  strftime(ts, '%Y-%m-%d') AS seen, CASE WHEN event_id % 89 = 5 THEN 'repeat' ELSE (event_id % 7)::VARCHAR END AS remark FROM events)
SELECT row_id, CASE k WHEN 0 THEN concat_ws(',', lot, code, v, share, ok, seen, remark) ELSE concat_ws(',', remark, seen, lot, ok, v, code, share) END AS line FROM e WHERE broken""",
    "layer_by_year": f"""{W_RAW} SELECT row_id, ANALYTE_CODE, ANALYSED_DATE + to_years((row_id % 3)::INT) AS ANALYSED_DATE, NUMERIC_FINAL_VALUE * CASE row_id % 3 WHEN 1 THEN 2 ELSE 1 END AS NUMERIC_FINAL_VALUE, (2024 + row_id % 3)::INT AS analysed_year
FROM raw WHERE row_id % 3 = 2 OR row_id % 3 = 1 AND row_id % 2 = 0""",
    "chart_parent_vs_dup": f"WITH {RAW}, {PAIRS} SELECT row_id, PARENT_NUMERIC_FINAL_VALUE, NUMERIC_FINAL_VALUE FROM pairs",
    "chart_rpd_hist": histogram(f"WITH {RAW}, {PAIRS}, model AS ({MODEL} pairs)", "model", "RPD", 30),
}
