"""DuckDB SQL of the models: the same hashes, sums in whole numbers, rounds as recursion."""

from __future__ import annotations

from assayer.operators import clusters, forest
from assayer.plans.sql import ALL, FEATURES, PAIRS, RAW, SIGNED, r, rounded


def hashed(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


def in_circle(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT / {forest.SPAN!r})"


def average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN {forest.UNIT} ELSE round((2.0::DOUBLE * (ln(({n} - 1)::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1) / {n}) * {forest.UNIT})::BIGINT END"


def isolation_forest(source: str, columns: list[str], trees: int, contamination: float = 0.05, seed: int = 42) -> str:
    """CTEs over `source` that end in `scored` (row_id, IForestScore) and `cutoff` (score_limit); they need WITH RECURSIVE."""
    size, levels = forest.SAMPLE, forest.depth_limit(forest.SAMPLE)
    parts = [
        f"fx AS MATERIALIZED (SELECT row_id, [{', '.join(r(c) for c in columns)}] AS x FROM {source} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns) + ")",
        f"fn AS MATERIALIZED (SELECT n, least({size}, n) AS size, ceil(log2(greatest(least({size}, n), 2)))::INT AS deepest, arc, greatest(1, floor(1 / arc))::BIGINT AS each FROM (SELECT count(*) AS n, least(1.0::DOUBLE, {size * forest.SLACK!r}::DOUBLE / greatest(count(*), 1)) AS arc FROM fx))",
        f"turn AS (SELECT row_id, x, k, {in_circle(hashed('row_id', str(seed), 'k'))} AS u, arc, each FROM fx, (SELECT unnest(range(({trees} + each - 1) // each)) AS k, arc, each FROM fn))",
        f"drawn AS (SELECT k * each + least(floor(u / arc), each)::BIGINT AS tree, u / arc - least(floor(u / arc), each) AS place, row_id, x FROM turn WHERE least(floor(u / arc), each) < each AND k * each + least(floor(u / arc), each) < {trees})",
        f"l0 AS MATERIALIZED (SELECT tree, 1 AS node, x FROM drawn QUALIFY row_number() OVER (PARTITION BY tree ORDER BY place, row_id) <= {size})",
    ]
    key = lambda *more: hashed(str(seed), "tree", "node", *more)
    for d in range(levels):
        parts += [
            f"t{d} AS (SELECT tree, node, i, min(v) AS lo, max(v) AS hi FROM (SELECT tree, node, unnest(x) AS v, unnest(range({len(columns)})) AS i FROM l{d}) GROUP BY ALL HAVING min(v) < max(v))",
            f"c{d} AS (SELECT tree, node, i, lo, hi, least(lo + (hi - lo) * ((('0x' || substr({key()}, 1, 13))::BIGINT + 1) / {forest.SPAN!r}), hi) AS spot FROM t{d}, fn WHERE {d} < deepest QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {key('i')}) = 1)",
            f"s{d} AS MATERIALIZED (SELECT tree, node, i, CASE WHEN spot > lo THEN spot ELSE hi END AS cut FROM c{d})",
            f"l{d + 1} AS MATERIALIZED (SELECT tree, node * 2 + (x[i + 1] >= cut)::INT AS node, x FROM l{d} JOIN s{d} USING (tree, node))",
        ]
    leaf = lambda d: f"SELECT tree, node, ({d} * {forest.UNIT} + {average_path('count(*)')})::BIGINT AS length FROM l{d} " + (f"ANTI JOIN s{d} USING (tree, node) " if d < levels else "") + "GROUP BY tree, node"
    parts += [
        "splits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(levels)) + ")",
        "leaves AS MATERIALIZED (" + " UNION ALL ".join(leaf(d) for d in range(levels + 1)) + ")",
        f"walk AS (SELECT row_id, tree, 1 AS node FROM fx, range({trees}) g(tree) UNION ALL SELECT row_id, tree, node * 2 + (x[i + 1] >= cut)::INT FROM walk JOIN splits USING (tree, node) JOIN fx USING (row_id))",
        f"scored AS MATERIALIZED (SELECT row_id, pow(2.0::DOUBLE, -(sum(length)::DOUBLE / ({trees} * greatest((SELECT {average_path('size')} FROM fn), 1))::DOUBLE)) AS IForestScore FROM walk JOIN leaves USING (tree, node) GROUP BY row_id)",
        f"cutoff AS MATERIALIZED (SELECT quantile_cont(IForestScore, {1 - contamination!r}) AS score_limit FROM scored)",
    ]
    return ", ".join(parts)


def kmeans(source: str, columns: list[str], k: int = 3, restarts: int = 10, seed: int = 42) -> str:
    """CTEs over `source` that end in `clustered` (row_id, CLUSTER); they need WITH RECURSIVE."""
    at = range(len(columns))
    gap = lambda p, c: " + ".join(f"({p}.x{i} - {c}.a{i}) * ({p}.x{i} - {c}.a{i})" for i in at)
    xs, centre = ", ".join(f"x{i}" for i in at), ", ".join(f"a{i}" for i in at)
    nearest = lambda table: f"SELECT p.row_id, {', '.join(f'p.x{i}' for i in at)}, c.run, c.c FROM pts p, {table} c QUALIFY row_number() OVER (PARTITION BY p.row_id, c.run ORDER BY {gap('p', 'c')}, c.c) = 1"
    return f"""
pts AS MATERIALIZED (SELECT row_id, {", ".join(f"round_even({c} * {clusters.STEPS}, 0)::BIGINT AS x{i}" for i, c in enumerate(columns))} FROM {source} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in columns)}),
starts AS MATERIALIZED (SELECT run, row_number() OVER (PARTITION BY run ORDER BY h, {xs}) - 1 AS c, {xs} FROM (SELECT run, {hashed(str(seed), "run", "row_id")} AS h, {xs} FROM pts, range({restarts}) g(run)) QUALIFY c < {k}),
rounds AS (
  SELECT 0 AS step, run, c, {", ".join(f"x{i}::DOUBLE AS a{i}" for i in at)} FROM starts
  UNION ALL
  SELECT step + 1, run, c, {", ".join(f"coalesce(m{i}, a{i})" for i in at)} FROM (
    SELECT o.*, {", ".join(f"m.m{i}" for i in at)} FROM rounds o LEFT JOIN (
      SELECT run, c, {", ".join(f"sum(x{i})::DOUBLE / count(*)::DOUBLE AS m{i}" for i in at)} FROM ({nearest("rounds")}) GROUP BY run, c) m USING (run, c))
  WHERE step < {clusters.ROUNDS}),
ends AS MATERIALIZED (SELECT run, c, {centre} FROM rounds WHERE step = {clusters.ROUNDS}),
final AS MATERIALIZED ({nearest("ends")}),
costs AS (SELECT run, sum({" + ".join(f"(q{i} * n - s{i} * s{i})::DOUBLE / n" for i in at)}) AS cost FROM (
  SELECT run, c, count(*)::HUGEINT AS n, {", ".join(f"sum(x{i}::HUGEINT) AS s{i}, sum(x{i}::HUGEINT * x{i}) AS q{i}" for i in at)} FROM final GROUP BY run, c) GROUP BY run),
best AS MATERIALIZED (SELECT run FROM costs ORDER BY cost, run LIMIT 1),
numbered AS (SELECT run, c, (row_number() OVER (ORDER BY {centre}) - 1)::INT AS CLUSTER FROM ends JOIN best USING (run)),
clustered AS MATERIALIZED (SELECT row_id, CLUSTER FROM final JOIN numbered USING (run, c))"""


_ASSESSED = "WITH RECURSIVE " + ALL.strip().removeprefix("WITH ")
_FILLED = "filled AS MATERIALIZED (SELECT row_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM feat), 0)::DOUBLE AS {c}" for c in FEATURES) + " FROM feat)"
_STRANGE = f"{_ASSESSED}, {_FILLED}, {isolation_forest('filled', FEATURES, 250)}, verdict AS MATERIALIZED (SELECT row_id, IForestScore, IForestScore > score_limit AS IForestAnomaly FROM scored, cutoff) "

_SCALED = """scaled AS MATERIALIZED (SELECT c.*, MEAN_CONC AS MEAN_VALUE, coalesce((u.RPD - avg(u.RPD) OVER ()) / nullif(stddev_pop(u.RPD) OVER (), 0), CASE WHEN u.RPD IS NOT NULL THEN 0 END) AS RPD_z,
  coalesce((u.LOG_MEAN - avg(u.LOG_MEAN) OVER ()) / nullif(stddev_pop(u.LOG_MEAN) OVER (), 0), CASE WHEN u.LOG_MEAN IS NOT NULL THEN 0 END) AS LOG_MEAN_z FROM clicks c LEFT JOIN (SELECT row_id, RPD, LOG_MEAN FROM usable) u USING (row_id))"""
_CLUSTERED = f"WITH RECURSIVE {RAW}, {PAIRS}, {SIGNED}, {_SCALED}, {kmeans('scaled', ['RPD_z', 'LOG_MEAN_z'])}, found AS MATERIALIZED (SELECT s.*, CLUSTER FROM scaled s LEFT JOIN clustered USING (row_id))"
_ODD = f"{_CLUSTERED}, {isolation_forest('scaled', ['RPD_z', 'LOG_MEAN_z'], 100)}, odd AS MATERIALIZED (SELECT f.*, CASE WHEN IForestScore > score_limit THEN -1 WHEN IForestScore IS NOT NULL THEN 1 END AS ANOMALY_SCORE FROM found f LEFT JOIN scored USING (row_id), cutoff) "
_LISTED = "row_id, JOB_CODE, ANALYTE_CODE, NUMERIC_FINAL_VALUE, PARENT_NUMERIC_FINAL_VALUE, ABS_DIFF, MEAN_VALUE, RPD, LOG_MEAN, PRECISION_STATUS, CLUSTER, ANOMALY_SCORE"
_TOP = "SELECT SampleID, SampleType, Analyte, AnalysisDate, Value, RuleFlag, RiskScore, RiskLevel, IForestAnomaly FROM risk JOIN verdict USING (row_id) ORDER BY RiskScore DESC NULLS LAST, row_id LIMIT 10"


def profile(columns: list[str]) -> str:
    cells = ", ".join(f"count({c}) AS {c}_count, {r(f'avg({c})')} AS {c}_mean, {r(f'median({c})')} AS {c}_median, {r(f'min({c})')} AS {c}_min, {r(f'max({c})')} AS {c}_max" for c in columns)
    return f"SELECT CLUSTER, {cells} FROM found WHERE CLUSTER IS NOT NULL GROUP BY CLUSTER"


ORACLES = {
    "kmeans_clusters": f"{_CLUSTERED} SELECT row_id, {rounded(['RPD', 'LOG_MEAN'])}, CLUSTER FROM found",
    "cluster_counts": f"{_CLUSTERED} SELECT CLUSTER, count(*) AS n FROM found GROUP BY CLUSTER",
    "cluster_profile": f"{_CLUSTERED} {profile(['RPD', 'MEAN_VALUE', 'LOG_MEAN', 'ABS_DIFF'])}",
    "cluster_by_status": f"{_CLUSTERED} SELECT CLUSTER, PRECISION_STATUS, count(*) AS n FROM found WHERE CLUSTER IS NOT NULL AND PRECISION_STATUS IS NOT NULL GROUP BY ALL",
    "chart_clusters": f"{_CLUSTERED} SELECT row_id, {rounded(['LOG_MEAN', 'RPD'])}, CLUSTER FROM found",
    "iforest_scores": f"{_STRANGE} SELECT row_id, {r('IForestScore')} AS IForestScore, IForestAnomaly, {r('(IForestScore - min(IForestScore) OVER ()) / (max(IForestScore) OVER () - min(IForestScore) OVER () + 1e-9)')} AS IForestScoreNorm FROM verdict",
    "anomaly_counts": f"{_STRANGE} SELECT IForestAnomaly, count(*) AS n FROM verdict GROUP BY IForestAnomaly",
    "anomalies_by_sample_type": f"{_STRANGE} SELECT SampleType, count(*) AS AnomalyCount FROM feat JOIN verdict USING (row_id) WHERE IForestAnomaly GROUP BY SampleType",
    "value_trend": f"{_STRANGE} SELECT row_id, AnalysisDate, Value, IForestAnomaly FROM feat JOIN verdict USING (row_id)",
    "top10_with_anomaly": f"{_STRANGE} {_TOP}",
    "anomaly_score_counts": f"{_ODD} SELECT ANOMALY_SCORE, count(*) AS n FROM odd GROUP BY ANOMALY_SCORE",
    "anomaly_by_status": f"{_ODD} SELECT ANOMALY_SCORE, PRECISION_STATUS, count(*) AS n FROM odd WHERE ANOMALY_SCORE IS NOT NULL AND PRECISION_STATUS IS NOT NULL GROUP BY ALL",
    "anomaly_list": f"{_ODD} SELECT * REPLACE ({rounded(['ABS_DIFF', 'MEAN_VALUE', 'RPD', 'LOG_MEAN'])}) FROM (SELECT {_LISTED} FROM odd WHERE ANOMALY_SCORE = -1)",
}
