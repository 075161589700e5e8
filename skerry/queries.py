"""Queries over the reference's own operators, and their SQL.

Streams: `events`, one for each event_type, ordered by (ts, event_id), in blocks of a day; `embeddings`, one stream by vec_id; `lineitem` for operators within a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import shared_path
from .functions import meters as M
from .functions import metrics as X
from .functions import scores as S
from .functions import vectors as V
from .functions.numerics import chi2_quantile, esd_critical, stl_seasonal
from .operators import columnar as C
from .operators import kernels as K
from .operators import online as O
from .operators import reference_window as R
from .operators.order import median_absolute_deviation, prefix_median, prefix_rank
from .operators.runtime import fit_then_score, key_hash, run_batch
from .operators.seasonal import series_residual
from .plans.pipeline import Columns, Pipeline, Sequential
from .plans.stream import StreamSpec
from .sources import readers
from .streaming.runner import read_events, run_stream, totals

EVENTS = StreamSpec(("event_type",), ("ts", "event_id"), "date_trunc('DAY', ts)")
USERS = StreamSpec(("user_id",), ("ts", "event_id"))
VECTORS = StreamSpec((), ("vec_id",), "floor(vec_id / 4096)")
ID = ["event_id", "event_type"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("features"), F.col("label").cast("int").alias("label"))


#: Added before rounding: means of cents are often ties at six digits, which the last bit would decide.
OFF_TIES = 3e-10


def rounded(df: DataFrame, *columns: str, keep: list[str] = ID) -> DataFrame:
    """Keys and rounded results; a negative zero is a zero."""
    return df.select(*keep, *[(F.round(F.col(c) + OFF_TIES, 6) + 0.0).alias(c) for c in columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """sql rounds as rounded() does."""
    QUERIES[name] = run
    if sql:
        SQL[name] = sql if sql in SQL.values() else sql.replace(", 6)", f" + {OFF_TIES}, 6)")


# --- meters ---------------------------------------------------------------------------------------------------------------------------------------------

_W = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS {} PRECEDING)"
_ALL, _30 = _W.format("UNBOUNDED"), _W.format(29)
_AGG = {"count": "count(*)", "sum": "sum(value)", "sum_squares": "sum(value * value)", "average": "avg(value)", "variance": "var_pop(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)"}
for _name, _sql in _AGG.items():
    _meter = M.METERS[_name]
    if _name != "median":
        query(f"meter_{_name}_prefix", lambda s, d, m=_meter: rounded(M.track(events(s, d), EVENTS, "value", {"v": m}).withColumn("v", F.col("v").cast("double")), "v"), f"SELECT event_id, event_type, round(CAST({_sql} {_ALL} AS DOUBLE), 6) AS v FROM events")
    query(f"meter_{_name}_running30", lambda s, d, m=_meter: rounded(M.running(events(s, d), EVENTS, "value", {"v": m}, 30).withColumn("v", F.col("v").cast("double")), "v"), f"SELECT event_id, event_type, round(CAST({_sql} {_30} AS DOUBLE), 6) AS v FROM events")
    query(f"meter_{_name}_final", lambda s, d, m=_meter: rounded(M.final(events(s, d), EVENTS, "value", {"v": m}).withColumn("v", F.col("v").cast("double")), "v", keep=["event_type"]), f"SELECT event_type, round(CAST({_sql} AS DOUBLE), 6) AS v FROM events GROUP BY event_type")
query("meter_median_prefix", lambda s, d: rounded(prefix_median(events(s, d), EVENTS, "value", "v"), "v"), f"SELECT event_id, event_type, round(median(value) {_ALL}, 6) AS v FROM events")
query("meter_abs_average", lambda s, d: rounded(M.track(events(s, d).withColumn("value", 50 - F.col("value")), EVENTS, "value", {"v": M.absolute(M.AVERAGE)}), "v"), f"SELECT event_id, event_type, round(abs(avg(50 - value) {_ALL}), 6) AS v FROM events")


def _retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value comes; those of 'error' users divisible by 3 go again."""
    came = events(spark, sf_dir).select("event_type", "value", F.lit(1).alias("op"))
    gone = events(spark, sf_dir).where("user_id % 3 = 0").select("event_type", "value", F.lit(-1).alias("op"))
    out = M.retracted(came.unionAll(gone), StreamSpec(("event_type",)), "value", "op")
    return rounded(out, "sum", "sum_squares", "average", "variance", "min", "max", "median", keep=["event_type", "n"])


query("meter_remove", _retracted, "SELECT event_type, count(*) AS n, round(sum(value), 6) AS sum, round(sum(value * value), 6) AS sum_squares, round(avg(value), 6) AS average, round(var_pop(value), 6) AS variance, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median FROM events WHERE user_id % 3 <> 0 GROUP BY event_type")

# --- post-processors and calibrators ----------------------------------------------------------------------------------------------------------------------


def _z_sql(w: str) -> str:
    return f"round((value - avg(value) {w}) / nullif(sqrt(var_pop(value) {w}), 0), 6) + 0.0"


def _post(name: str, f, expression: str, **options) -> None:
    query(f"post_{name}", lambda s, d: rounded(f(events(s, d), EVENTS, "value", **options), "post"), f"SELECT event_id, event_type, {expression} AS post FROM events")


_post("average", S.average, f"round(avg(value) {_ALL}, 6)")
_post("max", S.maximum, f"round(max(value) {_ALL}, 6)")
_post("zscore", S.zscore, f"CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 1 THEN {_z_sql(_ALL)} END")
_post("running_average", S.running_average, f"round(avg(value) {_30}, 6)", rows=30)
_post("running_max", S.running_maximum, f"round(max(value) {_30}, 6)", rows=30)
_post("running_median", S.running_median, f"round(median(value) {_30}, 6)", rows=30)
_post("running_zscore", S.running_zscore, f"CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 1 THEN {_z_sql(_30)} END", rows=30)
query("post_median", lambda s, d: rounded(prefix_median(events(s, d), EVENTS, "value", "post"), "post"), f"SELECT event_id, event_type, round(median(value) {_ALL}, 6) AS post FROM events")
query("post_frozen_zscore", lambda s, d: rounded(S.frozen_zscore(events(s, d).where("user_id % 2 = 0"), events(s, d).where("user_id % 2 = 1"), EVENTS, "value"), "post"), "WITH f AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE user_id % 2 = 0 GROUP BY event_type) SELECT event_id, event_type, round((value - m) / nullif(s, 0), 6) + 0.0 AS post FROM events LEFT JOIN f USING (event_type) WHERE user_id % 2 = 1")
_RANKED = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)"
query("calib_conformal_w50", lambda s, d: rounded(S.conformal(events(s, d), EVENTS, "value", 50), "p"), f"{_RANKED} SELECT a.event_id, a.event_type, round(count(*) FILTER (WHERE b.value > a.value) / count(*)::DOUBLE, 6) AS p FROM e a JOIN e b ON a.event_type = b.event_type AND b.rn BETWEEN a.rn - 49 AND a.rn GROUP BY ALL")
query("calib_conformal_all", lambda s, d: rounded(S.conformal(events(s, d), EVENTS, "value", None), "p"), f"{_RANKED} SELECT a.event_id, a.event_type, round(count(*) FILTER (WHERE b.value > a.value) / count(*)::DOUBLE, 6) AS p FROM e a JOIN e b ON a.event_type = b.event_type AND b.rn <= a.rn GROUP BY ALL")
query("calib_gauss_z_w100", lambda s, d: rounded(S.gaussian_z(events(s, d), EVENTS, "value", 100), "z"), f"SELECT event_id, event_type, round((value - m) / CASE WHEN rn > 1 AND v > 0 THEN sqrt(v) ELSE 1 END, 6) + 0.0 AS z FROM (SELECT *, avg(value) {_W.format(99)} AS m, var_pop(value) {_W.format(99)} AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)")
query("calib_gauss_z_all", lambda s, d: rounded(S.gaussian_z(events(s, d), EVENTS, "value", None), "z"), f"SELECT event_id, event_type, round((value - m) / CASE WHEN rn > 1 AND v > 0 THEN sqrt(v) ELSE 1 END, 6) + 0.0 AS z FROM (SELECT *, avg(value) {_ALL} AS m, var_pop(value) {_ALL} AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)")
query("calib_gauss_tail", lambda s, d: rounded(S.gaussian_tail(events(s, d), EVENTS, "value", 100), "p"), f"SELECT event_id, event_type, round({S.normal_cdf_sql('z')}, 6) AS p FROM ({SQL['calib_gauss_z_w100'].replace(f' + {OFF_TIES}', '').replace('round(', '(').replace(', 6) + 0.0', ')')})")
query("calib_conformal_w300", lambda s, d: rounded(S.conformal(events(s, d), EVENTS, "value"), "p"), SQL["calib_conformal_w50"].replace("a.rn - 49", "a.rn - 299").replace(f" + {OFF_TIES}", ""))
query("calib_gauss_z_w6400", lambda s, d: rounded(S.gaussian_z(events(s, d), EVENTS, "value"), "z"), SQL["calib_gauss_z_w100"].replace("ROWS 99", "ROWS 6399").replace(f" + {OFF_TIES}", ""))


def _frozen(name: str, method: str, value: str, fitted: str, rows: int | None = None) -> None:
    """Fitted on events of even users, applied to the others."""
    run = lambda s, d: rounded(S.frozen(events(s, d).where("user_id % 2 = 0"), events(s, d).where("user_id % 2 = 1"), EVENTS, "value", method, rows), "post")
    last = "" if rows is None else f" WHERE back <= {rows}"
    query(name, run, f"WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE user_id % 2 = 0), f AS (SELECT event_type, {fitted} FROM e{last} GROUP BY event_type) SELECT event_id, event_type, round({value}, 6) + 0.0 AS post FROM events LEFT JOIN f USING (event_type) WHERE user_id % 2 = 1")


_MOMENTS, _FROZEN_Z = "avg(value) AS m, var_pop(value) AS v", "((value - m) / CASE WHEN v > 0 THEN sqrt(v) ELSE 1 END)"
_frozen("post_frozen_average", "average", "m", "avg(value) AS m")
_frozen("post_frozen_max", "max", "m", "max(value) AS m")
_frozen("post_frozen_median", "median", "m", "median(value) AS m")
_frozen("post_frozen_running_median", "median", "m", "median(value) AS m", 30)
_frozen("post_frozen_running_zscore", "zscore", "(value - m) / nullif(sqrt(v), 0)", _MOMENTS, 30)
_frozen("calib_frozen_gauss", "gauss", _FROZEN_Z, _MOMENTS, 100)
_frozen("calib_frozen_gauss_tail", "gauss_tail", S.normal_cdf_sql(_FROZEN_Z), _MOMENTS, 100)
_frozen("calib_frozen_conformal", "conformal", "len(list_filter(l, lambda x: x > value)) / len(l)::DOUBLE", "list(value) AS l", 300)
query("alerts", lambda s, d: rounded(S.alerts(S.conformal(events(s, d), EVENTS, "value", 50), "p", 0.95), "p"), "SELECT * FROM (" + SQL["calib_conformal_w50"].replace(f" + {OFF_TIES}", "") + ") WHERE p > 0.95")

# --- ensemblers, vectors ----------------------------------------------------------------------------------------------------------------------------------

_SCORES = ["l_quantity / 50", "l_extendedprice / 100000", "l_discount * 10", "l_tax * 10"]
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_DEALT = [[2, 0], [3, 1]]


def _ensemble(name: str, f: Callable[[list[Column]], Column], expression: str) -> None:
    query(f"ens_{name}", lambda s, d: rounded(table(s, d, "lineitem").withColumn("score", f([F.expr(x) for x in _SCORES])), "score", keep=_LINE), f"SELECT {', '.join(_LINE)}, round({expression}, 6) AS score FROM (SELECT *, {', '.join(f'{x} AS s{i}' for i, x in enumerate(_SCORES))} FROM lineitem)")


_ensemble("average", S.mean_of, "(s0 + s1 + s2 + s3) / 4")
_ensemble("weighted", partial(S.mean_of, weights=[1, 2, 3, 4]), "(s0 * 1.0 + s1 * 2.0 + s2 * 3.0 + s3 * 4.0) / 10")
_ensemble("max", S.max_of, "greatest(s0, s1, s2, s3)")
_ensemble("median", S.median_of, "list_median([s0, s1, s2, s3])")
_ensemble("average_of_max", partial(S.average_of_maximum, dealt=_DEALT), "(greatest(s2, s0) + greatest(s3, s1)) / 2")
_ensemble("max_of_average", partial(S.maximum_of_average, dealt=_DEALT), "greatest((s2 + s0) / 2, (s3 + s1) / 2)")

for _name, _dealt in (("dynamic", S.buckets(4, 2, "dynamic", seed=3)), ("bootstrap", S.buckets(4, 2, bootstrap=True, seed=3))):
    _ensemble(f"average_of_max_{_name}", partial(S.average_of_maximum, dealt=_dealt), "(" + " + ".join(f"greatest({', '.join(f's{i}' for i in b)})" for b in _dealt) + f") / {len(_dealt)}")
    _ensemble(f"max_of_average_{_name}", partial(S.maximum_of_average, dealt=_dealt), f"greatest({', '.join('(' + ' + '.join(f's{i}' for i in b) + f') / {len(b)}' for b in _dealt)})")


def _zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors over the same stream, joined on key and order, and their mean."""
    own = events(spark, sf_dir)
    a = C.standard_absolute_deviation(own, EVENTS, "value")
    b = S.running_average(own, EVENTS, "value", 30, "score")
    both = S.zipped([a, b], EVENTS)
    return rounded(both.withColumn("score", S.mean_of([F.col("s0"), F.col("s1")])), "score")


query("ens_zip", _zipped, f"SELECT event_id, event_type, round(((CASE WHEN rn = 1 THEN 0 ELSE abs(value - avg(value) {_ALL}) / (sqrt(var_pop(value) {_ALL}) + 1e-10) END) + avg(value) {_30}) / 2, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)")


def _vector(name: str, f: Callable[[Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        out = embeddings(spark, sf_dir).select("vec_id", F.posexplode(f(F.col("features"))).alias("pos", "v"))
        return rounded(out, "v", keep=["vec_id", "pos"])

    query(name, run, f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), r AS ({sql}) SELECT vec_id, CAST(unnest(range(0, len(f))) AS INTEGER) AS pos, round(unnest(f), 6) + 0.0 AS v FROM r")


_vector("scale_identity", V.identity, "SELECT * FROM e")
_vector("scale_standard", V.standardised, "SELECT vec_id, list_transform(f, lambda x: (x - list_avg(f)) / nullif(list_stddev_pop(f), 0)) AS f FROM e")
_vector("scale_unit_l1", partial(V.unit, power=1), "SELECT vec_id, list_transform(f, lambda x: x / nullif(list_sum(list_transform(f, lambda y: abs(y))), 0)) AS f FROM e")
_vector("scale_unit_l2", V.unit, "SELECT vec_id, list_transform(f, lambda x: x / nullif(sqrt(list_sum(list_transform(f, lambda y: y * y))), 0)) AS f FROM e")
_vector("scale_unit_l3", partial(V.unit, power=3), "SELECT vec_id, list_transform(f, lambda x: x / nullif(pow(list_sum(list_transform(f, lambda y: pow(abs(y), 3))), 1.0 / 3), 0)) AS f FROM e")
_vector("scale_unit_l0", partial(V.unit, power=0), "SELECT vec_id, list_transform(f, lambda x: x / nullif(len(list_filter(f, lambda y: y <> 0)), 0)) AS f FROM e")
_vector("scale_unit_lninf", partial(V.unit, power=float("-inf")), "SELECT vec_id, list_transform(f, lambda x: x / nullif(list_min(list_transform(f, lambda y: abs(y))), 0)) AS f FROM e")
_vector("scale_unit_linf", partial(V.unit, power=float("inf")), "SELECT vec_id, list_transform(f, lambda x: x / nullif(list_max(list_transform(f, lambda y: abs(y))), 0)) AS f FROM e")


def _projection(name: str, projector: V.Projector) -> None:
    matrix = projector.matrix(64)
    rows = ", ".join("(" + " + ".join([f"f[{i + 1}] * {float(w)!r}::DOUBLE" for i, w in enumerate(row) if w] or ["0.0"]) + ")" for row in matrix)
    _vector(name, lambda x: V.projected(x, projector.matrix(64)), f"SELECT vec_id, [{rows}] AS f FROM e")


_projection("proj_streamhash_k8", V.StreamHash(8))
_projection("proj_gauss_k8", V.Gaussian(8, seed=61))
_projection("proj_sparse_k8", V.Sparse(8, seed=61))
query("minmax_features", lambda s, d: rounded(V.feature_extremes(embeddings(s, d)), "min", "max", keep=["pos"]), "SELECT CAST(pos - 1 AS INTEGER) AS pos, round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY pos")
query("minmax_scalar", lambda s, d: rounded(V.extremes(embeddings(s, d)), "min", "max", keep=[]), "SELECT round(min(list_min(CAST(embedding AS DOUBLE[]))), 6) + 0.0 AS min, round(max(list_max(CAST(embedding AS DOUBLE[]))), 6) + 0.0 AS max FROM embeddings")

# --- metrics ----------------------------------------------------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("y", (F.col("event_type") == "error").cast("int"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", "toxic", "quality")


def _predicted() -> Column:
    return F.col("value") > 50


query("metric_precision", lambda s, d: rounded(X.precision(_judged(s, d), "y", _predicted()), "value", keep=[]), "SELECT round(coalesce(sum((event_type = 'error' AND value > 50)::INT) / nullif(sum((value > 50)::INT), 0)::DOUBLE, 0), 6) AS value FROM events")
query("metric_recall", lambda s, d: rounded(X.recall(_judged(s, d), "y", _predicted()), "value", keep=[]), "SELECT round(coalesce(sum((event_type = 'error' AND value > 50)::INT) / nullif(sum((event_type = 'error')::INT), 0)::DOUBLE, 0), 6) AS value FROM events")
_CURVE = "WITH g AS (SELECT {s} AS s, sum({y})::DOUBLE AS tp, sum(1 - {y})::DOUBLE AS fp FROM {t} GROUP BY 1), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"
_ON_EVENTS = _CURVE.format(s="value", y="(event_type = 'error')::INT", t="events")
_ON_DOCUMENTS = _CURVE.format(s="n_chars", y="quality", t="documents JOIN labels USING (doc_id)")
for _name, _f, _e in (("auroc", X.auroc, "sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp))"), ("aupr", X.aupr, "sum(tp * ctp / (ctp + cfp)) / sum(tp)")):
    query(f"metric_{_name}", lambda s, d, f=_f: rounded(f(_judged(s, d), "y", "value"), "value", keep=[]), f"{_ON_EVENTS} SELECT round({_e}, 6) AS value FROM c")
    query(f"metric_{_name}_documents", lambda s, d, f=_f: rounded(f(_documents(s, d), "quality", "n_chars"), "value", keep=[]), f"{_ON_DOCUMENTS} SELECT round({_e}, 6) AS value FROM c")


def _windowed(metric, ignore: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label: values above 70; prediction: values above 50; windows of 25 rows of a user."""
    rows = events(spark, sf_dir).withColumn("y", (F.col("value") > 70).cast("int"))
    return rounded(X.windowed(rows, USERS, metric, 25, ignore), "value", keep=["user_id"])


_WINDOWS = "WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 25 AS w FROM events), m AS (SELECT user_id, w, count(*) AS n, {m} AS v FROM e GROUP BY user_id, w) SELECT user_id, round(avg(v), 6) AS value FROM m {where} GROUP BY user_id"
_PRECISION = "coalesce(sum((value > 70)::INT) / nullif(sum((value > 50)::INT), 0)::DOUBLE, 0)"
query("metric_windowed_precision", partial(_windowed, lambda df, by: X.precision(df, "y", _predicted(), by), True), _WINDOWS.format(m=_PRECISION, where="WHERE n = 25 OR w = 0"))
query("metric_windowed_precision_last", partial(_windowed, lambda df, by: X.precision(df, "y", _predicted(), by), False), _WINDOWS.format(m=_PRECISION, where=""))
query("metric_windowed_recall", partial(_windowed, lambda df, by: X.recall(df, "y", _predicted(), by), True), _WINDOWS.format(m="coalesce(sum((value > 70)::INT) / nullif(sum((value > 70)::INT), 0)::DOUBLE, 0)", where="WHERE n = 25 OR w = 0"))

# --- detectors as column plans ------------------------------------------------------------------------------------------------------------------------------

_SAD = f"SELECT event_id, event_type, round(CASE WHEN rn = 1 THEN 0 ELSE abs(value - {{m}}(value) {_ALL}) / (sqrt(var_pop(value) {_ALL}) + 1e-10) END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)"
query("det_sad_mean", lambda s, d: rounded(C.standard_absolute_deviation(events(s, d), EVENTS, "value"), "score"), _SAD.format(m="avg"))
query("det_sad_median", lambda s, d: rounded(C.standard_absolute_deviation(events(s, d), EVENTS, "value", "median"), "score"), _SAD.format(m="median"))
_U = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
query("det_mad", lambda s, d: rounded(median_absolute_deviation(events(s, d), USERS, "value"), "score", keep=["event_id", "user_id"]), f"WITH a AS (SELECT *, median(value) {_U} AS m FROM events), b AS (SELECT *, abs(value - m) AS dev FROM a) SELECT event_id, user_id, round(abs((value - m) / (1.4826 * median(dev) {_U} + 1e-10)), 6) AS score FROM b")
query("det_storm_w50", lambda s, d: rounded(C.exact_storm(events(s, d).withColumn("f", F.array("value")), EVENTS, "f", 50, 5.0), "score"), f"{_RANKED} SELECT a.event_id, a.event_type, round(coalesce(count(*) FILTER (WHERE abs(a.value - b.value) < 5) / nullif(count(b.rn), 0)::DOUBLE, 0), 6) AS score FROM e a LEFT JOIN e b ON a.event_type = b.event_type AND b.rn BETWEEN a.rn - 49 AND a.rn - 1 GROUP BY a.event_id, a.event_type")
_BINS = [f"sum((b >= {k} AND b {'<=' if k == 4 else '<'} {k + 1})::INT) {_W.format(51)} AS c{k}" for k in range(5)]
query(
    "det_relative_entropy",
    lambda s, d: rounded(C.relative_entropy(events(s, d), EVENTS, "value", 0, 100), "score"),
    f"{_RANKED}, h AS (SELECT *, {', '.join(_BINS)} FROM (SELECT *, ceil(value / 20) AS b FROM e)), p AS (SELECT *, {', '.join(f'c{k} / nullif(c0 + c1 + c2 + c3 + c4, 0)::DOUBLE AS p{k}' for k in range(5))} FROM h), q AS (SELECT event_type, {', '.join(f'p{k} AS q{k}' for k in range(5))} FROM p WHERE rn = 52) "
    + f"SELECT event_id, event_type, CASE WHEN rn < 52 THEN 0.0::DOUBLE WHEN 104 * ({' + '.join(f'CASE WHEN p{k} = 0 THEN 0 WHEN q{k} = 0 THEN 1e300 ELSE p{k} * ln(p{k} / q{k}) END' for k in range(5))}) < {chi2_quantile(0.99, 4)!r}::DOUBLE THEN 0.0 ELSE -1.0 END AS score FROM p LEFT JOIN q USING (event_type)",
)
query("det_null", lambda s, d: C.null_model(events(s, d)).select(*ID, "score"), "SELECT event_id, event_type, 0.5::DOUBLE AS score FROM events")
query("det_perfect", lambda s, d: C.perfect_model(_documents(s, d), "toxic").select("doc_id", "score"), "SELECT doc_id, toxic::DOUBLE AS score FROM documents JOIN labels USING (doc_id)")
query("det_random", lambda s, d: rounded(C.random_model(events(s, d), StreamSpec(("event_type",), ("event_id",)), 61), "score"), "SELECT event_id, event_type, round(('0x' || substr(md5(concat_ws('|', '61', event_type, event_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496, 6) AS score FROM events")
query("det_storm_oriented", lambda s, d: rounded(C.exact_storm(events(s, d).withColumn("f", F.array("value")), EVENTS, "f", 50, 5.0).withColumn("score", C.oriented("exact_storm")), "score"), SQL["det_storm_w50"].replace("round(coalesce(", "round(-coalesce(").replace(f", 6) AS", ", 6) + 0.0 AS").replace(f" + {OFF_TIES}", ""))
query("det_storm", lambda s, d: rounded(C.exact_storm(events(s, d).withColumn("f", F.array("value")), EVENTS, "f"), "score"), SQL["det_storm_w50"].replace("< 5)", "< 0.1)").replace("a.rn - 49", "a.rn - 9999").replace(f" + {OFF_TIES}", ""))
query(
    "seasonal_trend",
    lambda s, d: rounded(C.seasonal_trend(events(s, d), EVENTS, "value", 24, 12), "residual"),
    f"WITH a AS (SELECT *, avg(value) {_W.format(11)} AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events), b AS (SELECT *, CASE WHEN rn >= 12 THEN value - t END AS f FROM a) SELECT event_id, event_type, round(value - t - coalesce(avg(f) OVER (PARTITION BY event_type, (rn - 1) % 24 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS residual FROM b",
)


def _seasonal_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.seasonal_trend_vectors(embeddings(spark, sf_dir), VECTORS, "features", 6, 4)
    return rounded(out.select("vec_id", F.posexplode("residual").alias("pos", "residual")), "residual", keep=["vec_id", "pos"])


query(
    "seasonal_trend_vectors",
    _seasonal_vectors,
    "WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), e AS (SELECT vec_id, rn, unnest(range(64))::INT AS pos, unnest(f) AS v FROM x), a AS (SELECT *, avg(v) OVER (PARTITION BY pos ORDER BY rn ROWS 3 PRECEDING) AS t FROM e), b AS (SELECT *, CASE WHEN rn >= 4 THEN v - t END AS g FROM a) "
    "SELECT vec_id, pos, round(v - t - coalesce(avg(g) OVER (PARTITION BY pos, (rn - 1) % 6 ORDER BY rn ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS residual FROM b",
)

FOREST = C.Forest((-0.5,) * 64, (0.5,) * 64, n_trees=3, depth=4, seed=61)
DEEP = C.Forest((-0.5,) * 64, (0.5,) * 64, seed=61)
HASHES = C.HashParameters.drawn([-0.5] * 64, [0.5] * 64, seed=61)
_X = "WITH RECURSIVE x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"


def _forest_sql(forest: C.Forest, rows: int) -> str:
    trees = ", ".join(f"({t}, {a}::BIGINT, {b}::BIGINT)" for t in range(forest.n_trees) for a, b in [forest.factors(t)])
    box = lambda v: "[" + ", ".join(map(repr, v)) + "]::DOUBLE[]"
    moved = lambda c, when: f"CASE WHEN {when} THEN {c}[:q - 1] || [mid] || {c}[q + 1:] ELSE {c} END"
    step = f"SELECT rn, t, k + 1, 2 * n + r, {moved('low', 'r = 1')}, {moved('high', 'r = 0')} FROM (SELECT *, (f[q] > mid)::INT AS r FROM (SELECT *, (low[q] + high[q]) / 2 AS mid FROM (SELECT w.*, f, ((n * a + b) % {C.PRIME} % {len(forest.low)} + 1)::INT AS q FROM w JOIN trees USING (t) JOIN x USING (rn) WHERE k < {forest.depth})))"
    return (
        f"{_X}, trees AS (SELECT * FROM (VALUES {trees}) v(t, a, b)), w AS (SELECT rn, t, 0 AS k, 1::BIGINT AS n, {box(forest.low)} AS low, {box(forest.high)} AS high FROM x, trees UNION ALL {step}), p AS (SELECT vec_id, rn, t, k, n FROM w JOIN x USING (rn)), "
        f"m AS (SELECT (rn - 1) // {rows} + 1 AS r, t, n, count(*) AS m FROM p GROUP BY ALL), first AS (SELECT vec_id, rn, k, count(*) OVER (PARTITION BY t, n ORDER BY rn) AS m FROM p WHERE rn < {rows}), late AS (SELECT vec_id, rn, k, coalesce(m.m, 0) AS m FROM p LEFT JOIN m ON p.rn // {rows} = m.r AND p.t = m.t AND p.n = m.n WHERE rn >= {rows}) "
        "SELECT vec_id, round(-sum(m * pow(2.0, k)), 6) + 0.0 AS score FROM (SELECT * FROM first UNION ALL SELECT * FROM late) GROUP BY vec_id"
    )


def _hash_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT vec_id, rn, {r} AS r, concat_ws(',', {', '.join(f'floor((f[{i + 1}] + {a!r}::DOUBLE) / {w!r}::DOUBLE)::BIGINT::VARCHAR' for i, a in zip(own, shift))}) AS c FROM x"
        for r, (w, own, shift) in enumerate(zip(HASHES.widths, HASHES.features, HASHES.shifts))
    )
    return f"{_X}, e AS ({cells}), s AS (SELECT vec_id, coalesce(sum(pow(2.0, {HASHES.decay} * rn)) OVER (PARTITION BY r, c ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2.0, -{HASHES.decay} * rn) AS c FROM e) SELECT vec_id, round(sum(ln(1 + c)) / {len(HASHES.widths)}, 6) + 0.0 AS score FROM s GROUP BY vec_id"


query("det_hst", lambda s, d: rounded(C.half_space_trees(embeddings(s, d), VECTORS, "features", FOREST, 50), "score", keep=["vec_id"]), _forest_sql(FOREST, 50))
query("det_hst_kernel", lambda s, d: rounded(run_batch(embeddings(s, d), VECTORS, K.HalfSpaceTrees(FOREST, 50), features="features"), "score", keep=["vec_id"]), SQL["det_hst"])
query("det_hst_deep", lambda s, d: rounded(C.half_space_trees(embeddings(s, d), VECTORS, "features", DEEP), "score", keep=["vec_id"]), _forest_sql(DEEP, 100))
query("det_rshash", lambda s, d: rounded(C.rs_hash(embeddings(s, d), VECTORS, "features", HASHES), "score", keep=["vec_id"]), _hash_sql())
query("det_rshash_kernel", lambda s, d: rounded(run_batch(embeddings(s, d), VECTORS, K.RSHash(HASHES), features="features"), "score", keep=["vec_id"]), SQL["det_rshash"])

# --- kernels ------------------------------------------------------------------------------------------------------------------------------------------------


def _on_vectors(name: str, kernel: Callable[[], K.Kernel], sql: str | None = None) -> None:
    query(f"det_{name}", lambda s, d: rounded(run_batch(embeddings(s, d), VECTORS, kernel(), features="features"), "score", keep=["vec_id"]), sql)


def _on_values(name: str, kernel: Callable[[], K.Kernel], sql: str | None = None) -> None:
    query(f"det_{name}", lambda s, d: rounded(run_batch(events(s, d), USERS, kernel(), value="value"), "score", keep=["event_id", "user_id"]), sql)


def _drawn(kernel: K.Kernel) -> K.Kernel:
    """A kernel with what it draws for the one stream of 64-dimensional vectors."""
    own = kernel.fresh(key_hash(()))
    own.start(64)
    return own


def _products(matrix: np.ndarray) -> str:
    """The products of f with the rows of a matrix, as a list."""
    return "[" + ", ".join("(" + " + ".join(f"f[{i + 1}] * {float(w)!r}::DOUBLE" for i, w in enumerate(row) if w) + ")" if row.any() else "0.0::DOUBLE" for row in matrix) + "]"


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _loda_sql(kernel: K.LODA) -> str:
    return (
        f"{_X}, z AS (SELECT vec_id, rn, unnest(range(1, {kernel.n_cuts + 1})) AS c, unnest({_products(_drawn(kernel).w)}) AS z FROM x), w AS (SELECT c, CASE WHEN max(z) > min(z) THEN max(z) - min(z) ELSE 1 END / {kernel.n_bins} AS w FROM z WHERE rn <= {kernel.warm} GROUP BY c), "
        f"n AS (SELECT vec_id, rn, w, count(*) OVER (PARTITION BY c, floor(z / w) ORDER BY rn) AS n FROM z JOIN w USING (c)) SELECT vec_id, round(CASE WHEN min(rn) < {kernel.warm} THEN 0 ELSE -avg(ln(n / (rn * w))) END, 6) + 0.0 AS score FROM n GROUP BY vec_id"
    )


def _inqmad_sql(kernel: K.InqMAD) -> str:
    own = _drawn(kernel)
    return (
        f"{_X}, c AS (SELECT vec_id, rn, list_transform(list_zip({_products(own.w.T)}, {_list(own.b)}), lambda p: cos(p[1] + p[2])) AS p FROM x), u AS (SELECT vec_id, rn, list_transform(p, lambda v: v / sqrt(list_dot_product(p, p))) AS p FROM c), "
        f"d AS (SELECT a.vec_id, a.rn, unnest(range({kernel.m})) AS k, unnest(b.p) * list_dot_product(a.p, b.p) AS v FROM u a JOIN u b ON b.rn <= a.rn), s AS (SELECT vec_id, rn, k, sum(v) / rn AS v FROM d GROUP BY vec_id, rn, k) SELECT vec_id, round(sum(v * v), 6) AS score FROM s GROUP BY vec_id"
    )


def _xstream_sql(kernel: K.XStream, f: str = "f") -> str:
    """Cells of a row under a window's widths: floors of its bins at the depths where a feature of the chain was last cut.  A window's rows are counted under the widths of
    the window before (u) and looked up under those of the window closed last (v)."""
    chains = []
    for c in range(kernel.n_chains):
        cut, last = {}, {}
        for j, k in enumerate(kernel.features[c].tolist()):
            cut[k], last[k] = cut.get(k, 0) + 1, j + 1
            chains.append(f"({c}, {j + 1}, {k + 1}, {cut[k]}, {float(kernel.part[c, k])!r}::DOUBLE, {sorted(last.values())})")
    n, width = kernel.rows, f"coalesce(d, list_transform(range({kernel.k}), lambda i: 0.5::DOUBLE))"
    return (
        f"{_X}, g AS (SELECT vec_id, rn, {f} AS f FROM x), z AS (SELECT vec_id, rn, (rn - 1) // {n} AS w, {_products(_drawn(kernel).matrix)} AS z FROM g), chain AS (SELECT * FROM (VALUES {', '.join(chains)}) t(c, j, k, m, p, own)), "
        f"e AS (SELECT w, k, (max(v) - min(v)) / 2 AS d, count(*) AS n FROM (SELECT w, unnest(range({kernel.k})) AS k, unnest(z) AS v FROM z) GROUP BY w, k), d AS (SELECT w, list(CASE WHEN abs(d) <= 1e-4 THEN 1.0 ELSE d END ORDER BY k) AS d FROM e WHERE n = {n} GROUP BY w), "
        f"b AS (SELECT rn, 0 AS u, z, {width} AS d FROM z LEFT JOIN d ON d.w = z.w - 1 UNION ALL SELECT rn, 1, z, {width} FROM z LEFT JOIN d ON d.w = rn // {n} - 1), "
        f"l AS (SELECT rn, u, c, list(floor(pow(2, m - 1) * ((z[k] + p * d[k]) / d[k]) - (pow(2, m - 1) - 1) * p)::BIGINT ORDER BY j) AS b FROM b, chain GROUP BY rn, u, c), "
        f"h AS (SELECT rn, u, c, j, hash(list_transform(own, lambda i: b[i])) AS h FROM l JOIN chain USING (c)), "
        f"n AS (SELECT (rn - 1) // {n} AS w, c, j, h, count(*) AS n FROM h WHERE u = 0 GROUP BY ALL), s AS (SELECT rn, c, j, count(*) OVER (PARTITION BY c, j, h ORDER BY rn) AS n FROM h WHERE u = 0 AND rn < {n} "
        f"UNION ALL SELECT rn, h.c, h.j, coalesce(n.n, 0) FROM h LEFT JOIN n ON n.w = rn // {n} - 1 AND n.c = h.c AND n.j = h.j AND n.h = h.h WHERE u = 1 AND rn >= {n}), "
        f"t AS (SELECT rn, -sum(v) / {kernel.n_chains} AS score FROM (SELECT rn, c, min(log2(1 + n) + j) AS v FROM s GROUP BY rn, c) GROUP BY rn)"
    )


def _loop_sql(n: int = 100, k: int = 10, extent: int = 3) -> str:
    near = f"sqrt(avg(d)) AS s, list(i) AS near FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS r FROM {{}}) WHERE r <= {k} GROUP BY vec_id"
    plof = lambda t: f"SELECT u.vec_id, CASE WHEN avg(own.s) > 0 THEN any_value(u.s) / avg(own.s) - 1 ELSE 0 END AS p FROM (SELECT vec_id, s, unnest(near) AS i FROM {t}) u JOIN own ON own.vec_id = u.i GROUP BY u.vec_id"
    return (
        f"{_X}, a AS (SELECT x.vec_id, y.vec_id AS i, pow(list_distance(x.f, y.f), 2) AS d FROM x JOIN x y ON y.rn <= {n}), o AS (SELECT a.* FROM a JOIN x USING (vec_id) WHERE rn <= {n} AND vec_id <> i), own AS (SELECT vec_id, {near.format('o')}), every AS (SELECT vec_id, {near.format('a')}), "
        f"c AS (SELECT {extent} * sqrt(avg(p * p)) AS c FROM ({plof('own')})) SELECT vec_id, round(greatest(0, 2 * ({S.normal_cdf_sql('z')}) - 1), 6) AS score FROM (SELECT vec_id, p / CASE WHEN c = 0 THEN 1 ELSE c END AS z FROM ({plof('every')}), c)"
    )


def _season(n: int, period: int) -> np.ndarray:
    """STL's season of n rows, without robustness weights, as a matrix."""
    return np.column_stack([stl_seasonal(v, period, robust=False) for v in np.eye(n)])


_LAST30 = "WITH e AS (SELECT event_id, user_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING) AS y FROM events)"


def _residual_sql() -> str:
    rows = ", ".join(f"({n}, {_list(_season(n, 5)[-1])})" for n in range(10, 31))
    return f"{_LAST30} SELECT event_id, user_id, round(CASE WHEN o.n IS NULL THEN 0 ELSE y[-1] - list_dot_product(y, w) - list_median(y) END, 6) + 0.0 AS score FROM e LEFT JOIN (SELECT * FROM (VALUES {rows}) t(n, w)) o ON len(y) = o.n"


def _esd_sql(hybrid: bool, most: int = 3) -> str:
    """The test's steps, one after another: l are the residuals that are left, i their places, hits the number of steps up to the last significant one, and hit the step
    that took the newest row out."""
    seasons = "[" + ", ".join(f"list_dot_product(y, {_list(row)})" for row in _season(30, 5)) + "]"
    out = f"{_LAST30}, r AS (SELECT event_id, user_id, y, {seasons} AS season, list_median(y) AS m FROM e WHERE len(y) = 30), s0 AS (SELECT event_id, user_id, list_transform(range(1, 31), lambda k: y[k] - season[k] - m) AS l, range(1, 31) AS i, true AS going, 0 AS hits, 0 AS hit, 0.0::DOUBLE AS v FROM r)"
    for k in range(1, most + 1):
        centre, scale = ("list_median(l)", "1.4826 * list_median(list_transform(l, lambda x: abs(x - list_median(l))))") if hybrid else ("list_avg(l)", "list_aggregate(l, 'stddev_samp')")
        out += (
            f", a{k} AS (SELECT *, going AND sd > 1e-10 AS go, list_transform(l, lambda x: abs(x - c) / CASE WHEN sd > 1e-10 THEN sd ELSE 1 END) AS away FROM (SELECT *, {centre} AS c, {scale} AS sd FROM s{k - 1}))"
            f", s{k} AS (SELECT event_id, user_id, l[:q - 1] || l[q + 1:] AS l, i[:q - 1] || i[q + 1:] AS i, go AS going, CASE WHEN go AND away[q] > {esd_critical(30, k, 0.05)!r} THEN {k} ELSE hits END AS hits, CASE WHEN go AND i[q] = 30 THEN {k} ELSE hit END AS hit, CASE WHEN go AND i[q] = 30 THEN away[q] ELSE v END AS v FROM (SELECT *, list_position(away, list_max(away))::INT AS q FROM a{k}))"
        )
    return out + f" SELECT event_id, user_id, round(CASE WHEN hit BETWEEN 1 AND hits THEN v ELSE 0 END, 6) + 0.0 AS score FROM e LEFT JOIN s{most} USING (event_id, user_id)"


_on_vectors("xstream", K.XStream, _xstream_sql(K.XStream()) + " SELECT vec_id, round(score, 6) AS score FROM t JOIN x USING (rn)")
_on_vectors("loda", K.LODA, _loda_sql(K.LODA()))
_on_vectors("rrcf", K.RobustRandomCutForest)
_on_vectors("kitnet", lambda: K.KitNet(10, 50, 100))
_on_vectors("inqmad", lambda: K.InqMAD(64, 1.0), _inqmad_sql(K.InqMAD(64, 1.0)))
query("det_knncad", lambda s, d: rounded(run_batch(events(s, d), EVENTS, K.KNNCAD(60), value="value"), "score"))
_on_values("sesd", lambda: K.SeasonalESD(5, 30, 3, robust=False), _esd_sql(False))
_on_values("shesd", lambda: K.SeasonalESD(5, 30, 3, hybrid=True, robust=False), _esd_sql(True))
_on_values("stl_residual", lambda: K.STLResidual(5, 30, robust=False), _residual_sql())


query("stl_series", lambda s, d: rounded(series_residual(events(s, d).drop("ts").withColumn("ts", F.col("event_id")), StreamSpec(("user_id",), ("ts",)), "value", 5, robust=False), "residual", keep=["event_id", "user_id"]))


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream."""
    # A glob, for the source takes a plain path for a folder.
    return read_events(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema, None).select("event_id", "ts", "user_id", "event_type", "value")


def _streamed(spark: SparkSession, sf_dir: str, kernel: K.Kernel, spec: StreamSpec = EVENTS, out: str = "score", keep: list[str] = ID) -> DataFrame:
    """A kernel on a file stream, written to Parquet in the shared folder: the same scores as in batch."""
    base = shared_path(spark, "stream")
    scored = run_stream(_source(spark, sf_dir).withColumn("x", F.array("value")), spec, kernel, features="x", out=out).drop("x")
    scored.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(scored.schema).parquet(f"{base}/out"), out, keep=keep)


def _stream(name: str, kernel: Callable[[], K.Kernel], batch: str, out: str = "score") -> None:
    query(f"stream_{name}", lambda s, d: _streamed(s, d, kernel(), out=out), SQL[batch])


query("meter_median_parts", lambda s, d: rounded(prefix_median(events(s, d), EVENTS, "value", "v", part=500), "v"), SQL["meter_median_prefix"])
query("calib_conformal_parts", lambda s, d: rounded(prefix_rank(events(s, d), EVENTS, "value", part=500), "p"), SQL["calib_conformal_all"])
query("det_mad_parts", lambda s, d: rounded(median_absolute_deviation(events(s, d), USERS, "value", part=25), "score", keep=["event_id", "user_id"]), SQL["det_mad"])
query("stream_mad", lambda s, d: _streamed(s, d, K.MedianAbsoluteDeviation(), USERS, keep=["event_id", "user_id"]), SQL["det_mad"])
for _name in ("average", "variance", "sum_squares", "median"):
    _stream(f"{_name}_prefix", lambda n=_name: O.Statistic(n), f"meter_{_name}_prefix", "v")
for _name in ("variance", "max", "median"):
    _stream(f"{_name}_running30", lambda n=_name: O.Statistic(n, 30), f"meter_{_name}_running30", "v")
_stream("zscore", O.Standardised, "post_zscore", "post")
_stream("running_zscore", lambda: O.Standardised(rows=30), "post_running_zscore", "post")
_stream("conformal_w50", lambda: O.Conformal(50), "calib_conformal_w50", "p")
_stream("conformal_all", K.PrefixRank, "calib_conformal_all", "p")
_stream("gauss_z_w100", lambda: O.Standardised("gauss", 100), "calib_gauss_z_w100", "z")
_stream("gauss_tail", lambda: O.Standardised("tail", 100), "calib_gauss_tail", "p")
_stream("sad_mean", lambda: O.Standardised("sad"), "det_sad_mean")
_stream("sad_median", lambda: O.Standardised("sad", subtracted="median"), "det_sad_median")
_stream("storm_w50", lambda: O.ExactStorm(50, 5.0), "det_storm_w50")
_stream("relative_entropy", lambda: O.RelativeEntropy(0, 100), "det_relative_entropy")
_stream("seasonal_trend", lambda: O.SeasonalTrend(24, 12), "seasonal_trend", "residual")


def _stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meters' final values, kept up to date by a stream: the state is a row for each key."""
    base = shared_path(spark, "totals")
    now = totals(_source(spark, sf_dir), ["event_type"], "value")

    def kept(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{batch}")
        df.write.mode("overwrite").parquet(f"{base}/last")

    now.writeStream.outputMode("complete").foreachBatch(kept).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(now.schema).parquet(f"{base}/last").withColumn("count", F.col("count").cast("double")), "count", "sum", "sum_squares", "average", "variance", "min", "max", keep=["event_type"])


query("stream_totals", _stream_totals, "SELECT event_type, round(count(*)::DOUBLE, 6) AS count, round(sum(value), 6) AS sum, round(sum(value * value), 6) AS sum_squares, round(avg(value), 6) AS average, round(var_pop(value), 6) AS variance, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type")


# --- sources --------------------------------------------------------------------------------------------------------------------------------------------------


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as headerless files of numbers, written in ranges of vec_id and read again."""
    path = shared_path(spark, "csv")
    own = embeddings(spark, sf_dir).orderBy("vec_id")
    own.select(*[F.col("features")[i].alias(f"c{i}") for i in range(64)], "label").write.csv(path)
    return rounded(readers.read_dataset(spark, path).withColumn("sum", V.total(F.col("features"))), "sum", keep=["seq", "label"])


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places after a shuffle are a permutation."""
    own = readers.shuffled(embeddings(spark, sf_dir), 61, "vec_id")
    return own.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("places"), F.sum("vec_id").alias("ids"))


query("source_csv", _csv, "SELECT row_number() OVER (ORDER BY vec_id) AS seq, label::INT AS label, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS sum FROM embeddings")
query("source_shuffle", _shuffled, "SELECT count(*) AS n, 1::BIGINT AS first, count(*) AS last, count(*) AS places, sum(vec_id)::BIGINT AS ids FROM embeddings")


def _first_rows(df: DataFrame, n: int) -> np.ndarray:
    """The first rows of the stream: what users hand over as initial rows."""
    return np.array([r["features"] for r in df.orderBy("vec_id").limit(n).collect()])


def _loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return rounded(R.local_outlier_probability(df, "features", _first_rows(df, 100)), "score", keep=["vec_id"])


def _one_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return rounded(R.one_fit(df, "features", K.IsolationForest(50, 64), _first_rows(df, 100)), "score", keep=["vec_id"])


def _initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return rounded(R.monitor(df, VECTORS, "features", K.IsolationForest(20, 64), 120, 30, _first_rows(df, 100)), "score", keep=["vec_id"])


query("det_loop", _loop, _loop_sql())
query("int_onefit", _one_fit)
query("int_refwindow", lambda s, d: rounded(R.monitor(embeddings(s, d), VECTORS, "features", K.IsolationForest(20, 64), 60, 20), "score", keep=["vec_id"]))
query("int_refwindow_initial", _initial)
query("det_iforestasd", lambda s, d: rounded(R.iforest_asd(embeddings(s, d), VECTORS, "features", 64, K.IsolationForest(20, 64)), "score", keep=["vec_id"]))
query("fit_then_score", lambda s, d: rounded(fit_then_score(events(s, d).where("event_id % 2 = 0"), events(s, d).where("event_id % 2 = 1"), USERS, K.MedianAbsoluteDeviation(), value="value"), "score", keep=["event_id", "user_id"]), f"WITH a AS (SELECT *, median(value) {_U} AS m FROM events WHERE event_id % 2 = 0), f AS (SELECT user_id, median(value) AS m, median(abs(value - m)) AS mad FROM a GROUP BY user_id) SELECT event_id, user_id, round(abs((value - m) / (1.4826 * mad + 1e-10)), 6) AS score FROM events LEFT JOIN f USING (user_id) WHERE event_id % 2 = 1")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit norm, xStream, and the mean of the last five scores: steps of columns and a kernel."""
    steps = [
        Columns(lambda df: df.withColumn("features", V.unit("features"))),
        Sequential(K.XStream(), features="features"),
        Columns(lambda df: S.running_average(df, VECTORS, "score", 5, "post")),
    ]
    return rounded(Pipeline(VECTORS, steps).run(embeddings(spark, sf_dir)), "score", "post", keep=["vec_id", "label"])


_UNIT = "list_transform(f, lambda v: v / sqrt(list_dot_product(f, f)))"
query("pipeline_vectors", _pipeline, _xstream_sql(K.XStream(), _UNIT) + " SELECT vec_id, label::INT AS label, round(score, 6) AS score, round(avg(score) OVER (ORDER BY rn ROWS 4 PRECEDING), 6) AS post FROM t JOIN x USING (rn) JOIN embeddings USING (vec_id)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations of event values, smoothed, calibrated, and judged against the label `error`."""
    scored = C.standard_absolute_deviation(events(spark, sf_dir), EVENTS, "value")
    smooth = S.running_average(scored, EVENTS, "score", 5, "smooth")
    z = S.gaussian_z(smooth, EVENTS, "smooth", 100, "z").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return rounded(X.auroc(z, "y", "z"), "value", keep=[])


_Z = f"(smooth - avg(smooth) {_W.format(99)}) / CASE WHEN rn > 1 AND var_pop(smooth) {_W.format(99)} > 0 THEN sqrt(var_pop(smooth) {_W.format(99)}) ELSE 1 END"
query(
    "flagship",
    flagship,
    f"WITH a AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE abs(value - avg(value) {_ALL}) / (sqrt(var_pop(value) {_ALL}) + 1e-10) END AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)), b AS (SELECT *, avg(score) {_W.format(4)} AS smooth FROM a), z AS (SELECT event_type, {_Z} AS z FROM b), "
    + _CURVE.format(s="z", y="(event_type = 'error')::INT", t="z").removeprefix("WITH ")
    + " SELECT round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 6) AS value FROM c",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries"]
