"""Scans, windows, scores, vectors and metrics against NumPy on every prefix, with and without blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import meters as M
from skerry.functions import metrics as X
from skerry.functions import scores as S
from skerry.functions import vectors as V
from skerry.operators import columnar as C
from skerry.plans.stream import StreamSpec, numbered

PLAIN, BLOCKS = StreamSpec(("k",), ("seq",)), StreamSpec(("k",), ("seq",), "floor(seq / 7)")
NUMPY = {"count": len, "sum": np.sum, "sum_squares": lambda x: np.sum(x * x), "average": np.mean, "variance": np.var, "min": np.min, "max": np.max, "median": np.median}


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(61)
    rows = [(k, i + 1, float(v)) for k in ("a", "b") for i, v in enumerate(rng.random(100))]
    return spark.createDataFrame(rows, "k string, seq long, value double").repartition(3).cache()


def by_key(df, column):
    out = {}
    for r in df.orderBy("k", "seq").collect():
        out.setdefault(r["k"], []).append(r[column])
    return out


@pytest.mark.parametrize("spec", [PLAIN, BLOCKS])
def test_meters_on_every_prefix_and_window(stream, spec, monkeypatch):
    values = by_key(stream, "value")
    prefix = M.track(stream, spec, "value", {n: m for n, m in M.METERS.items() if n != "median"})
    import skerry.plans.stream as streams

    monkeypatch.setattr(streams, "CHUNK", 10)
    last = M.running(stream, spec, "value", M.METERS, 25)
    for name, f in NUMPY.items():
        for k, v in values.items():
            if name != "median":
                assert np.allclose(by_key(prefix, name)[k], [f(np.array(v[: i + 1])) for i in range(100)])
            assert np.allclose(by_key(last, name)[k], [f(np.array(v[max(0, i - 24) : i + 1])) for i in range(100)])


def test_sliding_chunks_repeat_rows(stream):
    from skerry.plans.stream import sliding

    out = sliding(stream, BLOCKS, 5, lambda w: [F.sum("value").over(w).alias("s")], chunk=6)
    assert out.count() == 200
    for k, v in by_key(stream, "value").items():
        assert np.allclose(by_key(out, "s")[k], [sum(v[max(0, i - 4) : i + 1]) for i in range(100)])


def test_numbers_missing_values_and_empty_streams(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, None), ("a", 4, 3.0), (None, 1, 5.0)], "k string, seq long, value double")
    for spec in (PLAIN, BLOCKS):
        rows = {(r["k"], r["seq"]): r for r in M.track(df, spec, "value", M.METERS | {"median": M.MAX}).collect()}
        assert rows["a", 3]["average"] == 1.0 and rows["a", 4]["max"] == 3.0 and rows["a", 4]["count"] == 4 and rows[None, 1]["sum"] == 5.0
        assert M.track(df.limit(0), spec, "value", {"v": M.SUM}).count() == 0
    assert sorted(r["rn"] for r in numbered(df, BLOCKS).collect()) == [1, 1, 2, 3, 4]


def test_absolute_and_removal(spark, stream):
    out = by_key(M.running(stream.withColumn("value", -F.col("value")), PLAIN, "value", {"v": M.absolute(M.AVERAGE)}, 3), "v")
    assert all(x > 0 for v in out.values() for x in v)
    rows = [("a", x, 1) for x in (1.0, 2.0, 2.0, 9.0)] + [("a", 9.0, -1), ("a", 2.0, -1)]
    r = M.retracted(spark.createDataFrame(rows, "k string, value double, op int"), PLAIN, "value", "op").first()
    assert (r["n"], r["sum"], r["max"], r["median"], r["variance"]) == (2, 3.0, 2.0, 1.5, 0.25)


def test_scores(stream):
    values = by_key(stream, "value")
    z = by_key(S.zscore(stream, BLOCKS, "value"), "post")
    p = by_key(S.conformal(stream, BLOCKS, "value", 10), "p")
    every = by_key(S.conformal(stream, PLAIN, "value", None), "p")
    tail = by_key(S.gaussian_tail(stream, PLAIN, "value", 20), "p")
    for k, v in values.items():
        v = np.array(v)
        assert z[k][0] is None and np.allclose(z[k][1:], [(v[i] - v[: i + 1].mean()) / v[: i + 1].std() for i in range(1, 100)])
        assert np.allclose(p[k], [(v[max(0, i - 9) : i + 1] > v[i]).mean() for i in range(100)])
        assert np.allclose(every[k], [(v[: i + 1] > v[i]).mean() for i in range(100)])
        w = [v[max(0, i - 19) : i + 1] for i in range(100)]
        assert np.allclose(tail[k], [0.5 * math.erfc(-(x[-1] - x.mean()) / (x.std() or 1) / math.sqrt(2)) for x in w])


def test_buckets():
    assert sorted(sum(S.buckets(10, 5), [])) == list(range(10))
    assert sorted(sum(S.buckets(10, 4, "dynamic"), [])) == list(range(10))
    assert len(sum(S.buckets(10, 5, bootstrap=True), [])) == 10
    for bad in ((10, 4, "static"), (3, 5, "dynamic"), (10, 5, "other")):
        with pytest.raises(ValueError):
            S.buckets(*bad)


def test_vectors(spark):
    x = np.random.default_rng(1).random((20, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [2.0] * 5), (100, [0.0] * 5)], "i int, f array<double>")
    get = lambda c: {r["i"]: r["v"] for r in df.select("i", c.alias("v")).collect()}
    scaled = get(V.standardised("f"))
    assert scaled[99] == [None] * 5 and np.allclose([scaled[i] for i in range(20)], (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True))
    for power in (0.5, 1, 2, 3, math.inf):
        assert np.allclose([get(V.unit("f", power))[i] for i in range(20)], x / np.linalg.norm(x, power, axis=1)[:, None])
    assert get(V.unit("f"))[100] == [None] * 5
    for m in (V.streamhash_matrix(12, 5), V.gaussian_matrix(3, 5), V.sparse_matrix(4, 5)):
        assert np.allclose([get(V.projected("f", m))[i] for i in range(20)], x @ m.T)
    assert V.murmur3(b"test") == 0xBA6BD213
    for bad in (0, "auto"):
        with pytest.raises((ValueError, TypeError)):
            V.gaussian_matrix(bad, 5)


def test_projectors(spark):
    x = np.random.default_rng(1).random((9, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, f array<double>")
    for p in (V.Gaussian(3, 7), V.Sparse(4, 0.5, 2), V.StreamHash(6)):
        got = V.project(df, "f", p, out="p").orderBy("i").collect()
        assert np.allclose([r["p"] for r in got], x @ p.matrix(5).T)
    assert V.project(df.limit(0), "f", V.Gaussian(3)).count() == 0


def test_metrics(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 200), np.round(rng.normal(size=200), 1) * 30
    df = spark.createDataFrame([(i + 1, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "seq int, y int, s double")
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert np.isclose(X.auroc(df, "y", "s").first()["value"], np.mean(pairs))
    order = sorted(set(s), reverse=True)
    hits = [((s >= t) & (y == 1)).sum() for t in order]
    ap = sum((h - p) / y.sum() * h / (s >= t).sum() for h, p, t in zip(hits, [0, *hits], order))
    assert np.isclose(X.aupr(df, "y", "s").first()["value"], ap)
    assert X.auroc(df.where("y = 1"), "y", "s").first()["value"] is None
    three = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0)], "seq int, y int, p int")
    assert X.recall(three, "y", F.col("p")).first()["value"] == 0.5 and X.precision(three.where("p = 0"), "y", F.col("p")).first()["value"] == 0.0
    spec = StreamSpec((), ("seq",))
    metric = lambda d, by: X.precision(d, "y", F.lit(1), by)
    parts = [y[i : i + 30].mean() for i in range(0, 200, 30)]
    assert np.isclose(X.windowed(df, spec, metric, 30).first()["value"], np.mean(parts[:-1]))
    assert np.isclose(X.windowed(df, spec, metric, 30, False).first()["value"], np.mean(parts))
    assert np.isclose(X.windowed(df, spec, metric, 300).first()["value"], y.mean())


def test_seasonal_trend_removes_a_season(spark):
    df = spark.createDataFrame([("a", i + 1, float(i % 3 + 1)) for i in range(24)], "k string, seq long, value double")
    out = by_key(C.seasonal_trend(df, BLOCKS, "value", 3), "residual")["a"]
    assert np.allclose(out[-6:], 0)
    with pytest.raises(ValueError):
        C.seasonal_trend(df, BLOCKS, "value", 1)


def test_storm_and_models(spark, stream):
    out = by_key(C.exact_storm(stream.withColumn("f", F.array("value", F.lit(0.0))), BLOCKS, "f", 20, 0.1), "score")
    for k, v in by_key(stream, "value").items():
        assert np.allclose(out[k], [np.mean(np.abs(np.array(v[max(0, i - 19) : i]) - v[i]) < 0.1) if i else 0 for i in range(100)])
    a, b = (by_key(C.random_model(stream.repartition(n), PLAIN, 1), "score") for n in (1, 5))
    assert a == b and 0.3 < np.mean(a["a"]) < 0.7
    with pytest.raises(ValueError):
        C.standard_absolute_deviation(stream, PLAIN, "value", "asd")
    with pytest.raises(Exception, match="labels"):
        C.perfect_model(stream.withColumn("label", F.lit(None)), "label").collect()
    assert not C.higher_is_anomalous("exact_storm") and C.higher_is_anomalous("loda")


def test_the_entry_point_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_variance_of_large_numbers(spark):
    """Deviations that sums of squares would lose: with and without blocks, with a drift, an empty first block and missing values."""
    rows = [("a", i, 1e9 + i % 2) for i in range(1, 101)] + [("b", i, 1e9 * (i > 50) + i % 3) for i in range(1, 101)] + [("c", i, None if i < 20 else float(i)) for i in range(1, 60)] + [(None, i, 5.0) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "k string, seq long, value double")
    for spec in (PLAIN, BLOCKS):
        got = {}
        for r in M.track(df, spec, "value", {"v": M.VARIANCE}).orderBy("seq").collect():
            got.setdefault(r["k"], []).append(r["v"])
        for k in ("a", "b", "c", None):
            v = [x for key, _, x in rows if key == k]
            want = [np.var([y for y in v[: i + 1] if y is not None]) if any(y is not None for y in v[: i + 1]) else None for i in range(len(v))]
            assert [x is None for x in got[k]] == [x is None for x in want]
            assert np.allclose([x for x in got[k] if x is not None], [x for x in want if x is not None], rtol=1e-9, atol=1e-6)
        assert abs(got["a"][-1] - 0.25) < 1e-6
    z = S.zscore(df.where("k = 'a'"), BLOCKS, "value").orderBy("seq").collect()
    assert abs(z[-1]["post"] + 1) < 1e-4


def test_small_tables_are_windowed_whole(spark, tmp_path, monkeypatch):
    """Both plans give the same; the small one has one exchange."""
    import skerry.plans.stream as streams

    rng = np.random.default_rng(3)
    path = f"{tmp_path}/t"
    spark.createDataFrame([("ab"[i % 2], i, float(v)) for i, v in enumerate(rng.normal(size=200))], "k string, seq long, value double").write.parquet(path)
    plans = []
    for most in (streams.SMALL, -1):
        monkeypatch.setattr(streams, "SMALL", most)
        df = spark.read.parquet(path)
        a = by_key(S.running_zscore(S.zscore(df, BLOCKS, "value", "z").na.fill(0.0), BLOCKS, "z", 9, "post"), "post")
        plans.append((streams.small(df), a, by_key(C.relative_entropy(df, BLOCKS, "value", -3, 3, rows=20), "score"), by_key(C.seasonal_trend(df, BLOCKS, "value", 4, 6), "residual")))
    assert plans[0][0] and not plans[1][0]
    for x, y in zip(plans[0][1:], plans[1][1:]):
        for k in "ab":
            assert np.allclose([np.nan if v is None else v for v in x[k]], [np.nan if v is None else v for v in y[k]], equal_nan=True)


def test_normal_distribution(spark):
    import duckdb

    z = [0.0, 1e-9, 0.3, -0.3, 1.0, -2.5, 5.0, -7.0, 7.08, -7.08, 12.0, -37.5, 40.0]
    df = spark.createDataFrame([(v,) for v in z] + [(None,), (float("nan"),)], "z double")
    got = [r["p"] for r in df.select(S.normal_cdf("z").alias("p")).collect()]
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in z]
    assert np.allclose(got[:-2], want, rtol=1e-6, atol=1e-15) and got[-2:] == [None, None]
    other = [duckdb.connect().execute(f"SELECT {S.normal_cdf_sql('z')} FROM (SELECT {v!r}::DOUBLE AS z)").fetchone()[0] for v in z]
    assert np.allclose(other, want, rtol=1e-6, atol=1e-15)


def test_frozen_scores(spark, stream):
    """Fitted on the first 60 rows of each stream, applied to the others, which change nothing."""
    first, rest = stream.where("seq <= 60"), stream.where("seq > 60").union(spark.createDataFrame([("new", 1, 1.0)], stream.schema))
    values = by_key(stream, "value")
    for method, rows, f in (
        ("average", None, lambda w, v: w.mean()),
        ("max", 9, lambda w, v: w.max()),
        ("median", 9, lambda w, v: np.median(w)),
        ("zscore", None, lambda w, v: (v - w.mean()) / w.std()),
        ("gauss", 9, lambda w, v: (v - w.mean()) / w.std()),
        ("gauss_tail", 9, lambda w, v: 0.5 * math.erfc(-(v - w.mean()) / w.std() / math.sqrt(2))),
        ("conformal", 9, lambda w, v: (w > v).mean()),
        ("conformal", None, lambda w, v: (w > v).mean()),
    ):
        for spec in (PLAIN, BLOCKS):
            got = by_key(S.frozen(first, rest, spec, "value", method, rows), "post")
            assert got["new"] == [None]
            for k, v in values.items():
                w = np.array(v[:60][-rows if rows else 0 :])
                assert np.allclose(got[k], [f(w, x) for x in v[60:]])


def test_hash_parameters():
    p = C.HashParameters.drawn([0.0] * 6 + [1.0], [1.0] * 7, n=200, seed=3)
    s = max(1000.0, 1 / (1 - 2**-0.015))
    for f, own, shift in zip(p.widths, p.features, p.shifts):
        t = math.log(s) / math.log(max(2, 1 / f))
        assert s**-0.5 <= f <= 1 - s**-0.5 and min(6, math.ceil(1 + t / 2)) <= len(own) <= max(math.floor(t), math.ceil(1 + t / 2)) and len(set(own)) == len(own) == len(shift)
        assert 6 not in own and all(0 <= a < f for a in shift)
    assert all(own == () for own in C.HashParameters.drawn([1.0], [1.0], n=3).features)


def test_the_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from skerry import cluster

    def session(master, path):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: path), sparkContext=SimpleNamespace(master=master))

    assert cluster.shared_dir(session("local[4]", None)) == cluster.LOCAL_SHARED and cluster.shared_dir(session("spark://x", "hdfs:///c/")) == "hdfs:///c"
    with pytest.raises(RuntimeError):
        cluster.shared_dir(session("spark://x", None))
