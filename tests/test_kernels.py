"""Kernels: restatements, planted outliers, schedules, streams equal to tables, readers."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import numerics as N
from skerry.operators import columnar as C
from skerry.operators import kernels as K
from skerry.operators import online as O
from skerry.operators import reference_window as R
from skerry.operators.runtime import fit_then_score, run_batch
from skerry.operators.seasonal import series_residual
from skerry.plans.pipeline import Columns, Pipeline, Sequential
from skerry.plans.stream import StreamSpec
from skerry.sources import readers
from skerry.streaming.runner import run_stream

ONE, KEYED = StreamSpec((), ("seq",), "floor(seq / 100)"), StreamSpec(("k",), ("seq",))


def auroc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    return (order[label == 1].mean() - (label.sum() - 1) / 2) / (label == 0).sum()


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(600, 4)), np.zeros(600, int)
    y[rng.choice(np.arange(200, 600), 12, replace=False)] = 1
    x[y == 1] += 8
    return x, y


BOX = ([-5.0] * 4, [13.0] * 4)


@pytest.mark.parametrize(
    "kernel, low",
    [
        (K.HalfSpaceTrees(C.Forest(tuple(BOX[0]), tuple(BOX[1]), 25, 8), 100), False),
        (K.RSHash(C.HashParameters.drawn(*BOX, n=50)), True),
        (K.LODA(), False),
        (K.XStream(20, 30, 10, 50), False),
        (K.RobustRandomCutForest(8, 128), False),
        (K.KitNet(3, 60, 100), False),
        (K.InqMAD(128, 0.1), True),
        (K.Monitor(K.IsolationForest(50, 64), 100, 50), False),
        (K.Fixed(K.LocalOutlierProbability(), np.random.default_rng(9).normal(size=(100, 4))), False),
    ],
)
def test_planted_outliers_are_found(planted, kernel, low):
    x, y = planted
    own = kernel.fresh()
    scores = np.array([own.next(v) for v in x])
    assert np.isfinite(scores).all()
    assert auroc((-scores if low else scores)[200:], y[200:]) > 0.9


def test_columns_and_kernels_agree(spark, planted):
    x, _ = planted
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x[:180])], "seq long, f array<double>")
    forest, cells = C.Forest(tuple(BOX[0]), tuple(BOX[1]), 3, 4, 5), C.HashParameters.drawn(*BOX, n=4)
    get = lambda d: [r["score"] for r in d.orderBy("seq").collect()]
    assert np.allclose(get(C.half_space_trees(df, ONE, "f", forest, 50)), get(run_batch(df, ONE, K.HalfSpaceTrees(forest, 50), features="f")))
    for block in (20_000, 50):
        assert np.allclose(get(C.rs_hash(df, ONE, "f", C.HashParameters(cells.widths, cells.features, cells.shifts, 1.5), block)), get(run_batch(df, ONE, K.RSHash(C.HashParameters(cells.widths, cells.features, cells.shifts, 1.5)), features="f")))


def test_rs_hash_follows_its_definition_where_weights_from_the_first_row_overflow(spark, planted):
    x, _ = planted
    x = x[:180]
    p = C.HashParameters.drawn(*BOX, n=4)
    p = C.HashParameters(p.widths, p.features, p.shifts, 7.0)  # 2.0 ** (7 * 147) is no double
    want = np.zeros(len(x))
    for width, own, shift in zip(p.widths, p.features, p.shifts):
        cells = [tuple(np.floor((row[list(own)] + shift) / width)) for row in x]
        want += [np.log1p(sum(2.0 ** (p.decay * (j - i)) for j in range(i) if cells[j] == cells[i])) for i in range(len(x))]
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "seq long, f array<double>")
    for got in (C.rs_hash(df, ONE, "f", p, 50), run_batch(df, ONE, K.RSHash(p), features="f")):
        assert np.allclose([r["score"] for r in got.orderBy("seq").collect()], want / len(p.widths), rtol=1e-9, atol=1e-15)


def test_medians():
    v = np.random.default_rng(1).random(60)
    own, mad = K.PrefixMedian().fresh(), K.MedianAbsoluteDeviation(False).fresh()
    assert np.allclose([own.next(np.array([x])) for x in v], [np.median(v[: i + 1]) for i in range(60)])
    dev = [abs(v[i] - np.median(v[: i + 1])) for i in range(60)]
    assert np.allclose([mad.next(np.array([x])) for x in v], [(v[i] - np.median(v[: i + 1])) / (1.4826 * np.median(dev[: i + 1]) + 1e-10) for i in range(60)])


def test_knncad_finds_a_level_shift():
    rng = np.random.default_rng(4)
    v = np.sin(np.arange(400) / 5) + rng.normal(scale=0.05, size=400)
    v[300] += 6
    own = K.KNNCAD(80).fresh()
    scores = [own.next(np.array([x])) for x in v]
    # 61 stored scores, the own among them: 60 / 61 is the most there is.
    assert not any(scores[:79]) and max(scores[300:319]) == 60 / 61
    with pytest.raises(ValueError):
        K.KNNCAD(40)


def test_seasonal_esd():
    v = np.tile([0.0, 1.0, 2.0, 1.0], 10) + np.random.default_rng(5).normal(scale=0.1, size=40)
    v[-1] = 9
    for hybrid in (False, True):
        own = K.SeasonalESD(4, 24, 3, hybrid=hybrid).fresh()
        scores = [own.next(np.array([x])) for x in v]
        assert scores[-1] > 0 and not any(scores[:23])
    for bad in ((1, 24, 3), (4, 7, 3), (4, 24, 0), (4, 24, 22)):
        with pytest.raises(ValueError):
            K.SeasonalESD(*bad)
    for alpha in (0.0, 1.0, -0.1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            K.SeasonalESD(4, 24, 3, alpha)
    own = K.STLResidual(4, 24).fresh()
    assert [own.next(np.array([x])) for x in v[:7]] == [0.0] * 7


def test_numerics():
    assert abs(N.chi2_quantile(0.99, 4) - 13.276704) < 1e-5
    assert abs(N.t_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(N.t_quantile(0.025, 3) + 3.182446) < 1e-5
    y = np.tile([1.0, 2.0, 3.0, 6.0], 8) + np.arange(32) * 0.1
    s = N.stl_seasonal(y, 4)
    assert np.allclose(s[8:24] - s[8:24].mean(), y[8:24] - y[8:24].mean() - (np.arange(16) - 7.5) * 0.1, atol=0.05)
    assert np.allclose(N.stl_seasonal(y, 4, robust=False), N._stl(y, 4, robust=False))
    assert sorted(map(sorted, N.single_linkage(np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]]), 2))) == [[0, 1], [2, 3]]


def test_series_residual(spark):
    v = np.tile([0.0, 1.0, 2.0, 1.0], 8)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 1.0)]
    out = {(r["k"], r["seq"]): r["residual"] for r in series_residual(spark.createDataFrame(rows, "k string, seq long, value double"), KEYED, "value", 4).collect()}
    assert out["b", 0] is None or np.isnan(out["b", 0])
    assert np.allclose([out["a", i] for i in range(32)], N.stl_residual(v, 4))


def test_cut_trees_count_and_forget():
    rng = np.random.default_rng(6)
    tree, points = K.CutTree(rng), rng.integers(0, 4, (60, 2)).astype(float)
    for i, p in enumerate(points):
        tree.insert(p, i)
        if i >= 20:
            tree.forget(i - 20)
        assert tree.root.n == len(tree.leaves)
        assert np.array_equal(tree.root.low, points[max(0, i - 19) : i + 1].min(0)) and np.array_equal(tree.root.high, points[max(0, i - 19) : i + 1].max(0))
    import pickle

    own = K.RobustRandomCutForest(2, 16).fresh()
    for p in points[:30]:
        own.next(p)
    other = pickle.loads(pickle.dumps(own))
    assert [own.next(p) for p in points[30:]] == [other.next(p) for p in points[30:]]


def test_schedules():
    assert [t for t, *_ in R.schedule(4, 2, 8)] == [1, 2, 3, 4, 6, 8]
    assert [t for t, *_ in R.schedule(10, 3, 25)] == [*range(1, 10), 12, 15, 18, 21, 24]

    class Seen:
        def fit(self, x, rng):
            self.log = [*getattr(self, "log", []), x[:, 0].tolist()]
            return self

        def scores(self, x):
            return np.zeros(len(x))

    for rows, slide, n in ((4, 2, 8), (10, 3, 25), (5, 5, 17), (3, 7, 20)):
        own = K.Monitor(Seen(), rows, slide).fresh()
        for t in range(1, n + 1):
            own.next(np.array([t]))
        assert own.detector.log == [[float(i) for i in range(a, b + 1)] for _, a, b in R.schedule(rows, slide, n)]


class Mean:
    """A detector without chance: the distance from the mean of the learned rows."""

    def fit(self, x, rng):
        out = Mean()
        out.mean = x.mean(0)
        return out

    def scores(self, x):
        return np.abs(x - self.mean).sum(1)


def test_versions_equal_the_sequential_monitor(spark):
    x = np.random.default_rng(7).random((70, 2))
    rows = [("a" if i % 3 else "b", i, v.tolist(), "kept") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, seq long, f array<double>, other string")
    spark.sparkContext.addPyFile(__file__)
    for size, slide in ((6, 2), (5, 5), (7, 3), (3, 8)):
        got = {r["seq"]: (r["score"], r["other"]) for r in R.monitor(df, KEYED, "f", Mean(), size, slide).collect()}
        assert len(got) == 70
        for key in "ab":
            own = K.Monitor(Mean(), size, slide).fresh()
            for k, i, v, _ in rows:
                if k == key:
                    assert np.isclose(got[i][0], own.next(np.array(v))) and got[i][1] == "kept"


def test_batch_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(8).random((120, 3))
    df = spark.createDataFrame([("a" if i % 2 else "b", i, v.tolist()) for i, v in enumerate(x)], "k string, seq long, f array<double>")
    runs = [sorted((r["seq"], r["score"]) for r in run_batch(df.repartition(n), KEYED, K.LODA(5, 20), features="f").collect()) for n in (1, 2, 7)]
    assert runs[0] == runs[1] == runs[2]
    assert run_batch(df.limit(0), KEYED, K.LODA(), features="f").count() == 0


def test_streams_equal_tables(spark, tmp_path):
    x = np.random.default_rng(8).random(90)
    rows = [("a" if i % 2 else "b", i, float(v)) for i, v in enumerate(x)]
    schema = "k string, seq long, value double"
    want = sorted((r["seq"], r["score"]) for r in run_batch(spark.createDataFrame(rows, schema), KEYED, K.MedianAbsoluteDeviation(), value="value").collect())
    for n, cuts in enumerate(([90], [20, 50, 90], range(13, 104, 13))):
        path, start = f"{tmp_path}/{n}", 0
        for i, end in enumerate(cuts):
            spark.createDataFrame(rows[start:end], schema).coalesce(1).write.parquet(f"{path}/in/{i:03}")
            start = end
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = run_stream(source, KEYED, K.MedianAbsoluteDeviation(), value="value")
        q = out.writeStream.format("memory").queryName(f"stream{n}").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted((r["seq"], r["score"]) for r in spark.table(f"stream{n}").collect()) == want


def test_late_rows_wait_for_the_watermark(spark, tmp_path):
    rows = [("a", i, float(i * i % 17), f"2024-01-01 00:00:{i:02}") for i in range(40)]
    shuffled = [rows[i] for i in np.argsort([i + 3 * (i % 4) for i in range(40)], kind="stable")]
    schema = "k string, seq long, value double, at string"
    for i in range(0, 40, 8):
        spark.createDataFrame(shuffled[i : i + 8], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    spark.createDataFrame([("z", 99, 0.0, "2024-01-02 00:00:00")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/900")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    timed = source.withColumn("ts", F.to_timestamp("at")).withWatermark("ts", "20 seconds")
    out = run_stream(timed, KEYED, K.MedianAbsoluteDeviation(), value="value", event_time="ts")
    q = out.writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["seq"], r["score"]) for r in spark.table("late").where("k = 'a'").collect())
    want = sorted((r["seq"], r["score"]) for r in run_batch(spark.createDataFrame(rows, schema), KEYED, K.MedianAbsoluteDeviation(), value="value").collect())
    assert got == want


def test_pipelines_fuse_kernels(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(np.random.default_rng(1).random(50))], "k string, seq long, value double")
    steps = [Sequential(K.MedianAbsoluteDeviation(), value="value"), Sequential(K.PrefixMedian(), value="score"), Columns(lambda d: d.withColumn("twice", 2 * F.col("score")))]
    p = Pipeline(KEYED, steps)
    assert len(p.fused()) == 2
    first = run_batch(df, KEYED, K.MedianAbsoluteDeviation(), value="value")
    want = sorted((r["seq"], 2 * r["score"]) for r in run_batch(first, KEYED, K.PrefixMedian(), value="score").collect())
    assert sorted((r["seq"], r["twice"]) for r in p.run(df).collect()) == want


def test_fit_then_score(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3])], "k string, seq long, value double")
    out = fit_then_score(df, df.unionAll(spark.createDataFrame([("new", 1, 1.0)], df.schema)), KEYED, K.PrefixMedian(), value="value").collect()
    for r in out:
        assert r["score"] == (None if r["k"] == "new" else 3.0)
    one = fit_then_score(df, df, ONE, K.MedianAbsoluteDeviation(), value="value").collect()
    own = K.MedianAbsoluteDeviation().fresh()
    for r in df.orderBy("seq").collect():
        own.next(np.array([r["value"]]))
    assert len(one) == 5 and all(r["score"] == own.score(np.array([r["value"]])) for r in one)
    assert fit_then_score(df.limit(0), df, KEYED, K.PrefixMedian(), value="value").where("score IS NULL").count() == 5


def mat(name_to_array, compress):
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = io.BytesIO()
    out.write(b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM")
    for name, a in name_to_array.items():
        body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + (struct.pack("<HH", 1, len(name)) + name.encode().ljust(4, b"\0")) + element(9, a.astype("<f8").tobytes(order="F"))
        whole = element(14, body)
        if compress:
            data = zlib.compress(whole)
            whole = struct.pack("<II", 15, len(data)) + data
        out.write(whole)
    return out.getvalue()


@pytest.mark.parametrize("compress", [False, True])
def test_readers(spark, tmp_path, compress):
    x, y = np.arange(10.0).reshape(5, 2), np.array([[0], [1], [0], [0], [1.0]])
    (tmp_path / "d.mat").write_bytes(mat({"X": x, "y": y}, compress))
    (tmp_path / "d.txt").write_text("".join(f"{a},{b},{i}\n" for i, (a, b) in enumerate(x)))
    got = readers.read_dataset(spark, f"file://{tmp_path}/d.mat").orderBy("seq").collect()
    assert [r["features"] for r in got] == x.tolist() and [r["label"] for r in got] == [0, 1, 0, 0, 1]
    got = readers.read_dataset(spark, f"file://{tmp_path}/d.txt").orderBy("seq").collect()
    assert [r["features"] for r in got] == x.tolist() and [r["label"] for r in got] == list(range(5)) and [r["seq"] for r in got] == [1, 2, 3, 4, 5]
    a, b = (readers.read_dataset(spark, f"file://{tmp_path}/d.txt", True, s).orderBy("seq").collect() for s in (1, 1))
    assert a == b and sorted(r["label"] for r in a) == list(range(5)) and [r["seq"] for r in a] == [1, 2, 3, 4, 5]


def test_csv_rows_are_in_the_order_of_files_and_lines(spark, tmp_path, monkeypatch):
    from skerry.plans import stream

    # The first file is the smallest; splits are of some 50 rows.
    at = 0
    for k, rows in enumerate((40, 700, 300)):
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{i}.25,{-i}.5,{i % 7}\n" for i in range(at, at + rows)))
        at += rows
    most, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for small in (stream.SMALL, -1):
            monkeypatch.setattr(stream, "SMALL", small)
            got = readers.read_dataset(spark, f"file://{tmp_path}").collect()
            assert sorted((r["seq"], r["features"][0], r["label"]) for r in got) == [(i + 1, i + 0.25, i % 7) for i in range(at)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("other", ["x", "__to"])
def test_rows_are_numbered_by_columns_of_any_name(spark, monkeypatch, other):
    from skerry.plans import stream

    monkeypatch.setattr(stream, "SMALL", -1)
    df = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("__at"), F.col("id").alias(other))
    got = stream.numbered(df, StreamSpec((), ("__at",), "floor(__at / 300)")).collect()
    assert len(got) == 1000 and all(r["rn"] == r["__at"] + 1 and r[other] * 7 % 1000 == r["__at"] for r in got)


def test_arrays(spark):
    import pandas as pd

    x = pd.DataFrame(np.arange(12.0).reshape(4, 3))
    assert [r["features"] for r in readers.from_arrays(spark, x, [0, 1, 0, 1]).orderBy("seq").collect()] == x.to_numpy().tolist()
    with pytest.raises(AssertionError):
        readers.from_arrays(spark, x, [0, 1])
    assert readers.from_arrays(spark, x, None, True, 3).count() == 4


@pytest.mark.parametrize("name", ["det_hst", "det_hst_kernel", "det_hst_deep", "det_rshash", "det_rshash_kernel", "det_xstream", "det_loda", "det_rrcf", "det_kitnet", "det_inqmad", "det_loop", "int_onefit", "int_refwindow", "int_refwindow_initial", "det_iforestasd", "pipeline_vectors"])
def test_vector_queries_read_all_dimensions(spark, tmp_path, name):
    from skerry import queries

    own = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").limit(200)
    tail = F.transform(F.slice("embedding", 9, 56), lambda x, i: F.when((F.col("vec_id") % 7 + i) % 2 == 0, -x).otherwise(x))
    found = []
    for k, df in enumerate((own, own.withColumn("embedding", F.concat(F.slice("embedding", 1, 8), tail).cast(own.schema["embedding"].dataType)))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        found.append(sorted((r["vec_id"], r["score"]) for r in queries.queries()[name](spark, f"{tmp_path}/{k}").collect()))
    assert len(found[0]) == own.count() and found[0] != found[1]


def meters(v, name, rows):
    f = {"count": len, "sum": np.sum, "sum_squares": lambda x: np.sum(x * x), "average": np.mean, "variance": np.var, "min": np.min, "max": np.max, "median": np.median}[name]
    return [f(np.array(v[max(0, i + 1 - rows) if rows else 0 : i + 1])) for i in range(len(v))]


@pytest.mark.parametrize("rows", [None, 1, 7, 200])
def test_online_statistics(rows):
    v = np.random.default_rng(1).normal(size=150) + 1e6
    for name in ("count", "sum", "sum_squares", "average", "variance", "min", "max", "median"):
        own = O.Statistic(name, rows).fresh()
        assert np.allclose([own.next(np.array([x])) for x in v], meters(v, name, rows), rtol=1e-9)
    own = O.Statistic("average", rows).fresh()
    assert own.next(np.array([np.nan])) is None and own.next(np.array([2.0])) == 2.0
    for bad in (lambda: O.Statistic("mode"), lambda: O.Standardised("other"), lambda: O.SeasonalTrend(1)):
        with pytest.raises(ValueError):
            bad()


def test_online_kernels_equal_plans(spark, tmp_path):
    """Row by row the same as by windows, also after a pickle and with missing values."""
    import pickle

    from skerry.functions import scores as S

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=160), 1) * 10
    rows = [("a", i, None if i in (5, 77) else float(x)) for i, x in enumerate(v)]
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, "k string, seq long, value double").write.parquet(path)
    df = spark.read.parquet(path)
    spec = StreamSpec(("k",), ("seq",), "floor(seq / 50)")
    cases = [
        (O.Standardised(), S.zscore(df, spec, "value", "score")),
        (O.Standardised(rows=12), S.running_zscore(df, spec, "value", 12, "score")),
        (O.Standardised("gauss", 12), S.gaussian_z(df, spec, "value", 12, "score")),
        (O.Standardised("tail", 12), S.gaussian_tail(df, spec, "value", 12, "score")),
        (O.Standardised("sad"), C.standard_absolute_deviation(df, spec, "value")),
        (O.Standardised("sad", subtracted="median", absolute=False), C.standard_absolute_deviation(df, spec, "value", "median", False)),
        (O.RelativeEntropy(-30, 30, rows=20), C.relative_entropy(df, spec, "value", -30, 30, rows=20)),
        (O.SeasonalTrend(5, 8), C.seasonal_trend(df, spec, "value", 5, 8, out="score")),
    ]
    for kernel, plan in cases:
        own, got = kernel.fresh(), []
        for i, (_, _, x) in enumerate(rows):
            got.append(own.next(np.array([np.nan if x is None else x])))
            if i == 60:
                own = pickle.loads(pickle.dumps(own))
                frozen = own.score(np.array([1.0]))
                assert own.score(np.array([1.0])) == frozen
        want = [r["score"] for r in plan.orderBy("seq").collect()]
        assert [x is None for x in got] == [x is None for x in want], kernel
        assert np.allclose([x for x in got if x is not None], [x for x in want if x is not None], atol=1e-9)


def test_frozen_season():
    """A frozen decomposer takes the phase of the next row and the trend of the last ones, and does not change."""
    own = O.SeasonalTrend(3).fresh()
    for x in np.tile([1.0, 2.0, 3.0], 8):
        own.next(np.array([x]))
    assert [own.score(np.array([1.0])) for _ in range(3)] == [0.0] * 3


def test_chunks_of_a_stream(spark, planted):
    """Kernels with a bounded memory give the same in chunks, each of which is a task."""
    x, _ = planted
    df = spark.createDataFrame([(i + 1, "ab"[i % 2], v.tolist(), float(v[0])) for i, v in enumerate(x[:300])], "seq long, k string, f array<double>, value double")
    forest = C.Forest(tuple(BOX[0]), tuple(BOX[1]), 3, 9, 5)
    spec = StreamSpec(("k",), ("seq",), "floor(seq / 100)")
    for kernel, source in ((K.HalfSpaceTrees(forest, 20), "f"), (K.XStream(6, 5, 4, 15), "f"), (O.ExactStorm(30, 2.0), "f"), (O.Conformal(25), "value"), (K.STLResidual(4, 20, robust=False), "value"), (O.Statistic("median", 9), "value"), (O.Standardised("tail", 31), "value")):
        args = {"value" if source == "value" else "features": source}
        whole = [(r["seq"], r["score"]) for r in run_batch(df, StreamSpec(("k",), ("seq",)), kernel, **args).orderBy("seq").collect()]
        parts = [(r["seq"], r["score"]) for r in run_batch(df, spec, kernel, chunk=40, **args).orderBy("seq").collect()]
        assert [a for a, _ in whole] == [a for a, _ in parts]
        assert np.allclose([np.nan if s is None else s for _, s in whole], [np.nan if s is None else s for _, s in parts], atol=1e-9, equal_nan=True), kernel
    assert run_batch(df, StreamSpec((), ("seq",), "floor(seq / 100)"), O.ExactStorm(30, 2.0), features="f", chunk=40).count() == 300


def test_scores_leave_the_state(planted):
    x, _ = planted
    for kernel in (K.HalfSpaceTrees(C.Forest(tuple(BOX[0]), tuple(BOX[1]), 5, 6), 50), K.RSHash(C.HashParameters.drawn(*BOX, n=9)), K.LODA(), K.XStream(6, 5, 4, 15), K.RobustRandomCutForest(2, 32), K.KitNet(3, 20, 30), K.InqMAD(32, 0.1), K.Monitor(K.IsolationForest(5, 16), 30, 10), O.ExactStorm(20, 1.0)):
        own = kernel.fresh()
        for v in x[:120]:
            own.next(v)
        before = [own.score(v) for v in x[120:130]]
        assert before == [own.score(v) for v in x[120:130]] and np.isfinite(before).all()


def test_an_initial_window_of_half_space_trees(planted):
    x, _ = planted
    forest = C.Forest(tuple(BOX[0]), tuple(BOX[1]), 5, 6)
    plain, own = K.HalfSpaceTrees(forest, 50).fresh(), K.HalfSpaceTrees(forest, 50, x[:50]).fresh()
    for v in x[:50]:
        plain.next(v)
    assert [plain.next(v) for v in x[50:180]] == [own.next(v) for v in x[50:180]]


def test_loess_is_local():
    """Against dense weights of all places."""
    rng = np.random.default_rng(7)
    for n, span in ((20, 7), (20, 6), (9, 15), (40, 40)):
        y, weights = rng.normal(size=n), rng.random(n)
        at = np.arange(-1, n + 1, dtype=float)
        far = np.abs(at[:, None] - np.arange(n))
        width = np.sort(far, axis=1)[:, min(span, n) - 1, None] + max(span - n, 0) // 2
        w = np.where(far <= 0.999 * width, np.where(far <= 0.001 * width, 1, (1 - np.minimum(far / width, 1) ** 3) ** 3), 0) * weights
        want = [np.polynomial.Polynomial.fit(np.arange(n)[k > 0], y[k > 0], 1, w=np.sqrt(k[k > 0]))(a) for a, k in zip(at, w)]
        assert np.allclose(N.loess(y, span, at, weights), want)


def test_known_datasets(spark, tmp_path):
    (tmp_path / "glass.mat").write_bytes(mat({"X": np.arange(6.0).reshape(3, 2), "y": np.array([[0], [1], [0.0]])}, True))
    assert [r["label"] for r in readers.dataset(spark, f"file://{tmp_path}", "glass.mat").orderBy("seq").collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        readers.dataset(spark, str(tmp_path), "other.mat")


class Labelled:
    """A detector that learns from labels: the distance from the mean of the rows that are labelled 0."""

    def fit(self, x, rng, y):
        out = Labelled()
        out.mean = x[y == 0].mean(0) if (y == 0).any() else np.zeros(x.shape[1])
        return out

    def scores(self, x):
        return np.abs(x - self.mean).sum(1)


def test_detectors_that_learn_from_labels(spark):
    x = np.random.default_rng(7).random((60, 2))
    rows = [("a" if i % 3 else "b", i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, seq long, f array<double>, y int")
    spark.sparkContext.addPyFile(__file__)
    initial, labels = x[:10] + 1, np.arange(10) % 2
    for first, more in ((None, {}), (initial, {"initial": initial, "initial_labels": labels})):
        got = {r["seq"]: r["score"] for r in R.monitor(df, KEYED, "f", Labelled(), 6, 4, label="y", **more).collect()}
        for key in "ab":
            own = K.Monitor(Labelled(), 6, 4, first, True, labels if first is not None else None).fresh()
            for k, i, v, y in rows:
                if k == key:
                    assert np.isclose(got[i], own.next(np.array(v), y))
    one = R.one_fit(df, "f", Labelled(), initial, labels=labels).collect()
    mean = initial[labels == 0].mean(0)
    assert np.allclose([r["score"] for r in one], [np.abs(np.array(r["f"]) - mean).sum() for r in one])
    with pytest.raises(ValueError):
        K.Monitor(Labelled(), 6, 4, initial, True)
    assert R.iforest_asd(df, KEYED, "f", 8, K.IsolationForest(3, 8), initial=initial).where("score > 0").count() == 60


def test_order_statistics_in_parts(spark):
    """Long and short streams, ties, a value with most of the rows, missing values at edges of chunks, and null keys: the same as by the kernels."""
    from skerry.operators import order

    rng = np.random.default_rng(9)
    rows = [("a", i, float(v)) for i, v in enumerate(np.round(rng.normal(size=300), 1))]
    rows += [(None, i, 7.0 if i % 3 else float(v)) for i, v in enumerate(rng.normal(size=200) * 5)]
    rows += [("b", i, None if i < 25 or 60 <= i < 90 else float(i * 37 % 101)) for i in range(150)] + [("c", i, 1.0) for i in range(90)] + [("d", i, float(i)) for i in range(5)] + [("e", i, None) for i in range(70)]
    df = spark.createDataFrame(rows, "k string, seq long, value double").repartition(3)
    spec = StreamSpec(("k",), ("seq",), "floor(seq / 40)")
    plain = StreamSpec(("k",), ("seq",))
    get = lambda d, c: {(r["k"], r["seq"]): r[c] for r in d.collect()}
    for f, kernel in ((order.prefix_median, K.PrefixMedian()), (order.prefix_rank, K.PrefixRank()), (order.median_absolute_deviation, K.MedianAbsoluteDeviation())):
        want, got = get(run_batch(df, plain, kernel, value="value"), "score"), get(f(df, spec, "value", out="score", part=20), "score")
        assert set(want) == set(got) and len(got) == len(rows)
        for key, v in want.items():
            assert (v is None) == (got[key] is None) and (v is None or np.isclose(v, got[key])), (f, key, v, got[key])
    assert order.prefix_median(df.limit(0), spec, "value", part=20).count() == 0


def test_counts_by_bucket():
    from skerry.operators.order import Counts, buckets

    rng = np.random.default_rng(1)
    x, bounds = rng.integers(0, 30, 500) / 2, np.array([2.0, 5.5, 9.0])
    own = buckets(bounds, x)
    assert ((own % 2 == 1) == np.isin(x, bounds)).all() and (np.diff(own[np.argsort(x, kind="stable")]) >= 0).all()
    counts, held = Counts(np.bincount(own[:100], minlength=7)), sorted(own[:100].tolist())
    for b in own[100:].tolist():
        counts.add(b)
        held = sorted([*held, b])
        k = int(rng.integers(len(held)))
        assert counts.upto(b) == sum(v <= b for v in held) and counts.find(k) == (held[k], k - sum(v < held[k] for v in held))
