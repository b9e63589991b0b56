import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import aggs, exprs
from millrace.operators import compose, metrics, numdiff, ordering, prep, validate
from millrace.sources.delimited import load_csv

NAN = float("nan")


def frame(spark, values, parts=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, x double")
    return df.repartition(parts) if parts else df


@pytest.mark.parametrize("method,values,want", [
    ("average", [10, 20, 20, 30], [1, 2.5, 2.5, 4]), ("dense", [10, 20, 20, 30], [1, 2, 2, 3]),
    ("ordinal", [20, 10, 20], [2, 1, 3]), ("average", [3, NAN, 1], [2, NAN, 1]),
])
@pytest.mark.parametrize("parts", [1, 7])
def test_rank(spark, method, values, want, parts):
    got = ordering.rank(frame(spark, map(float, values), parts), "x", "row_id", method).orderBy("row_id").collect()
    for r, w in zip(got, want, strict=True):
        assert (math.isnan(r["rank"]) and math.isnan(w)) or r["rank"] == w


@pytest.mark.parametrize("how,want", [("linear", 2.5), ("lower", 2), ("higher", 3), ("midpoint", 2.5)])
def test_percentile(spark, how, want):
    assert aggs.percentile(frame(spark, [1.0, 2.0, 3.0, 4.0, NAN]), "x", 50, how).first()["value"] == want


def test_percentile_by_group_and_empty(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("g", F.col("row_id") % 2)
    assert {r["g"]: r["value"] for r in aggs.quantile(df, "x", 0.5, "higher", by="g").collect()} == {0: 3.0, 1: 4.0}
    assert aggs.quantile(df.where("false"), "x", [0.5], "lower").first()["value"] is None
    with pytest.raises(ValueError):
        aggs.quantile(df, "x", 1.5)


def test_aggregates_skip_nan(spark):
    r = frame(spark, [1.0, 2.0, NAN, 3.0, 4.0, None]).agg(aggs.mean("x").alias("m"), aggs.median("x").alias("d"), aggs.std("x", 1).alias("s"), aggs.minimum("x").alias("l"), aggs.maximum("x").alias("h")).first()
    assert (r["m"], r["d"], r["l"], r["h"]) == (2.5, 2.5, 1.0, 4.0) and abs(r["s"] - 1.2909944487358056) < 1e-12


def test_histogram(spark):
    assert [r["n"] for r in aggs.histogram(frame(spark, [1.0, 2.0, NAN, 3.0]), "x", 2).orderBy("bin").collect()] == [1, 2]
    assert sum(r["n"] for r in aggs.histogram(frame(spark, [5.0, 5.0]), "x", 4).collect()) == 2
    assert sum(r["n"] for r in aggs.histogram(frame(spark, [NAN]), "x", 4).collect()) == 0


def test_order_statistics_search_and_topk(spark):
    df = frame(spark, [7.0, 1.0, 3.0, 9.0, 5.0], 3)
    assert ordering.quickselect(df, "x", 2) == 5
    with pytest.raises(ValueError):
        ordering.quickselect(df, "x", 5)
    assert [r["row_id"] for r in ordering.topk(frame(spark, [1.0, 9.0, 3.0, 7.0, 5.0]), "x", 3, True, "row_id").collect()] == [1, 3, 4]
    values = frame(spark, [1.0, 2.0, 2.0, 2.0, 3.0])
    probes = spark.createDataFrame([(2.0,), (0.0,), (9.0,), (2.5,)], "p double")
    got = {r["p"]: (r["idx"], r["found"]) for r in ordering.search_sorted(values, "x", probes, "p").collect()}
    assert got == {2.0: (1, True), 0.0: (0, False), 9.0: (5, False), 2.5: (4, False)}


def test_multi_key_directions(spark):
    assert ordering.effective_directions([False, True], True) == [False, False]
    assert ordering.effective_directions([False, False], True) == [False, True]
    assert ordering.effective_directions([True, False], True) == [True, False]
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "a long, b long")
    assert [tuple(r) for r in ordering.sort_rows(df, [0, -1]).collect()] == [(1, 1), (1, 2), (2, 1)]
    with pytest.raises(ValueError):
        ordering.sort_rows(df, [5])


def test_batches(spark):
    df = frame(spark, map(float, range(10)))
    assert ordering.make_batches(df, 4, "row_id").select("batch").distinct().count() == 3
    assert ordering.make_batches(df, 4, "row_id", drop_last=True).count() == 8
    a = ordering.make_batches(df, 4, "row_id", shuffle=True, seed=1).orderBy("row_id").collect()
    b = ordering.make_batches(df.repartition(5), 4, "row_id", shuffle=True, seed=1).orderBy("row_id").collect()
    assert a == b


def test_expressions(spark):
    r = spark.range(1).select(
        exprs.sigmoid(F.lit(-1000.0)).alias("a"), exprs.sigmoid(F.lit(1000.0)).alias("b"),
        exprs.logsumexp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("c"), exprs.logsumexp(F.array(F.lit(float("-inf")))).alias("d"),
        exprs.euclidean_distance(F.array(F.lit(0), F.lit(0)), F.array(F.lit(3), F.lit(4))).alias("e"),
        exprs.cosine_similarity(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(2))).alias("f"),
        exprs.manhattan_distance(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(3), F.lit(2), F.lit(1))).alias("g"),
        exprs.gini([F.lit(1), F.lit(1)]).alias("h"), exprs.hoeffding_bound(0, 0.1).alias("i"),
    ).first()
    assert (r["a"], r["b"], r["d"], r["e"], r["f"], r["g"], r["h"], r["i"]) == (0.0, 1.0, float("-inf"), 5.0, 0.0, 4.0, 0.5, 1.0)
    assert abs(r["c"] - 1000 - math.log(2)) < 1e-9


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 0.0), (3, 0.0, 0.0), (4, NAN, 1.0)], "id long, y double, p double")
    assert metrics.precision(df, "y", "p") == metrics.recall(df, "y", "p") == metrics.f1(df, "y", "p") == 0.5
    assert metrics.confusion_matrix(df, "y", "p") == [[1, 1], [1, 1]]
    with pytest.raises(ValueError):
        metrics.accuracy(df.withColumn("p", F.lit(0.7)), "y", "p")
    s = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.4), (2, 1, 0.35), (3, 1, 0.8)], "id long, y int, s double")
    assert metrics.auc(metrics.roc_curve(s, "y", "s", "id")).first()["auc"] == 0.75 == metrics.pooled_auc(s, "y", "s").first()["auc"]
    with pytest.raises(ValueError):
        metrics.roc_curve(s.where("y = 1"), "y", "s", "id")


def test_preprocessing(spark):
    df = spark.createDataFrame([(5.0, NAN, "A"), (5.0, 4.0, "B"), (5.0, 6.0, "A")], "a double, b double, c string")
    assert [r["a"] for r in prep.MinMaxScaler(["a"], (2.0, 4.0)).fit_transform(df).collect()] == [2.0] * 3
    assert [r["a"] for r in prep.StandardScaler(["a"]).fit_transform(df).collect()] == [0.0] * 3
    assert prep.SimpleImputer(["b"], "median").fit_transform(df).first()["b"] == 5
    enc = prep.OneHotEncoder(["c"], "ignore").fit(df)
    assert tuple(enc.transform(spark.createDataFrame([("Z",)], "c string")).select("c_A", "c_B").first()) == (0, 0)
    with pytest.raises(Exception, match="unknown category"):
        prep.OneHotEncoder(["c"]).fit(df).transform(spark.createDataFrame([("Z",)], "c string")).collect()
    with pytest.raises(ValueError):
        prep.StandardScaler(["a"]).transform(df)
    with pytest.raises(ValueError):
        prep.StandardScaler(["a"]).fit(df.where("false"))
    p = compose.Pipeline([("fill", prep.SimpleImputer(["b"])), ("scale", prep.StandardScaler(["b"]))])
    assert abs(p.fit_transform(df).agg(F.sum("b")).first()[0]) < 1e-12
    with pytest.raises(ValueError):
        p.predict(df)


def test_derivatives(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    g = df.select(numdiff.grad(lambda v: v[0] * v[0] + v[1] * v[1], ["a", "b"])).first()[0]
    j = df.select(numdiff.jacobian(lambda v: [v[0] + v[1], v[0] * v[1]], ["a", "b"])).first()[0]
    assert all(abs(x - y) < 1e-4 for x, y in zip([*g, *j[0], *j[1]], [6, 8, 1, 1, 4, 3]))
    with pytest.raises(TypeError):
        numdiff.grad(1, ["a"])


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("h1,h2\n1,2 # note\n\n3,\nabc,4\n")
    rows = load_csv(spark, str(f), skip_header=1, missing_value=-1.0).collect()
    assert sorted(map(tuple, rows)) == [(-1.0, 4.0), (1.0, 2.0), (3.0, -1.0)]
    (tmp_path / "b.csv").write_text("1,2\n3\n")
    with pytest.raises(ValueError):
        load_csv(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        load_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(TypeError):
        load_csv(spark, 3)


def test_check_array(spark):
    df = frame(spark, [1.0, NAN])
    with pytest.raises(ValueError):
        validate.check_array(df, ["x"], allow_nan=False)
    with pytest.raises(ValueError):
        validate.check_array(df, ["x"], ensure_1d=True, ensure_2d=True)
    assert validate.check_array(df, ["x"]).count() == 2


def test_plans_stay_native(spark):
    plan = ordering.topk(frame(spark, [1.0, 2.0]), "x", 1)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_nearest_of_many_queries(spark):
    queries = spark.range(10_050).select(F.col("id").alias("q"), (F.col("id") % 4 + 0.1).alias("a"))
    points = spark.createDataFrame([(i, float(i)) for i in range(4)], "p long, b double")
    out = ordering.pairwise_nearest(queries, points, F.abs(F.col("a") - F.col("b")), 2, "q", "p")
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert len(rows) == 2 * 10_050
    for r in rows:
        m = r["q"] % 4
        assert r["p"] == (m if r["nearest"] == 1 else m + 1 if m < 3 else 2)


def test_headers_of_many_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "".join(f"{i},{k}\n" for k in range(5)))
    rows = load_csv(spark, str(tmp_path), skip_header=1).collect()
    assert sorted((r[0], r[1]) for r in rows) == [(float(i), float(k)) for i in range(40) for k in range(5)]


def test_axis_reductions(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, NAN), (1, 4.0, 5.0, 6.0), (2, None, NAN, None)], "row_id long, a double, b double, c double")
    got = df.orderBy("row_id").select(*(aggs.across(["a", "b", "c"], h).alias(h) for h in ("mean", "median", "min", "max", "sum", "std"))).collect()
    assert [r["mean"] for r in got] == [1.5, 5.0, None] and [r["median"] for r in got] == [1.5, 5.0, None]
    assert tuple(got[0])[2:] == (1.0, 2.0, 3.0, 0.5) and tuple(got[2]) == (None,) * 6
    assert aggs.stacked(df, ["a", "b", "c"]).agg(aggs.mean("x")).first()[0] == 3.6


def test_order_statistics_in_one_pass(spark):
    df = frame(spark, [5.0] * 300 + [float(i) for i in range(100)] + [NAN], 5)
    values = sorted([5.0] * 300 + [float(i) for i in range(100)])
    ks = [0, 4, 5, 200, 304, 305, 306, 399]
    assert ordering.order_statistics(df, "x", ks) == {k: values[k] for k in ks}


def test_errors_inside_fit_are_seen(spark):
    class Broken:
        calls = 0

        def fit(self, df, y=None):
            self.calls += 1
            raise TypeError("inside")

        def transform(self, df):
            return df

    step = Broken()
    with pytest.raises(TypeError, match="inside"):
        compose.Pipeline([("s", step)]).fit(frame(spark, [1.0]))
    assert step.calls == 1
