import math

import pytest
from pyspark.sql import functions as F

from millrace.streaming import states, trainer, trees

NAN = float("nan")


def two(spark, rows):
    return spark.createDataFrame(rows, "a double, b double")


def test_merged_state_is_the_union(spark):
    s = states.ChunkStats(["a", "b"], window_size=2)
    s.update_stats(two(spark, [(1.0, 2.0), (3.0, 4.0)]), 0).update_stats(two(spark, [(5.0, 6.0), (7.0, 8.0)]), 1).update_stats(two(spark, [(9.0, 9.0)]), 1)
    assert s.mean_ == {"a": 4.0, "b": 5.0} and s.var_["a"] == 5.0 and s.chunks == 2
    assert s.window_mean_ == {"a": 4.0, "b": 5.0}
    one = states.StreamingStats()
    for x in (1, 2, NAN, 3, 4, 5):
        one.update(x)
    assert (one.mean, one.variance, one.sample_variance, one.count) == (3, 2, 2.5, 5)
    assert math.isnan(states.StreamingStats().mean)


def test_streaming_preprocessing(spark):
    sc = states.StreamingMinMaxScaler(["a", "b"])
    sc.partial_fit(two(spark, [(0.0, NAN), (3.0, NAN)])).partial_fit(two(spark, [(-5.0, 15.0)]))
    assert sc.state["a"].low == -5 and sc.state["b"].high == 15
    imp = states.StreamingImputer(["a"]).partial_fit(two(spark, [(2.0, 0.0), (4.0, 0.0)]))
    assert imp.fill("a") == 3
    assert imp.partial_fit(two(spark, [(4.0, 0.0), (8.0, 0.0)])).fill("a") == 4.5
    med = states.StreamingImputer(["a"], "median").partial_fit(two(spark, [(2.0, 0.0), (4.0, 0.0), (9.0, 0.0)]))
    assert med.fill("a") == 4
    enc = states.StreamingOneHotEncoder(["c"]).partial_fit(spark.createDataFrame([("b",)], "c string")).partial_fit(spark.createDataFrame([("a",)], "c string"))
    assert enc.output_columns() == ["c_a", "c_b"]
    with pytest.raises(ValueError):
        states.StreamingStandardScaler(["a"]).partial_fit(two(spark, [(1.0, 1.0)]).where("false"))


def test_streaming_metrics(spark):
    m = states.StreamingMetrics(window_size=2)
    right = spark.createDataFrame([(0.0, 0.0, 0.1), (1.0, 1.0, 0.9)], "y double, p double, s double")
    wrong = right.withColumn("p", 1 - F.col("p"))
    for i, df in enumerate((right, right, wrong)):
        m.update(df, "y", "p", "s", batch_id=i)
    r = m.result()
    assert r["rolling_accuracy"] == 0.5 and r["total_samples"] == 6 and r["auc"] == 1.0
    m.update(wrong, "y", "p", batch_id=2)
    assert m.result() == r


@pytest.fixture(scope="module")
def points(spark):
    u = [(F.xxhash64("id", F.lit(k)) % 1000) / 1000.0 for k in range(3)]
    df = spark.range(2000).select("id", *(x.alias(f"f{i}") for i, x in enumerate(u)))
    return df.withColumn("y", (F.col("f0") + F.col("f1") > 0).cast("int")).cache()


def accuracy(model, df):
    return model.predict(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]


@pytest.mark.parametrize("make", [
    lambda: trees.StreamingDecisionTree(["f0", "f1", "f2"], "y"),
    lambda: trees.StreamingBaggingClassifier(["f0", "f1", "f2"], "y", 3),
    lambda: trees.StreamingRandomForest(["f0", "f1", "f2"], "y", 3, max_features=2),
])
def test_models_learn(spark, points, make):
    model = make()
    for i in range(3):
        model.partial_fit(points.where(F.col("id") % 3 == i), [0, 1], batch_id=i)
    assert accuracy(model, points) > 0.7
    p = model.predict_proba(points).select(F.expr("aggregate(probability, 0D, (a, x) -> a + x)").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert all(abs(x - 1) < 1e-9 for x in p)


def test_one_fit_gives_a_stump_and_nan_is_routed(spark, points):
    t = trees.StreamingDecisionTree(["f0", "f1"], "y").fit(points)
    assert t.depth_ == 1 and trees.StreamingDecisionTree(["f0"], "y").render() == "<empty tree>"
    assert t.predict(points.withColumn("f0", F.lit(NAN)).limit(5)).where("prediction IS NULL").count() == 0
    with pytest.raises(ValueError):
        trees.StreamingRandomForest(["f0"], "y", max_features="half")
    assert trees.DecisionTreeClassifier is trees.StreamingDecisionTree and trees.EnsembleClassifier is trees.StreamingRandomForest


def test_trainer_over_a_stream(spark, points, tmp_path):
    path = str(tmp_path / "chunks")
    points.repartition(3, "id").write.parquet(path)
    t = trainer.StreamTrainer(trees.StreamingDecisionTree(["f0", "f1"], "y"), states.StreamingStandardScaler(["f0", "f1"]), [0, 1])
    q = trainer.read_chunks(spark, path, points.schema).writeStream.foreachBatch(t.foreach_batch()).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert len(t.log) == 3 and t.log[-1]["accuracy"] > 0.5 and t.summary()["total_samples"] == 2000
    assert t.fit_chunk(points, batch_id=2) is None and t.get_log(spark).count() == 3


def test_pipeline_resets_on_fit(spark, points):
    p = trainer.StreamingPipeline([("scale", states.StreamingStandardScaler(["f0", "f1"])), ("tree", trees.StreamingDecisionTree(["f0", "f1"], "y"))])
    p.fit(points)
    p.fit(points)
    assert p.named_steps["scale"].state["f0"].n == 2000 and accuracy(p, points) > 0.6


def test_a_failed_chunk_is_applied_when_it_comes_again(spark, points):
    s = states.ChunkStats(["a"])
    with pytest.raises(Exception):
        s.update_stats(spark.createDataFrame([("x",)], "a string").select(F.raise_error(F.lit("lost")).cast("double").alias("a")), 0)
    assert s.update_stats(two(spark, [(1.0, 2.0)]), 0).chunks == 1

    class Failing(trees.StreamingDecisionTree):
        once = True

        def partial_fit(self, df, classes=None, batch_id=None):
            if self.once:
                self.once = False
                raise RuntimeError("lost")
            return super().partial_fit(df, classes, batch_id)

    scaler = states.StreamingStandardScaler(["f0", "f1"])
    t = trainer.StreamTrainer(Failing(["f0", "f1"], "y"), scaler, [0, 1])
    with pytest.raises(RuntimeError):
        t.fit_chunk(points, 0)
    assert t.fit_chunk(points, 0)["fit_time_s"] > 0
    assert scaler.state["f0"].n == 2000 and len(t.log) == 1


def test_routing_is_linear_in_the_nodes(spark):
    t = trees.StreamingDecisionTree(["a"], "y")
    t.nodes = [trees.Node(0, n=8, feature="a", threshold=0.0, left=1, right=2)] + [trees.Node(1, n=4, feature="a", threshold=float(s), left=3 + 2 * k, right=4 + 2 * k) for k, s in enumerate((-1, 1))] + [trees.Node(2, n=2) for _ in range(4)]
    assert t._route(False)._jc.toString().upper().count("WHEN") == 3
    df = spark.createDataFrame([(-2.0,), (-0.5,), (0.5,), (2.0,), (NAN,)], "a double")
    assert [r[0] for r in df.select(t._route(False).alias("l")).collect()] == [3, 4, 5, 6, 3]
