"""The query catalogue: each named query over the test tables and its SQL twin.

Doubles are rounded on both sides, as sums differ in their last digits with the order of
addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggs, exprs
from ..operators import compose, metrics, numdiff, ordering, prep, validate
from ..session import table
from ..streaming import chunks, states, trainer, trees

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def r(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def injected(spark, sf) -> DataFrame:
    """lineitem with NaN prices where l_linenumber is 3."""
    return table(spark, sf, "lineitem").withColumn("x", F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")))


NAN_X = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"


@query("flagship_summary", """
SELECT l_returnflag, count(x) AS n, round(avg(x), 4) AS mean_x, round(stddev_pop(x), 4) AS std_x, min(x) AS min_x, max(x) AS max_x,
  round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
  round(avg(l_quantity), 4) AS mean_quantity
FROM (SELECT *, """ + NAN_X + """ AS x FROM lineitem) GROUP BY l_returnflag""")
def flagship_summary(spark, sf):
    p = F.percentile(exprs.valid("x"), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    out = injected(spark, sf).groupBy("l_returnflag").agg(
        F.count(exprs.valid("x")).alias("n"), r(aggs.mean("x")).alias("mean_x"), r(aggs.std("x")).alias("std_x"),
        aggs.minimum("x").alias("min_x"), aggs.maximum("x").alias("max_x"), p.alias("_p"), r(aggs.mean("l_quantity")).alias("mean_quantity"))
    return out.select("l_returnflag", "n", "mean_x", "std_x", "min_x", "max_x", *(r(F.col("_p")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "mean_quantity")


_AGGS = {
    "agg_mean": (aggs.mean, "avg({x})", 4), "agg_median": (aggs.median, "quantile_cont({x}, 0.5)", 4),
    "agg_std_pop": (aggs.std, "stddev_pop({x})", 4), "agg_std_samp": (lambda c: aggs.std(c, 1), "stddev_samp({x})", 4),
    "agg_std_ddof2": (lambda c: aggs.std(c, 2), "sqrt(var_pop({x}) * count({x}) / (count({x}) - 2))", 4),
    "agg_var": (aggs.variance, "var_pop({x})", 2), "agg_min": (aggs.minimum, "min({x})", 4), "agg_max": (aggs.maximum, "max({x})", 4),
    "agg_sumsq": (aggs.sum_of_squares, "sum({x} * {x})", 0),
}
for _name, (_f, _sql, _n) in _AGGS.items():
    QUERIES[_name] = lambda spark, sf, f=_f, n=_n: table(spark, sf, "lineitem").agg(r(f("l_quantity"), n).alias("v"))
    ORACLES[_name] = f"SELECT round({_sql.format(x='l_quantity')}, {_n}) AS v FROM lineitem"
    QUERIES[_name + "_by_flag"] = lambda spark, sf, f=_f, n=_n: table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(f("l_quantity"), n).alias("v"))
    ORACLES[_name + "_by_flag"] = f"SELECT l_returnflag, round({_sql.format(x='l_quantity')}, {_n}) AS v FROM lineitem GROUP BY l_returnflag"
    if _name != "agg_sumsq":
        QUERIES[_name + "_nan"] = lambda spark, sf, f=_f, n=min(_n, 2): injected(spark, sf).groupBy("l_linestatus").agg(r(f("x"), n).alias("v"))
        ORACLES[_name + "_nan"] = f"SELECT l_linestatus, round({_sql.format(x='x')}, {min(_n, 2)}) AS v FROM (SELECT *, {NAN_X} AS x FROM lineitem) GROUP BY l_linestatus"

_PICK = {
    "linear": "quantile_cont(l_extendedprice, {q})",
    "lower": "max(l_extendedprice) FILTER (WHERE i = floor((n - 1) * {q}))",
    "higher": "max(l_extendedprice) FILTER (WHERE i = ceil((n - 1) * {q}))",
    "midpoint": "(max(l_extendedprice) FILTER (WHERE i = floor((n - 1) * {q})) + max(l_extendedprice) FILTER (WHERE i = ceil((n - 1) * {q}))) / 2",
}
_NUMBERED = "(SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)"
for _how, _sql in _PICK.items():
    QUERIES[f"quantile_{_how}"] = lambda spark, sf, how=_how: aggs.quantile(table(spark, sf, "lineitem"), "l_extendedprice", [0.25, 0.3, 0.99], how).select("q", r("value").alias("value"))
    ORACLES[f"quantile_{_how}"] = " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round({_sql.format(q=q)}, 4) AS value FROM {_NUMBERED}" for q in (0.25, 0.3, 0.99))


@query("percentile_multi", """SELECT l_returnflag, CAST(q AS DOUBLE) AS q, round(CASE q WHEN 5 THEN quantile_cont(l_quantity, 0.05) WHEN 50 THEN quantile_cont(l_quantity, 0.5) ELSE quantile_cont(l_quantity, 0.95) END, 4) AS value
FROM lineitem, (VALUES (5), (50), (95)) t(q) GROUP BY l_returnflag, q""")
def percentile_multi(spark, sf):
    return aggs.percentile(table(spark, sf, "lineitem"), "l_quantity", [5, 50, 95], by="l_returnflag").select("l_returnflag", r("q", 0).alias("q"), r("value").alias("value"))


@query("histogram_10", """WITH b AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(lo + g.bin * (hi - lo) / 10, 4) AS lo FROM (SELECT unnest(range(10)) AS bin) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def histogram_10(spark, sf):
    return aggs.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10).select("bin", "n", r("lo").alias("lo"))


@query("histogram_range", """WITH c AS (SELECT CAST(least(floor((l_quantity - 5) / 20 * 8), 7) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 25 GROUP BY 1)
SELECT g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(range(8)) AS bin) g LEFT JOIN c ON g.bin = c.bin""")
def histogram_range(spark, sf):
    return aggs.histogram(table(spark, sf, "lineitem"), "l_quantity", 8, (5.0, 25.0)).select("bin", "n")


@query("sort_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS position FROM orders")
def sort_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    per = sorted((x[0], x[1]) for x in o.groupBy("o_orderpriority").count().collect())  # few priorities
    base, at = {}, 0
    for k, n in per:
        base[k], at = at, at + n
    offset = F.element_at(F.create_map(*(x for k, v in base.items() for x in (F.lit(k), F.lit(v).cast("long")))), F.col("o_orderpriority"))
    return ordering.sort_rows(o, ["o_orderpriority", "o_totalprice"], [True, False], "o_orderkey").withColumn("position", (F.row_number().over(w) - 1 + offset).cast("long"))


@query("sort_position", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")
def sort_position(spark, sf):
    return ordering.with_position(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").withColumn("position", F.col("position").cast("long"))


@query("sort_within", "SELECT vec_id, list_transform(list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda x: round(x, 6))[1] AS smallest, list_transform(list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda x: round(x, 6))[-1] AS largest FROM embeddings")
def sort_within(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", ordering.sort_within(F.col("embedding").cast("array<double>")).alias("s"))
    return e.select("vec_id", r(F.element_at("s", 1), 6).alias("smallest"), r(F.element_at("s", -1), 6).alias("largest"))


@query("topk_largest", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber LIMIT 25")
def topk_largest(spark, sf):
    return _topk(spark, sf, True)


@query("topk_smallest", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber LIMIT 25")
def topk_smallest(spark, sf):
    return _topk(spark, sf, False)


def _topk(spark, sf, largest):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))
    return ordering.topk(li, "l_extendedprice", 25, largest, "t").drop("t")


@query("topk_per_group", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def topk_per_group(spark, sf):
    return ordering.topk(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", 5, True, "o_orderkey", "o_orderpriority")


@query("kth_smallest", "SELECT CAST(k AS BIGINT) AS k, v FROM (SELECT row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, l_extendedprice AS v FROM lineitem) WHERE k IN (0, 100, 4000)")
def kth_smallest(spark, sf):
    found = ordering.order_statistics(table(spark, sf, "lineitem"), "l_extendedprice", [0, 100, 4000])
    return spark.createDataFrame(list(found.items()), "k long, v double")


@query("search_sorted", "SELECT CAST(p AS DOUBLE) AS p, count(*) FILTER (WHERE l_quantity < p) AS idx, bool_or(l_quantity = p) AS found FROM lineitem, (VALUES (-1.0), (7.0), (7.5), (50.0), (99.0)) t(p) GROUP BY p")
def search_sorted(spark, sf):
    probes = spark.createDataFrame([(x,) for x in (-1.0, 7.0, 7.5, 50.0, 99.0)], "p double")
    return ordering.search_sorted(table(spark, sf, "lineitem"), "l_quantity", probes, "p")


@query("batches", "WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders) SELECT o_orderkey, CAST(batch AS BIGINT) AS batch FROM b QUALIFY count(*) OVER (PARTITION BY batch) = 64")
def batches(spark, sf):
    return ordering.make_batches(table(spark, sf, "orders").select("o_orderkey"), 64, "o_orderkey", drop_last=True)


@query("batches_shuffled")
def batches_shuffled(spark, sf):
    return ordering.make_batches(table(spark, sf, "orders").select("o_orderkey"), 64, "o_orderkey", shuffle=True, seed=7)


_RANK = {
    "average": "rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0",
    "dense": "dense_rank() OVER (ORDER BY x)", "ordinal": "row_number() OVER (ORDER BY x, l_orderkey * 10 + l_linenumber)",
}


def _rank(spark, sf, how):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))
    return ordering.rank(x, "x", "t", how).drop("t")


for _how, _sql in _RANK.items():
    QUERIES[f"rank_{_how}"] = lambda spark, sf, how=_how: _rank(spark, sf, how)
    ORACLES[f"rank_{_how}"] = f"SELECT l_orderkey, l_linenumber, x, CAST({_sql} AS DOUBLE) AS rank FROM (SELECT *, l_quantity AS x FROM lineitem)"


@query("rank_nan", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_linenumber = 3 ORDER BY l_extendedprice) AS DOUBLE) + CASE WHEN l_linenumber = 3 THEN NULL ELSE 0 END + (count(*) OVER (PARTITION BY l_linenumber = 3, l_extendedprice) - 1) / 2.0 AS rank FROM lineitem")
def rank_nan(spark, sf):
    x = injected(spark, sf).withColumn("t", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = ordering.rank(x.select("l_orderkey", "l_linenumber", "t", "x"), "x", "t")
    return out.select("l_orderkey", "l_linenumber", F.when(~F.isnan("rank"), F.col("rank")).alias("rank"))


@query("sigmoid", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25))), 8) AS v FROM lineitem")
def sigmoid(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(exprs.sigmoid(F.col("l_quantity") - 25), 8).alias("v"))


@query("relu", "SELECT l_orderkey, l_linenumber, greatest(l_quantity - 25, 0.0::DOUBLE) AS v FROM lineitem")
def relu(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", exprs.relu(F.col("l_quantity") - 25).alias("v"))


@query("softmax_by_group", "SELECT event_id, round(exp(value - max(value) OVER w) / sum(exp(value - m)) OVER w, 8) AS v FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) WINDOW w AS (PARTITION BY event_type)")
def softmax_by_group(spark, sf):
    return table(spark, sf, "events").select("event_id", r(exprs.softmax_over("value", Window.partitionBy("event_type")), 8).alias("v"))


@query("logsumexp_by_group", "SELECT event_type, round(m + ln(sum(exp(value - m))), 6) AS v FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type, m")
def logsumexp_by_group(spark, sf):
    e = table(spark, sf, "events")
    top = e.groupBy("event_type").agg(F.max("value").alias("m"))
    return e.join(top, "event_type").groupBy("event_type", "m").agg((F.first("m") + F.log(F.sum(F.exp(F.col("value") - F.col("m"))))).alias("x")).select("event_type", r("x", 6).alias("v"))


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("softmax_rows", f"SELECT vec_id, round(list_max(list_transform(v, lambda x: exp(x - list_max(v)))) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 8) AS top, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS lse FROM (SELECT vec_id, {_D} AS v FROM embeddings)")
def softmax_rows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r(F.array_max(exprs.softmax("embedding")), 8).alias("top"), r(exprs.logsumexp("embedding"), 6).alias("lse"))


def _nearest(spark, sf, f):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    p = e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("pv"))
    return ordering.pairwise_nearest(q, p, r(f("qv", "pv"), 5), 5, "query_id", "point_id")


_METRIC = {"euclidean": (exprs.euclidean_distance, "list_distance(a, b)"), "manhattan": (exprs.manhattan_distance, "list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])))"), "cosine": (exprs.cosine_similarity, "list_cosine_similarity(a, b)")}
for _how, (_f, _sql) in _METRIC.items():
    QUERIES[f"nearest_{_how}"] = lambda spark, sf, f=_f: _nearest(spark, sf, f)
    ORACLES[f"nearest_{_how}"] = f"WITH e AS (SELECT vec_id, {_D} AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id AS point_id, round({_sql}, 5) AS distance FROM (SELECT vec_id, v AS a FROM e WHERE vec_id % 100 = 0) q, (SELECT vec_id, v AS b FROM e) e) SELECT query_id, point_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS nearest FROM p QUALIFY nearest <= 5"


@query("classification", "SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM labels)")
def classification(spark, sf):
    out = metrics.classification_report(table(spark, sf, "labels"), "quality", "toxic")
    return out.select("tn", "fp", "fn", "tp", *(r(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("confusion_counts", "SELECT CAST(quality AS DOUBLE) AS y, CAST(toxic AS DOUBLE) AS p, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic")
def confusion_counts(spark, sf):
    return metrics.normalised_confusion(metrics.confusion_counts(table(spark, sf, "labels"), "quality", "toxic")).select("y", "p", "n", r("share", 6).alias("share"))


@query("mse", "SELECT round(avg((l_discount - l_tax) * (l_discount - l_tax)), 8) AS mse FROM lineitem")
def mse(spark, sf):
    return metrics.mse(table(spark, sf, "lineitem"), "l_discount", "l_tax").select(r("mse", 8).alias("mse"))


@query("mismatches", "SELECT doc_id, quality <> toxic AS mismatch FROM labels")
def mismatches(spark, sf):
    return metrics.mismatches(table(spark, sf, "labels"), "quality", "toxic").select("doc_id", "mismatch")


_ROC = "WITH j AS (SELECT doc_id, toxic AS y, CAST(length(text) AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id)), c AS (SELECT row_number() OVER w AS position, s AS threshold, sum(y) OVER w AS tp, row_number() OVER w - sum(y) OVER w AS fp, sum(y) OVER () AS p, count(*) OVER () - sum(y) OVER () AS n FROM j WINDOW w AS (ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING)), r AS (SELECT position, threshold, fp / n AS fpr, tp / p AS tpr FROM c) "


def _scored(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("s")).join(table(spark, sf, "labels"), "doc_id")


@query("roc_curve", _ROC + "SELECT position, threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM r")
def roc_curve(spark, sf):
    return metrics.roc_curve(_scored(spark, sf), "toxic", "s", "doc_id").select(F.col("position").cast("long").alias("position"), "threshold", r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


@query("auc", _ROC + "SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 8) AS auc FROM (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY position) AS pf, lag(tpr) OVER (ORDER BY position) AS pt FROM r)")
def auc(spark, sf):
    return metrics.auc(metrics.roc_curve(_scored(spark, sf), "toxic", "s", "doc_id")).select(r("auc", 8).alias("auc"))


@query("pooled_auc", "WITH j AS (SELECT toxic AS y, length(text) AS s FROM documents JOIN labels USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM j) SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 8) AS auc FROM k")
def pooled_auc(spark, sf):
    return metrics.pooled_auc(_scored(spark, sf), "toxic", "s").select(r("auc", 8).alias("auc"))


@query("standard_scale", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem")
def standard_scale(spark, sf):
    return prep.StandardScaler(["l_quantity"]).fit_transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).withColumn("l_quantity", r("l_quantity", 6))


@query("minmax_scale", "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) * 2 - 1, 6) AS l_quantity FROM lineitem")
def minmax_scale(spark, sf):
    return prep.MinMaxScaler(["l_quantity"], (-1.0, 1.0)).fit_transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).withColumn("l_quantity", r("l_quantity", 6))


_FILL = {"mean": "avg(x) OVER ()", "median": "(SELECT quantile_cont(x, 0.5) FROM i)", "constant": "-1.0"}
for _how, _sql in _FILL.items():
    QUERIES[f"impute_{_how}"] = lambda spark, sf, how=_how: prep.SimpleImputer(["x"], how, -1.0).fit_transform(injected(spark, sf).select("l_orderkey", "l_linenumber", "x")).withColumn("x", r("x", 4))
    ORACLES[f"impute_{_how}"] = f"WITH i AS (SELECT l_orderkey, l_linenumber, {NAN_X} AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(coalesce(x, {_sql}), 4) AS x FROM i"


@query("onehot", "SELECT c_custkey, CAST(sum(CAST(c_mktsegment = s AS INT) * k) OVER (PARTITION BY c_custkey) AS BIGINT) AS code FROM (SELECT c_custkey, c_mktsegment, s, row_number() OVER (PARTITION BY c_custkey ORDER BY s) AS k FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer)) QUALIFY k = 1")
def onehot(spark, sf):
    enc = prep.OneHotEncoder(["c_mktsegment"])
    out = enc.fit_transform(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    code = sum((F.col(f"`{c}`") * (i + 1) for i, c in enumerate(enc.output_columns())), F.lit(0))
    return out.select("c_custkey", code.cast("long").alias("code"))


@query("feature_union", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS z__l_quantity, round((l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()), 6) AS m__l_tax FROM lineitem")
def feature_union(spark, sf):
    u = compose.FeatureUnion([("z", prep.StandardScaler(["l_quantity"])), ("m", prep.MinMaxScaler(["l_tax"]))])
    out = u.fit_transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))
    return out.select("l_orderkey", "l_linenumber", r("z__l_quantity", 6).alias("z__l_quantity"), r("m__l_tax", 6).alias("m__l_tax"))


@query("pipeline_scale", f"WITH i AS (SELECT l_orderkey, l_linenumber, {NAN_X} AS x FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, coalesce(x, avg(x) OVER ()) AS x FROM i) SELECT l_orderkey, l_linenumber, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 5) AS x FROM f")
def pipeline_scale(spark, sf):
    p = compose.Pipeline([("fill", prep.SimpleImputer(["x"])), ("scale", prep.StandardScaler(["x"]))])
    return p.fit_transform(injected(spark, sf).select("l_orderkey", "l_linenumber", "x")).withColumn("x", r("x", 5))


@query("check_array", "SELECT count(*) AS n FROM lineitem")
def check_array(spark, sf):
    return validate.check_array(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], ensure_2d=True, allow_nan=False, allow_inf=False).agg(F.count(F.lit(1)).alias("n"))


@query("grad_expr", "SELECT event_id, round(2 * value + 3, 3) AS dx, round(2 * value, 3) AS dy FROM events")
def grad_expr(spark, sf):
    g = numdiff.grad(lambda v: v[0] * v[0] + 3 * v[0] + v[1] * v[1], ["value", "value"])
    return table(spark, sf, "events").select("event_id", g.alias("g")).select("event_id", r(F.col("g")[0], 3).alias("dx"), r(F.col("g")[1], 3).alias("dy"))


@query("jacobian_expr", "SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS a, round(l_tax, 4) AS b, round(l_discount, 4) AS c FROM lineitem")
def jacobian_expr(spark, sf):
    j = numdiff.jacobian(lambda v: [v[0] + v[1], v[0] * v[1]], ["l_discount", "l_tax"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", j.alias("j")).select("l_orderkey", "l_linenumber", r(F.col("j")[0][0], 4).alias("a"), r(F.col("j")[1][0], 4).alias("b"), r(F.col("j")[1][1], 4).alias("c"))


_CHUNK = "SELECT event_id // 1000 AS chunk, count(*) AS n, avg(value) AS mean, var_pop(value) AS var, min(value) AS low, max(value) AS high FROM events GROUP BY 1"


def _chunk_stats(spark, sf):
    return chunks.chunk_stats(table(spark, sf, "events"), chunks.chunk_of("event_id", 1000), "value")


@query("chunk_stats", f"SELECT chunk, n, round(mean, 4) AS mean, round(var, 3) AS var, low, high FROM ({_CHUNK})")
def chunk_stats(spark, sf):
    return _chunk_stats(spark, sf).select("chunk", "n", r("mean").alias("mean"), r("var", 3).alias("var"), "low", "high")


@query("chunk_window_mean", f"SELECT chunk, round(avg(mean) OVER (ORDER BY chunk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS window_mean FROM ({_CHUNK})")
def chunk_window_mean(spark, sf):
    return chunks.window_mean(_chunk_stats(spark, sf), 3).select("chunk", r("window_mean").alias("window_mean"))


@query("cumulative_stats", f"SELECT chunk, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(mean * n) OVER w / sum(n) OVER w, 4) AS mean FROM ({_CHUNK}) WINDOW w AS (ORDER BY chunk ROWS UNBOUNDED PRECEDING)")
def cumulative_stats(spark, sf):
    return chunks.cumulative(_chunk_stats(spark, sf)).select("chunk", "n", r("mean").alias("mean"))


@query("streaming_stats", "SELECT count(value) AS count, round(avg(value), 4) AS mean, round(var_pop(value), 3) AS variance, round(var_samp(value), 3) AS sample_variance, min(value) AS min, max(value) AS max FROM events")
def streaming_stats(spark, sf):
    s = states.StreamingStats()
    e = table(spark, sf, "events")
    for i in range(4):
        s.update_many(e.where(F.pmod("event_id", F.lit(4)) == i), "value", batch_id=i)
    d = s.to_dict()
    row = [(d["count"], round(d["mean"], 4), round(d["variance"], 3), round(d["sample_variance"], 3), d["min"], d["max"])]
    return spark.createDataFrame(row, "count long, mean double, variance double, sample_variance double, min double, max double")


@query("streaming_stats_by_key", "SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(var_pop(value), 3) AS variance, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def streaming_stats_by_key(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = trainer.run_to_table(trainer.stats_by_key(stream, "event_type", "value"), "millrace_stats_by_key")
    return out.select("event_type", "count", r("mean").alias("mean"), r("variance", 3).alias("variance"), "min", "max")


@query("rolling_metrics", """WITH c AS (SELECT doc_id // 250 AS chunk, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels GROUP BY 1),
m AS (SELECT chunk, n, tp + tn AS ok, (tp + tn) / n AS a, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM c)
SELECT chunk, round(avg(a) OVER w, 6) AS rolling_accuracy, round(avg(p) OVER w, 6) AS rolling_precision, round(avg(rc) OVER w, 6) AS rolling_recall, round(avg(f) OVER w, 6) AS rolling_f1, round(sum(ok) OVER u / sum(n) OVER u, 6) AS cumulative_accuracy
FROM m WINDOW w AS (ORDER BY chunk ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), u AS (ORDER BY chunk ROWS UNBOUNDED PRECEDING)""")
def rolling_metrics(spark, sf):
    out = chunks.rolling_metrics(table(spark, sf, "labels"), chunks.chunk_of("doc_id", 250), "quality", "toxic", 2)
    return out.select("chunk", *(r(c, 6).alias(c) for c in out.columns[1:]))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _labelled_lines(spark, sf) -> DataFrame:
    y = (F.col("l_quantity") * 2000 + F.col("l_discount") * 500_000 > F.col("l_extendedprice") * 1.2).cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES, y.alias("y"))


def _grown(model, df: DataFrame, n: int = 4):
    for i in range(n):
        model.partial_fit(df.where(F.pmod("l_orderkey", F.lit(n)) == i), [0, 1], batch_id=i)
    return model


@query("tree_predict")
def tree_predict(spark, sf):
    df = _labelled_lines(spark, sf)
    return _grown(trees.StreamingDecisionTree(_FEATURES, "y"), df).predict(df).select("l_orderkey", "l_linenumber", "y", "prediction")


@query("tree_structure")
def tree_structure(spark, sf):
    t = _grown(trees.StreamingDecisionTree(_FEATURES, "y"), _labelled_lines(spark, sf))
    return spark.createDataFrame(t.structure(), "node int, depth int, feature string, threshold double, left int, right int, n double")


@query("bagging_predict")
def bagging_predict(spark, sf):
    df = _labelled_lines(spark, sf)
    return _grown(trees.StreamingBaggingClassifier(_FEATURES, "y", 3), df, 3).predict(df).select("l_orderkey", "l_linenumber", "y", "prediction")


@query("forest_predict")
def forest_predict(spark, sf):
    df = _labelled_lines(spark, sf)
    return _grown(trees.StreamingRandomForest(_FEATURES, "y", 3), df, 3).predict(df).select("l_orderkey", "l_linenumber", "y", "prediction")


@query("trainer_log")
def trainer_log(spark, sf):
    df = _labelled_lines(spark, sf)
    t = trainer.StreamTrainer(trees.StreamingDecisionTree(_FEATURES, "y"), states.StreamingStandardScaler(_FEATURES), [0, 1])
    for i in range(4):
        t.fit_chunk(df.where(F.pmod("l_orderkey", F.lit(4)) == i), i)
    return t.get_log(spark).drop("timestamp", "memory_bytes", "fit_time_s")


_THREE = ["l_quantity", "x", "l_discount"]


@query("stats_axis_1", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, list_filter([l_quantity, {NAN_X}, l_discount], lambda x: x IS NOT NULL) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(list_avg(v), 4) AS mean, round(list_median(v), 4) AS median, round(list_stddev_pop(v), 4) AS std, list_min(v) AS low, list_max(v) AS high FROM v""")
def stats_axis_1(spark, sf):
    a = lambda how: aggs.across(_THREE, how)
    return injected(spark, sf).select("l_orderkey", "l_linenumber", r(a("mean")).alias("mean"), r(a("median")).alias("median"), r(a("std")).alias("std"), a("min").alias("low"), a("max").alias("high"))


@query("stats_no_axis", f"SELECT count(x) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, min(x) AS low, max(x) AS high FROM (SELECT unnest([l_quantity, {NAN_X}, l_discount]) AS x FROM lineitem)")
def stats_no_axis(spark, sf):
    return aggs.stacked(injected(spark, sf), _THREE).agg(F.count("x").alias("n"), r(aggs.mean("x")).alias("mean"), r(aggs.std("x")).alias("std"), aggs.minimum("x").alias("low"), aggs.maximum("x").alias("high"))


def _streamed(spark, sf, stage):
    """The stage after four chunks, over all rows."""
    df = injected(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "x")
    for i in range(4):
        stage.partial_fit(df.where(F.pmod("l_orderkey", F.lit(4)) == i), batch_id=i)
    return stage.transform(df)


@query("stream_standard_scale", f"SELECT l_orderkey, l_linenumber, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x FROM (SELECT *, {NAN_X} AS x FROM lineitem)")
def stream_standard_scale(spark, sf):
    return _streamed(spark, sf, states.StreamingStandardScaler(["x"])).select("l_orderkey", "l_linenumber", r(exprs.valid("x"), 6).alias("x"))


@query("stream_minmax_scale", f"SELECT l_orderkey, l_linenumber, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x FROM (SELECT *, {NAN_X} AS x FROM lineitem)")
def stream_minmax_scale(spark, sf):
    return _streamed(spark, sf, states.StreamingMinMaxScaler(["x"])).select("l_orderkey", "l_linenumber", r(exprs.valid("x"), 6).alias("x"))


@query("stream_impute", f"SELECT l_orderkey, l_linenumber, round(coalesce(x, avg(x) OVER ()), 4) AS x FROM (SELECT *, {NAN_X} AS x FROM lineitem)")
def stream_impute(spark, sf):
    return _streamed(spark, sf, states.StreamingImputer(["x"])).select("l_orderkey", "l_linenumber", r("x").alias("x"))


@query("stream_onehot", "SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INT) AS a, CAST(l_returnflag = 'N' AS INT) AS n, CAST(l_returnflag = 'R' AS INT) AS r FROM lineitem")
def stream_onehot(spark, sf):
    out = _streamed(spark, sf, states.StreamingOneHotEncoder(["l_returnflag"]))
    return out.select("l_orderkey", "l_linenumber", *(F.col(f"l_returnflag_{c}").cast("int").alias(c.lower()) for c in "ANR"))


@query("stream_metrics", """
SELECT count(*) AS total_samples, round(avg(CAST(quality = toxic AS DOUBLE)), 8) AS accuracy,
  round(sum(quality * toxic) / sum(toxic), 8) AS precision, round(sum(quality * toxic) / sum(quality), 8) AS recall FROM labels""")
def stream_metrics(spark, sf):
    m, df = states.StreamingMetrics(), table(spark, sf, "labels")
    for i in range(4):
        m.update(df.where(F.pmod("doc_id", F.lit(4)) == i), "quality", "toxic", batch_id=i)
    out = m.result()
    return spark.createDataFrame([(out["total_samples"], *(round(out[k], 8) for k in ("accuracy", "precision", "recall")))], "total_samples long, accuracy double, precision double, recall double")


@query("stream_chunk_stats", f"SELECT CAST(count(x) AS BIGINT) AS n, round(avg(x), 4) AS mean, round(var_pop(x), 2) AS variance, min(x) AS low, max(x) AS high FROM (SELECT {NAN_X} AS x FROM lineitem)")
def stream_chunk_stats(spark, sf):
    s, df = states.ChunkStats(["x"]), injected(spark, sf)
    for i in range(4):
        s.update_stats(df.where(F.pmod("l_orderkey", F.lit(4)) == i), i)
    return spark.createDataFrame([(s.state["x"].n, round(s.mean_["x"], 4), round(s.var_["x"], 2), s.min_["x"], s.max_["x"])], "n long, mean double, variance double, low double, high double")
