"""Benchmark decontamination by winnowing, in DataFrame operations only.

A span of SPAN = 10 words that a document shares with an item has six 5-word grams;
winnowing keeps the smallest gram hash of every such window, so both sides keep the same
one: no shared span of 10 words or more is missed. Kept fingerprints of documents and
items are joined; each hit is then extended to its whole window by comparing the words.
Items of fewer words are one window of their own length, whose fingerprint is the hash
of the whole (a window of one gram).

The documents' fingerprints (about a third of a long per word) are written once to the
shared folder and read twice; words are compared only in documents that have a hit. The
items' windows are a written table too, so Spark broadcasts or shuffles them by their
measured size. Every join is on hashes of single windows and grows with the texts' length.

Rows: null texts have no words; a text or item without words matches nothing; repeated
rows are judged each by its own text; items with equal words all count; an empty
documents table gives an empty one and an empty benchmark marks nothing; only id and
text columns are read, so others may clash. A null item_id counts as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(common.lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(w: str, n: int, salt: int) -> Column:
    """Hash of every n consecutive words of the array column w."""
    c = F.col(w)
    return F.when(
        F.size(c) >= n,
        F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(F.lit(salt), *(F.get(c, i + j) for j in range(n)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _with_minima(df: DataFrame, w: str, length: int, out: str) -> DataFrame:
    """Adds the fingerprint of each window of `length` words, by position."""
    if length < SPAN:
        return df.withColumn(out, _grams(w, length, length))
    df = df.withColumn("_grams", _grams(w, GRAM, SPAN))
    g, per = F.col("_grams"), SPAN - GRAM + 1
    least = F.when(
        F.size(g) >= per,
        F.transform(F.sequence(F.lit(0), F.size(g) - per), lambda i: F.least(*(F.get(g, i + j) for j in range(per)))),
    ).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, least).drop("_grams")


def _windows(df: DataFrame, length: int, keep: Column | None, *carry: str) -> DataFrame:
    """Rows (carry, at, len, mark, span): windows of array `_w` whose fingerprint passes `keep` (an array)."""
    df = _with_minima(df, "_w", length, "_m")
    marks = F.transform(F.col("_m"), lambda m, i: F.struct(i.alias("at"), m.alias("mark")))
    if keep is not None:
        marks = F.filter(marks, lambda s: F.array_contains(keep, s["mark"]))
    df = df.withColumn("_marks", marks)
    spans = F.transform("_marks", lambda s: F.struct(s["at"].alias("at"), s["mark"].alias("mark"), F.array_join(F.slice("_w", s["at"] + 1, length), " ").alias("span")))
    return df.select(*carry, F.lit(length).alias("len"), F.inline(spans))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Names a row by id and text in 128 bits, nulls apart from any value; repeated rows share it and are judged alike."""
    key = F.col(id_col).cast("string")
    return F.unhex(F.md5(F.concat(common.text_hash(F.col(text_col)), F.when(key.isNull(), F.lit(" null")).otherwise(F.concat(F.lit(" id "), key)))))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    kept = common.written
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text)).alias("_w"))
    short = [r[0] for r in items.select(F.size("_w").alias("n")).where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect()]  # at most nine lengths
    lengths = sorted(short) + [SPAN]
    tables = [_windows(items.where(F.size("_w") >= SPAN if n == SPAN else F.size("_w") == n), n, None, "item") for n in lengths]
    windows = tables[0]
    for t in tables[1:]:
        windows = windows.unionByName(t)
    windows = kept(windows.select("mark", "span", "item").distinct(), "windows")

    rows = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_k"), F.col(text_col).alias("_text"))
    prints = rows.select("_id", "_k", words(F.col("_text")).alias("_w"))
    for n in lengths:
        prints = _with_minima(prints, "_w", n, f"_m{n}")
    marks = F.array_distinct(F.concat(*(f"_m{n}" for n in lengths))) if len(lengths) > 1 else F.array_distinct(f"_m{SPAN}")
    prints = kept(prints.select("_id", "_k", F.size("_w").cast("long").alias("n_words"), marks.alias("marks")), "fingerprints")

    hits = kept(
        prints.select("_k", F.explode("marks").alias("mark")).join(windows.select("mark").distinct(), "mark")
        .groupBy("_k").agg(F.collect_set("mark").alias("_hits")), "hits",
    )
    touched = rows.join(hits, "_k").select("_k", words(F.col("_text")).alias("_w"), "_hits").dropDuplicates(["_k"])
    parts = [_windows(touched, n, F.col("_hits"), "_k") for n in lengths]
    extended = parts[0]
    for t in parts[1:]:
        extended = extended.unionByName(t)
    spans = windows.select("mark", "span").distinct()
    found = kept(extended.join(spans, ["mark", "span"]).select("_k", "at", "len", "mark", "span"), "spans")

    order = Window.partitionBy("_k").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(F.col("at"), F.coalesce(F.max(F.col("at") + F.col("len")).over(order), F.lit(0))))
    n_hit = found.select("_k", covered.alias("new")).groupBy("_k").agg(F.sum("new").cast("long").alias("n_hit"))
    named = (
        found.select("_k", "mark", "span").distinct().join(windows, ["mark", "span"]).select("_k", "item").distinct()
        .groupBy("_k").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    result = n_hit.join(named, "_k")
    return (
        prints.select("_id", "_k", "n_words").join(result, "_k", "left")
        .select(
            F.col("_id").alias(id_col), "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.col("_k").alias("row_key"),
        )
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that share no window with an item, with all their columns and no others, whatever their names."""
    found = contamination(docs, bench, id_col, text_col, item_col, item_text).where("contaminated")
    key, bad = (common.free_name(docs.columns, n) for n in ("key", "bad"))
    rows = docs.withColumn(key, row_key(id_col, text_col))
    return rows.join(found.select(F.col("row_key").alias(bad)).distinct(), F.col(key) == F.col(bad), "left_anti").drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT item_id, len(w) AS n, least(len(w), 10) AS l, w, unnest(range(greatest(len(w) - 9, 1))) AS q FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, l, array_to_string(list_slice(w, q + 1, q + l), ' ') AS span FROM bw
), lens AS (SELECT DISTINCT l FROM win
), dw AS (
  SELECT doc_id, l, w, unnest(range(len(w) - l + 1)) AS p FROM d, lens WHERE len(w) >= l
), ds AS (
  SELECT doc_id, l, p, array_to_string(list_slice(w, p + 1, p + l), ' ') AS span FROM dw
), hit AS (
  SELECT doc_id, p, ds.l, item_id FROM ds JOIN win ON ds.l = win.l AND ds.span = win.span
), pos AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
