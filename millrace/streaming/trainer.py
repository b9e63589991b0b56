"""Training over micro-batches: a trainer with a log, a pipeline of stages, keyed running statistics."""

from __future__ import annotations

import inspect
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import valid

LOG_SCHEMA = "chunk_idx long, n_samples long, accuracy double, cumulative_accuracy double, fit_time_s double, memory_bytes long, timestamp double"


class StreamTrainer:
    """Scales, fits and scores each chunk; `prequential` scores a chunk before it is learned."""

    def __init__(self, model, scaler=None, classes: list | None = None, prequential: bool = False):
        if not hasattr(model, "partial_fit"):
            raise TypeError("the model has partial_fit")
        self.model, self.scaler, self.classes, self.prequential = model, scaler, classes, prequential
        self.reset_log()

    def reset_log(self):
        self.log, self._seen, self._right, self.last_batch = [], 0, 0, None

    def _score(self, df: DataFrame) -> tuple[int, int]:
        r = self.model.predict(df).where(F.col(self.model.label).isNotNull()).agg(F.count(F.lit(1)), F.sum((F.col("prediction") == F.col(self.model.label)).cast("long"))).first()
        return r[0], r[1] or 0

    @staticmethod
    def _once(learn, batch_id: int | None, *args):
        """With the batch id where the step takes one, so that a step that has learned a replayed chunk skips it."""
        if batch_id is not None and "batch_id" in inspect.signature(learn).parameters:
            return learn(*args, batch_id=batch_id)
        return learn(*args)

    def fit_chunk(self, df: DataFrame, batch_id: int | None = None) -> dict | None:
        if batch_id is not None and self.last_batch is not None and batch_id <= self.last_batch:
            return None
        before = None
        if self.prequential and self.log:
            before = self._score(self.scaler.transform(df) if self.scaler else df)
        began = time.perf_counter()
        if self.scaler is not None:
            df = self._once(self.scaler.partial_fit, batch_id, df).transform(df)
        self._once(self.model.partial_fit, batch_id, df, self.classes)
        took = time.perf_counter() - began
        n, right = before or self._score(df)
        self._seen, self._right = self._seen + n, self._right + right
        if batch_id is not None:
            self.last_batch = batch_id
        entry = {
            "chunk_idx": len(self.log), "n_samples": n, "accuracy": right / n if n else 0.0,
            "cumulative_accuracy": self._right / self._seen if self._seen else 0.0,
            "fit_time_s": took, "memory_bytes": sys.getsizeof(self.model), "timestamp": time.time(),
        }
        self.log.append(entry)
        return entry

    def score_chunk(self, df: DataFrame) -> float:
        n, right = self._score(self.scaler.transform(df) if self.scaler else df)
        return right / n if n else 0.0

    def foreach_batch(self):
        """For writeStream.foreachBatch; a replayed batch id changes nothing."""
        return lambda df, batch_id: self.fit_chunk(df, batch_id) and None

    def get_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)

    @property
    def accuracy_history(self) -> list[float]:
        return [e["accuracy"] for e in self.log]

    @property
    def cumulative_accuracy_history(self) -> list[float]:
        return [e["cumulative_accuracy"] for e in self.log]

    def summary(self) -> dict:
        return {"n_chunks": len(self.log), "total_samples": self._seen, "final_accuracy": self.log[-1]["accuracy"] if self.log else 0.0, "cumulative_accuracy": self._right / self._seen if self._seen else 0.0}


class StreamingPipeline:
    """Steps fitted and applied chunk by chunk; fit starts anew (compat=True: goes on)."""

    def __init__(self, steps: list[tuple[str, object]], compat: bool = False):
        if not steps:
            raise ValueError("at least one step")
        for name, step in steps[:-1]:
            if not hasattr(step, "transform"):
                raise ValueError(f"step {name} has no transform")
        self.steps, self.compat = list(steps), compat

    @property
    def named_steps(self) -> dict[str, object]:
        return dict(self.steps)

    def partial_fit(self, df: DataFrame, **kw) -> StreamingPipeline:
        for _, step in self.steps[:-1]:
            df = step.partial_fit(df).transform(df)
        self.steps[-1][1].partial_fit(df, **kw)
        return self

    def fit(self, df: DataFrame, y: str | None = None) -> StreamingPipeline:
        if self.compat:
            return self.partial_fit(df)
        for _, step in self.steps[:-1]:
            df = step.fit(df).transform(df)
        self.steps[-1][1].fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps[:-1]:
            df = step.transform(df)
        return df

    def _last(self, what: str):
        name, step = self.steps[-1]
        if not hasattr(step, what):
            raise ValueError(f"step {name} has no {what}")
        return getattr(step, what)

    def predict(self, df: DataFrame) -> DataFrame:
        return self._last("predict")(self.transform(df))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self._last("predict_proba")(self.transform(df))


def stats_by_key(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running statistics for each key; the same plan over a stream or a table."""
    x = valid(value)
    return stream.groupBy(key).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"),
        F.var_samp(x).alias("sample_variance"), F.min(x).alias("min"), F.max(x).alias("max"),
    )


def run_to_table(stream: DataFrame, name: str, output_mode: str = "complete") -> DataFrame:
    """Run a stream over what there is and return its result table."""
    query = stream.writeStream.outputMode(output_mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def read_chunks(spark: SparkSession, path: str, schema, files_per_chunk: int = 1) -> DataFrame:
    """A folder's Parquet files as micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(path)
