"""Timing, comparison and plot data."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame


def benchmark_function(f: Callable, *args, repeat: int = 3, warmup: int = 1, **kw) -> dict:
    """Times of a call; a DataFrame result is run to the end without keeping its rows."""
    if not callable(f):
        raise TypeError("f is callable")
    if repeat < 1 or warmup < 0:
        raise ValueError("repeat is at least 1 and warmup not negative")

    def once():
        out = f(*args, **kw)
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        return out

    for _ in range(warmup):
        once()
    times, result = [], None
    for _ in range(repeat):
        t = time.perf_counter()
        result = once()
        times.append(time.perf_counter() - t)
    return {"min": min(times), "max": max(times), "mean": statistics.fmean(times), "median": statistics.median(times), "std": statistics.pstdev(times), "repeat": repeat, "result": result}


def compare_functions(a: Callable, b: Callable, *args, repeat: int = 3, warmup: int = 1, rtol: float = 1e-7) -> dict:
    """Both timed; ValueError where their results differ."""
    x, y = (benchmark_function(f, *args, repeat=repeat, warmup=warmup) for f in (a, b))
    if not np.allclose(x["result"], y["result"], rtol=rtol):
        raise ValueError("the results differ")
    return {"baseline": x, "candidate": y, "speedup": x["mean"] / y["mean"] if y["mean"] else float("inf")}


def format_benchmark_table(results: dict[str, dict]) -> str:
    head = ["name", "mean", "std", "min", "max"]
    rows = [[name, *(f"{r[k]:.6f}" for k in head[1:])] for name, r in results.items()]
    return "\n".join(" | ".join(r) for r in [head, ["---"] * len(head), *rows])


def draw(kind: str, x, y, save_path: str | None = None, title: str = ""):
    """Optional drawing of collected plot data (kind: line, step or bar) where matplotlib is installed."""
    import matplotlib.pyplot as plt

    fig, ax = plt.subplots()
    {"line": ax.plot, "step": ax.step, "bar": ax.bar}[kind](x, y)
    ax.set_title(title)
    if save_path:
        fig.savefig(save_path, dpi=150)
    return fig
