"""Evaluation runs: corpus manifests, selection, aggregates, reports."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import tokens


def manifest(files: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """(name, bytes, sha256) of files (name, content), and with text (name, page, text) pages, tokens and scanned: under two tokens a page."""
    out = files.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    if text is None:
        return out
    counts = text.groupBy("name").agg(F.count_distinct("page").alias("pages"), F.sum(F.size(tokens(F.col("text")))).cast("long").alias("tokens"))
    return out.join(counts, "name", "left").withColumn("scanned", F.coalesce(F.col("tokens") < 2 * F.col("pages"), F.lit(True)))


def select_corpus(corpus: DataFrame, only: tuple[str, ...] = (), heavy: bool = False) -> DataFrame:
    """Entries (id, heavy) to run: those named, heavy or not; else all that aren't heavy, or all."""
    if only:
        return corpus.where(F.col("id").isin(*only))
    return corpus if heavy else corpus.where("NOT heavy")


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """(tool, documents, total_time, mean_f1, exact) of runs (tool, document, median_time, f1, exact)."""
    return runs.groupBy("tool").agg(F.count("*").alias("documents"), F.sum("median_time").alias("total_time"), F.avg("f1").alias("mean_f1"), F.count_if("exact").alias("exact"))


def report(totals: DataFrame) -> str:
    """A markdown table of the totals; they are one row a tool."""
    rows = totals.orderBy("tool").collect()
    head = "| tool | documents | total s | mean F1 | exact grids |\n|-|-:|-:|-:|-:|\n"
    return head + "".join(f"| {r['tool']} | {r['documents']} | {r['total_time']:.1f} | {100 * (r['mean_f1'] or 0):.1f} % | {r['exact']} |\n" for r in rows)


def timed(run: Callable[[], None], warm_up: int = 1, measured: int = 3) -> tuple[list[float], float]:
    """Seconds of the measured runs, and the driver's peak MB."""
    for _ in range(warm_up):
        run()
    took = []
    for _ in range(measured):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return took, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
