"""Folds over ordered groups: for rules whose next step depends on a running mean."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_groups(df: DataFrame, deal: list[str], keys: list[str], order: list, columns: list[str], step: Callable[[dict[str, list]], dict[str, list]], added: dict[str, str]) -> DataFrame:
    """`df` with the columns that `step` makes of each group's columns (lists in order).

    Rows are dealt by `deal` (a prefix of `keys`, so that later windows by it need no shuffle), sorted, and streamed:
    a worker holds one group at a time.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    ddl = ", ".join(f"`{c}` {t}" for c, t in (kinds | added).items())
    types = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "string": pa.string(), "boolean": pa.bool_()}
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
            cols = {c: table.column(c).to_pylist() for c in columns}
            out: dict[str, list] = {c: [] for c in added}
            lo = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[lo]:
                    made = step({c: v[lo:i] for c, v in cols.items()})
                    for c in added:
                        out[c] += made[c]
                    lo = i
            for c, kind in added.items():
                table = table.append_column(c, pa.array(out[c], types[kind]))
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = list(zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True))
            cut = batch.num_rows
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if held and ids[0] != last or cut:
                if held and ids[0] != last:
                    yield flush(held)
                    held = []
                if cut:
                    yield flush([*held, batch.slice(0, cut)])
                    held = []
            held.append(batch.slice(cut))
            last = ids[-1]
        if held:
            yield flush(held)

    return df.repartition(*deal).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def cluster_rows(group: dict[str, list]) -> dict[str, list]:
    """Row numbers and running mean heights of items in order of top_y: a new row where one is further from the mean than the tolerance."""
    heights = sorted(group["height"])
    tolerance = 0.6 * heights[len(heights) // 2]
    rows, last, mean, n = [], -1, 0.0, 0
    for y in group["top_y"]:
        if last < 0 or abs(y - mean) > tolerance:
            last, mean, n = last + 1, y, 1
        else:
            mean = (mean * n + y) / (n + 1)
            n += 1
        rows.append((last, mean))
    means = dict(rows)
    return {"row_idx": [r for r, _ in rows], "row_y": [means[r] for r, _ in rows]}


def start_clusters(group: dict[str, list]) -> dict[str, list]:
    """Fallback column starts from items in order of x: running-mean clusters with enough members, or all."""
    found: list[list[float]] = []
    for x in group["x"]:
        if found and x - found[-1][0] <= 3:
            mean, n = found[-1]
            found[-1] = [(mean * n + x) / (n + 1), n + 1]
        else:
            found.append([x, 1])
    least = max(2, int(0.15 * (max(group["row_idx"]) + 1)))
    kept = [m for m, n in found if n >= least] or [m for m, _ in found]
    return {"starts": [kept] * len(group["x"])}
