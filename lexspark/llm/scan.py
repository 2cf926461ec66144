"""Running sums along sequences that lie in the rows of a table: numpy scans over sorted partitions, joined by what each carries on.

Rows are range-partitioned by (key, order), so a sequence that holds a large part of all rows is spread over many tasks.  Each
partition is scanned in one stream of Arrow batches; what a sequence has summed up before a partition is found from one row per
partition, and is added when the result is read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_rows, written

_LOW = 1 << 14


class Powers:
    """Powers of an odd number modulo 2**64, of whole arrays of exponents."""

    def __init__(self, base: int):
        self.base = base
        self.low = self._run(base, _LOW)
        self.high = self._run(pow(base, _LOW, 1 << 64), 2)

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        most = int(exponents.max(initial=0)) // _LOW
        if most >= len(self.high):
            self.high = self._run(int(self.high[1]), most + 1)
        return self.low[exponents % _LOW] * self.high[exponents // _LOW]


def segmented(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums (modulo 2**64) that begin anew at each of the ascending ``starts``; the first of them is 0."""
    total = np.cumsum(x, dtype=np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), total])[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(x))))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def running(df: DataFrame, key: str, order: Sequence[Column], values: dict[str, tuple[str, int]], place: str, path: str, before: dict[str, str] | None = None) -> DataFrame:
    """Adds ``place``, a row's place from 1 among the rows of its key in ``order``, and for each ``name: (column, base)`` of ``values``
    the sum of column * base**(place - 1) over the key's rows up to this one, as 64-bit numbers that wrap.
    ``before`` names columns for such a sum without this row, and whose.

    ``key`` is not null; the columns summed are longs that are not null.  What is written to ``path`` must stay while the result is used.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seg, inner = fresh(df, "_seg"), fresh(df, "_inner")
    before = before or {}
    added = [seg, inner, place, *values, *before]
    bases = {name: base for name, (_, base) in values.items()}
    less = {value: name for name, value in before.items()}
    by = [F.col(key), *order]
    kept = list(df.columns)

    def scan(batches):
        number, powers = TaskContext.get().partitionId(), {b: Powers(b) for b in set(bases.values())}
        last, count, inside = None, 0, 0
        sums = dict.fromkeys(values, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(kept.index(key))
            first, final = keys[0].as_py(), keys[n - 1].as_py()
            fresh_key = np.ones(n, bool)
            fresh_key[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            goes_on = last is not None and first == last
            inside += last is not None and not goes_on  # a key that began in this partition
            starts = np.flatnonzero(fresh_key)
            group = np.cumsum(fresh_key) - 1
            places = np.arange(n) - starts[group]
            end = int(starts[1]) if len(starts) > 1 else n
            if goes_on:
                places[:end] += count
            columns = {seg: pa.array(np.full(n, number, np.int32)), inner: pa.array(inside + group > 0), place: pa.array(places + 1)}
            for name, (column, base) in values.items():
                x = batch.column(kept.index(column)).to_numpy(zero_copy_only=False).view(np.uint64)
                terms = x * powers[base](places) if base != 1 else x
                made = segmented(terms, starts)
                if goes_on:
                    made[:end] += np.uint64(sums[name])
                columns[name], sums[name] = _signed(made), int(made[-1])
                if name in less:
                    columns[less[name]] = _signed(made - terms)
            last, count, inside = final, int(places[-1]) + 1, inside + len(starts) - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *[columns[c] for c in added]], [*kept, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    kinds = [f"`{seg}` int", f"`{inner}` boolean", f"`{place}` bigint", *[f"`{v}` bigint" for v in (*values, *before)]]
    schema = ", ".join(fields + kinds)
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    local = written(map_rows(ordered, scan, schema), path)

    # of each partition its first and its last key, with what they sum up to there: as many rows as there are partitions
    ends = local.groupBy(seg).agg(
        F.min(key).alias("first"),
        F.max(key).alias("last"),
        F.max_by(F.struct(place, *values), F.struct(key, place)).alias("sums"),
    )
    carry: dict[int, tuple] = {}
    key_now, count, sums = None, 0, dict.fromkeys(values, 0)
    for row in sorted(ends.collect(), key=lambda r: r[seg]):
        if row["first"] == key_now:
            carry[row[seg]] = (count, dict(sums))
        if row["last"] != key_now or row["first"] != row["last"]:
            key_now, count, sums = row["last"], 0, dict.fromkeys(values, 0)
        sums = {v: (sums[v] + row["sums"][v] * pow(b, count, 1 << 64)) % (1 << 64) for v, b in bases.items()}
        count += row["sums"][place]
    if not carry:
        return local.drop(seg, inner)

    def carried(batches):
        powers = {b: Powers(b) for b in set(bases.values())}
        for batch in batches:
            columns = dict(zip([*kept, *added], batch.columns))
            number, within = columns[seg].to_numpy(), columns[inner].to_numpy(zero_copy_only=False)
            for s in np.unique(number[~within]).tolist():
                if s not in carry:
                    continue
                at = np.flatnonzero((number == s) & ~within)
                earlier, totals = carry[s]
                for name, value in [*((v, v) for v in values), *before.items()]:
                    x = columns[name].to_numpy().view(np.uint64).copy()
                    x[at] = x[at] * powers[bases[value]](np.array([earlier]))[0] + np.uint64(totals[value])
                    columns[name] = _signed(x)
                places = columns[place].to_numpy().copy()
                places[at] += earlier
                columns[place] = pa.array(places)
            names = [*kept, place, *values, *before]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return map_rows(local, carried, ", ".join([*fields, *kinds[2:]]))
