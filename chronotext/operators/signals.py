"""How much later one signal runs than another, by cross-correlation.

A signal is rows (by, place, value), places from 0. It is cut into blocks; blocks that a lag
within reach can bring together are multiplied by Fourier transforms in tasks, and the sums of
each lag come together by a group-by, so no task holds a signal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Values of a block, and sums by pairs of blocks that a task holds before it gives them on.
BLOCK, HELD = 4096, 64


def _blocks(signal: DataFrame, by: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, lengths): (by, block, values) with the mean at 0 and a deviation of 1; a place
    without a value, or a signal that never moves, counts as its mean."""
    value = F.when(~F.isnan("value"), F.col("value")).cast("double")
    s = signal.where("place >= 0").groupBy(*by, F.col("place").cast("long").alias("place")).agg(F.first(value, ignorenulls=True).alias("value"))
    stats = s.groupBy(*by).agg(F.mean("value").alias("_mean"), F.stddev_pop("value").alias("_deviation"), (F.max("place") + 1).alias("_n"))
    even = F.coalesce((F.col("value") - F.col("_mean")) / F.nullif(F.col("_deviation"), F.lit(0.0)), F.lit(0.0))
    cell = F.struct((F.col("place") % size).cast("int").alias("at"), even.alias("value"))
    blocks = s.join(stats, by).groupBy(*by, F.floor(F.col("place") / size).alias("_block")).agg(F.collect_list(cell).alias("_cells"))
    return blocks, stats.select(*by, "_n")


def correlations(left: DataFrame, right: DataFrame, by: list[str], reach: int, size: int = BLOCK) -> DataFrame:
    """(by, lag, score): for each lag up to reach either way, within which the signals overlap,
    the sum of left's value at place + lag times right's at place, both normalised, divided by
    the shorter one's length and rounded to nine digits.

    Each block meets those that reach allows, 2 + 2 * reach / size of them at most, so work
    grows with length times reach. Keys of one signal only, and null keys, give nothing. Of
    values at one place one counts."""
    if reach < 0 or size < 1:
        raise ValueError("reach must not be negative, size must be positive")
    (a, n), (b, m) = _blocks(left, by, size), _blocks(right, by, size)
    wide = reach // size + 1
    moved = b.withColumn("_apart", F.explode(F.sequence(F.lit(-wide), F.lit(wide)))).select(*by, (F.col("_block") + F.col("_apart")).alias("_block"), "_apart", F.col("_cells").alias("_others"))
    pairs = a.join(moved, [*by, "_block"])
    keys = [pairs.schema[c] for c in by]
    schema = StructType([*keys, StructField("_first", LongType()), StructField("_sums", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def spectrum(cells: list[dict]) -> np.ndarray:
        line = np.zeros(2 * size)
        for c in cells:
            line[c["at"]] = c["value"]
        return np.fft.rfft(line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            # lags from -size to size - 1 within a pair of blocks, the negative ones at the end
            rows = []
            for key, x in held.items():
                first = (key[-1] - 1) * size
                low, high = max(0, -reach - first), min(2 * size, reach - first + 1)
                if low < high:
                    rows.append((*key[:-1], first + low, np.roll(np.fft.irfft(x, 2 * size), size)[low:high]))
            held.clear()
            columns = [*zip(*rows)] if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in [*by, "_apart"]]
            for i, key in enumerate(zip(*names)):
                one = spectrum(batch.column("_cells")[i].as_py()) * np.conj(spectrum(batch.column("_others")[i].as_py()))
                held[key] = held[key] + one if key in held else one
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    lagged = pairs.select(*by, "_apart", "_cells", "_others").mapInArrow(run, schema).select(*by, "_first", F.posexplode("_sums").alias("_k", "_part"))
    sums = lagged.select(*by, (F.col("_first") + F.col("_k")).alias("lag"), "_part").groupBy(*by, "lag").agg(F.sum("_part").alias("score"))
    both = sums.join(n, by).join(m.withColumnRenamed("_n", "_m"), by).where((F.col("lag") < F.col("_n")) & (-F.col("lag") < F.col("_m")))
    return both.select(*by, "lag", F.round(F.col("score") / F.least("_n", "_m"), 9).alias("score"))


def offset(left: DataFrame, right: DataFrame, by: list[str], reach: int, size: int = BLOCK) -> DataFrame:
    """(by, lag, score) of the best lag: left's time is right's plus lag. Of equal scores the
    smallest lag."""
    best = F.max(F.struct(F.col("score"), (-F.col("lag")).alias("back")))
    return correlations(left, right, by, reach, size).groupBy(*by).agg(best.alias("best")).select(*by, (-F.col("best.back")).alias("lag"), "best.score")
