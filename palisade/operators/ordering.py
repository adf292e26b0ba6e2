"""Global order at scale: running sums, row numbers, previous rows and exact quantiles.

A window without a partition sends every row to one task. Here the rows are range-sorted into
slices instead; only one summary row per slice (at most the number of shuffle partitions) is
combined in order, and its offsets are joined back. Quantiles sort only the values near the wanted ranks.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DataType, DatetimeType, NumericType, StringType, TimestampNTZType

from palisade.session import checkpointed, packed, small_side


def _as_column(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


class SortedSlices:
    """``df`` in a global order, kept as range-sorted slices that are computed once."""

    def __init__(self, df: DataFrame, *order, unique: bool = False):
        """``unique`` says that no two rows share the whole order key; otherwise ties are spread."""
        keys = list(order) if unique else [*order, F.col("_tie")]
        frame = df if unique else df.withColumn("_tie", F.monotonically_increasing_id())
        ordered = frame.orderBy(*keys).withColumn("_place", F.monotonically_increasing_id())
        self.frame = packed(
            ordered.withColumn("_slice", F.shiftrightunsigned("_place", 33).cast("int")).drop("_tie")
        )
        self._inside = Window.partitionBy("_slice").orderBy("_place")

    def running(self, by=(), **sums) -> DataFrame:
        """Add ``<name>``: the sum of the column over all rows before this one in the order.

        With ``by`` (the leading order columns) the sums begin anew in each group. A group of any size
        is spread over many slices; there are at most as many (slice, group) pairs as slices and groups.
        """
        values = {f"_value_{name}": F.coalesce(_as_column(column), F.lit(0)) for name, column in sums.items()}
        valued = self.frame.withColumns(values)
        place = ["_slice", *by]
        per_slice = valued.groupBy(*place).agg(*[F.sum(v).alias(v) for v in values])
        earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_slice.select(
            *place, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_offset{v}") for v in values]
        )
        inside = Window.partitionBy(*place).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        # without groups there is one row per slice; with groups the optimizer goes by the size
        summed = valued.join(offsets if by else F.broadcast(offsets), place)
        return summed.withColumns({
            name: F.coalesce(F.sum(f"_value_{name}").over(inside), F.lit(0)) + F.col(f"_offset_value_{name}")
            for name in sums
        }).drop(*values, *[f"_offset{v}" for v in values])

    def numbered(self, name: str = "row_number", by=()) -> DataFrame:
        """Add the 0-based place of the row in the whole order (or its group); needs no second sort."""
        place = ["_slice", *by]
        counts = self.frame.groupBy(*place).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*place, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
        # one row per slice and group; many groups are joined by a shuffle
        numbered = self.frame.join(small_side(offsets) if by else F.broadcast(offsets), place)
        return numbered.withColumn(name, F.col("_place") - F.col("_first") + F.col("_offset")).drop("_first", "_offset")

    def previous(self, **columns) -> DataFrame:
        """Add ``<name>``: the value of the column in the row before this one in the order."""
        last = F.max_by(F.struct(*columns.values()), F.col("_place")).alias("_last")
        per_slice = self.frame.groupBy("_slice").agg(last)
        carried = per_slice.select("_slice", F.lag("_last").over(Window.orderBy("_slice")).alias("_carried"))
        joined = self.frame.join(F.broadcast(carried), "_slice")  # one row per slice
        first = F.row_number().over(self._inside) == 1
        return joined.withColumns({
            name: F.when(first, F.col("_carried")[column]).otherwise(F.lag(column).over(self._inside))
            for name, column in columns.items()
        }).drop("_carried")


def plain(df: DataFrame) -> DataFrame:
    """Drop the helper columns of a sorted frame."""
    return df.drop("_slice", "_place")


def running_totals(df: DataFrame, order, unique: bool = False, by=(), **sums) -> DataFrame:
    return plain(SortedSlices(df, *by, *order, unique=unique).running(by, **sums))


def with_row_number(df: DataFrame, order, name: str = "row_number", unique: bool = False) -> DataFrame:
    return plain(SortedSlices(df, *order, unique=unique).numbered(name))


def numbered_within(df: DataFrame, group: str, order, name: str = "row_number", unique: bool = False) -> DataFrame:
    """0-based row number inside each group, also when one group holds most rows."""
    return plain(SortedSlices(df, group, *order, unique=unique).numbered(name, [group]))


def _sortable(kind: DataType) -> bool:
    """Whether values are compared as they are: numbers, texts and times."""
    return isinstance(kind, (NumericType, StringType, BooleanType, DatetimeType, TimestampNTZType))


def first_per_key(df: DataFrame, keys, order, newest: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) in the order; combined before the shuffle.

    Where the order is given by names, its columns lead the row that is compared, so that they are moved once.
    """
    rest = [c for c in df.columns if c not in keys]
    plain_keys = all(isinstance(c, str) for c in [*keys, *order])
    leading = list(dict.fromkeys(c for c in order if c not in keys)) if plain_keys else []
    if leading and set(leading) <= set(rest) and all(_sortable(df.schema[c].dataType) for c in rest):
        whole = F.struct(*leading, *[c for c in rest if c not in leading])
        chosen = df.groupBy(*keys).agg((F.max if newest else F.min)(whole).alias("_row"))
        return chosen.select(*keys, "_row.*").select(*df.columns)
    pick = F.max_by if newest else F.min_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


# Rank error of the sketch that brackets a quantile, as one part in so many; it decides how many rows are sorted, not the result.
SKETCH_ACCURACY = 10_000


def bracket_edges(df: DataFrame, columns, probabilities) -> dict:
    """Per column sorted values that lie closely around the wanted quantiles, from one mergeable sketch a column."""
    reach = 2.0 / SKETCH_ACCURACY
    levels = sorted({min(1.0, max(0.0, p + side * reach)) for p in probabilities for side in (-1, 1)})
    value = lambda c: F.col(c).cast("double")
    found = df.agg(*[
        F.percentile_approx(F.when(~F.isnan(value(c)), value(c)), F.array(*map(F.lit, levels)), SKETCH_ACCURACY).alias(f"q{i}")
        for i, c in enumerate(columns)
    ]).first()  # a few numbers per column and probability
    return {c: np.unique(np.asarray(found[f"q{i}"] or [], dtype=float)) for i, c in enumerate(columns)}


def _cells(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """2 * i + 1 for a value equal to edge i, 2 * i for one between edge i - 1 and edge i."""
    return np.searchsorted(edges, values, "left") + np.searchsorted(edges, values, "right")


def _doubles(batch, i: int) -> np.ndarray:
    values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
    return values[~np.isnan(values)]


def cell_counts(df: DataFrame, columns, edges: dict) -> dict:
    """column -> number of values in each cell; tasks count first, so a task sends one row per cell."""

    def count(batches):
        total = [np.zeros(2 * len(edges[c]) + 1, np.int64) for c in columns]
        for batch in batches:
            for i, c in enumerate(columns):
                total[i] += np.bincount(_cells(edges[c], _doubles(batch, i)), minlength=len(total[i]))
        name = np.repeat(np.arange(len(columns)), [len(t) for t in total])
        cell, n = np.concatenate([np.arange(len(t)) for t in total]), np.concatenate(total)
        seen = n > 0
        yield pa.record_batch([pa.array(name[seen], pa.int32()), pa.array(cell[seen], pa.int32()), pa.array(n[seen])], names=["name", "cell", "n"])

    wide = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    out = {c: np.zeros(2 * len(edges[c]) + 1, np.int64) for c in columns}
    counted = wide.mapInArrow(count, "name int, cell int, n long").groupBy("name", "cell").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # cells per column
        out[columns[row["name"]]][row["cell"]] = row["n"]
    return out


def values_in_cells(df: DataFrame, columns, edges: dict, wanted: dict) -> DataFrame:
    """(name, cell, value) of the values in the wanted cells of each column."""

    def pick(batches):
        for batch in batches:
            for i, c in enumerate(columns):
                if wanted.get(c):
                    values = _doubles(batch, i)
                    cells = _cells(edges[c], values)
                    keep = np.isin(cells, wanted[c])
                    yield pa.record_batch([
                        pa.array(np.full(keep.sum(), i), pa.int32()), pa.array(cells[keep], pa.int32()), pa.array(values[keep])],
                        names=["name", "cell", "value"])

    wide = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    return wide.mapInArrow(pick, "name int, cell int, value double")


def ranked_values(df: DataFrame, columns, ranks: dict) -> dict:
    """(column, rank) -> value at that 0-based rank, for ``ranks``: column -> function of the number of values to ranks.

    1. A sketch gives edges around the wanted quantiles. 2. One pass counts the values between and on the edges, which
    tells the cell of every wanted rank; a value that ties with an edge is known then, however often it occurs.
    3. Only values strictly between two edges that hold a wanted rank are counted by value, sorted and numbered.
    """
    edges = bracket_edges(df, columns, ranks["probabilities"])
    counts = cell_counts(df, columns, edges)
    found, inside, lowest = {}, {}, {}
    for c in columns:
        ends = np.cumsum(counts[c])
        total = int(ends[-1])
        for rank in sorted(set(ranks["of"](total))) if total else []:
            cell = int(np.searchsorted(ends, rank, "right"))
            if cell % 2:
                found[c, rank] = float(edges[c][cell // 2])
            else:
                lowest[c, cell] = int(ends[cell] - counts[c][cell])
                inside.setdefault((c, cell), []).append(rank)
    if inside:
        wanted = {}
        for c, cell in inside:
            wanted.setdefault(c, []).append(cell)
        values = values_in_cells(df, columns, edges, wanted).groupBy("name", "cell", "value").agg(F.count(F.lit(1)).alias("n"))
        placed = running_totals(values, ["value"], unique=True, by=["name", "cell"], before=F.col("n"))
        asked = [(columns.index(c), cell, rank, rank - lowest[c, cell]) for (c, cell), rs in inside.items() for rank in rs]
        places = df.sparkSession.createDataFrame(asked, "name int, cell int, rank long, place long")  # the wanted ranks
        hit = placed.join(F.broadcast(places), ["name", "cell"]).where("place >= before AND place < before + n")
        for row in hit.select("name", "rank", "value").collect():
            found[columns[row["name"]], row["rank"]] = row["value"]
    return {**found, "totals": {c: int(counts[c].sum()) for c in columns}}


def quantile_values(df: DataFrame, columns, probabilities) -> dict:
    """(column, probability) -> exact quantile with linear interpolation; columns without a value are left out."""
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    around = lambda n: [r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]
    found = ranked_values(df, columns, {"probabilities": probabilities, "of": around})
    out = {}
    for c in columns:
        n = found["totals"][c]
        for p in probabilities if n else []:
            position = p * (n - 1)
            low, high = found[c, math.floor(position)], found[c, math.ceil(position)]
            out[c, p] = low if low == high else low + (high - low) * (position - math.floor(position))
    return out


def exact_quantiles(df: DataFrame, columns, probabilities) -> DataFrame:
    """(name, probability, value) with linear interpolation; NULL and NaN do not count.

    The values are read three times (sketch, counts, values near the wanted ranks) and never sorted as a whole. Spark's
    own ``percentile`` keeps all distinct values of a group in one buffer, so it is not used.
    """
    rows = [(c, p, float(v)) for (c, p), v in quantile_values(df, columns, probabilities).items()]
    return df.sparkSession.createDataFrame(rows, "name string, probability double, value double")


def quantile_table(df: DataFrame, columns, probabilities) -> dict:
    """The quantiles on the driver: one list per column, at most columns x probabilities numbers."""
    found = quantile_values(df, columns, probabilities)
    return {c: [found.get((c, float(p))) for p in probabilities] for c in columns}
