"""Training, validation and test parts without leakage over time or entities."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from palisade import schema as S
from palisade.functions.labels import binary_label
from palisade.functions.numbers import count_if
from palisade.operators.ordering import numbered_within, running_totals, with_row_number
from palisade.session import checkpointed

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def time_column(df: DataFrame) -> str | None:
    return next((c for c in ("window_end", "timestamp", "window_start") if c in df.columns), None)


def entity_column(df: DataFrame) -> str | None:
    return next((c for c in ("entity_id", "src_ip") if c in df.columns), None)


def part(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name).drop("split")


def _cuts(df: DataFrame, group: str, time: str, frac, one_group: bool = False) -> DataFrame:
    """Per group the two cut times: ends of equal-time groups nearest to the wanted row counts.

    With ``one_group`` the tables of one row per group have a single row and are sent to all tasks, so the
    rows of the group are not brought together on its key.
    """
    small = F.broadcast if one_group else (lambda frame: frame)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    per_time = df.where(F.col(time).isNotNull()).groupBy(group, time).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(per_time, [time], unique=True, by=[group], _before=F.col("_n"))
    # read for both cuts; one row per group and time
    ends = checkpointed(placed.join(small(sizes), group).select(
        group, F.col(time).alias("_time"), "_rows", (F.col("_before") + F.col("_n")).alias("_end")
    ))
    nearest = lambda target: F.min_by(
        F.struct("_end", "_time"), F.struct(F.abs(F.col("_end") - target), F.col("_end")))
    first_target = F.floor(F.col("_rows") * F.lit(float(frac[0])))
    second_target = F.floor(F.col("_rows") * F.lit(float(frac[0] + frac[1])))
    first = ends.groupBy(group).agg(nearest(first_target).alias("_first"))
    later = ends.join(small(first), group).where(F.col("_end") > F.col("_first._end"))
    second = later.groupBy(group).agg(nearest(second_target).alias("_second"))
    return first.join(second, group, "left").select(
        group, F.col("_first._time").alias("_cut1"), F.col("_second._time").alias("_cut2")
    )


def temporal_split(df: DataFrame, frac=(0.6, 0.2, 0.2), entity_disjoint: bool = False, by: str | None = None,
                   time: str | None = None) -> DataFrame:
    """Add ``split``. Rows of one time stay together; with ``by`` every source is cut on its own.

    Rows without a time come last. With ``entity_disjoint`` the later parts lose the entities that an
    earlier part already holds.
    """
    if len(frac) != 3 or any(f < 0 for f in frac) or not math.isclose(sum(frac), 1.0):
        raise ValueError(f"Split fractions must be non-negative and sum to 1.0: {frac}")
    time = time or time_column(df)
    if by is None:
        cuts = _cuts(df.withColumn("_all", F.lit(1)), "_all", time, frac, one_group=True)
        framed = df.withColumn("_cut1", cuts.select("_cut1").scalar()).withColumn("_cut2", cuts.select("_cut2").scalar())
    else:
        framed = df.join(_cuts(df, by, time, frac), by, "left")
    when = F.col(time)
    split = (
        F.when(F.col("_cut1").isNull() | (when <= F.col("_cut1")), TRAIN)
        .when(F.col("_cut2").isNull() | (when <= F.col("_cut2")), VALIDATION)
        .otherwise(TEST)
    )
    out = framed.withColumn("split", split).drop("_cut1", "_cut2").select(*df.columns, "split")
    entity = entity_column(df)
    return purge_entities(out, entity) if entity_disjoint and entity else out


def purge_entities(split: DataFrame, entity: str) -> DataFrame:
    """Validation without training entities; test without training and remaining validation entities.

    The first part an entity appears in is the only one it may stay in, so one aggregation per entity
    and one join replace two anti joins. Rows without an entity stay.
    """
    order = F.when(F.col("split") == TRAIN, 0).when(F.col("split") == VALIDATION, 1).otherwise(2)
    ranked = split.withColumn("_part", order)
    first = ranked.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min("_part").alias("_first_part"))
    joined = ranked.join(first, entity, "left")
    keep = F.col("_first_part").isNull() | (F.col("_part") == F.col("_first_part"))
    return joined.where(keep).select(*split.columns)


def entity_overlap(split: DataFrame, entity: str | None = None) -> DataFrame:
    """One row with the number of entities shared by each pair of parts."""
    entity = entity or entity_column(split)
    seen = split.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        *[F.max(F.col("split") == p).alias(p) for p in (TRAIN, VALIDATION, TEST)]
    )
    both = lambda a, b: count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}")
    return seen.agg(both(TRAIN, VALIDATION), both(TRAIN, TEST), both(VALIDATION, TEST))


def split_summary(split: DataFrame) -> DataFrame:
    """Per part: rows, first and last time, label counts and number of distinct sources."""
    time = time_column(split)
    aggregates = [
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("time_min"), F.max(time).alias("time_max"),
        count_if(F.col("label") == S.NORMAL).alias("normal_rows"),
        count_if(F.col("label") == S.ANOMALY).alias("anomaly_rows"),
    ]
    for name in ("timestamp_source", "label_source"):
        if name in split.columns:
            aggregates.append(F.count_distinct(name).alias(f"{name}s"))
    return split.groupBy("split").agg(*aggregates)


def split_label_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))


def split_sources(split: DataFrame) -> DataFrame:
    """Distinct time and label sources of each part, in long form."""
    names = [c for c in ("timestamp_source", "label_source") if c in split.columns]
    entries = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("source")) for c in names])
    return split.select("split", F.inline(entries)).where(F.col("source").isNotNull()).distinct()


def ratio_split(df: DataFrame, order, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Add ``split`` by row position: 60 / 20 / 20, each part with at least one row where possible."""
    numbered = with_row_number(df, order, "_row")
    total = numbered.agg(F.count(F.lit(1))).scalar()
    first = F.greatest(F.lit(1), F.floor(total * F.lit(float(train))))
    second = F.least(total - 1, first + F.greatest(F.lit(1), F.floor(total * F.lit(float(validation)))))
    row = F.col("_row")
    split = F.when(row < first, TRAIN).when(row < second, VALIDATION).otherwise(TEST)
    return numbered.withColumn("split", split).drop("_row")


def day_split(df: DataFrame, file: str = "source_file", order=None) -> DataFrame:
    """Add ``split`` by capture day in the file name, as far as the days are there.

    Monday trains. Tuesday validates and Thursday or Friday tests; with Tuesday alone its first half
    validates and its second half tests; with Thursday alone all other days are cut in time.
    """
    name = F.lower(F.col(file))
    days = df.agg(*[F.max(name.contains(d)).alias(d) for d in ("monday", "tuesday", "thursday")]).first()
    if not (days["monday"] and (days["tuesday"] or days["thursday"])):
        return temporal_split(df)
    if days["tuesday"] and days["thursday"]:
        split = (
            F.when(name.contains("monday"), TRAIN).when(name.contains("tuesday"), VALIDATION)
            .when(name.rlike("thursday|friday"), TEST)
        )
        return df.withColumn("split", split).where(F.col("split").isNotNull())
    train = df.where(name.contains("monday")).withColumn("split", F.lit(TRAIN))
    if days["tuesday"]:
        order = order or [time_column(df)]
        numbered = with_row_number(df.where(name.contains("tuesday")), order, "_row")
        half = F.floor(numbered.agg(F.count(F.lit(1))).scalar() / 2)
        rest = numbered.withColumn("split", F.when(F.col("_row") < half, VALIDATION).otherwise(TEST)).drop("_row")
    else:
        halves = temporal_split(df.where(~name.contains("monday")), (0.5, 0.5, 0.0))
        renamed = F.when(F.col("split") == TRAIN, VALIDATION).when(F.col("split") == VALIDATION, TEST)
        rest = halves.withColumn("split", renamed).where(F.col("split").isNotNull())
    return train.unionByName(rest)


def hash_order(keys, seed: int = 42) -> Column:
    """Pseudo-random but repeatable order of rows with the given key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def random_split(df: DataFrame, keys, test_fraction: float = 0.3, seed: int = 42,
                 strata: str | None = None) -> DataFrame:
    """Add ``split`` with exact sizes: the test part is rounded up, per stratum when one is given."""
    ordered = df.withColumn("_hash", hash_order(keys, seed))
    if strata is None:
        numbered = with_row_number(ordered, ["_hash", *keys], "_row", unique=True)
        total = numbered.agg(F.count(F.lit(1))).scalar()
        numbered = numbered.withColumn("_rows", total)
    else:
        numbered = numbered_within(ordered, strata, ["_hash", *keys], "_row", unique=True)
        numbered = numbered.join(numbered.groupBy(strata).agg(F.count(F.lit(1)).alias("_rows")), strata)
    test_rows = F.ceil(F.round(F.col("_rows") * F.lit(float(test_fraction)), 9))
    split = F.when(F.col("_row") < F.col("_rows") - test_rows, TRAIN).otherwise(TEST)
    return numbered.withColumn("split", split).select(*df.columns, "split")


def one_class_split(df: DataFrame, order, train_ratio: float = 0.6, label: str = "label") -> DataFrame:
    """Add ``split``: the first share of the benign rows trains; the rest and all anomalies test."""
    known = df.withColumn("_y", binary_label(F.col(label))).where(F.col("_y") >= 0)
    numbered = numbered_within(known, "_y", order, "_row")
    benign = known.where("_y = 0").agg(F.count(F.lit(1))).scalar()
    train = (F.col("_y") == 0) & (F.col("_row") < F.floor(benign * F.lit(float(train_ratio))))
    return numbered.withColumn("split", F.when(train, TRAIN).otherwise(TEST)).select(*df.columns, "split")


def union_test_set(benign: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Held-out benign rows together with all anomalies."""
    return benign.unionByName(anomalies, allowMissingColumns=True)


def spaced_rows(df: DataFrame, order, rows: int) -> DataFrame:
    """Evenly spaced rows, first and last included; all rows when there are not more than asked for."""
    total = df.count()
    if rows <= 0 or total <= rows:
        return df
    numbered = with_row_number(df, order, "_row")
    if rows == 1:
        return numbered.where("_row = 0").drop("_row")
    step = (total - 1) / (rows - 1)
    row = F.col("_row")
    near = F.floor(row / F.lit(step))
    # row r is chosen when floor(i * step) = r for some i; rounding may put i one off
    hit = F.exists(
        F.array(near - 1, near, near + 1),
        lambda i: (i >= 0) & (i < rows - 1) & (F.floor(i * F.lit(step)) == row),
    )
    return numbered.where(hit | (row == total - 1)).drop("_row")


def check_splits(split: DataFrame, saved_counts: dict) -> dict:
    """Raise when counts, training labels or entities break the split contract; return the counts."""
    rows = {r["split"]: r for r in split_summary(split).collect()}  # one row per part
    actual = {name: int(rows[name]["rows"]) if name in rows else 0 for name in (TRAIN, VALIDATION, TEST)}
    for name, count in actual.items():
        expected = saved_counts.get(name)
        if expected is not None and int(expected) != count:
            raise ValueError(f"Canonical split count mismatch for {name}: manifest={expected}, file={count}")
    bad = part(split, TRAIN).where(binary_label(F.col("label")) != 0)
    if not bad.isEmpty():
        raise ValueError("the training part contains non-benign labels")
    if entity_column(split):
        overlap = entity_overlap(split).first().asDict()
        if any(overlap.values()):
            raise ValueError(f"Canonical entity overlap detected: {overlap}")
    return actual
