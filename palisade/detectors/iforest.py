"""Isolation forest (Liu, Ting and Zhou 2008): trees grow in parallel from small row samples.

A tree needs only ``max_samples`` rows, so the whole forest is one shuffle of a few hundred thousand
rows whatever the size of the table. Several forests (for a grid or for feature subsets) grow in the
same job.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.operators.ordering import quantile_table
from palisade.session import checkpointed, tasks_for

DEFAULTS = {"n_estimators": 200, "max_samples": 256, "contamination": 0.02, "random_state": 42}
NODES = "forest int, tree int, node int, feature int, threshold double, left int, right int, size long, depth int"


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def grow_tree(rows: np.ndarray, columns, rng, max_depth: int) -> list:
    """Random splits of at most ``max_samples`` rows: (node, feature, threshold, left, right, size, depth)."""
    nodes, waiting = [], [(0, np.arange(len(rows)), 0)]
    created = 1
    while waiting:
        node, members, depth = waiting.pop()
        inside = rows[members][:, columns]
        low, high = inside.min(axis=0), inside.max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if depth >= max_depth or len(members) <= 1 or not len(open_columns):
            nodes.append((node, -1, 0.0, -1, -1, len(members), depth))
            continue
        pick = rng.choice(open_columns)
        threshold = rng.uniform(low[pick], high[pick])
        if threshold >= high[pick]:
            threshold = low[pick]
        goes_left = inside[:, pick] <= threshold
        left, right = created, created + 1
        created += 2
        nodes.append((node, int(columns[pick]), float(threshold), left, right, len(members), depth))
        waiting += [(left, members[goes_left], depth + 1), (right, members[~goes_left], depth + 1)]
    return nodes


@dataclass
class Forest:
    """Node arrays of all trees, one after the other; leaves point to themselves."""

    features: list
    params: dict
    sample_size: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    path: np.ndarray
    levels: np.ndarray
    offset: float = 0.0
    nodes: pd.DataFrame = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "nodes": None}  # executors need the arrays only

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, features, params, sample_size: int, offset: float = 0.0) -> "Forest":
        ordered = nodes.sort_values(["tree", "node"], ignore_index=True)
        sizes = ordered.groupby("tree").size()
        roots = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]]).astype(np.int64)
        start = np.repeat(roots, sizes.to_numpy())
        place = np.arange(len(ordered))
        leaf = ordered["feature"].to_numpy() < 0
        left = np.where(leaf, place, ordered["left"].to_numpy() + start)
        path = ordered["depth"].to_numpy() + average_path(ordered["size"].to_numpy())
        return Forest(
            list(features), dict(params), int(sample_size), roots, np.where(leaf, 0, ordered["feature"].to_numpy()),
            np.where(leaf, np.inf, ordered["threshold"].to_numpy()), left, path,
            ordered.groupby("tree")["depth"].max().to_numpy(), float(offset), ordered,
        )

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), between 0 and 1; higher is more anomalous.

        All rows go down one tree together. The children of a node lie side by side and a leaf leads to
        itself, so a step is one comparison added to the left child.
        """
        flat = np.ascontiguousarray(rows).ravel()
        base = np.arange(len(rows), dtype=np.int64) * rows.shape[1]
        total = np.zeros(len(rows))
        for root, levels in zip(self.roots, self.levels):
            at = np.full(len(rows), root, dtype=np.int64)
            for _ in range(levels):
                value = flat.take(base + self.feature.take(at))
                at = self.left.take(at) + (value > self.threshold.take(at))
            total += self.path.take(at)
        expected = float(average_path(self.sample_size)) or 1.0
        return np.power(2.0, -total / (len(self.roots) * expected))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes)

    def info(self) -> dict:
        return {"features": self.features, "params": self.params, "sample_size": self.sample_size, "offset": self.offset}


def merged(params: dict | None, defaults: dict) -> dict:
    return {**defaults, **{k: v for k, v in (params or {}).items() if v is not None}}


ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(code: np.ndarray) -> np.ndarray:
    """Codes as numbers strictly between 0 and 1."""
    return ((mixed(code) >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def offered_rows(rows: DataFrame, features, trees, chance: float, seed: int, keys=None) -> DataFrame:
    """(features, forest, tree, draw): each row meets each tree with the given chance.

    Everything is drawn from a code of the row, so neither partitions nor repeated tasks matter. With ``keys`` (columns
    that tell rows apart) the code is theirs; without them equal rows are counted first and their copies get numbers.
    The meetings of a row are its hits in one sequence of trials, copy by copy and tree by tree; the way to the next
    hit is drawn at once. The way to the first one is drawn in the JVM, so that a row that meets no tree ends there.
    """
    count = len(trees)
    forest_of, tree_of = (np.array(c) for c in zip(*trees))
    step = math.log1p(-chance) if chance < 1.0 else -math.inf
    code = F.xxhash64(F.lit(int(seed)), *[F.col(c) for c in (keys or features)])
    coded = rows.select(*features, code.alias("_code"))
    copies = lambda df: df.withColumn("_copies", F.lit(1).cast("long")) if keys else df.groupBy("_code").agg(
        F.count(F.lit(1)).alias("_copies"))
    first = (F.shiftrightunsigned(F.xxhash64("_code", F.lit(1)), 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
    met = copies(coded).withColumn("_first", F.floor(F.least(F.log(first) / F.lit(step), F.lit(2.0 ** 60))).cast("long"))
    met = met.where(F.col("_first") < F.col("_copies") * count)
    if keys:
        coded = met
    else:
        # only codes move to be counted; those that meet a tree, a bounded number as each tree keeps few rows, fetch their rows
        coded = coded.join(F.broadcast(met), "_code").groupBy("_code").agg(
            F.any_value(F.struct(*features)).alias("_row"), F.first("_copies").alias("_copies"), F.first("_first").alias("_first")).select(
            "_row.*", "_code", "_copies", "_first")

    def offer(batches):
        for pdf in batches:
            codes = pdf["_code"].to_numpy().astype(np.uint64)
            trials, at = pdf["_copies"].to_numpy() * count, pdf["_first"].to_numpy()
            live, turn, hit_rows, hit_trials = np.arange(len(pdf)), 1, [], []
            while len(live):
                hit_rows.append(live)
                hit_trials.append(at)
                way = np.log(uniform(codes[live] + np.uint64(turn * int(ODD) % (1 << 64)))) / step
                at = at + 1 + np.minimum(np.floor(way), 2.0 ** 60).astype(np.int64)
                left = at < trials[live]
                live, at, turn = live[left], at[left], turn + 1
            row = np.concatenate(hit_rows) if hit_rows else np.empty(0, int)
            trial = np.concatenate(hit_trials) if hit_trials else np.empty(0, int)
            out = pdf.iloc[row][list(features)].copy()
            pick = trial % count
            out["forest"], out["tree"] = forest_of[pick], tree_of[pick]
            out["draw"] = uniform(mixed(codes[row]) + trial.astype(np.uint64) * ODD)
            yield out

    fields = ", ".join(f"`{f}` double" for f in features)
    return coded.mapInPandas(offer, f"{fields}, forest int, tree int, draw double")


def grow_forests(df: DataFrame, features, grid, keys=None) -> list:
    """One forest per entry of ``grid`` (parameters, optionally a ``features`` subset), grown in one job.

    Every row is offered to every tree with the same small chance. A tree is offered somewhat more rows than it needs and
    keeps those with the smallest draws: a simple random sample without replacement, of exactly as many rows as it asks
    for (should a tree ever be offered too few, all are offered again with twice the chance). Rows, not their place,
    decide what is drawn: the same table gives the same forest however it is partitioned. ``keys`` names columns that
    tell rows apart and saves the count of equal rows.
    """
    features = list(features)
    grid = [merged(g, DEFAULTS) for g in grid]
    named = [F.col(c) for c in keys or [] if c not in features]
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], *named)
    total = df.count()
    if total == 0:
        raise ValueError("cannot fit an isolation forest on an empty training part")
    sizes = [min(int(g["max_samples"]), total) for g in grid]
    columns = [[features.index(f) for f in g.get("features", features)] for g in grid]
    trees = [(i, t) for i, g in enumerate(grid) for t in range(int(g["n_estimators"]))]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        forest, tree = int(pdf["forest"].iloc[0]), int(pdf["tree"].iloc[0])
        kept = pdf.sort_values(["draw", *features], ignore_index=True).head(sizes[forest])
        rng = np.random.default_rng([int(grid[forest]["random_state"]), tree])
        depth = int(math.ceil(math.log2(max(sizes[forest], 2))))
        rows = grow_tree(kept[features].to_numpy(dtype=float), columns[forest], rng, depth)
        return pd.DataFrame(
            [(forest, tree, *r) for r in rows],
            columns=["forest", "tree", "node", "feature", "threshold", "left", "right", "size", "depth"],
        )

    # eight deviations above the rows a tree keeps
    chance = min(1.0, (max(sizes) + 8.0 * math.sqrt(max(sizes)) + 16.0) / total)
    while True:
        sample = offered_rows(rows, features, trees, chance, int(grid[0]["random_state"]), keys)
        # at most 2 * max_samples - 1 nodes per tree
        spread_trees = sample.repartition(tasks_for(df.sparkSession, len(trees)), "forest", "tree")
        nodes = spread_trees.groupBy("forest", "tree").applyInPandas(build, NODES).toPandas()
        kept = nodes[nodes["feature"] < 0].groupby(["forest", "tree"])["size"].sum().to_dict()
        if all(kept.get((i, t), 0) == sizes[i] for i, t in trees):
            break
        chance = min(1.0, 2.0 * chance)
    return [
        Forest.from_nodes(nodes[nodes["forest"] == i].drop(columns="forest"), features, grid[i], sizes[i])
        for i in range(len(grid))
    ]


def forest_scores(spark: SparkSession, forests, features) -> Column:
    """Anomaly of a row under each forest as struct fields f0, f1, ...; node arrays are broadcast once."""
    shared = spark.sparkContext.broadcast(list(forests))  # at most n_estimators * (2 * max_samples - 1) nodes each

    @F.pandas_udf(", ".join(f"f{i} double" for i in range(len(forests))))
    def score(*columns: pd.Series) -> pd.DataFrame:
        rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.DataFrame({f"f{i}": forest.anomaly(rows) for i, forest in enumerate(shared.value)})

    return score(*[F.col(f).cast("double") for f in features])


def fit_iforest(df: DataFrame, features, params: dict | None = None, keys=None) -> Forest:
    """Grow one forest and place its offset at the contamination quantile of the training scores."""
    forest = grow_forests(df, features, [params or {}], keys)[0]
    scored = df.select((-forest_scores(df.sparkSession, [forest], features)["f0"]).alias("score"))
    forest.offset = float(quantile_table(checkpointed(scored), ["score"], [forest.params["contamination"]])["score"][0])
    return forest


def score_iforest(df: DataFrame, forest: Forest) -> DataFrame:
    """Add iforest_score (higher is more normal), iforest_decision, iforest_anomaly and iforest_label (1 / -1)."""
    scored = df.withColumn("_f", forest_scores(df.sparkSession, [forest], forest.features))
    decision = -F.col("_f.f0") - forest.offset
    return scored.withColumns({
        "iforest_score": -F.col("_f.f0"), "iforest_decision": decision, "iforest_anomaly": -decision,
        "iforest_label": F.when(decision < 0, -1).otherwise(1),
    }).drop("_f")
