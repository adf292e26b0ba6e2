"""Many detector settings at once: searches, gate sweeps, ablations, sensitivity.

All forests of a sweep grow in one job, all boundaries are solved in one job, and every row is scored
by all of them in one pass. Gates, weights and thresholds are then only column expressions.
"""

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from palisade import schema as S
from palisade.detectors.cascade import GATE_RATE, GRID, W_STAGE1, empirical_rank, fused_score, gate_level, \
    gate_rate_from_percentile, raw_scores
from palisade.detectors.iforest import DEFAULTS as FOREST_DEFAULTS, grow_forests, merged
from palisade.detectors.ocsvm import DEFAULTS as BOUNDARY_DEFAULTS, fit_boundaries
from palisade.functions.labels import binary_label
from palisade.operators.cleaning import benign_rows
from palisade.operators.metrics import basic_metrics, pick_thresholds, ranking_metrics
from palisade.operators.ordering import quantile_table
from palisade.session import checkpointed

# --- fixed values: default grids and sweeps ---------------------------------------------
IFOREST_GRID = {"n_estimators": [100, 200], "max_samples": [256, 512]}
OCSVM_GRID = {"kernel": ["rbf"], "nu": [0.01, 0.02, 0.05], "gamma": ["scale", 0.01, 0.1]}
SEARCH_GATE_RATES = (0.20, 0.30, 0.50, 1.00)
SEARCH_WEIGHTS = (0.2, 0.4, 0.6)
GATE_RATES = (0.05, 0.10, 0.20, 0.30, 0.50, 1.00)
CONTAMINATION_SWEEP = (0.01, 0.02, 0.05, 0.10, 0.20)
NU_SWEEP = (0.01, 0.02, 0.05, 0.10, 0.20)
GAMMA_SWEEP = ("scale", "auto", 0.01, 0.1, 1.0)
# ----------------------------------------------------------------------------------------

STAGES = ("forest", "boundary")
METRICS = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "f2", "fpr", "tnr", "pr_auc", "gate_rate_actual",
           "threshold"]


def expand_grid(grid: dict | None) -> list:
    if not grid:
        return [{}]
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]


def _distinct(items, defaults):
    """Unique parameter sets and, for each item, the place of its set."""
    keys, unique, places = {}, [], []
    for item in items:
        full = merged(item, defaults)
        key = json.dumps(full, sort_keys=True)
        if key not in keys:
            keys[key] = len(unique)
            unique.append(full)
        places.append(keys[key])
    return unique, places


class Sweep:
    """Fitted stages of a list of cascade settings: name, iforest, ocsvm, gate_rate, w_stage1, features."""

    def __init__(self, train: DataFrame, configs: list, features=None, label: str | None = None,
                 max_rows: int | None = None, stages=STAGES, fitted=()):
        """A search of one stage fits and scores only that one. ``fitted`` boundaries of the same rows are not solved again."""
        self.features = list(features or S.FEATURES)
        self.configs = configs
        subset = lambda c: {"features": list(c["features"])} if c.get("features") else {}
        # contamination moves only the forest's offset, which gate and ranks do not see
        forest_items = [{**{k: v for k, v in (c.get("iforest") or {}).items() if k != "contamination"}, **subset(c)}
                        for c in configs]
        forests, self.forest_of = _distinct(forest_items, FOREST_DEFAULTS)
        bounds, self.bound_of = _distinct([{**(c.get("ocsvm") or {}), **subset(c)} for c in configs], BOUNDARY_DEFAULTS)
        # settings that share stages, gate and weight have the same scores, which are made once: the first one's place
        alike = [(f, b, c.get("gate_rate", GATE_RATE), c.get("w_stage1", W_STAGE1))
                 for f, b, c in zip(self.forest_of, self.bound_of, configs)]
        self.same_as = [alike.index(key) for key in alike]
        rows = benign_rows(train, label) if label else train
        rows = checkpointed(rows.select(*[F.col(f).cast("double").alias(f) for f in self.features]))
        self.forests = grow_forests(rows, self.features, forests) if "forest" in stages else []
        known = {json.dumps(b.params, sort_keys=True): b for b in fitted if b.features == self.features}
        keys = [json.dumps(b, sort_keys=True) for b in bounds]
        missing = [b for b, key in zip(bounds, keys) if key not in known] if "boundary" in stages else []
        solved = iter(fit_boundaries(rows, self.features, missing, max_rows) if missing else [])
        self.bounds = [known[key] if key in known else next(solved) for key in keys] if "boundary" in stages else []
        self.names_f = [f"f{i}" for i in range(len(self.forests))]
        self.names_b = [f"b{i}" for i in range(len(self.bounds))]
        self.train = checkpointed(raw_scores(rows, self.forests, self.bounds, self.features).select(
            *self.names_f, *self.names_b))
        levels = sorted({*GRID, *[gate_level(c.get("gate_rate", GATE_RATE)) for c in configs],
                         *[1.0 - f.params["contamination"] for f in self.forests],
                         *[1.0 - b.params["nu"] for b in self.bounds]})
        table = quantile_table(self.train, [*self.names_f, *self.names_b], levels)
        self.at = {name: dict(zip(levels, values)) for name, values in table.items()}
        self.knots = {name: [found[p] for p in GRID] for name, found in self.at.items()}

    def _ranked(self, scored: DataFrame) -> DataFrame:
        """Add n_f0, n_b0, ...: place of each raw score among its training quantiles."""
        names = [*self.names_f, *self.names_b]
        shared = scored.sparkSession.sparkContext.broadcast(self.knots)  # 501 numbers per column

        @F.pandas_udf(", ".join(f"n_{n} double" for n in names))
        def ranks(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({
                f"n_{n}": empirical_rank(c.to_numpy(dtype=float), shared.value[n], shared.value[n][0], shared.value[n][-1])
                for n, c in zip(names, columns)
            })

        ranked = scored.withColumn("_n", ranks(*names))
        return ranked.select(*scored.columns, "_n.*")

    def _with_fused(self, ranked: DataFrame) -> DataFrame:
        columns = {}
        for i in sorted(set(self.same_as)):
            c = self.configs[i]
            f, b = self.names_f[self.forest_of[i]], self.names_b[self.bound_of[i]]
            gated = F.col(f) >= F.lit(self.at[f][gate_level(c.get("gate_rate", GATE_RATE))])
            columns[f"gated{i}"] = gated
            columns[f"fused{i}"] = fused_score(gated, F.col(f"n_{f}"), F.col(f"n_{b}"), c.get("w_stage1", W_STAGE1))
        return ranked.withColumns(columns)

    def scores(self, df: DataFrame, keep=()) -> DataFrame:
        """Raw scores of all stages and, where both are fitted, ranks, gates and fused scores of the distinct settings; computed once."""
        raw = raw_scores(df, self.forests, self.bounds, self.features).select(*keep, *self.names_f, *self.names_b)
        return checkpointed(self._with_fused(self._ranked(raw)) if self.forests and self.bounds else raw)

    def thresholds(self, validation: DataFrame | None = None, label: str | None = None, criterion: str = "fpr_budget",
                   max_fpr: float = 0.02) -> list:
        """Per setting: from the validation labels, else a quantile of the training scores."""
        names = [f"fused{i}" for i in self.same_as]
        once = list(dict.fromkeys(names))
        judged = None
        if validation is not None and label:
            judged = self.scores(validation, [label])
            classes = {r[0] for r in judged.select(binary_label(F.col(label))).distinct().collect()}  # at most three
            if {0, 1} <= classes:
                found = pick_thresholds(judged, label, once, criterion, max_fpr)
                return [found[n] for n in names]
        base = checkpointed(self._with_fused(self._ranked(self.train)).select(*once)) if judged is None else judged
        spare = [max(0.5, 1.0 - c.get("gate_rate", GATE_RATE)) for c in self.configs]
        levels = sorted(set(spare))
        table = quantile_table(base, once, levels)
        return [table[n][levels.index(p)] for n, p in zip(names, spare)]

    def evaluate(self, test: DataFrame, label: str, thresholds: list) -> DataFrame:
        """One row per setting: confusion counts, rates, average precision, gate share, threshold."""
        scored = self.scores(test, [label])
        cases = list(zip(self.same_as, map(float, thresholds)))
        entries = F.array(*[
            F.struct(
                F.lit(k).alias("case"), F.col(f"fused{i}").alias("score"), F.col(f"gated{i}").alias("gated"),
                F.when(F.col(f"fused{i}") >= cut, S.ANOMALY).otherwise(S.NORMAL).alias("prediction"),
            ) for k, (i, cut) in enumerate(cases) if cases.index((i, cut)) == k
        ])
        long = scored.select(label, F.inline(entries))
        rates = basic_metrics(long, label, "prediction", ["case"])
        ranked = ranking_metrics(long, label, "score", by=["case"]).select("case", "roc_auc", "pr_auc")
        gates = long.groupBy("case").agg(F.avg(F.col("gated").cast("double")).alias("gate_rate_actual"))
        chosen = test.sparkSession.createDataFrame(
            [(c["name"], t, k, cases.index((i, t))) for k, (c, (i, t)) in enumerate(zip(self.configs, cases))],
            "config string, threshold double, position int, case int",
        )
        return chosen.join(rates, "case").join(ranked, "case").join(gates, "case").drop("case").orderBy("position")


def _value_of(scoring: str) -> str:
    return {"average_precision": "pr_auc", "auc": "roc_auc", "f1_score": "f1"}.get(scoring, scoring)


def _grid_values(scored: DataFrame, label: str | None, cuts: dict, scoring: str) -> dict:
    """Value per raw score column: a labelled metric, or the spread of the score without two classes."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("config"), F.col(n).alias("score"),
                 F.when(F.col(n) > cut, S.ANOMALY).otherwise(S.NORMAL).alias("prediction"))
        for n, cut in cuts.items()
    ])
    long = scored.select(*([label] if label else []), F.inline(entries))
    classes = set()
    if label:
        classes = {r[0] for r in scored.select(binary_label(F.col(label))).distinct().collect()}  # at most three
    if not {0, 1} <= classes:
        rows = long.groupBy("config").agg(F.stddev_pop("score").alias("value"))
    elif _value_of(scoring) in ("pr_auc", "roc_auc"):
        rows = ranking_metrics(long, label, "score", by=["config"]).select("config", F.col(_value_of(scoring)).alias("value"))
    else:
        rates = basic_metrics(long, label, "prediction", ["config"])
        name = _value_of(scoring)
        rows = rates.select("config", F.col(name if name in rates.columns else "f1").alias("value"))
    return {r["config"]: r["value"] for r in rows.collect()}  # one row per setting


def _best(points, values, names):
    results = [{**p, "score": float(values[n])} for p, n in zip(points, names)]
    best = max(range(len(results)), key=lambda i: results[i]["score"])
    return {"best_params": points[best], "best_score": results[best]["score"], "results": results}


def grid_search_iforest(train, evaluation, features=None, grid=None, label=None, scoring="pr_auc", sweep=None) -> dict:
    """All forests of the grid in one job; a contamination in the grid moves only the cut."""
    points = expand_grid(grid or IFOREST_GRID)
    sweep = sweep or Sweep(train, [{"name": str(i), "iforest": p} for i, p in enumerate(points)], features, label, stages=STAGES[:1])
    scored = sweep.scores(evaluation, [label] if label else [])
    names, cuts, columns = [], {}, {}
    for i, p in enumerate(points):
        column, name = sweep.names_f[sweep.forest_of[i]], f"p{i}"
        share = 1.0 - merged(p, FOREST_DEFAULTS)["contamination"]
        cuts[name] = sweep.at[column].get(share)
        if cuts[name] is None:
            cuts[name] = quantile_table(sweep.train, [column], [share])[column][0]
        columns[name] = F.col(column)
        names.append(name)
    return _best(points, _grid_values(scored.withColumns(columns), label, cuts, scoring), names)


def _boundary_sweep(train, points, features, label) -> Sweep:
    return Sweep(train, [{"name": str(i), "ocsvm": p} for i, p in enumerate(points)], features, label, stages=STAGES[1:])


def grid_search_ocsvm(train, evaluation, features=None, grid=None, label=None, scoring="pr_auc", sweep=None) -> dict:
    points = expand_grid(grid or OCSVM_GRID)
    sweep = sweep or _boundary_sweep(train, points, features, label)
    scored = sweep.scores(evaluation, [label] if label else [])
    names = [sweep.names_b[sweep.bound_of[i]] for i in range(len(points))]
    cuts = {n: sweep.at[n][1.0 - sweep.bounds[int(n[1:])].params["nu"]] for n in names}
    return _best(points, _grid_values(scored, label, cuts, scoring), names)


def _best_config(table: DataFrame, scoring: str) -> dict:
    """Best setting; the first one wins ties."""
    rows = [r.asDict() for r in table.collect()]  # one row per setting
    return max(rows, key=lambda r: (r[_value_of(scoring)], -r["position"]))


def hyperparameter_search(train, evaluation, features=None, label="label", scoring="f1_score", iforest_grid=None,
                          ocsvm_grid=None, gate_rates=SEARCH_GATE_RATES, weights=SEARCH_WEIGHTS) -> dict:
    """Best forest, best boundary, then gate and weight on their stored scores; the boundary is not solved again."""
    forest = grid_search_iforest(train, evaluation, features, iforest_grid, label, scoring)
    solved = _boundary_sweep(train, expand_grid(ocsvm_grid or OCSVM_GRID), features, label)
    boundary = grid_search_ocsvm(train, evaluation, features, ocsvm_grid, label, scoring, solved)
    configs = [
        {"name": f"gate={g:g} w={w:g}", "iforest": forest["best_params"], "ocsvm": boundary["best_params"],
         "gate_rate": g, "w_stage1": w}
        for g, w in itertools.product(gate_rates, weights)
    ]
    sweep = Sweep(train, configs, features, label, fitted=solved.bounds)
    table = checkpointed(sweep.evaluate(evaluation, label, sweep.thresholds()))
    best = _best_config(table, scoring)
    chosen = configs[best["position"]]
    return {
        "iforest_params": forest["best_params"], "ocsvm_params": boundary["best_params"], "gate_rate": chosen["gate_rate"],
        "w_stage1": chosen["w_stage1"], "best_score": best[_value_of(scoring)], "iforest_search": forest,
        "ocsvm_search": boundary, "table": table,
    }


def grid_search_cascade(train, evaluation, percentiles, features=None, label="label", iforest_grid=None, ocsvm_grid=None,
                        scoring="f1_score") -> dict:
    """Gate percentile x forest x boundary."""
    points = list(itertools.product(percentiles, expand_grid(iforest_grid), expand_grid(ocsvm_grid)))
    configs = [
        {"name": str(i), "iforest": f, "ocsvm": b, "gate_rate": gate_rate_from_percentile(p)}
        for i, (p, f, b) in enumerate(points)
    ]
    sweep = Sweep(train, configs, features, label)
    table = checkpointed(sweep.evaluate(evaluation, label, sweep.thresholds()))
    best = _best_config(table, scoring)
    percentile, forest, boundary = points[best["position"]]
    return {
        "best_params": {"threshold_percentile": percentile, "iforest_params": forest, "ocsvm_params": boundary,
                        "score": best[_value_of(scoring)]},
        "best_score": best[_value_of(scoring)], "table": table,
    }


def gate_rate_sweep(train, validation, test, features=None, label="label", gate_rates=GATE_RATES, criterion="f2",
                    max_fpr=0.02) -> DataFrame:
    """Detection against the share of rows that reach stage 2, and the share that is saved."""
    configs = [{"name": f"{g:g}", "gate_rate": g} for g in gate_rates]
    sweep = Sweep(train, configs, features, label)
    table = sweep.evaluate(test, label, sweep.thresholds(validation, label, criterion, max_fpr))
    return table.select(F.col("config").cast("double").alias("gate_rate"), *METRICS).withColumn(
        "stage2_rows_saved", 1.0 - F.col("gate_rate_actual")
    )


def feature_group_ablation(train, validation, test, features=None, groups=None, label="label", gate_rate=GATE_RATE) -> DataFrame:
    """Drop each feature group: metrics and the change in average precision."""
    features = list(features or S.FEATURES)
    configs = [{"name": "full_14_features", "gate_rate": gate_rate}]
    removed = {"full_14_features": ""}
    for name, columns in (groups or S.FEATURE_GROUPS).items():
        left = [f for f in features if f not in columns]
        if left:
            configs.append({"name": f"minus_{name}", "gate_rate": gate_rate, "features": left})
            removed[f"minus_{name}"] = ",".join(columns)
    sweep = Sweep(train, configs, features, label)
    table = checkpointed(sweep.evaluate(test, label, sweep.thresholds(validation, label, "f2")))
    base = table.where("config = 'full_14_features'").select("pr_auc").scalar()
    dropped = F.create_map(*[F.lit(v) for pair in removed.items() for v in pair])
    return table.select("config", *METRICS, (F.col("pr_auc") - base).alias("delta_pr_auc"),
                        dropped[F.col("config")].alias("removed"))


def hyperparameter_sensitivity(train, validation, test, features=None, label="label") -> DataFrame:
    """Sweeps of contamination, nu and gamma over the default settings."""
    points = [("contamination", v, {"iforest": {"contamination": v}}) for v in CONTAMINATION_SWEEP]
    points += [("nu", v, {"ocsvm": {"nu": v}}) for v in NU_SWEEP]
    points += [("gamma", v, {"ocsvm": {"gamma": v}}) for v in GAMMA_SWEEP]
    configs = [{"name": f"{p}={v}", **setting} for p, v, setting in points]
    sweep = Sweep(train, configs, features, label)
    table = sweep.evaluate(test, label, sweep.thresholds(validation, label, "f2"))
    parts = F.split("config", "=")
    return table.select(parts[0].alias("param"), parts[1].alias("value"), *METRICS)
