"""One-class boundary in a random Fourier feature space.

The radial kernel is approximated by cosine features (Rahimi and Recht 2007). In that space the
one-class problem is the point of least norm in the reduced convex hull of the rows: no row may weigh
more than 1 / (nu * n). It is solved as one problem over all rows by fully corrective Frank-Wolfe steps.
A step is one scan: tasks sum the mapped rows whose margin is lowest, which gives the next corner of the
hull; the driver keeps the corners (a few dozen vectors) and finds the least-norm point among them. A
bounded sample tells where to look first; the scan also bounds the duality gap, which stops the search and is kept with the result. The offset is the
nu quantile over all training rows. All parameter sets share the scans.
"""

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.detectors.iforest import merged
from palisade.operators.ordering import quantile_table
from palisade.session import checkpointed, tasks_for

DEFAULTS = {"kernel": "rbf", "nu": 0.02, "gamma": "scale"}
MAX_TRAIN_ROWS = None  # a number fits on about so many rows, chosen by a hash; None takes all of them
COMPONENTS = 512
STEPS = 150  # of the solver in memory
TOLERANCE = 1e-3  # duality gap over the squared norm at which a search ends
SAMPLE, MOST_PROBES = 4096, 24  # rows of the sample that steers the search, normals it hands to the first scan
MOST_SCANS = 100  # a search that needs more ends with a warning and the gap it has reached
BINS, FINE = 32, 1024  # margin bins whose rows are summed, bins of the whole range that are only counted
FIXED = float(1 << 24)  # sums of mapped rows are whole numbers of this fraction, so that their order does not matter
CHUNK = 1024
MAPPED = 64  # rows mapped at a time, so that their components stay in the cache
SINGLE = float(np.finfo(np.float32).eps)


def fourier_basis(columns: int, gamma: float, components: int, seed: int):
    rng = np.random.default_rng([seed, columns, components])
    directions = rng.standard_normal((columns, components)) * math.sqrt(2.0 * gamma)
    return directions, rng.uniform(0.0, 2.0 * math.pi, components)


# pi in two parts, of which the first one has few digits, so that its multiples are exact; terms of the series up to the last that counts
PI_HIGH = math.floor(math.pi * 2.0 ** 31) * 2.0 ** -31
PI_LOW = (math.pi - PI_HIGH) + 1.2246467991473532e-16
TERMS = [(-1.0) ** i / math.factorial(2 * i) for i in range(11)]
ROUND = 1.5 * 2.0 ** 52  # adding it leaves the nearest whole number in the last bits
MODERATE = 1e6


def cosine(x: np.ndarray) -> None:
    """Cosine in place, off by at most a few units of the last place of one; twice as fast as the library's in double precision."""
    if not x.size or x.dtype != np.float64 or not (x.max() < MODERATE and x.min() > -MODERATE):
        np.cos(x, out=x)
        return
    halves = x * (1.0 / math.pi)
    halves += ROUND
    odd = halves.view(np.int64) << 63  # an odd number of half turns changes the sign
    halves -= ROUND
    series = halves * PI_HIGH
    x -= series
    np.multiply(halves, PI_LOW, out=series)
    x -= series
    x *= x
    np.multiply(x, TERMS[-1], out=series)
    for term in TERMS[-2:0:-1]:
        series += term
        series *= x
    np.add(series, 1.0, out=x)
    x.view(np.int64)[...] ^= odd


def mapped_by(rows: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Cosine features of the rows, in the precision of the basis."""
    out = np.empty((len(rows), len(phases)), directions.dtype)
    for start in range(0, len(rows), MAPPED):
        part = out[start:start + MAPPED]
        np.matmul(rows[start:start + MAPPED], directions, out=part)
        part += phases
        cosine(part)
        part *= directions.dtype.type(math.sqrt(2.0 / len(phases)))
    return out


class Bounds:
    """Margins in single precision with a bound on their error, to tell which rows can lie in a window.

    A product of n terms is off by at most n roundings of the sum of its terms' sizes, a cosine by the error of its
    argument and a few roundings; the bound takes twice that. Rows that overflow or have no number are never ruled out.
    """

    def __init__(self, directions: np.ndarray, phases: np.ndarray, normals):
        self.basis = directions.astype(np.float32), phases.astype(np.float32)
        self.normals = np.column_stack(normals).astype(np.float32)
        self.norms = np.array([float(np.linalg.norm(n)) for n in normals])
        self.longest = float(np.linalg.norm(directions, axis=0).max())
        self.terms = directions.shape

    def lowest(self, rows: np.ndarray):
        """(rows, normals): no margin of the row is below this."""
        columns, components = self.terms
        with np.errstate(all="ignore"):
            margins = mapped_by(rows.astype(np.float32), *self.basis) @ self.normals
            argument = (columns + 2) * SINGLE * (np.linalg.norm(rows, axis=1) * self.longest + 2.0 * math.pi)
            off = 2.0 * math.sqrt(2.0) * (argument + 4.0 * SINGLE + (components + 2) * SINGLE)
            return margins - off[:, None] * self.norms


@dataclass
class Boundary:
    features: list
    params: dict
    columns: list
    gamma: float
    seed: int
    normal: np.ndarray
    offset: float = 0.0
    gap: float = math.inf
    scans: int = 0

    def mapped(self, rows: np.ndarray) -> np.ndarray:
        return mapped_by(rows[:, self.columns], *self.basis())

    def basis(self):
        return fourier_basis(len(self.columns), self.gamma, len(self.normal), self.seed)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Projection on the normal; lower is more anomalous."""
        return margins([self], rows)[0]

    def info(self) -> dict:
        return {"features": self.features, "params": self.params, "columns": self.columns, "gamma": self.gamma,
                "seed": self.seed, "normal": [float(v) for v in self.normal], "offset": self.offset, "gap": self.gap,
                "scans": self.scans}

    @staticmethod
    def from_info(info: dict) -> "Boundary":
        return Boundary(info["features"], info["params"], info["columns"], info["gamma"], info["seed"],
                        np.asarray(info["normal"]), info["offset"], info.get("gap", math.inf), info.get("scans", 0))


def least_norm_point(points: np.ndarray, nu: float, steps: int = STEPS) -> np.ndarray:
    """Least-norm mean of the rows when no row may weigh more than 1 / (nu * n)."""
    n = len(points)
    share = max(nu * n, 1.0)
    whole = int(min(math.floor(share), n))
    rest = min(share - whole, 1.0) if whole < n else 0.0
    point = points.mean(axis=0)
    for _ in range(steps):
        margins = points @ point
        order = np.argpartition(margins, min(whole, n - 1))
        low = points[order[:whole]].sum(axis=0)
        if rest > 0:
            low = low + rest * points[order[whole]]
        corner = low / (whole + rest)
        gap = point - corner
        progress = float(point @ gap)
        if progress <= 1e-7 * float(point @ point):
            break
        point = point - min(1.0, progress / float(gap @ gap)) * gap
    return point


def gamma_value(gamma, columns: int, variance: float) -> float:
    if gamma == "scale":
        return 1.0 / (columns * variance) if variance > 0 else 1.0
    if gamma == "auto":
        return 1.0 / columns
    return float(gamma)


def hull_weights(gram: np.ndarray) -> np.ndarray:
    """Weights of the least-norm point among convex combinations of a few corners, from their products (Wolfe's method)."""
    weights = np.zeros(len(gram))
    active = [int(np.argmin(np.diag(gram)))]
    weights[active] = 1.0
    for _ in range(20 * len(gram)):
        slopes = gram @ weights
        best = int(np.argmin(slopes))
        if best in active or slopes[best] >= (weights @ slopes) * (1.0 - 1e-12):
            break
        active.append(best)
        while True:
            a, size = np.array(active), len(active)
            system = np.ones((size + 1, size + 1))
            system[:size, :size], system[size, size] = gram[np.ix_(a, a)], 0.0
            wanted = np.linalg.lstsq(system, np.r_[np.zeros(size), 1.0], rcond=None)[0][:size]
            low = wanted <= 1e-12
            if not low.any():
                weights[:] = 0.0
                weights[a] = wanted
                break
            now = weights[a]
            reach = np.min(now[low] / np.maximum(now[low] - wanted[low], 1e-300))
            moved = np.where(now + reach * (wanted - now) < 1e-12, 0.0, now + reach * (wanted - now))
            weights[:] = 0.0
            weights[a] = moved
            if (moved > 0).all():
                break
            active = [k for k, w in zip(active, moved) if w > 0]
    return weights / weights.sum()


def lowest_share(margins: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """How much of each weight belongs to the share with the lowest margins."""
    order = np.argsort(margins, kind="stable")
    after = np.cumsum(weights[order])
    used = np.empty(len(margins))
    used[order] = np.clip(share - (after - weights[order]), 0.0, weights[order])
    return used


def least_norm(corners: list) -> np.ndarray:
    every = np.array(corners)
    return hull_weights(every @ every.T) @ every


class HullSearch:
    """Frank-Wolfe state of one parameter set on the driver: corners, their best combination, where to look next.

    A small sample of mapped rows (``points`` with ``weights``) is solved first. It decides where the scans look: the
    normals on its way are tried in the first scan together, and its margins tell which window holds the share of
    lowest rows. Corners and gap are always those of all rows; a window that turns out wrong is found anew from the
    counts of the scan.
    """

    def __init__(self, nu: float, rows: int, points: np.ndarray, weights: np.ndarray):
        self.rows, self.share = rows, min(max(nu * rows, 1.0), float(rows))
        self.sample, self.weights = points, weights / max(weights.sum(), 1)
        self.corners, self.point = [], np.zeros(points.shape[1])
        self.gap, self.done, self.found = math.inf, False, []
        # the first scan sums all rows, and tries the normals that the sample came by
        self.probes = [(self.point, np.full(BINS, np.inf))]
        self.probes += [(normal, self.window(normal)) for normal in self.sample_normals()]

    def sample_normals(self) -> list:
        if not len(self.sample):
            return []
        part, corners, normals = self.share / self.rows, [self.weights @ self.sample], []
        for _ in range(MOST_PROBES):
            normal = least_norm(corners)
            corner = lowest_share(self.sample @ normal, self.weights, part) @ self.sample / part
            normals.append(normal)
            if normal @ (normal - corner) <= 0.1 * TOLERANCE * (normal @ normal):
                break
            corners.append(corner)
        return normals

    @staticmethod
    def limit(normal) -> float:
        """No margin is larger: a mapped row has a norm of at most the square root of two."""
        return 1.4143 * float(np.linalg.norm(normal)) + 1e-12

    def window(self, normal) -> np.ndarray:
        """Edges around the margins at the share, going by the sample; without one the next scan only counts."""
        if not len(self.sample):
            return np.full(BINS, -np.inf)
        margins = self.sample @ normal
        order = np.argsort(margins, kind="stable")
        reached, part = np.cumsum(self.weights[order]), self.share / self.rows
        low, high = (margins[order[min(int(np.searchsorted(reached, f * part)), len(order) - 1)]] for f in (0.7, 1.3))
        pad = 0.5 * (high - low) + 1e-3 * self.limit(normal)
        return np.linspace(low - pad, high + pad, BINS)

    def cut(self, normal, edges, counts, sums):
        """(corner, bound below all products with the normal) of the rows with the lowest margins; None in a wrong window."""
        reached = np.cumsum(counts)
        at = int(np.searchsorted(reached, self.share * (1.0 - 1e-12)))
        if at == 0 or at == BINS:
            return None
        need, low = self.share - reached[at - 1], sums[:at].sum(axis=0)
        # no choice of rows in the bin that is cut can lie below its lower edge
        return (low + sums[at] * (need / counts[at])) / self.share, (float(low @ normal) + need * edges[at - 1]) / self.share

    def take(self, found: list) -> None:
        """Use what a scan has found for each probe: counts and sums of its window, and counts of the whole range."""
        if not self.corners:
            self.corners.append(found[0][1][0] / found[0][0][0])
            cuts = [self.cut(*probe, counts, sums) for probe, (counts, sums, _) in zip(self.probes[1:], found[1:])]
            self.corners += [c[0] for c in cuts if c]
        else:
            (normal, edges), (counts, sums, fine) = self.probes[0], found[0]
            cut = self.cut(normal, edges, counts, sums)
            if cut is None:
                self.probes = [(normal, self.counted_window(fine))]
                return
            norm = float(normal @ normal)
            self.gap = max(0.0, norm - cut[1]) / max(norm, 1e-300)
            self.done = self.gap <= TOLERANCE or norm <= 1e-18
            self.corners.append(cut[0])
        if not self.done:
            self.point = least_norm(self.corners)
            self.probes = [(self.point, self.window(self.point))]

    def needs_counts(self, found: list) -> bool:
        """Whether the one probe of this scan had a wrong window, so that the counts of the whole range give the next one."""
        return bool(self.corners) and self.cut(*self.probes[0], *found[0][:2]) is None

    def counted_window(self, fine) -> np.ndarray:
        bound, reached = self.limit(self.point), np.cumsum(fine)
        scale = 2.0 * bound / FINE
        low = int(np.searchsorted(reached, 0.7 * self.share, "right"))
        high = int(np.searchsorted(reached, min(float(self.rows), 1.3 * self.share), "left"))
        edges = np.linspace(low * scale - bound, (min(high, FINE - 1) + 1) * scale - bound + 1e-9 * bound, BINS)
        if low == 0:
            edges[0] = -2.0 * bound
        return edges


def scan_margins(rows: DataFrame, features, bounds, searches) -> None:
    """One pass over the rows for all searches that go on; each takes its sums.

    Only a search whose window was wrong needs the counts of the whole range: they take a pass of their own.
    """
    live = [i for i, s in enumerate(searches) if not s.done]
    for i, results in scanned(rows, features, bounds, searches, live).items():
        searches[i].found = results
    wrong = [i for i in live if searches[i].needs_counts(searches[i].found)]
    if wrong:
        for i, results in scanned(rows, features, bounds, searches, wrong, whole=True).items():
            searches[i].found = results
    for i in live:
        searches[i].take(searches[i].found)


def scanned(rows: DataFrame, features, bounds, searches, live, whole: bool = False) -> dict:
    """search -> per probe the counts and sums of its window and, with ``whole``, counts of the whole range.

    A window holds few rows. Single precision rules out those that surely lie above it; the others are mapped in full.
    """
    probes = [(i, normal, edges) for i in live for normal, edges in searches[i].probes]
    components = len(probes[0][1])
    groups = {}  # probes that share a map
    for at, (i, _, _) in enumerate(probes):
        groups.setdefault((tuple(bounds[i].columns), bounds[i].gamma), []).append(at)

    def scan(batches):
        fine = np.zeros((len(probes), FINE), np.int64)
        sums = np.zeros((len(probes), BINS, components), np.int64)
        counts = np.zeros((len(probes), BINS), np.int64)
        plans = []
        for (columns, _), members in groups.items():
            basis = bounds[probes[members[0]][0]].basis()
            normals, tops = [probes[at][1] for at in members], np.array([probes[at][2][-1] for at in members])
            # a window without an upper end takes all rows, and a closed one (no sample) none
            every = whole or np.isposinf(tops).any()
            plans.append((list(columns), basis, members, np.column_stack(normals), tops, None if every else Bounds(*basis, normals)))
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for start in range(0, len(table), CHUNK):
                for columns, basis, members, normals, tops, bound in plans:
                    chunk = table[start:start + CHUNK][:, columns]
                    if bound is not None:
                        chunk = chunk[~(bound.lowest(chunk) >= tops).all(axis=1)]
                    mapped = mapped_by(chunk, *basis)
                    products = mapped @ normals
                    # whole numbers in doubles: sums of a chunk are exact
                    fixed = np.rint(np.multiply(mapped, FIXED, out=mapped), out=mapped)
                    total = None
                    for at, margins in zip(members, products.T):
                        _, normal, edges = probes[at]
                        if whole:
                            limit = HullSearch.limit(normal)
                            spot = ((margins + limit) * (FINE / (2.0 * limit))).astype(np.int64).clip(0, FINE - 1)
                            fine[at] += np.bincount(spot, minlength=FINE)
                        low = np.flatnonzero(margins < edges[-1])
                        if len(low) == len(fixed) and np.isposinf(edges[0]):  # all rows fall into the first bin
                            if total is None:
                                total = fixed.sum(axis=0).astype(np.int64)
                            sums[at][0] += total
                            counts[at][0] += len(low)
                        elif len(low):
                            bins = np.searchsorted(edges, margins[low], "right")
                            order = np.argsort(bins, kind="stable")
                            seen, first = np.unique(bins[order], return_index=True)
                            sums[at][seen] += np.add.reduceat(fixed[low[order]], first, axis=0).astype(np.int64)
                            counts[at] += np.bincount(bins, minlength=BINS)
        for at in range(len(probes)):
            used = np.flatnonzero(counts[at])
            yield pa.record_batch([
                pa.array([at] * (len(used) + 1), pa.int32()), pa.array([-1, *used], pa.int32()), pa.array([0, *counts[at][used]], pa.int64()),
                pa.array([fine[at].tobytes() if whole else b"", *(row.tobytes() for row in sums[at][used])], pa.binary())], names=SUMMED)

    parts = rows.select(*features).mapInArrow(scan, SUMS)
    tasks = tasks_for(rows.sparkSession, len(probes) * (BINS + 1))
    added = parts.repartition(tasks, "probe", "bin").mapInArrow(added_up, SUMS).toArrow()  # probes x (bins x components + fine bins) numbers
    places = [(np.zeros(BINS), np.zeros((BINS, components)), np.zeros(FINE)) for _ in probes]
    for at, spot, n, sums in zip(*(c.to_pylist() for c in added.columns)):
        values, (counts, binned, fine) = np.frombuffer(sums, np.int64), places[at]
        if spot >= 0:
            counts[spot], binned[spot] = n, values / FIXED
        elif len(values):
            fine[:] = values
    found = {}
    for (i, _, _), place in zip(probes, places):
        found.setdefault(i, []).append(place)
    return found


SUMMED, SUMS = ["probe", "bin", "n", "sums"], "probe int, bin int, n long, sums binary"  # sums: 64-bit numbers, one after the other


def added_up(batches):
    """One row per probe and bin: counts and sums of all tasks."""
    totals = {}
    for batch in batches:
        for probe, spot, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
            values = np.frombuffer(sums, np.int64)
            if (probe, spot) in totals:
                totals[probe, spot][0] += n
                totals[probe, spot][1] += values
            else:
                totals[probe, spot] = [n, values.copy()]
    if totals:
        yield pa.record_batch([
            pa.array([k[0] for k in totals], pa.int32()), pa.array([k[1] for k in totals], pa.int32()),
            pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([v.tobytes() for _, v in totals.values()], pa.binary())], names=SUMMED)


def fit_boundaries(df: DataFrame, features, grid, max_rows: int | None = MAX_TRAIN_ROWS, seed: int = 42,
                   components: int = COMPONENTS) -> list:
    """One boundary per entry of ``grid`` (parameters, optionally a ``features`` subset); offsets stay 0.

    The result is the solution of one problem over all rows, up to the duality gap that it carries; neither partitions
    nor the order of rows change it. ``max_rows`` fits on about so many rows, chosen by a hash of their features.
    """
    features = list(features)
    grid = [merged(g, DEFAULTS) for g in grid]
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    if max_rows is not None:
        total = df.count()
        if total > max_rows:
            share = int(max_rows / total * (1 << 52))
            rows = rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), *features), F.lit(1 << 52)) < share)
    rows = checkpointed(rows)  # read in every scan
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f).alias(f"s_{f}") for f in features], *[F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features],
    ).first()
    total = sums["n"]
    if total == 0:
        raise ValueError("cannot fit a one-class boundary on an empty training part")
    subsets = [list(g.get("features", features)) for g in grid]

    def variance(names):
        cells = total * len(names)
        mean = sum(sums[f"s_{f}"] for f in names) / cells
        return sum(sums[f"q_{f}"] for f in names) / cells - mean * mean

    bounds = []
    for g, names in zip(grid, subsets):
        gamma = float(f"{gamma_value(g['gamma'], len(names), variance(names)):.12g}")  # sums differ in their last digits
        bounds.append(Boundary(features, g, [features.index(f) for f in names], gamma, seed, np.zeros(components)))
    # distinct rows by a hash, with their numbers: at most about SAMPLE of them
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(1 << 52)) < int(min(1.0, SAMPLE / total) * (1 << 52)))
    sample = chosen.groupBy(*features).agg(F.count(F.lit(1)).alias("_n")).orderBy(*features).toArrow().to_pandas()
    table, weights = sample[features].to_numpy(dtype=float), sample["_n"].to_numpy(dtype=float)
    searches = [HullSearch(float(b.params["nu"]), total, b.mapped(table), weights) for b in bounds]
    for scan in range(1, MOST_SCANS + 1):
        scan_margins(rows, features, bounds, searches)
        for bound, search in zip(bounds, searches):
            if search.done and not bound.scans:
                bound.scans = scan
        if all(s.done for s in searches):
            break
    for bound, search in zip(bounds, searches):
        bound.normal, bound.gap = search.point, search.gap
        if not search.done:
            warnings.warn(f"the boundary of {bound.params} stopped at a relative gap of {search.gap:.2e}")
    return bounds


def boundary_margins(spark: SparkSession, bounds, features) -> Column:
    """Margin of a row under each boundary as struct fields b0, b1, ..."""
    shared = spark.sparkContext.broadcast(list(bounds))  # a few hundred numbers each

    @F.pandas_udf(", ".join(f"b{i} double" for i in range(len(bounds))))
    def margin(*columns: pd.Series) -> pd.DataFrame:
        rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.DataFrame({f"b{i}": values for i, values in enumerate(margins(shared.value, rows))})

    return margin(*[F.col(f).cast("double") for f in features])


def margins(bounds, rows: np.ndarray) -> list:
    """Margins of the rows under each boundary; boundaries with the same map share it."""
    out, alike = [np.empty(len(rows)) for _ in bounds], {}
    for i, b in enumerate(bounds):
        alike.setdefault((tuple(b.columns), b.gamma, b.seed, len(b.normal)), []).append(i)
    for members in alike.values():
        first = bounds[members[0]]
        basis, narrow = first.basis(), rows[:, first.columns]
        for start in range(0, len(rows), MAPPED):
            mapped = mapped_by(narrow[start:start + MAPPED], *basis)
            for i in members:
                out[i][start:start + MAPPED] = mapped @ bounds[i].normal
    return out


def fit_ocsvm(df: DataFrame, features, params: dict | None = None, max_rows: int | None = MAX_TRAIN_ROWS) -> Boundary:
    """Fit one boundary and place its offset so that a share of nu of the training rows lies outside."""
    bound = fit_boundaries(df, features, [params or {}], max_rows)[0]
    scored = df.select(boundary_margins(df.sparkSession, [bound], features)["b0"].alias("margin"))
    bound.offset = float(quantile_table(checkpointed(scored), ["margin"], [bound.params["nu"]])["margin"][0])
    return bound


def score_ocsvm(df: DataFrame, bound: Boundary) -> DataFrame:
    """Add ocsvm_score (decision value, higher is more normal), ocsvm_anomaly and ocsvm_label (1 / -1)."""
    scored = df.withColumn("_b", boundary_margins(df.sparkSession, [bound], bound.features))
    decision = F.col("_b.b0") - bound.offset
    return scored.withColumns({
        "ocsvm_score": decision, "ocsvm_anomaly": -decision, "ocsvm_label": F.when(decision < 0, -1).otherwise(1),
    }).drop("_b")
