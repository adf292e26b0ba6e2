"""Findings of larger tables, on rows of the tests' own."""

import datetime
import math
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import load
from palisade.detectors import ocsvm as O
from palisade.functions import patterns as T


def test_checked_splits_with_an_empty_part(spark, tmp_path):
    """Every entity occurs early, so validation and test lose all their rows."""
    first = datetime.datetime(2020, 1, 1)
    rows = [(7000 * k + 6, k, "O", 100.0 + k, first + datetime.timedelta(days=k), "3-MEDIUM") for k in range(40)]
    orders = spark.createDataFrame(
        rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    done = load().QUERIES["S19_checked_splits"](spark, str(tmp_path)).collect()
    assert done and {r["split"] for r in done} == {"train"} and {r["entity_id"] for r in done} == {"e6"}


def test_single_precision_rules_out_no_row_of_a_window(spark):
    """Margins in single precision lie below the exact ones for rows of any size, and close to them for common ones."""
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(500, 4)) * s for s in (1.0, 30.0, 1e4, 1e30)] + [np.full((1, 4), 1e300), np.full((1, 4), np.nan)])
    basis = O.fourier_basis(4, 0.25, 64, 1)
    normals = [rng.normal(size=64) * s for s in (0.01, 1.0)]
    exact = O.mapped_by(rows, *basis) @ np.column_stack(normals)
    lowest = O.Bounds(*basis, normals).lowest(rows)
    assert not (lowest > exact).any() and not (lowest[-2:] >= -1e9).any()
    assert (exact[:500] - lowest[:500] < 1e-3 * np.linalg.norm(normals, axis=1)).all()


def test_a_scan_gives_the_counts_and_sums_of_its_windows(spark):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(3000, 2))
    frame = spark.createDataFrame(pd.DataFrame(table, columns=["a", "b"])).repartition(3)
    bound = O.Boundary(["a", "b"], {"nu": 0.05}, [0, 1], 0.5, 7, np.zeros(32))
    mapped = bound.mapped(table)
    search = O.HullSearch(0.05, 3000, mapped[:300], np.ones(300))
    O.scan_margins(frame, ["a", "b"], [bound], [search])
    assert np.allclose(search.corners[0], mapped.mean(axis=0), atol=1e-6)
    normal, edges = search.probes[0]
    margins = mapped @ normal
    counts, sums, _ = O.scanned(frame, ["a", "b"], [bound], [search], [0])[0][0]
    assert counts.sum() == (margins < edges[-1]).sum()
    assert np.allclose(sums.sum(axis=0), mapped[margins < edges[-1]].sum(axis=0), atol=1e-5)
    # a window that misses the share is found anew from counts of the whole range
    search.probes = [(normal, edges - 10.0)]
    O.scan_margins(frame, ["a", "b"], [bound], [search])
    assert search.found[0][2].sum() == 3000 and search.probes[0][1][-1] > edges[0] - 1.0


def test_a_pattern_runs_once_a_line(spark):
    pattern = r"(?<a>[0-9]+)-(?<b>[a-z]*)(;)?(?<c>.)?"
    texts = ["1-x;y", "zz 22-;", "22-abc 33-def;q", "none", "", None, "7-\u0001", "8-q;\u0002 9-r", "\u0001 5-m", "4-$1\\"]
    done = T.parse_pattern(spark.createDataFrame([(t,) for t in texts], "_found string"), "_found", pattern)
    plain, names = T.numbered_groups(pattern)
    alone = done.select("_found", "a", "b", "c", "matched", *[
        F.nullif(F.regexp_extract("_found", plain, g), F.lit("")).alias(f"own_{n}") for n, g in names.items()],
        F.col("_found").rlike(plain).alias("own"))
    rows = alone.collect()
    assert len(rows) == len(texts) and done.columns == ["_found", "a", "b", "c", "matched"]
    assert [(r.a, r.b, r.c, r.matched) for r in rows] == [(r.own_a, r.own_b, r.own_c, r.own) for r in rows]
    clean = T.parse_format(spark.createDataFrame([("x",)], "line string"), "line", "istio_envoy_proxy")
    plan = clean.drop("matched")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_addresses_of_a_network_share_a_call(spark):
    """One call of the state function serves many addresses, each with a score and a time of its own."""
    import pandas as pd
    from palisade.streaming import decay as K

    class State:
        exists = hasTimedOut = False
        get = timer = None

        def getCurrentWatermarkMs(self):
            return self.mark

        def setTimeoutTimestamp(self, at):
            self.timer = at

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

    update, state, hour = K.idle_decay(3600), State(), 3_600_000
    rows = [("1.2.3.4", 40.0, 0), ("1.2.3.5", 90.0, 1), ("1.2.3.4", 50.0, 3), ("1.2.3.6", 10.0, 3)]
    batch = pd.DataFrame([(a, s, pd.Timestamp(h * hour, unit="ms")) for a, s, h in rows], columns=["src_ip", "score", "timestamp"])

    def called(mark, batches=()):
        state.mark = mark
        out = pd.concat(update(("1.2.3",), iter(batches), state))
        return sorted((r.src_ip, r.score, r.timestamp.value // (hour * 10 ** 6)) for r in out.itertuples() if r.decayed)

    assert called(0, [batch[:2], batch[2:]]) == [("1.2.3.4", 15.0, 2), ("1.2.3.4", 20.0, 1)]
    assert state.timer == 2 * hour and sorted(zip(*state.get)) == [("1.2.3.4", 50.0, 3 * hour), ("1.2.3.5", 90.0, hour)]
    state.hasTimedOut = True
    assert called(4 * hour) == [("1.2.3.4", 25.0, 4), ("1.2.3.5", 15.0, 4), ("1.2.3.5", 22.5, 3), ("1.2.3.5", 45.0, 2)]
    assert state.get[0] == ["1.2.3.4"] and state.timer == 5 * hour
    nets = spark.createDataFrame([("10.2.33.4",), ("fe80::1",), (None,), ("a.b.c.d",)], "a string").select(K.network(F.col("a"))).collect()
    assert [r[0] for r in nets] == ["10.2.33", "fe80::1", None, "a.b.c.d"]


def test_fading_risk_without_a_time(spark, tmp_path):
    """Rows without time, address or score pass on; the others fade as they do without them."""
    from palisade.streaming import decay as K, drain as D

    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("1.2.3.4", 40.0, at(0)), ("1.2.3.4", 99.0, None), (None, 20.0, at(1)), ("1.2.3.5", None, at(2)), ("c", 10.0, at(5))]
    schema = "src_ip string, score double, timestamp timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    made = D.drained(K.fading_risk(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3600)).collect()
    found = {(r.src_ip, r.score, r.timestamp, r.decayed) for r in made}
    faded = {("1.2.3.4", 20.0, at(1), True), ("1.2.3.4", 15.0, at(2), True), (None, 15.0, at(2), True)}
    assert found == {(*r, False) for r in rows} | faded and len(made) == len(found)


def shuffle_bytes(spark, wait=10):
    """Bytes of shuffled rows on disk; removals are asynchronous, so the smallest number within some seconds."""
    import os
    import time

    env, found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get(), []
    for _ in range(wait):
        names = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        found.append(sum(os.path.getsize(n) for n in names if n.endswith(".data") and "shuffle_" in n and os.path.exists(n)))
        time.sleep(0.2)
    return min(found)


def test_packed_rows_leave_no_shuffle_behind(spark):
    """Times stay as they are, shuffle files go with the job and the folder with its block."""
    from palisade.session import child_names, packed, packed_for, shared_folder

    at = [datetime.datetime(1500, 2, 3, 4, 5, 6, 789), None, datetime.datetime(2024, 1, 1)]
    rows = [(k % 7, at[k % 3], None if k % 5 == 0 else f"t{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "k int, `at.x` timestamp, text string")
    before = shuffle_bytes(spark)
    stored = packed(frame.repartition(3, "k"))
    assert stored.schema == frame.schema and stored.inputFiles()  # files, not a checkpoint
    seen = lambda df: sorted(map(tuple, df.selectExpr("k", "unix_micros(`at.x`)", "text").collect()), key=str)
    assert seen(stored) == seen(frame)
    with packed_for(frame.repartition(3, "text")) as kept:
        name = kept.inputFiles()[0].split("/")[-2]
        assert name in child_names(spark, shared_folder(spark)) and seen(kept) == seen(frame)
    assert name not in child_names(spark, shared_folder(spark))
    assert shuffle_bytes(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def flow_rows(spark, n=6000):
    """Flows of two files, each measurement twice, with columns that no feature reads."""
    columns = ["flow_bytes_s", "total_fwd_packets", "destination_port"]
    rows = [(f"{'Monday' if k % 3 else 'Tuesday'}.csv", k, float(k // 2), float(k % 5), float(k % 9), "BENIGN" if k % 4 else "DoS",
             datetime.datetime(2024, 1, 1, 0, k % 60), "x" * 50, f"10.0.0.{k % 11}") for k in range(n)]
    fields = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(
        rows, f"source_file string, row_number long, {fields}, flow_label string, flow_time timestamp_ntz, unread string, entity_id string")


def test_prepared_flows_keep_one_packed_table(spark, monkeypatch):
    """The two wide shuffles of the flows are gone when the sorted rows are stored, and so is the table between them."""
    from palisade import session
    from palisade.plans import prepare

    made_paths, new_path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *names: made_paths.append(new_path(*names)) or made_paths[-1])
    flows, held = flow_rows(spark), shuffle_bytes(spark)
    made = prepare.flow_dataset(flows.withColumnRenamed("row_number", "place"), ["place"])
    between, kept = made_paths
    assert not session.path_exists(spark, between) and shuffle_bytes(spark) < held + 20_000  # a row a slice
    stored = spark.read.parquet(kept)
    assert "unread" not in stored.columns and "flow_label" in stored.columns
    pdf = flows.toPandas().sort_values("row_number").drop_duplicates(
        ["source_file", "flow_bytes_s", "total_fwd_packets", "destination_port"])
    pdf["n"] = pdf.groupby("source_file").cumcount() // 120
    blocks = pdf.groupby(["source_file", "n"])["destination_port"].agg(["count", "nunique"])
    active = (np.sqrt(blocks["count"]) * np.log1p(blocks["nunique"])).clip(1, 250)
    want = sorted((r.source_file, r.entity_id, r.flow_time, round(active[r.source_file, r.n], 9)) for r in pdf.itertuples())
    got = sorted((r.source_file, r.entity_id, pd.Timestamp(r.timestamp), round(r.global_active_ips, 9)) for r in made.collect())
    assert got == want


def test_sources_of_the_unified_table_are_stored_before_they_are_compared(spark):
    from palisade.plans import prepare

    flows = flow_rows(spark).withColumnRenamed("row_number", "place")
    made = prepare.unified_dataset(prepare.flow_dataset(flows, ["place"]), prepare.flow_dataset(flows, ["place"]))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 2
    assert made.count() == made.select("source_file", "timestamp", *S.FEATURES).distinct().count()


def labelled_points(spark, n=400):
    rng = np.random.default_rng(8)
    table = pd.DataFrame(rng.normal(size=(n, 2)), columns=["a", "b"])
    table["label"] = np.where(np.arange(n) % 10 == 0, S.ANOMALY, S.NORMAL)
    table.loc[table["label"] == S.ANOMALY, ["a", "b"]] *= 4.0
    return spark.createDataFrame(table).repartition(3).localCheckpoint()


def test_boundaries_of_one_map_share_its_cosines(monkeypatch):
    rng, calls = np.random.default_rng(6), []
    rows = rng.normal(size=(150, 3))
    made = [O.Boundary(["x", "y", "z"], {}, columns, gamma, 7, rng.normal(size=32)) for columns, gamma in (
        ([0, 1, 2], 0.5), ([0, 1, 2], 0.5), ([0, 2], 0.5), ([0, 1, 2], 0.1))]
    exact = [b.mapped(rows) @ b.normal for b in made]
    mapped = O.mapped_by
    monkeypatch.setattr(O, "mapped_by", lambda part, *basis: calls.append(len(part)) or mapped(part, *basis))
    assert all(np.allclose(m, e, atol=1e-12) for m, e in zip(O.margins(made, rows), exact))
    assert sum(calls) == 3 * len(rows)  # three maps of four boundaries


def test_sums_of_tasks_are_added_as_whole_arrays():
    import pyarrow as pa

    def part(rows):
        probe, spot, n, sums = zip(*rows)
        return pa.record_batch([
            pa.array(probe, pa.int32()), pa.array(spot, pa.int32()), pa.array(n, pa.int64()),
            pa.array([np.array(v, np.int64).tobytes() for v in sums], pa.binary())], names=O.SUMMED)

    big = 1 << 60
    (done,) = O.added_up([part([(0, -1, 0, []), (0, 3, 2, [1, big]), (1, 3, 5, [7, 7])]), part([(0, 3, 1, [4, big]), (0, -1, 0, [])])])
    rows = {(p, s): (n, np.frombuffer(v, np.int64).tolist()) for p, s, n, v in zip(*(c.to_pylist() for c in done.columns))}
    assert rows == {(0, -1): (0, []), (0, 3): (3, [5, 2 * big]), (1, 3): (5, [7, 7])}
    assert list(O.added_up([])) == []


def test_a_search_solves_each_boundary_once(spark, monkeypatch):
    """Searches of one stage leave the other alone, and the last sweep takes the boundary that won."""
    from palisade.detectors import sweeps as W

    rows, solved, grown = labelled_points(spark), [], []
    fit, grow = W.fit_boundaries, W.grow_forests
    monkeypatch.setattr(W, "fit_boundaries", lambda df, features, grid, *more: solved.extend(grid) or fit(df, features, grid, *more))
    monkeypatch.setattr(W, "grow_forests", lambda df, features, grid: grown.extend(grid) or grow(df, features, grid))
    done = W.hyperparameter_search(rows.where("label = 'Normal'"), rows, ["a", "b"], iforest_grid={"n_estimators": [5, 9]},
                                   ocsvm_grid={"nu": [0.05, 0.1]}, gate_rates=(0.3, 1.0), weights=(0.4,))
    assert [b["nu"] for b in solved] == [0.05, 0.1] and [f["n_estimators"] for f in grown][:2] == [5, 9] and len(grown) == 3
    assert [r["config"] for r in done["table"].collect()] == ["gate=0.3 w=0.4", "gate=1 w=0.4"]
    # a sweep that solves the winner anew has the same rows
    monkeypatch.undo()
    settings = [{"name": f"g{g}", "iforest": done["iforest_params"], "ocsvm": done["ocsvm_params"], "gate_rate": g, "w_stage1": 0.4}
                for g in (0.3, 1.0)]
    again = W.Sweep(rows.where("label = 'Normal'"), settings, ["a", "b"], "label")
    columns = ["f1", "pr_auc", "gate_rate_actual", "threshold"]
    want = again.evaluate(rows, "label", again.thresholds()).select(*columns).collect()
    assert np.allclose(np.array(want, float), np.array(done["table"].select(*columns).collect(), float), atol=1e-9)


def test_equal_settings_are_scored_once(spark):
    """Settings that differ in the forest's offset only share their scores; every one keeps its row and its threshold."""
    from palisade.detectors import sweeps as W

    rows = labelled_points(spark)
    settings = [{"name": f"c{c}", "iforest": {"n_estimators": 8, "contamination": c}} for c in (0.01, 0.05)]
    settings += [{"name": "w", "iforest": {"n_estimators": 8}, "w_stage1": 0.9}, {"name": "c0.2", "iforest": {"n_estimators": 8, "contamination": 0.2}}]
    sweep = W.Sweep(rows, settings, ["a", "b"], "label")
    assert [c for c in sweep.scores(rows).columns if c.startswith("fused")] == ["fused0", "fused2"]
    cuts = sweep.thresholds(rows, "label", "f2")
    assert cuts[0] == cuts[1] == cuts[3] and len(cuts) == 4
    done = sweep.evaluate(rows, "label", [0.5, 0.5, 0.5, 2.0]).collect()
    assert [(r["config"], r["position"], r["threshold"]) for r in done] == [("c0.01", 0, 0.5), ("c0.05", 1, 0.5), ("w", 2, 0.5), ("c0.2", 3, 2.0)]
    assert done[0]["pr_auc"] == done[1]["pr_auc"] == done[3]["pr_auc"] and done[0]["tp"] == done[1]["tp"] > done[3]["tp"] == 0
    assert done[0].asDict().keys() >= set(W.METRICS) and "case" not in done[0].asDict()


def test_rows_of_a_tree_are_counted_by_their_codes(spark):
    """Only codes are grouped over all rows; rows follow for codes that meet a tree, with all their copies."""
    from palisade.detectors import iforest as T

    rows = spark.range(3000).selectExpr("cast(id % 600 as double) x", "cast(id % 600 as double) * 2 y")
    offered = T.offered_rows(rows, ["x", "y"], [(0, t) for t in range(6)], 0.05, 7)
    plan = offered._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    table = offered.toPandas()
    assert (table["y"] == 2 * table["x"]).all() and abs(len(table) - 3000 * 6 * 0.05) < 5 * (3000 * 6 * 0.05) ** 0.5
    assert table.groupby(["forest", "tree", "x"]).size().max() <= 5


def test_cosine_is_that_of_the_library():
    """In place and to the last place, also at half turns, for large, infinite and missing arguments and in single precision."""
    rng = np.random.default_rng(2)
    wide = np.concatenate([rng.normal(size=3000) * s for s in (1e-9, 1.0, 1e3, 1e5)] + [np.arange(-500, 500) * math.pi / 2])
    for x in (wide.reshape(-1, 8), wide * 1e4, wide[:0], np.array([1.0, np.nan]), wide.astype(np.float32)):
        made = x.copy()
        O.cosine(made)
        assert made.dtype == x.dtype and np.allclose(made, np.cos(x), rtol=0, atol=4e-16 if x.dtype == np.float64 else 0, equal_nan=True)
    calls, library = [], np.cos
    rows, basis = rng.normal(size=(70, 4)), O.fourier_basis(4, 0.25, 16, 1)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(O.np, "cos", lambda *a, **k: calls.append(1) or library(*a, **k))
        O.mapped_by(rows, *basis)
    assert not calls


def test_windows_of_all_rows_and_of_few_have_exact_sums(spark):
    """Sums of whole numbers, however the rows are dealt to tasks and whether a window takes all of them or some."""
    table = np.random.default_rng(9).normal(size=(2500, 2))
    bound = O.Boundary(["a", "b"], {"nu": 0.1}, [0, 1], 0.5, 7, np.zeros(16))
    mapped = bound.mapped(table)
    whole = np.rint(mapped * O.FIXED).astype(np.int64)
    found = []
    for parts in (1, 4):
        frame = spark.createDataFrame(pd.DataFrame(table, columns=["a", "b"])).repartition(parts)
        search = O.HullSearch(0.1, 2500, mapped[:200], np.ones(200))
        found.append(O.scanned(frame, ["a", "b"], [bound], [search], [0])[0])
    assert len(found[0]) == len(search.probes) > 2
    assert all((a == b).all() for one, two in zip(*found) for a, b in zip(one, two))
    assert (np.rint(found[0][0][1][0] * O.FIXED).astype(np.int64) == whole.sum(axis=0)).all() and found[0][0][0][0] == 2500
    for (normal, edges), (counts, sums, _) in list(zip(search.probes, found[0]))[1:]:
        inside = mapped @ normal < edges[-1]
        assert counts.sum() == inside.sum() and (np.rint(sums.sum(axis=0) * O.FIXED).astype(np.int64) == whole[inside].sum(axis=0)).all()


def test_a_scored_batch_leaves_its_tables_only(spark, tmp_path):
    """The scores that both result tables are made from, and the shuffles of the tables, are gone when they are written."""
    from palisade.catalog import models as M
    from palisade.detectors import cascade as C
    from palisade.session import child_names, shared_folder
    from palisade.streaming import features as W

    model = C.Cascade(M.forest(), M.boundary(), 0.2, M.WEIGHT, M.MARGIN, "fixed-v1", M.GATE, 0.0, M.THRESHOLD, list(M.KNOTS1), list(M.KNOTS2))
    rng, start = np.random.default_rng(3), datetime.datetime(2024, 1, 1)
    table = pd.DataFrame(rng.normal(30.0, 20.0, size=(3000, 4)), columns=M.ITEMS)
    table["src_ip"], table["window_start"] = [f"a{k}" for k in range(3000)], [start + datetime.timedelta(seconds=k) for k in range(3000)]
    frame = spark.createDataFrame(table).repartition(3).localCheckpoint()
    held, folders = shuffle_bytes(spark), set(child_names(spark, shared_folder(spark)))
    write = W.score_vectors(str(tmp_path / "t"), model, M.scaler())
    write(frame, 0)
    write(frame, 0)  # a batch that runs again finds its rows stored
    assert set(child_names(spark, shared_folder(spark))) == folders and shuffle_bytes(spark) <= held
    tables = W.result_tables(spark, str(tmp_path / "t"))
    results, risks = tables["anomaly_result"].read(), tables["risk_score"].read()
    want = {(r.src_ip, round(r.anomaly_score, 12), r.predicted_label, r.window_start) for r in model.predict_detailed(M.scaler().transform(frame)).collect()}
    assert {(r.src_ip, round(r.anomaly_score, 12), r.predicted_label, r.window_start) for r in results.collect()} == want
    assert risks.count() == sum(label != "Uncertain" for _, _, label, _ in want)


def test_state_of_windowed_streams_lies_on_disk(spark, tmp_path):
    """Both writers of windowed features keep no state on the heap; the settings of the session stay as they were."""
    from palisade.streaming import drain as D, features as W

    start = datetime.datetime(2024, 1, 1)
    rows = [(str(k), start + datetime.timedelta(seconds=40 * k), f"10.0.0.{k % 7}", "u", "auth", 3, "a1",
             f"Failed password for u{k % 3} from 10.0.0.{k % 7} port 22 ssh2", None) for k in range(200)]
    schema = "event_id string, timestamp timestamp, source_ip string, username string, event_type string, severity int, agent_id string, raw_log string, parsed_json string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    counters = lambda: W.stream_counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 600, context=True)
    names = [*D.ON_DISK]
    before = {n: spark.conf.get(n, None) for n in names}
    seen = []

    def kept_batches(folder):
        seen.append(folder)
        return W.write_features(folder, 600)

    made = D.drained_batches(counters(), kept_batches)
    W.start(counters(), W.write_features(f"{tmp_path}/rows", 600), f"{tmp_path}/state").awaitTermination()
    again = spark.read.parquet(f"{tmp_path}/rows")
    columns = ["window_start", "src_ip", "max_severity", "event_id", *S.FEATURES]
    assert made.count() > 50 and sorted(map(str, made.select(*columns).collect())) == sorted(map(str, again.select(*columns).collect()))
    for state in (f"{tmp_path}/state", seen[0].rsplit("/", 1)[0].removeprefix("file:") + "/state"):
        files = [f.suffix for f in pathlib.Path(state).rglob("*")]
        assert ".changelog" in files and ".delta" not in files
    assert {n: spark.conf.get(n, None) for n in names} == before
    with D.state_on_disk(spark):
        assert spark.conf.get(D.STATE + "providerClass").endswith("RocksDBStateStoreProvider")
    try:
        spark.conf.set(D.STATE + "providerClass", "org.example.Other")
        with D.state_on_disk(spark):
            assert spark.conf.get(D.STATE + "providerClass") == "org.example.Other"
    finally:
        spark.conf.unset(D.STATE + "providerClass")
