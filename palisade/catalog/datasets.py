"""Dataset preparation: duplicates, file statistics, splits, manifests, end-to-end jobs."""

from pyspark.sql import functions as F

from palisade import schema as S
from palisade.catalog import inputs as I
from palisade.catalog.logs import FLOW_ORDER, LOGIN_LABELS, _ALL, _attackers
from palisade.catalog.registry import query
from palisade.catalog.sqltext import r, rounded, with_inputs
from palisade.catalog.tables import FLOW_MAP
from palisade.operators import cleaning as C, flows as W, splits as P
from palisade.operators.ordering import numbered_within, with_row_number
from palisade.plans import prepare
from palisade.session import scratch_path
from palisade.sinks import datasets as O

_KEYS = ["source_file", "timestamp", *S.FEATURES]
_COARSE = """SELECT row_id, source_file, CASE WHEN label = 'attack' OR label = '1' THEN 'Anomaly' ELSE 'Normal' END AS label,
  date_trunc('year', timestamp) AS timestamp, {0} FROM vectors"""
_FEWER = ", ".join(
    f"floor({f} / 4) AS {f}" if f == "bytes_sent_mean" else (f"floor({f} / 100) AS {f}" if f == "http_req_rate" else f"0.0 AS {f}")
    for f in S.FEATURES)
COARSE = _COARSE.format(_FEWER)


def _coarse(spark, sf_dir):
    """Vectors rounded so far that many of them are equal."""
    frame = I.vectors(spark, sf_dir)
    columns = {f: F.lit(0.0) for f in S.FEATURES}
    columns["bytes_sent_mean"] = F.floor(F.col("bytes_sent_mean") / 4).cast("double")
    columns["http_req_rate"] = F.floor(F.col("http_req_rate") / 100).cast("double")
    label = F.when(F.col("label").isin("attack", "1"), S.ANOMALY).otherwise(S.NORMAL)
    return frame.select("row_id", "source_file", label.alias("label"), F.date_trunc("year", "timestamp").alias("timestamp"),
                        *[columns[f].alias(f) for f in S.FEATURES])


@query("A24_distinct_vectors", with_inputs(f"""
SELECT row_id, label, source_file FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY row_id) AS n FROM ({COARSE}))
WHERE n = 1""", "vectors"))
def distinct_vectors(spark, sf_dir):
    return C.distinct_vectors(_coarse(spark, sf_dir), ["row_id"]).select("row_id", "label", "source_file")


@query("A25_duplicate_audit", with_inputs(f"""
WITH rows_ AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(_KEYS)} ORDER BY row_id) AS n FROM ({COARSE}))
SELECT count(*) AS total_before, CAST(count(*) FILTER (n = 1) AS BIGINT) AS total_after, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicates_removed,
  CAST(count(*) FILTER (label = 'Anomaly') AS BIGINT) AS attacks_before, CAST(count(*) FILTER (label = 'Anomaly' AND n = 1) AS BIGINT) AS attacks_after,
  CAST(count(*) FILTER (label = 'Anomaly' AND n > 1) AS BIGINT) AS attacks_lost FROM rows_""", "vectors"))
def duplicate_audit(spark, sf_dir):
    before = _coarse(spark, sf_dir)
    return C.duplicate_audit(before, C.distinct_vectors(before, ["row_id"]))


_MEASURES = ["total_fwd_packets", "total_bwd_packets", "syn_flags", "ack_flags"]


@query("A24_distinct_measurements", with_inputs(f"""
SELECT source_file, {rounded(_MEASURES)}, min(l_orderkey) AS first_order FROM flows GROUP BY source_file, {', '.join(_MEASURES)}""", "flows"))
def distinct_measurements(spark, sf_dir):
    """Measurements that repeat inside a file count once, whatever their label."""
    flows = I.flows(spark, sf_dir).select("source_file", *_MEASURES, "l_orderkey", "l_partkey", "flow_label")
    kept = W.distinct_measurements(flows, ["l_orderkey", "l_partkey"])
    return kept.select("source_file", *_MEASURES, F.col("l_orderkey").alias("first_order"))


@query("A22_file_statistics", with_inputs("""
WITH raw AS (SELECT source_file, l_orderkey, total_fwd_packets, total_bwd_packets, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE syn_flags END AS syn_flags,
    l_orderkey % 11 = 0 AS inf_, flow_label FROM flows),
  kept AS (SELECT *, row_number() OVER (PARTITION BY source_file, total_fwd_packets, total_bwd_packets, syn_flags,
    CASE WHEN inf_ THEN NULL ELSE 1 END ORDER BY l_orderkey, flow_label) AS n FROM raw)
SELECT source_file, count(*) AS initial_rows, CAST(count(*) FILTER (n = 1) AS BIGINT) AS cleaned_rows, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicates_removed,
  CAST(count(*) FILTER (syn_flags IS NULL) AS BIGINT) AS nan_replaced, CAST(count(*) FILTER (inf_) AS BIGINT) AS inf_replaced,
  CAST(count(*) FILTER (n = 1 AND flow_label = 'BENIGN') AS BIGINT) AS normal_count, CAST(count(*) FILTER (n = 1 AND flow_label <> 'BENIGN') AS BIGINT) AS anomaly_count
FROM kept GROUP BY 1""", "flows"))
def file_statistics(spark, sf_dir):
    raw = I.flows(spark, sf_dir).select(
        "source_file", "l_orderkey", "total_fwd_packets", "total_bwd_packets",
        F.when(F.col("l_orderkey") % 10 != 0, F.col("syn_flags")).alias("syn_flags"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("inf"))).otherwise(1.0).alias("ack_flags"), "flow_label")
    cleaned = W.distinct_measurements(W.coerced(raw), ["l_orderkey", "flow_label"])
    return W.file_statistics(raw, cleaned)


@query("A23_unknown_audit", with_inputs(f"""
SELECT count(*) AS total_input_samples, CAST(count(*) FILTER (NOT u) AS BIGINT) AS labeled_samples_count, CAST(count(*) FILTER (u) AS BIGINT) AS unknown_samples_count,
  {r('round(CAST(count(*) FILTER (u) AS DOUBLE) / count(*) * 100, 4)', 'unknown_ratio_percent')}, CAST(count(*) FILTER (label IS NULL) AS BIGINT) AS missing_or_nan_count,
  CAST(count(*) FILTER (lower(trim(label)) = 'unknown') AS BIGINT) AS explicit_unknown_alias_count
FROM (SELECT label, (label IS NULL OR lower(trim(label)) = 'unknown') AS u FROM vectors)""", "vectors"))
def unknown_audit(spark, sf_dir):
    return C.unknown_audit(I.vectors(spark, sf_dir))


# --- blocks and row numbers ---------------------------------------------------------------------------

_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {_ALL}) - 1 AS n FROM flows)"


def _blocks(spark, sf_dir):
    numbered = numbered_within(I.flows(spark, sf_dir), "source_file", FLOW_ORDER)
    return W.concurrency(numbered)


@query("G27_concurrency", with_inputs(f"""
SELECT source_file, n // 120 AS block, count(*) AS rows, {r('least(greatest(sqrt(count(*)) * ln(1 + count(DISTINCT destination_port)), 1), 250)', 'global_active_ips')}
FROM {_NUMBERED} GROUP BY 1, 2""", "flows"))
def concurrency(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("source_file", F.floor(F.col("row_number") / 120).alias("block"), "global_active_ips").agg(
        F.count(F.lit(1)).alias("rows"))


@query("W04_block_transform", with_inputs(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('global_active_ips', 'global_active_ips')} FROM {_NUMBERED} f JOIN (
  SELECT source_file AS s, n // 120 AS b, least(greatest(sqrt(count(*)) * ln(1 + count(DISTINCT destination_port)), 1), 250) AS global_active_ips
  FROM {_NUMBERED} GROUP BY 1, 2) g ON g.s = f.source_file AND g.b = f.n // 120""", "flows"))
def block_transform(spark, sf_dir):
    return _blocks(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "global_active_ips")


@query("W06_row_numbers", with_inputs("""
SELECT row_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY timestamp, row_id) - 1 AS row_number FROM vectors""", "vectors"))
def row_numbers(spark, sf_dir):
    return numbered_within(I.vectors(spark, sf_dir), "source_file", ["timestamp", "row_id"], unique=True).select(
        "row_id", "source_file", "row_number")


@query("W16_sorted_rows", with_inputs("""
SELECT row_id, row_number() OVER (ORDER BY timestamp, row_id) - 1 AS place FROM vectors WHERE timestamp IS NOT NULL""", "vectors"))
def sorted_rows(spark, sf_dir):
    return with_row_number(I.vectors(spark, sf_dir), ["timestamp", "row_id"], "place", unique=True).select("row_id", "place")


@query("W13_spaced_rows", with_inputs("""
WITH rows_ AS (SELECT row_id, row_number() OVER (ORDER BY timestamp, row_id) - 1 AS n, count(*) OVER () AS total FROM vectors),
  picks AS (SELECT DISTINCT CASE WHEN i = 699 THEN t - 1 ELSE CAST(floor(i * ((t - 1) / 699.0)) AS BIGINT) END AS n
            FROM (SELECT unnest(range(700)) AS i, (SELECT count(*) FROM vectors) AS t))
SELECT row_id FROM rows_ JOIN picks USING (n)""", "vectors"))
def spaced_rows(spark, sf_dir):
    return P.spaced_rows(I.vectors(spark, sf_dir), ["timestamp", "row_id"], 700).select("row_id")


# --- splits -----------------------------------------------------------------------------------------------


def cuts_sql(source: str, group: str) -> str:
    return f"""
  ends_ AS (SELECT {group} AS g, timestamp AS t, sum(count(*)) OVER (PARTITION BY {group} ORDER BY timestamp) AS e,
            sum(count(*)) OVER (PARTITION BY {group}) AS total FROM {source} GROUP BY 1, 2),
  cut1 AS (SELECT g, min_by((e, t), (abs(e - floor(total * 0.6)), e)) AS c FROM ends_ GROUP BY 1),
  cut2 AS (SELECT ends_.g, min_by((e, t), (abs(e - floor(total * 0.8)), e)) AS c FROM ends_ JOIN cut1 USING (g)
           WHERE e > cut1.c[1] GROUP BY 1),
  split_ AS (SELECT v.*, CASE WHEN v.timestamp <= cut1.c[2] THEN 'train' WHEN cut2.c IS NULL OR v.timestamp <= cut2.c[2] THEN 'validation'
             ELSE 'test' END AS split FROM {source} v JOIN cut1 ON cut1.g = {group} LEFT JOIN cut2 ON cut2.g = {group})"""


@query("W07_temporal_split", with_inputs(f"WITH {cuts_sql('vectors', '1')} SELECT row_id, split FROM split_", "vectors"))
def temporal_split(spark, sf_dir):
    return P.temporal_split(I.vectors(spark, sf_dir)).select("row_id", "split")


@query("W10_split_per_source", with_inputs(f"WITH {cuts_sql('vectors', 'dataset_source')} SELECT row_id, dataset_source, split FROM split_", "vectors"))
def split_per_source(spark, sf_dir):
    return P.temporal_split(I.vectors(spark, sf_dir), by="dataset_source").select("row_id", "dataset_source", "split")


_SPREAD = "(SELECT * REPLACE (concat('e', CAST(row_id % 7000 AS VARCHAR)) AS entity_id) FROM vectors)"
_PURGED = f"""WITH spread AS {_SPREAD}, {cuts_sql('spread', '1')},
  val_ AS (SELECT * FROM split_ WHERE split = 'validation' AND entity_id NOT IN (SELECT entity_id FROM split_ WHERE split = 'train')),
  test_ AS (SELECT * FROM split_ WHERE split = 'test' AND entity_id NOT IN (SELECT entity_id FROM split_ WHERE split = 'train')
            AND entity_id NOT IN (SELECT entity_id FROM val_)),
  purged AS (SELECT * FROM split_ WHERE split = 'train' UNION ALL SELECT * FROM val_ UNION ALL SELECT * FROM test_)"""


def _spread(spark, sf_dir):
    return I.vectors(spark, sf_dir).withColumn("entity_id", F.concat(F.lit("e"), (F.col("row_id") % 7000).cast("string")))


@query("J08_entity_disjoint", with_inputs(f"{_PURGED} SELECT row_id, entity_id, split FROM purged", "vectors"))
def entity_disjoint(spark, sf_dir):
    return P.temporal_split(_spread(spark, sf_dir), entity_disjoint=True).select("row_id", "entity_id", "split")


def _overlap(a, b):
    return f"(SELECT count(*) FROM (SELECT entity_id FROM split_ WHERE split = '{a}' INTERSECT SELECT entity_id FROM split_ WHERE split = '{b}'))"


@query("J09_entity_overlap", with_inputs(f"""WITH spread AS {_SPREAD}, {cuts_sql('spread', '1')}
SELECT {_overlap('train', 'validation')} AS train_validation, {_overlap('train', 'test')} AS train_test, {_overlap('validation', 'test')} AS validation_test""", "vectors"))
def entity_overlap(spark, sf_dir):
    return P.entity_overlap(P.temporal_split(_spread(spark, sf_dir)))


@query("S19_checked_splits", with_inputs(f"""{_PURGED}
SELECT row_id, entity_id, split, label FROM purged WHERE split <> 'train' OR lower(trim(label)) = 'benign'""", "vectors"))
def checked_splits(spark, sf_dir):
    """The split contract holds for entity-disjoint parts with a benign training part."""
    split = P.temporal_split(_spread(spark, sf_dir), entity_disjoint=True)
    kept = split.where((F.col("split") != P.TRAIN) | (F.lower(F.trim("label")) == "benign"))
    counts = P.check_splits(kept, {})
    # a part that lost all its entities to earlier ones has no row here and a count of zero
    assert {k: n for k, n in counts.items() if n} == {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()}
    return kept.select("row_id", "entity_id", "split", "label")


@query("A21_split_summary", with_inputs(f"""WITH {cuts_sql('vectors', '1')}
SELECT split, count(*) AS rows, min(timestamp) AS time_min, max(timestamp) AS time_max, CAST(count(*) FILTER (label = 'Normal') AS BIGINT) AS normal_rows,
  CAST(count(*) FILTER (label = 'Anomaly') AS BIGINT) AS anomaly_rows, count(DISTINCT timestamp_source) AS timestamp_sources,
  count(DISTINCT label_source) AS label_sources FROM split_ GROUP BY 1""", "vectors"))
def split_summary(spark, sf_dir):
    return P.split_summary(P.temporal_split(I.vectors(spark, sf_dir)))


@query("A21_split_labels", with_inputs(f"""WITH {cuts_sql('vectors', '1')}
SELECT split, coalesce(label, 'missing') AS label, count(*) AS rows FROM split_ GROUP BY 1, 2""", "vectors"))
def split_labels(spark, sf_dir):
    return P.split_label_counts(P.temporal_split(I.vectors(spark, sf_dir))).fillna("missing", ["label"])


@query("K11_saved_splits", with_inputs(f"""WITH {cuts_sql('scored', '1')}
SELECT row_id, split, label, {r('score', 'score')}, timestamp, src_ip FROM split_
UNION ALL SELECT row_id, 'train_benign' AS split, label, {r('score', 'score')}, timestamp, src_ip FROM split_ WHERE split = 'train' AND label = 'Normal'""", "scored"))
def saved_splits(spark, sf_dir):
    folder = scratch_path(spark, "splits")
    manifest = O.save_splits(P.temporal_split(I.scored(spark, sf_dir)), folder)
    saved = O.read_json(spark, f"{folder}/split_manifest")["saved_counts"]
    assert saved == manifest["saved_counts"]
    return O.load_splits(spark, folder).select("row_id", "split", "label", "score", "timestamp", "src_ip")


@query("W08_ratio_split", with_inputs("""
SELECT row_id, CASE WHEN n < greatest(1, floor(total * 0.6)) THEN 'train' WHEN n < least(total - 1, greatest(1, floor(total * 0.6)) + greatest(1, floor(total * 0.2)))
  THEN 'validation' ELSE 'test' END AS split
FROM (SELECT row_id, row_number() OVER (ORDER BY timestamp, row_id) - 1 AS n, count(*) OVER () AS total FROM vectors)""", "vectors"))
def ratio_split(spark, sf_dir):
    return P.ratio_split(I.vectors(spark, sf_dir), ["timestamp", "row_id"]).select("row_id", "split")


@query("W09_day_split", with_inputs("""
SELECT row_id, CASE WHEN d = 0 THEN 'train' WHEN d = 1 THEN 'validation' ELSE 'test' END AS split FROM
  (SELECT row_id, row_id % 4 AS d FROM vectors)""", "vectors"))
def day_split(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(f"{d}-WorkingHours.csv") for d in ("Monday", "Tuesday", "Thursday", "Friday")]),
                        (F.col("row_id") % 4 + 1).cast("int"))
    return P.day_split(I.vectors(spark, sf_dir).withColumn("source_file", name)).select("row_id", "split")


@query("W09_day_split_halves", with_inputs("""
SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'train' WHEN n <= floor(total / 2) THEN 'validation' ELSE 'test' END AS split FROM
  (SELECT row_id, row_number() OVER (PARTITION BY row_id % 2 ORDER BY timestamp, row_id) AS n, count(*) OVER (PARTITION BY row_id % 2) AS total FROM vectors)""", "vectors"))
def day_split_halves(spark, sf_dir):
    """Tuesday alone is cut in two halves."""
    name = F.when(F.col("row_id") % 2 == 0, "monday.csv").otherwise("tuesday.csv")
    framed = I.vectors(spark, sf_dir).withColumn("source_file", name)
    return P.day_split(framed, order=["timestamp", "row_id"]).select("row_id", "split")


@query("W11_random_split", with_inputs("""
SELECT row_id, CASE WHEN n <= total - ceil(round(total * 0.3, 9)) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT row_id, row_number() OVER (ORDER BY md5(concat('42|', CAST(row_id AS VARCHAR))), row_id) AS n, count(*) OVER () AS total FROM vectors)""", "vectors"))
def random_split(spark, sf_dir):
    return P.random_split(I.vectors(spark, sf_dir), ["row_id"]).select("row_id", "split")


@query("W11_stratified_split", with_inputs("""
SELECT row_id, dataset_source, CASE WHEN n <= total - ceil(round(total * 0.25, 9)) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT row_id, dataset_source, row_number() OVER (PARTITION BY dataset_source ORDER BY md5(concat('7|', CAST(row_id AS VARCHAR))), row_id) AS n,
    count(*) OVER (PARTITION BY dataset_source) AS total FROM vectors)""", "vectors"))
def stratified_split(spark, sf_dir):
    made = P.random_split(I.vectors(spark, sf_dir), ["row_id"], 0.25, 7, "dataset_source")
    return made.select("row_id", "dataset_source", "split")


_ONE_CLASS = """SELECT row_id, label, CASE WHEN y = 0 AND n < floor(benign * 0.6) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT row_id, label, y, row_number() OVER (PARTITION BY y ORDER BY timestamp, row_id) - 1 AS n, (SELECT count(*) FROM vectors
    WHERE lower(trim(label)) = 'benign') AS benign FROM (SELECT *, CASE WHEN lower(trim(label)) = 'benign' THEN 0 WHEN label IN ('attack', '1') THEN 1
    ELSE -1 END AS y FROM vectors) WHERE y >= 0)"""


@query("W12_one_class_split", with_inputs(_ONE_CLASS, "vectors"))
def one_class_split(spark, sf_dir):
    return P.one_class_split(I.vectors(spark, sf_dir), ["timestamp", "row_id"]).select("row_id", "label", "split")


@query("U04_test_union", with_inputs("""SELECT row_id, label FROM vectors WHERE lower(trim(label)) = 'benign'
  UNION ALL SELECT row_id, label FROM vectors WHERE label IN ('attack', '1')""", "vectors"))
def test_union(spark, sf_dir):
    rows = I.vectors(spark, sf_dir)
    return P.union_test_set(C.benign_rows(rows), rows.where("label IN ('attack', '1')")).select("row_id", "label")


# --- end-to-end preparation ---------------------------------------------------------------------------------


def _prepared_flows(spark, sf_dir):
    flows = I.flows(spark, sf_dir).withColumn("entity_id", F.col("source_ip"))
    return prepare.flow_dataset(flows, FLOW_ORDER)


_MEASURE_COLUMNS = [c for c in W.FLOW_HEADERS.values() if c in {e.split(" AS ")[-1] for e in I.FLOWS}]
_FLOW_ROWS = f"""
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, {', '.join(_MEASURE_COLUMNS)} ORDER BY {_ALL}) AS d FROM flows) WHERE d = 1),
  placed AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {_ALL}) - 1 AS n FROM kept),
  blocks AS (SELECT source_file AS s, n // 120 AS b, least(greatest(sqrt(count(*)) * ln(1 + count(DISTINCT destination_port)), 1), 250) AS active FROM placed GROUP BY 1, 2),
  flow_rows AS (SELECT flow_time AS timestamp, source_ip AS entity_id, source_file, CASE WHEN flow_label = 'BENIGN' THEN 'Normal' ELSE 'Anomaly' END AS label,
    flow_label AS attack_category, active AS global_active_ips, {', '.join(f'{e} AS {n}' for n, e in FLOW_MAP.items())}
    FROM placed JOIN blocks ON s = source_file AND b = n // 120)"""


@query("M24_flow_dataset", with_inputs(f"""WITH {_FLOW_ROWS}
SELECT timestamp, entity_id, source_file, label, attack_category, {rounded(S.FEATURES, 8)} FROM flow_rows""", "flows"), digits=8)
def flow_dataset(spark, sf_dir):
    return _prepared_flows(spark, sf_dir).select("timestamp", "entity_id", "source_file", "label", "attack_category", *S.FEATURES)


_LOGIN_OUT = ["auth_fail_count", "auth_success_count", "auth_fail_ratio", "distinct_username", "fail_interarrival_mean",
              "fail_interarrival_std", "global_active_ips", "burst_rate"]


@query("M24_login_dataset", with_inputs(f"""WITH {LOGIN_LABELS}
SELECT source_file, window_start, timestamp, src_ip AS entity_id, {rounded(_LOGIN_OUT)}, attack_category FROM labelled""", "logins"))
def login_dataset(spark, sf_dir):
    made = prepare.login_dataset(I.logins(spark, sf_dir), _attackers(spark, sf_dir))
    return made.select("source_file", "window_start", "timestamp", "entity_id", *_LOGIN_OUT, "attack_category")


@query("M24_unified_dataset", with_inputs(f"""WITH {_FLOW_ROWS}, {LOGIN_LABELS},
  merged AS (SELECT DISTINCT 'cicids2017' AS dataset_source, source_file, timestamp, {', '.join(S.FEATURES)} FROM flow_rows
    UNION ALL SELECT DISTINCT 'loghub' AS dataset_source, source_file, timestamp, {', '.join(f if f in _LOGIN_OUT else f'0.0 AS {f}' for f in S.FEATURES)} FROM labelled)
SELECT dataset_source, source_file, timestamp, {rounded(S.FEATURES, 9)} FROM merged""", "flows", "logins"), digits=9)
def unified_dataset(spark, sf_dir):
    merged = prepare.unified_dataset(
        _prepared_flows(spark, sf_dir), prepare.login_dataset(I.logins(spark, sf_dir), _attackers(spark, sf_dir)))
    return merged.select("dataset_source", "source_file", "timestamp", *S.FEATURES)
