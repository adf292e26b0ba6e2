"""Detector metrics, thresholds, intervals, significance, rules."""

from pyspark.sql import functions as F

from palisade.catalog import inputs as I
from palisade.catalog.registry import query
from palisade.catalog.sqltext import r, with_inputs
from palisade.operators import metrics as M, resampling as B, rules as R, significance as G
from palisade.sinks import results as U

EPS = "1e-12"
CELLS = """
  used AS (SELECT *, CASE label WHEN 'Anomaly' THEN 1 WHEN 'Normal' THEN 0 ELSE -1 END AS y, CASE prediction WHEN 'Anomaly' THEN 1 WHEN 'Normal' THEN 0 ELSE -1 END AS g FROM scored),
  cells AS (SELECT CAST(count(*) FILTER (y = 1 AND g = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (y = 0 AND g = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (y = 1 AND g = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y = 0 AND g = 0) AS BIGINT) AS tn,
    count(*) FILTER (y >= 0 AND prediction <> 'Uncertain') / CAST(count(*) FILTER (y >= 0) AS DOUBLE) AS coverage,
    CAST(count(*) FILTER (prediction = 'Uncertain') AS BIGINT) AS uncertain_count, CAST(count(*) FILTER (y < 0) AS BIGINT) AS unknown_ground_truth_count FROM used)"""
RATES = f"""
  rates0 AS (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall FROM cells),
  rates AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
    5 * precision * recall / (4 * precision + recall + {EPS}) AS f2, fp / (fp + tn + {EPS}) AS fpr, tn / (fp + tn + {EPS}) AS tnr FROM rates0)"""
NAMES = ["accuracy", "precision", "recall", "f1", "f2", "fpr", "tnr", "coverage"]


@query("A01_basic_metrics", with_inputs(f"""WITH {CELLS}, {RATES}
SELECT tp, fp, fn, tn, {', '.join(r(n, n) for n in NAMES)}, uncertain_count, unknown_ground_truth_count FROM rates""", "scored"))
def basic_metrics(spark, sf_dir):
    return M.basic_metrics(I.scored(spark, sf_dir), "label", "prediction")


def ranking_sql(label="label", score="score", source="scored"):
    """One row: prevalence, roc_auc, pr_auc, and the same for the turned score."""
    return f"""
  points AS (SELECT {score} AS s, CAST(count(*) FILTER ({label} = 'Anomaly') AS DOUBLE) AS pos, CAST(count(*) FILTER ({label} = 'Normal') AS DOUBLE) AS neg
    FROM {source} WHERE {label} IN ('Anomaly', 'Normal') GROUP BY 1),
  curve AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER (ORDER BY s) AS tpr_,
    sum(neg) OVER (ORDER BY s) AS fpr_, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM points),
  ranks AS (SELECT max(p) / (max(p) + max(n)) AS prevalence, sum(neg * (tp - pos / 2)) / (max(p) * max(n)) AS roc_auc,
    sum(pos * tp / (tp + fp)) / max(p) AS pr_auc, sum(pos * tpr_ / (tpr_ + fpr_)) / max(p) AS pr_auc_turned,
    sum(pos * s) / sum(pos) < sum(neg * s) / sum(neg) AS lower_ FROM curve)"""


@query("A04_roc_auc", with_inputs(f"WITH {ranking_sql()} SELECT {r('prevalence', 'prevalence')}, {r('roc_auc', 'roc_auc')} FROM ranks", "scored"))
def roc_auc(spark, sf_dir):
    return M.ranking_metrics(I.scored(spark, sf_dir), "label", "score").select("prevalence", "roc_auc")


@query("A05_average_precision", with_inputs(f"""WITH {ranking_sql()}
SELECT {r('pr_auc', 'pr_auc')}, {r(f'pr_auc / (prevalence + {EPS})', 'pr_auc_over_prevalence')} FROM ranks""", "scored"))
def average_precision(spark, sf_dir):
    return M.ranking_metrics(I.scored(spark, sf_dir), "label", "score").select("pr_auc", "pr_auc_over_prevalence")


@query("F29_aligned_polarity", with_inputs(f"""WITH flipped AS (SELECT label, CASE WHEN label = 'Anomaly' THEN score - 1 ELSE score END AS score, row_id FROM scored),
  lower_ AS (SELECT avg(score) FILTER (label = 'Anomaly') < avg(score) FILTER (label = 'Normal') AS l FROM flipped)
SELECT row_id, {r('CASE WHEN l THEN -score ELSE score END', 'aligned_score')} FROM flipped, lower_""", "scored"))
def aligned_polarity(spark, sf_dir):
    flipped = I.scored(spark, sf_dir).withColumn(
        "score", F.when(F.col("label") == "Anomaly", F.col("score") - 1).otherwise(F.col("score")))
    return M.aligned_score(flipped, "label", "score").select("row_id", "aligned_score")


def cid_sql(tpr, fpr, b):
    def h(*parts):
        return "-(" + " + ".join(f"CASE WHEN ({p}) > 0 THEN ({p}) * log2({p}) ELSE 0 END" for p in parts) + ")"

    j = [f"{1 - b} * (1 - {fpr})", f"{1 - b} * {fpr}", f"{b} * (1 - {tpr})", f"{b} * {tpr}"]
    hx, hy = h(f"{j[0]} + {j[1]}", f"{j[2]} + {j[3]}"), h(f"{j[0]} + {j[2]}", f"{j[1]} + {j[3]}")
    return f"(({hx}) + ({hy}) - ({h(*j)})) / (({hx}) + {EPS})"


def bdr_sql(b):
    return f"recall * {b} / (recall * {b} + fpr * (1 - {b}) + {EPS})"


@query("A02_classification_metrics", with_inputs(f"""WITH {CELLS}, {RATES}, {ranking_sql()}
SELECT {r('accuracy', 'accuracy')}, {r('f1', 'f1_score')}, {r('f2', 'f2_score')}, {r('fpr', 'false_positive_rate')}, {r('recall', 'true_positive_rate')},
  {r('fn / CAST(greatest(fn + tp, 1) AS DOUBLE)', 'false_negative_rate')}, {r('CASE WHEN lower_ THEN 1 - roc_auc ELSE roc_auc END', 'roc_auc')},
  {r('CASE WHEN lower_ THEN pr_auc_turned ELSE pr_auc END', 'pr_auc')}, {r(bdr_sql(0.1), 'bdr_at_0_1')}, {r(cid_sql('recall', 'fpr', 0.01), 'cid_at_0_01')} FROM rates, ranks""", "scored"))
def classification_metrics(spark, sf_dir):
    made = M.classification_metrics(I.scored(spark, sf_dir), "label", "prediction", "score")
    return made.select("accuracy", "f1_score", "f2_score", "false_positive_rate", "true_positive_rate", "false_negative_rate",
                       "roc_auc", "pr_auc", "bdr_at_0_1", "cid_at_0_01")


@query("A03_confusion_table", with_inputs("""SELECT CASE WHEN prediction = 'Anomaly' THEN 'Predicted Anomaly' ELSE 'Predicted Normal' END AS predicted,
  CAST(count(*) FILTER (label = 'Normal') AS BIGINT) AS actual_normal, CAST(count(*) FILTER (label = 'Anomaly') AS BIGINT) AS actual_anomaly
FROM scored WHERE label IS NOT NULL AND prediction <> 'Uncertain' GROUP BY 1""", "scored"))
def confusion_table(spark, sf_dir):
    return M.confusion_table(I.scored(spark, sf_dir), "label", "prediction")


@query("A06_top_k", with_inputs(f"""WITH ranked AS (SELECT CASE WHEN label = 'Anomaly' THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY score DESC, row_id) AS n,
  count(*) FILTER (label = 'Anomaly') OVER () AS pos FROM scored WHERE label IS NOT NULL)
SELECT k, {r('count(*) FILTER (y = 1) / CAST(max(pos) AS DOUBLE)', 'recall')}, {r('count(*) FILTER (y = 1) / CAST(count(*) AS DOUBLE)', 'precision')}
FROM ranked JOIN (SELECT unnest([10, 25, 50, 100, 250]) AS k) ON n <= k GROUP BY k""", "scored"))
def top_k(spark, sf_dir):
    return M.top_k_metrics(I.scored(spark, sf_dir), "label", "score", ["row_id"])


@query("W15_top_k_rows", with_inputs(f"SELECT row_id, {r('score', 'score')} FROM scored ORDER BY scored.score DESC, row_id LIMIT 250", "scored"))
def top_k_rows(spark, sf_dir):
    return I.scored(spark, sf_dir).orderBy(F.col("score").desc(), "row_id").limit(250).select("row_id", "score")


@query("A07_base_rate_table", with_inputs(f"""WITH {CELLS}, {RATES}
SELECT base_rate, {r('recall * base_rate / (recall * base_rate + fpr * (1 - base_rate) + 1e-12)', 'bdr')} FROM rates,
  (SELECT CAST(unnest([0.1, 0.01, 0.001, 0.0001]) AS DOUBLE) AS base_rate)""", "scored"))
def base_rate_table(spark, sf_dir):
    rates = M.basic_metrics(I.scored(spark, sf_dir), "label", "prediction")
    return M.base_rate_table(rates).select("base_rate", "bdr")


@query("A08_alarms_per_hour", with_inputs(f"""WITH {CELLS}, {RATES}
SELECT {r('480000 * 0.99 * fpr + 480000 * 0.01 * recall', 'alarms', 4)} FROM rates""", "scored"), digits=4)
def alarms_per_hour(spark, sf_dir):
    rates = M.basic_metrics(I.scored(spark, sf_dir), "label", "prediction")
    return rates.select(M.alarms_per_hour(F.col("fpr"), F.col("recall"), 0.01).alias("alarms"))


@query("A09_detection_capability", with_inputs(f"""WITH {CELLS}, {RATES}
SELECT attack_category, {r(cid_sql('hit', '0.05', 0.01), 'cid')} FROM (SELECT attack_category, count(*) FILTER (prediction = 'Anomaly') / CAST(count(*) AS DOUBLE) AS hit
  FROM scored GROUP BY 1)""", "scored"))
def detection_capability(spark, sf_dir):
    rates = M.category_detection(I.scored(spark, sf_dir), "attack_category", "prediction")
    return rates.select("attack_category", M.detection_capability(F.col("detection_rate"), F.lit(0.05), 0.01).alias("cid"))


_STEPS = ", ".join(repr(p) for p in M.CANDIDATE_STEPS)
_SCAN = f"""
  known AS (SELECT score, CASE label WHEN 'Anomaly' THEN 1 WHEN 'Normal' THEN 0 ELSE -1 END AS y FROM scored),
  edges AS (SELECT DISTINCT unnest(quantile_cont(score, [{_STEPS}])) AS t FROM known UNION SELECT nextafter(max(score), CAST('Infinity' AS DOUBLE)) FROM known),
  cells AS (SELECT t, count(*) FILTER (y = 1 AND score >= t) AS tp, count(*) FILTER (y = 0 AND score >= t) AS fp, count(*) FILTER (y = 1 AND score < t) AS fn,
    count(*) FILTER (y = 0 AND score < t) AS tn FROM edges, known WHERE y >= 0 GROUP BY 1), {RATES}"""


@query("A10_pick_threshold", with_inputs(f"""WITH {_SCAN}
SELECT {r("(SELECT t FROM rates ORDER BY f2 DESC, t LIMIT 1)", 'best_f2')}, {r("(SELECT t FROM rates ORDER BY f1 DESC, t LIMIT 1)", 'best_f1')},
  {r("(SELECT t FROM rates WHERE fpr <= 0.1 ORDER BY recall DESC, t LIMIT 1)", 'best_budget')}""", "scored"))
def pick_threshold(spark, sf_dir):
    scored = I.scored(spark, sf_dir)
    found = (M.pick_threshold(scored, "label", "score", "f2"), M.pick_threshold(scored, "label", "score", "f1"),
             M.pick_threshold(scored, "label", "score", "fpr_budget", 0.1))
    return spark.createDataFrame([found], "best_f2 double, best_f1 double, best_budget double")


@query("A10_threshold_scan", with_inputs(f"""WITH {_SCAN}
SELECT {r('t', 'threshold')}, tp, fp, fn, tn, {r('recall', 'recall')}, {r('fpr', 'fpr')} FROM rates""", "scored"))
def threshold_scan(spark, sf_dir):
    scored = I.scored(spark, sf_dir)
    edges = M.threshold_candidates(scored, ["score"])["score"]
    return M.threshold_scan(scored, "label", "score", edges).select("threshold", "tp", "fp", "fn", "tn", "recall", "fpr")


@query("A11_average_precision_interval")
def average_precision_interval(spark, sf_dir):
    """Point, mean and 95 % interval from 1000 weighted replicates."""
    return B.average_precision_interval(I.scored(spark, sf_dir), "label", "score")


@query("A12_classification_intervals")
def classification_intervals(spark, sf_dir):
    return B.classification_intervals(I.scored(spark, sf_dir), "label", "prediction")


_REPORT = """
  used AS (SELECT *, CASE label WHEN 'Anomaly' THEN 1 WHEN 'Normal' THEN 0 ELSE -1 END AS y, CASE WHEN score >= 0.8 THEN 1 ELSE 0 END AS g FROM scored),
  cells AS (SELECT count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn,
    count(*) FILTER (y = 0 AND g = 0) AS tn, count(*) FILTER (y >= 0) AS n_samples, count(*) FILTER (g = 1) / CAST(count(*) AS DOUBLE) AS alert_rate FROM used)"""


@query("A13_full_report", with_inputs(f"""WITH {_REPORT}, {RATES}, {ranking_sql()}
SELECT tp, fp, n_samples, {r('alert_rate', 'alert_rate')}, {r('f1', 'f1')}, {r('pr_auc', 'pr_auc')}, {r(bdr_sql(0.01), 'bdr_at_0_01')},
  {r(cid_sql('recall', 'fpr', 0.01), 'cid_at_0_01', 9)} FROM rates, ranks""", "scored"), digits=9)
def full_report(spark, sf_dir):
    made = M.full_report(I.scored(spark, sf_dir), "label", "score", 0.8, ties=["row_id"])
    short = [F.round(c, 6).alias(c) for c in ("alert_rate", "f1", "pr_auc", "bdr_at_0_01")]
    return made.select("tp", "fp", "n_samples", *short, "cid_at_0_01")


def _two_reports(spark, sf_dir):
    scored = I.scored(spark, sf_dir)
    return {
        "cascade": M.full_report(scored, "label", "score", 0.8, ties=["row_id"]),
        "rule_only": M.full_report(scored, "label", "other_score", 0.7, ties=["row_id"]),
    }


def _cells(score, cut, who):
    return (f"(SELECT count(*) FILTER ({score} >= {cut} AND label IS NOT NULL) AS alerts_{who}, count(*) FILTER ({score} >= {cut} AND label = 'Anomaly') "
            f"/ CAST(count(*) FILTER (label = 'Anomaly') AS DOUBLE) AS recall_{who} FROM scored)")


@query("A14_alert_reduction", with_inputs(f"""SELECT alerts_rule_only, alerts_cascade, {r('100 * (1 - alerts_cascade / CAST(greatest(alerts_rule_only, 1) AS DOUBLE))', 'reduction_pct')},
  {r('recall_rule_only', 'recall_rule_only')}, {r('recall_cascade', 'recall_cascade')}, {r('recall_cascade - recall_rule_only', 'recall_delta')}
FROM {_cells('other_score', 0.7, 'rule_only')}, {_cells('score', 0.8, 'cascade')}""", "scored"))
def alert_reduction(spark, sf_dir):
    reports = _two_reports(spark, sf_dir)
    return M.alert_reduction(reports["rule_only"], reports["cascade"])


@query("A15_baseline_table", with_inputs(f"""SELECT detector, {r('CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END', 'precision')},
  {r('CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END', 'recall')} FROM (
  SELECT 'cascade' AS detector, count(*) FILTER (score >= 0.8 AND label = 'Anomaly') AS tp, count(*) FILTER (score >= 0.8 AND label = 'Normal') AS fp,
    count(*) FILTER (score < 0.8 AND label = 'Anomaly') AS fn FROM scored UNION ALL
  SELECT 'rule_only', count(*) FILTER (other_score >= 0.7 AND label = 'Anomaly'), count(*) FILTER (other_score >= 0.7 AND label = 'Normal'),
    count(*) FILTER (other_score < 0.7 AND label = 'Anomaly') FROM scored)""", "scored"))
def baseline_table(spark, sf_dir):
    return M.comparison_tables(_two_reports(spark, sf_dir))["baselines"].select("detector", "precision", "recall")


def _top_sql(name, score):
    hits = lambda k: f"CAST(count(*) FILTER (k <= {k} AND label = 'Anomaly') AS DOUBLE)"
    columns = ", ".join(f"{r(f'{hits(k)} / max(p)', f'recall_at_{k}')}, {r(f'{hits(k)} / {k}', f'precision_at_{k}')}" for k in M.TOP_K)
    return f"""SELECT '{name}' AS detector, {columns} FROM (SELECT label, row_number() OVER (ORDER BY {score} DESC, row_id) AS k,
      count(*) FILTER (label = 'Anomaly') OVER () AS p FROM scored WHERE label IS NOT NULL)"""


@query("K17_report_tables", with_inputs(f"{_top_sql('cascade', 'score')} UNION ALL {_top_sql('rule_only', 'other_score')}", "scored"))
def report_tables(spark, sf_dir):
    """Tables are written as CSV and read back."""
    from palisade.session import scratch_path
    from palisade.sinks.datasets import write_report_tables

    folder = scratch_path(spark, "reports")
    write_report_tables(M.comparison_tables(_two_reports(spark, sf_dir)), folder)
    read = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/table_topk")
    return read.select("detector", *[F.col(f"{m}_at_{k}").cast("double") for k in M.TOP_K for m in ("recall", "precision")])


def tail_sql(z, density):
    """1 - 2 * integral of a symmetric density from 0 to |z|, by Simpson's rule; beyond 40 nothing is left."""
    steps = 4000
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range({steps + 1}), lambda i: {weight} * {density(f'(i * least(abs({z}), 40) / {steps}.0)')})) * least(abs({z}), 40) / {steps}.0 / 3"
    return f"greatest(1 - 2 * ({area}), 0)"


def normal_density(x):
    return f"exp(-{x} * {x} / 2) / sqrt(2 * pi())"


def t_density(freedom):
    return lambda x: f"exp(lgamma(({freedom} + 1) / 2.0) - lgamma({freedom} / 2.0) - ({freedom} + 1) / 2.0 * ln(1 + {x} * {x} / {freedom})) / sqrt({freedom} * pi())"


@query("A16_paired_t_test", with_inputs(f"""SELECT pair, n, {r('t', 't_statistic')}, {r(tail_sql('t', t_density('f')), 'p_value')}, {tail_sql('t', t_density('f'))} < 0.05 AS significant
  FROM (SELECT 'score vs other_score' AS pair, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS f
  FROM (SELECT score - other_score AS d FROM scored))""", "scored"))
def paired_t_test(spark, sf_dir):
    return G.paired_t_tests(I.scored(spark, sf_dir), [("score", "other_score")]).select("pair", "n", "t_statistic", "p_value", "significant")


def _signed(a, b):
    ranks = f"""(SELECT d, abs(d) AS size, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk
      FROM (SELECT {a} - {b} AS d FROM three) WHERE d <> 0)"""
    z = "((w - n * (n + 1) / 4.0) / sqrt((n * (n + 1.0) * (2.0 * n + 1) - 0.5 * ties) / 24.0))"
    return f"""SELECT pair, n, w AS statistic, {tail_sql(z, normal_density)} AS p FROM (
      SELECT '{a} vs {b}' AS pair, count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM {ranks}),
      (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM {ranks} GROUP BY size))"""


_THREE = "WITH three AS (SELECT score, other_score, CAST(row_id % 100 AS DOUBLE) / 100 AS third FROM scored) "
_TESTED = f"SELECT pair, n, {r('statistic', 'statistic', 1)}, {r('p', 'p_value')}, p < 0.05 AS significant FROM"


@query("A17_signed_rank", with_inputs(f"{_THREE} {_TESTED} ({_signed('score', 'other_score')})", "scored"))
def signed_rank(spark, sf_dir):
    made = G.wilcoxon_tests(I.scored(spark, sf_dir), [("score", "other_score")], method="normal")
    return made.withColumn("statistic", F.round("statistic", 1))


@query("A17_exact_signed_rank", with_inputs(f"""WITH RECURSIVE cells AS (
  SELECT row_number() OVER (ORDER BY y, attack_category) AS place, d FROM (
    SELECT year(timestamp) AS y, attack_category, round(avg(score) - avg(other_score), 2) AS d FROM scored GROUP BY ALL)),
ranked AS (SELECT place, d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM cells WHERE d <> 0),
listed AS (SELECT CAST(round(2 * rk) AS BIGINT) AS step, row_number() OVER (ORDER BY rk, place) AS k FROM ranked),
ways(k, total, n) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE)
  UNION ALL SELECT k, total, sum(n) FROM (
    SELECT w.k + 1 AS k, w.total + CASE WHEN up THEN l.step ELSE 0 END AS total, w.n / 2 AS n FROM ways w JOIN listed l ON l.k = w.k + 1, (VALUES (true), (false)) s(up)) GROUP BY k, total),
sums AS (SELECT count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM ranked)
SELECT 'a vs b' AS pair, s.n, {r('w', 'statistic', 1)}, {r('least(1, 2 * (SELECT sum(n) FROM ways WHERE k = s.n AND total <= round(2 * s.w)))', 'p_value')} FROM sums s""", "scored"))
def exact_signed_rank(spark, sf_dir):
    """Exact tail with ties: the mean difference per year and attack category, to two digits."""
    cells = I.scored(spark, sf_dir).groupBy(F.year("timestamp"), "attack_category").agg(F.round(F.avg("score") - F.avg("other_score"), 2).alias("a"))
    return G.wilcoxon_tests(cells.withColumn("b", F.lit(0.0)), [("a", "b")], method="exact").select("pair", "n", F.round("statistic", 1).alias("statistic"), "p_value")


@query("A18_compare_detectors", with_inputs(f"""{_THREE} {_TESTED} ({_signed('score', 'other_score')}
  UNION ALL {_signed('score', 'third')} UNION ALL {_signed('other_score', 'third')})""", "scored"))
def compare_detectors(spark, sf_dir):
    three = I.scored(spark, sf_dir).withColumn("third", (F.col("row_id") % 100).cast("double") / 100)
    made = G.compare_detectors(three, ["score", "other_score", "third"], lambda df, pairs: G.wilcoxon_tests(df, pairs, "normal"))
    return made.withColumn("statistic", F.round("statistic", 1))


@query("J12_paired_scores", with_inputs(f"SELECT row_id, {r('score', 'score_a')}, {r('other_score', 'score_b')} FROM scored", "scored"))
def paired_scores(spark, sf_dir):
    scored = I.scored(spark, sf_dir)
    second = scored.select("row_id", F.col("other_score").alias("score"))
    return G.paired_scores(scored, second, "row_id")


_POINTS = """CASE WHEN auth_fail_count > greatest(q1, 0) THEN 0.35 ELSE 0 END + CASE WHEN http_req_rate > greatest(q2, 0) THEN 0.35 ELSE 0 END
  + CASE WHEN http_4xx_ratio > 0.5 THEN 0.15 ELSE 0 END + CASE WHEN http_5xx_ratio > 0.3 THEN 0.15 ELSE 0 END + CASE WHEN burst_rate > 5 THEN 0.15 ELSE 0 END"""
RULE_SCORE = f"""points AS (SELECT v.*, CAST({_POINTS} AS DOUBLE) AS p FROM vectors v, (SELECT quantile_cont(auth_fail_count, 0.95) AS q1, quantile_cont(http_req_rate, 0.95) AS q2 FROM vectors)),
  ruled AS (SELECT *, p / (SELECT max(p) FROM points) AS rule_score FROM points)"""


@query("A19_network_rules", with_inputs(f"WITH {RULE_SCORE} SELECT row_id, {r('rule_score', 'rule_score')} FROM ruled", "vectors"))
def network_rules(spark, sf_dir):
    return R.network_rule_score(I.vectors(spark, sf_dir)).select("row_id", "rule_score")


@query("F22_rule_only_score", with_inputs(f"SELECT row_id, {r('CAST(row_id % 16 AS DOUBLE) / 15', 'rule_score')} FROM vectors", "vectors"))
def rule_only_score(spark, sf_dir):
    levelled = I.vectors(spark, sf_dir).withColumn("rule_level", F.col("row_id") % 16)
    return R.rule_only_score(levelled).select("row_id", "rule_score")


@query("F30_rule_decision", with_inputs(f"""WITH {RULE_SCORE}, edge AS (SELECT quantile_cont(rule_score, 0.95) AS e FROM ruled WHERE timestamp < TIMESTAMP '1999-01-01')
SELECT row_id, CASE WHEN rule_score >= e THEN 'Anomaly' ELSE 'Normal' END AS rule_prediction FROM ruled, edge WHERE timestamp >= TIMESTAMP '1999-01-01'""", "vectors"))
def rule_decision(spark, sf_dir):
    ruled = R.network_rule_score(I.vectors(spark, sf_dir))
    early = F.col("timestamp") < F.lit("1999-01-01").cast("timestamp_ntz")
    edge = R.rule_threshold(ruled.where(early))
    return R.rule_decision(ruled.where(~early), edge).select("row_id", "rule_prediction")


_DETECT = f"""SELECT attack_category, count(*) AS total_samples, CAST(count(*) FILTER (prediction = 'Anomaly') AS BIGINT) AS detected_count,
  CAST(count(*) FILTER (prediction <> 'Anomaly') AS BIGINT) AS missed_count, {r("count(*) FILTER (prediction = 'Anomaly') / CAST(count(*) AS DOUBLE)", 'detection_rate')} FROM scored GROUP BY 1"""


@query("A20_category_detection", with_inputs(_DETECT, "scored"))
def category_detection(spark, sf_dir):
    return M.category_detection(I.scored(spark, sf_dir), "attack_category", "prediction")


@query("K06_category_rows", with_inputs(f"""SELECT concat('run_', substr(attack_category, 1, 20)) AS run_id, attack_category AS dataset_split,
  'cascade_iforest_ocsvm' AS model_config, detection_rate AS recall_score FROM ({_DETECT})""", "scored"))
def category_rows(spark, sf_dir):
    detection = M.category_detection(I.scored(spark, sf_dir), "attack_category", "prediction")
    return U.category_rows(detection, "run").select("run_id", "dataset_split", "model_config", "recall_score")
