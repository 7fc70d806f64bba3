"""Queries over evaluation operators. The history is made of events; predictions of documents, labels and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import drift, history, scoring
from textloom.plans.tables import table

HISTORY_SQL = "history AS (SELECT event_id AS id, event_type AS backend, 'd' || (user_id % 7) AS dataset, 'c' || (event_id % 3) AS commit, ts, (event_id * 37 % 1000) / 1000.0::DOUBLE AS f1, value FROM events)"
ITEMS_SQL = "items AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS actual, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 12 THEN 'N' ELSE 'R' END AS predicted, l_discount * 10 AS confidence, l_tax > 0.03 AS correct FROM lineitem)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("backend"), F.concat(F.lit("d"), F.col("user_id") % 7).alias("dataset"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("commit"), "ts", (F.col("event_id") * 37 % 1000 / 1000.0).alias("f1"), "value"
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("actual"), F.when(q > 30, "A").when(q > 12, "N").otherwise("R").alias("predicted"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") > 0.03).alias("correct")
    )


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def counts_by_cell(s, d):
    return history.counts(runs(s, d), "backend", "dataset")


def counts_by_dataset(s, d):
    return history.counts(runs(s, d), "dataset")


def counts_by_backend(s, d):
    return history.counts(runs(s, d), "backend")


def history_stats(s, d):
    return _r(history.stats(runs(s, d)), "mean_f1")


def outcome_rollup(s, d):
    return _r(history.outcome_rollup(runs(s, d), ["backend", "dataset", "commit"], failed=F.col("f1") < 0.1), "mean", "std", "stderr")


def best_per_dataset(s, d):
    return history.best_per_group(runs(s, d), ["dataset"], "f1", 3, "id").select("dataset", "rank", "id", "f1")


def recent_history(s, d):
    return history.recent(runs(s, d), 50).select("id", "backend", "f1")


def history_between(s, d):
    return history.between(runs(s, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00", "click").select("id", "dataset", "f1")


def half_split_regressions(s, d):
    return _r(history.half_split_drops(runs(s, d), ["backend", "dataset"], 0.002), "before", "after", "drop")


def recent_window_regressions(s, d):
    return _r(history.recent_window_drops(runs(s, d), ["backend", "dataset"], 20), "before", "after", "drop", "d")


def commit_regressions(s, d):
    return _r(history.commit_drops(runs(s, d), ["backend", "dataset"], "c0", "c1", 0.0), "before", "after", "drop")


def effect_size(s, d):
    return _r(history.cohens_d(runs(s, d), F.col("commit") == "c0", "f1"), "mean_a", "mean_b", "d")


def paired_t_test(s, d):
    pairs = runs(s, d).groupBy("dataset", "backend").agg(F.avg(F.when(F.col("commit") == "c0", F.col("f1"))).alias("a"), F.avg(F.when(F.col("commit") == "c1", F.col("f1"))).alias("b"))
    return _r(history.paired_t(pairs, "a", "b"), "mean", "sd", "t")


def seed_summary(s, d):
    return _r(history.seed_summary(runs(s, d), ["backend"], "f1"), "mean", "std")


def metric_intervals(s, d):
    return _r(history.confidence_interval(runs(s, d), ["backend", "dataset"], "f1"), "mean", "std", "half")


def confusion_matrix(s, d):
    return scoring.confusion(items(s, d), "predicted", "actual")


def most_confused_pairs(s, d):
    return scoring.most_confused(items(s, d), "predicted", "actual", 4)


def classification_metrics(s, d):
    return _r(scoring.classification(items(s, d), "predicted", "actual"), "accuracy", "micro_f1", "weighted_f1", "macro_p", "macro_r", "macro_f1")


def calibration_bins(s, d):
    return _r(scoring.calibration_bins(items(s, d), "confidence", "correct"), "confidence", "accuracy", "squares")


def calibration_errors(s, d):
    return _r(scoring.calibration(items(s, d), "confidence", "correct"), "ece", "mce", "brier")


def threshold_curve(s, d):
    return _r(scoring.threshold_curve(items(s, d), "confidence", "correct", 10), "threshold", "precision", "recall", "f1")


def class_imbalance(s, d):
    return _r(scoring.imbalance(table(s, d, "documents"), "lang"), "ratio")


def long_tail_split(s, d):
    return _r(scoring.long_tail(table(s, d, "documents"), "source"), "coverage")


def fleiss_kappa(s, d):
    lines = table(s, d, "lineitem").filter("l_linenumber <= 3")
    three = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")).filter("k = 3").select("l_orderkey")
    return _r(scoring.fleiss_kappa(lines.join(three, "l_orderkey"), "l_orderkey", "l_returnflag", 3), "observed", "chance", "kappa")


def majority_labels(s, d):
    return _r(scoring.majority(table(s, d, "lineitem"), ["l_orderkey"], "l_returnflag", 7), "confidence")


def ranking_scores(s, d):
    lines = table(s, d, "lineitem").withColumn("relevant", F.col("l_returnflag") == "R")
    return _r(scoring.ranking(lines, "l_orderkey", "l_linenumber", "relevant", 2), "mrr", "p_at_1", "hits")


def prediction_windows(s, d):
    windowed = drift.count_windows(runs(s, d), ["id"], 300, 4)
    return _r(drift.window_stats(windowed, "f1", "backend"), "mean", "std")


def type_drift_kl(s, d):
    r = runs(s, d)
    return _r(drift.kl_divergence(r.filter("f1 > 0.5"), r.filter("f1 <= 0.5"), "dataset"), "kl")


def type_divergence_js(s, d):
    docs = table(s, d, "documents")
    return _r(drift.js_divergence(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), "source"), "js")


def vocabulary_drift(s, d):
    return _r(drift.vocabulary_drift(table(s, d, "conversations"), table(s, d, "benchmark"), "text"), "drift")


def leakage_ratio(s, d):
    docs = table(s, d, "documents")
    return _r(drift.leakage(docs.filter("source = 'src0'"), docs.filter("source <> 'src0'"), "text"), "share")


def train_redundancy(s, d):
    return _r(drift.redundancy(table(s, d, "documents"), "text"), "redundancy")


def dataset_text_stats(s, d):
    return _r(drift.text_stats(table(s, d, "conversations"), "text"), "mean", "std")


_half = "row_number() OVER (PARTITION BY backend, dataset ORDER BY ts, id) AS k, count(*) OVER (PARTITION BY backend, dataset) AS n"
_windows = "w AS (SELECT ((row_number() OVER (ORDER BY id DESC) - 1) // 300)::INT AS \"window\", f1, backend FROM history QUALIFY row_number() OVER (ORDER BY id DESC) <= 1200)"
ORACLE = {
    "counts_by_cell": f"WITH {HISTORY_SQL} SELECT backend, dataset, count(*) AS n FROM history GROUP BY ALL",
    "counts_by_dataset": f"WITH {HISTORY_SQL} SELECT dataset, count(*) AS n FROM history GROUP BY ALL",
    "counts_by_backend": f"WITH {HISTORY_SQL} SELECT backend, count(*) AS n FROM history GROUP BY ALL",
    "history_stats": f"WITH {HISTORY_SQL} SELECT count(*) AS entries, count(DISTINCT backend) AS backends, count(DISTINCT dataset) AS datasets, round(avg(f1), 6) AS mean_f1 FROM history",
    "outcome_rollup": f"WITH {HISTORY_SQL} SELECT backend, dataset, commit, count(*) AS n, count_if(f1 < 0.1)::BIGINT AS failed, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, round(stddev_pop(f1) / sqrt(count(*)), 6) AS stderr FROM history GROUP BY ALL",
    "best_per_dataset": f"WITH {HISTORY_SQL} SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, id)::INT AS rank, id, f1 FROM history QUALIFY rank <= 3",
    "recent_history": f"WITH {HISTORY_SQL} SELECT id, backend, f1 FROM history ORDER BY ts DESC, id DESC LIMIT 50",
    "history_between": f"WITH {HISTORY_SQL} SELECT id, dataset, f1 FROM history WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND backend = 'click'",
    "half_split_regressions": f"WITH {HISTORY_SQL}, h AS (SELECT *, {_half} FROM history), m AS (SELECT backend, dataset, avg(f1) FILTER (k <= n // 2) AS before, avg(f1) FILTER (k > n // 2) AS after FROM h GROUP BY ALL) SELECT backend, dataset, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS drop FROM m WHERE before - after >= 0.002",
    "recent_window_regressions": f"WITH {HISTORY_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY backend, dataset ORDER BY ts DESC, id DESC) AS k FROM history), m AS (SELECT backend, dataset, avg(f1) FILTER (k > 20) AS before, avg(f1) FILTER (k <= 20) AS after, var_samp(f1) FILTER (k > 20) AS v1, var_samp(f1) FILTER (k <= 20) AS v2, count(f1) FILTER (k > 20) AS o FROM h GROUP BY ALL) SELECT backend, dataset, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS drop, round((before - after) / sqrt((v1 + v2) / 2), 6) AS d FROM m WHERE o >= 3",
    "commit_regressions": f"WITH {HISTORY_SQL}, m AS (SELECT backend, dataset, avg(f1) FILTER (commit = 'c0') AS before, avg(f1) FILTER (commit = 'c1') AS after FROM history WHERE commit IN ('c0', 'c1') GROUP BY ALL) SELECT backend, dataset, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS drop FROM m WHERE before - after >= 0",
    "effect_size": f"WITH {HISTORY_SQL} SELECT round(avg(f1) FILTER (commit = 'c0'), 6) AS mean_a, round(avg(f1) FILTER (commit <> 'c0'), 6) AS mean_b, round((avg(f1) FILTER (commit = 'c0') - avg(f1) FILTER (commit <> 'c0')) / sqrt((var_samp(f1) FILTER (commit = 'c0') + var_samp(f1) FILTER (commit <> 'c0')) / 2), 6) AS d FROM history",
    "paired_t_test": f"WITH {HISTORY_SQL}, p AS (SELECT avg(f1) FILTER (commit = 'c0') - avg(f1) FILTER (commit = 'c1') AS d FROM history GROUP BY dataset, backend), s AS (SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM p), t AS (SELECT *, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) ELSE 0 END AS t FROM s) SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, CASE WHEN n < 2 THEN 1.0 WHEN abs(t) > CASE WHEN n >= 30 THEN 2.576 ELSE 2.75 END THEN 0.01 WHEN abs(t) > CASE WHEN n >= 30 THEN 1.96 ELSE 2.04 END THEN 0.05 ELSE 0.1 END::DOUBLE AS p FROM t",
    "seed_summary": f"WITH {HISTORY_SQL} SELECT backend, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, min(f1) AS least, max(f1) AS greatest, count(f1) AS n FROM history GROUP BY ALL",
    "metric_intervals": f"WITH {HISTORY_SQL} SELECT backend, dataset, count(*) AS n, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, round(CASE WHEN count(*) >= 30 THEN 1.96 ELSE 2 + 0.1 / sqrt(count(*)) END * stddev_samp(f1) / sqrt(count(*)), 6) AS half FROM history GROUP BY ALL",
    "confusion_matrix": f"WITH {ITEMS_SQL} SELECT predicted, actual, count(*) AS n FROM items GROUP BY ALL",
    "most_confused_pairs": f"WITH {ITEMS_SQL} SELECT predicted, actual, count(*) AS n FROM items WHERE predicted <> actual GROUP BY ALL ORDER BY n DESC, predicted, actual LIMIT 4",
    "classification_metrics": f"WITH {ITEMS_SQL}, c AS (SELECT c, count_if(actual = c AND predicted = c) AS tp, count_if(predicted = c AND actual <> c) AS fp, count_if(actual = c AND predicted <> c) AS fn FROM items, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY c), m AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, tp + fn AS s FROM c), f AS (SELECT *, 2 * p * r / (p + r) AS f FROM m), a AS (SELECT sum(tp) / sum(s) AS accuracy, sum(tp) / sum(tp + fp) AS mp, sum(f * s) / sum(s) AS w, avg(p) AS macro_p, avg(r) AS macro_r FROM f) SELECT round(accuracy, 6) AS accuracy, round(2 * mp * accuracy / (mp + accuracy), 6) AS micro_f1, round(w, 6) AS weighted_f1, round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r, round(2 * macro_p * macro_r / (macro_p + macro_r), 6) AS macro_f1 FROM a",
    "calibration_bins": f"WITH {ITEMS_SQL} SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct::INT), 6) AS accuracy, round(sum((confidence - correct::INT) ** 2), 6) AS squares FROM items GROUP BY 1",
    "calibration_errors": f"WITH {ITEMS_SQL}, b AS (SELECT count(*) AS n, abs(avg(confidence) - avg(correct::INT)) AS gap, sum((confidence - correct::INT) ** 2) AS sq FROM items GROUP BY least(floor(confidence * 10), 9)) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM b",
    "threshold_curve": f"WITH {ITEMS_SQL}, t AS (SELECT k, count(i.id) FILTER (least(floor(confidence * 10 + 1e-9), 10) >= k) AS kept, count_if(correct AND least(floor(confidence * 10 + 1e-9), 10) >= k) AS hit, count_if(correct) AS total FROM range(11) r(k), items i GROUP BY k), p AS (SELECT k, kept, CASE WHEN kept = 0 THEN 1 ELSE hit / kept END AS p, CASE WHEN total = 0 THEN 1 ELSE hit / total END AS r FROM t) SELECT round(k / 10, 6) AS threshold, kept, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p",
    "class_imbalance": "SELECT round(max(n) / min(n), 6) AS ratio FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "long_tail_split": "WITH c AS (SELECT source AS class, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, class)::INT AS rank, count(*) OVER () AS k, sum(n) OVER (ORDER BY n DESC, class ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS coverage FROM c) SELECT class, n, rank, CASE WHEN rank <= ceil(k * 0.2) THEN 'head' WHEN rank > k - ceil(k * 0.2) THEN 'tail' ELSE 'mid' END AS part, round(coverage, 6) AS coverage FROM r",
    "fleiss_kappa": "WITH l AS (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(*) = 3)), c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM l GROUP BY ALL), o AS (SELECT avg(a) AS observed, count(*) AS items FROM (SELECT (sum(n * n) - 3) / 6 AS a FROM c GROUP BY l_orderkey)), e AS (SELECT sum(q) AS chance FROM (SELECT (sum(n) / (any_value(items) * 3)) ** 2 AS q FROM c, o GROUP BY l_returnflag)) SELECT round(observed, 6) AS observed, round(chance, 6) AS chance, round((observed - chance) / (1 - chance), 6) AS kappa FROM o, e",
    "majority_labels": "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, (sum(n) OVER (PARTITION BY l_orderkey))::BIGINT AS votes, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS k FROM c) SELECT l_orderkey, l_returnflag AS label, votes, round((votes / 7) * (n / votes), 6) AS confidence FROM r WHERE k = 1",
    "ranking_scores": "WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) SELECT round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(coalesce((f = 1)::INT, 0)), 6) AS p_at_1, round(avg(coalesce((f <= 2)::INT, 0)), 6) AS hits FROM f",
    "prediction_windows": f"WITH {HISTORY_SQL}, {_windows} SELECT \"window\", count(*) AS n, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, count(DISTINCT backend) AS kinds FROM w GROUP BY 1 HAVING count(*) = 300",
    "type_drift_kl": f"WITH {HISTORY_SQL}, p AS (SELECT dataset, count(*) / sum(count(*)) OVER () AS p FROM history WHERE f1 > 0.5 GROUP BY 1), q AS (SELECT dataset, count(*) / sum(count(*)) OVER () AS q FROM history WHERE f1 <= 0.5 GROUP BY 1) SELECT round(sum(p * ln(p / coalesce(q, 1e-10))), 6) AS kl FROM p LEFT JOIN q USING (dataset)",
    "type_divergence_js": "WITH p AS (SELECT source, count(*) / sum(count(*)) OVER () AS p FROM documents WHERE lang = 'en' GROUP BY 1), q AS (SELECT source, count(*) / sum(count(*)) OVER () AS q FROM documents WHERE lang <> 'en' GROUP BY 1), b AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q USING (source)) SELECT round((sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2 / ln(2), 6) AS js FROM b",
    "vocabulary_drift": "WITH c AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations), b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM benchmark) SELECT round(1 - count(b.w) / count(*), 6) AS drift FROM c LEFT JOIN b USING (w) WHERE c.w <> ''",
    "leakage_ratio": "WITH t AS (SELECT DISTINCT lower(text) AS t FROM documents WHERE source <> 'src0') SELECT count_if(lower(text) IN (SELECT t FROM t))::BIGINT AS leaked, round(count_if(lower(text) IN (SELECT t FROM t)) / count(*), 6) AS share FROM documents WHERE source = 'src0'",
    "train_redundancy": "SELECT round(1 - count(DISTINCT lower(text)) / count(*), 6) AS redundancy FROM documents",
    "dataset_text_stats": "WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations), l AS (SELECT len(w) AS n FROM w) SELECT (SELECT count(*) FROM l) AS texts, (SELECT sum(n)::BIGINT FROM l) AS words, (SELECT round(avg(n), 6) FROM l) AS mean, (SELECT round(stddev_pop(n), 6) FROM l) AS std, (SELECT list_sort(list(n))[count(*) // 2 + 1]::INT FROM l) AS median, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM w)) AS distinct_words",
}
QUERIES = {f.__name__: f for f in (
    counts_by_cell, counts_by_dataset, counts_by_backend, history_stats, outcome_rollup, best_per_dataset, recent_history, history_between, half_split_regressions, recent_window_regressions, commit_regressions, effect_size,
    paired_t_test, seed_summary, metric_intervals, confusion_matrix, most_confused_pairs, classification_metrics, calibration_bins, calibration_errors, threshold_curve, class_imbalance, long_tail_split, fleiss_kappa, majority_labels,
    ranking_scores, prediction_windows, type_drift_kl, type_divergence_js, vocabulary_drift, leakage_ratio, train_redundancy, dataset_text_stats,
)}
