"""Detection metrics. Every one is an aggregate; ranking metrics work on distinct scores."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.checks import rate
from wavelark.operators.ordering import fold_values, folded_quantiles, running_counts


def _cut(threshold) -> Column:
    return threshold if isinstance(threshold, Column) else F.lit(float(threshold))


def _folded_labels(scores: DataFrame, label: str, score: str) -> DataFrame:
    attack = (F.col(label) == 1).cast("long")
    return fold_values(scores, score, counts={"pos": attack, "neg": 1 - attack})


def _ranking(folded: DataFrame, score: str) -> DataFrame:
    totals = folded.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    t = totals.select(F.struct("p", "n").alias("t")).scalar()
    ranked = running_counts(folded, score, ["pos", "neg"]).withColumns({"_p": t["p"], "_n": t["n"]})
    below = F.col("cum_neg") - F.col("neg")
    caught = F.col("_p") - F.col("cum_pos") + F.col("pos")
    flagged = caught + F.col("_n") - below
    return ranked.agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                     F.max("_p") * F.max("_n").cast("double")).alias("roc_auc"),
        F.try_divide(F.sum(F.when(F.col("pos") > 0, F.col("pos") * caught / flagged)),
                     F.max("_p")).alias("pr_auc"))


def ranking_metrics(scores: DataFrame, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """ROC-AUC with averaged ties and step-wise average precision, in one row."""
    return _ranking(_folded_labels(scores, label, score), score)


def _confusion(folded: DataFrame, threshold, score: str) -> DataFrame:
    over = F.col(score) > _cut(threshold)

    def total(count, condition):
        return F.coalesce(F.sum(F.when(condition, F.col(count))), F.lit(0).cast("long"))

    counts = folded.agg(total("neg", ~over).alias("tn"), total("neg", over).alias("fp"),
                        total("pos", ~over).alias("fn"), total("pos", over).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    one_class = F.when(((tn + fp) == 0) | ((fn + tp) == 0),
                       F.raise_error(F.lit("evaluation needs normal and attack scores")))
    return counts.select(
        (tn + fp).alias("normal_rows"), (fn + tp).alias("attack_rows"), "tn", "fp", "fn", "tp",
        F.coalesce(one_class.cast("double"), F.try_divide(tn + tp, tn + fp + fn + tp)).alias("accuracy"),
        rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
        rate(fp, fp + tn).alias("false_positive_rate"), rate(fn, fn + tp).alias("false_negative_rate"))


def binary_metrics(scores: DataFrame, threshold, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """Confusion counts, rates and ranking metrics in one row, from one pass over the scores."""
    folded = _folded_labels(scores, label, score)
    ranks = _ranking(folded, score).select(F.struct("roc_auc", "pr_auc").alias("r")).scalar()
    return _confusion(folded, threshold, score).withColumns({
        "roc_auc": ranks["roc_auc"], "pr_auc": ranks["pr_auc"]})


def _spread(folded: DataFrame, keys: list[str], threshold, quantiles: dict[str, float], score: str) -> DataFrame:
    """Row count, moments, range, exceedance and quantiles per group of folded scores."""
    n, x = F.col("n"), F.col(score)
    means = folded.groupBy(*keys).agg(
        F.sum("n").alias("rows"), (F.sum(n * x) / F.sum("n")).alias("score_mean"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.sum(F.when(x > _cut(threshold), n).otherwise(0)).alias("threshold_exceedance_count"))
    picks = folded_quantiles(folded, score, quantiles, keys)
    if keys:
        centred = folded.join(means.select(*keys, "score_mean"), keys)
        out = means.join(picks, keys)
    else:
        centred = folded.withColumn("score_mean", means.select("score_mean").scalar())
        q = picks.select(F.struct(*quantiles).alias("q")).scalar()
        out = means.withColumns({name: q[name] for name in quantiles})
    gap = x - F.col("score_mean")
    deviation = centred.groupBy(*keys).agg(F.sqrt(F.sum(n * gap * gap) / F.sum("n")).alias("score_std"))
    out = out.join(deviation, keys) if keys else out.withColumn("score_std", deviation.select("score_std").scalar())
    return out.withColumn("threshold_exceedance_rate", F.col("threshold_exceedance_count") / F.col("rows"))


def normal_summary(scores: DataFrame, threshold, score: str = "anomaly_score") -> DataFrame:
    s = _spread(fold_values(scores, score), [], threshold, {"score_median": 0.5}, score)
    return s.select(
        "rows", F.col("threshold_exceedance_count").alias("false_positive_count"), "score_mean", "score_min",
        "score_max", (F.col("rows") - F.col("threshold_exceedance_count")).alias("true_negative_count"),
        F.col("threshold_exceedance_rate").alias("false_positive_rate"), "score_median")


def recall_by(scores: DataFrame, column: str, threshold, with_median: bool = True,
              score: str = "anomaly_score") -> DataFrame:
    """Detected share per value of a column; rows without one count as `unknown`."""
    named = scores.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("unknown")))
    over = F.col(score) > _cut(threshold)
    if not with_median:
        return named.groupBy(column).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(over).alias("detected"),
        ).withColumn("recall", F.col("detected") / F.col("rows"))
    folded = fold_values(named, score, [column])
    found = folded.groupBy(column).agg(
        F.sum("n").alias("rows"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("detected"))
    return found.join(folded_quantiles(folded, score, {"score_median": 0.5}, [column]), column).withColumn(
        "recall", F.col("detected") / F.col("rows"))


def score_distribution(scores: DataFrame, group: Sequence[str] | str, threshold,
                       quantiles: dict[str, float] | None = None, score: str = "anomaly_score") -> DataFrame:
    keys = [group] if isinstance(group, str) else list(group)
    return _spread(fold_values(scores, score, keys), keys, threshold, {"score_median": 0.5, **(quantiles or {})}, score)


def controlled_gates(rows: DataFrame, environment: str) -> DataFrame:
    """Per controlled session the sorted list of rules its rows break; none of them may be evaluated while there is one.

    Labels are 0 or 1 and equal the target flag; the session label is 1; exactly one BSSID is the target, and it was seen; every row
    has a BSSID and an attack type, is real, comes from controlled capture, and was taken where the normal rows were.
    """
    label, flag_ = F.col("label").cast("long"), F.coalesce("is_attack_target", F.lit(False))

    def any_of(condition):
        return F.count_if(F.coalesce(condition, F.lit(True))) > 0

    target = label == 1
    place = F.nullif(F.trim("environment"), F.lit(""))
    # Fold to target BSSIDs first, so that a session of any size is counted on a small table.
    folded = rows.groupBy("session_id", F.when(target, F.col("bssid_hash")).alias("_target"), place.alias("_place")).agg(
        F.count_if(target).alias("targets"), *[c.alias(n) for n, c in {
            "label_not_binary": any_of(~label.isin(0, 1)), "session_label_not_one": any_of(F.col("session_label") != 1),
            "label_differs_from_target_flag": any_of(label != flag_.cast("long")), "bssid_hash_missing": any_of(F.col("bssid_hash").isNull()),
            "synthetic_rows": any_of(F.col("is_synthetic")), "source_dataset_not_own_windows_attack": any_of(F.col("source_dataset") != "own_windows_attack"),
            "attack_type_missing": any_of(F.col("attack_type").isNull())}.items()])
    names = [c for c in folded.columns if c not in ("session_id", "_target", "_place", "targets")]
    broken = folded.groupBy("session_id").agg(
        *[F.max(n).alias(n) for n in names], (F.sum("targets") == 0).alias("target_not_observed"),
        (F.count_distinct("_target") > 1).alias("several_target_bssids"),
        (~F.coalesce((F.min("_place") == environment) & (F.max("_place") == environment), F.lit(False))).alias("attack_environment_mismatch"))
    listed = F.sort_array(F.array_compact(F.array(*[F.when(F.col(n), n) for n in broken.columns if n != "session_id"])))
    return broken.select("session_id", listed.alias("broken"), (F.size(listed) == 0).alias("passes"))


def refuse_broken(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """The rows, of which those of a session that breaks a rule fail the job; an environment that differs only blocks."""
    marked = rows.join(F.broadcast(gates.where(~F.col("passes")).select("session_id", "broken")), "session_id", "left")
    refused = F.array_except("broken", F.array(F.lit("attack_environment_mismatch")))
    checked = F.when(F.size(refused) > 0, F.raise_error(F.concat("session_id", F.lit(": "), F.array_join(refused, ", ")))).otherwise(F.col("session_id"))
    return marked.withColumn("session_id", checked).drop("broken").select(rows.columns)


def controlled_eligibility(features: DataFrame, environment: str, min_rate: float = 0.70) -> DataFrame:
    """Usable rows per controlled session and overall (`session_id` NULL), with the gates."""
    ok = F.col("context_available") & F.col("feature_complete")
    target = F.col("label") == 1
    # Fold first: a session's target BSSIDs and environments are then counted on a tiny table.
    folded = features.groupBy("session_id", F.when(target, F.col("bssid_hash")).alias("_target"),
                              F.nullif(F.trim("environment"), F.lit("")).alias("_place")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(target).alias("attack_rows"),
        F.count_if(ok).alias("eligible"), F.count_if(ok & target).alias("eligible_attack"),
        F.count_if("context_available").alias("context_available"))
    sums = ["rows", "attack_rows", "context_available", "eligible", "eligible_attack"]
    per_session = folded.groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count_distinct("_target").alias("_targets"),
        F.min("_target").alias("target_bssid_hash"),
        F.coalesce((F.min("_place") == environment) & (F.max("_place") == environment), F.lit(False)).alias("environment_matches"),
    ).withColumn("single_target", F.col("_targets") == 1).drop("_targets")
    overall = per_session.agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in sums],
        F.bool_and("environment_matches").alias("environment_matches"),
        F.bool_and("single_target").alias("single_target"),
    ).withColumns({"session_id": F.lit(None).cast("string"), "target_bssid_hash": F.lit(None).cast("string")})
    both = per_session.unionByName(overall).withColumns({
        "normal_rows": F.col("rows") - F.col("attack_rows"),
        "eligible_normal": F.col("eligible") - F.col("eligible_attack"),
        "eligible_rate": rate(F.col("eligible"), F.col("rows")),
        "attack_target_eligible_rate": rate(F.col("eligible_attack"), F.col("attack_rows")),
    })
    return both.withColumns({
        "coverage_passes": (F.col("eligible") > 0) & (F.col("eligible_rate") >= min_rate),
        "target_coverage_passes": (F.col("eligible_attack") > 0) & (F.col("attack_target_eligible_rate") >= min_rate),
    })
