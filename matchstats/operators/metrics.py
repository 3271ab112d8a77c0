"""Accuracy, Brier score, calibration and advice.  A settled row has actual_winner, correct, prediction_error and
calibration_error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_period(as_of: str, days: int) -> Column:
    end = F.lit(as_of).cast("date")
    return F.col("actual_winner").isNotNull() & F.col("game_date").between(F.date_sub(end, days), end)


def _measures(inside: Column) -> dict[str, Column]:
    def mean(value: str, where: Column | None = None) -> Column:
        return F.coalesce(F.round(F.avg(F.when(inside if where is None else inside & where, F.col(value))), 4), F.lit(0.0))

    conf = F.col("confidence")
    return {
        "total_predictions": F.count_if(inside), "correct_predictions": F.coalesce(F.sum(F.when(inside, F.col("correct"))), F.lit(0)), "accuracy": mean("correct"),
        "brier_score": mean("prediction_error"), "calibration_score": mean("calibration_error"), "avg_confidence": mean("confidence"),
        "high_conf_accuracy": mean("correct", conf >= 0.7), "low_conf_accuracy": mean("correct", conf < 0.7), "home_bias": mean("correct", F.col("predicted_home_prob") > 0.5),
        "favorite_bias": mean("correct", conf >= 0.6),
    }


def evaluate_performance(settled: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row of measures over the days up to as_of; an empty subset counts 0; rounded to 4 places."""
    return settled.agg(*[c.alias(n) for n, c in _measures(_in_period(as_of, days)).items()])


def performance_snapshot(measures: DataFrame, as_of: str, days: int) -> DataFrame:
    """Measures with their date and period, to be appended to the performance table."""
    end = F.lit(as_of).cast("date")
    return measures.select(end.alias("evaluation_date"), F.date_sub(end, days).alias("period_start"), end.alias("period_end"), *measures.columns)


def retrain_advice(settled: DataFrame, last_evaluation: str | None, as_of: str) -> DataFrame:
    """should_retrain, urgency and reasons from the last 30 against the last 90 days; the last rule that holds sets the
    urgency.  last_evaluation is the date before this evaluation."""
    short, long = _measures(_in_period(as_of, 30)), _measures(_in_period(as_of, 90))
    m = settled.agg(F.struct(*[c.alias(n) for n, c in short.items()]).alias("r"), F.struct(*[c.alias(n) for n, c in long.items()]).alias("l"))
    age = F.datediff(F.lit(as_of).cast("date"), F.lit(last_evaluation).cast("date"))
    rules = [
        (F.col("r.accuracy") < F.col("l.accuracy") - 0.05, F.lit("Accuracy dropped >5% in last 30 days"), "high"),
        (F.col("r.brier_score") > F.col("l.brier_score") * 1.2, F.lit("Brier score worsened by 20%"), "medium"),
        (F.col("r.total_predictions") < 20, F.lit("Insufficient recent predictions (<20)"), None),
        (F.col("r.calibration_score") > 0.15, F.lit("Poor calibration (error > 0.15)"), "medium"),
        (age > 7, F.concat(F.lit("Last training was "), age.cast("string"), F.lit(" days ago")), "low"),
    ]
    reasons = F.filter(F.array(*[F.when(c, t) for c, t, _ in rules]), lambda x: x.isNotNull())
    urgency = F.coalesce(*[F.when(c, F.lit(u)) for c, _, u in reversed(rules) if u], F.lit("low"))
    retrain = F.array_contains(F.array(*[F.coalesce(c, F.lit(False)) for c, _, u in rules if u]), True)
    return m.select(retrain.alias("should_retrain"), urgency.alias("urgency"), F.array_join(reasons, "; ").alias("reasons"))


#: Half-open confidence bins; exactly 1 is in none.
BINS = [(0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0)]


def calibration_table(settled: DataFrame, least: int = 3) -> DataFrame:
    """Per confidence bin of at least `least` settled rows: mean confidence, accuracy, number, gap and status
    (OK below a gap of 0.1, WARNING below 0.2, else BAD)."""
    conf = F.col("confidence")
    label = F.coalesce(*[F.when((conf >= a) & (conf < b), F.lit(f"{a:.0%}-{b:.0%}")) for a, b in BINS])
    rows = settled.where("correct is not null").withColumn("bin", label).where("bin is not null")
    t = rows.groupBy("bin").agg(F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"), F.count("*").alias("n")).where(F.col("n") >= least)
    gap = F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return t.withColumn("gap", gap).withColumn("status", F.when(gap < 0.1, "OK").when(gap < 0.2, "WARNING").otherwise("BAD"))


def ece(settled: DataFrame) -> DataFrame:
    """Expected calibration error: the gaps weighted by the rows of the reported bins."""
    return calibration_table(settled).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def status_counts(settled: DataFrame, as_of: str, days: int) -> DataFrame:
    """Correct, wrong and pending rows of the look-back and their accuracy; all pending rows with first and last date."""
    end = F.lit(as_of).cast("date")
    inside, pending = F.col("game_date").between(F.date_sub(end, days), end), F.col("actual_winner").isNull()
    good, bad = F.count_if(inside & (F.col("correct") == 1)), F.count_if(inside & (F.col("correct") == 0))
    return settled.agg(
        good.alias("correct"), bad.alias("wrong"), F.count_if(inside & pending).alias("pending"), F.coalesce(F.try_divide(good, good + bad), F.lit(0.0)).alias("accuracy"),
        F.count_if(pending).alias("all_pending"), F.min(F.when(pending, F.col("game_date"))).alias("first_pending"), F.max(F.when(pending, F.col("game_date"))).alias("last_pending"),
    )


def prediction_summary(pred: DataFrame) -> DataFrame:
    """Rows, rows of confidence from 0.7 on, and mean confidence of each date."""
    return pred.groupBy("game_date").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("high_confidence"), F.avg("confidence").alias("avg_confidence"))
