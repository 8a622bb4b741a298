"""Event studies, alarms and their lead times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.win import quantile

BACK = CONFIG.lookback


def alarms(signal: DataFrame, value: str, q: float = CONFIG.alarm_quantile, n: int = CONFIG.alarm_window, least: int = 252) -> DataFrame:
    """signal with alarm: whether the value is over the quantile of the rows before."""
    bar = quantile(value, q, n, least, offset=1)
    return signal.withColumn("alarm", F.coalesce(F.col(value) > bar, F.lit(False)))


def lead_times(alarmed: DataFrame, onsets: DataFrame, back: int = BACK) -> DataFrame:
    """onset position, detected, lead in days from the latest alarm of the days before."""
    a = alarmed.where("alarm").select(F.col("pos").alias("at"))
    o = onsets.where("onset").select(F.col("pos").alias("onset_pos"))
    met = o.join(a, (F.col("at") >= F.col("onset_pos") - back) & (F.col("at") < F.col("onset_pos")), "left")
    return met.groupBy("onset_pos").agg((F.col("onset_pos") - F.max("at")).alias("lead")).select("onset_pos", F.col("lead").isNotNull().alias("detected"), "lead")


def false_alarms(alarmed: DataFrame, onsets: DataFrame, ahead: int = BACK) -> DataFrame:
    """Alarm days that no onset follows."""
    a = alarmed.where("alarm").select(F.col("pos").alias("at"))
    o = onsets.where("onset").select(F.col("pos").alias("onset_pos"))
    return a.join(o, (F.col("onset_pos") > F.col("at")) & (F.col("onset_pos") <= F.col("at") + ahead), "left_anti")


def lead_summary(alarmed: DataFrame, onsets: DataFrame, back: int = BACK) -> DataFrame:
    leads = lead_times(alarmed, onsets, back).agg(F.count(F.lit(1)).alias("onsets"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.median("lead").alias("median_lead"))
    false = false_alarms(alarmed, onsets, back).agg(F.count(F.lit(1)).alias("false_alarms"))
    total = alarmed.agg(F.count_if("alarm").alias("alarms"))
    return leads.join(F.broadcast(false)).join(F.broadcast(total)).select("onsets", "detection_rate", "median_lead", "alarms", (F.col("false_alarms") / F.nullif(F.col("alarms"), F.lit(0))).alias("false_alarm_rate"))


def episodes(alarmed: DataFrame, gap: int = 5, key: str = "ticker") -> DataFrame:
    """Alarm days in runs with at most `gap` rows between: their first and last day and number."""
    days, order = alarmed.where("alarm").select(key, "pos"), Window.partitionBy(key).orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(order)) > gap, F.lit(True))
    runs = days.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(order))
    return runs.groupBy(key, "episode").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("days"))


def alarm_metrics(signals: DataFrame, onsets: DataFrame, back: int = BACK, compress: bool = True, q: float = CONFIG.alarm_quantile, n: int = CONFIG.alarm_window) -> DataFrame:
    """A row per signal: onsets, detected, detection_rate, mean_lead, median_lead, episodes, false_episodes, false_alarm_rate, episodes_a_year.

    signals: signal, pos, value (long), all in one plan. Thresholds come from a signal's rows without its gaps, or with
    compress=False from all of them; leads count from the earliest episode that starts in the days before. onsets: pos,
    onset of every day of the study.
    """
    rows = signals.where("value is not null") if compress else signals
    frame = Window.partitionBy("signal").orderBy("pos").rowsBetween(-n, -1)
    bar = F.when(F.count("value").over(frame) >= n // 2, F.percentile("value", F.lit(q)).over(frame))
    starts = episodes(rows.withColumn("alarm", F.coalesce(F.col("value") > bar, F.lit(False))), key="signal").select("signal", "first")
    days = onsets.agg(F.count(F.lit(1)).alias("days"))
    o = onsets.where("onset").select(F.col("pos").alias("onset_pos"))
    names = signals.select("signal").distinct()
    each = names.join(F.broadcast(o)).join(starts, ["signal"], "left")  # few signals, onsets and episodes
    ahead = (F.col("first") >= F.col("onset_pos") - back) & (F.col("first") < F.col("onset_pos"))
    each = each.groupBy("signal", "onset_pos").agg((F.col("onset_pos") - F.min(F.when(ahead, F.col("first")))).alias("lead"))
    hit = each.groupBy("signal").agg(F.count(F.lit(1)).alias("onsets"), F.count("lead").alias("detected"), F.avg("lead").alias("mean_lead"), F.median("lead").alias("median_lead"))
    useless = starts.join(F.broadcast(o), (F.col("onset_pos") > F.col("first")) & (F.col("onset_pos") <= F.col("first") + back), "left_anti").groupBy("signal").agg(F.count(F.lit(1)).alias("false"))
    total = starts.groupBy("signal").agg(F.count(F.lit(1)).alias("all"))
    out = names.join(hit, "signal", "left").join(useless, "signal", "left").join(total, "signal", "left").join(F.broadcast(days))  # days: one row
    none = F.lit(0).cast("long")
    out = out.select("signal", F.coalesce("onsets", none).alias("onsets"), F.coalesce("detected", none).alias("detected"), "mean_lead", "median_lead", F.coalesce("all", none).alias("episodes"), F.coalesce("false", none).alias("false_episodes"), "days")
    return out.select(
        "signal", "onsets", "detected", (F.col("detected") / F.nullif(F.col("onsets"), F.lit(0))).alias("detection_rate"), "mean_lead", "median_lead", "episodes", "false_episodes",
        (F.col("false_episodes") / F.greatest("episodes", F.lit(1))).alias("false_alarm_rate"), (F.col("episodes") * float(CONFIG.days_a_year) / F.nullif(F.col("days"), F.lit(0))).alias("episodes_a_year"),
    )


def shifted(signal: DataFrame, onsets: DataFrame, shifts: tuple[int, ...]) -> DataFrame:
    """A signal (pos, value) put on the days of onsets, moved forward in a circle by each shift, gaps and all: signal (the shift), pos, value."""
    edge = onsets.agg(F.min("pos").alias("_low"), F.count(F.lit(1)).alias("_n"))  # one row; pos runs on without gaps
    rows = onsets.select("pos").join(signal.select("pos", "value"), "pos", "left").join(F.broadcast(edge))
    moved = rows.withColumn("signal", F.explode(F.array(*[F.lit(s) for s in shifts])))
    return moved.select(F.col("signal").cast("string").alias("signal"), (F.col("_low") + F.pmod(F.col("pos") - F.col("_low") + F.col("signal"), F.col("_n"))).cast("int").alias("pos"), "value")


def chance_metrics(signal: DataFrame, onsets: DataFrame, shifts: tuple[int, ...] = (500, 1000, 1500, 2000)) -> DataFrame:
    """Medians of the alarm metrics of the circularly shifted signal. signal: pos, value."""
    each = alarm_metrics(shifted(signal, onsets, shifts), onsets, compress=False)
    whole = ("onsets", "detected", "episodes", "false_episodes")
    return each.agg(*[F.median(F.col(c).cast("double") if c in whole else F.col(c)).alias(c) for c in each.columns if c != "signal"])


def around(signals: DataFrame, days: DataFrame, back: int = BACK, fwd: int = 10) -> DataFrame:
    """signal, t, value, and the columns of days, of each day's window. signals: signal, pos, value; days: pos and more."""
    spread = days.withColumnRenamed("pos", "day").withColumn("t", F.explode(F.sequence(F.lit(-back), F.lit(fwd)))).withColumn("pos", F.col("day") + F.col("t"))
    return signals.join(spread, "pos")


def study_days(onsets: DataFrame, back: int = BACK, fwd: int = 10, warm: int = CONFIG.z_window) -> DataFrame:
    """The onsets that have enough days before and after them."""
    edge = onsets.agg(F.min("pos").alias("_low"), (F.max("pos") + 1).alias("_high"))  # one row
    inside = (F.col("pos") - F.col("_low") > back + warm) & (F.col("pos") < F.col("_high") - fwd)
    return onsets.where("onset").select("pos").join(F.broadcast(edge)).where(inside).select("pos")


def placebo_days(onsets: DataFrame, draws: int = CONFIG.placebo_draws, back: int = BACK, fwd: int = 10, warm: int = CONFIG.z_window, each: int | None = None, last: int = 1, a: int = 7919, b: int = 104729) -> DataFrame:
    """draw, pos: as many days as an event study has onsets (or `each`), drawn by integer arithmetic so that any engine draws the same."""
    edge = onsets.agg(F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"))
    count = study_days(onsets, back, fwd, warm).agg(F.count(F.lit(1)).alias("onsets")) if each is None else onsets.agg(F.lit(each).cast("long").alias("onsets"))
    size = edge.join(F.broadcast(count))  # one row each
    base = onsets.sparkSession.range(draws).select(F.col("id").alias("draw")).join(F.broadcast(size)).where("onsets > 0")
    rows = base.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("onsets") - 1)))
    first, room = back + warm, F.greatest(F.col("high") - F.col("low") - fwd - last - (back + warm), F.lit(1))
    return rows.select("draw", (F.col("low") + first + F.pmod(F.col("draw") * a + F.col("k") * b + F.col("draw") * F.col("k") * 17, room)).cast("int").alias("pos"))


def event_study(signals: DataFrame, onsets: DataFrame, placebo: DataFrame, back: int = BACK, fwd: int = 10) -> DataFrame:
    """signal, t, mean over onsets, and the band of the placebo draws' means."""
    seen = around(signals, study_days(onsets, back, fwd), back, fwd).groupBy("signal", "t").agg(F.avg("value").alias("mean"), F.count("value").alias("onsets"))
    drawn = around(signals, placebo, back, fwd).groupBy("signal", "t", "draw").agg(F.avg("value").alias("m"))
    band = drawn.groupBy("signal", "t").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return seen.join(band, ["signal", "t"], "left")


def first_movers(study: DataFrame, run: int = 3) -> DataFrame:
    """signal and the first t of 0 or before from which the mean stays over the band for `run` days; null where it never does."""
    order = Window.partitionBy("signal").orderBy("t")
    over = study.withColumn("over", F.coalesce(F.col("mean") > F.col("high"), F.lit(False)).cast("int"))
    frame = order.rowsBetween(0, run - 1)
    held = over.withColumn("stays", (F.min("over").over(frame) == 1) & (F.count(F.lit(1)).over(frame) == run))
    return held.groupBy("signal").agg(F.min(F.when(F.col("stays") & (F.col("t") <= 0), F.col("t"))).alias("first_t"))


def onset_path(signals: DataFrame, onsets: DataFrame, placebo: DataFrame, back: int = BACK, fwd: int = 20) -> DataFrame:
    """signal, t, mean and two standard errors either side, over onsets with so many days around them; placebo: the mean over placebo days."""
    days = study_days(onsets, back, fwd, 0)
    n = days.agg(F.count(F.lit(1)).alias("n"))  # one row
    out = around(signals, days, back, fwd).groupBy("signal", "t").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    error = 2 * F.col("s") / F.sqrt(F.nullif(F.col("n").cast("double"), F.lit(0.0)))
    out = out.join(F.broadcast(n)).select("signal", "t", "mean", (F.col("mean") - error).alias("low"), (F.col("mean") + error).alias("high"), "n")
    return out.join(around(signals, placebo, back, fwd).groupBy("signal", "t").agg(F.avg("value").alias("placebo")), ["signal", "t"], "left")
