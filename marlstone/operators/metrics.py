"""Monitoring expressions over samples (series labels, ts, value): counters, gauges, histograms, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the latency histograms, in seconds.
SEARCH_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
PIPELINE_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


#: A window over a series is cut into stretches of time that are numbered apart, so a busy series is spread over tasks.
STRETCH = 24 * 3600


def _stretches(samples: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Samples with their stretch, and copies of those that the next stretch can look back on."""
    size = max(STRETCH, 4 * seconds)
    at = F.floor(_seconds(ts) / (size * 1_000_000))
    reaches = F.floor((_seconds(ts) + seconds * 1_000_000) / (size * 1_000_000))
    placed = samples.withColumn("__own", at).withColumn("__stretch", F.explode(F.when(reaches > at, F.array(at, reaches)).otherwise(F.array(at))))
    return placed


def increments(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Counter samples with the increase since the one before; a drop is a reset and counts from zero, the first sample
    counts nothing. The first of a stretch of time takes the last of the stretch before from a small table."""
    placed = samples.withColumn("__stretch", F.floor(_seconds(ts) / (STRETCH * 1_000_000)))
    order = [ts, tie] if tie else [ts]
    last = placed.groupBy(*series, "__stretch").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*series).orderBy("__stretch")))
    keys = [*series, "__stretch"]
    carried = carried.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__carried")
    joined = placed.join(carried, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]).drop(*[f"__k{i}" for i in range(len(keys))])
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*series, "__stretch").orderBy(*order)), "__carried")
    up = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return joined.withColumn("increase", up).drop("__stretch", "__carried")


def rolling_rate(events: DataFrame, series: list[str], seconds: int, ts: str = "ts", amount: Column | None = None) -> DataFrame:
    """Per event the amount of its series over the trailing window, and that per second. The window holds (t - s, t]."""
    span = Window.partitionBy(*series, "__stretch").orderBy(_seconds(ts)).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    total = F.sum(amount if amount is not None else F.lit(1)).over(span)
    counted = _stretches(events, ts, seconds).withColumn("in_window", total).filter("__stretch = __own OR __own IS NULL")
    return counted.withColumn("rate", F.col("in_window") / float(seconds)).drop("__own", "__stretch")


def counter_rate(samples: DataFrame, series: list[str], seconds: int, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Per sample of a counter its increase over the trailing window a second, resets taken into account."""
    return rolling_rate(increments(samples, series, ts, value, tie), series, seconds, ts, F.col("increase"))


def sum_by(rates: DataFrame, labels: list[str], series: list[str], width: str, ts: str = "ts", value: str = "rate", tie: str | None = None) -> DataFrame:
    """(window_start, labels, value): the sum over the series of their last value in each tumbling window."""
    window = F.window(F.col(ts).cast("timestamp"), width).alias("w")
    last = rates.groupBy(window, *labels, *[s for s in series if s not in labels]).agg(F.max_by(value, F.struct(ts, tie) if tie else F.col(ts)).alias("last"))
    return last.groupBy("w", *labels).agg(F.sum("last").alias("value")).select(F.col("w.start").alias("window_start"), *labels, "value")


def increase(events: DataFrame, labels: list[str], width: str, ts: str = "ts", amount: Column | None = None) -> DataFrame:
    """(window start, labels, increase) in tumbling windows."""
    grouped = events.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w"), *labels).agg(F.sum(amount if amount is not None else F.lit(1)).alias("increase"))
    return grouped.select(F.col("w.start").alias("window_start"), *labels, "increase")


def counters(events: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    return events.groupBy(*labels).agg(F.sum(amount if amount is not None else F.lit(1)).alias("total"))


def gauges(samples: DataFrame, labels: list[str], ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Last value of every series."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(ts, tie) if tie else F.col(ts)).alias("value"))


def histogram(samples: DataFrame, labels: list[str], bounds: list[float], value: str = "value") -> DataFrame:
    """(labels, le, count) with cumulative counts per upper bound and the last for +Inf, and the sum of values. One pass: a
    conditional count per bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = samples.groupBy(*labels).agg(*counts, F.count(value).alias("total"), F.sum(value).alias("sum"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("count"))]
    return wide.select(*labels, "sum", F.explode(F.array(*pairs)).alias("b")).select(*labels, F.col("b.le").alias("le"), F.col("b.count").alias("count"), "sum")


def histogram_quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """(labels, value): the quantile by linear interpolation inside its bucket. In the last, unbounded bucket it is the
    highest bound; without observations it is null."""
    listed = buckets.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct("le", "count"))).alias("b"))
    wanted = F.element_at("b", -1)["count"] * q
    at = F.aggregate(F.transform("b", lambda x: x["count"]), F.lit(0), lambda n, c: n + F.when(c < wanted, 1).otherwise(0))
    upper, lower = F.try_element_at("b", at + 1), F.when(at > 0, F.try_element_at("b", F.when(at > 0, at)))
    low, base = F.coalesce(lower["le"], F.lit(0.0)), F.coalesce(lower["count"], F.lit(0))
    inside = low + (upper["le"] - low) * (wanted - base) / F.nullif(upper["count"] - base, F.lit(0))
    value = F.when(F.element_at("b", -1)["count"] == 0, F.lit(None)).when(upper["le"] == float("inf"), low).otherwise(F.coalesce(inside, upper["le"]))
    return listed.select(*labels, value.alias("value"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def held_for(samples: DataFrame, series: list[str], condition: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """Samples with ``firing``: the condition has held in every sample of the trailing time, and the series is that old."""
    span = Window.partitionBy(*series, "__stretch").orderBy(_seconds(ts)).rangeBetween(-(seconds * 1_000_000), 0)
    born = samples.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(series)]).agg(F.min(_seconds(ts)).alias("__born"))
    checked = _stretches(samples.withColumn("__c", condition), ts, seconds).withColumn("__held", F.min("__c").over(span)).filter("__stretch = __own OR __own IS NULL")
    joined = checked.join(born, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(series)]).drop(*[f"__k{i}" for i in range(len(series))])
    old = _seconds(ts) - F.col("__born") >= seconds * 1_000_000
    return joined.withColumn("firing", F.col("__held") & old).drop("__c", "__held", "__own", "__stretch", "__born")


def stalled(traffic: DataFrame, up: DataFrame, ts: str = "ts") -> DataFrame:
    """Times at which there was no traffic though the service was up: a join on time of (ts, increase) and (ts, up)."""
    return traffic.filter("increase = 0").join(up.filter("up = 1"), ts, "left_semi")


def matching(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    """Series whose label matches the whole pattern."""
    return samples.filter(F.col(label).rlike(f"^(?:{pattern})$"))


def clamp_max(value: Column, most: float) -> Column:
    return F.least(value, F.lit(most))


def uptime(started: str | Column, now: Column | None = None) -> Column:
    """Seconds since the start."""
    start = F.col(started) if isinstance(started, str) else started
    return (F.unix_micros(now if now is not None else F.current_timestamp()) - F.unix_micros(start.cast("timestamp"))) / 1e6


def any_of(rows: DataFrame, condition: Column) -> DataFrame:
    """One row that says whether the condition holds anywhere; false for an empty table."""
    return rows.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("any"))


def exposition(samples: DataFrame, name: str, kind: str, labels: list[str], value: str = "value") -> DataFrame:
    """(line) in the text format of metrics endpoints: the type, then a line per series."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in labels])
    lines = samples.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
    head = samples.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(lines)
