"""Counters, gauges, histograms, rates and alerts over metric samples.

Samples are wide rows (ts, tick, instance, one column a series). A rate is the
increase of a counter over the window that ends with a tick, a fall being a restart
from zero, over the window's length; nothing is extrapolated at the edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import role_code

GAUGES = ("is_leader", "term", "commit_index", "role_code", "leader_id", "stepdowns")
COUNTERS = ("proposals_total", "applies_total", "writes_total", "reads_total")
#: Upper bounds of the histograms' buckets, in seconds.
PROPOSE_BUCKETS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
READ_BUCKETS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1)


def with_role_code(samples: DataFrame) -> DataFrame:
    return samples.withColumn("role_code", role_code(F.col("role")))


def gauge_latest(samples: DataFrame, by: Sequence[str] = ("instance",)) -> DataFrame:
    """The last value of each gauge by series."""
    last = F.max_by(F.struct(*GAUGES), "ts")
    return with_role_code(samples).groupBy(*by).agg(last.alias("s")).select(*by, "s.*")


def sampled_gauges(samples: DataFrame) -> DataFrame:
    """What a sampler sees once a tick."""
    return gauge_latest(samples, ("tick", "instance"))


def increase(samples: DataFrame, counter: str) -> DataFrame:
    """samples with ``inc``, the counter's increase since the sample before."""
    before = F.lag(counter).over(Window.partitionBy("instance").orderBy("ts"))
    value = F.col(counter)
    return samples.withColumn("inc", F.when(before.isNull(), 0).when(value < before, value).otherwise(value - before))


def rates(samples: DataFrame, counter: str, seconds: float, ticks: int = 1) -> DataFrame:
    """(tick, instance, rate) over the last ``ticks`` ticks of ``seconds`` each."""
    each = increase(samples, counter).groupBy("tick", "instance").agg(F.sum("inc").alias("inc"))
    span = Window.partitionBy("instance").orderBy("tick").rangeBetween(-(ticks - 1), 0)
    return each.select("tick", "instance", (F.sum("inc").over(span) / F.lit(seconds * ticks)).alias("rate"))


def leader_rate(samples: DataFrame, counter: str, seconds: float) -> DataFrame:
    """(tick, rate) summed over the instances that lead as the tick ends, so that what
    followers repeat isn't counted again."""
    leads = samples.groupBy("tick", "instance").agg(F.max_by("is_leader", "ts").alias("leads")).where("leads = 1")
    own = rates(samples, counter, seconds).join(leads, ["tick", "instance"], "left_semi")
    return own.groupBy("tick").agg(F.round(F.sum("rate"), 6).alias("rate"))


def applies_per_sec(samples: DataFrame, seconds: float, ticks: int = 1, least: float = 1.0) -> DataFrame:
    """(tick, rate, low) over all instances; low marks what a panel shows in red."""
    total = F.round(F.sum("rate"), 6)
    return rates(samples, "applies_total", seconds, ticks).groupBy("tick").agg(total.alias("rate"), (total < least).alias("low"))


def stepdowns_total(samples: DataFrame) -> DataFrame:
    return gauge_latest(samples).agg(F.sum("stepdowns").alias("stepdowns"))


def host_cpu_busy(host: DataFrame, seconds: float) -> DataFrame:
    """host(tick, cpu, idle_seconds): (tick, busy) in per cent; null, as unknown, if
    it isn't a number."""
    idle = rates(host.withColumnRenamed("cpu", "instance").withColumn("ts", F.col("tick")), "idle_seconds", seconds)
    busy = 100 * (1 - F.avg("rate"))
    return idle.groupBy("tick").agg(F.round(F.when(F.isnan(busy) | (F.abs(busy) == float("inf")), None).otherwise(busy), 6).alias("busy"))


def host_mem_used(host: DataFrame, seconds: float) -> DataFrame:
    """(tick, ok, busy, used, total): all three readings must be there and the total
    be over 0, else all are 0 and not ok; used memory is not under 0."""
    memory = host.groupBy("tick").agg(F.max("mem_total").alias("total"), F.max("mem_available").alias("available"))
    ok = F.coalesce(F.col("busy").isNotNull() & F.col("available").isNotNull() & (F.col("total") > 0), F.lit(False))
    used = F.greatest(F.lit(0.0), F.col("total") - F.col("available"))
    shown = lambda c: F.when(F.col("ok"), c).otherwise(0.0)
    both = memory.join(host_cpu_busy(host, seconds), "tick").withColumn("ok", ok)
    return both.select("tick", "ok", shown(F.col("busy")).alias("busy"), shown(used).alias("used"), shown(F.col("total")).alias("total"))


def series_select(samples: DataFrame, host: DataFrame) -> DataFrame:
    """(tick, instance, series, val): the last value a tick of the raw panels; host
    memory has instance 0."""
    last = samples.groupBy("tick", "instance").agg(F.max_by(F.struct("is_leader", "term", "commit_index"), "ts").alias("s"))
    raft = last.select("tick", "instance", F.expr("stack(3, 'is_leader', CAST(s.is_leader AS DOUBLE), 'term', CAST(s.term AS DOUBLE), 'commit_index', CAST(s.commit_index AS DOUBLE)) AS (series, val)"))
    memory = host.groupBy("tick").agg(F.max("mem_total").alias("total"), F.max("mem_available").alias("available"))
    memory = memory.select("tick", F.lit(0).cast("long").alias("instance"), F.expr("stack(2, 'mem_used', total - available, 'mem_total', total) AS (series, val)"))
    return raft.union(memory).where("val IS NOT NULL")


def metrics_unpivot(samples: DataFrame) -> DataFrame:
    """(ts, instance, metric, val): every gauge, counter and observation as its own
    sample, as they are exposed."""
    names = [*GAUGES, *COUNTERS, "seconds", "read_seconds"]
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return with_role_code(samples).select("ts", "instance", F.expr(f"stack({len(names)}, {pairs}) AS (metric, val)"))


def histogram(samples: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """(le, cumulative, n, total): observations up to each bound, from one pass."""
    value = F.col(column)
    counts = samples.agg(F.array(*[F.count_if(value <= b) for b in bounds]).alias("c"), F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counts.select(F.posexplode("c").alias("i", "cumulative"), "n", "total").select(F.get(F.array(*[F.lit(float(b)) for b in bounds]), F.col("i")).alias("le"), "cumulative", "n", "total")


def latency_histogram(samples: DataFrame) -> DataFrame:
    parts = [histogram(samples, c, b).withColumn("kind", F.lit(k)) for k, c, b in (("propose", "seconds", PROPOSE_BUCKETS), ("read", "read_seconds", READ_BUCKETS))]
    return parts[0].union(parts[1])


def held_for(ticks: DataFrame, needed: int, by: Sequence[str] = ()) -> DataFrame:
    """ticks(.., tick, hit): pending while the condition holds, firing once it has
    done so at every evaluation for ``needed`` ticks."""
    order = Window.partitionBy(*by).orderBy("tick")
    rows = ticks.withColumn("run", F.sum((~F.col("hit")).cast("int")).over(order))
    begun = F.min(F.when(F.col("hit"), F.col("tick"))).over(Window.partitionBy(*by, "run"))
    return rows.select(*by, "tick", F.col("hit").alias("pending"), (F.col("hit") & (F.col("tick") - begun >= needed)).alias("firing"))


def alert_no_progress(samples: DataFrame, seconds: float, window: int, needed: int) -> DataFrame:
    """No instance has applied anything over the window."""
    total = rates(samples, "applies_total", seconds, window).groupBy("tick").agg((F.sum("rate") == 0).alias("hit"))
    return held_for(total, needed)


def alert_leader_stuck(samples: DataFrame, seconds: float, window: int, needed: int) -> DataFrame:
    """There is a leader, and no commit index moves over the window."""
    still = rates(samples, "commit_index", seconds, window).groupBy("tick").agg((F.sum("rate") == 0).alias("still"))
    led = samples.groupBy("tick", "instance").agg(F.max_by("is_leader", "ts").alias("leads")).groupBy("tick").agg((F.max("leads") == 1).alias("led"))
    return held_for(still.join(led, "tick").select("tick", (F.col("still") & F.col("led")).alias("hit")), needed)


def alert_watchdog(samples: DataFrame, window: int, needed: int) -> DataFrame:
    """By instance: the number of step-downs has changed within the window."""
    last = samples.groupBy("tick", "instance").agg(F.max_by("stepdowns", "ts").alias("n"))
    order = Window.partitionBy("instance").orderBy("tick")
    before = F.lag("tick").over(order)
    # a change counts if both samples lie in the window
    changed = last.withColumn("since", F.when(F.col("n") != F.lag("n").over(order), before))
    recent = F.max("since").over(order.rangeBetween(-window, 0))
    return held_for(changed.select("instance", "tick", F.coalesce(recent >= F.col("tick") - window, F.lit(False)).alias("hit")), needed, ("instance",))
