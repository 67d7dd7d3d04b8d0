"""Rules that feed back on themselves, as folds over ordered rows.

Where a rule starts anew after a pause, rows are cut at pauses first, so that one
busy node is many small folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold


def cooldown_step(seconds: int):
    def step(last, row):
        event, t, ip = row
        ok = last is None or t - last >= seconds
        return (t if ok else last), (event, ip, ok)

    return step


def cooldown(attempts: DataFrame, seconds: int) -> DataFrame:
    """attempts(event_id, t seconds, ip): accepted if the last accepted one of the
    address is at least ``seconds`` back; a refusal doesn't extend the wait. Blank
    addresses are one, "unknown"."""
    named = attempts.select("event_id", "t", F.when(F.coalesce(F.trim("ip"), F.lit("")) == "", "unknown").otherwise(F.col("ip")).alias("ip"))
    return ordered_fold(_islands(named, "ip", "t", "event_id", seconds), ["ip", "island"], ["t", "event_id"], lambda: None, lambda last, row: cooldown_step(seconds)(last, row[:3]), "event_id long, ip string, accepted boolean")


def _islands(rows: DataFrame, part: str, t: str, order: str, span: int) -> DataFrame:
    """rows with ``island``, which grows where the pause before a row is at least
    ``span``: whatever began before it is over."""
    own = Window.partitionBy(part).orderBy(*([t, order] if t != order else [t]))
    pause = F.col(t) - F.lag(t).over(own)
    return rows.withColumn("pause", F.coalesce((pause >= span).cast("int"), F.lit(0))).withColumn("island", F.sum("pause").over(own)).drop("pause")


def batches(items: DataFrame, span: int, most: int | None) -> DataFrame:
    """items(part, idx, t): (part, idx, batch), batches being named by their first
    idx: anchored at their first item, closed after ``span`` or ``most`` items."""

    def step(state, row):
        part, idx, t, _ = row
        first, n, name = state
        if first is None or t - first > span or most and n >= most:
            first, n, name = t, 0, idx
        return (first, n + 1, name), (part, idx, name)

    rows = _islands(items.select("part", "idx", "t"), "part", "t", "idx", span + 1)
    return ordered_fold(rows.select("part", "idx", "t", "island"), ["part", "island"], ["idx"], lambda: (None, 0, 0), step, "part long, idx long, batch long")


def cached(items: DataFrame, ttl: int) -> DataFrame:
    """items(part, idx, t): (part, idx, fresh) of a result that is computed anew once
    it is ``ttl`` old; answers in between are the same."""
    return batches(items, ttl - 1, None).select("part", "idx", (F.col("idx") == F.col("batch")).alias("fresh"), F.col("batch").alias("computed_at"))


def aimd_step(least: float, most: float):
    def step(rate, row):
        part, tick, ok, fail = row
        total = ok + fail
        if total:
            if fail > 0.2 * total:
                rate = max(rate / 2, least)
            elif fail < 0.05 * total and rate < most:
                rate = min(rate + most * 0.05, most)
        return rate, (part, tick, rate)

    return step


def aimd(ticks: DataFrame, start: float, least: float, most: float) -> DataFrame:
    """ticks(part, tick, ok, fail): halve over 20 % failures, add 5 % of the
    maximum under 5 %, else hold; a tick without traffic holds too."""
    return ordered_fold(ticks.select("part", "tick", "ok", "fail"), ["part"], ["tick"], lambda: start, aimd_step(least, most), "part long, tick long, rate double")


def lease(reads: DataFrame, seconds: int) -> DataFrame:
    """reads(part, idx, t, term): a read within ``seconds`` of the last confirmation
    of this leadership is served on the lease; any other confirms, which renews it. A
    new term has no lease."""

    def step(last, row):
        part, idx, t, term, _ = row
        held = last is not None and t - last < seconds
        return (last if held else t), (part, idx, held)

    rows = _islands(reads.select("part", "idx", "t", "term"), "part", "t", "idx", seconds)
    return ordered_fold(rows.select("part", "idx", "t", "term", "island"), ["part", "term", "island"], ["idx"], lambda: None, step, "part long, idx long, leased boolean")


def sweep_step(limit: int, every: int, window: int):
    def step(state, row):
        part, idx, client, request = row
        table, top, n = state
        if client and request:
            if (client, request) in table:
                return state, (part, idx, True)
            table.add((client, request))
            top[client] = max(top.get(client, 0), request)
            n += 1  # duplicates and commands without a client don't count
            if len(table) >= limit and n % every == 0:
                table = {(c, r) for c, r in table if r + window >= top[c]}
        return (table, top, n), (part, idx, False)

    return step


def dedup_sweep(log: DataFrame, limit: int = 16384, every: int = 1024, window: int = 128) -> DataFrame:
    """log(idx, client_id, request_id): (idx, duplicate) with the bounded table, from
    which entries more than ``window`` requests behind their client are swept. The
    table is one for all clients. If nothing can ever be swept, for too few pairs or
    as no client's requests are so far apart, rows are settled by pair; only else is
    the log read in order by one task."""
    tracked = (F.col("client_id") != "") & (F.col("request_id") != 0)
    spread = log.where(tracked).groupBy("client_id").agg(F.count_distinct("request_id").alias("n"), (F.max("request_id") - F.min("request_id")).alias("wide"))
    most = spread.agg(F.sum("n").alias("n"), F.max("wide").alias("wide")).first()
    if not most["n"] or most["n"] < limit or most["wide"] <= window:
        pair = Window.partitionBy("client_id", "request_id", F.when(tracked, F.lit(None)).otherwise(F.col("idx")))
        return log.select("idx", (F.col("idx") != F.min("idx").over(pair)).alias("duplicate"))
    rows = log.select(F.lit(0).cast("long").alias("part"), "idx", "client_id", "request_id")
    return ordered_fold(rows, ["part"], ["idx"], lambda: (set(), {}, 0), sweep_step(limit, every, window), "part long, idx long, duplicate boolean").drop("part")
