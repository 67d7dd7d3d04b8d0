"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTH = "ok boolean, id long, term long, commitIndex long, leaderId long, isLeader boolean, role string"


def majority(n: int) -> int:
    return n // 2 + 1


def role_code(role: Column) -> Column:
    return F.when(role == "follower", 0).when(role == "candidate", 1).when(role == "leader", 2).otherwise(-1)


def healthz(body: Column, code: Column | None = None) -> Column:
    """A node's health answer as a struct; null if it isn't one or the request failed."""
    parsed = F.from_json(body, HEALTH)
    fine = parsed["ok"].isNotNull() | parsed["term"].isNotNull()
    return F.when(fine if code is None else fine & (code == 200), parsed)


def instant(body: Column) -> Column:
    """The number of a metrics server's answer to an instant query: the first result's
    value, which is text; null on any failure."""
    parsed = F.from_json(body, "status string, data struct<result: array<struct<value: array<string>>>>")
    first = F.get(parsed["data"]["result"], F.lit(0))
    return F.when(parsed["status"] == "success", F.get(first["value"], F.lit(1)).try_cast("double"))


def audit_limit(asked: Column) -> Column:
    """How many lines are served: the number asked for, 1000 at most; 200 if it isn't
    a number over 0."""
    n = asked.try_cast("int")
    return F.least(F.when(n > 0, n).otherwise(200), F.lit(1000))
