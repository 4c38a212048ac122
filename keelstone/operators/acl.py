"""Users, passwords and permissions as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import USERS


def user_spec(spec: str) -> tuple[str, str, list[str]]:
    """A user from ``name:password[:CMD,CMD]``; no commands or ``*`` allows all."""
    parts = spec.split(":", 2)
    if len(parts) < 2 or not parts[0] or not parts[1]:
        raise ValueError("a user is name:password[:cmd1,cmd2,...]")
    allowed = [c.upper() for c in parts[2].split(",")] if len(parts) == 3 and parts[2] not in ("", "*") else []
    return parts[0], parts[1], sorted(set(allowed))


def users(spark: SparkSession, specs: list[str] | None = None, password: str | None = None) -> DataFrame:
    """The users table of command-line specs, or one user ``default`` with ``password``; the last spec of a name counts."""
    rows = {"default": ("default", password, [])} if password is not None else {}
    rows |= {u[0]: u for u in map(user_spec, specs or [])}
    return spark.createDataFrame(list(rows.values()), USERS)


def allows(allowed: Column, command: Column) -> Column:
    """Whether a user's list of commands allows one, in any case; an empty list allows all."""
    return (F.size(allowed) == 0) | F.array_contains(F.transform(allowed, F.upper), F.upper(command))


def can_run(requests: DataFrame, table: DataFrame) -> DataFrame:
    """``request_id, can_run`` of ``request_id, username, cmd``; an unknown user may run nothing."""
    joined = requests.join(table.select("username", "allowed"), "username", "left")
    return joined.select("request_id", F.coalesce(allows(F.col("allowed"), F.col("cmd")), F.lit(False)).alias("can_run"))


def authenticate(requests: DataFrame, table: DataFrame) -> DataFrame:
    """``request_id, ok`` of ``request_id, username, attempt``."""
    joined = requests.join(table.select("username", "password"), "username", "left")
    return joined.select("request_id", F.coalesce(F.col("password") == F.col("attempt"), F.lit(False)).alias("ok"))
