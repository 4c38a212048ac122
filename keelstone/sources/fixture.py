"""The command log that the driver's ``events`` table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEL, NEVER, PUT

NOW_MS = 1706000000000
VIEW_TTL_MS, PURCHASE_TTL_MS = 604_800_000, 86_400_000


def epoch_ms(column: str):
    """Milliseconds of a timestamp without time zone, in any session time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def event_commands(events: DataFrame) -> DataFrame:
    """``seq, ts_ms, cmd, key, value, ttl_ms, delta`` of each event: one command for each row."""
    who = F.lpad(F.col("user_id").cast("string"), 6, "0")
    kind = F.col("event_type")
    cmd = F.when(kind.isin("signup", "view"), "SET").when(kind == "error", "DEL").when(kind == "purchase", "PEXPIRE").when(kind == "click", "INCRBY")
    return events.select(
        F.col("event_id").alias("seq"),
        epoch_ms("ts").alias("ts_ms"),
        cmd.alias("cmd"),
        F.concat(F.when(kind == "click", "clicks:").otherwise("user:"), who).alias("key"),
        F.when(kind.isin("signup", "view"), F.col("props")).alias("value"),
        F.when(kind == "view", F.lit(VIEW_TTL_MS)).when(kind == "purchase", F.lit(PURCHASE_TTL_MS)).cast("bigint").alias("ttl_ms"),
        F.when(kind == "click", F.lit(1)).cast("bigint").alias("delta"),
    ).filter("cmd IS NOT NULL")


def blind_mutations(commands: DataFrame) -> DataFrame:
    """The log rows of the commands that need no earlier state (SET and DEL)."""
    return commands.filter(F.col("cmd").isin("SET", "DEL")).select(
        "seq",
        "ts_ms",
        F.when(F.col("cmd") == "SET", PUT).otherwise(DEL).alias("op"),
        "key",
        "value",
        F.when(F.col("ttl_ms").isNull(), F.lit(NEVER)).otherwise(F.expr("try_add(ts_ms, ttl_ms)")).alias("expires_at_ms"),
    )
