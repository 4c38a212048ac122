"""The scalar functions and the codec for SQL: temporary functions that Catalyst inlines, and one table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from ..schema import NEVER
from . import resp

_DIGITS = r"\\A[+-]?[0-9]+\\z"
_RUN = r"\\A(?:sst-|L([0-9]+)-)([0-9]+)\\.db\\z"
_CRLF = r"'\r\n'"

#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("ks_parse_long", "v STRING", "BIGINT", f"CASE WHEN v RLIKE '{_DIGITS}' THEN try_cast(v AS BIGINT) END"),
    ("ks_live", "op STRING, expires_at_ms BIGINT, now_ms BIGINT", "BOOLEAN", "op <> 'DEL' AND expires_at_ms > now_ms"),
    ("ks_ttl_ms", "found BOOLEAN, expires_at_ms BIGINT, now_ms BIGINT", "BIGINT", f"CASE WHEN NOT found THEN -2 WHEN expires_at_ms = {NEVER} THEN -1 ELSE greatest(0, expires_at_ms - now_ms) END"),
    ("ks_ttl_sec", "ms BIGINT", "BIGINT", "CASE WHEN ms < 0 THEN ms ELSE ms DIV 1000 END"),
    ("ks_glob_regex", "pattern STRING", "STRING", r"concat('\\A', array_join(transform(filter(split(pattern, ''), c -> c <> ''), c -> CASE WHEN c = '*' THEN '.*' WHEN c = '?' THEN '.' WHEN instr('.()+|^$@%\\', c) > 0 THEN concat('\\', c) ELSE c END), ''), '\\z')"),
    ("ks_resp_simple", "v STRING", "STRING", f"concat('+', v, {_CRLF})"),
    ("ks_resp_error", "v STRING", "STRING", f"concat('-', v, {_CRLF})"),
    ("ks_resp_integer", "n BIGINT", "STRING", f"concat(':', CAST(n AS STRING), {_CRLF})"),
    ("ks_resp_bulk", "v STRING", "STRING", f"CASE WHEN v IS NULL THEN concat('$-1', {_CRLF}) ELSE concat('$', CAST(octet_length(v) AS STRING), {_CRLF}, v, {_CRLF}) END"),
    ("ks_file_sequence", "name STRING", "BIGINT", f"CASE WHEN name RLIKE '{_RUN}' THEN coalesce(try_cast(regexp_extract(name, '{_RUN}', 2) AS BIGINT), -1) ELSE -1 END"),
    ("ks_bloom_bits", "n BIGINT", "BIGINT", "CAST(ceil(-n * ln(0.01D) / pow(ln(2.0D), 2)) AS BIGINT)"),
)


class Decode:
    """``ks_resp_decode(bytes)``: a row ``pos, argv, error`` for each request in a byte string."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        data, at, pos = bytes(data or b""), 0, 0
        while True:
            try:
                argv, at = resp.parse_command(data, at)
            except resp.ProtocolError as e:
                yield pos, None, str(e)
                return
            if argv is None:
                return
            yield pos, argv, None
            pos += 1


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    from pyspark.sql.functions import udtf

    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("ks_resp_decode", udtf(Decode, returnType="pos bigint, argv array<string>, error string"))
    return [f[0] for f in FUNCTIONS] + ["ks_resp_decode"]
