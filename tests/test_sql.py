"""The SQL forms of the functions against the column forms."""

from pyspark.sql import functions as F

from keelstone.functions import resp, sql, text


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS) + 1
    rows = [("5",), ("+07",), (" 5",), ("5\n",), ("x",), ("9" * 20,), (None,), ("a.b*?",), ("sst-000012.db",), ("L3-7.db",), ("L3-x.db",), ("(a)+|^$@%\\b",), ("é😀",), ("",)]
    df = spark.createDataFrame(rows, "v string")
    df.createOrReplaceTempView("t")
    v = F.col("v")
    pairs = {"ks_parse_long": text.parse_long(v), "ks_glob_regex": text.glob_regex(v), "ks_resp_bulk": resp.bulk(v), "ks_resp_simple": resp.simple(v), "ks_resp_error": resp.error(v), "ks_file_sequence": text.file_sequence(v)}
    for name, column in pairs.items():
        got = [r[0] for r in spark.sql(f"SELECT {name}(v) FROM t").collect()]
        want = [r[0] for r in df.select(column).collect()]
        assert got[:6] + got[7:] == want[:6] + want[7:], name
    n = spark.sql("SELECT ks_ttl_ms(true, 50, 20), ks_ttl_ms(false, 50, 20), ks_ttl_ms(true, 9223372036854775807, 20), ks_ttl_ms(true, 10, 20), ks_ttl_sec(1999), ks_ttl_sec(-2), ks_bloom_bits(1000), ks_live('PUT', 5, 5), ks_resp_integer(-3)").first()
    assert tuple(n) == (30, -2, -1, 0, 1, -2, 9586, False, ":-3\r\n")
    out = spark.sql("SELECT pos, argv FROM ks_resp_decode(CAST('*1\\r\\n$4\\r\\nPING\\r\\nGET k\\r\\n' AS BINARY)) ORDER BY pos").collect()
    assert [(r["pos"], r["argv"]) for r in out] == [(0, ["PING"]), (1, ["GET", "k"])]
