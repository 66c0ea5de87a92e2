"""ohlc_checks against its SQL on prices far above 1e5, where a relative tolerance would forgive what the SQL does not."""

import duckdb

import __spark_entry__ as entry


def test_ohlc_checks_on_large_prices(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""copy (select i as l_orderkey, 1::bigint as l_partkey, 1::bigint as l_suppkey, 1 as l_linenumber, 1.0::double as l_quantity, 300000.0 + (i * 7919) % 1000 as l_extendedprice,
        'A' as l_returnflag, 'F' as l_linestatus, timestamp '1995-01-01' + interval 1 day * (i // 3) as l_shipdate from range(1200) t(i)) to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    got = entry.queries()["ohlc_checks"](spark, str(tmp_path)).select("symbol", "strict_ok", "tolerant_ok", "n").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()["ohlc_checks"]).fetchall())
