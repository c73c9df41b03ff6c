"""Compare Spark result types with the DuckDB oracle's types for every registered query."""
import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from stockspark.plans.catalog import load_all  # noqa: E402
from stockspark.session import build_session  # noqa: E402

MAP = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
       T.BooleanType: "BOOLEAN", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
       T.DateType: "DATE", T.ShortType: "SMALLINT", T.FloatType: "FLOAT"}
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = build_session("local[4]")
con = duckdb.connect()
for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
bad = 0
for name, (fn, sql) in load_all().items():
    if not sql:
        continue
    sch = {f.name: f.dataType for f in fn(spark, sf).schema.fields}
    rel = con.sql(sql)
    o = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for c, dt in sch.items():
        want = MAP.get(type(dt), type(dt).__name__)
        got = o.get(c)
        if isinstance(dt, T.DecimalType):
            want = "DECIMAL"
            got = (got or "").split("(")[0]
        if got != want:
            bad += 1
            print(f"{name}.{c}: spark {dt.simpleString()} duckdb {o.get(c)}")
print("mismatches", bad)
