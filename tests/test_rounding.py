"""Rounding agrees with Python's ``round``, here and in the SQL that checks it."""

import duckdb
from pyspark.sql import functions as F

from tierflow.functions.num import even
from tierflow.plans import sql


def test_even_is_pythons_round(spark):
    values = sorted({t / w for w in range(1, 201) for t in range(w * 2)} | {2.675, 4.125, 1.115, .285, .0, 1.005, 4.725})
    table = spark.createDataFrame([(v,) for v in values], "v double")
    got = table.select("v", *[even("v", d).alias(f"d{d}") for d in (2, 3, 4)]).collect()
    assert all(r[f"d{d}"] == round(r["v"], d) for r in got for d in (2, 3, 4))
    for d in (2, 3, 4):
        rows = duckdb.connect().execute(f"select v, {sql.even('v', d)} from (select unnest(?::double[]) as v)", [values]).fetchall()
        assert all(r == round(v, d) for v, r in rows)
