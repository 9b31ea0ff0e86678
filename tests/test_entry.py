import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and "woe" in rows[0].asDict()


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_import_without_the_training_data_package():
    code = "import sys; sys.modules['riskloom.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_stream(spark, tmp_path):
    import pandas as pd

    from riskloom.operators.binning import BinRule, cube
    from riskloom.streaming.drift import watch

    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10"] * 50 + ["2024-01-01 05:00"]), "x": [0.2] * 25 + [0.8] * 25 + [0.1]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    rules = {"x": BinRule("x", True, cuts=[0.5])}
    base = cube(spark.createDataFrame(pd.DataFrame({"x": [0.2, 0.8]})), rules)
    found = []
    stream = spark.readStream.schema("ts timestamp, x double").parquet(str(tmp_path / "in"))
    q = watch(stream, rules, "ts", base, lambda df, k: found.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert any(abs(r["psi"]) < 1e-9 for r in found)
