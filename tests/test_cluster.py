"""Queries on executors that have JVMs of their own."""

import json
import os
import subprocess
import sys

import pyspark
from conftest import ROOT

RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
query, data, shared = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
print("rows", json.dumps([list(r) for r in __spark_entry__.queries()[query](spark, data).collect()]))
spark.stop()
"""


def test_jdbc_by_other_jvms(spark, small, tmp_path):
    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    (tmp_path / "shared").mkdir()
    spark_home = os.path.dirname(pyspark.__file__)
    for name in os.listdir(spark_home):
        if name != "work":
            (home / name).symlink_to(f"{spark_home}/{name}")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", RUN, "load_jdbc", small, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    found = [line for line in out.stdout.splitlines() if line.startswith("rows ")]
    assert found, out.stderr[-2000:]
    orders = spark.read.parquet(f"{small}/orders.parquet").where("o_totalprice > 100000").groupBy("o_orderstatus").agg({"*": "count", "o_totalprice": "sum"})
    want = {r[0]: (r["count(1)"], round(r["sum(o_totalprice)"], 2)) for r in orders.collect()}
    assert {s: (n, total) for s, n, total in json.loads(found[0][5:])} == want
