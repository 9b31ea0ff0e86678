"""Registered queries over the driver's tables and the DuckDB SQL that they must equal.

Numbers are rounded to 6 places on both sides. ``credit`` is lineitem with a target, periods,
weights and a sample label; ``price`` there is l_extendedprice with NULL and -999 put in;
``scored`` adds a noisy score; ``ev`` is events with values missing.
"""

from __future__ import annotations

import pickle
import re
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .operators import binning as B, cleaning as C, features as X, metrics as M, models as L, profiling as P, risk as K, scorecard as S, splits as D, stability as Y
from .functions import basics, quantiles as Q
from .sources import tables as IO
from .sources.shared import names_in, put_bytes, put_file, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{f.name}`"), n) + 0.0).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def credit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    price = F.when(F.col("l_orderkey") % 17 == 0, None).when(F.col("l_orderkey") % 13 == 0, -999.0).otherwise(F.col("l_extendedprice"))
    return t.select(
        "l_orderkey", "l_linenumber", *FEATURES, "l_returnflag", "l_linestatus", "l_shipdate",
        (F.col("l_quantity") * F.col("l_discount") > 1.5).cast("int").alias("y"), F.year("l_shipdate").alias("period"), (F.lit(1.0) + F.col("l_linenumber")).alias("w"),
        F.when(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp"), "dev").otherwise("oot").alias("sample"), price.alias("price"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    return credit(spark, d).withColumn("score", (F.col("l_quantity") * F.col("l_discount") + (F.col("l_orderkey") % 11) * F.lit(0.5)) / F.lit(10.0))


def ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))


CREDIT = """credit as (
  select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
    case when l_quantity * l_discount > 1.5 then 1 else 0 end as y, year(l_shipdate)::int as period, (1.0 + l_linenumber)::double as w,
    case when l_shipdate < timestamp '2000-01-01' then 'dev' else 'oot' end as sample,
    case when l_orderkey % 17 = 0 then null when l_orderkey % 13 = 0 then -999.0::double else l_extendedprice end as price,
    (l_quantity * l_discount + (l_orderkey % 11) * 0.5::double) / 10.0::double as score
  from lineitem)"""
EV = "ev as (select event_id, ts, user_id, event_type, case when event_id % 5 <> 0 then value end as value, props from events)"


def cuts_sql(x: str, n: int, view: str = "credit", where: str = "true") -> str:
    return f"(select quantile_cont({x}, [{', '.join(f'{k}::double/{n}' for k in range(1, n))}]) as q from {view} where {where})"


def case_sql(x: str, n: int, q: str = "q", special: str = "") -> str:
    return f"case when {x} is null then -1 {special} " + " ".join(f"when {x} < {q}[{k}] then {k - 1}" for k in range(1, n)) + f" else {n - 1} end"


def woe_sql(sums: str, by: str = "") -> str:
    """sums: a query with (by,) bin_idx, n, w, bad. Gives them with good, bad_rate, woe, iv."""
    over = f"over (partition by {by})" if by else "over ()"
    return f"""select *, ln(pb / pg) as woe, (pb - pg) * ln(pb / pg) as iv from (
      select *, w - bad as good, bad / w as bad_rate, sum(bad) {over} as tb, sum(w - bad) {over} as tg, 0.5::double * sum(w) {over} / sum(n) {over} as s,
        (bad + s) / (tb + 2 * s) as pb, (w - bad + s) / (tg + 2 * s) as pg from ({sums}))"""


def long_sql(n: int = 5, features: list[str] = FEATURES, w: str = "1.0::double", more: str = "", view: str = "credit") -> str:
    """feature, bin_idx and sums for several features."""
    keys = f"{more}, " if more else ""
    return " union all ".join(f"select '{f}' as feature, {keys}{case_sql(f, n)} as bin_idx, count(*)::double as n, sum({w}) as w, sum({w} * y) as bad from {view}, {cuts_sql(f, n, view)} group by all" for f in features)


# sources


@query("select l_orderkey, l_quantity from lineitem")
def load_parquet(spark, d):
    return IO.load_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("select o_orderkey, o_totalprice from orders")
def load_data_dispatch(spark, d):
    return IO.load_data(spark, {"type": "parquet", "path": f"{d}/orders.parquet", "columns": ["o_orderkey", "o_totalprice"]})


@query("select c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean from customer group by c_mktsegment")
def load_sql(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer_q")
    return rounded(IO.load_data(spark, {"type": "sql", "query": "select c_mktsegment, count(*) as n, avg(c_acctbal) as mean from customer_q group by c_mktsegment"}))


def _spilled(spark, df: DataFrame, name: str, kind: str | None = None) -> str:
    """A table written for a reader to read back."""
    return IO.save_dataframe(df, shared_path(spark, name), kind)


@query("select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus end as o_orderstatus, o_totalprice from orders")
def load_csv(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    df = df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("n/a"))
    return IO.load_csv(spark, _spilled(spark, df, "orders.csv"), ["o_orderkey", "o_orderstatus", "o_totalprice"], null_values=["n/a"], schema="o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")


DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def _database(spark: SparkSession, df: DataFrame, name: str, columns: str) -> str:
    """The JDBC url of a table in a Derby database that all JVMs can read: it is sealed in an archive in the shared folder.

    Executors write the rows as text there. A database that may be written belongs to one process,
    the driver's JVM: it imports that text file by file, through pages of at most 4 MB.
    """
    text, sealed = shared_path(spark, "text"), shared_path(spark, "database.jar")
    df.write.option("escape", '"').csv(text)
    sql, local = spark._jvm.java.sql.DriverManager, lambda p: re.sub("^file:(//)?", "", p)
    spark._jvm.java.lang.Class.forName(DERBY)
    with tempfile.TemporaryDirectory() as here:
        link = sql.getConnection(f"jdbc:derby:{here}/db;create=true")
        do = link.createStatement()
        do.execute(f"create table {name} ({columns})")
        for part in names_in(text):
            if part.endswith(".csv"):
                do.execute(f"call syscs_util.syscs_import_table(null, '{name.upper()}', '{local(text)}/{part}', null, null, 'UTF-8', 0)")
        link.close()
        try:
            sql.getConnection(f"jdbc:derby:{here}/db;shutdown=true")
        except Py4JJavaError:  # so Derby says that it has
            pass
        with zipfile.ZipFile(f"{here}/it.jar", "w", zipfile.ZIP_STORED) as jar:  # pages are found by place, so they are not compressed
            for path in sorted(Path(f"{here}/db").rglob("*")):
                if path.name not in ("db.lck", "dbex.lck"):
                    jar.write(path, path.relative_to(here))
        put_file(f"{here}/it.jar", sealed)
    return f"jdbc:derby:jar:({local(sealed)})db"


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 100000 group by o_orderstatus")
def load_jdbc(spark, d):
    """Orders in a database, read back in eight ranges of their keys with the filter pushed down."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    url = _database(spark, orders, "orders_q", '"o_orderkey" bigint, "o_orderstatus" varchar(8), "o_totalprice" double')
    found = IO.load_jdbc(spark, 'select * from orders_q', url, '"o_orderkey"', driver=DERBY)
    return rounded(found.where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("select s_suppkey, s_name from supplier")
def load_csv_skip_rows(spark, d):
    rows = table(spark, d, "supplier").select(F.concat_ws(";", "s_suppkey", "s_name").alias("value"))
    head = spark.createDataFrame([(0, "made by hand"), (1, "two lines"), (2, "s_suppkey;s_name")], "k int, value string")
    path = shared_path(spark, "supplier.csv")
    head.unionByName(rows.withColumn("k", F.lit(3))).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return IO.load_csv(spark, path, skip_rows=2, separator=";").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("select c_custkey, c_mktsegment, c_acctbal from customer")
def load_dataframe(spark, d):
    """Written as json, orc and parquet, a third each, and read back."""
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    parts = [IO.load_dataframe(spark, _spilled(spark, df.where(F.col("c_custkey") % 3 == k), f"customer.{kind}")).select(*df.columns) for k, kind in enumerate(("json", "orc", "parquet"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select n_nationkey::double as n_nationkey, n_name from nation")
def load_excel(spark, d):
    path = shared_path(spark, "nation.xlsx")
    return IO.load_excel(spark, IO.write_xlsx({"regions": table(spark, d, "region"), "nations": table(spark, d, "nation").select("n_nationkey", "n_name")}, path), sheet_name="nations").select(F.col("n_nationkey").cast("double").alias("n_nationkey"), "n_name")


@query("select o_orderkey, o_orderstatus, o_totalprice, o_orderdate::date::varchar as o_orderdate, (o_orderdate::timestamp + to_seconds(o_orderkey % 86399 + 1))::varchar as placed from orders")
def workbooks_by_status(spark, d):
    """A folder of workbooks, each of one status, read as one table with its dates and times."""
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.expr("timestampadd(second, o_orderkey % 86399 + 1, o_orderdate)").cast("timestamp_ntz").alias("placed"))
    folder = IO.write_workbooks(df, shared_path(spark, "workbooks"), "orders", "o_orderstatus")
    # days and times as their text, which tells a date from a timestamp
    return IO.load_excel(spark, folder, sheet_name="orders").withColumns({c: F.col(c).cast("string") for c in ("o_orderdate", "placed")})


@query("select r_regionkey, r_name from region")
def load_pickle(spark, d):
    path = shared_path(spark, "region.pkl")
    put_bytes(pickle.dumps(table(spark, d, "region").select("r_regionkey", "r_name").toPandas()), path)
    return IO.load_pickle(spark, path).select(F.col("r_regionkey").cast("int").alias("r_regionkey") if dict(table(spark, d, "region").dtypes)["r_regionkey"] == "int" else "r_regionkey", "r_name")


# cleaning and scaling


@query(f"with {CREDIT} select l_orderkey, l_linenumber, case when price <> -999 then price end as price from credit")
def null_sentinel(spark, d):
    return C.null_values(credit(spark, d), [-999.0], ["price"]).select("l_orderkey", "l_linenumber", "price")


@query(f"with {CREDIT} select l_orderkey, l_linenumber, coalesce(price, 7.5) as price from credit")
def fill_value(spark, d):
    return C.clean_data(credit(spark, d).select("l_orderkey", "l_linenumber", "price"), fill=7.5, columns=["price"])


@query(f"with {EV} select event_id, round(last_value(value ignore nulls) over (order by event_id rows unbounded preceding), 6) as value from ev")
def ffill(spark, d):
    return rounded(C.clean_data(ev(spark, d).select("event_id", "value"), "forward", order=["event_id"]))


@query(f"with {EV} select event_id, round(first_value(value ignore nulls) over (order by event_id rows between current row and unbounded following), 6) as value from ev")
def bfill(spark, d):
    return rounded(C.clean_data(ev(spark, d).select("event_id", "value"), "backward", order=["event_id"]))


@query(f"with {CREDIT}, m as (select avg(price) as m from credit) select l_orderkey, l_linenumber, round(coalesce(price, m), 6) as price from credit, m")
def fill_mean(spark, d):
    return rounded(C.clean_data(credit(spark, d).select("l_orderkey", "l_linenumber", "price"), "mean", columns=["price"]))


@query(f"with {CREDIT}, m as (select quantile_cont(price, 0.5::double) as m from credit) select l_orderkey, l_linenumber, round(coalesce(price, m), 6) as price from credit, m")
def fill_median(spark, d):
    return rounded(C.clean_data(credit(spark, d).select("l_orderkey", "l_linenumber", "price"), "median", columns=["price"]))


@query(f"with {CREDIT} select l_orderkey, l_linenumber, coalesce(price, 0) as price from credit")
def fill_zero(spark, d):
    return C.clean_data(credit(spark, d).select("l_orderkey", "l_linenumber", "price"), "zero", columns=["price"])


@query(f"with {CREDIT} select l_orderkey, l_linenumber, price from credit where price is not null")
def drop_nulls(spark, d):
    return C.clean_data(credit(spark, d).select("l_orderkey", "l_linenumber", "price"), "drop")


def _scale_sql(expr: str) -> str:
    return f"with {CREDIT}, s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as sd, quantile_cont(l_extendedprice, [0.25::double, 0.5, 0.75]) as q, quantile_cont(l_extendedprice, [0.01::double, 0.99]) as p from credit) select l_orderkey, l_linenumber, round({expr}, 6) as l_extendedprice from credit, s"


def _scaled(spark, d, method, clip=False):
    return rounded(C.normalize_data(credit(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], method, clip))


@query(_scale_sql("(l_extendedprice - lo) / (hi - lo + 1e-10)"))
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query(_scale_sql("(l_extendedprice - m) / (sd + 1e-10)"))
def scale_zscore(spark, d):
    return _scaled(spark, d, "zscore")


@query(_scale_sql("(l_extendedprice - q[2]) / (q[3] - q[1])"))
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query(_scale_sql("least(greatest(l_extendedprice, p[1]), p[2])"))
def clip_outliers(spark, d):
    return rounded(C.clip_outliers(credit(spark, d).select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"]))


@query(f"with {CREDIT}, m as (select quantile_cont(price, 0.5::double) as m from credit where price <> -999), c as (select l_orderkey, l_linenumber, coalesce(case when price <> -999 then price end, 0) as price from credit), s as (select min(price) as lo, max(price) as hi from c) select l_orderkey, round((price - lo) / (hi - lo + 1e-10), 6) as price from c, s")
def preprocess_data(spark, d):
    out = C.preprocess_data(credit(spark, d), keep=["price", "l_orderkey"], strategy="zero", custom_null_values=[-999.0])
    return rounded(C.normalize_data(out, ["price"], "minmax").select("l_orderkey", "price"))


@query(f"with {CREDIT} select avg(price) as mean, stddev_samp(price) as std, min(price) as min, max(price) as max, quantile_cont(price, 0.5::double) as median, quantile_cont(price, 0.25::double) as q25, quantile_cont(price, 0.75::double) as q75 from credit where price <> -999".replace("avg(price)", "round(avg(price), 6)").replace("stddev_samp(price)", "round(stddev_samp(price), 6)").replace("quantile_cont(price, 0.5::double)", "round(quantile_cont(price, 0.5::double), 6)").replace("quantile_cont(price, 0.25::double)", "round(quantile_cont(price, 0.25::double), 6)").replace("quantile_cont(price, 0.75::double)", "round(quantile_cont(price, 0.75::double), 6)"))
def preprocessor_fit(spark, d):
    p = C.Preprocessor(special_values=[-999.0]).fit(credit(spark, d), columns=["price"])
    s = p.stats["price"]
    return rounded(spark.createDataFrame([tuple(float(s[k]) for k in ("mean", "std", "min", "max", "median", "q25", "q75"))], "mean double, std double, min double, max double, median double, q25 double, q75 double"))


def weighted_cuts_sql(x: str, qs: list[str], w: str = "w", view: str = "credit", where: str = "true") -> str:
    """Weighted quantiles as a list q, at (running weight - weight / 2) / total, rows in order of value and weight."""
    return f"""(with z as (select {x} as x, {w} as w from {view} where {x} is not null and {where}), p as (select x, (sum(w) over (order by x, w rows unbounded preceding) - w / 2) / sum(w) over () as p from z),
      n as (select x, p, lead(p) over o as p1, lead(x) over o as x1 from p window o as (order by p)), t as (select unnest([{', '.join(qs)}]) as t, unnest(range({len(qs)})) as k)
      select list(x + (x1 - x) * (t - p) / (p1 - p) order by k) as q from n, t where p <= t and t < p1)"""


@query(f"with {CREDIT}, q as {weighted_cuts_sql('price', ['0.5::double'], where='price <> -999')} select round(sum(w * price) / sum(w), 6) as mean, round(sqrt(sum(w * price * price) / sum(w) - (sum(w * price) / sum(w)) ** 2), 4) as std, round(any_value(q[1]), 4) as median, min(price) as min, max(price) as max from credit, q where price is not null and price <> -999")
def preprocessor_fit_weighted(spark, d):
    s = C.Preprocessor(special_values=[-999.0]).fit(credit(spark, d), columns=["price"], weight="w").stats["price"]
    return spark.createDataFrame([(round(s["mean"], 6), round(s["std"], 4), round(s["median"], 4), s["min"], s["max"])], "mean double, std double, median double, min double, max double")


@query(f"with {CREDIT}, s as (select quantile_cont(price, 0.5::double) as m, avg(price) as mean, stddev_samp(price) as sd from credit where sample = 'dev' and price <> -999) select l_orderkey, l_linenumber, round((coalesce(case when price <> -999 then price end, m) - mean) / (sd + 1e-10), 6) as price from credit, s")
def preprocessor_transform(spark, d):
    df = credit(spark, d)
    p = C.Preprocessor("median", "zscore", [-999.0]).fit(df.where("sample = 'dev'"), columns=["price"])
    return rounded(p.transform(df).select("l_orderkey", "l_linenumber", "price"))


# splits


@query("select event_id, row_number() over (order by event_id) > count(*) over () - (count(*) over () * 0.2::double)::bigint as test from events".replace("(count(*) over () * 0.2::double)::bigint", "floor(count(*) over () * 0.2::double)"))
def train_test_tail(spark, d):
    a, b = D.train_test_split(table(spark, d, "events").select("event_id"), ["event_id"], 0.2, shuffle=False)
    return a.withColumn("test", F.lit(False)).unionByName(b.withColumn("test", F.lit(True)))


@query("select count(*) - floor(count(*) * 0.2::double)::bigint as n_train, floor(count(*) * 0.2::double)::bigint as n_test, 0::bigint as n_both from events")
def train_test_hashed(spark, d):
    a, b = D.train_test_split(table(spark, d, "events"), ["event_id"], 0.2)
    return a.agg(F.count(F.lit(1)).alias("n_train")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_test"))).crossJoin(a.join(b, "event_id").agg(F.count(F.lit(1)).alias("n_both")))


@query("select event_type, count(*) as n, round_even(count(*) * 0.2::double, 0)::bigint as n_test from events group by event_type")
def stratified_split(spark, d):
    a, b = D.stratified_split(table(spark, d, "events"), "event_type", ["event_id"])
    each = a.select("event_type", F.lit(0).alias("t")).unionByName(b.select("event_type", F.lit(1).alias("t")))
    return each.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("n_test"))


@query("with o as (select event_id, row_number() over (order by ts, event_id) as k, count(*) over () as n from events) select event_id, case when k <= n - floor(n * 0.2::double) - 100 then 'train' when k > n - floor(n * 0.2::double) then 'test' end as part from o where k <= n - floor(n * 0.2::double) - 100 or k > n - floor(n * 0.2::double)")
def time_series_split(spark, d):
    a, b = D.time_series_split(table(spark, d, "events").select("event_id", "ts"), "ts", ["event_id"], 0.2, 100)
    return a.select("event_id", F.lit("train").alias("part")).unionByName(b.select("event_id", F.lit("test").alias("part")))


@query("select event_id, (ntile(5) over (order by event_id) - 1)::int as fold from events")
def kfold(spark, d):
    return D.kfold(table(spark, d, "events").select("event_id"), 5, ["event_id"])


@query(f"with {CREDIT} select sample, count(*) as n, sum(y)::bigint as bad from credit group by sample")
def dev_oot_label(spark, d):
    s = D.split_dev_oot(credit(spark, d), sample="sample")
    return s.dev.unionByName(s.oot).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))


@query(f"with {CREDIT} select l_shipdate < timestamp '2000-01-01' as dev, count(*) as n, sum(y)::bigint as bad from credit group by all")
def dev_oot_date(spark, d):
    s = D.split_dev_oot(credit(spark, d), date="l_shipdate", oot_start="2000-01-01")
    return s.dev.withColumn("dev", F.lit(True)).unionByName(s.oot.withColumn("dev", F.lit(False))).groupBy("dev").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))


@query(f"with {CREDIT} select y, count(*) as n, round_even(count(*) * 0.3::double, 0)::bigint as n_oot from credit group by y")
def dev_oot_random(spark, d):
    s = D.split_dev_oot(credit(spark, d), target="y", key=["l_orderkey", "l_linenumber"], test_size=0.3).validate("y")
    return s.dev.select("y", F.lit(0).alias("o")).unionByName(s.oot.select("y", F.lit(1).alias("o"))).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("n_oot"))


@query(f"with {CREDIT}, f as (select y, (ntile(5) over (partition by y order by l_orderkey, l_linenumber) - 1)::int as fold from credit) select fold, y, count(*) as n_test, sum(count(*)) over (partition by y)::bigint - count(*) as n_train from f group by fold, y")
def cv_folds(spark, d):
    out = None
    for k, (train, test) in enumerate(D.cv_splits(credit(spark, d), 5, "stratified", "y", ["l_orderkey", "l_linenumber"])):
        each = test.groupBy("y").agg(F.count(F.lit(1)).alias("n_test")).join(train.groupBy("y").agg(F.count(F.lit(1)).alias("n_train")), "y").select(F.lit(k).alias("fold"), "y", "n_test", "n_train")
        out = each if out is None else out.unionByName(each)
    return out


@query("with o as (select event_id, ntile(4) over (order by ts, event_id) as part from events) select part - 1 as fold, count(*) as n_test, sum(count(*)) over (order by part) ::bigint - count(*) as n_train, min(event_id) as first from o group by part".replace("select part - 1 as fold", "select (part - 2)::int as fold").replace(" from o group by part", " from o group by part qualify part > 1"))
def cv_folds_in_time(spark, d):
    out = None
    for k, (train, test) in enumerate(D.cv_splits(table(spark, d, "events").select("event_id", "ts"), 3, "timeseries", key=["event_id"], date="ts")):
        each = test.agg(F.count(F.lit(1)).alias("n_test"), F.min("event_id").alias("first")).crossJoin(F.broadcast(train.agg(F.count(F.lit(1)).alias("n_train")))).select(F.lit(k).alias("fold"), "n_test", "n_train", "first")  # one row each
        out = each if out is None else out.unionByName(each)
    return out


# statistics


@query("""with e as (select value as x, (1 + user_id % 7)::double as w, event_id from events),
  p as (select x, (sum(w) over (order by x, w, event_id rows unbounded preceding) - w / 2) / sum(w) over () as p, w, event_id from e),
  n as (select *, lead(p) over (order by x, w, event_id) as p1, lead(x) over (order by x, w, event_id) as x1 from p),
  q as (select unnest([0.1::double, 0.25, 0.5, 0.9]) as q)
  select q, round(x + (x1 - x) * (q - p) / (p1 - p), 6) as value from q join n on p <= q and q < p1""")
def weighted_quantile(spark, d):
    rows = table(spark, d, "events").withColumn("w", (1 + F.col("user_id") % 7).cast("double"))
    qs = [0.1, 0.25, 0.5, 0.9]
    return rounded(spark.createDataFrame(list(zip(qs, Q.weighted_quantiles(rows, "value", "w", qs, ("event_id",)), strict=True)), "q double, value double"))


@query("with q as (select quantile_cont(value, [0.05::double, 0.5, 0.95]) as v from events) select unnest([0.05::double, 0.5, 0.95]) as q, round(unnest(v), 6) as value from q")
def exact_quantiles(spark, d):
    qs = [0.05, 0.5, 0.95]
    return rounded(spark.createDataFrame(list(zip(qs, Q.exact_quantiles(table(spark, d, "events"), {"v": F.col("value")}, qs)["v"], strict=True)), "q double, value double"))


@query(f"with {CREDIT} select l_returnflag, round(sum(w * price) filter (price is not null) / sum(w) filter (price is not null), 6) as mean from credit group by l_returnflag")
def weighted_mean(spark, d):
    return rounded(credit(spark, d).groupBy("l_returnflag").agg(basics.weighted_mean(F.col("price"), F.col("w")).alias("mean")))


@query(f"with {CREDIT}, c as ({long_sql(5, FEATURES[:2], 'w', 'period')}) select feature, period as \"group\", bin_idx, round(w / sum(w) over (partition by feature, period), 6) as pct from c")
def bin_distribution(spark, d):
    df = credit(spark, d)
    b = B.WoeBinner(5).fit(df, features=FEATURES[:2])
    return rounded(Y.bin_distribution(B.cube(df, b.rules, "y", "w", "period"), ["feature", "group"]).select("feature", "group", "bin_idx", "pct"))


# binning


def _binned_sql(n: int = 5, cuts: str | None = None) -> str:
    cuts = cuts or cuts_sql("l_extendedprice", n)
    return f"""with {CREDIT}, b as (select {case_sql("l_extendedprice", n)} as bin_idx, y from credit, {cuts}),
      g as (select bin_idx, count(*) as count, sum(y)::double as bad, sum(1 - y)::double as good from b group by bin_idx),
      t as (select *, (bad + 0.5) / (sum(bad) over () + 1) as pb, (good + 0.5) / (sum(good) over () + 1) as pg from g)
      select bin_idx, count, bad, good, round(bad / count, 6) as bad_rate, round(ln(pb / pg), 6) as woe, round((pb - pg) * ln(pb / pg), 6) as iv, round(sum((pb - pg) * ln(pb / pg)) over (), 6) as total_iv from t"""


@query(_binned_sql())
def binning_with_woe(spark, d):
    return rounded(B.binning_with_woe(credit(spark, d), "l_extendedprice", "y"))


@query(_binned_sql(5, "(select list_transform([1, 2, 3, 4], lambda k: min + (max - min) / 5 * k) as q from (select min(l_extendedprice) as min, max(l_extendedprice) as max from credit))"))
def woe_uniform(spark, d):
    return rounded(B.binning_with_woe(credit(spark, d), "l_extendedprice", "y", method="uniform"))


def _table_sql(sums: str, columns: str = "feature, bin_idx, n::bigint as n, round(w, 6) as w, round(bad, 6) as bad, round(good, 6) as good, round(bad_rate, 6) as bad_rate, round(woe, 6) as woe, round(iv, 6) as iv") -> str:
    return f"with {CREDIT}, c as ({sums}), t as ({woe_sql('select * from c', 'feature')}) select {columns} from t"


TABLE = ["feature", "bin_idx", "n", "w", "bad", "good", "bad_rate", "woe", "iv"]


def _woe(df: DataFrame, binner: B.WoeBinner, weight: str | None = None) -> DataFrame:
    """What a binner learned, or from its rules if it was read back."""
    if binner.sums:
        return binner.table(df)
    return B.woe_table(B.cube(df, binner.rules, "y", weight), binner.smoothing)


@query(_table_sql(long_sql()))
def woe_quantile(spark, d):
    df = credit(spark, d)
    return rounded(_woe(df, B.WoeBinner(5).fit(df, features=FEATURES, target="y")).select(*TABLE))


@query(_table_sql(f"select 'price' as feature, {case_sql('price', 5, special='when price = -999 then -3')} as bin_idx, count(*)::double as n, count(*)::double as w, sum(y)::double as bad from credit, {cuts_sql('price', 5, 'credit', 'price <> -999')} group by all"))
def woe_special_missing(spark, d):
    df = credit(spark, d)
    return rounded(_woe(df, B.WoeBinner(5, special_values=[-999.0]).fit(df, features=["price"], target="y")).select(*TABLE))


@query(_table_sql(f"select 'price' as feature, {case_sql('price', 5, special='when price = -999 then -1')} as bin_idx, count(*)::double as n, count(*)::double as w, sum(y)::double as bad from credit, {cuts_sql('price', 5, 'credit', 'price <> -999')} group by all"))
def woe_missing_values(spark, d):
    df = credit(spark, d)
    return rounded(_woe(df, B.WoeBinner(5, missing_values=[-999.0]).fit(df, features=["price"], target="y")).select(*TABLE))


@query(_table_sql("select 'l_returnflag' as feature, k as bin_idx, n::double as n, n::double as w, bad from (select (row_number() over (order by count(*) desc, l_returnflag) - 1)::int as k, count(*) as n, sum(y)::double as bad from credit group by l_returnflag)"))
def woe_categorical(spark, d):
    df = credit(spark, d)
    return rounded(_woe(df, B.WoeBinner().fit(df, features=["l_returnflag"], target="y")).select(*TABLE))


@query(_table_sql("select 'l_tax' as feature, case when l_tax < 0.03 then 0 when l_tax < 0.06 then 1 else 2 end as bin_idx, count(*)::double as n, sum(w) as w, sum(w * y) as bad from credit group by all"))
def woe_weighted(spark, d):
    rule = {"l_tax": B.BinRule("l_tax", True, cuts=[0.03, 0.06])}
    return rounded(B.woe_table(B.cube(credit(spark, d), rule, "y", "w")).select(*TABLE))


@query(_table_sql(f"select 'l_extendedprice' as feature, {case_sql('l_extendedprice', 5)} as bin_idx, count(*)::double as n, sum(w) as w, sum(w * y) as bad from credit, {weighted_cuts_sql('l_extendedprice', [f'{k}::double/5' for k in range(1, 5)])} group by all"))
def woe_weighted_quantile(spark, d):
    df = credit(spark, d)
    return rounded(_woe(df, B.WoeBinner(5).fit(df, features=["l_extendedprice"], target="y", weight="w"), "w").select(*TABLE))


@query(_table_sql(long_sql()))
def binning_round_trip(spark, d):
    """Rules written as JSON and read back."""
    df = credit(spark, d)
    path = shared_path(spark, "binning.json")
    IO.save_binning(B.WoeBinner(5).fit(df, features=FEATURES, target="y"), path)
    return rounded(_woe(df, IO.load_binning(path)).select(*TABLE))


@query(_table_sql(long_sql(), "feature, bin_idx, round(woe, 6) as woe"))
def woe_mapping(spark, d):
    """The WOE of each bin, written as JSON and read back."""
    path = shared_path(spark, "woe.json")
    IO.save_woe_mapping(B.WoeBinner(5).fit(credit(spark, d), features=FEATURES, target="y"), path)
    return rounded(spark.createDataFrame([(f, k, v) for f, found in IO.load_woe_mapping(path).items() for k, v in found.items()], "feature string, bin_idx int, woe double"))


@query(f"with {CREDIT} " + " union all ".join(f"select * from (select '{f}' as feature, case when min({x}) is null then 'no valid values' when min({x}) = max({x}) then 'constant' end as failure from credit) where failure is not null" for f, x in (("l_tax", "l_tax"), ("flat", "7"), ("hollow", "case when l_tax > 99 then 1 end"), ("sentinel", "case when price <> -999 and l_tax > 99 then price end"))))
def binning_failures(spark, d):
    df = credit(spark, d).withColumns({"flat": F.lit(7), "hollow": F.when(F.col("l_tax") > 99, 1.0), "sentinel": F.when(F.col("l_tax") > -1, -999.0)})
    b = B.WoeBinner(5, special_values=[-999.0]).fit(df, features=["l_tax", "flat", "hollow", "sentinel"], target="y")
    return spark.createDataFrame(list(b.failures.items()), "feature string, failure string")


@query(f"with {CREDIT} select l_orderkey, l_linenumber, {case_sql('l_quantity', 5)} as l_quantity_bin, {case_sql('l_tax', 5, 'q2')} as l_tax_bin from credit, {cuts_sql('l_quantity', 5)}, (select q as q2 from {cuts_sql('l_tax', 5)})")
def index_transform(spark, d):
    df = credit(spark, d)
    b = B.WoeBinner(5).fit(df, features=["l_quantity", "l_tax"], target="y")
    return b.transform(df).select("l_orderkey", "l_linenumber", "l_quantity_bin", "l_tax_bin")


@query(f"with {CREDIT}, c as ({long_sql(5, ['l_quantity'])}), t as ({woe_sql('select * from c', 'feature')}), b as (select l_orderkey, l_linenumber, {case_sql('l_quantity', 5)} as bin_idx from credit, {cuts_sql('l_quantity', 5)}) select l_orderkey, l_linenumber, round(woe, 6) as woe from b join t using (bin_idx)")
def woe_transform(spark, d):
    df = credit(spark, d)
    b = B.WoeBinner(5).fit(df, features=["l_quantity"], target="y")
    return rounded(b.transform(df, return_type="woe").select("l_orderkey", "l_linenumber", F.col("l_quantity_bin").alias("woe")))


@query(f"with {CREDIT}, m as (select l_returnflag, (row_number() over (order by count(*) desc, l_returnflag) - 1) as k from credit group by l_returnflag) select l_orderkey, l_linenumber, printf('%02d_', k::int) || l_returnflag as label from credit join m using (l_returnflag)")
def label_transform(spark, d):
    df = credit(spark, d)
    b = B.WoeBinner().fit(df, features=["l_returnflag"], target="y")
    return b.transform(df, return_type="label").select("l_orderkey", "l_linenumber", F.col("l_returnflag_bin").alias("label"))


INTERPRET = "case when {0} < 0.02 then 'unpredictive' when {0} < 0.1 then 'weak' when {0} < 0.3 then 'medium' when {0} < 0.5 then 'strong' else 'suspicious' end"


@query(_table_sql(long_sql(), f"feature, round(sum(iv), 6) as total_iv, {INTERPRET.format('sum(iv)')} as interpretation") + " group by feature")
def iv_report(spark, d):
    df = credit(spark, d)
    return rounded(B.iv_report(_woe(df, B.WoeBinner(5).fit(df, features=FEATURES, target="y"))))


@query(_table_sql(long_sql(w="w"), "feature, bin_idx, round(w, 6) as count, round(bad, 6) as bad, round(good, 6) as good, round(bad_rate, 6) as bad_rate, round(bad / tb, 6) as dist_bad, round(good / tg, 6) as dist_good, round(woe, 6) as woe, round((bad / tb - good / tg) * woe, 6) as iv"))
def bin_stats(spark, d):
    df = credit(spark, d)
    return rounded(B.WoeBinner(5).fit(df, features=FEATURES, target="y").stats(df, "y", "w"))


@query(f"with {CREDIT}, c as ({long_sql()}), u as (select feature, abs(sum(bad) over w / sum(bad) over (partition by feature) - sum(w - bad) over w / sum(w - bad) over (partition by feature)) as gap from c window w as (partition by feature order by bin_idx rows unbounded preceding)) select feature, round(max(gap), 6) as ks from u group by feature")
def binned_ks(spark, d):
    df = credit(spark, d)
    return rounded(B.binned_ks(_woe(df, B.WoeBinner(5).fit(df, features=FEATURES, target="y"))))


@query(_table_sql(long_sql(), "*") .replace("select * from t", "select feature, bool_and(coalesce(d >= 0, true)) or bool_and(coalesce(d <= 0, true)) as monotonic_woe from (select feature, woe - lag(woe) over (partition by feature order by bin_idx) as d from t where bin_idx >= 0) group by feature"))
def is_monotonic(spark, d):
    df = credit(spark, d)
    return B.monotonic(_woe(df, B.WoeBinner(5).fit(df, features=FEATURES, target="y")))


@query("select o_orderpriority as value, count(*) as n, case when count(*) < 2990 then -2 else (row_number() over (order by count(*) desc, o_orderpriority) - 1) end::int as bin_idx from orders group by o_orderpriority")
def category_mapping(spark, d):
    return B.category_mapping(table(spark, d, "orders"), "o_orderpriority", 2990)


def tree_sql(features: list[str], leaves: int, least: int) -> str:
    """feature, q: cuts of a tree that splits the leaf of greatest Gini gain first, one step a table."""
    impurity = lambda n, b: f"({n} - ({b} * {b} + ({n} - {b}) * ({n} - {b})) / {n})"
    steps = ["""d as (select feature, x, sum(n) over o as cn, sum(bad) over o as cb, lead(x) over o as next from v window o as (partition by feature order by x rows unbounded preceding)),
      l0 as (select feature, 0.0::double as a, 0.0::double as ab, max(cn)::double as b, arg_max(cb, cn)::double as bb, max(cn)::double as total from d group by feature)"""]
    for k in range(leaves - 1):
        gain = f"{impurity('(l.b - l.a)', '(l.bb - l.ab)')} - {impurity('(d.cn - l.a)', '(d.cb - l.ab)')} - {impurity('(l.b - d.cn)', '(l.bb - d.cb)')}"
        steps.append(f"""c{k} as (select * from (select l.*, d.cn, d.cb, (d.x + d.next) / 2 as cut, {gain} as gain, d.x from l{k} l join d on d.feature = l.feature and d.cn - l.a >= {least} and l.b - d.cn >= {least} and d.cn > l.a and d.cn < l.b)
          where gain > 1e-12 * greatest(1, total) qualify row_number() over (partition by feature order by gain desc, x) = 1),
          l{k + 1} as (select l.* from l{k} l anti join c{k} c on c.feature = l.feature and c.a = l.a union all select feature, a, ab, cn, cb, total from c{k} union all select feature, cn, cb, b, bb, total from c{k})""")
    values = " union all ".join(f"select '{f}' as feature, {f} as x, count(*)::double as n, sum(y)::double as bad from credit where {f} is not null group by {f}" for f in features)
    every = " union all ".join(f"select feature, cut from c{k}" for k in range(leaves - 1))
    return f"v as ({values}), {', '.join(steps)}, cuts as (select feature, list(cut order by cut) as q from ({every}) group by feature)"


def _cart_sql() -> str:
    sums = " union all ".join(f"select '{f}' as feature, len(list_filter(coalesce(q, []), lambda c: c <= {f}))::int as bin_idx, count(*)::double as n, count(*)::double as w, sum(y)::double as bad from credit left join cuts on cuts.feature = '{f}' group by all" for f in FEATURES)
    columns = "feature, bin_idx, round(w, 6) as count, round(bad, 6) as bad, round(good, 6) as good, round(bad_rate, 6) as bad_rate, round(bad / tb, 6) as dist_bad, round(good / tg, 6) as dist_good, round(woe, 6) as woe, round((bad / tb - good / tg) * woe, 6) as iv"
    return f"with {CREDIT}, {tree_sql(FEATURES, 5, 50)}, s as ({sums}), t as ({woe_sql('select * from s', 'feature')}) select {columns} from t"


@query(_cart_sql())
def cart_bins(spark, d):
    df = credit(spark, d)
    return rounded(B.WoeBinner(5, "cart", min_samples_bin=50).fit(df, features=FEATURES, target="y").stats(df, "y"))


#: Isotonic means are greatest least means: of all stretches that begin before a bin and end after it.
MONOTONE = f"""with {CREDIT}, c as (select * replace ((dense_rank() over (partition by feature order by bin_idx) - 1)::int as bin_idx) from ({long_sql(10)})), r as (select *, bad / w as rate, sum(bad / w) over o as s, row_number() over o as k from c window o as (partition by feature order by bin_idx rows unbounded preceding)),
  m as (select i.feature, i.bin_idx, j.k as j, min((e.s - j.s + j.rate) / (e.k - j.k + 1)) as least, max((e.s - j.s + j.rate) / (e.k - j.k + 1)) as most from r i join r j on j.feature = i.feature and j.k <= i.k join r e on e.feature = i.feature and e.k >= i.k group by all),
  f as (select feature, bin_idx, max(least) as up, min(most) as down from m group by all),
  g as (select r.*, up, down, sum((rate - up) ** 2) over (partition by feature) <= sum((rate - down) ** 2) over (partition by feature) as rises from r join f using (feature, bin_idx)),
  h as (select feature, bin_idx, w * p as bad, w * (1 - p) as good, 0.5::double * sum(w) over (partition by feature) / sum(n) over (partition by feature) as s from (select *, least(greatest(case when rises then up else down end, 1e-7), 1 - 1e-7) as p from g))
  select feature, bin_idx, round(ln(((bad + s) / (sum(bad) over (partition by feature) + 2 * s)) / ((good + s) / (sum(good) over (partition by feature) + 2 * s))), 6) as woe from h"""


@query(MONOTONE)
def monotonic_bins(spark, d):
    df = credit(spark, d)
    b = B.WoeBinner(10, monotonic=True).fit(df, features=FEATURES, target="y")
    return rounded(spark.createDataFrame([(f, k, v) for f, r in b.rules.items() for k, v in sorted(r.woe.items())], "feature string, bin_idx int, woe double"))


# stability


@query(f"with {CREDIT}, s as (select l_returnflag as v, count(*) filter (sample = 'dev')::double / (select count(*) from credit where sample = 'dev') as e, count(*) filter (sample = 'oot')::double / (select count(*) from credit where sample = 'oot') as a from credit group by v) select round(sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))), 9) as psi from s")
def psi_categorical(spark, d):
    s = D.split_dev_oot(credit(spark, d), sample="sample")
    return rounded(Y.psi_categorical(s.dev, s.oot, "l_returnflag"), 9)


def _psi_sql(x: str, n: int = 10) -> str:
    return f"""with {CREDIT}, b as (select sample, case when {x} is null then null {' '.join(f'when {x} < q[{k}] then {k}' for k in range(1, n))} else {n} end as bin from credit, {cuts_sql(x, n, "credit", "sample = 'dev'")}),
      s as (select r.bin::int as bin, (count(*) filter (sample = 'dev') + 1e-10) / (select count(*) from b where sample = 'dev') as e, (count(*) filter (sample = 'oot') + 1e-10) / (select count(*) from b where sample = 'oot') as a from range(1, {n + 1}) r(bin) left join b on b.bin = r.bin group by r.bin)
      select bin, round(e, 6) as expected_pct, round(a, 6) as actual_pct, round((a - e) * ln(a / e), 6) as psi from s"""


@query(_psi_sql("l_extendedprice"))
def psi_numeric(spark, d):
    s = D.split_dev_oot(credit(spark, d), sample="sample")
    return rounded(Y.psi_numeric(s.dev, s.oot, "l_extendedprice"))


@query(_psi_sql("price"))
def psi_numeric_missing(spark, d):
    s = D.split_dev_oot(credit(spark, d), sample="sample")
    return rounded(Y.psi_numeric(s.dev, s.oot, "price"))


@query(" union all ".join(f"select '{f}' as feature, round(sum(p), 6) as psi, case when sum(p) < 0.1 then 'Stable' when sum(p) < 0.25 then 'Moderate Shift' else 'Significant Shift' end as level from (select (a - e) * ln(a / e) as p from (" + _psi_sql(f, 5).replace("select bin, round(e, 6) as expected_pct, round(a, 6) as actual_pct, round((a - e) * ln(a / e), 6) as psi from s", "select * from s where (e + a) > 1e-8") + "))" for f in FEATURES))
def feature_psi(spark, d):
    s = D.split_dev_oot(credit(spark, d), sample="sample")
    return rounded(Y.feature_psi(s.dev, s.oot, FEATURES, 5))


PRICE_BINS = f"p as (select period, {case_sql('price', 5, special='when price = -999 then -3')} as bin_idx, w, y from credit, {cuts_sql('price', 5, 'credit', 'price <> -999')}), c as (select period, bin_idx, count(*)::double as n, sum(w) as w, sum(w * y) as bad from p group by all), h as (select *, w / sum(w) over (partition by period) as pct from c), base as (select bin_idx, pct from h where period = (select min(period) from h))"
PSI_TREND = f"with {CREDIT}, {PRICE_BINS}, x as (select g.period, b.bin_idx from (select distinct period from h) g cross join (select distinct bin_idx from h) b where b.bin_idx = -2 or b.bin_idx >= 0), t as (select x.period, greatest(coalesce(base.pct, 0), 1e-6) as e, greatest(coalesce(h.pct, 0), 1e-6) as a from x left join base using (bin_idx) left join h on h.period = x.period and h.bin_idx = x.bin_idx)"


def _profile(spark, d):
    return K.profile_risk(credit(spark, d), "y", ["price"], "period", "w", B.WoeBinner(5, special_values=[-999.0]).fit(credit(spark, d), features=["price"], target="y"))


@query(PSI_TREND + " select 'price' as feature, period as \"group\", round(sum((a - e) * ln(a / e)), 6) as psi from t group by period")
def psi_trend(spark, d):
    return rounded(_profile(spark, d).trends["psi"])


@query(f"with {CREDIT}, {PRICE_BINS} select 'price' as feature, period as \"group\", round(sum(case when bin_idx = -1 then w else 0 end) / sum(w), 6) as missing_rate from c group by period")
def missing_trend(spark, d):
    return rounded(_profile(spark, d).trends["missing_rate"])


@query(f"with {CREDIT} select 'price' as feature, period as \"group\", round(sum(w * y) / sum(w), 6) as bad_rate from credit group by period")
def bad_rate_trend(spark, d):
    return rounded(_profile(spark, d).trends["bad_rate"])


# metrics


CONFUSION = f"with {CREDIT}, c as (select sum(w) filter (y = 1 and score >= 0.25) as tp, sum(w) filter (y = 0 and score < 0.25) as tn, sum(w) filter (y = 0 and score >= 0.25) as fp, sum(w) filter (y = 1 and score < 0.25) as fn from credit)"


@query(CONFUSION + " select tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def classification_metrics(spark, d):
    return rounded(M.confusion(scored(spark, d).withColumn("p", (F.col("score") >= 0.25).cast("int")), "y", "p", "w"))


def _ks_sql(w: str, columns: str, by: str = "") -> str:
    k, p = (f"{by}, ", f"partition by {by}") if by else ("", "")
    return f"""with {CREDIT}, g as (select {k}score, sum({w} * y)::double as bad, sum({w} * (1 - y))::double as good from credit group by all),
      u as (select *, sum(bad) over o as cb, sum(good) over o as cg, sum(bad) over ({p}) as tb, sum(good) over ({p}) as tg from g window o as ({p} order by score desc rows unbounded preceding)),
      m as (select {k}max(abs(cb / tb - cg / tg)) as ks, arg_max(score, (round(abs(cb / tb - cg / tg), 14), score)) as ks_threshold, sum(bad * ((tg - cg) + good / 2)) / (any_value(tb) * any_value(tg)) as auc from u {'group by ' + by if by else ''})
      select {k}{columns} from m"""


KS = "round(ks, 6) as ks, round(ks_threshold, 6) as ks_threshold, round(auc, 6) as auc, round(2 * auc - 1, 6) as gini"


@query(_ks_sql("1", KS))
def ks_auc(spark, d):
    return rounded(M.ks_auc(scored(spark, d), "y", "score"))


@query(_ks_sql("w", KS))
def ks_auc_weighted(spark, d):
    return rounded(M.ks_auc(scored(spark, d), "y", "score", "w"))


@query(_ks_sql("1", KS))
def ks_auc_by_ranges(spark, d):
    return rounded(M.ks_auc(scored(spark, d), "y", "score", ranges=8))


@query(_ks_sql("w", KS, "l_linestatus"))
def segment_metrics(spark, d):
    return rounded(M.ks_auc(scored(spark, d), "y", "score", "w", ["l_linestatus"]))


@query(_ks_sql("1", KS, "period"))
def temporal_metrics(spark, d):
    return rounded(M.ks_auc(scored(spark, d), "y", "score", by=["period"]))


@query(f"""with {CREDIT}, b as (select {case_sql("score", 10)} as bin, score, y from credit, {cuts_sql("score", 10)}),
  g as (select bin::int as bin, count(*)::double as count, sum(y)::double as bad, avg(score) as s from b group by bin)
  select (row_number() over (order by s desc) - 1)::int as rank, bin, count, bad, round(bad / count, 6) as bad_rate, round(s, 6) as avg_score, round(sum(bad) over o / sum(count) over o, 6) as cum_bad_rate, round(bad / count / (sum(bad) over () / sum(count) over ()), 6) as lift from g window o as (order by s desc rows unbounded preceding)""")
def lift_deciles(spark, d):
    return rounded(M.lift(scored(spark, d), "y", "score"))


@query(f"""with {CREDIT}, q as {weighted_cuts_sql("score", [f"{k}::double/10" for k in range(1, 10)])},
  g as (select len(list_filter(list_distinct(q), lambda e: e <= score))::int as bin, sum(w) as count, sum(w * y) as bad, sum(w * score) / sum(w) as s from credit, q group by all)
  select (row_number() over (order by s desc) - 1)::int as rank, bin, count, bad, round(bad / count, 6) as bad_rate, round(s, 6) as avg_score, round(sum(bad) over o / sum(count) over o, 6) as cum_bad_rate, round(bad / count / (sum(bad) over () / sum(count) over ()), 6) as lift from g window o as (order by s desc rows unbounded preceding)""")
def lift_weighted(spark, d):
    return rounded(M.lift(scored(spark, d), "y", "score", weight="w"))


@query(f"with {CREDIT}, e as (select w, l_extendedprice as y, l_quantity * 1500.0 as p from credit), m as (select sum(w * y) / sum(w) as m from e) select round(sqrt(sum(w * (y - p) ** 2) / sum(w)), 4) as rmse, round(sum(w * abs(y - p)) / sum(w), 4) as mae, round(1 - sum(w * (y - p) ** 2) / sum(w * (y - m) ** 2), 6) as r2 from e, m")
def regression_metrics(spark, d):
    out = M.regression(credit(spark, d).withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p", "w")
    return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query(CONFUSION + " select unnest(['tp', 'tn', 'fp', 'fn', 'accuracy']) as metric, round(unnest([tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn)]), 6) as value from c")
def metrics_table(spark, d):
    row = M.confusion(scored(spark, d).withColumn("p", (F.col("score") >= 0.25).cast("int")), "y", "p", "w")
    return rounded(M.metrics_table(row.select("tp", "tn", "fp", "fn", "accuracy")))


# profiles


@query(f"with {CREDIT}, u as (select count(*) as rows from credit), k as (select count(*) as n from (select distinct * exclude (score) from credit)) select item, value from (select unnest(['rows', 'features', 'numeric', 'categorical', 'duplicate_rows', 'bad_rate', 'n_groups']) as item, unnest([rows::varchar, '3', '2', '1', (rows - n)::varchar, (select round(avg(y), 6)::decimal(18,6)::varchar from credit), (select count(distinct period)::varchar from credit)]) as value from u, k)")
def profile_overview(spark, d):
    return P.overview(credit(spark, d), ["price", "l_tax", "l_returnflag"], "y", "period")


@query(f"with {CREDIT} " + " union all ".join(f"select '{f}' as feature, count(*) filter ({f} is null) as n_missing, round(count(*) filter ({f} is null) / count(*), 6) as missing_rate, count(*) filter ({s}) as n_special, round(count(*) filter ({s}) / count(*), 6) as special_rate, count(distinct {f}) + max(({f} is null)::int) as n_unique, count(*) filter ({f} is null) / count(*) >= 0.9 as high_missing, count(distinct {f}) + max(({f} is null)::int) <= 1 as constant from credit" for f, s in (("price", "price = -999"), ("l_tax", "false"), ("l_returnflag", "false"))))
def profile_dq(spark, d):
    return rounded(P.quality(credit(spark, d), ["price", "l_tax", "l_returnflag"], [-999.0]))


@query(f"with {CREDIT} " + " union all ".join(f"select '{f}' as feature, count({f}) as count, round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as std, min({f}) as min, round(quantile_cont({f}, 0.25::double), 6) as p25, round(quantile_cont({f}, 0.5::double), 6) as median, round(quantile_cont({f}, 0.75::double), 6) as p75, max({f}) as max from credit where {f} <> -999" for f in ("price", "l_tax")))
def profile_stats(spark, d):
    return rounded(P.statistics_table(credit(spark, d), ["price", "l_tax"], [-999.0]))


@query(f"with {CREDIT} select 'price' as feature, period as \"group\", count(*) as row_count, round(count(*) filter (price is null) / count(*), 6) as missing_rate from credit group by period")
def profile_trend(spark, d):
    return rounded(P.trend(credit(spark, d), ["price"], "period"))


PSI_OF_FEATURES = f"""pg as ({long_sql(more='period')}), ph as (select feature, period, bin_idx, w / sum(w) over (partition by feature, period) as pct from pg), pb as (select * from ph where period = (select min(period) from ph)),
  px as (select distinct g.feature, g.period, b.bin_idx from ph g join (select feature, bin_idx from ph) b using (feature) where b.bin_idx = -2 or b.bin_idx >= 0),
  pp as (select px.feature, px.period, greatest(coalesce(pb.pct, 0), 1e-6) as e, greatest(coalesce(ph.pct, 0), 1e-6) as a from px left join pb on pb.feature = px.feature and pb.bin_idx = px.bin_idx left join ph on ph.feature = px.feature and ph.period = px.period and ph.bin_idx = px.bin_idx),
  psi as (select feature, round(max(psi), 6) as psi_max from (select feature, period, sum((a - e) * ln(a / e)) as psi from pp group by all) group by feature)"""


@query(f"with {CREDIT}, c as ({long_sql()}), t as ({woe_sql('select * from c', 'feature')}), k as (select feature, abs(sum(bad) over o / sum(bad) over (partition by feature) - sum(good) over o / sum(good) over (partition by feature)) as gap, iv, woe - lag(woe) over (partition by feature order by bin_idx) as dw from t window o as (partition by feature order by bin_idx rows unbounded preceding)), {PSI_OF_FEATURES} select feature, round(sum(iv), 6) as iv, {INTERPRET.format('sum(iv)')} as iv_strength, round(max(gap), 6) as ks, 0.0::double as missing_rate, count(*) as n_bins, bool_and(coalesce(dw >= 0, true)) or bool_and(coalesce(dw <= 0, true)) as monotonic_woe, any_value(psi_max) as psi_max from k join psi using (feature) group by feature")
def risk_summary(spark, d):
    return rounded(K.profile_risk(credit(spark, d), "y", FEATURES, "period", n_bins=5).summary)


LABEL = "case bin_idx when 0 then '00_(-inf, ' || printf('%.4g', q[1]) || ')' when 4 then '04_[' || printf('%.4g', q[4]) || ', inf)' else printf('%02d_[', bin_idx) || printf('%.4g', q[bin_idx]) || ', ' || printf('%.4g', q[bin_idx + 1]) || ')' end as bin_label"


@query(_table_sql(long_sql(5, ["l_quantity"]), "feature, bin_idx, w as count, bad, good, round(bad_rate, 6) as bad_rate, round(bad / tb, 6) as dist_bad, round(good / tg, 6) as dist_good, round(woe, 6) as woe, round((bad / tb - good / tg) * woe, 6) as iv, " + LABEL) + f", {cuts_sql('l_quantity', 5)}")
def risk_detail(spark, d):
    return rounded(K.profile_risk(credit(spark, d), "y", ["l_quantity"], n_bins=5).detail)


# monitoring


def _monitor(spark, d):
    df = scored(spark, d)
    b = B.WoeBinner(5, special_values=[-999.0]).fit(df, features=["price"], target="y")
    return K.Monitor(b).monitor(df, "period", features=["price"], target="y", score="score", weight="w")


@query(PSI_TREND + ", s as (select period, sum((a - e) * ln(a / e)) as psi from t group by period), m as (select period, sum(case when bin_idx = -1 then w else 0 end) / sum(w) as r from c group by period), j as (select * from s join m using (period)) select 'price' as feature, round(arg_max(psi, period), 6) as psi_latest, round(max(psi), 6) as psi_max, round(arg_max(r, period), 6) as missing_latest, round(max(r), 6) as missing_max, round(arg_max(r, period) - arg_min(r, period), 6) as missing_delta, case when max(psi) >= 0.25 then 'critical' when max(psi) >= 0.1 then 'warning' else 'normal' end as status from j")
def monitor_summary(spark, d):
    return rounded(_monitor(spark, d).summary)


@query(f"with {CREDIT}, {PRICE_BINS} select 'price' as feature, h.period as \"group\", h.bin_idx, round(h.pct, 6) as pct, round(base.pct, 6) as benchmark_pct, case h.bin_idx when -3 then 'Special_-999' when -1 then 'Missing' else " + LABEL.removesuffix(" as bin_label").replace("case bin_idx", "case h.bin_idx").replace("bin_idx]", "h.bin_idx]").replace("[', bin_idx)", "[', h.bin_idx)").replace("bin_idx + 1", "h.bin_idx + 1").replace("h.h.", "h.") + f" end as bin_label from h left join base using (bin_idx), {cuts_sql('price', 5, 'credit', 'price <> -999')}")
def monitor_detail(spark, d):
    return rounded(_monitor(spark, d).detail)


@query(f"with {CREDIT} select period as \"group\", round(sum(w * y) / sum(w), 6) as bad_rate from credit group by period")
def target_trend(spark, d):
    return rounded(_monitor(spark, d).trends["target"])


@query(f"with {CREDIT} select period as \"group\", round(avg(score), 6) as score_mean, round(stddev_pop(score), 6) as score_std from credit group by period")
def score_trend(spark, d):
    return rounded(K.score_trend(scored(spark, d), "period", "score"))


SHIFTED = {"l_quantity": "l_quantity + (period - 1992) * 3", "l_tax": "case when (l_orderkey + l_linenumber) % 100 < (period - 1992) * 2 then null else l_tax end", "l_discount": "l_discount"}


def _shifted(spark, d) -> DataFrame:
    """Features of which one drifts, one goes missing and one stays as it is."""
    return credit(spark, d).select("l_orderkey", "l_linenumber", "period", *[F.expr(x).alias(f) for f, x in SHIFTED.items()])


def _alert_sql() -> str:
    shifted = f"shifted as (select l_orderkey, l_linenumber, period, 1.0 as w, {', '.join(f'{x} as {f}' for f, x in SHIFTED.items())} from credit), bench as (select * from shifted where period = (select min(period) from shifted))"
    bins = " union all ".join(f"select '{f}' as feature, period, {case_sql(f, 5)} as bin_idx, count(*)::double as n from shifted, {cuts_sql(f, 5, 'bench', f'{f} is not null')} group by all" for f in SHIFTED)
    return f"""with {CREDIT}, {shifted}, c as ({bins}), h as (select *, n / sum(n) over (partition by feature, period) as pct from c), base as (select * from h where period = (select min(period) from h)),
      x as (select distinct g.feature, g.period, b.bin_idx from h g join (select distinct feature, bin_idx from h) b using (feature) where b.bin_idx >= 0),
      p as (select x.feature, x.period, sum((greatest(coalesce(h.pct, 0), 1e-6) - greatest(coalesce(base.pct, 0), 1e-6)) * ln(greatest(coalesce(h.pct, 0), 1e-6) / greatest(coalesce(base.pct, 0), 1e-6))) as psi
        from x left join base on base.feature = x.feature and base.bin_idx = x.bin_idx left join h on h.feature = x.feature and h.period = x.period and h.bin_idx = x.bin_idx group by all),
      m as (select feature, period, coalesce(sum(pct) filter (bin_idx = -1), 0) as missing from h group by all),
      s as (select feature, arg_max(psi, period) as psi, arg_max(missing, period) - arg_min(missing, period) as delta from p join m using (feature, period) group by feature)
      select feature, case when psi >= 0.25 then 'critical' else 'warning' end as level, case when psi >= 0.1 then 'psi' else 'missing' end as reason, feature = 'l_tax' as in_model, round(psi, 6) as psi_latest from s where psi >= 0.1 or abs(delta) >= 0.05"""


@query(_alert_sql())
def alert_levels(spark, d):
    return rounded(K.alerts(K.Monitor(n_bins=5).monitor(_shifted(spark, d), "period", features=list(SHIFTED)).summary, model_features=["l_tax"]))


# exploration


@query(f"with {CREDIT} select 'price' as feature, round(avg((price is null)::int) filter (sample = 'dev'), 6) as dev_missing, round(avg((price is null)::int) filter (sample = 'oot'), 6) as oot_missing, round(avg((price is null)::int) filter (sample = 'oot') - avg((price is null)::int) filter (sample = 'dev'), 6) as delta from credit")
def eda_missing(spark, d):
    s = D.split_dev_oot(credit(spark, d), sample="sample")
    return rounded(P.missing_by_sample(s.dev, s.oot, ["price"]))


@query("with q as (select quantile_cont(o_totalprice, [0.01::double, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as v from orders) select 'o_totalprice' as feature, unnest([0.01::double, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as q, round(unnest(v), 6) as value from q")
def eda_numeric(spark, d):
    return rounded(P.numeric_distribution(table(spark, d, "orders"), ["o_totalprice"]))


@query("with c as (select 'o_orderpriority' as feature, o_orderpriority as value, count(*) as n from orders group by value union all select 'o_orderstatus', o_orderstatus, count(*) from orders group by o_orderstatus) select feature, value, n, round(n / sum(n) over (partition by feature), 6) as pct, (row_number() over (partition by feature order by n desc, value))::int as rank from c")
def eda_top_categories(spark, d):
    return rounded(P.top_categories(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"]))


@query(f"select k.*, x.* exclude (sample) from ({_ks_sql('1', KS, 'sample')}) k join (with {CREDIT}, x as (select sample, count(*) filter (y = 1 and score >= 0.25)::double as tp, count(*) filter (y = 0 and score < 0.25)::double as tn, count(*) filter (y = 0 and score >= 0.25)::double as fp, count(*) filter (y = 1 and score < 0.25)::double as fn from credit group by sample) select *, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from x) x using (sample)")
def score_evaluation(spark, d):
    return rounded(M.all_metrics(scored(spark, d), "y", "score", 0.25, None, ["sample"]))


def _explored(spark, d) -> dict[str, DataFrame]:
    df = credit(spark, d).select("y", "sample", *FEATURES, "l_returnflag", "l_linestatus")
    return P.explore(df, "y", "sample", n_bins=5)


def _two_samples_sql(columns: str) -> str:
    """Sums by bins that the development rows give, of both samples."""
    numbers = " union all ".join(f"select '{f}' as feature, sample, {case_sql(f, 5)} as bin_idx, count(*)::double as n, count(*)::double as w, sum(y)::double as bad from credit, {cuts_sql(f, 5, 'credit', chr(34) + 'sample' + chr(34) + ' = ' + chr(39) + 'dev' + chr(39))} group by all" for f in FEATURES)
    words = " union all ".join(f"select '{f}' as feature, sample, coalesce(k, -2) as bin_idx, count(*)::double as n, count(*)::double as w, sum(y)::double as bad from credit left join (select {f}, (row_number() over (order by count(*) desc, {f}) - 1)::int as k from credit where sample = 'dev' group by {f}) using ({f}) group by all" for f in ("l_returnflag", "l_linestatus"))
    return f"with {CREDIT}, c as ({numbers} union all {words}), t as ({woe_sql('select * from c', 'feature, sample')}), h as (select *, w / sum(w) over (partition by feature, sample) as pct from c), x as (select distinct feature, bin_idx from h where bin_idx = -2 or bin_idx >= 0), p as (select x.feature, sum((greatest(coalesce(a.pct, 0), 1e-6) - greatest(coalesce(e.pct, 0), 1e-6)) * ln(greatest(coalesce(a.pct, 0), 1e-6) / greatest(coalesce(e.pct, 0), 1e-6))) as psi from x left join h e on e.feature = x.feature and e.bin_idx = x.bin_idx and e.sample = 'dev' left join h a on a.feature = x.feature and a.bin_idx = x.bin_idx and a.sample = 'oot' group by x.feature) {columns}"


@query(_two_samples_sql(f"select sample, feature, round(sum(iv), 6) as total_iv, {INTERPRET.format('sum(iv)')} as interpretation from t group by all"))
def eda_iv(spark, d):
    """Tables 7 and 8."""
    t = _explored(spark, d)
    return rounded(t["7_IV_DEV"].withColumn("sample", F.lit("dev")).unionByName(t["8_IV_OOT"].withColumn("sample", F.lit("oot"))))


@query(_two_samples_sql("select feature, round(psi, 6) as psi, case when feature in ('l_returnflag', 'l_linestatus') then 10 else 9 end as table_no from p"))
def eda_psi(spark, d):
    """Tables 9 and 10."""
    t = _explored(spark, d)
    return rounded(t["9_PSI_Numeric"].withColumn("table_no", F.lit(9)).unionByName(t["10_PSI_Categorical"].withColumn("table_no", F.lit(10))))


@query(f"with {CREDIT} " + " union all ".join(f"select sample, '{f}' as feature, count(*) as n, count({f}) as n_valid, round(avg(({f} is null)::int), 6) as missing_rate, min({f}) as min, max({f}) as max, round(avg({f}), 6) as mean, round(quantile_cont({f}, 0.5::double), 6) as median, round(stddev_samp({f}), 6) as std, round(quantile_cont({f}, 0.01::double), 6) as p01, round(quantile_cont({f}, 0.25::double), 6) as p25, round(quantile_cont({f}, 0.5::double), 6) as p50, round(quantile_cont({f}, 0.75::double), 6) as p75, round(quantile_cont({f}, 0.99::double), 6) as p99 from credit group by sample" for f in FEATURES))
def eda_numeric_by_sample(spark, d):
    """Tables 3 and 4."""
    t = _explored(spark, d)
    return rounded(t["3_Num_Dist_DEV"].withColumn("sample", F.lit("dev")).unionByName(t["4_Num_Dist_OOT"].withColumn("sample", F.lit("oot"))))


@query(f"with {CREDIT}, c as (" + " union all ".join(f"select sample, '{f}' as feature, {f} as value, count(*) as n from credit group by all" for f in ("l_returnflag", "l_linestatus")) + ") select *, round(n / sum(n) over (partition by sample, feature), 6) as pct, (row_number() over (partition by sample, feature order by n desc, value))::int as rank from c")
def eda_categories_by_sample(spark, d):
    """Tables 5 and 6."""
    t = _explored(spark, d)
    return rounded(t["5_Char_Dist_DEV"].withColumn("sample", F.lit("dev")).unionByName(t["6_Char_Dist_OOT"].withColumn("sample", F.lit("oot"))))


@query(f"with {CREDIT} " + " union all ".join(f"select '{f}' as feature, round(avg(({f} is null)::int) filter (sample = 'dev'), 6) as dev_missing, round(avg(({f} is null)::int) filter (sample = 'oot'), 6) as oot_missing, round(avg(({f} is null)::int) filter (sample = 'oot') - avg(({f} is null)::int) filter (sample = 'dev'), 6) as delta from credit" for f in [*FEATURES, "l_returnflag", "l_linestatus"]))
def eda_missing_by_sample(spark, d):
    """Table 2."""
    return rounded(_explored(spark, d)["2_Missing_Rate"])


# features


@query("select l_orderkey, l_linenumber, l_quantity, l_tax, round(l_quantity * l_quantity, 6) as \"l_quantity^2\", round(l_quantity * l_tax, 6) as \"l_quantity l_tax\", round(l_tax * l_tax, 6) as \"l_tax^2\" from lineitem")
def polynomial(spark, d):
    return rounded(X.polynomial(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]))


@query("select l_orderkey, l_linenumber, l_quantity, l_tax, round(l_quantity * l_tax, 6) as \"l_quantity l_tax\" from lineitem")
def interaction(spark, d):
    return rounded(X.interaction(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]))


@query(f"with {CREDIT} select l_orderkey, l_linenumber, price, l_quantity, round(price / (abs(l_quantity) + 1e-10), 6) as price_div_l_quantity from credit")
def ratio(spark, d):
    return rounded(X.ratio(credit(spark, d).select("l_orderkey", "l_linenumber", "price", "l_quantity"), ["price", "l_quantity"]))


@query(f"with {CREDIT} select l_orderkey, l_linenumber, price, round(sign(price) * ln(1 + abs(price)), 6) as price_log from credit")
def log(spark, d):
    return rounded(X.log(credit(spark, d).select("l_orderkey", "l_linenumber", "price"), ["price"]))


@query(f"with {CREDIT} select l_orderkey, l_linenumber, l_quantity, {case_sql('l_quantity', 5)} as l_quantity_binned from credit, {cuts_sql('l_quantity', 5)}")
def binned_feature(spark, d):
    return X.binned(credit(spark, d).select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])


@query("select l_orderkey, l_linenumber, l_quantity, l_tax, round(l_quantity * l_quantity, 6) as \"l_quantity^2\", round(l_quantity * l_tax, 6) as \"l_quantity l_tax\", round(l_tax * l_tax, 6) as \"l_tax^2\", round(l_quantity / (abs(l_tax) + 1e-10), 2) as l_quantity_div_l_tax, round(ln(1 + l_quantity), 6) as l_quantity_log, round(ln(1 + l_tax), 6) as l_tax_log from lineitem")
def generate_features(spark, d):
    out = X.generate_features(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], ratios=True, logs=True)
    return rounded(out.withColumn("l_quantity_div_l_tax", F.round("l_quantity_div_l_tax", 2)))


# selection and importance


@query(" union all ".join(f"select '{f}' as feature, round(var_samp({f}), 6) as variance from lineitem" for f in ("l_quantity", "l_discount", "l_tax")))
def variance(spark, d):
    return rounded(X.variances(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def corr_matrix(spark, d):
    return rounded(X.correlations(table(spark, d, "lineitem"), FEATURES))


@query("select unnest(['l_quantity', 'l_tax']) as feature")
def correlation_selection(spark, d):
    df = table(spark, d, "lineitem").withColumn("twin", F.col("l_quantity") * 0.5 + 1)
    return spark.createDataFrame([(f,) for f in X.select_features(df, "correlation", columns=["l_quantity", "twin", "l_tax"])], "feature string")


@query(_table_sql(long_sql(10), "feature") + " group by feature having sum(iv) >= 0.02")
def iv_selection(spark, d):
    return spark.createDataFrame([(f,) for f in X.select_features(credit(spark, d), "iv", "y", FEATURES)], "feature string")


@query(f"with {CREDIT}, b as (" + " union all ".join(f"select '{f}' as feature, {case_sql(f, 10)} as b, y from credit, {cuts_sql(f, 10)}" for f in FEATURES) + "), c as (select feature, b, y, count(*)::double as n from b group by all), s as (select feature, n, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, b) as tb, sum(n) over (partition by feature, y) as ty from c) select feature, round(sum(n / t * ln(n * t / (tb * ty))), 6) as mi from s group by feature")
def mutual_information(spark, d):
    return rounded(X.mutual_information(credit(spark, d), "y", FEATURES))


def _psi_sql(x: str) -> str:
    y = f"(({x})::double + 6)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - 1 / (132 * {y} ** 10) - " + " - ".join(f"1 / (({x})::double + {k})" for k in range(6)) + ")"


_NEAR = ["l_quantity", "l_extendedprice", "price"]
_LAGS = "[" + ", ".join(f"{f}(x, {j}) over o" for j in (1, 2, 3) for f in ("lag", "lead")) + "]"


@query(f"""with {CREDIT}, f as (
  {" union all ".join(f"select '{c}' as feature, coalesce({c}, 0)::double as x, y from credit" for c in _NEAR)}
), n as (
  select *, count(*) over (partition by feature, y) as size, list_filter({_LAGS}, lambda v: v is not null) as near from f window o as (partition by feature, y order by x)
), r as (
  select *, list_sort(list_transform(near, lambda v: abs(v - x)))[3] as r from n
), e as (
  select *, coalesce(list_filter(near, lambda v: v < x and abs(v - x) = r)[1], x - r) as low, coalesce(list_filter(near, lambda v: v > x and abs(v - x) = r)[1], x + r) as high from r
), v as (
  select feature, x, sum(count(*)) over (partition by feature order by x) as upto, count(*) as here from f group by feature, x
), m as (
  select e.feature, e.size, case when r = 0 then s.here else coalesce(b.upto, 0) - coalesce(a.upto, 0) end as m
  from e join v s on s.feature = e.feature and s.x = e.x asof left join v a on a.feature = e.feature and e.low >= a.x asof left join v b on b.feature = e.feature and e.high > b.x
)
select feature, round(greatest(0, {_psi_sql("count(*)")} + {_psi_sql("3")} - avg({_psi_sql("size")}) - avg({_psi_sql("m")})), 6) as mi from m group by feature""")
def neighbour_information(spark, d):
    """Mutual information by the three nearest neighbours."""
    return rounded(X.neighbour_information(credit(spark, d), "y", _NEAR))


@query()
def recursive_elimination(spark, d):
    return spark.createDataFrame([(f,) for f in X.select_features(credit(spark, d), "rfe", "y", FEATURES, n=2)], "feature string")


@query("select l_quantity, l_extendedprice from lineitem")
def feature_selector(spark, d):
    return X.FeatureSelector("variance").fit_transform(table(spark, d, "lineitem"), columns=FEATURES)


_SPREADS = " union all ".join(f"select '{f}' as feature, {{0}}({f}) as importance from lineitem" for f in FEATURES)


@query(f"with t as ({_SPREADS.format('var_samp')}) select (row_number() over (order by importance desc))::int as rank, feature, round(importance, 4) as importance, round(100 * importance / sum(importance) over (), 6) as pct, round(100 * sum(importance) over (order by importance desc rows unbounded preceding) / sum(importance) over (), 6) as cum_pct from t")
def importance_summary(spark, d):
    out = X.importance_summary(X.variances(table(spark, d, "lineitem"), FEATURES).withColumnRenamed("variance", "importance"))
    return rounded(out.withColumn("importance", F.round("importance", 4)))


@query(f"with a as ({_SPREADS.format('var_samp')} union all select 'twin', var_samp(l_quantity) from lineitem), b as ({_SPREADS.format('-1 * var_samp')}), ra as (select feature, rank() over (order by importance desc) + (count(*) over (partition by importance) - 1) / 2 as rank_a from a), rb as (select feature, rank() over (order by importance desc) + (count(*) over (partition by importance) - 1) / 2 as rank_b from b) select feature, rank_a::double as rank_a, rank_b::double as rank_b, ((rank_a + coalesce(rank_b, rank_a)) / 2)::double as mean_rank from ra left join rb using (feature)")
def importance_rank(spark, d):
    spread = X.variances(table(spark, d, "lineitem"), FEATURES).withColumnRenamed("variance", "importance")
    first = spread.unionByName(spread.where("feature = 'l_quantity'").withColumn("feature", F.lit("twin")))
    return X.rank_features(first, spread.withColumn("importance", -F.col("importance")))


@query()
def importance_model(spark, d):
    return L.train_model(credit(spark, d), "y", FEATURES, "tree", maxDepth=4).importance(credit(spark, d))


@query()
def importance_permutation(spark, d):
    df = credit(spark, d)
    return L.permutation_importance(L.train_model(df, "y", FEATURES), df, "y")


# models and scorecards


@query()
def train_logistic(spark, d):
    df = credit(spark, d)
    return rounded(L.train_model(df.where("sample = 'dev'"), "y", FEATURES, weight="w").predict_proba(df.where("sample = 'oot'")).select("l_orderkey", "l_linenumber", "y", "probability"))


def newton_sql(x: str, w: str = "1.0::double", view: str = "credit", where: str = "true", steps: int = 25) -> str:
    """b0, b1 of a logistic model with C = 1 by Newton steps."""
    return f"""(with recursive e as (select {x} as x, y, {w} as w from {view} where {where}), it(k, b0, b1) as (select 0, 0.0::double, 0.0::double union all
      select k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from
        (select k, b0, b1, sum(w * (p - y)) as g0, sum(w * (p - y) * x) + b1 as g1, sum(w * p * (1 - p)) as h00, sum(w * p * (1 - p) * x) as h01, sum(w * p * (1 - p) * x * x) + 1 as h11
          from (select k, b0, b1, x, y, w, 1 / (1 + exp(-(b0 + b1 * x))) as p from it, e where k < {steps}) group by k, b0, b1))
      select b0, b1 from it where k = {steps})"""


@query(f"with {CREDIT} select round(b0, 4) as intercept, round(b1, 4) as coefficient from {newton_sql('l_quantity', 'w', 'credit', chr(34) + 'sample' + chr(34) + ' = ' + chr(39) + 'dev' + chr(39))}")
def logistic_coefficients(spark, d):
    m = L.train_model(credit(spark, d).where("sample = 'dev'"), "y", ["l_quantity"], weight="w").fitted
    return spark.createDataFrame([(round(float(m.intercept), 4), round(float(m.coefficients[0]), 4))], "intercept double, coefficient double")


@query(f"with {CREDIT} select l_orderkey, l_linenumber, round(1 / (1 + exp(-(b0 + b1 * l_quantity))), 3) as probability, (b0 + b1 * l_quantity >= 0)::int as prediction from credit, {newton_sql('l_quantity')} where abs(b0 + b1 * l_quantity) > 1e-3")
def logistic_predictions(spark, d):
    """Of a model that was saved and loaded."""
    df = credit(spark, d)
    path = shared_path(spark, "model")
    L.train_model(df, "y", ["l_quantity"]).save(path)
    m = L.ModelTrainer.load(spark, path)
    out = m.predict(m.predict_proba(df)).where((F.col("probability") - 0.5) * (F.col("probability") - 0.5) > 6.2e-8)
    return out.select("l_orderkey", "l_linenumber", F.round("probability", 3).alias("probability"), "prediction")


_SINGLE = ["l_quantity", "l_discount"]


@query(f"with {CREDIT} " + " union all ".join(f"select '{x}' as feature, round(avg(abs(b1 * ({x} - m))), 3) as importance from credit, (select avg({x}) as m from credit), {newton_sql(x)}" for x in _SINGLE))
def importance_linear(spark, d):
    """The mean size of what a feature adds to the log odds, for a model of each feature."""
    df = credit(spark, d)
    tables = [L.train_model(df, "y", [x]).shap_importance(df) for x in _SINGLE]
    return rounded(tables[0].unionByName(tables[1]), 3)


@query("select 'logistic' as model_type, true as has_metadata union all select 'tree', true")
def saved_models(spark, d):
    df, path = credit(spark, d), shared_path(spark, "models")
    for kind in ("logistic", "tree"):
        L.train_model(df, "y", ["l_quantity"], kind).save(f"{path}/{kind}")
    return IO.list_saved_models(spark, path).select("model_type", "has_metadata")


@query()
def train_boosted(spark, d):
    df = credit(spark, d)
    model = L.train_model(df.where("sample = 'dev'"), "y", FEATURES, "xgboost", n_estimators=20, max_depth=3)
    return rounded(M.all_metrics(model.predict_proba(df.where("sample = 'oot'")), "y", "probability"))


_STUMP = ["qty", "l_discount", "l_tax"]
_STUMP_SQL = f"""with {CREDIT}, t as (
  select *, case when l_orderkey % 5 <> 0 then l_quantity end as qty from credit
), b as (
  select sum(w * y) / sum(w) as p from t
), r as (
  select t.*, w * (p - y) as g, w * p * (1 - p) as h from t, b
), f as (
  {" union all ".join(f"select {k} as k, '{x}' as feature, {x} as x, g, h from r" for k, x in enumerate(_STUMP))}
), v as (
  select k, feature, x, sum(g) as g, sum(h) as h from f where x is not null group by all
), a as (
  select k, feature, sum(g) as g, sum(h) as h, coalesce(sum(g) filter (x is null), 0) as mg, coalesce(sum(h) filter (x is null), 0) as mh from f group by all
), c as (
  select k, feature, x as cut, sum(g) over w as gl, sum(h) over w as hl from v window w as (partition by k order by x rows between unbounded preceding and 1 preceding)
), d as (
  select c.k, c.feature, cut, left_too, gl + left_too::int * mg as gl, hl + left_too::int * mh as hl, a.g, a.h
  from c join a on a.k = c.k, (values (false), (true)) m(left_too) where gl is not null and not (left_too and mh = 0)
)
select feature, round(cut, 6) as cut, left_too as missing_left, round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 4) as gain,
  round(-0.3 * gl / (hl + 1), 6) as left_value, round(-0.3 * (g - gl) / (h - hl + 1), 6) as right_value
from d where hl >= 1 and h - hl >= 1 order by gain desc limit 1"""


@query(_STUMP_SQL)
def boosted_stump(spark, d):
    """The first split of second-order boosting, with weights and missing values."""
    df = credit(spark, d).withColumn("qty", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")))
    t = L.train_model(df, "y", _STUMP, "xgboost", weight="w", n_estimators=1, max_depth=1).fitted.trees[0]
    row = (_STUMP[t.feature[0]], t.cut[0], t.missing_left[0], round(t.gain[0], 4), t.value[1], t.value[2])
    return rounded(spark.createDataFrame([row], "feature string, cut double, missing_left boolean, gain double, left_value double, right_value double"))


@query()
def train_leafwise(spark, d):
    """Trees of 31 leaves that are grown by gain."""
    df = credit(spark, d)
    model = L.train_model(df.where("sample = 'dev'"), "y", FEATURES, "lightgbm", n_estimators=5)
    return rounded(M.all_metrics(model.predict_proba(df.where("sample = 'oot'")), "y", "probability"))


@query()
def train_oblivious(spark, d):
    """Symmetric trees, and a category by means of the rows before."""
    df = credit(spark, d)
    model = L.train_model(df.where("sample = 'dev'"), "y", [*FEATURES, "l_returnflag"], "catboost", iterations=10, learning_rate=0.3)
    return rounded(M.all_metrics(model.predict_proba(df.where("sample = 'oot'")), "y", "probability"))


@query()
def early_stopping(spark, d):
    """The held rows' loss after each round, up to three rounds without gain."""
    df = credit(spark, d)
    model = L.train_model(df.where("sample = 'dev'"), "y", FEATURES, "xgboost", n_estimators=15, max_depth=2, learning_rate=0.8, early_stopping_rounds=3).fitted
    return rounded(spark.createDataFrame([(k, v, k <= model.best_round) for k, v in enumerate(model.history)], "round int, loss double, kept boolean"))


@query(f"with {CREDIT}, p as (select avg(y) as p from credit where sample = 'dev'), m as (select l_returnflag, (sum(y) + max(p)) / (count(*) + 1) as m from credit, p where sample = 'dev' group by l_returnflag) select l_orderkey, l_linenumber, round(coalesce(m, p), 6) as l_returnflag from credit left join m using (l_returnflag), p where sample = 'oot'")
def target_statistics(spark, d):
    """A category as the mean target of the rows that were learned from."""
    df = credit(spark, d)
    coder = L.boosting.OrderedStatistics(["l_returnflag"])
    coder.fit(df.where("sample = 'dev'"), "y", ["l_orderkey", "l_linenumber"])
    return rounded(coder.transform(df.where("sample = 'oot'")).select("l_orderkey", "l_linenumber", "l_returnflag"))


@query()
def train_forest(spark, d):
    df = credit(spark, d)
    model = L.train_model(df.where("sample = 'dev'"), "y", FEATURES, "random_forest", n_estimators=30, max_depth=5)
    return rounded(M.all_metrics(model.predict_proba(df.where("sample = 'oot'")), "y", "probability"))


@query("select round(regr_slope(o_totalprice, date_diff('day', timestamp '1995-01-01', o_orderdate)::double), 4) as slope, round(regr_intercept(o_totalprice, date_diff('day', timestamp '1995-01-01', o_orderdate)::double), 3) as intercept from orders")
def linear_regression(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double").alias("x"))
    m = L.train_model(df, "o_totalprice", ["x"], "linear", "regression", solver="normal").fitted
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 3))], "slope double, intercept double")


@query(f"""with {CREDIT}, g as (select score, count(*)::double as n, sum(y)::double as s, row_number() over (order by score) as k from credit group by score),
  r as (select *, sum(n) over o as cn, sum(s) over o as cs from g window o as (order by k rows unbounded preceding)),
  pairs as (select j.k as j, e.k as e, (e.cs - j.cs + j.s) / (e.cn - j.cn + j.n) as mean from r j join r e on e.k >= j.k),
  least as (select j, e, min(mean) over (partition by j order by e desc rows unbounded preceding) as m from pairs),
  fit as (select e as k, max(m) as p from least group by e)
  select 'raw' as method, round(avg((y - score) ** 2), 6) as brier from credit
  union all select 'sigmoid', round(avg((y - 1 / (1 + exp(-(b0 + b1 * score)))) ** 2), 6) from credit, {newton_sql('score')}
  union all select 'isotonic', round(sum(s * (1 - p) ** 2 + (n - s) * p ** 2) / sum(n), 6) from fit join g using (k)""")
def calibrate(spark, d):
    df = scored(spark, d)
    out = [(m, L.brier(L.Calibrator(m).fit(df, "y", "score").transform(df, "score"), "y", "calibrated")) for m in ("sigmoid", "isotonic")]
    return rounded(spark.createDataFrame([("raw", L.brier(df, "y", "score")), *out], "method string, brier double"))


@query()
def cross_validate(spark, d):
    return rounded(L.cross_validate(credit(spark, d), "y", FEATURES, key=["l_orderkey", "l_linenumber"]))


def _fold_sql(f: int) -> str:
    """Accuracy and recall on fold f of a model of the folds before."""
    return f"select {f} as fold, avg(((b0 + b1 * l_quantity >= 0)::int = y)::int) as accuracy, avg((b0 + b1 * l_quantity >= 0)::int) filter (y = 1) as recall from folded, {newton_sql('l_quantity', view='folded', where=f'fold < {f}')} where fold = {f}"


@query(
    f"with {CREDIT}, folded as (select *, ntile(4) over (order by l_shipdate, l_orderkey, l_linenumber) - 1 as fold from credit), f as ({' union all '.join(map(_fold_sql, (1, 2, 3)))}), "
    "m as (select 'accuracy' as metric, accuracy as v from f union all select 'recall', recall from f) select metric, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max from m group by metric"
)
def cross_validate_over_time(spark, d):
    """Models of earlier folds judged on the next, all fitted in the same scans."""
    table = L.cross_validate(credit(spark, d), "y", ["l_quantity"], k=3, method="timeseries", date="l_shipdate", key=["l_orderkey", "l_linenumber"])
    return rounded(table.where(F.col("metric").isin("accuracy", "recall")))


@query()
def calibrated_folds(spark, d):
    """The mean of five fold models, each calibrated on the rows it did not see."""
    df = credit(spark, d)
    model = L.CalibratedModel("logistic").fit(df.where("sample = 'dev'"), "y", ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"])
    return rounded(model.predict_proba(df.where("sample = 'oot'")).select("l_orderkey", "l_linenumber", "probability"), 3)


@query(f"with {CREDIT} select l_orderkey, l_linenumber, round(least(greatest(500 + 20 / ln(2) * ln((1 - p) / p), 300), 900), 6) as credit_score from (select l_orderkey, l_linenumber, least(greatest(score, 1e-12), 1 - 1e-12) as p from credit)")
def credit_score(spark, d):
    return rounded(scored(spark, d).select("l_orderkey", "l_linenumber", S.credit_score(F.col("score")).alias("credit_score")))


@query(_table_sql(long_sql(), "feature, bin_idx, round(-0.8 * woe * 20 / ln(2), 6) as points"))
def scorecard_points(spark, d):
    df = credit(spark, d)
    t = _woe(df, B.WoeBinner(5).fit(df, features=FEATURES, target="y"))
    return rounded(t.select("feature", "bin_idx", S.points_column(0.8, F.col("woe")).alias("points")))


def _fixed_scorecard(spark, d) -> S.Scorecard:
    """A scorecard with a coefficient of 0.8 for l_quantity and an intercept of -0.7."""
    df = credit(spark, d)
    card = S.Scorecard()
    card.binner = B.WoeBinner(5).fit(df, features=["l_quantity"], target="y")
    card.base_points = card.offset + card.factor * 0.7
    card.points = {"l_quantity": {k: -0.8 * w * card.factor for k, w in card.binner.rules["l_quantity"].woe.items()}}
    return card


CARD = f"with {CREDIT}, c as ({long_sql(5, ['l_quantity'])}), t as ({woe_sql('select * from c', 'feature')}), b as (select l_orderkey, l_linenumber, {case_sql('l_quantity', 5)} as bin_idx from credit, {cuts_sql('l_quantity', 5)}), s as (select l_orderkey, l_linenumber, 600 - 20 / ln(2) * ln(50) + 20 / ln(2) * 0.7 - 0.8 * woe * 20 / ln(2) as s from b join t using (bin_idx))"


@query(CARD + " select l_orderkey, l_linenumber, round_even(s, 0) as score, (round_even(s, 0) >= 600)::int as approved from s")
def scorecard_score(spark, d):
    card = _fixed_scorecard(spark, d)
    return card.predict(card.score(credit(spark, d))).select("l_orderkey", "l_linenumber", "score", "approved")


@query(CARD + " select l_orderkey, l_linenumber, round(1 / (1 + exp(-((600 - 20 / ln(2) * ln(50)) - s) / (20 / ln(2)))), 6) as p_bad from s")
def scorecard_proba(spark, d):
    return rounded(_fixed_scorecard(spark, d).predict_proba(credit(spark, d)).select("l_orderkey", "l_linenumber", "p_bad"))


@query(f"""with {CREDIT}, c as ({long_sql(5, ['l_quantity'])}), t as ({woe_sql('select * from c', 'feature')}), b as (select y, {case_sql('l_quantity', 5)} as bin_idx from credit, {cuts_sql('l_quantity', 5)}), r as (select y, woe from b join t using (bin_idx)),
  m as (select * from {newton_sql('woe', view='r')}), p as (select -b1 * woe * 20 / ln(2) as points from t, m) select 'l_quantity' as feature, round(min(points), 3) as min_points, round(max(points), 3) as max_points, round(max(points) - min(points), 3) as range from p""")
def scorecard_one_feature(spark, d):
    df = credit(spark, d)
    return rounded(S.build_scorecard(df, "y", ["l_quantity"]).summary(df), 3)


@query()
def scorecard_fitted(spark, d):
    df = credit(spark, d)
    return rounded(S.build_scorecard(df, "y", FEATURES).summary(df))


@query()
def auto_pipeline(spark, d):
    from .functions.basics import Roles
    from .plans.pipeline import AutoPipeline

    roles = Roles(target="y", sample="sample", weight="w", temporal="period", excluded=["l_orderkey", "l_linenumber", "l_shipdate", "price"])
    pipe = AutoPipeline(roles).fit(credit(spark, d))
    pipe.release()
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in sorted(pipe.metrics.items())], "metric string, value double"))


def _one_feature_sql() -> str:
    """Ranking metrics of a model of one binned feature: its scores stand in the order of WOE."""
    bins = f"b as (select sample, y, {case_sql('l_quantity', 5)} as bin_idx from credit, {cuts_sql('l_quantity', 5, 'credit', chr(34) + 'sample' + chr(34) + ' = ' + chr(39) + 'dev' + chr(39))})"
    sums = "select bin_idx, count(*)::double as n, count(*)::double as w, sum(y)::double as bad from b where sample = 'dev' group by bin_idx"
    return f"""with {CREDIT}, {bins}, t as ({woe_sql(sums)}), g as (select sample, woe as score, sum(y)::double as bad, sum(1 - y)::double as good from b join t using (bin_idx) group by all),
      u as (select *, sum(bad) over o as cb, sum(good) over o as cg, sum(bad) over (partition by sample) as tb, sum(good) over (partition by sample) as tg from g window o as (partition by sample order by score desc rows unbounded preceding)),
      m as (select sample, max(abs(cb / tb - cg / tg)) as ks, sum(bad * ((tg - cg) + good / 2)) / (any_value(tb) * any_value(tg)) as auc from u group by sample)
      select sample || '_ks' as metric, round(ks, 6) as value from m union all select sample || '_auc', round(auc, 6) from m union all select sample || '_gini', round(2 * auc - 1, 6) from m"""


@query(_one_feature_sql())
def auto_pipeline_one_feature(spark, d):
    """Metrics of a pipeline whose artifact was saved, loaded and used to score."""
    from .functions.basics import Roles
    from .plans.pipeline import AutoPipeline, ScoringArtifact

    df = credit(spark, d).select("l_quantity", "y", "sample")
    pipe = AutoPipeline(Roles(target="y", sample="sample"), threshold=-1.0).fit(df)
    pipe.release()
    path = shared_path(spark, "artifact")
    pipe.artifact.save(path)
    found = M.ks_auc(ScoringArtifact.load(spark, path).score(df, "score"), "y", "score", by=["sample"])
    pairs = F.explode(F.array(*[F.struct(F.concat("sample", F.lit(f"_{m}")).alias("metric"), F.col(m).alias("value")) for m in ("ks", "auc", "gini")]))
    return rounded(found.select(pairs.alias("p")).select("p.*"))


@query("""with o as (select o_totalprice as y, date_diff('day', timestamp '1995-01-01', o_orderdate)::double as x, case when o_orderkey % 4 = 0 then 'oot' else 'dev' end as sample from orders),
  l as (select regr_slope(y, x) as a, regr_intercept(y, x) as b from o where sample = 'dev'), m as (select sample, avg(y) as m from o group by sample), e as (select sample, y - (a * x + b) as e, y - m as c from o join m using (sample), l),
  s as (select sample, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, 1 - sum(e * e) / sum(c * c) as r2 from e group by sample)
  select sample || '_rmse' as metric, round(rmse, 2) as value from s union all select sample || '_mae', round(mae, 2) from s union all select sample || '_r2', round(r2, 6) from s""")
def regression_pipeline(spark, d):
    from .functions.basics import Roles
    from .plans.pipeline import RegressionPipeline

    df = table(spark, d, "orders").select(F.col("o_totalprice").alias("y"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double").alias("x"), F.when(F.col("o_orderkey") % 4 == 0, "oot").otherwise("dev").alias("sample"))
    pipe = RegressionPipeline(Roles(target="y", sample="sample"), solver="normal").fit(df)
    return spark.createDataFrame([(k, round(v, 6 if k.endswith("r2") else 2)) for k, v in pipe.metrics.items()], "metric string, value double")


@query("select 'r' || n_nationkey as run_id, n_name as model_type, n_nationkey / 100::double as auc from nation")
def run_history(spark, d):
    """Runs archived and read back as a table."""
    import os

    from .plans import runs

    folder = shared_path(spark, "runs").removeprefix("file://")
    os.makedirs(f"{folder}/out")
    for r in table(spark, d, "nation").collect():
        runs.archive_run(f"{folder}/out", f"{folder}/runs", metrics={"auc": r["n_nationkey"] / 100, "none": float("nan")}, model_type=r["n_name"], run_id=f"r{r['n_nationkey']}")
    return runs.runs_table(spark, f"{folder}/runs").select("run_id", "model_type", "metrics.auc")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return binning_with_woe(spark, d)
