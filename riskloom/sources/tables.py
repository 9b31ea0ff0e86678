"""Readers and writers by suffix: csv, parquet, json, orc, xlsx, pickle and SQL."""

from __future__ import annotations

import json
import pickle
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import ConfigurationError
from ..functions.basics import col, ensure_dataframe, plain
from .shared import get_bytes, put_bytes
from .workbooks import load_excel, sheet_names, write_workbooks, write_xlsx


def load_csv(spark: SparkSession, path: str, columns: list[str] | None = None, n_rows: int | None = None, skip_rows: int = 0, has_header: bool = True, separator: str = ",", encoding: str = "utf-8", null_values: list[str] = (), schema: str | None = None) -> DataFrame:
    """A schema spares the pass that infers it. skip_rows drops lines at the head of a single file, less than its first split."""
    how = {"header": has_header, "sep": separator, "encoding": encoding, "inferSchema": schema is None}
    reader = spark.read.options(**how)
    if schema:
        reader = reader.schema(schema)
    if skip_rows:
        # a split's lines are numbered in order, so the head of the file is known without a sort
        lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
        kept = lines.where((F.col("at") > 0) | (F.col("k") >= skip_rows)).select("value")
        strings = getattr(kept._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        df = DataFrame(reader._jreader.csv(strings), spark)
    else:
        df = reader.csv(path)
    if null_values:
        df = df.withColumns({c: F.when(~F.coalesce(col(c).cast("string").isin(list(null_values)), F.lit(False)), col(c)) for c in df.columns})
    if columns:
        df = df.select(*map(col, columns))
    return df.limit(n_rows) if n_rows is not None else df


def load_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*map(col, columns)) if columns else df
    return df.limit(n_rows) if n_rows is not None else df


def _bytes(spark: SparkSession, path: str) -> bytes:
    """A file's content by Spark's readers, so that any store will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def load_pickle(spark: SparkSession, path: str) -> DataFrame:
    """A pickled pandas frame or dict of columns. Only from sources you trust: pickles run code."""
    return ensure_dataframe(pickle.loads(_bytes(spark, path)), spark)


def load_sql(spark: SparkSession, query: str, url: str | None = None, **options) -> DataFrame:
    """A query over catalog tables and views, or over JDBC if a url is given: see load_jdbc for reads in partitions."""
    if url is None:
        return spark.sql(query)
    return load_jdbc(spark, query, url, **options)


def load_jdbc(spark: SparkSession, query: str, url: str, partition_column: str | None = None, partitions: int = 8, bounds: tuple | None = None, predicates: list[str] | None = None, fetch_size: int = 10_000, **options) -> DataFrame:
    """A query or a table's name over JDBC; Spark pushes columns and filters down to the database.

    Tasks read ranges of partition_column, a number, date or timestamp of the result, between
    bounds (its least and greatest value where none are given; rows beyond them and nulls are
    read too), or the rows of one of the predicates each. Else one task reads all.
    """
    table = f"({query}) q" if re.search(r"\s", query.strip()) else query
    options = {"url": url, "fetchsize": str(fetch_size)} | options
    if predicates:
        if partition_column:
            raise ConfigurationError("either a partition column or predicates")
        rest = {k: str(v) for k, v in options.items() if k != "url"}
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=rest)
    if partition_column:
        if bounds is None:
            ends = f"(select min({partition_column}) as a, max({partition_column}) as b from {table}) e"
            bounds = tuple(spark.read.format("jdbc").options(**options, dbtable=ends).load().first())
        if bounds[0] is not None:
            options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options, dbtable=table).load()


def load_data(spark: SparkSession, source, **how) -> DataFrame:
    """A path by its suffix, or {"type": ..., "path" or "query": ..., options}."""
    if isinstance(source, dict):
        rest = dict(source)
        kind = rest.pop("type")
        if kind == "sql":
            return load_sql(spark, **rest | how)
        path = rest.pop("path")
        how = rest | how
    else:
        path, kind = str(source), Path(str(source)).suffix.lstrip(".").lower()
    readers = {"csv": load_csv, "parquet": load_parquet, "pkl": load_pickle, "pickle": load_pickle, "xlsx": load_excel, "xls": _no_xls, "json": lambda s, p, **k: s.read.json(p, **k), "orc": lambda s, p, **k: s.read.orc(p, **k)}
    if kind not in readers:
        raise ConfigurationError(f"no reader for {kind!r}")
    return readers[kind](spark, path, **how)


def _no_xls(*_, **__):
    raise ConfigurationError("workbooks of the binary .xls format are not read; save them as .xlsx")


def load_csv_pandas(spark: SparkSession, path: str, **how):
    """As load_csv, as a pandas frame on the driver: for small files."""
    return load_csv(spark, path, **how).toPandas()


def load_excel_pandas(spark: SparkSession, path: str, **how):
    return load_excel(spark, path, **how).toPandas()


def save_dataframe(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> str:
    kind = kind or Path(path).suffix.lstrip(".").lower() or "parquet"
    if kind == "xlsx":
        write_xlsx({"Sheet1": df}, path)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind in ("parquet", "json", "orc"):
        getattr(df.write.mode(mode), kind)(path)
    else:
        raise ConfigurationError(f"no writer for {kind!r}")
    return path


def load_dataframe(spark: SparkSession, path: str, kind: str | None = None, **how) -> DataFrame:
    """What save_dataframe wrote: csv, parquet, json, orc or xlsx, by suffix or as named."""
    kind = kind or Path(path).suffix.lstrip(".").lower() or "parquet"
    if kind not in ("csv", "parquet", "json", "orc", "xlsx"):
        raise ConfigurationError(f"no reader for {kind!r}")
    return load_data(spark, {"type": kind, "path": path}, **how)


def save_json(data: dict, path: str) -> str:
    """Keys become strings; numbers that are not finite become null. A path with a scheme is on that store, else on the driver's disk."""
    text = json.dumps(plain(data), indent=2, ensure_ascii=False, allow_nan=False)
    if "://" in path:
        return put_bytes(text.encode(), path)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return path


def load_json(path: str) -> dict:
    if "://" not in path:
        return json.loads(Path(path).read_text())
    text = get_bytes(path)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


save_config, load_config = save_json, load_json


def save_binning(binner, path: str) -> str:
    """A fitted WoeBinner's rules."""
    return save_json(binner.to_dict(), path)


def load_binning(path: str):
    from ..operators.binning import WoeBinner

    return WoeBinner.from_dict(load_json(path))


def save_woe_mapping(binner, path: str) -> str:
    """{feature: {bin: WOE}}"""
    return save_json({f: binner.woe_dict(f) for f in binner.rules}, path)


def load_woe_mapping(path: str) -> dict[str, dict[int, float]]:
    return {f: {int(k): v for k, v in found.items()} for f, found in load_json(path).items()}


def list_saved_models(spark: SparkSession, folder: str) -> DataFrame:
    """path, model_type, has_metadata, size_kb of models below a folder, on any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    roots = files.select(F.regexp_extract("path", r"^(.*)/metadata/part-[^/]*$", 1).alias("root")).where("root <> ''").distinct().orderBy("root").collect()
    roots = [r["root"] for r in roots]  # a few for each model
    inside = lambda r, more="": F.startswith("path", F.lit(f"{r}/{more}"))
    found = files.agg(*[e.alias(f"{n}{k}") for k, r in enumerate(roots) for n, e in (("m", F.max(inside(r, "model/"))), ("b", F.sum(F.when(inside(r), F.col("length")))))]).first() if roots else {}
    out = []
    for k, r in enumerate(roots):
        if found[f"m{k}"]:
            text = spark.read.text(f"{r}/metadata").first()
            out.append((r.removeprefix("file:"), json.loads(text[0]).get("model_type") if text else None, True, found[f"b{k}"] / 1024))
    return spark.createDataFrame(out, "path string, model_type string, has_metadata boolean, size_kb double")
