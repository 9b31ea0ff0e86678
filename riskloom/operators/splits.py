"""Train and test, stratified, time-ordered, k-fold and development / out-of-time splits.

Random splits order rows by a hash of a key and a seed, so they are exact in size and the
same on every run and cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import ValidationError
from ..functions.basics import LOG, col, fresh, require
from ..functions.quantiles import ranges_for, ranked


@dataclass
class DatasetSplit:
    dev: DataFrame
    oot: DataFrame
    dropped: int = 0

    def validate(self, target: str) -> DatasetSplit:
        for name, df in (("dev", self.dev), ("oot", self.oot)):
            require(df, target)
            if not df.limit(1).count():
                raise ValidationError(f"{name} is empty")
        return self


def hashed(key: list[str], seed: int) -> Column:
    return F.xxhash64(*[col(k) for k in key], F.lit(seed))


def _within(df: DataFrame, by: str, key: list[str], seed: int, ranges: int | None = None, k: str = "_k", n: str = "_n") -> DataFrame:
    """Adds k, a row's number in its class by hash, and n, the class's rows; classes are dealt in ranges of the hash."""
    taken = [*df.columns, k, n]
    h, r, c, s, m, b = (fresh(taken, f"_{x}") for x in "hrcsmb")
    rows = df.withColumn(h, hashed(key, seed))
    shares = ranges or ranges_for(df.count())
    rows = rows.withColumn(r, F.pmod(F.shiftright(h, 40), F.lit(shares)))
    counts = rows.groupBy(col(by).alias(c), r).agg(F.count(F.lit(1)).alias(m))
    before = F.coalesce(F.sum(m).over(W.partitionBy(c).orderBy(r).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = counts.select(c, F.col(r).alias(s), before.alias(b), F.sum(m).over(W.partitionBy(c)).alias(n))
    place = F.row_number().over(W.partitionBy(col(by), r).orderBy(h, *[col(x) for x in key]))
    out = rows.withColumn(k, place).join(known, col(by).eqNullSafe(F.col(c)) & (F.col(r) == F.col(s)))
    return out.withColumn(k, F.col(k) + F.col(b)).drop(c, h, r, s, b)


def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.2, shuffle: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """int(n * test_size) rows to test: by hash, or the last ones in order of the key.

    Shuffled, the cut is a quantile of the hash found from counts of hash ranges; no task orders all rows.
    """
    if not 0 < test_size < 1:
        raise ValidationError("test_size lies between 0 and 1")
    n = df.count()
    n_test = int(n * test_size)
    h, r, k = (fresh(df.columns, f"_{x}") for x in "hrk")
    if not shuffle:
        rows = ranked(df, list(key), n, name=k)
        return rows.where(F.col(k) <= n - n_test).drop(k), rows.where(F.col(k) > n - n_test).drop(k)
    rows = df.withColumn(h, hashed(key, seed))
    counts = rows.groupBy(F.shiftright(h, 48).alias("r")).agg(F.count(F.lit(1)).alias("n")).orderBy("r").collect()  # 2**16 ranges at most
    left, edge = n - n_test, None
    for x in counts:
        if x["n"] > left:
            edge = x["r"]
            break
        left -= x["n"]
    place = F.row_number().over(W.partitionBy(r).orderBy(h, *[col(x) for x in key]))
    rows = rows.withColumn(r, F.shiftright(h, 48))
    if edge is None:
        return df, df.limit(0)
    inside = rows.where(F.col(r) == edge).withColumn(k, place)
    drop = (h, r, k)
    train = rows.where(F.col(r) < edge).drop(*drop).unionByName(inside.where(F.col(k) <= left).drop(*drop))
    test = rows.where(F.col(r) > edge).drop(*drop).unionByName(inside.where(F.col(k) > left).drop(*drop))
    return train, test


def stratified_split(df: DataFrame, target: str, key: list[str], test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Of each class its rounded share to test."""
    k, n = fresh(df.columns, "_k"), fresh(df.columns, "_n")
    rows = _within(df, target, key, seed, k=k, n=n)
    test = F.col(k) <= F.bround(F.col(n) * test_size)
    return rows.where(~test).drop(k, n), rows.where(test).drop(k, n)


def time_series_split(df: DataFrame, date: str, key: list[str], test_size: float = 0.2, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """The last rows in order of (date, key) to test; ``gap`` rows before them to neither."""
    n = df.count()
    n_test = int(n * test_size)
    if gap < 0 or n - n_test - gap <= 0 or n_test <= 0:
        raise ValidationError("nothing is left to train or to test on")
    k = fresh(df.columns, "_k")
    rows = ranked(df, [date, *[x for x in key if x != date]], n, name=k)
    return rows.where(F.col(k) <= n - n_test - gap).drop(k), rows.where(F.col(k) > n - n_test).drop(k)


def kfold(df: DataFrame, k: int = 5, key: list[str] = (), shuffle: bool = False, seed: int = 42, stratify: str | None = None, name: str = "fold") -> DataFrame:
    """Adds the fold 0..k-1: contiguous in the key's order, or by hash; the first n % k folds have one row more."""
    if k < 2:
        raise ValidationError("at least two folds")
    p, m, h = (fresh([*df.columns, name], x) for x in ("_k", "_n", "_h"))
    if stratify:
        rows = _within(df, stratify, list(key), seed, k=p, n=m)
    else:
        n = df.count()
        rows = ranked(df.withColumn(h, hashed(list(key), seed)), [h, *key], n, name=p).drop(h) if shuffle else ranked(df, list(key), n, name=p)
        rows = rows.withColumn(m, F.lit(n))
    # as ntile: the first n % k folds take a row more
    low, more = F.expr(f"{m} div {k}"), F.col(m) % k
    at = F.col(p) - 1
    edge = more * (low + 1)
    fold = F.when(at < edge, F.floor(F.try_divide(at, low + 1))).otherwise(more + F.floor(F.try_divide(at - edge, low)))
    return rows.withColumn(name, fold.cast("int")).drop(p, m)


def cv_folds(df: DataFrame, k: int = 5, method: str = "stratified", target: str | None = None, key: list[str] = (), date: str | None = None, seed: int = 42, name: str = "fold") -> tuple[DataFrame, list[tuple[frozenset[int], int]]]:
    """df with a fold, and for each split the folds that train and the one that tests; timeseries trains on all earlier folds."""
    if method == "stratified":
        folded = kfold(df, k, key, True, seed, target, name)
    elif method == "kfold":
        folded = kfold(df, k, key, True, seed, name=name)
    elif method == "timeseries":
        return kfold(df, k + 1, [date, *key], name=name), [(frozenset(range(f)), f) for f in range(1, k + 1)]
    else:
        raise ValidationError(f"no such method: {method}")
    return folded, [(frozenset(range(k)) - {f}, f) for f in range(k)]


def cv_splits(df: DataFrame, k: int = 5, method: str = "stratified", target: str | None = None, key: list[str] = (), date: str | None = None, seed: int = 42):
    """(train, test) of each fold; timeseries trains on all earlier folds."""
    name = fresh(df.columns, "fold")
    folded, splits = cv_folds(df, k, method, target, key, date, seed, name)
    for train, f in splits:
        yield folded.where(F.col(name).isin(sorted(train))).drop(name), folded.where(F.col(name) == f).drop(name)


def split_dev_oot(df: DataFrame, sample: str | None = None, date: str | None = None, oot_start=None, target: str | None = None, key: list[str] = (), test_size: float = 0.2, dev: str = "dev", oot: str = "oot") -> DatasetSplit:
    """By a sample label, else by a date (dev before oot_start), else at random by class."""
    if sample:
        require(df, sample)
        label = F.lower(col(sample).cast("string"))
        yes = lambda c: F.coalesce(F.max(c), F.lit(False))
        found = df.agg(yes(label.isin(dev, oot)).alias("named"), yes(~label.isin("0", "1")).alias("other")).first()
        a, b = (dev, oot) if found["named"] or found["other"] else ("1", "0")
        dropped = df.where(label.isNull() | ~label.isin(a, b)).count()
        if dropped:
            LOG.warning("%d rows are neither %s nor %s", dropped, dev, oot)
        return DatasetSplit(df.where(label == a), df.where(label == b), dropped)
    if date:
        require(df, date)
        return DatasetSplit(df.where(col(date) < F.lit(oot_start)), df.where(col(date) >= F.lit(oot_start)))
    if not target or not key:
        raise ValidationError("a random split needs a target and a key")
    return DatasetSplit(*stratified_split(df, target, list(key), test_size))
