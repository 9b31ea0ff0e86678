"""Exact quantiles, weighted quantiles and running sums that need no task to hold all rows.

Spark's percentile keeps a map of all distinct values of all columns in one task; tables above
SMALL rows are searched by digits instead. A double's bits, negative ones turned over, are in
the order of the values. A scan counts, for all columns and quantiles at once, the values
whose leading digits are known by the next digit of DIGIT bits; tasks add up their rows, a
shuffle adds up the tasks, and running sums there tell the digit that a quantile has. Scans end
as soon as all values of a digit are the same, after 64 / DIGIT at the latest, whatever the
numbers of rows, columns and quantiles; the driver sees one row a column and quantile.

Running sums over a value's order go through ranges of the value: sums within
a range by a window, and the sums of earlier ranges from a table of one row a range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import ValidationError
from .basics import fresh

#: Rows up to which Spark's percentile keeps all values of all columns in one task.
SMALL = 20_000
#: Bits of a digit, and counts that a task holds before it adds them up.
DIGIT, HELD = 16, 400_000
#: Rows that a task takes at once.
AT_ONCE = 65_536
#: Rows of one range, and ranges at most; beyond that ranges grow.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096


def check(qs: list[float]) -> list[float]:
    if any(not 0 <= q <= 1 for q in qs):
        raise ValidationError("quantiles lie in [0, 1]")
    return [float(q) for q in qs]


def percentiles(x: Column, qs: list[float]) -> Column:
    """Linear quantiles as an array expression; for tables that fit the small way."""
    return F.percentile(x, [float(q) for q in check(qs)])


def finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def exact_quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float], small: int = SMALL, bracketed: int | None = None) -> dict[str, list[float] | None]:
    """Linear quantiles of each expression's finite values; None where there are none. bracketed changes nothing any more."""
    qs, names = check(qs), list(columns)
    if not names or not qs:
        return {n: [] for n in names}
    values = df.select(*[finite(c).alias(f"_{k}") for k, c in enumerate(columns.values())])
    counts = values.agg(*[F.count(f"_{k}") for k in range(len(names))]).first()
    if max(counts) <= small:
        row = values.agg(*[percentiles(F.col(f"_{k}"), qs).alias(f"_{k}") for k in range(len(names))]).first()
        return {n: row[k] for k, n in enumerate(names)}
    found = _plain(values, counts, qs)
    return {n: found.get(k) for k, n in enumerate(names)}


def _plain(values: DataFrame, counts: list[int], qs: list[float]) -> dict[int, list[float]]:
    """Linear quantiles of the columns _0, _1, ... by the ranks on both sides of each."""
    ranks = {(k, float(r)) for k, n in enumerate(counts) if n for q in qs for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    found = {t: g.low for t, g in _search(values, ranks, None).items()}
    out = {}
    for k, n in enumerate(counts):
        if n:
            at = [q * (n - 1) for q in qs]
            out[k] = [found[k, float(math.floor(a))] + (found[k, float(math.ceil(a))] - found[k, float(math.floor(a))]) * (a - math.floor(a)) for a in at]
    return out


def lower_quantiles(values: DataFrame, counts: list[int], qs: list[float]) -> list[list[float]]:
    """Of the columns _0, _1, ... with these numbers of values, which are not NaN: for each q the least value that a share q of the values is at most."""
    ranks = [[float(max(0, math.ceil(q * n) - 1)) for q in qs] if n else [] for n in counts]
    found = _search(values, {(k, r) for k, each in enumerate(ranks) for r in each}, None)
    return [[found[k, r].low for r in each] for k, each in enumerate(ranks)]


class _Group:
    """Rows of a target's leading digits: what they weigh, what lies before them, and their ends with the weights there."""

    def __init__(self, before: float, weight: float, low: float, high: float, first: float, last: float, previous, following):
        self.before, self.weight, self.low, self.high, self.first, self.last = before, weight, low, high, first, last
        #: (value, greatest weight) of the next lesser value, (value, least weight) of the next greater one
        self.previous, self.following = previous, following


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)


def _from_bits(key: np.ndarray) -> np.ndarray:
    """The numbers that ordered_bits made these of."""
    bits = key.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(-(2**63)), ~bits).view(np.float64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about AT_ONCE rows, none of them empty."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _search(values: DataFrame, targets: set[tuple[int, float]], weighted: set[int] | None) -> dict[tuple[int, float], _Group]:
    """The group of equal values that each target lies in: a column's number, and the weight (or rows) before the place.

    weighted: columns whose rows count by ``_w``.
    """
    spark, state = values.sparkSession, {t: (0, t[1], _Group(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, None, None)) for t in targets}
    done: dict[tuple[int, float], _Group] = {}
    for level in range(64 // DIGIT):
        names = sorted(state)
        if not names:
            break
        rows = [(i, t[0], state[t][0], state[t][1]) for i, t in enumerate(names)]
        known = {k: np.unique([np.uint64(state[t][0]) for t in names if t[0] == k]) for k in {t[0] for t in names}}
        hist = _histograms(values, level, known, weighted or set())
        each = W.partitionBy("k", "prefix").orderBy("digit")
        upto = each.rowsBetween(W.unboundedPreceding, 0)
        placed = hist.withColumns({
            "cum": F.sum("n").over(upto), "before": F.coalesce(F.sum("n").over(each.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "previous": F.lag("high").over(each), "following": F.lead("low").over(each),
        })
        wanted = F.broadcast(spark.createDataFrame(rows, "t int, k int, prefix long, r double"))  # a row a column and quantile
        hit = (F.col("r") >= F.col("before")) & ((F.col("r") < F.col("cum")) | F.col("following").isNull())
        for r in placed.join(wanted, ["k", "prefix"]).where(hit).collect():
            t = names[r["t"]]
            prefix, local, parent = state[t]
            ends = [None if e is None else (e["x"], e["w"]) for e in (r["previous"], r["following"])]
            g = _Group(parent.before + r["before"], r["n"], r["low"]["x"], r["high"]["x"], r["low"]["w"], r["high"]["w"], ends[0] or parent.previous, ends[1] or parent.following)
            if g.low == g.high:
                done[t] = g
                del state[t]
            else:
                state[t] = ((prefix << DIGIT) | r["digit"], local - r["before"], g)
    return done


def _histograms(values: DataFrame, level: int, known: dict[int, np.ndarray], weighted: set[int]) -> DataFrame:
    """k, prefix, digit, n, low, high: weights, and least and greatest values x with their least and greatest weights w, by the next digit of values with known leading digits."""
    shift, columns = 64 - DIGIT * (level + 1), sorted(known)
    names = ["k", "prefix", "digit", "n", "low", "wlow", "high", "whigh"]

    def add_up(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        k, prefix, digit, n, low, wlow, high, whigh = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((digit, prefix, k))
        k, prefix, digit = k[order], prefix[order], digit[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (prefix[1:] != prefix[:-1]) | (digit[1:] != digit[:-1])
        lead = np.flatnonzero(new)
        if not len(lead):
            return parts[0]
        group = np.cumsum(new) - 1
        low, wlow, high, whigh = (x[order] for x in (low, wlow, high, whigh))
        least, most = np.minimum.reduceat(low, lead), np.maximum.reduceat(high, lead)
        first = np.minimum.reduceat(np.where(low == least[group], wlow, np.inf), lead)
        last = np.maximum.reduceat(np.where(high == most[group], whigh, -np.inf), lead)
        return [k[lead], prefix[lead], digit[lead], np.add.reduceat(n[order], lead), least, first, most, last]

    def batch_of(total: list[np.ndarray]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.float64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(total, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in _together(batches):
            for k in columns:
                x = b[f"_{k}"]
                some = x.is_valid().to_numpy(zero_copy_only=False)
                x = x.to_numpy(zero_copy_only=False)[some] + 0.0
                key = ordered_bits(x)
                if k not in weighted:  # in order, a digit's values are a stretch that begins with the least and ends with the greatest
                    if level:
                        prefix = key >> np.uint64(shift + DIGIT)
                        at = np.minimum(np.searchsorted(known[k], prefix), len(known[k]) - 1)
                        key = key[known[k][at] == prefix]
                    if len(key):
                        key = np.sort(key)
                        top = key >> np.uint64(shift)
                        lead = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
                        ends = np.append(lead[1:], len(key))
                        digit = (top[lead] & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                        prefix = (top[lead] >> np.uint64(DIGIT)).astype(np.int64) if level else np.zeros(len(lead), np.int64)
                        one = np.ones(len(lead))
                        held.append([np.full(len(lead), k), prefix, digit, (ends - lead).astype(np.float64), _from_bits(key[lead]), one, _from_bits(key[ends - 1]), one])
                        n += len(lead)
                    continue
                w = b["_w"].to_numpy(zero_copy_only=False)[some]
                if level:
                    prefix = key >> np.uint64(shift + DIGIT)
                    at = np.minimum(np.searchsorted(known[k], prefix), len(known[k]) - 1)
                    here = known[k][at] == prefix
                    x, w, key, prefix = x[here], w[here], key[here], prefix[here].astype(np.int64)
                else:
                    prefix = np.zeros(len(x), np.int64)
                if len(x):
                    digit = ((key >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                    held.append(add_up([[np.full(len(x), k), prefix, digit, w, x, w, x, w]]))
                    n += len(held[-1][0])
            if n > HELD:
                held = [add_up(held)]
                n = len(held[0][0])
                if n > HELD // 2:
                    yield batch_of(held[0])
                    held, n = [], 0
        if held:
            yield batch_of(add_up(held))

    used = [f"_{k}" for k in columns] + (["_w"] if weighted & set(columns) else [])
    sums = values.select(*used).mapInArrow(run, "k int, prefix long, digit int, n double, low double, wlow double, high double, whigh double").repartition("k", "prefix")
    return sums.groupBy("k", "prefix", "digit").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("low").alias("x"), F.col("wlow").alias("w"))).alias("low"), F.max(F.struct(F.col("high").alias("x"), F.col("whigh").alias("w"))).alias("high"))


def running(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False, ties: tuple[str, ...] = (), ranges: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums (rows up to and including this one) in the order of a numeric column.

    sums: name of the sum -> column. ranges: how many ranges of ``by``; by default one for
    each RANGE_ROWS rows. Rows of equal ``by`` stay in one range. within: columns whose
    values each have running sums of their own.
    """
    order = [F.desc(by) if descending else F.asc(by), *map(F.asc, ties)]
    keys = list(within)
    if ranges is None:
        ranges = ranges_for(df.count())
    if ranges <= 1:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    taken = [*df.columns, *sums]
    part = fresh(taken, "_range")
    total = [fresh(taken, f"_total{k}") for k in range(len(sums))]
    place = range_of(df, by, ranges)
    dealt = df.withColumn(part, -place if descending else place)
    w = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, part).agg(*[F.sum(c).alias(t) for t, c in zip(total, sums.values(), strict=True)])
    totals = totals.select(*keys, part, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(t) for t in total])
    if not keys:
        totals = F.broadcast(totals)  # one row a range, MOST_RANGES at most
    out = dealt.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(totals, [*keys, part])
    return out.withColumns({n: F.col(n) + F.col(t) for n, t in zip(sums, total, strict=True)}).drop(part, *total)


def ranges_for(n: int) -> int:
    return max(1, min(MOST_RANGES, n // RANGE_ROWS))


def bisect(bounds: list, x: Column) -> Column:
    """How many of the sorted bounds are at most x, by halving; 0 for null."""
    values = F.array(*[F.lit(b) for b in bounds])
    start = F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["a"] + s["b"], 1)
        above = (s["a"] < s["b"]) & F.coalesce(F.get(values, middle) <= x, F.lit(False))
        return F.struct(F.when(above, middle + 1).otherwise(s["a"]).alias("a"), F.when(above, s["b"]).otherwise(middle).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["a"])


def range_of(df: DataFrame, by: str, ranges: int) -> Column:
    """The range of a row, 0 for the least values: about as many rows each, equal values together."""
    found = df.agg(F.percentile_approx(by, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    return bisect(bounds, F.col(by))


def ranked(df: DataFrame, order: list[str], n: int, ranges: int | None = None, name: str = "_k") -> DataFrame:
    """Adds a row's number from 1 in an order that begins with a number or a time, without one task for all."""
    one = fresh([*df.columns, name], "_one")
    rows = df.withColumn(one, F.lit(1))
    return running(rows, order[0], {name: one}, ties=tuple(order[1:]), ranges=ranges_for(n) if ranges is None else ranges).drop(one)


def weighted_quantiles_of(df: DataFrame, columns: dict[str, Column], weight: Column, qs: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of each expression's finite values, interpolated at (running weight - weight / 2) / total weight of each row.

    Rows go by value, then weight, so of equal values only the first and the last row matter.
    Equal weights give plain linear quantiles. None where there are no values.
    """
    qs, names = check(qs), list(columns)
    if not names or not qs:
        return {n: [] for n in names}
    w = finite(weight)
    values = df.select(w.alias("_w"), *[F.when(w.isNotNull(), finite(c)).alias(f"_{k}") for k, c in enumerate(columns.values())])
    mine = lambda k: F.when(F.col(f"_{k}").isNotNull(), F.col("_w"))
    about = values.agg(*[e for k in range(len(names)) for e in (F.count(f"_{k}"), F.sum(mine(k)), F.min(mine(k)), F.max(mine(k)))]).first()
    counts, totals = about[0::4], about[1::4]
    even = [about[4 * k + 2] == about[4 * k + 3] for k in range(len(names))]
    out: dict[str, list[float] | None] = {}
    if any(even):
        found = _plain(values, [n if e else 0 for n, e in zip(counts, even, strict=True)], qs)
        out = {n: found.get(k) for k, n in enumerate(names) if even[k]}
    uneven = {k for k in range(len(names)) if not even[k]}
    groups = _search(values, {(k, q * totals[k]) for k in uneven for q in qs}, uneven)
    for k in uneven:
        out[names[k]] = [_between(groups[k, q * totals[k]], q * totals[k]) for q in qs]
    return {n: out[n] for n in names}


def _between(g: _Group, place: float) -> float:
    """The value at a place in terms of weight, given the group of equal values that it lies in."""
    first, last = g.before + g.first / 2, g.before + g.weight - g.last / 2
    if place < first and g.previous:
        (x, w), y, b = g.previous, g.low, first
        a = g.before - w / 2
    elif place >= last and g.following:
        x, a, (y, w) = g.low, last, g.following
        b = g.before + g.weight + w / 2
    else:
        return g.low
    return x + (y - x) * (place - a) / (b - a)


def weighted_quantiles(df: DataFrame, value: str, weight: str, qs: list[float], ties: tuple[str, ...] = (), ranges: int | None = None) -> list[float]:
    """weighted_quantiles_of one column, which must have values. ties and ranges change nothing: of equal values only the ends count."""
    found = weighted_quantiles_of(df, {value: F.col(value)}, F.col(weight), qs)[value]
    if found is None:
        raise ValidationError(f"{value} has no finite values")
    return found
