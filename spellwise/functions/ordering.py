"""Orders over whole tables without a window that puts a table in one task: running sums, numbers, exact quantiles, as-of joins.

An order is cut into PARTS parts of about as many rows, at approximate quantiles of its first key; the rows of a value that fills
several parts are dealt to them by the next key.  Parts are summed with partial aggregates, what they hand on to each other
is worked out over the few parts, and the windows that remain run inside a part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of an order.  Rows without a first key make up to PARTS more.
PARTS = 256


def _number(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _cuts(df: DataFrame, columns: list[str]) -> tuple[list[list[float]], bool]:
    """Ends of parts for each column, ascending, as often as they end a part, and whether the first has nulls; one aggregate."""
    shares = ", ".join(f"{k / PARTS!r}D" for k in range(1, PARTS))
    row = df.agg(*[F.expr(f"percentile_approx(`{c}`, array({shares}), {10 * PARTS})").alias(f"c{i}") for i, c in enumerate(columns)], F.count(F.when(F.col(columns[0]).isNull(), 1)).alias("n")).first()
    return [sorted(x for x in row[i] or [] if math.isfinite(x)) for i in range(len(columns))], row.n > 0


def _bucketed(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """Adds {c}__base, the part in which a value begins, and {c}__width, the parts that the value fills; found by binary search."""
    from pyspark.ml.feature import Bucketizer

    splits, tables = [], []
    for ends in cuts:
        ends = ends or [0.0]
        points, parts, seen = [-math.inf], [(0, 1)], 0
        for v in sorted(set(ends)):
            times = ends.count(v)
            points.append(v)
            parts.append((seen + 1, times))
            seen += times
            if times > 1:
                points.append(math.nextafter(v, math.inf))
                parts.append((seen, 1))
        merged = [0] + [i for i in range(1, len(points)) if i + 1 == len(points) or points[i] != points[i + 1]]  # a value just above a wide one
        splits.append([points[i] for i in merged] + [math.inf])
        tables.append([parts[i] for i in merged])
    at = [f"{c}__at" for c in columns]
    out = Bucketizer(splitsArray=splits, inputCols=columns, outputCols=at, handleInvalid="keep").transform(df)
    for c, a, table in zip(columns, at, tables, strict=True):
        place = lambda k, a=a, table=table: F.expr(f"get(array({', '.join(str(p[k]) for p in table)}), cast(`{a}` as int))")
        out = out.withColumns({f"{c}__base": place(0), f"{c}__width": place(1)})
    return out.drop(*at)


def _parted(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds __part, which does not fall along the order of the keys; nulls and NaN of the first key stand last."""
    names = [f"__k{i}" for i in range(len(keys))]
    out = df.withColumns({n: _number(k) for n, k in zip(names, keys, strict=True)})
    cuts, nulls = _cuts(out, names[:1])
    wide = nulls or len(set(cuts[0])) < len(cuts[0])
    used = names if wide else names[:1]
    if wide and len(names) > 1:
        cuts += _cuts(out, names[1:])[0]
    out = _bucketed(out, used, cuts)
    place = F.lit(0)
    for n in reversed(used):
        inside = F.floor(F.col(f"{n}__width") * place / PARTS)
        place = F.when(F.col(n).isNull(), F.lit(PARTS - 1) if n != names[0] else PARTS + place).otherwise(F.col(f"{n}__base") + F.when(F.col(f"{n}__width") > 1, inside).otherwise(0))
    return out.withColumn("__part", place.cast("int")).drop(*names, *[f"{n}__{x}" for n in used for x in ("base", "width")])


def _running(parted: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds {c}_upto for each c of sums, over the order given by __part and then by order."""
    totals = parted.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # 2 x PARTS rows
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(F.broadcast(starts), "__part")  # 2 x PARTS rows
    return out.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"__{c}") for c in sums}).drop("__part", *[f"__{c}" for c in sums])


def running_sums(df: DataFrame, x: str, sums: list[str], ties: str | list[str] | None = None, descending: bool = False) -> DataFrame:
    """Adds {c}_upto: the sum of c over the rows up to this one in the order of the number x (nulls last), then of ties.

    Ties are numbers, or else go in the order of a 64-bit hash; they also spread the rows of a frequent x over parts.
    """
    ties = [ties] if isinstance(ties, str) else ties or []
    keys = [F.col(t) if isinstance(df.schema[t].dataType, T.NumericType) else F.xxhash64(t) for t in ties]
    first = _number(F.col(x))
    order = [first.desc_nulls_last() if descending else first.asc_nulls_last(), *[k.asc_nulls_last() for k in keys], *ties]
    return _running(_parted(df, [-first if descending else first, *keys]), order, sums)


def numbered(df: DataFrame, key: Column, ties: str, name: str) -> DataFrame:
    """Adds row numbers from 1 in the order of a 64-bit hash: its highest bits cut the parts."""
    parted = df.withColumns({"__key": key, "__one": F.lit(1).cast("long")}).withColumn("__part", F.shiftright(F.col("__key"), 56))
    out = _running(parted, [F.col("__key"), F.col(ties)], ["__one"])
    return out.withColumn(name, F.col("__one_upto").cast("int")).drop("__key", "__one", "__one_upto")


def exact_quantiles(rows: DataFrame, values: list[str], shares: list[float], keys: list[str] | None = None, weights: dict[str, Column] | None = None) -> DataFrame:
    """keys, variable and quantiles: the exact quantiles (linear between neighbours) of several columns at once, by group.

    With weights a row counts so many times; null and NaN values and groups without values are left out.  Three passes over rows, whatever
    the number of columns and groups: equal-depth cuts of each column, weights by group and part, and the rows of those parts of each
    group that hold a quantile.  A part has about a row in PARTS of the table, however the values lie.
    """
    keys = keys or []
    names = [f"__x{i}" for i in range(len(values))]
    known = rows.select(F.struct(*keys).alias("__g") if keys else F.lit(0).alias("__g"), *[_number(F.col(v)).alias(n) for v, n in zip(values, names, strict=True)], *[(weights or {}).get(v, F.lit(1)).cast("long").alias(f"__w{i}") for i, v in enumerate(values)])
    parted = _bucketed(known, names, _cuts(known, names)[0])
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(n).alias("x"), F.col(f"{n}__base").alias("part"), F.col(f"__w{i}").alias("w")) for i, (v, n) in enumerate(zip(values, names, strict=True))])
    long = parted.select("__g", F.explode(each).alias("v")).select("__g", "v.*").where("x IS NOT NULL")
    sums = long.groupBy("__g", "variable", "part").agg(F.sum("w").alias("w"))
    one = Window.partitionBy("__g", "variable")  # PARTS rows
    sums = sums.select("__g", "variable", "part", "w", (F.sum("w").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("before"), F.sum("w").over(one).alias("total"))
    ends = {q: (F.floor((F.col("total") - 1) * F.lit(q)), F.ceil((F.col("total") - 1) * F.lit(q))) for q in shares}
    holds = F.lit(False)
    for pair in ends.values():
        for place in pair:
            holds = holds | ((F.col("before") <= place) & (place < F.col("before") + F.col("w")))
    wanted = sums.where(holds).select("__g", "variable", "part", "before", "total")
    inside = long.join(wanted, ["__g", "variable", "part"]).groupBy("__g", "variable", "part", "before", "total", "x").agg(F.sum("w").alias("w"))
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("__g", "variable", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    found = inside.withColumn("upto", upto).groupBy("__g", "variable", "total").agg(*[f for i, (lo, hi) in enumerate(ends.values()) for f in (at(lo).alias(f"lo{i}"), at(hi).alias(f"hi{i}"))])
    share = lambda i, q: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * ((F.col("total") - 1) * F.lit(q) - ends[q][0])
    return found.select(*[F.col(f"__g.`{k}`").alias(k) for k in keys], "variable", F.array(*[share(i, q) for i, q in enumerate(shares)]).alias("quantiles"))


def quantiles(rows: DataFrame, x: str, shares: list[float]) -> list[float]:
    """The exact quantiles of one column; none without values."""
    found = exact_quantiles(rows, [x], shares).first()
    return list(found.quantiles) if found else []


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """left with values of right: those of the last row of the same keys whose time is not after it; null where there is none.

    Of right rows of one key and time the one with the greatest values counts; a null time of left has none, one of right is none; null keys
    are alike.  Both sides stand in one order, cut into parts by time over all keys, so that a large group spreads over tasks: the last values
    are carried along inside each part, and from the parts before.
    """
    own, kept = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{v}`") for v in values])
    group = F.struct(*keys) if keys else F.lit(0)
    none = lambda df, columns: F.lit(None).cast(df.select(*columns).schema)
    a = left.select(group.alias("g"), _number(F.col(time)).alias("t"), F.lit(1).alias("kind"), own.alias("own"), none(right, values).alias("r"))
    b = right.where(F.col(time).isNotNull()).select(group.alias("g"), _number(F.col(time)).alias("t"), F.lit(0).alias("kind"), none(left, left.columns).alias("own"), kept.alias("r"))
    both = a.unionAll(b)
    spread = F.when(F.col("kind") == 1, F.pmod(F.xxhash64("own"), F.lit(1 << 20))).otherwise(-1)  # right rows stand before the left ones of their time
    parted = _parted(both, [F.col("t"), spread])
    lasts = parted.groupBy("g", "__part").agg(F.max(F.when((F.col("kind") == 0) & F.col("t").isNotNull(), F.struct("t", "r"))).alias("last"))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # 2 x PARTS rows
    carried = lasts.select("g", "__part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("g", "__part").orderBy("t", "kind", "r").rowsBetween(Window.unboundedPreceding, 0)
    met = parted.join(carried, ["g", "__part"]).withColumn("here", F.last(F.when(F.col("kind") == 0, F.col("r")), ignorenulls=True).over(order))
    found = F.when(F.col("t").isNotNull(), F.coalesce(F.col("here"), F.col("carried.r")))
    return met.where("kind = 1").select("own", found.alias("r")).select(*[F.col(f"own.`{c}`").alias(c) for c in left.columns], *[F.col(f"r.`{v}`").alias(v) for v in values])
