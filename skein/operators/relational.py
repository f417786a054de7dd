"""Scans, joins and aggregates over a star of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skein.functions import stats


class UnknownDimension(ValueError):
    pass


def point(df: DataFrame, column: str, key) -> DataFrame:
    """P02."""
    return df.where(F.col(column) == key).limit(1)


def named(df: DataFrame, dimension: str, dims: dict[str, tuple[DataFrame, str, str]], key: str, alias: str) -> DataFrame:
    """Adds the dimension's name for df's key; a null key gives null, an undeclared dimension is an error.

    Spark chooses the join from the dimension's size.
    """
    if dimension not in dims:
        raise UnknownDimension(dimension)
    dim, id_col, name_col = dims[dimension]
    return df.join(dim.select(F.col(id_col).alias(key), F.col(name_col).alias(alias)), key, "left")


def any_of(df: DataFrame, **facets: str | None) -> DataFrame:
    """A conjunction of the facets that are set."""
    for column, value in facets.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def page(df: DataFrame, order: list[Column], number: int, size: int = 5) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def counts(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, n) by n descending, ties by key."""
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), key).limit(limit) if limit else out


def shares(df: DataFrame, key: str, digits: int = 0) -> DataFrame:
    """(key, n, share): rounded percent of all rows, 0 without rows."""
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), digits))


def monthly(df: DataFrame, day: str) -> DataFrame:
    """A02."""
    return df.where(F.col(day).isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def recent(df: DataFrame, day: str, tie: str, limit: int = 12) -> DataFrame:
    """The latest rows; ties to the larger id."""
    return df.orderBy(F.desc(day), F.desc(tie)).limit(limit)


def recoded_status(name: Column) -> Column:
    """P12."""
    return F.when(F.lower(name).contains("non"), "Medium").otherwise("Critical")


def located(df: DataFrame, lat: str, lon: str, tie: str, limit: int = 60) -> DataFrame:
    """P09."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).orderBy(tie).limit(limit)


def boxed(df: DataFrame, x: str, name: str, low: float = 8.0, high: float = 92.0) -> DataFrame:
    """Df with x scaled into low..high over all rows as `name`; the middle where all are equal."""
    ends = df.agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    width = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low"))
    scaled = F.coalesce(low + (high - low) * F.try_divide(F.col(x) - F.col("_low"), width), F.lit((low + high) / 2))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("_low", "_high")  # ends is one row


def histogram(df: DataFrame, ts: str, part: str) -> DataFrame:
    """Counts by month, weekday (0 is Monday; days without rows count 0) or hour."""
    of = {"month": F.date_format(ts, "yyyy-MM"), "weekday": F.weekday(ts), "hour": F.hour(ts)}[part]
    out = df.where(F.col(ts).isNotNull()).groupBy(of.alias(part)).agg(F.count("*").alias("n"))
    if part == "weekday":
        days = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
        out = days.join(out, "weekday", "left").select("weekday", F.coalesce("n", F.lit(0)).alias("n"))
    return out


def peak(df: DataFrame, key: Column, tie: str) -> DataFrame:
    """The most frequent key; ties to the one that the smallest `tie` has."""
    g = df.groupBy(key.alias("peak")).agg(F.count("*").alias("n"), F.min(tie).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(1).select("peak", "n")


def at_night(ts: Column) -> Column:
    """From 22 to 6."""
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def night_share(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    """A06."""
    d = df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.count_if(at_night(F.col(ts))).alias("night"), F.count_if(~at_night(F.col(ts))).alias("day"))
    return d.withColumn("night_pct", stats.pct(F.col("night"), F.col("night") + F.col("day")))


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def top_share(df: DataFrame, group: str, item: str, tie: str, min_count: int = 1) -> DataFrame:
    """Per group n, its share of all, the most frequent item and that one's share."""
    c = df.groupBy(group, item).agg(F.count("*").alias("c"), F.min(tie).alias("first"))
    best = F.max_by(F.struct(F.col(item).alias("item"), "c"), F.struct("c", -F.col("first"))).alias("b")
    g = c.groupBy(group).agg(F.sum("c").alias("n"), best)
    g = g.withColumn("share", stats.pct(F.col("n"), F.sum("n").over(W.partitionBy()))).where(F.col("n") >= min_count)
    return g.select(group, "n", "share", F.col("b.item").alias("top"), stats.pct(F.col("b.c"), F.col("n")).alias("top_share"))


def mix(df: DataFrame, group: str, item: str, keep: int = 4) -> DataFrame:
    """A10: the `keep` most frequent items of each group, as 'item=n' in order."""
    c = df.groupBy(group, item).agg(F.count("*").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), F.col(item).alias("i"))))
    return c.groupBy(group).agg(F.array_join(F.transform(F.slice(ordered, 1, keep), lambda x: F.concat(x.i.cast("string"), F.lit("="), (-x.k).cast("string"))), ",").alias("mix"))


def age_by_gender(df: DataFrame, age: str, gender: str) -> DataFrame:
    """Per age band women, men and all."""
    return df.groupBy(stats.age_band(F.col(age)).alias("band")).agg(F.count_if(F.col(gender) == 2).alias("f"), F.count_if(F.col(gender) == 1).alias("m"), F.count("*").alias("total"))


def concentrated(top: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Groups of which one item makes the threshold or more."""
    return top.where(F.col("top_share") >= threshold)


#: Attributes that no offender distribution may use.
PROTECTED = ["caste", "religion", "occupation", "community", "ethnicity", "tribe"]


class EthicalRefusal(PermissionError):
    pass


def guard(attribute: str) -> str:
    """Refuses protected attributes, before any plan is made."""
    if attribute.lower().strip() in PROTECTED:
        raise EthicalRefusal(f"offenders are not profiled by {attribute}")
    return attribute


def offender_distribution(accused: DataFrame, attribute: str) -> DataFrame:
    """A12."""
    column = stats.age_band(F.col("age")) if guard(attribute) == "age_band" else F.col(attribute)
    return accused.groupBy(column.alias(attribute)).agg(F.count("*").alias("n"))


def visible(df: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """The rows in scope."""
    return df.join(scope.select(key).distinct(), key, "left_semi")


def wholly_visible(df: DataFrame, scope: DataFrame, group: str, key: str) -> DataFrame:
    """The groups all of whose keys are in scope."""
    hidden = df.join(scope.select(key).distinct(), key, "left_anti").select(group).distinct()
    return df.join(hidden, group, "left_anti")


#: Roles and their scopes.
ROLES = {"station_officer": "station", "district_sp": "district", "scrb_analyst": "state", "state_leadership": "aggregate"}


def scope_of(cases: DataFrame, role: str, station: int | None = None, district: str | None = None) -> DataFrame:
    """(case_id) that a role may see; an unknown role sees none."""
    kind = ROLES.get(role)
    ids = cases.select("case_id")
    if kind == "station" and station is not None:
        ids = cases.where(F.col("station_id") == station).select("case_id")
    elif kind == "district" and district is not None:
        ids = cases.where(F.col("district") == district).select("case_id")
    elif kind not in ("state", "aggregate"):
        ids = ids.limit(0)
    return ids


def dashboard(cases: DataFrame, keys: dict[str, str], day: str, tie: str, top: dict[str, int], latest: int = 12) -> DataFrame:
    """Q27: (section, rank, label, value, share) of a whole dashboard: `total`; a section for each of keys (section: column) with
    counts by value; `monthly_trend`; and `recent`, the latest cases by day, with the case as value.

    One scan of the cases counts all sections by grouping sets, days among them. The days' counts tell how far back the
    latest cases reach, so the second read is of those days only. top limits a section to so many rows; rows without a key
    count as a null label, those without a day in no month; without cases there are no rows."""
    c = cases.select(*(F.col(v).cast("string").alias(k) for k, v in keys.items()), F.col(day).cast("date").alias("_day"))
    sets = [[k] for k in keys] + [["_day"], []]
    which = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in [*keys, "_day"]), F.lit("total"))
    counted = c.groupingSets(sets, *keys, "_day").agg(which.alias("section"), F.count("*").alias("value"))
    counted = counted.select("section", F.coalesce(*keys).alias("label"), "_day", "value").persist()  # one row a value or day
    dated = counted.where("section = '_day' and _day is not null")
    months = dated.groupBy(F.date_format("_day", "yyyy-MM").alias("label")).agg(F.sum("value").alias("value")).select(F.lit("monthly_trend").alias("section"), "label", "value")
    out = counted.where("section <> '_day'").select("section", "label", "value").union(months)
    every = W.partitionBy("section")
    out = out.withColumn("share", F.when(~F.col("section").isin("total", "monthly_trend"), F.round(100.0 * F.col("value") / F.sum("value").over(every), 1)))
    order = F.when(F.col("section") == "monthly_trend", 0).otherwise(-F.col("value"))
    out = out.withColumn("rank", F.row_number().over(every.orderBy(order, F.col("label").asc_nulls_first())))
    most = F.coalesce(*(F.when(F.col("section") == k, F.lit(n)) for k, n in top.items()), F.lit(2**31 - 1))
    out = out.where(F.col("rank") <= most).select("section", "rank", "label", "value", "share")
    newest = dated.orderBy(F.desc("_day")).limit(latest).agg(F.min("_day").alias("since"))  # so many days hold so many cases
    since = newest.first()["since"]
    late = cases.where(F.col(day) >= F.lit(since)) if since is not None else cases.limit(0)
    recent_ = recent(late.where(F.col(day).isNotNull()), day, tie, latest)
    recent_ = recent_.withColumn("rank", F.row_number().over(W.orderBy(F.desc(day), F.desc(tie))))  # at most `latest` rows
    return out.union(recent_.select(F.lit("recent"), "rank", F.col(day).cast("date").cast("string"), F.col(tie).cast("long"), F.lit(None).cast("double")))
