"""Statistics, distances and ordered tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def normal_tail(z: Column) -> Column:
    """1 - Phi(z) by the polynomial 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


#: The same in DuckDB; {z} stands for the argument.
NORMAL_TAIL_SQL = "(CASE WHEN {z} >= 0 THEN {u} ELSE 1 - {u} END)".replace(
    "{u}",
    "(0.5 * (1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0)))) * (0.254829592 + (1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0)))) * (-0.284496736 + (1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0)))) * (1.421413741 + (1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0)))) * (-1.453152027 + (1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0)))) * 1.061405429)))) * exp(-abs({z}) * abs({z}) / 2))",
)


def normal_tail_of(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def severity(z: Column, has_baseline: Column, recent: Column) -> Column:
    """M05."""
    return F.when(~has_baseline & (recent >= 3), "EMERGENT").when(z >= 3, "HIGH").when(z >= 2, "ELEVATED").otherwise("WATCH")


def age_band(age: Column) -> Column:
    """M06."""
    return F.when(age.isNull(), "unknown").when(age < 18, "<18").when(age < 26, "18-25").when(age < 36, "26-35").when(age < 51, "36-50").otherwise("51+")


def age_buckets(age: Column, width: int = 5, tolerance: int = 2) -> Column:
    """The buckets of age - 2 and age + 2, so ages within the tolerance share one; ['NA'] for null."""
    b = F.array_distinct(F.array(F.floor((age - tolerance) / width), F.floor((age + tolerance) / width)))
    return F.when(age.isNull(), F.array(F.lit("NA"))).otherwise(b.cast("array<string>"))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, with 1 for an empty whole."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def ordinal(value: str, tie: str, partition: list[str] | None = None) -> Column:
    """Rank without averaging ties."""
    return F.row_number().over(W.partitionBy(*(partition or [])).orderBy(value, tie))


def spearman(df: DataFrame, x: str, y: str, tie: str, keys: list[str]) -> DataFrame:
    """Rho for each group of keys, null below 3 rows; ties keep the order of `tie`."""
    d = df.withColumn("_d", ordinal(x, tie, keys) - ordinal(y, tie, keys))
    n = F.count("*")
    return d.groupBy(*keys).agg(n.alias("n"), F.when(n >= 3, F.round(1 - 6 * F.sum(F.col("_d") * F.col("_d")) / (n * (n * n - 1)), 6)).alias("rho"))


def benjamini_hochberg(df: DataFrame, p: str, tie: str, q: float, m: Column | int) -> DataFrame:
    """Df with `accepted`: the first i rows by p, for the last i with p <= i / m * q.

    Ranks run over all cells in one task; cells are groups already, not rows of data.
    """
    ranked = df.withColumn("_i", F.row_number().over(W.orderBy(p, tie)))
    cut = F.max(F.when(F.col(p) <= F.col("_i") * q / m, F.col("_i"))).over(W.partitionBy())
    return ranked.withColumn("accepted", F.coalesce(F.col("_i") <= cut, F.lit(False))).drop("_i")


def _width(band: Column) -> Column:
    """Degrees of latitude that one of longitude is worth at the poleward edge of a band; 0 near the poles, where all share one cell."""
    edge = F.abs(band) + 2
    return F.when(edge < 89, F.cos(F.radians(edge))).otherwise(0.0)


def reached(x: Column, by: float = 1) -> Column:
    """The cells, two units wide, within `by` units of x."""
    return F.sequence(F.floor((x - by) / 2), F.floor((x + by) / 2))


def place_cell(lat: Column, lon: Column, metres: float) -> Column:
    """struct<band,x,y>: the cell of a place, two units of `metres` wide. Longitude is counted by the width of the latitude
    band of one degree."""
    step, band = metres / 111_000.0, F.floor(lat)
    return F.struct(band.alias("band"), F.floor(lon * _width(band) / step / 2).alias("x"), F.floor(lat / step / 2).alias("y"))


def cells_around(lat: Column, lon: Column, metres: float, by: float = 1) -> Column:
    """array<struct<band,x,y>>: the cells of all places within `by` times `metres`, one time at most: two at most of each direction, but at
    the edge of a band and at 180 degrees, where a place is reached from the other side too."""
    step = metres / 111_000.0

    def of_band(band: Column) -> Column:
        width = _width(band)
        degrees = F.when(width > 0, by * step / width).otherwise(0.0)
        beyond = F.filter(F.array(lon, lon - 360, lon + 360), lambda v: F.abs(v) <= 180 + degrees)
        columns = F.array_distinct(F.flatten(F.transform(beyond, lambda v: reached(v * width / step, by))))
        return F.flatten(F.transform(columns, lambda x: F.transform(reached(lat / step, by), lambda y: F.struct(band.alias("band"), x.alias("x"), y.alias("y")))))

    return F.flatten(F.transform(F.sequence(F.floor(lat - by * step), F.floor(lat + by * step)), of_band))


def near_pairs(left: DataFrame, right: DataFrame, metres: float, days: int | None = None) -> DataFrame:
    """Pairs (a_*, b_*) within `metres`, and `days` of each other, of rows (id, lat, lon, day).

    Cells are twice as wide as the radius, in place and days, so the right side reaches into two cells at most of each,
    and the join has equal keys. The exact distance is checked last.
    """

    def fields(df: DataFrame, p: str) -> DataFrame:
        u = F.datediff("day", F.lit("1970-01-01")) / F.lit(float(days or 1))
        return df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lon", "day")), (u if days else F.lit(0.5)).alias("u"))

    a = fields(left, "a").withColumn("cell", place_cell(F.col("a_lat"), F.col("a_lon"), metres)).withColumn("t", F.floor(F.col("u") / 2)).select("*", "cell.*").drop("u", "cell")
    b = fields(right, "b").where("b_lat is not null and b_lon is not null and u is not null")
    b = b.withColumn("cell", F.explode(cells_around(F.col("b_lat"), F.col("b_lon"), metres))).withColumn("t", F.explode(reached(F.col("u"))) if days else F.lit(0).cast("long")).select("*", "cell.*").drop("u", "cell")
    d = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    # a few files of places make very many pairs: neither side may be sent to the driver, as Spark would by the size of the files
    out = a.hint("merge").join(b, ["band", "x", "y", "t"]).where(F.col("a_id") != F.col("b_id")).withColumn("metres", d).where(F.col("metres") <= metres)
    if days:
        out = out.where(F.abs(F.datediff("a_day", "b_day")) <= days)
    return out.drop("band", "x", "y", "t")
