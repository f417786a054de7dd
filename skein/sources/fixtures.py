"""A seeded incident corpus of any size, from spark.range and hashes.

The values of a row follow from (seed, id) alone, so the corpus is the same however it is
partitioned. It holds the seeded sets: A a burglary series with three recurring people, B one
person and one vehicle in two districts, C one person in three spellings, D one person with one
account in three districts; then decoys of one name and age without evidence; then background.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Places as (district, latitude, longitude).
DISTRICTS = [("Bengaluru Urban", 12.97, 77.59), ("Mysuru", 12.30, 76.64), ("Mangaluru", 12.91, 74.86), ("Kalaburagi", 17.33, 76.83), ("Belagavi", 15.85, 74.50)]
CRIMES = ["House Burglary", "Vehicle Theft", "Robbery", "Cheating", "Assault"]
GIVEN = "Ramesh Suresh Manjunath Prakash Nagaraj Shivakumar Mahesh Lakshmi Savitha Geetha Kavya Radha Anand Kiran Vinod Asha".split()
SURNAMES = "Gowda Reddy Kumar Shetty Rao Patil Hegde Naik".split()
#: Narratives; %s stands for evidence.
STORIES = [
    "The rear window of the house was forced with an iron rod at night and gold ornaments were taken. %s",
    "A motorcycle parked near the shop was stolen; two persons fled on a two-wheeler. %s",
    "The complainant was threatened with a knife and cash was taken. %s",
    "Posing as a bank officer the accused induced a transfer by UPI from the complainant. %s",
    "After an argument near the market the victim was walking home and was assaulted. %s",
]
SET_SIZES = {"A": 14, "B": 2, "C": 3, "D": 4, "decoy": 6}


def _draw(seed: int, name: str, *keys: Column) -> Column:
    """A pseudo-random long of 0 or more."""
    return F.xxhash64(F.lit(seed), F.lit(name), *keys).bitwiseAND(F.lit(2**63 - 1))


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


#: Section codes, two for each kind of crime.
SECTIONS = ["457", "380", "379", "411", "420", "406", "392", "397", "324", "326"]


def corpus(spark: SparkSession, n_cases: int = 500, seed: int = 7) -> dict[str, DataFrame]:
    """cases, accused, truth (true_person, accused_id), outcomes, arrests, complainants, victims, sections."""
    ids = spark.range(1, n_cases + 1).withColumnRenamed("id", "case_id")
    edges, kind = 1, F.lit("background")
    for name, size in SET_SIZES.items():
        kind = F.when(F.col("case_id").between(edges, edges + size - 1), name).otherwise(kind)
        edges += size
    first = {}
    at = 1
    for name, size in SET_SIZES.items():
        first[name], at = at, at + size
    k = F.col("case_id") - F.coalesce(*(F.when(F.col("kind") == s, F.lit(first[s])) for s in first), F.lit(0))
    c = ids.withColumn("kind", kind).withColumn("k", k)
    is_a, is_b, is_c, is_d, is_decoy = (F.col("kind") == s for s in SET_SIZES)
    place = F.when(is_a | is_c, 0).when(is_b, F.col("k") % 2).when(is_d, F.col("k") % 3).otherwise(_draw(seed, "district", F.col("case_id")) % 5).cast("int")
    crime = F.when(is_a | is_c, 0).when(is_b, 1).when(is_d, 3).otherwise(_draw(seed, "crime", F.col("case_id")) % 5).cast("int")
    c = c.withColumn("d", place).withColumn("crime", crime)
    spread = F.when(is_a, 0.005).otherwise(0.4)

    def coordinate(i: int, name: str) -> Column:
        return _pick([x[i] for x in DISTRICTS], F.col("d")) + spread * ((_draw(seed, name, F.col("case_id")) % 10_000) / 10_000.0 - 0.5)

    day = F.when(is_a, 200 + 3 * F.col("k")).otherwise(_draw(seed, "day", F.col("case_id")) % 365).cast("int")
    hour = F.when(is_a, 23).otherwise(_draw(seed, "hour", F.col("case_id")) % 24)

    def number(what: str, key: Column) -> Column:
        return F.concat(F.lit("+91"), (F.lit(9_000_000_000) - _draw(seed, what, key) % 2_999_999_999).cast("string"))

    def has(what: str, share: int) -> Column:
        return _draw(seed, f"has {what}", F.col("case_id")) % 100 < share

    phone = F.when(is_a, number("phone A", F.col("k") % 3)).when(is_c | is_d, number("phone", F.col("kind"))).when(~is_decoy & ~is_b & has("phone", 50), number("phone", F.col("case_id")))
    second = F.when(is_a & (F.col("k") < 5), number("shared", F.lit("A")))

    def plate(what: str, key: Column) -> Column:
        r = _draw(seed, what, key)
        return F.format_string("KA-%02d-%s-%04d", (r % 70 + 1).cast("int"), _pick(["AB", "CD", "EF", "GH"], F.shiftright(r, 8)), (F.shiftright(r, 16) % 10_000).cast("int"))

    vehicle = F.when(is_b | is_c, plate("vehicle", F.col("kind"))).when((F.col("kind") == "background") & has("vehicle", 25), plate("vehicle", F.col("case_id")))
    account = F.when(is_d | (is_a & F.col("k").isin(1, 3)), F.concat(F.lit("mule"), F.col("kind"), F.lit("@okicici"))).when((F.col("kind") == "background") & has("account", 15), F.concat(F.lit("user"), F.col("case_id").cast("string"), F.lit("@ybl")))
    c = c.withColumns({"phone": phone, "second": second, "vehicle": vehicle, "account": account})
    told = F.concat_ws(" ", F.when(F.col("phone").isNotNull(), F.concat(F.lit("Phone"), F.lit(" "), F.col("phone"), F.lit("."))), F.when(F.col("second").isNotNull(), F.concat(F.lit("Also "), F.col("second"), F.lit("."))), F.when(F.col("vehicle").isNotNull(), F.concat(F.lit("Vehicle "), F.col("vehicle"), F.lit("."))), F.when(F.col("account").isNotNull(), F.concat(F.lit("Paid to "), F.col("account"), F.lit("."))))
    story = F.replace(_pick(STORIES, F.col("crime")), F.lit("%s"), told)
    registered = F.date_add(F.lit("2025-01-01").cast("date"), day)
    cases = c.select(
        "case_id", "kind", _pick([x[0] for x in DISTRICTS], F.col("d")).alias("district"), (F.col("d") * 4 + _draw(seed, "station", F.col("case_id")) % 4).cast("int").alias("station_id"),
        _pick(CRIMES, F.col("crime")).alias("crime"), F.when(_draw(seed, "gravity", F.col("case_id")) % 3 == 0, 1).otherwise(2).alias("gravity"),
        (_draw(seed, "status", F.col("case_id")) % 4 + 1).cast("int").alias("status"), registered.alias("registered"),
        F.timestamp_seconds(F.unix_timestamp(registered.cast("timestamp")) + hour * 3600).alias("occurred"), coordinate(1, "lat").alias("lat"), coordinate(2, "lon").alias("lon"), story.alias("facts"),
    )
    spelled = F.element_at(F.array(F.lit("ರಾಮಯ್ಯ"), F.lit("Ramaiah"), F.lit("Ramayya")), (F.col("k") % 3 + 1).cast("int"))
    drawn = F.concat_ws(" ", _pick(GIVEN, _draw(seed, "given", F.col("case_id"))), _pick(SURNAMES, _draw(seed, "surname", F.col("case_id"))))
    name = F.when(is_a, _pick(["Kiran Gowda", "Vinod Shetty", "Anand Naik"], F.col("k"))).when(is_b, "Mahesh Patil").when(is_c, spelled).when(is_d, "Prakash Rao").when(is_decoy, "Ramesh Kumar").otherwise(drawn)
    person = F.when(is_a, F.concat(F.lit("A"), (F.col("k") % 3).cast("string"))).when(is_b | is_c | is_d, F.col("kind")).otherwise(F.concat(F.lit("P"), F.col("case_id").cast("string")))
    age = F.when(is_decoy, 34).when(F.col("kind") != "background", 30 + F.length(person)).otherwise(18 + _draw(seed, "age", F.col("case_id")) % 45).cast("int")
    main = c.select((2 * F.col("case_id")).alias("accused_id"), "case_id", name.alias("name"), age.alias("age"), F.when(F.col("kind") == "background", 1 + _draw(seed, "gender", F.col("case_id")) % 2).otherwise(1).cast("int").alias("gender"), person.alias("true_person"))
    other = F.concat_ws(" ", _pick(GIVEN, _draw(seed, "given 2", F.col("case_id"))), _pick(SURNAMES, _draw(seed, "surname 2", F.col("case_id"))))
    extra = c.where((F.col("kind") == "background") & has("second", 25)).select((2 * F.col("case_id") + 1).alias("accused_id"), "case_id", other.alias("name"), (18 + _draw(seed, "age 2", F.col("case_id")) % 45).cast("int").alias("age"), (1 + _draw(seed, "gender 2", F.col("case_id")) % 2).cast("int").alias("gender"), F.concat(F.lit("Q"), F.col("case_id").cast("string")).alias("true_person"))
    people = main.union(extra)
    arrested = c.where(has("arrest", 40)).select("case_id", (2 * F.col("case_id")).alias("accused_id"), F.date_add(registered, (_draw(seed, "arrest day", F.col("case_id")) % 30).cast("int")).alias("arrested_on"), "d")
    evidence = F.col("phone").isNotNull() | F.col("vehicle").isNotNull() | F.col("account").isNotNull()
    odds = 12 + F.when(evidence, 45).otherwise(0) + F.when(has("arrest", 40), 35).otherwise(0)
    roll = _draw(seed, "outcome", F.col("case_id")) % 100
    kind_of = F.when(roll < 6, "B").when(roll < 6 + odds, "A").when(roll < 90, "C")
    outcomes = c.select("case_id", kind_of.alias("cstype")).where("cstype is not null")
    complainants = c.select((F.col("case_id")).alias("complainant_id"), "case_id", F.concat(F.lit("Citizen "), F.col("case_id").cast("string")).alias("name"), (18 + _draw(seed, "c age", F.col("case_id")) % 60).cast("int").alias("age"), (1 + _draw(seed, "c gender", F.col("case_id")) % 2).cast("int").alias("gender"), _pick(["Farmer", "Teacher", "Trader", "Student", "Driver", "Engineer", "Homemaker", "Retired"], _draw(seed, "job", F.col("case_id"))).alias("occupation"))
    victims = c.select((3 * F.col("case_id")).alias("victim_id"), "case_id", F.concat(F.lit("Victim "), F.col("case_id").cast("string")).alias("name"), (18 + _draw(seed, "v age", F.col("case_id")) % 60).cast("int").alias("age"), (1 + _draw(seed, "v gender", F.col("case_id")) % 2).cast("int").alias("gender"))
    charged = F.array(*map(F.lit, SECTIONS))
    sections = c.select("case_id", F.lit("IPC").alias("act"), F.explode(F.slice(charged, F.col("crime") * 2 + 1, F.when(has("second section", 30), 2).otherwise(1))).alias("section"))
    return {"victims": victims, "sections": sections, "cases": cases, "accused": people.drop("true_person"), "truth": people.select("true_person", "accused_id"), "outcomes": outcomes, "arrests": arrested.drop("d"), "complainants": complainants}
