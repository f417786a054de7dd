"""Audit chain, retention, purge plan, timeline, fairness inputs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skein.session import Scratch

GENESIS = "GENESIS"


def canonical(*columns: str) -> Column:
    """One JSON text of the named columns, in the alphabetical order of their names."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def chained(entries: DataFrame, chain: str, seq: str, payload: str, start: str | None = None) -> DataFrame:
    """Entries with prev_hash and entry_hash = sha256(prev_hash + payload), by chain: from GENESIS, or from the hash
    that the chain's rows hold in the column `start`.

    A hash needs the one before it, so a chain is walked in order in one task: rows are sorted on disk
    and streamed, only the last hash is kept. Chains run side by side.
    """
    import hashlib

    fields = entries.schema.simpleString()[7:-1]

    def walk(batches):
        last, prev = object(), GENESIS
        for pdf in batches:
            before, after = [], []
            starts = pdf[start] if start else [None] * len(pdf)
            for c, p, first in zip(pdf[chain], pdf[payload], starts, strict=True):
                if c != last:
                    last, prev = c, first or GENESIS
                before.append(prev)
                prev = hashlib.sha256((prev + p).encode()).hexdigest()
                after.append(prev)
            yield pdf.assign(prev_hash=before, entry_hash=after)

    return entries.repartition(chain).sortWithinPartitions(chain, seq).mapInPandas(walk, f"{fields},prev_hash:string,entry_hash:string")


def broken(entries: DataFrame, chain: str, seq: str, payload: str) -> DataFrame:
    """The first entry of each chain that was changed or does not follow its predecessor; intact chains give none.

    Needs no order of work: each entry is checked against the stored hash before it.
    """
    prev = F.coalesce(F.lag("entry_hash").over(W.partitionBy(chain).orderBy(seq)), F.lit(GENESIS))
    bad = (F.col("prev_hash") != prev) | (F.col("entry_hash") != F.sha2(F.concat("prev_hash", payload), 256))
    return entries.withColumn("_bad", bad).where("_bad").groupBy(chain).agg(F.min(seq).alias("first_bad"))


#: Days that data are kept, by outcome; an open case is held.
RETENTION_DAYS = {"false_case": 90, "undetected": 1825, "chargesheeted": 3650, "no_outcome": 1095}


def retention(cases: DataFrame, as_of: DataFrame) -> DataFrame:
    """Cases (case_id, status, cstype, day) with bucket, age and decision (due, hold or within)."""
    bucket = F.when(F.col("status") == 1, "open").when(F.col("cstype") == "A", "chargesheeted").when(F.col("cstype") == "B", "false_case").when(F.col("cstype") == "C", "undetected").otherwise("no_outcome")
    limit = F.create_map(*(F.lit(x) for kv in RETENTION_DAYS.items() for x in kv))
    out = cases.crossJoin(F.broadcast(as_of)).withColumn("bucket", bucket).withColumn("age", F.datediff("as_of", "day"))  # as_of is one row
    kept = F.element_at(limit, F.col("bucket"))
    return out.withColumn("decision", F.when(F.col("bucket") == "open", "hold").when(F.col("age") > kept, "due").otherwise("within"))


TOMBSTONE = "[ERASED-DPDP]"


def purge_plan(due: DataFrame, people: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """What a purge of the due cases would overwrite: (table, id, case_id, field, value). A plan, nothing changes.

    people: table -> (rows, id column, name column); complainants are included.
    """
    parts = [rows.join(due.select("case_id").distinct(), "case_id", "left_semi").select(F.lit(t).alias("table"), F.col(i).cast("long").alias("id"), "case_id", F.lit(n).alias("field"), F.lit(TOMBSTONE).alias("value")) for t, (rows, i, n) in people.items()]
    return reduce(DataFrame.union, parts)


def erasure(name: str, people: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Q23: the rows that hold exactly this name."""
    return reduce(DataFrame.union, [rows.where(F.col(n) == name).select(F.lit(t).alias("table"), F.col(i).cast("long").alias("id"), "case_id") for t, (rows, i, n) in people.items()])


def person_names(people: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """U06."""
    return reduce(DataFrame.union, [rows.select(F.col(n).alias("name")) for rows, _, n in people.values()]).where("name is not null").distinct()


#: Events of one day in the order of cause and effect.
SEQUENCE = ["INCIDENT", "REPORTED", "FIR REGISTERED", "ARREST", "CHARGESHEET", "LINKED PRIOR OFFENCE"]


def timeline(cases: DataFrame, accused: DataFrame, arrests: DataFrame, groups: DataFrame) -> DataFrame:
    """(case_id, position, at, kind, what) of every case."""
    name = accused.select("accused_id", "name")
    who = accused.join(groups.withColumnRenamed("id", "accused_id"), "accused_id")
    linked = who.select("component", "case_id").join(who.select("component", F.col("case_id").alias("other"), "name"), "component").where("case_id <> other").drop("component").distinct()
    linked = linked.join(cases.select(F.col("case_id").alias("other"), "registered", "crime"), "other")
    parts = [
        cases.select("case_id", F.col("occurred").alias("at"), F.lit("INCIDENT").alias("kind"), F.concat(F.lit("Offence occurred "), F.date_format("occurred", "HH:mm")).alias("what")),
        cases.select("case_id", F.col("registered").cast("timestamp"), F.lit("FIR REGISTERED"), F.concat(F.lit("FIR "), F.col("case_id").cast("string"), F.lit(" registered"))),
        arrests.join(name, "accused_id").select("case_id", F.col("arrested_on").cast("timestamp"), F.lit("ARREST"), F.concat("name", F.lit(" arrested"))),
        linked.select("case_id", F.col("registered").cast("timestamp"), F.lit("LINKED PRIOR OFFENCE"), F.concat(F.lit("Same person ("), "name", F.lit(") in FIR "), F.col("other").cast("string"))),
    ]
    events = reduce(DataFrame.union, parts).where("at is not null")
    place = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(SEQUENCE) for x in (k, i))), F.col("kind"))
    return events.withColumn("position", F.row_number().over(W.partitionBy("case_id").orderBy(F.to_date("at"), place, "at", "what")))


def proxy_values(identities: DataFrame, complainants: DataFrame, attribute: str) -> DataFrame:
    """(identity, flagged, value): an attribute of the complainants in an identity's cases, as a channel of proxies and never
    an input of the score; identities (identity, band, cases) of the bands HIGH and MEDIUM are flagged."""
    held = identities.select("identity", F.col("band").isin("HIGH", "MEDIUM").alias("flagged"), F.explode("cases").alias("case_id"))
    return held.join(complainants.select("case_id", F.col(attribute).alias("value")), "case_id").where("value is not null").select("identity", "flagged", "value").distinct()


def fairness(identities: DataFrame, complainants: DataFrame, attribute: str, least: float = 0.8, warn: float = 0.35) -> DataFrame:
    """One row per value of an attribute: n, flagged, rate, ratio of the lowest to the highest rate, the verdict by the
    four-fifths rule, the distance of the values' shares on both sides of the flag, and whether that is a warning."""
    from skein.operators import analytics

    rows = proxy_values(identities, complainants, attribute)
    rates = analytics.selection_rates(rows, "value", F.col("flagged"))
    distance = analytics.total_variation(rows, F.col("flagged"), "value", warn)  # one row
    verdict = F.when(F.col("ratio").isNull(), "insufficient").when(F.col("ratio") >= least, "pass").otherwise("adverse impact")
    return rates.crossJoin(F.broadcast(distance)).withColumn("verdict", verdict)


#: The fields of an audit entry that are hashed, besides prev_hash.
AUDIT_FIELDS = ["access_decision", "cases_touched", "intent", "query", "response_chars", "role", "seq", "timestamp", "user"]


def _entry_hash(values: tuple, prev: str) -> str:
    """sha256 of the hash before and a JSON of AUDIT_FIELDS and prev_hash in alphabetical order."""
    import hashlib
    import json

    entry = dict(zip(AUDIT_FIELDS, (v.tolist() if hasattr(v, "tolist") else v for v in values), strict=True)) | {"prev_hash": prev}
    return hashlib.sha256((prev + json.dumps(entry, sort_keys=True)).encode()).hexdigest()


def audited(entries: DataFrame, chain: str, seq: str = "seq") -> DataFrame:
    """Entries of AUDIT_FIELDS with prev_hash and entry_hash, by chain in the order of seq, as chained()."""
    fields = entries.schema.simpleString()[7:-1]

    def walk(batches):
        last, prev = object(), GENESIS
        for pdf in batches:
            before, after = [], []
            for c, *values in zip(pdf[chain], *(pdf[f] for f in AUDIT_FIELDS), strict=True):
                if c != last:
                    last, prev = c, GENESIS
                before.append(prev)
                prev = _entry_hash(tuple(values), prev)
                after.append(prev)
            yield pdf.assign(prev_hash=before, entry_hash=after)

    return entries.repartition(chain).sortWithinPartitions(chain, seq).mapInPandas(walk, f"{fields},prev_hash:string,entry_hash:string")


def tampered(entries: DataFrame, chain: str, seq: str = "seq") -> DataFrame:
    """The first entry of each chain whose fields or place were changed; each entry is hashed again by itself."""

    @F.pandas_udf("string")
    def again(*columns: pd.Series) -> pd.Series:
        *values, prev = columns
        return pd.Series([_entry_hash(tuple(v), p) for p, *v in zip(prev, *values, strict=True)])

    before = F.coalesce(F.lag("entry_hash").over(W.partitionBy(chain).orderBy(seq)), F.lit(GENESIS))
    rows = entries.withColumn("_again", again(*AUDIT_FIELDS, "prev_hash")).withColumn("_before", before)
    return rows.where("_again <> entry_hash or _before <> prev_hash").groupBy(chain).agg(F.min(seq).alias("first_bad"))


#: Beginnings of names with their lengths that are sent to every task after they are counted, about 10 MB.
SMALL_HEADS = 200_000


def _broadcast_if_small(heads: DataFrame) -> DataFrame:
    heads = Scratch(heads.sparkSession, "heads").store(heads, "heads")
    return F.broadcast(heads) if heads.count() <= SMALL_HEADS else heads


def masked_table(df: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """T20 with a table of names: any known name, wherever it stands in a text, by one way for any number of names.

    Where three characters of a text begin names, its parts of these names' lengths from there are looked up among all names, so
    a row only meets names that it holds; the longest goes first. A row without any is left as it is, but for its numbers."""
    import re

    from skein.functions.text import masked

    known = names.where("length(name) > 2").select("name").distinct()
    heads = known.select(F.substring("name", 1, 3).alias("head"), F.length("name").alias("n")).distinct()
    out = df
    for c in columns:
        texts = out.where(F.length(c) > 2).select(c).distinct()
        at = F.sequence(F.lit(1), F.length(c) - 2)
        starts = F.transform(at, lambda i: F.struct(F.substring(F.col(c), i, F.lit(3)).alias("head"), i.alias("at")))
        # a text meets the names that are equal to a part of it, not all that begin alike
        parts = texts.select(c, F.explode(starts).alias("s")).select(c, "s.*").join(_broadcast_if_small(heads), "head").select(c, F.substring(F.col(c), F.col("at"), F.col("n")).alias("name")).distinct()
        hits = parts.join(known, "name")
        found = hits.groupBy(c).agg(F.collect_set("name").alias("_names"))

        @F.pandas_udf("string")
        def hide(text: pd.Series, held: pd.Series) -> pd.Series:
            return pd.Series([t if t is None or f is None or not len(f) else re.sub("|".join(map(re.escape, sorted(f, key=lambda n: (-len(n), n)))), "[NAME-MASKED]", t) for t, f in zip(text, held, strict=True)])

        out = out.join(found, c, "left").withColumn(c, hide(masked(F.col(c)), F.col("_names"))).drop("_names")
    return out.select(*df.columns)
