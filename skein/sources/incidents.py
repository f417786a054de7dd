"""Incident tables: schemas, contract-checked CSV input, foreign keys, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# The tables' columns in the order of their files.
TABLES = {
    "State": "StateID int, StateName string, Active int",
    "District": "DistrictID int, DistrictName string, StateID int, Active int",
    "UnitType": "UnitTypeID int, UnitTypeName string, Active int",
    "Unit": "UnitID int, UnitName string, TypeID int, StateID int, DistrictID int, Active int",
    "CaseCategory": "CaseCategoryID int, CodeDigit int, LookupValue string",
    "GravityOffence": "GravityOffenceID int, LookupValue string",
    "CrimeHead": "CrimeHeadID int, CrimeGroupName string, Active int",
    "CrimeSubHead": "CrimeSubHeadID int, CrimeHeadID int, CrimeHeadName string",
    "CaseStatusMaster": "CaseStatusID int, CaseStatusName string",
    "ReligionMaster": "ReligionID int, ReligionName string",
    "CasteMaster": "caste_master_id int, caste_master_name string",
    "OccupationMaster": "OccupationID int, OccupationName string",
    "Rank": "RankID int, RankName string, Hierarchy int, Active int",
    "Designation": "DesignationID int, DesignationName string, Active int",
    "Court": "CourtID int, CourtName string, DistrictID int, StateID int, Active int",
    "Employee": "EmployeeID int, DistrictID int, UnitID int, RankID int, DesignationID int, KGID string, FirstName string, EmployeeDOB date, GenderID int, AppointmentDate date",
    "Act": "ActCode string, ActDescription string, ShortName string, Active int",
    "Section": "ActCode string, SectionCode string, SectionDescription string, Active int",
    "CaseMaster": "CaseMasterID int, CrimeNo string, CaseNo string, CrimeRegisteredDate date, PolicePersonID int, PoliceStationID int, CaseCategoryID int, GravityOffenceID int, CrimeMajorHeadID int, CrimeMinorHeadID int, CaseStatusID int, CourtID int, IncidentFromDate timestamp, IncidentToDate timestamp, InfoReceivedPSDate timestamp, latitude double, longitude double, BriefFacts string",
    "Accused": "AccusedMasterID int, CaseMasterID int, AccusedName string, AgeYear int, GenderID int, PersonID string",
    "Victim": "VictimMasterID int, CaseMasterID int, VictimName string, AgeYear int, GenderID int, VictimPolice int",
    "ChargesheetDetails": "CSID int, CaseMasterID int, csdate timestamp, cstype string, PolicePersonID int",
    "ComplainantDetails": "ComplainantID int, CaseMasterID int, ComplainantName string, AgeYear int, OccupationID int, ReligionID int, CasteID int, GenderID int",
    "ArrestSurrender": "ArrestSurrenderID int, CaseMasterID int, ArrestSurrenderTypeID int, ArrestSurrenderDate date, ArrestSurrenderStateId int, ArrestSurrenderDistrictId int, PoliceStationID int, IOID int, CourtID int, AccusedMasterID int, IsAccused int, IsComplainantAccused int",
    "ActSectionAssociation": "CaseMasterID int, ActID string, SectionID string, ActOrderID int, SectionOrderID int",
}

#: child, columns, parent, columns
FOREIGN_KEYS = [
    ("District", ["StateID"], "State", ["StateID"]),
    ("Unit", ["TypeID"], "UnitType", ["UnitTypeID"]),
    ("Unit", ["DistrictID"], "District", ["DistrictID"]),
    ("CrimeSubHead", ["CrimeHeadID"], "CrimeHead", ["CrimeHeadID"]),
    ("Court", ["DistrictID"], "District", ["DistrictID"]),
    ("Employee", ["UnitID"], "Unit", ["UnitID"]),
    ("Section", ["ActCode"], "Act", ["ActCode"]),
    ("CaseMaster", ["PoliceStationID"], "Unit", ["UnitID"]),
    ("CaseMaster", ["CaseStatusID"], "CaseStatusMaster", ["CaseStatusID"]),
    ("CaseMaster", ["CaseCategoryID"], "CaseCategory", ["CaseCategoryID"]),
    ("Accused", ["CaseMasterID"], "CaseMaster", ["CaseMasterID"]),
    ("Victim", ["CaseMasterID"], "CaseMaster", ["CaseMasterID"]),
    ("ComplainantDetails", ["CaseMasterID"], "CaseMaster", ["CaseMasterID"]),
    ("ComplainantDetails", ["OccupationID"], "OccupationMaster", ["OccupationID"]),
    ("ChargesheetDetails", ["CaseMasterID"], "CaseMaster", ["CaseMasterID"]),
    ("ArrestSurrender", ["AccusedMasterID"], "Accused", ["AccusedMasterID"]),
    ("ActSectionAssociation", ["CaseMasterID"], "CaseMaster", ["CaseMasterID"]),
    ("ActSectionAssociation", ["ActID"], "Act", ["ActCode"]),
]


class ContractError(ValueError):
    """A table's file is missing, or its header is not the contract's, name by name and in order."""


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with exactly the schema's header; an empty cell is null."""
    try:
        header = spark.read.option("header", True).csv(path).columns
    except Exception as e:
        raise ContractError(f"{path}: {type(e).__name__}") from e
    wanted = [c.split()[0] for c in schema.split(", ")]
    if header != wanted:
        raise ContractError(f"{path}: header {header}, contract {wanted}")
    return spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "").schema(schema).csv(path)


def load(spark: SparkSession, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a folder, each checked; temporary views have their names."""
    out = {t: read_csv(spark, f"{folder}/{t}.csv", TABLES[t]) for t in tables or TABLES}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, df in tables.items()])


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], name: str) -> DataFrame:
    """(fk, n) child rows whose complete key has no parent."""
    p = parent.select(*(F.col(b).alias(a) for a, b in zip(keys, parent_keys, strict=True))).distinct()
    return child.dropna(subset=keys).join(p, keys, "left_anti").agg(F.lit(name).alias("fk"), F.count("*").alias("n"))


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """S03 over all declared keys whose two tables are given; rows with n > 0 are violations."""
    return reduce(DataFrame.union, [orphans(tables[c], k, tables[p], pk, f"{c}.{'+'.join(k)}") for c, k, p, pk in FOREIGN_KEYS if c in tables and p in tables])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label, edges by rel."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def append_audit(entries: DataFrame, path: str, limit: int = 2000) -> None:
    """Scalar columns only; arrays become JSON, texts are cut to the limit."""
    cols = [F.to_json(c).alias(c) if t.startswith("array") else F.substring(c, 1, limit).alias(c) if t == "string" else F.col(c) for c, t in entries.dtypes]
    entries.select(*cols).write.mode("append").parquet(path)
