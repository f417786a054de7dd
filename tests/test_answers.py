"""Composed answers, the dashboard and transcript repair."""

import datetime

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import relational as R
from skein.operators.answers import ASK, NOTHING, REFUSED, UNKNOWN, answered, branches

DAY = datetime.date(2025, 3, 1)


def _tables(spark):
    cases = spark.createDataFrame([(1, "D1", "Robbery", "Open", DAY, "Phone +919876543210."), (2, "D1", "Theft", None, DAY, "Phone +919876543210. Paid to mule@ybl."), (3, "D2", "Theft", "Closed", DAY, "Paid to mule@ybl.")], "case_id long, district string, crime string, status string, registered date, facts string")
    accused = spark.createDataFrame([(10, 1, "Ravi"), (20, 2, "Ravi"), (21, 2, "Asha"), (30, 3, "Kiran")], "accused_id long, case_id long, name string")
    arrests = spark.createDataFrame([(2, 20, DAY)], "case_id long, accused_id long, arrested_on date")
    complainants = spark.createDataFrame([(1, 1, "Citizen 1")], "complainant_id long, case_id long, name string")
    groups = spark.createDataFrame([(10, 10), (20, 10)], "id long, component long")
    return cases, accused, arrests, complainants, groups


def test_every_intent_is_answered_from_its_own_case(spark):
    turns = [
        ("a", 1, "show the network of FIR 1"), ("a", 2, "and its status"), ("a", 3, "who is the accused in case 2"), ("a", 4, "history of case 1"), ("a", 5, "history of case 3"),
        ("a", 6, "which upi is in fir 3"), ("a", 7, "timeline of case 2"), ("a", 8, "timeline of case 3"), ("a", 9, "summary of fir 2"), ("a", 10, "who reported case 1"),
        ("b", 1, "status"), ("b", 2, "list accused by caste"), ("b", 3, None), ("b", 4, "status of fir 99"), ("b", 5, "network of fir 3"), ("b", 6, "status of case 2"),
    ]
    df = spark.createDataFrame(turns, "s string, t int, q string")
    got = {(r.s, r.t): r.answer for r in answered(df, "s", "t", "q", *_tables(spark)).collect()}
    assert got == {
        ("a", 1): "FIR 1 is linked to 1 case(s): FIR 2.", ("a", 2): "FIR 1 has status Open; registered on 2025-03-01 in D1.", ("a", 3): "Accused in FIR 2: Asha, Ravi.",
        ("a", 4): "Accused of FIR 1 are resolved to 1 other case(s): FIR 2.", ("a", 5): "No accused of FIR 3 is resolved to another case.", ("a", 6): "Accounts in FIR 3: mule@ybl in 2 case(s).",
        ("a", 7): "FIR 2: registered on 2025-03-01; 1 arrest(s), the first on 2025-03-01.", ("a", 8): "FIR 3: registered on 2025-03-01; no arrest.", ("a", 9): "FIR 2: Theft in D1, 2 accused, linked to 1 case(s).",
        ("a", 10): "Complainant in FIR 1: Citizen 1.", ("b", 1): ASK, ("b", 2): REFUSED, ("b", 3): UNKNOWN, ("b", 4): NOTHING, ("b", 5): "FIR 3 shares no phone or vehicle with another case.", ("b", 6): "FIR 2 has status unknown; registered on 2025-03-01 in D1.",
    }


def test_answers_stay_in_scope(spark):
    df = spark.createDataFrame([("a", 1, "network of FIR 1"), ("a", 2, "status of fir 2"), ("a", 3, "history of fir 1")], "s string, t int, q string")
    scope = spark.createDataFrame([(1,), (3,)], "case_id long")
    got = {r.t: r.answer for r in answered(df, "s", "t", "q", *_tables(spark), scope).collect()}
    assert got == {1: "FIR 1 shares no phone or vehicle with another case.", 2: NOTHING, 3: "No accused of FIR 1 is resolved to another case."}


def test_spoken_turns_go_where_they_belong(spark):
    from skein.operators.answers import spoken

    said = ["Keshwan", "status of kase two", "Ravi Kumar", "what is the risk", "fire 2", "ಎರಡು", None, "network of FIR 1 please"]
    df = spoken(spark.createDataFrame([("v", i, x) for i, x in enumerate(said)], "s string, t int, q string"), "q")
    assert {r.t: (r.kind, r.q) for r in df.collect()} == {
        0: ("brief", "summary of case 1"), 1: ("brief", "status of case two fir 2"), 2: ("search", "ravi kumar"), 3: ("conversation", "what is the risk"), 4: ("brief", "summary of fir 2"),
        5: ("brief", "summary of fir 2"), 6: ("conversation", ""), 7: ("brief", "network of fir 1 please"),
    }
    got = {r.t: r.answer for r in answered(df.where("kind <> 'search'"), "s", "t", "q", *_tables(spark)).collect()}
    assert got[1] == "FIR 2 has status unknown; registered on 2025-03-01 in D1." and got[5] == got[4] == "FIR 2: Theft in D1, 2 accused, linked to 1 case(s)."


def test_branches_see_only_what_was_asked(spark):
    from skein.operators import graph

    cases, accused, arrests, complainants, groups = _tables(spark)
    asked = spark.createDataFrame([("status", 1), ("status", 1), ("summary", 2)], "intent string, case_id long")
    out = branches(asked, cases, accused, arrests, complainants, groups, graph.evidence(cases))
    assert {k: sorted(r.case_id for r in v.collect()) for k, v in out.items() if v.count()} == {"status": [1], "summary": [2]}


def test_dashboard_counts_every_section_and_pages_the_latest(spark):
    rows = [(i, ["A", "B", None][i % 3], f"d{i % 10}", DAY + datetime.timedelta(days=i // 4) if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "case_id long, status string, district string, day date")
    got = R.dashboard(df, {"status": "status", "district": "district"}, "day", "case_id", {"district": 8}, latest=5).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.section, r.rank)):
        by.setdefault(r.section, []).append((r.label, r.value, r.share))
    assert by["status"] == [(None, 20, 33.3), ("A", 20, 33.3), ("B", 20, 33.3)] and len(by["district"]) == 8 and by["total"] == [(None, 60, None)]
    dated = sorted(((d, i) for i, _, _, d in rows if d), reverse=True)
    assert [(a, v) for a, v, _ in by["recent"]] == [(str(d), i) for d, i in dated[:5]]
    assert sum(v for _, v, _ in by["monthly_trend"]) == len(dated)
    assert R.dashboard(df.limit(0), {"status": "status"}, "day", "case_id", {}).count() == 0


HEARD = [
    ("fire 12", 12), ("fear one", 1), ("keys two hundred", 200), ("Keshwan", 1), ("kishan", 1), ("kesh two", 2), ("kesh three", 3), ("kase twenty five", 25), ("case fourteen", 14),
    ("case nineteen please open it", 19), ("case two hundred and five", 205), ("case one hundred", 100), ("hundred", 100), ("case ninety nine now nine", 99), ("fourty two", 42), ("open the case", None),
    ("three", 3), ("seven hundred and sixty one", 761), ("and", None), ("FIR 7", 7), ("fir 123 and 45", 123), ("case 1234", None), ("ten", 10), ("eleven", 11), ("fir eighty", 80), ("five hundred", 500),
    ("ಒಂದು", 1), ("ಉಂಡು", 1), ("ಎರಡು", 2), ("ಮೂರು", 3), ("ನಾಲ್ಕು", 4), ("ಐದು", 5), ("ಆರು", 6), ("ಏಳು", 7), ("ಎಂಟು", 8), ("ಒಂಬತ್ತು", 9), ("ಹತ್ತು", 10), ("ಪ್ರಕರಣ ಎರಡ", 2), ("ondu", 1), ("eradu", 2), ("mooru", 3),
    ("hattu", 10), ("the", None), ("tree", None), ("", None), (None, None), ("elu", 7),
]


def test_spoken_cases(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HEARD)], "i int, heard string")
    got = {r.i: r.n for r in df.select("i", T.spoken_case(F.col("heard")).alias("n")).collect()}
    assert [(h, got[i]) for i, (h, _) in enumerate(HEARD)] == HEARD


@pytest.mark.parametrize("text,fallback,day", [("2025-03-04", None, "2025-03-04"), ("2025-03-04T10:20:00", None, "2025-03-04"), ("2025-03-04 10:20:00", "2020-01-01", "2025-03-04"), ("2025-03-04 or so", None, "2025-03-04"), ("soon", "2020-01-01", "2020-01-01"), ("2025-13-41", None, None), (None, "2020-01-01", "2020-01-01"), (None, None, None)])
def test_days_are_parsed_or_fall_back(spark, text, fallback, day):
    df = spark.createDataFrame([(text, fallback)], "t string, f string")
    assert str(df.select(T.parsed_day(F.col("t"), F.col("f")).alias("d")).first().d) == str(day)
