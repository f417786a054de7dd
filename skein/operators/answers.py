"""Composed answers of the chat routes (Q24-Q26, T28): all turns of all sessions at once.

Turns are routed first (intent, case, language). Each intent has one branch, which is fed the distinct cases of its own
turns only, looks their facts up with semi-joins, and narrates them by a template: one row a case. Branches share one
result schema and meet their turns by (intent, case). Every answer cites its cases; one that cites others, or claims
another number of links than there are, is held back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions import text as T
from skein.operators import conversation, graph

# Attributes that no answer is given by.
PROTECTED = ["caste", "religion", "community", "ethnicity"]

ASK = "Which case should I analyse? Name its FIR number."
UNKNOWN = "I could not map that to a capability. Try: network, history, accused, victim, summary, status, timeline, money trail."
REFUSED = "Offenders are not profiled by protected attributes."
NOTHING = "There is no such case, or none that you may see."


def _listed(values: Column, most: int = 5) -> Column:
    """The first values in order, and how many more there are."""
    head = F.array_join(F.slice(values, 1, most), ", ")
    return F.when(F.size(values) > most, F.concat(head, F.lit(" and "), (F.size(values) - most).cast("string"), F.lit(" more"))).otherwise(head)


def _fir() -> Column:
    return F.concat(F.lit("FIR "), F.col("case_id").cast("string"))


def _row(rows: DataFrame, intent: str, answer: Column, cites: Column | None = None) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return rows.select(F.lit(intent).alias("intent"), "case_id", answer.alias("answer"), (F.coalesce(cites, none) if cites is not None else none).alias("cites"))


def branches(asked: DataFrame, cases: DataFrame, accused: DataFrame, arrests: DataFrame, complainants: DataFrame, groups: DataFrame, own: DataFrame) -> dict[str, DataFrame]:
    """intent -> (intent, case_id, answer, cites) for the cases that the turns of the intent ask for; asked: (intent, case_id)."""

    def of(intent: str) -> DataFrame:
        return asked.where(F.col("intent") == intent).select("case_id").distinct()

    def facts(intent: str) -> DataFrame:
        return cases.join(of(intent), "case_id", "left_semi")

    def people(intent: str) -> DataFrame:
        return accused.join(of(intent), "case_id", "left_semi")

    def shared(intent: str) -> DataFrame:
        """(case_id, linked): cases with a phone or vehicle in common, found from the asked cases' own evidence."""
        mine = own.where("entity like 'Phone:%' or entity like 'Vehicle:%'")
        wanted = mine.join(of(intent), "case_id", "left_semi")
        met = wanted.join(mine.select("entity", F.col("case_id").alias("other")), "entity").where("case_id <> other")
        return of(intent).join(met.groupBy("case_id").agg(F.array_sort(F.collect_set("other")).alias("linked")), "case_id", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<bigint>")))

    out = {}
    out["status"] = _row(facts("status"), "status", F.concat(_fir(), F.lit(" has status "), F.coalesce("status", F.lit("unknown")), F.lit("; registered on "), F.col("registered").cast("string"), F.lit(" in "), F.col("district"), F.lit(".")))
    named = people("accused").groupBy("case_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    out["accused"] = _row(facts("accused").select("case_id").join(named, "case_id", "left"), "accused", F.when(F.col("names").isNull(), F.concat(_fir(), F.lit(" names no accused."))).otherwise(F.concat(F.lit("Accused in "), _fir(), F.lit(": "), _listed(F.col("names")), F.lit("."))))
    out["victim"] = _row(complainants.join(of("victim"), "case_id", "left_semi").groupBy("case_id").agg(F.array_sort(F.collect_list("name")).alias("names")), "victim", F.concat(F.lit("Complainant in "), _fir(), F.lit(": "), _listed(F.col("names")), F.lit(".")))
    links = facts("network").select("case_id").join(shared("network"), "case_id")
    firs = F.transform("linked", lambda x: F.concat(F.lit("FIR "), x.cast("string")))
    out["network"] = _row(links, "network", F.when(F.size("linked") == 0, F.concat(_fir(), F.lit(" shares no phone or vehicle with another case."))).otherwise(F.concat(_fir(), F.lit(" is linked to "), F.size("linked").cast("string"), F.lit(" case(s): "), _listed(firs), F.lit("."))), F.col("linked"))
    who = people("identity_history").join(groups.withColumnRenamed("id", "accused_id"), "accused_id").select("case_id", "name", "component")
    past = who.join(groups.join(accused.select(F.col("accused_id").alias("id"), F.col("case_id").alias("other")), "id").select("component", "other"), "component").where("case_id <> other")
    past = past.groupBy("case_id").agg(F.array_sort(F.collect_set("other")).alias("linked"))
    history = facts("identity_history").select("case_id").join(past, "case_id", "left")
    out["identity_history"] = _row(history, "identity_history", F.when(F.col("linked").isNull(), F.concat(F.lit("No accused of "), _fir(), F.lit(" is resolved to another case."))).otherwise(F.concat(F.lit("Accused of "), _fir(), F.lit(" are resolved to "), F.size("linked").cast("string"), F.lit(" other case(s): "), _listed(F.transform("linked", lambda x: F.concat(F.lit("FIR "), x.cast("string")))), F.lit("."))), F.col("linked"))
    accounts = own.where("entity like 'FinancialAccount:%'")
    used = accounts.join(of("money_trail"), "case_id", "left_semi").join(accounts.groupBy("entity").agg(F.count("*").alias("n")), "entity")
    used = used.groupBy("case_id").agg(F.array_sort(F.collect_list(F.concat(F.substring_index("entity", ":", -1), F.lit(" in "), F.col("n").cast("string"), F.lit(" case(s)")))).alias("accounts"))
    out["money_trail"] = _row(facts("money_trail").select("case_id").join(used, "case_id", "left"), "money_trail", F.when(F.col("accounts").isNull(), F.concat(_fir(), F.lit(" names no account."))).otherwise(F.concat(F.lit("Accounts in "), _fir(), F.lit(": "), _listed(F.col("accounts")), F.lit("."))))
    seized = arrests.join(of("timeline"), "case_id", "left_semi").groupBy("case_id").agg(F.min("arrested_on").alias("first"), F.count("*").alias("n"))
    out["timeline"] = _row(facts("timeline").join(seized, "case_id", "left"), "timeline", F.concat(_fir(), F.lit(": registered on "), F.col("registered").cast("string"), F.when(F.col("n").isNull(), F.lit("; no arrest.")).otherwise(F.concat(F.lit("; "), F.col("n").cast("string"), F.lit(" arrest(s), the first on "), F.col("first").cast("string"), F.lit(".")))))
    count = people("summary").groupBy("case_id").agg(F.count("*").alias("n"))
    brief = facts("summary").join(count, "case_id", "left").join(shared("summary"), "case_id")
    out["summary"] = _row(brief, "summary", F.concat(_fir(), F.lit(": "), F.coalesce("crime", F.lit("offence")), F.lit(" in "), F.col("district"), F.lit(", "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" accused, linked to "), F.size("linked").cast("string"), F.lit(" case(s).")))
    return out


def answered(turns: DataFrame, session: str, turn: str, text: str, cases: DataFrame, accused: DataFrame, arrests: DataFrame, complainants: DataFrame, groups: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(session, turn, intent, case_id, answer) of every turn. visible (case_id) is the caller's scope, all cases if None: other cases
    are as if they were not there, also as links. A null text is an unknown intent; a turn that leans on a case that was never
    named is asked back; one by a protected attribute is refused."""
    if visible is not None:
        scope = visible.select("case_id").distinct()
        cases, accused, arrests, complainants = (x.join(scope, "case_id", "left_semi") for x in (cases, accused, arrests, complainants))
        groups = groups.join(accused.select(F.col("accused_id").alias("id")), "id", "left_semi")
    own = graph.evidence(cases)
    t = conversation.resolved(turns.withColumn(text, F.coalesce(text, F.lit(""))), session, turn, text).select(session, turn, F.col("route.intent").alias("intent"), "case_id", T.names_protected(F.col(text), PROTECTED).alias("refused"))
    # carried only for some intents; here each intent that speaks of one case takes the session's last
    asked = t.where("not refused and case_id is not null").select("intent", "case_id")
    rows = reduce(DataFrame.union, branches(asked, cases, accused, arrests, complainants, groups, own).values())
    linked = F.when(F.col("answer").contains("linked to"), F.size("cites"))
    safe = F.col("intent").isin("summary") | T.claims_hold(F.col("answer"), F.concat(F.array("case_id"), "cites"), F.coalesce(linked, F.lit(0)).cast("long"))
    rows = rows.select("intent", "case_id", F.when(safe, F.col("answer")).otherwise("[HELD BACK: a claim without its case]").alias("answer"))
    known = list(conversation.INTENTS)
    out = t.join(rows, ["intent", "case_id"], "left")
    served = F.col("intent").isin("status", "accused", "victim", "network", "identity_history", "money_trail", "timeline", "summary")
    answer = F.when(F.col("refused"), REFUSED).when(~F.col("intent").isin(*known) | ~served, UNKNOWN).when(F.col("case_id").isNull(), ASK).otherwise(F.coalesce("answer", F.lit(NOTHING)))
    return out.select(session, turn, "intent", "case_id", answer.alias("answer"))


def spoken(turns: DataFrame, text: str) -> DataFrame:
    """Q25: transcripts as turns: repaired, and sent where T33 says: a case number alone asks for the case's summary, a question
    with one keeps its words with the number in digits, a name is left to the person search (kind `search`), the rest is
    conversation. Adds `kind` and puts the words that are to be answered in place of the text."""
    heard = T.repaired(F.coalesce(text, F.lit("")))
    number = T.spoken_case(F.col(text))
    named = T.explicit_case(heard).isNotNull()
    routed = conversation.intent(heard)["intent"] != "unknown"
    fir = F.concat(F.lit("fir "), number.cast("string"))
    words = F.when(number.isNull() | named, heard).when(routed, F.concat(heard, F.lit(" "), fir)).otherwise(F.concat(F.lit("summary of "), fir))
    words = F.when(named & ~routed, F.concat(F.lit("summary of "), heard)).otherwise(words)
    name = T.dispatch(heard) == "search"
    return turns.withColumns({"kind": F.when(number.isNotNull(), "brief").when(name & ~routed, "search").otherwise("conversation"), text: words})
