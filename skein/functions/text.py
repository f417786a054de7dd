"""Text functions: evidence patterns, language, tokens, lexicon tags, masking, guards.

Everything is a column expression but `mention_spans`, as no built-in gives the offsets of all matches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Evidence patterns.
PHONE = r"\+91(\d{10})"
SPACED_PHONE = r"\b(\d{3})\s(\d{3})\s(\d{4})\b"
VEHICLE = r"\bKA-\d{2}-[A-Z]{2}-\d{4}\b"
PAYMENT_HANDLE = r"\b([a-z0-9][a-z0-9._-]{1,})@([a-z][a-z0-9]{1,19})\b(?!\.[a-z])"

# English stop words.
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became
because become becomes becoming been before beforehand behind being below beside besides between beyond bill both
bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during each eg eight
either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty
fill find fire first five for former formerly forty found four from front full further get give go had has hasnt have
he hence her here hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in inc
indeed interest into is it its itself keep last latter latterly least less ltd made many may me meanwhile might mill
mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no nobody
none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours
ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several she
should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such
system take ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon
these they thick thin third this those though three through throughout thru thus to together too top toward towards
twelve twenty two un under until up upon us very via was we well were what whatever when whence whenever where
whereafter whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why
will with within without would yet you your yours yourself yourselves
""".split()

# Behaviour lexicon, tag and pattern.
LEXICON = [
    ("entry:rear_window", r"rear window|back window|window.{0,15}(broke|forced|prised|pried)"),
    ("entry:door_forced", r"door.{0,20}(broke|forced|prised|pried)|lock.{0,12}(broke|cut|forced)"),
    ("entry:grille_cut", r"grill?e?.{0,10}cut|iron bars? cut"),
    ("entry:duplicate_key", r"duplicate key|spare key"),
    ("entry:unlocked", r"door was (open|unlocked)|left unlocked"),
    ("target:house", r"\bhouse|residence|dwelling|home\b"),
    ("target:shop", r"\bshop|store|showroom|commercial premises\b"),
    ("target:vehicle", r"\bvehicle|motorcycle|two-wheeler|car\b"),
    ("target:person", r"\bpedestrian|passer-?by|the victim was walking\b"),
    ("property:gold", r"\bgold|jewell?ery|ornaments?|chain\b"),
    ("property:cash", r"\bcash|currency|money|rupees\b"),
    ("property:electronics", r"\bmobile phone|laptop|television|electronics\b"),
    ("tool:crowbar", r"crowbar|iron rod|lever"),
    ("tool:cutter", r"cutter|hacksaw|bolt cutter"),
    ("tool:weapon", r"\bknife|weapon|firearm|pistol|machete\b"),
    ("approach:vehicle", r"\b(on|using|in) a (motorcycle|two-wheeler|car|vehicle)|fled on"),
    ("approach:accomplice", r"accomplice|two persons|three persons|gang|along with another"),
    ("approach:impersonate", r"posing as|impersonat|pretending to be|false pretext"),
    ("approach:online", r"\bonline|UPI|transfer|induced.{0,20}transfer|call(ed)? .{0,15}mobile\b"),
]

KANNADA = r"[ಀ-೿]"
MENTION = ArrayType(StructType([StructField(c, StringType()) for c in ("type", "value", "span")] + [StructField(c, IntegerType()) for c in ("start", "end")]))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def phones(text: Column) -> Column:
    """+91 numbers, then spaced numbers that begin with 6-9, as +91 and ten digits."""
    plain = F.transform(_all(text, PHONE, 1), lambda d: F.concat(F.lit("+91"), d))
    spaced = F.transform(_all(text, SPACED_PHONE), lambda d: F.regexp_replace(d, r"\s", ""))
    return F.concat(plain, F.transform(F.filter(spaced, lambda d: d.rlike("^[6-9]")), lambda d: F.concat(F.lit("+91"), d)))


def vehicles(text: Column) -> Column:
    return _all(text, VEHICLE)


def payment_handles(text: Column) -> Column:
    """handle@provider, lowered; a provider followed by .letter is an e-mail address."""
    return F.transform(_all(text, f"(?i){PAYMENT_HANDLE}"), F.lower)


def mention_values(text: Column) -> Column:
    """array<struct<type,value>> in the order phones, vehicles, handles."""

    def typed(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))

    return F.concat(typed("phone", phones(text)), typed("vehicle", vehicles(text)), typed("upi", payment_handles(text)))


_COMPILED = [("phone", re.compile(PHONE)), ("spaced", re.compile(SPACED_PHONE)), ("vehicle", re.compile(VEHICLE)), ("upi", re.compile(PAYMENT_HANDLE, re.IGNORECASE))]


def find_mentions(text: str | None) -> list[dict]:
    out = []
    for kind, pattern in _COMPILED:
        for m in pattern.finditer(text or ""):
            value = m[0].lower() if kind == "upi" else m[0] if kind == "vehicle" else "+91" + "".join(m.groups())
            if kind != "spaced" or value[3] in "6789":
                out.append({"type": "phone" if kind == "spaced" else kind, "value": value, "span": m[0], "start": m.start(), "end": m.end()})
    return out


@F.pandas_udf(MENTION)
def mention_spans(text: pd.Series) -> pd.Series:
    """All mentions with their character offsets."""
    return text.map(find_mentions)


#: The same, where Spark would search a text once more in a filter that it moves below a join or an exchange.
mention_spans_once = F.pandas_udf(mention_spans.func, MENTION).asNondeterministic()


def context(text: Column, start: Column, end: Column, width: int = 45) -> Column:
    """The text around a span, on one line."""
    a = F.greatest(start - width, F.lit(0))
    return F.regexp_replace(F.substring(text, a + 1, end + width - a), "\n", " ")


def node_id(kind: str, value: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), value.cast("string"))


def is_kannada(text: Column) -> Column:
    return text.rlike(KANNADA)


def language(text: Column) -> Column:
    """Kn, en or code-mixed."""
    latin = text.rlike("[A-Za-z]{2,}")
    return F.when(is_kannada(text) & latin, "code-mixed").when(is_kannada(text), "kn").otherwise("en")


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS, bigrams: bool = True) -> Column:
    """Words of two characters or more without stop words, then pairs of what is left."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
    if not bigrams:
        return words
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit(""))))
    return F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def lexicon_tags(text: Column, lexicon: Sequence[tuple[str, str]] = tuple(LEXICON)) -> Column:
    """Sorted tags whose pattern occurs, whatever the case. In an alternation, a word boundary binds
    to the first or last branch only, as in the fixed patterns."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.array_compact(F.array(*(F.when(t.rlike(f"(?i){rx}"), F.lit(tag)) for tag, rx in lexicon))))


_WORD = "[A-Za-z0-9_]"


def re2(pattern: str) -> str:
    """The pattern as RE2 reads it, for (?i) in Java: word boundaries are those of ASCII words, and the long s and the Kelvin sign
    are cases of s and k. Escapes and character classes stay as they are."""
    boundary = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
    folded = {"s": "[s\u017f]", "k": "[k\u212a]"}
    return re.sub(r"\\.|\[\^?\]?[^\]]*\]|[skSK]", lambda m: boundary if m[0] == r"\b" else folded.get(m[0].lower(), m[0]), pattern)


def time_of_day(ts: Column) -> Column:
    """T19."""
    h = F.hour(ts)
    return F.when(h < 5, "time:early_hours").when(h < 12, "time:morning").when(h < 18, "time:afternoon").when(h < 22, "time:evening").when(h >= 22, "time:night")


def masked(text: Column, names: Sequence[str] = ()) -> Column:
    """Phone numbers in both forms, then known names of more than two letters, the longest first."""
    out = F.regexp_replace(F.regexp_replace(text, r"\+91\d{10}", "[PHONE-MASKED]"), r"\b[6-9]\d{2}\s\d{3}\s\d{4}\b", "[PHONE-MASKED]")
    known = sorted({n for n in names if n and len(n) > 2}, key=lambda n: (-len(n), n))
    return F.regexp_replace(out, "|".join(re.escape(n) for n in known), "[NAME-MASKED]") if known else out


def has_phrase(phrase: str, text: Column) -> Column:
    """A phrase between word boundaries; Kannada phrases match anywhere."""
    if re.search(KANNADA, phrase):
        return text.contains(phrase)
    return F.lower(text).rlike(rf"\b{re.escape(phrase)}\b")


def explicit_case(text: Column) -> Column:
    """The number behind 'fir' or 'case', else null."""
    found = F.regexp_extract(F.lower(text), r"\b(?:fir|case)\s*#?\s*(\d+)\b", 1)
    return F.when(found != "", found).try_cast("long")


def claims_hold(answer: Column, allowed: Column, linked: Column) -> Column:
    """Every cited case is allowed, and every 'linked to N cases' gives the true N."""
    cited = F.transform(_all(F.lower(answer), r"\b(?:fir|case)s?\s*#?\s*(\d+)", 1), lambda x: x.try_cast("long"))
    counts = F.transform(_all(F.lower(answer), r"linked to (\d+)", 1), lambda x: x.try_cast("long"))
    return (F.size(F.array_except(cited, allowed)) == 0) & F.forall(counts, lambda n: n == linked)


def numbers_survive(source: Column, translated: Column) -> Column:
    """Each number of the source is in the translation."""
    return F.size(F.array_except(_all(source, r"\d+"), _all(translated, r"\d+"))) == 0


def same_numbers_by_line(source: Column, translated: Column) -> Column:
    """T26, for one line: the same numbers in the same order, and no less than 0.45 of the length."""
    return (_all(source, r"\d+") == _all(translated, r"\d+")) & (F.length(translated) >= 0.45 * F.length(source))


def without_scratchpad(text: Column) -> Column:
    """Drops <think> parts, closed or not, and a leading 'final answer' label."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<think>.*$", ""), r"(?is)^.*</think>", "")
    return F.trim(F.regexp_replace(out, r"(?i)^\s*(final answer|answer)\s*:\s*", ""))


def cited_or_blocked(answer: Column, citations: Column) -> Column:
    """An answer that makes a claim must cite."""
    claim = answer.rlike(r"(?i)\b(fir|case|accused|linked|account)\b")
    return F.when(claim & (F.coalesce(F.size(citations), F.lit(0)) == 0), F.lit("[BLOCKED: no citation]")).otherwise(answer)


def names_protected(text: Column, protected: Sequence[str]) -> Column:
    """Whether a word of the text is a protected attribute."""
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}]+"), F.array(*map(F.lit, protected)))


# Spoken numbers. Kannada ones are heard in several spellings.
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
UNITS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
HEARD_NUMBERS = {
    1: ["ಒಂದು", "ಉಂಡು", "ಒನ್ದು", "ondu", "undu"], 2: ["ಎರಡು", "ಇರಡು", "eradu"], 3: ["ಮೂರು", "ಮುರು", "mooru", "muru"], 4: ["ನಾಲ್ಕು", "nalku"], 5: ["ಐದು", "aidu"],
    6: ["ಆರು", "aaru"], 7: ["ಏಳು", "elu"], 8: ["ಎಂಟು", "entu"], 9: ["ಒಂಬತ್ತು", "ombattu"], 10: ["ಹತ್ತು", "hattu"],
}
# What speech recognition makes of "fir", "case" and the first case numbers.
MISHEARD = [
    ("fir", ["fire", "fired", "fier", "fear", "feyar", "phair"]),
    ("case", ["keys", "kase", "kaise", "keys's", "cayce"]),
    ("case 1", ["keshwan", "kishwan", "kishan", "keshawan", "keshvan", "kesh one", "kesh wan"]),
    ("case 2", ["kesh two", "keshtwo"]),
    ("case 3", ["kesh three"]),
]


def spoken_digits(text: Column) -> Column:
    """Digit words become digits, and digits said one by one become one number."""
    out = F.lower(text)
    for i, w in enumerate(DIGIT_WORDS):
        out = F.regexp_replace(out, rf"\b{w}\b", str(i))
    return F.regexp_replace(out, r"(?<=\b\d) (?=\d\b)", "")


def repaired(text: Column) -> Column:
    """A transcript, lowered, with misheard words put right."""
    out = F.lower(F.trim(text))
    for right, wrong in MISHEARD:
        out = F.regexp_replace(out, rf"\b({'|'.join(map(re.escape, wrong))})\b", right)
    return F.trim(out)


def _valued(words: dict[str, int], word: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), word)


def _english_number(words: Column) -> Column:
    """The first number that the words spell: units, teens and tens add up, `hundred` multiplies, `and` goes on inside a
    number, and any other word ends it. An automaton over the words, with the value and whether it has begun or ended."""
    start = F.struct(F.lit(0).alias("value"), F.lit(False).alias("begun"), F.lit(False).alias("over"))

    def step(s: Column, w: Column) -> Column:
        adds = F.coalesce(_valued(UNITS | TEENS | TENS, w), F.lit(0))
        value = F.when(w == "hundred", F.when(s["value"] == 0, 100).otherwise(s["value"] * 100)).otherwise(s["value"] + adds)
        number = (adds > 0) | (w == "hundred")
        ends = ~number & s["begun"] & (w != "and")
        return F.when(s["over"], s).otherwise(F.struct(F.when(number, value).otherwise(s["value"]).alias("value"), (s["begun"] | number).alias("begun"), ends.alias("over")))

    return F.aggregate(words, start, step, lambda s: F.when(s["begun"] & (s["value"] > 0), s["value"]))


def spoken_case(text: Column) -> Column:
    """The case number of a transcript: digits (three at most), else an English number, else a Kannada one in either
    script: heard exactly, or in Kannada script within one edit, two for words of five letters and more. The nearest word wins,
    ties to the smaller number. Null if there is none."""
    t = repaired(text)
    digits = F.regexp_extract(t, r"\b(\d{1,3})\b", 1)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    heard = [(n, w) for n, variants in HEARD_NUMBERS.items() for w in variants]
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(w).alias("word"), F.lit(i).alias("i")) for i, (n, w) in enumerate(heard)))
    exact = F.array_min(F.transform(F.filter(table, lambda x: F.array_contains(words, x["word"])), lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"))))["n"]
    kannada = F.filter(words, is_kannada)

    def nearest(x: Column) -> Column:
        d = F.array_min(F.transform(kannada, lambda w: F.levenshtein(w, x["word"])))
        return F.when(is_kannada(x["word"]) & (d <= F.when(F.length(x["word"]) <= 4, 1).otherwise(2)), F.struct(d.alias("d"), x["i"].alias("i"), x["n"].alias("n")))

    close = F.array_min(F.array_compact(F.transform(table, nearest)))["n"]
    return F.coalesce(F.when(digits != "", digits.cast("int")), _english_number(words), exact, close).cast("long")


def parsed_day(text: Column, fallback: Column | None = None) -> Column:
    """The day of an ISO date or time, else the fallback, else null."""
    day = F.coalesce(text.try_cast("timestamp").cast("date"), F.substring(text, 1, 10).try_cast("date"))
    return F.coalesce(day, fallback.cast("date")) if fallback is not None else day


def near_word(word: Column, target: str) -> Column:
    """Within one edit, or two for Kannada words."""
    return F.levenshtein(word, F.lit(target)) <= F.when(is_kannada(word), 2).otherwise(1)


def crime_number(category: Column, district: Column, station: Column, year: Column, serial: Column) -> Column:
    """18 digits."""
    return F.format_string("%d%04d%04d%04d%05d", *(c.cast("int") for c in (category, district, station, year, serial)))


def dispatch(text: Column) -> Column:
    """Brief for a case number, name search for name-shaped text, else conversation."""
    name = text.rlike(r"^\p{L}[\p{L}\s.']{2,40}$") & (F.size(F.split(F.trim(text), r"\s+")) <= 4)
    return F.when(F.coalesce(explicit_case(repaired(text)), explicit_case(spoken_digits(text))).isNotNull(), "brief").when(name, "search").otherwise("conversation")
