"""Analysis of questions: aliases, intents, named entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Abbreviation, full name.
ALIASES = (
    ("MBA", "Master of Business Administration"),
    ("MCA", "Master of Computer Applications"),
    ("BCA", "Bachelor of Computer Applications"),
    ("BTECH", "Bachelor of Technology"),
    ("MTECH", "Master of Technology"),
    ("BSC", "Bachelor of Science"),
    ("MSC", "Master of Science"),
    ("BA", "Bachelor of Arts"),
    ("MA", "Master of Arts"),
    ("BED", "Bachelor of Education"),
    ("BE", "Bachelor of Engineering"),
    ("LLB", "Bachelor of Laws"),
    ("PHD", "Doctor of Philosophy"),
    ("BALLB", "Bachelor of Arts and Bachelor of Laws"),
    ("BLIS", "Bachelor of Library and Information Science"),
    ("MLIS", "Master of Library and Information Science"),
    ("BARCH", "Bachelor of Architecture"),
    ("MARCH", "Master of Architecture"),
    ("MPLAN", "Master of Planning"),
    ("MBBS", "Bachelor of Medicine and Bachelor of Surgery"),
    ("BUMS", "Kamil-e-Tib-o-Jarahat (Bachelor of Unani Medicine and Surgery)"),
    ("BVOC", "Bachelor of Vocation"),
    ("BPHARM", "Bachelor of Pharmacy"),
    ("MPHARM", "Master of Pharmacy"),
    ("PGDCP", "Post Graduate Diploma in Computer Programming"),
    ("PGD", "Post Graduate Diploma"),
    ("SSSC", "Senior Secondary School Certificate"),
    ("BPED", "Bachelor of Physical Education"),
    ("MPED", "Master of Physical Education"),
    ("BCOM", "Bachelor of Commerce"),
    ("MCOM", "Master of Commerce"),
    ("BBA", "Bachelor of Business Administration"),
    ("BDS", "Bachelor of Dental Surgery"),
    ("BPT", "Bachelor of Physiotherapy"),
    ("MED", "Master of Education"),
    ("LLM", "Master of Laws"),
    ("MSW", "Master of Social Work"),
    ("MPH", "Master of Public Health"),
    ("BVA", "Bachelor of Visual Arts"),
    ("MVA", "Master of Visual Arts"),
)
#: Further spellings, as segments of letters. Fixed values.
SPELLINGS = {
    "BLIS": (("B", "Lib", "I", "Sc"), ("B", "Lib")),
    "MLIS": (("M", "Lib", "I", "Sc"), ("M", "Lib")),
    "MARCH": (("M", "Arch"),),
    "MPLAN": (("M", "Plan"),),
    "PGD": (("P", "G", "Diploma"), ("P", "G", "Dip")),
    "BED": (("B", "Ed"),),
    "MED": (("M", "Ed"),),
}
#: Keys that name where a passage comes from, not a fact in it. Fixed values.
CONTEXT_KEYS = ("course", "expanded course name", "faculty", "programme level", "record type", "field", "table", "table row")
#: Abbreviations that are words too, and so count only in capitals, in the case of their segments, or with a dot. Fixed values.
WORD_LIKE = ("BE", "MA", "BA", "BED", "MED", "MARCH", "MPLAN")
# Intent, pattern, preferred fields.
INTENTS = (
    ("fees", "\\b(?:fees?|cost|charges?|tuition)\\b", ("fee_summary",)),
    ("dates", "\\b(?:dates?|deadline|when|last day|schedule)\\b", ("application_summary", "test_schedule")),
    ("test", "\\b(?:tests?|exams?|entrance)\\b", ("test_schedule",)),
    ("eligibility", "\\b(?:eligib\\w*|qualif\\w*|require\\w*|criteria)\\b", ()),
    ("duration", "\\b(?:duration|how long|years?|semesters?)\\b", ()),
    ("intake", "\\b(?:intake|seats?|capacity)\\b", ()),
    ("age_limit", "\\b(?:ages?|older|younger|how old)\\b", ("age_limit",)),
    ("selection", "\\b(?:selection|selected|admission process|merit list)\\b", ("selection_process",)),
    ("test_centres", "\\b(?:tests?|exams?)\\s+(?:cent(?:re|er)|location)s?\\b", ("test_centres",)),
    ("test_paper", "\\b(?:syllabus|(?:test|exam) pattern|(?:test|exam|paper)\\s+(?:questions?|marks?)|(?:questions?|marks?)\\s+(?:in|on)\\s+(?:the\\s+)?(?:test|exam|paper))\\b", ("test_paper_details",)),
    ("documents", "\\b(?:documents?|certificates?|marksheets?)\\b", ()),
    ("apply", "\\b(?:apply|application|form|register)\\b", ("application_summary",)),
)


def alias_pattern(abbreviation: str) -> str:
    """Letters or segments with spaces, dots, hyphens or underscores between; a trailing dot belongs to it."""
    spellings = SPELLINGS.get(abbreviation, ())
    if abbreviation in WORD_LIKE:
        first, *rest = spellings[0] if spellings else abbreviation
        dotted = f"{first}[ _-]*\\.[ ._-]*" + "[ ._-]*".join(rest)
        body = f"(?:{abbreviation}|{first} *{' *'.join(rest)}|(?i:{dotted}))"
    else:
        body = "(?i:" + "|".join("[ ._-]*".join(form) for form in (*spellings, abbreviation)) + ")"
    return f"(?U)(?<!\\w){body}(?!\\w)\\.?"


def expand(question: Column) -> Column:
    """The question with abbreviations written out, longer ones first."""
    for short, full in sorted(ALIASES, key=lambda a: (-len(a[0]), a[0])):
        question = F.regexp_replace(question, alias_pattern(short), full)
    return question


def aliases_in(question: Column) -> Column:
    """Abbreviations that occur, in the order of the table."""
    return F.array_compact(F.array(*[F.when(F.rlike(question, F.lit(alias_pattern(short))), F.lit(short)) for short, _ in ALIASES]))


def _longest_first() -> list[tuple[str, str]]:
    return sorted(ALIASES, key=lambda a: (-len(a[0]), a[0]))


def alias_spans(question: Column) -> Column:
    """Matches from the left, longer abbreviations first, that don't overlap: array of (start, end, text, abbreviation, full_name)."""
    order = _longest_first()
    every = "|".join(f"(?:{alias_pattern(a)})" for a, _ in order)
    pieces, found = F.split(question, every, -1), F.regexp_extract_all(question, F.lit(every), F.lit(0))
    short = lambda m: F.coalesce(*[F.when(F.rlike(m, F.lit(f"^(?:{alias_pattern(a)})$")), F.lit(a)) for a, _ in order])
    full = F.create_map(*[F.lit(x) for kv in ALIASES for x in kv])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        b = a["at"] + F.length(x["p"])
        e = b + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(b.alias("start"), e.alias("end"), x["m"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    placed = F.aggregate(pairs, start, step, lambda a: a["out"])
    named = F.transform(placed, lambda x: F.struct(x["start"], x["end"], x["text"], short(x["text"]).alias("abbreviation")))
    return F.transform(named, lambda x: F.struct(x["start"], x["end"], x["text"], x["abbreviation"], F.try_element_at(full, x["abbreviation"]).alias("full_name")))


def title_names(title: Column) -> Column:
    """Full names of the longest abbreviations that a title holds, each once."""
    found = F.array_compact(F.array(*[F.when(F.rlike(title, F.lit(alias_pattern(a))), F.struct(F.lit(len(a)).alias("n"), F.lit(full).alias("name"))) for a, full in ALIASES]))
    most = F.array_max(F.transform(found, lambda x: x["n"]))
    return F.array_distinct(F.transform(F.filter(found, lambda x: x["n"] == most), lambda x: x["name"]))


#: Runs of capitals, and dotted groups of letters, that look like abbreviations. Fixed value.
CANDIDATE = "(?U)(?<![\\w.])(?:[A-Z][A-Za-z]{0,3}\\.\\s?)+[A-Z][A-Za-z]{0,3}\\.?(?!\\w)|\\b[A-Z]{3,}\\b"
#: Subjects that look like abbreviations. Fixed value.
SUBJECTS = ("GIS",)


def uncovered_abbreviations(text: Column) -> Column:
    """What looks like an abbreviation of a course in a text and lies outside all known ones; in order, repeats included."""
    rest = text
    for short, _ in _longest_first():
        rest = F.regexp_replace(rest, alias_pattern(short), "·")
    found = F.transform(F.regexp_extract_all(rest, F.lit(CANDIDATE), F.lit(0)), lambda x: F.trim(x))
    return F.filter(found, lambda x: ~x.isin(*SUBJECTS))


def intents(question: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(F.rlike(question, F.lit(T.any_case(p))), F.lit(n)) for n, p, _ in INTENTS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def preferred_fields(question: Column) -> Column:
    parts = [F.when(F.rlike(question, F.lit(T.any_case(p))), F.array(*[F.lit(x) for x in fields])) for _, p, fields in INTENTS if fields]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))


def unknown_abbreviations(texts: DataFrame, text: str, known: list[str]) -> DataFrame:
    """Distinct runs of two to six capitals, dots removed, that no table explains."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("(?<![A-Za-z0-9])((?:[A-Z]\\.?){2,6})(?![A-Za-z0-9])"), F.lit(1))).alias("a"))
    return found.select(F.replace("a", F.lit("."), F.lit("")).alias("abbreviation")).where(~F.col("abbreviation").isin(known)).distinct()


def exact_value(question: Column, passage: Column, skipped: tuple[str, ...] = CONTEXT_KEYS) -> Column:
    """Whether the value of any ``key: value`` line of the passage, but for skipped keys, stands in the question."""
    norm = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), " "), F.lit(" "))
    q = norm(question)

    def hit(line):
        key = F.trim(norm(F.substring_index(line, ":", 1)))
        value = F.trim(norm(F.substr(line, F.instr(line, ":") + 1)))
        named = ~key.isin(*skipped) if skipped else F.lit(True)
        return (F.instr(line, ":") > 0) & named & (F.length(value) > 0) & (F.instr(q, value) > 0)

    return F.exists(F.split(passage, "\n"), hit)
