"""Ordered, counted, typed redaction of personal data, as column expressions over Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cues import trie

#: Kinds in the order in which they are taken out, each on what the one before has left. Group 1 is a prefix that stays.
PATTERNS = (
    ("URL", r"(?iU)()(?:\b(?:https?://|www\.)\S+|\b(?:bit\.ly|tinyurl\.com|t\.me|wa\.me|rb\.gy)/\S+|\b[\w-]+\.(?:apk|xyz|top|click|link)\b)"),
    ("EMAIL", r"(?U)()\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("UPI", r"(?iU)()\b[\w.-]{2,}@(?:ok)?[a-z]{2,}\b"),
    ("CARD", r"(?U)()\b(?:\d{4}[\s-]?){3}\d{4}\b"),
    ("AADHAAR", r"(?U)()\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("PAN", r"(?U)()\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("IFSC", r"(?U)()\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("PHONE", r"(?U)()(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"),
    ("OTP", r"(?iU)(\b(?:otp|pin|code|cvv)(?:\s+is)?[\s:]+)\d{3,8}\b"),
    ("ACCOUNT", r"(?iU)(?:(\bending\s+(?:in\s+)?)\d{4}\b|\b\d{9,18}\b)"),
)
#: Words that announce a name; those of the first list are titles.
TITLES = ("इंस्पेक्टर", "inspector", "officer", "constable", r"mr\.?", r"mrs\.?", r"ms\.?", r"dr\.?", "shri", r"smt\.?")
LEADS = ("this is", "i am", "i'm", "my name is", "mera naam", "naam", "hello", "hi", "dear", "namaste", "namaskar", "main", "speaking with", "good (?:morning|afternoon|evening)", "मेरा नाम", "नमस्ते")
#: Words that are no names.
NOT_NAMES = tuple(
    """
a an the to of in on at for from with and or is are am was be not no yes so just also already here there
it its it's me my your you we us our this that sir madam maam ma'am ji everyone all customer team bank police
inspector officer senior manager executive calling speaking connecting going sending adding hiring checking
telling sorry fine ok okay good glad very sure back again interested done ready happy hello hi automated alert
delivery aapka aapki aap bol baat ek mama beta bhai kya mera naam main hoon hai ki ka ke se raha rahi
sbi hdfc icici axis kotak pnb rbi cbi ncb trai fedex dhl paytm phonepe amazon flipkart microsoft airtel jio
support kyc head department office account card haan achha acha theek accha sahi mr mrs ms dr shri smt good
""".split()
)
_END = r"(?!['-]*[a-z])"
_WORD = r"[a-z](?:[a-z'-]*[a-z])(?![\w])"
_STOP = rf"(?!(?:{'|'.join(sorted(set(NOT_NAMES), key=lambda w: (-len(w), w)))}){_END}\b)"
_ING = rf"(?![a-z'-]*ing{_END}\b)"
_SECOND = rf"(?: {_STOP}{_ING}{_WORD})?"
NAME = rf"(?iU)((?:\b(?:{'|'.join(TITLES)})\s+)(?={_STOP}{_WORD})|(?:\b(?:{'|'.join(LEADS)})\s+)(?={_STOP}{_ING}{_WORD})){_WORD}{_SECOND}"
JI_NAME = rf"()\b(?!(?i:{'|'.join(sorted(set(NOT_NAMES), key=lambda w: (-len(w), w)))}) ji\b)([A-Za-z][a-z]+) ji\b"
TYPES = (*[k for k, _ in PATTERNS], "NAME")
MODES = ("none", "typed", "masked")


#: What a text must hold to have anything of a kind. Redaction takes such things away and brings none, so one look at the text serves all kinds.
_HINTS = {
    "url": r"(?i)https?://|www\.|\.(?:ly/|com/|me/|gy/|apk|xyz|top|click|link)",
    "at": "@",
    "digits": r"\p{Nd}{3}",
    "zero": "0",
    "name": rf"(?iU)\b(?:{trie(w.partition(' (')[0].removesuffix(chr(92) + '.?') for w in (*TITLES, *LEADS))})",
    "ji": " ji",
}
_HINT_OF = {"URL": "url", "EMAIL": "at", "UPI": "at", "IFSC": "zero", "NAME": "name", "JI": "ji"}
_STEPS = (*[(k, k, p, "") for k, p in PATTERNS], ("NAME", "NAME", NAME, ""), ("JI", "NAME", JI_NAME, " ji"))
_MARK = "\ue000"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redaction(c: Column, mode: str = "typed", spans: bool = False) -> Column:
    """A struct of the redacted text, n (counts in the order of TYPES) and, with ``spans``, what each step took out.

    Each kind that a text can hold is replaced in one pass, on what the kinds before it left, by its tag behind a mark;
    the marked tags are the counts, and the marks go at the end. A text that has the mark itself gets one that is longer
    than the text. Every value is named once in the expression, so Catalyst can move it anywhere without repeating work.
    """
    none = F.array().cast("array<string>")
    mark = lambda t: F.when(F.contains(t, F.lit(_MARK)), F.repeat(F.lit(_MARK), F.length(t) + 1)).otherwise(_MARK)
    hint = lambda t, h: F.contains(t, F.lit(_HINTS[h])) if h in ("at", "zero", "ji") else t.rlike(_HINTS[h])
    start = lambda t: F.struct(t.alias("t"), mark(t).alias("mark"), *[hint(t, h).alias(h) for h in _HINTS])

    def step(name: str, pattern: str, there: Column, to: Column):
        def run(y: Column) -> Column:
            new = F.when(there, F.regexp_replace(y["t"], F.lit(pattern), to)).otherwise(y["t"])
            values = F.regexp_extract_all(y["t"], F.lit(pattern), 2) if name == "JI" else _values(y["t"], pattern)
            return F.struct(new.alias("t"), (F.array_append(y["taken"], F.when(there, values).otherwise(none)) if spans else y["taken"]).alias("taken"))

        return run

    def chain(x: Column) -> Column:
        cur = F.struct(x["t"].alias("t"), F.array().cast("array<array<string>>").alias("taken"))
        for name, kind, pattern, after in _STEPS:
            cur = _let(cur, step(name, pattern, x[_HINT_OF.get(name, "digits")], F.concat(F.lit("$1"), x["mark"], F.lit(f"[{kind}]{after}"))))
        return _let(cur, lambda y: done(y, x["mark"]))

    def done(y: Column, mark: Column) -> Column:
        t, marked = y["t"], lambda k: F.concat(mark, F.lit(f"[{k}]"))
        count = lambda k: ((F.length(t) - F.length(F.replace(t, marked(k), mark))) / (len(k) + 2)).cast("int")
        some, clean = F.contains(t, F.concat(mark, F.lit("["))), t
        for k in TYPES if mode == "masked" else ():
            clean = F.replace(clean, marked(k), F.lit("[REDACTED]"))
        clean = F.when(some, F.replace(clean, F.concat(mark, F.lit("[")), F.lit("["))).otherwise(t)
        zero = F.array(*[F.lit(0) for _ in TYPES])
        return F.struct(clean.alias("t"), F.when(some, F.array(*[count(k) for k in TYPES])).otherwise(zero).alias("n"), y["taken"].alias("taken"))

    return _let(c, lambda t: _let(start(t), chain))


def redact(df: DataFrame, text: str = "text", mode: str = "typed", out: str = "redacted", spans: bool = False) -> DataFrame:
    """df with ``out``, n_pii and, for each kind, n_<kind>; with ``spans`` also the taken-out strings by kind, in order.

    Mode none leaves texts as they are. Null texts stay null with no counts.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    if mode == "none":
        df = df.withColumn(out, F.col(text)).withColumns({f"n_{k.lower()}": F.lit(0) for k in TYPES})
        df = df.withColumns({f"spans_{k.lower()}": F.array().cast("array<string>") for k in TYPES}) if spans else df
        return df.withColumn("n_pii", F.lit(0))
    r = F.col("__r")
    df = df.withColumn("__r", redaction(F.col(text), mode, spans))
    df = df.withColumns({out: r["t"]} | {f"n_{k.lower()}": F.coalesce(r["n"][i], F.lit(0)) for i, k in enumerate(TYPES)} | {"n_pii": F.coalesce(F.aggregate(r["n"], F.lit(0), lambda a, x: a + x), F.lit(0))})
    if spans:
        of = lambda k: [F.coalesce(r["taken"][i], F.array().cast("array<string>")) for i, (_, kind, *_) in enumerate(_STEPS) if kind == k]
        df = df.withColumns({f"spans_{k.lower()}": F.concat(*of(k)) for k in TYPES})
    return df.drop("__r")


def redacted(c: Column, mode: str = "typed") -> Column:
    """The redacted text alone, as one expression; it can stand in a lambda."""
    tag = lambda kind: _literal("[REDACTED]" if mode == "masked" else f"[{kind}]")
    for kind, pattern in PATTERNS if mode != "none" else ():
        c = F.regexp_replace(c, pattern, "$1" + tag(kind))
    return c if mode == "none" else F.regexp_replace(F.regexp_replace(c, NAME, "$1" + tag("NAME")), JI_NAME, tag("NAME") + " ji")


def _literal(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def _values(c: Column, pattern: str) -> Column:
    """What each match takes out: the match without its prefix."""
    whole, pre = F.regexp_extract_all(c, F.lit(pattern), 0), F.regexp_extract_all(c, F.lit(pattern), 1)
    return F.zip_with(whole, pre, lambda w, p: F.substring(w, F.length(F.coalesce(p, F.lit(""))) + 1, F.length(w)))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[\s-]", "")


def leaked(values: Column, text: Column) -> Column:
    """Of a list of known values those that a text still holds, without regard to case, spaces and hyphens."""
    return F.filter(values, lambda v: F.contains(_squeezed(text), _squeezed(v)))


#: The display's own, shorter list, in order: kind, pattern with the part that stays as group 1.
BASIC = (
    ("EMAIL", r"()\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("UPI", r"(?i)()\b[\w.-]{2,}@[a-z]{2,}\b"),
    ("PHONE", r"()\b(?:\+?91[\s-]?)?[6-9]\d{9}\b"),
    ("ACCOUNT", r"(?i)()\bending\s+(?:in\s+)?\d{4}\b"),
    ("ACCOUNT", r"()\b\d{9,18}\b"),
    ("NAME", r"()\b(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"),
    ("NAME", r"(\b(?:[Tt]his is|I am|I'm|my name is|Hi|Hello|Dear))\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"),
)


def sanitize_basic(df: DataFrame, text: str = "text", out: str = "sanitized") -> DataFrame:
    """df with ``out`` and n_sanitized by the display's own list of kinds."""
    df = df.withColumns({out: F.col(text), "n_sanitized": F.lit(0)})
    for i, (kind, pattern) in enumerate(BASIC):
        to = {3: "ending [ACCOUNT]", 6: "$1 [NAME]"}.get(i, f"[{kind}]")
        df = df.withColumns({"n_sanitized": F.col("n_sanitized") + F.coalesce(F.regexp_count(F.col(out), F.lit(pattern)), F.lit(0)), out: F.regexp_replace(F.col(out), pattern, to)})
    return df
