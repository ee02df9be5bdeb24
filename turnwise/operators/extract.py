"""Semantic events from redacted turns: rule extractor, grounding of a model's claims, merging, extractor registry."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cues, dims
from ..functions import lexicon as lex

HITS = "array<struct<signal:string,evidence:string,confidence:double>>"
ENTITIES = "array<struct<type:string,value:string>>"
EVENT = f"struct<actor_claim:string,communication_intent:string,manipulation_signals:{HITS},requested_action:string,financial_consequence:string,stage:string,entities:{ENTITIES},confidence:double,source:string>"


def clause_prefix(text: Column, at: Column) -> Column:
    """What stands before position ``at`` (1-based) in its clause, looking back 40 characters."""
    before = F.substring(text, F.lit(1), at - 1)
    tail = F.right(before, F.lit(40))
    return F.element_at(F.split(tail, lex.CLAUSE_BREAK), -1)


def negated(prefix: Column) -> Column:
    """Whether one of the last words of the clause before a cue is a negator."""
    words = F.regexp_extract_all(F.lower(prefix), F.lit(lex.WORD), 0)
    return F.arrays_overlap(F.slice(F.reverse(words), 1, lex.NEGATED_WITHIN), F.array(*[F.lit(w) for w in lex.NEGATORS]))


def quote(text: Column, pattern: str) -> Column:
    """The first match, completed to the closing bracket if it cuts a [TAG], without signs and spaces before it; null if none."""
    p = F.lit(lex.FLAGS + pattern)
    found, start = F.regexp_substr(text, p), F.regexp_instr(text, p)
    opened = F.length(F.regexp_replace(found, r"[^\[]", "")) > F.length(F.regexp_replace(found, r"[^\]]", ""))
    rest = F.substring(text, start + F.length(found), F.length(text))
    more = F.instr(rest, "]")
    whole = F.when(opened & (more > 0), F.concat(found, F.substring(rest, F.lit(1), more))).otherwise(found)
    return F.trim(F.regexp_replace(whole, rf"^(?:{lex.CLAUSE_BREAK}|:)+ ?", ""))


def signal_quote(text: Column, signal: str) -> Column:
    """Evidence of one signal: the first pattern that matches and, where the signal can be negated, isn't; its first match only."""
    options = []
    for pattern in lex.SIGNAL_PATTERNS[signal]:
        p = lex.FLAGS + pattern
        hit = text.rlike(p)
        if signal in lex.NEGATABLE:
            hit = hit & ~negated(clause_prefix(text, F.regexp_instr(text, F.lit(p))))
        options.append(F.when(hit, quote(text, pattern)))
    return F.coalesce(*options)


#: All patterns of the lexicon by what they tell, for the one scan that says which of them are worth trying.
SCAN = cues.Scan({f"signal/{s}": p for s, p in lex.SIGNAL_PATTERNS.items()} | {f"{kind}/{k}": (p,) for kind, table in (("actor", lex.ACTOR_PATTERNS), ("action", lex.ACTION_PATTERNS), ("entity", lex.ENTITY_PATTERNS)) for k, p in table})


def _by_name(name: Column, options: dict[str, Column]) -> Column:
    """The option of that name. In a lambda only that one is evaluated, and Spark generates no code for any of them."""
    return reduce(lambda c, o: F.when(name == o[0], o[1]).otherwise(c), reversed(options.items()), F.lit(None))


def rule_hits(text: Column, found: Column) -> Column:
    """(signal, evidence, confidence) by signal name, of the signals that the scan found worth trying; safety advice takes secrecy out."""
    quotes = {f"signal/{s}": signal_quote(text, s) for s in sorted(lex.SIGNAL_PATTERNS)}
    strong = F.array(*[F.lit(s) for s in dims.STRONG])
    signal = lambda n: F.substring(n, len("signal/") + 1, 100)
    tried = F.transform(F.filter(found, lambda n: F.startswith(n, F.lit("signal/"))), lambda n: F.struct(signal(n).alias("signal"), _by_name(n, quotes).alias("evidence"), F.when(F.array_contains(strong, signal(n)), 0.9).otherwise(0.75).alias("confidence")))
    hits = F.filter(tried, lambda h: h["evidence"].isNotNull())
    return F.get(F.transform(F.array(hits), lambda hs: F.filter(hs, lambda h: (h["signal"] != "SECRECY") | ~F.exists(hs, lambda o: o["signal"] == "SAFETY_ADVICE"))), F.lit(0))


def actor_claim(text: Column, found: Column) -> Column:
    """Who the text says is calling: the first of the table that it names."""
    named = F.filter(F.array(*[F.lit(a) for a, _ in lex.ACTOR_PATTERNS]), lambda a: F.array_contains(found, F.concat(F.lit("actor/"), a)) & _by_name(a, {k: text.rlike(lex.FLAGS + p) for k, p in lex.ACTOR_PATTERNS}))
    return F.coalesce(F.get(named, F.lit(0)), F.lit("UNKNOWN"))


def first_by_priority(actions: Column) -> Column:
    """The first of the action table that an array holds; NONE if none."""
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(a) for a in dims.ACTIONS]), lambda a: F.array_contains(actions, a)), F.lit(0)), F.lit("NONE"))


def default_actions(signals: Column) -> Column:
    return F.array_compact(F.transform(signals, dims.default_action_of))


def requested_action(text: Column, signals: Column, found: Column) -> Column:
    """Default actions of the signals, refined by what the text names; nothing without a signal that asks for something."""
    base = default_actions(signals)
    says = {a: F.array_contains(found, f"action/{a}") & text.rlike(lex.FLAGS + p) for a, p in lex.ACTION_PATTERNS}
    creds, pays = F.array_contains(base, "SHARE_CREDENTIALS"), F.array_contains(base, "TRANSFER_MONEY")
    refined = F.filter(base, lambda a: ~((a == "SHARE_CREDENTIALS") & says["SHARE_OTP"]))
    for action, when in (("SHARE_OTP", says["SHARE_OTP"] & creds), ("SCAN_QR", says["SCAN_QR"] & pays), ("CLICK_LINK", says["CLICK_LINK"]), ("CALL_NUMBER", says["CALL_NUMBER"])):
        refined = F.when(when, F.array_append(refined, F.lit(action))).otherwise(refined)
    return F.when(F.size(base) > 0, first_by_priority(refined)).otherwise(F.lit("NONE"))


def intent(speaker: Column, signals: Column, action: Column, turn_idx: Column) -> Column:
    has = lambda s: F.array_contains(signals, s)
    return (
        F.when(speaker == "user", "VICTIM_RESPONSE")
        .when(action.isin("SHARE_OTP", "SHARE_CREDENTIALS", "SHARE_PERSONAL_INFO"), "REQUEST_INFO")
        .when(action != "NONE", "REQUEST_ACTION")
        .when(has("THREAT"), "THREATEN")
        .when(has("REWARD_LURE"), "OFFER")
        .when(has("TRUST_BUILDING") | has("SAFETY_ADVICE"), "REASSURE")
        .when(turn_idx == 0, "GREETING")
        .otherwise("INFORM")
    )


def stage_of(signals: Column) -> Column:
    return dims.stage_name(F.array_max(F.transform(signals, dims.stage_index_of)))


def entities(text: Column, found: Column | None = None) -> Column:
    """Distinct (type, value) by type and lower-cased value, in the order of the patterns; the first casing stays."""
    found = SCAN.groups(text) if found is None else found
    kinds = F.filter(F.array(*[F.lit(t) for t, _ in lex.ENTITY_PATTERNS]), lambda t: F.array_contains(found, F.concat(F.lit("entity/"), t)))
    values = {t: F.regexp_extract_all(text, F.lit(lex.FLAGS + p), 0) for t, p in lex.ENTITY_PATTERNS}
    every = F.flatten(F.transform(kinds, lambda t: F.transform(_by_name(t, values), lambda v: F.struct(t.alias("type"), v.alias("value")))))

    def add(acc: Column, e: Column) -> Column:
        known = F.exists(acc, lambda x: (x["type"] == e["type"]) & (F.lower(x["value"]) == F.lower(e["value"])))
        return F.when(known, acc).otherwise(F.array_append(acc, e))

    return F.aggregate(every, F.array().cast(ENTITIES), add)


def rules(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn_idx, speaker, text: redacted) with ``event``. One projection after another; no shuffle.

    One scan a text finds which patterns can match at all; only those are tried, inside lambdas, for which Spark makes no code.
    """
    text, speaker, found = F.coalesce(F.col("text"), F.lit("")), F.col("speaker"), F.col("__found")
    t = turns.withColumn("__found", SCAN.groups(text))
    no_hits = F.array().cast(HITS)
    t = t.withColumns({"__hits": F.when(speaker == "caller", rule_hits(text, found)).otherwise(no_hits), "__entities": entities(text, found), "__actor": F.when(speaker == "caller", actor_claim(text, found)).otherwise("UNKNOWN")})
    t = t.withColumn("__signals", F.transform("__hits", lambda h: h["signal"]))
    t = t.withColumn("__action", requested_action(text, F.col("__signals"), found))
    event = F.struct(
        F.col("__actor").alias("actor_claim"),
        intent(speaker, F.col("__signals"), F.col("__action"), F.col("turn_idx")).alias("communication_intent"),
        F.col("__hits").alias("manipulation_signals"),
        F.col("__action").alias("requested_action"),
        dims.consequence_of(F.col("__action")).alias("financial_consequence"),
        stage_of(F.col("__signals")).alias("stage"),
        F.col("__entities").alias("entities"),
        F.coalesce(F.array_max(F.transform("__hits", lambda h: h["confidence"])), F.lit(0.0)).alias("confidence"),
        F.lit("rules").alias("source"),
    )
    return t.withColumn("event", event).drop("__found", "__hits", "__entities", "__actor", "__signals", "__action")


def hits_of(turns: DataFrame, event: str = "event") -> DataFrame:
    """One row per hit: conv_id, turn_idx, at where there is one, signal, evidence, confidence."""
    keep = [c for c in ("conv_id", "turn_idx", "at") if c in turns.columns]
    return turns.select(*keep, F.inline(f"{event}.manipulation_signals"))


# ---- grounding ------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalise(c: Column, compatible: bool = False) -> Column:
    """Lower case, straight quotes, single spaces, no symbols at the ends. ``compatible``: after NFKC, which needs Python; ASCII texts don't."""
    c = nfkc(c) if compatible else c
    c = F.translate(F.lower(c), "’“”", "'\"\"")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"(?U)^[\W_]+|[\W_]+$", ""))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalise(c), F.lit(r"(?U)\w+|\[\w+\]"), 0)


def evidence_score(evidence: Column, text: Column) -> Column:
    """1 for an exact, normalised substring; else the best share of the quote's distinct tokens in a window of its length plus two."""
    e, t = tokens(evidence), tokens(text)
    n, m = F.size(e), F.size(t)
    distinct = F.array_distinct(e)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), m - n))
    best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(distinct, F.slice(t, i + 1, n + 2))) / F.size(distinct)))
    ne = normalise(evidence)
    return F.when(F.length(ne) == 0, F.lit(0.0)).when(F.contains(normalise(text), ne), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(best)


def plausible(signal: Column, evidence: Column) -> Column:
    return F.coalesce(*[F.when(signal == s, evidence.rlike(lex.FLAGS + p)) for s, p in lex.CUES.items()], F.lit(False))


def ground(turns: DataFrame, event: str = "event", text: str = "text", min_overlap: float = 0.8) -> DataFrame:
    """turns with ``event`` reduced to what the text bears out, and n_kept, n_dropped, n_dropped_entities, downgraded.

    Quotes without a cue for their signal go; inexact ones of ``min_overlap`` or more are discounted; the strongest hit
    of a signal stays. Entities must be in the text. An unsupported action falls back to the first, by priority, that the
    signals stand for. Stage and consequence are recomputed. Confidences are clamped to 0..1.
    """
    e, t = F.col(event), F.col(text)
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    judged = F.transform(e["manipulation_signals"], lambda h: F.struct(h["signal"].alias("signal"), h["evidence"].alias("evidence"), clamp(h["confidence"]).alias("confidence"), evidence_score(h["evidence"], t).alias("score"), plausible(h["signal"], h["evidence"]).alias("ok")))
    d = turns.withColumn("__j", judged)
    kept = F.transform(F.filter("__j", lambda h: h["ok"] & (h["score"] >= min_overlap)), lambda h: F.struct(h["signal"].alias("signal"), h["evidence"].alias("evidence"), F.when(h["score"] >= 1.0, h["confidence"]).otherwise(F.bround(h["confidence"] * h["score"] * 0.9, 3)).alias("confidence")))
    d = d.withColumn("__k", kept)
    best = F.filter("__k", lambda h, i: ~F.exists(F.transform("__k", lambda o, j: (o["signal"] == h["signal"]) & ((o["confidence"] > h["confidence"]) | ((o["confidence"] == h["confidence"]) & (j < i)))), lambda x: x))
    d = d.withColumn("__b", F.array_sort(best)).withColumn("__s", F.transform("__b", lambda h: h["signal"]))
    ents = F.filter(e["entities"], lambda x: (F.length(normalise(x["value"])) > 0) & F.contains(normalise(t), normalise(x["value"])))
    act, base = e["requested_action"], default_actions(F.col("__s"))
    supported = (act == "NONE") | F.array_contains(base, act)
    for a, sigs in lex.ACTION_SUPPORT.items():
        supported = supported | ((act == a) & F.arrays_overlap(F.col("__s"), F.array(*[F.lit(x) for x in sigs])))
    d = d.withColumns({"__e": ents, "__a": F.when(supported, act).otherwise(first_by_priority(base)), "downgraded": ~supported})
    own = clamp(e["confidence"])
    conf = F.coalesce(F.array_max(F.transform("__b", lambda h: h["confidence"])), F.least(own, F.lit(0.3)))
    new = F.struct(e["actor_claim"].alias("actor_claim"), e["communication_intent"].alias("communication_intent"), F.col("__b").alias("manipulation_signals"), F.col("__a").alias("requested_action"), dims.consequence_of(F.col("__a")).alias("financial_consequence"), stage_of(F.col("__s")).alias("stage"), F.col("__e").alias("entities"), F.bround(F.least(conf, F.when(own > 0, own).otherwise(conf)), 3).alias("confidence"), e["source"].alias("source"))
    counts = {"n_kept": F.size("__b"), "n_dropped": F.size("__j") - F.size("__k"), "n_dropped_entities": F.size(e["entities"]) - F.size("__e")}
    return d.withColumns(counts).withColumn(event, new).drop("__j", "__k", "__b", "__s", "__e", "__a")


def merge(a: Column, b: Column) -> Column:
    """Two events as one: the stronger hit of each signal (a's on ties), the more urgent action, both sides' entities (b's value on equal keys), b's actor where known, b's intent. Null b: a."""
    better = lambda h, others, strict: ~F.exists(others, lambda o: (o["signal"] == h["signal"]) & ((o["confidence"] > h["confidence"]) if strict else (o["confidence"] >= h["confidence"])))
    ah, bh = a["manipulation_signals"], b["manipulation_signals"]
    hits = F.array_sort(F.concat(F.filter(ah, lambda h: better(h, bh, True)), F.filter(bh, lambda h: better(h, ah, False))))
    same = lambda x, y: (x["type"] == y["type"]) & (F.lower(x["value"]) == F.lower(y["value"]))
    ents = F.concat(F.transform(a["entities"], lambda x: F.coalesce(F.get(F.filter(b["entities"], lambda y: same(x, y)), F.lit(0)), x)), F.filter(b["entities"], lambda y: ~F.exists(a["entities"], lambda x: same(x, y))))
    action = first_by_priority(F.array(a["requested_action"], b["requested_action"]))
    both = F.struct(F.when(b["actor_claim"] != "UNKNOWN", b["actor_claim"]).otherwise(a["actor_claim"]).alias("actor_claim"), b["communication_intent"].alias("communication_intent"), hits.alias("manipulation_signals"), action.alias("requested_action"), dims.consequence_of(action).alias("financial_consequence"), stage_of(F.transform(hits, lambda h: h["signal"])).alias("stage"), ents.alias("entities"), F.greatest(a["confidence"], b["confidence"]).alias("confidence"), F.lit("ensemble").alias("source"))
    return F.when(b.isNull(), a.cast(EVENT)).otherwise(both.cast(EVENT))


def ensemble(turns: DataFrame, answers: DataFrame, budget_ms: int = 1500) -> DataFrame:
    """turns with the merged event of rules and a model's recorded answers (conv_id, turn_idx, model_event, latency_ms).

    Answers count for callers' turns within the budget and are grounded first; without one the rules stand.
    """
    ruled = rules(turns)
    in_time = answers.filter(F.col("latency_ms") <= budget_ms).select("conv_id", "turn_idx", "model_event")
    j = ruled.join(in_time, ["conv_id", "turn_idx"], "left").withColumn("model_event", F.when(F.col("speaker") == "caller", F.col("model_event")))
    j = j.withColumns({"model_event": F.col("model_event").cast(EVENT), "__answered": F.col("model_event").isNotNull()})
    g = ground(j, "model_event").withColumn("model_event", F.when(F.col("__answered"), F.col("model_event")))
    return g.withColumn("event", merge(F.col("event"), F.col("model_event"))).drop("model_event", "__answered", "n_kept", "n_dropped", "n_dropped_entities", "downgraded")


def strip_fences(c: Column) -> Column:
    """A model's JSON without the ``` lines around it."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def parse_answer(c: Column) -> Column:
    """A model's JSON answer as an event; null where it can't be read or lacks its action."""
    e = F.from_json(strip_fences(c), EVENT)
    return F.when(e["requested_action"].isNotNull() & e["manipulation_signals"].isNotNull(), e)


Extractor = Callable[[DataFrame], DataFrame]
_EXTRACTORS: dict[str, Extractor] = {"rules": rules}


def register_extractor(name: str, make: Extractor) -> None:
    """Adds a stage turns -> turns with ``event``."""
    _EXTRACTORS[name] = make


def build_extractor(name: str = "rules") -> Extractor:
    """The stage of a name: rules, semantic, hybrid, or one that was registered, such as ``model.model_extractor`` or ``model.ensemble_extractor`` of a client."""
    from . import semantic  # noqa: F401  (registers its stages)

    if name not in _EXTRACTORS:
        raise ValueError(f"no extractor {name!r}; there are {', '.join(sorted(_EXTRACTORS))}")
    return _EXTRACTORS[name]
