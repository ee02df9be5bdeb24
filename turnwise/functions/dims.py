"""The closed vocabularies of conversational risk, as small tables.

Fixed values: names, orders, weights and labels below are part of the results and must stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("TRUST", "AUTHORITY", "URGENCY", "ISOLATION", "COMPLIANCE", "MONEY_MOVEMENT")

#: step: label, code
STEPS = {
    "AUTHORITY": ("Authority claim", "AUT"),
    "URGENCY": ("Urgency", "URG"),
    "CHANNEL_SHIFT": ("Channel shift", "CHN"),
    "ISOLATION": ("Isolation", "ISO"),
    "REMOTE_ACCESS": ("Remote access", "RMT"),
    "CREDENTIALS": ("Credential request", "CRD"),
    "TRANSFER": ("Money transfer", "TRF"),
    "LURE": ("Reward lure", "LUR"),
    "TRUST": ("Rapport building", "TRS"),
}
UI_STEPS = ("AUTHORITY", "URGENCY", "CHANNEL_SHIFT", "ISOLATION", "REMOTE_ACCESS", "CREDENTIALS", "TRANSFER")

#: signal: step, stage, weight, severity, label, default action
SIGNALS = {
    "AUTHORITY_CLAIM": ("AUTHORITY", "AUTHORITY", 0.15, "warn", "Authority impersonation", None),
    "TRUST_BUILDING": ("TRUST", "TRUST", 0.05, "info", "Rapport building", None),
    "REWARD_LURE": ("LURE", "TRUST", 0.15, "warn", "Reward / refund lure", None),
    "URGENCY": ("URGENCY", "URGENCY", 0.20, "warn", "Urgency created", None),
    "THREAT": ("URGENCY", "URGENCY", 0.25, "warn", "Threat of loss or legal action", None),
    "CHANNEL_SHIFT": ("CHANNEL_SHIFT", "ISOLATION", 0.20, "warn", "Channel migration", "SWITCH_CHANNEL"),
    "ISOLATION": ("ISOLATION", "ISOLATION", 0.30, "critical", "Isolation from others", "STAY_ON_LINE"),
    "SECRECY": ("ISOLATION", "ISOLATION", 0.35, "critical", "Secrecy demanded", "KEEP_SECRET"),
    "VERIFICATION_DISCOURAGEMENT": ("ISOLATION", "ISOLATION", 0.35, "critical", "Discouraged independent verification", None),
    "REMOTE_ACCESS": ("REMOTE_ACCESS", "COMPLIANCE", 0.45, "critical", "Remote-access request", "INSTALL_APP"),
    "CREDENTIAL_REQUEST": ("CREDENTIALS", "COMPLIANCE", 0.45, "critical", "Credential request", "SHARE_CREDENTIALS"),
    "PERSONAL_INFO_REQUEST": ("CREDENTIALS", "COMPLIANCE", 0.25, "warn", "Personal identity data request", "SHARE_PERSONAL_INFO"),
    "PAYMENT_REQUEST": ("TRANSFER", "MONEY_MOVEMENT", 0.50, "critical", "Payment instruction", "TRANSFER_MONEY"),
    "SAFETY_ADVICE": (None, None, -0.30, "info", "Genuine safety advice", None),
}
PRESSURE = ("AUTHORITY_CLAIM", "REWARD_LURE", "URGENCY", "THREAT", "CHANNEL_SHIFT", "ISOLATION", "SECRECY", "VERIFICATION_DISCOURAGEMENT")
ASKS = ("REMOTE_ACCESS", "CREDENTIAL_REQUEST", "PERSONAL_INFO_REQUEST", "PAYMENT_REQUEST")
STRONG = ("REMOTE_ACCESS", "CREDENTIAL_REQUEST", "SECRECY", "SAFETY_ADVICE")

#: action: consequence, in descending priority
ACTIONS = {
    "TRANSFER_MONEY": "DIRECT_TRANSFER",
    "SCAN_QR": "DIRECT_TRANSFER",
    "SHARE_OTP": "ACCOUNT_TAKEOVER",
    "SHARE_CREDENTIALS": "ACCOUNT_TAKEOVER",
    "INSTALL_APP": "DEVICE_TAKEOVER",
    "CLICK_LINK": "ACCOUNT_TAKEOVER",
    "SHARE_PERSONAL_INFO": "IDENTITY_THEFT",
    "KEEP_SECRET": "LOSS_OF_SUPPORT",
    "SWITCH_CHANNEL": "LOSS_OF_SUPPORT",
    "CALL_NUMBER": "LOSS_OF_SUPPORT",
    "STAY_ON_LINE": "LOSS_OF_SUPPORT",
    "NONE": "NONE",
}
INTENTS = ("GREETING", "INFORM", "REASSURE", "OFFER", "THREATEN", "REQUEST_ACTION", "REQUEST_INFO", "VICTIM_RESPONSE")

#: The kinds of output events, as a display expects them.
EVENT_TYPES = ("transcript", "privacy", "signal", "stage", "scam_dna", "shadowpath", "graph_node", "risk", "reality_pause")
PATTERN_EVENT, PREDICTION_EVENT, PAUSE_EVENT = EVENT_TYPES[4], EVENT_TYPES[5], EVENT_TYPES[8]

#: thresholds of the state machine, the matcher and the predictor
THRESHOLD, SATURATION, UNPRESSURED, MIN_WEIGHT = 0.10, 0.5, 0.15, 0.05
PROGRESS_STEP, DNA_STEP, PREDICTION_STEP = 0.08, 5, 10
NOVEL_BELOW, CLUSTER_AT, MAX_ORDER, MIN_SUPPORT, FULL_SUPPORT, MIN_CONFIDENCE = 0.55, 0.65, 3, 3, 8, 35
TURN_GAP_MS = 3000


def signal_dim(spark: SparkSession) -> DataFrame:
    """One row per signal: ord, signal, step, stage, stage_idx, weight, severity, label, default_action, is_pressure, is_ask."""
    rows = [(i, s, step, stage, STAGES.index(stage) if stage else None, w, sev, label, act, s in PRESSURE, s in ASKS) for i, (s, (step, stage, w, sev, label, act)) in enumerate(SIGNALS.items())]
    return spark.createDataFrame(rows, "ord int, signal string, step string, stage string, stage_idx int, weight double, severity string, label string, default_action string, is_pressure boolean, is_ask boolean")


def lookup(table: dict, key: Column) -> Column:
    """table[key] as a map literal; null for keys it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def step_of(signal: Column) -> Column:
    return lookup({s: v[0] for s, v in SIGNALS.items() if v[0]}, signal)


def stage_index_of(signal: Column) -> Column:
    return lookup({s: STAGES.index(v[1]) for s, v in SIGNALS.items() if v[1]}, signal)


def weight_of(signal: Column) -> Column:
    return lookup({s: v[2] for s, v in SIGNALS.items()}, signal)


def severity_of(signal: Column) -> Column:
    return lookup({s: v[3] for s, v in SIGNALS.items()}, signal)


def label_of(signal: Column) -> Column:
    return lookup({s: v[4] for s, v in SIGNALS.items()}, signal)


def default_action_of(signal: Column) -> Column:
    return lookup({s: v[5] for s, v in SIGNALS.items() if v[5]}, signal)


def step_label(step: Column) -> Column:
    return lookup({s: v[0] for s, v in STEPS.items()}, step)


def consequence_of(action: Column) -> Column:
    return lookup(ACTIONS, action)


def stage_name(index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in STAGES]), index + 1)


def stage_position(stage: Column) -> Column:
    """Place of a stage in the display's bar, from 0; -1 before any stage."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.coalesce(stage, F.lit(""))).cast("int") - 1


def valid_steps(steps: Column) -> Column:
    """The steps themselves; a name that no step has is an error."""
    known = F.forall(steps, lambda s: F.coalesce(s.isin(*STEPS), F.lit(False)))
    return F.when(known | steps.isNull(), steps).otherwise(F.raise_error(F.concat(F.lit("unknown step in "), F.to_json(steps))).cast("array<string>"))


def step_code(steps: Column) -> Column:
    """Codes of a step list joined by ``>``."""
    codes = {s: v[1] for s, v in STEPS.items()}
    return F.array_join(F.transform(steps, lambda s: lookup(codes, s)), ">")


def inferred_tactics(steps: Column) -> Column:
    """All signals whose step is in the list, in the order of the signal table; safety advice never."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(v[0]).alias("step")) for s, v in SIGNALS.items() if v[0]])
    return F.transform(F.filter(pairs, lambda p: F.array_contains(steps, p["step"])), lambda p: p["signal"])
