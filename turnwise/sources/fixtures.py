"""Small demonstration data: a scripted timeline of output events, and incidents with one that is still under way. All made up here."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions import dims

#: (at ms, kind, payload) of a scripted call, in the order in which a player shows it.
TIMELINE = (
    (500, "transcript", {"speaker": "caller", "text": "Good day, I am calling from the Harbour Bank head office."}),
    (510, "privacy", {"detected": 0, "removed": 0, "transmitted": 0}),
    (600, "signal", {"label": "Authority claim", "evidence": "calling from the Harbour Bank head office"}),
    (650, "stage", {"stage": "TRUST", "progress": 0.2}),
    (700, "graph_node", {"id": "authority", "parent": None}),
    (2800, "transcript", {"speaker": "user", "text": "What has happened?"}),
    (5600, "transcript", {"speaker": "caller", "text": "Your account [ACCOUNT] will be blocked, act right now."}),
    (5610, "privacy", {"detected": 1, "removed": 1, "transmitted": 0}),
    (5700, "signal", {"label": "Threat", "evidence": "account [ACCOUNT] will be blocked"}),
    (5750, "signal", {"label": "Urgency", "evidence": "right now"}),
    (5800, "stage", {"stage": "FEAR", "progress": 0.5}),
    (5850, dims.PATTERN_EVENT, {"pattern": "Account that needs saving", "matchPct": 58}),
    (5860, "graph_node", {"id": "urgency", "parent": "authority"}),
    (8200, "transcript", {"speaker": "user", "text": "Fine, go ahead."}),
    (11000, "transcript", {"speaker": "caller", "text": "Stay on the line and install this app."}),
    (11100, "signal", {"label": "Isolation", "evidence": "Stay on the line"}),
    (11150, "signal", {"label": "Remote access", "evidence": "install this app"}),
    (11200, "stage", {"stage": "COMPLIANCE", "progress": 0.75}),
    (11250, dims.PATTERN_EVENT, {"pattern": "Account that needs saving", "matchPct": 81}),
    (11300, dims.PREDICTION_EVENT, {"next": "Credentials", "confidence": 72}),
    (11350, "risk", {"level": "high"}),
    (11400, dims.PAUSE_EVENT, {"reason": "The caller asks for control of your screen."}),
)
#: (id, label, surface, steps); the last one is still under way.
INCIDENTS = (
    ("demo-1", "Account that needs saving", "Harbour Bank · Phone", ("AUTHORITY", "URGENCY", "ISOLATION", "REMOTE_ACCESS", "CREDENTIALS", "TRANSFER")),
    ("demo-2", "Parcel held back", "Swift Courier · Phone", ("AUTHORITY", "URGENCY", "CHANNEL_SHIFT", "ISOLATION", "TRANSFER")),
    ("demo-3", "Code for money back", "QuickWallet · Chat", ("AUTHORITY", "LURE", "REMOTE_ACCESS", "TRANSFER")),
    ("demo-live", "Under way", "Meridian Bank · Phone", ("AUTHORITY", "URGENCY", "ISOLATION")),
)


def timeline(spark: SparkSession) -> DataFrame:
    """The scripted events: conv_id, at, seq, type, payload (JSON)."""
    return spark.createDataFrame([("demo", at, i, kind, json.dumps(p)) for i, (at, kind, p) in enumerate(TIMELINE)], "conv_id string, at long, seq int, type string, payload string")


def incidents(spark: SparkSession) -> DataFrame:
    """id, label, surface, steps, live of the demonstration incidents."""
    return spark.createDataFrame([(*r[:3], list(r[3]), r[0] == "demo-live") for r in INCIDENTS], "id string, label string, surface string, steps array<string>, live boolean")
