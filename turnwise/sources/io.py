"""Readers and writers: scenarios, conversations, incidents, CSV sets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims

TURNS = "array<struct<speaker:string,at:bigint,text:string>>"
SCENARIO = f"id string, description string, turns {TURNS}"
HELDOUT = f"id string, family string, is_scam boolean, novel_family boolean, lang string, turns {TURNS}, gold_steps array<string>, money_turn int"
INCIDENT = "id string, label string, surface string, family string, steps array<string>, tactics array<string>"
NODE_EVENT = "type string, at bigint, id string, label string, parent string, predicted boolean, level string, message string, reasons array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines don't count."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8 without escapes, without null fields; replaces what is there."""
    df.write.mode("overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str = SCENARIO) -> DataFrame:
    """A file that is one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def turns_of(conversations: DataFrame, key: str = "id") -> DataFrame:
    """conv_id, turn_idx, speaker, text, at_ms from conversations with a turns array."""
    t = conversations.select(F.col(key).alias("conv_id"), F.posexplode("turns").alias("turn_idx", "t"))
    return t.select("conv_id", "turn_idx", F.col("t.speaker").alias("speaker"), F.col("t.text").alias("text"), F.col("t.at").cast("long").alias("at_ms"))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents; without tactics they are inferred from the steps."""
    df = spark.read.schema(INCIDENT).option("multiLine", True).json(path)
    return with_tactics(df)


def with_tactics(incidents: DataFrame) -> DataFrame:
    given = F.coalesce(F.size("tactics"), F.lit(0)) > 0
    return incidents.withColumns({"tactics": F.array_sort(F.when(given, F.col("tactics")).otherwise(dims.inferred_tactics(F.col("steps")))), "family": F.coalesce("family", F.lit(""))})


def export_incidents(incidents: DataFrame, path: str) -> None:
    write_jsonl(incidents.select("id", "label", "surface", "family", "steps", F.array_sort("tactics").alias("tactics")), path)


def write_bundle(path: str, **frames: DataFrame) -> None:
    """One folder of JSON lines per part of a library: incidents, patterns, display incidents."""
    for name, df in frames.items():
        write_jsonl(df, f"{path.rstrip('/')}/{name}")


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with header, quoted line breaks and doubled quotes; raises if a required column is missing."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def dialogue_turns(text: Column) -> Column:
    """(speaker, text) of a dialogue written with caller: and receiver: labels; blank parts go."""
    parts = F.regexp_extract_all(text, F.lit(r"(?is)(caller|receiver)\s*:(.*?)(?=(?:caller|receiver)\s*:|\z)"), 0)
    split = F.transform(parts, lambda p: F.struct(F.when(F.lower(F.substring(p, 1, 6)) == "caller", "caller").otherwise("user").alias("speaker"), F.btrim(F.regexp_replace(p, r"(?is)^(?:caller|receiver)\s*:", ""), F.lit(" \t\r\n")).alias("text")))
    return F.filter(split, lambda t: F.length(t["text"]) > 0)


def report(row: DataFrame, path: str | None = None) -> DataFrame:
    """A metrics frame as JSON lines, written where a path is given."""
    out = row.select(F.to_json(F.struct("*")).alias("report"))
    if path:
        out.write.mode("overwrite").text(path)
    return out


def event_lines(events: DataFrame) -> DataFrame:
    """Output events as JSON, null fields left out."""
    return events.select(F.to_json(F.struct("*")).alias("event"))


def speech_turns(segments: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Turns of a transcriber's segments (conv_id, speaker, start seconds, text): at = offset + 1000 start; blanks go. The transcriber itself is an adapter."""
    t = segments.withColumn("text", F.trim("text")).filter(F.length("text") > 0)
    return t.select("conv_id", "speaker", "text", (F.lit(offset_ms) + F.floor(F.col("start") * 1000)).cast("long").alias("at_ms"))


def json_schema(schema) -> dict:
    """A StructType as a strict JSON Schema: every field required, no others allowed."""
    kinds = {"string": "string", "boolean": "boolean", "integer": "integer", "long": "integer", "short": "integer", "double": "number", "float": "number"}

    def of(t) -> dict:
        if isinstance(t, str):
            return {"type": kinds.get(t, "string")}
        if t["type"] == "struct":
            return {"type": "object", "properties": {f["name"]: of(f["type"]) for f in t["fields"]}, "required": [f["name"] for f in t["fields"]], "additionalProperties": False}
        if t["type"] == "array":
            return {"type": "array", "items": of(t["elementType"])}
        return {"type": "object", "additionalProperties": of(t["valueType"])}

    return of(schema.jsonValue())
