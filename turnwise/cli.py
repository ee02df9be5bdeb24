"""Command line: demo, extract, gen-data, export-library, evaluate. ``python -m turnwise.cli demo scenario.json``"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="turnwise")
    sub = ap.add_subparsers(dest="command", required=True)
    p = sub.add_parser("demo", help="events of a scenario file, one JSON line each")
    p.add_argument("scenario")
    p.add_argument("--mode", default="typed", choices=("none", "typed", "masked"))
    p = sub.add_parser("extract", help="the semantic event of one utterance")
    p.add_argument("text")
    p.add_argument("--speaker", default="caller", choices=("caller", "user"))
    p = sub.add_parser("gen-data", help="generated conversations as fine-tuning rows: train, val and test")
    p.add_argument("out")
    p.add_argument("--per-family", type=int, default=40)
    p.add_argument("--seed", type=int, default=13)
    p = sub.add_parser("export-library", help="incidents, patterns and display incidents")
    p.add_argument("out")
    p = sub.add_parser("evaluate", help="all reports on generated conversations")
    p.add_argument("out")
    p.add_argument("--per-family", type=int, default=20)
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions import privacy
    from .operators import evaluate, extract, patterns
    from .plans import datagen, evaluation, session
    from .sources import io
    from .sources.stage import staged

    spark = SparkSession.builder.appName("turnwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    labels = {f: v.label for f, v in datagen.FAMILIES.items()}

    def library():
        return session.build_library(datagen.incidents(datagen.turns(datagen.conversations(spark, 25, 7, None, 0.0), 7)), labels)

    if a.command == "demo":
        found = session.analyse(io.turns_of(io.read_document(spark, a.scenario)), library(), a.mode)
        for r in io.event_lines(session.events(found).orderBy("at", "seq").drop("turn_idx")).toLocalIterator():
            print(r["event"])
    elif a.command == "extract":
        t = privacy.redact(spark.createDataFrame([("c", 0, a.speaker, a.text)], "conv_id string, turn_idx int, speaker string, text string"))
        t = t.select("conv_id", "turn_idx", "speaker", F.col("redacted").alias("text"))
        print(extract.rules(t).select(F.to_json("event").alias("e")).first()["e"])
    elif a.command == "gen-data":
        gold = staged(datagen.gold(datagen.turns(datagen.conversations(spark, a.per_family, a.seed), a.seed)), "gold")
        parts = evaluate.partition_corpus(gold.groupBy("conv_id").agg(F.first("family").alias("family")), ("meter_notice", "prize_draw", "bill_reminder"), "conv_id").select("conv_id", "part")
        for part in ("train", "val", "test"):
            io.write_jsonl(datagen.sft_rows(gold.join(parts.filter(F.col("part") == part).select("conv_id"), "conv_id", "left_semi")), f"{a.out}/{part}")
    elif a.command == "export-library":
        lib = library()
        matched = patterns.best_match(lib.incidents, lib.patterns, ["conv_id"], partial=False)
        shown = matched.select(F.col("conv_id").alias("id"), F.col("family").alias("label"), F.col("family").alias("surface"), F.col("pattern_id").alias("pattern_ord"), "pattern_name", F.col("conv_id").alias("ord"), "steps")
        io.write_bundle(a.out, incidents=lib.incidents, patterns=lib.patterns, frontend_incidents=patterns.ui_incidents(shown))
    else:
        for name, df in evaluation.full_report(spark, a.per_family).items():
            io.write_jsonl(df, f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
