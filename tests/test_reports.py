"""Reports and the command line on small generated corpora."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise import cli
from turnwise.functions import dims
from turnwise.plans import datagen, evaluation, session
from turnwise.sources.stage import staged


def test_heldout_counts(spark):
    meta = spark.createDataFrame([("a", True, True, ["AUTHORITY", "TRANSFER"], 2), ("b", True, False, ["URGENCY"], 1), ("c", False, False, None, None)], "conv_id string, is_scam boolean, novel_family boolean, gold_steps array<string>, money_turn int")
    scored = spark.createDataFrame([("a", 0.8, "COMPLIANCE", ["AUTHORITY", "URGENCY"], 2), ("b", 0.3, None, [], None), ("c", 0.3, "MONEY_MOVEMENT", ["TRANSFER"], 0)], "conv_id string, score double, stage string, steps array<string>, warned_at int")
    rows, summary = evaluation.heldout(meta, scored)
    s = summary.first()
    assert (s.conversations, s.scams, s.benign, s.warned_by_money_turn, s.benign_reaching_compliance, s.novel_detected, s.novel) == (3, 2, 1, 1, 1, 1, 1)
    assert (s.step_p, s.step_r, s.detection_auroc) == (0.5, 0.333, 0.75)
    assert {r.conv_id: (r.step_tp, r.step_fp, r.step_fn) for r in rows.collect()} == {"a": (1, 1, 1), "b": (0, 0, 1), "c": (0, 1, 0)}


def test_leave_families_out(spark):
    f = lambda rows: spark.createDataFrame(rows, "conv_id string, steps array<string>, family string").withColumn("tactics", F.array_sort(dims.inferred_tactics(F.col("steps"))))
    a, b = ["AUTHORITY", "URGENCY", "TRANSFER"], ["LURE", "CHANNEL_SHIFT"]
    lib = f([("1", a, "x"), ("2", a, "x"), ("3", b, "y")])
    per, summary = evaluation.leave_families_out(lib, f([("t1", a, "x"), ("t2", b, "y")]))
    assert {r.family: r.mean_match for r in per.collect()} == {"x": 0.0, "y": 0.0}
    assert summary.first().asDict() == {"mean_match_unseen": 0.0, "mean_match_seen": 1.0, "novelty_auroc": 1.0}


def test_extraction_and_teacher(spark):
    gold = staged(datagen.gold(datagen.turns(datagen.conversations(spark, 1, 3, ["side_income", "bank_asks"], 0.0), 3)))
    r = evaluation.extraction(gold)
    t = r["totals"].first()
    assert t.turns == gold.count() and t.grounding_rate == 1.0 and 0 <= t.action_accuracy <= 1
    kept, counts = evaluation.teacher_labels(spark.createDataFrame([(0,), (2,)], "n_dropped int"))
    assert kept.count() == 1 and counts.first().asDict() == {"kept": 1, "n": 2}
    rows = datagen.sft_labels(datagen.sft_rows(gold)).collect()
    assert rows and all(len(x.labels) == 14 and len(x.prompt) == 2 and len(x.completion) == 1 for x in rows)


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["extract", "Tell me the OTP, mail a@b.co"]) == 0
    e = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert e["requested_action"] == "SHARE_OTP" and e["entities"] == [{"type": "EMAIL", "value": "[EMAIL]"}]
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
    scenario = tmp_path / "s.json"
    scenario.write_text(json.dumps({"id": "s", "description": "d", "turns": [{"speaker": "caller", "at": 500, "text": "I am calling from the bank. Your account will be blocked, call 9812345670 right now."}, {"speaker": "user", "at": 2500, "text": "Oh no."}, {"speaker": "caller", "at": 5000, "text": "Stay on the line and tell me the OTP, then transfer the money."}]}))
    assert cli.main(["demo", str(scenario)]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0]["type"] == "transcript" and [x["stage"] for x in lines if x["type"] == "stage"][-1] == "MONEY_MOVEMENT"
    assert not any("9812345670" in json.dumps(x) for x in lines)


def test_feed_as_a_stream_gives_the_events_and_the_state_of_the_batch(spark):
    from turnwise.sources.stage import new_folder
    from turnwise.streaming import feed

    lib = session.build_library(datagen.incidents(datagen.turns(datagen.conversations(spark, 6, 7, None, 0.0), 7)))
    turns = staged(datagen.turns(datagen.conversations(spark, 1, 101), 101), "turns").select("conv_id", "turn_idx", "speaker", "text", "at_ms")
    odd = spark.createDataFrame([("odd", 0, "caller", None, None), ("odd", 1, "user", "", None), ("odd", 2, None, "mail a.b@c.de", None)], turns.schema)
    turns = staged(turns.unionByName(odd), "turns")
    a = session.analyse(turns, lib)
    want = staged(session.events(a), "want")
    folder = new_folder(spark)
    got = feed.replay(turns, lib, folder=folder)
    assert set(got.columns) == set(want.columns)
    got = got.select(*[F.col(c).cast(t) for c, t in want.dtypes])
    assert {r["type"] for r in want.select("type").distinct().collect()} == {"transcript", "privacy", "signal", "stage", dims.PATTERN_EVENT, dims.PREDICTION_EVENT}
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0
    state = feed.state_snapshot(spark, folder, lib)
    last = session.snapshot(a).select(state.columns)
    assert last.exceptAll(state).count() == state.exceptAll(last).count() == 0
