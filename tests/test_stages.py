"""Extractor stages: semantic and hybrid against brute force, a model with a budget."""

import http.server
import itertools
import json
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import encode, extract, model, semantic
from turnwise.plans import datagen, queries, text_queries  # noqa: F401

TURN = "conv_id string, turn_idx int, speaker string, text string"


def test_vectors_are_unit_and_alike_for_like_texts():
    v = encode.vectors(["Pay the fee now", "pay  the FEE now ", "Pay the fees now", "The weather is fine", None, "", " ", "é"])
    assert np.allclose(np.linalg.norm(v[:4], axis=1), 1) and not v[4].any() and not v[5].any() and not v[6].any() and v[7].any()
    assert np.array_equal(v[0], v[1]) and v[0] @ v[2] > 0.7 > 0.3 > abs(v[0] @ v[3])
    assert np.array_equal(encode.vectors(["a b", "x"])[1], encode.vectors(["x"])[0])


BANK = [("tell me the code", "CREDENTIAL_REQUEST"), ("read out the code", "CREDENTIAL_REQUEST"), ("never tell the code", "SAFETY_ADVICE"), ("do not hang up", "ISOLATION"), ("stay on the line", "ISOLATION"), ("the weather is fine", "NONE"), ("we have dinner today", "NONE")]


def brute_semantic(text, speaker, k, min_sim, margin, spark_clauses):
    best = {}
    if speaker != "caller" or text is None:
        return {}
    bank = encode.vectors([t for t, _ in BANK])
    for c in spark_clauses:
        v = encode.vectors([c])[0]
        score = {s: np.mean(sorted((float(v @ b) for b, (_, x) in zip(bank, BANK) if x == s), reverse=True)[:k]) for s in {x for _, x in BANK}}
        for s, x in score.items():
            if s != "NONE" and x >= min_sim and x - score["NONE"] >= margin:
                conf = min(0.85, round(0.5 + 5 * (x - score["NONE"]), 3))
                if s not in best or conf > best[s][0]:
                    best[s] = (conf, c)
    if "SAFETY_ADVICE" in best:
        best = {s: x for s, x in best.items() if s not in ("CREDENTIAL_REQUEST", "SECRECY")}
    return best


@pytest.mark.parametrize("k, min_sim, margin", [(1, 0.4, 0.02), (3, 0.3, 0.05)])
def test_semantic_stage_against_brute_force(spark, k, min_sim, margin):
    rng = random.Random(3)
    bits = ["tell me the code", "please read out that code", "do not hang up now", "the weather is so fine", "Never tell them the code", "we two have dinner", "stay here on the line"]
    rows = [(f"c{i % 5}", i, rng.choice(("caller", "caller", "user")), ". ".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [("z", 0, "caller", None), ("z", 1, "caller", ""), ("z", 2, "caller", "no")]
    df = spark.createDataFrame(rows, TURN)
    bank = spark.createDataFrame(BANK, "text string, label string")
    cut = {r.turn_idx if r.conv_id != "z" else -1 - r.turn_idx: r.c for r in df.withColumn("c", semantic.clauses(F.coalesce("text", F.lit("")))).collect()}
    got = semantic.semantic_extractor(bank, k=k, min_sim=min_sim, margin=margin)(df).collect()
    assert len(got) == len(rows)
    some = 0
    for r in got:
        want = brute_semantic(r.text, r.speaker, k, min_sim, margin, cut[r.turn_idx if r.conv_id != "z" else -1 - r.turn_idx])
        assert {h.signal: (h.confidence, h.evidence) for h in r.event.manipulation_signals} == {s: (pytest.approx(c, abs=1e-3), e) for s, (c, e) in want.items()}
        assert all(h.evidence in r.text for h in r.event.manipulation_signals)
        some += len(want)
    assert some > 10


def test_hybrid_keeps_the_rules_actor_and_adds_clauses(spark):
    df = spark.createDataFrame([("c", 0, "caller", "I am calling from the bank. Tell me the OTP."), ("c", 1, "caller", "read out the codes"), ("c", 2, "user", "tell me the code")], TURN)
    bank = spark.createDataFrame(BANK, "text string, label string")
    rules = {r.turn_idx: r.event for r in extract.rules(df).collect()}
    both = {r.turn_idx: r.event for r in semantic.hybrid_extractor(bank, k=1, min_sim=0.4)(df).collect()}
    for i, e in both.items():
        assert (e.actor_claim, e.communication_intent) == (rules[i].actor_claim, rules[i].communication_intent)
        assert {h.signal for h in rules[i].manipulation_signals} <= {h.signal for h in e.manipulation_signals}
    assert "CREDENTIAL_REQUEST" in {h.signal for h in both[1].manipulation_signals} and not rules[1].manipulation_signals
    assert both[2].manipulation_signals == []


def test_clauses_of_turns_meet_a_small_bank_without_a_shuffle(spark, monkeypatch):
    """Each row has its own hits, repeated turns and null ids too; a bank that isn't small gives the same in a join."""
    rows = [("c", 0, "caller", "read out the codes"), ("c", 0, "caller", "I work at the bank. hello there my friend"), (None, 1, "caller", "read out the codes, and then tell me the code"), ("c", 2, "user", "read out the codes"), ("c", 3, "caller", None), ("c", 4, "caller", "")]
    df = spark.createDataFrame(rows, TURN)
    bank = spark.createDataFrame([*BANK, ("read out the codes", None), (None, "THREAT")], "text string, label string")

    def hits(k):
        e = semantic.semantic_extractor(bank, k=k, min_sim=0.3, margin=0.01)(df)
        plan = e._jdf.queryExecution().optimizedPlan().toString()
        return plan, sorted((str(r.conv_id), r.turn_idx, r.text or "", [(h.signal, h.evidence, round(h.confidence, 6)) for h in r.event.manipulation_signals]) for r in e.collect())

    small = [hits(k) for k in (1, 2)]
    monkeypatch.setattr(semantic, "BANK_ROWS", 1)
    large = [hits(k) for k in (1, 2)]
    assert [h for _, h in small] == [h for _, h in large]
    assert not any("Join" in p or "Aggregate" in p for p, _ in small) and all("Join" in p for p, _ in large)
    found = {(c, i, t): h for c, i, t, h in small[0][1]}
    assert found["c", 0, rows[0][3]] and found["None", 1, rows[2][3]] and found["c", 0, rows[0][3]] != found["c", 0, rows[1][3]]
    assert not found["c", 2, rows[3][3]] and not found["c", 3, ""]


def test_registered_stages_over_the_conversations_table(spark):
    assert extract.build_extractor("semantic") and extract.build_extractor("hybrid")
    for q in ("semantic_extraction_whole", "hybrid_extraction_whole"):
        out = queries.QUERIES[q](spark, "/root/testdata/sf0.001")
        assert out.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter("role <> 'system'").count()


def test_the_default_bank_knows_other_conversations(spark):
    """Of generated turns of another seed most marked signals are found, and few plain turns have any."""
    t = datagen.turns(datagen.conversations(spark, 2, 51, None, 0.0), 51).filter("speaker = 'caller'")
    e = semantic.semantic_extractor()(t.select("conv_id", "turn_idx", "speaker", "text", "spans", "is_scam")).collect()
    marked = [(({s.signal for s in r.spans}), {h.signal for h in r.event.manipulation_signals}) for r in e]
    found = sum(len(a & b) for a, b in marked) / max(1, sum(len(a) for a, _ in marked))
    assert found > 0.6 and sum(bool(b) for a, b in marked if not a) / max(1, sum(not a for a, _ in marked)) < 0.25


# ---- a model with a budget -----------------------------------------------------------------------------------------------


EVENT = json.dumps({"actor_claim": "BANK", "communication_intent": "REQUEST_INFO", "manipulation_signals": [{"signal": "CREDENTIAL_REQUEST", "evidence": "Tell me the OTP", "confidence": 0.95}], "requested_action": "SHARE_OTP", "financial_consequence": "ACCOUNT_TAKEOVER", "stage": "COMPLIANCE", "entities": [], "confidence": 0.95})


def fake():
    """Answers by what the turn says: late, broken, failing once, always failing, or at once."""
    seen = {}

    def ask(key, prompt):
        said = prompt.rsplit("]: ", 1)[1]
        seen[key] = seen.get(key, 0) + 1
        if "slow" in said:
            time.sleep(5)
        if "fail" in said or ("flaky" in said and seen[key] == 1):
            raise OSError("no answer")
        return "not json" if "broken" in said else "```json\n" + EVENT + "\n```"

    return ask


def test_a_model_within_its_budget(spark):
    texts = ["Tell me the OTP", "Tell me the OTP slow", "Tell me the OTP broken", "Tell me the OTP flaky", "Tell me the OTP fail", "hello there"]
    rows = [("c", i, "caller", t) for i, t in enumerate(texts)] + [("c", 6, "user", "Tell me the OTP"), ("c", 7, "caller", None)]
    df = spark.createDataFrame(rows, TURN).coalesce(1)
    asked = model.ask(df, fake, budget_ms=700, concurrency=3)
    by = {r.turn_idx: r for r in asked.collect()}
    assert [by[i].model_status for i in range(8)] == ["ok", "timeout", "ok", "ok", "error", "ok", None, None]
    assert by[1].model_answer is None and by[1].latency_ms >= 600 and by[6].latency_ms is None
    m = model.metrics(asked).first()
    assert (m.asked, m.ok, m.timeout, m.error, m.skipped) == (6, 4, 1, 1, 0)
    for make, alone in ((model.ensemble_extractor, False), (model.model_extractor, True)):
        e = {r.turn_idx: r.event for r in make(fake, budget_ms=700, concurrency=3)(df).collect()}
        assert len(e) == 8 and e[0].actor_claim == "BANK" and e[0].confidence == 0.95
        assert {e[i].source for i in (1, 2, 4, 6, 7)} == {"rules"} and e[0].source == ("llm" if alone else "ensemble")
        assert [h.signal for h in e[1].manipulation_signals] == ["CREDENTIAL_REQUEST"]  # the rules stand
        assert e[5].manipulation_signals == []  # its quote isn't in the text


def test_calls_are_bounded_and_in_order():
    running, most, lock = itertools.count(), [0, 0], threading.Lock()

    def make():
        def ask(key, prompt):
            with lock:
                most[0] += 1
                most[1] = max(most)
            time.sleep(0.01)
            with lock:
                most[0] -= 1
            return key

        return ask

    rows = [(str(next(running)), "x" if i % 3 else None) for i in range(100)]
    got = list(model.answers(make, 2000, 4, 0, iter(rows)))
    assert [a for a, _, _ in got] == [k if p else None for k, p in rows] and most[1] <= 4


def test_hung_calls_end_in_skips():
    got = list(model.answers(lambda: lambda k, p: time.sleep(20), 30, 2, 0, iter([(str(i), "x") for i in range(9)]), most_abandoned=4))
    assert [s for _, s, _ in got].count("timeout") >= 4 and [s for _, s, _ in got][-1] == "skipped" and len(got) == 9


def test_http_client():
    class Chat(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            answer = json.dumps({"choices": [{"message": {"content": self.headers["Idempotency-Key"] + ":" + body["messages"][1]["content"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert model.http_client(f"http://127.0.0.1:{server.server_port}/v1/chat", "m")()("c/1", "hi") == "c/1:hi"
    server.shutdown()


# ---- passages by windows -------------------------------------------------------------------------------------------------


def test_window_overlaps_against_all_windows(spark):
    from turnwise.operators.grounding import window_overlaps

    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["[url]", "é"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(40)] + [(100, "w1"), (101, "w1 w1 w1 w2"), (102, docs[3][1] or "w1"), (103, "nowhere at all"), (104, "...")]
    got = {(r.item_id, r.doc_id): r.score for r in window_overlaps(spark.createDataFrame(items, "item_id long, q string"), spark.createDataFrame(docs, "doc_id long, t string")).collect()}
    want = {}
    for i, q in items:
        e = q.split() if q != "..." else []
        for j, t in docs:
            if t is None:
                continue
            tk, score = t.split(), 1.0 if q in t else 0.0
            if not score and e and tk:
                score = max(len(set(e) & set(tk[s : s + len(e) + 2])) / len(set(e)) for s in range(max(1, len(tk) - len(e) + 1)))
            if score >= 0.8:
                want[i, j] = pytest.approx(score)
    assert got == want and len(want) > 50


# ---- similarity and linkage at size --------------------------------------------------------------------------------------


def fingerprints(rng, n, repeats=False):
    from turnwise.functions import dims

    steps, out = list(dims.STEPS), {}
    while len(out) < n:
        s = rng.sample(steps, rng.randint(1, 7)) if not repeats else [rng.choice([*steps, "ODD"]) for _ in range(rng.randint(0, 7))]
        t = sorted(rng.sample(sorted(dims.SIGNALS), rng.randint(0, 4)))
        out[">".join(s) + "|" + ",".join(t)] = (s, t)
    return [(c, s, t, 1 + i % 3, f"c{i:05}") for i, (c, (s, t)) in enumerate(out.items())]


FP = "code string, steps array<string>, tactics array<string>, n long, first_conv string"


@pytest.mark.parametrize("repeats", [False, True])
def test_bounds_lose_no_similar_pair(spark, repeats):
    from turnwise.operators import patterns

    df = spark.createDataFrame(fingerprints(random.Random(5), 60, repeats), FP).withColumn("node", F.xxhash64("code"))
    every = {frozenset((r.a, r.b)): r.similarity for r in patterns.pair_similarity(df, "node").collect()}
    for threshold in (0.55, 0.65, 0.8):
        got = {frozenset((r.a, r.b)): r.s for r in patterns.similar_pairs(df, threshold).collect()}
        assert got == {p: pytest.approx(s) for p, s in every.items() if s >= threshold}


def test_nearest_against_all_pairs(spark):
    from turnwise.operators import patterns

    rows = fingerprints(random.Random(9), 80, True)
    df = spark.createDataFrame(rows, FP)
    every = {(r.a, r.b): r.similarity for r in patterns.pair_similarity(df).collect()}
    sim = lambda a, b: every[min(a, b), max(a, b)] if a != b else (1.0 if rows_by[a] else 0.0)
    rows_by = {r[0]: r[1] for r in rows}
    live = df.limit(25)
    got = {(r.code, r["rank"]): (r.incident, round(r.similarity, 9)) for r in patterns.nearest(live, df, 4).collect()}
    for c in (r.code for r in live.collect()):
        want = sorted((-round(sim(c, o), 9), o) for o in rows_by)[:4]
        assert [got[c, k + 1] for k in range(4)] == [(o, -s) for s, o in want]


@pytest.mark.parametrize("row_bytes", [1, 128 << 20])
def test_linkage_by_rows_is_linkage(row_bytes):
    """The same merges as with the whole matrix, also where next to no row is kept."""
    from turnwise.operators import patterns

    for seed in range(6):
        rows = fingerprints(random.Random(seed), 60, seed % 2 == 1)
        linked = patterns.Linkage([r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows]), row_bytes)
        m = np.array([linked.similarities(i) for i in range(60)])
        np.fill_diagonal(m, 1.0)
        for threshold in (0.4, 0.65):
            fresh = patterns.Linkage([r[1] for r in rows], [r[2] for r in rows], np.array([r[3] for r in rows]), row_bytes)
            assert sorted(map(sorted, fresh.clusters(threshold))) == sorted(map(sorted, patterns.linkage(m, np.array([r[3] for r in rows]), threshold)))


def test_linkage_beyond_the_old_limit():
    from turnwise.operators import patterns

    rows = fingerprints(random.Random(1), 4500)
    start = time.process_time()
    groups = patterns.Linkage([r[1] for r in rows], [r[2] for r in rows], np.ones(4500), 32 << 20).clusters(0.65)
    assert sorted(i for g in groups for i in g) == list(range(4500)) and 1 < len(groups) < 4500
    assert time.process_time() - start < 300
