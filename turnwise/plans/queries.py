"""Registered queries over the driver's tables, one for each operator family, and their DuckDB SQL.

Sessions of ``events`` stand for conversations: (user, day), ordered by time and id; the five event types map to five
signals, and the confidence follows the value. ``conversations`` gives turns: assistant for caller, user for user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims, privacy, sequences
from ..operators import evaluate, extract, folds, graph, markov, patterns, semantic
from ..sources import io
from . import datagen, session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: event type -> signal
SIGNAL_OF = {"view": "AUTHORITY_CLAIM", "click": "URGENCY", "error": "ISOLATION", "signup": "CREDENTIAL_REQUEST", "purchase": "PAYMENT_REQUEST"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Queries on lines or conversations that the engine makes itself: demonstrations that tests run, not part of the registry.
FIXTURES: dict[str, Callable] = {}
FIXTURE_ORACLES: dict[str, str] = {}


def fixture(sql: str | None = None):
    def add(f):
        FIXTURES[f.__name__] = f
        if sql:
            FIXTURE_ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn_idx, signal, evidence, confidence of the events' sessions. The one shuffle by user puts all of a user's sessions together."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL")
    day = F.to_date("ts")
    i = F.row_number().over(W.partitionBy("user_id", day).orderBy("ts", "event_id")) - 1
    conf = F.when(F.col("value") < 50, 0.75).otherwise(0.9)
    out = e.select(F.concat_ws("@", F.col("user_id").cast("string"), day.cast("string")).alias("conv_id"), i.alias("turn_idx"), dims.lookup(SIGNAL_OF, F.col("event_type")).alias("signal"), F.concat(F.col("event_type"), F.lit("#"), F.col("event_id").cast("string")).alias("evidence"), conf.alias("confidence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return out.filter("signal IS NOT NULL")


H = """
m(event_type, signal, step, stage, w, ask, pressure, code) AS (VALUES
 ('view','AUTHORITY_CLAIM','AUTHORITY',1,0.15::DOUBLE,false,true,'AUT'),('click','URGENCY','URGENCY',2,0.2::DOUBLE,false,true,'URG'),('error','ISOLATION','ISOLATION',3,0.3::DOUBLE,false,true,'ISO'),
 ('signup','CREDENTIAL_REQUEST','CREDENTIALS',4,0.45::DOUBLE,true,false,'CRD'),('purchase','PAYMENT_REQUEST','TRANSFER',5,0.5::DOUBLE,true,false,'TRF')),
h AS (SELECT user_id::VARCHAR || '@' || strftime(ts, '%Y-%m-%d') AS conv_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS turn_idx,
  signal, step, stage, w, ask, pressure, code, event_type || '#' || event_id::VARCHAR AS evidence, CASE WHEN value < 50 THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
  epoch_us(ts) // 1000 AS ms, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events JOIN m USING (event_type) WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""
FP = H + """,
firsts AS (SELECT conv_id, step, code, min(turn_idx) AS first_turn, min(signal) AS signal FROM h GROUP BY 1, 2, 3),
fp AS (SELECT conv_id, string_agg(step, '>' ORDER BY first_turn) AS steps, string_agg(code, '>' ORDER BY first_turn) AS code, count(*) AS n_steps,
  string_agg(signal, ',' ORDER BY signal) AS tactics FROM firsts GROUP BY 1)"""
EV = H + """,
t AS (SELECT conv_id, turn_idx, signal, stage, ask, pressure, evidence, greatest(w, 0.05) * confidence AS full_w, confidence FROM h),
run AS (SELECT *, bool_or(pressure) OVER c AS pressured, """ + ", ".join(f"sum(CASE WHEN stage={i} AND NOT ask THEN full_w ELSE 0 END) OVER c AS o{i}, sum(CASE WHEN stage={i} AND ask THEN full_w ELSE 0 END) OVER c AS a{i}" for i in range(1, 6)) + """
  FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING)),
sc AS (SELECT conv_id, turn_idx, pressured, """ + ", ".join(f"o{i} + a{i} * CASE WHEN pressured THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END AS s{i}" for i in range(1, 6)) + """ FROM run),
st AS (SELECT *, CASE WHEN s5>=0.1 THEN 5 WHEN s4>=0.1 THEN 4 WHEN s3>=0.1 THEN 3 WHEN s2>=0.1 THEN 2 WHEN s1>=0.1 THEN 1 END AS reached FROM sc),
rs AS (SELECT *, CASE reached WHEN 5 THEN s5 WHEN 4 THEN s4 WHEN 3 THEN s3 WHEN 2 THEN s2 WHEN 1 THEN s1 END AS rscore FROM st)"""


def fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fingerprints(hits(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.turn_evidence(hits(spark, sf_dir))


# ---- fingerprints and folds -------------------------------------------------------------------------------------------


@query("WITH" + FP + " SELECT code, count(*) AS n FROM fp GROUP BY code")
def fingerprint_codes(spark, sf_dir):
    return fps(spark, sf_dir).groupBy(dims.step_code(F.col("steps")).alias("code")).agg(F.count("*").alias("n"))


@query("WITH" + FP + " SELECT conv_id, step, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS INTEGER) AS pos FROM firsts")
def first_step_order(spark, sf_dir):
    return fps(spark, sf_dir).select("conv_id", F.posexplode("steps").alias("p", "step")).select("conv_id", "step", (F.col("p") + 1).alias("pos"))


@query("WITH" + FP + ", o AS (SELECT conv_id, step, lead(step) OVER (PARTITION BY conv_id ORDER BY first_turn) AS nxt FROM firsts) SELECT step || '>' || nxt AS bigram, count(*) AS n FROM o WHERE nxt IS NOT NULL GROUP BY 1")
def step_bigrams(spark, sf_dir):
    return folds.step_bigrams(fps(spark, sf_dir)).groupBy("bigram").agg(F.count("*").alias("n"))


@query("WITH" + H + """, g AS (SELECT conv_id, turn_idx, CASE WHEN k % 2 = 0 THEN ms % 86400000 END AS at_ms FROM h),
 l AS (SELECT *, max(CASE WHEN at_ms IS NOT NULL THEN turn_idx END) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING) AS last FROM g)
 SELECT l.conv_id, CAST(l.turn_idx AS INTEGER) AS turn_idx, CAST(CASE WHEN l.last IS NULL THEN 3000 * (l.turn_idx + 1) ELSE b.at_ms + 3000 * (l.turn_idx - l.last) END AS BIGINT) AS at
 FROM l LEFT JOIN g b ON b.conv_id = l.conv_id AND b.turn_idx = l.last""")
def clock_fill(spark, sf_dir):
    t = hits(spark, sf_dir).select("conv_id", "turn_idx", F.when(F.col("k") % 2 == 0, F.pmod("ms", F.lit(86400000))).alias("at_ms"))
    return folds.clock_fill(t).select("conv_id", "turn_idx", "at")


@query("WITH" + EV + " SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, pressured FROM rs")
def pressure_flag(spark, sf_dir):
    return evidence(spark, sf_dir).select("conv_id", "turn_idx", "pressured")


@query("WITH" + EV + " SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, " + ", ".join(f"round(s{i}, 6) AS score_{i}" for i in range(1, 6)) + " FROM rs")
def gated_stage_scores(spark, sf_dir):
    return evidence(spark, sf_dir).select("conv_id", "turn_idx", *[F.round(f"score_{i}", 6).alias(f"score_{i}") for i in range(1, 6)])


@query("WITH" + EV + " SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, CAST(coalesce(reached, -1) AS INTEGER) AS reached FROM rs")
def stage_reached(spark, sf_dir):
    return evidence(spark, sf_dir).select("conv_id", "turn_idx", F.coalesce("reached", F.lit(-1)).alias("reached"))


@query("WITH" + EV + """, m2 AS (SELECT conv_id, turn_idx, max(reached) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING) AS now,
 max(reached) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rs)
 SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, CAST(now AS INTEGER) AS stage_idx FROM m2 WHERE now > coalesce(before, -1)""")
def stage_history(spark, sf_dir):
    return folds.stage_history(evidence(spark, sf_dir))


@query("WITH" + H + " SELECT conv_id, CAST(stage AS INTEGER) AS stage_idx, arg_min(evidence, turn_idx) AS evidence FROM h GROUP BY 1, 2")
def stage_reason(spark, sf_dir):
    return folds.stage_reasons(hits(spark, sf_dir))


PROGRESS = "WITH RECURSIVE" + EV + """, p AS (SELECT conv_id, turn_idx, reached, round_even(least(1.0::DOUBLE, (reached + least(1.0::DOUBLE, rscore / 0.5::DOUBLE)) / 6), 2) AS raw,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn_idx) AS i FROM rs WHERE reached IS NOT NULL),
 f AS (SELECT conv_id, i, turn_idx, CAST(reached AS INTEGER) AS cur, raw AS pr, true AS emit FROM p WHERE i = 1
  UNION ALL SELECT p.conv_id, p.i, p.turn_idx,
   CASE WHEN p.reached > f.cur OR greatest(p.raw, f.pr) - f.pr >= 0.08::DOUBLE THEN CAST(p.reached AS INTEGER) ELSE f.cur END,
   CASE WHEN p.reached > f.cur OR greatest(p.raw, f.pr) - f.pr >= 0.08::DOUBLE THEN greatest(p.raw, f.pr) ELSE f.pr END,
   p.reached > f.cur OR greatest(p.raw, f.pr) - f.pr >= 0.08::DOUBLE FROM f JOIN p ON p.conv_id = f.conv_id AND p.i = f.i + 1)"""


@query(PROGRESS + " SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, cur AS stage_idx, pr AS progress FROM f WHERE emit")
def progress_emissions(spark, sf_dir):
    return folds.progress_emissions(evidence(spark, sf_dir))


@query("WITH" + EV + ", f AS (SELECT conv_id, max(reached) AS stage FROM rs GROUP BY 1), c AS (SELECT conv_id, signal, max(w) AS w, max(confidence) AS c FROM h GROUP BY 1, 2), q AS (SELECT conv_id, product(1 - w * c) AS left_over FROM c GROUP BY 1) SELECT conv_id, round_even(0.5 * (1 - left_over) + 0.3 * coalesce(stage, 0) / 5, 4) AS score FROM q JOIN f USING (conv_id)")
def evidence_score(spark, sf_dir):
    h = hits(spark, sf_dir)
    reached = folds.turn_evidence(h).groupBy("conv_id").agg(F.max("reached").alias("stage_idx"))
    return folds.evidence_scores(h, reached)


@query("WITH" + H + """, e AS (SELECT conv_id, turn_idx, signal, row_number() OVER (PARTITION BY conv_id, signal ORDER BY turn_idx) AS r FROM h)
 SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, signal, CAST(3000 * (turn_idx + 1) + 100 AS BIGINT) AS event_at FROM e WHERE r = 1 OR signal IN ('ISOLATION','CREDENTIAL_REQUEST','PAYMENT_REQUEST')""")
def signal_emission_times(spark, sf_dir):
    h = hits(spark, sf_dir)
    t = folds.clock_fill(h.withColumn("at_ms", F.lit(None).cast("long")))
    return folds.emitted_signals(t).select("conv_id", "turn_idx", "signal", F.col("event_at").cast("long").alias("event_at"))


@query("WITH" + EV + """, f AS (SELECT conv_id, max(reached) AS gated, max(CASE WHEN o5+a5>=0.1 THEN 5 WHEN o4+a4>=0.1 THEN 4 WHEN o3+a3>=0.1 THEN 3 WHEN o2+a2>=0.1 THEN 2 WHEN o1+a1>=0.1 THEN 1 END) AS open FROM rs JOIN run USING (conv_id, turn_idx) GROUP BY 1)
 SELECT CAST(coalesce(gated, -1) AS INTEGER) AS gated, CAST(coalesce(open, -1) AS INTEGER) AS open, count(*) AS n FROM f GROUP BY 1, 2""")
def stage_gate_ablation(spark, sf_dir):
    h = hits(spark, sf_dir)
    final = lambda gate, name: folds.turn_evidence(h, gate).groupBy("conv_id").agg(F.coalesce(F.max("reached"), F.lit(-1)).alias(name))
    return final(True, "gated").join(final(False, "open"), "conv_id").groupBy("gated", "open").agg(F.count("*").alias("n"))


@query("WITH" + FP + """, k AS (SELECT steps, count(*) AS m, min(conv_id) AS f FROM fp GROUP BY 1),
 x AS (SELECT steps, m, f, unnest(range(len(string_split(steps || '>END', '>')))) AS i FROM k), y AS (SELECT *, string_split(steps || '>END', '>') AS a FROM x),
 z AS (SELECT *, unnest([1, 2, 3]) AS k FROM y)
 SELECT array_to_string(a[i - k + 1:i], '>') AS ctx, CAST(k AS INTEGER) AS k, a[i + 1] AS nxt, CAST(sum(m) AS BIGINT) AS n FROM z WHERE i >= k GROUP BY 1, 2, 3""")
def ngram_counts(spark, sf_dir):
    return markov.train(fps(spark, sf_dir)).select("ctx", "k", "nxt", "n")


MODEL = FP + """, kinds AS (SELECT steps, count(*) AS m, min(conv_id) AS f FROM fp GROUP BY 1),
 spots AS (SELECT steps, m, f, string_split(steps || '>END', '>') AS a, unnest(range(len(string_split(steps || '>END', '>')))) AS i FROM kinds),
 ctxs AS (SELECT *, unnest([1, 2, 3]) AS k FROM spots),
 model AS (SELECT array_to_string(a[i - k + 1:i], '>') AS ctx, k, a[i + 1] AS nxt, sum(m) AS n, min(f || '#' || lpad(i::VARCHAR, 6, '0')) AS first_seen FROM ctxs WHERE i >= k GROUP BY 1, 2, 3),
 totals AS (SELECT ctx, k, sum(n) AS total FROM model GROUP BY 1, 2 HAVING sum(n) >= 3),
 pre AS (SELECT DISTINCT array_to_string(a[1:i], '>') AS key FROM spots WHERE i >= 1),
 suf AS (SELECT key, unnest([1, 2, 3]) AS k FROM pre),
 bk AS (SELECT key, max(suf.k) AS k FROM suf JOIN totals t ON t.k = suf.k AND t.ctx = array_to_string(list_reverse(list_reverse(string_split(key, '>'))[1:suf.k]), '>') WHERE len(string_split(key, '>')) >= suf.k GROUP BY 1),
 dist AS (SELECT bk.key, bk.k, md.nxt, md.n, md.first_seen, t.total FROM bk JOIN totals t ON t.k = bk.k AND t.ctx = array_to_string(list_reverse(list_reverse(string_split(key, '>'))[1:bk.k]), '>') JOIN model md ON md.ctx = t.ctx AND md.k = t.k),
 alive AS (SELECT * FROM dist WHERE NOT list_contains(string_split(key, '>'), nxt)),
 base AS (SELECT key, max(k) AS k, sum(n) AS support FROM alive GROUP BY 1),
 best AS (SELECT a.key, a.nxt, a.n, row_number() OVER (PARTITION BY a.key ORDER BY a.n DESC, a.first_seen) AS r FROM alive a WHERE nxt <> 'END')"""


def _prefixes(spark, sf_dir) -> DataFrame:
    """All distinct non-empty prefixes of the sessions' step lists, the whole lists included."""
    f = fps(spark, sf_dir).select("steps").distinct()
    return f.select(F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("k"), "steps").select(F.slice("steps", 1, F.col("k")).alias("steps")).distinct()


@query("WITH" + MODEL + " SELECT key, CAST(k AS INTEGER) AS k, nxt, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM dist")
def backoff_distribution(spark, sf_dir):
    return markov.backoff(_prefixes(spark, sf_dir), markov.train(fps(spark, sf_dir))).select("key", "k", "nxt", "n", "total")


def _unmatched(live: DataFrame) -> DataFrame:
    return live.select("steps", F.lit(0.0).alias("match_score"), F.lit(True).alias("novel"), F.lit(None).cast("array<string>").alias("prototype"), F.lit(None).cast("string").alias("pattern_name"))


@query("WITH" + MODEL + " SELECT b.key, nxt AS next, round_even(n / support, 3) AS probability, CAST(support AS BIGINT) AS support, CAST(k AS INTEGER) AS ord, CAST(round_even(100 * round_even(n / support, 3) * least(1.0::DOUBLE, sqrt(support / 8.0::DOUBLE)), 0) AS INTEGER) AS confidence FROM best b JOIN base USING (key) WHERE r = 1")
def next_step_prediction(spark, sf_dir):
    p = markov.predict(_unmatched(_prefixes(spark, sf_dir)), markov.train(fps(spark, sf_dir)))
    return p.select(F.array_join("steps", ">").alias("key"), "next", "probability", "support", F.col("order").alias("ord"), "confidence")


@query("WITH" + MODEL + """, g AS (SELECT array_to_string(a[1:i], '>') AS key, a[i + 1] AS gold, sum(m) AS n FROM spots WHERE i >= 1 AND i < len(a) - 1 GROUP BY 1, 2)
 SELECT CAST(sum(g.n) AS BIGINT) AS n, round(sum(CASE WHEN b.r = 1 THEN g.n ELSE 0 END)::DOUBLE / sum(g.n), 6) AS top1, round(sum(CASE WHEN b.r <= 2 THEN g.n ELSE 0 END)::DOUBLE / sum(g.n), 6) AS top3 FROM g LEFT JOIN best b ON b.key = g.key AND b.nxt = g.gold""")
def prediction_accuracy(spark, sf_dir):
    """Top 3 is the prediction and then the ranked list, which holds it again: without a pattern's bonus the first two ranks."""
    f = fps(spark, sf_dir)
    model = markov.train(f)
    g = markov.prefixes(f).groupBy(F.array_join("steps", ">").alias("key"), "gold").agg(F.sum("n").alias("n"))
    live = _prefixes(spark, sf_dir)
    first = markov.predict(_unmatched(live), model).select(F.array_join("steps", ">").alias("key"), "next")
    ranked = markov.ranked_next(live, model).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nxt"))), lambda x: x["nxt"]).alias("ranked"))
    j = g.join(first, "key", "left").join(ranked, "key", "left")
    top3 = F.slice(F.concat(F.array("next"), F.coalesce("ranked", F.array().cast("array<string>"))), 1, 3)
    share = lambda c: F.round(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return j.agg(F.sum("n").alias("n"), share(F.col("next") == F.col("gold")).alias("top1"), share(F.array_contains(top3, F.col("gold"))).alias("top3"))


# ---- similarity --------------------------------------------------------------------------------------------------------

KINDS = FP + ", kinds AS (SELECT code, min(steps) AS steps, min(tactics) AS tactics, count(*) AS n FROM fp GROUP BY 1)"
LCS = KINDS + """, pairs AS (SELECT a.code AS a, b.code AS b, a.steps AS xs, b.steps AS ys, a.tactics AS xt, b.tactics AS yt FROM kinds a JOIN kinds b ON a.code < b.code),
 sub AS (SELECT code, string_split(code, '>') AS s FROM kinds),
 masks AS (SELECT code, s, unnest(range(1, CAST(power(2, len(s)) AS BIGINT))) AS k FROM sub),
 seqs AS (SELECT DISTINCT code, array_to_string(list_filter(s, lambda x, i: (k // CAST(power(2, i - 1) AS BIGINT)) % 2 = 1), '>') AS q, bit_count(k) AS n FROM masks),
 lcs AS (SELECT p.a, p.b, max(x.n) AS l FROM pairs p JOIN seqs x ON x.code = p.a JOIN seqs y ON y.code = p.b AND y.q = x.q GROUP BY 1, 2)"""
SIM = LCS + """, bi AS (SELECT code, list_transform(range(1, len(string_split(code, '>'))), lambda i: string_split(code, '>')[i] || '>' || string_split(code, '>')[i + 1]) AS g FROM kinds),
 jac AS (SELECT p.a, p.b, p.xs, p.ys, len(list_intersect(string_split(p.xt, ','), string_split(p.yt, ',')))::DOUBLE / len(list_distinct(list_concat(string_split(p.xt, ','), string_split(p.yt, ',')))) AS tj,
  CASE WHEN len(list_concat(x.g, y.g)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(list_concat(x.g, y.g))) END AS bj
  FROM pairs p JOIN bi x ON x.code = p.a JOIN bi y ON y.code = p.b),
 sim AS (SELECT j.a, j.b, 0.5 * 2.0 * coalesce(l, 0) / (len(string_split(xs, '>')) + len(string_split(ys, '>'))) + 0.3 * tj + 0.2 * bj AS s, coalesce(l, 0) AS l, tj, bj, len(string_split(xs, '>')) + len(string_split(ys, '>')) AS len2 FROM jac j LEFT JOIN lcs USING (a, b))"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct fingerprints by step code. Here tactics follow from steps, so the code alone is the key."""
    k = patterns.distinct_fingerprints(fps(spark, sf_dir))
    return k.withColumn("code", dims.step_code(F.col("steps")))


@query("WITH" + SIM + " SELECT a, b, CAST(l AS INTEGER) AS lcs, round(2.0 * l / len2, 6) AS order_similarity FROM sim")
def code_pair_lcs(spark, sf_dir):
    k = kinds(spark, sf_dir)
    a, b = k.select(F.col("code").alias("a"), F.col("steps").alias("x")), k.select(F.col("code").alias("b"), F.col("steps").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", sequences.lcs_length(F.col("x"), F.col("y")).alias("lcs"), F.round(sequences.order_similarity(F.col("x"), F.col("y")), 6).alias("order_similarity"))


@query("WITH" + SIM + " SELECT a, b, round(tj, 6) AS tactic_jaccard, round(bj, 6) AS bigram_jaccard FROM sim")
def code_pair_jaccard(spark, sf_dir):
    k = kinds(spark, sf_dir)
    a, b = (k.select(F.col("code").alias(n), F.col("steps").alias(f"s{n}"), F.col("tactics").alias(f"t{n}")) for n in ("a", "b"))
    bi = sequences.jaccard(sequences.bigrams(F.col("sa")), sequences.bigrams(F.col("sb")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(sequences.jaccard(F.col("ta"), F.col("tb")), 6).alias("tactic_jaccard"), F.round(bi, 6).alias("bigram_jaccard"))


@query("WITH" + SIM + " SELECT a, b, round(s, 6) AS similarity FROM sim")
def pair_similarity(spark, sf_dir):
    return patterns.pair_similarity(kinds(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH" + SIM + """, w AS (SELECT sum(x.n * y.n * 2.0 * l / len2) AS s, sum(x.n * y.n) AS w FROM sim JOIN kinds x ON x.code = a JOIN kinds y ON y.code = b),
 o AS (SELECT sum(n * (n - 1) / 2.0) AS w FROM kinds) SELECT round((w.s + o.w) / (w.w + o.w), 6) AS average FROM w, o""")
def avg_pair_similarity(spark, sf_dir):
    f = fps(spark, sf_dir).withColumnRenamed("conv_id", "id")
    return patterns.average_pair_similarity(f).select(F.round("average", 6).alias("average"))


@query("WITH" + SIM + """, two AS (SELECT a AS x, b AS y, s FROM sim UNION ALL SELECT b, a, s FROM sim),
 r AS (SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) AS r FROM (SELECT * FROM two UNION ALL SELECT code, code, 1.0 FROM kinds))
 SELECT x AS code, CAST(r AS INTEGER) AS rank, y AS incident, round(s, 6) AS similarity FROM r WHERE r <= 3""")
def nearest_incidents_topk(spark, sf_dir):
    k = kinds(spark, sf_dir)
    return patterns.nearest(k, k).withColumn("similarity", F.round("similarity", 6))


@query("WITH" + SIM + """, two AS (SELECT a AS x, b AS y, s FROM sim UNION ALL SELECT b, a, s FROM sim UNION ALL SELECT code, code, 1.0 FROM kinds),
 t AS (SELECT string_split(x, '>')[1] AS first_step, x, sum(s * k.n) AS s FROM two JOIN kinds k ON k.code = y WHERE string_split(x, '>')[1] = string_split(y, '>')[1] GROUP BY 1, 2)
 SELECT first_step, arg_max(x, s) AS code, round(max(s), 4) AS total FROM t GROUP BY 1""")
def medoid(spark, sf_dir):
    k = kinds(spark, sf_dir).withColumn("first_step", F.substring("code", 1, 3))
    m = patterns.medoids(k, k.select("code", F.col("first_step").alias("cluster")))
    x = k.select("first_step", F.col("steps").alias("y"), F.col("tactics").alias("q"), F.col("n").alias("m"))
    total = F.sum(sequences.fingerprint_similarity(F.col("steps"), F.col("tactics"), F.col("y"), F.col("q")) * F.col("m"))
    best = k.join(m.select("code"), "code").join(x, "first_step").groupBy("first_step", "code").agg(F.round(total, 4).alias("total"))
    return best


@query("WITH" + KINDS + """, part AS (SELECT 'AUT>URG' AS part UNION ALL SELECT 'URG' UNION ALL SELECT 'CRD>TRF'),
 pos AS (SELECT part, code, n, list_position(string_split(code, '>'), string_split(part, '>')[1]) AS p1, CASE WHEN len(string_split(part, '>')) = 2 THEN list_position(string_split(code, '>'), string_split(part, '>')[2]) ELSE 99 END AS p2 FROM part, kinds),
 nx AS (SELECT part, n, code, string_split(code, '>')[CASE WHEN p2 = 99 THEN p1 ELSE p2 END + 1] AS nxt FROM pos WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p1 < p2),
 v AS (SELECT part, nxt, sum(n) AS votes, min(code) AS f FROM nx WHERE nxt IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, sum(votes) OVER (PARTITION BY part) AS total, row_number() OVER (PARTITION BY part ORDER BY votes DESC, f) AS r FROM v)
 SELECT part AS code, CASE nxt WHEN 'AUT' THEN 'AUTHORITY' WHEN 'URG' THEN 'URGENCY' WHEN 'ISO' THEN 'ISOLATION' WHEN 'CRD' THEN 'CREDENTIALS' ELSE 'TRANSFER' END AS next, CAST(votes AS BIGINT) AS votes, CAST(total AS BIGINT) AS total FROM r WHERE r = 1""")
def vote_next_step(spark, sf_dir):
    parts = spark.createDataFrame([("AUT>URG", ["AUTHORITY", "URGENCY"]), ("URG", ["URGENCY"]), ("CRD>TRF", ["CREDENTIALS", "TRANSFER"])], "code string, steps array<string>")
    return patterns.vote_next(parts, kinds(spark, sf_dir).withColumn("ord", F.col("code")))


def _protos(spark: SparkSession) -> DataFrame:
    rows = [(1, "P1", "long", 4, ["AUTHORITY", "URGENCY", "ISOLATION", "CREDENTIALS", "TRANSFER"]), (2, "P2", "short", 3, ["AUTHORITY", "TRANSFER"]), (3, "P3", "late", 2, ["URGENCY", "CREDENTIALS", "TRANSFER"])]
    p = spark.createDataFrame(rows, "pattern_ord int, id string, name string, size int, steps array<string>")
    return p.withColumn("tactics", F.filter(F.array_sort(dims.inferred_tactics(F.col("steps"))), lambda s: s.isin(*SIGNAL_OF.values())))


PROTO = KINDS + """, proto(ord, id, code, tactics) AS (VALUES (1,'P1','AUT>URG>ISO>CRD>TRF','AUTHORITY_CLAIM,CREDENTIAL_REQUEST,ISOLATION,PAYMENT_REQUEST,URGENCY'),(2,'P2','AUT>TRF','AUTHORITY_CLAIM,PAYMENT_REQUEST'),(3,'P3','URG>CRD>TRF','CREDENTIAL_REQUEST,PAYMENT_REQUEST,URGENCY')),
 lp AS (SELECT k.code, k.tactics AS lt, p.id, p.ord, p.tactics AS pt, string_split(k.code, '>') AS s, string_split(p.code, '>')[1:len(string_split(k.code, '>')) + 1] AS f FROM kinds k, proto p),
 mk AS (SELECT code, id, s, f, unnest(range(1, CAST(power(2, len(s)) AS BIGINT))) AS k FROM lp),
 mq AS (SELECT code, id, f, bit_count(k) AS n, list_filter(s, lambda x, i: (k // CAST(power(2, i - 1) AS BIGINT)) % 2 = 1) AS q FROM mk),
 ml AS (SELECT code, id, max(n) AS l FROM mq WHERE list_filter(f, lambda x: list_contains(q, x)) = q GROUP BY 1, 2),
 bg AS (SELECT lp.code, lp.id, lp.ord, lt, pt, len(s) AS k, coalesce(l, 0) AS l, list_transform(range(1, len(s)), lambda i: s[i] || '>' || s[i + 1]) AS g, list_transform(range(1, len(f)), lambda i: f[i] || '>' || f[i + 1]) AS h FROM lp LEFT JOIN ml USING (code, id)),
 ps AS (SELECT code, id, ord, (0.5 * l / k + 0.3 * len(list_intersect(string_split(lt, ','), string_split(pt, ','))) / len(string_split(lt, ',')) + 0.2 * CASE WHEN k > 1 THEN CASE WHEN len(list_concat(g, h)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(g, h))::DOUBLE / len(list_distinct(list_concat(g, h))) END ELSE l::DOUBLE / k END) * least(1.0::DOUBLE, sqrt(k / 4.0::DOUBLE)) AS s FROM bg)"""


@query("WITH" + PROTO + " SELECT code, id AS pattern_id, round(s, 6) AS score FROM ps")
def partial_match(spark, sf_dir):
    p = _protos(spark).select(F.col("id").alias("pattern_id"), F.col("steps").alias("y"), F.col("tactics").alias("q"))
    s = sequences.partial_similarity(F.col("steps"), F.col("tactics"), F.col("y"), F.col("q"))
    return kinds(spark, sf_dir).join(F.broadcast(p), F.lit(True)).select("code", "pattern_id", F.round(s, 6).alias("score"))


@query("WITH" + PROTO + ", r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY s DESC, ord) AS r FROM ps) SELECT code, CASE WHEN s > 0 THEN id END AS pattern_id, round(s, 6) AS score, s < 0.55 AS novel, CAST(round_even(100 * round(s, 9), 0) AS INTEGER) AS match_pct FROM r WHERE r = 1")
def best_pattern_match(spark, sf_dir):
    m = patterns.best_match(kinds(spark, sf_dir), _protos(spark), ["code"])
    return m.select("code", "pattern_id", F.round("match_score", 6).alias("score"), "novel", sequences.percent(F.round("match_score", 9)).alias("match_pct"))


@query()
def pattern_clusters(spark, sf_dir):
    """Average-linkage clusters of the distinct fingerprints; sequential merging is beyond SQL."""
    k = kinds(spark, sf_dir)
    return patterns.clusters(k).join(k.select("code", "n"), "code").select("code", "cluster", "rank", "n")


@query("WITH" + FP + ", c AS (SELECT string_split(code, '>')[1] AS cluster, n_steps::VARCHAR AS family FROM fp), n AS (SELECT cluster, family, count(*) AS n FROM c GROUP BY 1, 2) SELECT cluster, family, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS share, n / sum(n) OVER (PARTITION BY cluster) >= 0.3 AS is_major FROM n")
def family_histogram(spark, sf_dir):
    f = fps(spark, sf_dir)
    h = patterns.family_histogram(f.select(F.substring(dims.step_code(F.col("steps")), 1, 3).alias("cluster"), F.size("steps").cast("string").alias("family")))
    return h.withColumn("share", F.round("share", 6))


@query()
def session_patterns(spark, sf_dir):
    """The library built from sessions: clusters, medoids, names; rows only, as for the clusters."""
    f = fps(spark, sf_dir).withColumn("family", F.concat(F.lit("len"), F.size("steps").cast("string")))
    p = session.build_library(f).patterns
    return p.select("pattern_ord", "id", "name", "size", F.array_join("steps", ">").alias("steps"), F.array_join("tactics", ",").alias("tactics"))
