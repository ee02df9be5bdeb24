"""Registered queries over texts, labels, embeddings and fixtures, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, privacy
from ..operators import evaluate, extract, folds, graph, semantic
from ..operators.grounding import held, window_overlaps
from ..sources.stage import staged
from . import datagen, session
from .queries import EV, ORACLES, PROGRESS, evidence, fixture, hits, query, table

# ---- redaction ---------------------------------------------------------------------------------------------------------

_URL = r"(?i)\b(?:https?://|www\.)\S+|\b(?:bit\.ly|tinyurl\.com|t\.me|wa\.me|rb\.gy)/\S+|\b[\w-]+\.(?:apk|xyz|top|click|link)\b"
_CHAIN = [
    ("url", _URL, "[URL]"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[EMAIL]"),
    ("upi", r"(?i)\b[\w.-]{2,}@(?:ok)?[a-z]{2,}\b", "[UPI]"),
    ("card", r"\b(?:\d{4}[\s-]?){3}\d{4}\b", "[CARD]"),
    ("aadhaar", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", "[AADHAAR]"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", "[PAN]"),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "[IFSC]"),
]
_STEPS, _prev = [], "text"
for _i, (_n, _p, _t) in enumerate(_CHAIN):
    _STEPS.append(f"r{_i} AS (SELECT *, len(regexp_extract_all({_prev}, '{_p}')) AS n_{_n}, regexp_replace({_prev}, '{_p}', '{_t}', 'g') AS x{_i} FROM {'documents' if _i == 0 else f'r{_i - 1}'})")
    _prev = f"x{_i}"
REDACT = ",\n".join(_STEPS)


@query(f"WITH {REDACT} SELECT lang, " + ", ".join(f"CAST(sum(n_{n}) AS BIGINT) AS n_{n}" for n, *_ in _CHAIN) + " FROM r6 GROUP BY lang")
def redact_counts_by_type(spark, sf_dir):
    r = privacy.redact(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return r.groupBy("lang").agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n, *_ in _CHAIN])


@query()
def redact_full(spark, sf_dir):
    """All kinds with names and look-around, which the checking engine's patterns lack; tests hold it against Python."""
    r = privacy.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_pii", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b')) AS INTEGER) AS n_email FROM documents WHERE len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b')) > 0")
def redact_emails_by_document(spark, sf_dir):
    r = privacy.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.filter("n_email > 0").select("doc_id", "n_email")


#: The e-mail pattern for an engine whose word characters and boundaries are ASCII only: letters of all scripts by class, the boundary as the character before.
_MAIL = r"(?:^|[^W])([W][W.+-]*@[W-]+\.[W.]*[W])".replace("W", r"\p{L}\p{M}\p{Nd}_")
_LEAK = rf"""WITH v AS (SELECT text, list_distinct(regexp_extract_all(text, '{_MAIL}', 1)) AS vals, regexp_replace(text, '{_MAIL}', '[EMAIL]', 'g') AS red FROM documents),
 n AS (SELECT regexp_replace(lower(unnest(vals)), '[\s-]', '', 'g') AS v, regexp_replace(lower(text), '[\s-]', '', 'g') AS raw, regexp_replace(lower(red), '[\s-]', '', 'g') AS red FROM v)
"""


@query(_LEAK + "SELECT count(*) AS n_values, CAST(sum(CASE WHEN contains(raw, v) THEN 1 ELSE 0 END) AS BIGINT) AS leaked_none, CAST(sum(CASE WHEN contains(red, v) THEN 1 ELSE 0 END) AS BIGINT) AS leaked_typed FROM n")
def leak_rate(spark, sf_dir):
    """E-mail values and leaks of all documents."""
    r = privacy.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), spans=True).withColumn("vals", F.array_distinct("spans_email")).filter(F.size("vals") > 0)
    n = lambda c: F.sum(F.size(c)).alias
    return r.agg(n(F.col("vals"))("n_values"), n(privacy.leaked(F.col("vals"), F.col("text")))("leaked_none"), n(privacy.leaked(F.col("vals"), F.col("redacted")))("leaked_typed")).select(*[F.col(c).cast("long").alias(c) for c in ("n_values", "leaked_none", "leaked_typed")])


@fixture()
def privacy_mode_sweep(spark, sf_dir):
    """mode, n_pii, leaked over the three modes on generated conversations."""
    t = datagen.turns(datagen.conversations(spark, 6))
    parts = []
    for mode in privacy.MODES:
        r = privacy.redact(t, "text", mode)
        parts.append(r.agg(F.lit(mode).alias("mode"), F.sum(F.size("pii")).cast("long").alias("n_values"), F.sum("n_pii").cast("long").alias("n_pii"), F.sum(F.size(privacy.leaked(F.col("pii"), F.col("redacted")))).cast("long").alias("leaked")))
    return parts[0].union(parts[1]).union(parts[2])


@query(r"""WITH a AS (SELECT doc_id, len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b')) AS e, regexp_replace(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b', '[EMAIL]', 'g') AS t FROM documents),
 b AS (SELECT doc_id, e + len(regexp_extract_all(t, '(?i)\b[\w.-]{2,}@[a-z]{2,}\b')) AS e, regexp_replace(t, '(?i)\b[\w.-]{2,}@[a-z]{2,}\b', '[UPI]', 'g') AS t FROM a),
 c AS (SELECT doc_id, e + len(regexp_extract_all(t, '\b(?:\+?91[\s-]?)?[6-9]\d{9}\b')) AS e, regexp_replace(t, '\b(?:\+?91[\s-]?)?[6-9]\d{9}\b', '[PHONE]', 'g') AS t FROM b),
 d AS (SELECT doc_id, e + len(regexp_extract_all(t, '(?i)\bending\s+(?:in\s+)?\d{4}\b')) AS e, regexp_replace(t, '(?i)\bending\s+(?:in\s+)?\d{4}\b', 'ending [ACCOUNT]', 'g') AS t FROM c),
 f AS (SELECT doc_id, e + len(regexp_extract_all(t, '\b\d{9,18}\b')) AS e, regexp_replace(t, '\b\d{9,18}\b', '[ACCOUNT]', 'g') AS t FROM d),
 g AS (SELECT doc_id, e + len(regexp_extract_all(t, '\b(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?')) AS e, regexp_replace(t, '\b(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?', '[NAME]', 'g') AS t FROM f),
 i AS (SELECT doc_id, e + len(regexp_extract_all(t, '\b(?:[Tt]his is|I am|I''m|my name is|Hi|Hello|Dear)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?')) AS e FROM g)
 SELECT doc_id, CAST(e AS INTEGER) AS n_sanitized FROM i WHERE e > 0""")
def sanitize_basic(spark, sf_dir):
    return privacy.sanitize_basic(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("n_sanitized > 0").select("doc_id", "n_sanitized")


# ---- turns -------------------------------------------------------------------------------------------------------------

_TURNS = "tt AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn_idx, CASE role WHEN 'assistant' THEN 'caller' ELSE 'user' END AS speaker, text FROM conversations WHERE role <> 'system')"


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    return c.select("conv_id", F.col("turn").cast("int").alias("turn_idx"), F.when(F.col("role") == "assistant", "caller").otherwise("user").alias("speaker"), "text")


@query(f"WITH {_TURNS}, w AS (SELECT conv_id, turn_idx, array_agg('[' || speaker || '] ' || text) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS c FROM tt) SELECT conv_id, turn_idx, CAST(coalesce(len(c), 0) AS INTEGER) AS n_context, md5(coalesce(array_to_string(c, chr(10)), '(start of conversation)')) AS context_md5 FROM w")
def prompt_context(spark, sf_dir):
    return folds.history_window(turns(spark, sf_dir)).select("conv_id", "turn_idx", F.size("context").alias("n_context"), F.md5(F.col("prompt_context").cast("binary")).alias("context_md5"))


@query(f"""WITH {_TURNS}, s AS (SELECT conv_id, turn_idx, unnest(regexp_extract_all(text, '[^.?!।;\\n]+(?:[.?!।;]+|$)')) AS s FROM tt), w AS (SELECT conv_id, turn_idx, trim(trim(s, ws), ' .?!;') AS whole, trim(s, ws) AS s FROM s, (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws) WHERE trim(s, ws) <> ''),
 p AS (SELECT conv_id, turn_idx, whole, unnest(regexp_split_to_array(s, '(?i),\\s+|\\s+(?:and then|then|aur phir|phir|aur|and)\\s+')) AS part FROM w),
 c AS (SELECT conv_id, turn_idx, whole AS clause FROM w UNION ALL SELECT conv_id, turn_idx, trim(part, ' ,.?!;') FROM p WHERE trim(part, ' ,.?!;') <> whole)
 SELECT conv_id, turn_idx, count(*) AS n_clauses, CAST(sum(length(clause)) AS BIGINT) AS n_chars FROM c WHERE len(list_filter(regexp_split_to_array(clause, '\\s+'), lambda x: length(x) > 0)) >= 3 GROUP BY 1, 2""")
def clause_split(spark, sf_dir):
    c = turns(spark, sf_dir).select("conv_id", "turn_idx", F.explode(semantic.clauses(F.col("text"))).alias("clause"))
    return c.groupBy("conv_id", "turn_idx").agg(F.count("*").alias("n_clauses"), F.sum(F.length("clause")).alias("n_chars"))


@query(f"WITH {_TURNS} SELECT conv_id, count(*) AS n, arg_max(speaker, turn_idx) AS last_speaker, md5(string_agg(text, '|' ORDER BY turn_idx)) AS transcript_md5 FROM tt GROUP BY conv_id")
def ui_reducer(spark, sf_dir):
    t = turns(spark, sf_dir)
    ev = t.select("conv_id", F.col("turn_idx").alias("at"), F.lit(0).alias("seq"), F.lit("transcript").alias("type"), F.col("text").alias("payload")).union(t.select("conv_id", F.col("turn_idx"), F.lit(1), F.lit("stage"), F.col("speaker")))
    r = graph.reduce_events(ev)
    return r.select("conv_id", F.size("transcript").cast("long").alias("n"), F.col("stage").alias("last_speaker"), F.md5(F.array_join("transcript", "|").cast("binary")).alias("transcript_md5"))


@query("""WITH RECURSIVE n AS (SELECT conv_id, CAST(turn AS BIGINT) AS id, CASE WHEN turn > 0 THEN CAST((turn - 1) // 2 AS BIGINT) END AS parent FROM conversations),
 w AS (SELECT conv_id, id, 0 AS depth FROM n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM n p WHERE p.conv_id = n.conv_id AND p.id = n.parent)
  UNION ALL SELECT n.conv_id, n.id, w.depth + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.parent = w.id)
 SELECT conv_id, id, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY conv_id, depth ORDER BY id) - 1 AS INTEGER) AS x FROM w""")
def graph_depth(spark, sf_dir):
    """The turns of a conversation as a tree in which turn t hangs on turn (t-1)/2."""
    c = table(spark, sf_dir, "conversations")
    n = c.select("conv_id", F.col("turn").cast("long").alias("id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).cast("long").alias("parent"), F.col("turn").alias("ord"))
    return graph.node_depth(n).select("conv_id", "id", "depth", "x")


# ---- splits and samples ------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN CAST('0x' || right(sha1(text), 1) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END AS part, count(*) AS n FROM documents GROUP BY 1")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(evaluate.hash_split(F.col("text")).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT md5(trim(text, ' ')) AS text_md5, arg_min(source, doc_id) AS label FROM documents GROUP BY 1")
def dedupe_first_label(spark, sf_dir):
    d = evaluate.dedupe_first_label(table(spark, sf_dir, "documents"), "text", "source", "doc_id")
    return d.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "label")


@query("SELECT lang, count(*) FILTER (lang = 'de') AS held, count(*) FILTER (lang <> 'de') AS kept FROM documents GROUP BY lang")
def leave_one_out_lang(spark, sf_dir):
    kept, held = evaluate.leave_one_out(table(spark, sf_dir, "documents"), "lang", "de")
    k, h = kept.groupBy("lang").agg(F.count("*").alias("kept")), held.groupBy("lang").agg(F.count("*").alias("held"))
    return k.join(h, "lang", "full").select("lang", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("kept", F.lit(0)).alias("kept"))


@query("SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS r FROM labels) WHERE r <= 50")
def balanced_sample(spark, sf_dir):
    return evaluate.balanced(table(spark, sf_dir, "labels"), 100, "toxic", "doc_id").select("doc_id", "toxic")


@query("SELECT DISTINCT lang FROM documents")
def axis_values(spark, sf_dir):
    return evaluate.axis_values(table(spark, sf_dir, "documents"), "lang")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN source IN ('src1', 'src2') THEN 'test' WHEN (row_number() OVER (PARTITION BY source IN ('src1', 'src2') ORDER BY doc_id) - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS part FROM documents) GROUP BY part")
def corpus_partition(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("family"), "doc_id")
    return evaluate.partition_corpus(d, ("src1", "src2"), "doc_id").groupBy("part").agg(F.count("*").alias("n"))


# ---- evaluation --------------------------------------------------------------------------------------------------------

_LAB = """lab AS (SELECT d.doc_id, d.lang, l.toxic = 1 AS positive, list_concat(CASE WHEN quality = 1 THEN ['AUTHORITY_CLAIM'] ELSE [] END, CASE WHEN toxic = 1 THEN ['THREAT'] ELSE [] END) AS gold,
 list_concat(CASE WHEN n_chars > 1000 THEN ['AUTHORITY_CLAIM'] ELSE [] END, CASE WHEN contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') THEN ['THREAT'] ELSE [] END, CASE WHEN contains(text, 'icense') THEN ['URGENCY'] ELSE [] END) AS predicted,
 round((n_chars % 50) / 50.0 + CASE WHEN contains(lower(text), 'stupid') THEN 0.5 ELSE 0 END, 2) AS score FROM documents d JOIN labels l USING (doc_id))"""
_CONF = _LAB + """, x AS (SELECT doc_id, lang, gold, predicted, unnest(list_distinct(list_concat(gold, predicted))) AS signal FROM lab),
 cc AS (SELECT signal, lang, CAST(sum(CASE WHEN list_contains(gold, signal) AND list_contains(predicted, signal) THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT list_contains(gold, signal) AND list_contains(predicted, signal) THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN list_contains(gold, signal) AND NOT list_contains(predicted, signal) THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM x GROUP BY GROUPING SETS ((signal), (lang), ())),
 pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p0, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r0 FROM cc),
 prf AS (SELECT signal, lang, tp, fp, fn, round_even(p0, 3) AS p, round_even(r0, 3) AS r, round_even(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END, 3) AS f1, tp + fn AS support FROM pr)"""


def labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    has = lambda s: F.contains(F.lower("text"), F.lit(s))
    names = lambda **k: F.array_compact(F.array(*[F.when(c, n) for n, c in k.items()]))
    return d.select("doc_id", "lang", (F.col("toxic") == 1).alias("positive"), names(AUTHORITY_CLAIM=F.col("quality") == 1, THREAT=F.col("toxic") == 1).alias("gold"), names(AUTHORITY_CLAIM=F.col("n_chars") > 1000, THREAT=has("stupid") | has("idiot"), URGENCY=F.contains("text", F.lit("icense"))).alias("predicted"), F.round((F.col("n_chars") % 50) / 50.0 + F.when(has("stupid"), 0.5).otherwise(0), 2).alias("score"))


@query(f"WITH {_CONF} SELECT coalesce(signal, '*') AS signal, coalesce(lang, '*') AS lang, tp, fp, fn FROM prf")
def confusion_counts(spark, sf_dir):
    c = evaluate.confusion_counts(labelled(spark, sf_dir))
    return c.select(F.coalesce("signal", F.lit("*")).alias("signal"), F.coalesce("lang", F.lit("*")).alias("lang"), "tp", "fp", "fn")


@query(f"WITH {_CONF} SELECT coalesce(signal, '*') AS signal, coalesce(lang, '*') AS lang, p, r, f1, support FROM prf")
def prf_by_group(spark, sf_dir):
    c = evaluate.prf(evaluate.confusion_counts(labelled(spark, sf_dir)))
    return c.select(F.coalesce("signal", F.lit("*")).alias("signal"), F.coalesce("lang", F.lit("*")).alias("lang"), "p", "r", "f1", "support")


@query(f"WITH {_CONF} SELECT round_even(avg(f1), 3) AS macro_f1 FROM prf WHERE signal IS NOT NULL AND support > 0")
def macro_f1(spark, sf_dir):
    return evaluate.macro_f1(evaluate.prf(evaluate.confusion_counts(labelled(spark, sf_dir)).filter("signal IS NOT NULL")))


@query(f"WITH {_LAB} SELECT round_even(avg(CASE WHEN gold[1] IS NOT DISTINCT FROM predicted[1] THEN 1.0 ELSE 0.0 END), 3) AS first_acc, round_even(avg(CASE WHEN list_contains(gold, 'THREAT') IS NOT DISTINCT FROM list_contains(predicted, 'THREAT') THEN 1.0 ELSE 0.0 END), 3) AS threat_acc FROM lab")
def accuracy_nullsafe(spark, sf_dir):
    r = labelled(spark, sf_dir).select(F.get("gold", F.lit(0)).alias("g1"), F.get("predicted", F.lit(0)).alias("p1"), F.array_contains("gold", "THREAT").alias("g2"), F.array_contains("predicted", "THREAT").alias("p2"))
    return evaluate.accuracy(r, {"first_acc": ("g1", "p1"), "threat_acc": ("g2", "p2")})


@query(f"WITH {_LAB} SELECT a.lang, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM lab a JOIN lab b ON a.lang = b.lang AND a.positive AND NOT b.positive GROUP BY 1")
def auroc_rank(spark, sf_dir):
    return evaluate.auroc(labelled(spark, sf_dir), by=["lang"]).filter(~F.isnan("auroc")).select("lang", F.round("auroc", 6).alias("auroc"))


@query("SELECT lang, round_even(CAST(list_sort(list(n_chars))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1] AS DOUBLE), 2) AS p50, round_even(CAST(list_sort(list(n_chars))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT) + 1] AS DOUBLE), 2) AS p95 FROM documents GROUP BY lang")
def quantile_nearest_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    p = [evaluate.nearest_rank(d, "v", q, ["lang"]).withColumnRenamed("quantile", n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    return p[0].join(p[1], "lang")


@query(f"""WITH {_LAB}, n AS (SELECT list_sort(list(score)) AS s FROM lab WHERE NOT positive), t AS (SELECT s[CAST(floor(0.95 * (len(s) - 1)) AS BIGINT) + 1] AS thr FROM n)
 SELECT max(thr) AS threshold, round_even(avg(CASE WHEN positive THEN CASE WHEN score > thr THEN 1.0 ELSE 0.0 END END), 3) AS recall, round_even(avg(CASE WHEN positive THEN CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END END), 3) AS positive_any, round_even(avg(CASE WHEN NOT positive THEN CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END END), 3) AS negative_any FROM lab, t""")
def recall_at_fpr(spark, sf_dir):
    return evaluate.recall_at_fpr(labelled(spark, sf_dir))


@query(f"WITH {_LAB} SELECT lang || CASE WHEN positive THEN '+' ELSE '-' END AS key, round_even(avg(score), 3) AS mean_score FROM lab GROUP BY 1")
def mean_score_by_type(spark, sf_dir):
    return evaluate.mean_by_type(labelled(spark, sf_dir), "lang")


@query(f"WITH {_LAB} SELECT doc_id, score FROM lab WHERE NOT positive ORDER BY score DESC, doc_id LIMIT 10")
def top_false_hits(spark, sf_dir):
    """The ten highest-scored negatives: the report's own length."""
    return labelled(spark, sf_dir).filter("NOT positive").select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"WITH {_LAB} SELECT CAST(sum(len(list_intersect(predicted, gold))) AS BIGINT) AS tp, CAST(sum(len(list_filter(predicted, lambda x: NOT list_contains(gold, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(gold, lambda x: NOT list_contains(predicted, x)))) AS BIGINT) AS fn FROM lab")
def step_recovery(spark, sf_dir):
    return evaluate.step_recovery(labelled(spark, sf_dir))


@query("WITH" + EV + " SELECT conv_id, CAST(coalesce(min(CASE WHEN reached >= 4 THEN turn_idx END), -1) AS INTEGER) AS warned_at FROM rs GROUP BY 1")
def early_warning(spark, sf_dir):
    e = evidence(spark, sf_dir).select("conv_id", "turn_idx", F.col("reached").alias("stage_idx"), F.lit(None).cast("string").alias("next"), F.lit(0).alias("confidence"))
    return evaluate.early_warning(e).select("conv_id", F.coalesce("warned_at", F.lit(-1)).alias("warned_at"))


# ---- grounding ---------------------------------------------------------------------------------------------------------

#: Without NFKC, which the checking engine lacks; on these tables NFC gives the same passages.
_NORM = r"""trim(regexp_replace(regexp_replace(translate(lower(nfc_normalize(text)), '’“”', '''""'), '[\p{Z}\s\x0b\x1c-\x1f\x{85}]+', ' ', 'g'), '^[^\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}]+$', '', 'g'))"""


@query(f"WITH b AS (SELECT item_id, {_NORM} AS q FROM benchmark), d AS (SELECT doc_id, {_NORM} AS t FROM documents) SELECT item_id, doc_id FROM b JOIN d ON q <> '' AND contains(t, q)")
def grounding_exact(spark, sf_dir):
    """All benchmark passages found whole in all documents, both normalised after NFKC. The passages are a bounded table."""
    return held(*_normalised(spark, sf_dir))


def _normalised(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Passages (item_id, q) and documents (doc_id, t), written."""

    def normal(c):
        """ASCII texts don't go to Python."""
        ascii_ = F.length(c) == F.octet_length(c)
        return extract.normalise(F.coalesce(extract.nfkc(F.when(~ascii_, c)), c))

    b = table(spark, sf_dir, "benchmark").select("item_id", normal(F.col("text")).alias("q")).filter("q <> ''")
    return b, staged(table(spark, sf_dir, "documents").select("doc_id", normal(F.col("text")).alias("t")), "normal")


_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|\[[\p{L}\p{M}\p{Nd}\p{Pc}]+\]"


@query(f"""WITH b AS (SELECT item_id, {_NORM} AS q FROM benchmark), d AS (SELECT doc_id, {_NORM} AS t FROM documents),
 e AS (SELECT item_id, q, regexp_extract_all(q, '{_WORD}') AS l FROM b), p AS (SELECT item_id, len(l) AS n, list_distinct(l) AS e, len(list_distinct(l)) AS m FROM e WHERE len(l) > 0),
 k AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS tk FROM d), o AS (SELECT doc_id, len(tk) AS big, unnest(tk) AS w, unnest(range(len(tk))) AS pos FROM k),
 x AS (SELECT item_id, n, m, unnest(e) AS w FROM p), h AS (SELECT item_id, doc_id, n, m, big, pos, w FROM x JOIN o USING (w)),
 s AS (SELECT a.item_id, a.doc_id, any_value(a.m) AS m, a.start, count(DISTINCT h.w) AS c FROM (SELECT DISTINCT item_id, doc_id, n, m, least(pos, greatest(0, big - n)) AS start FROM h) a
       JOIN h ON a.item_id = h.item_id AND a.doc_id = h.doc_id AND h.pos BETWEEN a.start AND a.start + a.n + 1 GROUP BY 1, 2, a.start),
 r AS (SELECT item_id, doc_id, max(c / m) AS score FROM s GROUP BY 1, 2 HAVING max(c / m) >= 0.8 - 1e-9 UNION ALL SELECT item_id, doc_id, 1.0 FROM b JOIN d ON q <> '' AND contains(t, q))
 SELECT item_id, doc_id, round(max(score), 6) AS score FROM r GROUP BY 1, 2""")
def grounding_windows(spark, sf_dir):
    """All benchmark passages that documents hold whole or, by four fifths of their tokens, in a window."""
    b, d = _normalised(spark, sf_dir)
    return window_overlaps(b, d).select("item_id", "doc_id", F.round("score", 6).alias("score"))


_QUOTES = [("the officer said to pay the fee now", "The officer said that you pay the full fee right now."), ("share your otp", "Please share your OTP with me."), ("wire nine thousand dollars", "Nothing of the kind was said here."), ("stay on the line and wait", "stay on that line, and please wait")]


@fixture("WITH q(i, e, t) AS (VALUES " + ", ".join(f"({i}, '{e}', '{t.lower()}')" for i, (e, t) in enumerate(_QUOTES)) + r"""), tk AS (SELECT i, e, trim(t, '.') AS t, regexp_extract_all(e, '[a-z0-9_]+') AS et, regexp_extract_all(t, '[a-z0-9_]+') AS tt FROM q),
 w AS (SELECT i, e, t, et, tt, unnest(range(greatest(1, len(tt) - len(et) + 1))) AS s FROM tk)
 SELECT CAST(i AS INTEGER) AS i, round(max(CASE WHEN contains(t, e) THEN 1.0 ELSE len(list_intersect(list_distinct(et), tt[s + 1:s + len(et) + 2]))::DOUBLE / len(list_distinct(et)) END), 6) AS score FROM w GROUP BY i""")
def grounding_window_overlap(spark, sf_dir):
    q = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(_QUOTES)], "i int, e string, t string")
    return q.select("i", F.round(extract.evidence_score(F.col("e"), F.col("t")), 6).alias("score"))


# ---- embeddings --------------------------------------------------------------------------------------------------------

_KNN = """q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 2 = 1), b AS (SELECT label, embedding AS v FROM embeddings WHERE vec_id % 2 = 0),
 s AS (SELECT query_id, label, list_sum(list_transform(list_zip(e, v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS s FROM q, b),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC) AS r FROM s), ls AS (SELECT query_id, label, avg(s) AS score FROM r WHERE r <= 3 GROUP BY 1, 2)"""


def _knn(spark, sf_dir) -> DataFrame:
    """Label scores of every vector: even ids are the exemplar bank, odd ids ask."""
    e = table(spark, sf_dir, "embeddings")
    return semantic.label_scores(e.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.filter("vec_id % 2 = 0").select("label", F.col("embedding").alias("vec")))


@query(f"WITH {_KNN} SELECT query_id, label, round(score, 5) AS score FROM ls")
def knn_label_scores(spark, sf_dir):
    return _knn(spark, sf_dir).select("query_id", "label", F.round("score", 5).alias("score"))


@query(f"WITH {_KNN} SELECT a.query_id, a.label, least(0.85, round_even(0.5 + 5 * (a.score - n.score), 3)) AS confidence FROM ls a JOIN ls n ON n.query_id = a.query_id AND n.label = 0 WHERE a.label <> 0 AND a.score >= 0.2 AND a.score - n.score >= 0.02")
def knn_margin_hits(spark, sf_dir):
    return semantic.margin_hits(_knn(spark, sf_dir), 0, 0.2, 0.02).select("query_id", "label", "confidence")


_GRID = ([0.0, 0.02, 0.05], [0.1, 0.2, 0.3])


@query(f"WITH {_KNN}, x AS (SELECT a.query_id, a.query_id % 3 = 0 AS positive, a.score, n.score AS neg FROM ls a JOIN ls n ON n.query_id = a.query_id AND n.label = 0 WHERE a.label <> 0), g AS (SELECT unnest([0.0, 0.02, 0.05]) AS margin), h AS (SELECT unnest([0.1, 0.2, 0.3]) AS min_sim)," + """
 p AS (SELECT CAST(margin AS DOUBLE) AS margin, CAST(min_sim AS DOUBLE) AS min_sim, query_id, positive, max(CASE WHEN score >= min_sim AND score - neg >= margin THEN least(0.85, round_even(0.5 + 5 * (score - neg), 3)) ELSE 0 END) AS s FROM x, g, h GROUP BY ALL),
 a AS (SELECT m.margin, m.min_sim, round(sum(CASE WHEN m.s > n.s THEN 1.0 WHEN m.s = n.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc FROM p m JOIN p n ON m.margin = n.margin AND m.min_sim = n.min_sim AND m.positive AND NOT n.positive GROUP BY 1, 2),
 bn AS (SELECT margin, min_sim, round(avg(CASE WHEN NOT positive THEN CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END END), 6) AS benign_any FROM p GROUP BY 1, 2) SELECT margin, min_sim, auroc, benign_any FROM a JOIN bn USING (margin, min_sim)""")
def margin_grid_search(spark, sf_dir):
    s = _knn(spark, sf_dir)
    neg = s.filter("label = 0").select("query_id", F.col("score").alias("neg"))
    x = s.filter("label <> 0").join(neg, "query_id").select("query_id", (F.col("query_id") % 3 == 0).alias("positive"), "label", "score", "neg")
    return semantic.grid_search(x, *_GRID).select("margin", "min_sim", F.round("auroc", 6).alias("auroc"), F.round("benign_any", 6).alias("benign_any"))


# ---- extraction on fixtures --------------------------------------------------------------------------------------------

#: Our own lines: (turn, speaker, text). The corpus tables hold none of these cues.
FIXTURE = [
    (0, "caller", "Hello, I am calling from the Harbour Bank security department."),
    (1, "caller", "Your account will be blocked, act right now."),
    (2, "user", "Do not tell anyone my OTP."),
    (3, "caller", "Stay on the line and do not tell anyone about this."),
    (4, "caller", "Please install this app and share your screen."),
    (5, "caller", "Never share your OTP with anyone, we will never ask."),
    (6, "caller", "Tell me the OTP, then pay the processing fee of Rs 499."),
    (7, "caller", "Scan this QR and send the money within 10 minutes."),
    (8, "caller", "Have a nice day."),
]
_SIGNAL_SQL = {
    "AUTHORITY_CLAIM": [r"(?:calling|speaking|ringing|call) (?:you )?(?:\w+ ){0,3}from (?:the )?(?:\w+ ){0,3}(?:bank|police|office|department)"],
    "URGENCY": [r"\b(?:immediately|right now|right away|urgent|urgently|at once)\b", r"\b(?:within|in the next) \d+ ?(?:min|minutes|hours|hrs)\b"],
    "THREAT": [r"\b(?:account|card|sim|number|connection|wallet)\b[^.?!]{0,30}\b(?:blocked|frozen|suspended)\b"],
    "ISOLATION": [r"\bstay on (?:the )?(?:line|call)\b"],
    "SECRECY": [r"\b(?:do not|never) (?:tell|inform) (?:anyone|anybody)\b"],
    "REMOTE_ACCESS": [r"\binstall this app\b|share your screen"],
    "CREDENTIAL_REQUEST": [r"tell me the otp"],
    "PAYMENT_REQUEST": [r"\bpay\b[^.?!]{0,40}\bfee", r"send the money|scan this qr"],
    "SAFETY_ADVICE": [r"never share your otp|never ask"],
}


@fixture("WITH f(i, speaker, text) AS (VALUES " + ", ".join(f"({i}, '{s}', '{t.lower()}')" for i, s, t in FIXTURE) + "), p(signal, p) AS (VALUES " + ", ".join(f"('{s}', '{p}')" for s, ps in _SIGNAL_SQL.items() for p in ps) + ") SELECT DISTINCT CAST(i AS INTEGER) AS turn_idx, signal, CASE WHEN signal IN ('REMOTE_ACCESS','CREDENTIAL_REQUEST','SECRECY','SAFETY_ADVICE') THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM f, p WHERE speaker = 'caller' AND regexp_matches(text, p)")
def rule_signals_fixture(spark, sf_dir):
    t = spark.createDataFrame([("c", *r) for r in FIXTURE], "conv_id string, turn_idx int, speaker string, text string")
    return extract.hits_of(extract.rules(t)).select("turn_idx", "signal", "confidence")


@fixture("SELECT * FROM (VALUES " + ", ".join(f"({i}::INTEGER, '{a}', '{n}')" for i, a, n in ((0, "NONE", "GREETING"), (1, "NONE", "THREATEN"), (2, "NONE", "VICTIM_RESPONSE"), (3, "KEEP_SECRET", "REQUEST_ACTION"), (4, "INSTALL_APP", "REQUEST_ACTION"), (5, "NONE", "REASSURE"), (6, "TRANSFER_MONEY", "REQUEST_ACTION"), (7, "TRANSFER_MONEY", "REQUEST_ACTION"), (8, "NONE", "INFORM"))) + ") t(turn_idx, action, intent)")
def rule_actions_fixture(spark, sf_dir):
    t = spark.createDataFrame([("c", *r) for r in FIXTURE], "conv_id string, turn_idx int, speaker string, text string")
    return extract.rules(t).select("turn_idx", F.col("event.requested_action").alias("action"), F.col("event.communication_intent").alias("intent"))


# ---- generated corpus and the whole analysis ---------------------------------------------------------------------------


@fixture()
def generated_corpus(spark, sf_dir):
    """Families of a generated corpus; hashes decide everything, so SQL elsewhere can't repeat it."""
    t = datagen.turns(datagen.conversations(spark, 10))
    return t.groupBy("family").agg(F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_turns"), F.sum(F.size("spans")).alias("n_spans"))


@fixture()
def generated_languages(spark, sf_dir):
    """Turns of each language of a generated corpus, and how many of them are written in Devanagari."""
    t = datagen.turns(datagen.conversations(spark, 10))
    return t.groupBy("lang").agg(F.count("*").alias("n_turns"), F.sum(F.col("text").rlike(r"\p{IsDevanagari}").cast("long")).alias("n_devanagari"))


@fixture()
def sft_rows(spark, sf_dir):
    t = staged(datagen.gold(datagen.turns(datagen.conversations(spark, 4))), "gold")
    return datagen.sft_rows(t).select("meta.conv", "meta.turn", F.md5(F.to_json("messages").cast("binary")).alias("messages_md5"))


@fixture()
def conversation_analysis(spark, sf_dir):
    """Generated conversations through redaction, extraction, folds, matching and prediction, with a library of other ones."""
    train = datagen.incidents(datagen.turns(datagen.conversations(spark, 12, 7, None, 0.0), 7))
    lib = session.build_library(train, {f: v.label for f, v in datagen.FAMILIES.items()})
    a = session.analyse(staged(datagen.turns(datagen.conversations(spark, 4, 101), 101), "turns").select("conv_id", "turn_idx", "speaker", "text", "at_ms"), lib)
    return session.snapshot(a).select("conv_id", "stage", "progress", "code", "pattern", "match_pct", "novel", "next", "confidence", "evidence_score", "pii_detected")


@fixture()
def conversation_events(spark, sf_dir):
    train = datagen.incidents(datagen.turns(datagen.conversations(spark, 12, 7, None, 0.0), 7))
    lib = session.build_library(train, {f: v.label for f, v in datagen.FAMILIES.items()})
    a = session.analyse(staged(datagen.turns(datagen.conversations(spark, 3, 101), 101), "turns").select("conv_id", "turn_idx", "speaker", "text", "at_ms"), lib)
    return session.events(a).groupBy("type").agg(F.count("*").alias("n"))


def _analysed(spark, sf_dir) -> session.Analysis:
    """All turns of the conversations table, with a library of generated ones. The table has no clock: turns are spaced by the engine's own."""
    train = datagen.incidents(datagen.turns(datagen.conversations(spark, 12, 7, None, 0.0), 7))
    lib = session.build_library(train, {f: v.label for f, v in datagen.FAMILIES.items()})
    return session.analyse(turns(spark, sf_dir).withColumn("at_ms", F.lit(None).cast("long")), lib)


@query()
def conversation_analysis_whole(spark, sf_dir):
    """The whole conversations table through redaction, extraction, folds, matching and prediction."""
    return session.snapshot(_analysed(spark, sf_dir)).select("conv_id", "stage", "progress", "code", "pattern", "match_pct", "novel", "next", "confidence", "evidence_score", "pii_detected")


@query()
def conversation_events_whole(spark, sf_dir):
    return session.events(_analysed(spark, sf_dir)).groupBy("conv_id", "type").agg(F.count("*").alias("n"))


@query()
def rule_extraction_whole(spark, sf_dir):
    """Action, intent and number of signals of every turn of the conversations table, after redaction. The table has no gold labels to report against."""
    t = privacy.redact(turns(spark, sf_dir), "text", "typed", "clean")
    t = extract.rules(t.select("conv_id", "turn_idx", "speaker", "n_pii", F.col("clean").alias("text")))
    return t.select("conv_id", "turn_idx", F.col("event.requested_action").alias("action"), F.col("event.communication_intent").alias("intent"), F.size("event.manipulation_signals").alias("n_signals"), "n_pii")


def _extracted(spark, sf_dir, kind: str) -> DataFrame:
    """Turns are dealt out first: a text costs far more than its move, and a file may be one row group."""
    t = privacy.redact(turns(spark, sf_dir).repartition("conv_id", "turn_idx"), "text", "typed", "clean").select("conv_id", "turn_idx", "speaker", F.col("clean").alias("text"))
    e = extract.build_extractor(kind)(t)
    signals = F.transform("event.manipulation_signals", lambda h: h["signal"])
    return e.select("conv_id", "turn_idx", F.array_join(signals, ",").alias("signals"), F.col("event.requested_action").alias("action"), F.col("event.stage").alias("stage"), F.col("event.confidence").alias("confidence"))


@query()
def semantic_extraction_whole(spark, sf_dir):
    """Signals of every turn of the conversations table by the clauses that lie near exemplars; tests hold it against brute force."""
    return _extracted(spark, sf_dir, "semantic")


@query()
def hybrid_extraction_whole(spark, sf_dir):
    """The same by rules and clauses together."""
    return _extracted(spark, sf_dir, "hybrid")


@query()
def session_prediction(spark, sf_dir):
    """The flagship: every session's code, stage, evidence score, best pattern, next step and confidence."""
    return flagship(spark, sf_dir)


def flagship(spark, sf_dir) -> DataFrame:
    from ..operators import markov, patterns
    from ..functions.sequences import percent

    h = staged(hits(spark, sf_dir), "hits")
    f = folds.fingerprints(h)
    lib = session.build_library(f.withColumn("family", F.concat(F.lit("len"), F.size("steps").cast("string"))))
    stage = folds.turn_evidence(h).groupBy("conv_id").agg(F.max("reached").alias("stage_idx"))
    matched = patterns.best_match(f, lib.patterns, ["conv_id"])
    pred = session._with_prediction(matched, markov.predict(matched, lib.model))
    dna = matched.select("conv_id", F.when(F.size("steps") >= 2, F.col("match_score")).otherwise(0.0).alias("dna_score"))
    score = folds.evidence_scores(h, stage, dna)
    out = pred.join(stage, "conv_id", "left").join(score, "conv_id")
    return out.select("conv_id", dims.step_code(F.col("steps")).alias("code"), dims.stage_name(F.col("stage_idx")).alias("stage"), "score", F.col("pattern_name").alias("pattern"), percent(F.col("match_score")).alias("match_pct"), "next", "confidence")


# ---- stream ------------------------------------------------------------------------------------------------------------


@query(PROGRESS + " SELECT conv_id, CAST(turn_idx AS INTEGER) AS turn_idx, cur AS stage_idx, pr AS progress FROM f WHERE emit")
def streamed_stage_events(spark, sf_dir):
    """The stage events of the batch query, from a stream of the same hits: conversations by id in a few micro-batches."""
    from ..streaming.session import replay_stages

    return replay_stages(hits(spark, sf_dir).select("conv_id", "turn_idx", "signal", "confidence"))


@query()
def streamed_conversation_events(spark, sf_dir):
    """conversation_events_whole from a stream of the whole conversations table, in two parts."""
    from ..streaming import feed

    train = datagen.incidents(datagen.turns(datagen.conversations(spark, 12, 7, None, 0.0), 7))
    lib = session.build_library(train, {f: v.label for f, v in datagen.FAMILIES.items()})
    out = feed.replay(turns(spark, sf_dir).withColumn("at_ms", F.lit(None).cast("long")), lib)
    return out.groupBy(F.col("conv_id").cast("long").alias("conv_id"), "type").agg(F.count("*").alias("n"))


# ---- reports on generated conversations --------------------------------------------------------------------------------


@fixture()
def novelty_leave_family_out(spark, sf_dir):
    """Mean match of each family to a library without it."""
    from . import evaluation

    known = staged(datagen.incidents(datagen.turns(datagen.conversations(spark, 12, 7, None, 0.0), 7)), "known")
    test = staged(datagen.incidents(datagen.turns(datagen.conversations(spark, 4, 101, None, 0.0), 101)), "test")
    return evaluation.leave_families_out(known, test)[0]


@fixture()
def extraction_report(spark, sf_dir):
    """Turns, action and stage accuracy, macro F1 and grounding rate of the rules on generated turns."""
    from . import evaluation

    gold = staged(datagen.gold(datagen.turns(datagen.conversations(spark, 3, 101), 101)), "gold")
    return evaluation.extraction(gold)["totals"]
