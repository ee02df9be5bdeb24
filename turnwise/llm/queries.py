"""The queries op1_ to op13_ over whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(read_table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"))


def op8_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vptree import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), piece_model_path())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def url_given_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's parts that SQL can repeat: host, path, the given rule, and its verdict (null where the mined rules judge)."""
    from .urls import judge

    out = judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("given_verdict"))


def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 by source: documents, size, target (to three decimals) and the words that the mix takes."""
    from .mixing import mix

    out = mix(read_table(spark, sf_dir, "documents")).groupBy("source")
    out = out.agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"))
    return out.select("source", "n_docs", "source_size", F.round("target", 3).alias("target"), "taken")


def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's search at factor 1, where the trees are exact: cosines to nine decimals."""
    from .vptree import nearest

    out = nearest(read_table(spark, sf_dir, "embeddings"), factor=1.0)
    return out.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_simhash, op4_html_text, op5_packing, op6_toxicity, op7_exact_topk, op8_vp_trees, op9_url_rules, op10_mixing, op11_token_counts, op12_filter_audit, op13_collocations)}
#: The parts of operators without SQL of their own that SQL can express.
QUERIES |= {f.__name__: f for f in (url_given_rules, mixing_sources, nearest_exact)}

_LINE_KEYS = r"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
trimmed AS (SELECT doc_id, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM lines),
keyed AS (SELECT doc_id, pos, line, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM trimmed),
holders AS (SELECT k, min(doc_id) AS holder, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT keyed.*, coalesce(n >= 2 AND doc_id <> holder, false) AS falls FROM keyed LEFT JOIN holders USING (k))
"""

ORACLES = {
    "op7_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op2_line_dedup": f"""
WITH {_LINE_KEYS}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (falls) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT falls), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS holder FROM d),
f AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, coalesce(len(words) < 200, true) AS a,
             100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, doc_id > holder AS e
      FROM w LEFT JOIN labels USING (doc_id)),
m AS (SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
             || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM f GROUP BY ALL),
x(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, CAST(s AS INTEGER) AS step, substr(o, s, 1) AS f, string_split(left(o, s - 1), '') AS before FROM orders, range(1, 6) r(s)),
gone AS (SELECT part, good, toxic, fails, n, o, step, f, contains(fails, f) AS hit, len(list_filter(before, lambda y: y <> '' AND contains(fails, y))) > 0 AS went FROM m, steps),
rows AS (SELECT part, o AS filter_order, step, f, sum(n) FILTER (NOT hit AND NOT went) AS kept, sum(n) FILTER (hit AND NOT went) AS removed, sum(n) FILTER (hit AND went) AS redundant,
                sum(n) FILTER (fails = f) AS unique_fails, sum(n) FILTER (hit AND NOT went AND good) AS good_lost, sum(n) FILTER (hit AND NOT went AND toxic) AS toxic_lost
         FROM gone GROUP BY part, o, step, f)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows
""",
    "op13_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))))) AS phrase FROM w),
f AS (SELECT lang, phrase, count(*) AS a, len(string_split(phrase, ' ')) AS m FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
dead AS (SELECT DISTINCT s.lang, s.phrase FROM f s JOIN (SELECT lang, a, m, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' '))))) AS phrase FROM f WHERE m > 2) b
         ON s.lang = b.lang AND s.phrase = b.phrase AND 100 * b.a >= 100 * s.a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
         FROM (SELECT *, unnest(range(1, m)) AS k FROM f ANTI JOIN dead USING (lang, phrase) WHERE m > 1)),
s AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(n AS BIGINT) AS n, CAST((CAST(1000 AS HUGEINT) * c.a * CAST(n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM cuts c JOIN f x ON c.lang = x.lang AND c.first = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase JOIN n ON c.lang = n.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM b)
SELECT * FROM r WHERE rank <= 2000
""",
    "url_given_rules": r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p FROM rules),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS given_verdict
         FROM parts JOIN split ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, given_verdict FROM parts LEFT JOIN fits USING (page_id)
""",
    "mixing_sources": r"""
WITH s AS (SELECT source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, list_value(5.0, 2.0, 1.0)[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
ratios AS (SELECT DISTINCT cap / weight AS ratio FROM w),
levels AS (SELECT ratio,
                  ((SELECT sum(source_size) FROM w) - coalesce(sum(b.cap), 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(b.weight), 0)) AS level
           FROM ratios LEFT JOIN w b ON b.cap / b.weight < ratio GROUP BY ratio),
final AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
t AS (SELECT *, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS exact FROM w, final)
SELECT source, n_docs, source_size, round(exact, 3) AS target, CAST(floor(exact) AS BIGINT) AS taken FROM t
""",
    "nearest_exact": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) / (q.norm * c.norm) AS score
      FROM n q, n c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.norm > 0 AND c.norm > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 9) AS score FROM r WHERE rank <= 5
""",
}
