"""kNN-margin signal classifier over embeddings, clause splitting, exemplar banks, and the stages made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims
from ..sources.stage import is_small, staged
from . import encode, extract

#: For the vectors of ``encode``: how similar a clause must be to a label's exemplars, and by how much more than to those of none.
MIN_SIM, MARGIN, NEAREST = 0.35, 0.05, 1
#: A bank of at most so many exemplars and bytes goes to every task (16 MB of vectors); a larger one meets the clauses in a join of blocks.
BANK_ROWS, BANK_BYTES = 4_096, 4 << 20

SUBCLAUSE = r"(?i),\s+|\s+(?:and then|then|aur phir|phir|aur|and)\s+"  # fixed values: what parts a sentence
TRIM = " .?!;"


def clauses(text: Column, min_words: int = 3) -> Column:
    """Sentences of at least three words and, after each, its parts of that length; all are substrings of the text."""
    sentences = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.?!।;\n]+(?:[.?!।;]+|$)"), 0), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: F.length(s) > 0)
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0))

    def both(s: Column) -> Column:
        whole = F.btrim(s, F.lit(TRIM))
        parts = F.transform(F.split(s, SUBCLAUSE), lambda p: F.btrim(p, F.lit(" ,.?!;")))
        parts = F.filter(parts, lambda p: (words(p) >= min_words) & (p != whole))
        return F.concat(F.when(words(whole) >= min_words, F.array(whole)).otherwise(F.array().cast("array<string>")), parts)

    return F.flatten(F.transform(sentences, both))


def label_scores(queries: DataFrame, bank: DataFrame, k: int = 3, block: int = 2048) -> DataFrame:
    """query_id, label, score: the mean of each query's k largest dot products with a label's exemplars.

    Queries (query_id, vec) and bank (label, vec) are packed into arrays of about ``block`` vectors of one length, numbered
    by a hash of vector and row, so that copies are spread. Each array of queries meets each array of a label in an
    equi-join on its number; a pair is one matrix product in double precision and gives every query's k largest, so a
    label's exemplars never stand in one task. Vectors that are null, empty or hold a null take no part.
    """
    sized = lambda d: d.withColumn("dim", F.size("vec")).filter((F.col("dim") > 0) & ~F.exists("vec", lambda x: x.isNull()))
    bank = sized(bank.select("label", F.col("vec").cast("array<double>").alias("vec")))
    asked = sized(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")))
    schema = T.StructType([asked.schema["query_id"], bank.schema["label"], T.StructField("s", T.DoubleType())])
    sizes, packed = _packed(bank, ["label", "dim"], block, F.collect_list("vec").alias("vecs"))
    _, blocks = _packed(asked, ["dim"], block, F.collect_list("query_id").alias("ids"), F.collect_list("vec").alias("asked"))
    blocks = blocks.drop("part").join(sizes, "dim")  # one row for each label: labels are a closed vocabulary
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def products(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch["dim"][i].as_py()
                q, v = (batch[c].slice(i, 1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in ("asked", "vecs"))
                s = q @ v.T
                if s.shape[1] > k:
                    s = np.partition(s, s.shape[1] - k, axis=1)[:, -k:]
                n = s.shape[1]
                at = pa.array(np.repeat(np.arange(len(s)), n))
                yield pa.RecordBatch.from_arrays([batch["ids"].slice(i, 1).flatten().take(at), batch["label"].take(pa.array(np.full(len(at), i))), pa.array(s.ravel())], ["query_id", "label", "s"])

    per = blocks.join(packed, ["label", "dim", "part"]).mapInArrow(products, schema)
    r = F.row_number().over(W.partitionBy("query_id", "label").orderBy(F.desc("s")))
    return per.withColumn("r", r).filter(F.col("r") <= k).groupBy("query_id", "label").agg(F.avg("s").alias("score"))


def _packed(vectors: DataFrame, key: list[str], block: int, *lists: Column) -> tuple[DataFrame, DataFrame]:
    """How many parts each key has, and the vectors of each key and part, about ``block`` of them, as lists."""
    vectors = staged(vectors.withColumn("__row", F.monotonically_increasing_id()), "vectors")  # written, so that a row's number stays
    sizes = vectors.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("parts"))
    numbered = vectors.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("vec", "__row"), F.col("parts")))
    return sizes, numbered.groupBy(*key, "part").agg(*lists)


def margin_hits(scores: DataFrame, none_label="NONE", min_sim: float = 0.80, margin: float = 0.02) -> DataFrame:
    """query_id, label, score, confidence where a label is similar enough and by a margin more so than the none label."""
    neg = scores.filter(F.col("label") == F.lit(none_label)).select("query_id", F.col("score").alias("neg"))
    j = scores.filter(F.col("label") != F.lit(none_label)).join(neg, "query_id")
    j = j.filter((F.col("score") >= min_sim) & (F.col("score") - F.col("neg") >= margin))
    return j.select("query_id", "label", "score", confidence(F.col("score"), F.col("neg")).alias("confidence"))


def confidence(score: Column, neg: Column) -> Column:
    """How sure a hit is, from by how much its score exceeds the none label's."""
    return F.least(F.lit(0.85), F.bround(0.5 + 5 * (score - neg), 3))


def best_clause(hits: DataFrame, key: tuple[str, ...] = ("conv_id", "turn_idx")) -> DataFrame:
    """The key's columns, signal, evidence, confidence from clause hits (…, clause, ord): the strongest clause of each signal."""
    g = hits.groupBy(*key, F.col("label").alias("signal"))
    return g.agg(F.max_by("clause", F.struct("confidence", -F.col("ord"))).alias("evidence"), F.max("confidence").alias("confidence"))


def grid_search(queries: DataFrame, margins: list[float], sims: list[float]) -> DataFrame:
    """margin, min_sim, auroc, benign_any for each setting over (query_id, positive, label, score, neg), best first by auroc then fewest benign hits.

    A query's score under a setting is its largest confidence; the grid multiplies rows by its own, fixed size.
    """
    from .evaluate import auroc

    spark = queries.sparkSession
    grid = spark.createDataFrame([(m, s) for m in margins for s in sims], "margin double, min_sim double")
    x = queries.join(F.broadcast(grid), F.lit(True))
    hit = (F.col("score") >= F.col("min_sim")) & (F.col("score") - F.col("neg") >= F.col("margin"))
    conf = F.when(hit, confidence(F.col("score"), F.col("neg"))).otherwise(0.0)
    per = x.groupBy("margin", "min_sim", "query_id", "positive").agg(F.max(conf).alias("s"))
    any_ = per.groupBy("margin", "min_sim").agg(F.avg(F.when(~F.col("positive"), (F.col("s") > 0).cast("double"))).alias("benign_any"))
    return auroc(per, "s", "positive", ["margin", "min_sim"]).join(any_, ["margin", "min_sim"]).orderBy(F.desc("auroc"), "benign_any", "margin", "min_sim")


def exemplars(rendered: DataFrame, victims: DataFrame) -> DataFrame:
    """Distinct (text, label) from rendered templates (text, spans(signal, evidence)) and victims' lines: spans are positives, the rest NONE."""
    trim = lambda c: F.btrim(c, F.lit(" ,.?!;"))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0))
    pos = rendered.select(F.inline("spans")).select(trim(F.col("evidence")).alias("text"), F.col("signal").alias("label"))
    rest = F.aggregate("spans", F.col("text"), lambda t, s: F.replace(t, s["evidence"], F.lit(" | ")))
    neg = rendered.select(F.explode(F.split(rest, r" \| ")).alias("text")).filter(words(F.col("text")) >= 3).union(victims.select("text"))
    every = pos.union(neg.select(trim(F.col("text")), F.lit("NONE")))
    return every.filter(words(F.col("text")) >= 2).distinct()


def semantic_event(hits: Column, speaker: Column) -> Column:
    """The event of kNN hits (array of signal, evidence, confidence); safety advice takes credential requests and secrecy out."""
    safe = F.exists(hits, lambda h: h["signal"] == "SAFETY_ADVICE")
    kept = F.array_sort(F.filter(hits, lambda h: ~(safe & h["signal"].isin("CREDENTIAL_REQUEST", "SECRECY"))))
    kept = F.when(speaker == "caller", kept).otherwise(F.array().cast(extract.HITS))
    signals = F.transform(kept, lambda h: h["signal"])
    action = extract.first_by_priority(extract.default_actions(signals))
    said = F.when(speaker == "user", "VICTIM_RESPONSE").when(action != "NONE", "REQUEST_ACTION").otherwise("INFORM")
    return F.struct(F.lit("UNKNOWN").alias("actor_claim"), said.alias("communication_intent"), kept.alias("manipulation_signals"), action.alias("requested_action"), dims.consequence_of(action).alias("financial_consequence"), extract.stage_of(signals).alias("stage"), F.array().cast(extract.ENTITIES).alias("entities"), F.coalesce(F.array_max(F.transform(kept, lambda h: h["confidence"])), F.lit(0.0)).alias("confidence"), F.lit("llm").alias("source"))


def hybrid_event(rules: Column, semantic: Column) -> Column:
    """Rules and semantic events merged, with the rules' actor and intent."""
    m = extract.merge(rules, semantic)
    return m.withField("actor_claim", rules["actor_claim"]).withField("communication_intent", rules["communication_intent"])


def default_bank(spark) -> DataFrame:
    """Exemplars (text, label) of the wordings that come with the engine."""
    from ..plans import datagen

    t = datagen.turns(datagen.conversations(spark, 12, 7, None, 0.0), 7)
    return exemplars(t.filter("speaker = 'caller'").select("text", "spans"), t.filter("speaker = 'user'").select("text"))


def clause_hits(turns: DataFrame, bank: DataFrame, k: int = NEAREST, min_sim: float = MIN_SIM, margin: float = MARGIN, key: tuple[str, ...] = ("conv_id", "turn_idx")) -> DataFrame:
    """The key's columns, signal, evidence, confidence: the strongest clause of each signal in each caller's turn, for a bank of any size.

    Clauses are exploded and each distinct one is embedded and compared with the bank once, in blocks; hits go back to
    all places where a clause stands. The evidence is a substring of the turn.
    """
    said = turns.filter("speaker = 'caller' AND text IS NOT NULL").select(*key, F.posexplode(clauses(F.col("text"))).alias("ord", "clause"))
    said = staged(said, "clauses")
    asked = said.select(F.col("clause").alias("query_id")).distinct().withColumn("vec", encode.embed(F.col("query_id")))
    known = bank.select("label", encode.embed(F.col("text")).alias("vec"))
    hits = margin_hits(label_scores(asked, known, k), "NONE", min_sim, margin).withColumnRenamed("query_id", "clause")
    return best_clause(said.join(hits, "clause"), key)


NEAR = "array<struct<signal:string,evidence:string,score:double,neg:double,ord:int>>"


def near_exemplars(turns: DataFrame, said: str, bank: DataFrame, k: int = NEAREST, min_sim: float = MIN_SIM, margin: float = MARGIN, block: int = 1024) -> DataFrame:
    """turns with ``__near`` instead of their array of clauses: those that ``margin_hits`` has, for a bank that ``is_small``.

    The bank's vectors go to every task. Clauses are embedded where they are and compared with the bank by one matrix
    product a block, so no vector is written or shuffled, and a clause that many turns share makes no hot key.
    """
    rows = sorted((r["label"], r["text"] or "") for r in bank.filter("label IS NOT NULL").select("label", "text").collect())
    labels = sorted({label for label, _ in rows})
    starts = [next(i for i, r in enumerate(rows) if r[0] == label) for label in labels]
    known, none = encode.vectors([t for _, t in rows]), labels.index("NONE") if "NONE" in labels else None

    def scores(texts: list[str]) -> np.ndarray:
        s = encode.vectors(texts) @ known.T
        if k == 1:
            return np.maximum.reduceat(s, starts, axis=1)
        parts = np.split(s, starts[1:], axis=1)
        return np.stack([(np.partition(p, p.shape[1] - k, axis=1)[:, -k:] if p.shape[1] > k else p).mean(axis=1) for p in parts], axis=1)

    def hits(texts: list[str]) -> Iterator[tuple[int, str, float, float]]:
        """Number of the text, label, score and none label's score of each hit."""
        for i in range(0, len(texts) if none is not None else 0, block):
            s = scores(texts[i : i + block])
            hit = (s >= min_sim) & (s - s[:, [none]] >= margin)
            hit[:, none] = False
            for at, j in zip(*np.nonzero(hit)):
                yield i + int(at), labels[j], float(s[at, j]), float(s[at, none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code: dict[str, int] = {}
            place = [(row, i, code.setdefault(c, len(code))) for row, cs in enumerate(b[said].to_pylist()) for i, c in enumerate(cs or ())]
            texts, found = list(code), {}
            for at, *hit in hits(texts):
                found.setdefault(at, []).append(hit)
            near: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for row, i, c in place:
                for label, score, neg in found.get(c, ()):
                    near[row].append({"signal": label, "evidence": texts[c], "score": score, "neg": neg, "ord": i})
            kind = pa.list_(pa.struct({"signal": pa.string(), "evidence": pa.string(), "score": pa.float64(), "neg": pa.float64(), "ord": pa.int32()}))
            rest = [n for n in b.schema.names if n != said]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in rest), pa.array(near, kind)], [*rest, "__near"])

    schema = T.StructType([*(f for f in turns.schema if f.name != said), T.StructField("__near", T._parse_datatype_string(NEAR))])
    return turns.mapInArrow(run, schema)


def strongest(near: Column) -> Column:
    """The hits (signal, evidence, confidence) of a turn from those of ``near_exemplars``: each signal's strongest clause, the first of equals."""
    rated = F.transform(near, lambda h: F.struct(h["signal"].alias("signal"), (-confidence(h["score"], h["neg"])).alias("less"), h["ord"].alias("ord"), h["evidence"].alias("evidence")))
    kept = F.aggregate(F.array_sort(rated), F.array().cast("array<struct<signal:string,less:double,ord:int,evidence:string>>"), lambda a, h: F.when(F.exists(a, lambda o: o["signal"] == h["signal"]), a).otherwise(F.array_append(a, h)))
    return F.transform(kept, lambda h: F.struct(h["signal"].alias("signal"), h["evidence"].alias("evidence"), (-h["less"]).alias("confidence")))


def semantic_extractor(bank: DataFrame | None = None, **options) -> extract.Extractor:
    """A stage turns -> turns with the event of the clauses that lie near exemplars of a signal. A bank that is small goes to the turns; a larger one meets their distinct clauses in a join."""

    def stage(turns: DataFrame) -> DataFrame:
        known = staged(default_bank(turns.sparkSession) if bank is None else bank.select("text", "label"), "bank")
        if is_small(known, BANK_ROWS, BANK_BYTES):
            t = turns.withColumn("__said", F.when(F.col("speaker") == "caller", clauses(F.col("text"))))
            t = near_exemplars(t, "__said", known, **options).withColumn("__hits", strongest(F.col("__near"))).drop("__near")
        else:
            t = staged(turns.withColumn("__row", F.monotonically_increasing_id()), "turns")  # written, so that a row's number stays
            per = clause_hits(t, known, **options, key=("__row",)).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("signal", "evidence", F.col("confidence").cast("double").alias("confidence")))).alias("__hits"))
            t = t.join(per, "__row", "left")
        t = t.withColumn("__hits", F.coalesce("__hits", F.array().cast(extract.HITS)))
        return t.select(*turns.columns, semantic_event(F.col("__hits"), F.col("speaker")).cast(extract.EVENT).alias("event"))

    return stage


def hybrid_extractor(bank: DataFrame | None = None, **options) -> extract.Extractor:
    """A stage whose event is that of the rules, merged with the semantic one."""

    def stage(turns: DataFrame) -> DataFrame:
        ruled = extract.rules(turns).withColumnRenamed("event", "__rules")
        both = semantic_extractor(bank, **options)(ruled)
        return both.withColumn("event", hybrid_event(F.col("__rules"), F.col("event")).cast(extract.EVENT)).drop("__rules")

    return stage


extract.register_extractor("semantic", lambda turns: semantic_extractor()(turns))
extract.register_extractor("hybrid", lambda turns: hybrid_extractor()(turns))
