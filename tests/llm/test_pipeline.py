"""The pipeline's stages: each against a plain version on its own input."""

import corpus_pipeline as p
from tests.llm.test_search_and_mixing import brute_targets
from tests.llm.test_text_operators import brute_lines, check_packing
from turnwise.llm import quality, simhash
from turnwise.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    out = {}
    for name, stage in p.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), name)
        out[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns

    before, after = out["quality"]
    good = {r.doc_id for r in quality.score_quality(spark.createDataFrame(before), spark.read.parquet(f"{SF}/labels.parquet")).filter("score >= 0.7").collect()}
    assert {r.doc_id for r in after} == good and len(after) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in good for i in clean) / len(clean) > 0.95

    before, after = out["line_dedup"]
    want = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    before, after = out["near_dedup"]
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in before}
    root = {i: i for i in fp}
    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    assert {r.doc_id for r in after} == set(root.values())
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()

    before, after = out["mixing"]
    words = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in before}}
    target, took, texts = brute_targets(words(before)), words(after), {r.doc_id: r.text for r in before}
    assert all(abs(took[s] - target[s]) <= 1.001 for s in target)
    assert all(texts[r.doc_id].strip().startswith(r.text.strip()) for r in after)

    before, after = out["packing"]
    check_packing(after, [r.text for r in before])


def test_run_on_an_empty_folder(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
