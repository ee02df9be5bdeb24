"""Token counts, filter audit and collocations: against the library, brute force and DuckDB, and on odd tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from turnwise.llm import audit, phrases, tokencount
from turnwise.llm.common import LOWER_MAP
from turnwise.llm.queries import QUERIES, piece_model_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "  \t ", "one", "a\n\nb\n", "ÀÉ ß x", "日本語🎉​", "word " * 30_000, "a" * 20_000, "copy of a text", "copy of a text"]


def docs(spark, texts, langs=None, ids=None):
    rows = [(i, t, x, "s", 0) for i, t, x in zip(ids if ids is not None else range(len(texts)), texts, langs or ["en"] * len(texts))]
    return spark.createDataFrame(rows, DOC).withColumnsRenamed({"source": "part", "n_chars": "mask"})  # names that clash with internal ones


# ---- token counts --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def counts():
    return tokencount.TokenCounts(piece_model_path())


def random_texts(model, n=1500):
    rng, pieces = random.Random(4), None
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.get_piece_size())]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    out += ["".join(rng.choice("etaoin the-_=/*") for _ in range(rng.randint(1, 300))) for _ in range(n)]
    out += ["".join(rng.choice(rng.choice(["aab", "*=", "  ▁", "naeé", "()", ".._", "ABcdefghij"])) for _ in range(rng.randint(1, 1500))) for _ in range(n // 5)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0x500), rng.randint(0x3000, 0x9FFF), rng.randint(0x1F300, 0x1F600)])) for _ in range(40)) for _ in range(n // 5)]


def test_counts_equal_the_library(model, counts):
    texts = [t for t in ODD if t] + ["a" * 1000, " " * 1000, "=" * 997, "x\0y", "▁" * 50 + "the", "<s></s><unk><0x41>", "ab" * 5000] + random_texts(model)
    assert counts.of_texts(pa.array(texts, pa.string())).tolist() == [len(x) for x in model.encode(texts)]


@pytest.mark.parametrize("window, chunk", [(5, 3), (64, 16), (1000, 64)])
def test_windows_and_chunks_change_nothing(model, counts, monkeypatch, window, chunk):
    monkeypatch.setattr(tokencount, "WINDOW", window)
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    monkeypatch.setattr(tokencount, "STATES", 50)
    texts = random_texts(model, 60) + ["=" * 300, " " * 200, "x"]
    assert counts.of_texts(pa.array(texts, pa.string())).tolist() == [len(x) for x in model.encode(texts)]


def test_scan_composes_maps():
    rng = np.random.default_rng(1)
    to, n = rng.integers(0, 3, (40, 3)), rng.integers(0, 5, (40, 3))
    first = np.repeat([0, 7, 8, 30], [7, 1, 22, 10])
    whole, total = tokencount.scan(to, n, first)
    for i in range(40):
        for k in range(3):
            at, s = k, 0
            for j in range(first[i], i + 1):
                s, at = s + n[j, at], to[j, at]
            assert (whole[i, k], total[i, k]) == (at, s)


def test_the_transducer_follows_the_merge_rule(counts):
    merges, rng = counts.machine.merges, random.Random(2)
    pieces = [p for p in merges.scores if merges.proper(p)]
    for a, b in ((rng.choice(pieces), rng.choice(pieces)) for _ in range(3000)):
        assert merges.neighbours(a, b) == (merges.encode(a + b) == [a, b])


def test_token_counts_of_odd_rows(spark, model):
    rows = docs(spark, ODD, ids=[None, 1, 1, *range(3, len(ODD))])
    got = tokencount.count_tokens(rows, piece_model_path(), limit=3).collect()
    assert [r.doc_id for r in got] == [None, 1, 1, *range(3, len(ODD))]
    for r, t in zip(got, ODD):
        n = len(model.encode(t)) if t else 0
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 3)
    assert tokencount.count_tokens(rows.limit(0), piece_model_path()).collect() == []


def test_query_counts_whole_table(spark, model):
    got = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows) and all(got[r.doc_id].n_tokens == len(model.encode(r.text)) for r in rows)


# ---- filter audit --------------------------------------------------------------------------------------------------------


def fails(rows):
    """Names of the filters that each (id, text) fails, by their definitions."""
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows)
        out.append("".join(f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)) if bad))
    return out


def plain_audit(rows, langs, good, toxic):
    out, failed = {}, fails(rows)
    for part in {x or "" for x in langs}:
        mine = [k for k, x in enumerate(langs) if (x or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in failed[k]}
                redundant = sum(f in failed[k] for k in set(mine) - left)
                left -= gone
                out[part, order, step] = [len(left), len(gone), redundant, sum(failed[k] == f for k in mine), len(gone & good), len(gone & toxic)]
    for part in {p for p, _, _ in out}:
        for f in "ABCDE":
            share = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(share)
    return out


def test_audit_equals_every_order_played_through(spark):
    rng = random.Random(5)
    texts, langs, ids = [], [], []
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d%", "épsilon", "x\ty", f"w{rng.randint(0, 400)}"]) for _ in range(rng.choice([0, 3, 210, 300]))]
        texts.append(" ".join(words) if rng.random() < 0.7 or not texts else rng.choice(texts))
        langs.append(rng.choice(["en", "de", None, ""]))
        ids.append(i if rng.random() < 0.8 else rng.choice([None, 3, 4]))
    texts[7], texts[8] = None, ""
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0)]
    mark = lambda k: {i: min(x[k] for x in labels if x[0] == i and x[k] is not None) for i in {x[0] for x in labels if x[0] is not None and x[k] is not None}}
    quality, toxicity = mark(1), mark(2)
    want = plain_audit(list(zip(ids, texts)), langs, {k for k, i in enumerate(ids) if quality.get(i) == 1}, {k for k, i in enumerate(ids) if toxicity.get(i) == 1})
    got = audit.audit(docs(spark, texts, langs, ids), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == want and len(got) == len(want) == 600 * len({x or "" for x in langs})


def test_parity_sums_invert_exactly(spark):
    rng = random.Random(6)
    rows = [("p", rng.random() < 0.5, rng.random() < 0.5, m, rng.randint(0, 10**12)) for m in range(32) for _ in range(2)]
    sums = audit.parity_sums(spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long"))
    got = sums.select(*[audit.cells(sums[c]).alias(c) for c in audit.LABELS]).first()
    assert len(sums.first()["all"]) == 32
    for label, want in (("all", lambda r: True), ("good", lambda r: r[1]), ("toxic", lambda r: r[2])):
        assert got[label] == [sum(r[4] for r in rows if r[3] == m and want(r)) for m in range(32)]


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs(spark, ["x"]).limit(0), none).collect() == []
    assert audit.audit(docs(spark, ["x"]), none).count() == 600


# ---- collocations --------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOWER_MAP)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    out = []
    for lang in n:
        found = {p: a for p, a in f[lang].items() if a >= least and len(p) > 1}
        dead = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= found[p[i:j]]}
        best = []
        for p, a in found.items():
            if p not in dead:
                s, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def phrase_rows(seed=8, n=300):
    rng = random.Random(seed)
    common = ["as a matter of fact", "New York city", "new york", "é à", "x x x x x x", "  😀 z"]
    rows = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.3 else rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "en", "de", None, ""]), "".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n"]) for w in words)))
    return rows + [("en", None), ("en", ""), ("fr", " .. "), ("en", "as a matter of fact " * 500)] + [("de", "the same line for all to see")] * 40


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50, "range_paths": 20}])
def test_collocations_equal_brute_force(spark, sizes):
    rows = phrase_rows()
    d = docs(spark, [t for _, t in rows], [x for x, _ in rows]).withColumnRenamed("part", "words").repartition(7)
    for least, top in ((8, 2000), (20, 5)):
        got = phrases.collocations(d, least=least, top=top, **sizes).collect()
        assert sorted(map(tuple, got)) == plain_collocations(rows, least, top)


def test_tries_count_alike_in_any_windows(monkeypatch):
    data = ("one two, three. four five\n" * 20 + "no cut here " * 30 + ". end").encode()
    monkeypatch.setattr(phrases, "WINDOW", 64)
    cuts = list(phrases._windows(np.frombuffer(data, np.uint8), np.array([0, 100, 100, len(data)])))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert all(stop in (100, len(data)) or data[stop - 1 : stop] in b".,;:!?\n" for _, stop in cuts) and len(cuts) > 5


def test_scores_beyond_64_bits_are_exact(spark):
    big = 10**13
    rows = [("en", [], 9 * big, []), ("en", ["a"], big + 7, []), ("en", ["b"], big + 3, []), ("en", ["a", "b"], big + 1, [big + 7])]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words array<string>, f long, lefts array<long>")).first()
    assert got.score == 1000 * (big + 1) * 9 * big // ((big + 7) * (big + 3)) and (got.l, got.r) == (big + 7, big + 3)


def test_no_texts_no_phrases(spark):
    assert phrases.collocations(docs(spark, ["x"]).limit(0)).collect() == []
    assert phrases.collocations(docs(spark, [None, "", " . "])).collect() == []
