"""Quality, line dedup, SimHash, HTML, packing, toxicity: against brute force, held-out rows, and on odd tables."""

import hashlib
import html as html_lib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from turnwise.llm import lines, packing, quality, simhash, toxicity
from turnwise.llm import html as pages
from turnwise.llm.queries import ORACLES, QUERIES, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [None, "", " \t ", "one", "a\n\nb\n", "ÀÉ ß x", LONG, "copy of a text here", "copy of a text here"]


def docs(spark, texts, ids=None, extra=True):
    ids = ids if ids is not None else list(range(len(texts)))
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOC)
    return df.withColumnsRenamed({"lang": "score", "source": "h1"}) if extra else df  # names that clash with internal ones


def rng_text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# ---- quality and toxicity ----------------------------------------------------------------------------------------------


def labelled(spark, good, bad, label):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        y = i % 3 != 0
        rows.append((i, (good if y else bad)(rng), y))
    d = docs(spark, [r[1] for r in rows])
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows] + [(None, 1), (5000, 1), (1, None)], f"doc_id long, {label} int")
    return d, labels, rows


def test_quality_learns_and_holds_out(spark):
    d, labels, rows = labelled(spark, lambda r: rng_text(r, 60).capitalize() + ".", lambda r: " | ".join(rng_text(r, 40).split()), "quality")
    out = quality.score_quality(d, labels).collect()
    assert len(out) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    right = [(r.score >= 0.7) == rows[r.doc_id][2] for r in out if r.held_out]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.predicted}


def test_toxicity_learns_and_ignores_groups(spark):
    d, labels, rows = labelled(spark, lambda r: rng_text(r, 40) + " rotter " + rng_text(r, 5), lambda r: rng_text(r, 45), "toxic")
    out = toxicity.score_toxicity(d, labels).collect()
    assert np.mean([(r.score >= 0.5) == rows[r.doc_id][2] for r in out if r.held_out]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def biased(seed, n=400):
    """A corpus in which groups are named almost only by toxic texts, three in ten of which have no other cue."""
    rng, terms = random.Random(seed), toxicity.IDENTITY_TERMS["en"]
    rows = []
    for i in range(n):
        y = i % 2
        named = rng.random() < (0.9 if y else 0.05)
        rows.append((f"{rng_text(rng, 12)}. {rng_text(rng, 3)} {rng.choice(terms[:6]) if named else ''} {'rotter' if y and rng.random() < 0.7 else ''} {rng_text(rng, 4)}.", y))
    return rows, terms[:6]


def test_counterfactual_penalty_spares_neutral_mentions():
    sample, terms = biased(1)
    tied, free = toxicity.train(sample).scorer(), toxicity.train(sample, penalty=0.0).scorer()
    rng = random.Random(2)
    neutral = [f"{rng_text(rng, 6)} {t} {rng_text(rng, 6)}." for t in terms for _ in range(20)]
    toxic = [f"{rng_text(rng, 6)} rotter {rng_text(rng, 6)}." for _ in range(40)]
    assert np.mean([tied(x) >= 0.5 for x in neutral]) < 0.05 < 0.9 < np.mean([free(x) >= 0.5 for x in neutral])
    assert np.mean([tied(x) >= 0.5 for x in toxic]) > 0.95


def test_every_sentence_is_paired():
    pairs = toxicity.swaps("The women sing. Nobody came! Les hommes et les femmes? \n", 1)
    assert [set(a) for a, *_, put_in in pairs if not put_in] == [{"women"}, {"femmes"}, {"hommes"}] and all(not a & b for a, b, *_ in pairs)
    bare = [w for *_, w, put_in in pairs if put_in]
    assert len(bare) == 2 and sum(bare) == 1.0  # one sentence without a name, one without words
    assert toxicity.swaps(None, 1) == []


def brute_ftrl(rows, size, epochs, weight_of, alpha=0.3, beta=1.0, l1=0.1, l2=0.1):
    """Follow-the-regularised-leader as published, one number at a time."""
    import math

    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def w(i):
        k = 0.0 if i == size else l1
        return 0.0 if abs(z[i]) <= k else -(z[i] - math.copysign(k, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for slots, values, y in rows:
            x = [*zip(slots, values), (size, 1.0)]
            ws = {i: w(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(ws[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * weight_of(y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * ws[i]
                n[i] += g * g
    return [w(i) for i in range(size + 1)]


def test_training_is_ftrl():
    from turnwise.llm.ngrams import sparse

    rng = random.Random(12)
    sample = [(rng_text(rng, 9) + (" good" if i % 3 else ""), int(i % 3 > 0)) for i in range(60)]
    got = quality.train(sample, bits=8, epochs=2)
    good = sum(y for _, y in sample)
    want = brute_ftrl([(*(x.tolist() for x in sparse(t, 8)), y) for t, y in sample], 256, 2, lambda y: (60 / (2 * (good if y else 60 - good))) ** 0.5)
    assert got.weights == pytest.approx(want[:-1], abs=1e-5) and got.bias == pytest.approx(want[-1], abs=1e-6)
    t = sample[0][0]
    score = 1 / (1 + np.exp(-(want[-1] + sum(want[i] * v for i, v in zip(*(x.tolist() for x in sparse(t, 8)))))))
    assert 1 / (1 + np.exp(-got.logit(*sparse(t, 8)))) == pytest.approx(score, abs=1e-5)


def test_the_penalty_is_the_gradient_of_squared_differences():
    """One step against the slope found by moving each weight a little."""
    from turnwise.llm.ngrams import Ftrl

    pairs = toxicity.swaps("The women sing. The men of old sang too. Nobody came.", 4)
    of = lambda words: {s for w in words for s in toxicity.word_slots(w, 12)}
    rng = np.random.default_rng(3)
    weights = rng.normal(size=1 << 12)
    loss = lambda w: sum(k * (sum(w[s] for s in of(a)) - sum(w[s] for s in of(b))) ** 2 for a, b, k, _ in pairs)

    class Spy(Ftrl):
        def weight(self, i):
            return weights[i]

        def push(self, i, g, w):
            self.seen = dict(zip(i.tolist(), g.tolist()))

    spy = Spy(1 << 12)
    toxicity._Pairs(pairs, 12).push(spy, 1.0)
    for s, g in spy.seen.items():
        up, down = weights.copy(), weights.copy()
        up[s], down[s] = up[s] + 1e-5, down[s] - 1e-5
        assert g == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-5)


def test_the_sample_is_bounded(spark):
    from turnwise.llm.scoring import labelled_sample

    d = docs(spark, ["a" * 500, "b" * 500, "b" * 400, None, "c" * 5000, "d" * 500], [1, 3, 3, 4, 5, 6])
    labels = spark.createDataFrame([(i, 1) for i in (1, 3, 4, 5, 6)], "doc_id long, quality int")
    full = labelled_sample(d, labels, "quality", 99, 4, 100, text_bytes=1000)
    assert len(full) == 4 and sorted(len(t or "") for t, _ in full)[0] == 0
    assert sum(len(t or "") for t, _ in labelled_sample(d, labels, "quality", 99, 4, 100, text_bytes=1000, total_bytes=900)) <= 900


@pytest.mark.parametrize("score,label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, score, label):
    d = docs(spark, ODD, [None, 1, 2, 3, 4, 5, 6, 7, 7])
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    out = score(d, none).collect()
    assert len(out) == len(ODD) and all(r.score == 0.5 for r in out)
    one = spark.createDataFrame([(1, 1), (3, 1)], f"doc_id long, {label} int")
    assert all(r.score > 0.5 for r in score(d, one).collect())
    assert score(d.limit(0), none).count() == 0


# ---- line dedup --------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: float("inf") if i is None else i
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)] = min(holders.get(key(x), float("inf")), rank(i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= 10 and holders[key(x)] != rank(i))]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (6, 3)])
def test_lines_against_brute_force(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [rng_text(rng, 4) for _ in range(25)] + ["short", "", "  PADDED line of text \t", "padded LINE of text", "É" * 10, "é" * 10]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(None, pool[0] + "\n" + pool[1]), (200, None), (201, ""), (7, pool[2] + "\n" + pool[3]), (300, pool[4] + "\n" + LONG)]
    out = lines.dedup_lines(docs(spark, [t for _, t in rows], [i for i, _ in rows]), batches=batches, fanout=fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == brute_lines(rows)
    assert set(docs(spark, []).columns) < set(out.columns)


def test_lines_of_an_empty_table(spark):
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_runs_compact(spark):
    index = lines.LineRuns(spark, fanout=2)
    for b in range(5):
        index.add(spark.createDataFrame([(h, h, b) for h in range(b, b + 4)], "h1 long, h2 long, holder long"))
    assert len(index.runs) == 2
    assert sorted((r.h1, r.holder) for r in index.table().collect()) == [(h, max(0, h - 3)) for h in range(8)]


# ---- SimHash -----------------------------------------------------------------------------------------------------------


def test_fingerprint_by_hand():
    import xxhash

    text = "The QUICK brown fox the quick brown"
    words = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)


@pytest.mark.parametrize("segments,radius", [(8, 3), (4, 3), (7, 3), (8, 2), (16, 5)])
def test_pairs_are_complete(spark, segments, radius):
    rng = random.Random(segments)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = set(seeds)
    for s in seeds:
        for _ in range(25):
            values.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 2))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    got = [(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), radius, segments).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng_text(rng, 150) for _ in range(6)]
    texts = list(ODD)
    for t in base:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        texts.append(t)
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs(spark, texts, ids)).collect()}
    fp = [simhash.fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3 and ids[i] is not None and ids[j] is not None:
                group = [group[j] if g == group[i] else g for g in group]
    for i, t in enumerate(texts):
        if ids[i] is not None:
            assert out[ids[i], f"{fp[i]:016x}"] == min(ids[k] for k in range(len(texts)) if group[k] == group[i] and ids[k] is not None)
    kept = simhash.keep_one(docs(spark, texts, ids))
    assert kept.columns == docs(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {None} | {c for (d, _), c in out.items() if c is not None and d is not None}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one_of_an_id_with_two_texts(spark):
    d = docs(spark, ["first text of this id", "another text of it", "another text of it", None], [4, 4, 4, None])
    kept = [sorted(str(r) for r in simhash.keep_one(d.repartition(n)).collect()) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


# ---- HTML --------------------------------------------------------------------------------------------------------------


def test_crf_on_unseen_pages():
    rng, wrong, total = random.Random(77), 0, 0
    for _ in range(150):
        h, gold = pages.labelled_page(rng)
        found = pages.parse(h)
        assert len(found.blocks) == len(gold)
        got = pages.model().labels(pages.model().leads(found))
        wrong, total = wrong + sum(a != b for a, b in zip(got, gold)), total + len(gold)
    assert wrong / total < 0.01


def test_viterbi_is_the_best_path():
    crf, rng = pages.model(), random.Random(4)
    h, _ = pages.labelled_page(rng)
    leads = crf.leads(pages.parse(h))[:9]
    score = lambda y: sum(e for e, k in zip(leads, y) if k) + sum(crf.step[a][b] for a, b in zip(y, y[1:]))
    best = max((tuple(m >> t & 1 for t in range(len(leads))) for m in range(1 << len(leads))), key=score)
    assert score(crf.labels(leads)) == score(best)


def test_leads_are_the_sums_of_all_features():
    crf, rng = pages.model(), random.Random(6)
    for _ in range(20):
        page = pages.parse(pages.labelled_page(rng)[0])
        assert crf.leads(page) == [sum(crf.lead[s] for s in slots) for slots in pages.slots_of(page)]


ARTICLE = "<article><p>One sentence of the article. Another one.</p></article>"


@pytest.mark.parametrize("html", ["<html><head><title>t</title><body>" + ARTICLE, "<head><title>t</title>" + ARTICLE, "<head><title>t<body>" + ARTICLE, "<svg><path>" + ARTICLE, "<body><select><option>x" + ARTICLE, ARTICLE + "<p clas", ARTICLE + "<!-- never closed", "<!-- never closed>" + ARTICLE, "<a title='open>x</a>" + ARTICLE, ARTICLE + "<script>var a = 1"])
def test_left_out_ends(html):
    assert "One sentence of the article. Another one." in pages.main_text(html, pages.model())


TOLD = [
    "The committee met on Tuesday to look at the plans for the new bridge, and the members asked for more time.",
    "Engineers said that the old bridge is safe for now, but that it will not carry the traffic of the next ten years.",
    "Nobody at the meeting spoke against the plan, which is to be paid for by the region and in part by the state itself.",
    "A decision is expected in the spring, when the results of the survey are known and the costs have been worked out.",
]
BOXES = ["<div>{}</div>", '<div class="text">{}</div>', '<div id="main">{}</div>', '<div role="main">{}</div>', "<section>{}</section>", '<div class="page"><div class="inner">{}</div></div>', "{}", "<article>{}</article>", "<main>{}</main>", '<div class="story">{}</div>', '<div class="main-content">{}</div>', "<table><tr><td>{}</td></tr></table>", '<div class="xqz7">{}</div>', '<div class="layout"><div class="col-8">{}</div></div>']
AROUND = {
    "none": ("", ""),
    "menu and foot": ('<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', "<footer>&copy; 2020 The Paper</footer>"),
    "side": ('<header><a href="/">Home</a></header>', '<div class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story of the day</a></li></ul></div><footer>&copy; 2020 The Paper</footer>'),
}


@pytest.mark.parametrize("around", sorted(AROUND))
@pytest.mark.parametrize("box", BOXES)
def test_articles_in_any_container(box, around):
    before, after = AROUND[around]
    for title in ("h1", "h2"):
        body = f"<{title}>Bridge plans get more time</{title}>" + "".join(f"<p>{t}</p>" for t in TOLD)
        page = f"<html><head><title>x</title></head><body>{before}{box.format(body)}{after}</body></html>"
        assert pages.main_text(page, pages.model()) == " ".join(["Bridge plans get more time", *TOLD])


def test_quotes_without_an_end_change_no_other_text():
    page = "<article>" + "<p>it's \"so\", said 'x'.</p>" * 200 + "<a href='y>z</a><p>It's the \"end\" of it, in a whole sentence.</p></article>"
    got = pages.main_text(page, pages.model())
    assert got.count("it's \"so\", said 'x'.") == 200


def test_cue_words_tell_blocks_without_classes():
    crf = pages.model()
    page = "<body><div><p>{}</p></div>" + ARTICLE.replace("</p>", "</p>" + "<p>Still more of it, in a whole sentence.</p>" * 3)
    assert pages.main_text(page.format("We use cookies. Consent and subscribe."), crf).startswith("One sentence")


@pytest.mark.parametrize("part,end", [("<div>x y z. ", ""), ("<div class=c>x y z. ", ""), ("<b>", "<h1>x</h1>" * 50_000), ("<div>", "</x></i>" * 50_000), ("<i><div><b>", "</i>" * 50_000), ("<li><p>x", ""), ("<table><tr><td>x", ""), ("<!--", ""), ("<a ", ""), ("<a b='", ""), ("</", ""), ("&", "")])
def test_time_is_linear_in_hostile_pages(part, end):
    start = time.process_time()
    pages.main_text(part * 50_000 + end, pages.model())
    assert time.process_time() - start < 30  # seconds; what grows with the square takes many minutes


def test_pages(spark):
    body = "<article><h1>T &amp; T</h1><p>One  two <b>bold</b>er&nbsp;x<br>next<p>Para with &eacute;<div class=ad>Buy now!</div></article>"
    page = f"<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{body}<footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<<<>&am"), (1, "u", page), (5, "z", "<article><p>" + LONG + "</p></article>"), (6, "q", "<p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = pages.extract(df).collect()
    by = {(r.page_id, r.url): r for r in out}
    assert len(out) == len(rows) and by[1, "u"].text == "T & T One two bolder x next Para with é"
    assert by[2, None].text == by[3, "v"].text == "" and by[2, None].n_chars == 0
    assert by[5, "z"].text == LONG.strip() and by[5, "z"].n_chars == len(LONG.strip())
    assert pages.extract(df.limit(0)).count() == 0


def test_corpus_pages_keep_articles(spark):
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    for r in df.collect():
        a = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", a))).split())


# ---- packing -----------------------------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    assert sum(r.length for r in rows) == sum(map(len, want))
    by_seq, padding = {}, 0
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return want, padding


def test_packing_round_trip(spark):
    rng = random.Random(9)
    texts = [rng_text(rng, rng.choice((1, 20, 400, 3000, 9000))) for _ in range(60)] + ODD + ["it's <|endoftext|> NASA's\x1cx x²y"]
    rows = packing.pack(docs(spark, texts), tokenizer_path(), shard_docs=25).collect()
    want, padding = check_packing(rows, texts)
    assert padding < 4 * 4096
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in enumerate(want):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_holds_a_slice_of_a_batch():
    """What a worker holds beside a batch follows from SLICE, not from the batch, and what it remembers is bounded in bytes."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    texts = pa.array([" ".join(rng.choices(["alpha", "Beta,", "gamma", "it's", "x2"], k=4000)) for _ in range(1200)], pa.string())
    assert texts.nbytes > 4 * packing.SLICE
    tokens = packing.WordTokens(tokenizer_path())
    tracemalloc.start()
    for _ in tokens.of_texts(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak
    for _ in tokens.of_texts(pa.array(["".join(rng.choices("日本語の文", k=200_000)) for _ in range(12)], pa.string())):
        pass
    assert tokens.odd.words.nbytes <= packing.REMEMBERED


def test_packing_slices_and_long_texts(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE", 300)
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    rng = random.Random(4)
    texts = [None, "", *ODD, "é日 " * 400, "x" * 1000, "日" * 500 + " \n" + "it's " * 200, " " * 900, "word  " * 150 + "end", "a" * 300, "a" * 299 + " b"]
    texts += [rng_text(rng, rng.choice((1, 20, 400, 3000))) for _ in range(40)] + [None]
    t = Tokenizer.from_file(tokenizer_path())
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    tokens = packing.WordTokens(tokenizer_path())
    for given in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["before", *texts, "after"], pa.string())[1:-1]):
        assert [np.frombuffer(x, dtype="<u2").tolist() for x in tokens.of_texts(given)] == want
    assert [np.frombuffer(tokens(x), dtype="<u2").tolist() for x in texts] == want


def test_packing_odd_tables(spark):
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0
    rows = packing.pack(docs(spark, ["a b", None, "a b"], [None, 3, None]), tokenizer_path()).collect()
    assert sum(r.length for r in rows) == 7 and {r.doc_tokens for r in rows if r.doc_id is None} == {3} and {r.doc_tokens for r in rows if r.doc_id == 3} == {1}


def test_packing_many_rows_of_one_id(spark):
    """Null ids and one id ten thousand times stay where they are read; no task gathers them."""
    texts, ids = ["a b c"] * 10_000 + [f"{i} words" for i in range(3000)], [7] * 10_000 + [None] * 3000
    df = docs(spark, texts, ids).repartition(6)
    out = packing.pack(df, tokenizer_path(), shard_docs=500)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    check_packing(out.collect(), [r.text for r in df.collect()])


def test_assign_balances_cost():
    lengths = sorted([900, 700, 500, 500, 300, 200, 100, 50, 30, 16], reverse=True)
    caps = packing.capacities(sum(lengths), 1024)
    out = packing.assign(lengths, caps)
    used = [0] * len(caps)
    for i, start, n, k, offset in out:
        assert offset == used[k]
        used[k] += n
    assert sum(used) == sum(lengths) and all(u <= c for u, c in zip(used, caps))
    assert sum(caps) - sum(lengths) < 1024 / 8


def test_queries_digest(spark):
    out = QUERIES["op2_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    d = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute_lines(list(d.items()))}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in out} == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(*want.columns).collect()), key=repr)
    assert rows and rows == sorted(want.fetchall(), key=repr)
