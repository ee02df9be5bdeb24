"""Exact and approximate search, URL filters and mixing: against brute force, and on odd tables."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import mixing, topk, urls, vptree

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VEC).withColumnRenamed("label", "score").selectExpr("*", "1 AS rank", "2 AS dim")


def sample(n=700, dim=16, seed=3, same=150):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = (centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, dim))).astype(np.float32)
    v[n - same :] = v[0]  # one very common vector
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(7000, None), (7100, []), (7200, [1.0, None] + [0.0] * (dim - 2)), (7300, [float("nan")] * dim), (7400, [float("inf")] * dim), (None, rows[3][1]), (7500, [1.0, 2.0]), (7600, [2.0, 1.0]), (20, rows[5][1])]
    return rows, odd


def brute_topk(rows, k, every):
    live = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in live:
        if i % every == 0:
            first[i] = min(first.get(i, v), v)
    out = set()
    for q, qv in first.items():
        found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in live if i != q and len(v) == len(qv))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("big", [9, 1e5, 1e8, 1e9, 3e9, 1e12, 1e15, 9e18])
def test_scores_are_exact_over_all_longs(big):
    rng = np.random.default_rng(1)
    q, c = (np.clip(np.floor(rng.uniform(-big, big, (n, 64))), -(2.0**63) + 1024, 2.0**63 - 1024) for n in (9, 30))
    s, over = topk._scores(q, c)
    for i in range(9):
        for j in range(30):
            want = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[j].tolist()))
            if -(2**63) <= want < 2**63:
                assert s[i, j] == want and not (over is not None and over[i, j])
            else:
                assert over[i, j] and s[i, j] == (2**63 - 1 if want > 0 else -(2**63))


def test_topk_of_wide_components(spark):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.uniform(-1e6, 1e6))) for _ in range(16)]) for i in range(90)]
    out = topk.top_k(vectors(spark, rows), every=10, query_rows=4, block_rows=30).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out} == brute_topk(rows, 10, 10)


@pytest.mark.parametrize("k,block", [(10, 100), (3, 5000), (900, 200)])
def test_topk_against_brute_force(spark, k, block):
    rows, odd = sample(400 if k < 100 else 120)
    out = topk.top_k(vectors(spark, rows + odd), k=k, every=50, query_rows=3, block_rows=block).collect()
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in out}
    want = brute_topk(rows + odd, k, 50)
    if k > 100:  # equal rows of a repeated id may stand in either order
        assert {(q, i, s) for q, _, i, s in got} == {(q, i, s) for q, _, i, s in want}
    assert got == want and len(out) == len(got)


def test_topk_large_components_and_empty_tables(spark):
    rows = [(0, [3e5, 1e5]), (1, [-3e5, 2e5]), (2, [1e5, 1e5]), (3, [1e5, 1e5])]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), every=2).collect()} == brute_topk(rows, 10, 2)
    with pytest.raises(Exception, match="no long"):
        topk.top_k(vectors(spark, [(0, [1e9]), (1, [1e9])])).collect()
    assert topk.top_k(vectors(spark, [(0, [2.0**20, 1.0]), (1, [2.0**21, -1.0])])).first().score == 2**61 - 2**20
    wild = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(71, [-1e25, 0.0]), (73, [-3e30, -1e30])]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors(spark, wild), every=20).collect()} == brute_topk([(i, [np.float32(x).item() for x in v]) for i, v in wild], 10, 20)
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0])])).count() == 0


def brute_cosine(rows, k, every):
    live = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, qv in live:
        if q % every == 0:
            s = sorted((-float(np.einsum("d,d->", qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v))), i) for i, v in live if i != q and len(v) == len(qv))
            out[q] = [(i, -c) for c, i in s[:k]]
    return out


def test_factor_one_is_exact(spark):
    rows, odd = sample()
    odd = [r for r in odd if r[0] != 20] + [(7700, [0.0] * 16)] + [rows[7]] * 3 + [(150, rows[150][1])]
    out = vptree.nearest(vectors(spark, rows + odd), every=50, factor=1.0, shard_rows=200, leaf=8, query_rows=4).collect()
    want = brute_cosine(rows + odd, 5, 50)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {q for q, v in want.items() if v}
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in want[q]], abs=1e-12)
        assert [i for i, _ in found] == [i for i, _ in want[q]]


def test_trees_of_odd_tables(spark):
    assert vptree.nearest(vectors(spark, [])).count() == 0
    assert vptree.nearest(vectors(spark, [(50, None), (None, [1.0]), (100, [0.0])])).count() == 0
    same = vptree.nearest(vectors(spark, [(50, [1.0, 2.0])] * 40 + [(51, [2.0, 4.0])] * 3), shard_rows=8, leaf=2, vantage=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in same) == [(50, k, 51) for k in (1, 2, 3)]


def test_an_id_that_repeats_is_spread(spark):
    from turnwise.llm import blocks

    many = spark.createDataFrame([(7, [float(i % 3), 1.0]) for i in range(10_000)], "vec_id long, v array<double>")
    sizes = [len(blocks.unpack(r)[0]) for r in blocks.in_blocks(blocks.numbered(many, "v"), 500, "b").collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 800


def test_recall_and_share_on_the_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_cosine([(r.vec_id, list(r.embedding)) for r in df.collect()], 5, 50)
    rows, trees = vptree.index(df)
    found, got = vptree.candidates_found(rows, trees).collect(), {}
    for r in vptree.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in want.items()]) >= 0.9
    assert sum(r.scored for r in found) < 0.8 * len(want) * df.count()


def test_a_larger_factor_looks_at_less():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))
    shards = []
    for part in (v[:3000], v[3000:]):
        order, nodes, far = vptree.build(part / np.linalg.norm(part, axis=1, keepdims=True), 64, 8)
        assert sorted(order) == list(range(3000))
        shards.append(vptree.Shard(order + (0 if part is v[:3000] else 3000), part[order], nodes, far, 8))
    scored, alone = {}, 0
    for factor in (1.0, 1.6, 3.0):
        s = vptree.Search(np.full(20, -1), v[:20] + 0.01, 5, factor)
        for one in shards:
            s.shard(one)
        scored[factor] = s.scored
    for one in shards:
        s = vptree.Search(np.full(20, -1), v[:20] + 0.01, 5, 1.0)
        s.shard(one)
        alone += s.scored
    assert scored[3.0] < scored[1.6] < scored[1.0] < 0.7 * 20 * 6000  # exact search prunes where vectors lie in clusters
    assert scored[1.0] < alone  # and a bound found in one shard prunes the next


# ---- URLs --------------------------------------------------------------------------------------------------------------


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls_against_brute_force(spark):
    rng = random.Random(8)
    rows = [f"{rng.choice(('http', 'HTTPS'))}://{rng.choice(('', 'www.', 'a.b.', 'X.'))}{rng.choice(('example.net', 'Example.COM', 'example.org', 'notnet', 'net', 'xexample.net'))}{rng.choice(('', '/', '/en/', '/de/7', '/fr/x.html', '/de'))}{rng.choice(('', '?q=1&p=2', '#top', '?u=http://e.net/'))}" for _ in range(400)]
    rows += [None, "", "no scheme", "://", "http://", "x://É.net/ü", "http://a.net" + "/y" * 20_000, "mailto:x@y.net", "http://net/", "http://net"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(rows)], "page_id long, url string, rule int").selectExpr("*", "2 AS host")
    out = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(out) == len(rows)
    for i, u in enumerate(rows):
        host, path, best = brute_url(u)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best and best[1])
        assert out[i].verdict == best[0] if best else out[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    none = urls.judge(df.filter("url = 'no scheme'")).collect()
    assert none[0].verdict == "allow" and none[0].rule is None


def test_mined_rules_decide(spark):
    rows = [(["p:shop", "h:a"], "block")] * 40 + [(["p:shop", "h:b"], "block")] * 10 + [(["p:news", "h:a"], "allow")] * 60 + [(None, "block"), (["h:a"], None)]
    m = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert m.default == "allow" and any(r[0] == ("p:shop",) and r[1] == "block" for r in m.rules)
    t = spark.createDataFrame([(["p:shop"],), (["p:news", "h:z"],), (["h:z"],), ([],)], "t array<string>")
    assert [r.v for r in t.select(m.verdict(t["t"]).alias("v")).collect()] == ["block", "allow", "allow", "allow"]
    assert all(c >= urls.MIN_CONFIDENCE for _, _, c, _ in m.rules)


def test_mined_rules_against_all_subsets(spark):
    """Rules of any length, with their numbers, are those of a walk over all subsets; the best of those that fit decides."""
    rng = random.Random(12)
    rows = [(sorted(rng.sample("abcdefgh", rng.randint(1, 7))), rng.choice(("allow", "block", "block"))) for _ in range(120)]
    m = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.05, min_confidence=0.7)
    every = []
    for k in range(1, 9):
        for left in itertools.combinations("abcdefgh", k):
            fits = [v for t, v in rows if set(left) <= set(t)]
            every += [(left, v, fits.count(v) / len(fits), fits.count(v) / 120) for v in ("allow", "block") if fits.count(v) >= 6 and fits.count(v) / len(fits) >= 0.7]
    every.sort(key=lambda r: (-r[2], -r[3], len(r[0]), " ".join(r[0]), r[1]))
    assert set(m.rules) <= set(every) and max(len(r[0]) for r in every) > 4
    tests = [sorted(rng.sample("abcdefgh", rng.randint(1, 8))) for _ in range(100)]
    want = [next((v for left, v, *_ in every if set(left) <= set(t)), m.default) for t in tests]
    assert [r.v for r in spark.createDataFrame([(t,) for t in tests], "t array<string>").coalesce(1).select(m.verdict(F.col("t")).alias("v")).collect()] == want


def test_mining_ends_where_most_sets_are_frequent(spark):
    """Half of sixty tokens in each of 400 rows: millions of sets have support; it is raised, and there are rules of the bounded size."""
    rng = random.Random(3)
    rows = [(rng.sample([f"t{i}" for i in range(60)], 30), rng.choice(("allow", "block"))) for _ in range(400)]
    start = time.time()
    m = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), min_support=0.02, max_sets=20_000)
    assert time.time() - start < 60 and len(m.rules) <= 20_000
    n = spark.createDataFrame(rows, "t array<string>, v string").select(m.verdict(F.col("t")).alias("v")).filter("v IN ('allow', 'block')").count()
    assert n == 400


def test_rules_that_no_model_holds_judge_all_the_same(spark):
    """With more sets than the model may hold, each URL has the verdict of the best of all rules, as by a model that holds them."""
    rng = random.Random(14)
    words = [f"w{c}" for c in "abcdefgh"]
    hosts = ("a.net/", "b.org/fr/", "c.com/", "d.com/")
    urls_ = [(i, f"http://{rng.choice(hosts)}{'/'.join(rng.sample(words, rng.randint(0, 6)))}") for i in range(600)] + [(600, None), (601, "no scheme"), (602, "http://d.com/unseen")]
    df = spark.createDataFrame(urls_, "page_id long, url string")
    whole, few = ({r.page_id: tuple(r) for r in urls.judge(df, min_support=0.03, max_sets=m).collect()} for m in (100_000, 20))
    assert whole == few and len(few) == 603
    assert len({r[4] for r in few.values() if r[1] in ("c.com", "d.com")}) == 2


def test_mining_survives_urls_that_share_all_tokens(spark):
    many = [f"t{i}" for i in range(60)]
    m = urls.mine(spark.createDataFrame([(many, "block")] * 300 + [(many[:30], "allow")] * 20, "tokens array<string>, label string"))
    assert 0 < len(m.rules) <= 4


def test_every_labelled_row_counts(spark):
    shapes = [(["p:a"], "block", 15_000), (["p:b"], "allow", 9_000), (["p:c"], "allow", 8_000), (["p:d"], "block", 5_000)]
    rows = spark.createDataFrame([(t, v, n) for t, v, n in shapes], "tokens array<string>, label string, n int").selectExpr("tokens", "label", "explode(sequence(1, n)) AS i")
    m = urls.mine(rows)
    assert m.default == "block"
    assert {(i, v): s for i, v, _, s in m.rules} == {(tuple(t), v): n / 37_000 for t, v, n in shapes}


def test_all_tokens_with_support_are_mined(spark):
    hosts = [f"h:spam{i:03}" for i in range(90)]
    rows = [([h, f"p:{h}", "s:http"], "block") for h in hosts for _ in range(3)] + [(["s:http", f"h:fine{i % 90:03}"], "allow") for i in range(900)]
    m = urls.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert {((h,), "block") for h in hosts} <= {r[:2] for r in m.rules}
    t = spark.createDataFrame([([h, "s:x"],) for h in hosts] + [([f"p:{h}"],) for h in hosts] + [(["h:else"],), (None,)], "t array<string>")
    assert [r.v for r in t.coalesce(1).select(m.verdict(t["t"]).alias("v")).collect()] == ["block"] * 180 + ["allow"] * 2


# ---- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        target = {s: left * w[s] / weight for s in free} if weight else {}
        over = [s for s in free if target[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return {**capped, **target}
        capped |= {s: float(epochs * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mix_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "b", "B", "é", "zz", "hot"]
    rows = [(i, " ".join("x" * rng.randint(1, 3) for _ in range(rng.choice((0, 3, 40, 200)))), rng.choice(names + ["hot"] * 6)) for i in range(250)]
    rows += [(900, None, "only null"), (901, "", None), (None, "a b c", "b"), (5, "again and again", "b"), (5, "again and again", "b"), (902, "w " * 5000, "tiny")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    size = lambda t: len((t or "").split())
    assert len(out) == len(rows) and sorted(r.size for r in out) == sorted(size(t) for _, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = brute_targets(sizes), {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 1.001 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert all((x.size, x.source_size, x.target, x.taken) == (0, 0, 0.0, 0) for x in r)


def test_materialise_takes_what_was_planned(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.materialise(df)
    assert out.columns == df.columns
    got, sizes = {}, {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = brute_targets(sizes)
    assert all(abs(got.get(s, 0) - want[s]) <= 1.001 for s in sizes)


def test_hot_rows_are_classes(spark):
    """Ten thousand rows without an id, and one row ten thousand times: planned and given out as planned, in full."""
    rows = [(None, f"w{i} and nine more words so that size is ten", "hot") for i in range(500)] + [(3, "one two three four five six seven", "hot")] * 10_000 + [(i, "a b c d", "cold") for i in range(100, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df).collect()
    sizes = {"hot": 500 * 10 + 70_000, "cold": 2400}
    want, taken, given = brute_targets(sizes), {}, {}
    assert len(plan) == len(rows)
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in mixing.materialise(df).collect():
        given[r.source] = given.get(r.source, 0) + len(r.text.split())
    assert all(abs(x[s] - want[s]) <= 1.001 for s in sizes for x in (taken, given))


def test_materialise_tells_rows_apart(spark):
    rows = [(None, f"{i} " + "x " * 9, "b", i) for i in range(20)] + [(i, "y " * 10, "c", 0) for i in range(60)] + [(7, "z " * 10, "b", k) for k in (1, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    given, want = {}, brute_targets({"b": 230, "c": 600})
    for r in mixing.materialise(df).collect():
        given[r.source] = given.get(r.source, 0) + len(r.text.split())
    assert all(abs(given[s] - want[s]) <= 1.001 for s in want)
    assert mixing.materialise(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [1, 7, 10_000])
def test_targets_of_many_sources(spark, one_task, monkeypatch):
    from turnwise.operators import ranks

    monkeypatch.setattr(mixing, "running", lambda rows, order, sums: ranks.running(rows, order, sums, one_task))
    rng = random.Random(one_task)
    sizes = {f"s{i}": rng.choice((0, 1, 5, 100, 4000)) for i in range(60)} | {None: 50}
    out = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.target for r in out} == pytest.approx(want, abs=1e-6)
