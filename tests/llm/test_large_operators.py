import itertools
import random
import re

import pytest

import corpus_pipeline
from tests.llm.conftest import words
from voxspark.llm import contamination, jaccard, mixing
from voxspark.llm.common import word_hash_lists
from voxspark.llm.components import connected_components


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _set(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _components(rows):
    sets, root = [_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.setdefault(rows[i][0], set()).add((len(sets[i]), min(ids, default=None)))
    return out


def _edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("boundary", [None, 2, 24, 64])
def test_jaccard_components_against_brute_force(spark, monkeypatch, boundary):
    rng, texts = random.Random(8), []
    for size in (2, 5, 6, 7, 9, 12, 20, 40, 120, 300):
        base = words(size, size)
        texts += [base, base, base.upper()] + [_edited(rng, base, k) for k in (1, 1, 2, 3, 5, 8)] + [base + " " + words(size + 1, max(1, size // 4)), base[: len(base) * 4 // 5]]
    crowd = words(99, 80)
    texts += [_edited(rng, crowd, rng.randrange(1, 4)) for _ in range(60)] + [words(500 + i, 10) + " " + words(77, 50) for i in range(20)] + ["", None, "a", "A"]
    if boundary:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sets: boundary)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = _components(rows)
    assert len(got) == len(rows)
    for r in got:
        n, comp = next(iter(want[r.doc_id]))
        assert (r.n_shingles, r.component_id) == (n, comp if n else r.doc_id)


@pytest.mark.parametrize("shrinks, factor", [(0.0, 0), (0.9, 0), (0.7, 4)])
def test_all_rounds_agree(spark, monkeypatch, shrinks, factor):
    """A crowd near the threshold, with and without hub rounds before the full join."""
    rng = random.Random(5)
    base = words(4, 60)
    rows = [(i, _edited(rng, base, rng.randrange(1, 7))) for i in range(120)]
    rows += [(200 + i, _edited(rng, rows[i][1], rng.randrange(0, 3))) for i in range(60)]
    want = _components(rows)
    monkeypatch.setattr(jaccard, "SHRINKS", shrinks)
    monkeypatch.setattr(jaccard, "FULL_FACTOR", factor)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and all(next(iter(want[r.doc_id]))[1] == r.component_id for r in got)


@pytest.mark.parametrize("share, chunk", [(1.0, 300), (0.375, 100), (0.375, 10**6)])
def test_bounds_are_never_too_low(spark, monkeypatch, share, chunk):
    """Against all pairs, over many chunks; exact where all shingles are looked at and sets are distinct."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng, texts = random.Random(11), []
    for size in (3, 5, 6, 20, 80, 200):
        base = words(40 + size, size)
        texts += [base] + [_edited(rng, base, rng.randrange(1, 5)) for _ in range(12)]
    texts += [words(900 + i, 40) for i in range(20)] + [texts[0], texts[40], "", None]
    rows = list(enumerate(texts))
    got = jaccard.bounds(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), share).collect()
    sets = [_set(t) for t in texts]
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    most = {}
    for r in got:
        assert r.n == len(sets[r.doc_id]) and (r.node is None) == (r.n == 0)
        if r.most is not None:
            most[r.node] = max(r.most, most.get(r.node, 0))
    for r in got:
        if r.n:
            others = [s for s in sets if s != sets[r.doc_id]]
            common = len(sets[r.doc_id] & set().union(*others))
            assert max(len(sets[r.doc_id] & s) for s in others) <= common <= most[r.node] <= r.n
            if share == 1 and sets.count(sets[r.doc_id]) == 1:
                assert most[r.node] == common


def test_word_hashes_do_not_depend_on_their_place():
    texts = [b"", b" \n", b"Alpha beta", b"x" * 600_000 + b" beta", b"beta alpha", b"\talpha\x0b\x0cBETA\r\n", "é😀 beta".encode(), b"gamma " * 90_000]
    got = [h.tolist() for h in word_hash_lists(texts)]
    assert [len(h) for h in got] == [0, 0, 2, 2, 2, 2, 2, 90_000]
    a, b = got[2]
    assert got[4] == [b, a] and got[5] == [a, b] and got[3][1] == got[6][1] == b and len(set(got[7])) == 1
    alone = [h.tolist() for t in texts for h in word_hash_lists([t])]
    assert alone == got


def test_jaccard_of_odd_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = _components(rows)
    for r in jaccard.jaccard_components(odd_docs).collect():
        n, comp = next(iter(want[r.doc_id]))
        assert (r.n_shingles, r.component_id) == (n, comp if n else r.doc_id)
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 10 not in ids and 2 not in ids and {1, 3, 4, 5, 6, 7, 8, 9, 11, None} <= set(ids)
    assert jaccard.jaccard_components(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_null_ids_keep_their_links(spark):
    a, b, c, d = (words(700 + i, 120) for i in range(4))
    rows = [(None, a), (5, a), (6, "changed " + a), (None, b), (7, "changed " + b), (None, c), (None, "changed " + c), (None, d)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    ids = sorted(((r.doc_id, r.component_id) for r in got), key=str)
    assert ids == sorted([(None, 5), (5, 5), (6, 5), (None, 7), (7, 7), (None, None), (None, None), (None, None)], key=str)


def test_one_row_of_each_component_stays(spark):
    """A repeated smallest id, ids with several texts, repeated null ids."""
    a, b, c, d, e, f = (words(600 + i, 120) for i in range(6))
    near = "changed " + a
    rows = [
        (1, a, 0), (1, a, 1), (1, a, 2), (2, a, 3), (3, near, 4),  # a repeated smallest id
        (4, a, 5), (4, b, 6),  # a copy, and a clean text under the same id
        (5, c, 7), (5, "changed " + c, 8), (6, c, 9),  # both texts of the smallest id in one group
        (None, d, 10), (None, d, 11), (None, a, 12), (None, "", 13),
        (7, e, 14), (7, None, 15), (7, e.upper(), 16), (8, "", 17), (9, f, 18),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(4)
    kept = [(r.doc_id, r.text, r.row) for r in jaccard.keep_one(docs).collect()]
    assert set(kept) <= set(rows) and len(kept) == len(set(kept))
    groups = [{0, 1, 2}, {6}, {7, 8}, {10, 11}, {13}, {14, 16}, {15}, {17}, {18}]
    assert len(kept) == len(groups) and all(len(g & {r[2] for r in kept}) == 1 for g in groups)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op3 ----------------------------------------------------------------------------------------


def _contained(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            own, has = _set(x), _set(t)
            if own and 100 * len(own & has) >= 75 * len(own):
                out.add((d, i, len(own & has), len(own)))
    return out


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, words(1000 + i, n)) for i, n in enumerate((1, 3, 5, 6, 9, 16, 30, 64, 200))] + [(50, None), (51, " ")]
    docs = []
    for i, x in items[:9]:
        n = len(x.split())
        docs += [(10 * i, words(i, 2000) + " " + x + " " + words(i + 1, 500)), (10 * i + 1, x.upper()), (10 * i + 2, words(i, 50) + "\n" + _edited(rng, x, max(1, n // 30)) + "\t" + words(i, 9)), (10 * i + 3, " ".join(x.split()[: n * 7 // 10]))]
    docs += [(900, None), (901, ""), (902, words(1, 40_000))]
    got = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.hits, r.item_shingles) for r in got.collect()} == _contained(docs, items)


def test_containment_beyond_the_broadcast_bound(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {tuple(r) for r in contamination.contaminated(docs, items).collect()}
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert want and {tuple(r) for r in contamination.contaminated(docs, items).collect()} == want


def test_decontamination_of_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, words(1, 40), "x"), (None, words(2, 40), "x"), (3, None, "x")], "item_id long, text string, doc_id string")
    kept = contamination.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {9, 10, 11} & set(ids) and len(ids) == odd_docs.count() - 3
    assert contamination.decontaminate(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert contamination.decontaminate(no_docs, items).count() == 0


# --- op10 ---------------------------------------------------------------------------------------


def _buckets(text):
    import regex
    import xxhash

    runs = set(regex.findall(r"\p{L}+|[^\p{L}\p{N}\s]+", (text or "").lower()))
    return {xxhash.xxh64_intdigest(w.encode(), seed=42) % mixing.BUCKETS for w in runs}


def test_posteriors_against_brute_force(spark):
    """The telling buckets, the choice of scale, and every document's posteriors, worked out document by document."""
    import math

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = mixing.fit_classifier(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fold'), 5) AS f").collect()}
    known = [(r.doc_id, f"q{r.quality}_t{r.toxic}") for r in labels.collect() if r.quality is not None and r.toxic is not None and r.doc_id in rows]
    assert model.domains == sorted({k for _, k in known})
    learnt_odds = {r.b: list(r)[1:] for r in model.odds.collect()}
    found = {i: _buckets(t) for i, t in rows.items()}
    learnt, held = [(i, k) for i, k in known if fold[i]], [(i, k) for i, k in known if not fold[i]]
    size, n = {k: sum(x == k for _, x in learnt) for k in model.domains}, {}
    for i, k in learnt:
        for b in found[i]:
            n.setdefault(b, dict.fromkeys(model.domains, 0))[k] += 1
    odds = {}
    for b, by in n.items():
        every, w, z = sum(by.values()), [], []
        for k in model.domains:
            x, y = by[k] + 1, every - by[k] + 1
            v = math.log(x / (size[k] + 2)) - math.log(y / (len(learnt) - size[k] + 2))
            z.append(abs(v) / math.sqrt(1 / x + 1 / y))
            w.append(v if z[-1] >= mixing.TELLING else 0.0)
        if every >= mixing.LEAST_DOCUMENTS and any(w):
            odds[b] = w
    assert odds and odds.keys() == learnt_odds.keys()
    for b, w in odds.items():
        assert all(abs(x - y) <= 5.1e-4 for x, y in zip(w, learnt_odds[b], strict=True))
    odds = learnt_odds
    prior = [math.log((size[k] + 1) / (len(learnt) + len(size))) for k in model.domains]

    def posterior(i, power, scale):
        s = scale / max(1, len(found[i])) ** power * 30**power
        logs = [p + s * sum(odds[b][j] for b in found[i] if b in odds) for j, p in enumerate(prior)]
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    loss = {(a, s): -sum(math.log(max(1e-9, posterior(i, a, s)[model.domains.index(k)])) for i, k in held) / len(held) for a in mixing.POWERS for s in mixing.SCALES}
    assert math.isclose(loss[model.power, model.scale], min(loss.values()), rel_tol=1e-9) and math.isclose(model.held_out[0], min(loss.values()), rel_tol=1e-9)
    assert model.held_out[0] < 0.9 * model.held_out[2]
    got = model.posteriors(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        steps = [round(x * mixing.GRID) for x in posterior(r.doc_id, model.power, model.scale)]
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert sum(abs(x - y / sum(steps)) for x, y in zip(r.p, steps, strict=True)) < 0.04


def test_rates_meet_their_targets(spark):
    """Weights of all domains that some rates do meet."""
    import numpy as np

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = mixing.fit_classifier(docs, labels)
    rows = model.posteriors(docs).collect()
    p, n = np.array([r.p for r in rows]), np.array([r.n_tokens for r in rows])
    assert len(rows) == docs.count() and np.allclose(p.sum(1), 1)
    wanted = (n * np.maximum(0, 1 + 2 * (p[:, 2] - p[:, 2].mean()))) @ p
    weights = dict(zip(model.domains, wanted / wanted.sum(), strict=True))
    model, _, u = mixing.mixing_rates(docs, labels, weights)
    rates = np.array([r.rate for r in model.posteriors(docs).withColumn("rate", mixing.rate_of(u)).collect()])
    assert (rates >= 0).all() and np.abs((rates * n) @ p / n.sum() - wanted / wanted.sum()).max() < 2e-3


def _rates(profiles, *given, **more):
    import numpy as np

    u = mixing.fit_rates(profiles, *given, **more)
    return np.array([r.rate for r in sorted(profiles.withColumn("rate", mixing.rate_of(u)).collect())])


@pytest.mark.parametrize("weights", [{"a": 0.6, "b": 0.1}, {"a": 0.05}, {}])
def test_rates_against_plain_projected_gradient(spark, weights):
    import numpy as np

    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.5, 0.2], 40)
    n = rng.integers(1, 500, 40)
    got = _rates(spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(40)], "code int, n long, p array<double>"), ["a", "b", "c"], weights)
    target, r = mixing.target_tokens(["a", "b", "c"], n @ p, weights), np.ones(40)
    for _ in range(400_000):
        r = np.maximum(0, r - 1.0 * (p @ (((r * n) @ p - target) / n.sum()) + mixing.RIDGE * (r - 1)))
    assert (got >= 0).all() and np.allclose(got, r, atol=2e-2) and np.abs((got * n) @ p - target).max() < 2e-3 * n.sum()


@pytest.mark.parametrize("soft", [0.3, 0.6, 0.9])
def test_rates_meet_the_production_targets_with_default_steps(spark, soft):
    """Soft posteriors and small residual domains."""
    import numpy as np

    rng, domains = np.random.default_rng(1), ["q0_t0", "q0_t1", "q1_t0", "q1_t1"]
    natural = np.array([0.15, 0.02, 0.765, 0.065])
    p = (1 - soft) * np.eye(4)[rng.choice(4, 300, p=natural)] + soft * rng.dirichlet(4 * natural, 300)
    n = rng.integers(1, 500, 300)
    r = _rates(spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(300)], "code int, n long, p array<double>"), domains, mixing.TARGETS)
    tokens, target = (r * n) @ p, mixing.target_tokens(domains, n @ p, mixing.TARGETS)
    assert (r >= 0).all() and abs((r * n).sum() / n.sum() - 1) < 0.01
    assert abs(tokens[2] / n.sum() - 0.95) < 0.005 and np.abs(tokens - target).max() < 0.005 * n.sum()


def test_unreachable_targets_end_at_the_least_squares(spark):
    """Every row is half a: three quarters cannot be reached, and the rates are those of the plain projected gradient."""
    import numpy as np

    n, p = np.array([100, 300]), np.array([[0.5, 0.5], [0.5, 0.5]])
    profiles = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(2)], "code int, n long, p array<double>")
    got = _rates(profiles, ["a", "b"], {"a": 0.75})
    target, r = mixing.target_tokens(["a", "b"], n @ p, {"a": 0.75}), np.ones(2)
    for _ in range(20_000):
        r = np.maximum(0, r - 1.0 * (p @ (((r * n) @ p - target) / 400) + mixing.RIDGE * (r - 1)))
    assert np.allclose(got, r, atol=1e-3)
    with pytest.raises(RuntimeError):
        mixing.fit_rates(profiles, ["a", "b"], {"a": 0.75}, steps=1)


def test_any_number_of_domains(spark):
    """Six and forty domains that nothing but their words tells apart."""
    for qualities in (3, 20):
        n = 2 * qualities
        rows = [(i, f"{words(5000 + i, 6)} {' '.join(f'telling{chr(97 + i % n // 26)}{chr(97 + i % n % 26)}{chr(97 + j)}' for j in range(4))} end") for i in range(30 * n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % n // 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
        model, _, u = mixing.mixing_rates(docs, labels, {})
        assert len(model.domains) == n and model.held_out[1] == 1
        for r in model.posteriors(docs).collect():
            assert model.domains[max(range(len(r.p)), key=lambda k: r.p[k])] == f"q{r.doc_id % n // 2}_t{r.doc_id % 2}"


def test_features_are_worked_out_once(spark):
    """The classifier's table is written before rates filter it, so no plan holds the features twice."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for df in (mixing.mix(docs, labels), mixing.featured(docs, "doc_id")):
        assert df._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 0


def test_tables_that_nothing_reads_are_deleted(spark):
    """What an operator has written goes, but for what its result reads."""
    import os

    from voxspark.llm.common import local_path, shared_dir

    folder = local_path(shared_dir(spark))
    docs, before = spark.createDataFrame([(i, words(i // 2, 60)) for i in range(40)], "doc_id long, text string"), set(os.listdir(folder))
    out = jaccard.jaccard_components(docs)
    read = {p.rpartition("/")[0].rpartition("/")[2] for p in out.inputFiles()}
    assert set(os.listdir(folder)) - before == read and len({r.component_id for r in out.collect()}) == 20


def test_mixing_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, None), (None, 1, 0), (9, 0, 0), (9, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mix(odd_docs, labels)
    assert out.columns == odd_docs.columns and {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd_docs.collect()}
    assert mixing.mix(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert mixing.mix(no_docs, labels).count() == 0


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns and 0 < docs.count() < before.count(), name
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert not _contained(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    comps = _components(rows)
    assert all(next(iter(v))[1] == k for k, v in comps.items())
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    assert mixed.columns == columns
    assert corpus_pipeline.STAGES[4][1](spark, mixed, sf).columns == [*columns, "shard", "grown_shard"]


def test_pipeline_of_odd_tables(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
        assert out.count() <= docs.count()
