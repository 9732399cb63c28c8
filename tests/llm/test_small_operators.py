import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from voxspark.llm import lm_scoring, perspectives, quality, secrets, sharding, token_planes, warc
from voxspark.llm.common import fresh


# --- op1 ----------------------------------------------------------------------------------------


def test_rotation_parts_join_to_the_whole_dialogue(spark):
    rows = [(1, t, ["ann", "bob", "cy"][t % 3], f"message {t} é😀") for t in range(7)]
    got = perspectives.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part=3).collect()
    for who in ("ann", "bob", "cy"):
        own = sorted((r for r in got if r.participant == who), key=lambda r: r.part)
        assert [r.n_messages for r in own] == [3, 3, 1]
        want = "".join(("<|im_start|>assistant\n" if r[2] == who else f"<|im_start|>user name={r[2]}\n") + r[3] + "<|im_end|>\n" for r in rows)
        assert "".join(r.text for r in own) == want
        masked = [r.text[s.start : s.end] for r in own for s in r.mask]
        assert masked == [r[3] + "<|im_end|>\n" for r in rows if r[2] == who]


def test_rotation_of_nulls_ties_and_an_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string, part string, msgs int"
    rows = [(None, 0, "a", "x", "p", 1), (1, None, None, None, None, None), (1, 0, "b", "t", "p", 1), (1, 0, "b", "t", "p", 1), (1, 0, "a", "t", "p", 1)]
    got = {(r.conv_id, r.participant): r for r in perspectives.rotate_perspectives(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(None, "a"), (1, "unknown"), (1, "a"), (1, "b")}
    assert got[1, "b"].n_messages == 4 and len(got[1, "b"].mask) == 2
    assert got[1, "unknown"].text.startswith("<|im_start|>assistant\n<|im_end|>\n")
    assert perspectives.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


# --- op2 ----------------------------------------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"


def _path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def test_planes_round_trip_at_any_position():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 49_408, 10_000).astype(np.uint32)
    out = io.BytesIO()
    w = token_planes.PlaneWriter(out, block=777)
    for part in np.array_split(ids, 23):
        w.add(part)
    w.close()
    r = token_planes.PlaneReader(out)
    for a, n in ((0, 10_000), (776, 2), (777, 1), (9_999, 1), (5, 0), (1_500, 3_000)):
        assert (r.ids(a, n) == ids[a : a + n]).all()
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(b"x" * 40))


def test_tokens_match_the_library(spark, odd_docs, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_path())
    both = odd_docs.select("doc_id", "text").union(docs.select(docs.doc_id + 100, "text"))
    folder = fresh(spark, "test-tokens")
    got = token_planes.read_tokens(token_planes.write_tokens(both, folder, _path(), block=1000), folder).collect()
    rows = sorted(both.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_added_tokens_and_sigmas_match_the_library():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|><|endoftext|>\n", "ΟΔΟΣ ΣΑΣ Σ ΣΣ", "ΑΣ<|endoftext|>ΑΣ", "ὈΔΥΣΣΕΎΣ's Σ1", "İΣ", "σας ς", "no <|end of|> it", ""]
    coder, t = token_planes.Encoder(_path()), Tokenizer.from_file(_path())
    assert coder.whole is None
    for x, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_random_unicode_matches_the_library():
    import json
    import sys

    from tokenizers import Tokenizer

    rng, coder, t = random.Random(21), token_planes.Encoder(_path()), Tokenizer.from_file(_path())
    added = [x["content"] for x in json.load(open(_path(), encoding="utf-8"))["added_tokens"]]
    tricky = [*added, *[x.upper() for x in added], "Σ", "ς", "İ", "ı", "ß", "ẞ", "ﬁ", "\u0301", "e\u0301", "\u1e9b\u0323", "\u212b", "\u2126", "\uac00", "\u1100\u1161", "'S", "'ll", "\u00a0", "\u2028", "\u3000", "\x1c", "\x85", "\u200b", "1", "٣", "_", "…"]
    ranges = [(32, 127), (0, 0x250), (0x370, 0x530), (0x300, 0x370), (0x1E00, 0x2000), (0x2000, 0x2200), (0x3040, 0x3100), (0x1F300, 0x1F700), (0, sys.maxunicode)]

    def one() -> str:
        low, high = rng.choice(ranges)
        c = chr(rng.randrange(low, high))
        return rng.choice(tricky) if rng.random() < 0.15 else " " if rng.random() < 0.15 or 0xD800 <= ord(c) < 0xE000 else c

    texts = ["".join(one() for _ in range(rng.randrange(1, 25))) for _ in range(6000)] + [f"{a}{x}{b}" for x in tricky for a in ("", "a", " ", "Σ") for b in ("", "B", " ", "Σ")]
    for x, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, ascii(x)


def test_no_tokens_of_an_empty_table(spark, no_docs):
    folder = fresh(spark, "test-tokens")
    assert token_planes.read_tokens(token_planes.write_tokens(no_docs, folder, _path()), folder).count() == 0


# --- op4 ----------------------------------------------------------------------------------------


def test_warc_round_trip_and_random_access(spark):
    same, rows = "<p>copied</p>" * 20, []
    rows += [(i, f"http://x/{i}", same, "e") for i in (5, 9, 7, 12)] + [(1, "u", "short", "e"), (2, "u", "short", "e"), (3, None, None, None), (4, "", "", "e"), (None, "n", same, "e"), (20, "é", "ü😀" * 200_000, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = fresh(spark, "test-warc")
    index = warc.write_archives(pages, folder, frame_bytes=500)
    got = {r.page_id: r for r in warc.read_archives(index, folder).collect()}
    assert len(got) == 10
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        again = html == same and i != 5
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 5) if again else ("response", None))
    from voxspark.llm.common import local_path

    place = {r.page_id: r for r in index.collect()}[20]
    with open(f"{local_path(folder)}/{place.file}", "rb") as f:
        headers, block = warc.BundleReader(f).record(place.frame, place.offset)
    assert headers["WARC-Record-ID"] == place.record_id and block.endswith(("ü😀" * 200_000).encode())
    empty = warc.write_archives(pages.limit(0), fresh(spark, "test-warc"))
    assert empty.count() == 0


def test_warc_of_odd_urls_and_repeated_pages(spark, monkeypatch):
    same = "<p>copied</p>" * 20
    rows = [(1, "http://x/\r\nWARC-Type: evil\r\n\r\n", same), (1, "http://y", same), (1, "http://y", same), (2, "a: b\x00\x85é", same), (3, "http://z", same + "!"), (3, "http://z", "short"), (None, None, same), (None, "", same), (4, " ", same + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = fresh(spark, "test-warc")
    index = warc.write_archives(pages, folder).collect()
    got = warc.read_archives(spark.createDataFrame(index, warc.INDEX), folder).collect()
    assert len({r.record_id for r in index}) == len(rows) and {r.record_id for r in got} == {r.record_id for r in index}
    want = sorted(((p, len(h), "revisit", o) if o is not None and p != o else (p, len(h), "response", None) for p, _, h in rows for o in [{same: 1, same + "!": 3}.get(h)]), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want
    assert {r.url for r in got} == {"http://x/%0D%0AWARC-Type: evil%0D%0A%0D%0A", "http://y", "a: b%00%C2%85é", "http://z", "", " "}
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    far = fresh(spark, "test-warc")
    again = warc.read_archives(warc.write_archives(pages, far), far).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in again), key=str) == want


def test_bundle_is_plain_zstandard():
    import zstandard

    out = io.BytesIO()
    w = warc.BundleWriter(out, frame_bytes=10)
    for x in (b"first record", b"2nd", b"3rd"):
        w.add(x)
    w.close()
    d = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True)
    assert d.read(100) == b"first record2nd3rd"


# --- op6 ----------------------------------------------------------------------------------------


def _cost(key: int, shard: int) -> float:
    first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed=first)
    return -math.log(((h >> 11) + 0.5) * 2.0**-53)


def test_rendezvous_against_brute_force(spark, sf):
    got = sharding.op6_rendezvous_sharding(spark, sf).collect()
    for r in got:
        costs = [_cost(r.doc_id, i) for i in range(25)]
        assert r.shard == costs.index(min(costs[:24])) and r.grown_shard == costs.index(min(costs))
        assert r.grown_shard in (r.shard, 24)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_weights_and_odd_rows(spark, odd_docs, no_docs):
    many = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = dict(sharding.assign_shards(many, weights=[1, 3]).groupBy("shard").count().collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02
    got = sharding.with_slots(sharding.assign_shards(odd_docs)).collect()
    assert len(got) == odd_docs.count() and len({(r.shard, r.slot) for r in got}) == len(got)
    assert sharding.with_slots(sharding.assign_shards(no_docs)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(many, weights=[0.0, 1.0])


# --- op7 ----------------------------------------------------------------------------------------


def _base_spans(text: str):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def test_secret_scan_against_plain_search(docs):
    a = secrets._automaton()
    rng = random.Random(4)
    pieces = ["token", "=", "secret:", "PASSWORD", ' "', "'", " ", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "İ", "ſecret", "Key", "api_key", "apikey = ", "a.b/c+d-e=", "passwd"]
    texts = ["".join(rng.choices(pieces, k=12)) for _ in range(3000)] + [r.text for r in docs.select("text").collect()]
    for t in texts:
        assert [s for s in secrets.scan(t, a) if s[0] in secrets.BASE] == _base_spans(t)


def test_checksummed_tokens_and_odd_rows(odd_docs, no_docs):
    a, body = secrets._automaton(), "aB3" * 10
    good = f"x ghp_{body}{secrets.checksum(body)} y"
    assert ("github", 2, 42) in secrets.scan(good, a)
    assert not [s for s in secrets.scan(good.replace("aB3", "aB4", 1), a) if s[0] == "github"]
    assert not [s for s in secrets.scan(f"npm_{body}{secrets.checksum(body)}q", a) if s[0] == "npm"]
    got = secrets.find_secrets(odd_docs)
    assert got.count() == odd_docs.count() and dict(got.dtypes)["secrets"].startswith("array")
    assert secrets.find_secrets(no_docs).count() == 0


# --- op9 ----------------------------------------------------------------------------------------


def test_ratio_and_verdict_against_brute_force(spark, sf, docs):
    """Counts, log-ratios, the threshold and every verdict, worked out document by document with plain numbers."""
    import math
    from collections import Counter

    from voxspark.llm.common import mixed, word_hash_lists

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in texts]
    good, bad = {i for i, q in known if q == 1}, {i for i, q in known if q == 0}

    def buckets(text):
        h = [int(x) for x in word_hash_lists([text.encode()], False)[0]]
        codes = h + [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:], strict=False)]
        return [int(mixed(np.array([c], np.uint64))[0]) % quality.BUCKETS for c in codes]

    found = {i: buckets(t) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, b in found.items():
        raw.update(b)
        if i in good:
            target.update(b)
    whole, own = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = lambda b: math.log((target[b] + 1) / own) - math.log((raw[b] + 1) / whole)
    llr = {i: sum(map(weight, b)) / len(b) if b else 0.0 for i, b in found.items()}
    ratio = quality.fit_ratio(docs, labels)
    rows = quality.apply_ratio(docs, ratio).collect()
    failed = {r.doc_id: r.base_failed for r in rows}
    of = lambda ids, q: float(np.quantile([llr[i] for i in ids if not failed[i]], q))
    low, high = of(good, quality.QUANTILE), of(bad, 0.9)
    threshold = (low + min(low, high)) / 2
    assert math.isclose(ratio.threshold, threshold, rel_tol=1e-9)
    for r in rows:
        assert math.isclose(r.llr, llr[r.doc_id], rel_tol=1e-9, abs_tol=1e-12) and r.kept == (not r.base_failed and r.llr >= ratio.threshold)
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_quality_counts_against_brute_force(spark, odd_docs, docs):
    both = odd_docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(spark.createDataFrame([(900, "a b c a b c a b\n\n x \n x \nx\n x "), (901, "a a a a")], "doc_id long, text string"))
    got = quality.apply_ratio(both, quality.Ratio(np.zeros(quality.BUCKETS), 0.0)).collect()
    for r, src in zip(got, both.collect(), strict=True):
        text = src.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        at: dict = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(cover), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_ratio_keeps_trusted_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.apply_ratio(docs, quality.fit_ratio(docs, labels)).join(labels, "doc_id").where("not base_failed")
    good = got.where("quality = 1").select("kept").collect()
    assert sum(r.kept for r in good) >= 0.97 * len(good)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_all_labels_count(spark, monkeypatch, most):
    """More labelled documents than any sample held: every trusted one adds to the target, and quantiles are those of all."""
    monkeypatch.setattr(quality, "BROADCAST_LABELS", most)
    n = 20_050
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id % 7, ' v', id % 11, ' ', array_join(transform(sequence(1, 60), i -> concat('x', i)), ' ')) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = {r.bucket: (r.raw, r.target) for r in quality.bucket_counts(docs, quality.labelled(labels, 1)).collect()}
    assert sum(t for _, t in got.values()) == n * (2 * 62 - 1) and all(r == t for r, t in got.values())
    ratio = quality.fit_ratio(docs, labels)
    assert np.allclose(ratio.weights, 0) and abs(ratio.threshold) < 1e-9


@pytest.mark.parametrize("q", [0.0, 0.002, 0.37, 0.9, 1.0])
def test_quantiles_of_counted_values(spark, monkeypatch, q):
    monkeypatch.setattr(quality, "QUANTILE_BINS", 5)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=300), np.repeat(0.25, 100), [1e-13, 2e-13, -40.0]])
    counted = [(float(v), int(k)) for v, k in zip(*np.unique(values, return_counts=True), strict=True)]
    counts = spark.createDataFrame(counted, "llr double, n long")
    assert np.isclose(quality.quantile_of(counts, q), np.quantile(values, q), rtol=1e-12, atol=1e-15)
    assert quality.quantile_of(counts.limit(0), q) is None and quality.quantile_of(counts.where("llr = 0.25"), q) == 0.25


def test_ratio_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 1, 0), (9, 0, 0), (9, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.apply_ratio(odd_docs, quality.fit_ratio(odd_docs, labels)).count() == odd_docs.count()
    assert quality.apply_ratio(no_docs, quality.fit_ratio(no_docs, labels)).count() == 0
    assert quality.fit_ratio(odd_docs, labels.limit(0)).threshold == 0


# --- op5 ----------------------------------------------------------------------------------------


def test_base_scores_and_the_tail_join(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, counts = docs.collect(), {}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    for r in rows:
        if not held(r.doc_id):
            for w in words(r.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    by = {}
    for head in (1 << 19, 700):
        got = {r.doc_id: r for r in lm_scoring.language_model_scores(docs, head=head).collect()}
        by[head] = got
        for r in rows:
            w, g = words(r.text), got[r.doc_id]
            assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(w), sum(x in counts for x in w), n)
            assert math.isclose(g.base_score, sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    for i in by[700]:
        assert math.isclose(by[700][i].score, by[1 << 19][i].score, rel_tol=1e-4)
    out = [g for g in by[700].values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_model_is_a_distribution_and_carries_state():
    from voxspark.llm import gru

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 99, gru.SYMBOLS).astype(float)
    t = gru.Trainer(gru.initial(counts))
    docs = [rng.integers(0, gru.SYMBOLS, n).astype(np.int32) for n in (400, 3, 90)]
    t.train(docs)
    h = rng.normal(size=(1, gru.HIDDEN)).astype(np.float32)
    every = gru.probabilities(t.p, np.repeat(h, gru.SYMBOLS, 0), np.arange(gru.SYMBOLS))
    assert abs(every.sum() - 1) < 1e-4
    unigram = counts / counts.sum()
    docs += [rng.integers(0, gru.SYMBOLS, n).astype(np.int32) for n in (1, 7, 13, 64, 65, 101)]
    alone = [gru.scores(t.p, [d], unigram, 0.05)[0] for d in docs]
    for lanes, steps in ((512, 64), (1, 5), (1, 1000), (2, 7), (3, 64)):
        assert np.allclose(gru.scores(t.p, docs, unigram, 0.05, lanes=lanes, steps=steps), alone, rtol=1e-5)


def test_gradients_against_finite_differences():
    """Over a window with beginnings inside, a part behind a lane's end, and a state from before."""
    from voxspark.llm import gru

    rng = np.random.default_rng(6)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in gru.initial(rng.integers(1, 99, gru.SYMBOLS).astype(float)).items()}
    y = rng.integers(0, gru.SYMBOLS, (9, 3)).astype(np.int32)
    first, used = np.zeros(y.shape, bool), np.ones(y.shape, bool)
    first[[4, 0, 2, 8], [0, 1, 1, 2]], used[6:, 1] = True, False
    x = gru.inputs_of(y, first, np.array([5, 6, 7], np.int32))
    h = rng.normal(0, 0.5, (3, gru.HIDDEN)).astype(np.float32)
    g, last = gru._gradients(p, x, y, first, used, h.copy(), 1)

    def loss() -> float:
        out = gru._states(p, x, first, h, False)[0]
        return -float(np.log(gru.probabilities(p, out[1:].reshape(-1, gru.HIDDEN), y.ravel()).astype(float))[used.ravel()].sum())

    assert np.allclose(last, gru._states(p, x, first, h, False)[0][-1])
    for k, v in p.items():
        at = np.argsort(-np.abs(g[k]).ravel())[:40]
        for i in rng.choice(at, 12, replace=False):
            place, before, d = np.unravel_index(i, v.shape), v.flat[i], 4e-3
            v[place] = before + d
            up = loss()
            v[place] = before - d
            slope = (up - loss()) / (2 * d)
            v[place] = before
            assert abs(slope - g[k][place]) <= 0.02 * abs(slope) + 5e-3, (k, slope, g[k][place])


def test_training_carries_states_over_windows():
    """A symbol that only the one seven places before tells; windows do not end with documents."""
    from voxspark.llm import gru

    rng, n = np.random.default_rng(3), 300
    docs = [np.array([2 + k, *[30] * 6, 10 + k, 0], np.int32) for k in rng.integers(0, 2, n)]
    t = gru.Trainer(gru.initial(np.bincount(np.concatenate(docs), minlength=gru.SYMBOLS)))
    for _ in range(12):
        t.train(docs, lanes=10, steps=12)
    assert t.tokens == 12 * 9 * n
    got = gru.scores(t.p, docs[:20], np.full(gru.SYMBOLS, 1 / gru.SYMBOLS), 0.0) / 9
    assert got.mean() > -0.1


def test_scores_of_odd_tables(odd_docs, no_docs):
    got = lm_scoring.language_model_scores(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert lm_scoring.language_model_scores(no_docs).count() == 0


def test_count_cutoff(spark):
    from voxspark.llm.common import count_cutoff

    rng = random.Random(1)
    n = [rng.randrange(1, 40) for _ in range(500)] + [rng.randrange(1, 10**6) for _ in range(500)]
    counts = spark.createDataFrame([(x,) for x in n], "n long")
    for most in (0, 1, 10, 300, 700, 1000, 5000):
        c = count_cutoff(counts, most)
        assert sum(x >= c for x in n) <= most and (most < 1000 or c <= min(n))
    assert count_cutoff(counts.limit(0), 5) == 1
