"""Near fingerprints, witnesses and token alignments against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from voxspark.llm import alignment, catalog, merkle, simhash


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def reachable(ids, prints, most=4):
    """Smallest id of each row's component, all pairs compared."""
    f = np.array(prints, np.uint64)
    near, left, out = np.bitwise_count(f[:, None] ^ f[None]) <= most, set(range(len(f))), [None] * len(f)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            i = todo.pop()
            seen.add(i)
            for j in np.flatnonzero(near[i]).tolist():
                if j in left:
                    left.discard(j)
                    todo.append(j)
        least = min((ids[i] for i in seen if ids[i] is not None), default=None)
        for i in seen:
            out[i] = least
    return out


def test_simhash_query_against_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in catalog.QUERIES["op11_simhash_trie"](spark, sf).collect()}
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    want = reachable(*zip(*rows, strict=True))
    assert len(got) == len(rows) and len({r.component_id for r in got.values()}) < len(rows)
    for (i, f), c in zip(rows, want, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", c)


def test_simhash_of_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(rows, reachable(*zip(*rows, strict=True)), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd_docs).collect()) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def clustered(rng, n, centres, flips):
    f = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        f = np.where(rng.random(n) < 0.6, f ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), f)
    return np.unique(f)


@pytest.mark.parametrize("most", [1, 3, 4])
def test_trie_join_of_all_rotations_is_complete(most):
    rng = np.random.default_rng(most)
    for _ in range(12):
        f = clustered(rng, int(rng.integers(2, 300)), int(rng.integers(1, 40)), int(rng.integers(1, 8)))
        links, at = [], 0
        for r, size in enumerate(simhash.block_sizes(most)):
            keys = simhash._rotated(f, at)
            order, found = np.argsort(keys), simhash.Links(len(f))
            simhash.trie_join(keys[order], simhash.allowances(most, r), found)
            links += [(int(order[a]), int(order[b])) for a, b in found.found]
            at += size
        assert all(bin(int(f[a] ^ f[b])).count("1") <= most for a, b in links)
        parts = np.arange(len(f))
        for _ in range(len(f)):
            for a, b in links:
                parts[a] = parts[b] = min(parts[a], parts[b])
        want = reachable(list(range(len(f))), f, most)
        assert all(len({want[i] for i in np.flatnonzero(parts == p)}) == 1 for p in set(parts.tolist())) and len(set(parts.tolist())) == len(set(want))


def test_large_groups_are_joined_in_tiles(spark):
    """Groups of more than a tile, with one very frequent fingerprint."""
    f = clustered(np.random.default_rng(5), 500, 6, 5)
    rows = spark.createDataFrame([(int(x), 1 + (i == 7) * 1000) for i, x in enumerate(f.view(np.int64))], "f long, n long")
    want, at = reachable(list(range(len(f))), f), {int(x): i for i, x in enumerate(f.view(np.int64))}
    for tile in (20, 1 << 19):
        links = simhash.near_links(rows, tile=tile).collect()
        parts = np.arange(len(f))
        for _ in range(40):
            for r in links:
                a, b = at[r.a], at[r.b]
                parts[a] = parts[b] = min(parts[a], parts[b])
        assert len(set(parts.tolist())) == len(set(want)) and len(links) < 40 * len(f)


# --- witnesses ----------------------------------------------------------------------------------


def tree(nodes):
    sib, pos, cur = [""] * len(nodes), list(range(len(nodes))), list(nodes)
    while len(cur) > 1:
        for i, p in enumerate(pos):
            run = p // 3
            sib[i] += "".join(cur[j] for j in range(3 * run, min(3 * run + 3, len(cur))) if j != p)
            pos[i] = run
        cur = [H("".join(cur[j : j + 3])) for j in range(0, len(cur), 3)]
    return cur[0], sib


def leaf(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([m[1] for m in made])
    out = []
    for (own, subroot, low), high in zip(made, upper, strict=True):
        for r, sib in zip(own, low, strict=True):
            hurt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")
            out.append((r[0], leaf(r), subroot, root, H(sib + high), not hurt))
    return Counter(out)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82, 244])
def test_appended_trees_are_those_built_level_by_level(n):
    nodes = [H(str(i)) for i in range(n)]
    root, sib = tree(nodes)
    a = merkle.Appender()
    for x in nodes:
        a.append(x)
    assert a.close() == root
    for x, s, w in zip(nodes, sib, a.witnesses, strict=True):
        assert "".join(y for *_, y in w) == s and merkle.fold(x, "".join(f"{i}{k}" for i, k, _ in w), s) == root


def test_witness_query_against_brute_force_and_sql(spark, sf, docs):
    df = catalog.QUERIES["op12_merkle_witnesses"](spark, sf)
    got = df.collect()
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got) == manifest(rows)
    assert all((r.folded_root == r.root) == r.verified for r in got) and 0 < sum(r.verified for r in got) < len(got)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = db.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL['op12_merkle_witnesses']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(sql)


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_are_appended_in_rounds(spark, docs, odd_docs, no_docs, levels):
    """Small blocks make several rounds; nulls in all columns, repeated rows and clashing names."""
    for df in (docs, odd_docs):
        rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
        made = merkle.folded(merkle.manifest(df, levels=levels), "leaf")
        got = made.selectExpr("doc_id", "leaf", "subroot", "root", "sha2(siblings, 256)", "folded_root = root").collect()
        assert Counter(map(tuple, got)) == Counter({(*k[:5], True): n for k, n in _unhurt(manifest(rows)).items()})
    assert merkle.folded(merkle.manifest(no_docs), "leaf").count() == 0


def _unhurt(counted):
    out = Counter()
    for k, n in counted.items():
        out[(*k[:5], True)] += n
    return out


# --- alignment ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    import public_tokenizers as P

    return alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def groups(al, text):
    """Of the whole text: n_a, n_b, and a list of groups of ids."""
    if not text:
        return 0, 0, []
    raw = f" {text}".encode()
    a, b = al.a.encode(f" {text}", add_special_tokens=False).ids, al.b.encode(text)
    if b"".join(al.bytes_a[i] for i in a) != raw or b"".join(al.bytes_b[i] for i in b) != raw:
        return 0, 0, []
    ea, eb = np.cumsum([len(al.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(al.bytes_b[i]) for i in b]).tolist()
    out, fa, fb = [], 0, 0
    for e in sorted(set(ea) & set(eb)):
        na, nb = ea.index(e, fa) + 1, eb.index(e, fb) + 1
        out.append((a[fa:na], b[fb:nb]))
        fa, fb = na, nb
    return len(a), len(b), out


def text_of(found):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found)


def aligned_rows(al, texts):
    each = [groups(al, t) for t in texts]
    count = Counter((x[-1], y[-1]) for _, _, g in each for x, y in g)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for n_a, n_b, g in each:
        own = [count[x[-1], y[-1]] for x, y in g]
        best = sum(n == top[y[-1]] for n, (_, y) in zip(own, g, strict=True))
        out.append((n_a, n_b, len(g), len(g), best, sum(own), H(text_of(g)) if n_a else ""))
    return out


ODD = [
    "", " ", "a  b", "\n", "x\n\ny", " lead", "trail ", "é漢😀 漢字\nß", "<|endoftext|> <s> </s> <0x0A>", "▁a b", "tab\tb", "nb sp", "don't we'll I'm\n'tis", "á é", "ﬁ ½",
    "12345 67,890.12\n-3", "a\r\nb", "a b", "🏳️‍🌈 flags", "ǅ ſ", "\x00 nul", "﻿bom",
]


def test_alignment_of_odd_texts(aligner, monkeypatch):
    """White space of all kinds, parts of characters, byte fallback, special tokens' strings; also where hardly any word is kept."""
    rng = np.random.default_rng(1)
    bits = ["a", "B", " ", "\n", "é", "漢", "😀", "'s", "1", ".", "the ", "\t", " ", "<", "▁", " word", "́"]
    texts = ODD + ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(400)]
    for kept in (1 << 20, 30):
        monkeypatch.setattr(alignment, "KEPT", kept)
        for _ in range(2):
            for t, r in zip(texts, aligner.rows(texts), strict=True):
                n_a, n_b, g = groups(aligner, t)
                assert r[:4] == (n_a, n_b, len(g), H(text_of(g)) if n_a else ""), t
                assert Counter(dict(zip(r[4], r[5], strict=True))) == Counter(x[-1] << 32 | y[-1] for x, y in g)


def test_spans_are_refined_by_bytes():
    assert alignment.refined(np.array([1, 4, 4, 4, 6]), np.array([1, 1, 1, 1, 2])).tolist() == [1, 2, 3, 4, 6]
    assert alignment.refined(np.array([2, 2, 2, 5, 6]), np.array([2, 1, 1, 1, 1])).tolist() == [2, 3, 4, 5, 6]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_against_brute_force(spark, sf, docs, aligner):
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in catalog.QUERIES["op13_token_alignment"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id] == w for r, w in zip(rows, aligned_rows(aligner, [r.text for r in rows]), strict=True))


def test_alignment_of_odd_tables(spark, odd_docs, no_docs, aligner, monkeypatch):
    import public_tokenizers as P

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, aligned_rows(aligner, [t for _, t in rows]), strict=True))
    for most in (1 << 20, 0):  # the table of pairs broadcast, and shuffled
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
        assert Counter(tuple(r[c] for c in ["doc_id", *NAMES]) for r in alignment.align(odd_docs, *paths).collect()) == want
    assert alignment.align(no_docs, *paths).count() == 0
