import random

import numpy as np
import pytest
import xxhash

from shelfwise.llm import simhash as sh


def slow_fingerprint(text):
    """Bit by bit, from the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """{id: smallest id reachable}, all pairs compared."""
    u = sorted(set(prints.values()))
    root = {f: f for f in u}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in prints.items()}


def test_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    want = slow_components(prints)
    got = sh.op2_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{prints[d]:016x}", want[d]) for d in prints}
    assert len(got) == len(docs)


@pytest.mark.parametrize("groups,hot", [(4, 4096), (4, 8), (5, 4096)])
def test_links_lose_nothing(spark, monkeypatch, groups, hot):
    rng = random.Random(groups)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for f in list(prints):  # planted neighbours, chains, and one dense cluster
        for _ in range(2):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    prints |= {0xABCD << 40 | 1 << a | 1 << b for a in range(20) for b in range(20)}
    prints = sorted(prints)
    want = {(min(a, b, key=signed), max(a, b, key=signed)) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    monkeypatch.setattr(sh, "HOT", hot)
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    got = {(r.a % 2**64, r.b % 2**64) for r in sh.linked_pairs(df, groups=groups).collect()}
    assert got == want


def signed(f):
    return f - 2**64 if f >= 2**63 else f


def test_distance_counts_equal_pairs():
    rng = np.random.default_rng(1)
    histogram = rng.integers(0, 5, 64)
    want = np.zeros(7)
    for a in range(64):
        for b in range(64):
            want[(a ^ b).bit_count()] += histogram[a] * histogram[b]
    assert np.allclose(sh.distance_counts(histogram), want)


def test_allocation_is_least_and_sums():
    cheap, dear = np.array([10.0, 100, 200, 400]), np.array([1e6, 2e6, 3e6, 4e6])
    assert sum(t + 1 for t in sh.allocate([cheap, dear, cheap, cheap], 3)) == 4
    assert sh.allocate([cheap, dear, cheap, cheap], 3)[1] == -1


def test_odd_rows(spark, write, odd_docs):
    folder = write(odd_docs)
    got = sh.op2_simhash(spark, folder).collect()
    assert len(got) == len(odd_docs)
    for r in odd_docs:
        assert any(g.doc_id == r[0] and g.fingerprint == f"{slow_fingerprint(r[1]):016x}" for g in got)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sh.near_duplicates(docs.where("doc_id < 0")).count() == 0
    kept = sh.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    # 1, 2 and 3 are the same words; null, empty and blank are one group; 7 and 8 have 3 of 4 shingles in common
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8, 9, 11]
    assert sh.keep_one_of_each(docs.where("doc_id < 0")).count() == 0


def shingle_set(text, words=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def slow_near_copies(texts, similarity=0.8):
    """{id: smallest id reachable by pairs of at least this similarity}, all pairs that share a shingle compared."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root, holders = {i: i for i in sets}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for g in s or {None}:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s or {None} for j in holders[g] if j < i}:
            if s == sets[j] or len(s & sets[j]) >= similarity * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies_against_all_pairs(spark, monkeypatch, block):
    """Chains, a large dense group, a passage that unrelated texts share, and copies at the bound."""
    monkeypatch.setattr(sh, "BLOCK", block)  # 8: the large groups are compared in pairs of parts
    rng = random.Random(block)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = [[word() for _ in range(rng.randint(1, 120))] for _ in range(150)]
    out = [" ".join(t) for t in texts]
    out += [edited(rng, t, rng.randint(0, 4)) for t in texts if len(t) > 20 for _ in range(2)]
    dense = [word() for _ in range(150)]
    out += [edited(rng, dense, 2) for _ in range(80)]
    passage = " ".join(word() for _ in range(60))
    out += [f"{passage} {' '.join(word() for _ in range(50))}" for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(20):
        chain = edited(rng, chain, 1).split()
        out.append(" ".join(chain))
    want = slow_near_copies(dict(enumerate(out)))
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    got = {r.doc_id for r in sh.keep_one_of_each(docs).collect()}
    assert got == {i for i, r in want.items() if i == r}


def test_a_dense_group_is_joined_by_its_leaders(spark, monkeypatch):
    """Near copies of one text, all in the same buckets: after the pass over the leaders nothing is
    left to compare, so the rows dealt follow the members, not their pairs."""
    monkeypatch.setattr(sh, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"v{rng.randrange(3000)}" for _ in range(200)]
    texts = [" ".join(base)] + [edited(rng, base, rng.choice([0, 1, 1, 2])) for _ in range(299)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], sh._rest_links

    def counting(large, joined, whole, similarity, weight):
        out = real(large, joined, whole, similarity, weight)
        rest = sh.components(joined).groupBy("root").count().collect()
        seen.append((large.select("unit").distinct().count(), max(r["count"] for r in rest)))
        return out

    monkeypatch.setattr(sh, "_rest_links", counting)
    want = slow_near_copies(dict(enumerate(texts)))
    assert {r.doc_id for r in sh.keep_one_of_each(docs).collect()} == {i for i, r in want.items() if i == r}
    units, joined = seen[0]
    assert units > 150 and joined >= 0.9 * units
