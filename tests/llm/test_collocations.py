import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from compare import assert_same, connect
from shelfwise.llm import collocations as co


def slow(rows, least=30, top=2000):
    """The contract over lists and dictionaries, with whole numbers of any size."""
    f, sizes = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        sizes[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in cand.items()):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def rows_of(df):
    assert df.columns == list(COLUMNS)
    return sorted(tuple(r) for r in df.collect())


def test_agrees_with_sql(spark, sf_dir):
    assert_same(co.op11_collocations(spark, sf_dir), co.OP11_SQL, sf_dir)


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "hall", "at", "once", "ß", "Éa", "x-ray"]
    phrases = ["new york city hall", "at  once", "Once\tupon a time", "of the", "the ß Éa"]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", " ", " ", ". ", "\n", ",", " \t "]) for p in parts)
        rows.append((i, text, rng.choice(["en", "en", "de", None]), "s", 1))
    return rows + [rows[3]] * 40 + [(None, None, None, None, None), (900, "", "fr", "s", 0), (901, " . ", "und", "s", 0), (902, "the of " * 1000, "en", "s", 1)]


@pytest.mark.parametrize("tight", [False, True])
def test_against_brute_force(spark, write, monkeypatch, tight):
    """Tight bounds: tries spill and burst, words are forgotten, prefixes are hot, windows cut texts."""
    rows = corpus(1)
    if tight:
        for name, value in dict(TRIE_ENTRIES=20, WORD_ENTRIES=8, BURST=2, WINDOW=64, PARTITION_ENTRIES=400, MAX_BITS=1 << 12).items():
            monkeypatch.setattr(co, name, value)
        rows = [(i, (t or "")[:3000], *r) for i, t, *r in rows]
    folder = write(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = slow(rows, 20, 15)
    assert len(want) > 25 and rows_of(co.collocations(docs, 20, 15)) == want
    if not tight:
        assert rows_of(co.op11_collocations(spark, folder)) == slow(rows)
        sql = connect(folder).execute(co.OP11_SQL)
        assert sorted(sql.fetchall()) == slow(rows) and [c[0] for c in sql.description] == list(COLUMNS)


def test_odd_tables(spark, write, odd_docs):
    docs = spark.read.parquet(f"{write(odd_docs)}/documents.parquet")
    assert rows_of(co.collocations(docs, 2)) == slow(odd_docs, 2)
    assert rows_of(co.collocations(docs.where("doc_id < -9"))) == []
    clash = spark.createDataFrame([(1, "a b a b", "en", "x", 5, 7)], "doc_id long, text string, lang string, word string, w1 long, f long")
    assert rows_of(co.collocations(clash, 2)) == slow([(1, "a b a b", "en")], 2)


def test_words_that_share_a_number_get_other_numbers(spark, monkeypatch):
    import xxhash

    seeds = []
    real = co.count_words

    def counting(texts, seed):
        seeds.append(seed)
        out = real(texts, seed)
        return out.withColumn("id", co.F.lit(5).cast("long")) if seed == 0 else out

    monkeypatch.setattr(co, "count_words", counting)
    docs = spark.createDataFrame([(1, "a b c. a b c", "en")], "doc_id long, text string, lang string")
    assert rows_of(co.collocations(docs, 2)) == slow([(1, "a b c. a b c", "en")], 2) and seeds[:2] == [0, 1]
    assert co.word_id(b"a", 0) % (1 << 64) == xxhash.xxh64_intdigest(b"a", 0)


def test_windows_cut_between_words(monkeypatch):
    monkeypatch.setattr(co, "WINDOW", 5)
    text = b"Some WORDS, of\tall\r\nkinds " + b"x" * 40 + b" end."
    whole = [w for part in co.words_of(text) for w in part]
    assert whole == b"some words . of all . . kinds".split() + [b"x" * 40, b"end", b"."]


def test_trie_bursts_and_gives_up_its_largest_subtrees(monkeypatch):
    monkeypatch.setattr(co, "BURST", 3)
    trie, want = co.HatTrie(bursts=True), Counter()
    rng = random.Random(0)
    for _ in range(400):
        first, others = rng.randrange(4), [(rng.randrange(3) << 42) | rng.randrange(9) for _ in range(3)]
        trie.add(first, others, [1, 2, 3])
        want.update({})
        for o, n in zip(others, (1, 2, 3)):
            want[first, o] += n
    assert any(burst for _, burst in trie.root.values()) and trie.entries == len(want)
    got = Counter()
    for left in (50, 0):
        for first, others, n in zip(*map(np.ndarray.tolist, trie.take(left))):
            got[first, others] += n
        assert trie.entries <= left
    assert got == want
