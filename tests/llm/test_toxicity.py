import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.llm import toxicity as tx

TERMS = [("idiot", False, 5.0), ("scum", False, 4.0), ("worthless", False, 6.0), ("lowei", True, 5.0), ("lost", True, 3.0), ("losers", False, 2.0)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_match(word):
    hits = [(0, -o, k) for k, (t, stem, o) in enumerate(TERMS) if stem and word.startswith(t)]
    hits += [(e, -o, k) for k, (t, stem, o) in enumerate(TERMS) if not stem and (e := edits(word, t)) <= tx.allowed_edits(len(t))]
    return (min(hits)[2], min(hits)[0]) if hits else None


AUTOMATON = tx.LexiconAutomaton(TERMS)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("idotscumwrhleang", max_size=11), st.builds(
    lambda t, i, c, j: t[:i] + c + t[i + j :], st.sampled_from([t[0] + s for t in TERMS for s in ("", "ab", "en")]), st.integers(0, 9), st.text("osxé", max_size=2), st.integers(0, 2))))
def test_automaton_equals_edit_distance(word):
    assert AUTOMATON.match(word) == slow_match(word)


def test_quotation():
    f = tx.Finder(AUTOMATON)
    assert [h[:3] for h in f.hits('They said "you idiot" to her')[1]] == [(0, 0, True)]
    assert [h[:3] for h in f.hits("“An idi0t!” he wrote. IDIOT")[1]] == [(0, 1, True), (0, 0, False)]
    assert [h[2] for h in f.hits('"Hello" you idiot, "bye"')[1]] == [False]
    m = tx.Model(TERMS, weights=np.array([-4.0, 3, 0, 0, 0, 0]))
    assert m.score("you idiot") > m.score('she said "idiot" once') > m.score("fine words") == m.score("") == m.score(None)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in tx.op6_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    out = [(got[d].predicted, t, got[d].score) for d, t in labels.items() if d in got and got[d].held_out]
    caught = sum(p for p, t, _ in out if t) / sum(t for _, t, _ in out)
    wrong = sum(p for p, t, _ in out if not t) / sum(1 - t for _, t, _ in out)
    # a few labelled rows hold no trace of abuse (repeated or cut texts), so not all can be caught
    assert caught > 0.9 and wrong < 0.005
    assert all(0 <= r.score <= 1 for r in got.values())


def test_misspelt_terms_are_caught(spark, write, tmp_path):
    rng = random.Random(5)
    filler = ["ab" + "".join(rng.choice("aeiourt") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(filler, k=30)
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(30)] = rng.choice(["worthless", "disgusting"])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, toxic))
    misspelt = {1000: "wortless", 1001: "d1sgusting", 1002: "disgustting", 1003: "worthles"}
    for i, w in misspelt.items():
        rows.append((i, " ".join([*rng.choices(filler, k=10), w, *rng.choices(filler, k=10)]), "en", "s", 1))
    rows += [(1100, None, None, None, None), (1101, "", "en", "s", 0), (None, "worthless", "en", "s", 1), (1102, "x " * 100_000, "en", "s", 1)]
    write(rows)
    write(labels, "labels", "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.op6_toxicity(spark, str(tmp_path)).collect()}
    assert all(got[i].predicted == 1 for i in misspelt) and got[None].predicted == 1 and got[None].held_out is False
    assert all(got[i].predicted == 0 for i in (1100, 1101, 1102)) and got[1100].score == got[1101].score
    assert sum(got[i].predicted != t for i, t in labels) == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, None)]])
def test_few_or_no_labels(spark, write, odd_docs, labels, tmp_path):
    write(odd_docs)
    write(labels, "labels", "doc_id long, toxic int")
    got = tx.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(odd_docs) and all(0 <= r.score <= 1 for r in got)


def test_inflected_terms_may_be_misspelt():
    toxic = {"idiot": 100, "idiots": 30, "idio*": 130, "idiot*": 30}
    a = tx.LexiconAutomaton(tx.induce_terms(toxic, {"idio*": 1}, 1000, 2000))
    assert ("idio", True) in {t[:2] for t in a.terms}
    for word, edits in (("idiot", 0), ("idiotic", 0), ("idjot", 1), ("1diot", 1), ("ediot", 1), ("idjots", 1)):
        found = a.match(word)
        assert found and found[1] == edits, word
    assert a.match("patriot") is None


def test_automaton_outlives_its_bound(monkeypatch):
    monkeypatch.setattr(tx, "_CACHE", 8)
    a, rng = tx.LexiconAutomaton(TERMS), random.Random(3)
    words = ["".join(rng.choices("idotscumwrhle", k=rng.randint(1, 10))) for _ in range(400)] + ["worthles", "idi0t", "loweiab"] * 3
    assert [a.match(w) for w in words] == [slow_match(w) for w in words]
    assert len(a._states) < 40


def slow_score(model, text):
    """Word by word against every term by edit distance, windows by index, the sum by hand."""
    raw = (text or "").lower().split()
    hits = []
    for i, word in enumerate(raw):
        found = [(f, m.span()) for m in tx._WORD.finditer(word) for f in [slow_find(model.terms, m.group())] if f]
        if not found:
            continue
        spans = [m.span() for m in tx._WORD.finditer(word)]
        before, after = raw[max(0, i - tx.WINDOW) : i], raw[i + 1 : i + 1 + tx.WINDOW]
        quoted = tx.is_quoted(" ".join([*before, word[: spans[0][0]]]), " ".join([word[spans[-1][1] :], *after]))
        near = {m.group() for w in before + after if (m := tx._WORD.search(w))}
        cue = 1 / (1 + math.exp(-sum(model.cues.get(w, 0) for w in near)))
        hits += [(model.terms[k][2] * tx.EDIT_FACTOR**e * (tx.QUOTE_FACTOR if quoted else 1) * 2 * cue, quoted, e > 0) for (k, e), _ in found]
    strength = sum(h[0] for h in hits)
    x = [1, math.log1p(strength), math.log1p(len(hits)), math.log1p(sum(h[1] for h in hits)), math.log1p(sum(h[2] for h in hits)), strength / max(1, len(raw))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(model.weights, x))))))


FOUND = {}


def slow_find(terms, word):
    if word not in FOUND:
        hits = [(0, -o, k) for k, (t, stem, o) in enumerate(terms) if stem and word.startswith(t)]
        hits += [(e, -o, k) for k, (t, stem, o) in enumerate(terms) if not stem and abs(len(t) - len(word)) <= 2 and (e := edits(word, t)) <= tx.allowed_edits(len(t))]
        FOUND[word] = (min(hits)[2], min(hits)[0]) if hits else None
    return FOUND[word]


@pytest.mark.parametrize("bound", [tx._CACHE, 50])
def test_every_score_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(tx, "_CACHE", bound)  # 50: states and words are forgotten all the time
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert model.terms
    FOUND.clear()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        assert model.score(t) == pytest.approx(slow_score(model, t)), i
    got = {r.doc_id: r.score for r in tx.score(docs.withColumns({"score": F.lit("x"), "toxic": F.lit("y")}), model).collect()}
    assert got == {i: pytest.approx(model.score(t)) for i, t in texts.items()}


def test_the_sample_is_bounded_in_rows(spark, write, monkeypatch):
    """Labelled ids that repeat, in the labels and in the documents, enlarge nothing."""
    rows = [(i % 40, f"some {'idiot' if i % 40 < 20 else 'friendly'} words {i % 40} {i % 3}", "en", "s", 1) for i in range(4000)]
    folder = write(rows)
    write([(i % 40, int(i % 40 < 20)) for i in range(200)], "labels", "doc_id long, toxic int")
    seen, real = [], tx._without_copies
    monkeypatch.setattr(tx, "_without_copies", lambda sample: seen.append(sample.groupBy("toxic").count().collect()) or real(sample))
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    tx.fit(docs, labels)
    assert sorted(map(tuple, seen[0])) == [(0, 60), (1, 60)]
    monkeypatch.setattr(tx, "SAMPLE_TOXIC", 30)
    monkeypatch.setattr(tx, "SAMPLE_CLEAN", 10)
    tx.fit(docs, labels)
    assert sorted(map(tuple, seen[1])) == [(0, 10), (1, 30)]
