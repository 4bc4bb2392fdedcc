import math
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pytest

from shelfwise.llm import langid as li


def slow_buckets(text):
    b = [c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in f" {text or ''} ".encode()]
    b = [c for i, c in enumerate(b) if c != 32 or i == 0 or b[i - 1] != 32]
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        m = (x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % 2**32
        out.append(((m ^ m >> 15) * 0x2C1B3C6D) % 2**32 >> 16)
    return out


@pytest.mark.parametrize("text", ["Hello,  World!", "", None, "123", "é", "a"])
def test_trigrams(text):
    assert [int(c) for part in li.trigrams(text) for c in part] == slow_buckets(text)


def test_documents_and_pages(spark, sf_dir):
    got = li.op4_language_id(spark, sf_dir).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pages = {p.page_id: p.html.split('lang="')[1][:2] for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    of_docs, of_pages = [r for r in got if r.doc_id is not None], [r for r in got if r.page_id is not None]
    assert len(of_docs) == len(docs) and len(of_pages) == len(pages) and len(got) == len(docs) + len(pages)
    assert np.mean([r.language == docs[r.doc_id].lang for r in of_docs]) > 0.99
    assert np.mean([r.language == pages[r.page_id] for r in of_pages]) > 0.99
    assert np.mean([r.kept for r in of_docs]) > 0.995


def slow_fuse(rows, languages):
    """The same posterior, row by row in Python."""
    n = len(languages)
    guess = [int(np.argmax(r["ll"])) if min(r["ll"]) < 0 else None for r in rows]
    share = [sum(g == i for g in guess) for i in range(n)]
    known = [(s + 1) / (sum(share[:-1]) + n - 1) for s in share[:-1]]
    corpus = [*known, li.UNKNOWN_PRIOR]

    def shares(key, value, parent):
        k = [sum(g == i for g, r in zip(guess, rows) if r[key] == value) for i in range(n)]
        return [(a + li.SMOOTHING * q) / (sum(k) + li.SMOOTHING) for a, q in zip(k, parent)]

    out = []
    for r in rows:
        prior = corpus if r["host"] is None else shares("host", r["host"], shares("domain", r["domain"], corpus))
        post = [np.log(max(p, 1e-12)) + li.TEMPER * x for p, x in zip(prior, r["ll"])]
        for signal in ("declared", "suffix"):
            if r[signal] in languages:
                k = [sum(g == i for g, x in zip(guess, rows) if x[signal] == r[signal]) for i in range(n)]
                post = [a + np.log((c + 1) / (s + n)) for a, c, s in zip(post, k, share)]
        w = np.exp(np.array(post) - max(post))
        out.append((languages[int(np.argmax(w))], 1 / w.sum()))
    return out


def test_fusion_against_rows(spark):
    rng = np.random.default_rng(3)
    languages = ["de", "en", "fr", li.UNKNOWN]
    rows = []
    for i in range(120):
        host = rng.choice(["a.x.com", "b.x.com", "c.y.de", None], p=[0.5, 0.2, 0.2, 0.1])
        ll = [0.0] * 4 if i % 17 == 0 else (-rng.random(4) * 20 - 1).tolist()
        pick = lambda: rng.choice(["de", "en", "fr", "xx", None])
        rows.append({"id": i, "ll": ll, "declared": pick(), "suffix": pick(), "host": host, "domain": host and host[2:]})
    df = spark.createDataFrame([tuple(None if v is None else (str(v) if isinstance(v, str) else v) for v in r.values()) for r in rows], "id long, ll array<double>, declared string, suffix string, host string, domain string")
    got = {r.id: r for r in li.fuse(df, languages).collect()}
    for r, (language, posterior) in zip(rows, slow_fuse(rows, languages)):
        assert got[r["id"]].posterior == pytest.approx(posterior)
        if posterior < 0.999 and sum(r["ll"]) < 0:
            assert got[r["id"]].language == language


def slow_logs(docs):
    """Logarithms of the share of each bucket, by language, counted one trigram at a time."""
    counts = {}
    for d in docs:
        if d.lang is not None and d.text is not None:
            counts.setdefault(d.lang, Counter()).update(slow_buckets(d.text))
    size = 1 << 16
    logs = {}
    for lang, own in sorted(counts.items()):
        all_ = sum(own.values()) + 0.1 * size
        logs[lang] = lambda b, own=own, all_=all_: float(np.float32(math.log((own[b] + 0.1) / all_)))
    logs[li.UNKNOWN] = lambda b: float(np.float32(math.log(1 / size)))
    return logs


def slow_page(page, known):
    """What a page says of its language, taken apart with the standard library."""
    html = page.html or ""
    declared = re.search(r"""<html[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", html, re.I)
    address = urlsplit(page.url or "")
    host = address.hostname
    first = address.path.split("/")[1:2] or [""]
    signs = [first[0][:2].lower() if re.fullmatch(r"[A-Za-z]{2}([\-_].*)?", first[0]) else None, host.split(".")[-1] if host else None]
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?[A-Za-z0-9_]+;", " ", html)
    return {"text": text, "declared": declared and declared[1].lower(), "suffix": next((x for x in signs if x in known), None), "host": host, "domain": host and ".".join(host.split(".")[-2:])}


def test_query_against_brute_force(spark):
    """Every row of the registered query: the model, the evidence and the fusion done row by row."""
    small = "/root/testdata/sf0.001"
    docs, pages = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "pages"))
    logs = slow_logs(docs)
    languages = list(logs)

    def ll(text):
        seen = Counter(slow_buckets(text))
        return [sum(n * log(b) for b, n in seen.items()) for log in logs.values()]

    of_docs = [{"text": d.text, "declared": None, "suffix": None, "host": d.source, "domain": d.source} for d in docs]
    of_pages = [slow_page(p, languages[:-1]) for p in pages]
    got = li.op4_language_id(spark, small).collect()
    assert len(got) == len(docs) + len(pages)
    for key, table, rows in (("doc_id", docs, of_docs), ("page_id", pages, of_pages)):
        rows = [{**r, "ll": ll(r["text"])} for r in rows]
        mine = {r[key]: r for r in got if r[key] is not None}
        for row, r, (language, posterior) in zip(table, rows, slow_fuse(rows, languages)):
            found = mine[row[key]]
            assert found.posterior == pytest.approx(posterior, rel=1e-4)
            if min(r["ll"]) < 0:
                assert found.language == language
            assert found.kept == (min(r["ll"]) < 0 and language != li.UNKNOWN and posterior >= li.CERTAIN)


def test_evidence_from_pages(spark):
    rows = [
        (1, "https://m.site.example.com/fr/1?x", "<!doctype html><HTML class='a' lang='FR-ca'><p>a &amp; b</p><script>x<y</script>"),
        (2, "http://user@shop.de:80/", "<html><p>c"), (3, None, None), (4, "mailto:x", "plain"),
    ]
    got = {r.page_id: r for r in li.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"), ["de", "fr"]).collect()}
    assert (got[1].declared, got[1].suffix, got[1].host, got[1].domain, got[1].text.split()) == ("fr", "fr", "m.site.example.com", "example.com", ["a", "b"])
    assert (got[2].declared, got[2].suffix, got[2].host, got[2].domain) == (None, "de", "shop.de", "shop.de")
    assert (got[3].declared, got[3].suffix, got[3].host, got[3].text) == (None, None, None, None)
    assert (got[4].host, got[4].text) == (None, "plain")


def test_odd_rows(spark, sf_dir, write, odd_docs):
    model = li.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = spark.read.parquet(f"{write(odd_docs)}/documents.parquet")
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    assert not any(got[i].kept for i in (4, 5, 6))
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    assert li.keep_identified(docs.where("doc_id < 0")).count() == 0
    # without a single label no language is known: only texts without letters go
    unlabelled = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert sorted(r.doc_id or 0 for r in li.keep_identified(unlabelled).collect()) == [0, 1, 2, 3, 7, 8, 9, 9, 10, 11]
    assert model.languages[int(np.argmax(model.score("日本語のテキスト"))) ] == li.UNKNOWN


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 10])
def test_chunks_lose_no_trigram(monkeypatch, chunk):
    for text in ("Straße  12, the quick -- brown fox, " * 4, "a", "", None, "   ", "  ab  ", "é" * 9):
        whole = np.concatenate([*li.trigrams(text), np.zeros(0, np.uint32)])
        with monkeypatch.context() as m:
            m.setattr(li, "_CHUNK", chunk)
            assert np.concatenate([*li.trigrams(text), np.zeros(0, np.uint32)]).tolist() == whole.tolist()
