"""Language identification by Bayesian fusion of evidence.

Text gives a likelihood from hashed byte trigrams. The language a page declares in its markup
and the language code in its address are noisy signals, whose reliability is counted over the
whole corpus. The host gives a prior, smoothed towards its domain and then the corpus. All
counts are grouped aggregates over the first, text-only guesses of all rows. The posterior adds
the logarithms; "und" (no known language) competes as a uniform text model.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import materialise, packed, without

#: Labelled documents of each language that the trigram model is fitted on: least hashes of the id.
SAMPLE_PER_LANGUAGE = 1500
MAX_LANGUAGES = 200
UNKNOWN = "und"
#: Strength of each level of smoothing, in rows; text evidence is tempered, as trigrams overlap.
SMOOTHING, TEMPER = 20.0, 0.3
#: Prior of the unknown language, and the posterior a language needs.
UNKNOWN_PRIOR, CERTAIN = 1e-4, 0.5
_BUCKET_BITS = 16
_CHUNK = 1 << 20

_FOLD = np.full(256, 32, np.uint32)  # anything that is no letter is a space
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a text, letters only, runs of others are a space. Texts of
    any length are taken whole, in chunks that carry on the last two bytes of the one before."""
    raw = np.frombuffer(f" {text or ''} ".encode("utf-8", "surrogatepass"), np.uint8)
    carried = np.zeros(0, np.uint32)
    for start in range(0, len(raw), _CHUNK):
        b = np.concatenate([carried, _FOLD[raw[start : start + _CHUNK]]])
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
        carried = b[-2:]
        if len(b) > 2:
            mixed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
            yield (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _BUCKET_BITS)


class TrigramModel:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = [*sorted(counts), UNKNOWN]
        p = [(counts[s] + 0.1) / (counts[s].sum() + 0.1 * len(counts[s])) for s in self.languages[:-1]]
        uniform = np.full(1 << _BUCKET_BITS, 2.0**-_BUCKET_BITS)
        self.logs = np.log(np.stack([*p, uniform], 1)).astype(np.float32)

    def score(self, text: str | None) -> np.ndarray:
        """Log-likelihood under each language; zeros for a text without letters."""
        total = np.zeros(len(self.languages))
        for codes in trigrams(text):
            total += self.logs[codes].sum(0, dtype=np.float64)
        return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(1 << _BUCKET_BITS, np.int64))
            for codes in trigrams(text):
                own += np.bincount(codes, minlength=len(own))
    for lang, own in counts.items():
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> TrigramModel:
    """Fit on a bounded sample of (doc_id, text, lang) rows, the same whatever the row order."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("lang", F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sampled = F.lit(False)
    for lang, n in sizes.items():  # hashes are uniform: a share of their range is a share of the rows
        bound = int(-(2**63) + min(1.0, per_language / n) * (2**64 - 1))
        sampled |= (F.col("lang") == lang) & (F.xxhash64("doc_id") <= min(bound, 2**63 - 1))
    counted = rows.where(sampled).select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in table.groupby("lang"):
        counts[lang] = np.zeros(1 << _BUCKET_BITS)
        counts[lang][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return TrigramModel(counts)


def text_scores(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """Replace the column ``text`` by ``ll``: one log-likelihood for each of model.languages."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keys = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = pa.array([shared.value.score(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], ll], names=[*keys, "ll"])

    schema = rows.select(*keys).schema.add("ll", T.ArrayType(T.DoubleType()))
    return rows.select(*keys, "text").mapInArrow(run, schema)


def _shares(rows: DataFrame, key: str, languages: list[str], parent: Column, parent_df: DataFrame | None, on: str | None) -> DataFrame:
    """(key, p): language shares of the key's rows, smoothed by SMOOTHING rows of the parent's shares."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key, *([on] if on else [])).agg(
        F.array(*[F.sum((F.col("guess") == i).cast("long")) for i in range(len(languages))]).alias("n")
    )
    if parent_df is not None:
        counts = counts.join(parent_df, on)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    p = F.zip_with("n", parent, lambda n, q: (n + SMOOTHING * q) / (total + SMOOTHING))
    return counts.select(key, p.alias(f"{key}_p"))


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Add language and posterior to rows with ll, declared, suffix, host and domain (any may be null).

    The text-only guesses of all rows give P(language | host), smoothed towards the domain and
    the corpus, and P(signal | language) for the declared and the address language.
    """
    n = len(languages)
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    # a text without letters says nothing and is not counted
    guessed = scored.withColumn("guess", F.when(F.array_min("ll") < 0, best))
    totals = guessed.agg(*[F.sum((F.col("guess") == i).cast("long")).alias(f"n{i}") for i in range(n)]).first()
    share = np.array([t or 0 for t in totals], float)
    known = (share[:-1] + 1) / (share[:-1].sum() + n - 1)
    corpus = F.array(*[F.lit(float(p)) for p in known], F.lit(UNKNOWN_PRIOR))
    domains = _shares(guessed, "domain", languages, corpus, None, None)
    hosts = _shares(guessed, "host", languages, F.col("domain_p"), domains, "domain")
    # rows without a host find nothing: a spread-out key keeps them from meeting in one task
    key = F.coalesce("host", F.concat(F.lit("\0"), F.pmod(F.xxhash64("ll"), F.lit(1 << 16)).cast("string")))
    out = guessed.withColumn("__host", key).join(hosts.withColumnRenamed("host", "__host"), "__host", "left").drop("__host")
    prior = F.coalesce("host_p", corpus)
    log_post = F.zip_with(prior, "ll", lambda p, x: F.log(F.greatest(p, F.lit(1e-12))) + TEMPER * x)
    seen = F.array(*[F.lit(s) for s in languages])
    for signal in ("declared", "suffix"):
        given = F.array(*[F.sum((F.col("guess") == i).cast("long")) for i in range(n)])
        # P(signal | language), smoothed: an unseen pair is possible, as signals may be wrong
        reliability = guessed.where(F.col(signal).isin(languages)).groupBy(signal).agg(given.alias("n"))
        p = F.zip_with("n", F.array(*[F.lit(float(s)) for s in share]), lambda k, all_: (k + 1.0) / (all_ + n))
        out = out.join(F.broadcast(reliability.select(signal, p.alias(f"{signal}_p"))), signal, "left")  # one row a language
        log_post = F.when(F.col(f"{signal}_p").isNull(), log_post).otherwise(F.zip_with(log_post, f"{signal}_p", lambda a, q: a + F.log(q)))
    out = out.withColumn("log_post", log_post)
    top = F.array_max("log_post")
    weight = F.aggregate(F.transform("log_post", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    language = F.element_at(seen, F.array_position("log_post", top).cast("int"))
    return out.withColumns({"language": language, "posterior": 1 / weight})


def accepted(languages: list[str]) -> Column:
    """A text with letters, in a known language, with enough certainty. Where no language is known
    at all, as nothing was labelled, a text is not rejected for its language."""
    known = (F.col("language") != UNKNOWN) & (F.col("posterior") >= CERTAIN)
    return (F.array_min("ll") < 0) & (known if len(languages) > 1 else F.lit(True))


def _document_evidence(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    source = F.col("doc.source").cast("string")
    return rows.select("doc.doc_id", "row", "doc.text", none.alias("declared"), none.alias("suffix"), source.alias("host"), source.alias("domain"))


def _identified(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """doc_id, row, language, posterior, kept of packed documents."""
    scored = materialise(text_scores(_document_evidence(rows), model), "langid")
    return fuse(scored, model.languages).select("doc_id", "row", "language", "posterior", accepted(model.languages).alias("kept"))


def identify(docs: DataFrame, model: TrigramModel) -> DataFrame:
    """doc_id, language, posterior, kept for each document; its source stands for the host.

    Null, empty and letterless texts are not kept. Null sources take the corpus prior. Repeated
    rows count as often as they occur; very long texts count whole; an empty table gives no rows;
    extra columns are ignored.
    """
    return _identified(docs.select(F.struct("*").alias("doc"), F.lit(0).alias("row")), model).drop("row")


def keep_identified(docs: DataFrame, model: TrigramModel | None = None, row: Column | None = None) -> DataFrame:
    """The whole documents whose language is known, with their own columns, whatever their names.

    Null, empty and letterless texts go. Without a model one is fitted on the labelled rows; if
    there are none, no language is known and only letterless texts go. Repeated rows stay or go
    together; an empty table stays empty. ``row`` as in ``packed``.
    """
    rows = packed(docs, row)
    found = _identified(rows, model or fit(rows.select("doc.doc_id", "doc.text", "doc.lang")))
    return without(rows, found.where("NOT kept"))


def page_evidence(pages: DataFrame, languages: list[str]) -> DataFrame:
    """What a page says of its language: markup, address, host, and its text without the markup."""
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    authority = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    in_path = F.lower(F.regexp_extract("url", r"://[^/?#]+/([A-Za-z]{2})(?:[/?#\-_]|$)", 1))
    end = F.regexp_extract(authority, r"\.([a-z]{2,})$", 1)
    suffix = F.when(in_path.isin(languages), in_path).when(end.isin(languages), end)
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return pages.select(
        "page_id", text.alias("text"), F.when(declared != "", declared).alias("declared"), suffix.alias("suffix"),
        F.when(authority != "", authority).alias("host"), F.when(authority != "", F.regexp_extract(authority, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )


def identify_pages(pages: DataFrame, model: TrigramModel) -> DataFrame:
    """page_id, language, posterior, kept from all four kinds of evidence.

    Null html is a text without letters, a null or odd url one without host. Repeated rows are
    pages like any other; an empty table gives no rows; extra columns are ignored.
    """
    scored = materialise(text_scores(page_evidence(pages, model.languages[:-1]), model), "langid")
    return fuse(scored, model.languages).select("page_id", "language", "posterior", accepted(model.languages).alias("kept"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (doc_id) and every page (page_id) with its language."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    model = fit(docs)
    columns = ("doc_id", "page_id", "language", "posterior", "kept")
    of_docs = identify(docs, model).withColumn("page_id", F.lit(None).cast("long"))
    of_pages = identify_pages(pages, model).withColumn("doc_id", F.lit(None).cast("long"))
    return of_docs.select(*columns).unionByName(of_pages.select(*columns))
