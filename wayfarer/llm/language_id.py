"""Language identification by Bayesian evidence fusion.

A row's posterior over the languages is the product of
- the text's likelihood under each language's byte trigrams (naive Bayes, fitted on a bounded labelled sample),
- the likelihood of its declared markup language (<html lang>), of its address suffix (top-level domain and
  two-letter first path segment), each from a table of the whole corpus smoothed towards independence,
- its host's prior, smoothed towards its domain's, that towards the corpus'; the row's own share is taken out.
The tables are grouped sums of the text posteriors over all rows, and are joined back by value.
A row is rejected (language "und") if it has no letters or if most of its trigrams, of MIN_TRIGRAMS at least, occur in no
labelled text; other evidence never rejects. Null and empty texts are "und"; null hosts, addresses and declarations are no evidence.
Of languages that are equally likely the first by code wins. Repeated rows get the same result each, and count each in the tables; an empty
table gives an empty result, and without any labelled row all is "und". Keep names columns of the input; evidence and results have names of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_of

#: Labelled rows of each language that the text model is fitted on at most.
FIT_ROWS = 1000
SLOTS, SMOOTH = 1 << 16, 0.5
SEEN_SHARE, MIN_TRIGRAMS = 0.5, 12
#: Rows' worth of the coarser level in a host's and a domain's prior, and of independence in the tables.
HOST_SMOOTH, DOMAIN_SMOOTH, TABLE_SMOOTH = 20.0, 50.0, 20.0
UNKNOWN = "und"
#: ASCII but letters becomes a blank, upper case becomes lower case; other bytes are parts of letters.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
BLOCK = 1 << 20


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of text's words, in blocks."""
    raw = b" ".join((b" " + (text or "").encode("utf-8", "replace").translate(PLAIN) + b" ").split())
    if not raw:
        return
    data = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    for at in range(0, len(data) - 2, BLOCK):
        x = data[at : at + BLOCK + 2]
        yield ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)


def slot_counts(rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(language, slot, n) of rows (language, text)."""
    counts: dict[str, np.ndarray] = {}
    for language, text in rows:
        for slots in trigrams(text):
            counts.setdefault(language, np.zeros(SLOTS, np.int64))
            counts[language] += np.bincount(slots, minlength=SLOTS)
    for language, n in counts.items():
        yield from ((language, int(slot), int(n[slot])) for slot in np.flatnonzero(n))


class TextModel:
    """Log likelihoods (slots x languages) of trigrams, and which slots occur in any labelled text."""

    def __init__(self, languages: list[str], logs: np.ndarray, seen: np.ndarray):
        self.languages, self.logs, self.seen = languages, logs, seen

    @classmethod
    def of_counts(cls, languages: list[str], counts: Iterable[tuple[str, int, int]]) -> TextModel:
        """From how often each slot occurs in each language: (language, slot, n)."""
        found = np.full((SLOTS, len(languages)), SMOOTH)
        place = {x: i for i, x in enumerate(languages)}
        for language, slot, n in counts:
            found[slot, place[language]] += n
        return cls(languages, np.log(found / found.sum(axis=0)).astype(np.float32), (found > SMOOTH).any(axis=1))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        return cls.of_counts(sorted({x for x, _ in rows}), slot_counts(rows))

    def score(self, text: str | None) -> tuple[bool, np.ndarray]:
        """Whether the text is in a known language at all, and its summed log likelihood under each language."""
        n, seen, total = 0, 0, np.zeros(len(self.languages))
        for slots in trigrams(text):
            n += len(slots)
            seen += int(self.seen[slots].sum())
            total += np.bincount(slots, minlength=SLOTS) @ self.logs if len(slots) > SLOTS else self.logs[slots].sum(axis=0, dtype=np.float64)
        return n > 0 and (n < MIN_TRIGRAMS or seen >= SEEN_SHARE * n), total


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> TextModel:
    """The text model of a sample of labelled: of every language the rows of least hash, rows at most.

    All languages of the table are counted, so that none is missing. Trigrams are counted where the rows are and summed by language and slot: the driver gets SLOTS counts
    a language at most, and no text.
    """
    place = F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("fit")), F.lit(1 << 30))
    labelled = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("text"), place.alias("place"))
    # Below the limit are about 2 * rows rows of a language, and its least one in any case.
    limit = F.greatest(F.min("place"), (F.lit(2.0 * rows) / F.count("*") * (1 << 30)).cast("long")).alias("limit")
    limits = materialize(labelled.groupBy("language").agg(limit), "languages")
    chosen = labelled.join(F.broadcast(limits), "language").where("place <= limit")
    first = F.row_number().over(Window.partitionBy("language").orderBy("place", "text"))
    chosen = chosen.withColumn("i", first).where(F.col("i") <= rows)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for frame in frames for x in zip(frame["language"], frame["text"], strict=True))
        yield pd.DataFrame(list(slot_counts(rows)), columns=["language", "slot", "n"])

    counts = chosen.select("language", "text").mapInPandas(count, "language string, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n"))
    return TextModel.of_counts(sorted(r[0] for r in limits.select("language").collect()), map(tuple, counts.collect()))


def declared_in(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute, in lower case; null if there is none."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    return F.when(found != "", F.lower(found))


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def domain_of(host: Column) -> Column:
    found = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(found != "", found)


def suffix_of(url: Column) -> Column:
    """Top-level domain and first path segment where that has two letters, such as com/fr."""
    top = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    first = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]+/([a-zA-Z]{2})(?:[/?#-]|$)", 1))
    found = F.concat_ws("/", F.nullif(top, F.lit("")), F.nullif(first, F.lit("")))
    return F.nullif(found, F.lit(""))


def _share(sums: Column, n: Column, coarse: Column, smooth: float) -> Column:
    return F.zip_with(sums, coarse, lambda s, c: (s + smooth * c) / (n + smooth))


def identify(rows: DataFrame, model: TextModel, text: str = "text", host: str | None = None, domain: str | None = None, declared: str | None = None, suffix: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of rows with text_hash, lang, probability and text_lang (by the text alone).

    host, domain, declared and suffix name string columns of evidence, where rows has such.
    """
    spark, languages = rows.sparkSession, model.languages
    if not languages:
        return rows.select(*keep, F.xxhash64(text_of(text)).alias("text_hash"), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"), F.lit(UNKNOWN).alias("text_lang"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(texts: pd.Series) -> pd.Series:
        own, out = shared.value, []
        for x in texts:
            known, total = own.score(x)
            # Neighbouring trigrams share bytes: each byte counts once. The last entry: is there a language at all?
            out.append([*(total / 3).tolist(), float(known)])
        return pd.Series(out)

    evidence = {"host": host, "domain": domain, "declared": declared, "suffix": suffix}
    body = text_of(text)
    base = rows.select(*keep, F.xxhash64(body).alias("text_hash"), scores(body).alias("s"), *[(F.coalesce(F.col(c), F.lit("")) if c else F.lit("")).alias(f"e_{e}") for e, c in evidence.items()])
    k = len(languages)
    base = base.withColumn("ll", F.slice("s", 1, k)).withColumn("known", F.element_at("s", k + 1) > 0)
    base = base.withColumn("ex", F.transform("ll", lambda x: F.exp(x - F.array_max("ll"))))
    total = F.aggregate("ex", F.lit(0.0), lambda a, x: a + x)
    base = base.withColumn("p", F.when(F.col("known"), F.transform("ex", lambda x: x / total)).otherwise(F.array_repeat(F.lit(0.0), k)))
    base = materialize(base.drop("s", "ex"), "scores")
    sums = [F.sum(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(k)]
    sums_of = lambda df: df.select("*", F.array(*[f"p{i}" for i in range(k)]).alias("sums")).drop(*[f"p{i}" for i in range(k)])
    overall = [x or 0.0 for x in base.agg(*sums).first()]
    mass = sum(overall)
    flat = F.array(*[F.lit((x + 1.0) / (mass + k)) for x in overall])
    joined = base
    for name in evidence:
        if evidence[name]:
            held = sums_of(base.where(F.col(f"e_{name}") != "").groupBy(f"e_{name}").agg(*sums))
            held = materialize(held.withColumnRenamed("sums", f"sums_{name}"), name)
            joined = joined.join(held, f"e_{name}", "left")

    def own_out(name: str) -> tuple[Column, Column]:
        """Sums and mass of the row's value, less the row itself; zero where it has no value."""
        if not evidence[name]:
            return F.array_repeat(F.lit(0.0), k), F.lit(0.0)
        left = F.zip_with(F.coalesce(F.col(f"sums_{name}"), F.col("p")), F.col("p"), lambda s, p: F.greatest(s - p, F.lit(0.0)))
        return left, F.aggregate(left, F.lit(0.0), lambda a, x: a + x)

    prior = flat
    for name, smooth in (("domain", DOMAIN_SMOOTH), ("host", HOST_SMOOTH)):
        if evidence[name]:
            held, n = own_out(name)
            joined = joined.withColumn(f"prior_{name}", _share(held, n, prior, smooth))
            prior = F.col(f"prior_{name}")
    log_post = F.zip_with("ll", prior, lambda a, b: a + F.log(b))
    for name in ("declared", "suffix"):
        if evidence[name]:
            # P(value | language) up to a factor that is the same for all languages: the value's sum for the
            # language over the language's sum, smoothed towards the value's share of the corpus.
            held, n = own_out(name)
            given = F.zip_with(held, flat, lambda s, f: (s + TABLE_SMOOTH * f) / (f * (n + TABLE_SMOOTH)))
            log_post = F.zip_with(log_post, given, lambda a, g: a + F.log(g))
    joined = joined.withColumn("lp", log_post)
    joined = joined.withColumn("ep", F.transform("lp", lambda x: F.exp(x - F.array_max("lp"))))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    post = 1.0 / F.aggregate("ep", F.lit(0.0), lambda a, x: a + x)
    return joined.select(
        *keep,
        "text_hash",
        F.when(F.col("known"), best(F.col("lp"))).otherwise(UNKNOWN).alias("lang"),
        F.when(F.col("known"), post).otherwise(0.0).alias("probability"),
        F.when(F.col("known"), best(F.col("ll"))).otherwise(UNKNOWN).alias("text_lang"),
    )


def identify_pages(pages: DataFrame, model: TextModel, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """identify with the evidence that pages (url, html) have; likelihoods are those of the text without markup."""
    html = text_of("html")
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    host = host_of(F.col("url"))
    rows = pages.select(*keep, plain.alias("text"), host.alias("host"), domain_of(host).alias("domain"), declared_in(html).alias("declared"), suffix_of(F.col("url")).alias("suffix"))
    return identify(rows, model, host="host", domain="domain", declared="declared", suffix="suffix", keep=keep)


def drop_unknown(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", labels: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose language is unknown. The model is fitted on labels (doc_id, text, lang; without them on docs)."""
    found = identify(docs, fit(docs, text, key=key) if labels is None else fit(labels), text, host, keep=(key,))
    out = found.where(F.col("lang") == UNKNOWN).select(F.col(key).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    out = materialize(out, "rejected")
    return docs.join(out, docs[key].eqNullSafe(out["__id"]) & (F.xxhash64(text_of(text)) == out["__hash"]), "left_anti")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document (its source is its host) and for each page."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    found = identify(docs, model, host="source").select("doc_id", F.lit(None).cast("long").alias("page_id"), "lang", "probability", "text_lang")
    pages = identify_pages(table(spark, sf_dir, "pages"), model)
    return found.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "lang", "probability", "text_lang"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
