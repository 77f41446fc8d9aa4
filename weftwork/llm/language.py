"""Operator 7: language identification by Bayesian evidence fusion.

The likelihood of a text under each language comes from byte trigrams (naive Bayes, fitted on a bounded sample of
labelled rows: at most `sample_rows`, in equal shares of the labels, chosen by a hash of the id; all labels take part). It is tempered to at most `evidence` trigrams' worth,
for neighbouring trigrams aren't independent. Declared language of the markup and the suffix of the address add their
own likelihoods. The prior is that of the host, smoothed towards its domain's and that towards all rows'; it comes from
grouped sums of the texts' posteriors, without the row's own.

Defined results: a text without letters (null, empty, signs only) has no text evidence and is rejected, its language is
that of the prior; a text whose best language has less than `least` confidence is rejected; ties go to the language
that sorts first; repeated rows are rows like others; null hosts and declarations are no evidence, null hosts share one
prior; without labelled rows no language is known, all languages are null and nothing is rejected; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import common

BUCKETS = 1 << 16
_KEEP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte trigrams of letters and gaps of all texts in a row, their number in each text)."""
    raw = [b" " + (x or "").lower().encode("utf-8", "surrogatepass") + b" " for x in texts]
    codes = _KEEP[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint32)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    owner_end = np.cumsum(lengths)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
    mixed = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761) >> np.uint32(16)
    inside = np.ones(len(mixed), bool)
    for back in (1, 2):  # those that reach into the next text
        at = owner_end[:-1] - back
        inside[at[at < len(mixed)]] = False
    inside &= (codes[1:-1] != 32) | (codes[:-2] != 32) & (codes[2:] != 32)
    counts = np.diff(np.concatenate([[0], np.cumsum(inside)])[np.minimum(np.concatenate([[0], owner_end]), len(mixed))])
    return mixed[inside].astype(np.int64), counts


def _quotas(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """The rows of each label: equal shares of `rows`, one at least; what a rare label leaves goes to the others."""
    out: dict[str, int] = {}
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, rows // (len(sizes) - i)))
        rows -= out[name]
    return out


def fit(docs: DataFrame, *, label: str = "lang", sample_rows: int = 3000) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from at most sample_rows labelled rows of docs (doc_id, text, label), or one of each label where there are more labels."""
    key = F.xxhash64("__id")
    labelled = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))
    sizes = {r["__label"]: (r["n"], r["least"]) for r in labelled.groupBy("__label").agg(F.count("*").alias("n"), F.min(key).alias("least")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    quotas = _quotas({k: n for k, (n, _) in sizes.items()}, sample_rows)
    # Of each label about twice its quota by hash, and its least hash, so that the ranking meets few rows.
    upto = [(k, quotas[k], max(least, ((1 << 64) - 1) * min(n, 2 * quotas[k] + 100) // n - (1 << 63))) for k, (n, least) in sizes.items()]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(upto, "__label string, __quota long, __upto long"))
    rank = F.row_number().over(Window.partitionBy("__label").orderBy(key, "__id"))
    chosen = labelled.join(bounds, "__label").where(key <= F.col("__upto")).withColumn("__rank", rank).where("__rank <= __quota").select("__id", "__label").distinct()
    sample = docs.join(F.broadcast(chosen), (docs["doc_id"] == chosen["__id"]) & (docs[label] == chosen["__label"]), "left_semi").select(label, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is not None:
                    held = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    grams, _ = trigrams([text])
                    held += np.bincount(grams, minlength=BUCKETS)
        for name, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["language", "bucket", "n"])

    rows = sample.mapInArrow(count, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for name, bucket, n in rows.toLocalIterator():
        found.setdefault(name, np.zeros(BUCKETS))[bucket] += n
    names = sorted(found)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([found[k] for k in names], axis=1) + 0.1
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(rows: DataFrame, table: np.ndarray, *, evidence: int = 200) -> DataFrame:
    """rows (text first, other columns) with grams and ll, the tempered log likelihoods, in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    others = rows.columns[1:]
    schema = rows.select(*others).withColumn("grams", F.lit(0).cast("long")).withColumn("ll", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                grams, counts = trigrams(part.column(0).to_pylist())
                ends = np.cumsum(counts)
                out = np.zeros((len(counts), logs.shape[1]))
                for k in range(logs.shape[1]):
                    sums = np.concatenate([[0.0], np.cumsum(logs[:, k][grams], dtype=np.float64)])
                    out[:, k] = sums[ends] - sums[ends - counts]
                out *= (np.minimum(counts, evidence) / np.maximum(counts, 1))[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * logs.shape[1], pa.int32()), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts), flat], [*others, "grams", "ll"])

    return rows.mapInArrow(run, schema)


def _with(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _softmax(logs: Column) -> Column:
    shifted = _with(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    return _with(shifted, lambda s: _with(F.aggregate(s, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(s, lambda x: x / total)))


def _said(languages: list[str], said: Column, right: float) -> Column:
    """Log likelihoods of what is said (a language code), by language: right if it is that, the rest shared; nothing said or unknown: none."""
    names, other = F.array(*map(F.lit, languages)), (1 - right) / max(1, len(languages) - 1)
    known = F.coalesce(said.isin(*languages), F.lit(False))
    return F.transform(names, lambda k: F.when(~known, F.lit(0.0)).when(said == k, F.log(F.lit(right))).otherwise(F.log(F.lit(other or 1e-9))))


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def identify(
    rows: DataFrame, model: tuple[list[str], np.ndarray], *, keys: list[str], levels: list[Column | str], declared: Column | str | None = None, suffix: Column | str | None = None, text: Column | str = "text",
    least: float = 0.5, smoothing: float = 20.0, declared_right: float = 0.9, suffix_right: float = 0.6,
) -> DataFrame:
    """keys of rows with language, confidence, text_language, grams and accepted, a row for each. levels: the host and what it is part of, from the narrowest."""
    languages, table = model
    if not languages:
        nothing = F.lit(None).cast("string")
        return rows.select(*keys, nothing.alias("language"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_language"), F.lit(0).cast("long").alias("grams"), F.lit(True).alias("accepted"))
    col = lambda x: F.col(x) if isinstance(x, str) else F.lit(None).cast("string") if x is None else x
    own = [f"__l{i}" for i in range(len(levels))]
    held = rows.select(col(text).alias("__text"), *keys, *(col(x).alias(k) for x, k in zip(levels, own, strict=True)), F.lower(col(declared)).alias("__declared"), F.lower(col(suffix)).alias("__suffix"))
    held = common.stage(text_evidence(held, table).withColumn("p", F.when(F.col("grams") > 0, _softmax(F.col("ll")))), "evidence")
    n = len(languages)
    added = lambda of: F.array(*(F.coalesce(F.sum(F.element_at(of, i + 1)), F.lit(0.0)) for i in range(n))).alias("s")
    sums = [held.groupBy(*own).agg(F.count("p").alias("n"), added("p"))]
    for i in range(1, len(own)):
        sums.append(sums[-1].groupBy(*own[i:]).agg(F.sum("n").alias("n"), added("s")))
    total, all_ = sums[-1].agg(F.coalesce(F.sum("n"), F.lit(0)), added("s")).first()
    prior = F.array(*(F.lit((x + 1) / (total + n)) for x in all_))
    # From the widest level down; the host's own sums stay apart, as each row takes its own share out of them.
    above = sums[-1].select(*(F.col(k).alias(f"{k}a") for k in own[-1:]), F.col("n").alias("host_n"), F.col("s").alias("host_s"), prior.alias("prior"))
    for i in range(len(own) - 2, -1, -1):
        smoothed = F.zip_with("host_s", "prior", lambda x, q: (x + smoothing * q) / (F.col("host_n") + smoothing))
        wide = above.select(*(f"{k}a" for k in own[i + 1 :]), smoothed.alias("prior"))
        above = sums[i].join(wide, _same(own[i + 1 :], [f"{k}a" for k in own[i + 1 :]])).select(*(F.col(k).alias(f"{k}a") if k == own[i] else f"{k}a" for k in own[i:]), F.col("n").alias("host_n"), F.col("s").alias("host_s"), "prior")
    joined = held.join(above, _same(own, [f"{k}a" for k in own]))
    own_n = F.when(F.col("p").isNull(), 0).otherwise(1)
    rest = F.zip_with("host_s", F.coalesce("p", F.array_repeat(F.lit(0.0), n)), lambda x, y: F.greatest(F.lit(0.0), x - y))
    prior = F.zip_with(rest, "prior", lambda x, q: (x + smoothing * q) / (F.col("host_n") - own_n + smoothing))
    said = F.zip_with(_said(languages, F.col("__declared"), declared_right), _said(languages, F.col("__suffix"), suffix_right), lambda a, b: a + b)
    logs = F.zip_with(F.zip_with("ll", prior, lambda a, q: a + F.log(q)), said, lambda a, b: a + b)
    joined = joined.withColumn("post", _softmax(logs))
    names = F.array(*map(F.lit, languages))
    pick = lambda of: F.element_at(names, F.array_position(of, F.array_max(of)).cast("int"))
    confidence = F.array_max("post")
    return joined.select(*keys, pick("post").alias("language"), confidence.alias("confidence"), F.when(F.col("grams") > 0, pick("ll")).alias("text_language"), "grams", ((F.col("grams") > 0) & (confidence >= least)).alias("accepted"))


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, pattern, 1)), F.lit(""))


DECLARED = r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})"""


def of_documents(docs: DataFrame, *, keys: tuple = ("doc_id",), **options) -> DataFrame:
    """identify() for docs (doc_id, text, lang, source): lang is the label to fit on, source the host; markup and addresses that the text itself holds are evidence too."""
    text = F.col("text")
    declared = F.when(text.contains("<html"), _found(text, DECLARED))
    suffix = F.when(text.contains("://"), _found(text, r"://[^\s/:?#]+\.([A-Za-z]{2})(?![\w.])"))
    return identify(docs, fit(docs), keys=list(keys), levels=["source"], declared=declared, suffix=suffix, **options)


def of_pages(pages: DataFrame, model: tuple[list[str], np.ndarray], **options) -> DataFrame:
    """identify() for pages (page_id, url, html) with their markup's lang, address, host, its domain and the domain's zone."""
    url, html = F.col("url"), F.col("html")
    host = _found(url, r"^[A-Za-z][\w+.-]*://([^/:?#]+)")
    parts = F.split(host, r"\.")
    zone = F.element_at(parts, -1)
    domain = F.when(F.size(parts) >= 2, F.concat_ws(".", F.element_at(parts, -2), zone)).otherwise(host)
    suffix = F.coalesce(_found(url, r"^[A-Za-z][\w+.-]*://[^/]+/([A-Za-z]{2})(?:[/?#]|$)"), F.nullif(F.regexp_extract(host, r"\.([a-z]{2})$", 1), F.lit("")))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    return identify(pages, model, keys=["page_id"], levels=[host, domain, zone], declared=_found(html, DECLARED), suffix=suffix, text=bare, **options)


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are rejected; all columns stay."""
    rows = common.with_row(docs)
    gone = of_documents(rows, keys=("__file", "__at"), **options).where(~F.col("accepted"))
    return common.without_rows(rows, gone)
