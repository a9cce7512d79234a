"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (one to ``max_n`` characters, hashed into ``buckets``) per language in a distributed
aggregation over a bounded sample of labelled rows, ``max_rows`` per language.  The log-probability matrix
(languages x buckets, its size is fixed by the parameters) is broadcast, and tasks score whole texts in numpy:
rows of the matrix are gathered per n-gram and summed per text.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text is lower-cased, and every
run of non-letters is one space; rows with null language or text do not train; equal posteriors give the first
language by name; a null doc_id hashes like an empty one; if nothing can be learned every text is ``und``; repeated rows are scored alike; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ship_package, table
from .textops import mixed, trimmed

UND = "und"
BUCKETS = 1 << 14
MAX_N = 3
CHUNK_CHARS = 100_000
#: n-grams beyond this many add no confidence to the score; all of them decide the language
EVIDENCE = 40
_folded: list = []


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == rest


def _fold() -> np.ndarray:
    """Code point to its lower-case letter, or to a space (32) if it is no letter."""
    if not _folded:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _folded.append(out)
    return _folded[0]


def _texts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def grams(texts: list[str], buckets: int = BUCKETS, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number, text has a letter) of all n-grams; n-grams lie inside their text, padded by one space."""
    sizes = np.fromiter((len(t) + 3 for t in texts), np.int64, len(texts))
    data = np.frombuffer("".join(f" {t} \0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _fold()[data]
    ends = np.cumsum(sizes) - 1
    code[ends] = 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = ~((code == 32) & (np.concatenate([[0], code[:-1]]) == 32))
    code, owner = code[keep].astype(np.uint64), owner[keep]
    letters = np.bincount(owner[code > 32], minlength=len(texts)) > 0
    out_b, out_d = [], []
    rolled = np.zeros(len(code), np.uint64)
    alive = np.ones(len(code), bool)
    for n in range(1, max_n + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        rolled, alive = rolled[:m] * np.uint64(0x100000001B3) + code[n - 1 :], alive[:m] & (code[n - 1 :] != 0)
        good = alive if n > 1 else alive & (code != 32)
        h = mixed(rolled[good] + np.uint64(n << 40))
        out_b.append((h % np.uint64(buckets)).astype(np.int32))
        out_d.append(owner[:m][good])
    bucket, doc = np.concatenate(out_b), np.concatenate(out_d)
    order = np.argsort(doc, kind="stable")
    return bucket[order], doc[order], letters


def _count(batches: Iterator[pa.RecordBatch], buckets: int, max_n: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            for part in _texts([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                bucket, _, _ = grams(part, buckets, max_n)
                got = np.bincount(bucket, minlength=buckets)
                total[lang] = total[lang] + got if lang in total else got
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at].astype(np.int64))})


class Model:
    """Languages, log probabilities of their n-grams (a float32 matrix of fixed size) and log priors.

    The language is the one of the largest posterior.  The score is the softmax of the mean log-probability of a
    text's n-grams, times their number but at most ``evidence`` (long texts would all score 1), plus the prior.
    """

    def __init__(self, langs: list[str], weights: np.ndarray, max_n: int, prior: np.ndarray | None = None, evidence: int = EVIDENCE):
        self.langs, self.weights, self.max_n, self.evidence = langs, weights, max_n, evidence
        self.prior = np.zeros(len(langs)) if prior is None else prior

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for part in _texts(texts):
            bucket, doc, letters = grams(part, self.weights.shape[0], self.max_n)
            n = np.bincount(doc, minlength=len(part))
            sums = np.stack([np.bincount(doc, weights=self.weights[bucket, j], minlength=len(part)) for j in range(len(self.langs))], axis=1) if self.langs else np.zeros((len(part), 0))
            best = np.argmax(sums + self.prior, axis=1) if self.langs else np.zeros(len(part), np.int64)
            z = sums / np.maximum(n, 1)[:, None] * np.minimum(n, self.evidence)[:, None] + self.prior
            for i in range(len(part)):
                if not letters[i] or not self.langs:
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                e = np.exp(z[i] - z[i].max())
                langs.append(self.langs[int(best[i])])
                scores.append(float(e[best[i]] / e.sum()))
        return langs, scores


def fit(docs: DataFrame, max_rows: int = 4000, buckets: int = BUCKETS, max_n: int = MAX_N, smoothing: float = 0.5, evidence: int = EVIDENCE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``: of each language about ``max_rows`` rows, those with the least hash of the id.

    The bound on training rows is the only sampling; ``max_rows`` x languages rows are read at most (in expectation).
    """
    ship_package(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count()
    seen = {r["lang"]: r["count"] for r in counts.collect()}
    share = {lang: min(1.0, max_rows / many) for lang, many in seen.items()}
    if not share:
        return Model([], np.zeros((buckets, 0), np.float32), max_n)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000.0
    sample = known.filter(unit < limit).select("lang", "text")
    got = sample.mapInArrow(lambda b: trimmed(_count(b, buckets, max_n)), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = got.toPandas()
    langs = sorted(share)
    n = np.zeros((buckets, len(langs)))
    n[rows["bucket"].to_numpy(np.int64), [langs.index(x) for x in rows["lang"]]] = rows["n"]
    many = np.array([seen[x] for x in langs], float)
    return Model(langs, np.log((n + smoothing) / (n + smoothing).sum(axis=0)).astype(np.float32), max_n, np.log(many / many.sum()), evidence)


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score`` (replaced if they exist); whole texts are scored."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in (lang.lower(), score.lower())]
    schema = T.StructType([*kept, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(lambda b: trimmed(run(b)), schema)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is not ``und`` and was predicted with at least ``min_score``; all columns stay."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    out = identify(docs, fit(learnable(docs)), lang, score)
    return out.filter((F.col(lang) != UND) & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(learnable(docs)))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
