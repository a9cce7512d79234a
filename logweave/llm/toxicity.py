"""Toxicity: a bag of subword embeddings, averaged, into a linear softmax; trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (3 to 5, with word boundaries)
and of the whole word, so unseen misspellings share most of a known word's vectors.  A passage is the weighted
mean of its words' vectors: every occurrence counts, the k-th of a word k ** -repeats (0: all alike).  A softmax over two
classes sits on top; both are trained together on a bounded sample of labelled rows.  A document has a passage of
``window`` words at every half window, over its whole text, is one passage as a whole too, and gets the largest
probability, so a few words in a very long text still count.

Defined cases: a null or empty text has no words and gets the model's bias as score; rows without a label do
not train; a null doc_id hashes like an empty one; labels may repeat (the largest counts); without labels, or with
labels 0 only, all scores are 0, with labels 1 only 1; repeated rows are scored alike; extra columns are kept by ``score_texts``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, ship_package, table
from .language_id import held_out
from .textops import mixed, trimmed

WORD = re.compile(r"\w+")
CACHE_WORDS = 300_000
#: longer runs of word characters (scripts without spaces, joined text) are scored in pieces
RUN = 60
#: neutral words that every passage counts besides its own, so that one word alone decides nothing
SMOOTH = 10
#: the k-th occurrence of a word in a passage counts k ** -REPEATS, so a line said fifty times does not outweigh a passage
REPEATS = 2.0


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of the character n-grams of each word and of the word itself, ordered by word.

    Words are taken whole, with boundary marks.
    """
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(end, size) - np.arange(len(code))  # characters up to the word's end
    found, whose = [], []
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, 6):
        m = max(0, len(code) - n + 1)
        rolled = rolled[:m] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n >= 3:
            inside = left[:m] >= n
            found.append(mixed(rolled[inside] + np.uint64(n << 50)))
            whose.append(owner[:m][inside])
    if len(words):
        place = (np.arange(len(code)) - np.repeat(end - size, size)).astype(np.uint64)
        found.append(np.add.reduceat(mixed(code + (place << np.uint64(32))), end - size))
        whose.append(np.arange(len(words)))
    bucket, word = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(word, kind="stable")
    return (bucket[order] % np.uint64(buckets)).astype(np.int64), word[order]


class _Memo(dict):
    """A bounded cache of a function of strings."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.of(key)
        if len(key) <= 1000:
            self[key] = out
        return out


def split_words(chunk: str) -> tuple[str, ...]:
    """Lower-cased words; a run beyond RUN characters counts as pieces that overlap, so that each holds every n-gram that starts in its first RUN."""
    out = []
    for w in WORD.findall(chunk.lower()):
        out += [w] if len(w) <= RUN else [w[a : a + RUN + 4] for a in range(0, len(w) - 4, RUN)]
    return tuple(out)


_pieces = _Memo(split_words)


def words_of(text: str) -> list[str]:
    """Lower-cased words in order, with every repeat and all pieces of long runs."""
    return list(chain.from_iterable(map(_pieces.__getitem__, text.split())))


def passages(ids: np.ndarray, first: np.ndarray, window: int, rows: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, starts, word ids as rows) of the passages of texts ``ids[first[i]:first[i + 1]]``, ``rows`` at a time.

    A text of up to ``window`` words is one passage; a longer one has a passage at every half window and at its end.
    Rows of shorter texts are filled up with -1; a text without words has no passage.
    """
    n = np.diff(first)
    step = max(1, window // 2)
    many = np.where(n > window, -(-(n - window) // step) + 1, (n > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(many)])
    padded = np.concatenate([ids, np.full(window, -1, ids.dtype)])
    for a in range(0, int(before[-1]), rows):
        k = np.arange(a, min(a + rows, int(before[-1])))
        text = np.searchsorted(before, k, side="right") - 1
        start = np.minimum((k - before[text]) * step, np.maximum(n[text] - window, 0))
        own = padded[(first[text] + start)[:, None] + np.arange(window)]
        own[np.arange(window) >= n[text][:, None]] = -1
        yield text, start, own


def repeat_weights(rows: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by word id, and what each occurrence counts: the k-th of a word in its row k ** -power; fillings (-1) count nothing."""
    rows = np.sort(rows, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    place = np.arange(rows.shape[1])
    k = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return rows, np.where(rows >= 0, (np.arange(1, rows.shape[1] + 1.0) ** -power)[k], 0.0)


class Classifier:
    """``value`` (buckets): what a subword adds to the log odds; ``bias``; ``common``: weights of words that many texts have.

    ``repeats``: the k-th occurrence of a word in a passage counts k ** -repeats.
    """

    def __init__(self, value: np.ndarray, bias: float, window: int, common: dict[str, float] | None = None, repeats: float = 0.0):
        self.value, self.bias, self.window, self.common, self.repeats = value, bias, window, common or {}, repeats
        self._forget()

    def __reduce__(self):
        return Classifier, (self.value, self.bias, self.window, self.common, self.repeats)

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._values = np.zeros(1)  # by number, 1 and up; the last stands for fillings

    def word(self, w: str) -> float:
        return float(self._learn([w])[0])

    def _learn(self, words: list[str]) -> np.ndarray:
        bucket, word = subwords(words, len(self.value))
        mean = np.bincount(word, weights=self.value[bucket], minlength=len(words)) / np.bincount(word, minlength=len(words))
        return mean * np.fromiter((self.common.get(w, 1.0) for w in words), np.float64, len(words))

    def log_odds(self, texts: list[str | None]) -> list[float]:
        """Whole texts; 200 at a time, whose unknown words are looked up together."""
        out: list[float] = []
        for a in range(0, len(texts), 200):
            split = [words_of(t or "") for t in texts[a : a + 200]]
            if len(self._number) > CACHE_WORDS:
                self._forget()
            new = sorted(set(chain.from_iterable(split)).difference(self._number))
            if new:
                self._number.update(zip(new, range(len(self._number), len(self._number) + len(new)), strict=True))
                self._values = np.concatenate([self._values[:-1], self._learn(new), [0.0]])
            first = np.concatenate([[0], np.cumsum([len(w) for w in split])])
            ids = np.fromiter(map(self._number.__getitem__, chain.from_iterable(split)), np.int32, first[-1])
            best = self._whole(ids, first)
            for text, _, rows in passages(ids, first, self.window):
                rows, weight = repeat_weights(rows, self.repeats)
                size = np.minimum(np.diff(first)[text], self.window)
                np.maximum.at(best, text, (self._values[rows] * weight).sum(axis=1) / (size + SMOOTH))
            out += (self.bias + best).tolist()
        return out

    def _whole(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each text as one passage; 0 without words."""
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        pair, times = np.unique(owner * np.int64(len(self._values)) + ids, return_counts=True)
        upto = np.cumsum(np.arange(1, times.max(initial=0) + 1.0) ** -self.repeats)
        text, word = np.divmod(pair, len(self._values))
        return np.bincount(text, weights=self._values[word] * upto[times - 1], minlength=len(n)) / (n + SMOOTH)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(self.log_odds(texts), float), -60, 60)))


def train(texts: list[str], labels: list[int], buckets: int = 1 << 20, dim: int = 4, rounds: int = 12, steps: int = 10, rate: float = 15_000.0, momentum: float = 0.9, penalty: float = 1.5e-5, min_docs: int = 6, rarity: float = 0.02, window: int = 60, repeats: float = 0.0, seed: int = 7) -> Classifier:
    """Joint training of subword vectors and softmax on passages.  Classes are weighted evenly.

    In every round a text is trained on through the passage that its current model finds most toxic, as in scoring; in the
    first round through any passage.  A round is ``steps`` proximal gradient steps over all passages: the length of every
    subword's vector shrinks by ``penalty`` (a group lasso), so subwords that only happen to stand in toxic texts
    stay at zero.
    """
    if not texts or len(set(labels)) < 2:
        return Classifier(np.zeros(buckets, np.float32), -60.0 if not any(labels) else 60.0, window, None, repeats)
    vocab: dict[str, int] = {}
    docs = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in words_of(t or "")), np.int32) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ids = np.concatenate(docs)
    names = list(vocab)
    slices = [(len(part), *subwords(part, buckets)) for part in (names[a : a + 20_000] for a in range(0, max(1, len(names)), 20_000))]
    flat = np.concatenate([bucket.astype(np.int32) for _, bucket, _ in slices])
    size = np.concatenate([np.bincount(word, minlength=n) for n, _, word in slices])
    at = np.concatenate([[0], np.cumsum(size)])
    df, seen = np.zeros(len(vocab), np.int64), np.zeros(buckets, np.int32)
    for d in docs:
        d = np.unique(d)
        df[d] += 1
        if len(d):
            seen[np.unique(np.concatenate([flat[at[w] : at[w + 1]] for w in d]))] += 1
    # only subwords of min_docs texts or more are learned; others add nothing
    learned = np.flatnonzero(seen >= min_docs)
    row_of = np.full(buckets, -1, np.int32)
    row_of[learned] = np.arange(len(learned))
    sub, word_of = row_of[flat], np.repeat(np.arange(len(size), dtype=np.int32), size)
    sub, word_of = sub[sub >= 0], word_of[sub >= 0]
    damp = np.sqrt(rarity / (rarity + df / len(docs)))
    share = damp / size
    y = np.array(labels, float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    rng = np.random.default_rng(seed)
    emb, speed, bias = np.zeros((len(learned), dim)), np.zeros((len(learned), dim)), np.zeros(2)
    top = rng.normal(0, 1, (dim, 2))
    top *= 3 / np.linalg.norm(top[:, 1] - top[:, 0])

    def values() -> np.ndarray:
        return np.bincount(word_of, weights=(emb @ (top[:, 1] - top[:, 0]))[sub], minlength=len(vocab)) * share

    for turn in range(rounds):
        value = np.append(values(), 0.0) if turn else np.append(rng.random(len(vocab)), 0.0)
        best = np.full(len(docs), -np.inf)
        start = np.zeros(len(docs), np.int64)
        for text, begin, rows in passages(ids, first, window):
            rows, counts = repeat_weights(rows, repeats)
            x = (value[rows] * counts).sum(axis=1)
            order = np.lexsort((-begin, x))  # of equal passages the first
            better = x[order] >= best[text[order]]
            best[text[order][better]], start[text[order][better]] = x[order][better], begin[order][better]
        chosen = np.full((len(docs), window), -1, np.int32)
        for i, d in enumerate(docs):
            own = d[start[i] : start[i] + window]
            chosen[i, : len(own)] = own
        chosen, counts = repeat_weights(chosen, repeats)
        owner, place = np.nonzero(chosen >= 0)
        words = chosen[owner, place]
        counts = counts[owner, place] / (np.count_nonzero(chosen >= 0, axis=1) + SMOOTH)[owner]
        for _ in range(steps):
            apart = top[:, 1] - top[:, 0]
            z = np.bincount(owner, weights=values()[words] * counts, minlength=len(docs)) + bias[1] - bias[0]
            # of two classes the softmax's error is one number with two signs
            err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
            g_word = np.bincount(words, weights=err[owner] * counts, minlength=len(vocab)) * share
            g = np.bincount(sub, weights=g_word[word_of], minlength=len(learned))
            g_top = emb.T @ g
            before = emb
            emb = emb + momentum * speed - rate * np.outer(g, apart)
            emb *= np.maximum(0, 1 - rate * penalty / np.maximum(np.linalg.norm(emb, axis=1), 1e-12))[:, None]
            speed = emb - before
            top -= 0.001 * np.outer(g_top, [-1, 1])
            bias += np.array([1, -1]) * err.sum()
    value = np.zeros(buckets, np.float32)
    value[learned] = emb @ (top[:, 1] - top[:, 0])
    common = {w: float(damp[i]) for w, i in vocab.items() if df[i] > 1 and damp[i] < 0.98}
    return Classifier(value, float(bias[1] - bias[0]), window, common, repeats)


def calibrated(model: Classifier, texts: list[str], labels: list[int], weights: list[float], steps: int = 50) -> Classifier:
    """Rescale the log odds by a logistic fit on texts that did not train the model."""
    y, w = np.array(labels, float), np.array(weights, float)
    if len(set(labels)) < 2:
        return model
    x = np.clip(np.array(model.log_odds(texts)), -30, 30)
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.array([1.0, 0.0])
    w = w / w.sum() * len(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-3])
        beta = beta + np.clip(np.linalg.solve(hess, design.T @ (w * (y - p)) - 1e-3 * (beta - [1.0, 0.0])), -1, 1)
    if beta[0] <= 0:
        return model
    return Classifier((model.value * beta[0]).astype(np.float32), float(model.bias * beta[0] + beta[1]), model.window, model.common, model.repeats)


def train_calibrated(texts: list[str], labels: list[int], weights: list[float], **params) -> Classifier:
    """Train on four of five rows, calibrate on the fifth.  With weights that even out the classes, a score of 0.7 asks for odds of 7 to 3 between equally frequent classes."""
    late = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    held = set(late)
    early = [i for i in range(len(texts)) if i not in held]
    model = train([texts[i] for i in early], [labels[i] for i in early], **{"repeats": REPEATS, **params})
    if len({labels[i] for i in late}) < 2:
        return model
    return calibrated(model, [texts[i] for i in late], [labels[i] for i in late], [weights[i] for i in late])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 60_000_000, **params) -> Classifier:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Of each class about ``max_rows`` labels train, those with the least hash of the id; fewer, in the same proportion,
    if their texts would pass ``max_chars`` characters.  Whole texts train.  Labels without a document do not train.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: min(1.0, max_rows / r["count"]) for r in marked.groupBy("toxic").count().collect()}
    if not share:
        return train([], [])
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (int(k), v)]), F.col("toxic"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1_000_000)) / 1_000_000.0
    # about 2 * max_rows ids, so they are broadcast and the texts stay where they are
    ids = saved(marked.filter(unit < limit).withColumn("_u", unit / limit), "toxicity-sample")
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    expected = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rows = known.filter(F.col("_u") < min(1.0, max_chars / max(1, expected))).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    got = [int(r["toxic"]) for r in rows]
    return train_calibrated([r["text"] for r in rows], got, [1 / got.count(y) for y in got], **params)


def score_texts(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != "toxicity"]
    schema = T.StructType([*kept, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(lambda b: trimmed(run(b)), schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.filter(~out), table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~out))
    scored = score_texts(docs, model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
