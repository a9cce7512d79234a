"""Token ids as ORC: one row per document with its ids as an integer array.

ORC stores the ids with its integer run-length encoding, in stripes with row indexes and a Bloom filter on
``doc_id``: stripes are read in parallel, and readers skip stripes and row groups by minimum, maximum and Bloom
filter of ``doc_id``.  Rows are dealt into buckets by exact, repeatable id bounds and sorted inside them; a file stores
each document's offset inside its bucket, and a manifest the number of ids per bucket, so nothing is
rewritten to make offsets global.

Encoding splits texts at ASCII white space, and Latin-1 texts before marks, where the tokenizer always splits too, and keeps the ids of each piece in
a bounded cache; every piece (or a word and its closing marks, which the tokenizer also divides) is encoded by the
tokenizers library itself.

Defined cases: a null text is empty and has only the end id; null doc_ids come first; rows with equal doc_id are
ordered by their text, so offsets of repeated rows are repeatable; an empty table gives an empty result; extra columns are not written.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_of, range_bounds, scratch_path, ship_package, table
from .textops import trimmed

END_ID = 1
#: pieces whose ids a worker keeps, twice: those of the current and of the last generation
CACHE_PIECES = 250_000
#: bytes of the texts that are encoded at once; the more, the more of their pieces are repeats
PART_BYTES = 4_000_000
#: ASCII marks, none of which the tokenizer joins with a letter before it
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_latin = [chr(b) for b in range(256)]
LATIN_LOWER = "".join(map(str.lower, _latin)).encode("latin-1")
#: 1: letters and digits, 2: marks
LATIN_KIND = bytes(2 if c in MARKS else c.isalpha() or unicodedata.category(c)[0] == "N" for c in _latin)
_encoders: dict = {}


def _kinds(config: dict | None) -> list[str]:
    """Types of the parts of a tokenizer's normalizer or pre-tokenizer."""
    return [part["type"] for key in ("normalizers", "pretokenizers") for part in (config or {}).get(key, [])]


class Encoder:
    """Ids of a text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence as Normalizers
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = self.tokenizer
        config = json.loads(self.tokenizer.to_str())
        if [_kinds(config["normalizer"]), _kinds(config["pre_tokenizer"])] == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            # words that the normalizer leaves alone and the pattern doesn't divide need neither: the same model without regular expressions
            self.quick = Tokenizer(self.tokenizer.model)
            self.quick.normalizer = Normalizers([])
            self.quick.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end = np.array([END_ID], "<u4").tobytes()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _each(self, pieces: list[str]) -> None:
        for a in range(0, len(pieces), 500):
            part = pieces[a : a + 500]
            for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = np.array(got.ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> None:
        """Words of letters only, 500 to a text, cut again at the ids that end a word."""
        simple, other = [], []
        for w in words:
            (simple if w.isascii() and w.islower() or self._simple(w) else other).append(w)
        self._joined(self.quick, simple)
        self._joined(self.tokenizer, other)

    @staticmethod
    def _simple(word: str) -> bool:
        """Latin-1 in lower case: normal already."""
        return max(word) < "\u0100" and word == word.lower()

    def _joined(self, tokenizer, words: list[str]) -> None:
        parts = [words[a : a + 500] for a in range(0, len(words), 500)]
        for a in range(0, len(parts), 4):
            texts = [" ".join(p) for p in parts[a : a + 4]]
            for part, got in zip(parts[a : a + 4], tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(got.ids, "<u4")
                cut = np.flatnonzero(self.closes[ids]) + 1
                if len(cut) != len(part) or cut[-1] != len(ids):
                    self._each(part)
                    continue
                data, ends = ids.tobytes(), (4 * cut).tolist()
                self.known.update(zip(part, [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    @staticmethod
    def plain(texts: list[str]) -> pa.Array:
        """Texts whose pieces between ASCII white space have ids that, one after the other, are those of ``texts``.

        Latin-1 texts are lower-cased, as the tokenizer does (its other normalization leaves them alone), and get a space
        between a letter or digit and a mark behind it, where the tokenizer always divides; but for those in which a special token's
        name may stand.
        """
        simple, other, order = [], [], []
        for t in texts:
            try:
                data = None if "<|" in t else t.encode("latin-1")
            except UnicodeEncodeError:
                data = None
            order.append(len(simple) if data is not None else -1 - len(other))
            if data is None:
                other.append(t)
            else:
                simple.append(data)
        ends = np.cumsum(np.fromiter(map(len, simple), np.int64, len(simple)))
        lower = b"".join(simple).translate(LATIN_LOWER)
        kind = np.frombuffer(lower.translate(LATIN_KIND), np.uint8)
        divides = (kind[:-1] == 1) & (kind[1:] == 2)
        divides[ends[(ends > 0) & (ends < len(lower))] - 1] = False  # the next text begins there
        cut = np.flatnonzero(divides) + 1
        spaced = np.insert(np.frombuffer(lower, np.uint8), cut, 32)
        ends += np.searchsorted(cut, ends)
        wide = np.flatnonzero(spaced > 127)  # characters of two bytes in UTF-8
        offsets = np.concatenate([[0], ends + np.searchsorted(wide, ends)])
        utf8 = spaced.tobytes()
        if len(wide):
            utf8 = utf8.decode("latin-1").encode()
        first = pa.LargeStringArray.from_buffers(len(simple), pa.py_buffer(offsets), pa.py_buffer(utf8))
        if not other:
            return first
        at = np.array(order, np.int64)
        return pa.concat_arrays([first, pa.array(other, pa.large_string())]).take(pa.array(np.where(at < 0, len(simple) - 1 - at, at)))

    def _learn(self, pieces: list[str]) -> None:
        """Words, and words with ASCII marks behind them (the tokenizer divides there), are looked up as words."""
        words, other, closed = [], [], []
        for p in pieces:
            if p.isalpha():
                words.append(p)
            elif (core := p.rstrip(MARKS)).isalpha():
                closed.append((p, core, p[len(core) :]))
            else:
                other.append(p)
        known = self.known
        cores = {core for _, core, _ in closed}.difference(known)
        again = cores.intersection(self.older)
        known.update([(w, self.older[w]) for w in again])
        self._words(words + list(cores.difference(again, words)))
        self._each(list({mark for _, _, mark in closed}.difference(known)))
        self._each([p for p in other if p not in known])
        known.update([(p, known[core] + known[mark]) for p, core, mark in closed])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end id behind it; and their numbers per text.

        Every different piece of the texts is looked up once; Arrow splits the texts and numbers their pieces.
        """
        split = pc.ascii_split_whitespace(self.plain(texts))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        got = list(map(known.get, pieces))
        new = [p for p, x in zip(pieces, got, strict=True) if x is None]
        before = list(map(older.get, new)) if older else [None] * len(new)
        known.update([(p, x) for p, x in zip(new, before, strict=True) if x is not None])
        self._learn([p for p, x in zip(new, before, strict=True) if x is None])
        got = [known[p] if x is None else x for p, x in zip(pieces, got, strict=True)]
        got.append(self.end)
        pool = np.frombuffer(b"".join(got), "<i4")
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        at = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        codes = np.insert(coded.indices.to_numpy(), at[1:], len(pieces))  # the end id is one more piece
        lengths = sizes[codes]
        starts = (np.cumsum(sizes) - sizes)[codes]
        ends = np.cumsum(lengths)
        flat = pool[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        upto = ends[at[1:] + np.arange(len(texts))]
        return flat, np.diff(upto, prepend=0)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(batch: pa.RecordBatch, rows: int = 1000, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts hold at most ``size`` bytes (one text at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
    upto, a = np.cumsum(sizes), 0
    while a < len(batch):
        b = int(np.searchsorted(upto, size + (upto[a - 1] if a else 0), "right"))
        b = min(max(b, a + 1), a + rows)
        yield batch.slice(a, b - a)
        a = b


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the offset starts anew in each."""
    import public_tokenizers

    enc = encoder(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
    bucket, offset = None, 0
    for batch in batches:
        for part in _parts(batch):
            flat, sizes = enc.encode([t or "" for t in part.column("text").to_pylist()])
            starts = []
            for b, n in zip(part.column("bucket").to_pylist(), sizes.tolist(), strict=True):
                if b != bucket:
                    bucket, offset = b, 0
                starts.append(offset)
                offset += n
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("bucket"), part.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes), ids], names=["bucket", "doc_id", "local_start", "n_tokens", "ids"])


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", rows_per_bucket: int = 4096, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> DataFrame:
    """Write ``docs(doc_id long, text)`` below ``path`` (ids/ and manifest/); returns the manifest (bucket, n_rows, n_tokens, start).

    ``vocabulary`` is a name of the public tokenizer files or a path that executors can read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.count()
    per_bucket = max(rows_per_bucket, -(-total // 20_000))
    bounds = range_bounds(rows.select("doc_id"), [F.col("doc_id")], "doc_id", per_bucket, "token-ids")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(bucket_of(F.col("doc_id"), bounds))
    dealt = rows.withColumn("bucket", bucket.cast("int")).repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    schema = f"bucket int, doc_id {dict(rows.dtypes)['doc_id']}, local_start long, n_tokens long, ids array<int>"
    out = dealt.select("bucket", "doc_id", "text").mapInArrow(lambda b: trimmed(_encode(b, vocabulary)), schema)
    options = {"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(row_index_stride), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    out.write.options(**options).orc(f"{path}/ids")
    sums = spark.read.orc(f"{path}/ids").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    manifest = sums.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.coalesce(1).write.orc(f"{path}/manifest")
    return spark.read.orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); filters on doc_id reach the ORC reader.  The manifest has one row per bucket (20,001 at most)."""
    manifest = spark.read.orc(f"{path}/manifest").select("bucket", F.col("start").alias("_start"))
    rows = spark.read.orc(f"{path}/ids")
    return rows.join(F.broadcast(manifest), "bucket").select("doc_id", (F.col("_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).view("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        n = pa.array(np.diff(at).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), n, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` returns."""
    ship_package(tokens.sparkSession)
    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "start", "ids").mapInArrow(_crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_and_digests(docs: DataFrame) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return digests(read_tokens(docs.sparkSession, path))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_and_digests(table(spark, sf_dir, "documents"))
