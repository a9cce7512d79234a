"""Benchmark decontamination with an FM-index per training shard.

Every task cuts its documents into shards of a bounded number of words (a longer document is a shard by
itself), builds an FM-index over the shard's distinct texts (suffix order by doubling, Burrows-Wheeler
transform in a wavelet matrix, sampled suffix positions) and searches all windows of the benchmark by
backward search, all at once in numpy.  Occurrences are located by walking to the next sampled position,
and merge into removal spans.

Benchmark windows are dealt into slices of at most ``slice_words`` words; one slice at a time is broadcast, so
what is broadcast is bounded by that parameter; with several slices the documents' hits are merged.

Defined cases: null or empty texts have no words, no hits and are not contaminated; a null item_id stands in no
list of items, its windows hit; items without words are ignored; repeated items count as often as they have
different ids; repeated rows are judged alike and all returned; an empty benchmark hits nothing; extra columns, whatever
their names, are kept by ``drop_contaminated`` and ``cut_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, saved, ship_package, table
from .textops import Words, chunks, lazily, trimmed

WINDOW = 13
SHARD_BYTES = 2_000_000
SAMPLE_STEP = 16
SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)])


def word_bytes() -> np.ndarray:
    """Bytes of words after lower-casing: digits, a-z, and everything beyond ASCII."""
    table_ = np.zeros(256, bool)
    table_[0x30:0x3A] = table_[0x61:0x7B] = True
    table_[0x80:] = True
    return table_


class WaveletMatrix:
    """Rank queries over symbols below 2**bits; one bit vector per level, with a count per 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = np.left_shift(np.uint64(1), (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        at, start = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, s = self._rank1(level, at), self._rank1(level, start)
            at = np.where(one, self.zeros[level] + a, at - a)
            start = np.where(one, self.zeros[level] + s, start - s)
        return at - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i, and how often it occurs before i."""
        at, start, symbol = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = ((self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, s = self._rank1(level, at), self._rank1(level, start)
            at = np.where(one, self.zeros[level] + a, at - a)
            start = np.where(one, self.zeros[level] + s, start - s)
            symbol = (symbol << 1) | one
        return symbol, at - start


def suffix_order(symbols: np.ndarray, n_breaks: int) -> np.ndarray:
    """Suffix array; the ``n_breaks`` least symbols occur once each and end texts, so no comparison passes them."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    width = max(1, int(rank.max()).bit_length())
    depth = 3 if 3 * width <= 62 else 2
    key = rank.copy()
    for i in range(1, depth):
        key = (key << width) | np.concatenate([rank[i:], np.zeros(min(i, n), np.int64)])[:n]
    order = np.argsort(key)
    active = order
    base = np.zeros(n, np.int64)  # where the group of active[i] starts in the order
    sorted_key = key[order]
    rank = np.empty(n, np.int64)
    out = np.empty(n, np.int64)
    while True:
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        if len(active) != n:
            new |= np.concatenate([[True], base[1:] != base[:-1]])
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [len(active)]]))
        offset = np.arange(len(active)) - np.repeat(at, size)
        # places of active suffixes: those of one old group are neighbours, groups keep their bases
        group_start = np.repeat(_places(base, len(active), n)[at], size)
        rank[active] = group_start
        out[group_start + offset] = active
        again = np.repeat(size > 1, size)
        if not again.any():
            return out
        active, base = active[again], group_start[again]
        nxt = active + depth
        follow = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        order = np.lexsort((follow, base))
        active, base, sorted_key = active[order], base[order], follow[order]
        depth *= 2


def _places(base: np.ndarray, m: int, n: int) -> np.ndarray:
    """Place in the suffix order of each active suffix."""
    if m == n:
        return np.arange(n)
    start = np.concatenate([[True], base[1:] != base[:-1]])
    first = np.flatnonzero(start)
    size = np.diff(np.concatenate([first, [m]]))
    return base + np.arange(m) - np.repeat(first, size)


class FmIndex:
    """FM-index over the word hashes of several texts, each ended by a symbol of its own."""

    def __init__(self, words: Words):
        texts = len(words.first) - 1
        self.vocab, symbol = np.unique(words.hashes, return_inverse=True)
        counts = np.diff(words.first)
        owner = np.repeat(np.arange(texts), counts)
        self.at = words.first[:-1] + np.arange(texts)  # first position of each text
        self.n = len(symbol) + texts
        seq = np.empty(self.n, np.int64)
        seq[self.at + counts] = np.arange(texts)
        position = np.arange(len(symbol)) + owner
        seq[position] = symbol + texts
        self.texts, self.end = texts, self.at + counts
        sa = suffix_order(seq, texts)
        # rows whose suffix starts a text are sampled, so walks never step over an end; ends share symbol 0 there
        low = np.maximum(seq - texts + 1, 0)
        bwt = low[sa - 1]
        self.bits = max(1, int(len(self.vocab)).bit_length())
        self.tree = WaveletMatrix(bwt, self.bits)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=len(self.vocab) + 1))])
        starts = np.zeros(self.n, bool)
        starts[self.at] = True
        sampled = (sa % SAMPLE_STEP == 0) | starts[sa]
        self.sampled = np.flatnonzero(sampled)
        self.sample = sa[self.sampled]
        self.is_sampled = sampled

    def search(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each window (word hashes, aligned to the right) that occurs: (window number, lo, hi)."""
        width = windows.shape[1]
        where = np.searchsorted(self.vocab, windows)
        symbol = np.where(self.vocab[np.minimum(where, len(self.vocab) - 1)] == windows, where + 1, -1) if len(self.vocab) else np.full(windows.shape, -1)
        used = np.arange(width)[None, :] >= width - length[:, None]
        ids = np.flatnonzero(((symbol > 0) | ~used).all(axis=1))
        lo, hi = np.zeros(len(ids), np.int64), np.full(len(ids), self.n, np.int64)
        done = []
        for step in range(1, width + 1):
            over = length[ids] < step
            if over.any():
                done.append((ids[over], lo[over], hi[over]))
                ids, lo, hi = ids[~over], lo[~over], hi[~over]
            if not len(ids):
                break
            c = symbol[ids, width - step]
            lo, hi = self.less[c] + self.tree.rank(c, lo), self.less[c] + self.tree.rank(c, hi)
            some = hi > lo
            ids, lo, hi = ids[some], lo[some], hi[some]
        done.append((ids, lo, hi))
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: steps back through the text until a sampled row."""
        out, todo, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.is_sampled[row]
            out[todo[hit]] = self.sample[np.searchsorted(self.sampled, row[hit])] + steps
            todo, row = todo[~hit], row[~hit]
            symbol, before = self.tree.access_rank(row)
            row = self.less[symbol] + before
            steps += 1
        return out


class Slice:
    """Distinct windows of benchmark items, aligned to the right, and the items that have them."""

    def __init__(self, rows: list[tuple[str | None, np.ndarray]]):
        found: dict[bytes, set] = {}
        self.width = max([WINDOW, *(len(w) for _, w in rows)]) if rows else WINDOW
        for item, w in rows:
            found.setdefault(w.tobytes(), set()).add(item)
        self.windows = np.zeros((len(found), self.width), np.uint64)
        self.length = np.zeros(len(found), np.int64)
        self.items: list[list[str]] = []
        for i, (w, items) in enumerate(found.items()):
            w = np.frombuffer(w, np.uint64)
            self.windows[i, self.width - len(w) :] = w
            self.length[i] = len(w)
            self.items.append(sorted(x for x in items if x is not None))


def bench_windows(bench: DataFrame) -> DataFrame:
    """(item, words binary): the windows of every item; an item of fewer words than a window is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(lazily(batch.column("item")), lazily(batch.column("text"))):
                w = Words(texts, word_bytes())
                items, found = [], []
                for d, item in enumerate(ids):
                    h = w.hashes[w.first[d] : w.first[d + 1]]
                    n = min(WINDOW, len(h))
                    for a in range(len(h) - n + 1 if n else 0):
                        items.append(item)
                        found.append(h[a : a + n].tobytes())
                yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.string()), "words": pa.array(found, pa.binary())})

    ship_package(bench.sparkSession)
    return bench.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words binary").distinct()


def merge_spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def search_shard(texts: list[bytes], part: Slice) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """Per text: n_words, n_hit, items, spans."""
    words = Words(texts, word_bytes())
    counts = np.diff(words.first)
    nothing = [(int(n), 0, [], []) for n in counts]
    if not len(part.items) or not len(words.hashes):
        return nothing
    index = FmIndex(words)
    window, lo, hi = index.search(part.windows, part.length)
    if not len(window):
        return nothing
    each = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
    position, window = index.locate(rows), np.repeat(window, each)
    text = np.searchsorted(index.at, position, side="right") - 1
    change = np.bincount(position, minlength=index.n + 1) - np.bincount(position + part.length[window], minlength=index.n + 1)
    # windows of one text never reach into the next one
    hit = np.cumsum(change) > 0
    pairs = np.unique(np.stack([text, window]), axis=1)
    items: dict[int, set] = {}
    for t, w in pairs.T:
        items.setdefault(int(t), set()).update(part.items[w])
    out = nothing
    for t in np.unique(text):
        own = hit[index.at[t] : index.end[t]]
        out[t] = (int(counts[t]), int(own.sum()), sorted(items[int(t)]), merge_spans(own, *words.spans(t)))
    return out


def _search(docs: DataFrame, part: Slice, name: str = "found") -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(part)
    fields = docs.schema.fields
    schema = T.StructType([*fields, T.StructField(name, RESULT)])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            texts = batch.column(at).to_pylist()
            number: dict[str | None, int] = {}
            which = [number.setdefault(t, len(number)) for t in texts]
            found = []
            for _, shard in chunks(list(number), list(number), SHARD_BYTES):
                found += search_shard(shard, shared.value)
            rows = [{"n_words": n, "n_hit": h, "items": i, "spans": [{"begin": a, "end": b} for a, b in s]} for n, h, i, s in (found[k] for k in which)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(lambda b: trimmed(run(b)), schema)


def contamination(docs: DataFrame, bench: DataFrame, slice_words: int = 4_000_000, name: str = "found") -> DataFrame:
    """``docs`` (with text) with ``name`` (not a column yet): n_words, n_hit, items (sorted), spans (UTF-8 byte offsets, merged)."""
    ship_package(docs.sparkSession)
    windows = saved(bench_windows(bench), "decon-windows")
    total = windows.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // slice_words))
    if n == 1:
        return _search(docs, Slice([(r["item"], np.frombuffer(r["words"], np.uint64)) for r in windows.collect()]), name)
    # several slices: each is searched for and written; then the parts of a row meet by its number
    row = free_name(docs, "row_number")
    keyed = saved(docs.withColumn(row, F.monotonically_increasing_id()), "decon-docs")
    parts = None
    for i in range(n):
        rows = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == i).collect()
        got = saved(_search(keyed.select(F.col(row).alias("row"), "text"), Slice([(r["item"], np.frombuffer(r["words"], np.uint64)) for r in rows])).select("row", "found"), "decon-slice")
        parts = got if parts is None else parts.unionByName(got)
    whole = parts.groupBy("row").agg(F.max("found.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.spans")))).alias("spans"))
    whole = whole.select(F.col("row").alias(row), F.struct("n_words", "items", "spans").alias(name))
    out = keyed.join(whole, row).drop(row)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])
    at = out.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            rows = []
            for text, got in zip(lazily(batch.column(at)), lazily(batch.column(len(batch.columns) - 1)), strict=True):
                w = Words([(text or "").encode("utf-8", "surrogatepass")], word_bytes())
                hit = np.zeros(len(w.hashes), bool)
                for s in got["spans"]:
                    hit |= (w.starts >= s["begin"]) & (w.ends <= s["end"])
                rows.append({"n_words": got["n_words"], "n_hit": int(hit.sum()), "items": got["items"], "spans": [{"begin": a, "end": b} for a, b in merge_spans(hit, w.starts, w.ends)]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=schema.names)

    return out.mapInArrow(run, schema)


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans (byte offsets of its UTF-8 form)."""
    if text is None:
        return None
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def drop_contaminated(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, unchanged."""
    name = free_name(docs, "found")
    found = contamination(docs, bench, name=name, **params)
    return found.filter(~is_contaminated(F.col(f"{name}.n_hit"), F.col(f"{name}.n_words"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_contaminated(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """``docs`` with the merged removal spans cut out of the texts; no document is dropped."""
    name = free_name(docs, "found")
    found = contamination(docs, bench, name=name, **params)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_spans(t, [(s["begin"], s["end"]) for s in got["spans"]]) for t, got in zip(lazily(batch.column(at)), lazily(batch.column(len(batch.columns) - 1)), strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.mapInArrow(run, schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    f = F.col("found")
    return out.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(f["n_hit"], f["n_words"]).alias("contaminated"))
