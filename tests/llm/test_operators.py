"""Training-data operators against brute force on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from logweave.llm import decontamination, fingerprints, language_id, line_dedup, mixing, ngram_join, token_output, toxicity, url_filters, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spare int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), 0) for i, t in texts], DOCS)


def words(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def test_words_before_marks_are_encoded_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, enc, alone = Tokenizer.from_file(path), token_output.Encoder(path), []
    cores = ["straße", "naïve", "ªb", "µm", "ΟΔΟΣ", "слово", "数字", "각", "é", "İx", "don't", "e\u0301", "a1", "ǅ", "w" * 300]
    pieces = [c + m for c in cores for m in ("", "!!", ",***", ".&&&", "'", "'s", "<|", "\u0301", "…", "|>.")] + ["$$$", "..", "ÀB!!", "<|endoftext|>", "x<|endoftext|>!!"]
    each = enc._each
    enc._each = lambda pieces: (alone.extend(pieces), each(pieces))[1]
    for _ in range(2):  # the second time from the cache
        for texts in (pieces, [" ".join(pieces)]):
            ids, sizes = enc.encode(texts)
            want = [[*x.ids, token_output.END_ID] for x in whole.encode_batch(texts, add_special_tokens=False)]
            assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    assert "straße!!" not in alone and "слово,***" not in alone and "!!" in alone and len(alone) == len(set(alone))


def shuffled_texts(df):
    """Rows that the exchanges whose rows hold a text have written while ``df`` was run without AQE."""

    def walk(node):
        own = node.metrics().apply("shuffleRecordsWritten").value() if "Exchange" in node.nodeName() and "text#" in node.output().mkString(",") and node.metrics().contains("shuffleRecordsWritten") else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_dropping_copies_leaves_texts_where_they_are(spark):
    rows = [(i, " ".join(words(30, i // 2 if i < 40 else i))) for i in range(2000)] + [(None, "no id"), (None, None), (41, "same id, other text"), (1, "not a copy, but a copy's id")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, maybe int")
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        kept = ngram_join.drop_near_copies(df)
        got = kept.collect()
        moved = shuffled_texts(kept)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    gone = {i for i in range(3, 40, 2)}  # id 1 stays: one of its rows is no copy
    assert kept.columns == df.columns
    assert sorted(map(str, got)) == sorted(str(r) for r in df.collect() if r.doc_id not in gone)
    assert moved < 400


def test_open_round_of_a_large_group(spark):
    wide = bytes(ngram_join.WIDE)
    sets_ = spark.createDataFrame([(i, wide) for i in range(40)], "node long, wide binary")
    rows = [(7, i, i, 100, 0) for i in range(40)] + [(8, i, i, 100, 12) for i in range(40)]  # 80 % asks for an overlap of 89: places 0 to 11 leave room
    lists = spark.createDataFrame(rows, "token long, node long, root long, n long, pos long")
    found = ngram_join.open_candidates(lists, sets_, 80, 1024, forest=True)
    assert found.count() == 39 and ngram_join.components(found, "test").select("root").distinct().count() == 1
    assert ngram_join.open_candidates(lists, sets_, 80, 1024).count() == ngram_join.open_candidates(lists, sets_, 80, 8).count() == 780
    assert ngram_join.open_candidates(lists.filter("token = 8"), sets_, 80, 8).count() == 0
    assert ngram_join.reaching(lists, 80).select("token").distinct().first()[0] == 7


def test_components_of_stars_need_no_round(spark):
    import glob

    star = spark.createDataFrame([(1, i) for i in range(2, 50)] + [(100, 101)], "a long, b long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 31), (41, 40), (41, 31)], "a long, b long")
    roots = ngram_join.components(star, "stars")
    want = {(i, 1) for i in range(1, 50)} | {(100, 100), (101, 100)}
    assert {tuple(r) for r in roots.collect()} == want and roots.count() == len(want)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://").rstrip("/")
    assert len(glob.glob(f"{folder}/scratch/*/stars-cc-*")) == 1
    assert sorted(map(tuple, ngram_join.components(chain, "chain").collect())) == [(i, 1) for i in range(1, 31)] + [(31, 31), (40, 31), (41, 31)]
    links = spark.createDataFrame([(49, 101)], "a long, b long")
    assert ngram_join.merged(roots, links.filter("false"), "more") is roots
    assert {tuple(r) for r in ngram_join.merged(roots, links, "more").collect()} == {(i, 1) for i, _ in want}


def test_filters_reach_the_driver_in_few_jobs(spark):
    for key, value in (("spark.sql.shuffle.partitions", "80"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        numbers = spark.range(3000)
        spark.sparkContext.setJobGroup("few-jobs", "")
        bits, shared = ngram_join.bit_filter(numbers, numbers["id"])
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(shared.value[i % bits // 64] >> (i % bits % 64) & 1 for i in range(3000))
    assert jobs < 40


def test_encoder_looks_up_each_piece_of_a_batch_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", "  a  b ", "\x0b x\x0cy\r\n", "<|endoftext|> A", "É È µ ß İ", "a\x00b", "\x85 x\xa0y", "world.. don't .", ".", "x.", "\x1c a\x1db", "日本語 。", "é. È,"]
    for some in (texts, texts[:1], texts[::-1], []):
        ids, sizes = token_output.Encoder(path).encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(some)] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in some]
    enc, asked = token_output.Encoder(path), []

    class Known(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    enc.known = Known(enc.known)
    enc.encode(["one two"] * 300)
    assert sorted(asked) == ["one", "two"]


def test_rare_shingles_are_told_apart_in_a_large_corpus(spark):
    """Half of each set is its own, half is in eight sets; there are a score of shingles for each of 2**18 counters."""
    half = 500
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(half)] + [f"some{i // 8}x{j}" for j in range(half)])) for i in range(8000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = ngram_join.corpus_counts(ngram_join.saved(ngram_join.sizes_and_digests(table, 1), "test-rows"))
    some = table.filter("doc_id < 400")
    texts = dict(some.collect())
    shared = {x for i in texts if i % 8 == 0 for s in ngram_join.shingle_sets([" ".join(texts[i].split()[half:]).encode()], 1) for x in s.view(np.int64).tolist()}
    taken = [x for r in ngram_join.signatures(some, 1, 90, counts, 0).select("prefix").collect() for x in r.prefix]
    assert len(taken) == 400 * 101 and len(shared) == 50 * half
    assert sum(x in shared for x in taken) < 0.002 * len(taken)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, k, percent):
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "a b")]
    for g in range(30):
        base = words(int(rng.integers(4, 120)), g)
        for _ in range(6):
            new = list(base)
            for _ in range(int(rng.integers(0, 4))):
                new[int(rng.integers(0, len(new)))] = f"x{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(new[: len(new) - int(rng.integers(0, 3))])))
    s = sets(rows, k)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join.near_copies(docs(spark, rows), words=k, percent=percent)
    assert sorted(map(tuple, got.collect())) == sorted((i, len(s[i]), find(i)) for i in s)


def test_join_of_nothing(spark):
    assert ngram_join.near_copies(docs(spark, [])).count() == 0


def test_decontamination(spark):
    long = words(60, 1, 10_000)
    bench = [(7, " ".join(long[:30])), (8, "only three words"), (9, None), (10, "..."), (7, " ".join(long[20:40]))]
    rows = [(1, " ".join(["x"] * 5 + long[10:28] + ["y"] * 300)), (2, "Only, three WORDS"), (3, None), (4, ""), (5, " ".join(long[:12])), (6, " ".join(long[:25])), (6, " ".join(long[:25]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (4_000_000, 150):  # one slice, several slices
        got = {r.doc_id: r.found for r in decontamination.contamination(docs(spark, rows), b, slice_words=limit).collect()}
        assert {i: (f.n_words, f.n_hit, f["items"]) for i, f in got.items()} == {1: (323, 18, ["7"]), 2: (3, 3, ["8"]), 3: (0, 0, []), 4: (0, 0, []), 5: (12, 0, []), 6: (25, 25, ["7"])}
        assert len(got[1].spans) == 1
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs(spark, rows), b).collect()) == [3, 4, 5]


def test_fingerprints(spark):
    rows = [(1, None), (2, "a b c d e f g"), (2, ""), (5, "é " * 50), (9, "a b c d e f g")]
    got = fingerprints.compare_neighbours(docs(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    assert len(got) == len(rows) and {r.doc_id: r.n_chars for r in got if r.doc_id != 2} == {1: 0, 5: 100, 9: 7 * 2 - 1}
    first = next(r for r in got if r.doc_id == 9)
    assert first.edited_sha256 == hashlib.sha256((order[0][1][:7] + order[1][1][:6]).encode()).hexdigest()
    a, b = (fingerprints.sketches([" ".join(words(n, 3))])[0] for n in (2000, 500))
    assert abs(fingerprints.containment(b, a) - 1) < 0.05 and fingerprints.merge(a, b).tolist() == a.tolist()
    assert fingerprints.from_string(fingerprints.to_string(a)).tolist() == a.tolist()


def test_normal_words_are_told_apart_without_a_call_for_each(monkeypatch):
    import public_tokenizers

    asked = []
    monkeypatch.setattr(token_output.Encoder, "_simple", staticmethod(lambda word: asked.append(word) or False))
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_output.Encoder(path)
    ids, _ = encoder.encode(["many plain words, école"])
    assert asked == ["école"]
    assert ids.tolist() == encoder.tokenizer.encode("many plain words, école", add_special_tokens=False).ids + [1]


def test_both_tokenizers_of_an_encoder_hold_one_model():
    import public_tokenizers

    encoder = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.tokenizer.model.dropout = 0.5
    assert encoder.quick is not encoder.tokenizer and encoder.quick.model.dropout == 0.5


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(3, "Word. WORD, it's 3.14 É. <|endoftext|>x"), (1, None), (2, "é ́x　y... ,. x.y"), (4, "a\x1cb \x85c")]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.tokens_and_digests(docs(spark, rows)).collect())) == want
    assert token_output.tokens_and_digests(docs(spark, [])).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, None, None), (4, "v", ""), (5, "é\r\n", "ü" * 100), (None, "a", "aa")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folders = [f"file://{tmp_path}/{n}" for n in "ab"]
    first, second = (sorted(map(tuple, warc.write_warc(pages, f, file_bytes=400).collect())) for f in folders)
    assert first == second and len(first) > 1
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, folders[0]).collect()}
    assert got == {1: (2, "revisit", 2), 2: (2, "response", None), 3: (0, "revisit", 4), 4: (0, "response", None), 5: (200, "response", None), None: (2, "revisit", 2)}


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7))) for i in range(300)] + [(300, None)]
    sized, plan = mixing.plan_mix(docs(spark, rows))
    taken = mixing.mix(docs(spark, rows)).groupBy("source").agg({"n_chars": "count"}).collect()
    assert len(taken) == 3 and all(r.target <= 2 * r.source_size for r in plan.collect())
    assert sorted(map(tuple, mixing.mix(docs(spark, rows)).collect())) == sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))


def test_url_rules(spark):
    urls = [(1, "http://a.com/x"), (2, "http://EXAMPLE.com/en/a"), (3, "http://www.example.com/en/a"), (4, "x"), (5, None), (6, "http://b.net/es/"), (7, "http://b.org/q")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, labels).collect()}
    assert got == {1: ("a.com", "/x", "com/", "allow"), 2: ("example.com", "/en/a", "example.com/en/", "block"), 3: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("b.net", "/es/", "net/es/", "block"), 7: ("b.org", "/q", None, "allow")}


def test_line_spread(spark):
    rows = [(i, f"own {i}\n\nshared", "en", f"site{i}", 0, 0) for i in range(8)] + [(9, None, "en", None, 0, 0)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.strip_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3] == ("own 3\n", 1) and got[9] == (None, 0)


def test_language(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et la souris", "en" if i % 2 else "fr", "s", 0, 0) for i in range(40)] + [(90, "123", "en", "s", 0, 0), (91, None, None, "s", 0, 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(d, language_id.fit(d)).collect()}
    assert got[90] == got[91] == "und" and all(got[i] == ("en" if i % 2 else "fr") for i in range(40))


def test_toxicity_of_misspellings():
    texts = [" ".join(words(30, i) + (["idiot"] if i % 2 else [])) for i in range(400)]
    model = toxicity.train(texts, [i % 2 for i in range(400)])
    fine, bad, misspelled, empty = model.score([" ".join(words(30, 999)), " ".join(words(30, 999) + ["idiot"]), " ".join(words(30, 999) + ["idiott"]), None])
    assert bad > fine and misspelled > fine and 0 <= empty <= 1


def test_toxicity_counts_every_occurrence():
    texts = [" ".join(words(30, i) + (["idiot"] if i % 2 else [])) for i in range(400)]
    model = toxicity.train(texts, [i % 2 for i in range(400)], window=20)
    once, often = model.log_odds(["idiot", "idiot " * 60])
    assert np.allclose([once - model.bias, often - model.bias], [model.word("idiot") / 11, 60 * model.word("idiot") / 70])

    # a late passage whose words all came before, far apart
    late = words(300, 1) + ["idiot"] + words(300, 2) + ["idiot", "w1", "idiot", "w2", "idiot"] + words(300, 3)
    x = [model.word(w) for w in late]
    at = [*range(0, len(x) - 20, 10), len(x) - 20]
    want = max(sum(x) / (len(x) + 10), *(sum(x[a : a + 20]) / 30 for a in at))
    assert np.isclose(model.log_odds([" ".join(late)])[0], model.bias + want)


def test_toxicity_trains_on_repeats():
    # both classes have the same words; only how often they occur tells them apart
    texts = ["good bad " + ("bad " if i % 2 else "good ") * 20 for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    clean, toxic = model.score(texts[:2])
    assert clean < 0.3 and toxic > 0.7


def test_toxicity_of_long_runs():
    texts = [" ".join(words(30, i) + (["idiot"] if i % 2 else [])) for i in range(400)]
    model = toxicity.train(texts, [i % 2 for i in range(400)])
    fine, bad = model.log_odds(["_".join(words(300, 9)), "_".join(words(200, 9) + ["idiot"] * 60 + words(100, 9))])
    assert bad > fine + 0.1
    for n in [*range(55, 70), *range(115, 130), 500]:
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(run)
        assert len(pieces) == 1 if n <= 60 else max(map(len, pieces)) <= 64
        assert all(any(run[a : a + k] in p for p in pieces) for k in (3, 4, 5) for a in range(n - k + 1))
