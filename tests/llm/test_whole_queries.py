"""Queries and pipeline stages on small tables: planted cases, brute force, nulls, repeats, clashing names, empty tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from logweave.llm import decontamination, fingerprints, language_id, line_dedup, mixing, ngram_join, toxicity, url_filters
from logweave.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id string, text string", "pages": "page_id long, url string, html string"}


def words(n, seed, vocabulary=400):
    return [f"w{chr(97 + x % 26)}{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def tables(spark, folder, **rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, k, percent):
    """Component of each row (doc_id, text) by all pairs of rows."""
    s, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                root[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, len(s[a]), (least[find(a)] if s[a] else i) if i is not None else None) for a, (i, _) in enumerate(rows)]


def test_join_of_repeated_and_null_ids(spark):
    a, b = words(60, 1), words(60, 2)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:59], "other"])), (3, " ".join([*b[:59], "other"])), (None, " ".join(a)), (None, None), (7, None), (7, "")]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(groups(rows, 3, 90), key=key)


def test_join_of_long_lists_in_blocks(spark):
    # groups around one shared passage: lists longer than a block, several roots in each; short sets too, so both ways run
    shared, rows = words(30, 5), []
    for g in range(8):
        own = words(40, 100 + g)
        for v in range(6):
            rows.append((len(rows), " ".join([*shared, *own[: 40 - v % 3], f"v{v % 4}"])))
    rows += [(len(rows) + i, " ".join([*words(12, 300 + i // 3), f"e{i % 3}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cost in (0.0, 1e9):  # all by lists, all (small) by subsets
        got = ngram_join.near_copies(df, words=1, percent=80, list_cost=cost, block=5)
        assert sorted(map(tuple, got.collect())) == sorted(groups(rows, 1, 80))


NAMES = ["_n", "_source", "source_key", "source_cuts", "times_taken", "found", "row_number", "lang_pred", "lang_score", "gone", "row_key", "bad_lines", "n_lines", "n_removed", "row", "h", "cuts", "token", "Node"]


def test_clashing_names_keep_their_data(spark):
    rows = [(i, " ".join(words(30, i)) + "\nshared line", "en", f"s{i % 6}", 0, *[100 + k for k in range(len(NAMES))]) for i in range(24)]
    d = spark.createDataFrame(rows, DOCS + "".join(f", {n} int" for n in NAMES))
    bench = spark.createDataFrame([("x", " ".join(words(30, 3)))], TABLES["benchmark"])
    stages = [
        mixing.mix(d),
        decontamination.drop_contaminated(d, bench),
        decontamination.drop_contaminated(d, bench, slice_words=20),
        decontamination.cut_contaminated(d, bench),
        language_id.keep_identified(d, min_score=0.0),
        ngram_join.drop_near_copies(d),
        line_dedup.strip_boilerplate(d).select(*d.columns),
    ]
    for out in stages:
        got = out.collect()
        assert out.columns == d.columns and got and all(tuple(r)[5:] == rows[0][5:] for r in got)
    assert 3 not in {r.doc_id for r in stages[1].collect()} | {r.doc_id for r in stages[2].collect()}
    assert next(r.text for r in stages[3].collect() if r.doc_id == 3).strip() == "shared line"
    assert {r.n_removed_ for r in line_dedup.strip_boilerplate(d).collect()} == {1}


@pytest.mark.parametrize("size", [4, 4096])
def test_fingerprints_of_neighbours(spark, size, monkeypatch):
    rows = [(i * 3, None if i % 7 == 0 else " ".join(words(5 + 40 * (i % 5), i // 2)) + "É𝒳" * (i % 3)) for i in range(23)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprints.with_lookahead(df, size).select("doc_id", "text", "bucket", "ahead")
    got = {r.doc_id: r for r in dealt.mapInArrow(fingerprints._compare, fingerprints.RESULT).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    sk = lambda t: fingerprints.sketches([t])[0]
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprints.to_string(sk(t)) and r.edited_fingerprint == fingerprints.to_string(sk(new))
        assert math.isclose(r.near_edited, fingerprints.containment(sk(t), sk(new))) and math.isclose(r.near_next, fingerprints.containment(sk(t), sk(nxt)))


def test_mined_url_rules(spark):
    # casino AND promo are bad together only; spam is bad by itself, so spam AND news is a nested rule; rare is below the support
    urls = [f"http://h{i % 40}.org/{p}" for p in ("casino/promo", "casino/news", "promo/news") for i in range(40)] + [f"http://h{i}.org/spam/news" for i in range(40)] + [f"http://h{i}.org/rare" for i in range(19)] + [f"http://h{i % 40}.org/fine" for i in range(400)]
    bad = [i < 40 or 120 <= i < 179 for i in range(len(urls))]
    urls += [None, "nothing", "http://h1.org/casino/promo", "http://new.org/PROMO/casino?a=1", "http://www.example.com/en/spam"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(bad)] + [(0, True), (99_999, True), (5, None), (None, True)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filters.judge(pages, labels).collect()}
    n = len(bad)
    assert len(got) == len(urls) + 1
    assert {got[i].mined_rule for i in [*range(40), n + 2, n + 3, n + 5]} == {"p:casino p:promo"}
    assert {got[i].mined_rule for i in range(120, 160)} == {"p:spam"} and got[120].mined_confidence == 1.0
    assert all(got[i].mined_rule is None and got[i].verdict == "allow" for i in [*range(40, 120), *range(160, n), n, n + 1])
    assert (got[n + 4].rule, got[n + 4].verdict, got[n + 4].mined_rule) == ("www.example.com/en/", "allow", "p:spam")


def test_toxicity_query_finds_planted_words(spark, tmp_path):
    marks = ["idiot", "moron", "trash", "scum", "loser"]
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        w = words(int(rng.integers(20, 300)), i, 3000)
        if i % 5 == 0:
            for at in rng.integers(0, len(w), 3 + len(w) // 40):
                w.insert(int(at), marks[int(rng.integers(0, 5))])
        if i % 9 == 1:
            w += [w[0]] * 60
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, "idiot moron scum", None, None, None), (2002, " ".join(words(200_000, 8, 3000)) + " idiot moron trash scum loser idiot", "en", "s", 0), (5, rows[5][1], "en", "s", 0)]
    folder = tables(spark, tmp_path, documents=rows, labels=[*labels, (5, 1, 1), (7, 0, None), (77_777, 0, 1)])
    got = QUERIES["op8_toxicity"](spark, folder).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    caught = [r.predicted for r in held if r.doc_id % 5 == 0]
    alone = [1 - r.predicted for r in held if r.doc_id % 5]
    assert np.mean(caught) >= 0.9 and np.mean(alone) >= 0.98
    assert {r.predicted for r in got if r.doc_id == 2002} == {1} and {r.predicted for r in got if r.doc_id in (2000, 2001)} == {0}


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (2, 1, 1)]])
def test_toxicity_without_two_classes(spark, tmp_path, labels):
    folder = tables(spark, tmp_path, documents=[(1, "a b", None, None, 0), (2, None, None, None, 0)], labels=labels)
    assert {round(r.score) for r in QUERIES["op8_toxicity"](spark, folder).collect()} == {1 if labels and labels[0][2] else 0}


def test_language_query_on_held_out_rows(spark, tmp_path):
    letters = {"en": "abcdefgh", "fr": "aceéàùlm", "ru": "абвгдежз", "zh": "中文字母表格学习"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(12)), lang, "s", 0) for i in range(400) for lang in [list(letters)[i % 4]]]
    rows += [(500, None, "en", "s", 0), (501, "123 !!", "en", "s", 0), (None, "абв где", None, None, None), (502, "中" * 300_000, None, "s", 0), (3, rows[3][1], "zh", "s", 0)]
    got = QUERIES["op10_language_id"](spark, tables(spark, tmp_path, documents=rows)).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.lang_pred == list(letters)[r.doc_id % 4] and 0 <= r.score <= 1 for r in held)
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[500], by[501], by[None], by[502]) == ("und", "und", "ru", "zh")


def test_prior_decides_between_equal_texts(spark):
    rows = [(i, "aaa", "x" if i % 4 else "y") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(d, language_id.fit(d)).collect()} == {"x"}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", None])
def test_same_rows_as_sql(spark, tmp_path, name, data):
    if data is None:
        lines = ["menu", "  menu ", "own", "", "a b c"]
        rows = [(i, None if i == 5 else "\n".join([*lines[: i % 6], f"own {i}"]), "en", None if i % 7 == 0 else f"s{i % 11}", 0) for i in range(60)] + [(3, "menu", "en", "s1", 0), (3, "menu", "en", "s1", 0), (61, "x " * 50_000, "en", "big", 0), (62, "", "en", "none", 0)]
        data = tables(spark, tmp_path, documents=rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{data}/documents.parquet{'/*.parquet' if 'testdata' not in data else ''}')")
    got, want = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, tables(spark, tmp_path)).count() == 0


def test_mix_keeps_to_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en", (None, "a", "b", "c", "d")[min(i % 9, 4)], 0) for i in range(3000)]
    got = spark.createDataFrame(rows, DOCS)
    _, plan = mixing.plan_mix(got)
    targets = {r.source: r.target for r in plan.collect()}
    taken: dict = {}
    for r in mixing.mix(got).collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken[s] - t) <= 10 for s, t in targets.items())


def brute_pipeline(rows, bench):
    import public_tokenizers
    from tokenizers import Tokenizer

    kept = [(i, t, s) for i, t, _, s, _ in rows if any(c.isalpha() for c in t or "")]
    comp = [g[2] for g in groups([(i, t) for i, t, _ in kept], 5, 80)]
    kept = [r for r, c in zip(kept, comp, strict=True) if r[0] == c]
    grams = set()
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    for _, t in bench:
        w = word(t)
        n = min(13, len(w))
        grams |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()

    def contaminated(t):
        w = word(t)
        hit = np.zeros(len(w), bool)
        for g in grams:
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit[a : a + len(g)] = True
        return hit.any() and 20 * hit.sum() >= len(w)

    kept = [r for r in kept if not contaminated(r[1])]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sources = sorted({s for _, _, s in kept}, key=lambda s: (s is None, s or ""))
    total, weight = {s: sum(size(t) for _, t, x in kept if x == s) for s in sources}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    full: set = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        target = {s: 2.0 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        more = {s for s in sources if s not in full and target[s] >= 2 * total[s]}
        if not more:
            break
        full |= more
    hashed = lambda i, t: int(hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    mixed = []
    for s in sources:
        own = sorted((hashed(i, t), i, t) for i, t, x in kept if x == s)
        for epoch in (0, 1):
            budget, run = max(0.0, min(float(total[s]), target[s] - epoch * total[s])), 0
            for _, i, t in own:
                if run + size(t) > budget:
                    if budget - run >= run + size(t) - budget:
                        mixed.append((i, t))
                    break
                run += size(t)
                mixed.append((i, t))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for i, t in sorted(mixed):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng, rows = np.random.default_rng(4), []
    for i in range(200):
        base = words(int(rng.integers(8, 90)), i // 3 if i % 2 else 1000 + i, 2000)
        text = " ".join([*base[: len(base) - i % 2], f"t{i % 4}"])
        rows.append((i, None if i % 41 == 0 else "12 34 !" if i % 43 == 0 else text, "en" if i % 3 else None, (None, "a", "b", "c")[i % 4], len(text)))
    passage = words(40, 77, 5000)
    rows += [(300, " ".join([*passage, *words(20, 78)]), "en", "a", 0), (301, " ".join([*passage[:13], *words(400, 79)]), "en", "a", 0), (302, "", "en", "b", 0), (303, " ".join(words(6000, 80, 4000)), "en", "b", 0)]
    bench = [("i1", " ".join(passage)), ("i2", None and "")]
    folder = tables(spark, tmp_path, documents=rows, benchmark=bench)
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == sorted(brute_pipeline(rows, [(i, t or "") for i, t in bench]))
    assert 300 not in {r[0] for r in got} and 301 in {r[0] for r in got}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path)).count() == 0
