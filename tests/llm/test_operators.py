"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, langid, ledger, licenses, ngram_join, packing, sharding, surrogates, toxicity, urlrules
from fathomline.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, extra string"
KEY = surrogates.SurrogateParams("a key of these tests")
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog tonight"),
    (2, "the QUICK brown fox jumps over the lazy dog tonight"),
    (3, None),
    (4, ""),
    (5, "one two"),
    (6, "One  two"),
    (7, " ".join(f"w{i}" for i in range(3000))),
    (8, " ".join(f"w{i}" for i in range(2990)) + " changed end"),
    (None, "an id may be missing here and it still counts"),
    (9, "tab\tand\nnew\x0bline \x1c sign é ß"),
    (9, "tab\tand\nnew\x0bline \x1c sign é ß"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    names = {}
    for i, (doc, _) in enumerate(rows):
        ids = names.setdefault(top(i), [])
        if doc is not None:
            ids.append(doc)
    return [(doc, len(sets[i]), (min(names[top(i)]) if names[top(i)] else None) if sets[i] else doc) for i, (doc, _) in enumerate(rows)], links


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_join_edges(spark, docs, none):
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    assert key(got) == key(brute_components(TEXTS)[0])
    assert ngram_join.near_duplicates(none).count() == 0
    # A very long text beside a near copy, many exact copies, and columns named like inner ones.
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 0), (2, long + " and an end", 0), *((10 + i, "a hot text of seven words here", 0) for i in range(300))]
    clash = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("component", F.lit(1))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(clash).collect()}
    assert got == {1: 1, 2: 1} | {10 + i: 10 for i in range(300)}


@pytest.mark.parametrize("block_rows", [1 << 16, 6])
def test_join_random_near_copies(spark, block_rows):
    random.seed(11)
    word = lambda: random.choice("abcdefghij") + random.choice("klmnop") + str(random.randrange(40))
    passage = [word() for _ in range(60)]
    rows, base = [], [[word() for _ in range(random.choice((6, 30, 80, 200)))] for _ in range(12)]
    for i in range(120):
        w = list(random.choice(base))
        if i % 5 == 0:
            w += passage
        for _ in range(random.randrange(0, 5)):
            w[random.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    params = ngram_join.JoinParams(short_list=2, first_leaders=4, sketch_bits=12, block_rows=block_rows, hub_pairs=2, slice_bytes=900)
    want, _ = brute_components(rows)
    assert key([tuple(r) for r in ngram_join.near_duplicates(df, params=params).collect()]) == key(want)
    if block_rows > 6:
        return
    found, members = ngram_join.links(df, params=params)
    node = {r.doc_id: r.node for r in members.collect()}
    pairs = {(r.a, r.b) for r in found.collect()}
    sets = {i: set(ngram_join.shingles(t, params).tolist()) for i, t in rows}
    exact = {tuple(sorted((node[i], node[j]))) for i in sets for j in sets if i < j and node[i] != node[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {tuple(sorted(p)) for p in pairs} == exact


def test_toxicity_learns_stems_and_keeps_edges(spark, none):
    random.seed(2)
    ordinary = ["".join(random.choice(("the", "an", "er", "on", "re", "ing", "tion", "ha")) for _ in range(random.randrange(1, 5))) for _ in range(3000)]
    text = lambda bad: " ".join(random.choice(("grob", "zlof")) + random.choice(("x", "um", "ei", "ar")) if bad and random.random() < 0.04 else random.choice(ordinary) for _ in range(90))
    rows = [(i, text(i % 5 == 0)) for i in range(600)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels.where("doc_id < 480"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    right = [(got[i] >= 0.5) == (i % 5 == 0) for i in range(480, 600)]
    assert np.mean(right) > 0.9
    edges = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string"), model)
    scores = [r.score for r in edges.collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] < 0.5
    assert toxicity.fit(df, labels.where("toxic = 0")) is None and toxicity.score(df, None).where("score <> 0").isEmpty()
    assert toxicity.score(none, model).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(df.withColumn("score", F.lit(1)), model)


def brute_alignment(a, b):
    """Longest common subsequence length."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_licenses(docs, none, spark):
    random.seed(4)
    for _ in range(60):
        b = [random.choice("abcdefghijklmnop") + str(random.randrange(9)) for _ in range(40)]
        a = [w for w in b if random.random() > 0.1]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= brute_alignment(a, b)
    assert len(licenses.align(list("xaby"), list("abc"))) == 2
    notice = "Released under the MIT License."
    rows = [(1, f"foo bar. {notice} more words here. {notice}"), (2, "released a license under the moon"), (3, "MIT License"), (4, None)]
    got = {r.doc_id: [(s.license, s.start, s.end) for s in r.licenses] for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("MIT-notice", 2, 7), ("MIT-notice", 10, 15)] and got[2] == got[3] == got[4] == []
    full = dict(licenses.TEMPLATES)["MIT"].replace("merge,", "").replace("sell", "vend")
    one = licenses.find(spark.createDataFrame([(1, "x y z " * 400 + full + " tail" * 300)], "doc_id long, text string")).first().licenses
    assert one[0].license == "MIT" and one[0].coverage > 0.95
    assert licenses.find(docs).count() == len(TEXTS) and licenses.find(none).count() == 0


def test_surrogates(spark, docs, none):
    rows = [
        (1, "mail el.99@mail9.example.com or EL.99@mail9.example.com, +1 (555) 123-4567, 10.0.0.255."),
        (2, "again el.99@mail9.example.com and 4111111111111111 and 4111111111111112 and 123-45-6789"),
        (3, 'token = "9abc9ff9ca9fb9e9c999a9eb99999999a999bdde" Frau Anna Müller met Herr Müller'),
        (4, None), (5, ""), (6, "clean text, 12 words 3.5 and v1.2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r.doc_id: r for r in surrogates.replace(df, surrogates.SurrogateParams(k)).collect()} for k in ("one", "two"))
    assert a[4].text is None and a[5].text == "" and a[6].text == rows[5][1]
    assert a[1].text != b[1].text != rows[0][1]
    mail = r"[\w.]+@[\w.]+\.com"
    first = re.findall(mail, a[1].text)
    assert re.findall(mail, a[2].text) == first[:1] and first[0] != first[1] and first[0].endswith("example.com")
    assert re.fullmatch(r"mail [a-z]{2}\.\d\d@[a-z]{4}\d\.example\.com or [A-Z]{2}\.\d\d@.*, \+1 \(\d{3}\) \d{3}-\d{4}, (\d{1,3}\.){3}\d{1,3}\.", a[1].text)
    luhn = lambda s: sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(s))) % 10
    cards = re.findall(r"\d{16}", a[2].text)
    assert [luhn(c) for c in cards] == [luhn("4111111111111111"), luhn("4111111111111112")] and len(set(cards)) == 2
    names = re.search(r"Frau (\w+) (\w+) met Herr (\w+)", a[3].text)
    assert names[2] == names[3] != "Müller" and names[1].lower() in surrogates.GIVEN_NAMES[1] and names[1] != "Anna"
    assert re.search(r'"[0-9a-f]{40}"', a[3].text) and "9abc9ff9" not in a[3].text
    many = spark.range(4000).select(F.concat(F.lit("x "), F.format_string("a%d.%d@m1.example.com", "id", "id"), F.lit(" "), F.format_string("10.0.%d.%d", F.floor(F.col("id") / 256), F.col("id") % 256)).alias("text"))
    assert all(r.shared == 0 and r.entities == r.surrogates == 4000 for r in surrogates.collisions(many, KEY).collect())
    assert surrogates.replace_checked(docs, KEY).count() == len(TEXTS) and surrogates.replace_checked(none, KEY).count() == 0
    with pytest.raises(ValueError):
        surrogates.replace(docs.withColumn("n_ip", F.lit(1)), KEY)
    with pytest.raises(TypeError):
        surrogates.SurrogateParams()


def test_sharding(spark, docs, none):
    rows = [(i, f"t{i % 90}" if i < 180 else "hot" if i < 500 else f"u{i}") for i in range(1000)] + [(None, None), (7, "t7"), (7, "t7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df, params=sharding.ShardParams(shards=8)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is not None, r.doc_id) for r in got if r.doc_id is not None) == sorted((True, i) for i, _ in rows if i is not None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 8 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(rows)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    spread = {}
    for r in got:
        if r.doc_id is not None and r.doc_id < 180:
            spread.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) <= 25  # random placing would cut about 80 of 90
    assert sharding.assign(none).count() == 0 and sharding.assign(docs).count() == len(TEXTS)


def brute_hits(text, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        grams = {tuple(b[i : i + k]) for i in range(max(1, len(b) - k + 1))} if b else set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()


@pytest.mark.parametrize("block", [200_000, 5])
def test_decontamination(spark, docs, none, block):
    random.seed(8)
    word = lambda: random.choice(("a", "b", "c", "é", "x1"))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 14, 10, 3, 30, 2, 0))] + [(20, None), (21, "A-B, a"), (10, items_text := "zz " * 11), (None, "no id has this one, yet it is a passage"), (None, "c c b")]
    rows = [(i, " ".join(word() for _ in range(random.randrange(0, 120)))) for i in range(25)]
    rows += [(30, "Before! " + items[4][1].replace("a", "A").replace("c", "C") + " after"), (31, items[4][1][:-1]), (32, None), (33, items_text * 40), (33, items_text * 40), (34, "q " * 3000 + items[1][1]), (35, "x No id has this one, yet it is a passage. y"), (36, "q " * 40_000 + items_text)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    params = decontaminate.DecontaminateParams(shard_bytes=700, block_phrases=block)
    found = decontaminate.find_spans(df, bench, params=params)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.digest(found).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t in rows)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(found).collect()}
    assert cut[32] is None and "before" in cut[30].lower() and len(cut[30]) < 40
    assert decontaminate.find_spans(none, bench).count() == 0
    empty = decontaminate.digest(decontaminate.find_spans(docs, bench.where("false"))).collect()
    assert len(empty) == len(TEXTS) and not any(r.contaminated for r in empty)


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 400):
        symbols = np.append(rng.integers(1, 5, n), 0)
        order = decontaminate.suffix_order(symbols)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: symbols[i:].tolist())
        index = decontaminate.FMIndex(symbols, 6, 4)
        phrases = np.array([[1, 2, 0], [3, 3, 3], [4, 0, 0], [5, 1, 0]])
        lo, hi = index.search(phrases, np.array([2, 3, 1, 2]))
        for p, size, a, b in zip(phrases.tolist(), (2, 3, 1, 2), lo, hi):
            want = [i for i in range(n + 1 - size + 1) if symbols[i : i + size].tolist() == p[:size]]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    params = packing.PackParams(tokenizer=path, length=64, slice_chars=300)
    rows = [(i, t) for i, t in TEXTS] + [(40, "ΑΣ. a.., b?. _. x.y,z 1,2.3 It's I'LL <|endoftext|> \u00a0q e\u0301. ½. ²,")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    stream = {}
    for r in got:
        stream[r.sequence_id * 64 + r.offset] = r
    at = 0
    while at in stream:
        at += stream[at].length
    want = sorted(zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()) for _, t in rows)
    assert at == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows) and max(r.sequence_id for r in got) == (at - 1) // 64
    whole = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.PackParams(tokenizer=path, length=1 << 20)).collect()
    assert sorted(r.ids_crc32 for r in whole) == want and all(r.start == 0 and r.length == r.doc_tokens for r in whole)
    assert packing.pack(none, params).count() == 0


def test_hilbert_keys_visit_neighbours():
    for dims in (2, 3):
        grid = np.stack(np.meshgrid(*[np.arange(8)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_key(grid, 3)
        assert sorted(keys.tolist()) == list(range(8**dims))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_language_profiles(spark, docs, none):
    rows = [(i, random.Random(i).choice(("der die das und nicht ist sehr", "the and of to in that is")), None) for i in range(200)]
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 5)), "de" if "d" in t.split()[0] and t.startswith("der") else "en") for i, t, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ranked = langid.fit(df.where("doc_id < 120"), params=langid.LangParams(size=50))
    got = langid.predict(df, ranked, params=langid.LangParams(size=50)).where("doc_id >= 120").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) == 1.0
    edge = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 _ !"), (4, "x")], "doc_id long, text string"), ranked).collect()}
    assert edge[1] == edge[2] == edge[3] == ("und", 0.0) and edge[4][0] in ("de", "en")
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"} and langid.predict(none, ranked).count() == 0
    assert langid.fit(none) == {}


def test_language_profiles_count_copies_once(spark):
    # Whether a copied text is drawn or not, each language keeps a profile, and copies add nothing to it.
    def fitted(copies):
        rows = [(f"{w} nur", w) for w in "abcdefgh" for _ in range(copies)] + [(f"wort {w} {v}", "many") for w in "abcdefghij" for v in "klmnopqrst"] + [("wort a k", "many")] * copies
        return langid.fit(spark.createDataFrame(rows, "text string, lang string"), params=langid.LangParams(size=50, fit_rows=20))

    ranked = fitted(400)
    assert set(ranked) == {*"abcdefgh", "many"} and ranked == fitted(1)


def test_rank_distance_by_hand():
    profiles = langid.Profiles({"a": [1, 2, 3], "b": [3, 2, 9]}, 3)
    own = np.array([3, 2, 1])
    want = {"a": 2 + 0 + 2, "b": 0 + 0 + 3}
    at = np.searchsorted(profiles.union, own)
    ranks = profiles.ranks[:, at]
    away = np.where(ranks < 0, 3, np.abs(ranks - np.arange(3))).sum(axis=1)
    assert dict(zip(profiles.langs, away.tolist())) == want


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), (None, "/", "block"), ("b.example.com", "/en/7", "block")], "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://Example.COM/en/1", "http://a.example.com/en/75?x#y", "x://b.example.com/en/7", "http://notexample.org/en/7", "http://com", "http://com/en/", "a://b://c.com/en/2", "http://example.com#/en/7"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(3, urls[3], "z")], "page_id long, url string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df, rules).collect()]
    assert key(got) == key([
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.com", "/en/1", "com/en/", "block"), (3, "example.com", "/en/1", "com/en/", "block"),
        (4, "a.example.com", "/en/75", "example.com/en/7", "allow"), (5, "b.example.com", "/en/7", "b.example.com/en/7", "block"), (6, "notexample.org", "/en/7", None, "allow"),
        (7, "com", "", None, "allow"), (8, "com", "/en/", "com/en/", "block"), (9, "b:", "//c.com/en/2", None, "allow"), (10, "example.com", "", None, "allow"),
    ])
    assert urlrules.judge(df.where("false"), rules).count() == 0
    assert {r.verdict for r in urlrules.judge(df, rules.where("false")).collect()} == {"allow"}


def test_ledger(spark, docs, none):
    line = "one two three four five six seven eight"
    rows = [(1, line + " " + line), (2, "a a a a a a a a a"), (3, None), (4, "x\nx\n \nx #$%"), (5, " ".join(f"w{i}" for i in range(40))), (6, " ".join(f"W{i}!!" for i in range(40)))]
    got = {r.doc_id: r for r in ledger.apply_policy(ledger.ledger(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    for i, t in rows:
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == brute(t)
    assert got[5].kept and not got[6].kept and not got[1].kept and got[3].fail_mask == 1
    rows_df = ledger.ledger(docs)
    table = {r.rule: r for r in ledger.ablation(rows_df).collect()}
    masks = [r.fail_mask for r in rows_df.collect()]
    for bit, rule in enumerate(ledger.RULES):
        assert table[rule].n_failed == sum(m >> bit & 1 for m in masks)
        assert table[rule].n_kept_without == sum(m & ~(1 << bit) == 0 for m in masks)
    assert ledger.ledger(none).count() == 0
    with pytest.raises(ValueError):
        ledger.measure(docs.withColumn("n_words", F.lit(1)))


def test_native_operators_use_no_python(docs):
    for df in (ledger.ledger(docs), surrogates.replace(docs, KEY), sharding.assign(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
