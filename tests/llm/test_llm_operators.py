"""Small cases of every operator against plain Python, and odd input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import classifier, exact_topk, graph, lm_scoring, mixing, ngram_join, packing, quality_rules, skew, textops, token_counts, url_filters

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, token string"


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def frame(spark, texts, sources=None, parts=3):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", 0, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, "doc_id") if rows else spark.createDataFrame([], SCHEMA)


def odd_texts():
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "Été", "ǅ", "中文", "don't", "#*$", "|"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(80)) for _ in range(6)]
    texts = [None, "", " \t\n\x0b\r", "one", "ONE", "one two", "one\x1ctwo", "a\u00a0b \u2028 c", "<|endoftext|>", "x<|endoftext|><|startoftext|>y"]
    texts += base + base[:2] + [base[0].upper(), base[1] + " tail"]
    for i in range(12):
        words = base[i % 3].split()
        words[i * 5 % 80] = f"n{i}"
        texts.append(" ".join(words))
    texts += ["rep eat " * 300, "line\n" * 30 + "other words here\n", "long " + "z" * 5000]
    return texts


def test_ngram_join_equals_brute_force(spark):
    texts = odd_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def brute_components(texts, width=3, percent=90):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("common", "edits"), [(2, 3), (4, 3), (3, 9)])
def test_ngram_join_with_dense_groups(spark, monkeypatch, common, edits):
    """Most shingles are common here, so classes go by centres, mixed with sparse ones."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "COST", 2)
    monkeypatch.setattr(ngram_join, "OUTSIDERS", 5)
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    rnd = random.Random(common + edits)
    bases = [[f"b{g}w{i}" for i in range(70)] for g in range(3)]
    shared = [f"c{i}" for i in range(40)]
    texts = []
    for k in range(60):
        words = list(bases[k % 3])
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(70)] = f"e{rnd.randrange(9)}"
        if k % 5 == 0:
            words = shared + words[: rnd.randint(5, 30)]
        if k % 7 == 0:
            words = words[rnd.randint(0, 4) :]
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_ngram_join_empty_and_repeated(spark):
    assert ngram_join.ngram_join(frame(spark, [])).collect() == []
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, "x y z w"), (2, "q q"), (9, "X Y Z W")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect())
    assert got == Counter({(5, 2, 5): 2, (None, 2, 5): 1, (2, 2, 2): 1, (2, 1, 2): 1, (9, 2, 2): 1})


def test_words_without_structure_in_their_hashes(spark):
    """Sequences that polynomial hashes modulo a power of two can't tell apart, and words of every length."""
    thue = lambda a, b: "".join(b if i.bit_count() % 2 else a for i in range(1024))
    texts = [thue("a", "b"), thue("b", "a"), thue("ab ", "cd "), thue("cd ", "ab "), "x" * 64, "x" * 65, "x" * 66, *("y" * n for n in range(1, 20))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, texts)).collect()}
    assert got == brute_components(texts)
    words = textops.Words(pa.array([" ".join(f"{i:x}".rjust(n, "0") for n in (1, 8, 9, 16, 63, 64, 65, 200) for i in range(500))]))
    text = [bytes(words.bytes[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
    assert len(set(words.hashes().tolist())) == len(set(text))


def test_ngram_join_without_ids(spark):
    """Rows without id, or of one id, are joined by their texts: no pair of them is made for its id."""
    pairs = [f"{' '.join(f'p{i}w{k}' for k in range(60))}{end}" for i in range(150) for end in ("", " more")]
    for key in (None, 4):
        df = spark.createDataFrame([(key, t) for t in pairs] + [(key, pairs[0])] * 40, "doc_id long, text string").repartition(3)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect())
        assert got == Counter({(key, 58, key): 190, (key, 59, key): 150})


def test_hot_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL", 3)
    monkeypatch.setattr(skew, "PARTS", 5)
    rows = [(i, "a" if i % 3 else f"k{i % 17}") for i in range(300)] + [(1000, "none")]
    df = spark.createDataFrame(rows, "i long, k string")
    table = df.filter("i < 1000").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    for how in ("left", "inner"):
        got = skew.hot_join(df, table, ["k"], "n", 300, F.col("i"), how)
        assert Counter(map(tuple, got.select("i", "k", "n", "least").collect())) == Counter(map(tuple, df.join(table, "k", how).select("i", "k", "n", "least").collect()))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_components_of_hubs_and_random_links(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(200, 200 + i) for i in range(1, 60)] + [(260, 259), (5, 5)]
    root = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(links + links[:5], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted(root.items())


def test_written_frame_takes_no_job_for_a_cache(spark):
    """One job for the shuffle and one that writes: the driver keeps a record of every task."""
    spark.sparkContext.setJobGroup("checkpoint", "counted")
    out = graph.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("checkpoint")
    spark.sparkContext.setJobGroup("others", "not counted")
    assert len(jobs) == 2 and out.count() == 7


def test_classifier_is_fitted_off_the_driver(spark, monkeypatch):
    def here(*_):
        raise AssertionError("fitted by the driver")

    texts = [" ".join(f"{'good' if i % 2 else 'bad'}word{(i + k) % 9}" for k in range(30)) for i in range(200)]
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    row, feature, _ = classifier.features(docs.filter(F.col("text").isNotNull()).orderBy(F.xxhash64("doc_id", "text")).select("text").toArrow()["text"].combine_chunks())
    targets = np.array([r.doc_id % 2 for r in docs.orderBy(F.xxhash64("doc_id", "text")).collect()], np.float64)
    wanted = classifier.fit(feature.astype(np.uint32), np.bincount(row), targets)
    monkeypatch.setattr(classifier, "fit", here)
    good, toxic = classifier.train(docs, labels)
    assert wanted.any() and np.array_equal(good, wanted) and not toxic.any()


def test_quality_rules_measures(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {p for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(frame(spark, [])).collect() == []


def test_quality_rules_host_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 20 else "short", "fine") for i in range(400)] + [(1000 + i, "short" if i % 10 else good, "bad") for i in range(200)] + [(5000, "short", "new"), (5001, good, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].kept and not got[0].kept
    assert got[1000].host_failed and not got[1000].kept  # a good text on a failing host
    assert not got[5000].host_failed and got[5001].kept  # one failure doesn't condemn a host


def test_token_counts_equal_the_library(spark):
    texts = odd_texts()
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for parts in (1, 5):
        got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), path, parts=parts, limit=100).collect()}
        for i, t in enumerate(texts):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100)
    assert token_counts.token_counts(frame(spark, []), path).collect() == []


def test_token_counts_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 500)
    texts = odd_texts() * 2
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return lower(host), re.match(r"[^?#]*", rest[len(host) :]).group()


@pytest.mark.parametrize("inline", [256, 0])
def test_url_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filters, "INLINE_RULES", inline)
    urls = [None, "", "nourl", "http://A.Example.com/en/7x?q", "https://com/en/", "http://xcom/en/1", "http://b.example.net/de/80#t", "http://example.net/de/7", "http://o.org/es/5", "http://o.org/fr/5", "http://o.org", "x://a.org/es/?://", "http://a.example.com/en/8"] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = pages.limit(0).select("url", F.lit(True).alias("bad"))
    got = {r.page_id: r for r in url_filters.url_filters(pages, none).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = host_path(u)
        fits = [(r, v) for r, v in url_filters.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best), u


def test_url_rules_are_mined(spark):
    rnd = random.Random(1)
    urls, bad = [], []
    for i in range(600):
        spam = i % 4 == 0
        host = rnd.choice(["a.site.info", "b.site.info", "c.other.info"])
        urls.append(f"http://{host}/{'win' if spam else 'news'}/{'now' if spam or i % 3 else 'later'}/{i}")
        bad.append(spam)
    labelled = spark.createDataFrame(list(zip(urls, bad, strict=True)), "url string, bad boolean")
    fresh = ["http://z.site.info/win/now/1", "http://z.site.info/news/now/1", "http://a.site.info/win/later/2"]
    pages = spark.createDataFrame(list(enumerate([*urls, *fresh])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.url_filters(pages, labelled, rules=[]).collect()}
    assert all((got[i] == "block") == b for i, b in enumerate(bad))
    assert [got[600 + i] for i in range(3)] == ["block", "allow", "block"]
    assert brute_rules(spark, labelled) == {tuple(sorted(r.antecedent)) for r in url_filters.mine_rules(split(labelled), 20, 0.9).collect()}


def test_url_rules_are_mined_from_explicit_verdicts(spark):
    """What nearly all urls that have it share with the blocked ones is carried over; what a rule is made of is not.  Ids, urls and column names repeat."""
    urls = [f"http://h{i % 9}.{'com' if i % 2 else 'org'}/{'es' if i % 2 == 0 else 'fr'}/{i}{'?ad=1&x=2' if i % 2 == 0 else '?x=2'}" for i in range(200)]
    urls += ["http://a.net/x/1?ad=1", "http://a.net/es/1", "http://a.net/fr/1", None, None, "http://b.net/x/2?ad=1", "http://b.net/x/2?ad=1", "http://c.org/fr/3", "http://d.net/x?x=2"]
    pages = spark.createDataFrame([(i % 50, u, "h", "p", "r", True) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, mined boolean")
    rows = url_filters.url_filters(pages, rules=[("org/es/", "block"), ("com/fr/", "allow"), ("org/es/", "allow")]).collect()
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.mined) for r in rows)
    wanted = Counter()
    for i, u in enumerate(urls):
        host, path = host_path(u)
        rule = "org/es/" if host.endswith("org") and path.startswith("/es/") else "com/fr/" if host.endswith("com") else None
        mined = rule is None and "ad=1" in (u or "")
        wanted[(i % 50, host, path, rule, "block" if rule == "org/es/" or mined else "allow", mined)] += 1
    assert got == wanted
    assert url_filters.url_filters(pages.limit(0)).collect() == []


def test_a_token_must_be_bad_wherever_it_occurs(spark):
    """Half of the urls with a token aren't named by any rule, so it says nothing."""
    urls = [f"http://h{i}.org/es/{i}?ad=1" for i in range(40)] + [f"http://h{i}.org/fr/{i}?ad=1" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert not any(r.mined for r in url_filters.url_filters(pages, rules=[("org/es/", "block")]).collect())
    assert url_filters.made_of([("A.b.org/es/x", "block")]) == ["d:a.b.org", "d:b.org", "h:a", "h:b", "h:org", "p:es", "p:x"]


def split(labelled):
    host, path = url_filters.host_path(F.col("url"))
    return labelled.withColumns({"host": host, "path": path}).select(url_filters.url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "bad")


def brute_rules(spark, labelled):
    from itertools import combinations

    rows = split(labelled).collect()
    least = 20
    frequent = {t for t, c in Counter(t for r in rows for t in r.tokens).items() if c >= least}
    seen, hit = Counter(), Counter()
    for r in rows:
        own = sorted(frequent & set(r.tokens))
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                seen[c] += 1
                hit[c] += r.bad
    sure = {c for c in seen if hit[c] >= least and hit[c] / seen[c] >= 0.9}
    return {c for c in sure if not any(set(x) < set(c) for x in sure)}


def test_packing(spark):
    texts = odd_texts() + ["many words here " * 3000]
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for window, most in ((2048, 1024), (64, 4)):
        rows = packing.pack(frame(spark, texts), path, window=window, max_open=most).collect()
        ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
        pieces, windows = defaultdict(list), defaultdict(list)
        for r in rows:
            assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids[r.doc_id])
            pieces[r.doc_id].append((r.start, r.length))
            windows[r.sequence_id].append((r.offset, r.length))
        for d, own in pieces.items():
            assert gapless(own) == len(ids[d])
        assert len(pieces) == len(texts)
        for own in windows.values():
            n = gapless(own)
            assert n == window or n & (n - 1) == 0
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(frame(spark, texts), path)).collect()}
    assert digest[(0, 0)] == zlib.crc32(ids[0].tobytes())
    assert packing.pack(frame(spark, []), path).collect() == []


def gapless(pieces):
    at = 0
    for start, length in sorted(pieces):
        assert start == at and length > 0
        at += length
    return at


def test_packing_places_nearly_all_by_the_method():
    """The share of tokens in windows that placement alone filled, and memory bounded where nothing fits together."""
    rnd = random.Random(4)
    for n, least in ((250, 0.3), (1000, 0.5), (8000, 0.85)):
        packer = packing.Packer(2048)
        for i in range(n):
            packer.place(i, bytes(4 * max(1, int(rnd.lognormvariate(6, 1)))))
        packer.finish()
        assert packer.placed / packer.total > least
    packer = packing.Packer(2048, 50)
    for i in range(2000):
        packer.place(i, bytes(4 * 1500))
        assert packer.n_open <= 50
    packer.finish()
    sizes = Counter(sum(len(ids) // 4 for _, _, ids in w) for w in packer.done)
    assert sum(k * v for k, v in sizes.items()) == packer.total == 3_000_000 and all(k & (k - 1) == 0 for k in sizes)
    cut = Counter(row for w in packer.done for row, _, _ in w)
    assert sum(v - 1 for v in cut.values()) <= len(packer.done)


def test_packing_level_minimises_the_sum_of_squares():
    rnd = random.Random(2)
    packer = packing.Packer(32)
    for _ in range(400):
        size = rnd.randint(1, 31)
        counts = packer.counts.copy()

        def cost(level, counts=counts, size=size):
            c = counts.copy()
            c[level] -= level > 0
            if level + size < 32:
                c[level + size] += 1
            return (c[1:32] ** 2).sum()

        level = packer._level(size)
        options = [h for h in range(32 - size + 1) if h == 0 or counts[h]]
        assert level in options and cost(level) == min(map(cost, options))
        packer.place("d", bytes(4 * size))


@pytest.mark.parametrize(("order", "leave_out"), [(1, False), (2, True), (3, True), (3, False)])
def test_lm_scores(spark, order, leave_out):
    texts = odd_texts()
    got = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, texts), order=order, leave_out=leave_out, blocks=3).collect()}
    docs = [WORD.findall(lower(t or "")) for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    every = sum(map(grams, docs), Counter())
    for i, w in enumerate(docs):
        c = every - grams(w) if leave_out else every
        n = sum(map(len, docs)) - len(w) * leave_out
        total = 0.0
        for k in range(len(w)):
            for m in range(order, 0, -1):
                g = tuple(w[k - m + 1 : k + 1]) if k >= m - 1 else None
                if m == 1:
                    s = 0.4 ** (order - 1) * max(c[(w[k],)], 1) / max(n, 1)
                elif g and c[g]:
                    s = 0.4 ** (order - m) * c[g] / max(c[g[:-1]], c[g])
                else:
                    continue
                total += math.log(s)
                break
        assert got[i].n_words == len(w) and got[i].log_score == pytest.approx(total, abs=1e-4), texts[i]
        assert (got[i].mean_log_score is None) == (not w)
    assert lm_scoring.lm_scores(frame(spark, [])).collect() == []


def test_lm_packing_is_a_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 32, 4095, 4096, 70_000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        assert (lm_scoring._unpacked(lm_scoring._packed(keys)) == keys).all()
        counts = rng.choice([1, 1, 1, 2, 254, 255, 256, 1 << 40], n)
        assert (lm_scoring._large(lm_scoring._small(counts)) == counts).all()
    ends = np.array([0, 1, (1 << 64) - 1] + list(range(5, 5000)), np.uint64)
    assert (lm_scoring._unpacked(lm_scoring._packed(np.sort(ends))) == np.sort(ends)).all()


def test_mixing_keeps_every_source_within_a_block(spark):
    sources = ["a"] * 900 + ["b"] * 400 + ["c"] * 100 + [None] * 7
    docs = frame(spark, ["t"] * len(sources), sources)
    targets = {"a": 0.25, "b": 0.45, "c": 0.3}
    rows = mixing.mix_sources(docs, targets, block_docs=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sources)))
    blocks = {(r.source, r.block): r for r in rows}
    assert len({r.slot for r in blocks.values()}) == len(blocks) == max(r.slot for r in rows) + 1
    assert all(r.release <= r.slot < r.deadline for r in rows)
    counts = Counter(r.source for r in rows)
    weights = mixing.integer_weights(counts, targets)
    first_out = min(max(r.slot for r in rows if r.source == s) for s in counts)
    order = [s for _, s in sorted((r.slot, s) for (s, _), r in blocks.items())]
    for n in range(1, first_out + 1):
        for s, w in weights.items():
            assert abs(order[:n].count(s) - n * w / sum(weights.values())) < 1
    assert mixing.mix_sources(frame(spark, [])).collect() == []


def test_period_equals_an_exhaustive_schedule():
    weights = {"a": 5, "b": 3, "c": 1, "d": 2}
    place, length = mixing.period_slots(weights), 11
    assert sorted(x for p in place.values() for x in p) == list(range(length))
    for s, w in weights.items():
        for j, slot in enumerate(place[s], 1):
            assert (j - 1) * length // w <= slot < -(-j * length // w)


def worst_deviation(blocks, targets, slots):
    """The most that a source's blocks differ from its target after any of the first slots."""
    rows = mixing.schedule(blocks, mixing.integer_weights(blocks, targets))
    total, given, worst = sum(map(Fraction, targets.values())), Counter(), 0
    for n, (s, block, slot, release, deadline) in enumerate(islice(rows, slots), 1):
        assert block == given[s] and slot == n - 1 and release <= slot < deadline
        given[s] += 1
        # between its own blocks a source only falls behind: its ends are checked by the deadlines
        ideal = n * Fraction(targets[s]) / total
        worst = max(worst, abs(given[s] - ideal), abs(given[s] - 1 - (n - 1) * Fraction(targets[s]) / total))
    ideals = {s: slots * Fraction(w) / total for s, w in targets.items()}
    return float(max(worst, *(abs(given[s] - ideals[s]) for s in targets)))


def test_mixing_keeps_targets_over_a_long_mix():
    documents = {f"s{i}": 1_000_000 if i == 0 else 105_000 for i in range(20)}
    targets = {s: math.sqrt(n) for s, n in documents.items()}
    blocks = {s: -(-n // mixing.BLOCK_DOCS) for s, n in documents.items()}
    assert mixing.integer_weights(documents, None) == mixing.integer_weights(documents, targets)
    assert worst_deviation(blocks, targets, 140_000) < 1
    assert worst_deviation({"a": 50_000, "b": 50_000}, {"a": 0.9999, "b": 0.0001}, 50_000) < 1


def test_mixing_gives_a_rare_source_its_target(spark):
    docs = frame(spark, ["t"] * 6000, ["b"] * 3 + ["a"] * 5997)
    rows = mixing.mix_sources(docs, {"a": 0.9999, "b": 0.0001}, block_docs=1).collect()
    slots = sorted(r.slot for r in rows)
    assert slots == list(range(6000)) and all(r.release <= r.slot < r.deadline for r in rows)
    # 0.6 of a block is b's by the time a is used up: its first at most, where a period of 1025 gave it all three
    assert sorted(r.slot for r in rows if r.source == "b")[1:] == [5998, 5999]


def test_mixing_takes_sources_of_no_weight_last():
    rows = list(mixing.schedule({"a": 3, "b": 5, "c": 2}, mixing.integer_weights({"a": 3, "b": 5, "c": 2}, {"a": 0.0, "b": 1.0, "c": -1.0})))
    assert [s for s, *_ in rows[:5]] == ["b"] * 5 and Counter(s for s, *_ in rows[5:]) == {"a": 3, "c": 2}
    assert [r[2] for r in rows] == list(range(10)) and all(release <= slot < deadline for _, _, slot, release, deadline in rows)


def test_mixing_keeps_ratios_as_sources_run_out():
    rnd = random.Random(2)
    for _ in range(60):
        blocks = {f"s{i}": rnd.randint(1, 30) for i in range(rnd.randint(1, 9))}
        weights = mixing.integer_weights(blocks, {s: rnd.choice([rnd.random(), rnd.randint(1, 4), n]) for s, n in blocks.items()})
        rows = list(mixing.schedule(blocks, weights))
        assert [r[2] for r in rows] == list(range(sum(blocks.values())))
        ideal, given = dict.fromkeys(blocks, Fraction(0)), Counter()
        for s, _, slot, release, deadline in rows:
            assert release <= slot < deadline
            given[s] += 1
            share = Fraction(1)
            while share:  # this slot's ideal share, up to where the next source runs out
                left = {s: w for s, w in weights.items() if ideal[s] < blocks[s]}
                step = min(share, *((blocks[s] - ideal[s]) * sum(left.values()) / Fraction(w) for s, w in left.items()))
                for s, w in left.items():
                    ideal[s] += step * w / sum(left.values())
                share -= step
            assert all(abs(given[s] - ideal[s]) < 1 for s in blocks)
        assert ideal == given == blocks


def test_mixing_takes_many_sources(spark):
    sources = [f"host{i % 1300}" for i in range(3000)]
    rows = mixing.mix_sources(frame(spark, ["t"] * len(sources), sources), block_docs=2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sources)))
    blocks = {(r.source, r.block): r for r in rows}
    assert sorted(r.slot for r in blocks.values()) == list(range(len(blocks)))
    assert all(r.source == sources[r.doc_id] and r.release <= r.slot < r.deadline for r in rows)


def test_interleave_keeps_rows_and_columns(spark):
    docs = frame(spark, [f"t{i}" for i in range(50)], [f"s{i % 3}" for i in range(50)])
    twice = docs.union(docs.filter("doc_id = 3")).union(spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA))
    got = mixing.interleave(twice)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, twice.collect()))


def test_classifier_holds_out(spark):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    texts, good, toxic = [], [], []
    for i in range(900):
        w = [rnd.choice(words) for _ in range(60)]
        kind = i % 6
        if kind == 0:
            w = [x + "%%%" for x in w]
        if kind == 1:
            w[rnd.randrange(60)] = rnd.choice(["vile", "vileness"]) + "ly"
        texts.append(" ".join(w))
        good.append(int(kind != 0))
        toxic.append(int(kind == 1))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(600)] + [(7, None, 1), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in classifier.quality_classifier(docs, labels).collect()}
    wrong = sum(got[i] != (good[i] == 1 and toxic[i] == 0) for i in range(600, 900))
    assert wrong <= 9


def test_site_posteriors_equal_plain_python(spark):
    """Hosts and paths of unlike sizes and rates, nulls and repeats among them."""
    rnd = random.Random(12)
    rows = []
    for h in range(9):
        for p in range(1 + h % 3):
            lean = rnd.gauss(0, 2)
            rows += [(f"h{h}" if h else "", f"p{p}", int(1e6 * rnd.gauss(lean, 1)), int(1e6 * rnd.gauss(-lean, 2))) for _ in range(rnd.choice([1, 3, 40]))]
    shifts, total = classifier.site_shifts(spark.createDataFrame(rows, "_host string, _path string, _good long, _toxic long"))
    got = {(r._host, r._path): (r.n, r._good_shift, r._toxic_shift) for r in shifts.collect()}
    assert total == len(rows) and set(got) == {r[:2] for r in rows}
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for k in (2, 3):
        chance = [1 / (1 + math.exp(-r[k] / 1e6)) for r in rows]
        mean = sum(chance) / len(rows)
        hosts, paths = defaultdict(list), defaultdict(list)
        for r, c in zip(rows, chance, strict=True):
            hosts[r[0]].append(c)
            paths[r[:2]].append(c)
        rate = {h: sum(c) / len(c) for h, c in hosts.items()}
        among = sum(len(c) * (rate[h] - mean) ** 2 for h, c in hosts.items()) / len(rows)
        within = sum(len(c) * (sum(c) / len(c) - rate[p[0]]) ** 2 for p, c in paths.items()) / len(rows)
        spread = sum(len(c) * rate[h] * (1 - rate[h]) for h, c in hosts.items()) / len(rows)
        host_size, path_size = mean * (1 - mean) / among - 1, spread / within - 1
        assert 1 < host_size < 1e4 and 1 < path_size < 1e4  # so that neither bound acts
        for p, c in paths.items():
            host = (sum(hosts[p[0]]) + host_size * mean) / (len(hosts[p[0]]) + host_size)
            post = (sum(c) + path_size * host) / (len(c) + path_size)
            assert got[p][0] == len(c) and got[p][k - 1] == pytest.approx(0.5 * (logit(post) - logit(mean)), abs=1e-3)
    assert classifier.concentration(0.2, 0.0) == 1e4 and classifier.concentration(0.2, 0.19) == 1.0
    empty, none = classifier.site_shifts(spark.createDataFrame([], "_host string, _path string, _good long, _toxic long"))
    assert none == 0 and empty.collect() == []


def test_classifier_odd_input(spark):
    texts = odd_texts()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.quality_classifier(frame(spark, texts), labels).collect()}
    assert all(got[i].kept == bool(WORD.search(t or "")) for i, t in enumerate(texts))
    assert classifier.quality_classifier(frame(spark, []), labels).collect() == []


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (500, [float("inf")] * 6), (None, [1.0] * 6), (600, [0.0] * 6), (700, []), (800, [2.0, 1.0]), (801, [2.0, 1.0]), (801, [2.0, 1.0])]
    rows += [(300, [9.0, -1.0]), (300, [9.0, -1.0]), (100, [1.0, 5.0, 2.0])]  # ids of several query rows
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, row int, floor int")
    got = defaultdict(list)
    for r in exact_topk.exact_topk(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == brute_topk(rows)


def clip(score):
    return min(max(score, -(1 << 63)), (1 << 63) - 1)


def brute_topk(rows, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for own, (i, q) in enumerate(fine):
        if i % 100 == 0:
            scored = sorted((-clip(sum(a * b for a, b in zip(q, v, strict=False))), j) for m, (j, v) in enumerate(fine) if m != own)[:k]
            out[i] = sorted(out.get(i, []) + [(n, -s, j) for n, (s, j) in enumerate(scored, 1)])
    return out


def test_topk_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATES", 37)
    monkeypatch.setattr(exact_topk, "QUERIES", 2)
    monkeypatch.setattr(exact_topk, "FEW", 100)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(0, 900, 2)] + [(1000, [1e300, 1.0, 0.0, 0.0])]
    got = defaultdict(list)
    for r in exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == brute_topk(rows)


@pytest.mark.parametrize(("decay", "most"), [(0.5, 0.25), (0.8, 0.8), (1.0, 1.0)])
def test_topk_reading_stops(decay, most):
    """Where few dimensions weigh most, the bound falls below the kth score long before all rows are scored; where all weigh alike it can't."""
    rng = np.random.default_rng(3)
    vectors = np.floor(1024 * rng.standard_normal((4000, 16)) * decay ** np.arange(16))
    lists = exact_topk.Lists(np.arange(4000), np.arange(4000), vectors)
    for own in range(20):
        found = lists.top(vectors[own], own, 10)
        scores = vectors @ vectors[own]
        wanted = sorted(((-int(s), i) for i, s in enumerate(scores) if i != own))[:10]
        assert found == [(-s, i) for s, i in wanted]
    assert lists.scored <= most * 20 * 4000


def test_topk_empty(spark):
    assert exact_topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_lm_keys_take_little_more_than_their_information():
    rng = np.random.default_rng(0)
    for n, shift in ((0, 0), (1, 0), (2, 60), (31, 0), (500, 12), (30_000, 7), (5000, 44)):
        for odd in (0, 1):
            keys = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True) >> np.uint64(shift) | np.uint64(odd))
            assert (lm_scoring._unpacked(lm_scoring._packed(keys)) == keys).all()
    assert (lm_scoring._unpacked(lm_scoring._packed(np.array([1, 2**64 - 1], np.uint64))) == np.array([1, 2**64 - 1], np.uint64)).all()
    # a block's three million keys over 100 parts: each part's share in under 45 bits a key
    keys = np.unique(rng.integers(0, 2**64 - 1, 3_000_000, np.uint64) | np.uint64(1))
    same, _, parts = lm_scoring._distinct([keys], 100)
    assert sum(len(lm_scoring._packed(same[p])) for p in parts) < len(keys) * 45 / 8


def test_lm_texts_travel_compressed(spark):
    docs = spark.range(2000).selectExpr("id doc_id", "repeat(concat('some words of a text ', id, ' '), 20) text")
    sizes = docs.repartition(2).mapInArrow(lm_scoring._pieces(7, 20_000), "block int, data binary").selectExpr("block", "length(data) n").collect()
    assert {r.block for r in sizes} == set(range(7)) and sum(r.n for r in sizes) < 200_000
