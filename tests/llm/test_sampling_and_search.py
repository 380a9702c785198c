"""Order MinHash, importance resampling and ranked lexical search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import lexical, order_minhash, resampling, terms

SCHEMA = "doc_id long, text string, source string, range int, score long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return TERM.findall(lower(text or ""))


def odd_texts():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)] + ["the", "The", "of", "Été", "中文", "don't", "x" * 70, "ß"]
    texts = [None, "", " \t\n", "one", "ONE!", "a-b_c", "é", "{~}", "\x7f", "a b", "z" * 3000]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 200))) for _ in range(40)]
    texts += texts[11:14] + [texts[12] + " tail", texts[13].upper(), "word " * 5000]
    return texts


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


# terms


def test_terms_and_checksums():
    texts = odd_texts()
    found = terms.Terms(pa.array(texts))
    spans = [found.bytes[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
    assert spans == [w.encode() for t in texts for w in words(t)]
    assert found.row.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    single = terms.crc32(found.bytes, found.starts, found.ends)
    assert single.tolist() == [zlib.crc32(s) for s in spans]
    row, pair = terms.bigram_crc32(found, single)
    wanted = [(i, zlib.crc32(f"{a} {b}".encode())) for i, t in enumerate(texts) for a, b in zip(words(t), words(t)[1:], strict=False)]
    assert list(zip(row.tolist(), pair.tolist(), strict=True)) == wanted


# importance resampling


def plain_resample(docs, target, percent=25, seed=7, least=20):
    def features(text):
        w = words(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def counted(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t))

    s, t = counted(x for _, x in docs), counted(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        own = [gain[zlib.crc32(f.encode()) % 10000] for f in features(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = may[: len(may) * percent // 100]
    return rows, [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize("percent", [25, 100])
def test_resampling_equals_plain_python(spark, percent):
    docs = list(enumerate(odd_texts()))
    target = ["w1 w2 the of w3", None, "", "w5 " * 30]
    rows, drawn = plain_resample(docs, target, percent)
    got = resampling.resample(frame(spark, docs), frame(spark, list(enumerate(target))), percent=percent).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == drawn


def test_resampling_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(None, text), (None, text), (4, text), (4, text), (4, text + " more"), (5, None)]
    rows, drawn = plain_resample(docs, [], 60)
    got = resampling.resample(frame(spark, docs), frame(spark, []), percent=60).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [r.score for r in ranked] == [s for _, s in drawn]
    assert resampling.resample(frame(spark, []), frame(spark, [(1, text)])).collect() == []


# ranked lexical search


def plain_search(docs, items, k=10):
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs if i is not None]
    n_docs, n_terms = sum(1 for d in counted if d[2]), sum(d[2] for d in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        asked = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in set(words(text)) if df[w]}
        found = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // max(n_terms, 1)
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked.items() if c[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("most", "query_bytes"), [(128, 1 << 20), (4, 200)])
def test_lexical_search_equals_plain_python(spark, monkeypatch, most, query_bytes):
    monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)
    docs = [*enumerate(odd_texts()), (None, "w1 w2 w3"), (3, "one w1"), (3, "one w1")]
    items = [(0, "w1 w2 w3 the"), (1, None), (2, ""), (3, "nothing known"), (4, "ÉTÉ été one ONE"), (5, docs[15][1]), (0, "w7")]
    got = lexical.ranked_search(frame(spark, docs), frame(spark, items), id_col="doc_id", item_col="doc_id", most=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items)


def test_lexical_search_empty(spark):
    one = [(1, "some words")]
    for docs, items in (([], one), (one, []), ([], [])):
        assert lexical.ranked_search(frame(spark, docs), frame(spark, items), item_col="doc_id").collect() == []


def shuffled_topics(n_topics=8, per_topic=100):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice([f"t{topic}v{i}" for i in range(40)] + ["the", "of"]) for _ in range(60)) for topic in range(n_topics) for _ in range(per_topic)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [texts[i] for i in order], [i // per_topic for i in order]


def test_bisection_gathers_like_documents():
    texts, topics = shuffled_topics()
    every = lexical.Postings.of(pa.array(texts))
    runs = lexical.bisected(every.docs, every.terms, len(texts), 100)
    assert sorted(np.concatenate(runs).tolist()) == list(range(len(texts))) and max(map(len, runs)) <= 100
    pure = sum(Counter(topics[i] for i in run.tolist()).most_common(1)[0][1] for run in runs)
    assert pure >= 0.9 * len(texts)


def test_search_stops_before_it_has_visited_every_cluster():
    texts, _ = shuffled_topics()
    measured = terms.Terms(pa.array(texts))
    n_docs, n_terms = len(texts), int(measured.counts.sum())
    names = [f.split()[0] for f in lexical.INDEX.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in lexical.clusters(np.arange(n_docs), pa.array(texts), n_docs, n_terms, 50)]
    items = [f"t{i % 8}v{i} t{i % 8}v{i + 7} the" for i in range(16)]
    block = lexical.Block.of(items)
    df = sum(lexical.Cluster(r, block).sizes() for r in rows)
    block.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()])
    visitor = lexical.Visitor(block, n_docs, n_terms, 10, None)
    visitor.batch(rows)
    wanted = plain_search(list(enumerate(texts)), list(enumerate(items)))
    got = sorted((q, rank, i, -s) for q, own in enumerate(visitor.best) for rank, (s, i) in enumerate(own, 1))
    assert got == wanted
    assert visitor.met == 16 * len(rows) and visitor.visited < 0.4 * visitor.met


# order MinHash


def plain_mix(x):
    mask = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ (x >> 31)


def plain_sketches(text, k, sketches, size):
    """The method, one k-mer at a time."""
    mask, place = (1 << 64) - 1, [plain_mix(i) | 1 for i in range(1, 513)]
    k = min(k, len(text))
    if not k:
        return ""
    kmers, numbered, seen = [], [], Counter()
    for i in range(len(text) - k + 1):
        gram = text[i : i + k]
        h = plain_mix(sum(plain_mix(ord(c) + 1) * place[-3] ** (k - 1 - j) for j, c in enumerate(gram)) & mask)
        kmers.append(h)
        numbered.append(((h + seen[gram] * place[-1]) * place[-2] & mask) >> 32)
        seen[gram] += 1
    family = [plain_mix(i * 0x9E3779B97F4A7C15 & mask) >> 32 | 1 for i in range(1, sketches + 1)]
    out = ""
    for j in range(sketches):
        hashed = [v * family[j] & 0xFFFFFFFF for v in numbered]
        chosen = sorted(sorted(range(len(kmers)), key=lambda i: (hashed[i], i))[:size])
        total = sum(kmers[i] * place[n] for n, i in enumerate(chosen)) + place[len(chosen)]
        out += f"{plain_mix(total & mask) >> 32:08x}"
    return out


def plain_likeness(a, b):
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    return sum(x == y for x, y in pairs) / len(pairs) if a and b else float(len(a) == len(b))


def plain_neighbours(docs, **how):
    ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, following = text or "", following or ""
        quarter = len(text) // 4
        other = text[: len(text) - quarter] + following[:quarter]
        a, b, c = (plain_sketches(t, **how) for t in (text, other, following))
        out.append((i, len(text), hashlib.sha256(other.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    return out


@pytest.mark.parametrize("ranges", [1, 7])
def test_order_minhash_equals_plain_python(spark, monkeypatch, ranges):
    monkeypatch.setattr(order_minhash, "sized", lambda spark: ranges)
    how = {"k": 5, "sketches": 6, "size": 3}
    texts = [t[:400] if t else t for t in odd_texts()] + ["😀é" * 9, "abc", "abcab", "aaaaaaaaaa"]
    docs = [(3 * i - 40, t) for i, t in enumerate(texts)] + [(None, "none"), (None, "none"), (None, "a"), (-7, "tied"), (-7, "Tied"), (-7, "tied"), (200, "z" * 30)]
    got = order_minhash.edited_fingerprints(frame(spark, docs), **how).collect()
    assert Counter(map(tuple, got)) == Counter(plain_neighbours(docs, **how))


@pytest.mark.parametrize("docs", [[], [(7, None)], [(7, "a single text of some length")], [(1, "same"), (1, "same"), (1, "same")]])
def test_order_minhash_few_rows(spark, docs):
    how = {"k": order_minhash.K, "sketches": order_minhash.SKETCHES, "size": order_minhash.SIZE}
    got = order_minhash.edited_fingerprints(frame(spark, docs)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_neighbours(docs, **how))


def test_order_minhash_cuts_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "sized", lambda spark: 8)
    monkeypatch.setattr(order_minhash, "SAMPLED", 1000)
    docs = [(5 if i % 3 else i, f"text number {i}") for i in range(600)]
    ordered = order_minhash.in_order(frame(spark, docs), "doc_id", "text").filter("not last").withColumn("part", F.spark_partition_id())
    most = max(r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    assert most <= 300


def test_sketches_of_many_blocks(monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 7)
    for k, size in ((1, 1), (4, 2), (11, 3)):
        sketch = order_minhash.OrderMinHash(k, 5, size)
        for text in ["", "ab", "abcabcabc" * 9, "éü😀" * 30, "the quick brown fox jumps over the lazy dog " * 3]:
            assert order_minhash.as_hex(sketch(order_minhash.code_points(text))) == plain_sketches(text, k, 5, size)


def test_likeness_follows_edits_and_order(spark):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400))
    other = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400))

    def changed(share):
        return "".join(rnd.choice("klmn") if rnd.random() < share else c for c in text)

    half = len(text) // 2
    sketch = order_minhash.OrderMinHash(sketches=256)
    own = sketch(order_minhash.code_points(text))
    like = {name: order_minhash.alike(own, sketch(order_minhash.code_points(t))) for name, t in {"same": text, "few": changed(0.01), "some": changed(0.05), "many": changed(0.2), "moved": text[half:] + text[:half], "other": other}.items()}
    assert like["same"] == 1 and like["same"] > like["few"] > like["some"] > like["many"] >= like["other"]
    assert like["moved"] < 0.75  # the same k-mers but for a few
    rows = spark.createDataFrame([(0, text), (1, other), (2, text), (3, ""), (4, None)], "doc_id long, text string")
    found = order_minhash.fingerprints(rows)
    pairs = found.alias("a").join(found.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select("a.doc_id", F.col("b.doc_id").alias("of"), order_minhash.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("like"))
    got = {(r["doc_id"], r["of"]): r["like"] for r in pairs.collect()}
    assert got[0, 2] == got[3, 4] == got[1, 1] == 1 and got[0, 3] == 0 and got[0, 1] < 0.1
