"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import decontaminate, jaccard, langid, lm, media, mixing, pii, quality, sharding, tokencount

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table, with null, empty, blank, very long, tied and repeated rows and columns whose names clash."""
    long = "alpha beta gamma delta " * 20_000
    rows = [
        (10**6, None, None, None, None), (10**6 + 1, "", "en", "a", 0), (10**6 + 2, " \n\t ", "en", "a", 4), (10**6 + 3, "ÉCOLE 中文 😀 a@b.co", "fr", "a", 1), (10**6 + 4, long, "en", "b", 1),
        (10**6 + 5, "same row here again and again", "en", "b", 1), (10**6 + 5, "same row here again and again", "en", "b", 1), (None, "a text without an id", "en", None, 1),
    ]
    extra = spark.createDataFrame(rows, SCHEMA)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").union(extra)
    return d.withColumn("k", F.lit(1)).withColumn("h", F.lit(2)).withColumn("n_words", F.lit(3)).withColumn("shard", F.lit("x")).withColumn("score", F.lit(4)).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def by_key(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def residue(i, n):
    return zlib.crc32(b"" if i is None else str(i).encode()) % n


# --- op 1


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_pii(t):
    found = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15):
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_pii_base_spans(spark, docs, rows):
    rng = random.Random(7)
    parts = [*"ab.@-+_% 0123456789()", "😀", "é", "a@b.c", "@b.c.d", "127.0.0.1", ".1.2", "4539 1488 0343 6467", "+1 (555) 123-4567", "000300", "\n"]
    made = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(2000)] + [(-1, "a@b.c " * 2000)]
    for frame, pairs in ((docs, rows), (spark.createDataFrame(made, "doc_id long, text string"), made)):
        got = by_key(pii.pii_digest(frame))
        assert sum(map(len, got.values())) == len(pairs)
        for i, t in pairs:
            spans = brute_pii(t or "")
            for r in got[i]:
                assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, t)
                assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone")]


def test_pii_checksums_context_and_redaction(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB83 WEST 1234 5698 7654 32", "no 123-45-6789", "my ssn 123-45-6789", "mail a@b.co, or 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find_pii(df).collect()}
    assert found == {0: [("iban", 5, 32)], 1: [], 2: [], 3: [("ssn", 7, 18)], 4: [("email", 5, 11), ("ip", 16, 24)]}
    assert {r.doc_id: r.redacted for r in pii.redact(df).collect()}[4] == "mail <EMAIL>, or <IP>"


# --- op 2


def test_language(docs):
    got = by_key(langid.language_digest(docs))
    assert sum(map(len, got.values())) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for i in (10**6, 10**6 + 1, 10**6 + 2) for r in got[i])
    held = [(r, x.lang) for x in docs.filter("doc_id < 1000000").collect() for r in got[x.doc_id] if r.held_out]
    assert all(r.held_out == (residue(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.95 * len(held) > 0


def test_language_groups_do_not_matter():
    texts = ["the cat", "", "été à la plage", "x", "中文字 english"]
    p = langid.Profiles({"a": np.arange(langid.DIMENSIONS) % 7 - 3.0, "b": np.arange(langid.DIMENSIONS) % 5 - 2.0})
    one = [p.predict([t]) for t in texts]
    names, scores = p.predict(texts)
    assert names == [x[0][0] for x in one] and np.allclose(scores, [x[1][0] for x in one])
    assert langid.Profiles({}).predict(["a"])[0] == ["und"]


def test_long_training_text_counts_whole(spark):
    rng = random.Random(1)
    rare = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(140_000))
    kinds, counts, _ = langid.trigram_counts([rare])
    assert counts.max() < 30 and len(kinds) > 20_000
    whole = sum(langid.trigram_vectors(kinds[i : i + 5000]).astype(np.int64).T @ counts[0, i : i + 5000] for i in range(0, len(kinds), 5000))
    docs = spark.createDataFrame([(rare, "x"), ("other words", "y")], "text string, lang string")
    got = langid.learn_profiles(docs)
    one = langid.Profiles({"x": whole / counts.sum() * langid.LONGEST, "y": langid.bundles(*langid.trigram_counts(["other words"])[:2])[0].astype(float)})
    assert got.languages == ["x", "y"] and np.allclose(got.own, one.own, atol=1e-3)
    assert [x for g in langid.groups(["a" * 10] * 70 + ["b" * (1 << 21)] + ["c"]) for x in [g.stop - g.start]] == [64, 6, 1, 1]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LABELS", 2)
    docs = spark.createDataFrame([("some words", str(i)) for i in range(3)], "text string, lang string")
    with pytest.raises(ValueError):
        langid.learn_profiles(docs)


def test_selected_languages(docs):
    p = langid.learn_profiles(docs)
    clash = docs.withColumn("__language", F.lit("keep")).withColumn("__score", F.lit(7))
    kept = langid.select_languages(clash, p, ["fr"])
    assert kept.columns == clash.columns and {r["__language"] for r in kept.collect()} == {"keep"}
    assert langid.select_languages(docs, p, []).count() == 0 and langid.select_languages(docs, langid.Profiles({}), ["en"]).count() == 0


# --- op 3


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(pairs, items):
    grams = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(g) for g in grams}
    for i, t in pairs:
        w, hit, own = words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if g := grams.get(tuple(w[j : j + n])):
                    own |= g
                    hit |= set(range(j, j + n))
        yield i, (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    short = spark.createDataFrame([(900, "Same ROW here"), (901, None), (902, "!!!"), (903, "alpha, beta")], "item_id long, text string")
    for items in (bench, bench.union(short), short.limit(0)):
        got = by_key(decontaminate.contamination_digest(docs, items))
        for i, want in brute_hits(rows, [(r.item_id, r.text) for r in items.collect()]):
            assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want for r in got[i]), i
        assert sum(map(len, got.values())) == len(rows)
    kept = decontaminate.decontaminate(docs, bench.union(short))
    bad = {i for i, w in brute_hits(rows, [(r.item_id, r.text) for r in bench.union(short).collect()]) if w[4]}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad) and kept.columns == docs.columns


def test_span_removal(spark):
    d = spark.createDataFrame([(1, "Keep A B, C! keep"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, documents=False).collect()} == {1: "Keep  , ! keep", 2: None}
    assert [r.doc_id for r in decontaminate.decontaminate(d, b).collect()] == [2]
    long = "x " * 100 + "A b C."
    d = spark.createDataFrame([(1, long, 7), (2, "clean", 9)], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, decontaminate.decontaminate(d, b).collect())) == [(1, "x " * 100 + "  .", 203), (2, "clean", 9)]


# --- op 4


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        share = total / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        total -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, rows):
    got = mixing.mix_digest(docs)
    rows_ = got.collect()
    assert len(rows_) == len(rows) and sorted(map(tuple, rows_), key=str) == sorted(map(tuple, mixing.mix_digest(docs.repartition(5)).collect()), key=str)
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows_:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    want = brute_targets({s: sizes[s] for s in set(source.values())})
    for r in rows_:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert abs(taken[s] - r.target) <= largest[s]
    assert mixing.mix(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


# --- op 5


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = by_key(quality.quality_digest(docs, labels))
    assert sum(map(len, got.values())) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (residue(r.doc_id, 5) == 0) for rs in got.values() for r in rs)
    d = "/root/testdata/sf0.01"
    big, marks = spark.read.parquet(f"{d}/documents.parquet"), {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, marks[r.doc_id]) for r in quality.quality_digest(big, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.held_out and r.doc_id in marks]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0
    assert quality.quality_digest(docs.limit(0), labels).count() == 0 and quality.quality_digest(docs, labels.limit(0)).count() == docs.count()


def test_quality_with_clashing_columns(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clash = docs.select("*", *(F.lit(1).alias(n) for n in ("y", "r", "t", "__k", "features")))
    a, b = ({(r.doc_id, r.score) for r in quality.quality_digest(x, labels.withColumn("text", F.lit("no"))).collect()} for x in (docs, clash))
    assert a == b


def test_quality_against_brute_force_training():
    """Each tree's first cut is the best of all cuts by gain, computed without histograms."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(0, 3, 300) > 9).astype(float)
    trees = quality.train(x, y, trees=1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    g, h = y - share, np.full(len(y), share * (1 - share))
    score = lambda a, b: a**2 / (b + quality.RIDGE)
    best = max((score(g[l].sum(), h[l].sum()) + score(g[~l].sum(), h[~l].sum()), j, t) for j in range(4) for t in np.unique(x[:, j])[:-1] for l in [x[:, j] <= t] if min(h[l].sum(), h[~l].sum()) >= quality.LEAST_HESSIAN)  # noqa: E741
    assert (trees.feature[0][0], trees.threshold[0][0]) == best[1:]


def test_tree_walk_matches_a_plain_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    trees = quality.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10)
    for row, got in zip(x[:50], trees.score(x[:50])):
        raw = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            raw += leaf[node - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


# --- op 6


def brute_links(pairs):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * len(sets[a] | sets[b]) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_similarity_join(spark, docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    want = brute_links([r for r in rows if r[0] is not None])
    assert {i: v for i, v in got.items() if i is not None} == want and got[None][1] is None
    rng, voc, made = random.Random(3), [f"w{i}" for i in range(40)], []
    for _ in range(60):
        base = [rng.choice(voc) for _ in range(rng.choice([3, 5, 6, 9, 12, 20, 40, 80, 200]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [rng.choice(voc)] * rng.randint(0, 1)
                w = w or ["w"]
            made.append((len(made), " ".join(w)))
    passage = [f"p{j}" for j in range(60)]  # shared by texts that aren't alike
    made += [(len(made) + k, " ".join(rng.sample(voc, 20) + passage + rng.sample(voc, 20))) for k in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    want = brute_links(made)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect()} == want
    assert sorted(r.doc_id for r in jaccard.keep_first(df).collect()) == sorted(i for i, v in want.items() if v[1] == i)


def test_repeated_rows_stay_once(docs):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1000005").count() == 1 and kept.filter("doc_id is null").count() == 1
    clash = docs.select("*", *(F.lit(1).alias(n) for n in ("__n", "__id", "__h", "__again", "__gone", "id", "u", "t")))
    assert jaccard.keep_first(clash).columns == clash.columns and jaccard.keep_first(clash).count() == kept.count()


def test_repeated_ids_with_different_texts(spark):
    words = [f"w{i}" for i in range(30)]
    near = [*words[:29], "x"]
    rows = [(1, " ".join(words)), (2, "a b c d e f"), (2, " ".join(near)), (3, "a b c d e f"), (4, "z y x w v u"), (4, "q r s t u v"), (4, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect())
    assert got == [(1, 26, 1), (2, 2, 2), (2, 26, 1), (3, 2, 2), (4, 2, 4), (4, 2, 4), (4, 2, 4)]
    assert sorted(map(tuple, jaccard.keep_first(df).collect())) == [(1, " ".join(words)), (2, "a b c d e f"), (4, "q r s t u v"), (4, "z y x w v u")]


@pytest.mark.parametrize("block, small", [(jaccard.BLOCK, jaccard.SMALL_BLOCK), (9, 3), (jaccard.BLOCK, 5)])
def test_pairs_of_a_crowded_run(spark, monkeypatch, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL_BLOCK", small)
    monkeypatch.setattr(jaccard, "BLOCKS", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 40)
    rng, sets = np.random.default_rng(2), []
    base = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in range(60, 120, 3)]
    for b in base:
        sets += [b, np.unique(np.append(b[rng.integers(1, 5) :], rng.integers(0, 2**64, 2, dtype=np.uint64)))]
    rows = [(k, i, i, len(s), jaccard.parity(s).tolist()) for k in (5, -7) for i, s in enumerate(sets) if k == 5 or i % 3]
    members = spark.createDataFrame(rows, "key long, u long, c long, n long, p array<long>").repartition(3)
    got = {tuple(r) for r in jaccard.crowded_pairs(members).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    assert want and want <= got and len(got) < len(sets) * 4
    same = members.withColumn("c", F.lit(1))
    assert jaccard.crowded_pairs(same).count() == 0


def test_unlike_sets_share_no_key():
    rng = np.random.default_rng(8)
    for n in [*range(1, 34), 40, 47, 48, 56, 60]:
        sets = rng.integers(0, 2**64, (20_000, n), dtype=np.uint64)
        keys = np.concatenate([jaccard.sketch_keys(np.sort(s)) for s in (sets if n < 20 else sets[:4000])])
        assert len(keys) - len(np.unique(keys)) <= 2, n


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 127, 128, 129, 500, 1025]:
        for _ in range(60 if n < 20 else 12):
            s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            d = len(s) // 9
            other = np.unique(np.append(np.delete(s, rng.choice(len(s), d, replace=False)), rng.integers(0, 2**64, rng.integers(0, d + 1), dtype=np.uint64)))
            common = len(np.intersect1d(s, other))
            if 100 * common >= 80 * (len(s) + len(other) - common) and not np.array_equal(s, other):
                assert len(np.intersect1d(jaccard.sketch_keys(s), jaccard.sketch_keys(other))), n
                assert np.bitwise_count((jaccard.parity(s) ^ jaccard.parity(other)).view(np.uint64)).sum() <= jaccard.differences(len(s), len(other))


# --- op 7


def test_sharding(docs, rows):
    got = sharding.shard_digest(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(i, 0) for i in range(24)) <= 1 and set(sizes) <= set(range(24))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_digest(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in got} == again
    assert sharding.external_shuffle(docs).columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]


def test_sharding_of_repeated_keys_and_clashing_columns(spark):
    rows = [(1, "same", i) for i in range(500)] + [(i, None, 0) for i in range(50)] + [(None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").select("*", *(F.lit(1).alias(c) for c in ("__bucket", "__order", "__task", "__at")), F.create_map(F.lit("k"), "n").alias("m"))
    kwargs = {"n_shards": 3, "bucket_bytes": 700, "max_tasks": 5}
    a, b = ({(r.doc_id, r.n, r.shard, r.slot) for r in sharding.external_shuffle(x, **kwargs).collect()} for x in (df, df.repartition(6, "n")))
    assert a == b and len(a) == len(rows)
    for shard in range(3):
        slots = sorted(x[3] for x in a if x[2] == shard)
        assert slots == list(range(len(slots)))


def test_written_shards(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sharding.write_shards(df, str(tmp_path / "s"), n_shards=4, file_rows=20)
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.external_shuffle(df, 4).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == want
    import pyarrow.parquet as pq

    for shard in range(4):
        slots = [x for f in sorted((tmp_path / "s" / f"shard={shard}").glob("*.parquet")) for x in pq.read_table(f)["slot"].to_pylist()]
        assert slots == list(range(50))


# --- op 8


@pytest.mark.parametrize("frequent", [lm.MAX_FREQUENT, 50])
def test_language_model(docs, rows, monkeypatch, frequent):
    monkeypatch.setattr(lm, "MAX_FREQUENT", frequent)
    got = by_key(lm.lm_digest(docs))
    counts = Counter()
    for i, t in rows:
        if residue(i, 10):
            counts.update(lm._tokens((t or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        w = lm._tokens((t or "").encode())
        base = sum(np.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in counts for x in w), total, residue(i, 10) == 0)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for rs in got.values() for r in rs if r.held_out and r.doc_id is not None and r.doc_id < 10**6]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def brute_score(model, counts, words):
    """The score of words by one token at a time, from the formulas of the model alone."""
    own = {w: i for i, w in enumerate(model.shape.vocabulary)}
    a, classes = {k: v.astype(float) for k, v in model.arrays.items()}, model.shape.classes
    output = lambda w: own.get(w, len(own) + zlib.crc32(w[-3:]) % model.shape.buckets)
    rest = {}
    for w, c in counts.items():
        if w not in own:
            n, k = rest.get(output(w), (0, 0))
            rest[output(w)] = n + c, k + 1
    total, before = 0.0, [output(lm.END_WORD)] * lm.CONTEXT
    for w in words:
        h = sum(a["place"][i] * a["context"][before[-1 - i]] for i in range(lm.CONTEXT))
        o = output(w)
        by_class = np.exp(a["class"] @ h + a["class_bias"][:, 0])
        inside = [j for j in range(len(classes)) if classes[j] == classes[o]]
        by_word = np.exp(a["word"][inside] @ h + a["word_bias"][inside, 0])
        p = by_class[classes[o]] / by_class.sum() * by_word[inside.index(o)] / by_word.sum()
        if w not in own:
            n, k = rest.get(o, (0, 0))
            p *= (counts[w] + 0.1) / (n + 0.1 * (k + 1))
        total += np.log10(p)
        before.append(o)
    return total


@pytest.mark.parametrize("frequent", [lm.MAX_FREQUENT, 30])
def test_score_of_a_small_model(spark, monkeypatch, frequent):
    for name, value in (("MAX_FREQUENT", frequent), ("VOCABULARY", 40), ("BUCKETS", 16), ("BLOCK_TOKENS", 2000), ("PART", 7), ("CACHED", 50)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(4)
    made = [" ".join(f"a{min(int(rng.expovariate(0.05)), 200)}" for _ in range(rng.randint(0, 60))) for _ in range(300)]
    train = spark.createDataFrame([(t.encode(),) for t in made], "t binary").repartition(4)
    counts = lm.count_words(train).cache()
    model = lm.learn(train, counts)
    assert 1 < len(model.shape.members) < len(model.shape.mass) == len(model.shape.vocabulary) + 16
    by_word = {bytes(w): c for w, c in counts.collect()}
    texts = [(i, t) for i, t in enumerate([*made[:20], "", "never seen", "a1 never a2 " * 5])]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), model, counts).collect()}
    for i, t in texts:
        assert got[i] == pytest.approx(brute_score(model, Counter(by_word), lm._tokens(t.encode())), rel=1e-4)
    # over all words of the corpus and an unseen one in each bucket, the probabilities after a context add up to 1
    endings, i = {}, 0
    while len(endings) < 16:
        w = b"z%d" % i
        endings.setdefault(lm._bucket(w, 16), w)
        i += 1
    every, before = [*by_word, *endings.values()], lm._tokens(b"a1 a3")[:2]
    start = brute_score(model, Counter(by_word), before)
    assert sum(10 ** (brute_score(model, Counter(by_word), [*before, w]) - start) for w in every) == pytest.approx(1, abs=1e-6)


def test_words_before_count(spark):
    rng = random.Random(4)
    pairs = [(f"c{i}", f"w{i}x{k}") for i in range(40) for k in range(30) for _ in range(20)]
    rng.shuffle(pairs)
    train = spark.createDataFrame([(" ".join(f"{a} {b}" for a, b in pairs[i : i + 50]).encode(),) for i in range(0, len(pairs), 50)], "t binary").coalesce(1)
    counts = lm.count_words(train).cache()
    texts = [(2 * i + x, " ".join(f"c{(i + 7 * x) % 40} w{i}x{k}" for k in range(30))) for i in range(40) for x in (0, 1)]
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), lm.learn(train, counts), counts).collect()}
    assert sum(got[2 * i] > got[2 * i + 1] + 30 * 0.1 for i in range(40)) >= 36


def test_blocks_are_averaged_by_their_meetings():
    shape = lm.Shape([lm.END_WORD, b"a", b"b"], np.array([5.0, 5, 3, *[0.1] * lm.BUCKETS]), "m")
    model = lm.start(shape)
    one, two = lm.Trainer(shape, model), lm.Trainer(shape, model)
    one.step(np.array([0] * lm.CONTEXT + [1, 1, 1, 0]), np.ones(4, bool))
    two.step(np.array([0] * lm.CONTEXT + [1, 2, 0]), np.ones(3, bool))
    sums = {}
    for t in (one, two):
        for p, x in t.learned():
            sums[p] = sums.get(p, 0) + np.frombuffer(x, np.float32).astype(float)
    got = lm.merged(shape, model, sums)
    assert np.allclose(got["context"][1], (one.model["context"][1] + two.model["context"][1]) / 2, atol=1e-5)
    assert np.allclose(got["context"][2], two.model["context"][2], atol=1e-5)  # only the second met it
    assert np.allclose(got["class"], (4 * one.model["class"] + 3 * two.model["class"]) / 7, atol=1e-5)


def test_bucket_is_the_same_in_sql(spark):
    words = [b"", b"a", b"ab", b"abc", b"abcd", "né中".encode(), lm.END_WORD]
    got = spark.createDataFrame([(w,) for w in words], "w binary").select(F.pmod(F.crc32(F.substring("w", -lm.ENDING, lm.ENDING)), F.lit(lm.BUCKETS))).collect()
    assert [r[0] for r in got] == [lm._bucket(w, lm.BUCKETS) for w in words]


# --- op 9


def test_token_counts(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(1)
    parts = [*"ab's tmdrvlle  '\n\r\t 12½²é中ñ", "<|endoftext|>", "'re", "'ll", "'s", "  ", "\n\n", "　", "\x85", "\x1c", "é", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000]
    own = tokencount.TokenCounter(path)
    assert own.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    made = ["".join(rng.choice(["a", "b", "ing", "th", "-", "=", "0", " ", "é", "\n"]) * rng.randint(1, 40) for _ in range(rng.randint(0, 12))) for _ in range(10_000)]
    assert own.counts(made).tolist() == [len(e.ids) for e in library.encode_batch(made, add_special_tokens=False)]
    tokencount_states, monkey = len(own.counter.states), pytest.MonkeyPatch()
    with monkey.context() as m:  # starting anew changes no result
        m.setattr(tokencount, "MAX_STATES", tokencount_states // 50)
        assert np.concatenate([own.counts(made[i : i + 200]) for i in range(0, 4000, 200)]).tolist() == own.counts(made[:4000]).tolist()
    got = by_key(tokencount.token_counts(docs, path))
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 1024) for r in got[i])


def test_cuts_do_not_depend_on_chunks():
    points = np.frombuffer(("it's  a\n\n test,  don't 12ab" * 30).encode("utf-32-le"), np.uint32)
    assert all(np.array_equal(tokencount.cuts(points, c), tokencount.cuts(points, 1 << 14)) for c in (1, 2, 3, 7, 64))


# --- op 10


def test_media_round_trip(docs, rows):
    got = by_key(media.media_digest(docs))
    for i, t in rows:
        b = (t or "").encode()
        payload = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        for r in got[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            stream = media.write_stream(payload)
            assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


def test_stream_made_by_hand():
    """The packets of a short payload, byte by byte, and its feature."""
    payload = b"A" * 64
    pat = bytes.fromhex("474000100000b00d0001c100000001f0002ab104b2")
    pmt = bytes.fromhex("475000100002b0120001c10000e100f00006e100f0004abd9a0b")
    pes = bytes.fromhex("000001bd0048848005" + "2100010001") + payload
    pcr = bytes.fromhex("000000007e00")
    head = bytes.fromhex("47410030") + bytes([183 - len(pes), 0x50]) + pcr
    media_packet = head + b"\xff" * (188 - len(head) - len(pes)) + pes
    stream = media.write_stream(payload)
    assert stream[:21] == pat and stream[188:193] == pmt[:5]
    for at, table in ((0, pat), (188, pmt)):
        size = 3 + (int.from_bytes(stream[at + 6 : at + 8], "big") & 0xFFF)
        section = stream[at + 5 : at + 5 + size]
        assert section[:-4] == table[5:-4] and media.section_crc(section) == 0 and set(stream[at + 5 + size : at + 188]) == {0xFF}
    assert stream[376:] == media_packet and len(stream) == 564
    got = media.read_stream(stream)
    assert (got.payload, got.pts, got.pcr, got.random_access, got.stream_type) == (payload, [0], [0], [0], 6)


def test_features_of_media(spark):
    df = spark.createDataFrame([(1, "x" * 9000), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.feature for r in media.media_digest(df).collect()}
    units, packets = 3, 2  # 9,024 bytes are three units; tables first
    for size, first in ((4096, True), (4096, False), (832, False)):
        body = size + 14 - (184 - 8 if first else 0)
        packets += bool(first) + -(-body // 184)
    assert got == {1: f"packets={packets};units={units};last_pts=7200;random_access=1;discontinuities=0", 2: "packets=3;units=1;last_pts=0;random_access=1;discontinuities=0"}


def test_repeated_packets_count_once():
    data = bytes(range(256)) * 40
    stream = media.write_stream(data)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    got = media.read_stream(b"".join(p for i, p in enumerate(packets) for _ in range(1 + (i % 3 == 0))))
    assert got.payload == data and not got.discontinuities and got.duplicates == len(packets[::3])


def test_transport_stream_faults():
    data = bytes(range(256)) * 200
    stream = media.write_stream(data)
    got = media.read_stream(stream)
    assert got.payload == data and not got.discontinuities and got.pts == [3600 * i for i in range(13)] and got.random_access == [0, 8]
    lost = stream[: 188 * 5] + stream[188 * 6 :]
    assert media.read_stream(lost).discontinuities == 1
    for bad in (stream[:-1], stream[188 * 2 :], b"\0" * 188, stream[:5] + b"\xff" + stream[6:]):
        with pytest.raises(media.StreamError):
            media.read_stream(bad)


# --- all


def test_empty_tables(docs):
    e = docs.limit(0)
    import public_tokenizers

    for f in (pii.pii_digest, langid.language_digest, mixing.mix_digest, jaccard.link_components, sharding.shard_digest, lm.lm_digest, media.media_digest, lambda d: tokencount.token_counts(d, public_tokenizers.path("byte_bpe_50k.json"))):
        assert f(e).count() == 0
