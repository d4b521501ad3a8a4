"""Prefix trie, centroid clustering and quality rules against brute force, with nulls, ties, repeated rows, long rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import clusters, rules, trie

TURNS = "conv_id long, turn long, role string, text string, key string, shard int, kind int, n long"


def brute_trie(rows):
    """Nodes of rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) if below else 1
        saved[path] = sum(saved[k] for k in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(path)))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(rng):
    rows = []
    for c in [*range(0, 230), 1000, 1001, 1099, -5, -100, -101, 2**40]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, rng.choice(["user", "assistant"]), f"say {rng.integers(3)} é" if turn < 3 else f"{c} {turn}"))
    for c in range(300, 380):  # a hot group of copies, and a hot first turn
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    for c in range(400, 404):  # long ones that part late, or end inside another
        rows += [(c, t, "user", f"long {t}" if t < 180 or c < 402 else f"{c} {t}") for t in range(200 - c % 3 * 10)]
    rows += [(500, None, "user", "first"), (500, None, None, "first"), (500, 3, "user", None), (500, 3, "user", None), (500, 3, "a", "b"), (None, 1, "user", "lost"), (501, 0, "user", "x" * 100_000)]
    return rows


@pytest.mark.parametrize(("shards", "fan"), [(1, 64), (7, 2), (60, 3)])
def test_trie_against_brute_force(spark, shards, fan):
    rows = talk(np.random.default_rng(31))
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], TURNS)
    got = trie.trie(trie.rebuilt(df), shards, fan).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark, tmp_path):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)  # conversation 0 is absent, and its own first turns go
    assert [tuple(r) for r in trie.trie(trie.rebuilt(spark.createDataFrame([(c, 0, "user", "a", "k", 1, 2, 3)], TURNS))).collect()] == brute_trie([(c, 0, "user", "a")])
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op12_prefix_trie(spark, str(tmp_path)).collect() == []


def test_matrix_order_goes_on_in_later_columns():
    rng = np.random.default_rng(32)
    rows = [rng.integers(0, 2, int(n)) for n in rng.integers(0, 5, 60)]
    stem = rng.integers(0, 9, 3 * trie.BLOCK)
    rows += [np.r_[stem[:k], rng.integers(0, 2, 3)] for k in (0, 63, 64, 65, 128, 190, 190, 192)] + [stem, stem, stem[:64]]
    length = np.array([len(r) for r in rows])
    order, common = trie.ordered(np.concatenate(rows), np.cumsum(length) - length, length, np.arange(len(rows)))
    want = sorted(range(len(rows)), key=lambda i: (rows[i].tolist(), i))
    assert order.tolist() == want
    for i in range(1, len(rows)):
        a, b = rows[want[i - 1]].tolist(), rows[want[i]].tolist()
        assert common[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


VECTORS = "vec_id long, embedding array<double>, id long, q int, cluster int, distance string"


def brute_clusters(rows):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [q for _, _, q in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q, q) for i, q in kept)[:16]]

    def near(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(3):
        at = [near(q)[0] for _, q in kept]
        for k in range(len(centroids)):
            own = [q for (_, q), a in zip(kept, at, strict=True) if a == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    final = [(i, *near(q)) for i, q in kept]
    total = sum(d for *_, d in final)
    return sorted(((i, k, d, sum(e for _, j, e in final if j == k), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in final), key=repr)


def vectors(rng, n):
    centres = rng.normal(size=(9, 64))
    rows = [(i, [float(x) for x in centres[i % 9] + 0.3 * rng.normal(size=64)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a hot vector
    rows += [(n + 50 + i, [0.5 if j == i % 3 else 0.0 for j in range(64)]) for i in range(12)]  # ties
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [math.inf] * 64]
    return rows + [(900 + k, v) for k, v in enumerate(odd)] + [(None, [-0.01] * 64), (3, rows[5][1]), (3, rows[5][1]), (950, [-30000.0] * 64), (951, [0.0] * 64)]


@pytest.mark.parametrize("n", [150, 3])
def test_clusters_against_brute_force(spark, tmp_path, n):
    rows = vectors(np.random.default_rng(33), n) if n > 3 else [(i, [float(i)] * 64) for i in range(n)]
    spark.createDataFrame([(i, v, 1, 2, 3, "d") for i, v in rows], VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clusters.op13_rotated_clusters(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_clusters(rows)


def test_clusters_measure_few_centroids_of_clustered_vectors(spark):
    rng = np.random.default_rng(34)
    centres = rng.normal(size=(16, 64))
    df = spark.createDataFrame([(i, [float(x) for x in centres[i % 16] + 0.05 * rng.normal(size=64)]) for i in range(800)], "vec_id long, embedding array<double>")
    rows, _ = clusters.cluster(df)
    assert rows.agg(F.avg("n_measured")).first()[0] < 4


def test_clusters_of_nothing_and_of_too_much(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert clusters.op13_rotated_clusters(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))[0].collect()


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def written(rng, i):
    words = [str(w) for w in rng.choice(["tion", "the", "wh", "ou", "été", "naïve", "漢字", "or", "and", "in"], int(rng.integers(20, 90)))]
    return " ".join(words) if i % 4 else " ".join(w.upper() + rng.choice(["###", "&&&", "!!"]) for w in words)


def test_rules_counts_and_scores_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(35)
    texts = [written(rng, i) for i in range(240)]
    odd = [None, "", " \n\t", "a b", "x\ny\n x\nx\n\n \n \nx", "# * $ % & | < >" * 9, "one two " * 40, "w " * 7, "w " * 8, "w " * 9, " ".join(map(str, range(50))) + "\x0b" + " ".join(map(str, range(8))), "é\x1c漢" * 30, "y" * 3_000_000, written(rng, 1) * 9000]
    rows = [*enumerate([*texts, *odd]), (None, texts[1]), (1, texts[1])]
    schema = "doc_id long, text string, kept string, score string, n_words string, _judged int, id int"
    spark.createDataFrame([(*r, "k", "s", "n", 1, 2) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 4 > 0)) for i in range(240)] + [(7, None), (8, 9), (None, 1)]
    spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    got = rules.op11_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {i: brute_counts(t) for i, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert r.kept == (not r.base_failed and r.score >= rules.KEEP_SCORE) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240 and not r.base_failed]
    assert len(held) > 20 and np.mean([r.kept == (r.doc_id % 4 > 0) for r in held]) > 0.97

    # the same model, from features counted one by one, and a plain solver
    import xxhash

    def features(text):
        b, out = text.encode(), np.zeros(rules.DIMS)
        kinds = [[x for x in b]]
        for n, bits, begin in zip((2, 3, 4), rules.BITS, rules.BEGINS[1:], strict=False):
            kinds.append([begin + (int.from_bytes(b[i : i + n], "big") * 0x9E3779B1 % 2**32 >> (32 - bits)) for i in range(len(b) - n + 1)])
        h = [xxhash.xxh64_intdigest(w) for w in b.split()]
        kinds.append([rules.BEGINS[4] + (x >> (64 - rules.BITS[3])) for x in h])
        kinds.append([rules.BEGINS[5] + ((x * 3 + y) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - rules.BITS[4])) for x, y in zip(h[:-1], h[1:], strict=True)])
        for places in kinds:
            for p in places:
                out[p] += 1 / len(places)
        return out

    train = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5]
    x = np.array([features(texts[i]) for i in range(240)])
    y = np.array([i % 4 > 0 for i in train])
    model = rules.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    m = x[train] @ model.weights + model.bias
    each = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    r = each * (1 / (1 + np.exp(-m)) - y)
    gradient = x[train].T @ r + rules.PENALTY * model.weights
    assert np.abs(gradient).max() < 2e-4 and abs(r.sum()) < 2e-4  # the optimum, but for half-precision shares
    scores = {row.doc_id: row.score for row in got if row.doc_id is not None}
    assert all(scores[i] == pytest.approx(float(model.score(x[i] @ model.weights + model.bias)), abs=1e-9) for i in range(240))


def test_rules_never_see_held_out_labels_and_keep_columns(spark):
    rng = np.random.default_rng(36)
    df = spark.createDataFrame([(i, written(rng, i), "kept") for i in range(160)], "doc_id long, text string, kept string")
    good = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(160)], "doc_id long, quality int")
    swapped = good.withColumn("quality", F.when(rules.crc_mod(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = rules.train(df, good), rules.train(df, swapped)
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)
    kept = rules.keep_good(df, good)
    assert kept.columns == df.columns and {r.doc_id % 4 for r in kept.collect()} == {1, 2, 3}


def test_rules_of_empty_tables_and_one_class(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert rules.op11_quality_rules(spark, str(tmp_path)).collect() == []
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = rules.train(df, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert {r.score for r in rules.judge(df, model, ["doc_id"]).collect()} <= {0.5, 2 / 3, 0.75}


def test_packed_shares_both_ways():
    rng = np.random.default_rng(37)
    for text in (b"", b"a", "é ü ".encode() * 5, rng.integers(33, 120, 400_000).astype(np.uint8).tobytes()):
        hashes = rules.WordHashes().of(text.split())
        data = rules.shares(text, hashes)
        at, x = rules.unpacked(data)
        assert len(data) <= 2 * rules.DIMS + 1 and (not text or x.sum() == pytest.approx(sum(1 for n in (len(text), len(text) - 1, len(text) - 2, len(text) - 3, len(hashes), len(hashes) - 1) if n > 0), rel=0.02))
        assert len(set(at.tolist())) == len(at)
