"""The operators of the llm subpackage against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import ann, bpe, common, exact_dedup, html_text, lm, mixing, near_dedup, pii, quality, substring_dedup
from phenogrid.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _own string, _gone long, _score double, row long, id string, node string, size int"
WORDS = [f"w{i}" for i in range(60)] + ["The", "the", "été", "naïve", "漢字", "1,000", "x!!"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def rows_of(texts, rng, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, None if k % 9 == 0 else "en", None if k % 11 == 3 else f"src{k % 4}", None, "a", 1, 0.5, 7, "z", None, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(0)
    base = [prose(rng, int(rng.integers(1, 200))) for _ in range(60)]
    out = list(base)
    out += [base[0], base[0], base[1].replace(" ", "\n \t"), " " + base[2]]  # copies, with other white space
    for k in range(12):  # near copies of one text
        words = base[5 + k // 6].split()
        for _ in range(max(1, len(words) // 60)):
            words[int(rng.integers(len(words)))] = "changed%d" % k
        out.append(" ".join(words))
    passage = prose(rng, 70)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(5)]
    out += [None, "", "   ", "one", "a b c d", "Und " * 200, prose(rng, 6000), "z" * 20000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rng = np.random.default_rng(1)
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows_of(texts, rng), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(t is not None and "!!" not in t), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(labels + labels[:3] + [(5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_empty_tables(spark, empty):
    from phenogrid.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, empty).collect() == [], name


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(spark, docs, texts):
    got = {r.doc_id: r for r in exact_dedup.op3_exact_dedup(spark, docs).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (ids[0], len(ids), i == ids[0], hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_null_and_repeated_ids(spark):
    rows = rows_of(["a", "a", "a", "b", "b", "b"], None, [None, 3, 3, None, None, 9])
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.id if r.id is not None else -1, r.kept) for r in got if r.keep_id == 3) == [(-1, False), (3, False), (3, True)]
    assert sum(r.kept for r in got) == 2
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == ["a", "b"]


def test_many_runs_merge_in_rounds(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 700).cast("string").alias("text")).repartition(40)
    rows = common.materialise(exact_dedup.digests(df), "digests")
    got = exact_dedup.merge_runs(rows, fan_in=2).collect()
    assert sorted(r.id for r in got) == list(range(700)) and sum(r.n for r in got) == 3000


def brute_classes(texts, threshold=0.8, weighted=True):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
        sets.append(Counter(found if weighted else set(found)))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and (sets[i] & sets[j]).total() / (sets[i] | sets[j]).total() >= threshold:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_dedup_matches_all_pairs(spark, docs, texts):
    got = {r.doc_id: r.class_id for r in near_dedup.op7_dart_minhash(spark, docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = near_dedup.keep_one(spark.read.parquet(f"{docs}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(texts)))
    sets = {r.id: r.class_id for r in near_dedup.classes(spark.read.parquet(f"{docs}/documents.parquet"), weighted=False).collect()}
    assert [sets[i] for i in range(len(texts))] == brute_classes(texts, weighted=False)


def test_a_chain_of_near_copies_is_one_class(spark):
    rng = np.random.default_rng(3)
    words = list(rng.choice(WORDS, 150))
    chain = []
    for k in range(40):  # neighbours are similar, the ends are not
        chain.append(" ".join(words))
        words[(k * 7) % 150] = f"new{k}"
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.classes(df).collect()}
    assert [got[i] for i in range(40)] == brute_classes(chain)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    x = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    u, v = rng.uniform(0.2, 4, 400), rng.uniform(0.2, 4, 400)
    s = near_dedup.dart_signatures([x, x], [u, v], k=4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 0.03


def test_near_dedup_null_and_repeated_ids(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, words), (4, words), (4, "other " + words), (2, words + " x"), (7, None), (7, "a b c d e f g"), (None, None)]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.class_id) for r in got if r.id is not None) == [(2, 2), (4, 2), (4, 2), (7, 7), (7, 7)]
    assert [r.class_id for r in got if r.id is None] == [None, None]


def test_near_dedup_weights_count(spark):
    """How often a shingle stands matters: equal sets, unlike weights."""
    few, many = "u " * 6, "u " * 4000
    a = " ".join(f"a{i}" for i in range(60))
    made = [few, many, "u " * 3900, f"{a} {a} {a} {a} {a}", f"{a} {a} {a} {a} {a} {a}", a]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r.id: r.class_id for r in near_dedup.classes(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r.id: r.class_id for r in near_dedup.classes(df, weighted=False).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_common_counts():
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 500, 80)).astype(np.uint64) for _ in range(n)] for n in (4, 6))
    got = near_dedup.common_counts(a, b, columns=64)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (100, 102), (103, 102)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r.node[0]: r.label[0] for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100, 103: 100}


def brute_repeats(texts):
    first, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in enumerate(texts)}
    for i, w in words.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_repeats_match_all_windows(spark, docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op4_debruijn_repeats(spark, docs).collect()}
    assert got == brute_repeats(texts)


def test_repeats_of_random_splices(spark):
    rng = np.random.default_rng(6)
    pieces = [list(rng.choice(WORDS[:12], int(rng.integers(45, 120)))) for _ in range(6)]
    made = []
    for _ in range(120):
        w = []
        for _ in range(int(rng.integers(0, 4))):
            p = list(pieces[int(rng.integers(6))][int(rng.integers(0, 10)) :])
            if rng.random() < 0.4:
                p[int(rng.integers(len(p)))] = "cut"
            w += p + ["rep"] * int(rng.integers(0, 80) * (rng.random() < 0.3))
        made.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(made)


def test_null_ids_neither_give_nor_lose_words(spark):
    p = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(None, p), (None, p), (4, p), (5, p)], "doc_id long, text string")
    got = sorted(((r.id or 0), r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(0, 0), (0, 0), (4, 0), (5, 60)]


def test_bpe_equals_the_library(spark, docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in bpe.op10_byte_bpe(spark, docs).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_does_not_depend_on_what_is_shared(spark):
    """Null ids, repeated rows, an empty and a very long piece; no, few or all pieces shared."""
    import public_tokenizers as P

    rng = np.random.default_rng(22)
    made = [" ".join("".join(rng.choice(list("abcdeéß漢"), int(rng.integers(3, 14)))) for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(made), (None, made[0]), (3, made[3]), (40, ""), (41, None), (42, "q" * 30000)], "doc_id long, text string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    runs = [sorted(((r.id is None, r.id or 0), list(r.ids)) for r in bpe.encode(df, path, P.PATTERN, shared_pieces=n).collect()) for n in (0, 60, 1 << 18)]
    assert runs[0] == runs[1] == runs[2]
    v = bpe.vocabulary(path, P.PATTERN)
    assert bpe.decode(dict(runs[0])[(False, 42)], v) == b"q" * 30000 and dict(runs[0])[(False, 41)] == []


def test_replay_equals_encoding_alone():
    import public_tokenizers as P

    v = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(7)
    pieces = list({bytes(rng.choice(list(b"abeth ing\xc3\xa9"), int(rng.integers(1, 30))).tolist()) for _ in range(400)})
    whole = [[v.ranks[p]] if p in v.ranks else bpe.encode_alone(p, v) for p in pieces]
    assert bpe.replay(pieces, v) == whole


def test_bpe_of_texts_cut_at_spaces_equals_the_library():
    """White space of all kinds, at ends too; words come back in later batches, where they stand otherwise."""
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    v, plain = bpe.vocabulary(path, P.PATTERN), bpe.Vocabulary(bpe.load_ranks(path), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert v.spaced
    plain.spaced = False  # as of any other pattern
    rng = np.random.default_rng(23)
    bits = np.array([" ", " ", " ", "\n", "\t", "\u00a0", "\x1c", "a", "b", "é", "'s", "'", "1", "漢", "!", "the", "🎉", "q" * 80])
    encoder, other = bpe.Encoder(v), bpe.Encoder(plain)
    for _ in range(40):
        made = ["".join(rng.choice(bits, int(rng.integers(0, 25))).tolist()) for _ in range(100)]
        assert other.batch(made) == (got := encoder.batch(made))
        assert [np.frombuffer(x, v.width).tolist() for x in got] == [enc.encode_ordinary(t) for t in made]


def test_bpe_matches_each_distinct_word_once():
    import public_tokenizers as P

    v = bpe.Vocabulary(bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    read, split = [], v.split
    v.split = lambda t: read.append(len(t)) or split(t)
    encoder = bpe.Encoder(v)
    encoder.batch(["alpha beta, gamma " * 2000 + "end"] * 3)
    encoder.batch(["gamma beta, end"])
    assert sum(read) < 100  # the pattern ran over each text: 108,000 characters


def test_bpe_makes_no_object_for_each_word():
    """Words that come back are columns' numbers: as strings they took 60 bytes each, and most of the time."""
    import tracemalloc

    import public_tokenizers as P

    v = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts, encoder = [" ".join(f"word{i % 997}," for i in range(100_000))] * 4, bpe.Encoder(v)
    encoder.batch(texts[:1])
    tracemalloc.start()
    got = encoder.batch(texts)
    most = tracemalloc.get_traced_memory()[1] - sum(map(len, got))
    tracemalloc.stop()
    assert len(set(got)) == 1 and most < 40 * 400_000


def test_bpe_counts_every_word_of_the_corpus():
    """Over slices and batches, nulls, white space beside spaces, and the words of another pattern."""
    import public_tokenizers as P
    import pyarrow as pa

    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["a b c, b", None, "b  b\n x", "", "a", " b", "c, " + "y" * 65, "b b\t"] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 5], pa.string())], ["text"]) for i in range(0, len(texts), 5)]
    got = Counter()
    for b in bpe.count_words(path, P.PATTERN)(iter(batches)):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    want = Counter([" a", "b", "c,", "b", " ", " b  b\n x", " ", " a", "  b", " c,", " b", "  b\t"])
    assert got == Counter({w: 3 * c for w, c in want.items()})
    other = bpe.Vocabulary(bpe.load_ranks(path), r"\s?\S+|\s+")
    words, at, begins = other.words(pa.array(["a b b", "", "b b"]))
    assert [words[i].as_py() for i in at] == ["a", " b", " b", "b", " b"] and begins.tolist() == [0, 3, 3, 5]


def test_bpe_digests_refuse_ids_of_another_text():
    import public_tokenizers as P
    import pyarrow as pa

    v = bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = pa.array(["before", "one two", "", "漢 three", "after"]).slice(1, 3)
    flat, ends = bpe.Encoder(v).encoded(texts)
    sha, back = bpe.text_digests(flat, ends, texts, v)
    ids = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert sha == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert back == [hashlib.sha256(t.as_py().encode()).hexdigest() for t in texts]
    with pytest.raises(ValueError):
        bpe.text_digests(flat, ends, pa.array(["one two", "", "漢 threE"]), v)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii(spark, tmp_path):
    rng = np.random.default_rng(8)
    bits = ["a@b.c", "x_y", "@", "+1 (234) 567-8901", "4111 1111 1111 1111", "4111-1111-1111-1112", "192.168.0.1", "1.2.3.4.5", "256.1.1.1", "é", "🎉", " ", "a.b@c.d.e@f.g", "00012.1.1.001", "+", "..", "12345678901234567890"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(int(rng.integers(0, 10)))) for _ in range(200)]
    made += [None, "", "1" * 30000, "a" * 30000 + "@", "1 " * 20000, "my iban GB82 WEST 1234 5698 7654 32 bank", "my iban GB83 WEST 1234 5698 7654 32 bank"]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(made):
        want = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert sum(got[i][f"n_{k}"] for k in BASE) == (want.count(",") + 1 if want else 0)
    assert "iban:8:35" in got[len(made) - 2].spans and "iban" not in got[len(made) - 1].spans


def test_pii_context_decides(spark, tmp_path):
    """The same run of characters is a secret beside a context word only; a base span's score changes, and it stays."""
    run = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    made = [f'token = "{run}" x', f'colour = "{run}" x', f"{run} is the API KEY", "token " + "a" * 40, "token " + "a1" * 65, f"token {'x' * 50} {run}", "pay 4111 1111 1111 1111", "see 4111 1111 1111 1111", None]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    assert [got[i].n_secret for i in range(9)] == [1, 0, 1, 0, 0, 0, 0, 0, 0]
    assert got[0].spans.endswith("secret:9:49") and got[0].scores.endswith("0.7")
    assert [got[i].n_card for i in (6, 7)] == [1, 1] and [got[i].scores for i in (6, 7, 8)] == ["0.9", "0.7", ""] and got[6].n_spans == 1


def test_pii_context_is_whole_words_nearby(spark, tmp_path):
    run = "a1b2c3d4e5f6a7b8c9d0e1f2a3b4"
    made = [f"the author of monkey {run}", f"api_key:{run}", f"KEY {'x' * 3} {'-' * 60} {run}", f"{'m' * 37}key {run}", f"on{'k' * 35} key {run}", f"{run} Token", f"{run} {'-' * 13} token", f"{run} {'-' * 14} token"]
    spark.createDataFrame([*enumerate(made), (None, made[1]), (1, made[1])], "doc_id long, text string").selectExpr("*", "'c' AS spans", "1 AS at_email", "2 AS id").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op6_pii(spark, str(tmp_path)).collect()
    got = {r.doc_id: r.n_secret for r in rows}
    assert [got[i] for i in range(8)] == [0, 1, 0, 0, 1, 1, 1, 0] and len(rows) == 10 and got[None] == 1


def test_pii_is_linear_in_the_matches_of_one_text(spark, tmp_path):
    """Many e-mails in one text: right positions, and time in proportion to their number."""
    import time

    took = {}
    for n in (20_000, 20_000, 80_000):
        text = "é ab@cd.ef, 4111 1111 1111 1111; " * n
        path = f"{tmp_path}/{n}-{len(took)}"
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        began = time.perf_counter()
        r = pii.op6_pii(spark, path).first()
        took[n] = time.perf_counter() - began
        assert (r.n_email, r.n_card) == (n, n) and r.base_sha256 == hashlib.sha256(",".join(f"email:{33 * i + 2}:{33 * i + 10},card:{33 * i + 12}:{33 * i + 31}" for i in range(n)).encode()).hexdigest()
    assert took[80_000] < 8 * took[20_000] + 2


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        goal = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if goal[s] > most * sizes[s] + 1e-9}
        if not over:
            return goal
        capped |= over


def test_mixing(spark, docs, texts):
    rows = spark.read.parquet(f"{docs}/documents.parquet").collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    per = Counter()
    for r in rows:
        per[r.source] += size[r.doc_id]
    goal = brute_targets(per)
    got = mixing.op8_curriculum_mix(spark, docs).collect()
    taken = Counter()
    for r in got:
        s = next(x.source for x in rows if x.doc_id == r.doc_id)
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(goal[s], abs=1e-5) and r.taken <= 3 * r["size"]
        taken[s] += r.taken
    big = max(size.values())
    assert all(abs(taken[s] - goal[s]) <= big for s in per)
    assert got == mixing.op8_curriculum_mix(spark, docs).collect()
    plan = {r.id: r.passes for r in mixing.curriculum(spark.read.parquet(f"{docs}/documents.parquet")).collect()}
    out = mixing.mixed(spark.read.parquet(f"{docs}/documents.parquet"))
    assert out.columns == SCHEMA.replace(",", "").split()[::2] and Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in plan.items() if v})


def test_mixing_null_and_repeated_ids(spark):
    """Rows without an id, and rows that share one, spread by their texts; another partitioning gives the same."""
    rows = [(None, f"t{i} a b", "s") for i in range(200)] + [(5, f"u{i} a", "s") for i in range(100)] + [(i, "x y", "r") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.id or -1, r.size, r.taken, [round(p, 9) for p in r.positions]) for r in mixing.curriculum(d).collect()) for d in (df.coalesce(1), df.repartition(7)))
    assert one == two and len(one) == 330
    kept, again = (Counter(r.text for r in mixing.mixed(d).collect()) for d in (df.coalesce(1), df.repartition(5)))
    assert kept == again


def test_language_model_counts_and_normalisation(spark, docs, texts):
    got = {r.doc_id: r for r in lm.op2_log_bilinear(spark, docs).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            c.update(lm.tokens(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = lm.tokens(t) + [b""]
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(c[x] > 0 for x in w) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and got[i].score < 0


def lm_corpus(rng):
    own = [f"w{i}" for i in range(40)]
    made = [" ".join([*rng.choice(own, 30), *(f"once{k}-{j}" for j in range(3)), "u" * (65 + k % 5) + str(k % 7)]) for k in range(200)]
    return [*made, made[0], None, "", " ".join(f"d{i}" for i in range(3000)), "x" * 100]


def test_language_model_against_brute_force(spark):
    """Scores token by token from the parameters, with plain sums over all classes and units; the event space sums to 1, long and unseen words included."""
    texts = lm_corpus(np.random.default_rng(3))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[1])], "doc_id long, text string").coalesce(1)
    got = {r.id: r for r in lm.score(df).collect() if r.id is not None}
    train = [t for i, t in enumerate([*texts, texts[1]]) if zlib.crc32(str(i if i < len(texts) else "").encode()) % 10]
    c = Counter(lm.key_of(w) for t in train for w in lm.tokens(t)) + Counter({b"": len(train)})
    counts = lm.count_words(spark.createDataFrame([(t,) for t in train], "text string"))
    total = sum(c.values())
    lex = lm.lexicon(counts, total)
    rows = lm.annotate(df, lex, "doc_id", "text", 10)
    p = lm.train(rows.filter("not held_out").select("units", F.lit(0).alias("row")), lex)
    place = dict(zip(lex.words, lex.unit.tolist()))
    shapes = set(lex.of_shape.tolist())

    def unit(key):
        return place.get(key, None) if key in place else int(lex.of_shape[lm.shape(key)])

    def units_given(u, v):
        h = (p["R"][u].astype(float) @ p["A"] + p["R"][v].astype(float) @ p["B"])
        e = np.exp(p["K"] @ h + p["k"])
        out = np.zeros(len(lex.tally))
        for k, (a, b) in enumerate(zip(lex.first[:-1], lex.first[1:])):
            inner = np.exp(p["Q"][a:b] @ h + p["q"][a:b])
            out[a:b] = e[k] / e.sum() * inner / inner.sum()
        return out

    mass = Counter()
    for w, n in c.items():
        mass[unit(w)] += n + 0.1
    for s in shapes:
        mass[s] += 0.1  # the unseen word
    assert sum(1 for w in c if unit(w) not in shapes) > 20 and any(lm.shape(w) == 64 for w in c if w)
    for u, v in ((0, 0), (3, 5), (len(lex.tally) - 1, 2)):
        given = units_given(u, v)
        share = Counter()
        for w, n in c.items():
            share[unit(w)] += given[unit(w)] * ((n + 0.1) / mass[unit(w)] if unit(w) in shapes else 1)
        unseen = sum(given[s] * 0.1 / mass[s] for s in shapes)
        assert sum(share.values()) + unseen == pytest.approx(1, abs=1e-6)
    for i in (0, 7, 200, 201, 202, 204):
        w, expect = [lm.key_of(x) for x in lm.tokens(texts[i])] + [b""], 0.0
        before = [b"", b"", *w]
        for k, x in enumerate(w):
            given = units_given(unit(before[k]), unit(before[k + 1]))[unit(x)]
            expect += math.log10(given * ((c[x] + 0.1) / mass[unit(x)] if unit(x) in shapes else 1))
        assert got[i].score == pytest.approx(expect, rel=2e-4)


def test_language_model_does_not_depend_on_which_words_are_shared(spark):
    texts = lm_corpus(np.random.default_rng(4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    few, all_ = ({r.id: r for r in lm.score(df, shared=n).collect()} for n in (150, 1 << 18))
    for i, r in all_.items():
        assert (few[i].n_known, few[i].n_tokens) == (r.n_known, r.n_tokens) and few[i].base_score == pytest.approx(r.base_score) and few[i].score == pytest.approx(r.score, rel=1e-6)


def test_language_model_of_words_that_all_stand_once(spark):
    """The level of the end holds more words than are shared; and without any training text."""
    df = spark.createDataFrame([(1, " ".join(f"d{i}" for i in range(500)))], "doc_id long, text string")
    r = lm.score(df, shared=20).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (501, 501, 501) and r.base_score == pytest.approx(501 * math.log10(1.1 / (501 + 50.2))) and r.score < 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens, r.held_out) == (0, 0, True) and math.isfinite(r.score)


def test_language_model_trains_in_more_rounds_on_more_tokens():
    """Steps in sequence grow with the tokens; partitions beyond the tasks of a round change nothing."""
    assert [lm.plan(t, 10_000, 8)[:2] for t in (10, 10**6, 4 * 10**6, 2 * 10**7, 10**10)] == [(8, 1), (4, 1), (1, 4), (1, 16), (1, 16)]
    assert lm.plan(3 * 10**6, 4, 8)[2] == 4 and lm.plan(3 * 10**6, 40, 8) == lm.plan(3 * 10**6, 4000, 8) == (1, 3, 5)
    depth = [t / lm.plan(t, 10**6, 100)[2] for t in (10**7, 10**8, 10**9, 10**10)]
    assert depth == sorted(depth) and depth[-1] > 20 * depth[0]


def test_language_model_does_not_depend_on_files(spark, tmp_path):
    """The gain over the base with many small files is near that with one."""
    rng = np.random.default_rng(29)
    made = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), 120), np.repeat(rng.choice(list("xyz")), 120), strict=True)) for _ in range(600)]
    gains = []
    for n in (1, 40):
        spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(n).write.parquet(f"{tmp_path}/{n}")
        r = lm.score(spark.read.parquet(f"{tmp_path}/{n}")).filter("held_out").agg((F.sum("score") - F.sum("base_score")).alias("g"), F.sum("n_tokens").alias("n")).first()
        gains.append(r.g / r.n)
    assert min(gains) > 0.9 * max(gains) > 0.1


def test_language_model_products_hold_the_biases():
    """Energies and gradients against the plain formulas, large energies too; units are stored in two bytes where these do."""
    rng = np.random.default_rng(24)
    for size in (1, 20, 200):
        x, vectors, bias = rng.normal(0, 1, (700, 16)).astype(np.float32), rng.normal(0, size, (9, 16)).astype(np.float32), rng.normal(0, 1, 9).astype(np.float32)
        noise, true = rng.uniform(0.1, 9, 9).astype(np.float32), rng.integers(0, 9, 700)
        e = x.astype(float) @ vectors.T.astype(float) + bias
        top = e.max(1, keepdims=True)
        plain = (e - top - np.log(np.exp(e - top).sum(1, keepdims=True)))[np.arange(700), true]
        assert np.allclose(lm._log_softmax_at(lm._with(x, 1), vectors, bias, true), plain, rtol=1e-4, atol=1e-3)
        sigma = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
        grad = sigma * noise
        grad[np.arange(700), true] -= 1 - sigma[np.arange(700), true]
        assert np.allclose(lm._contrast(lm._with(x, 1), vectors, bias, noise, true), grad, atol=2e-3)
    few = lm.Lexicon([], np.zeros(0), np.zeros(0), np.zeros(0), np.array([0, 5]), np.ones(5), np.zeros(5))
    assert few.kind is np.uint16 and lm.replace(few, tally=np.ones(65_537)).kind is np.int32
    assert lm.shape("é".encode()) != lm.shape(b"e")


def test_language_model_vocabulary_grows():
    assert [lm.own_words(10**k) for k in (4, 6, 8)] == [50, 500, 5000]


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(9)
    tongues = [[f"{a}{b}" for a in s for b in s] for s in ("bcd", "fgh", "jkl")]
    made = [" ".join(rng.choice(tongues[i % 3], 80)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    r = lm.score(df).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > 0.8 * r.b


def test_quality_learns_and_never_sees_held_out_labels(spark):
    rng = np.random.default_rng(10)
    made = [prose(rng, 60) if i % 4 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    good = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    got = quality.score(df, quality.train(df, good)).collect()
    assert np.mean([(r.score >= 0.5) == (r.id % 4 > 0) for r in got if zlib.crc32(str(r.id).encode()) % 5 == 0]) > 0.98
    swapped = good.withColumn("quality", F.when(common.crc_mod(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.id: r.score for r in quality.score(df, quality.train(df, swapped)).collect()}
    assert again == {r.id: r.score for r in got}


def test_quality_against_brute_force(spark):
    """The fit on plain arrays gives the scores of the query; repeated ids are one labelled row; dense and sparse features travel alike."""
    rng = np.random.default_rng(23)
    made = [prose(rng, 40) if i % 3 else prose(rng, 40).upper() for i in range(120)] + [" ".join(chr(40 + int(c)) * 2 for c in rng.integers(0, 5000, 20000))]
    df = spark.createDataFrame([*enumerate(made), (7, made[7])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(121)], "doc_id long, quality int")
    features = quality.Features()
    train = [i for i in range(121) if zlib.crc32(str(i).encode()) % 5]
    found = [features.of(made[i].encode()).astype(np.int32) for i in train]
    assert all(np.array_equal(quality.unpacked(quality.packed(x)), x) for x in found) and quality.packed(found[-1])[:1] in (b"b", b"l")
    model = quality.fit(quality.Rows([quality.packed(x) for x in found]), np.array([int(i % 3 > 0) for i in train]))
    want = {i: float(model.score(np.array([model.margin(features.of(t.encode()))]))[0]) for i, t in enumerate(made)}
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == 122 and all(r.score == pytest.approx(want[r.id], abs=1e-12) for r in got)


def test_quality_with_one_class_and_odd_rows(spark, docs):
    got = quality.op5_nbsvm_quality(spark, docs).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(df, quality.train(df, one)).collect()} <= {0.5, 2 / 3, 0.75}


def brute_nearest(ids, x, q, k=5):
    fine = [i for i, v in enumerate(x) if v is not None and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v) and any(v) and ids[i] is not None]
    if q not in fine:
        return []
    a = np.array(x[q], float)
    out = []
    for i in fine:
        if ids[i] != ids[q]:
            b = np.array(x[i], float)
            out.append((-round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 12), ids[i]))
    return [i for _, i in sorted(out)[:k]]


def test_nearest_neighbours_small_and_odd(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = [[float(v) for v in np.float32(rng.normal(size=4))] for _ in range(110)]
    x[3], x[4], x[5], x[6], x[7] = None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 1.0, 1.0], [1.0, 2.0]
    for i in range(60, 100):
        x[i] = x[60]  # a hot vector
    ids = [*range(109), None]
    spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in ann.op1_learned_partitions(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {i: brute_nearest(ids, x, i) for i in range(0, 109, 50)}
    assert got == {q: v for q, v in want.items() if v}


def test_nearest_neighbours_recall(spark, tmp_path):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    got = ann.op1_learned_partitions(spark, str(tmp_path)).collect()
    for q in range(0, 4000, 50):
        s = u[q] @ u.T
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / 400 >= 0.9
    router = ann.fit(x[:3000], 4000)
    assert router.parts > 4 and router.probes < router.parts


def recall(got, ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.id)
    hits = 0
    for q in queries:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:k]].tolist()) & found[q])
    return hits / (k * len(queries))


def test_nearest_neighbours_in_two_levels(spark):
    """A table beyond one level's parts; every query gets its five, clashing columns and repeated query ids change nothing."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 12))[rng.integers(0, 60, 3000)] + 0.3 * rng.normal(size=(3000, 12))
    rows = [(i, [float(v) for v in r], 1, 2) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[100]], "vec_id long, embedding array<double>, id int, part int")
    got = ann.search(df, F.col("vec_id") % 50 == 0, part_rows=16, max_parts=8).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in range(0, 3000, 50) for k in range(1, 6)]
    assert recall(got, np.arange(3000), x, list(range(0, 3000, 50))) >= 0.9


def test_queries_are_not_copied_for_each_part(spark, monkeypatch):
    """A query that probes many parts goes to each block once: no table between has more rows than the input, and blocks hold many parts."""
    tables = {}

    def kept(df, name):
        table = common.materialise(df, name)
        tables[name] = table.count()
        return table

    monkeypatch.setattr(ann, "materialise", kept)
    x = np.random.default_rng(22).normal(size=(1500, 12))  # without structure: most parts are probed
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.lit(True), part_rows=16, max_parts=8).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in range(1500) for k in range(1, 6)]
    assert recall(got, np.arange(1500), x, list(range(0, 1500, 50))) >= 0.9
    assert max(n for name, n in tables.items() if name != "found") <= 1500 and tables["blocks"] <= 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_nearest_neighbours_of_the_tables_are_routed(spark, monkeypatch):
    routers = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **k: routers.append(fit(*a, **k)) or routers[-1])
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    rows = df.filter("embedding is not null").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    assert routers[0].probes < routers[0].parts
    assert recall(got, ids, np.array([r.embedding for r in rows], float), ids[ids % 50 == 0].tolist()) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = np.bincount(ann.balanced_parts(x, ann.neighbours(x, 8), 10), minlength=10)
    assert size.min() > 60 and size.max() <= 132


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>One<p>Two <b>bo<i>ld</b> x", "One\n\nTwo bold x"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>tail", "- a\n- b\n  3. x\n  4. y\n- c\n\ntail"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name      | Qty\nApple pie | 3"),
        ("a<div hidden>no<div>no</div></div>b<span style='display: none'>no</span>c<!-- no -->d", "abcd"),
        ("<head><title>no</title></head><body>yes<script>if (a<b) no</script><style>no</style>", "yes"),
        ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"), ("3 < 4 <br>z", "3 < 4\nz"), ("<dl><dt>T<dd>D</dl>", "T\n  D"),
    ],
)
def test_html(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<ul><li hidden>a<li>b</ul><p>c", "- b\n\nc"),
        ("<p style='display:none'>x<p>visible", "visible"),
        ("<div><span hidden>a</div>b", "b"),
        ("<div hidden>a<div>b</div>c</div>d", "d"),
        ("<table><tr><td hidden>a<td>b<tr hidden><td>c<tr><td>d</table>e", "b\nd\n\ne"),
        ("<dl><dt hidden>a<dd>b</dl>c", "  b\n\nc"),
        ("<select><option hidden>a<option>b</select>", "b"),
        ("<div><template><p>a</div>b</template>c</div>d", "c\nd"),
        ("<p hidden>a<script>'</p>'</script>b</p>c", "c"),
        ("<head><title>t</title><h2>a</h2><p>b", "a\n\nb"),
        ("<head><meta charset=x><a href=u>a</a> b<p>c", "a b\n\nc"),
        ("<head><title>t</title>a<p>b", "a\n\nb"),
        ("<head><template><p>x</template><title>t</title></head><body>a", "a"),
        ("<p>a<head>b", "ab"),
        ("a <svg><title>t</title><path d='x'/><text>b</text></svg> c", "a\nb\nc"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"),
        ("<svg><defs><text>a</text></defs><p>b", "b"),
    ],
)
def test_html_hidden_elements_end_as_others_do(html, text):
    assert html_text.render(html) == text


def test_html_hidden_stays_linear():
    for bad in ("<p hidden>x" * 50_000, "<span hidden>" * 50_000 + "</b>" * 50_000, "<svg><foreignObject>" + "<b>" * 50_000, "<head><b>x" * 50_000, "<svg><g>" * 50_000 + "<p>x"):
        html_text.render(bad)


def test_html_keeps_every_visible_word():
    rng = np.random.default_rng(14)
    for _ in range(200):
        parts, words = [], []
        for k in range(int(rng.integers(1, 30))):
            tag = str(rng.choice("p div li ul ol table tr td b i h1 br blockquote dd pre".split()))
            parts.append(f"<{tag}>" if rng.random() < 0.6 else f"</{tag}>")
            if rng.random() < 0.7:
                words.append(f"word{k}")
                parts.append(f" word{k} ")
        assert sorted(re.findall(r"word\d+", html_text.render("".join(parts)))) == sorted(words)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab    | c\nd | e | f"),
        ("<table><tr><td colspan=2>a long title<td>c<tr><td>d<td>e<td>f</table>", "a long title | c\nd | e        | f"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<table><tr><td colspan=x>a<td rowspan=-1>b<tr><td>c<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a | b | c\nd     | e"),
    ],
)
def test_html_spans(html, text):
    assert html_text.render(html) == text


def test_html_wide_cells_do_not_blow_up():
    html = "<table><tr><td>" + "x" * 20000 + "<td>y" + "<tr><td>a<td>b" * 3000 + "</table>"
    assert len(html_text.render(html)) < 20000 + 3000 * 80
    assert len(html_text.render("<table>" + "<tr><td rowspan=65534 colspan=1000>q" * 2000 + "</table>")) < 2000 * 420


def test_html_against_a_tree():
    """Random trees whose text is told from the tree itself; end tags that may be left out are left out at random, and hidden elements put in between."""
    rng = np.random.default_rng(17)

    def words():
        return " ".join(f"w{int(x)}" for x in rng.integers(0, 500, int(rng.integers(1, 6))))

    def maybe(tag):
        return tag if rng.random() < 0.5 else ""

    def listing(depth):
        kind = rng.choice(["ul", "ol"])
        html, lines = f"<{kind}>", []
        for k in range(int(rng.integers(1, 4))):
            w = words()
            html += f"<li>{w}"
            lines.append("  " * depth + (f"{k + 1}." if kind == "ol" else "-") + " " + w)
            if depth < 2 and rng.random() < 0.3:
                inner, below = listing(depth + 1)
                html, lines = html + inner, lines + below
            html += maybe("</li>")
        return html + f"</{kind}>", lines

    for _ in range(150):
        html, want = "", []
        for _ in range(int(rng.integers(1, 6))):
            kind = rng.integers(0, 4)
            if kind == 0:
                w = words()
                html, want = html + f"<p>{w.replace(' ', rng.choice([' ', chr(10), ' <b> ', '<i> </i>']))}{maybe('</p>')}", [*want, w]
            elif kind == 1:
                more, lines = listing(0)
                html, want = html + more, [*want, "\n".join(lines)]
            elif kind == 2:
                grid = [[words() for _ in range(3)] for _ in range(int(rng.integers(1, 4)))]
                width = [max(len(r[i]) for r in grid) for i in range(3)]
                html += "<table>" + "".join(f"<tr>{''.join(f'<td>{x}' + maybe('</td>') for x in r)}{maybe('</tr>')}" for r in grid) + "</table>"
                want.append("\n".join(" | ".join(x.ljust(n) for x, n in zip(r, width, strict=True)).rstrip() for r in grid))
            else:
                html += f"<div hidden>{words()}<p>{words()}</div><!-- {words()} --><script>{words()}</script>"
        assert html_text.render(html) == "\n\n".join(want), html


@pytest.mark.parametrize("bad", ["<p><html>" + "<div>" * 60000, "<table>" + "<tr><td>" * 20000, "<a " * 50000, '<a "' * 30000, "<!--" * 30000, "<div>" * 30000, "<li>" * 20000, "&" * 50000, "<script>" * 20000])
def test_html_stays_linear(bad):
    html_text.render(bad)


def test_html_query(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (None, "u", "<b>c</b>"), (1, "u", "<p>a")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(((r.page_id or 0), r.text) for r in html_text.op9_layout_text(spark, str(tmp_path)).collect()) == [(0, "c"), (1, "a"), (1, "a"), (2, "")]


def test_rolling_hash_depends_on_order_and_width():
    h = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w in (1, 5, 26, 39):
        r = common.rolling(h, w)
        assert len(r) == 40 - w and len(set(r.tolist())) == len(r)
    assert common.rolling(h, 40).size == 0 and common.rolling(h[::-1].copy(), 39)[0] != common.rolling(h, 39)[0]


def test_pipeline_against_brute_force(spark, docs, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers as P

    df = spark.read.parquet(f"{docs}/documents.parquet")
    steps = [df]
    for name, f in corpus_pipeline.STAGES[:-1]:
        steps.append(common.materialise(f(spark, steps[-1], docs), name.replace(" ", "-")))
        assert steps[-1].columns == df.columns, name
    good = {r.id for r in quality.score(df, quality.train(df, spark.read.parquet(f"{docs}/labels.parquet"))).collect() if r.score >= 0.3}
    assert {r.doc_id for r in steps[1].collect()} == good
    seen, exact = set(), []
    for i in sorted(good):
        if norm(texts[i]) not in seen:
            seen.add(norm(texts[i]))
            exact.append(i)
    assert sorted(r.doc_id for r in steps[2].collect()) == exact
    near = [exact[k] for k, c in enumerate(brute_classes([texts[i] for i in exact])) if c == k]
    assert sorted(r.doc_id for r in steps[3].collect()) == near
    plan = {r.id: r.passes for r in mixing.curriculum(steps[3]).collect()}
    mix = Counter(r.doc_id for r in steps[4].collect())
    assert mix == Counter({k: v for k, v in plan.items() if v})
    v = bpe.vocabulary(P.path(corpus_pipeline.RANKS), P.PATTERN)
    out = corpus_pipeline.run(spark, docs).collect()
    assert Counter(r.doc_id for r in out) == mix
    for r in out:
        assert bpe.decode(r.ids, v).decode() == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_nothing_else_imports_llm():
    import phenogrid

    root = os.path.dirname(phenogrid.__file__)
    for d, _, names in os.walk(root):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "phenogrid.llm" not in open(os.path.join(d, n)).read(), n


def test_tasks_hold_few_texts_of_a_batch_at_a_time(monkeypatch):
    """A batch holds 10,000 rows, whose words would take several times its bytes."""
    import pyarrow as pa

    held, hashes = [], common.WordHashes()
    monkeypatch.setattr(near_dedup, "shingles", lambda texts, h, f=near_dedup.shingles: held.append(sum(map(len, texts))) or f(texts, h))
    texts = ["w%d " % i * 100_000 for i in range(20)] + [None, "", "z " * 1_000_000]
    got = near_dedup._names(pa.array(texts), hashes, True)
    assert max(held[:-1]) <= near_dedup._BATCH_CHARS and held[-1] == 2_000_000 and sum(held) == sum(len(t or "") for t in texts)
    assert [x is None for x in got] == [not t for t in texts] and len(set(got)) == 22
    assert [len(x) for x in common.sliced(pa.array(["ab", None, "abc", "", "é"]), 4)] == [2, 2, 1] and list(common.sliced(pa.array([], pa.string()), 4)) == []
    assert list(common.lean(iter)([1, 2])) == [1, 2]


def test_near_copies_of_repeated_ids_keep_one_row_of_each_class(spark):
    words = [f"word{i}" for i in range(300)]
    text, near, clean = " ".join(words), " ".join(words[:299]), " ".join(f"other{i}" for i in range(300))
    twin, twin_near = " ".join(f"twin{i}" for i in range(300)), " ".join(f"twin{i}" for i in range(299))
    rows = [(1, text), (2, near), (2, clean), (3, twin), (3, twin_near), (4, None), (None, text)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((i, t) for i, t in got if i in (1, 2)) == [(1, text), (2, clean)]  # the clean text of a repeated id stays
    assert len([t for i, t in got if i == 3]) == 1  # of two near-equal texts of one id one goes
    assert (4, None) in got and (None, text) in got and kept.columns == ["doc_id", "text"]
