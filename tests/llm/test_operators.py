"""The operators against brute force, exact round trips, and their defined results for odd input."""

import base64
import hashlib
import itertools
import random
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import ann, bpe, langid, licenses, mixing, near_dedup, sharding, tiff, token_counts, tokenfiles
from tidegrid.llm import queries as q
from tidegrid.llm.common import utf8

from .conftest import BASE, SCHEMA, SF, row


def words(text):
    return (text or "").encode().split()


# 1


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.BYTE_BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_bpe_random_texts(oracle):
    rnd, vocab = random.Random(1), bpe.vocabulary(q.BYTE_BPE)
    letters = list("ab'strevlmd  \n\t1²½!?é漢 　\x1ć\U0001f600")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40))) for _ in range(4000)] + ["a" * 5000, " " * 3000 + "x", "'" * 500]
    raw, offsets = pack(texts)
    ids, upto = vocab.encode(raw, offsets)
    for k, t in enumerate(texts):
        assert ids[upto[k] : upto[k + 1]].tolist() == oracle.encode_ordinary(t), t


def test_op1(spark, docs, oracle):
    got = {r.doc_id: r for r in q.op1_byte_bpe(spark, SF).collect()}
    for r in docs.collect():
        ids, x = oracle.encode_ordinary(r.text), got[r.doc_id]
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_odd(odd, none, oracle):
    encoded = bpe.encode_documents(odd, q.BYTE_BPE)
    want = Counter((r.doc_id, tuple(oracle.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in encoded.collect()) == want
    assert Counter((r.doc_id, bytes(r.decoded)) for r in bpe.decode_documents(encoded, q.BYTE_BPE).collect()) == Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    assert bpe.encode_documents(none, q.BYTE_BPE).count() == 0


# 2


def word_grams(text, n=5):
    w = [x.lower() for x in words(text)]
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def check_licenses(text, got):
    """Every run of as many shingles as a template has, at every offset, and what the reported words hold."""
    mine = word_grams(text)
    w = words(text)
    for name, notice in licenses.NOTICES.items():
        t = set(word_grams(notice))
        best = max((len(t & set(mine[a : a + len(t)])) / len(t) for a in range(len(mine))), default=0)
        if name in got:
            r = got[name]
            assert r.containment >= max(best, 0.8)
            assert len(t & set(word_grams(b" ".join(w[r.first_word : r.end_word]).decode()))) / len(t) == r.containment
        else:
            assert best < 0.8


def test_licenses(spark, docs):
    notice = licenses.NOTICES["MIT-text"].split()
    rnd = random.Random(3)
    made = []
    for k in range(200):
        inside = list(notice)
        for _ in range(rnd.randrange(0, 3)):
            inside[rnd.randrange(len(inside))] = "changed"
        made.append((10_000 + k, " ".join([*rnd.choices(BASE, k=rnd.randrange(0, 90)), *inside, *rnd.choices(BASE, k=rnd.randrange(0, 90))])))
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = defaultdict(dict)
    for r in licenses.scan(every).collect():
        got[r.doc_id][r.license] = r
    for r in every.collect():
        check_licenses(r.text, got.get(r.doc_id, {}))
    assert any("MIT-text" in x for x in got.values())


def test_many_templates(spark):
    """Retrieval by the index of hundreds of templates finds what each holds."""
    rnd = random.Random(8)
    notices = {f"t{k}": " ".join(f"{rnd.choice(BASE)}{rnd.randrange(30)}" for _ in range(rnd.randrange(6, 60))) for k in range(300)}
    rows = [(k, " ".join([*rnd.choices(BASE, k=rnd.randrange(0, 40)), notices[f"t{k}"], *rnd.choices(BASE, k=9)])) for k in range(0, 300, 3)]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices).collect()}
    assert {(k, f"t{k}") for k, _ in rows} <= got


def test_licenses_odd(odd, none):
    assert licenses.scan(odd).count() == 0
    assert licenses.scan(none).count() == 0
    assert {r.license for r in licenses.scan(odd, {"x": "word", "y": ""}).collect()} == {"x"}


GENUINE = {
    "MIT-permission": '# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \u201cSoftware\u201d), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use',
    "MIT": "released under the MIT license and",
    "GPL-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
}


def test_op2_genuine(spark, tmp_path):
    rows = [(k, " ".join(BASE) + " " + text + " " + " ".join(BASE)) for k, text in enumerate(GENUINE.values())] + [(9, " ".join(BASE) + " under the license"), (10, "The quick release of an MIT report, licensed to nobody.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(set)
    for r in q.op2_license_scan(spark, str(tmp_path)).collect():
        got[r.doc_id].add(r.license)
    assert all(name in got[k] for k, name in enumerate(GENUINE))
    assert set(got) == set(range(len(GENUINE)))


# 3


def brute_components(rows, n, num=80, den=100):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_op3(spark, docs):
    got = q.op3_minhash_near_dedup(spark, SF)
    assert found(got) == brute_components([(r.doc_id, r.text) for r in docs.collect()], 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def edited(spark):
    """Dense groups at every similarity around the limit, and small sets."""
    rnd, rows = random.Random(5), []
    for g in range(6):
        base = [f"{rnd.choice(BASE)}{rnd.randrange(40)}" for _ in range((60, 60, 100, 9, 4, 2)[g])]
        for _ in range(130):
            w = list(base)
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(len(w))] = f"{rnd.choice(BASE)}{rnd.randrange(6)}"
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_dense(spark, n, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    monkeypatch.setattr(near_dedup, "GROUP", 20)
    monkeypatch.setattr(near_dedup, "VOLUME", 2000)
    rows = edited(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(near_dedup.near_duplicates(df, shingle=n)) == brute_components(rows, n)


def test_near_duplicates_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(near_dedup.near_duplicates(odd, shingle=2)) == brute_components(rows, 2)
    kept = near_dedup.keep_one(odd, shingle=5)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13]
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0


def test_keep_one_without_own_ids(spark):
    """Rows without an id and rows that share one: only rows of one component displace each other."""
    texts = [" ".join(f"{w}{g}" for w in BASE) for g in range(5)]
    rows = [(None, texts[0]), (None, texts[0] + " indeed"), (None, texts[1]), (None, texts[2]), (3, texts[2] + " indeed"), (7, texts[3]), (7, texts[4]), (2, texts[4] + " indeed"), (8, texts[1][::-1]), (8, texts[0][::-1]), (None, ""), (None, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumns({c: F.lit(7) for c in ("row", "key", "id", "no_id", "words", "_kept_id", "row_key", "component")})
    kept = near_dedup.keep_one(clash, shingle=2)
    assert kept.columns == clash.columns and {r["key"] for r in kept.collect()} == {7}
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    kept = [rows[k] for k in (2, 4, 5, 7, 8, 9, 10, 11, 12)]
    assert sum(got.values()) == len(kept) + 1 and all(got[r] == 1 for r in kept)
    assert got[rows[0]] + got[rows[1]] == 1


# 4


def brute_nearest(rows, k, step=20):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    out = {}
    for i, d in enumerate(ids):
        if d % step == 0:
            scores = sorted((-float(s), v) for v, s in zip(ids, x @ x[i], strict=True) if v != d)
            out[d] = [v for _, v in scores[:k]]
    return out


def test_op4_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute_nearest([(r.vec_id, r.embedding) for r in rows], 20)
    got = defaultdict(dict)
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    for r in q.op4_multi_index_ann(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id][r.rank] = r.vec_id
        assert abs(r.score - float(vectors[r.query_id] @ vectors[r.vec_id])) < 1e-12
    assert got.keys() == want.keys()
    assert all(sorted(x) == list(range(1, 21)) for x in got.values())
    assert np.mean([len({*want[d]} & {*got[d].values()}) / 20 for d in want]) >= 0.9


def test_nearest_odd(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 10)
    schema = "vec_id long, embedding array<float>, rank string, score string, cell string"
    made = [(i, [float(i % 3), 1.0, 0.5, float(i % 2)]) for i in range(40)]
    short = [(-40, [1.0]), (-39, [2.0]), (-38, [3.0])]  # the smallest ids have vectors of another length
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in made + short + bad], schema)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == brute_nearest(made, 5) | {-40: [-38, -39]}
    few = ann.nearest(df.where("vec_id between 0 and 2"), F.col("vec_id") % 20 == 0, 5).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [1, 2]  # a tie
    assert ann.nearest(df.where("vec_id < -99"), F.lit(True)).count() == 0


def test_nearest_repeated_ids(spark):
    """Queries that share an id have lists of their own, equal ones share theirs; entries that repeat are entries."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0, 2, recall=1.0).collect())
    assert got == {(1, 1, 1.0): 1, (2, 3, 0.9): 1, (1, 2, 1.0): 1, (2, 2, 1.0): 1}


def test_nearest_large_vectors(spark):
    """The order of near-ties of vectors that are far from unit length."""
    rnd = np.random.default_rng(2)
    rows = [(i, (1e9 + rnd.integers(0, 3, 8)).tolist()) for i in range(200)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 9, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for d, mine in got.items():
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(rows[d][1], x, strict=True)), v) for v, x in rows if v != d)
        rounded = sorted((-float(-s), v) for s, v in exact)
        assert mine == [v for _, v in rounded[:9]]


# 5


def check_shards(df, rows, tolerance=None):
    got = df.collect()
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == sizes
    by, held = defaultdict(list), Counter()
    for r in got:
        by[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) <= set(range(8))
    if tolerance:
        assert max(held.values()) - min(held[s] for s in range(8)) <= tolerance * sum(held.values()) / 8
    return got


def torn(got, count=8):
    """Groups of equal texts in more than one shard, and the share of a shard's bytes that each has."""
    at, held = defaultdict(set), Counter()
    for r in got:
        at[r.text_crc32, r.size].add(r.shard)
        held[r.text_crc32, r.size] += r.size
    return {g: held[g] * count / sum(held.values()) for g, x in at.items() if len(x) > 1}


def test_op5(spark, docs):
    got = check_shards(q.op5_kd_sharding(spark, SF), docs.collect(), 0.2)  # a document holds up to a sixth of a shard
    assert {r.law for r in got} == {"bytes"}
    assert got == q.op5_kd_sharding(spark, SF).collect() or sorted(got, key=str) == sorted(q.op5_kd_sharding(spark, SF).collect(), key=str)


def test_op5_keeps_groups(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check_shards(q.op5_kd_sharding(spark, "/root/testdata/sf0.01"), rows.collect(), 0.04)
    pieces = torn(got)
    assert len(pieces) <= 7 and all(x > sharding.HEAVY for x in pieces.values())  # one a cut at most, and none that is small
    assert len({(r.text_crc32, r.size) for r in got}) < len(got)


def test_shards_balance_with_hot_groups(spark):
    rows = [row(i, "same text " * 5 if i % 3 == 0 else f"text {i % 2900} " * (i % 17 + 1), lang=f"l{i % 5}", source=f"s{i % 2}") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = torn(check_shards(sharding.shards(df), df.collect(), 0.04))
    assert set(pieces) <= {(zlib.crc32(b"same text " * 5), 51)}


def brute_tree(rows, count):
    """Shards of texts that are all different, cut at weighted medians of exact coordinates: the sizes of both sides of the first cut."""
    total = sum(rows)
    upto, best = 0, 0
    for x in sorted(rows):
        upto += x
        if abs(upto - total / 2) < abs(best - total / 2):
            best = upto
    return best


def test_first_cut_is_a_weighted_median(spark):
    """Texts of one source and language and of sizes far apart: two shards are the texts up to the median size and the rest."""
    rows = [row(i, "x" * (3 * i + 1)) for i in range(400)]
    got = sharding.shards(spark.createDataFrame(rows, SCHEMA), 2).collect()
    low = [r.size for r in got if r.shard == 0]
    assert max(low) < min(r.size for r in got if r.shard == 1)
    assert sum(low) == brute_tree([r.size for r in got], 2)


def test_shards_odd(odd, none):
    check_shards(sharding.shards(odd), odd.collect())
    assert sharding.shards(none).count() == 0


# 6


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    rnd = np.random.default_rng(n)
    for high in (1, 2, 50_000, 2**32):
        ids = rnd.integers(0, high, n).astype(np.uint32)
        if n > 50:
            ids[rnd.integers(0, n, n // 25)] = 2**32 - 1
        data = tokenfiles.pack(ids)
        assert (tokenfiles.unpack(data) == ids).all()
        assert (tokenfiles.unpack(data, 1, 3) == ids[128:384]).all()
    assert len(tokenfiles.pack(np.full(1280, 7))) < 200


def brute_tokens(rows):
    t, at, out = Tokenizer.from_file(q.WORD_BPE), 0, Counter()
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    return out


def test_op6(spark, docs):
    got = Counter(tuple(r) for r in q.op6_token_files(spark, SF).collect())
    assert got == brute_tokens([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])


def test_token_files_odd(odd, none):
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = Counter(tuple(r) for r in tokenfiles.read_shards(tokenfiles.write_shards(rows, q.WORD_BPE, 2).cache()).collect())
    assert got == brute_tokens([(r.doc_id, r.text) for r in rows.orderBy("doc_id").collect()])
    assert tokenfiles.read_shards(tokenfiles.write_shards(odd, q.WORD_BPE, 2).cache()).count() == odd.count()
    assert tokenfiles.read_shards(tokenfiles.write_shards(none, q.WORD_BPE, 2)).count() == 0


# 7


def test_op7(spark, docs, oracle):
    word = Tokenizer.from_file(q.WORD_BPE)
    want, seen = Counter(), set()
    for r in docs.orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            for version, n in ((token_counts.BYTE, len(oracle.encode_ordinary(r.text))), (token_counts.WORD, len(word.encode(r.text, add_special_tokens=False).ids))):
                want[r.source, r.lang, version, "docs"] += 1
                want[r.source, r.lang, version, "tokens"] += n
    got = Counter()
    for r in q.op7_token_counts(spark, SF).collect():
        got[r.source, r.lang, r.tokenizer_version, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer_version, "tokens"] += r.n_tokens
    assert +got == +want


def test_counts_odd(odd, none, oracle):
    word = Tokenizer.from_file(q.WORD_BPE)
    each = token_counts.counted(odd, q.BYTE_BPE, q.WORD_BPE)
    want = Counter((r.doc_id, r.source, len((r.text or "").encode()), len(oracle.encode_ordinary(r.text or "")), len(word.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert Counter((r.doc_id, r.source, r.n_bytes, r[token_counts.BYTE], r[token_counts.WORD]) for r in each.collect()) == want
    gone = token_counts.copies(each).collect()
    assert sum(r.times for r in gone) == odd.count() - odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.copies(token_counts.counted(none, q.BYTE_BPE, q.WORD_BPE)).count() == 0


def test_compaction(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, old_tokens long, new_tokens long, times long"
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.compact() == 0
    one = spark.createDataFrame([("a", "en", "v", None, 5, 3)], schema)
    assert r.apply(4, one) and r.compact() == 1  # batches may come in any order
    assert r.apply(2, one) and not r.apply(4, one)
    assert r.compact() == 2 and r.compact() == 2
    assert not any((tmp_path / "r/deltas").iterdir())
    (tmp_path / "r/base-broken/sums").mkdir(parents=True)  # a compaction that failed before its marker
    r.apply(7, spark.createDataFrame([("a", "en", "v", 5, 1, 2)], schema))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v", 6, 22)]


def test_rollup(spark, tmp_path):
    schema = "source string, lang string, tokenizer_version string, old_tokens long, new_tokens long, n_docs string"
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    first = spark.createDataFrame([("a", "en", "v", None, 5, "x"), ("a", "en", "v", None, 0, "x"), (None, None, "v", None, 3, "x")], schema)
    assert r.apply(0, first) and not r.apply(0, first)
    (tmp_path / "r/deltas/batch=1").mkdir()  # a batch that failed before its commit
    r.apply(1, spark.createDataFrame([("a", "en", "v", 5, 7, "x"), (None, None, "v", 3, None, "x")], schema))
    r.apply(2, spark.createDataFrame([], schema))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v", 2, 7)]


# 8


def brute_mix(rows, share=1.5, most=2.0):
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > most * size[s]}
        if not full:
            return size, target | {s: left * weight[s] / total for s in free}
        for s in full:
            target[s] = most * size[s]
            left -= target[s]
        free -= full
    return size, target


def inverse(u, a):
    return u if a == 0 else (((1 - a) ** 2 + 4 * a * u) ** 0.5 - (1 - a)) / (2 * a)


def brute_passes(rows, slopes=mixing.SLOPES, most=2):
    """(doc_id, pass, taken, position) by walking each source's order again and again."""
    size, target = brute_mix(rows)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    out = []
    for i, s in enumerate(order):
        mine = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, len(words(r.text))) for r in rows if r.source == s)
        at = 0
        for k in range(most):
            for _, d, n in mine:
                if min(n, int(target[s]) - at) > 0:
                    out.append((d, k, min(n, int(target[s]) - at), inverse(at / target[s], slopes[i % 3])))
                at += n
    return out


def check_mix(df, rows):
    size, target = brute_mix(rows)
    got = df.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    places = [r.first_position for r in got if r.first_position is not None]
    assert places == sorted(places)
    assert all(0 <= p <= 1 for p in places)
    return got


def test_op8(spark, docs, duck):
    got = check_mix(mixing.mix(docs), docs.collect())
    again = q.op8_source_mixing(spark, SF).collect()
    assert again == [(r.doc_id, r.size, r.source_size, r.target, r.taken, r.first_position, r.last_position) for r in got]
    assert Counter(map(tuple, again)) == Counter(duck.sql(q.ORACLE_SQL["op8_source_mixing"]).fetchall())


@pytest.mark.parametrize("slopes", [mixing.SLOPES, (0.9, -0.9, 0.0)])
def test_passes_follow_the_schedules(docs, slopes, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    rows = docs.collect()
    want = brute_passes(rows, slopes)
    got = mixing.training_rows(docs, slopes=slopes).collect()
    assert {(r.doc_id, r["pass"]): (r.taken, round(r.position, 9)) for r in got} == {(d, k): (n, round(t, 9)) for d, k, n, t in want}
    assert [r.position for r in got] == sorted(r.position for r in got)
    assert max(r.position for r in got if r["pass"] == 1) > 0.9
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    assert taken == +Counter({r.doc_id: r.taken for r in mixing.mix(docs, slopes=slopes).collect()})


def test_mixed_rows_are_in_training_order(docs):
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    named = lambda d: hashlib.md5(str(d).encode()).hexdigest()
    want = [d for _, _, _, d in sorted((round(t, 12), named(d), k, d) for d, k, n, t in brute_passes(docs.collect()) if 2 * n >= size[d])]
    assert [r.doc_id for r in mixing.mixed_rows(docs).collect()] == want


def test_mix_chunks(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    check_mix(mixing.mix(docs), docs.collect())


def test_mix_odd(odd, none):
    check_mix(mixing.mix(odd), odd.collect())
    assert mixing.mix(none).count() == mixing.training_rows(none).count() == 0
    clash = odd.withColumns({c: F.lit(7) for c in ("row", "pass", "_pass", "_passes", "_mixed_id", "key", "tie", "id", "taken", "before", "within", "name")})
    rows = mixing.mixed_rows(clash)
    assert rows.columns == clash.columns
    every = rows.collect()
    assert {r["pass"] for r in every} == {7}
    assert max(Counter((r.doc_id, r.text) for r in every if r.doc_id != 2).values()) <= 2
    assert mixing.mixed_rows(none).count() == 0


def test_rows_that_share_an_id_are_mixed_apart(spark):
    rows = [row(None if i % 2 else 5, f"w{i} " * 10, source="ab"[i % 3 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = Counter(r.text for r in mixing.mixed_rows(df).collect())
    assert set(taken.values()) <= {1, 2} and abs(sum(taken.values()) - 90) <= 2


def test_schedule_is_inverted(spark):
    df = spark.createDataFrame([row(i, "a b c d", source=s) for s in "xyz" for i in range(300)], SCHEMA)
    by = defaultdict(list)
    for r in mixing.training_rows(df).collect():
        by[r.source].append(r.position)
    assert np.mean(by["x"]) < np.mean(by["z"])  # the first source's weight falls, the third's rises


# 9


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(compression, predictor, tile):
    rnd = np.random.default_rng(1)
    pages = [rnd.integers(0, h, (y, x, s)).astype(np.uint8) for y, x, s, h in ((1, 1, 1, 2), (37, 53, 3, 5), (130, 64, 1, 256), (70, 90, 3, 256))]
    data = tiff.write_tiff(pages, compression, predictor, rows=20, tile=tile)
    back = [tiff.read_page(data, fields) for _, fields in tiff.directories(data)]
    assert len(back) == 4
    assert all((a == b).all() for a, b in zip(pages, back, strict=True))


def test_known_codes():
    """Sequences that are printed with the formats' descriptions."""
    assert tiff.lzw_decode(bytes.fromhex("800B6050220C0C8501"), 99) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    packed, plain = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert tiff.packbits_decode(packed, 99) == plain
    assert tiff.packbits_decode(packed, 5)[:5] == plain[:5]


def by_hand(order, entries, data):
    """One directory at 8; entries: tag, type, values; data goes behind it, and offsets of the name 'data' mean its start."""
    start = 8 + 2 + 12 * len(entries) + 4
    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(entries))
    for tag, kind, values in entries:
        values = [start + v[1] if isinstance(v, tuple) else v for v in values]
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}[kind]
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(raw) > 4:
            raw, data = struct.pack(f"{order}I", start + len(data)), data + raw
        out += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return out + bytes(4) + data


def page_of(data):
    return tiff.read_page(data, next(iter(tiff.directories(data)))[1])


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_by_hand(order):
    """Tiles of 16 x 16 over a page of 20 x 3, with the horizontal predictor; and strips of LZW and PackBits."""
    tiles = bytes([1] + [1] * 15) * 16 + bytes([20] + [2] * 15) * 16
    data = by_hand(order, [(256, 3, [20]), (257, 3, [3]), (258, 3, [8]), (259, 3, [1]), (277, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, [("data", 0), ("data", 256)]), (325, 4, [256, 256])], tiles)
    assert page_of(data)[:, :, 0].tolist() == [[*range(1, 17), 20, 22, 24, 26]] * 3
    lzw = bytes.fromhex("800B6050220C0C8501")
    data = by_hand(order, [(256, 4, [5]), (257, 4, [2]), (258, 3, [8]), (259, 3, [5]), (273, 4, [("data", 0)]), (279, 4, [9])], lzw)
    assert page_of(data)[:, :, 0].tolist() == [[45] * 5, [65, 45, 45, 45, 66]]
    data = by_hand(order, [(256, 3, [2]), (257, 3, [2]), (258, 3, [8, 8, 8]), (259, 3, [32773]), (273, 4, [("data", 0), ("data", 2)]), (277, 3, [3]), (278, 3, [1]), (279, 4, [2, 6])], bytes([0xFB, 9, 0x02, 1, 2, 3, 0xFE, 7]))
    assert page_of(data).tolist() == [[[9, 9, 9], [9, 9, 9]], [[1, 2, 3], [7, 7, 7]]]


def malformed():
    base = [(256, 3, [2]), (257, 3, [2]), (258, 3, [8]), (259, 3, [1]), (273, 4, [("data", 0)]), (277, 3, [1]), (278, 3, [2]), (279, 4, [4])]

    def without(tag, *values, kind=3):
        return by_hand("<", sorted([e for e in base if e[0] != tag] + ([(tag, kind, list(values))] if values else [])), bytes(4))

    huge = [(256, 4, [1 << 31]), (257, 4, [1 << 31])]
    return {
        "width 0": without(256, 0), "length 0": without(257, 0), "no width": without(256), "16 bits": without(258, 16), "jpeg": without(259, 7), "short": without(257, 3), "predictor 3": without(317, 3), "rows 0": without(278, 0), "no counts": without(279), "strips": without(273, 1, 2, kind=4), "bit order": without(266, 2),
        "planes": by_hand("<", [(256, 3, [1]), (257, 3, [1]), (258, 3, [8, 8]), (273, 4, [("data", 0), ("data", 1)]), (277, 3, [2]), (279, 4, [1, 1]), (284, 3, [2])], bytes(2)),
        "tile 0": by_hand("<", [(256, 3, [2]), (257, 3, [2]), (258, 3, [8]), (322, 3, [0]), (323, 3, [16]), (324, 4, [8]), (325, 4, [4])], bytes(4)),
        "huge": by_hand("<", huge + [e for e in base if e[0] > 257], bytes(4)), "bad deflate": without(259, 8), "count": by_hand("<", [*base[:4], (273, 4, [8]), (279, 4, [4])], b"")[:60],
    }


def test_malformed_files(spark):
    """Each has a row with its error; the good file among them is read."""
    files = malformed()
    good = by_hand("<", [(256, 3, [2]), (257, 3, [2]), (258, 3, [8]), (273, 4, [("data", 0)]), (279, 4, [4])], b"abcd")
    rows = [(k, 1, x) for k, x in enumerate(files.values())] + [(99, 1, good)]
    got = {r.doc_id: r for r in tiff.decode_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert {name for k, name in enumerate(files) if not got[k].error or got[k].pixels is not None} == set()
    assert bytes(got[99].pixels) == b"abcd" and got[99].error is None


def test_a_small_file_does_not_grow_large():
    bomb = zlib.compress(bytes(50_000_000), 9)
    data = by_hand("<", [(256, 3, [2]), (257, 3, [2]), (258, 3, [8]), (259, 3, [8]), (273, 4, [("data", 0)]), (279, 4, [len(bomb)])], bomb)
    assert page_of(data).shape == (2, 2, 1)
    assert len(tiff.inflate(bomb, 4)) == 4


def brute_media(text):
    """The stored file by its fields, and the feature by counting."""
    data = tiff.payload(text.encode())
    rows = [data[i : i + 192] for i in range(0, len(data), 192)]
    strips = []
    for z in range(0, len(rows), 256):
        plain = b"".join(r[:3] + bytes((r[i] - r[i - 3]) & 255 for i in range(3, 192)) for r in rows[z : z + 256])
        strips.append(zlib.compress(plain, 1))
    mean = sum(data) / len(data)
    spread = (sum((x - mean) ** 2 for x in data) / len(data)) ** 0.5
    shares = [sum(32 * k <= x < 32 * k + 32 for x in data) / len(data) for k in range(8)]
    return strips, f"64x{len(rows)}x3;{mean:.4f};{spread:.4f};" + ",".join(f"{x:.4f}" for x in shares)


def test_op9(spark, docs):
    got = {r.doc_id: r for r in q.op9_tiff_media(spark, SF).collect()}
    media = {r.doc_id: bytes(r.media) for r in tiff.encode_media(docs).collect()}
    for r in docs.collect():
        data, x = tiff.payload(r.text.encode()), got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(r.text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        stored = media[r.doc_id]
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        strips, feature = brute_media(r.text)
        fields = next(iter(tiff.directories(stored)))[1]
        assert [stored[a : a + n] for a, n in zip(fields[tiff.STRIP_OFFSETS], fields[tiff.STRIP_COUNTS], strict=True)] == strips
        assert x.feature == feature


def test_tiff_odd(spark, odd, none):
    media = tiff.encode_media(odd)
    want = Counter((r.doc_id, tiff.payload((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.pixels)) for r in tiff.decode_media(media).collect()) == want
    assert tiff.encode_media(none).count() == 0
    loop = bytearray(tiff.write_tiff([np.zeros((2, 2, 1), np.uint8)]))
    loop[-4:] = loop[4:8]  # the directory names itself as the next
    bad = spark.createDataFrame([(1, 1, None), (2, 1, b"II"), (3, 1, b""), (4, 1, bytes(loop))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in tiff.decode_media(bad).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2].error and got[3].error and got[4].error is None


# 10


def test_op10(spark, docs):
    got = {r.doc_id: r for r in q.op10_language_id(spark, SF).collect()}
    rows = docs.collect()
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.95


def test_spans(spark, docs):
    model = langid.fit(docs)
    texts = {r.lang: r.text[:400] for r in docs.where("length(text) > 600").collect()}
    mixed = texts["en"] + " " + texts["fr"]
    got = langid.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert [s.lang for s in got.spans] == ["en", "fr"]
    assert abs(got.spans[1].start - 401) < 30


def test_letters(spark, docs):
    """Marks alone, digits and signs are no letters; a mark after a letter belongs to its word."""
    model = langid.fit(docs)
    texts = ["\u0301\u0302", "12 \u0301", "!?", "", None, "\u0301le \u0302chat noir", "le chat noir", "le\u0301 chat noir"]
    got = [r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert [(r.lang_pred, r.score, r.spans) for r in got[:5]] == [("und", 0.0, [])] * 5
    assert got[5].lang_pred == got[6].lang_pred and got[5].spans[0].start == 1
    assert got[7].spans[0].end == 13


def brute_labels(model, text):
    """Words by hand, their n-grams counted one by one, and the best path by trying all labels word by word."""
    words_, word = [], ""
    for c in text + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words_.append(word)
            word = ""
    if not words_:
        return "und"
    raw = " ".join(words_).encode()
    f = langid.word_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    scores = model.words(f).astype(np.float64)
    best = {x: (scores[0, x], [x]) for x in range(len(model.langs))}
    for t in range(1, len(scores)):
        best = {x: max(((v - langid.PENALTY * (y != x) + scores[t, x], [*p, x]) for y, (v, p) in best.items()), key=lambda z: z[0]) for x in range(len(model.langs))}
    path = max(best.values(), key=lambda z: z[0])[1]
    letters = Counter()
    for x, w in zip(path, words_, strict=True):
        letters[x] += len(w)
    return model.langs[max(letters, key=lambda x: (letters[x], -x))]


def test_op10_brute(spark, docs):
    model = langid.fit(docs.where(~q.held_out()))
    got = {r.doc_id: r.lang_pred for r in q.op10_language_id(spark, SF).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute_labels(model, r.text), r.doc_id


def test_viterbi():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        scores, penalty = rnd.normal(0, 2, (6, 3)), rnd.uniform(0, 4)
        value = lambda p: sum(scores[t, x] for t, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))  # noqa: E731, B023
        best = max(value(p) for p in np.ndindex(*(3,) * 6))
        assert value(langid.viterbi(scores, penalty)) == pytest.approx(best)


def test_viterbi_two_halves():
    """The third language has the best total, but one switch pays for the gains of both halves."""
    assert langid.viterbi(np.array([[0, 10, -30], [0, -30, 10]], np.float32), 14).tolist() == [1, 2]


def test_language_odd(odd, none):
    model = langid.fit(odd)
    got = Counter((r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect())
    assert all(got[d, "und"] for d in (4, 5, 6, 9, None))
    assert sum(got.values()) == odd.count()
    assert langid.keep_identified(odd, model).columns == odd.columns
    nothing = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
