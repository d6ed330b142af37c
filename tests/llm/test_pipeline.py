from collections import Counter

import corpus_pipeline
from tidegrid.llm import bpe, near_dedup

from .conftest import SF, row
from .test_operators import brute_components, brute_mix, words


def test_stages(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.identify_language(spark, docs, SF)
    assert first.columns == docs.columns
    kept = first.collect()
    assert len(kept) >= 0.98 * len(rows)
    second = corpus_pipeline.drop_near_duplicates(spark, first, SF)
    want = {c for d, n, c in brute_components([(r.doc_id, r.text) for r in kept], 5) if n}
    assert {r.doc_id for r in second.collect()} == want
    third = corpus_pipeline.mix_sources(spark, second, SF).collect()
    size, target = brute_mix(second.collect())
    took = Counter()
    for r in third:
        took[r.source] += len(words(r.text))
    longest = max(len(words(r.text)) for r in second.collect())
    assert all(abs(took[s] - t) <= longest for s, t in target.items())
    last = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in third)
    vocab = bpe.vocabulary(corpus_pipeline.BYTE_BPE)
    assert all(b"".join(vocab.tokens[i] for i in r.token_ids).decode() == rows[r.doc_id].text for r in last)


def test_odd(spark, odd, none):
    left = {}
    for label, table in (("odd", odd), ("none", none)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            left[label, name] = docs.collect()
            if name != "byte_bpe":
                assert docs.columns == table.columns
    assert not any(rows for (label, _), rows in left.items() if label == "none")
    texts = {r.text for r in left["odd", "language_id"]}
    assert not texts & {None, "", " \n\t ", "12 34 !?"}  # no letters
    before, after = left["odd", "language_id"], left["odd", "near_dedup"]
    assert {r.text for r in after} <= texts
    assert len(after) == len(brute_components([(k, r.text) for k, r in enumerate(before)], 5).keys() & {(k, n, k) for k, n, _ in brute_components([(k, r.text) for k, r in enumerate(before)], 5)})
    assert {r.text for r in left["odd", "source_mixing"]} <= {r.text for r in after}
    assert len(left["odd", "byte_bpe"]) == len(left["odd", "source_mixing"])
