import random
import re

import corpus_pipeline
from lodestack.llm import sentencepiece_unigram
from lodestack.llm.mixing import capped_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed):
    r = random.Random(seed)
    letters = ["ta", "ri", "mo", "len", "sa", "vor", "ne", "ki", "dul", "of", "Ze"]
    rows, labels = [], []
    for k in range(400):
        if rows and r.random() < 0.3:
            text = r.choice(rows)[1]
            text = r.choice((text, text.replace(" ", "  ", 1), text + " end"))
            good = "#" not in text
        else:
            words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(4, 120))]
            good = r.random() < 0.75
            text = " ".join(words if good else [w + "###" for w in words])
        rows.append((k, text, "en", r.choice("aaab") if k % 50 else None, len(text)))
        labels.append((k, int(good), 0))
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    from test_shingle_dedup import brute

    rows, labels = corpus(3)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = stage(spark, docs, sf)
        assert n == 4 or docs.columns == before
        docs.write.parquet(f"{sf}/out-{n}")
        docs = spark.read.parquet(f"{sf}/out-{n}")
        kept[name] = docs.collect()
    good = {i for i, q, _ in labels if q}
    assert {r.doc_id for r in kept["quality classifier"]} == good
    first = {}
    for i, t, *_ in rows:
        if i in good:
            first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), i)
    assert sorted(r.doc_id for r in kept["exact dedup"]) == sorted(first.values())
    near = brute([(r.doc_id, r.text) for r in kept["exact dedup"]])  # all pairs, by the stage's rule: five words, similarity 0.8
    assert sorted(r.doc_id for r in kept["simhash near-dedup"]) == sorted(set(near.values()))
    sizes, taken = {}, {}
    for stage, into in (("simhash near-dedup", sizes), ("mixing sources", taken)):
        for r in kept[stage]:
            into[r.source] = into.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, capped_targets([sizes[s] for s in order], [1, 2, 3])):
        assert abs(taken[s] - target) <= 60
    mixed = sorted((r.doc_id, r.text) for r in kept["mixing sources"])
    encoder = sentencepiece_unigram.Encoder(sentencepiece_unigram.load_vocabulary())
    assert sorted((r.doc_id, encoder.decode(r.token_ids)) for r in kept["sentencepiece encoding"]) == mixed
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in kept["sentencepiece encoding"])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, kept["sentencepiece encoding"]))


def test_empty_and_odd_documents(spark, tmp_path):
    odd = [(1, None, None, None, None), (1, "", None, None, 0), (None, "a b c d e", "en", "s", 9), (4, "a b c d e", "en", "s", 9)]
    for name, rows in (("odd", odd), ("none", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in got} == ({4} if rows else set())
