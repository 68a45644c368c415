"""The pipeline against a brute-force version of its stages, on a small fixture."""

import random

import corpus_pipeline
from tests.llm.test_operators_llm import brute_contamination, brute_fingerprint, lower, union_find


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    words = [a + b for a in ("the", "and", "ing", "er") for b in ("ab", "ti", "ou", "en", "sh")]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(20, 200))) for _ in range(40)]
    item = " ".join(r.choice(words) for _ in range(15))
    texts += [texts[0], texts[1].upper(), texts[2] + " zz", None, "", "12 34", texts[5] + " " + item, item[: len(item) // 3]]
    texts += [texts[i] + " " + " ".join("new" + r.choice(words) for _ in range(len(texts[i].split()) // 8)) for i in range(8, 14)]  # similar, but for a passage at the end
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, t) for i, t, *_ in data if any(map(str.isalpha, t or ""))]
    keep = {}
    for i, t in left:
        keep[lower(t)] = i
    left = [(i, t) for i, t in left if keep[lower(t)] == i]
    prints = {i: brute_fingerprint(t) for i, t in left}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in left for w in [lower(t).split()]}
    alike = {(a, b) for a in prints for b in prints if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])}
    by_print = {(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3}
    assert {a for a, b in alike - by_print if a > b} >= {48, 50}
    root = union_find(prints, alike | by_print)
    left = [(i, t) for i, t in left if root[i] == i]
    left = [(i, t) for (i, t), w in zip(left, brute_contamination([t for _, t in left], [(1, item)])) if not w[4]]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in got.collect()} == {i for i, _ in left}
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name
