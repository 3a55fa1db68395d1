"""The pipeline stage by stage against plain versions of its decisions."""

from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers

from test_operators import components, rows, shingles, squeeze


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(rows(40, seed=3), "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for _, stage in pipeline.STAGES:
        out = pipeline.stash(stage(spark, seen[-1], ""), "test-stage")
        seen.append(out)
    for out in seen[1:-1]:
        assert out.columns == docs.columns
    texts = [[(r.doc_id, r.text) for r in s.collect()] for s in seen[:-1]]
    assert Counter(texts[1]) == Counter((i, t) for i, t in texts[0] if any(c.isalpha() for c in t or ""))
    first = {}
    for i, t in texts[1]:
        key = squeeze(t)
        if key not in first or (i is not None and (first[key] is None or i < first[key])):
            first[key] = i
    assert sorted(map(str, first.values())) == sorted(str(i) for i, _ in texts[2])
    roots = components([shingles(t) for _, t in texts[2]], 85)
    best = {}
    for (i, _), root in zip(texts[2], roots, strict=True):
        if i is not None:
            best[root] = min(best.get(root, i), i)
        else:
            best.setdefault(root, 10**9)
    assert sorted(i for i, _ in texts[3] if i is not None) == sorted(i for i in best.values() if i < 10**9)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts[4])
    assert seen[-1].toPandas()["length"].sum() == want and np.all(seen[-1].toPandas().groupby("sequence_id")["length"].sum() <= 2048)


def test_run_over_a_table(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns[0] == "doc_id"
