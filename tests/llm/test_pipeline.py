"""The pipeline on a small corpus, against what each stage must do."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from seqlake.llm import packing


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}{rng.randrange(900)}lm" for _ in range(n))
    clean = {n: prose(rng.randrange(30, 200)) for n in range(60)}
    item = prose(40)
    rows = dict(clean)
    rows |= {100: clean[3], 101: clean[4], 102: clean[4], 110: "12 34 !!", 111: None}
    rows |= {120: f"{prose(50)} {item} {prose(50)}", 130: f"{clean[5]} password = abcdefghijklmnop", 140: prose(900)}
    frame = spark.createDataFrame([(n, t, "en", "s", len(t or "")) for n, t in rows.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert set(texts) - {130} == set(clean) | {140}
    assert all(texts[n] == (t, len(t)) for n, t in clean.items())
    if 130 in texts:  # unless its fingerprint is that of the text it extends
        assert texts[130][0] == f"{clean[5]} password = [SECRET]" and texts[130][1] == len(texts[130][0])

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    sizes = {n: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for n, (t, _) in texts.items()}
    found = {}
    for r in pieces:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == sizes
    filled = np.bincount([r["sequence_id"] for r in pieces], weights=[r["length"] for r in pieces])
    assert filled.max() <= packing.SIZE and len(filled) <= -(-sum(sizes.values()) // packing.SIZE) + 1
