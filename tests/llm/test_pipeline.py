"""The pipeline against plain versions of its stages on the smallest tables."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests_llm_helpers import brute_components, naive_score
from tokenizers import Tokenizer
from vesselwatch.llm.pii import pseudonymise
from vesselwatch.llm.quality import train

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    net = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {k: naive_score(net, (t or "").encode()) for k, t in rows}
    assert all(abs(s - 0.3) > 1e-4 for s in scores.values())  # none is so close that rounding decides
    good = [(k, t) for k, t in rows if scores[k] >= 0.3]
    kept = {k for k, (_, _, first) in brute_components(good, 5, 80).items() if first}
    replaced = {r["doc_id"]: r["text"] for r in pseudonymise(docs, corpus_pipeline.PII_KEY).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {k: np.array([*tokenizer.encode(replaced[k] or "", add_special_tokens=False).ids, 1], "<u4") for k in kept}

    at, sequences = defaultdict(int), defaultdict(list)
    for p in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda p: (p["doc_id"], p["start"])):
        ids = tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(tokens[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(ids.tobytes())
        at[p["doc_id"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert dict(at) == {k: len(v) for k, v in tokens.items()}
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 2048 and [o for o, _ in sorted(parts)] == [sum(n for o2, n in parts if o2 < o) for o, _ in sorted(parts)]


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
