"""The corpus pipeline, stage by stage, against plain versions."""

import zlib
from fractions import Fraction

import brute
import numpy as np
import public_tokenizers
from test_operators import texts
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tmp_path):
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}", len(t or "")) for i, t in texts(40)]
    rows.append((500, "12 !? 34", "xx", "s1", 8))
    items = [(0, next(t for _, t in reversed(texts(40)) if 12 <= len(t.split()) <= 60)), (1, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, results = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        results.append(docs)
    left = [(r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(r["doc_id"] for r in results[0].collect()) == [i for i, _ in left]
    left = [(i, t) for i, t in left if (i, i) in {(a, c) for a, _, c in brute.groups(left, 5, Fraction(4, 5))}]
    assert sorted(r["doc_id"] for r in results[1].collect()) == [i for i, _ in left]
    gone = {d for d, _ in brute.leaks(left, items)}
    left = [(i, t) for i, t in left if i not in gone]
    assert gone and sorted(r["doc_id"] for r in results[2].collect()) == [i for i, _ in left]
    assert all(r.columns == ["doc_id", "text", "lang", "source", "n_chars"] for r in results[:4])
    mixed = sorted((r["doc_id"], r["text"]) for r in results[3].collect())
    assert set(mixed) <= set(left) and all(mixed.count(row) <= 3 for row in set(mixed))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text in mixed:
        content = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((doc_id, start, len(content) // 4, zlib.crc32(content)))
        start += len(content) // 4
    assert sorted(tuple(r) for r in results[4].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
