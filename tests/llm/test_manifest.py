"""The Merkle manifest against a plain tree, with blocks of several sizes and awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marketlens.llm import manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, pos long, head string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """(root, siblings of each leaf from the bottom, list of lists)."""
    nodes, below, found = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for i in below[k]:
                    found[i].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        below = [sum((below[j] for j in run), []) for run in runs]
        nodes = [sha("".join(nodes[j] for j in run)) for run in runs]
    return nodes[0], found


def brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, row["text"]), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs}
    root, above = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, upper in zip(langs, above):
        subroot, witnesses = trees[lang]
        for (_, _, leaf, row), lower in zip(sorted(by_lang[lang], key=lambda x: x[:3]), witnesses):
            text = row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(row, text)
            for left, right in lower + upper:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in lower + upper))
            out.append((row["doc_id"], leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_query_equals_plain_tree(spark, small_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    found = queries.op11_merkle_manifest(spark, small_dir)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
    assert {r["verified"] for r in found.select("verified").distinct().collect()} == {True, False}


def documents(n):
    """Languages of very different size, null, empty and odd ones; ids that tie, are null or negative."""
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else [None, "", "de", "é", "z"][i % 5]
        doc_id = None if i % 17 == 0 else 7 if i % 5 == 0 else -i
        text = [None, "", "Ab\n", f"Text {i % 4} É", "x" * 3000][i % 5]
        rows.append((doc_id, text, lang, None if i % 4 == 0 else f"s:{i}", None if i % 7 == 0 else i % 3, "t", "n", 3, "h"))
    return rows


def built(df):
    leaf = manifest.row_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    return manifest.build(df.withColumn("leaf", leaf), F.col("lang"), [F.col("doc_id")], F.col("leaf"), keep=["doc_id", "node", "tree"])


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_blocks_and_awkward_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 8**levels)
    rows = documents(700)
    df = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(5)
    leaf = manifest.row_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    found = manifest.verify(
        manifest.build(df.withColumn("leaf", leaf), F.col("lang"), [F.col("doc_id")], F.col("leaf"), keep=["doc_id", "node"])
    ).collect()
    plain = brute([r.asDict() for r in df.collect()])
    assert sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], sha(r["witness"])) for r in found if r["doc_id"] is not None) == sorted(
        p[:5] for p in plain if p[0] is not None
    )
    assert sorted(sha(r["witness"]) for r in found) == sorted(p[4] for p in plain)
    assert all(r["verified"] for r in found) and {r["node"] for r in found} == {"n"}
    assert all(0 <= r["pos"] < r["n"] and 0 <= r["place"] < r["places"] == 6 for r in found)


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_small_trees(spark, n):
    df = spark.createDataFrame([(i, "A", "en", "s", 1, "t", "n", 3, "h") for i in range(n)], SCHEMA)
    found = manifest.verify(manifest.build(df, F.col("lang"), [F.col("doc_id")], F.sha2("text", 256))).collect()
    root, _ = tree([sha("A")] * n)
    assert [r["root"] for r in found] == [root] * n and all(r["verified"] for r in found)
    assert n > 1 or found[0]["witness"] == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = manifest.verify(manifest.build(df, F.col("lang"), [F.col("doc_id")], F.sha2("text", 256), keep=["doc_id"]))
    assert found.collect() == [] and "folded_root" in found.columns


def test_tampered_rows_are_found(spark):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", 1, "t", "n", 3, "h") for i in range(30)], SCHEMA)
    whole = manifest.build(df, F.col("lang"), [F.col("doc_id")], F.sha2("text", 256), keep=["doc_id"])
    changed = whole.withColumn("seen", F.when(F.col("doc_id") % 2 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf")))
    assert {(r["doc_id"] % 2, r["verified"]) for r in manifest.verify(changed, "seen").collect()} == {(0, False), (1, True)}
