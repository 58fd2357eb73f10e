"""Every operator against a plain version, on a small table and on awkward rows."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from marketlens.llm import (
    decontamination,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    queries,
    set_join,
    storage,
    token_counts,
    token_files,
    topk,
    url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, size int, key string, `_row` int"


def texts(n=60, seed=5):
    """Short documents over few words, with copies, near copies, shared lines, nulls and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "Only three words"), (4, "only Three words")]
    while len(rows) < n:
        if rng.random() < 0.4 and len(rows) > 8:
            base = rng.choice(rows[5:])[1].split(" ")
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            text = " ".join(base)
        else:
            text = " ".join(rng.choice(vocabulary) + ("\n" if rng.random() < 0.08 else "") for _ in range(rng.randint(1, 90)))
        rows.append((len(rows), text))
    return rows


def table(spark, rows, **columns):
    """Documents with columns whose names the operators use inside."""
    full = [(i, t, columns.get("lang", "xx"), f"s{(i or 0) % 4}" if i != 7 else None, 1, "k", 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(params=[(128, 8192, 32), (2, 40, 1), (1, 2, 2)], ids=["runs", "copies", "leader"])
def run_limits(request, monkeypatch):
    """The ways in which frequent signatures are handled."""
    monkeypatch.setattr(set_join, "RUN", request.param[0])
    monkeypatch.setattr(set_join, "HELD", request.param[1])
    monkeypatch.setattr(set_join, "CARRIED", request.param[2])


def test_ngram_join(spark, run_limits):
    rows = texts()
    got = sorted(tuple(r) for r in ngram_join.link_documents(table(spark, rows), 4).collect())
    assert got == brute.groups(rows)
    assert len({c for _, _, c in got}) < len(got)


@pytest.mark.parametrize("carried", [1, 2, 32])
def test_open_pairs_meet_once_and_lose_none(spark, monkeypatch, carried):
    """Sets that share a signature meet; those that share one of the first that both carry meet there only."""
    monkeypatch.setattr(set_join, "CARRIED", carried)
    rng = random.Random(carried)
    bears = {key: rng.sample(range(12), rng.randint(1, 6)) for key in range(60)}
    rows = [(s, key, 100, [0, 0], key) for key, signatures in bears.items() for s in signatures]
    bearers = spark.createDataFrame(rows, "signature long, key long, size int, bits array<long>, root long")
    got = set_join.open_pairs(bearers, 2, Fraction(4, 5), F.col("a.root") < F.col("b.root"))
    want = {(a, b) for a in bears for b in bears if a < b and set(bears[a]) & set(bears[b])}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_long_run_is_not_compared_pair_by_pair(spark):
    """20,000 different sets of one signature: one comparison each, wherever the run ends in the buffer."""
    rows = [(1, i, i, 10, 0, i) for i in range(20_000)] + [(2, 50_000 + i, 50_000 + i, 10, 0, 7) for i in range(3)]
    found = set_join.candidates(spark.createDataFrame(rows, set_join.POSTINGS), Fraction(4, 5))
    counts = {r["frequent"]: r["count"] for r in found.where("a = b").groupBy("frequent").count().collect()}
    assert counts == {1: 20_000}
    assert found.where("a <> b and a >= 50000").count() == 3
    assert found.where("a <> b and a < 50000").count() < 20_000


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies that differ in two words near each other: a quarter of all pairs link; the pairs compared grow as the copies do."""
    monkeypatch.setattr(set_join, "RUN", 8)
    monkeypatch.setattr(set_join, "leader_pairs", lambda bearers: bearers.limit(0).select(F.col("key").alias("a"), F.col("key").alias("b")))
    monkeypatch.setattr(ngram_join, "LEADERS", 8, raising=False)
    compared = []
    verified = set_join.verified

    def counted(pairs, *others):
        compared.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(set_join, "verified", counted)
    rows = []
    for i in range(240):
        words = [f"v{k}" for k in range(120)]
        at = 40 + (i * 7) % 60
        words[at : at + 2] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in ngram_join.link_documents(table(spark, rows)).collect())
    assert got == brute.groups(rows)
    assert got[-1][2] == 0
    assert sum(compared) < 20 * len(rows)


def test_ngram_join_with_frequent_tokens(spark, monkeypatch):
    """Every token counts as frequent: large sets meet by pairs of tokens only."""
    monkeypatch.setattr(ngram_join, "slots_of", lambda tokens: np.zeros(len(tokens), np.int64))
    rng = random.Random(3)
    base = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(12):
        own = list(base)
        for _ in range(i):
            own[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    got = sorted(tuple(r) for r in ngram_join.link_documents(table(spark, rows)).collect())
    assert got == brute.groups(rows)


def test_ngram_join_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None), (9, "")]
    got = [tuple(r) for r in ngram_join.link_documents(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (9, 0, 9)], key=str)
    kept = ngram_join.keep_first(table(spark, rows), 4, Fraction(85, 100))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.select("doc_id", "text").collect() if r["text"]) == [(5, "a b c d e")]
    assert kept.columns == table(spark, rows).columns
    assert ngram_join.link_documents(table(spark, [])).count() == 0


def test_line_dedup(spark, run_limits):
    rows = texts(seed=8)
    got = sorted(tuple(r) for r in line_dedup.remove_similar_lines(table(spark, rows)).collect())
    assert got == brute.without_similar_lines(rows)
    assert sum(r[2] for r in got) > 3


def test_line_dedup_awkward_rows(spark):
    line = "one two three four five six"
    rows = [(None, line), (3, f"{line}\n{line.upper()}"), (3, f"{line}\n{line.upper()}"), (4, None), (5, "")]
    got = sorted((tuple(r) for r in line_dedup.remove_similar_lines(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 1, 1, ""), (3, 2, 1, line), (3, 2, 1, line), (4, 0, 0, None), (5, 1, 0, "")], key=str)
    assert line_dedup.remove_similar_lines(table(spark, [])).count() == 0


def test_line_dedup_keeps_unique_lines_of_rows_that_share_an_id(spark):
    line, own, other = "alpha beta gamma delta epsilon zeta", "one two three four five unique", "seven eight nine ten eleven twelve"
    rows = [(1, line), (None, line), (None, own), (5, f"{line}\n{other}"), (5, f"{own} \n{line}")]
    got = [r["text"] for r in line_dedup.remove_similar_lines(table(spark, rows)).collect()]
    left = [x.strip() for text in got for x in text.split("\n") if x.strip()]
    assert sorted(left) == sorted([line, own, other])


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40)))) for k in range(15)] + [(20, None), (21, "a b"), (22, "x " * 12)]
    docs = [(0, None), (1, ""), (None, items[3][1])]
    for i in range(2, 60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            passage = items[i % 15][1].split(" ")
            if i % 2:
                passage[rng.choice([0, -1])] = "other"
            w[len(w) // 2 : len(w) // 2] = passage
        docs.append((i, ("; " if i % 4 else " ").join(w).title()))
    docs += [(100, "x " * 40), (100, "x " * 40)]
    benchmark = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    found = decontamination.find_leaks(table(spark, docs), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute.leaks(docs, items)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found}) > 15
    plan = decontamination.find_leaks(table(spark, docs), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    kept = decontamination.clean_documents(table(spark, docs), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {r["doc_id"] for r in found}
    assert decontamination.find_leaks(table(spark, []), benchmark).count() == 0
    assert decontamination.find_leaks(table(spark, docs), benchmark.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7) if i % 11 else None) for i in range(400)] + [(3, "a b c"), (3, "a b c"), (None, "z")]
    small = table(spark, rows).withColumn("source", F.when(F.col("doc_id") % 40 == 5, "tiny").otherwise(F.col("source")))
    got = [r.asDict() for r in mixing.mix(small).collect()]
    assert len(got) == len(rows)
    sources = {r["source"]: r for r in got}
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    sizes = {s: sources[s]["source_size"] for s in order}
    total = sum(r["size"] for r in got)
    assert total == sum(len(brute.words(t)) for _, t in rows) == sum(sizes.values())
    clamped = set()
    while True:
        level = (total - sum(3 * sizes[s] for s in clamped)) / sum(weight[s] for s in order if s not in clamped)
        above = {s for s in order if weight[s] * level > 3 * sizes[s]} | clamped
        if above == clamped:
            break
        clamped = above
    assert "tiny" in clamped
    for s in order:
        target = 3 * sizes[s] if s in clamped else weight[s] * level
        assert abs(sources[s]["target"] - target) < 1e-9 * total
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - target) <= 9  # not much more than a document
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(small.repartition(7)).select("doc_id", "taken", "target").collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(small).select("doc_id", "taken", "target").collect()))
    assert mixing.mix(table(spark, [])).count() == 0


def mixed_words(rows):
    """Per source: (target, taken words, largest document)."""
    out = {}
    for r in rows:
        target, taken, most = out.get(r["source"], (r["target"], 0, 0))
        out[r["source"]] = (target, taken + r["taken"], max(most, r["size"]))
    return out


@pytest.mark.parametrize("sorted_rows", [1 << 14, 3])
def test_mixing_cuts_inside_ties(spark, monkeypatch, sorted_rows):
    """Sources whose rows share an id, have none, or are alike altogether still reach their targets."""
    monkeypatch.setattr(mixing, "SORTED", sorted_rows)
    rows = [("a", None, f"text {i} of no id" + " more" * (i % 4)) for i in range(200)]
    rows += [("b", 7, f"text {i} of one id") for i in range(250)]
    rows += [("c", 9, "the very same four") for _ in range(240)]
    rows += [("d", i, f"an own text {i}") for i in range(250)]
    docs = spark.createDataFrame([(s, i, t) for s, i, t in rows], "source string, doc_id long, text string").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for target, taken, most in mixed_words(got).values():
        assert abs(taken - target) <= most / 2 + 1e-6
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r["source"], r["text"], r["taken"]) for r in again) == sorted((r["source"], r["text"], r["taken"]) for r in got)


def test_mixing_keeps_columns_of_any_name(spark):
    names = "order no rest last whole start plan_source tie bucket words n doc pos copies among cut_order cut_tie upto own before".split()
    docs = table(spark, [(i, "w " * (1 + i % 5)) for i in range(60)])
    wide = docs.select("*", *(F.lit(f"is {x}").alias(x) for x in names))
    got = mixing.mix(wide)
    assert set(names) < set(got.columns) and got.where(" and ".join(f"`{x}` = 'is {x}'" for x in names)).count() == 60
    kept = mixing.repeated(docs.drop("size").select("*", *(F.lit(-1).alias(x) for x in ("size", "source_size", "target", "repeats", "taken", "copy"))))
    taken = mixing.mix(docs).agg(F.sum("repeats")).first()[0]
    assert kept.where("size = -1 and taken = -1 and copy = -1").count() == taken == kept.count()


def test_token_counts_and_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a<|endoftext|>", "naïve  café\n\n 12³ ¼", "日本語 テキスト", "\x1c \x1f\x85 x", "it's we'LL", "a" * 50_000]
    rows = [*texts(30), *((200 - i, t) for i, t in enumerate(odd)), (300, "same"), (300, "same"), (None, "last")]
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    counted = token_counts.count_tokens(table(spark, rows), path, entries=20).collect()
    assert sorted(map(str, counted)) == sorted(
        f"Row(doc_id={i}, n_bytes={len((t or '').encode())}, n_tokens={len(ids[t])}, over_limit={len(ids[t]) > 512})" for i, t in rows
    )
    manifest = token_files.write_token_files(table(spark, rows), str(tmp_path / "files"), path, shards=5)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect())
    tasks = token_files.read_token_files(manifest).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1 or manifest.count() == 1
    start = 0
    for row, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        content = np.array([*ids[text], 0], "<u4").tobytes()
        assert row == (start, doc_id, len(content) // 4, zlib.crc32(content))
        start += len(content) // 4
    file = manifest.orderBy("shard").first()["path"]
    assert list(token_files.read_documents(file, [3])[3]) == [*ids["Only three words"], 0]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(file, "rb"), read_across_frames=True).read()
    assert len(whole) == 4 * manifest.orderBy("shard").first()["tokens"]
    damaged = bytearray(open(file, "rb").read())
    damaged[9] ^= 255
    (tmp_path / "damaged").write_bytes(damaged)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.read_documents(str(tmp_path / "damaged"), [0, 1, 2, 3])
    assert token_counts.count_tokens(table(spark, []), path).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(table(spark, []), str(tmp_path / "none"), path)).count() == 0


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(table(spark, texts(20)), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(processor.encode(t or "")) for i, t in texts(20)}


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * 0.3)], 0) for i in range(300)]
    rows += [(400 + i, rows[50][1], 1) for i in range(40)]  # ties
    rows += [(600, None, 0), (601, [None] * 6, 0), (602, [float("nan")] * 6, 0), (650, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    fit = {i: np.floor(256 * np.array(np.float32(v), float)).astype(int) for i, v, _ in rows if i is not None and i < 600}
    want = []
    for q in sorted(i for i in fit if i % 50 == 0):
        best = sorted((-int(fit[q] @ fit[v]), v) for v in fit if v != q)[:5]
        want += [(q, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.search(df).collect()) == want
    few = df.where("vec_id in (0, 1, 2)")
    assert [r["vec_id"] for r in topk.search(few).collect()] and topk.search(few).count() == 2
    assert topk.search(df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Scores of all 64 bits, and own rows whose score no long holds."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    rows[50] = (50, [1e7, 0.25, -3.0])
    rows[51], rows[52], rows[53] = (51, [1.2e7, 1.0, 2.0]), (52, [-1.2e7, 0.0, 0.5]), (53, [1.2e7, 1.0, 2.5])
    rows[100] = (100, [2.0, -1e13, 1.0])  # its own score is beyond a long
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        best = sorted((-sum(x * y for x, y in zip(whole[q], whole[v], strict=True)), v) for v in whole if v != q)[:5]
        want += [(q, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    assert max(s for *_, s in want) > 2**62
    assert sorted(tuple(r) for r in topk.search(df).collect()) == want
    beyond = df.union(spark.createDataFrame([(200, [1e300, 0.0, 0.0])], df.schema))
    with pytest.raises(Exception, match="does not fit into a long"):
        topk.search(beyond).collect()


def test_language_id(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/../sf0.01/documents.parquet")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    odd = docs.select("doc_id", "text", "lang").limit(50).union(
        spark.createDataFrame([(-1, None, "en"), (-2, "123 !", "en"), (None, "the and of", None), (-3, "the", "en")], "doc_id long, text string, lang string")
    )
    rows = {r["doc_id"]: r for r in language_id.identify_languages(odd).collect()}
    assert (rows[-1]["lang_pred"], rows[-1]["score"], rows[-2]["lang_pred"]) == ("und", 0.0, "und")
    assert rows[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[-3]["held_out"] == (zlib.crc32(b"-3") % 4 == 2)
    none = language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_id.identify_languages(odd.limit(0)).count() == 0
    assert {r["doc_id"] for r in language_id.keep_known(odd, 0.0).collect()}.isdisjoint({-1, -2})


def test_url_filter(spark, small_dir):
    cases = {
        "https://A.Example.ORG/es/x?y=1": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/1#a": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.org": ("x.org", "", None, None),
        "x://y://z.org/": ("y:", "//z.org/", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    extra = spark.createDataFrame([(1000 + i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    pages = spark.read.parquet(f"{small_dir}/../sf0.01/pages.parquet").select("page_id", "url", F.lit("h").alias("host"))
    got = {r["page_id"]: r for r in url_filter.judge(pages.union(extra)).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        row = got[1000 + i]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")
    assert len(got) == pages.count() + len(cases)
    # the trees by themselves, on labels they were trained with and on others
    ruled = [r for r in got.values() if r["rule"]]
    assert sum((r["score"] > 0.5) == (r["verdict"] == "block") for r in ruled) / len(ruled) > 0.9
    assert {r["verdict"] for r in url_filter.judge(extra.where("url = 'no scheme'")).collect()} == {"allow"}
    assert url_filter.judge(extra.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p><b>bo</b>ld<br>next<p>x &lt; y<script>var a="</p>";</script>
<aside>side</aside><form><input>go</form><div class="comments"><p>nice!</p></div><p>end</article><div class="sidebar">s</div><footer>f</footer>"""


def test_html_extraction(spark):
    assert html_extract.extracted([PAGE, None, "", "<p", "plain  text"]) == ["A & B bold next x < y end", "", "", "", "plain text"]
    common = "all rights of this site are reserved by its owner and publisher"
    pages = [(i, "http://h.org/", f"<div>unique {' '.join(f'u{i}x{k}' for k in range(9))}</div><div>{common}</div>", "t") for i in range(6)]
    pages += [(9, "http://h.org/", f"<article><p>{common}</p></article>", "t"), (10, None, None, "t"), (11, "http://h.org/", "", "t"), (9, "http://h.org/", "<p>again</p>", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    want = [(i, t := f"unique {' '.join(f'u{i}x{k}' for k in range(9))}", len(t)) for i in range(6)]
    assert got == sorted([*want, (9, common, len(common)), (9, "again", 5), (10, "", 0), (11, "", 0)])
    assert html_extract.extract(df.limit(0)).count() == 0
    assert html_extract.extract(df).count() == len(pages)


def test_names_of_blocks_are_whole_and_never_remove_the_article():
    text = lambda html: html_extract.marked_text(html_extract.blocks_of(html))
    assert text('<article class="post share-buttons-on"><p>kept</p></article>') == "kept"
    assert text('<main id="comments"><div class="banner-free content">kept</div><div class="banner">gone</div></main>') == "kept"
    assert text('<div role="main" class="social">kept <div class="social-science">too</div><div class="big social">gone</div></div>') == "kept too"
    assert text('<article>kept<div id="cookie_banner">gone</div><div class="cookie-banner x">gone</div></article>') == "kept"
    assert text('<nav><article>gone</article></nav><article>kept</article>') == "kept"
    assert html_extract.extracted(["<div>three word page</div>"]) == ["three word page"]
    assert html_extract.extracted([]) == []


def test_repeated_runs_against_brute_force():
    rng = random.Random(1)
    pages = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    import pyarrow as pa

    from marketlens.llm import hashing

    streams = [hashing.hashed_words(d, o) for p in pages for _, _, d, o in hashing.chunks(pa.array([p]))]
    size, seen = html_extract.RUN, {}
    split = [p.split() for p in pages]
    for w in split:
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), set()).add(tuple(w))
    for w, covered in zip(split, html_extract.repeated(streams), strict=True):
        want = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if len(seen[tuple(w[k : k + size])]) >= html_extract.PAGES:
                want[k : k + size] = True
        assert want.tolist() == covered.tolist()


def test_every_query_runs(spark, small_dir):
    for name, query in queries.QUERIES.items():
        assert query(spark, small_dir).count() > 0, name


def test_rows_without_id_are_kept_and_dropped_one_by_one(spark):
    copy, leak = "a b c d e f g h", "one two three four five six seven"
    rows = [(1, copy), (None, copy), (None, "quite another text of this table"), (None, "p q r s t u"), (None, "p q r s t u")]
    rows += [(7, copy), (7, "same id but its very own text"), (8, "x1 x2 x3 x4 x5"), (8, "y1 y2 y3 y4 y5"), (8, "y1 y2 y3 y4 y5"), (None, None), (None, "")]
    want = [rows[i] for i in (0, 2, 3, 6, 7, 8, 10, 11)]
    kept = ngram_join.keep_first(table(spark, rows), 4, Fraction(85, 100))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    benchmark = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows += [(None, f"and {leak} eight"), (8, leak)]
    clean = decontamination.clean_documents(table(spark, rows), benchmark)
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(rows[:-2], key=str)


def test_url_statistics_cover_all_rows(spark, monkeypatch):
    urls = [f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(60)] + ["http://open.net/x/1"] * 20
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    counted = []
    plain = url_filter.with_statistics
    monkeypatch.setattr(url_filter, "with_statistics", lambda *a: counted.append(plain(*a)) or counted[-1])
    got = url_filter.judge(df, sample=4).collect()
    assert len(got) == len(urls)
    rows = {r["url"]: r for r in counted[-1].collect()}
    assert rows["http://open.net/x/1"]["folder_share"] == 0.25 and rows["http://open.net/x/1"]["suffix_blocked"] == 0.5
    assert rows["http://h1.com/de/1"]["folder_blocked"] == 30.5 / 31 and rows["http://h2.com/fr/2"]["folder_blocked"] == 0.5 / 31


def test_url_sample_of_different_urls(spark):
    """One URL on most rows does not fill the sample; a sample of one kind gets some of the other."""
    for hot in ("http://a.com/de/1", "http://a.com/fr/1"):
        urls = [hot] * 200 + [f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(60)] + ["http://n.net/de/5", "http://n.net/fr/6"]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        for size in (1, 40):
            got = {r["host"] + r["path"]: r["verdict"] for r in url_filter.judge(df, sample=size).collect()}
            assert len({got["n.net/de/5"], got["n.net/fr/6"]}) == 2 or size == 1


def test_texts_in_no_learned_language_go(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/../sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)

    def text(letters, words):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(words))

    greek, latin = "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"
    odd = [(-1, text(greek, 300), None), (-2, text(greek, 1000), "en"), (None, text(greek, 200), "de"), (-4, text(latin, 500), None), (-5, "und", None)]
    kept = language_id.keep_known(docs.union(spark.createDataFrame(odd, docs.schema)), 0.0).collect()
    assert {r["doc_id"] for r in kept if r["doc_id"] is None or r["doc_id"] < 0} == {-5}
    gone = [r["text"] for r in set(docs.collect()) - set(kept) if any(c.isalpha() for c in r["text"] or "")]
    assert len(gone) <= 1 and all(len(set(t.split())) < 0.1 * len(t.split()) for t in gone)  # endless repeats of a few words


def test_short_lines_are_deduplicated(spark, run_limits, tmp_path):
    lines = ["share", "Menu Home", "a b c d", "a b c d e", "ha ha ha ha", "", " ", "a b c", "menu  home", "p q r s t", "p q r s", "Ha", "x y z w v u"]
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(4))) for i in range(20)] + [(30, None), (31, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect())
    assert got == brute.without_similar_lines(rows, least=1)
    assert brute.without_similar_lines([(0, "a b c d\na b c d e")], least=1)[0][2] == 1  # four of five words


def test_repeats_count_over_the_whole_host(spark):
    """A run on few of many pages, with copies and marked pages among them, whatever the bytes of the host."""
    common = "all rights of this site are reserved by its owner and publisher"
    pages = [f"<div>{' '.join(f'u{i}x{k}' for k in range(12))}</div>{f'<p>{common}</p>' if i % 20 == 0 else ''}" for i in range(80)]
    pages += [pages[1]] * 60 + [f"<article>{common}</article>"]
    rows = [(i, "http://h.org/", h) for i, h in enumerate(pages)]
    want = sorted(enumerate(html_extract.extracted(pages)))
    assert want[0][1] == " ".join(f"u0x{k}" for k in range(12)) and want[-1][1] == common
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract(df).collect()) == want


def test_short_benchmark_items(spark):
    items = [(1, "Two words"), (2, "two WORDS!"), (3, "alone"), (4, "this has four words"), (5, ""), (6, None), (7, "absent here")]
    docs = [(1, "x two words, and two words"), (2, "alone"), (None, "this has four words"), (4, "two other words"), (5, None), (6, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(table(spark, docs), benchmark).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, 1, 2, 0, 1.0), (2, 3, 0, 1, 0, 1.0), (None, 4, 0, 4, 0, 1.0)], key=str)


def test_a_packed_bitmap_marks_what_an_unpacked_one_does(spark):
    from marketlens.llm import set_join

    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys[:2000]] + [(None,)], "key long")
    want = np.zeros(1 << 12, bool)
    want[set_join.places(keys[:2000], len(want))] = True
    found = set_join.key_filter(df, "key", bits=1 << 12)
    assert (found == want).all()
    assert (set_join.marked(keys, np.packbits(found)) == found[set_join.places(keys, len(found))]).all()


def test_rare_ngrams_come_first(spark):
    """A passage of 60 documents, too few for a frequent one: their own n-grams come first and match nothing."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"u{rng.random()}" for _ in range(60)) + " " + passage) for i in range(60)]
    docs = table(spark, rows)
    slots = ngram_join.slots_for(len(rows))
    counts = ngram_join.added_up(ngram_join.profiles(docs, 4, slots).where("slice is not null").select("slice", "counts"), slots)
    assert counts.sum() == 60 * 97
    found = ngram_join.postings(docs, 4, Fraction(85, 100), ngram_join.ranks_of(counts), 255)
    assert found.groupBy("signature").count().where("count >= 60").count() == 0
    assert [c for _, _, c in sorted(tuple(r) for r in ngram_join.link_documents(docs).collect())] == list(range(60))


def test_counters_follow_the_documents():
    assert [ngram_join.slots_for(n) for n in (0, 1 << 16, (1 << 16) + 1, 1 << 40)] == [1 << 18, 1 << 18, 1 << 19, 1 << 22]


def test_token_encoder_serves_later_tasks(monkeypatch):
    """Pre-tokens that a task of the process has encoded are not encoded again; a small table gives the same ids."""
    with open(queries.public_tokenizers.path(queries.TOKENIZER), encoding="utf-8") as file:
        model = file.read()
    plain = token_files.Tokenizer.from_str(model)
    some = [text or "" for _, text in texts()] + ["", "one <|endoftext|> two", "ÄÖ中文 x"]
    want = [np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes() for text in some]
    token_files.ENCODERS.clear()
    monkeypatch.setattr(token_files, "SHARED_CACHE", 5)
    first = token_files.shared_encoder(model, 0)
    assert [first(text) for text in some] == want
    token_files.ENCODERS[model, 0] = first
    assert token_files.shared_encoder(model, 0) is first and not token_files.ENCODERS
    monkeypatch.setattr(token_files, "SHARED_CACHE", 1 << 20)
    again = token_files.shared_encoder(model, 0)
    assert [again(text) for text in some] == want
    monkeypatch.setattr(token_files.pretokens, "encoded", None)
    assert [again(text) for text in some] == want
    token_files.ENCODERS[model, 0] = again
    assert token_files.shared_encoder(model, 7) is not again and not token_files.ENCODERS


@pytest.mark.parametrize("module", ["packing", "token_files"])
def test_tasks_leave_their_encoder_to_later_tasks(spark, tmp_path, module):
    def count(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(vars(sys.modules.get(f"marketlens_{module}", sys)).get("encoders", ()))]})

    docs = table(spark, texts()).repartition(8)
    if module == "packing":
        queries.packing.pack(docs, queries.public_tokenizers.path(queries.PACKED)).count()
    else:
        path = queries.public_tokenizers.path(queries.TOKENIZER)
        token_files.write_token_files(docs, str(tmp_path), path, shards=8, shared=True).count()
    left = spark.range(16).repartition(16).mapInArrow(count, "n long").collect()
    assert max(r["n"] for r in left) == 1


def test_runs_are_compared_by_size_and_parity_first(monkeypatch):
    """All possible pairs of the runs come out, few are compared in full; a large run of copies is named instead."""
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 40)
    rows = {"signature": np.sort(rng.integers(0, 4, 600)), "key": rng.integers(0, 500, 600), "size": rng.integers(5, 60, 600), "position": rng.integers(0, 5, 600), "place": np.zeros(600, np.int64)}
    rows["size"], rows["position"] = rows["key"] % 50 + 5, rows["key"] % 3
    rows["parity"] = base[rows["key"] % 40] ^ (np.int64(1) << (rows["key"] % 7))
    threshold, full = Fraction(4, 5), []
    possible = set_join.possible
    monkeypatch.setattr(set_join, "possible", lambda a, b, t: full.append(len(a["key"])) or possible(a, b, t))
    monkeypatch.setattr(set_join, "RUN", 10_000)
    pairs, left, dense = set_join.pairs_of_runs(rows, threshold)
    got = sorted(tuple(sorted(p)) for p in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True))
    want, bears = [], {}
    for s in range(4):
        own = {int(k): {n: v[[i]] for n, v in rows.items()} for i, k in enumerate(rows["key"]) if rows["signature"][i] == s}
        want += [(a, b) for a in own for b in own if a < b and possible(own[a], own[b], threshold)[0]]
        bears[s] = own
    assert got == sorted(want) and want and not len(dense) and not len(left["key"])
    assert sum(full) < 20_000  # of about 40,000 pairs of four signatures
    # thinned out: a pair is given, or both its rows are
    few, left, dense = set_join.pairs_of_runs(rows, threshold, 16)
    few = set(map(tuple, map(sorted, zip(few[0].tolist(), few[1].tolist(), strict=True))))
    open_ = set(zip(left["signature"].tolist(), left["key"].tolist(), strict=True))
    assert all(pair in few or any({(s, pair[0]), (s, pair[1])} <= open_ for s in range(4)) for pair in want)
    assert len(few) < len(want) and not len(dense)
    same = {k: np.full(300, v[0]) for k, v in rows.items()} | {"key": np.arange(300)}
    monkeypatch.setattr(set_join, "RUN", 128)
    assert set_join.pairs_of_runs(same, threshold)[2].tolist() == [rows["signature"][0]]


def test_lines_are_compared_with_one_earlier_line_first(spark, monkeypatch):
    """Every copy is similar to the first line: one comparison each, not one for each pair of copies."""
    compared = []
    verified = set_join.verified

    def counted(pairs, *others):
        compared.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(set_join, "verified", counted)
    line = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join([*line[:-1], f"u{i}"])) for i in range(100)] + [(200, " ".join(["x1", "x2", *line[2:-1], "u3"]))]
    got = sorted(tuple(r) for r in line_dedup.remove_similar_lines(table(spark, rows)).collect())
    assert got == brute.without_similar_lines(rows)
    assert sum(compared) < 3 * len(rows)


def test_close_pairs_fold_parity_bits_and_carry_columns(spark):
    rng = np.random.default_rng(3)
    bits = {k: rng.integers(0, 2**63, 2 ** int(rng.integers(1, 5)), dtype=np.uint64) for k in range(12)}
    rows = [(k, 30 + 15 * k, v.tobytes(), f"p{k}") for k, v in bits.items()]
    pairs = [(a, b) for a in bits for b in bits if a < b]
    got = set_join.close_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "key long, size int, parity binary, place string"), Fraction(2, 5), "place")
    near = lambda a, b: set_join.hashing.differing_bits(rows[a][2], rows[b][2]) <= (n := rows[a][1] + rows[b][1]) - 2 * math.ceil(Fraction(2 * n, 7))
    want = [(a, b, f"p{a}", f"p{b}") for a, b in pairs if near(a, b)]
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < len(pairs)


def test_tokens_are_read_from_one_text_of_each_candidate(spark, monkeypatch):
    """Null ids included; texts that meet no other are not read again."""
    read = []
    token_sets = set_join.token_sets
    monkeypatch.setattr(set_join, "token_sets", lambda docs, *others: read.append(docs.count()) or token_sets(docs, *others))
    near = " ".join(f"v{k}" for k in range(60))
    rows = [(None, near), (7, f"{near} end"), *((i, " ".join(f"t{i}x{k}" for k in range(20))) for i in range(10, 50))]
    got = [tuple(r) for r in ngram_join.link_documents(table(spark, rows)).collect()]
    assert sorted(got, key=str)[-1] == (None, 57, 7) and (7, 58, 7) in got and len(got) == 42
    assert read == [2]


def test_signatures_of_one_group_are_left_out_of_later_rounds(spark):
    bearers = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12)], "signature long, key long")
    roots = spark.createDataFrame([(10, 10), (11, 10)], "key long, root long")
    rest = ngram_join.open_bearers(bearers, roots)
    assert sorted(map(tuple, rest.collect())) == [(2, 11, 10), (2, 12, 12)]
    joined = spark.createDataFrame([(10, 10), (11, 10), (12, 10)], "key long, root long")
    assert ngram_join.open_bearers(rest.select("signature", "key"), joined).count() == 0


def test_counters_take_as_many_bytes_as_their_largest_needs(spark):
    counts = np.zeros(8 * storage.SLICE, np.int64)
    counts[[3, storage.SLICE, 2 * storage.SLICE, 3 * storage.SLICE + 1]] = 255, 256, 1 << 16, (1 << 31) + 5
    parts = storage.sliced(counts)
    assert [len(x) // storage.SLICE for x in parts.column(1).to_pylist()] == [1, 2, 4, 8]
    rows = spark.createDataFrame([(r["slice"], bytearray(r["counts"])) for r in parts.to_pylist() * 3], "slice int, counts binary")
    assert (storage.added_up(rows, len(counts)) == 3 * counts).all()


def test_a_dense_run_gives_no_more_pairs_than_rows(spark):
    """Sets of one signature in many overlapping groups: a pair is given, or left open at the signature of both."""
    rng, n, threshold = np.random.default_rng(2), 600, Fraction(4, 5)
    bits = [sum(1 << int(b) for b in rng.choice(60, 5, replace=False)) for _ in range(n)]
    rows = [(1, i, i, 30, 0, bits[i]) for i in range(n)]
    found = [tuple(r) for r in set_join.candidates(spark.createDataFrame(rows, set_join.POSTINGS).coalesce(1), threshold).collect()]
    columns = {k: np.array(v) for k, v in zip(("signature", "place", "key", "size", "position", "parity"), zip(*rows, strict=True), strict=True)}
    want = set()
    for i in range(n):
        near = set_join.possible({k: np.full(n, v[i]) for k, v in columns.items()}, columns, threshold)
        want |= {(i, int(j)) for j in np.flatnonzero(near) if i < j}
    given, open_ = {x[:2] for x in found if x[2] is None}, {x[0] for x in found if x[2] is not None}
    assert len(want) > set_join.DENSE * n and given <= want
    assert all(pair in given or set(pair) <= open_ for pair in want)
    assert len(found) <= 2 * n
