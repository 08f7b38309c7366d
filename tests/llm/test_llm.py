"""Each operator against brute force, round trips and odd input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm import bpe, chat, common, embedding_join, exact_dedup, mixing, ngram_join, quality, queries, sketch, substring_dedup, textkernel, token_files, warc

DOCS = "doc_id long, text string, source string, keep_id string, id int, size string"
SF = "/root/testdata/sf0.001"


def words(rng, n, most=40):
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def documents(spark, rows):
    """rows: (doc_id, text, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    base = words(rng, 300, 4000)
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n ", "b"), (None, "null id", "a"), (None, "null id", "a"), (4, "ÄÖ 中文 😀 it's \x85 x", "c")]
    rows += [(5, " ".join(base), "a"), (6, " ".join(base), "a"), (6, " ".join(base), "a"), (7, " ".join(words(rng, 5000, 9000)), None)]
    for k in range(8, 40):
        v = base[:]
        for _ in range(k - 8):
            v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(v).title() if k % 5 == 0 else "  ".join(v), rng.choice("abc")))
    rows += [(k, "one two three", "b") for k in range(40, 46)] + [(46, "one two", "b"), (47, "z " * 3000, "a")]
    return rows


# -- shared ----------------------------------------------------------------


def test_words_hash_alike_whatever_stands_around_them():
    import pyarrow as pa

    texts = ["alpha beta", "beta", " beta  alpha\x0b", None, "", "BETA"]
    seen = {}
    for a, b, buf, off in textkernel.text_chunks(pa.array(texts), 4):
        s, e, first = textkernel.find_words(buf, off)
        h = textkernel.word_hashes(buf, s, e)
        for k in range(b - a):
            for w, x in zip((texts[a + k] or "").split(), h[first[k] : first[k + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == 3


def test_long_rows_hash_like_short_ones():
    text = " ".join(f"word{k % 977}" for k in range(600_000)).encode()
    buf = np.frombuffer(text, np.uint8)
    assert len(buf) > 4 * textkernel.CHUNK
    words, first = textkernel.row_words(buf, np.array([0, len(buf)]))
    one, _ = textkernel.row_words(np.frombuffer(b"word5 word976", np.uint8), np.array([0, 13]))
    assert first.tolist() == [0, 600_000] and words[5] == one[0] and (words[976::977] == one[1]).all()


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 60)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root(v) for v in linked}
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_sweep_removes_what_was_made(spark):
    import os

    path = common.settle(spark.range(3), "swept").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.sweep(spark) > 0 and not os.path.exists(path)
    assert common.sweep(spark) == 0


def test_global_rank(spark):
    d = spark.range(500).select((F.col("id") * 37 % 501).alias("v")).repartition(7)
    assert [r["rank"] for r in common.global_rank(d, [F.col("v")]).orderBy("v").collect()] == list(range(500))


def test_sketch_never_underestimates(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 62, 3000).astype(np.uint64)
    c1, c2 = sketch.Counter(20), sketch.Counter(20)
    c1.add(keys)
    c2.add(keys[:1000])
    tiles = spark.createDataFrame([(t, bytearray(a), bytearray(b)) for c in (c1, c2) for t, a, b in c.tiles()], sketch.TILES)
    hit = sketch.test(sketch.merge(tiles, 20, 2), keys)
    assert hit[:1000].all() and hit[1000:].mean() < 0.05


# -- 1 ----------------------------------------------------------------


def test_mix_targets_and_totals(spark, odd_rows):
    rng = random.Random(3)
    rows = odd_rows + [(100 + k, " ".join(words(rng, rng.randrange(1, 60))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(400)]
    d = documents(spark, rows)
    got = mixing.mix(d, leaf=16, fan=4).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        want = 2 * size[s] if s in full else level * weight[s]
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, want) for r in own)
        assert abs(sum(r.taken for r in own) - want) <= max(r["size"] for r in own)
    again = mixing.mix(d.repartition(9), leaf=16, fan=4).collect()
    assert sorted((r.doc_id or -1, r["size"], r.copies) for r in got) == sorted((r.doc_id or -1, r["size"], r.copies) for r in again)


def test_pivotal_rounding_keeps_expectations():
    size = np.array([3.0, 1, 4, 2, 5, 2])
    p = np.array([0.3, 0.6, 0.5, 0.25, 0.8, 0.4])
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(6000):
        q, held = mixing._round_pairs(p, size, rng.random(6), False)
        assert abs(size @ q - size @ p) < 1e-9 and sum(0 < x < 1 for x in q) <= 1
        runs.append(q)
    assert np.abs(np.mean(runs, 0) - p).max() < 0.03


def test_apply_mix_repeats_rows(spark, odd_rows):
    d = documents(spark, odd_rows)
    want = mixing.mix(d).agg(F.sum("copies")).first()[0]
    out = mixing.apply_mix(d)
    assert out.columns == d.columns and out.count() == want


# -- 2 ----------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    page = "<p>" + "long enough " * 20
    rows = [(1, "u", page), (2, "u b\n", page), (3, None, None), (4, "u", ""), (5, "é", "short"), (6, "u", "short"), (7, "u", page + "é"), (9, "u", page), (9, "u", page), (None, "u", page)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = {}
    for r in warc.archive_round_trip(spark, d, out_dir=f"file://{tmp_path}/a").collect():
        got.setdefault(r.page_id, []).append(r)
    for k, _, html in rows:
        data = (html or "").encode()
        assert all(r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_bytes == len(data) for r in got[k])
    assert [r.record_type for r in got[1]] == ["response"] and [(r.record_type, r.refers_to) for r in got[2]] == [("revisit", 1)]
    assert all(r.refers_to == 1 for r in got[9] + got[None]) and len(got[9]) == 2
    assert all(r.record_type == "response" for k in (3, 4, 5, 6, 7) for r in got[k])
    empty = spark.createDataFrame([], d.schema)
    assert warc.archive_round_trip(spark, empty).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_what_damage_leaves(spark, tmp_path, compress):
    d = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 50) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(d, f"file://{tmp_path}/{compress}", compress=compress).collect()
    path = files[0].path.removeprefix("file://")
    whole = [x for x in warc.salvage(path)]
    assert [x[0] for x in whole] == ["record"] * 30
    raw = bytearray(open(path, "rb").read())
    raw[whole[3][2] - 30] ^= 0xFF  # a broken record
    c = whole[20][1]
    raw = raw[:c] + b"garbage WARC/1.1 and \x1f\x8b\x08 more" + raw[c:]  # foreign bytes
    raw = raw[:-20]  # cut off
    broken = f"{tmp_path}/broken{compress}.warc"
    open(broken, "wb").write(raw)
    parts = list(warc.salvage(broken))
    kept = [int(x[3]["x-row-id"]) for x in parts if x[0] == "record"]
    order = [int(x[3]["x-row-id"]) for x in whole]
    assert kept == order[:3] + order[4:-1]
    at = 0
    for x in parts:  # records and gaps cover the file
        assert x[1] == at
        at = x[2]
    assert at == len(raw) and sum(x[0] == "gap" for x in parts) == 3
    got = warc.read_warc(spark.createDataFrame([(broken,)], "path string"))
    assert got.where("kind = 'gap'").count() == 3 and got.where("kind = 'record'").count() == 28


@pytest.mark.parametrize("compress", [True, False])
def test_long_urls_come_back(spark, tmp_path, compress):
    urls = ["data:," + "x y" * 100_000, "u", "data:," + "z" * 3_000_000, "v"]
    d = spark.createDataFrame([(k, u, f"page {k} " * 50) for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_warc(d, f"file://{tmp_path}/{compress}", compress=compress)
    got = warc.read_warc(files.select("path")).collect()
    assert [r.kind for r in got] == ["record"] * 4 and {r.row_id: r.url for r in got} == {k: u.replace(" ", "%20") for k, u in enumerate(urls)}


def test_members_are_plain_gzip(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    path = warc.write_warc(d, f"file://{tmp_path}/g").first().path.removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")


# -- 3 ----------------------------------------------------------------


def brute_repeats(rows, window=50):
    low, split = {}, []
    for k, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        split.append(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            low[key] = min(low.get(key, math.inf), math.inf if k is None else k)
    out = []
    for (k, _, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if low[tuple(w[i : i + window])] < (math.inf if k is None else k):
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def by_text(rows):
    return sorted(map(str, rows))


def thue_morse(n):
    """Two words that every polynomial hash modulo a power of two takes for one."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_take_for_one(spark):
    rng = random.Random(8)
    rows, near = [], []
    for k, n in enumerate((1024, 2048, 64)):
        a, b = thue_morse(n)
        rest = words(rng, 49, 10**6)
        rows += [(10 * k + 1, " ".join([a, *rest]), "a"), (10 * k + 2, " ".join([b, *rest]), "a")]
        near += [(10 * k + 1, " ".join([a, *rest[:5]]), "a"), (10 * k + 2, " ".join([b, *rest[:5]]), "a"), (10 * k + 3, " ".join([a.upper(), *rest[:5]]), "a")]
    a, b = thue_morse(1024)
    rows.append((90, " ".join([*rest, *a]), "a"))  # the same with words in place of letters
    rows.append((91, " ".join([*rest, *b]), "a"))
    assert {r.n_removed for r in substring_dedup.remove_repeats(documents(spark, rows[:-2])).collect()} == {0}
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()) == sorted(brute_repeats(rows))
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(documents(spark, near)).collect()}
    assert got == {k: {3: 1}.get(k % 10, k % 10) + k // 10 * 10 for k, *_ in near}


def test_windows_in_very_many_texts_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_OFTEN", 3)
    rng = random.Random(4)
    line = words(rng, 55, 10**6)
    rows = [(k, " ".join(words(rng, 9, 10**6) + line + words(rng, 9, 10**6)), "a") for k in range(30)]
    got = substring_dedup.remove_repeats(documents(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_repeats(rows))


def test_substring_dedup_matches_brute_force(spark, odd_rows):
    rng = random.Random(8)
    passage = words(rng, 90, 3000)
    rows = list(odd_rows)
    for k in range(60, 90):
        a, b = sorted((rng.randrange(91), rng.randrange(91)))
        rows.append((k, " ".join(words(rng, rng.randrange(80), 3000) + passage[a:b] + words(rng, rng.randrange(80), 3000) + passage[: rng.randrange(91)]), "a"))
    got = substring_dedup.remove_repeats(documents(spark, rows).repartition(5))
    assert by_text(tuple(r) for r in got.collect()) == by_text(brute_repeats(rows))
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


# -- 4 ----------------------------------------------------------------


def test_token_files_match_the_library(spark, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    rows = odd_rows + [(200, "a<|endoftext|> b, c.# <|ENDOFTEXT|> don't,", "a"), (201, "x' 'y ''z! #a,. é, ß.", "a")]
    d = documents(spark, rows).repartition(3)
    manifest = token_files.write_tokens(d, path, f"file://{tmp_path}/t")
    got = sorted(token_files.read_tokens(manifest, ids=True).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(path)
    want = sorted([(-1 if k is None else k, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for k, t, _ in rows], key=lambda r: r[0])
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [k for k, _ in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted(list(r.ids) for r in got) == sorted(i for _, i in want)
    assert token_files.tokenized(spark, documents(spark, []), path).count() == 0


def test_other_vocabularies_are_encoded_whole(spark, odd_rows, tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(queries.vocabulary("word_bpe_49k.json")).read())
    spec["normalizer"] = None  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(spec))
    tok = Tokenizer.from_file(str(tmp_path / "other.json"))
    rows = [r for r in odd_rows if r[0] is not None and r[0] not in (6,)]
    got = token_files.tokenized(spark, documents(spark, rows), str(tmp_path / "other.json"))
    for r in got.collect():
        ids = tok.encode(next(t for k, t, _ in rows if k == r.doc_id) or "", add_special_tokens=False).ids + [1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_files_are_read_by_more_tasks_than_one(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("x" * 200), "id").alias("html")).repartition(6)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    files = warc.write_warc(pages, f"file://{tmp_path}/w")
    assert files.count() > 1
    read = common.settle(warc.read_warc(files).withColumn("task", F.spark_partition_id()), "read")
    assert read.select("task").distinct().count() > 1 and read.where("kind = 'record'").count() == 400
    with pytest.raises(Exception, match="records written"):
        warc.read_warc(files.withColumn("n_records", F.col("n_records") + 1)).count()
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text")).repartition(5)
    manifest = common.settle(token_files.write_tokens(docs, queries.vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/t"), "bases")
    for most in (1 << 25, 64):  # files whole, and in ranges of documents
        read = common.settle(token_files.read_tokens(manifest, most=most).withColumn("task", F.spark_partition_id()), "read")
        assert read.select("task").distinct().count() > 1 or (manifest.count() == 1 and most > 64)
        assert [(r.doc_id, r.start) for r in read.orderBy("doc_id").collect()] == [(k, 4 * k) for k in range(300)]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://a:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_root(Session())
    Session.sparkContext.master = "local[2]"
    assert common.shared_root(Session()) == common.shared_root(Session())


def test_token_file_refuses_wrong_size(spark, tmp_path):
    m = token_files.write_tokens(documents(spark, [(1, "a b", "s")]), queries.vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/w").first()
    open(m.ids_file.removeprefix("file://"), "ab").write(b"x")
    with pytest.raises(ValueError):
        token_files.TokenFile(m.ids_file, m.index_file)


# -- 5 ----------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels, allowed=~quality.held_out("id"))
    got = quality.score(docs, model).withColumn("held", quality.held_out()).join(labels, "doc_id").where("held").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_odd_input(spark, odd_rows):
    d = documents(spark, odd_rows)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("false")
    for lab in (labels, none, labels.where("doc_id = 5")):
        got = quality.score(d, quality.fit(d, lab)).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(documents(spark, []), quality.fit(d, none)).count() == 0
    assert quality.keep_good(d, quality.fit(d, none)).columns == d.columns


def test_ratios_and_margins_match_plain_counts():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(12), 9)) for _ in range(60)]
    y = np.array([rng.choice((-1.0, 1.0)) for _ in texts])
    ((_, _, ids, bounds),) = quality.features(pa.array(texts))
    sets = [set(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    for t, s in zip(texts, sets):
        w = t.split()
        assert len(s) == len(set(w)) + len(set(zip(w, w[1:])))
    up, down = ({f: 1 + sum(f in s for s, v in zip(sets, y) if v == side) for f in range(1 << quality.BITS) if any(f in s for s in sets)} for side in (1, -1))
    rest = (1 << quality.BITS) - len(up)
    r = quality.log_count_ratios(ids, bounds, y)
    for f in up:
        assert r[f] == pytest.approx(math.log(up[f] / (sum(up.values()) + rest)) - math.log(down[f] / (sum(down.values()) + rest)))
    v = np.random.default_rng(1).normal(size=1 << quality.BITS)
    got = quality.margins(ids, bounds, v, r, 0.5)
    for m, s in zip(got, sets):
        assert m == pytest.approx(sum(v[f] for f in s) / math.sqrt(max(1, sum(r[f] ** 2 for f in s))) + 0.5)


def test_dual_descent_reaches_the_best_objective():
    rng = np.random.default_rng(0)
    n, d = 40, 6
    x = rng.normal(size=(n, d))
    y = np.where(x @ rng.normal(size=d) + rng.normal(size=n) > 0, 1.0, -1.0)
    ids, bounds, cost = np.tile(np.arange(d), n), np.arange(n + 1) * d, np.full(n, 0.5)
    w, b = quality.dual_descent(ids, bounds, x.ravel(), y, cost, epochs=2000)
    objective = lambda u: (u @ u) / 2 + (cost * np.maximum(0, 1 - y * (np.column_stack([x, np.ones(n)]) @ u))).sum()
    best = u = np.zeros(d + 1)  # plain subgradient descent on the primal
    z = np.column_stack([x, np.ones(n)])
    for k in range(1, 40_000):
        open_ = y * (z @ u) < 1
        u = u - (u - (cost * y * open_) @ z) / (k + 10)
        best = min(best, u, key=objective)
    assert objective(np.append(w[:d], b)) <= objective(best) * 1.001


def test_repeated_ids_learn_the_same_text(spark):
    rng = random.Random(6)
    rows = [(k % 40, " ".join(words(rng, 8, 30)), "a") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    models = [quality.fit(documents(spark, rng.sample(rows, 80)).repartition(n), labels) for n in (1, 5)]
    assert models[0] == models[1]


def test_dual_descent_separates():
    ids = np.array([0, 1, 0, 2, 3, 1, 3, 2])
    w, b = quality.dual_descent(ids, np.array([0, 2, 4, 6, 8]), np.ones(8), np.array([1.0, 1, -1, -1]), np.full(4, 10.0), 200)
    assert all(y * (w[ids[i : i + 2]].sum() + b) > 0.9 for y, i in zip((1, 1, -1, -1), (0, 2, 4, 6)))


# -- 6 ----------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(4)
    nasty = ["<|end|>\n", "a\\", "<", "<|assistant|>\n", "\\<|", "</s>[INST] ok [/INST]", "", None, "😀 é", "x <|end|> y\\\\"]
    rows, k = [], 0
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 25)):
            text = rng.choice(nasty) if rng.random() < 0.4 else " ".join(words(rng, rng.randrange(60)))
            rows.append((conv, turn if rng.random() < 0.95 else None, "system" if not turn and conv and conv % 2 else rng.choice(["user", "assistant", "tool", None]), text))
            k += 1
    rows.append((50, 0, "assistant", "w " * 4000))
    d = chat.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    windows = chat.format_chats(d, budget=120, history=30)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    rows += [(-1, 0, "user", nasty[5]), (-1, 1, "assistant", nasty[5])]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [t or "" for _, _, role, t in own if role == "assistant"]
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == sum(map(len, said))
        assert r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own).encode()).hexdigest()
    for w in windows.collect():
        turns = chat.parse(w.text)
        assert w.tokens == sum(chat.count_tokens(a) + chat.count_tokens(b) + 2 for a, b, _, _ in turns)
        assert w.tokens <= 120 or len(turns) - w.first_new <= 1 or w.window == 0
    assert chat.read_back(chat.format_chats(d.where("false"))).count() == 0


# -- 7 ----------------------------------------------------------------


def test_bpe_matches_the_library(spark, odd_rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab'stvelldmRE  \n\t　.!?éÉß12٣中😀́\r'\x00") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["ab" * 900, " " * 700, "!" * 300 + "'s", "it's we're they'll'll ''s 's \n's"] + [t or "" for _, t, _ in odd_rows]
    c = bpe.Codec(path, cache=50)
    for run in bpe._runs(texts, 500):
        for t, (ids, cut) in zip(texts[run[0] : run[1]], c.encode(texts[run[0] : run[1]])):
            assert ids == enc.encode_ordinary(t) and c.decode(ids) == t.encode()
            assert cut[0] == 0 and cut[-1] == len(t) and (np.diff(cut) > 0).all()
    d = documents(spark, odd_rows)
    both = bpe.encode(d, path, bounds=True)
    assert by_text(r.decoded.decode() for r in bpe.decode(both, path).collect()) == by_text(t or "" for _, t, _ in odd_rows)
    assert all(len(r.bounds) == len(r.first_id) and r.first_id[-1] == len(r.ids) for r in both.collect())
    assert bpe.round_trip(documents(spark, []), path).count() == 0


# -- 8 ----------------------------------------------------------------


def brute_near(rows):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for k, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for i, (a, _, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(k, len(s), None if k is None else root(k)) for (k, _, _), s in zip(rows, sets)]


@pytest.mark.parametrize("block", [256, 4])
def test_near_components_match_brute_force(spark, odd_rows, block):
    rng = random.Random(9)
    rows = list(odd_rows)
    for g in range(4):  # chains, whose ends aren't linked
        text = words(rng, 60, 5000)
        for k in range(25):
            rows.append((1000 + 100 * g + rng.randrange(100), " ".join(text), "a"))
            text = text[:]
            for _ in range(1 + g):
                text[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
    common_line = words(rng, 30, 5000)
    rows += [(2000 + k, " ".join(words(rng, 12, 5000) + common_line), "a") for k in range(40)]
    got = ngram_join.near_components(documents(spark, rows).repartition(5), block=block, frequent=64)
    assert by_text(tuple(r) for r in got.collect()) == by_text(brute_near(rows))


def test_shingles_compare_words():
    rng = random.Random(2)
    for n in (1, 2, 5):
        for _ in range(300):
            a, b = ([rng.choice("abcd" if rng.random() < 0.9 else "efgh") for _ in range(rng.randint(1, 30))] for _ in range(2))
            x, y = ({tuple(v[i : i + n]) for i in range(len(v) - n + 1)} or {tuple(v)} for v in (a, b))
            s = ngram_join.Shingles(" ".join(a).encode(), n)
            assert (len(s), *s.common(" ".join(b).encode())) == (len(x), len(x & y), len(y))


def test_near_components_empty(spark):
    assert ngram_join.near_components(documents(spark, [])).count() == 0
    kept = ngram_join.keep_one(documents(spark, [(1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (None, "q", "s")]))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "None"]


# -- 9 ----------------------------------------------------------------


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(6)
    vec = T.ArrayType(T.FloatType())
    rows = []
    for g in range(12):
        c = rng.standard_normal(64)
        for _ in range(25):
            v = c + rng.standard_normal(64) * rng.choice([0.02, 0.1, 0.14, 0.2])
            rows.append([(v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(g % 3)])
    rows += [[rows[0][0], 0]] * 40 + [[rows[0][0], 1], [rows[0][0], None], [None, 1], [[0.0] * 64, 1], [[0.0] * 64, 1], [[None] + [1.0] * 63, 1], [[float("nan")] * 64, 1], [[float("inf")] + [1.0] * 63, 1], [[1.0] * 8, 1], [[1.0] * 8, 1], [[], 1]]
    rows = [(k, *r, "x") for k, r in enumerate(rows)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", vec), T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType())])
    d = spark.createDataFrame(rows, schema)
    fine = [r for r in rows if r[1] and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links, parent = {}, {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a in fine:
        for b in fine:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]] = links.get(a[0], 0) + 1
                    links[b[0]] = links.get(b[0], 0) + 1
                    p, q = root(a[0]), root(b[0])
                    parent[max(p, q)] = min(p, q)
    want = [(k, links.get(k, 0), root(k), root(k) == k) for k, *_ in rows]
    for most in (2048, 16):
        got = embedding_join.near_vectors(d.repartition(3), most=most)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert embedding_join.near_vectors(d.where("false")).count() == 0


def test_near_vectors_of_doubles(spark):
    d = spark.createDataFrame([(1, [1e39, 0.0], 1), (2, [1e39, 1.0], 1), (3, [0.0, 1e-300], 1), (4, [1e300, 1e300], 1), (5, [1e-300, 1e-300], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_vectors(d).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


# -- 10 ----------------------------------------------------------------


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, odd_rows, keep):
    d = documents(spark, odd_rows).repartition(7)
    got = exact_dedup.exact_dedup(d, keep=keep).collect()
    groups = {}
    for k, t, _ in odd_rows:
        groups.setdefault(t or "", []).append(k)
    assert len(got) == len(odd_rows)
    kept = {}
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [k for k in own if k is not None]
        assert r.group_size == len(own) and r.keep_id == ((max if keep == "max" else min)(known) if known else None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    out = exact_dedup.drop_copies(d, keep=keep)
    assert out.columns == d.columns and out.count() == len(groups)
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0 and exact_dedup.drop_copies(documents(spark, [])).count() == 0


@pytest.mark.parametrize("leaves", [1, 3, 100])
def test_any_number_of_leaves_merges(spark, leaves):
    keys = spark.range(300).select("id", F.lit("00ff").alias("digest"), F.lit(1).cast("long").alias("size"), F.lit(2).cast("long").alias("check"), (F.col("id") % leaves).cast("int").alias("run"))
    got = exact_dedup.merge_runs(keys, leaves).collect()
    assert [(r.keep_id, r.group_size) for r in got] == [(299, 300)]


def test_exact_dedup_runs_no_python(spark, odd_rows):
    plan = exact_dedup.exact_dedup(documents(spark, odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    keys = exact_dedup.digests(documents(spark, odd_rows).repartition(16))
    plan = exact_dedup.merge_runs(keys, 16)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert [[re.sub(r"#.*", "", c.strip()) for c in d.split(",")[:-1]] for d in dealt] == [["part", "run"], ["part", "run"], ["run"]]
    assert plan.count("SortAggregate(key=[part") >= 2


# -- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settle(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        if name == "exact_dedup":
            assert out.count() == docs.select("text").distinct().count()
        if name == "ngram_jaccard_join":
            near = brute_near([(r.doc_id, r.text, None) for r in docs.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, _, c in near if k == c)
        n[name], docs = out.count(), out
    assert n["mix_sources"] > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n["mix_sources"]
