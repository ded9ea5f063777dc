import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import mixing, packing, quality, topk


def search(rows, is_query, k=5):
    """Every product of whole numbers, in Python."""
    whole = [(i, [int(np.floor(np.float64(x) * 256)) if abs(np.float64(x) * 256) < 2.0**53 else int(np.float64(x) * 256) for x in v]) for i, v in rows]
    out = []
    for at, (q, u) in enumerate(whole):
        if is_query(q):
            scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(u, v, strict=True)))), c) for i, (c, v) in enumerate(whole) if i != at and len(v) == len(u)]
            out += [(q, n + 1, c, s) for n, (s, c) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def test_topk_matches_all_products(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=8) * r.choice([0.1, 1, 3]))]) for i in range(3000)]
    rows += [(i + 3000, rows[i][1]) for i in range(40)]  # ties
    rows += [(i, [float(x) for x in np.float32(r.normal(size=8))]) for i in (7, 50, 50, 100)]  # repeated ids, with vectors of their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, queries_at_once=20)
    assert sorted(tuple(x) for x in out.collect()) == search(rows, lambda i: i % 50 == 0)


def test_bounds_leave_most_rows_unscored():
    r = np.random.default_rng(1)
    v = np.floor(r.normal(size=(4000, 16)) * np.exp(r.normal(size=(4000, 1))) * 50)
    v = v[np.argsort(-(v**2).sum(1))]
    turn = np.linalg.svd(v, full_matrices=False)[2].T
    s = topk.Searcher(np.array([-1]), np.array([-1]), v[2000:2001], np.array([-np.inf]), turn, 8, 5)
    for at in range(0, 4000, 250):
        s.block(np.arange(at, at + 250), np.arange(at, at + 250), v[at : at + 250])
    assert s.scored < 2000 and sorted(s.found[0][1].tolist()) == sorted((v @ v[2000]).astype(int).tolist())[-5:]


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 0.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (50, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS row", "vec_id AS v", "vec_id AS dim")
    out = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert out == search([rows[i] for i in (0, 1, 6, 8, 9)], lambda i: i % 50 == 0)
    assert (50, 1, 6, 65536) in out and len([x for x in out if x[0] == 0]) == 4
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []


def test_topk_of_repeated_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 6 * 65536), (0, 2, 1, 2 * 65536)]


@pytest.mark.parametrize("size", [2.0e4, 3.0e7, 1.0e12, 1.0e200, 1.7e308])
def test_topk_of_large_components(spark, size):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=4) * (size if i % 3 else 1.0)]) for i in range(60)] if size < 1e300 else [(i, [size, -size if i % 2 else 1.0, 0.5, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 10 == 0).collect())
    if size < 1e300:
        assert out == search(rows, lambda i: i % 10 == 0)
    else:  # scaled, these are held at the greatest double
        assert len(out) == 10 and all(x[3] in (2**63 - 1, -(2**63)) for x in out)


def check_packing(rows, capacity):
    where = {}
    for r in rows:
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in where.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(where)


def test_plan_is_near_the_bound():
    r = np.random.default_rng(0)
    lengths = np.minimum(4096, np.exp(r.normal(6.5, 1.1, 20_000)).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    segments = packing.plan(counts)
    load = np.zeros(max(s[3] + s[2] for s in segments), int)
    placed = {}
    for length, first, n, bins, offset in sorted(segments, key=lambda s: s[4]):
        assert (load[bins : bins + n] == offset).all()
        load[bins : bins + n] += length
        placed.setdefault(length, []).append((first, n))
    for length, parts in placed.items():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) == counts[length]
    assert load.max() <= 4096 and len(load) <= 1.01 * lengths.sum() / 4096 + 1


def test_pieces_match_the_tokenizer(make):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    docs = [None, "", " \t\n", "Don't  STOP\x85now ok", "É é́ <|endoftext|>x ½", "日本 😀 İ", "word " * 9000]
    out = packing.pack_documents(make(docs, extra=True), with_ids=True)
    rows = out.collect()
    for i, text in enumerate(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [t for r in pieces for t in r["ids"]] == ids and [r["start"] for r in pieces] == list(range(0, len(ids), 4096))
        for r in pieces:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(own, np.uint32).tobytes())
    check_packing(rows, 4096)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(out).collect()}
    assert sum(map(len, whole.values())) == sum(r["length"] for r in rows)


def test_tokenizers_that_join_blanks_get_whole_texts(make):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no such vocabulary")
    tokenizer, docs = Tokenizer.from_file(path), ["Two words  and\nlines", None, "x " * 50]
    rows = {r["doc_id"]: r for r in packing.pack_documents(make(docs), path=path).collect()}
    for i, text in enumerate(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, np.uint32).tobytes())


def test_packing_repeats_and_nothing(make, monkeypatch):
    rows = packing.pack_documents(make([(None, "a b"), (1, "a b"), (1, "a b")] + [(i, "a " * (i % 7)) for i in range(200)]), capacity=16).collect()
    assert len(rows) == 203
    assert check_packing(rows, 16) == -(-sum(r["length"] for r in rows) // 16)
    assert packing.pack_documents(make([])).collect() == []


def test_quality_measures(make):
    eight = "a b c d e f g h"
    docs = [None, "", "é ü\tß\x0bx", "l one\nl one\n \nL one", f"{eight} z {eight}", "#*$ %& |<>", "word " * 5000]
    out = quality.apply_policy(quality.ledger(make(docs, extra=True))).orderBy("doc_id").collect()
    assert [r["n_words"] for r in out] == [0, 0, 4, 6, 17, 3, 5000]
    assert out[2]["word_chars"] == 4 and out[3]["n_dup_lines"] == 1 and out[4]["n_repeat_words"] == 16 and out[5]["n_symbols"] == 8
    assert out[6]["n_repeat_words"] == 5000 and out[6]["failed"] & quality.BIT["repeated_windows"] and not out[6]["kept"]
    assert [r["base_failed"] for r in out] == [True] * 7
    assert quality.ledger(make([])).collect() == []


def test_policies_and_ablations(spark):
    few, caps = quality.BIT["few_words"], quality.BIT["upper_case"]
    entries = spark.createDataFrame([(0, 0), (1, few), (2, few | caps), (3, caps)], "doc_id long, failed long")
    assert [r["kept"] for r in quality.apply_policy(entries, "base").orderBy("doc_id").collect()] == [True, False, False, True]
    out = {r["rule"]: (r["fails"], r["only_this"]) for r in quality.ablations(entries).collect()}
    assert out["few_words"] == (2, 1) and out["upper_case"] == (2, 1) and out["long_words"] == (0, 0)


def test_measures_of_repeated_rows(make):
    out = quality.ledger(make([(1, "a b"), (1, "a b"), (None, "a b")])).collect()
    assert len(out) == 3 and len({tuple(r)[1:] for r in out}) == 1


def test_targets_stop_at_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 500)], "source string, source_size long")
    out = {r["source"]: r["target"] for r in mixing.reshared_targets(sizes).collect()}
    # weights 5, 2, 1, 5, 2: a and d stop at 30 and 0, the rest shares 2480 by 2, 1, 2
    assert out == pytest.approx({"a": 30, "b": 992, "c": 496, "d": 0, None: 992})


def test_mix_meets_targets(make):
    r = np.random.default_rng(0)
    docs = make([(i, "w " * int(r.integers(0, 80)), "en", ["x", "y", None][i % 3], 0) for i in range(900)] + [(900, None, "en", "y", 0)], extra=True)
    rows = mixing.mix_documents(docs).collect()
    by = {}
    for x in rows:
        t = by.setdefault(x["source"], [x["target"], 0])
        t[1] += x["taken"]
        assert x["taken"] <= 3 * x["size"] and x["taken"] % max(x["size"], 1) == 0
    for target, taken in by.values():
        assert taken == pytest.approx(target, rel=0.01)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_documents(docs).collect()), key=str)
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns and copies.count() == sum(x["copies"] for x in rows)


def test_unequal_measures_raise_shares(spark):
    from fieldweave.llm.common import Scratch

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), (1 + F.col("id") % 2).cast("double").alias("measure"))
    targets = spark.createDataFrame([("s", 40000, 20000.0)], "source string, source_size long, target double")
    out = mixing.pareto_mix(docs, targets, Scratch(spark, "t")).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in out}
    assert n[0] + n[1] == 2000 and n[1] / n[0] == pytest.approx(2, rel=0.15)


def mixed(rows, targets, most=3.0):
    """``doc_id: copies`` of ``(doc_id, source, size)`` by plain loops, with the default measure."""
    import hashlib

    out = {}
    for source, target in targets.items():
        own = [(i, n, len(f"{n:b}")) for i, s, n in rows if s == source]
        level, capped = None, set()
        while True:
            rest = [(n, m) for _, n, m in own if m not in capped]
            total = sum(n * m for n, m in rest)
            level = (target - most * sum(n for _, n, m in own if m in capped)) / total if total else None
            over = {m for _, m in rest if level is not None and m * level >= most and m == max(x for _, x in rest)}
            if not over:
                break
            capped |= over
        docs = []
        for i, n, m in own:
            expected = most if m in capped else (level or 0.0) * m
            certain = int(np.floor(expected + 1e-9))
            u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = expected - certain
            docs.append([i, n, certain, (u / (1 - u)) * (1 - p) / p if p > 0 else None, 0])
        left, upto = target - sum(d[1] * d[2] for d in docs), 0
        for d in sorted((d for d in docs if d[3] is not None), key=lambda d: (d[3], d[0], d[1])):
            upto += d[1]
            d[4] = int(upto - d[1] / 2 <= left)
        for _ in range(mixing.EXCHANGES):
            gap = target - sum(d[1] * (d[2] + d[4]) for d in docs)
            off = [(abs(gap - (d[1] if not d[4] else -d[1])), d[3], d[0], k) for k, d in enumerate(docs) if d[3] is not None]
            off = [x for x in off if x[0] < abs(gap)]
            if off:
                docs[min(off)[3]][4] ^= 1
        out |= {d[0]: d[2] + d[4] for d in docs}
    return out


def test_mix_matches_plain_loops(make):
    r = np.random.default_rng(3)
    sizes = [int(x) for x in r.choice([0, 1, 3, 9, 40, 200], 600)]
    docs = make([(i, "w " * n, "en", ["x", "y", "z", None][i % 4], 0) for i, n in enumerate(sizes)], extra=True)
    rows = mixing.mix_documents(docs).collect()
    targets = {x["source"]: x["target"] for x in rows}
    assert {x["doc_id"]: x["copies"] for x in rows} == mixed([(x["doc_id"], x["source"], x["size"]) for x in rows], targets)
    by = {n: np.mean([x["copies"] for x in rows if x["size"] == n and x["source"] == "y"]) for n in (1, 9, 200)}
    assert by[1] < by[9] < by[200]  # longer documents are likelier


def test_mix_of_repeats_and_long_texts(make):
    rows = [(1, "w " * 30, "en", "s", 0), (1, "w " * 30, "en", "s", 0), (1, "w " * 12, "en", "s", 0), (2, "w " * 60_000, "en", "t", 0), (None, "w " * 9, "en", None, 0)]
    docs = make(rows, extra=True)
    out = mixing.mix_documents(docs).collect()
    assert len(out) == 5 and sum(x["taken"] for x in out) <= 3 * sum(x["size"] for x in out)
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns
    for x in copies.groupBy("doc_id", "text").count().collect():
        assert x["count"] <= (6 if x["doc_id"] == 1 else 3)


def test_mix_by_a_measure_of_ones_own(make):
    docs = make([(i, "w " * 10, "en", "s", i % 2) for i in range(2000)] + [(5000, "w " * 10, "en", "s", None)])
    out = mixing.mix_documents(docs, measure=F.col("n_chars").cast("double")).collect()
    assert all(x["copies"] == 0 for x in out if x["doc_id"] % 2 == 0) and sum(x["taken"] for x in out) == pytest.approx(out[0]["target"], rel=0.01)


def test_bins_share_a_source_evenly(spark):
    from fieldweave.llm.common import Scratch

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(900.0).alias("measure"))
    targets = spark.createDataFrame([("s", 400_000, 500.0)], "source string, source_size long, target double")
    scratch = Scratch(spark, "bins")
    assert mixing.pareto_mix(docs, targets, scratch).agg(F.sum("taken")).first()[0] == 500
    most = spark.read.parquet(f"{scratch.root}/ranked").groupBy("bin").count().agg(F.max("count")).first()[0]
    assert most < 10 * 40_000 / mixing.BINS


def test_mix_of_nothing(make):
    assert mixing.mix_documents(make([])).collect() == []
    assert mixing.mix_documents(make([None, ""])).agg(F.sum("taken")).first()[0] == 0
