import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldweave.llm import cotraining, linear, lm, toxicity


def labelled_texts(n, seed=0):
    r = np.random.default_rng(seed)
    words = [f"plain{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = list(r.choice(words, int(r.integers(15, 60))))
        toxic, junk = int(r.random() < 0.3), int(r.random() < 0.3)
        if toxic:
            for _ in range(3):
                w.insert(int(r.integers(len(w))), str(r.choice(["awful", "AWFUL!", "nasty,", "nasties"])))
        if junk:
            w = [x + "%%%" for x in w] + ["buy", "now"]
        rows.append((i, " ".join(w), toxic, junk))
    return rows


def test_chain_learns_and_feeds_forward(make, spark):
    rows = labelled_texts(600)
    docs = make([r[:2] for r in rows] + [(None, None), (7, rows[7][1])], extra=True)
    labels = spark.createDataFrame([(i, 1 - junk, toxic) for i, _, toxic, junk in rows[:400]] + [(5, None, None), (None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.judged(docs, labels).collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] >= 400]
    assert np.mean([r["toxic"] == bool(rows[r["doc_id"]][2]) for r in held]) > 0.95
    assert np.mean([(r["p_junk"] > 0.5) == bool(rows[r["doc_id"]][3]) for r in held]) > 0.9
    twice = [r for r in out if r["doc_id"] == 7]
    assert len(out) == 602 and len(twice) == 2 and twice[0] == twice[1]
    chain, odds, _ = toxicity.train(docs, labels)
    assert len(chain.weights[1]) == len(chain.selected[1]) + 2 and odds.shape[1] == 2  # the second model has the first's odds
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in out)


def test_chain_matches_plain_loops(make, spark):
    """Scores by the definition: features of each distinct word, a dense product, the earlier log odds as a feature."""
    rows = labelled_texts(300, 9)
    docs = [r[:2] for r in rows] + [(900, None), (901, ""), (902, "awful " * 3000), (903, "x" * 300 + "/awful/NASTY-" + "y" * 80)]
    labels = spark.createDataFrame([(i, 1 - junk, toxic) for i, _, toxic, junk in rows], "doc_id long, quality int, toxic int")
    chain, _, _ = toxicity.train(make(docs), labels)
    out = {r["doc_id"]: r for r in toxicity.judged(make(docs), labels).collect()}
    for i, text in docs:
        times = Counter(f for w in set(linear.words_of((text or "").encode())) for f in linear.meaning_features(w).tolist())
        odds = []
        for selected, w in zip(chain.selected, chain.weights, strict=True):
            x = [math.log1p(times[f]) for f in selected.tolist()] + [max(-toxicity.LIMIT, min(toxicity.LIMIT, o)) for o in odds]
            odds.append(sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1])
        assert [out[i]["p_junk"], out[i]["p_toxic"]] == pytest.approx([1 / (1 + math.exp(-o)) for o in odds], abs=1e-9)
    assert out[902]["toxic"]


def test_long_words_count_by_their_pieces():
    assert linear.words_of(b"short " + b"a" * 70 + b"/nasty " + b"end") == [b"short", b"a" * 64, b"a" * 6, b"nasty", b"end"]
    assert linear.words_of(b"") == [] and len(linear.words_of(b"z" * 200_000)) == 3125


def test_chain_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in toxicity.judged(make(["a b", None]), none).collect()] == [False, False]
    assert toxicity.judged(make([]), none).collect() == []


def test_logistic_matches_its_gradient():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(200, 4)), (r.random(200) < 0.4).astype(float)
    w = linear.logistic(x, y, np.ones(200))
    p = linear.sigmoid(x @ w[:-1] + w[-1])
    assert np.allclose(x.T @ (p - y) + w[:-1], 0, atol=1e-2) and abs((p - y).sum()) < 1e-2


def test_cotraining_uses_both_views(make, spark):
    r = np.random.default_rng(3)
    rows, labels = [], []
    for i, (_, text, _, junk) in enumerate(labelled_texts(900, 5)):
        repeated = r.random() < 0.2  # seen by the layout only
        rows.append((i, (text + "\n") * 6 if repeated else text, "en", "s", None))
        if i < 500:
            labels.append((i, int(not (junk or repeated))))
        rows[-1] = (*rows[-1][:4], int(not (junk or repeated)))
    docs = make([*rows, (None, None, None, None, None)], extra=True)
    views, given = cotraining.train(docs, spark.createDataFrame([*labels, (3, None), (None, 0)], "doc_id long, quality int"))
    out = {r["doc_id"]: r for r in cotraining.score(docs, views).collect()}
    held = range(500, 900)
    assert np.mean([(out[i]["score"] > 0.5) == bool(rows[i][4]) for i in held]) > 0.93 and sum(given) > 0
    assert 0 <= out[None]["score"] <= 1


def test_cotraining_learns_from_all_unlabelled_texts(make, spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(6600):  # the smallest id hashes have no priority, nor do labelled rows among them
        junk = i % 2 == 1
        rows.append((i, " ".join(f"{w}%%%" if junk else f"w{w}" for w in r.integers(0, 60, 12 if junk else 48)), "en", "s", None))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)], "doc_id long, quality int")
    _, given = cotraining.train(make(rows), labels)
    assert sum(given) > 10_000  # of 6,000 texts for each of two views


def test_views_share_nothing(make):
    one, two = (cotraining.Rows.of(cotraining.features(make([(0, t, "en", "s", 30)])).toArrow()) for t in ("plain words\nand more of", "OTHER %%%%!\nall else 12"))
    assert (one.layout == two.layout).all() and sorted(one.feature.tolist()) != sorted(two.feature.tolist())
    other = cotraining.Rows.of(cotraining.features(make([(0, "plain words\nand more of", "de", "t", None)])).toArrow())
    assert (one.layout != other.layout).any() and (one.feature == other.feature).all()


def test_cotraining_matches_plain_loops(make, spark):
    """Scores by the definition: both views' weights, calibration and the combination, text by text."""
    rows = [(i, text, "en", "s", 1 - junk) for i, text, _, junk in labelled_texts(400, 11)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "word " * 4000, "en", "s", 9), (902, "word " * 4000, "en", "s", 9)]
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:300]], "doc_id long, quality int")
    views, _ = cotraining.train(make(rows), labels)
    out = {r["doc_id"]: r for r in cotraining.score(make(rows), views).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i, text, lang, source, size in rows:
        words = (text or "").encode().split()
        times = Counter(f for w in words for f in linear.shape_features(w).tolist()) + Counter({f: max(len(words), 1) for f in cotraining.repetition([(text or "").encode()])[0]})
        content = sum(w * math.sqrt(times[f] / max(len(words), 1)) for f, w in zip(views.selected.tolist(), views.content[:-1], strict=True)) + views.content[-1]
        layout = cotraining.metadata([(text or "").encode()], [lang], [source], [size])[0].astype(np.float32)
        z = [max(-12, min(12, a * o + b)) for (a, b), o in zip(views.calibration, (content, float(layout @ views.layout[:-1]) + views.layout[-1]), strict=True)]
        joint = sum(w * x for w, x in zip(views.combined[:-1], z, strict=True)) + views.combined[-1]
        assert [out[i][c] for c in ("p_content", "p_metadata", "score")] == pytest.approx([sigmoid(z[0]), sigmoid(z[1]), sigmoid(joint)], abs=1e-5)


def test_cotraining_of_one_kind_and_nothing(make, spark):
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    views, _ = cotraining.train(make(["a b", "c d", None]), one)
    assert all(r["score"] > 0.5 for r in cotraining.score(make(["a b", "c d", None]), views).collect())
    assert cotraining.score(make([]), views).collect() == []


def test_base_scores_match_a_count(make):
    r = np.random.default_rng(0)
    docs = [None, "", "A a\x0bB", "é É", *(" ".join(f"w{int(x)}" for x in r.zipf(1.4, 60) % 500) for _ in range(80)), "tail " * 3000]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(docs))]
    tokens = [[*(t or "").encode().lower().split(), b""] for t in docs]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    out = lm.score_documents(make(docs, extra=True), most_words=50).orderBy("doc_id").collect()
    for row, words, h in zip(out, tokens, held, strict=True):
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (h, len(words), sum(w in c for w in words), n)
        assert row["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
        assert row["score"] < 0


def _vocabulary(spark, n=700, most=600):
    counts = spark.createDataFrame([(f"w{i}".encode(), 900 - i) for i in range(n)] + [(b"", 90)], "word binary, c long")
    return counts, lm.vocabulary(counts, most)


def _weights(seed=0, n_nodes=lm.FEWEST):
    r = np.random.default_rng(seed)
    return lm.Weights(r.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32), r.normal(size=n_nodes).astype(np.float32))


def _within(known, weights, place, one, two):
    """A known token's probability within its class, step by step; ``one``, ``two``: places of the tokens before, plus 1."""
    p, mask = 1.0, (1 << 64) - 1
    for at in range(known.paths.start[place], known.paths.start[place + 1]):
        node, sign = int(known.paths.node[at]), int(known.paths.sign[at])
        key = node * 0x9E3779B97F4A7C15 & mask
        z = float(known.paths.bias[node])
        for context, salt in ((one, 0xC2B2AE3D27D4EB4F), (two, 0xA0761D6478BD642F)):
            z += float(weights.nodes[((key ^ (context * salt & mask)) * 0xD6E8FEB86659FD93 & mask) >> (65 - len(weights.nodes).bit_length())])
        p /= 1 + math.exp(-sign * z)
    return p * math.exp(known.in_class[place])


def test_probabilities_sum_to_one(spark):
    """All tokens' probabilities after some contexts, rare and unknown ones by their shares."""
    counts, known = _vocabulary(spark)
    weights, n = _weights(), len(known.counts)
    assert n <= 600 and (np.diff(known.paths.start)[lm.OWN : n] > 0).any()
    rare = [(bytes(r["word"]), r["c"]) for r in counts.collect() if bytes(r["word"]) not in known.place]
    for before in ([], [3], [70, 5], [4, n + 2]):
        total = 0.0
        for place in range(n + lm.RARE):
            places = np.array([*before, place])
            p = math.exp(lm.log_probabilities(known, weights, places, np.array([len(places)]))[-1])
            if place >= n:  # each rare token has its count plus 1, and the class one unknown token
                p *= 1 + sum(c + 1 for w, c in rare if lm._ending(w) % lm.RARE == place - n)
            total += p
        assert total == pytest.approx(1, abs=1e-4)


def test_scores_match_plain_loops(spark):
    _, known = _vocabulary(spark)
    weights, n = _weights(1), len(known.counts)
    r = np.random.default_rng(2)
    sizes = np.array([1, 7, 40])
    places = r.integers(0, n + lm.RARE, sizes.sum())
    got, at = lm.log_probabilities(known, weights, places, sizes), 0
    rows = lm.feature_rows(places, sizes)
    for size in sizes:
        for i in range(size):
            place = int(places[at])
            one, two = (int(places[at - k]) + 1 if i >= k else 0 for k in (1, 2))
            z = known.class_bias + sum(weights.classes[row].astype(float) for row in rows[:, at])
            want = z[known.classes[place]] - math.log(np.exp(z).sum()) + math.log(_within(known, weights, place, one, two))
            assert got[at] == pytest.approx(want, abs=1e-3)
            at += 1


def test_untrained_trees_give_shares_of_counts(spark):
    _, known = _vocabulary(spark)
    weights = lm.Weights(np.zeros((lm.ROWS, lm.CLASSES), np.float32), np.zeros(lm.FEWEST, np.float32))
    for place in range(lm.OWN, len(known.counts)):
        own = known.counts[known.classes[: len(known.counts)] == known.classes[place]]
        assert _within(known, weights, place, 0, 0) == pytest.approx(known.counts[place] / own.sum(), rel=1e-5)


def test_weights_grow_with_the_words():
    assert lm.node_weights(0) == lm.FEWEST and lm.node_weights(40_000) == 1 << 18 and lm.node_weights(10**9) == lm.MOST


def test_training_beats_counts_on_held_out_text(make):
    r = np.random.default_rng(0)
    nexts = r.permutation(300)

    def chain_text():
        w, out = int(r.integers(300)), []
        for _ in range(150):
            out.append(f"w{w}")
            w = int(nexts[w]) if r.random() < 0.8 else int(r.integers(300))
        return " ".join(out)

    out = lm.score_documents(make([chain_text() for _ in range(200)])).where("held_out").collect()
    assert len(out) > 10 and sum(x["score"] for x in out) > sum(x["base_score"] for x in out) + 10


def test_scores_of_nulls_and_repeats(make):
    docs = [(None, "a b a"), (1, "a b"), (1, "a b"), (2, None), (3, "long " * 5000)]
    out = lm.score_documents(make(docs, extra=True)).collect()
    assert len(out) == 5 and [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    twice = [tuple(r) for r in out if r["doc_id"] == 1]
    assert len(set(twice)) == 1 and [r["n_tokens"] for r in out if r["doc_id"] == 2] == [1]


def test_scores_of_nothing(make):
    assert lm.score_documents(make([])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_documents(make([(only, "a b")])).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0)


@pytest.mark.parametrize("most", [3, 4000])
def test_sums_of_rows_and_softmax_against_plain_ones(most):
    r = np.random.default_rng(most)
    values, rows = r.normal(size=(2048, lm.CLASSES)).astype(np.float32), r.integers(0, most, 2048).astype(np.uint16)
    used, sums = lm.row_sums(values, rows)
    assert used.tolist() == sorted(set(rows.tolist()))
    assert np.allclose(sums, [values[rows == k].sum(0) for k in used], atol=1e-4)
    weights = r.normal(size=(4001, lm.CLASSES)).astype(np.float32)
    weights[1] -= 500  # far below the others
    bias, chosen = np.zeros(lm.CLASSES, np.float32), r.integers(0, lm.CLASSES, 2048)
    z = weights[rows].astype(float)
    want = z - np.logaddexp.reduce(z, axis=1)[:, None]
    p, own = lm.softmax(weights, bias, rows[None], chosen)
    assert np.allclose(p, np.exp(want), atol=1e-4) and np.allclose(own, want[np.arange(2048), chosen], atol=1e-3)


def test_exponents_score_without_probabilities_and_rows_add_up_around_the_turns():
    rng = np.random.default_rng(4)
    weights = rng.normal(0, 40, (50, lm.CLASSES)).astype(np.float32)  # some rows lie far below the greatest of all
    bias, rows, chosen = np.zeros(lm.CLASSES, np.float32), rng.integers(0, 50, (3, 300)), rng.integers(0, lm.CLASSES, 300)
    _, total, own = lm.exponents(weights, bias, rows, chosen)
    z = weights[rows].astype(np.float64).sum(0)
    plain = z[np.arange(300), chosen] - z.max(1) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
    assert np.allclose(own - np.log(total), plain, rtol=1e-5, atol=1e-4)
    times = [1, 2, lm.TURNS - 1, lm.TURNS, lm.TURNS + 1, 3 * lm.TURNS]
    repeated = rng.permutation(np.repeat(np.arange(len(times), dtype=np.uint16) * 7, times))
    values = rng.normal(size=(len(repeated), lm.CLASSES)).astype(np.float32)
    used, sums = lm.row_sums(values, repeated)
    assert used.tolist() == [7 * i for i in range(len(times))]
    assert np.allclose(sums, [values[repeated == u].sum(0) for u in used], atol=1e-5)
