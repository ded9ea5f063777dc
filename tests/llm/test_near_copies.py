"""Line dedup, substring dedup and the n-gram join against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import line_dedup, ngram_join, substring_dedup

EDGES = [None, "", "  \n \t", "one", "one two", "one two", "a b c d e f g h", "a b c d e f g h", "A B c d e\tf g h"]


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(30)]
    docs = []
    for _ in range(n):
        if docs and r.random() < 0.5:
            base = docs[r.randrange(len(docs))].split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                base[r.randrange(len(base))] = r.choice(words)
        else:
            base = [r.choice(words) for _ in range(r.randint(5, 120))]
        if r.random() < 0.3:
            at = r.randrange(len(base))
            base = base[:at] + passage + base[at:]
        docs.append(" ".join(base))
    docs.append("x " * 50 + "x")  # repeats itself
    docs.append(" ".join(f"long{i}" for i in range(9000)))
    docs.append(docs[-1] + " end")
    return docs


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = [shingles(t) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(docs))]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_match_all_pairs(make, seed):
    docs = EDGES + corpus(seed)
    out = ngram_join.link_documents(make(docs, extra=True))
    assert sorted(tuple(r) for r in out.collect()) == components(docs)


@pytest.mark.parametrize("tree", [2, 5, 1000])
def test_chunks_and_trees_lose_nothing(make, monkeypatch, tree):
    monkeypatch.setattr(ngram_join, "TREE", tree)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "LEAF", 2)
    monkeypatch.setattr(ngram_join, "FANOUT", 2)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    docs = corpus(3, 50)
    assert sorted(tuple(r) for r in ngram_join.link_documents(make(docs)).collect()) == components(docs)


def test_links_of_nulls_repeats_and_nothing(make, spark):
    out = ngram_join.link_documents(make([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")]))
    assert sorted((str(r[0]), r[1], r[2]) for r in out.collect()) == [("3", 2, 3), ("3", 2, 3), ("5", 2, 3), ("None", 2, None)]
    assert ngram_join.link_documents(make([])).collect() == []
    assert len(ngram_join.link_documents(make([None, ""])).collect()) == 2


def kept_lines(docs):
    seen, out = [], []
    for text in docs:
        gone = []
        for i, line in enumerate([] if text is None else text.split("\n")):
            words = set(line.encode().split())
            if words:
                if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                    gone.append(i)
                seen.append(words)
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_all_pairs(make, seed):
    r = random.Random(seed)
    lines = [line for t in corpus(seed, 40) for line in t.split(" x")][:80]
    docs = EDGES + ["\n".join(r.choice(lines) for _ in range(r.randint(1, 6))) for _ in range(25)]
    found = line_dedup.dedup_lines(make(docs, extra=True))
    assert found.columns == [*(c for c in make([], extra=True).columns if c != "removed"), "removed"]
    out = found.orderBy("doc_id").collect()
    assert [list(x["removed"]) for x in out] == kept_lines(docs)
    for row, text, gone in zip(out, docs, kept_lines(docs), strict=True):
        assert row["text"] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))


def test_lines_of_nulls_repeats_and_nothing(make):
    assert line_dedup.dedup_lines(make([])).collect() == []
    out = line_dedup.dedup_lines(make([(None, "p q r"), (1, "p q r"), (1, "p q r")])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("1", "p q r"), ("1", "p q r"), ("None", "")]


def test_lines_of_texts_under_one_id_are_told_apart(make):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, a.replace("one", "uno"))]
    out = line_dedup.dedup_lines(make(rows)).orderBy("doc_id", "text").collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, a), (1, b), (2, ""), (3, ""), (4, rows[4][1])]


def test_long_lines_and_groups_of_near_copies(make):
    r = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    base = words[:40]
    docs = [" ".join(f"long{i}" for i in range(9000)), " ".join(f"long{i}" for i in range(9500))]
    for _ in range(70):  # variants that differ from each other more than from the base
        line = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            line[r.randrange(40)] = r.choice(words)
        docs.append(" ".join(line))
    out = line_dedup.dedup_lines(make(docs)).orderBy("doc_id").collect()
    assert [list(x["removed"]) for x in out] == kept_lines(docs)


def test_short_lines_have_one_signature_and_meet_longer_ones(make):
    r = random.Random(8)
    words = [f"u{i}" for i in range(600)]
    base = r.sample(words, 70)
    docs = [" ".join(base[: r.randint(45, 70)] + r.sample(words, r.randint(0, 4))) for _ in range(60)]
    docs += ["\x0b".join(base[:60]), "\t".join(base[:50]) + "\r", "\x0c".join(base[:57])]
    table = make(docs)
    sizes = line_dedup.magnitudes(table, line_dedup.Scratch(table.sparkSession, "test"))
    lines = line_dedup.keyed(table, sizes).collect()
    assert min(x["n"] for x in lines) <= line_dedup.SHORT < max(x["n"] for x in lines)
    assert all((x["s2"] == 0) == (x["n"] <= line_dedup.SHORT) and x["s1"] for x in lines)
    out = line_dedup.dedup_lines(table).orderBy("doc_id").collect()
    assert [list(x["removed"]) for x in out] == kept_lines(docs)


@pytest.mark.parametrize("low", [-(1 << 63), (1 << 63) - 200, None])
def test_places_are_numbers_where_ids_lie_close(make, monkeypatch, low):
    """Then classes need no ordering; far ones, and ids of other types, are ordered as before."""
    written, write = [], line_dedup.Scratch.write
    monkeypatch.setattr(line_dedup.Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    r = random.Random(11)
    lines = [line for t in corpus(4, 30) for line in t.split(" x")][:60]
    docs = ["\n".join(r.choice(lines) for _ in range(r.randint(1, 6))) for _ in range(20)]
    table = make([((low or 0) + i, t) for i, t in enumerate(docs)] + [(None, "\n".join(lines[:9])), (None, lines[40])])
    if low is None:  # by code point, as numbers of three digits
        table = table.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 3, "0"))
    out = line_dedup.dedup_lines(table).where("doc_id IS NOT NULL").orderBy("doc_id").collect()
    assert [list(x["removed"]) for x in out] == kept_lines(docs)
    assert ("grouped" in written) == (low is None)
    if low is not None:
        far = line_dedup.dedup_lines(table.withColumn("doc_id", F.when(F.col("doc_id") == low, -(1 << 63)).when(F.col("doc_id") == low + 19, (1 << 63) - 1).otherwise(F.col("doc_id"))))
        assert [list(x["removed"]) for x in far.where("doc_id IS NOT NULL").orderBy("doc_id").collect()] == kept_lines(docs)
        assert "grouped" in written


def test_classes_keep_repeated_keys_at_their_places(make):
    table = make(["once shared twice again more", "shared twice other again more", None, "lone solo single sole"])
    scratch = line_dedup.Scratch(table.sparkSession, "test")
    sizes = line_dedup.magnitudes(table, scratch)
    classes = line_dedup.numbered(line_dedup.keyed(table, sizes), table, scratch).orderBy("cls").collect()
    assert [(x["doc_id"], x["line_no"], x["single"], len(x["prefix"])) for x in classes] == [(0, 0, 1, 1), (1, 0, 1, 1), (3, 0, 1, 0)]
    assert all(k >= 1 << line_dedup.HASH_BITS for x in classes for k in x["prefix"])


def test_only_crowded_keys_are_compared_beforehand(make, monkeypatch):
    """Frequent words alone bring no class to the first comparison."""
    found, similar = [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, words: found.append(pairs.count()) or similar(pairs, words))
    words, r = [f"c{i}" for i in range(30)], random.Random(3)
    docs = ["\n".join(" ".join([*r.sample(words, 9), *[f"n{d}x{k}y{i % 3}" for i in range(3)]]) for k in range(5)) for d in range(20)]
    few = [" ".join([*words[:25], *r.sample(words[25:], 2)]) for _ in range(10)]
    out = line_dedup.dedup_lines(make(docs + few)).orderBy("doc_id").collect()
    assert [list(x["removed"]) for x in out] == kept_lines(docs + few)
    assert found[0] == 0


def test_lines_asked_for_under_an_id_of_several_texts(make):
    a, b = "one two three four five six seven", "red green blue black white grey pink"
    rows = [(4, a + "\n" + b), (4, "short"), (4, None), (5, b + " more"), (6, "zero\n" + a + " too")]
    out = line_dedup.dedup_lines(make(rows)).orderBy("doc_id", "text").collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(4, None), (4, a + "\n" + b), (4, "short"), (5, ""), (6, "zero")]


def unrepeated(docs, width=20):
    split = [(t or "").encode().split() for t in docs]
    first, out = {}, []
    for d, words in enumerate(split):
        for i in range(len(words) - width + 1):
            first.setdefault(tuple(words[i : i + width]), (d, i))
    for d, words in enumerate(split):
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        out.append((d, len(words), b" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_all_windows(make, seed):
    docs = EDGES + corpus(seed)
    out = substring_dedup.remove_repeats(make(docs, extra=True)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], bytes(r["kept"])) for r in out] == unrepeated(docs)


def test_paths_over_several_pieces(make, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PLACES", 4)
    docs = corpus(6, 30)
    out = substring_dedup.remove_repeats(make(docs)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], bytes(r["kept"])) for r in out] == unrepeated(docs)


def test_substrings_under_one_or_no_id(make):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "xy")
    rows = [(None, a + " " + b), (None, b + " " + a), (7, a), (7, b), (9, b)]
    out = substring_dedup.remove_repeats(make(rows)).collect()
    # the texts under 7 are one document with two texts at the same places
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_kept"]) for r in out) == [("7", 40, 40), ("7", 40, 40), ("9", 40, 0), ("None", 80, 0), ("None", 80, 0)]


def test_substrings_of_nulls_and_nothing(make):
    long = " ".join(f"v{i}" for i in range(30))
    out = substring_dedup.remove_repeats(make([(None, long), (4, long), (4, long), (9, "z " + long)])).collect()
    assert sorted((str(r["doc_id"]), r["n_kept"]) for r in out) == [("4", 30), ("4", 30), ("9", 1), ("None", 0)]
    assert substring_dedup.remove_repeats(make([])).collect() == []


def test_paths_of_unlike_words_are_parted(spark):
    """Two wordings under one path, as after a collision of hashes, each keep their earliest place."""
    spans = spark.createDataFrame([(1, b"d", 7, 0, 20, False), (2, b"d", 7, 0, 20, True), (3, b"d", 7, 0, 20, True)], "doc_id long, digest binary, head long, at int, n_words int, goes boolean")
    checks = spark.createDataFrame([(1, 7, 0, b"x"), (2, 7, 0, b"y"), (3, 7, 0, b"y")], "doc_id long, head long, at int, words binary")
    assert sorted((r["doc_id"], r["goes"]) for r in substring_dedup._parted(spans, checks).collect()) == [(1, False), (2, False), (3, True)]
