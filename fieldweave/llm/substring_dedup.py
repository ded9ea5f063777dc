"""Removal of long repeated word sequences by compaction of a de Bruijn graph.

A window of ``width`` words is an edge between the runs of ``width - 1`` words
that it starts and ends with. Words of a window go if the same window also
starts earlier (smaller document id, or the same document, earlier start).

1. Texts equal to one of a smaller id go whole, if they hold a window.
2. Every window has a seed, the smallest hash among its runs of ``SEED``
   words; equal windows have equal seeds. Only windows whose seed occurs twice
   in the corpus can repeat: about one word in seven brings a seed, and unique
   text gets no further.
3. Windows with such seeds are counted as edges, with their earliest place
   and the edges before and after them. An edge and the next belong to one
   path if neither has another neighbour there. All edges of a path occur
   together, so in the text of its earliest place they are neighbours: edges of
   the same few places of a text are first put together to pieces, which
   bounds every group, and pieces are joined to the pieces they go on in, and
   those pointers to themselves, which halves the way to a path's head each time.
4. Paths, each known by its first edge, are joined with that edge's places:
   a span per occurrence, all but the earliest to be removed.
5. Spans are verified by digests of their words at each place; if a hash of
   edges has united different words, the digests set them apart again.

Defined results: a null text has no words; texts under ``width`` words keep
all. Null ids come last in order. Rows that repeat an id are one document:
a window at the same start in both is one place. An empty table gives an empty
result. Other columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, slices, table, utf8
from .hashing import run_hashes, word_hashes

WIDTH = 20
SEED = 8
#: Places of a text whose edges are ordered together.
PLACES = 64


def seeds(words: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window, its seed's hash and place (the first of equal ones)."""
    runs = run_hashes(words, seed)
    n, within = len(words) - width + 1, width - seed + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # the least of a span is that of two shorter ones that cover it
    best, at, span = runs, np.arange(len(runs)), 1
    while span < within:
        step = min(span, within - span)
        less = best[step:] < best[:-step]
        best, at, span = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step]), span + step
    return best[:n], at[:n]


def _by_doc(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each word's document, and the windows that lie in one document."""
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(words) - width + 1)
    inside = doc[:n] == doc[width - 1 : width - 1 + n]
    return words, doc, inside


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), utf8("text").alias("text"))


def seed_table(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, digest, seeds``: the hashes of the seeds of all rows, one for each place up to two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words, doc, inside = _by_doc(texts, width)
                best, at = seeds(words, width, SEED)
                best, at = best[inside], at[inside]
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                # a seed's place may serve windows that others interrupt; once is enough
                place, first = np.unique(at[new], return_index=True)
                found, owner = best[new][first], doc[place]
                order = np.lexsort((found, owner))
                found, owner = found[order], owner[order]
                # two places in a document already make a seed a repeated one
                third = np.zeros(len(found), bool)
                third[2:] = (found[2:] == found[:-2]) & (owner[2:] == owner[:-2])
                found, owner = found[~third], owner[~third]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(found.view(np.int64), owner, len(texts))], ["doc_id", "digest", "seeds"])

    return _texts(docs).mapInArrow(run, "doc_id long, digest binary, seeds array<long>")


def edge_runs(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``doc_id, start, hashes``: the neighbouring windows that may repeat, for ``asked(a_id, a_digest, repeated)``."""
    texts = _texts(docs).join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in slices(batch, "text"):
                words, doc, inside = _by_doc(own, width)
                best, _ = seeds(words, width, SEED)
                repeated = part.column(2)
                asked_seeds = repeated.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), np.diff(repeated.offsets.to_numpy()))
                # a seed counts in its own document only: compare hashes mixed with the document
                salt = np.uint64(0x9FB21C651E98DF25)
                sought = np.sort(asked_seeds ^ (owner.astype(np.uint64) * salt))
                have = best ^ (doc[: len(best)].astype(np.uint64) * salt)
                hit = sought[np.minimum(np.searchsorted(sought, have), len(sought) - 1)] == have if len(sought) else np.zeros(len(have), bool)
                hit &= inside
                places = np.flatnonzero(hit)
                if not len(places):
                    continue
                edge = run_hashes(words, width)[places].view(np.int64)
                cut = np.ones(len(places), bool)
                cut[1:] = (np.diff(places) != 1) | (doc[places[1:]] != doc[places[:-1]])
                heads = np.flatnonzero(cut)
                first_word = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                of = doc[places[heads]]
                start = (places[heads] - first_word[of]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(np.append(heads, len(places)).astype(np.int32)), pa.array(edge))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(start), hashes], ["doc_id", "digest", "start", "hashes"])

    return texts.select("doc_id", "digest", "repeated", "text").mapInArrow(run, "doc_id long, digest binary, start int, hashes array<long>")


def pieces(occurrences: DataFrame) -> DataFrame:
    """``head, tail, before, after, n_edges, f_doc, f_digest, f_at``: neighbouring edges of one path within ``PLACES`` places."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at", "digest")
    edges = occurrences.groupBy("edge").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")
    )
    only = lambda low, high: F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.lit(0))
    first = [F.col(f"first.{c}").alias(f"f_{name}") for c, name in (("doc_id", "doc"), ("digest", "digest"), ("at", "at"))]
    edges = edges.where("n > 1").select("edge", *first, only("b0", "b1").alias("before"), only("a0", "a1").alias("after"))
    edges = edges.withColumn("block", (F.col("f_at") / PLACES).cast("int"))
    order = W.partitionBy("f_doc", "f_digest", "block").orderBy("f_at")
    last = lambda c: F.lag(c).over(order)
    goes_on = (F.col("before") != 0) & (last("edge") == F.col("before")) & (last("after") == F.col("edge")) & (last("f_at") + 1 == F.col("f_at"))
    islands = edges.withColumn("piece", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    at = lambda take, c: take(c, "f_at").alias(c)
    return islands.groupBy("f_doc", "f_digest", "block", "piece").agg(
        F.min_by("edge", "f_at").alias("head"), F.max_by("edge", "f_at").alias("tail"), at(F.min_by, "before"), at(F.max_by, "after"), F.count(F.lit(1)).cast("int").alias("n_edges"), F.min("f_at").alias("f_at")
    ).drop("block", "piece")


def paths(occurrences: DataFrame, scratch: Scratch) -> DataFrame:
    """``head, n_edges, f_doc, f_at`` of the compacted repeated paths: first edge, edges, earliest place."""
    parts = scratch.write(pieces(occurrences), "pieces")
    scratch.release()
    left, right = parts.alias("p"), parts.alias("q")
    follows = (F.col("p.after") == F.col("q.head")) & (F.col("q.before") == F.col("p.tail")) & F.col("p.f_doc").eqNullSafe(F.col("q.f_doc")) & (F.col("p.f_digest") == F.col("q.f_digest"))
    follows &= F.col("p.f_at") + F.col("p.n_edges") == F.col("q.f_at")
    up = scratch.write(left.join(right, follows).select(F.col("q.head").alias("node"), F.col("p.head").alias("to")), "up0")
    turn = 0
    while True:  # places along a path increase, so pointers have an end
        ahead = up.select(F.col("node").alias("via"), F.col("to").alias("on"))
        new = up.join(ahead, F.col("to") == F.col("via"), "left").select("node", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved"))
        turn += 1
        new = scratch.write(new, f"up{turn}")
        scratch.drop(f"up{turn - 1}")
        scratch.release()
        up = new.select("node", "to")
        if not new.where("moved").limit(1).count():
            break
    of = parts.join(up, F.col("head") == F.col("node"), "left").withColumn("root", F.coalesce("to", "head"))
    return of.groupBy(F.col("root").alias("head")).agg(F.sum("n_edges").cast("int").alias("n_edges"), F.first("f_doc").alias("f_doc"), F.min("f_at").alias("f_at"))


def _applied(docs: DataFrame, decisions: DataFrame, width: int) -> DataFrame:
    """Every row with what is left of its words, and digests of the words of its spans."""
    joined = _texts(docs).join(decisions, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("digest") == F.col("d_digest")), "left")
    joined = joined.select("doc_id", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("spans", F.array().cast("array<struct<head:bigint,at:int,n_words:int,goes:boolean>>")).alias("spans"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows = {"doc_id": part.column(0), "n_words": [], "kept": [], "n_kept": [], "checks": []}
                for text, copy, spans in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.split()
                    rows["n_words"].append(len(words))
                    rows["checks"].append([{"head": s["head"], "at": s["at"], "words": hashlib.blake2b(b" ".join(words[s["at"] : s["at"] + s["n_words"]]), digest_size=16).digest()} for s in spans])
                    if copy and len(words) >= width:
                        words = []
                    elif any(s["goes"] for s in spans):
                        keep = np.ones(len(words), bool)
                        for s in spans:
                            if s["goes"]:
                                keep[s["at"] : s["at"] + s["n_words"]] = False
                        words = [words[i] for i in np.flatnonzero(keep)]
                    rows["kept"].append(b" ".join(words))
                    rows["n_kept"].append(len(words))
                checks = pa.array(rows["checks"], pa.list_(pa.struct([("head", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])))
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_kept"], pa.int64()), pa.array(rows["kept"], pa.binary()), checks], ["doc_id", "n_words", "n_kept", "kept", "checks"])

    schema = "doc_id long, n_words long, n_kept long, kept binary, checks array<struct<head:bigint,at:int,words:binary>>"
    return joined.mapInArrow(run, schema)


def _decisions(spans: DataFrame, copies: DataFrame) -> DataFrame:
    """``d_id, d_digest, copy, spans`` per text. ``spans``: ``doc_id, digest, head, at, n_words, goes``."""
    listed = spans.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("head", "at", "n_words", "goes")).alias("spans")).withColumn("copy", F.lit(False))
    whole = copies.select("doc_id", "digest", F.lit(None).cast(listed.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy"))
    return listed.unionByName(whole).select(F.col("doc_id").alias("d_id"), F.col("digest").alias("d_digest"), "copy", "spans")


def remove_repeats(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_kept, kept`` for every row of ``docs(doc_id, text)``; ``kept``: the bytes of the words left, one space between."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    all_seeds = scratch.write(seed_table(docs, width), "seeds")
    firsts = all_seeds.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"), F.first("seeds").alias("seeds"))
    firsts = scratch.write(firsts.select("digest", F.col("first.doc_id").alias("doc_id"), "seeds"), "firsts")
    other = firsts.select(F.col("digest").alias("f_digest"), F.col("doc_id").alias("f_id"))
    copies = all_seeds.select("doc_id", "digest").distinct().join(other, F.col("digest") == F.col("f_digest")).where(~F.col("doc_id").eqNullSafe(F.col("f_id"))).select("doc_id", "digest")
    copies = scratch.write(copies, "copies")
    scratch.drop("seeds")
    placed = firsts.select("doc_id", "digest", F.explode("seeds").alias("seed"))
    twice = placed.groupBy(F.col("seed").alias("twice")).count().where("count > 1").select("twice")
    asked = placed.join(twice, F.col("seed") == F.col("twice")).groupBy(F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest")).agg(F.collect_set("seed").alias("repeated"))
    asked = scratch.write(asked, "asked")
    scratch.drop("firsts")
    scratch.release()
    runs = scratch.write(edge_runs(docs, asked, width), "runs")
    scratch.drop("asked")
    scratch.release()
    at = runs.select("doc_id", "digest", "start", "hashes", F.posexplode("hashes").alias("i", "edge"))
    none = F.lit(0).cast("long")
    neighbour = lambda step: F.coalesce(F.get("hashes", F.col("i") + step), none)
    occurrences = at.select("doc_id", "digest", (F.col("start") + F.col("i")).alias("at"), "edge", neighbour(-1).alias("before"), neighbour(1).alias("after"))
    heads = scratch.write(paths(occurrences, scratch), "heads")
    scratch.release()
    places = at.select("doc_id", "digest", (F.col("start") + F.col("i")).alias("at"), "edge")
    goes = ~F.col("doc_id").eqNullSafe(F.col("f_doc")) | (F.col("at") != F.col("f_at"))
    spans = places.join(heads, F.col("edge") == F.col("head")).select("doc_id", "digest", "head", "at", (F.col("n_edges") + width - 1).alias("n_words"), goes.alias("goes"))
    spans = scratch.write(spans, "spans")
    scratch.drop("runs", "heads", "pieces")
    scratch.release()
    out = scratch.write(_applied(docs, _decisions(spans, copies), width), "applied")
    scratch.release()
    checks = out.select("doc_id", F.explode("checks").alias("c")).select("doc_id", "c.head", "c.at", "c.words")
    false = checks.groupBy("head").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low <> high")
    if false.limit(1).count():
        out = scratch.write(_applied(docs, _decisions(_parted(spans, checks), copies), width), "reapplied")
    return out.drop("checks")


def _parted(spans: DataFrame, checks: DataFrame) -> DataFrame:
    """Spans whose path united different words: each wording has its own earliest place."""
    words = checks.select(F.col("doc_id").alias("c_id"), F.col("head").alias("c_head"), F.col("at").alias("c_at"), "words").distinct()
    known = spans.join(words, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("head") == F.col("c_head")) & (F.col("at") == F.col("c_at")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    first = known.groupBy(F.col("head").alias("g_head"), F.col("words").alias("g_words")).agg(F.min(place).alias("first"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("at") != F.col("first.at"))
    return known.join(first, (F.col("head") == F.col("g_head")) & (F.col("words") == F.col("g_words"))).select("doc_id", "digest", "head", "at", "n_words", goes.alias("goes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", (F.col("n_words") - F.col("n_kept")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (SELECT doc_id, p, w FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN covered USING (doc_id, p)),
texts AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN texts USING (doc_id)
"""
