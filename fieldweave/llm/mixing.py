"""Mixing sources to target weights by Pareto order sampling.

Every document has a measure, by default the number of binary digits of its
word count, so that longer documents are likelier. Its expected number of
copies is proportional to its measure, up to a limit, so that its source
expects its target. The whole part is certain; for the fraction ``p`` the
documents of a source are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with a
random ``u`` fixed by the document's id, and the first ones are taken until
the source's words reach its target. At last up to two documents of a source
change sides, each the one that brings the words nearest to the target, which
matters for sources of few documents.

Measures are grades: a source has few different ones, as sizes and sums of a
source's grades are brought into one order.

Defined results: a null text has size 0 and takes no words; null sources form
one source of their own, last in order; a null id draws the number of the
text "null"; a null or negative measure counts as 0, and such documents are
not taken. Rows that repeat an id draw the same number and are ranked by size.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, Scratch, apart, broadcast_if, table

#: Steps of the cumulative table per source; only memory for it depends on this, no result does.
BINS = 4096
#: How many documents of a source, at most, are put in or left out against their rank, to come nearer to its target.
EXCHANGES = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from a key, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def reshared_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """``(source, source_size, target)``: all words shared by weight, no target above ``most`` times its source.

    ``sizes`` has one row per source. Sources by code point, null last, take
    the weights in turn. Stopping a target and sharing its excess among the
    others, again and again, ends where the sources with the smallest
    ``size / weight`` stand at their limit and the rest share what is left by
    weight; one ordered pass finds that point.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    by_limit = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("own_level", level)
        .withColumn("open", F.col("cap") > F.col("own_level") * F.col("w"))
        .withColumn("level", F.max(F.when(F.col("open"), F.col("own_level"))).over(everything))
        .select("source", "source_size", F.when(F.col("open"), F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target"))
    )


def measure_of(size: Column) -> Column:
    """The number of binary digits of a size."""
    return F.length(F.bin(size)).cast("double")


def expected_copies(grades: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``source, measure, n, expected``: copies in proportion to measures, none above ``most``, that bring each source to its target.

    ``grades``: ``source, measure, n, words``. What a limit cuts off goes to the
    source's other documents; one pass in order of measure finds the level.
    """
    own = grades.join(targets.select(F.col("source").alias("t_source"), "target"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    down = W.partitionBy("source").orderBy(F.col("measure").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double")
    onward = F.sum(F.col("measure") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    level = F.when(F.col("onward") > 0, (F.col("target") - F.lit(float(most)) * F.col("before")) / F.col("onward"))
    found = own.withColumn("before", before).withColumn("onward", onward).withColumn("own", level).withColumn("open", F.coalesce(F.col("measure") * F.col("own") < float(most), F.lit(True)))
    level = F.max(F.when(F.col("open"), F.col("own"))).over(W.partitionBy("source"))
    expected = F.when(~F.col("open"), F.lit(float(most))).otherwise(F.coalesce(F.col("level") * F.col("measure"), F.lit(0.0)))
    return found.withColumn("level", level).select("source", "measure", "n", expected.alias("expected"))


def pareto_mix(docs: DataFrame, targets: DataFrame, scratch: Scratch, *, most: float = 3, seed: str = SEED) -> DataFrame:
    """``docs(doc_id, source, size, measure)`` with ``copies`` and ``taken`` words.

    ``targets``: ``source, source_size, target``. Counts are cumulated over
    bins of the rank first, so a source of any size is spread over many tasks
    and only the rows of one bin are ever ordered together. A bin is the rank's
    share in the source, from the shares of its grades: bins are about equal,
    whatever the odds.
    """
    n_sources = targets.count()
    docs = docs.withColumn("measure", F.greatest(F.coalesce(F.col("measure").cast("double"), F.lit(0.0)), F.lit(0.0)))
    grades = docs.groupBy("source", "measure").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    grades = scratch.write(expected_copies(grades, targets, most), "grades")
    # A whole number missed by rounding in the last place is that whole number.
    grades = grades.withColumn("certain", F.floor(F.col("expected") + 1e-9).cast("double")).withColumn("p", F.col("expected") - F.col("certain"))
    odds = F.col("p") / (1 - F.col("p"))
    alike = grades.where("p > 0").withColumn("power", F.floor(F.log2(odds))).groupBy("source", "power").agg(F.sum("n").alias("n"))
    parts = alike.groupBy("source").agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), F.pow(F.lit(2.0), F.col("power")).alias("odds"))).alias("parts"), F.sum("n").cast("double").alias("all"))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    sources = targets.join(named(parts, "p"), F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    own = docs.join(broadcast_if(named(sources, "s"), n_sources), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    own = own.join(broadcast_if(named(grades, "g"), grades.count()), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("measure") == F.col("g_measure")))
    q = F.when(F.col("g_p") > 0, (F.col("u") / (1 - F.col("u"))) * (1 - F.col("g_p")) / F.col("g_p"))
    share = F.aggregate("s_p_parts", F.lit(0.0), lambda a, x: a + x["n"] * (F.col("q") * x["odds"]) / (1 + F.col("q") * x["odds"])) / F.col("s_p_all")
    ranked = (
        own.withColumn("u", uniform(F.col("doc_id"), seed))
        .withColumn("q", q)
        .withColumn("bin", F.when(F.col("q").isNotNull(), F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")))
        .select("doc_id", "source", "size", F.col("s_source_size").alias("source_size"), F.col("s_target").alias("target"), F.col("g_certain").alias("certain"), "q", "bin", F.monotonically_increasing_id().alias("row"))
    )
    ranked = scratch.write(ranked, "ranked")
    certain = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("left"))
    cumulative = W.partitionBy("source").orderBy("bin")
    bins = (
        ranked.where("bin IS NOT NULL")
        .groupBy("source", "bin")
        .agg(F.sum("size").alias("bin_size"))
        .withColumn("before", F.sum("bin_size").over(cumulative) - F.col("bin_size"))
        .alias("b")
        .join(broadcast_if(certain.alias("c"), n_sources), F.col("b.source").eqNullSafe(F.col("c.source")))
        .select(F.col("b.source").alias("b_source"), F.col("bin").alias("b_bin"), "before", "left")
    )
    in_bin = W.partitionBy("source", "bin").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    chosen = (
        ranked.where("bin IS NOT NULL")
        .withColumn("in_bin", F.sum("size").over(in_bin))
        .join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
        # A document goes in if more than half of it still fits.
        .withColumn("extra", (F.col("before") + F.col("in_bin") - F.col("size") / 2 <= F.col("left")).cast("long"))
        .drop("in_bin", "before", "left", "b_source", "b_bin")
    )
    chosen = chosen.unionByName(ranked.where("bin IS NULL").withColumn("extra", F.lit(0).cast("long")))
    for turn in range(EXCHANGES):
        chosen = _exchanged(scratch.write(chosen, f"chosen{turn}"), n_sources)
    copies = (F.col("certain") + F.col("extra")).cast("long")
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _exchanged(chosen: DataFrame, n_sources: int) -> DataFrame:
    """Take or leave the one document per source that brings its words nearest to the target, if any does."""
    gaps = chosen.groupBy(F.col("source").alias("g_source")).agg((F.first("target") - F.sum((F.col("certain") + F.col("extra")) * F.col("size"))).alias("gap"))
    off = F.abs(F.col("gap") - F.when(F.col("extra") == 0, F.col("size")).otherwise(-F.col("size")))
    better = (
        chosen.where("bin IS NOT NULL")
        .join(broadcast_if(gaps, n_sources), F.col("source").eqNullSafe(F.col("g_source")))
        .where(off < F.abs(F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "q", "doc_id", "row")).alias("best"))
        .select(F.col("best.row").alias("best_row"))
    )
    turned = F.when(F.col("best_row").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))
    return chosen.join(broadcast_if(better, n_sources), F.col("row") == F.col("best_row"), "left").withColumn("extra", turned).drop("best_row")


def mix_documents(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, seed: str = SEED, measure: Column | None = None) -> DataFrame:
    """Mix ``docs(doc_id, source, text)`` to the weights of its sources.

    ``measure``, over the columns of ``docs``, stands for the number of binary digits of the word count.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = word_count(F.col("text"))
    measured = docs.select("doc_id", "source", size.alias("size"), *([] if measure is None else [measure.alias("measure")]))
    measured = scratch.write(measured, "sized")
    if measure is None:
        measured = measured.withColumn("measure", measure_of(F.col("size")))
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.write(reshared_targets(sizes, weights, most), "targets")
    return pareto_mix(measured, targets, scratch, most=most, seed=seed)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: a row for every copy, with all columns of ``docs``, whatever their names.

    Copies are looked up by ``doc_id``; rows that repeat an id, a source and a
    size get the copies of the one that has most.
    """
    plain = apart(docs, "doc_id", "source", "text")
    mix = mix_documents(plain.select("doc_id", "source", "text"), **options).groupBy("doc_id", "size", "source").agg(F.max("copies").alias("copies"))
    mix = mix.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), F.col("copies").alias("_copies"))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (word_count(F.col("text")) == F.col("_size"))
    # explode without a copy number: only its row count matters
    rows = plain.join(mix, match).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return rows.select(*plain.columns).toDF(*docs.columns)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
  [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sizes),
levels AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM weighed),
level AS (SELECT max(own) AS x FROM levels WHERE cap > own * w),
targets AS (SELECT source, source_size, CASE WHEN cap > own * w THEN x * w ELSE cap END AS target FROM levels, level),
measured AS (SELECT doc_id, source, size, CAST(length(bin(size)) AS DOUBLE) AS measure FROM sized),
grades AS (SELECT source, measure, CAST(sum(size) AS DOUBLE) AS words FROM measured GROUP BY ALL),
filled AS (SELECT g.source, g.measure, t.source_size, t.target,
  coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY measure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(measure * words) OVER (PARTITION BY g.source ORDER BY measure DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
  FROM grades g JOIN targets t ON g.source IS NOT DISTINCT FROM t.source),
owns AS (SELECT *, CASE WHEN onward > 0 THEN (target - 3.0::DOUBLE * before) / onward END AS own FROM filled),
opened AS (SELECT *, coalesce(measure * own < 3.0::DOUBLE, true) AS open FROM owns),
levelled AS (SELECT *, max(CASE WHEN open THEN own END) OVER (PARTITION BY source) AS x FROM opened),
expecting AS (SELECT source, measure, source_size, target, CASE WHEN NOT open THEN 3.0::DOUBLE ELSE coalesce(x * measure, 0) END AS expected FROM levelled),
ranked AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.source, floor(e.expected + 1e-9::DOUBLE) AS certain, e.expected - floor(e.expected + 1e-9::DOUBLE) AS p,
    (CAST(('0x' || substr(md5('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM measured d JOIN expecting e ON d.source IS NOT DISTINCT FROM e.source AND d.measure = e.measure),
odds AS (SELECT *, p > 0 AS can, CASE WHEN p > 0 THEN (u / (1 - u)) * (1 - p) / p END AS q FROM ranked),
cut AS (
  SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest,
    sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM odds),
x0 AS (SELECT *, CASE WHEN can AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS extra FROM cut),
g0 AS (SELECT *, target - sum((certain + extra) * size) OVER (PARTITION BY source) AS gap FROM x0),
o0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY can AND abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END) < abs(gap) DESC,
  abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END), q, doc_id) = 1 AND can AND abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END) < abs(gap) AS turn FROM g0),
x1 AS (SELECT * EXCLUDE (extra, gap, turn), CASE WHEN turn THEN 1 - extra ELSE extra END AS extra FROM o0),
g1 AS (SELECT *, target - sum((certain + extra) * size) OVER (PARTITION BY source) AS gap FROM x1),
o1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY can AND abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END) < abs(gap) DESC,
  abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END), q, doc_id) = 1 AND can AND abs(gap - CASE WHEN extra = 0 THEN size ELSE -size END) < abs(gap) AS turn FROM g1),
x2 AS (SELECT * EXCLUDE (extra), CASE WHEN turn THEN 1 - extra ELSE extra END AS extra FROM o1)
SELECT doc_id, size, source_size, target, CAST((certain + extra) * size AS BIGINT) AS taken FROM x2
"""


def query(spark, sf_dir: str) -> DataFrame:
    mix = mix_documents(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
