"""Quality rules as a bitmask ledger.

Texts are measured once and every rule is evaluated once; a ledger row holds
the measurements and one bit per failed rule. A policy is a version name with
a mask of the rules that reject. Applying one, comparing two or leaving one
rule out (an ablation) are bitwise operations on the ledger; texts are not
read again.

Defined results: a null text has no words and fails the rule on few words; an
empty table gives an empty ledger; every row is judged alone, so repeated rows
get equal results; a null id stays null; other columns are ignored. Texts of
any length are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, small_batches, table, utf8

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaim")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements; integers only, so that every engine agrees


#: A rule's bit is its place here: new rules go to the end, and none is taken out.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("upper_case", "100 * n_upper > 50 * (n_upper + n_lower)"),
    Rule("exclamations", "100 * n_exclaim > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versions of the policy: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "2024-1": ("few_words", "repeated_windows", "many_symbols", "upper_case"),
    "2024-2": tuple(BIT),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """Per document, its words in windows of ``width`` words that the document holds twice or more.

    A hash of each window finds those that may repeat; their words decide.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = window * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    window = (window ^ (window >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    order = np.argsort(window[inside])
    ranked = window[inside][order]
    same = ranked[1:] == ranked[:-1]
    maybe = np.zeros(len(inside), bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    starts = inside[maybe]
    if not len(starts):
        return np.zeros(n_docs, np.int64)
    rows = np.column_stack([doc[starts], *(ids[starts + k] for k in range(width))])
    _, place, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = starts[times[place.reshape(-1)] > 1]
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    covered = np.cumsum(steps[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    split = [text.split() for text in texts]
    n_words = np.array([len(x) for x in split], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for x in split for w in x), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(texts)), n_words)
    out = {"n_words": n_words, "n_repeat_words": repeat_words(ids, doc, len(texts))}
    bounds = np.cumsum(np.array([0, *map(len, texts)], np.int64))
    flat = np.frombuffer(b"".join(texts), np.uint8)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    out["word_chars"] = per_text(((flat & 0xC0) != 0x80) & (flat != 32) & ((flat < 9) | (flat > 13)))
    out["n_symbols"] = per_text(np.isin(flat, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_upper"] = per_text((flat >= 65) & (flat <= 90))
    out["n_lower"] = per_text((flat >= 97) & (flat <= 122))
    out["n_exclaim"] = per_text(flat == 33)
    lines = [[x for x in text.split(b"\n") if x and not x.isspace()] for text in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = out["n_lines"] - np.array([len(set(x)) for x in lines], np.int64)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            found = measured(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed``: the bits of the rules that a document fails."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(_measure, schema).withColumn("failed", failed_bits())


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    rejected = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    return entries.withColumn("kept", rejected == 0).withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0)


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects and its removal would keep.

    One aggregation over the distinct patterns of bits, of which there are at
    most two to the number of rules.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("fails"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def ablation_query(spark, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")))


_BITS = " + ".join(f"CASE WHEN {rule.fails} THEN {BIT[rule.name]} ELSE 0 END" for rule in RULES)
_LEDGER = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}')),
per_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower, len(regexp_extract_all(t, '!')) AS n_exclaim
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN per_doc USING (doc_id)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m)
"""
ORACLE = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask("base")} <> 0 AS base_failed, failed & {mask(CURRENT)} = 0 AS kept, failed FROM b
"""
_RULES = ", ".join(f"('{name}', CAST({BIT[name]} AS BIGINT))" for name in POLICIES[CURRENT])
ABLATION_ORACLE = f"""{_LEDGER}
SELECT rule, bit, count(*) FILTER (failed & {mask(CURRENT)} & bit <> 0) AS fails, count(*) FILTER (failed & {mask(CURRENT)} = bit) AS only_this FROM (VALUES {_RULES}) r(rule, bit), b GROUP BY rule, bit
"""
