"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

The driver packs the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are:

1. Large lengths are put in descending order into groups of equal cardinality
   and rounded up to the largest of their group (linear grouping).
2. Configurations of these few sizes are optimised by column generation:
   a simplex over the groups, priced by a knapsack.
3. Actual lengths take the places of the rounded ones.
4. What is left, and all small lengths, go by best fit, largest first, into
   the fullest bins with room, then into new bins.

The plan is a list of segments "the pieces of length l with ranks a to b go to
bins from c on, at offset o"; ranks are dealt out by Spark and joined to it.

Defined results: a null text has no tokens and is one piece of the end token;
a null id stays null; rows that repeat an id are packed each on its own; an
empty table gives an empty result. Texts of any length are tokenized whole,
and cut only if they exceed the capacity. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, slices, small_batches, table, utf8

CAPACITY = 4096
END = np.uint32(1).tobytes()
GROUPS = 40
#: Lengths up to this share of the capacity are small.
SMALL = 1 / 8
#: Entries of a worker's memory of words, about 200 bytes each; beyond it the memory starts anew.
MEMORY = 1_000_000


#: Texts that tell whether a tokenizer joins across blanks.
PROBES = ("a b", " a  b ", "word\nword", "it 's\tthe 3 . 5", "\u00e9 e\u0301 x", "The end .\r\n New")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """A tokenizer, a memory of words, and whether a text's ids are those of its words in turn."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    apart = all(ids(text) == [i for word in text.split() for i in ids(word)] for text in PROBES)
    blanks = any(any(c.isspace() for c in str(token.content)) for token in tokenizer.get_added_tokens_decoder().values())
    return tokenizer, {}, apart and not blanks


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids with the end id, as little-endian 32-bit numbers.

    A vocabulary that drops white space and never joins across it gives a text
    the ids of its words in turn, and words are looked up in a memory. With
    any other, texts are tokenized whole.
    """
    tokenizer, known, by_word = _tokenizer(path)
    if not by_word:
        return [array("I", tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes() + END for text in texts]
    split = [text.split() for text in texts]
    new = list(set().union(*split).difference(known))
    if len(known) + len(new) > MEMORY:
        known.clear()
        new = list(set().union(*split))
    for start in range(0, len(new), 20_000):
        some = new[start : start + 20_000]
        for word, ids in zip(some, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
            known[word] = array("I", ids.ids).tobytes()
    look = known.__getitem__
    return [b"".join([*map(look, x), END]) for x in split]


def tokenized(docs: DataFrame, *, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, and the ids themselves if wanted."""
    path = path or vocabulary()
    small_batches(docs.sparkSession)
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(token_bytes(texts, path)):
                    for k, at in enumerate(range(0, len(data), width)):
                        own = data[at : at + width]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, np.uint32).astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, schema)


def _groups(counts: dict[int, int], n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths in descending order in groups of equal cardinality: ``(largest, [(length, count), ...])``."""
    total = sum(counts.values())
    out: list[tuple[int, list[tuple[int, int]]]] = []
    each, room = -(-total // n_groups), 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append((length, []))
                room = each
            some = min(n, room)
            out[-1][1].append((length, some))
            n, room = n - some, room - some
    return out


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of greatest value, any number of each size: by number of things in it."""
    best = np.zeros(capacity + 1)
    choices = []
    for _ in range(capacity // int(sizes.min())):
        grown = np.full((len(sizes), capacity + 1), -np.inf)
        for g, s in enumerate(sizes):
            grown[g, s:] = best[: capacity + 1 - s] + values[g]
        pick = grown.argmax(0)
        value = grown[pick, np.arange(capacity + 1)]
        better = value > best + 1e-12
        if not better.any():
            break
        choices.append(np.where(better, pick, -1))
        best = np.where(better, value, best)
    config, room = np.zeros(len(sizes), np.int64), capacity
    for layer in reversed(choices):
        if layer[room] >= 0:
            config[layer[room]] += 1
            room -= int(sizes[layer[room]])
    return float(config @ values), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_steps: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the linear optimum, rounded down."""
    g = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(most_steps):
        inverse = np.linalg.inv(basis)
        amounts, prices = inverse @ demand, np.ones(g) @ inverse
        value, config = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ config
        ratios = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratios.argmin())] = config
    amounts = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(basis[:, j].astype(np.int64), int(amounts[j] + 1e-6)) for j in range(g) if amounts[j] >= 1 - 1e-6]


def plan(counts: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(length, first rank, pieces, first bin, offset)`` for a histogram of lengths."""
    segments: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)  # ranks given away, by length
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first bin, bins), by what is still free in them
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        segments.append((length, used[length], n, first, offset))
        used[length] += n

    large = {length: n for length, n in counts.items() if length > capacity * SMALL}
    if large:
        groups = _groups(large, n_groups)
        sizes = np.array([size for size, _ in groups])
        demand = np.array([sum(n for _, n in members) for _, members in groups], float)
        queues = [list(reversed(members)) for _, members in groups]
        for config, times in configurations(sizes, demand, capacity):
            places = [q for q, n in enumerate(config) for _ in range(int(n))]
            left = int(min([times, *(sum(n for _, n in queues[q]) // int(config[q]) for q in set(places))]))
            taken = []  # a run of actual lengths for each place
            for q in places:
                run, need = [], left
                while need:
                    length, n = queues[q].pop()
                    some = min(n, need)
                    run.append((length, some))
                    need -= some
                    if n > some:
                        queues[q].append((length, n - some))
                taken.append(list(reversed(run)))
            while left:  # bins in a row whose places hold equal lengths
                some, fill = min(run[-1][1] for run in taken), 0
                for run in taken:
                    length, n = run.pop()
                    put(length, some, bins, fill)
                    fill += length
                    if n > some:
                        run.append((length, n - some))
                rooms[capacity - fill].append((bins, some))
                bins, left = bins + some, left - some
    open_rooms = sorted(r for r in rooms if r)  # a sorted list is a heap of the smallest
    rest = {length: n - used[length] for length, n in counts.items() if n > used[length]}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        # fullest first among the bins with room; what is left of them goes back
        candidates = [r for r in open_rooms if r >= length]
        heapq.heapify(candidates)
        while n and candidates:
            room = candidates[0]
            if not rooms[room]:
                heapq.heappop(candidates)
                continue
            first, k = rooms[room].pop()
            some = min(k, n)
            put(length, some, first, capacity - room)
            if k > some:
                rooms[room].append((first + some, k - some))
            if room > length:
                if room - length >= length and not rooms[room - length]:
                    heapq.heappush(candidates, room - length)
                rooms[room - length].append((first, some))
            n -= some
        each = capacity // length
        for fit in ([each] if n >= each else []) + ([n % each] if n % each else []):
            some = n // each if fit == each and n >= each else 1
            for place in range(fit):
                put(length, some, bins, place * length)
            rooms[capacity - fit * length].append((bins, some))
            bins += some
        open_rooms = sorted(r for r, x in rooms.items() if r and x)
    return segments


def pack(pieces: DataFrame, scratch: Scratch, *, capacity: int = CAPACITY, cell_rows: int = 512) -> DataFrame:
    """``pieces`` (a table with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``.

    Ranks within a length are dealt out in cells of about ``cell_rows``, so a
    length that very many pieces share is ordered in many tasks.
    """
    spark: SparkSession = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    segments = plan(counts, capacity)
    total = sum(counts.values())
    each = max(cell_rows, total // 100_000)  # so there are at most 100,000 cells more than lengths
    salts = spark.createDataFrame([(length, -(-n // each)) for length, n in counts.items()], "s_length long, salts long")
    planned = spark.createDataFrame(_frame(segments), "p_length long, first_rank long, n long, first_bin long, offset long")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("s_length")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("s_length", "salts")
    cells = salted.groupBy("length", "salt").count()
    cells = cells.select(F.col("length").alias("c_length"), F.col("salt").alias("c_salt"), (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    cells = scratch.write(cells, "cells")
    in_cell = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return (
        salted.withColumn("in_cell", in_cell)
        .join(F.broadcast(cells), (F.col("length") == F.col("c_length")) & (F.col("salt") == F.col("c_salt")))
        .withColumn("rank", F.col("before") + F.col("in_cell"))
        .join(F.broadcast(planned), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
        .withColumn("sequence_id", F.col("first_bin") + F.col("rank") - F.col("first_rank"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def _frame(segments: list[tuple]):
    import pandas as pd

    return pd.DataFrame(np.array(segments, np.int64).reshape(-1, 5), columns=["p_length", "first_rank", "n", "first_bin", "offset"])


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.write(tokenized(docs, capacity=capacity, path=path, with_ids=with_ids), "pieces"), scratch, capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack_documents(..., with_ids=True)``; a sequence holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
