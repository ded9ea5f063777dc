"""Language-model scoring by a hashed maximum-entropy model.

A token's probability is that of its class given the tokens before, times that
of the token within its class (class-factored softmax). Features are hashed:
the token before, the two tokens before, and, skipping one, the token but one.
The class softmax has a row of weights for each feature's hash. Frequent tokens
are classes of their own; other known tokens share classes by their last
letters, and so do rare tokens, one unknown token in each of their classes
included.

Within a class of known tokens the softmax is a binary tree of two-way ones, by
alphabet and balanced by counts: a node's log odds are those of the counts
below it plus the weights at the hashes of the node with the token before and
with the token but one. So a token costs as many steps as its path is long. The
few tokens of a leaf, and rare ones in their class, share it by their counts.
All probabilities still sum to 1.

1. Tokens of all training texts are counted; the most frequent, a bounded
   number, are the vocabulary that tasks hold.
2. Weights are trained in rounds. In each, tasks run minibatch gradient steps
   (Adagrad) from the shared weights over their part of the round's texts, and
   the steps are averaged by tokens. Every training text is in one round.
3. Texts are scored in sparse numpy batches. Rare tokens go, with their texts,
   to a join with the counts, which no task needs to hold.

Defined results: a null text is empty and has one token, its end. A null id
counts as trained on. Without training texts every token is unknown. Rows that
repeat an id are scored, and trained on, each on its own. An empty table gives
an empty result. Other columns are ignored; texts of any length are used whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table, utf8

END = b""
#: Tokens that every task holds at most: a few MB.
VOCABULARY = 200_000
#: Classes: tokens of their own, other known tokens, rare tokens.
OWN, KNOWN, RARE = 16, 12, 4
CLASSES = OWN + KNOWN + RARE
#: Rows of weights: one for each frequent token, and shared ones for all others and for pairs.
DIRECT, SHARED, PAIRS = 3072, 1024, 8192
START = DIRECT + SHARED  # the context before a text
CONTEXTS = START + 1
ROWS = CONTEXTS + PAIRS + CONTEXTS
ROUNDS, BATCH, RATE = 2, 2048, 0.25
#: Tokens of a training task, at least.
TASK_TOKENS = 4_000_000
#: Weights of the trees' nodes: a power of two over so many times the distinct tokens, between bounds; 4 bytes each.
EACH, FEWEST, MOST = 4, 1 << 16, 1 << 21
NODE_RATE, NODE_BLOCK = 0.2, 1 << 16
#: Steps of a path at most; the tokens of a leaf share its probability by their counts.
DEPTH = 7
#: Distinct tokens that a counting task holds before it passes them on.
HELD = 300_000
BLOCK = 256
#: Rows that come so often in a batch at most have their gradients added turn by turn.
TURNS = 8


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:])


def count_tokens(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows of ``texts(text)`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for _, some in slices(batch, "text"):
                for text in some:
                    held.update(tokens(text))
                if len(held) > HELD:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    def packed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Paths:
    """The way to each place through the tree of its class; places from ``start[i]`` to ``start[i + 1]`` are those of ``i``."""

    start: np.ndarray
    node: np.ndarray
    sign: np.ndarray  # 1 to the right, -1 to the left
    bias: np.ndarray  # by node: the log odds of going right, from counts


def trees(words: list[bytes], classes: np.ndarray, counts: np.ndarray) -> tuple[Paths, np.ndarray]:
    """The paths, and by place the logarithm of its share of its leaf. ``classes`` also has those of pseudo-places, which have no path."""
    shared = np.flatnonzero((classes[: len(words)] >= OWN) & (classes[: len(words)] < OWN + KNOWN)).tolist()
    places = np.array(sorted(shared, key=lambda i: (classes[i], words[i])), np.int64)
    total = np.concatenate([[0.0], np.cumsum(counts[places])])
    cuts = np.flatnonzero(np.diff(classes[places])) + 1 if len(places) else np.zeros(0, np.int64)
    a, b = np.concatenate([np.zeros(min(1, len(places)), np.int64), cuts]), np.concatenate([cuts, [len(places)] if len(places) else []]).astype(np.int64)
    n_nodes, item, node, sign, bias = 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int8)], [np.zeros(0, np.float32)]
    for _ in range(DEPTH):
        wide = b - a > 1
        a, b = a[wide], b[wide]
        middle = np.clip(np.searchsorted(total, (total[a] + total[b]) / 2), a + 1, b - 1)
        size = b - a
        at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        item.append(places[at].astype(np.int32))
        node.append(np.repeat(np.arange(n_nodes, n_nodes + len(a), dtype=np.int32), size))
        sign.append(np.where(at >= np.repeat(middle, size), 1, -1).astype(np.int8))
        bias.append(np.log((total[b] - total[middle]) / (total[middle] - total[a])).astype(np.float32))
        n_nodes += len(a)
        a, b = np.concatenate([a, middle]), np.concatenate([middle, b])
    leaf = np.zeros(len(classes))  # of the tokens that share one, the logarithm of their shares
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        leaf[places[x:y]] = np.log(counts[places[x:y]] / (total[y] - total[x]))
    item = np.concatenate(item)
    order = np.argsort(item, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(classes)))])
    return Paths(start.astype(np.int64), np.concatenate(node)[order], np.concatenate(sign)[order], np.concatenate(bias)), leaf


@dataclass
class Vocabulary:
    place: dict[bytes, int]
    counts: np.ndarray  # by place, descending
    classes: np.ndarray  # by place, then of the rare classes' pseudo-places
    in_class: np.ndarray  # log share of a known token in its leaf; of rare ones in their class, without their own count
    class_bias: np.ndarray
    n_tokens: int
    n_words: int
    paths: Paths

    def places(self, split: list[list[bytes]]) -> np.ndarray:
        """Places of all tokens; rare ones have the pseudo-place of their class, beyond the vocabulary."""
        known = len(self.counts)
        out = np.empty(sum(map(len, split)), np.int64)
        at, get = 0, self.place.get
        for words in split:
            own = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            rare = np.flatnonzero(own < 0)
            own[rare] = [known + _ending(words[i]) % RARE for i in rare.tolist()]
            out[at : at + len(own)] = own
            at += len(own)
        return out


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    """The most frequent tokens: all whose count reaches the least bound that at most ``most`` reach."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 384)  # at most a few thousand steps
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("least")).collect()
    steps.sort(key=lambda r: -r["step"])
    n_tokens, n_words, taken, least = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps), 0, None
    for r in steps:
        if taken + r["words"] > most:
            break
        taken, least = taken + r["words"], r["least"]
    held = [] if least is None else [(bytes(r["word"]), int(r["c"])) for r in counts.where(F.col("c") >= least).collect()]
    held.sort(key=lambda x: (-x[1], x[0]))
    own = np.array([c for _, c in held], np.float64)
    classes = np.array([i if i < OWN else OWN + _ending(w) % KNOWN for i, (w, _) in enumerate(held)] + [OWN + KNOWN + f for f in range(RARE)], np.int64)
    bound = least if least is not None else 1 << 62
    rare = counts.where(F.col("c") < bound).groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % RARE).alias("f")).agg(F.sum(F.col("c") + 1).alias("size")).collect()
    sizes = np.ones(RARE)
    for r in rare:
        sizes[r["f"]] += r["size"]
    mass = np.bincount(classes[: len(own)], own, CLASSES)
    mass[OWN + KNOWN :] = sizes
    bias = np.log((mass + 0.1) / (mass + 0.1).sum())
    paths, leaf = trees([w for w, _ in held], classes, own)
    in_class = leaf + np.concatenate([np.zeros(len(own)), -np.log(sizes)])
    return Vocabulary({w: i for i, (w, _) in enumerate(held)}, own, classes, in_class, bias, int(n_tokens), int(n_words), paths)


def node_weights(n_words: int) -> int:
    """How many weights the trees' nodes have for so many distinct tokens."""
    return min(MOST, max(FEWEST, 1 << (EACH * max(1, n_words) - 1).bit_length()))


def feature_rows(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three rows of weights for each token of texts of these sizes, laid end to end."""
    context = np.where(places < DIRECT, places, DIRECT + (places * 2654435761 >> 8) % SHARED)
    within = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.full(len(places), START), np.full(len(places), START)
    one[1:], two[2:] = context[:-1], context[:-2]
    one[within < 1], two[within < 2] = START, START
    pair = ((two * CONTEXTS + one) * 0x9E3779B1 >> 12) % PAIRS
    return np.stack([one, CONTEXTS + pair, CONTEXTS + PAIRS + two]).astype(np.uint16)


def contexts(places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places plus 1 of the token before each and of the token but one; 0 before the text."""
    within = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
    one[1:], two[2:] = places[:-1] + 1, places[:-2] + 1
    one[within < 1], two[within < 2] = 0, 0
    return one, two


def node_rows(paths: Paths, places: np.ndarray, one: np.ndarray, two: np.ndarray, n_weights: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per step on the tokens' paths: token, node, sign, and the two places of its weights."""
    first = paths.start.take(places)
    steps = paths.start.take(places + 1) - first
    token = np.repeat(np.arange(len(places)), steps)
    at = np.arange(len(token)) + np.repeat(first - (np.cumsum(steps) - steps), steps)
    node = paths.node.take(at)
    key = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    down = np.uint64(65 - n_weights.bit_length())
    hashed = np.empty((2, len(token)), np.uint64)
    for out, context, salt in zip(hashed, (one, two), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F), strict=True):
        np.bitwise_xor(key, np.repeat(context * np.uint64(salt), steps), out=out)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out >>= down
    return token, node, paths.sign.take(at), hashed.view(np.int64)


def node_odds(paths: Paths, weights: np.ndarray, node: np.ndarray, at: np.ndarray) -> np.ndarray:
    odds = paths.bias.take(node)
    for places in at:
        odds += weights.take(places)
    return odds


def descend_nodes(paths: Paths, weights: np.ndarray, memory: np.ndarray, node: np.ndarray, sign: np.ndarray, at: np.ndarray) -> None:
    """One gradient step on a batch of steps, in place; ``memory`` sums the squares of each weight's gradients."""
    g = 1 / (1 + np.exp(-node_odds(paths, weights, node, at).clip(-30, 30))) - (sign > 0)
    g = g.astype(np.float32)
    square = g * g
    for places in at:
        np.add.at(memory, places, square)
    g *= np.float32(NODE_RATE)
    for places in at:
        np.subtract.at(weights, places, g / np.sqrt(memory.take(places) + np.float32(0.1)))


def exponents(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the softmax the exponentials of all classes, their sums, and the exponents of the chosen ones."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    z -= z.max()
    own = z[np.arange(len(z)), chosen]
    p = np.exp(z)
    total = p @ np.ones(z.shape[1], z.dtype)
    if total.min() < 1e-20:  # a row far below the greatest of all
        top = z.max(1, keepdims=True)
        own -= top[:, 0]
        p = np.exp(z - top)
        total = p.sum(1)
    return p, total, own


def softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probabilities of all classes, and the logarithms of the chosen ones."""
    p, total, own = exponents(weights, bias, rows, chosen)
    p *= (1 / total)[:, None]
    return p, own - np.log(total)


def row_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, ascending, and the sums of their values.

    ``reduceat`` takes its time for each row and column, so rows that come a
    few times are added turn by turn.
    """
    order = np.argsort(rows, kind="stable")
    ranked = rows.take(order)
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(starts, append=len(rows))
    sums = values.take(order.take(starts), axis=0)
    left = np.flatnonzero((times > 1) & (times <= TURNS))
    for turn in range(1, TURNS):
        if not len(left):
            break
        sums[left] += values.take(order.take(starts.take(left) + turn), axis=0)
        left = left[times.take(left) > turn + 1]
    more = times > TURNS
    if more.any():
        some = values.take(order[np.repeat(more, times)], axis=0)
        sums[more] = np.add.reduceat(some, np.cumsum(times[more]) - times[more], axis=0)
    return ranked.take(starts).astype(np.intp), sums


def descend(weights: np.ndarray, bias: np.ndarray, memory: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step on a batch, in place; ``memory`` holds the mean squares of the rows' gradients."""
    g, total, _ = exponents(weights, bias, rows, classes)
    g *= (1 / total)[:, None]
    g[np.arange(len(classes)), classes] -= 1
    for r in rows:
        used, sums = row_sums(g, r)
        squares = memory.take(used) + np.einsum("ij,ij->i", sums, sums) / CLASSES
        memory[used] = squares
        sums *= (RATE / np.sqrt(squares + 1e-2))[:, None]
        weights[used] = weights.take(used, axis=0) - sums


@dataclass
class Weights:
    classes: np.ndarray
    nodes: np.ndarray


def _sizes(split: list[list[bytes]]) -> np.ndarray:
    return np.array([len(x) for x in split])


def train_round(texts: DataFrame, words: Broadcast, weights: Weights, tasks: int) -> Weights:
    """New weights after one round: the averages of the tasks' steps.

    Class weights are averaged by tokens; a node's weight, which few tasks may
    have met, by what they learned of it (the sum of squared gradients, to an
    eighth of a power of two). A task returns its steps in blocks of weights;
    those of 32 tasks are added at a time, level by level, and the driver gets
    one set of weights.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    n_blocks = -(-ROWS // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = words.value, shared.value
        own, bias, nodes = start.classes.copy(), known.class_bias.astype(np.float32), start.nodes.copy()
        memory, node_memory, seen = np.zeros(ROWS, np.float32), np.zeros(len(nodes), np.float32), 0
        for batch in batches:
            for _, some in slices(batch, "text"):
                split = [tokens(t) for t in some]
                places, sizes = known.places(split), _sizes(split)
                rows, classes = feature_rows(places, sizes), known.classes[places]
                one, two = contexts(places, sizes)
                for at in range(0, len(places), BATCH):
                    some_ = slice(at, at + BATCH)
                    descend(own, bias, memory, rows[:, some_], classes[some_])
                    _, node, sign, hashed = node_rows(known.paths, places[some_], one[some_], two[some_], len(nodes))
                    descend_nodes(known.paths, nodes, node_memory, node, sign, hashed)
                seen += len(places)
        if not seen:
            return
        part = TaskContext.get().partitionId() // 32
        moved = (own - start.classes) * seen
        blocks = [(k, part, float(seen), moved[b : b + BLOCK].astype(np.float32).tobytes(), None) for k, b in enumerate(range(0, ROWS, BLOCK))]
        learned = np.ceil(8 * np.log2(1 + 16 * node_memory)).clip(0, 255).astype(np.uint8)
        change = (nodes - start.nodes).astype(np.float16)
        blocks += [(n_blocks + k, part, 0.0, change[b : b + NODE_BLOCK].tobytes(), learned[b : b + NODE_BLOCK].tobytes()) for k, b in enumerate(range(0, len(nodes), NODE_BLOCK))]
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "part", "n", "moved", "learned"), x, strict=True)) for x in blocks], pa.schema([("block", pa.int32()), ("part", pa.int32()), ("n", pa.float64()), ("moved", pa.binary()), ("learned", pa.binary())]))

    def added(key: tuple, n: float, moved: np.ndarray, learned: np.ndarray | None) -> pa.Table:
        block, part = (x.as_py() for x in key)
        columns = [[block], [part // 32], [n], [moved.astype(np.float32).tobytes()], [None if learned is None else learned.astype(np.float32).tobytes()]]
        return pa.table(dict(zip(("block", "part", "n", "moved", "learned"), (pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)), strict=True)))

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        block, moves = key[0].as_py(), rows["moved"].to_pylist()
        if block < n_blocks:
            return added(key, sum(rows["n"].to_pylist()), sum(np.frombuffer(x, np.float32).astype(np.float64) for x in moves), None)
        weight = [np.exp2(np.frombuffer(x, np.uint8) / np.float32(8)) - 1 for x in rows["learned"].to_pylist()]
        return added(key, 0.0, sum(np.frombuffer(x, np.float16) * w for x, w in zip(moves, weight, strict=True)), sum(weight))

    def rest(key: tuple, rows: pa.Table) -> pa.Table:
        plus = lambda c: sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows[c].to_pylist())
        return added(key, sum(rows["n"].to_pylist()), plus("moved"), None if key[0].as_py() < n_blocks else plus("learned"))

    schema = "block int, part int, n double, moved binary, learned binary"
    moved = texts.select("text").coalesce(tasks).mapInArrow(run, schema)
    moved, parts = moved.groupBy("block", "part").applyInArrow(first, schema), -(-tasks // 32)
    while parts > 1:
        moved, parts = moved.groupBy("block", "part").applyInArrow(rest, schema), -(-parts // 32)
    new = Weights(weights.classes.copy(), weights.nodes.copy())
    for r in moved.collect():
        step = np.frombuffer(bytes(r["moved"]), np.float32)
        if r["block"] < n_blocks:
            block = step.reshape(-1, CLASSES)
            at = r["block"] * BLOCK
            new.classes[at : at + len(block)] += block / np.float32(max(r["n"], 1.0))
        else:
            at = (r["block"] - n_blocks) * NODE_BLOCK
            new.nodes[at : at + len(step)] += step / np.maximum(np.frombuffer(bytes(r["learned"]), np.float32), np.float32(1e-6))
    shared.destroy()
    return new


def train(texts: DataFrame, words: Broadcast, rounds: int = ROUNDS) -> Weights:
    """``texts``: ``doc_id, text`` (binary) of the training documents; ``words``: the vocabulary, which tasks get once."""
    known = words.value
    weights = Weights(np.zeros((ROWS, CLASSES), np.float32), np.zeros(node_weights(known.n_words), np.float32))
    tasks = max(1, known.n_tokens // (rounds * TASK_TOKENS))
    for k in range(rounds):
        part = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        weights = train_round(part, words, weights, tasks)
    return weights


def log_probabilities(known: Vocabulary, weights: Weights, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The model's natural logarithm for each token of texts laid end to end; of rare ones without their own count."""
    found, classes, bias = feature_rows(places, sizes), known.classes[places], known.class_bias.astype(np.float32)
    one, two = contexts(places, sizes)
    model = known.in_class[places]
    for at in range(0, len(places), BATCH):
        some = slice(at, at + BATCH)
        _, total, own = exponents(weights.classes, bias, found[:, some], classes[some])
        token, node, sign, hashed = node_rows(known.paths, places[some], one[some], two[some], len(weights.nodes))
        odds = node_odds(known.paths, weights.nodes, node, hashed) * -sign
        steps = np.log(1 + np.exp(-np.abs(odds))) + np.maximum(odds, 0)  # logaddexp(0, odds), in loops over many at a time
        model[some] += own - np.log(total) - np.bincount(token, steps, len(own))
    return model


def partial_scores(rows: DataFrame, words: Broadcast, weights: Weights) -> DataFrame:
    """Per row, what needs no counts of rare tokens, and its rare tokens.

    ``rows``: ``doc_id, held_out, text`` (binary). Both scores are natural logarithms.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = words.value, shared.value
        n_known = len(known.counts)
        log_counts = np.concatenate([np.log(known.counts + 1), np.zeros(RARE)])
        for batch in batches:
            for part, some in slices(batch, "text"):
                split = [tokens(t) for t in some]
                sizes = _sizes(split)
                places = known.places(split)
                model = log_probabilities(known, w, places, sizes)
                ends = np.cumsum(sizes)
                firsts = ends - sizes
                rare = [dict(Counter(x[i] for i in np.flatnonzero(places[a:b] >= n_known).tolist())) for x, a, b in zip(split, firsts, ends, strict=True)]
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(places < n_known, firsts, dtype=np.int64), pa.int64()),
                    pa.array(np.add.reduceat(log_counts[places], firsts)),
                    pa.array(np.add.reduceat(model, firsts)),
                    pa.array([[{"word": k, "times": v} for k, v in x.items()] for x in rare], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_held", "base", "model", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_held long, base double, model double, rare array<struct<word:binary,times:long>>")


def score_documents(docs: DataFrame, *, most_words: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its base score and the model's, both log10 probabilities."""
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), utf8("text").alias("text"))
    learning = texts.where("NOT held_out").select("doc_id", "text")
    counts = scratch.write(count_tokens(learning), "counts")
    scratch.release()
    words = vocabulary(counts, most_words)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    weights = train(learning, sent, rounds)
    scratch.release()
    found = scratch.write(partial_scores(texts, sent, weights).withColumn("row", F.monotonically_increasing_id()), "found")
    sent.destroy()
    scratch.release()
    listed = found.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("rare_word"), F.col("r.times").alias("times"))
    looked_up = listed.join(counts, F.col("rare_word") == F.col("word")).groupBy(F.col("row").alias("of")).agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log(F.col("c") + 1)).alias("gain"))
    joined = found.drop("rare").join(looked_up, F.col("row") == F.col("of"), "left")
    gain, tens = F.coalesce("gain", F.lit(0.0)), float(np.log(10))
    below = float(np.log(words.n_tokens + words.n_words + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_held") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.n_tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + gain - F.col("n_tokens") * below) / tens).alias("base_score"),
        ((F.col("model") + gain) / tens).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
