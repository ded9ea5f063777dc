"""N-gram Jaccard join over signature trees.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches the threshold. The join is exact up to 64-bit hashes of shingles:

1. Documents of equal sets form a class; only classes go on.
2. Classes meet where they share a shingle of their prefixes (the first
   ``n - ceil(t n) + 1`` shingles in one order for all; shingles found
   frequent come last, so they seldom meet there). Linked sets always do.
3. In a few rounds each class is first compared with one leader of its blocks;
   verified links already join most copies, and pairs within a component
   need no look any more.
4. In small blocks that still hold several components, pairs are counted: the
   shingles that their prefixes share must be as many as their sizes need. In
   larger ones classes are the leaves of a signature tree. A node has the OR of
   its prefixes' bitmaps and the range of its sizes; a dual traversal follows
   only pairs of nodes whose greatest possible overlap reaches what their sizes
   need. Blocks are cut into chunks, and pairs of chunks are dealt out, so that
   a block of any size has many tasks.
5. Candidates are verified on the whole sets.

Defined results: with fewer words than a shingle, the sequence is one shingle;
without words or with a null text, the set is empty and links with nothing.
Null ids take no part and have a null component. Rows that repeat an id are
separate sets, and the smallest id of what they link with is the component of
each. An empty table gives an empty result; other columns are ignored; texts
of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, broadcast_if, slices, table, utf8
from .components import components
from .hashing import mixed, run_hashes, word_hashes

WIDTH = 5
#: The similarity threshold as a fraction of whole numbers.
NUM, DEN = 4, 5
#: The frequent shingles that every task knows: 8 bytes each, 8 MB.
FREQUENT = 1 << 20
#: Shingles that are counted together, and how often a frequent one is among them.
COUNTED, OFTEN = 4_000_000, 4
BITS = 4096
CHUNK, FANOUT, LEAF = 256, 8, 16
#: Blocks from this number of classes on have trees.
TREE = 64
#: Rounds in which classes are compared with the leaders of their blocks.
LEADERS = 2


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hash)`` of all shingles, repeated ones included, in no certain order."""
    words, counts = word_hashes(texts, lower=True)
    doc = np.repeat(np.arange(len(texts)), counts)
    hashes = run_hashes(words, width)
    inside = doc[: len(hashes)] == doc[width - 1 :][: len(hashes)]
    owner, hashes = doc[: len(hashes)][inside], hashes[inside]
    ends = np.cumsum(counts)
    short = [i for i in np.flatnonzero((counts > 0) & (counts < width))]
    if short:
        whole = [run_hashes(words[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short]
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
    return owner, hashes


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(document, hash)`` of all distinct shingles, ordered by both."""
    owner, hashes = shingles(texts, width)
    order = np.argsort(hashes)
    # a stable sort of small numbers is one pass; equal hashes of a document are one
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], hashes[fresh]


def _digests(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document: first place and number of its shingles, and two sums that equal sets share."""
    sizes = np.bincount(owner, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    totals = []
    for salt in (np.uint64(0x51ED270B), np.uint64(0xD1B54A32D192ED03)):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ salt), dtype=np.uint64)])
        totals.append((run[first + sizes] - run[first]).view(np.int64))
    return first, sizes, totals[0], totals[1]


def frequent_shingles(docs: DataFrame, width: int = WIDTH, most: int = FREQUENT) -> np.ndarray:
    """Hashes of shingles that occur in many different texts, sorted; the ``most`` most frequent.

    Only the order of the prefixes depends on them, not what the join finds.
    """

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, times = np.unique(np.concatenate(held), return_counts=True)
        often = times >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(times[often])], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [np.zeros(0, np.uint64)], 0, set()
        for batch in batches:
            for _, texts in slices(batch, "text"):
                new = []
                for text in texts:
                    key = xxhash.xxh3_128_digest(text)
                    if key not in seen:
                        seen.add(key)
                        new.append(text)
                held.append(shingles(new, width)[1])
                n_held += len(held[-1])
                if n_held >= COUNTED:
                    yield flush(held)
                    held, n_held, seen = [np.zeros(0, np.uint64)], 0, set()
        yield flush(held)

    counts = docs.select(utf8("text").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.col("n").desc(), "h").limit(most).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def look(text: str = "text") -> Column:
    """A digest that tells texts under one id apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def prefix_length(n: np.ndarray | int):
    return n - (NUM * n + DEN - 1) // DEN + 1


def sets_table(docs: DataFrame, frequent: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``doc_id, look, n, d1, d2, prefix`` for every row: digest of the text, and size, digests and prefix of its shingle set."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = known.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                owner, hashes = shingle_sets(texts, width)
                first, sizes, one, two = _digests(owner, hashes, len(texts))
                if len(last) and len(hashes):
                    late = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] == hashes
                    order = np.argsort(owner * 2 + late, kind="stable")
                    hashes = hashes[order]
                lengths = np.where(sizes > 0, prefix_length(sizes), 0)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                places = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(first, lengths)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[places].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(one), pa.array(two), prefix], ["doc_id", "look", "n", "d1", "d2", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), look().alias("look"), utf8("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, look binary, n long, d1 long, d2 long, prefix array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """``class, n, hashes`` for the classes ``wanted(class, first_id, d1, d2)``, from one of their documents."""
    wanted = broadcast_if(wanted, wanted.count())  # 32 bytes a row
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in slices(batch, "text"):
                owner, hashes = shingle_sets(own, width)
                first, sizes, one, two = _digests(owner, hashes, len(own))
                right = np.flatnonzero((one == part.column(1).to_numpy()) & (two == part.column(2).to_numpy()))
                kept = [hashes[first[i] : first[i] + sizes[i]].view(np.int64) for i in right]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(right, pa.int64())), pa.array(sizes[right]), pa.array(kept, pa.list_(pa.int64()))], ["class", "n", "hashes"])

    found = texts.select("class", "d1", "d2", utf8("text").alias("text")).mapInArrow(run, "class long, n long, hashes array<long>")
    return found.dropDuplicates(["class"])


def needed(n: Column, m: Column) -> Column:
    """The least overlap of sets of ``n`` and ``m`` that reaches the threshold."""
    return F.ceil(NUM * (n + m) / (NUM + DEN))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, width: int) -> DataFrame:
    """The pairs ``a, b`` of classes that reach the threshold, by the whole sets of the classes in pairs."""
    asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = scratch.write(classes.join(asked, "class").select("class", "first_id", "d1", "d2"), f"{name}-wanted")
    whole = scratch.write(whole_sets(docs, wanted, width), f"{name}-whole")
    scratch.release()
    left = whole.select(F.col("class").alias("a"), F.col("n").alias("a_n"), F.col("hashes").alias("a_set"))
    right = whole.select(F.col("class").alias("b"), F.col("n").alias("b_n"), F.col("hashes").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(left, "a").join(right, "b").withColumn("both", both).where(DEN * F.col("both") >= NUM * (F.col("a_n") + F.col("b_n") - F.col("both"))).select("a", "b")


def bitmaps(classes: DataFrame) -> DataFrame:
    """``class, bits`` from ``class, prefix``: the bitmap of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                sizes = part.column(1).value_lengths().to_numpy()
                flags = np.zeros((part.num_rows, BITS), bool)
                flags[np.repeat(np.arange(part.num_rows), sizes), part.column(1).flatten().to_numpy().view(np.uint64) % np.uint64(BITS)] = True
                rows = [row.tobytes() for row in np.packbits(flags, axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["class", "bits"])

    return classes.select("class", "prefix").mapInArrow(run, "class long, bits binary")


class SignatureTree:
    """Leaves are sets in order of size; a node holds the OR of its prefixes' bitmaps and the range of its sizes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """``bits``: one row of 64-bit words a set; rows in order of size."""
        prefix = prefix_length(sizes)
        excess = prefix - np.bitwise_count(bits).sum(1)
        #: by level: least and greatest size, most words that share a bit, most words outside the prefix, bitmap
        self.levels = [(sizes, sizes, excess, sizes - prefix, bits)]
        self.steps: list[int] = []
        while len(self.levels[-1][0]) > 1:
            low, high, over, tail, has = self.levels[-1]
            step = FANOUT if self.steps else LEAF
            starts = np.arange(0, len(low), step)
            most = [np.maximum.reduceat(x, starts) for x in (high, over, tail)]
            self.levels.append((np.minimum.reduceat(low, starts), *most, np.bitwise_or.reduceat(has, starts, axis=0)))
            self.steps.append(step)

    def join(self, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that may reach the threshold, by descending both trees level by level.

        Of two prefixes, the one that ends first has all its common words in
        the other. So an overlap is at most the common bits, the words that
        share a bit with another, and the words outside one prefix; and it is
        at most the smaller size.
        """
        depth = max(len(self.levels), len(other.levels)) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth, -1, -1):
            x, y = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            kept_a, kept_b = [], []
            for at in range(0, len(a), 1 << 14):  # bounds what bitmaps are in memory
                i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                common = np.bitwise_count(x[4][i] & y[4][j]).sum(1) + np.minimum(x[2][i], y[2][j])
                most = np.minimum(common + np.maximum(x[3][i], y[3][j]), np.minimum(x[1][i], y[1][j]))
                enough = (NUM + DEN) * most >= NUM * (x[0][i] + y[0][j])
                fitting = (DEN * x[1][i] >= NUM * y[0][j]) & (DEN * y[1][j] >= NUM * x[0][i])
                kept_a.append(i[enough & fitting])
                kept_b.append(j[enough & fitting])
            a, b = np.concatenate(kept_a), np.concatenate(kept_b)
            if level and len(a):
                a, b = self._children(a, b, other, level)
        return a, b

    def _children(self, a: np.ndarray, b: np.ndarray, other: SignatureTree, level: int) -> tuple[np.ndarray, np.ndarray]:
        def of(tree: SignatureTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if level >= len(tree.levels):  # this tree is lower: the node stays
                return nodes, np.ones(len(nodes), np.int64)
            step, n = tree.steps[level - 1], len(tree.levels[level - 1][0])
            return nodes * step, np.minimum(step, n - nodes * step)

        (first_a, n_a), (first_b, n_b) = of(self, a), of(other, b)
        each = n_a * n_b
        pair = np.repeat(np.arange(len(a)), each)
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return first_a[pair] + inner // n_b[pair], first_b[pair] + inner % n_b[pair]


def tree_candidates(blocks: DataFrame, signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``a < b`` of classes of different components that a block's trees let through.

    ``blocks``: ``key, class, component, n, place``; ``signatures``: ``class,
    bits``. A shared shingle must also be early enough in both. A block is cut into chunks
    of classes in order of size; every pair of chunks whose sizes can fit is a
    group of its own, of at most two chunks' rows.
    """
    numbered = blocks.withColumn("chunk", ((F.row_number().over(W.partitionBy("key").orderBy("n", "class")) - 1) / CHUNK).cast("int"))
    numbered = scratch.write(numbered, "chunks")
    ranges = numbered.groupBy("key", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = ranges.alias("x"), ranges.alias("y")
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.chunk") <= F.col("y.chunk")) & (DEN * F.col("x.high") >= NUM * F.col("y.low"))
    tasks = x.join(y, fits).select(F.col("x.key").alias("t_key"), F.explode(F.array_distinct(F.array("x.chunk", "y.chunk"))).alias("t_chunk"), F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j"))
    dealt = numbered.join(tasks, (F.col("key") == F.col("t_key")) & (F.col("chunk") == F.col("t_chunk"))).join(signatures, "class").select("key", "i", "j", "chunk", "n", "place", "class", "component", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            task = np.stack([rows[c].to_numpy() for c in ("key", "i", "j")])
            bounds = np.flatnonzero((task[:, 1:] != task[:, :-1]).any(0)) + 1
            last = int(bounds[-1]) if len(bounds) else 0  # the last group may go on in the next batch
            rest = rows.slice(last)
            yield _block_pairs(rows.slice(0, last), np.concatenate([[0], bounds]) if last else np.zeros(1, np.int64))
        if rest is not None:
            yield _block_pairs(rest, np.array([0, rest.num_rows]))

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "class")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _block_pairs(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    out_a, out_b = [], []
    if rows.num_rows:
        ids, component, n, place, chunk, i, j = (rows[c].to_numpy() for c in ("class", "component", "n", "place", "chunk", "i", "j"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            one = np.arange(start, end)[chunk[start:end] == i[start]]
            two = np.arange(start, end)[chunk[start:end] == j[start]]
            left = SignatureTree(n[one], bits[one])
            a, b = left.join(left if i[start] == j[start] else SignatureTree(n[two], bits[two]))
            a, b = one[a], two[b]
            behind = 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1
            apart = (component[a] != component[b]) & ((NUM + DEN) * behind >= NUM * (n[a] + n[b]))
            out_a.append(np.minimum(ids[a], ids[b])[apart])
            out_b.append(np.maximum(ids[a], ids[b])[apart])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    if len(a):
        a, b = np.unique(np.column_stack([a, b]), axis=0).T
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def may_reach(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Sizes fit, and what follows the places in both sets suffices if this shingle is the first they share."""
    fits = (DEN * n >= NUM * m) & (DEN * m >= NUM * n)
    return fits & (1 + F.least(n - place - 1, m - other - 1) >= needed(n, m))


def _prefix(n: Column) -> Column:
    return n - F.ceil(NUM * n / DEN) + 1


def counted_candidates(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of classes of different components that share enough keys of their prefixes.

    ``small``, ``large``: rows of the open blocks, ``key, class, component, n,
    place``. Pairs meet in ``small``; of the blocks in ``large`` they share as
    many at most as the one with fewer is in.
    """
    x, y = small.alias("x"), small.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & (DEN * n >= NUM * m) & (DEN * m >= NUM * n)
    behind = 1 + F.least(n - F.col("x.place") - 1, m - F.col("y.place") - 1)
    pairs = x.join(y, meet).groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(behind).alias("behind"), F.first("x.n").alias("n"), F.first("y.n").alias("m"))
    more = large.groupBy(F.col("class").alias("of")).agg(F.count(F.lit(1)).alias("more"))
    more = broadcast_if(more, more.count())
    for c in ("a", "b"):
        pairs = pairs.join(more.select(F.col("of").alias(f"of_{c}"), F.col("more").alias(f"more_{c}")), F.col(c) == F.col(f"of_{c}"), "left")
    other = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    need = needed(F.col("n"), F.col("m"))
    common = need - F.greatest(F.col("n") - _prefix(F.col("n")), F.col("m") - _prefix(F.col("m")))
    return pairs.where((F.col("shared") + other >= common) & ((other > 0) | (F.col("behind") >= need))).select("a", "b")


def _with_leaders(blocks: DataFrame, links: DataFrame | None, turn: int) -> DataFrame:
    """Pairs ``a, b``: each class with one leader of its blocks that is in another component.

    A block's leader is its class with the most links so far, in an order of
    its own for each turn; a class takes the leader that it shares the most
    blocks with.
    """
    blocks = blocks.withColumn("degree", F.lit(0).cast("long"))
    if links is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("has"))
        blocks = blocks.join(degree, F.col("class") == F.col("of"), "left").withColumn("degree", F.coalesce("has", F.lit(0).cast("long"))).drop("of", "has")
    # where the shared shingle comes early, least is a class's own: it is nearest to what a group has in common
    first = F.max(F.struct("degree", (-F.col("place")).alias("early"), F.xxhash64("class", F.lit(turn)).alias("order"), "class", "component", "n", "place")).over(W.partitionBy("key"))
    led = blocks.withColumn("leader", first).where((F.col("component") != F.col("leader.component")) & may_reach(F.col("n"), F.col("place"), F.col("leader.n"), F.col("leader.place")))
    times = led.groupBy("class", F.col("leader.class").alias("leader")).agg(F.count(F.lit(1)).alias("times"))
    best = times.groupBy("class").agg(F.max(F.struct("times", (-F.col("leader")).alias("order"), "leader")).alias("best"))
    return best.select(F.least("class", "best.leader").alias("a"), F.greatest("class", "best.leader").alias("b")).distinct()


def linked(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``doc_id, look, n_shingles, component_id, first`` for every row of ``docs(doc_id, text)``.

    ``look`` tells the texts of one id apart (see :func:`look`). ``first`` is
    true for the rows of each component with the smallest id and then digest,
    which are equal texts, and for rows that take no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    sets = scratch.write(sets_table(docs, frequent_shingles(docs, width), width).withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = (
        sets.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2", "n")
        .agg(F.min("row").alias("class"), F.min(F.struct("doc_id", "look")).alias("least"), F.first("prefix").alias("prefix"))
        .withColumn("first_id", F.col("least.doc_id"))
    )
    classes = scratch.write(classes, "classes")
    sets = scratch.write(sets.select("doc_id", "look", "n", "d1", "d2"), "rows")
    scratch.drop("sets")
    scratch.release()
    keys = classes.select("class", "n", F.posexplode("prefix").alias("place", "key"))
    block = W.partitionBy("key")
    shared = keys.withColumn("size", F.count(F.lit(1)).over(block)).where("size > 1")
    shared = scratch.write(shared, "shared")
    scratch.release()
    links, open_blocks, labels = None, shared.withColumn("component", F.col("class")), None
    for turn in range(LEADERS):
        pairs = scratch.write(_with_leaders(open_blocks, links, turn), f"pairs{turn}")
        found = verified(docs, pairs, classes, scratch, f"links{turn}", width)
        links = scratch.write(found if links is None else links.union(found), f"verified{turn}")
        scratch.drop(f"links{turn}-whole", f"open{turn - 1}")
        scratch.release()
        labels = components(links, scratch, f"turn{turn}")
        # Blocks that still hold several components
        labelled = shared.join(labels, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class")).drop("node")
        labelled = labelled.withColumn("low", F.min("component").over(block)).withColumn("high", F.max("component").over(block)).where("low <> high").drop("low", "high")
        open_blocks = scratch.write(labelled, f"open{turn}")
        scratch.release()
    small, large = open_blocks.where(F.col("size") < TREE).drop("size"), open_blocks.where(F.col("size") >= TREE).drop("size")
    signatures = scratch.write(bitmaps(classes.join(large.select("class").distinct(), "class")), "signatures")
    trees = scratch.write(tree_candidates(large, signatures, scratch), "trees")
    scratch.drop("chunks", "signatures")
    scratch.release()
    candidates = scratch.write(trees.union(counted_candidates(small, large)).distinct(), "candidates")
    scratch.drop("trees", f"open{LEADERS - 1}")
    scratch.release()
    more = scratch.write(verified(docs, candidates, classes, scratch, "more", width), "more")
    final = components(links.union(more), scratch, "final")
    of_class = classes.select("class", "least", "d1", "d2", "n").join(final, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class"))
    smallest = of_class.groupBy("component").agg(F.min("least").alias("head"))
    known = scratch.write(of_class.join(smallest, "component").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.col("n").alias("k_n"), "head"), "known")
    scratch.drop("classes", "shared", "candidates", "more-whole")
    scratch.release()
    same = (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")) & (F.col("n") == F.col("k_n")) & F.col("doc_id").isNotNull()
    first = F.col("head").isNull() | ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("look") == F.col("head.look")))
    return sets.join(known, same, "left").select("doc_id", "look", F.col("n").alias("n_shingles"), F.coalesce("head.doc_id", "doc_id").alias("component_id"), first.alias("first"))


def link_documents(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    return linked(docs, width=width).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
