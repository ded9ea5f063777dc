"""Quality by co-training of two views.

One classifier sees the content of a text: the look of its words and how much
of it is repeated. The other sees the page's metadata: source, language,
recorded size, and the layout of lines, never a word. Both start from
the labelled texts. In every round each gives the other all unlabelled texts
it is sure of as pseudo-labels, unless the other is sure of the opposite.
At last both are calibrated on labelled texts that neither was fitted on, and
a small model over the calibrated log odds scores all documents.

1. All texts are read once, into a table of their features.
2. The driver holds a bounded number of labelled rows, those of the smallest
   hashes of ids. Unlabelled rows stay in the table: in every round tasks
   derive their pseudo-labels from the models so far and return statistics
   (counts by feature, then sums of Newton steps), which are added.
3. All rows of the table are scored.

Pseudo-labels of all unlabelled texts count in every statistic. One weighs
half a label, or less where together they would outweigh the labels.

Defined results: a null text has no words; null language, source or size are
values of their own; a null label does not count; of labels that repeat an id
the largest counts. With labels of one kind only, every text gets that kind.
Null ids stay null and get no pseudo-label, repeated rows get equal results,
of labelled rows that repeat an id one is fitted on, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if, slices, table, utf8
from .linear import LEAST, MEMORY, RARELY, SELECTED, SPACE, folds, logistic, platt, shape_features, sigmoid, words_of
from .quality import measured

#: At most so many labelled texts are fitted on.
SAMPLE = 4000
ROUNDS = 4
#: The log odds from which a view gives a pseudo-label.
SURE = 3.0
#: The other view's log odds for the opposite that stop a pseudo-label.
OPPOSED = 1.0
#: A pseudo-label's weight at most, and the squared penalties of the views.
PSEUDO, PENALTIES = 0.5, (0.1, 0.3)
#: Newton steps of a fit at most, and the relative gain that ends it.
STEPS, GAIN = 10, 1e-4
#: Labelled ids up to this number are broadcast, beyond it joined by shuffle.
LABELS_SENT = 400_000
#: Rows of a task that gathers statistics, at least, and rows of a dense matrix at most.
TASK_ROWS, DENSE = 8000, 4096
THRESHOLD = 0.5
#: Shares of repeated words and lines from which on a text has a feature of the content view.
BOUNDS = (0.02, 0.1, 0.2, 0.3, 0.5, 0.8)
#: Sizes, and characters a line, below which the metadata view has a feature.
SIZES, WIDTHS = (1, 20, 60, 120, 250, 1000, 4000), (5, 20, 60, 200)
NAMES = 8


def _name(value: str | None, kind: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % NAMES


def metadata(texts: list[bytes], lang: list, source: list, n_chars: list) -> np.ndarray:
    """The metadata view's features, a row for each text; of the text only its line ends and length count."""
    lines = np.array([t.count(b"\n") + 1 for t in texts], float)
    blank = np.array([t.count(b"\n\n") for t in texts], float)
    size = np.array([-1.0 if x is None else float(x) for x in n_chars])
    width = np.array([len(t) for t in texts], float) / lines
    columns = [np.log1p(np.maximum(size, 0)), size < 0, np.log1p(lines), np.log1p(width), blank / lines]
    columns += [(size >= 0) & (size < n) for n in SIZES]
    columns += [width < n for n in WIDTHS]
    named = np.zeros((len(texts), 2 * NAMES))
    for i, (a, b) in enumerate(zip(lang, source, strict=True)):
        named[i, _name(a, "lang")] = named[i, NAMES + _name(b, "source")] = 1
    return np.column_stack([*(np.asarray(c, float) for c in columns), named])


def repetition(texts: list[bytes]) -> list[list[int]]:
    """Per text, the features of the content view for the shares of its repeated words and lines, and for few words."""
    m = {k: v.astype(float) for k, v in measured(texts).items()}
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    has = [m["n_words"] < n for n in (5, 10, 20, 40)]
    has += [share > bound for share in (m["n_repeat_words"] / words, m["n_dup_lines"] / lines) for bound in BOUNDS]
    table = np.column_stack(has)
    names = [zlib.crc32(b"share:%d" % i) % SPACE for i in range(table.shape[1])]
    return [[names[i] for i in np.flatnonzero(row)] for row in table]


#: Columns of the metadata view.
LAYOUT = metadata([b""], [None], [None], [None]).shape[1]


@dataclass
class Views:
    selected: np.ndarray  # features of the content view
    content: np.ndarray  # its weights, the intercept last
    layout: np.ndarray  # the metadata view's
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combined: np.ndarray | None = None

    def log_odds(self, rows: Rows) -> np.ndarray:
        return np.column_stack([rows.product(self.selected, self.content[:-1]) + self.content[-1], rows.layout @ self.layout[:-1] + self.layout[-1]])

    def probabilities(self, odds: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of both views, and the combined one."""
        z = _calibrated(odds, self.calibration)
        return np.column_stack([sigmoid(z), sigmoid(z @ self.combined[:-1] + self.combined[-1])])


def _calibrated(odds: np.ndarray, calibration) -> np.ndarray:
    return np.column_stack([a * odds[:, k] + b for k, (a, b) in enumerate(calibration)]).clip(-12, 12)


class Rows:
    """Rows of the table of features: a dense layout, and word features as (text, feature, value)."""

    def __init__(self, size: np.ndarray, layout: list[bytes], feature: list[bytes], times: list[bytes]):
        self.n = len(size)
        self.layout = np.frombuffer(b"".join(layout), np.float32).reshape(self.n, LAYOUT).astype(float)
        self.feature = np.frombuffer(b"".join(feature), np.int32)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) // 4 for x in feature])
        counts = np.frombuffer(b"".join(times), np.int32)
        self.values = np.sqrt(counts / np.maximum(size, 1)[self.text]).astype(np.float32)

    @classmethod
    def of(cls, rows: pa.RecordBatch | pa.Table) -> Rows:
        size, *others = (rows.column(c) for c in ("size", "layout", "feature", "times"))
        return cls(size.to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else size.to_numpy(), *(x.to_pylist() for x in others))

    def _places(self, selected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(SPACE, -1, np.int16)
        place[selected] = np.arange(len(selected))
        at = place[self.feature]
        return np.flatnonzero(at >= 0), at

    def product(self, selected: np.ndarray, weights: np.ndarray) -> np.ndarray:
        hit, at = self._places(selected)
        return np.bincount(self.text[hit], self.values[hit] * weights[at[hit]], self.n)

    def content(self, selected: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(selected)))
        hit, at = self._places(selected)
        out[self.text[hit], at[hit]] = self.values[hit]
        return out

    def present(self, of: np.ndarray) -> np.ndarray:
        """How many of the texts ``of`` (a mask) have each feature."""
        return np.bincount(self.feature[of[self.text]], minlength=SPACE)


def pseudo_labels(rows: Rows, history: list[Views]) -> np.ndarray:
    """What each view is given (1, 0 or NaN, a column each) after rounds that began with these models."""
    given = np.full((rows.n, 2), np.nan)
    for views in history:
        odds = views.log_odds(rows)
        for k in range(2):
            other = 1 - k
            for sign in (1, -1):
                sure = np.isnan(given[:, other]) & (sign * odds[:, k] >= SURE) & (sign * odds[:, other] > -OPPOSED)
                given[sure, other] = sign > 0
    return given


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and the upper triangle of the Hessian of a logistic regression, end to end."""
    loss, gradient, hessian = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for a in range(0, len(x), DENSE):
        part, target = np.column_stack([x[a : a + DENSE], np.ones(len(x[a : a + DENSE]))]), y[a : a + DENSE]
        z = np.clip(part @ w, -40, 40)
        p = sigmoid(z)
        loss += float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - target * z).sum())
        gradient += part.T @ (p - target)
        hessian += (part * (p * (1 - p))[:, None]).T @ part
    return np.concatenate([[loss], gradient, hessian[np.triu_indices(len(w))]])


def _whole(triangle: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = triangle
    return out + np.triu(out, 1).T


def gathered(unlabelled: DataFrame, tasks: int, statistics: Callable[[Rows], np.ndarray], n: int) -> np.ndarray:
    """The sum over all rows of what ``statistics`` finds in a batch, ``n`` numbers.

    Sums travel compressed, as counts are mostly zero; those of many tasks are
    added in groups of 32 first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            for a in range(0, batch.num_rows, DENSE):
                total += statistics(Rows.of(batch.slice(a, DENSE)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // 32], pa.int32()), pa.array([zlib.compress(total, 1)], pa.binary())], ["part", "total"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x)) for x in rows["total"].to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([zlib.compress(total, 1)], pa.binary())})

    schema = "part int, total binary"
    found = unlabelled.select("size", "layout", "feature", "times").coalesce(tasks).mapInArrow(run, schema)
    if found.rdd.getNumPartitions() > 32:
        found = found.groupBy("part").applyInArrow(add, schema)
    total = np.zeros(n)
    for r in found.collect():
        total += np.frombuffer(zlib.decompress(bytes(r["total"])))
    return total


def select(one: np.ndarray, zero: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The features whose presence depends most on the label, from the weight of the texts of each kind that have them."""
    n, present = n1 + n0, one + zero
    some = np.flatnonzero((present >= RARELY) & (present <= n - RARELY))
    a, b = one[some], zero[some]
    c, d = n1 - a, n0 - b
    chi = n * (np.abs(a * d - b * c) - n / 2).clip(0) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    return np.sort(some[best[chi[best] >= LEAST]])


def fit(local: list[np.ndarray], y: np.ndarray, start: list[np.ndarray], remote: Callable[[list[np.ndarray]], list[np.ndarray]] | None) -> list[np.ndarray]:
    """Weights of both views by damped Newton steps on the labelled rows and, by ``remote``, the sums over all others."""
    w, trial = [x.copy() for x in start], [x.copy() for x in start]
    now: list = [None, None]  # loss, gradient and Hessian at w
    scale, done = [1.0, 1.0], [False, False]
    for _ in range(STEPS):
        sums = [_sums(x, y, v) for x, v in zip(local, trial, strict=True)]
        if remote:
            sums = [a + b for a, b in zip(sums, remote(trial), strict=True)]
        for k, v in enumerate(trial):
            if done[k]:
                continue
            ridge = np.append(np.full(len(v) - 1, PENALTIES[k]), 1e-6)
            loss = sums[k][0] + (ridge * v * v).sum() / 2
            if now[k] is None or loss <= now[k][0]:
                done[k] = now[k] is not None and now[k][0] - loss < GAIN * max(1.0, loss)
                now[k] = loss, sums[k][1 : 1 + len(v)] + ridge * v, _whole(sums[k][1 + len(v) :], len(v)) + np.diag(ridge)
                w[k], scale[k] = v, 1.0
            else:
                scale[k] /= 2
                done[k] = scale[k] < 1e-3
            trial[k] = w[k] if done[k] else w[k] - scale[k] * np.linalg.solve(now[k][2], now[k][1])
        if all(done):
            break
    return w


def cotrain(labelled: Rows, ids: np.ndarray, y: np.ndarray, unlabelled: DataFrame, tasks: int, rounds: int = ROUNDS, release: Callable = lambda: None) -> tuple[Views, list[int]]:
    """``y``: 1 or 0 for each row of ``labelled``. The views, and how many pseudo-labels each round gave."""
    spark = unlabelled.sparkSession
    held = folds(ids, 4) == 0
    target = y[~held]
    n1, n0 = float(target.sum()), float((1 - target).sum())
    one, zero = labelled.present(~held & (y == 1)), labelled.present(~held & (y == 0))
    history: list[int] = []
    if n1 and n0:
        chosen = select(one, zero, n1, n0)
        w = fit([labelled.content(chosen)[~held], labelled.layout[~held]], target, [np.zeros(len(chosen) + 1), np.zeros(LAYOUT + 1)], None)
        models = [Views(chosen, *w)]
        before = 0
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(models)

            def counted(rows: Rows, shared=shared) -> np.ndarray:
                given = pseudo_labels(rows, shared.value)
                return np.concatenate([(~np.isnan(given)).sum(0), np.nansum(given, 0), rows.present(given[:, 0] == 1), rows.present(given[:, 0] == 0)])

            found = gathered(unlabelled, tasks, counted, 4 + 2 * SPACE)
            history.append(int(found[:2].sum()) - before)
            if not history[-1]:
                break
            before += history[-1]
            weight = [min(PSEUDO, PSEUDO * len(target) / max(n, 1.0)) for n in found[:2]]
            m1 = weight[0] * found[2]
            chosen = select(one + weight[0] * found[4 : 4 + SPACE], zero + weight[0] * found[4 + SPACE :], n1 + m1, n0 + weight[0] * found[0] - m1)

            def remote(trial: list[np.ndarray], shared=shared, chosen=chosen, weight=weight) -> list[np.ndarray]:
                def stepped(rows: Rows) -> np.ndarray:
                    given = pseudo_labels(rows, shared.value)
                    has = ~np.isnan(given)
                    x = [rows.content(chosen), rows.layout]
                    return np.concatenate([_sums(x[k][has[:, k]], given[has[:, k], k], trial[k]) for k in range(2)])

                first, second = (1 + len(v) + len(v) * (len(v) + 1) // 2 for v in trial)
                total = gathered(unlabelled, tasks, stepped, first + second)
                return [weight[0] * total[:first], weight[1] * total[first:]]

            last = models[-1]
            known = dict(zip(last.selected.tolist(), last.content[:-1].tolist(), strict=True))
            start = [np.array([*(known.get(f, 0.0) for f in chosen.tolist()), last.content[-1]]), last.layout]
            w = fit([labelled.content(chosen)[~held], labelled.layout[~held]], target, start, remote)
            models = [*models, Views(chosen, *w)]
            release()
        views = models[-1]
    else:
        b = 6.0 if n1 else -6.0 if n0 else 0.0
        views = Views(np.zeros(0, np.int64), np.array([b]), np.append(np.zeros(LAYOUT), b))
    odds = views.log_odds(labelled)
    if held.sum() >= 20 and 0 < y[held].sum() < held.sum():
        views.calibration = tuple(platt(odds[held, k], y[held]) for k in range(2))
        views.combined = logistic(_calibrated(odds[held], views.calibration), y[held], np.ones(int(held.sum())), penalty=1.0)
    else:
        views.combined = np.array([0.5, 0.5, 0.0])
    return views, history


class _Words:
    """Features of words; a word's are hashed once per worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 6), np.int32)

    def learn(self, sets: list[Counter]) -> None:
        new = set().union(*sets).difference(self.known)
        if self.known and len(self.known) + len(new) > MEMORY:
            self.__init__()
            new = set().union(*sets)
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.array([shape_features(w) for w in new], np.int32)])

    def features(self, words: Counter, more: list[int]) -> tuple[bytes, bytes]:
        """A text's features in order, and how many of its words have each; ``more`` are features of the text, of all its words."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        hashed = np.concatenate([self.table[at].ravel(), np.array(more, np.int32)])
        times = np.concatenate([np.repeat(np.fromiter(words.values(), np.int64, len(words)), self.table.shape[1]), np.full(len(more), max(words.total(), 1))])
        found, where = np.unique(hashed, return_inverse=True)
        return found.astype(np.int32).tobytes(), np.bincount(where.ravel(), times, len(found)).astype(np.int32).tobytes()


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of words, and the features of both views, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                layout = metadata(texts, *(part.column(k).to_pylist() for k in (1, 2, 3))).astype(np.float32)
                sets = [Counter(words_of(t)) for t in texts]
                words.learn(sets)
                both = [words.features(s, more) for s, more in zip(sets, repetition(texts), strict=True)]
                columns = [part.column(0), pa.array([s.total() for s in sets], pa.int64()), pa.array([x.tobytes() for x in layout], pa.binary()), *(pa.array([x[k] for x in both], pa.binary()) for k in range(2))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "layout", "feature", "times"])

    columns = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), utf8("text").alias("text"))
    return columns.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, layout binary, feature binary, times binary")


def train_features(found: DataFrame, labels: DataFrame, scratch: Scratch, *, label: str = "quality", most: int = SAMPLE) -> tuple[DataFrame, Views, list[int]]:
    """The table of ``found`` features as written, and the views fitted on it."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    rows = scratch.write(found.join(broadcast_if(marks, marks.count(), LABELS_SENT), "doc_id", "left"), "features")
    scratch.release()
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
    parts = ("feature", "times", "layout", "size", "y")
    own = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*parts)).alias("row")).select("doc_id", "row.*").collect()
    own.sort(key=lambda r: r["doc_id"])
    labelled = Rows(np.array([r["size"] for r in own], np.int64), *([bytes(r[c]) for r in own] for c in ("layout", "feature", "times")))
    ids, y = np.array([r["doc_id"] for r in own], np.int64), np.array([r["y"] for r in own], float)
    del own
    unlabelled = rows.where("y IS NULL AND doc_id IS NOT NULL")
    views, given = cotrain(labelled, ids, y, unlabelled, max(1, rows.count() // TASK_ROWS), release=scratch.release)
    return rows, views, given


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = SAMPLE) -> tuple[Views, list[int]]:
    scratch = Scratch(docs.sparkSession, "cotraining")
    _, views, given = train_features(features(docs), labels, scratch, label=label, most=most)
    scratch.drop("features")
    return views, given


def score_features(rows: DataFrame, views: Views) -> DataFrame:
    """``doc_id, p_content, p_metadata, score`` for every row of features."""
    shared = rows.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = model.probabilities(model.log_odds(Rows.of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3))], ["doc_id", "p_content", "p_metadata", "score"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, p_content double, p_metadata double, score double"
    return rows.select("doc_id", "size", "layout", "feature", "times").mapInArrow(run, schema)


def score(docs: DataFrame, views: Views) -> DataFrame:
    """``doc_id, p_content, p_metadata, score`` for every row."""
    return score_features(features(docs), views)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, views, _ = train_features(features(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), Scratch(spark, "cotraining"))
    return score_features(rows, views).withColumn("kept", F.col("score") >= THRESHOLD)
