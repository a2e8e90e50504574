"""Quality classifier by co-training of two views.

View one is the text: which words it has (hashed) and a few measures of its characters. View two is metadata: language,
source and length. Each view has a logistic model, fitted on labelled rows and calibrated on others. In every round each
view judges all documents outside the labelled sample, and those whose odds it moves from the prior by `Fit.sure` or more
become pseudo-labelled documents of the other view: their features are counted by class over the whole corpus, and the
mean log ratio of a document's features in these counts is one more feature of that view, whose weight is fitted on the
labelled rows. The calibrated odds of both views are combined with weights found on the rows that calibrate.

Only the labelled rows are a bounded sample (`Fit.labelled`, the first by md5 of seed and key); their sparse features,
and 2 * 2^18 counts a view and round, are all that reaches the driver. Counts and scores read every document whole. A
model is 2^19 numbers a view whatever the input, so broadcasting it is bounded.

A good document has quality 1 and is not toxic. Labels of a key that has several are averaged; null labels are left out.

Defined cases: null and empty texts have no words; null metadata are values of their own; repeated rows are scored each,
and each counts where it is pseudo-labelled; very long texts are read in blocks; equal odds get equal pseudo-labels;
without labels (or with labels of one class only) every score is the prior (0.5 without labels); no rows give no rows;
results are added to the key alone, so other columns cannot clash.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import ship_package
from catalogspark.llm import byte_pairs, shingles

SLOTS = 1 << 18
CHUNK = 1 << 20
SYMBOLS = b"#*$%&|<>{}[]"


@dataclass
class Fit:
    """Bounds and settings of fitting."""

    labelled: int = 5000
    rounds: int = 3
    sure: float = 3.0  # how many times likelier than by the prior a class must be for a pseudo-label
    steps: int = 120
    l2: float = 1e-3
    least_docs: int = 3
    seed: int = 5


@dataclass
class View:
    """Model of one view; `line` calibrates its odds."""

    weights: np.ndarray  # of SLOTS features, then of the dense ones, then of the mean evidence
    evidence: np.ndarray  # log ratio of each feature in pseudo-labelled documents
    line: np.ndarray

    def odds(self, slots: np.ndarray, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Calibrated odds of rows whose features are slots[at[i] : at[i + 1]] and dense[i]."""
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        sums = lambda by: np.bincount(row, weights=by[slots], minlength=len(n))
        mean = sums(self.evidence) / np.maximum(n, 1)
        raw = sums(self.weights[:SLOTS]) + np.column_stack([dense, mean]) @ self.weights[SLOTS:]
        return self.line[0] * raw + self.line[1]


@dataclass
class Model:
    """Both views, how their calibrated odds are combined, and the odds of the prior."""

    text: View
    meta: View
    both: np.ndarray
    prior: float


def measures(data: np.ndarray, offsets: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Dense measures of texts, each about 0 to 1."""
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    size = np.maximum(np.diff(offsets), 1)
    symbol, digit, line = sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))), sums((data >= 48) & (data <= 57)), sums(data == 10)
    upper = sums((data >= 65) & (data <= 90))
    words = np.maximum(n_words, 1)
    return np.stack([np.ones(len(size)), np.minimum(symbol / words, 2), np.minimum(digit / words, 2), upper / size, np.minimum(line / words, 1), np.minimum(size / words / 10, 3), np.log1p(n_words) / 10], 1)


DENSE = 7


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots of distinct words, texts' places in them, dense measures) of blocks of texts."""
    data, at = byte_pairs.buffers(texts)
    for a, b in byte_pairs.blocks(at, CHUNK):
        part, inner = data[at[a] : at[b]], at[a : b + 1] - at[a]
        low = shingles.LOWER[part]
        starts, ends, where = shingles.words(low, inner)
        slot = (shingles.word_hashes(low, starts, ends) >> np.uint64(46)).astype(np.int64)
        doc = np.repeat(np.arange(b - a), np.diff(where))
        pairs = np.unique(doc * SLOTS + slot)
        yield pairs % SLOTS, np.searchsorted(pairs, np.arange(b - a + 1) * SLOTS), measures(part, inner, np.diff(where))


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Three slots of SLOTS for each row: language, source, and length in powers of two."""
    import zlib

    length = ["none" if n is None else str(int(n).bit_length()) for n in n_chars]
    names = [(f"l:{a}", f"s:{b}", f"n:{c}") for a, b, c in zip(lang, source, length, strict=True)]
    return np.array([[zlib.crc32(x.encode()) % SLOTS for x in row] for row in names], np.int64).reshape(-1, 3)


class Rows:
    """Sparse 0/1 features and dense ones of fitting rows."""

    def __init__(self, slots: list[np.ndarray], dense: np.ndarray):
        self.dense = dense
        self.row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        self.slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        self.n = len(slots)

    def common(self, least: int) -> "Rows":
        """Without slots of fewer than `least` rows, renumbered; `kept` names them."""
        kept = np.flatnonzero(np.bincount(self.slot, minlength=SLOTS) >= least)
        place = np.full(SLOTS, -1)
        place[kept] = np.arange(len(kept))
        some = place[self.slot] >= 0
        out = Rows([], self.dense)
        out.n, out.row, out.slot, out.kept = self.n, self.row[some], place[self.slot[some]], kept
        return out

    def dot(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot], minlength=self.n) + self.dense @ v


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Weighted logistic regression by Adam over all rows."""
    w, v = np.zeros(len(x.kept)), np.zeros(x.dense.shape[1])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    total = max(weight.sum(), 1e-9)
    for t in range(1, fit.steps + 1):
        error = weight * (sigmoid(x.dot(w, v)) - y) / total
        grads = (np.bincount(x.slot, weights=error[x.row], minlength=len(w)) + fit.l2 * w, x.dense.T @ error + fit.l2 * v)
        for p, g, (m, s) in zip((w, v), grads, state, strict=True):
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.98**t)) + 1e-8)
    return w, v


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of columns and an offset of the odds, by Newton steps with slight shrinkage; no negative weights."""
    x = np.column_stack([x, np.ones(len(y))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] = np.maximum(w[:-1], 0.0)
    return w


def ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log ratio of features in good and bad pseudo-labelled documents; 0 without documents of either class.

    Entries 0 to SLOTS - 1 count documents with the feature, the last one all documents of the class."""
    if not good[-1] or not bad[-1]:
        return np.zeros(SLOTS)
    return np.log((good[:-1] + 1) / (good[-1] + 2)) - np.log((bad[:-1] + 1) / (bad[-1] + 2))


def learnt(text: Rows, meta: Rows, y: np.ndarray, fold: np.ndarray, evidence: list[np.ndarray], fit: Fit) -> Model:
    """Views fitted on labelled rows outside the fold, calibrated and combined on those in it."""
    prior = float(y.mean())
    hold = fold if len(np.unique(y[fold])) == 2 else np.zeros(len(y), bool)
    train = ~hold
    views, odds = [], []
    for rows, least, logs in ((text, fit.least_docs, evidence[0]), (meta, 1, evidence[1])):
        mean = np.bincount(rows.row, weights=logs[rows.slot], minlength=rows.n) / np.maximum(np.bincount(rows.row, minlength=rows.n), 1)
        x = rows.common(least)
        x.dense = np.column_stack([x.dense, mean])
        w, v = logistic(x, y.astype(float), train.astype(float), fit)
        raw, line = x.dot(w, v), np.array([1.0, 0.0])
        if hold.any():
            line = calibrated(raw[hold][:, None], y[hold])
        whole = np.zeros(SLOTS + len(v))
        whole[x.kept], whole[SLOTS:] = w, v
        views.append(View(whole, logs, line))
        odds.append(line[0] * raw + line[1])
    both = np.array([1.0, 1.0, -np.log(prior / (1 - prior))])
    if hold.any():
        both = calibrated(np.column_stack(odds)[hold], y[hold])
    return Model(views[0], views[1], both, float(np.log(prior / (1 - prior))))


def narrowed(labels: DataFrame, key: str) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col(key).alias("key")).agg((F.avg(good.cast("int")) >= 0.5).cast("int").alias("y"))


def columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """What both views read, under names of their own."""
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def viewed(batch: pa.RecordBatch) -> Iterator[tuple[tuple, tuple]]:
    """(slots, at, dense) of the text and of the metadata, for blocks of a batch's rows in order."""
    meta = meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    a = 0
    for slot, at, dense in text_features(batch.column("text")):
        n = len(at) - 1
        yield (slot, at, dense), (meta[a : a + n].ravel(), np.arange(n + 1) * 3, np.ones((n, 1)))
        a += n


def exchanged(rows: DataFrame, some: DataFrame, model: Model, fit: Fit) -> list[np.ndarray]:
    """Evidence of both views: each from all documents outside the sample that the other one is sure of."""
    spark = rows.sparkSession
    shared, gap = spark.sparkContext.broadcast(model), float(np.log(fit.sure))
    # at most `labelled` keys; a null key is in no sample
    pool = rows.join(F.broadcast(some.select("key")), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        counts = np.zeros((2, 2, SLOTS + 1), np.int64)
        for batch in batches:
            for views in viewed(batch):
                odds = [view.odds(*x) for view, x in zip((m.text, m.meta), views, strict=True)]
                for learner, (slots, at, _) in enumerate(views):
                    moved = odds[1 - learner] - m.prior
                    for label, chosen in enumerate((moved <= -gap, moved >= gap)):
                        counts[learner, label, :SLOTS] += np.bincount(slots[np.repeat(chosen, np.diff(at))], minlength=SLOTS)
                        counts[learner, label, SLOTS] += chosen.sum()
        for learner in range(2):
            slot = np.flatnonzero(counts[learner].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), learner, np.int32)), pa.array(slot.astype(np.int32)), *(pa.array(counts[learner, label, slot]) for label in range(2))], ["learner", "slot", "bad", "good"])

    found = pool.mapInArrow(run, "learner int, slot int, bad long, good long").groupBy("learner", "slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    total = np.zeros((2, 2, SLOTS + 1), np.int64)
    for label, name in enumerate(("bad", "good")):
        total[found["learner"].to_numpy(), label, found["slot"].to_numpy()] = found[name].to_numpy()
    return [ratios(t[1], t[0]) for t in total]


def fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, fit: Fit) -> Model | None:
    """Model from a bounded sample of labelled rows and all others; None without labels of both classes."""
    known = narrowed(labels, key)
    rank = lambda c: F.md5(F.concat_ws("|", F.lit(str(fit.seed)), F.col(c).cast("string")))
    every = columns(docs, key, text)
    some = every.select("key").filter("key IS NOT NULL").distinct().join(known, "key").orderBy(rank("key")).limit(fit.labelled)
    rows = every.join(F.broadcast(some), "key")  # at most `labelled` rows
    rows = rows.groupBy("key").agg(F.min_by(F.struct("y", "text", "lang", "source", "n_chars"), F.struct(F.xxhash64("text"), "lang", "source", "n_chars")).alias("row")).select("key", "row.*")  # one row a key

    kind = dict(every.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, dense, meta = [], [], []
            for (slot, at, d), (m, _, _) in viewed(batch):
                slots += [slot[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                dense += list(d)
                meta += list(m.reshape(-1, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("rank"), batch.column("y"), pa.array(slots, pa.list_(pa.int64())), pa.array(dense, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int64()))],
                ["key", "rank", "y", "slots", "dense", "meta"],
            )

    found = rows.withColumn("rank", rank("key")).select("key", "rank", "y", "text", "lang", "source", "n_chars").mapInArrow(run, f"key {kind}, rank string, y int, slots array<long>, dense array<double>, meta array<long>").toArrow().sort_by("rank")
    y = found["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    of_text = Rows([s.values.to_numpy() for s in found["slots"]], np.stack([d.values.to_numpy() for d in found["dense"]]))
    of_meta = Rows([m.values.to_numpy() for m in found["meta"]], np.ones((len(y), 1)))
    fold = np.array([int(r[-8:], 16) % 5 == 0 for r in found["rank"].to_pylist()])  # far from the leading digits that choose rows
    evidence = [np.zeros(SLOTS)] * 2
    some = docs.sparkSession.createDataFrame(found.select(["key"]), f"key {kind}")  # the chosen keys, so that no round chooses them again
    model = learnt(of_text, of_meta, y, fold, evidence, fit)
    for _ in range(fit.rounds):
        model = learnt(of_text, of_meta, y, fold, exchanged(every, some, model, fit), fit)
    return model


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit: Fit | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, text_score, meta_score, score, kept) of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    model = fitted(docs, labels, key, text, fit or Fit())
    if model is None:
        known = narrowed(labels, key).agg(F.avg("y")).first()[0]
        prior = float(np.clip(0.5 if known is None else known, 1e-6, 1 - 1e-6))
        flat = np.array([0.0, np.log(prior / (1 - prior))])
        views = [View(np.zeros(SLOTS + n + 1), np.zeros(SLOTS), flat) for n in (DENSE, 1)]
        model = Model(*views, np.array([0.5, 0.5, 0.0]), float(flat[1]))
    shared = spark.sparkContext.broadcast(model)
    rows = columns(docs, key, text)
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            odds = [(m.text.odds(*t), m.meta.odds(*x)) for t, x in viewed(batch)]
            a, b = (np.concatenate([o[i] for o in odds]) if odds else np.zeros(0) for i in (0, 1))
            both = m.both[0] * a + m.both[1] * b + m.both[2]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(np.round(sigmoid(x), 9)) for x in (a, b, both))], ["key", "text_score", "meta_score", "score"])

    out = rows.mapInArrow(run, f"key {kind}, text_score double, meta_score double, score double")
    return out.withColumn("kept", F.col("score") >= threshold).withColumnRenamed("key", key)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by co-trained views."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
