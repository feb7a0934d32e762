"""Quality classifier by positive-unlabelled learning.

Texts become a few shares and ratios (never labels, languages, sources or ids). A small network learns
from trusted positives and unlabelled texts, minimising the non-negative unbiased risk; the class prior
is estimated from how a first classifier ranks the two. The positives are a bounded sample of the
labelled rows; the unlabelled are all rows, dealt out evenly: each task trains on its own, and the
networks are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, map_text, materialize, record, small_batches, texts_of, values_of

#: Labelled rows that train at most, and rows of features that a task holds at once.
MAX_POSITIVES, CHUNK_ROWS = 20_000, 50_000
#: Frequent function words of several languages.
FUNCTION_WORDS = frozenset(
    b"the of and a to in is that it was for on with as are be de la le et les des en un une du est que qui der die und den von zu das mit nicht ein el y los se las por con no para".split()
)
CLASSES = [
    bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"?-()", b"!", b"#*$%&|<>", b"@^~=+_\\/{}[]`", bytes(range(128, 256)),
]
N_FEATURES = len(CLASSES) + 13


def features(text: bytes) -> list[float]:
    """Finite numbers for any text; zeros for an empty one."""
    words, size = text.split(), len(text)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    shares = [(size - len(text.translate(None, c))) / size for c in CLASSES]
    letters = sum(map(len, words))
    capital = sum(map(bytes.isupper, words))
    return shares + [
        np.log1p(n), np.log1p(size / n), letters / n / 10,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / pairs,
        sum(map(eq, words, words[1:])) / pairs,
        capital / n,
        sum(map(bytes.isalpha, words)) / n,
        sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum([len(x) == 1 for x in words]) / n,
        max(map(len, words)) / letters,
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, x): written once, read for training and for scoring. Rows are dealt out evenly, so that
    what a task trains on is like the whole, however the documents are sorted."""
    out = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            yield record(out, values_of(batch, "doc_id"), values_of(batch, "fold"), [features(t) for t in texts_of(batch)])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (id_crc32() % 5).cast("int").alias("fold"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(map_text(chosen, run, "doc_id long, fold int, x array<float>").repartition(parts), "quality-features")


class Network:
    """One hidden layer; ``logit > 0`` speaks for the positive class."""

    def __init__(self, params: list[np.ndarray]):
        self.p = [np.array(x, np.float64) for x in params]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    @classmethod
    def fresh(cls, width: int, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float, decay: float = 1e-3) -> None:
        """One Adam step for the loss whose derivative by the logits is ``slope``."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = np.outer(slope, self.p[2]) * (1 - h * h)
        grads = [x.T @ back + decay * self.p[0], back.sum(0), h.T @ slope + decay * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for p, g, m, v in zip(self.p, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def apart_slope(z: np.ndarray, n_positive: int) -> np.ndarray:
    """Derivative of the logistic loss that tells the first ``n_positive`` rows from the rest, both halves
    of equal weight."""
    s = _sigmoid(z)
    return np.concatenate([(s[:n_positive] - 1) / n_positive, s[n_positive:] / (len(z) - n_positive)]) / 2


def risk_slope(z: np.ndarray, n_positive: int, prior: float) -> np.ndarray:
    """Derivative of prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), logistic losses, by the logits of
    the positives and then the unlabelled rows. Where the part that cannot be negative would be, the step
    goes up on it instead."""
    s, n_unlabelled = _sigmoid(z), len(z) - n_positive
    as_negative = np.concatenate([-prior * s[:n_positive] / n_positive, s[n_positive:] / n_unlabelled])
    if np.logaddexp(0, z[n_positive:]).mean() < prior * np.logaddexp(0, z[:n_positive]).mean():
        return -as_negative
    as_negative[:n_positive] += prior * (s[:n_positive] - 1) / n_positive
    return as_negative


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(batch.num_rows, -1)


def _chunks(batches, scale) -> Iterator[np.ndarray]:
    """The rows of a task, scaled, some CHUNK_ROWS at a time."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_rows(batch))
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield scale(np.concatenate(held))
                held, size = [], 0
    if held:
        yield scale(np.concatenate(held))


def train(table: DataFrame, positive: np.ndarray, scale: Scale, net: Network, slope: Callable[[np.ndarray, int], np.ndarray], rounds: int, steps: int = 75, rate: float = 0.02, batch: int = 2048) -> Network:
    """The network after ``rounds`` of training on all rows of ``table``. In a round each task takes the
    network, makes ``steps`` steps over each chunk of its rows, against the positives, and gives back
    what it has; the driver's next network is their mean, weighted by rows."""
    spark = table.sparkSession
    for i in range(rounds):
        held = spark.sparkContext.broadcast((positive, scale, net.p, rate if i < rounds * 2 // 3 else rate / 5))

        def run(batches, held=held):
            positive, scale, params, rate = held.value
            for rows in _chunks(batches, scale):
                own, rng = Network(params), np.random.default_rng(len(rows))
                for _ in range(steps):
                    p = positive if len(positive) <= batch else positive[rng.integers(len(positive), size=batch)]
                    u = rows if len(rows) <= batch else rows[rng.integers(len(rows), size=batch)]
                    x = np.concatenate([p, u])
                    own.step(x, slope(own.logit(x), len(p)), rate)
                yield pa.RecordBatch.from_arrays([pa.array([float(len(rows))]), pa.array([np.concatenate([q.ravel() for q in own.p]).tolist()])], ["n", "p"])

        n, total = 0.0, 0.0
        for r in table.select("x").mapInArrow(run, "n double, p array<double>").toLocalIterator():  # some kB a chunk, one after the other
            n, total = n + r.n, total + r.n * np.array(r.p)
        held.unpersist()
        cuts = np.cumsum([q.size for q in net.p])[:-1]
        net = Network([q.reshape(old.shape) for q, old in zip(np.split(total / n, cuts), net.p)])
    return net


def class_prior(table: DataFrame, positive: np.ndarray, scale: Scale, seed: int = 0) -> float:
    """The share of positives among the unlabelled rows: a classifier of one against the other learns on
    half of both, and on the other halves the least ratio of the shares above a score bounds it. Two
    standard errors are taken off: too high a prior hides the negatives, too low a one only dims scores."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    net = train(table.where(half == 0), positive[::2], scale, Network.fresh(positive.shape[1], 12, seed), apart_slope, 4)
    sp = np.sort(net.logit(positive[1::2]))
    cuts = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    params = net.p

    def run(batches):
        above, n = np.zeros(len(cuts)), 0
        for rows in _chunks(batches, scale):
            su = np.sort(Network(params).logit(rows))
            above += len(su) - np.searchsorted(su, cuts)
            n += len(su)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array([*above, float(n)])], ["cut", "n"])

    counted = dict(table.where(half == 1).select("x").mapInArrow(run, "cut long, n double").groupBy("cut").agg(F.sum("n")).collect())  # 92 rows
    n_u = counted[len(cuts)]
    if not n_u:
        return 0.5
    qp, qu = 1 - np.searchsorted(sp, cuts) / len(sp), np.array([counted[i] for i in range(len(cuts))]) / n_u
    slack = (np.log(40) / 2 / n_u) ** 0.5 + (np.log(40) / 2 / len(sp)) ** 0.5
    at = np.argmin((qu + slack) / qp)
    share = min(1.0, qu[at] / qp[at])
    return float(np.clip(share - 2 * (share * (1 - share) / n_u) ** 0.5, 0.05, 0.98))


@dataclass(frozen=True)
class Scale:
    """Features to numbers of like spread."""

    mean: np.ndarray
    spread: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.spread, -8, 8)

    @classmethod
    def of(cls, table: DataFrame) -> tuple[Scale, int]:
        """The scale of all rows, and their number."""

        def run(batches):
            sums = np.zeros(2 * N_FEATURES + 1)
            for batch in batches:
                if batch.num_rows:
                    x = _rows(batch).astype(np.float64)
                    sums += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["i", "s"])

        got = dict(table.select("x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s")).collect())  # a row a feature and moment
        sums = np.array([got.get(i, 0.0) for i in range(2 * N_FEATURES + 1)])
        n = max(1.0, sums[-1])
        mean = sums[:N_FEATURES] / n
        return cls(mean, np.sqrt(np.maximum(sums[N_FEATURES:-1] / n - mean**2, 0)) + 1e-3), int(sums[-1])


@dataclass(frozen=True)
class Model:
    """What scores texts; without ``params`` every score is 0.5."""

    scale: Scale | None
    params: list[np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(Network(self.params).logit(self.scale(x))) if self.params is not None and len(x) else np.full(len(x), 0.5)


def fit_features(table: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES) -> Model:
    """The model that a feature table's rows outside fold 0 give."""
    rest = table.where("fold <> 0")
    trusted = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1")
    drawn = rest.join(trusted, "doc_id", "left_semi").select("doc_id", "x").orderBy(F.xxhash64("doc_id"), "x").limit(max_positives)
    positive = np.array([r.x for r in drawn.toLocalIterator()], np.float64).reshape(-1, N_FEATURES)
    scale, n = Scale.of(rest)
    if len(positive) < 4 or n < 4:
        return Model(None, None)
    positive = scale(positive)
    prior = class_prior(rest, positive, scale)
    return Model(scale, train(rest, positive, scale, Network.fresh(N_FEATURES, 16, 1), partial(risk_slope, prior=prior), 8).p)


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES) -> Model:
    """A model learned from all documents but those held out (``quality_scores`` says which)."""
    return fit_features(feature_table(docs), labels, max_positives)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores ``threshold`` or more, as they are. Texts stay in their tasks: one pass,
    no shuffle, and only the text column meets Python."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw = [t.encode() if t else b"" for t in texts.to_pylist()]
        return pa.array(held.value.score(np.array([features(t) for t in raw], np.float32).reshape(-1, N_FEATURES)))

    small_batches(docs.sparkSession)
    return docs.where(score("text") >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_positives: int = MAX_POSITIVES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    ``labels``: doc_id and quality; positives are those all of whose labels are 1, and at most
    ``max_positives`` of them, those of the smallest hashes, train. Unlabelled are all rows, in every
    round. Rows whose crc32 of the id mod 5 is 0 are held out: nothing is learned from them. Null and
    empty texts have the zero features and a score like any other. With fewer than 4 positives or texts
    to learn from the score is 0.5; an empty table gives no rows. Null labels are ignored; repeated rows
    get equal scores. Columns other than doc_id and text are not read.
    """
    table = feature_table(docs)
    held = docs.sparkSession.sparkContext.broadcast(fit_features(table, labels, max_positives))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            score = held.value.score(_rows(batch)) if batch.num_rows else np.empty(0)
            yield record(out, batch.column(0), batch.column(1).to_numpy(zero_copy_only=False) == 0, score, (score >= threshold).astype(np.int32))

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
