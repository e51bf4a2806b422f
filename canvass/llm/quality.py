"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad.  What speaks for a label are
counts of the line's characters and words, whether the line repeats, and the
same of the lines beside it; how labels follow one another is learned too.
Forward-backward gives each line's probability of being good, and their mean
by length, put on the scale of the labels, is the document's quality.

Learned on a bounded sample of labelled documents outside the held-out fold
(``PER_LABEL`` of each label, long texts by a part; ``samples`` has the bounds),
on the driver in numpy, a few texts' features at a time, so that it holds one table of
lines; scored over whole texts where the texts are.  Lines have
no labels of their own: at first every line bears its document's, then those that
the model finds to be of the other kind change sides, up to half of a bad
document's length and a fifth of a good one's, and the model learns again.
Chains of very many lines are worked on in stretches side by side.  A null or empty text has one empty line and gets that
line's score.  Without any labelled rows of both labels every score is 0.5.
Repeated rows give repeated results; rows without doc_id are left out; other
columns come through only in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import samples
from canvass.llm import textbytes as tb
from canvass.llm.common import parts, small_batches

PER_LABEL = 1200
STEPS = 120
ROUNDS = 2  # of learning; before each but the first, lines change sides
STRETCH = 2000  # lines of a chain that are gone through one by one
SAMPLE_BYTES = 1 << 18  # of the sample's texts, whose features are found at once
SAMPLE_LINES = 1 << 16  # that are weighed at once when learning

_CLASSES = ["upper", "lower", "digit", "shout", "symbol", "bar", "point", "blank", "other"]
_CLASS = np.full(256, 8, np.uint8)
for _i, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "#$%&*@^~<>={}[]\\/_+`", "|", ".,;:'\"-()", " \t\r\x0b\x0c\n"]):
    _CLASS[[ord(c) for c in _chars]] = _i


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, and the n + 1 offsets of each text's lines;
    every text has one line more than it has line feeds."""
    feeds = np.flatnonzero(data == 10)
    per = np.searchsorted(feeds, offsets)
    first = per + np.arange(len(offsets))
    total = int(first[-1])
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    slot = np.arange(len(feeds)) + np.searchsorted(offsets, feeds, "right") - 1
    starts[first[:-1]] = offsets[:-1]
    starts[slot + 1] = feeds + 1
    ends[first[1:] - 1] = offsets[1:]
    ends[slot] = feeds
    return starts, ends, first


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features and a length for each line, and the texts' line offsets."""
    starts, ends, first = lines(data, offsets)
    size = ends - starts
    share = 1.0 / np.maximum(size, 1)
    kind = _CLASS[data]
    columns = []
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        columns.append((total[ends] - total[starts]) * share)
    word, stop, head = tb.words(data, offsets)
    low = np.searchsorted(word, starts)
    count = np.searchsorted(word, ends) - low
    hashes = tb.word_hashes(data, word, stop)
    again = np.zeros(len(word) + 1, np.int64)  # words like one of the eight before in their text
    if len(word):
        same = np.zeros(len(word), bool)
        place = np.arange(len(word)) - np.repeat(head[:-1], np.diff(head))
        for back in range(1, 9):
            same[back:] |= (hashes[back:] == hashes[:-back]) & (place[back:] >= back)
        np.cumsum(same, out=again[1:])
    columns.append((again[low + count] - again[low]) / np.maximum(count, 1))
    columns.append(np.log1p(size) / 5)
    columns.append(size / np.maximum(count, 1) / 10)
    # Does the line repeat one of its text's lines?
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = tb.word_hashes(data, starts, ends, 1)
    order = np.lexsort((h, owner))
    h = h[order]
    twin = np.zeros(len(order), bool)
    if len(order) > 1:
        equal = (h[1:] == h[:-1]) & (owner[order][1:] == owner[order][:-1]) & (size[order][1:] > 0)
        twin[order[1:]] |= equal
        twin[order[:-1]] |= equal
    columns.append(twin.astype(float))
    own = np.stack(columns, axis=1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edges = np.zeros((len(own), 2), np.float32)
    edges[first[:-1], 0] = 1
    edges[first[1:] - 1, 1] = 1
    return np.concatenate([own, before, after, edges], axis=1), size + 1, first


def join(x: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of two exponentials, along the last axis."""
    return np.maximum(x[..., 0], x[..., 1]) + np.log1p(np.exp(-np.abs(x[..., 0] - x[..., 1])))


def _along(score: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The forward sums of one long chain.  The chain is cut into stretches;
    what each makes of either label before it is found for all stretches at
    once, then the stretches are gone through one after the other."""
    n = len(score)
    size = int(np.ceil(np.sqrt(n)))
    count = -(-n // size)
    padded = np.zeros((count * size, 2))
    padded[:n] = score
    padded = padded.reshape(count, size, 2)
    # of[b, t, i, j]: the sum over stretch b's first t + 1 labels, the last being j, after label i.
    of = np.empty((count, size, 2, 2))
    of[:, 0] = table[None] + padded[:, 0, None, :]
    for t in range(1, size):
        of[:, t] = padded[:, t, None, :] + join(of[:, t - 1, :, None, :] + table.T[None, None])
    out = np.empty((count, size, 2))
    out[0, 0] = score[0]
    for t in range(1, size):
        out[0, t] = padded[0, t] + join(out[0, t - 1][None, :] + table.T)
    for b in range(1, count):
        before = out[b - 1, -1]
        out[b] = join(np.moveaxis(before[:, None] + of[b], 1, -1))
    return out.reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For many chains at once: each place's probability of label 1, the sums
    of the neighbouring labels' joint probabilities, and the chains' log sums.
    ``emission`` is the advantage of label 1, ``table`` that of label pairs."""
    score = np.stack([np.zeros_like(emission), emission], axis=1)
    forward, backward = score.copy(), np.zeros_like(score)
    number = np.diff(first)
    for k in np.flatnonzero(number > STRETCH):
        part = slice(first[k], first[k + 1])
        forward[part] = _along(score[part], table)
        backward[part] = _along(score[part][::-1], table.T)[::-1] - score[part]
    short = np.flatnonzero(number <= STRETCH)
    order = short[np.argsort(-number[short], kind="stable")]
    size, head = number[order], first[:-1][order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest + 1), "left")  # chains with over t places
    for t in range(1, longest):
        at = head[: active[t]] + t
        forward[at] = score[at] + join(forward[at - 1][:, None, :] + table.T[None])
    for t in range(longest - 2, -1, -1):
        at = head[: active[t + 1]] + t
        backward[at] = join((backward[at + 1] + score[at + 1])[:, None, :] + table[None])
    z = np.where(number > 0, join(forward[np.maximum(first[1:] - 1, 0)]) if len(forward) else 0.0, 0.0)
    each = np.repeat(z, number)
    good = np.exp(np.clip(forward[:, 1] + backward[:, 1] - each, -60, 0))
    later = np.ones(len(emission), bool)
    later[first[:-1]] = False
    b = np.flatnonzero(later)
    joint = np.exp(np.clip(forward[b - 1][:, :, None] + table[None] + (score[b] + backward[b])[:, None, :] - each[b][:, None, None], -60, 0)).sum(axis=0)
    return good, joint, z


def advantage(x: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """That of label 1 for each line, from its scaled features."""
    out = np.empty(len(x))
    for low in range(0, len(x), SAMPLE_LINES):
        out[low : low + SAMPLE_LINES] = x[low : low + SAMPLE_LINES] @ weights + bias
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    table: np.ndarray
    slope: float
    shift: float

    def chain(self, x: np.ndarray) -> np.ndarray:
        return advantage(np.clip((x - self.mean) / self.scale, -5, 5), self.weights, self.bias)

    def mean_good(self, emission: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = marginals(emission, first, self.table)
        total = np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1])
        p = np.clip(total, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, length, first = features(data, offsets)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.mean_good(self.chain(x), length, first) + self.shift, -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and constant of a logistic curve through (x, y), by Newton steps
    with a little shrinkage."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * w
        w += np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 0.1 * np.eye(len(w)), slope)
    return w


def sides(y: np.ndarray, good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A label for each line: its own where its document's share of changed
    lines allows it, the surest first, else its document's."""
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    line = y[owner]
    own = np.where(line == 1, 1 - good, good)  # how sure the other side is
    order = np.lexsort((-own, owner))
    used = np.cumsum(length[order])
    used = used - np.concatenate([[0], used])[first[:-1]][owner]
    allowed = np.where(y == 1, 0.2, 0.5) * np.add.reduceat(length, first[:-1])
    out = line.copy()
    change = order[(used <= allowed[owner]) & (own[order] > 0.5)]
    out[change] = 1 - line[change]
    return out


def sample_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of all the texts, found for some of them at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    found = [features(*tb.column(some.column("text"))) for some in parts([batch], size=SAMPLE_BYTES)]
    number = np.concatenate([np.diff(first) for _, _, first in found])
    return np.concatenate([x for x, _, _ in found]), np.concatenate([length for _, length, _ in found]), np.concatenate([[0], np.cumsum(number)])


def train(sample: list[tuple[str, int]], steps: int = STEPS) -> Model | None:
    """Maximises the lines' conditional likelihood.  None if a label is
    missing."""
    y = np.array([label for _, label in sample], float)
    if len(set(y)) < 2:
        return None
    x, length, first = sample_features([text for text, _ in sample])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    # In place: the sample's lines are one table, however many they are.
    x -= mean
    x /= scale
    np.clip(x, -5, 5, out=x)
    number = np.diff(first)
    line_y = np.repeat(y, number)
    weight = np.repeat(1.0 / number, number)  # each document counts alike
    theta = np.zeros(x.shape[1] + 1 + 4)
    split = lambda theta: (theta[:-5], theta[-5], theta[-4:].reshape(2, 2))
    later = np.ones(len(line_y), bool)
    later[first[:-1]] = False
    pairs = np.flatnonzero(later)
    for turn in range(ROUNDS):
        if turn:
            w, b, table = split(theta)
            line_y = sides(y, marginals(advantage(x, w, b), first, table)[0], length, first)
        label = line_y.astype(int)
        observed = np.zeros((2, 2))
        np.add.at(observed, (label[pairs - 1], label[pairs]), 1.0)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps // ROUNDS + 1):
            w, b, table = split(theta)
            good, joint, _ = marginals(advantage(x, w, b), first, table)
            error = (line_y - good) * weight
            pull = sum(x[low : low + SAMPLE_LINES].T @ error[low : low + SAMPLE_LINES] for low in range(0, len(x), SAMPLE_LINES))
            slope = np.concatenate([pull, [error.sum()], ((observed - joint) / max(len(label), 1) * len(y)).ravel()]) / len(y)
            slope -= 1e-3 * theta
            slope[-4:] -= 0.05 * theta[-4:]
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, b, table = split(theta)
    model = Model(mean, scale, w.astype(np.float32), float(b), table, 1.0, 0.0)
    model.slope, model.shift = map(float, calibrate(model.mean_good(advantage(x, model.weights, model.bias), length, first)[:, None], y))
    return model


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, per_label: int = PER_LABEL) -> Model | None:
    return train(samples.labelled(docs, labels, "quality", parts, held_out, per_label))


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *keep, score`` for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.where("doc_id IS NOT NULL").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).select("doc_id", "text", *(k for k in keep if k != "text"))
    if model is None:
        return base.select("doc_id", *keep, F.lit(0.5).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in parts(batches):
            value = shared.value.score(*tb.column(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", *keep)), pa.array(value)], ["doc_id", *keep, "score"])

    kinds = dict(base.dtypes)
    return base.mapInArrow(run, ", ".join(["doc_id long", *(f"`{k}` {kinds[k]}" for k in keep), "score double"]))
