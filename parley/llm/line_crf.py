"""Document quality from lines: a linear-chain conditional random field over good and bad lines.

A line is described by shares of kinds of characters, lengths and repetition of
its words, and by the same numbers of the lines before and after it. The field
has weights for these and for the four pairs of neighbouring labels. Forward and
backward passes give each line's marginal probability of being good; a
document's quality is their mean weighted by line length, turned into a
probability by a one-dimensional logistic fit on the training documents.

The field is fitted on a bounded sample: at most `per_class` documents of each
label, in the order of a hash of their id, and of each at most `sample_lines`
lines, in runs of neighbouring lines that a hash chooses over the whole text
(lines carry the document's label, runs are chains of their own). The sample's
features are made on the executors. The logistic fit and scoring read every
line of every text they use.

Defined cases: a null text counts as empty; an empty text is one empty line.
Without labelled documents of both kinds every score is 1. Labels other than 0
and 1 are not used; a document with labels of both kinds is not used either.
Rows may repeat; other columns are not read or pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.descent import minimise
from parley.llm.shared import handed_back

PER_CLASS = 1_000
SAMPLE_LINES = 200
RUN_LINES = 20
GOOD_FROM = 0.3
SLICE_ROWS = 256
# Kinds of bytes counted in a line, each with its characters (fixed values).
KINDS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:'\"-()",
    b"!?", b"|/\\<>[]{}=_", b"#$%&*@^~+`",
)


def _kind_table() -> np.ndarray:
    kinds = np.full(256, len(KINDS), np.uint8)
    for n, members in enumerate(KINDS):
        kinds[list(members)] = n
    return kinds


_KIND_OF = _kind_table()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row of numbers per line, and the lines' lengths in bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    kinds = np.append(_KIND_OF[np.frombuffer(raw, np.uint8)], len(KINDS) + 1)
    size = np.maximum(lengths, 1)[:, None]
    counts = np.stack(
        [np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(len(KINDS) + 1)], axis=1
    )
    words = [line.split() for line in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    some = np.maximum(n_words, 1)
    different = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    repeats = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, len(words))
    short = np.fromiter((sum(len(x) <= 3 for x in w) for w in words), np.int64, len(words))
    ends = np.fromiter((line[-1:] in b".!?" and line != b"" for line in lines), float, len(lines))
    again = np.concatenate([[False], np.array([a == b for a, b in zip(lines, lines[1:], strict=False)], bool)])
    own = np.column_stack([
        counts / size,
        np.log1p(lengths), np.log1p(n_words), np.minimum(lengths / some, 40.0) / 10.0,
        different / some, repeats / some, short / some, ends, again,
    ])
    return np.hstack([own, (own > 0.02).astype(float)]), lengths


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A line's numbers, those of the lines before and after (zeros beyond the ends), and marks of the ends."""
    none = np.zeros((1, own.shape[1]))
    edges = np.zeros((len(own), 2))
    edges[0, 0] = edges[-1, 1] = 1.0
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), edges, np.ones((len(own), 1))])


def marginals(odds: list[float], pairs: np.ndarray) -> list[float]:
    """Probability of a good line for each line, from the lines' own log odds and the label pairs."""
    (t00, t01), (t10, t11) = pairs.tolist()

    def passed(z: float, a01: float, a10: float) -> float:
        # log(e^(z+t11) + e^a01) - log(e^(z+a10) + e^t00), stable for any z
        x, y = z + t11, a01
        up = max(x, y) + math.log1p(math.exp(-abs(x - y)))
        x, y = z + a10, t00
        return up - max(x, y) - math.log1p(math.exp(-abs(x - y)))

    forward, z = [], None
    for u in odds:
        z = u if z is None else u + passed(z, t01, t10)
        forward.append(z)
    out, b = [0.0] * len(odds), 0.0
    for t in range(len(odds) - 1, -1, -1):
        m = forward[t] + b
        out[t] = 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, m))))
        b = passed(odds[t] + b, t10, t01)
    return out


@dataclass
class LineModel:
    """Scaling and weights of a line's numbers, scores of label pairs, and the document's logistic."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_probabilities(self, text: str | None) -> tuple[list[float], np.ndarray]:
        own, lengths = line_features(text)
        x = (with_neighbours(own) - self.centre) / self.scale
        return marginals((x @ self.weights).tolist(), self.pairs), lengths

    def raw(self, text: str | None) -> float:
        """Mean marginal of the lines, weighted by their length, as bounded log odds."""
        good, lengths = self.line_probabilities(text)
        return _log_odds(float(np.average(good, weights=lengths + 1)))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * self.raw(text) + self.shift))))


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-4), 1.0 - 1e-4)
    return math.log(p / (1.0 - p))


def constant_model() -> LineModel:
    n = with_neighbours(line_features("")[0]).shape[1]
    return LineModel(np.zeros(n), np.ones(n), np.zeros(n), np.zeros((2, 2)), 0.0, 500.0)


def _chains(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lines in a table of documents by line number; -1 beyond a document's end."""
    lengths = np.array([len(rows) for rows in x])
    at = np.full((len(x), lengths.max()), -1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for d, n in enumerate(lengths):
        at[d, :n] = first[d] + np.arange(n)
    return at, lengths


def field_loss(
    x: list[np.ndarray], y: np.ndarray, doc: np.ndarray | None = None, penalty: float = 1e-3
) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Penalised negative log likelihood of chains of lines, and its gradient, classes weighted alike.

    `y` holds the label of each chain's document, `doc` its number (default: a
    chain is a document). All lines of a document carry its label. The passes
    run over all chains at once, line number by line number.
    """
    lines = np.vstack(x)
    at, lengths = _chains(x)
    of = np.repeat(np.arange(len(x)), lengths)
    doc = np.arange(len(x)) if doc is None else doc
    per_doc = np.bincount(doc, weights=lengths)[doc]
    docs_of = {label: max(len(np.unique(doc[y == label])), 1) for label in (0, 1)}
    share = np.where(y == 1, 0.5 / docs_of[1], 0.5 / docs_of[0]) / np.sqrt(per_doc)
    width = lines.shape[1]

    def loss(flat: np.ndarray):
        w, pairs = flat[:width], flat[width:].reshape(2, 2)
        u = lines @ w
        docs, most = at.shape
        ahead = np.zeros((docs, most, 2))
        back = np.zeros((docs, most, 2))
        known = at >= 0
        node = np.zeros((docs, most, 2))
        node[known, 1] = u[at[known]]
        ahead[:, 0] = node[:, 0]
        for t in range(1, most):
            on = known[:, t]
            before = ahead[on, t - 1]
            for b in (0, 1):
                ahead[on, t, b] = node[on, t, b] + np.logaddexp(before[:, 0] + pairs[0, b], before[:, 1] + pairs[1, b])
        for t in range(most - 2, -1, -1):
            on = known[:, t + 1]
            after = node[on, t + 1] + back[on, t + 1]
            for a in (0, 1):
                back[on, t, a] = np.logaddexp(pairs[a, 0] + after[:, 0], pairs[a, 1] + after[:, 1])
        last = ahead[np.arange(docs), lengths - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        good = np.exp(ahead[..., 1] + back[..., 1] - total[:, None])
        slope_pairs = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = ahead[:, :-1, a] + pairs[a, b] + node[:, 1:, b] + back[:, 1:, b] - total[:, None]
                expected = np.where(known[:, 1:], np.exp(np.minimum(joint, 0.0)), 0.0).sum(axis=1)
                slope_pairs[a, b] = share @ expected
        for label in (0, 1):
            mine = y == label
            slope_pairs[label, label] -= share[mine] @ (lengths[mine] - 1)
        line_good = np.zeros(len(lines))
        line_good[at[known]] = good[known]
        own = np.bincount(of, weights=u, minlength=docs) * y + (lengths - 1) * pairs[y, y]
        value = share @ (total - own) + penalty / 2 * (flat @ flat)
        pull = share[of] * (line_good - y[of])
        return value, np.concatenate([pull @ lines, slope_pairs.ravel()]) + penalty * flat

    return loss


def fit_field(x: list[np.ndarray], y: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label pairs of the largest penalised likelihood."""
    width = x[0].shape[1]
    found = minimise(field_loss(x, y, doc), np.zeros(width + 4), rounds=80)
    return found[:width], found[width:].reshape(2, 2)


def _fit_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    def loss(p: np.ndarray):
        m = p[0] * z + p[1]
        good = 1.0 / (1.0 + np.exp(-np.clip(m, -500, 500)))
        value = weight @ (np.logaddexp(0.0, m) - y * m) + 1e-3 * (p[0] - 1.0) ** 2
        pull = weight * (good - y)
        return value, np.array([pull @ z + 2e-3 * (p[0] - 1.0), pull.sum()])

    slope, shift = minimise(loss, np.array([1.0, 0.0]))
    return max(float(slope), 0.05), float(shift)


def chosen_runs(text: str | None, n_lines: int, most: int) -> list[tuple[int, int]]:
    """First and end line of the runs to learn from: all, or runs a hash chooses over the whole text."""
    if n_lines <= most:
        return [(0, n_lines)]
    size = min(RUN_LINES, most)
    seed = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
    starts = sorted(range(0, n_lines, size), key=lambda at: (zlib.crc32(at.to_bytes(8, "little"), seed), at))
    return [(at, min(at + size, n_lines)) for at in sorted(starts[: most // size])]


def _sample_features(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = with_neighbours(line_features(text)[0])
                runs = chosen_runs(text, len(own), most)
                x = np.vstack([own[a:b] for a, b in runs]).astype("<f4")
                rows.append((quality, [b - a for a, b in runs], x.tobytes()))
            names = ("quality", "runs", "x")
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, pa.schema(
                [("quality", pa.int32()), ("runs", pa.list_(pa.int32())), ("x", pa.binary())]
            ))

    return run


def _raw(text: Column, model: LineModel) -> Column:
    @F.arrow_udf("double")
    def line_field_raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                yield pa.array([model.raw(t) for t in batch.slice(at, SLICE_ROWS).to_pylist()], pa.float64())

    return line_field_raw(text)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text",
    quality: str = "quality", per_class: int = PER_CLASS, sample_lines: int = SAMPLE_LINES,
) -> LineModel:
    """Fit on a bounded sample of the labelled documents whose id satisfies `learn`."""
    texts = docs.select(F.col(key).alias("_of"), F.col(text).cast("string").alias("text"))
    known = (
        labels.where(learn & F.col(key).isNotNull() & F.col(quality).isin(0, 1))
        .groupBy(F.col(key).alias("_id"))
        .agg(F.min(quality).cast("int").alias("quality"), F.max(quality).alias("_most"))
        .where(F.col("quality") == F.col("_most"))
        .join(texts.select(F.col("_of").alias("_id")), "_id", "left_semi")
    )
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return constant_model()
    order = F.xxhash64("_id")
    picked = [
        known.where(F.col("quality") == label).orderBy(order, "_id").limit(per_class).select("_id", "quality")
        for label in (0, 1)
    ]
    # At most 2 * per_class ids of a few bytes: safe to broadcast.
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), F.col("_of") == F.col("_id")).select(
        "text", "quality"
    ).limit(4 * per_class)
    rows = sample.mapInArrow(_sample_features(sample_lines), "quality int, runs array<int>, x binary").collect()
    if len({r["quality"] for r in rows}) < 2:
        return constant_model()
    everything = np.vstack([np.frombuffer(r["x"], "<f4").reshape(sum(r["runs"]), -1) for r in rows]).astype(float)
    centre, scale = everything.mean(axis=0), everything.std(axis=0)
    scale[scale < 1e-6] = 1.0
    centre[-1] = 0.0
    everything = (everything - centre) / scale
    chains = np.split(everything, np.cumsum([n for r in rows for n in r["runs"]])[:-1])
    doc = np.repeat(np.arange(len(rows)), [len(r["runs"]) for r in rows])
    weights, pairs = fit_field(chains, np.array([r["quality"] for r in rows], int)[doc], doc)
    # Whole texts, as scoring reads them; a sample's row is one number here.
    model = LineModel(centre, scale, weights, pairs)
    whole = sample.select("quality", _raw(F.col("text"), model).alias("raw")).collect()
    y = np.array([r["quality"] for r in whole], int)
    raw = np.array([r["raw"] for r in whole])
    # The sample holds the classes in equal numbers; weights restore their shares among the labels.
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    slope, shift = _fit_logistic(raw, y, weight / weight.sum())
    return LineModel(centre, scale, weights, pairs, slope, shift)


def score(text: Column, model: LineModel) -> Column:
    """Probability that a document is good."""

    @F.arrow_udf("double")
    def line_field_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in handed_back(batches):
            for at in range(0, len(batch), SLICE_ROWS):
                yield pa.array([model.score(t) for t in batch.slice(at, SLICE_ROWS).to_pylist()], pa.float64())

    return line_field_score(text.cast("string"))
