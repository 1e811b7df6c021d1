"""Quality classifier learned from trusted positives and unlabelled text.

The score is a small network on features of the whole text (shares of letters, marks and repeated words; no
vocabulary). It minimises the non-negative unbiased risk of positive-unlabelled learning,

    prior * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - prior * E_pos[loss(-f)]),

with logistic loss, so that sigmoid(f) estimates the chance of being good. No negative label is ever read. The class prior
is estimated too: a first network separates positives from unlabelled text, and the prior is the
smallest ratio of the two sides' tails above a threshold, an upper bound that is met
where the top of the ranking is purely positive. Everything about unlabelled text is an aggregate over all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyback.llm.common import arrow_map, cut_lineage, document_texts, release
from tallyback.llm.text import Rolling, byte_values, chunks, texts_of, word_bounds

# Trusted positives of the fit and texts its start is found on (in expectation; drawn by a hash of the id, the same in every run).
POSITIVE_SAMPLE = 10_000
START_SAMPLE = 20_000
PASSES = 10  # steps over all texts
RATE_AFTER_START = 0.005
TAILS = 1_000  # thresholds of the class prior
HIDDEN = 12
FOLDS = 5

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "upper", "digits", "exclamation", "bars", "symbols",
    "punctuation", "commas_per_word", "stops_per_word", "not_ascii", "lines_per_word", "blank", "distinct_words", "top_word",
    "equal_neighbours", "short_words", "capital_words",
]
UNBOUNDED = [
    FEATURES.index(f)
    for f in ("word_length", "word_length_spread", "exclamation", "bars", "symbols", "punctuation", "commas_per_word", "stops_per_word", "lines_per_word")
]


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from the whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    kinds = np.zeros((8, 256))
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*", b"\"'()-:;?/", b",", b".")):
        kinds[k, list(chars)] = 1
    for row0, row1, data, bounds in chunks(texts):
        n = row1 - row0
        size = np.diff(bounds).astype(float)
        starts, ends, firsts = word_bounds(data, bounds)
        words = np.diff(firsts).astype(float)
        some, one = np.maximum(size, 1), np.maximum(words, 1)
        row = np.repeat(np.arange(n), np.diff(firsts))
        length = (ends - starts).astype(float)
        per = lambda values: np.bincount(row, values, minlength=n)

        def share(mask):
            total = np.zeros(len(data) + 1)
            np.cumsum(mask, out=total[1:])
            return total[bounds[1:]] - total[bounds[:-1]]

        marks = [share(kinds[k][data]) for k in range(8)]
        hashes = Rolling(byte_values(data)).ranges(starts, ends)
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(h)))
        top = np.zeros(n)
        np.maximum.at(top, r[at], count)
        same = np.zeros(len(row))
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        mean = per(length) / one
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        first_bytes = data[starts] if len(starts) else data[:0]
        out[row0:row1] = np.stack(
            [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per(length**2) / one - mean**2, 0)), np.log1p(longest),
             marks[0] / some, marks[1] / some, marks[2] / one, marks[3] / one, marks[4] / one, marks[5] / one, marks[6] / one,
             marks[7] / one, share(data >= 128) / some, share(data == 10) / one, share(data <= 32) / some,
             np.bincount(r[at], minlength=n) / one, top / one, per(same) / one, per(length <= 3) / one,
             per(kinds[0][first_bytes]) / one],
            axis=1,
        )
    out[:, UNBOUNDED] = np.log1p(out[:, UNBOUNDED])  # one text of a single long word must not set the scale
    return out


@dataclass
class Network:
    """One hidden layer on standardised features; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float = 0.5

    def standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6)

    def margin(self, features: np.ndarray) -> np.ndarray:
        return self.forward(self.standard(features))[1]

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(features))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and margin of standardised rows."""
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def backward(self, x: np.ndarray, hidden: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Sums over rows of ``g`` times the gradient of the margin, one array per array of weights."""
        back = np.outer(g, self.weights[2]) * (1 - hidden * hidden)
        return [x.T @ back, back.sum(0), hidden.T @ g, np.array([g.sum()])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Moving averages of gradients and of their squares, and the steps they lead to."""

    def __init__(self, weights: list[np.ndarray], decay: float = 1e-4):
        self.moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
        self.decay, self.t = decay, 0

    def step(self, weights: list[np.ndarray], grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for w, g, m in zip(weights, grads, self.moments):
            g = g + self.decay * w
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w -= rate * (m[0] / (1 - 0.9**self.t)) / (np.sqrt(m[1] / (1 - 0.99**self.t)) + 1e-8)


def risk_step(net: Network, positive: np.ndarray, n_unl: int, loss: float, sums: list[np.ndarray], prior: float) -> tuple[float, list[np.ndarray]]:
    """Non-negative risk and the gradient to follow, from standardised positives and the sums over the unlabelled rows.

    ``loss`` sums loss(-f) and ``sums`` its gradients over ``n_unl`` unlabelled rows, wherever they are.
    Gradients of the logistic loss: of loss(f) is sigmoid(f) - 1, of loss(-f) is sigmoid(f).
    """
    hidden, f = net.forward(positive)
    negative = loss / n_unl - prior * np.logaddexp(0, f).mean()
    risk = prior * np.logaddexp(0, -f).mean() + max(0.0, negative)
    if negative >= 0:
        own, sign = np.full(len(f), -prior / len(f)), 1.0  # loss(f) - loss(-f) is -f
    else:  # the estimate fell below zero, which no risk can: step back along it instead
        own, sign = prior * sigmoid(f) / len(f), -1.0
    return risk, [o + sign * u / n_unl for o, u in zip(net.backward(positive, hidden, own), sums)]


def _fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, moments: tuple[np.ndarray, np.ndarray] | None = None,
    steps: int = 250, rate: float = 0.03,
) -> tuple[Network, Adam]:
    """Minimise the non-negative risk at ``prior`` on rows at hand; with None, simply separate positives from unlabelled rows.

    ``moments`` are mean and scale of the features, those of the given rows where None.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = moments or (both.mean(0), both.std(0) + 1e-6)
    rng = np.random.default_rng(7)
    weights = [rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    net, adam = Network(mean, scale, weights), Adam(weights)
    xp, xu = net.standard(positive), net.standard(unlabelled)
    for _ in range(steps):
        hidden, fu = net.forward(xu)
        if prior is None:
            hp, fp = net.forward(xp)
            sides = net.backward(xp, hp, (sigmoid(fp) - 1) / len(fp)), net.backward(xu, hidden, sigmoid(fu) / len(fu))
            grads = [p + u for p, u in zip(*sides)]
        else:
            grads = risk_step(net, xp, len(fu), np.logaddexp(0, fu).sum(), net.backward(xu, hidden, sigmoid(fu)), prior)[1]
        adam.step(weights, grads, rate)
    return net, adam


def tail_ratio(above_p: np.ndarray, above_u: np.ndarray, n_p: int, n_u: int) -> float:
    """Share of positives among unlabelled rows, by the smallest ratio of the two sides' tails above the same thresholds."""
    slack = np.sqrt(np.log(40) / (2 * n_p)) + np.sqrt(np.log(40) / (2 * n_u))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _thresholds(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most TAILS thresholds among the margins of positives that leave a tenth of them or more above, with the share above each."""
    p = np.sort(margins)
    usable = p[: max(1, int(0.9 * len(p)))]
    at = np.unique(usable[np.linspace(0, len(usable) - 1, min(TAILS, len(usable))).astype(int)])
    return at, 1 - np.searchsorted(p, at, side="left") / len(p)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior of rows at hand; the ranking is fitted on one half of them and its tails are read on the other."""
    net, _ = _fit(positive[::2], unlabelled[::2], None)
    p, u = net.margin(positive[1::2]), np.sort(net.margin(unlabelled[1::2]))
    if len(p) < 2 or len(u) < 2:
        return 0.5
    at, above_p = _thresholds(p)
    return tail_ratio(above_p, 1 - np.searchsorted(u, at, side="left") / len(u), len(p), len(u))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; rows in fold 0 are held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(FOLDS))


def _half():
    """0 for rows the ranking behind the class prior may be fitted on, 1 for those whose tails are counted."""
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), len(FEATURES))


def learning_features(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """A written table of the features of all texts that may be learned from: doc_id, positive (whether in ``chosen``), features."""
    marked = docs.filter("doc_id IS NOT NULL").filter(fold() != 0).join(F.broadcast(chosen), "doc_id", "left")

    def step(batch: pa.RecordBatch):
        features = text_features(texts_of(batch.column(1))).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(list(features), pa.list_(pa.float32()))], ["doc_id", "positive", "features"]
        )

    marked = marked.select("doc_id", "text", F.coalesce("positive", F.lit(False)).alias("positive"))
    return cut_lineage(arrow_map(marked, step, "doc_id long, positive boolean, features array<float>"))


def feature_moments(table: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows of ``table``, and mean and scale of their features, all from one aggregate.

    Ten digits are kept, so that the order in which parts were added doesn't show.
    """
    cells = [F.element_at("features", k + 1).cast("double") for k in range(len(FEATURES))]
    row = table.agg(F.count(F.lit(1)), *[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    mean, scale = (np.array([float(f"{v or 0:.10g}") for v in row[1 + k * len(cells) :][: len(cells)]]) for k in range(2))
    return row[0], mean, scale + 1e-6


def tail_counts(table: DataFrame, net: Network, at: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows of ``table``, and how many of them have a margin of at least each threshold of the ascending ``at``."""

    def run(batches):
        count = np.zeros(len(at) + 1, np.int64)
        for batch in batches:
            count += np.bincount(np.searchsorted(at, net.margin(_matrix(batch.column(0))), side="right"), minlength=len(at) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], ["slot", "n"])

    counted = table.select("features").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    count = np.zeros(len(at) + 1, np.int64)
    for slot, n in counted.collect():  # TAILS + 1 rows at most
        count[slot] = n
    return int(count.sum()), np.cumsum(count[::-1])[::-1][1:]


def unlabelled_sums(table: DataFrame, net: Network) -> tuple[float, list[np.ndarray]]:
    """Sums of loss(-f) and of its gradients over all rows of ``table``, each part added where its rows are."""
    sizes = [w.size for w in net.weights]

    def run(batches):
        total = np.zeros(1 + sum(sizes))
        for batch in batches:
            x = net.standard(_matrix(batch.column(0)))
            hidden, f = net.forward(x)
            parts = [np.array([np.logaddexp(0, f).sum()]), *net.backward(x, hidden, sigmoid(f))]
            total += np.concatenate([part.ravel() for part in parts])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "v"])

    summed = table.select("features").mapInArrow(run, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v"))
    total = np.zeros(1 + sum(sizes))
    for slot, v in summed.collect():  # one row per weight
        total[slot] = float(f"{v:.10g}")
    flat = np.split(total[1:], np.cumsum(sizes)[:-1])
    return total[0], [part.reshape(w.shape) for part, w in zip(flat, net.weights)]


def train(
    docs: DataFrame, labels: DataFrame, positive_sample: int = POSITIVE_SAMPLE, start_sample: int = START_SAMPLE, passes: int = PASSES
) -> Network:
    """Fit on trusted positives (``labels.quality`` = 1) and unlabelled texts (all texts, labels unseen), outside fold 0.

    Positives are drawn by a hash of the id down to ``positive_sample``. Means, scales, the tails behind the class prior and the
    unlabelled side of the risk cover every text. Only the start is found on a draw (about ``start_sample`` texts, which with
    the positives is all that reaches the driver); from there ``passes`` steps follow the risk over all texts, and
    the weights of least risk over all texts are returned.
    """
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality = 1 AND doc_id IS NOT NULL")
    trusted = trusted.filter(fold() != 0).select("doc_id").distinct()
    # At most about ``positive_sample`` ids, so this side is small by construction.
    chosen = cut_lineage(trusted.filter(draw < positive_sample / max(trusted.count(), 1)).withColumn("positive", F.lit(True)))
    table = learning_features(docs, chosen)
    n_all, mean, scale = feature_moments(table)
    few = table.withColumn("started", draw < start_sample / max(n_all, 1)).filter("positive OR started").withColumn("half", _half())
    sample = few.toPandas()
    sample["sum"] = [float(np.sum(f)) for f in sample["features"]]
    sample = sample.sort_values(["doc_id", "sum"])
    rows = np.array(sample["features"].tolist(), float).reshape(len(sample), len(FEATURES))
    is_p, is_u, half = (sample[c].to_numpy(int) for c in ("positive", "started", "half"))
    positive, unlabelled = rows[is_p == 1], rows[is_u == 1]
    if len(positive) < 4 or len(unlabelled) < 4:  # nothing to learn from: every text is as good as any other
        release(chosen, table)
        zeros = [np.zeros((len(FEATURES), HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
        return Network(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), zeros)

    prior = 0.5
    learn, judge = half == 0, (half == 1) & (is_p == 1)
    if min((learn & (is_p == 1)).sum(), (learn & (is_u == 1)).sum(), judge.sum()) >= 2:
        ranking, _ = _fit(rows[learn & (is_p == 1)], rows[learn & (is_u == 1)], None, (mean, scale))
        at, above_p = _thresholds(ranking.margin(rows[judge]))
        n_u, above_u = tail_counts(table.filter(_half() == 1), ranking, at)
        prior = tail_ratio(above_p, above_u / max(n_u, 1), int(judge.sum()), max(n_u, 1))

    net, adam = _fit(positive, unlabelled, prior, (mean, scale))
    net.prior = prior
    xp = net.standard(positive)
    best, least = None, np.inf
    for k in range(passes + 1):
        risk, grads = risk_step(net, xp, n_all, *unlabelled_sums(table, net), prior)
        if risk < least:
            best, least = [w.copy() for w in net.weights], risk
        if k < passes:
            adam.step(net.weights, grads, RATE_AFTER_START)
    release(chosen, table)
    net.weights = [np.round(w, 6) for w in best]
    return net


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score every whole text for quality: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Labels, language, source and id are never inputs of a score. Null text is scored as empty text, repeated rows
    each alike, a null id as any other (never used to learn). An empty table gives an empty result; without
    usable positives every score is 0.5. Of ``labels`` only doc_id and quality are read, of ``docs`` id and text.
    """
    texts = document_texts(docs, id_col, text_col)
    net = train(texts, labels)

    def step(batch: pa.RecordBatch):
        score = net.score(text_features(texts_of(batch.column(1))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = arrow_map(texts, step, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns as they are; null and empty texts are scored like others."""
    net = train(document_texts(docs, id_col, text_col), labels)
    at = docs.columns.index(text_col)

    def step(batch: pa.RecordBatch):
        yield batch.filter(pa.array(net.score(text_features(texts_of(batch.column(at)))) >= threshold))

    return arrow_map(docs, step, docs.schema)
