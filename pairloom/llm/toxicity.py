"""Toxicity scores from a character n-gram linear classifier with naive Bayes log-count ratio features.

A text is lower-cased, its white space counts as spaces, and a space is set at either end. Its features are the distinct
runs of 3, 4 and 5 code points, hashed to ``DIMS`` numbers. With p and q the numbers of toxic and other training texts that
hold a feature, smoothed and divided by their sums, r = log(p / q) is the feature's scale. Features whose log-likelihood
ratio statistic says that they depend on the label (at most ``FEATURES``) enter a logistic regression on presence * r; a
text's score is its probability.

Training reads at most ``SAMPLE`` labelled texts, the ones of lowest hash of their id, so that the driver's part is bounded
at any input size. Scoring reads every text whole, in blocks. Blocks and portions of batches are small: a worker's memory
comes on top of an executor's heap, which a long session fills.

Defined results: a null or empty text is scored as one without features, by the model's intercept; a null label or id is
not learnt from; of several labels of an id the highest counts; without any training text every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, portions, returning

ORDERS, DIM_BITS = (3, 4, 5), 20
DIMS, SAMPLE, FEATURES, LEAST_G = 1 << DIM_BITS, 24_000, 16_384, 20.0
BLOCK, HELD, RANGES, SLICE = 1 << 17, 1 << 19, 16, 500_000
_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**63, (max(ORDERS) + 1, max(ORDERS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _pieces(texts):
    """Code points of texts in blocks, long texts in overlapping parts, with each part's text and bounds."""
    overlap, waiting, size = max(ORDERS) - 1, [], 0
    for i, text in enumerate(texts):
        text = f" {(text or '').lower()} "
        for at in range(0, max(1, len(text) - overlap), BLOCK):
            part = text[at : at + BLOCK + overlap]
            waiting.append((i, part))
            size += len(part)
            if size >= BLOCK:
                yield _joined(waiting)
                waiting, size = [], 0
    if waiting:
        yield _joined(waiting)


def _joined(waiting):
    points = np.frombuffer("".join(x for _, x in waiting).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points >= 9) & (points <= 13)] = 32
    ends = np.cumsum([len(x) for _, x in waiting])
    return points, ends, np.array([i for i, _ in waiting], np.int64)


def hits(texts, table: np.ndarray):
    """Distinct (text, number) of the features with table[feature] >= 0, table giving their numbers."""
    found, held, most = [np.empty(0, np.int64)], 0, HELD
    for points, ends, owner in _pieces(texts):
        for n in ORDERS:
            if len(points) < n:
                continue
            h = np.zeros(len(points) - n + 1, np.uint64)
            for j in range(n):
                h += points[j : len(points) - n + 1 + j] * _MULTIPLIERS[n, j]
            h ^= h >> np.uint64(32)
            h *= _MULTIPLIERS[0, 0]
            number = table[(h >> np.uint64(64 - DIM_BITS)).astype(np.int64)]
            at = np.flatnonzero(number >= 0)
            part = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[part]
            found.append(np.unique(owner[part[inside]] << np.int64(32) | number[at[inside]].astype(np.int64)))
            held += len(found[-1])
        if held > most:  # the parts of a long text hold the same features again and again
            found = [np.unique(np.concatenate(found))]
            held, most = len(found[0]), 2 * len(found[0]) + HELD
    code = np.unique(np.concatenate(found))
    return np.stack([code >> np.int64(32), code & np.int64(0xFFFFFFFF)], 1)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By label how many texts hold each feature (2 x DIMS), and how many texts there are. Counters are summed on the
    executors, a range of features at a time."""
    width = 2 * DIMS // RANGES

    def count(batches):
        import pyarrow as pa

        own, every, some = np.zeros((RANGES, width), np.uint32), np.arange(DIMS, dtype=np.int32), False
        for batch in portions(batches, "text"):
            label = np.array(batch.column("label").to_pylist(), np.int64)
            pairs = hits(batch.column("text").to_pylist(), every)
            np.add.at(own.reshape(-1), pairs[:, 1] * 2 + label[pairs[:, 0]], 1)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in own], pa.binary())], ["part", "counts"])

    def add(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(pa.decompress(counts.as_py(), width * 4, "zstd"), np.uint32)
                sums[part] = sums.get(part, 0) + got
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary())], ["part", "counts"])

    import pyarrow as pa

    kind = "part int, counts binary"
    out = np.zeros((RANGES, width), np.uint32)
    for row in sample.select("text", "label").mapInArrow(returning(count), kind).repartition("part").mapInArrow(returning(add), kind).collect():
        out[row.part] = np.frombuffer(pa.decompress(row.counts, width * 4, "zstd"), np.uint32)
    texts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    return out.reshape(DIMS, 2).T, np.array([texts.get(0, 0), texts.get(1, 0)])


def _select(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The features that depend on the label by the log-likelihood ratio, the strongest first."""
    held = np.flatnonzero(counts.sum(0) > 0)
    q, p = counts[:, held].astype(float)
    total = texts.sum()

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    row, g = p + q, np.zeros(len(held))
    for seen, label in ((q, 0), (p, 1)):
        g += part(seen, row * texts[label] / total) + part(texts[label] - seen, (total - row) * texts[label] / total)
    best = np.argsort(-g, kind="stable")[:FEATURES]
    return held[best[2 * g[best] > LEAST_G]]


def _fit(cols: np.ndarray, lengths: np.ndarray, values: np.ndarray, y: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; cols holds the rows' features one after another, and values[f] is what
    feature f is worth where it is present. Rows are gone through a slice at a time, so that little is held at once."""
    w, b = np.zeros(len(values)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    upto = np.concatenate(([0], np.cumsum(lengths)))
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1], SLICE)), len(y)))
    slices = []
    for i, j in zip(cuts, cuts[1:]):
        some = np.flatnonzero(lengths[i:j])  # the sum over a row's features is asked for where it has any
        slices.append((i, j, some, upto[i:j][some] - upto[i], cols[upto[i] : upto[j]]))
    for t in range(1, steps + 1):
        grad, scaled = np.zeros(len(w) + 1), w * values
        for i, j, some, starts, own in slices:
            z = np.full(j - i, b)
            if len(some):
                z[some] += np.add.reduceat(scaled[own], starts)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[i:j]) / len(y)
            grad[:-1] += np.bincount(own, np.repeat(error, lengths[i:j]), len(w))
            grad[-1] += error.sum()
        grad[:-1] = grad[:-1] * values + penalty * w / len(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def table(self) -> np.ndarray:
        out = np.full(DIMS, -1, np.int32)
        out[self.features] = np.arange(len(self.features))
        return out


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model of labels (doc_id, label) joined to docs; usable: a condition on doc_id for rows that may be learnt from."""
    spark = docs.sparkSession
    space = Workspace(spark, "toxicity")
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if usable is not None:
        marked = marked.where(usable)
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    # At most ``sample`` rows of an id and a label: a bounded broadcast.
    chosen = space.save(texts.join(F.broadcast(marked), F.col("doc") == F.col("id")).select("text", "label"))
    counts, n = _counts(chosen)
    if not n.all():
        bias = 0.0 if not n.any() else float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
        return Model(np.empty(0, np.int64), np.empty(0), bias)
    features = _select(counts, n)
    q, p = counts[:, features] + 1.0
    ratio = np.log((p / (counts[1].sum() + DIMS)) / (q / (counts[0].sum() + DIMS)))
    ratio /= max(1e-9, np.abs(ratio).max(initial=1e-9))
    model = Model(features, np.zeros(len(features)), 0.0)
    table = spark.sparkContext.broadcast(model.table())

    def present(batches):
        import pyarrow as pa

        for batch in portions(batches, "text"):
            pairs = hits(batch.column("text").to_pylist(), table.value)
            cuts = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
            packed = [pairs[a:b, 1].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], ["label", "features"])

    rows = chosen.select("text", "label").mapInArrow(returning(present), "label int, features binary").collect()
    rows.sort(key=lambda r: (r.label, r.features))  # whatever order they came in, the fit is the same
    lengths = np.array([len(r.features) // 2 for r in rows])
    y = np.array([float(r.label) for r in rows])
    cols = np.frombuffer(b"".join(r.features for r in rows), np.uint16)
    del rows
    w, b = _fit(cols, lengths, ratio, y)
    return Model(features, w * ratio, b)


def score(docs: DataFrame, model: Model, *, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with ``score`` (double, 0 to 1), which replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), model.weights, model.bias))
    kept = [c for c in docs.columns if c != "score" and not (drop_text and c == text)]
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", T.DoubleType())

    def run(batches):
        import pyarrow as pa

        table, weights, bias = shared.value
        for batch in portions(batches, text):
            pairs = hits(batch.column(text).to_pylist(), table)
            z = np.bincount(pairs[:, 0], weights[pairs[:, 1]], batch.num_rows) + bias
            out = pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], out], [*kept, "score"])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(returning(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids kept from training: crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
