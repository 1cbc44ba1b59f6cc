"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Each passage is described by its own make-up (case, digits, marks,
word lengths, repetition), encoded by a learned layer, weighted by gated attention learnt from document labels
(softmax of w . (tanh(V h) * sigmoid(U h))), and the weighted sum is scored by a logistic layer. Every passage of
every text is read, in training and in scoring; labels, language, source and ids never enter.

The model is fitted on the driver on at most SAMPLE labelled documents, those with the smallest hash of their id, less
those of more than LONGEST passages; features of the sample are what is collected, some 90 MB at most. Weights are a few
kilobytes and go to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.store import tidied
from pactum.llm.words import BLANKS, batches, grams, mix, utf8

PASSAGE = 64
SAMPLE, LONGEST = 2000, 512
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 12, 200, 0.02, 1e-4

_CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "comma", "bang", "bar", "quote", "dash", "other", "high"]


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), np.int64)
    for name, members in {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\v\f", "line": b"\n", "stop": b".", "comma": b",;:", "bang": b"!?", "bar": b"|", "quote": b"'\"()", "dash": b"-_/"}.items():
        table[list(members)] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("high")
    return table


_TABLE = _class_table()
FEATURES = len(_CLASSES) + 10


def _repeats(keys: np.ndarray) -> np.ndarray:
    """1 where a key occurred before."""
    again = np.ones(len(keys))
    again[np.unique(keys, return_index=True)[1]] = 0
    return again


def passages(column: pa.Array):
    """Yields (first row, passages of each row, matrix of features by passage). A text without words has one passage of zeros."""
    data, offsets = utf8(column)
    for row, counts, starts, ends, hashes in batches(data, offsets, BLANKS):
        rows = len(counts)
        number = np.maximum(1, -(-counts // PASSAGE))
        first = np.concatenate([[0], np.cumsum(number)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(rows), counts)
        place = np.arange(len(starts)) - bounds[doc]
        owner = first[doc] + place // PASSAGE
        total = int(first[-1])
        out = np.zeros((total, FEATURES), np.float32)
        if len(starts):
            words = np.bincount(owner, minlength=total).astype(np.float64)
            some = np.maximum(words, 1)
            # A passage owns the bytes from its first word to the next passage's; blanks before the first word are nobody's.
            lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = starts[lead]
            high = np.concatenate([low[1:], [offsets[row + rows]]])
            high = np.minimum(high, offsets[row + 1 + doc[lead]])
            size = high - low
            span = np.repeat(owner[lead], size)
            where = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(span))
            made = np.bincount(span * len(_CLASSES) + _TABLE[data[where]], minlength=total * len(_CLASSES)).reshape(total, len(_CLASSES))
            out[:, : len(_CLASSES)] = made / np.maximum(made.sum(axis=1, keepdims=True), 1)
            length = (ends - starts).astype(np.float64)
            mean = np.bincount(owner, length, total) / some
            k = len(_CLASSES)
            tag = mix(owner.astype(np.uint64) + np.uint64(1))
            out[:, k] = np.log1p(words) / 5
            out[:, k + 1] = mean / 10
            out[:, k + 2] = np.sqrt(np.maximum(np.bincount(owner, length**2, total) / some - mean**2, 0)) / 10
            out[:, k + 3] = np.bincount(owner, _repeats(hashes ^ tag), total) / some
            own = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1 << 40))
            out[:, k + 4] = np.bincount(owner, _repeats(own), total) / some
            runs = grams(own, 4)
            out[:, k + 5] = np.bincount(owner[: len(runs)], _repeats(runs), total) / some
            initial, final = _TABLE[data[starts]], _TABLE[data[ends - 1]]
            out[:, k + 6] = np.bincount(owner, initial == _CLASSES.index("upper"), total) / some
            out[:, k + 7] = np.bincount(owner, final >= _CLASSES.index("stop"), total) / some
            out[:, k + 8] = np.bincount(owner, length == 1, total) / some
            out[:, k + 9] = np.bincount(owner, initial == _CLASSES.index("other"), total) / some
        yield row, number, out


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float

    def _forward(self, x: np.ndarray, starts: np.ndarray, number: np.ndarray):
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (v * u) @ w["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), number))
        a /= np.repeat(np.add.reduceat(a, starts), number)
        z = np.add.reduceat(a[:, None] * h, starts)
        return h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -40, 40)))

    def score(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(number), self.prior)
        return self._forward((x - self.shift) / self.scale, np.cumsum(number) - number, number)[-1]


def fit(x: np.ndarray, number: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam on the whole sample. With labels of one kind, or none, the model gives their share (none: 0.5)."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, float(y.mean()) if len(y) else 0.5)
    x = x.astype(np.float64)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - shift) / scale
    rnd = np.random.default_rng(seed)
    w = {
        "E": rnd.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": rnd.normal(0, 0.3, (HIDDEN, GATE)), "U": rnd.normal(0, 0.3, (HIDDEN, GATE)),
        "w": rnd.normal(0, 0.3, GATE), "c": rnd.normal(0, 0.3, HIDDEN), "b": np.array(np.log(y.mean() / (1 - y.mean()))),
    }
    model = Model(shift, scale, w, float(y.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    starts = np.cumsum(number) - number
    for step in range(1, EPOCHS + 1):
        h, v, u, a, z, p = model._forward(x, starts, number)
        dz = ((p - y) / len(y))[:, None] * w["c"]
        wide = np.repeat(dz, number, axis=0)
        da = (wide * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), number))
        dv, du = ds[:, None] * w["w"] * u * (1 - v * v), ds[:, None] * w["w"] * v * u * (1 - u)
        dh = (a[:, None] * wide + dv @ w["V"].T + du @ w["U"].T) * (1 - h * h)
        grad = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": z.T @ (p - y) / len(y), "b": np.mean(p - y)}
        for k in w:
            g = grad[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fits on at most `sample` labelled documents that aren't held out, of at most `longest` passages each. Null labels and ids without a document are left out."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(parts):
        for batch in parts:
            for row, number, x in passages(batch.column(2)):
                at = np.cumsum(number) - number
                for k, n in ((k, n) for k, n in enumerate(number.tolist()) if n <= longest):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[row + k : row + k + 1].cast(pa.string()), batch.column(1)[row + k : row + k + 1], pa.array([x[at[k] : at[k] + n].tobytes()], pa.binary())], names=["id", "y", "x"])

    rows = texts.join(F.broadcast(known), "id").select("id", "y", "text").mapInArrow(tidied(run), "id string, y double, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.x))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES)), np.array([len(b) for b in bags], np.int64), np.array([r.y for r in rows]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1; null and empty texts too). Repeated rows give a row each; other columns aren't read."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for batch in parts:
            for row, number, x in passages(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + len(number)], pa.array(sent.value.score(x, number).astype(np.float64))], names=["id", "score"])

    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`; one pass, no shuffle."""
    place, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for batch in parts:
            if batch.num_rows:
                keep = np.concatenate([sent.value.score(x, number) >= least for _, number, x in passages(batch.column(place))])
                out = batch.filter(pa.array(keep))
                if out.num_rows:
                    yield out

    return docs.mapInArrow(tidied(run), docs.schema)
