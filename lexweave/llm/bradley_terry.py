"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Each training pair is a better and a worse document; the chance that the better wins is the logistic of the difference
of their scores, a linear function of text features, so learning is logistic loss on feature differences. The
threshold is a quantile of the training scores: the share of worse documents among them. The reported score is the
logistic of the distance to that threshold, so 0.5 is the threshold.

The fit takes every pair of a better and a worse labelled row, and the threshold every training score. Pairs are not
listed: the loss of a pair depends only on the difference of two scores and is analytic in it, so sums over all pairs
follow, to rounding, from Chebyshev moments of each class in boxes of the score. Moments add up over rows, so each Newton
step is one pass over the features of the labelled rows, which are written once; the driver holds moments only. Every
text is scored whole, in one Arrow pass without a shuffle.

Defined results: null and empty texts have all features at zero and a score like any other; a null id is never
held out and never trains; labels other than 0 and 1 are ignored; labelled ids that repeat in the documents train
once; without both classes every score is 0.5; an empty table gives an empty table; only the id is carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, _shuffles_dropped, as_bytes
from .quality_rules import STOP_WORDS, SYMBOLS

CHUNK = 1 << 15  # rows of a task in the fit
NAMES = ("length", "word_bytes", "symbols", "upper", "digits", "marks", "shouts", "stops", "repeats", "windows", "lines", "line_words")

# A box of scores this wide and this many polynomials leave an error below 1e-16 of the sum: the nearest pole is pi away.
_WIDE, _TERMS = 2.0, 22
_PLACES = np.cos(np.pi * (np.arange(_TERMS) + 0.5) / _TERMS)
_AT = chebvander(_PLACES, _TERMS - 1) * np.where(np.arange(_TERMS), 2, 1) / _TERMS
_ROW, _COL = np.triu_indices(len(NAMES) + 1)

Model = dict[str, np.ndarray | float]
Moments = dict[int, np.ndarray]

_SYMBOLS, _MARKS = SYMBOLS.encode(), b"!?.,;:"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_STOPS = frozenset(f.encode() for w in STOP_WORDS for f in (w, w.capitalize()))


def features(text: bytes) -> list[float]:
    """Feature vector of a whole text, in the order of NAMES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    inside = sum(map(len, words))
    share = lambda some: (len(text) - len(text.translate(None, some))) / inside
    lines = [x for x in text.split(b"\n") if x]
    windows = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 1.0
    return [
        np.log1p(n),
        inside / n,
        share(_SYMBOLS),
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        text.count(b"!!") / n,
        sum(map(_STOPS.__contains__, words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1.0 - windows,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0,
        min(n / max(len(lines), 1), 200.0) / 200.0,
    ]


def _model() -> Model:
    width = len(NAMES)
    return {"mean": np.zeros(width), "scale": np.ones(width), "weights": np.zeros(width), "threshold": 0.0, "spread": 1.0}


def _moments(x: np.ndarray, model: Model) -> Moments:
    """By box of the score: sums of the products of (1, features) with itself, times each polynomial of the place in the box."""
    z = np.concatenate((np.ones((len(x), 1)), (x - model["mean"]) / model["scale"]), axis=1)
    at = z[:, 1:] @ model["weights"] / _WIDE
    box = np.floor(at)
    order = np.argsort(box, kind="stable")
    found = {}
    for rows in np.split(order, np.flatnonzero(np.diff(box[order])) + 1) if len(x) else ():
        basis = chebvander(2 * (at[rows] - box[rows]) - 1, _TERMS - 1)
        found[int(box[rows[0]])] = basis.T @ (z[rows][:, _ROW] * z[rows][:, _COL])
    return found


def _square(sums: np.ndarray) -> np.ndarray:
    full = np.zeros((len(sums), len(NAMES) + 1, len(NAMES) + 1))
    full[:, _ROW, _COL] = full[:, _COL, _ROW] = sums
    return full


def _total(moments: Moments) -> np.ndarray:
    """Sum of the products over all rows of a class."""
    return sum((_square(m[:1])[0] for _, m in sorted(moments.items())), np.zeros((len(NAMES) + 1,) * 2))


def _nodes(moments: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Scores that stand for a class in any smooth sum, and the products that each of them carries."""
    boxes = sorted(moments)
    scores = np.concatenate([(b + (_PLACES + 1) / 2) * _WIDE for b in boxes])
    return scores, _square(np.concatenate([_AT @ moments[b] for b in boxes]))


def _loss(better: Moments, worse: Moments, weights: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean of log(1 + exp(-difference)) over all pairs + ridge |w|^2 / 2, with its gradient and second derivatives."""
    (s, a), (t, b) = _nodes(better), _nodes(worse)
    width = len(weights)
    loss, gradient, curve = 0.0, np.zeros(width), np.zeros((width, width))
    for i in range(0, len(s), _TERMS):  # a box of the better against all of the worse
        of, d = a[i : i + _TERMS], s[i : i + _TERMS, None] - t
        under, over = np.logaddexp(0, -d), np.logaddexp(0, d)
        lost, bend = np.exp(-over), np.exp(-over - under)
        loss += of[:, 0, 0] @ under @ b[:, 0, 0]
        gradient -= (lost @ b[:, 0, 0]) @ of[:, 0, 1:] - (of[:, 0, 0] @ lost) @ b[:, 0, 1:]
        cross = of[:, 0, 1:].T @ bend @ b[:, 0, 1:]
        curve += np.tensordot(bend @ b[:, 0, 0], of[:, 1:, 1:], 1) + np.tensordot(of[:, 0, 0] @ bend, b[:, 1:, 1:], 1) - cross - cross.T
    n = _total(better)[0, 0] * _total(worse)[0, 0]
    return loss / n + ridge * float(weights @ weights) / 2, gradient / n + ridge * weights, curve / n + ridge * np.eye(width)


def _descend(gather: Callable[[Model], tuple[Moments, Moments]], ridge: float, steps: int) -> tuple[Model, int]:
    """Model without its threshold, and the number of worse rows; ``gather`` gives the moments of better and worse rows."""
    model = _model()
    sums = [_total(m) for m in gather(model)]
    if not all(m[0, 0] for m in sums):
        return model, 0
    n = sums[0][0, 0] + sums[1][0, 0]
    model["mean"] = (sums[0] + sums[1])[0, 1:] / n
    scale = np.sqrt(np.diagonal(sum(map(_total, gather(model))))[1:] / n)
    model["scale"] = np.where(scale < 1e-9, 1.0, scale)
    step, least = np.zeros(len(NAMES)), np.inf
    for _ in range(steps):  # Newton steps, halved where the loss would rise
        tried = model["weights"] - step
        better, worse = gather({**model, "weights": tried})
        loss, gradient, curve = _loss(better, worse, tried, ridge)
        if loss > least + 1e-12:
            step = step / 2
            continue
        model["weights"], least, step = tried, loss, np.linalg.solve(curve, gradient)
        if np.abs(step).max() < 1e-8:
            break
    products = (_total(better) + _total(worse))[1:, 1:] / n
    model["spread"] = max(float(np.sqrt(max(model["weights"] @ products @ model["weights"], 0.0))) / 4, 1e-9)
    return model, int(sums[1][0, 0])


def _scores(x: np.ndarray, model: Model) -> np.ndarray:
    return (x - model["mean"]) / model["scale"] @ model["weights"]


def fit(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> Model:
    """Weights, standardisation and threshold from the features of better and worse documents."""
    model, low = _descend(lambda m: (_moments(better, m), _moments(worse, m)), ridge, steps)
    if low:  # as many training scores lie below the threshold as there are worse documents
        model["threshold"] = float(np.sort(_scores(np.concatenate((better, worse)), model))[low - 1 : low + 1].mean())
    return model


def held_out(id_col: Column) -> Column:
    """The fold that never trains."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of a partition's rows, in their order, as one row a class."""
    parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for batch in batches:
        label, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
        for y, held in parts.items():
            held.append(x[label == y])
    for y, held in parts.items():
        if sum(map(len, held)):
            packed = np.concatenate(held).tobytes()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([TaskContext.get().partitionId()], pa.int32()), "label": pa.array([y], pa.int32()), "x": pa.array([packed], pa.binary())})


def _gathered(chunks: DataFrame, model: Model) -> tuple[Moments, Moments]:
    """Moments of better and worse rows, added up in the order of the chunks."""
    schema = pa.schema([("chunk", pa.int32()), ("label", pa.int32()), ("box", pa.int64()), ("sums", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [{**r, "box": b, "sums": m.tobytes()} for b, m in _moments(np.frombuffer(r["x"]).reshape(-1, len(NAMES)), model).items()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        total = sum(np.frombuffer(m) for m in rows["sums"].to_pylist())
        return pa.table([rows["label"][:1], rows["box"][:1], pa.array([total.tobytes()], pa.binary())], ["label", "box", "sums"])

    with _shuffles_dropped(chunks.sparkSession):
        sums = chunks.mapInArrow(each, "chunk int, label int, box long, sums binary").groupBy("label", "box")
        found = sums.applyInArrow(added, "label int, box long, sums binary").collect()
    by: tuple[Moments, Moments] = ({}, {})
    for r in found:
        by[1 - r["label"]][r["box"]] = np.frombuffer(r["sums"]).reshape(_TERMS, -1)
    return by


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _middle(chunks: DataFrame, model: Model, low: int) -> float:
    """Midway between the ``low``-th smallest training score and the next one, found 16 bits a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                scores = _scores(np.frombuffer(x).reshape(-1, len(NAMES)), model)
                yield pa.RecordBatch.from_arrays([pa.array(_ordered(scores.view(np.int64)))], ["key"])

    keys = chunks.select("x").mapInArrow(run, "key long")
    some, left = keys, low - 1
    with _shuffles_dropped(chunks.sparkSession):
        for bits in (48, 32, 16, 0):
            digit = F.shiftright("key", bits)
            for at, n in sorted(map(tuple, some.groupBy(digit.alias("digit")).count().collect())):
                if left < n:
                    break
                left -= n
            some = keys.where(digit == at)
        after = at if left + 1 < n else keys.where(F.col("key") > at).agg(F.min("key")).first()[0]
    return float(_ordered(np.array([at, after])).view(np.float64).mean())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chunk: int = CHUNK, ridge: float = 1e-3, steps: int = 30) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)").where(~held_out(F.col("id"))).distinct()
    parts = max(1, -(-known.count() // chunk))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    own = own.where("id is not null").where(~held_out(F.col("id"))).mapInArrow(_features, "id long, x array<double>")  # before the join, which may move its rows
    rows = own.join(known, "id").groupBy("id", "label").agg(F.min("x").alias("x"))
    rows = rows.repartition(parts, "id").sortWithinPartitions("id", "label").select("label", "x")
    scratch = Scratch(docs.sparkSession, "preferences")
    chunks = scratch.table(rows.mapInArrow(_packed, "chunk int, label int, x binary"), "chunks")
    model, low = _descend(lambda m: _gathered(chunks, m), ridge, steps)
    if low:
        model["threshold"] = _middle(chunks, model, low)
    scratch.drop("chunks")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    weights = np.asarray(model["weights"]) / model["scale"]
    base = float(np.asarray(model["mean"]) @ weights + model["threshold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(1))], float).reshape(-1, len(NAMES))
            scores = 1 / (1 + np.exp(-np.clip((x @ weights - base) / model["spread"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
