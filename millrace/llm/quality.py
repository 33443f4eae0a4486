"""Quality grades by ordinal regression: one weight per hashed feature of the text, one threshold between each two grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import flat, slices, word_hashes, words

WORD_SLOTS, SHAPE_SLOTS = 1 << 15, 1 << 12
SLOTS = WORD_SLOTS + SHAPE_SLOTS
#: Features are shares of a text's words, times this.
SCALE = 30.0

_CLASS = np.arange(256, dtype=np.uint64)  # marks stand for themselves
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two feature slots for each word, by what it is and by how it is written, and where each text's words begin."""
    starts, ends, text = words(data, offsets)
    word = (word_hashes(data, starts, ends) % np.uint64(WORD_SLOTS)).astype(np.int64)
    c = _CLASS[data]
    second, before = np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts)
    shape = c[starts]
    for more in (c[second] if len(starts) else shape, c[before], c[ends - 1], np.minimum(ends - starts, 12).astype(np.uint64)):
        shape = shape * np.uint64(0x9E3779B97F4A7C15) + more
        shape ^= shape >> np.uint64(31)
    slots = np.stack([word, WORD_SLOTS + (shape % np.uint64(SHAPE_SLOTS)).astype(np.int64)])
    return slots, np.searchsorted(text, np.arange(len(offsets)))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = 1 / (1 + exp(thresholds[k - 1] - weights . features)), thresholds in rising order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of words of each text of a slice."""
        slots, bounds = features(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.weights[slots].sum(axis=0))])
        n = np.diff(bounds)
        return SCALE * (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1), n


def _examples(batches):
    for batch in batches:
        for rows in slices(batch, "text"):
            slots, bounds = features(*flat(rows.column("text")))
            ids, values = [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                own, n = np.unique(slots[:, low:high], return_counts=True)
                ids.append(own.astype("<u4").tobytes())
                values.append((SCALE * n / max(high - low, 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows.column("grade").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["grade", "slots", "shares"]
            )


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8192, steps: int = 200) -> OrdinalModel:
    """Fit on at most ``max_rows`` rated rows: those whose hashed id is smallest.

    ``ratings`` holds the id and ``grade`` (0, 1, 2 ...; null is no rating; of several for an id the lowest counts).
    Without any rated text every weight is 0.
    """
    rated = ratings.where("grade is not null").groupBy(id_col).agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64(F.col(id_col).cast("long")), id_col).limit(max_rows)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), id_col)  # max_rows rows at most
    table = rows.select("text", "grade").mapInArrow(_examples, "grade long, slots binary, shares binary").toArrow()
    grade = table.column("grade").to_numpy()
    top = int(grade.max()) if len(grade) else 1
    if len(grade) == 0 or top < 1:
        return OrdinalModel(np.zeros(SLOTS), np.zeros(max(top, 1)))
    slots = [np.frombuffer(b, "<u4") for b in table.column("slots").to_pylist()]
    shares = [np.frombuffer(b, "<f4") for b in table.column("shares").to_pylist()]
    order = np.lexsort((np.array([s.sum() for s in shares]), [int(s.sum()) for s in slots], grade))  # whatever order rows came in
    row = np.repeat(np.arange(len(order)), [len(slots[k]) for k in order])
    return _fit(grade[order], row, np.concatenate([slots[k] for k in order]).astype(np.int64), np.concatenate([shares[k] for k in order]), top, steps)


def _fit(grade: np.ndarray, row: np.ndarray, slot: np.ndarray, share: np.ndarray, top: int, steps: int) -> OrdinalModel:
    """Likeliest weights and thresholds, by Adam on all rows at once."""
    n = len(grade)
    share_of = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share_of / (1 - share_of))
    value = np.concatenate([np.zeros(SLOTS), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(value), np.zeros_like(value)
    every = np.arange(n)
    for step in range(1, steps + 1):
        weights = value[:SLOTS]
        gaps = np.exp(value[SLOTS + 1 :])
        limits = np.concatenate([[-np.inf], value[SLOTS] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(row, weights[slot] * share, n)
        z = np.clip(score[:, None] - limits[None, :], -40, 40)
        tail = 1 / (1 + np.exp(-z))
        tail[:, 0], tail[:, -1] = 1, 0
        slope = tail * (1 - tail)
        p = np.maximum(tail[every, grade] - tail[every, grade + 1], 1e-9)
        by_score = (slope[every, grade] - slope[every, grade + 1]) / p
        by_limit = np.zeros(top + 2)
        np.add.at(by_limit, grade, -slope[every, grade] / p)
        np.add.at(by_limit, grade + 1, slope[every, grade + 1] / p)
        inner = by_limit[1:-1]
        steps_of_gaps = np.array([inner[k:].sum() for k in range(1, top)]) * gaps
        gradient = np.concatenate([np.bincount(slot, by_score[row] * share, SLOTS), [inner.sum()], steps_of_gaps]) / n
        gradient[:SLOTS] -= 1e-4 * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = 0.1 * (1 - 0.9 * step / steps)
        value = value + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(value[SLOTS + 1 :])
    return OrdinalModel(value[:SLOTS].copy(), value[SLOTS] + np.concatenate([[0], np.cumsum(gaps)]))


def graded(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_grade: int = 1, least: float = 0.5, out: str = "quality"
) -> DataFrame:
    """Expected grade and tail probabilities of each row of ``docs``, from its whole text.

    Returns the columns of ``docs`` and a struct ``out`` (in place of a column of that name): ``expected`` grade, ``tails`` (P(grade >= 1),
    P(grade >= 2), ...), ``keep`` (P(grade >= ``keep_grade``) is at least ``least``). Null texts and texts without words
    show nothing to grade: expected 0, tails 0, not kept.
    """
    top = len(model.thresholds)

    def run(batches):
        for batch in batches:
            for rows in slices(batch, text_col):
                score, n = model.scores(*flat(rows.column(text_col)))
                tails = np.where(n[:, None] > 0, model.tails(score), 0.0)
                quality = pa.StructArray.from_arrays(
                    [
                        pa.array(tails.sum(axis=1)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, top * len(n) + 1, top), pa.int32()), pa.array(tails.ravel())),
                        pa.array(tails[:, keep_grade - 1] >= least),
                    ],
                    names=["expected", "tails", "keep"],
                )
                names = list(rows.schema.names)
                place = names.index(out) if out in names else len(names)
                columns = [*rows.columns[:place], quality, *rows.columns[place + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, names=names if place < len(names) else [*names, out])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fields[out] = "struct<expected:double,tails:array<double>,keep:boolean>"
    return docs.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in fields.items()))
