"""Language identification: averaged hashed subword embeddings and a linear softmax, with rejection.

A text is its byte n-grams of lengths two to four in ASCII lower case, where every ASCII character that is
no letter is a space and n-grams with two spaces in a row do not count, so n-grams know word borders. Each
hashes to one of 2**BUCKET_BITS embeddings; their mean goes into a softmax over the learned languages.
Embeddings and weights are trained by stochastic gradient descent in numpy on a bounded sample: the
PER_LANGUAGE ids of lowest hash of each language, one row each. A fifth of it calibrates: a temperature makes the
score the probability of being right, and a row whose score is under MIN_SCORE is rejected. Texts of few
n-grams have their logits shrunk.

For prediction, embedding times weights is one short vector per bucket, so a text costs one look-up per
n-gram and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .rawtext import crc_fold, mix, slices, text_buffer

BUCKET_BITS = 16
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
PER_LANGUAGE = 500
EPOCHS = 20
#: Up to so many labels their bounds and the ids chosen are sent to the tasks; more are joined.
MAX_SENT_LABELS = 1000
MIN_SCORE = 0.4
#: A text of so many n-grams counts with half its logits: few n-grams are little evidence.
SHRINK = 10
UNKNOWN = "und"
_SLICE = 500_000

_PLAIN = np.full(256, ord(" "), np.uint8)
for _byte in range(ord("a"), ord("z") + 1):
    _PLAIN[_byte] = _PLAIN[_byte - 32] = _byte
_PLAIN[0x80:] = np.arange(0x80, 256)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row) of the n-grams; each row stands between two spaces."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    text = np.full(len(data) + n + 1, ord(" "), np.uint8)
    row = np.repeat(np.arange(n), lengths)
    text[np.arange(len(data)) + row + 1] = _PLAIN[data]
    row = np.repeat(np.arange(n), lengths + 1)
    space = text == ord(" ")
    double = np.concatenate([[0], np.cumsum(space[:-1] & space[1:])])
    buckets, rows = [], []
    wide = text.astype(np.uint64)
    key = wide
    for length in range(2, LENGTHS[-1] + 1):
        # an n-gram may start at the space before its row and end at the one after it
        key = (key[:-1] << np.uint64(8)) | wide[length - 1:]
        start = np.arange(len(key))
        good = double[start + length - 1] == double[start]
        # all but its last character are its row's: that one may be the space before the next row
        good &= row[start] == row[start + length - 2]
        buckets.append((mix(key[good] + np.uint64(length << 40)) >> np.uint64(64 - BUCKET_BITS)).view(np.int64))
        rows.append(row[start[good]])
    return np.concatenate(buckets), np.concatenate(rows)


def has_letter(text: bytes) -> bool:
    """Whether there is a letter of any script."""
    return text.lower() != text.upper() or any(c.isalpha() for c in text.decode())


class Classifier:
    """One vector of language logits per bucket, with the temperature of the scores."""

    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray):
        self.languages, self.logits, self.bias = languages, logits, bias
        self.temperature = 1.0

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logits, (rows, languages)."""
        buckets, rows = subwords(data, offsets)
        n = len(offsets) - 1
        counts = np.bincount(rows, minlength=n) + SHRINK
        sums = [np.bincount(rows, self.logits[buckets, k], n) for k in range(len(self.languages))]
        return np.stack(sums, axis=1) / counts[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, probability)."""
        p = softmax(self.raw(data, offsets) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 8) -> Classifier:
    """SGD over rows of (buckets, shares); a row's hidden vector is the mean of its embeddings."""
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(2.0 * (1 - epoch / EPOCHS) + 0.05)
        for i in rng.permutation(len(labels)):
            buckets, shares = features[i]
            if not len(buckets):
                continue
            hidden = shares @ embedding[buckets]
            error = softmax((hidden @ weights + bias)[None])[0].astype(np.float32)
            error[labels[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= np.float32(0.01) * rate * error
            embedding[buckets] -= rate * shares[:, None] * back
    return Classifier(languages, (embedding @ weights).astype(np.float32), bias)


def calibrate(model: Classifier, raw: np.ndarray, labels: np.ndarray) -> Classifier:
    """Sets the temperature of least log loss on rows that were not trained on."""
    if len(labels):
        grid = np.geomspace(0.05, 20, 61)
        # a share of the rows counts as wrong though none is, or the scores would all be 1
        wrong = 1 / (len(labels) + 2)
        logs = [np.log(softmax(raw / t) + 1e-12) for t in grid]
        own = [x[np.arange(len(labels)), labels] for x in logs]
        rest = max(raw.shape[1] - 1, 1)
        losses = [-((1 - wrong) * y + wrong * (x.sum(axis=1) - y) / rest).mean() for x, y in zip(logs, own)]
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5,
        per_language: int = PER_LANGUAGE) -> Classifier | None:
    """A classifier from the rows outside fold 0 whose label is not null; None where there are none.

    The sample is ``per_language`` ids of each label at most, whole texts, and of an id that has many rows
    under a label the one of lowest text hash; only bucket counts reach the driver, one row per id chosen. Rows
    without id are not learned from.
    """
    rows = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).alias("label")
    ).filter((crc_fold(F.col("id"), folds) != 0) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # the lowest hashes of a label are under a bound that lets some four times as many ids through, so that
    # few rows of a frequent label meet in the window; ids are counted, as rows of one id share its hash
    bits = 40
    named = rows.select("id", "label", F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("rank_hash"))
    share = named.groupBy("label").agg((F.lit(4.0 * per_language) / F.approx_count_distinct("id")).alias("share"))
    sent = share.limit(MAX_SENT_LABELS + 1).collect()
    few = len(sent) <= MAX_SENT_LABELS
    if few:
        share = df.sparkSession.createDataFrame(sent, share.schema)
    hint = F.broadcast if few else (lambda x: x)
    near = rows.select("id", "label", F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("rank_hash"), F.xxhash64("text").alias("text_hash"))
    near = near.join(hint(share), "label").filter(F.col("rank_hash") < F.col("share") * float(1 << bits))
    order = Window.partitionBy("label").orderBy("rank_hash", "id")
    chosen = near.groupBy("label", "id", "rank_hash").agg(F.min("text_hash").alias("text_hash")).withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= per_language).drop("rank_hash")
    sample = rows.withColumn("text_hash", F.xxhash64("text")).join(hint(chosen), ["id", "label", "text_hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(batches, "text", _SLICE):
            # a task counts an id that repeats once; its rows here have one text
            known = list(zip(part.column("label").to_pylist(), part.column("rank").to_pylist()))
            new = [not (key in seen or seen.add(key)) for key in known]
            part = part.filter(pa.array(new, pa.bool_()))
            buckets, row = subwords(*text_buffer(part.column("text")))
            key, n = np.unique((row << BUCKET_BITS) | buckets, return_counts=True)
            cuts = np.searchsorted(key >> BUCKET_BITS, np.arange(part.num_rows + 1)).astype(np.int64)
            own = (key & ((1 << BUCKET_BITS) - 1)).astype("<i4")
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("rank"), part.column("id"), cut(own), cut(n.astype("<f4"))],
                ["label", "rank", "id", "buckets", "n"],
            )

    found = sample.select("label", "rank", "id", "text").mapInArrow(
        count, "label string, rank int, id string, buckets binary, n binary"
    ).dropDuplicates(["label", "rank"]).orderBy("label", "rank").collect()
    if not found:
        return None
    languages = sorted({r.label for r in found})
    labels = np.array([languages.index(r.label) for r in found])
    features, sizes = [], []
    for r in found:
        n = np.frombuffer(r.n, "<f4")
        sizes.append(float(n.sum()))
        features.append((np.frombuffer(r.buckets, "<i4"), n / np.float32(max(float(n.sum()), 1.0))))
    held = np.array([r.rank % 5 == 0 for r in found])
    model = train([f for f, h in zip(features, held) if not h] or features, labels[~held] if (~held).any() else labels, languages)
    weight = [s / (s + SHRINK) for s in sizes]
    raw = [w * (shares @ model.logits[buckets]) + model.bias for (buckets, shares), w, h in zip(features, weight, held) if h]
    return calibrate(model, np.array(raw).reshape(-1, len(languages)), labels[held])


def _judge(texts: pa.Array, model: Classifier | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, whether it is rejected) of each text."""
    data, offsets = text_buffer(texts)
    raw = data.tobytes()
    known = np.array([has_letter(raw[a:b]) for a, b in zip(offsets, offsets[1:])], bool)
    names, best, score = [UNKNOWN], np.zeros(len(known), int), np.zeros(len(known))
    if model is None:
        known[:] = False
    else:
        best, score = model.predict(data, offsets)
        names = model.languages
    score = np.where(known, score, 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best, known)], score, ~known | (score < MIN_SCORE)


def predict(df: DataFrame, model: Classifier | None, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``lang_pred``, ``lang_score``, ``lang_rejected``; reads the text alone.

    Columns of these names are replaced. ``und`` with score 0, rejected, for a null text or one without a letter, and for all rows where
    nothing could be learned (no model).
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "lang_score", "lang_rejected"]
    base = df.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, text_col, _SLICE):
            pred, score, rejected = _judge(part.column(text_col), model)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], [*part.schema.names, *added]
            )

    return base.mapInArrow(run, T.StructType([
        *base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
        T.StructField("lang_rejected", T.BooleanType()),
    ]))


def language_report(df: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score and whether the prediction is rejected."""
    return predict(df.select("doc_id", "text"), fit(df, folds=folds)).select(
        "doc_id", (crc_fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"),
    )


def accepted(df: DataFrame) -> DataFrame:
    """The rows of ``df``, with their columns as they are, whose language is not rejected.

    Where nothing could be learned no language is rejected: only null texts and those without a letter go.
    """
    sent = df.sparkSession.sparkContext.broadcast(fit(df))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            if sent.value is None:
                data, offsets = text_buffer(part.column("text"))
                raw = data.tobytes()
                yield part.filter(pa.array([has_letter(raw[a:b]) for a, b in zip(offsets, offsets[1:])], pa.bool_()))
            else:
                yield part.filter(pa.array(~_judge(part.column("text"), sent.value)[2]))

    return df.mapInArrow(keep, df.schema)
