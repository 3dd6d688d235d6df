"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(s - c_k) with c_0 < c_1 < ... and one score s for all grades: the dot product of a text's
hashed words and shape with shared weights. Expected grade: the sum of P(grade > k). Tail: P(grade >= least).

Grades come from labels: 0 toxic, 1 of low quality, 2 good. The fit is on at most FIT_ROWS labelled documents, the
first by a hash of their ids, whole texts (the bound is a parameter); every document is scored, whole.

Words are lower-cased in A-Z and hashed into 2**BITS buckets. The rarest kind of evidence, one word in hundreds, has
to count, so a document's distinct words count once each, and alike in long and short documents.

Defined cases: null text counts as empty; labels with a null grade are left out; several labels of a document all
count, as do several documents of an id, but no more than FIT_ROWS rows are fitted on (ties by grade, then by a hash of the
text's words); without labels the score is 0 and the grades are equally likely; an empty table gives no rows. Texts of any
length are read whole, in memory of some times their length. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idiolect.llm.common import as_bytes

BITS, GRADES, LEAST_GRADE = 16, 3, 2
FIT_ROWS, ROUNDS, RATE, DECAY = 6_000, 150, 1.0, 1e-4
#: Buckets in fewer fitted documents than this, or in over a half of them, say nothing.
LEAST_DOCS = 3
#: Standard errors by which the mean grade of a bucket's documents has to differ from the mean of all.
LEAST_Z = 4.0
#: Words whose buckets a worker remembers.
REMEMBERED = 1_000_000
SHAPES = 8
_seen: dict[bytes, int] = {}


def bucket(word: bytes) -> int:
    if word not in _seen:
        if len(_seen) >= REMEMBERED:
            _seen.clear()
        _seen[word] = zlib.crc32(word) >> (32 - BITS)
    return _seen[word]


def features(raw: bytes):
    """The distinct buckets of the words, and the text's shape."""
    import numpy as np

    words = raw.lower().split()
    n, size = max(1, len(words)), max(1, len(raw))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>!"))
    capitals = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    distinct = set(words)
    stripped = {w.strip(b".,;:!?\"'()[]") for w in distinct}
    shape = [min(1.0, symbols / n), min(1.0, 4 * capitals / size), min(1.0, 4 * digits / size), len(distinct) / n, min(1.0, math.log1p(len(words)) / 10), min(1.0, size / n / 20), float(n < 10), float(not words)]
    return np.fromiter({bucket(w) for w in stripped}, np.int64), np.array(shape)


@dataclass
class Model:
    words: object
    shape: object
    cuts: object

    def score(self, raw: bytes) -> float:
        ids, shape = features(raw)
        return float(self.words[ids].sum() + shape @ self.shape)

    def tails(self, score: float) -> list[float]:
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, score - c)))) for c in self.cuts]


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) of labels (id, quality, toxic) that rate a document."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(id_col), grade.cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col(id_col).isNotNull())


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """(id, ids, shape, grade) of the documents of at most `rows` labels, the first by a hash of their ids, as an Arrow
    table. The labels are few by that bound, so they are broadcast and no text is shuffled."""
    chosen = grades(labels, id_col).orderBy(F.xxhash64(id_col), id_col, "grade").limit(rows)
    rated = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").select("id", "text", "grade")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [features(raw) for raw in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0].astype("i4") for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column(2)], names=["id", "ids", "shape", "grade"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = rated.mapInArrow(run, f"id {kind}, ids array<int>, shape array<double>, grade int")
    first = made.orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("ids", "shape")).limit(rows)  # an id may be many documents
    return first.toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])


def loss(s, y, cuts):
    """Minus the mean log-likelihood of grades y at scores s, and its gradients by each score and by the cuts."""
    import numpy as np

    n, k = len(y), np.arange(len(y))
    p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
    upper = np.hstack([np.ones((n, 1)), p])[k, y]
    lower = np.hstack([p, np.zeros((n, 1))])[k, y]
    mass = np.maximum(upper - lower, 1e-9)
    slope = p * (1 - p)
    is_above, is_below = y[:, None] == np.arange(1, len(cuts) + 1), y[:, None] == np.arange(len(cuts))
    by_cut = np.sum(slope / mass[:, None] * (is_above.astype(float) - is_below), axis=0) / n
    return -np.log(mass).sum() / n, -(1 - upper - lower) / n, by_cut


def fit(rows, rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY, grades: int = GRADES) -> Model:
    """Full-batch AdaGrad on the cumulative-link likelihood of rows (an Arrow table of sample())."""
    import numpy as np

    words, shape, cuts = np.zeros(1 << BITS), np.zeros(SHAPES), np.linspace(-1, 1, grades - 1)
    model = Model(words, shape, cuts)
    y = rows["grade"].to_numpy() if rows.num_rows else np.empty(0)
    if len(y) == 0:
        return model
    lists = rows["ids"].combine_chunks()
    n_ids = np.diff(lists.offsets.to_numpy())
    ids, doc = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), n_ids)
    shapes = np.array(rows["shape"].to_pylist())
    freq = np.bincount(ids, minlength=1 << BITS)
    off = (y - y.mean()) / max(float(y.std()), 1e-9)
    z = np.abs(np.bincount(ids, off[doc], minlength=1 << BITS)) / np.sqrt(np.maximum(freq, 1))
    common = ((freq >= LEAST_DOCS) & (2 * freq <= len(y)) & (z >= LEAST_Z)).astype(float)  # the others keep weight 0
    seen = [np.full(1 << BITS, 1e-8), np.full(SHAPES, 1e-8), np.full(grades - 1, 1e-8)]
    for _ in range(rounds):
        s = np.bincount(doc, words[ids], minlength=len(y)) + shapes @ shape
        _, by_score, g_cuts = loss(s, y, cuts)
        g_words = np.bincount(ids, by_score[doc], minlength=1 << BITS) + decay * words
        g_shape = shapes.T @ by_score + decay * shape
        for x, g, v, step in ((words, g_words, seen[0], 0.3 * rate * common), (shape, g_shape, seen[1], rate), (cuts, g_cuts, seen[2], 0.1 * rate)):
            v += g * g
            x -= step * g / np.sqrt(v)
        cuts.sort()
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_GRADE) -> DataFrame:
    """Per row: id, expected_grade, tail (the chance of grade `least` or more), selected (tail of one half or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            tails = [shared.value.tails(shared.value.score(raw)) for raw in as_bytes(batch.column(1))]
            tail = [round(t[least - 1], 6) for t in tails]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(sum(t), 6) for t in tails], pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= 0.5 for t in tail], pa.bool_())], names=[id_col, "expected_grade", "tail", "selected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail double, selected boolean")
