"""Quality classifier: hashed word n-gram logistic regression, FTRL-trained, scored as sparse dot products."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ngrams import BITS, Ftrl, Model, sigmoid, sparse
from .scoring import judged, labelled_sample, passed

#: Labelled rows that the model is fitted on at most.
FIT_ROWS, EPOCHS = 4000, 4
FOLD, FOLDS, THRESHOLD = 2, 4, 0.7


def train(sample: list[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """FTRL over the sample, the rarer label weighted up to half the balance. Without both labels the model is their smoothed share."""
    learner = Ftrl(1 << bits)
    n, good = len(sample), sum(y for _, y in sample)
    if not 0 < good < n:
        model = learner.model()
        model.bias = 4.0 if good else -4.0 if n else 0.0
        return model
    rows = [(*sparse(t, bits), y) for t, y in sample]
    for _ in range(epochs):
        for slots, values, y in rows:
            learner.learn(slots, values, y, (n / (2 * (good if y else n - good))) ** 0.5)
    return learner.model()


def _scorer(docs: DataFrame, labels: DataFrame, key: str, text: str, fit_rows: int):
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", FOLD, FOLDS, fit_rows, key, text)))

    def make():
        m = model.value
        bits = len(m.weights).bit_length() - 1
        return lambda t: sigmoid(m.logit(*sparse(t, bits)))

    return make


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (1: labelled good is likelier), predicted per document.

    Learns from labels of at most ``fit_rows`` documents whose crc32(id) mod 4 is not 2; only texts are inputs. Whole
    texts are scored, empty and null ones by a feature of their own. A null id is never held out. An empty table gives
    no rows; without labels every score is 0.5. Repeated rows score alike. Other columns don't matter.
    """
    return judged(docs, _scorer(docs, labels, key, text, fit_rows), FOLD, FOLDS, threshold, key, text)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score_quality predicts to be good, in all their columns."""
    return passed(docs, _scorer(docs, labels, key, text, fit_rows), FOLD, FOLDS, threshold, key, text)
