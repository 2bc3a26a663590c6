"""Language identification with a string kernel.

A text is the set of its character n-grams of orders 1 to 4 (a blended
spectrum, presence only), and the kernel of two texts is the share of common
n-grams: |A & B| / sqrt(|A| |B|). A few training texts are landmarks. With
their kernel matrix K = U S U', the Nystroem features of a text are its kernel
values to the landmarks times U S^(-1/2); on these, one-versus-rest kernel
ridge regression is a small linear system for all classes at once. Texts are
scored in batches by two matrix products: presence times landmarks, and
features times weights.

N-grams are taken over lower-cased letters, all else being a blank, and are
hashed to ``2**HASH_BITS`` places; a text is the sorted list of the places it
holds, at most ``2**HASH_BITS`` however long the text.

A text may also be in none of the learnt languages. Its coverage is the share
of its places that the training texts of the predicted class hold together
(the class's profile). A class accepts texts whose coverage lies nearer to
what its own texts reach than to chance: above the middle between the
``OWN_QUANTILE`` of coverages of one half of its training texts in a profile of
the other half, and the share of all places that the profile fills. Short texts
have ``1 / sqrt(places)`` to spare. A class with fewer than ``CALIBRATION``
training texts in a half accepts everything.

What is learnt comes from a bounded sample: ``PER_CLASS`` training rows of
each language value, the first by the hash of their id. The driver holds their
bits (``2**HASH_BITS / 8`` bytes each) and nothing else of the corpus.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import returning

ORDERS = (1, 2, 3, 4)
HASH_BITS = 17
PER_CLASS = 300
LANDMARKS_PER_CLASS = 24
RIDGE = 1e-3
OWN_QUANTILE = 0.01
CALIBRATION = 20
# Places whose landmark rows are summed at a time, in the cores' own memory: the
# sum makes 32-bit copies of those rows.
BLOCK = 1 << 13
# Parts of a class from which the sample's candidates are picked side by side.
PARTS = 32

UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def places(text: str, seen: np.ndarray | None = None) -> np.ndarray:
    """The places, ascending, of the text's n-grams. ``seen``: a cleared
    array of 2**HASH_BITS flags to work in, left cleared."""
    data = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(1 << HASH_BITS, bool) if seen is None else seen
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(data):
            break
        # Multiplying spreads the low bits upwards; the place is the top bits.
        code = (code[:len(data) - n + 1] ^ data[n - 1:]) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        if n in ORDERS:
            seen[(code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)] = True
    held = np.flatnonzero(seen)
    seen[held] = False
    return held.astype(np.int32)


def profile(rows: list[np.ndarray]) -> np.ndarray:
    """Which places the rows hold together."""
    out = np.zeros(1 << HASH_BITS, bool)
    for row in rows:
        out[row] = True
    return out


class Model:
    """Landmarks, the feature map, one weight vector and one profile a class."""

    def __init__(self, rows: list[np.ndarray], labels: list[str]):
        """``rows``: places of the training texts; ``labels``: their classes."""
        self.classes = sorted(set(labels))
        at = np.asarray([self.classes.index(x) for x in labels])
        chosen = np.concatenate([np.flatnonzero(at == c)[:LANDMARKS_PER_CLASS] for c in range(len(self.classes))])
        self.landmarks = np.stack([profile([rows[i]]) for i in chosen], axis=1).astype(np.uint8)
        self.sizes = np.sqrt([max(len(rows[i]), 1) for i in chosen])
        values, vectors = np.linalg.eigh(self.kernel([rows[i] for i in chosen]))
        good = values > 1e-6 * values.max()
        self.map = vectors[:, good] / np.sqrt(values[good])
        z = self.features(rows)
        z1 = np.hstack([z, np.ones((len(z), 1))])
        y = np.where(at[:, None] == np.arange(len(self.classes)), 1.0, -1.0)
        # Classes weigh alike, whatever their share of the sample.
        weight = (1 / np.bincount(at))[at][:, None]
        self.weights = np.linalg.solve(z1.T @ (weight * z1) + RIDGE * np.eye(z1.shape[1]), z1.T @ (weight * y))
        own = [[rows[i] for i in np.flatnonzero(at == c)] for c in range(len(self.classes))]
        self.profiles = np.stack([profile(r) for r in own])
        self.limits = np.asarray([self.limit(r) for r in own])

    @staticmethod
    def limit(rows: list[np.ndarray]) -> float:
        """The least coverage at which a class with these rows accepts a text."""
        half, other = profile(rows[::2]), rows[1::2]
        if len(other) < CALIBRATION:
            return 0.0
        return float(np.quantile([half[r].mean() for r in other], OWN_QUANTILE) + profile(rows).mean()) / 2

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.asarray([len(r) for r in rows])
        common = np.zeros((len(rows), self.landmarks.shape[1]))
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(rows):
            hi = int(np.searchsorted(ends, ends[lo] - sizes[lo] + BLOCK, "right"))
            if hi <= lo:                               # one long text, some of its places after others
                for at in range(0, sizes[lo], BLOCK):
                    common[lo] += self.landmarks[rows[lo][at:at + BLOCK]].sum(0, dtype=np.int32)
                lo += 1
                continue
            # A sparse product: the landmark rows of a text's places, summed.
            part = self.landmarks[np.concatenate(rows[lo:hi])]
            common[lo:hi] = np.add.reduceat(part, ends[lo:hi] - sizes[lo:hi] - (ends[lo] - sizes[lo]), axis=0, dtype=np.int32)
            lo = hi
        return common / (np.sqrt(sizes)[:, None] * self.sizes)

    def features(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.kernel(rows) @ self.map

    def score(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Class index and score in [0, 1] (softmax of the class outputs) of each row."""
        z = self.features(rows)
        out = z @ self.weights[:-1] + self.weights[-1]
        odds = np.exp(4 * (out - out.max(1, keepdims=True)))
        best = out.argmax(1)
        return best, odds[np.arange(len(best)), best] / odds.sum(1)

    def accepts(self, rows: list[np.ndarray], best: np.ndarray) -> np.ndarray:
        """Whether each row's coverage suffices for its predicted class."""
        return np.asarray([self.profiles[c][r].mean() + len(r) ** -0.5 >= self.limits[c] for r, c in zip(rows, best)], bool)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
        per_class: int = PER_CLASS) -> Model | None:
    """Fit on up to ``per_class`` rows of each label: the first by the hash of
    their id, then the id. Null labels, null ids and texts without a letter are
    left out; of rows equal in label and id one is taken, the least text. Very
    long texts are read whole. None if there is nothing to learn from, as in an
    empty table."""
    import pyarrow as pa
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    order = [F.xxhash64("id"), F.col("id")]
    rows = (labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(id_col).alias("id"))
            .filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")))
    # The ids are picked first, so that texts are moved for the sample only;
    # first within parts of a label, so that no task sorts a whole label.
    ids = rows.filter("id is not null").select("label", "id").distinct().withColumn("part", part)
    first = (ids.withColumn("rank", F.row_number().over(Window.partitionBy("label", "part").orderBy(*order)))
             .filter(F.col("rank") <= per_class).select("label", "id"))
    picked = (first.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
              .filter(F.col("rank") <= per_class).select("label", "id"))
    # At most per_class ids for each label value: small enough to broadcast.
    sample = (rows.join(F.broadcast(picked), ["label", "id"]).groupBy("label", "id").agg(F.min("text").alias("text")))

    def run(batches):
        for batch in batches:
            bits = [np.packbits(profile([places(t)])).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), pa.array(bits, pa.binary())], names=["label", "id", "bits"])
    found = sample.select("text", "label", "id").mapInArrow(run, f"label string, id {dict(sample.dtypes)['id']}, bits binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.label, hash_order(r.id)))
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8))) for r in found]
    return Model(rows, [r.label for r in found])


def hash_order(key) -> int:
    import zlib
    return zlib.crc32(str(key).encode())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted (columns of these names are
    replaced). ``und`` with score 0, not accepted, for texts that are null or
    hold no letter, and for all texts if there is no model. ``accepted`` is
    false, too, for texts that are like none of the learnt languages; their
    lang_pred is the nearest. Equal texts get equal results, very long ones are
    read whole, and an empty table gives no rows."""
    import pyarrow as pa
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "accepted")
    held = spark.sparkContext.broadcast(model)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema

    def run(batches):
        model, seen = held.value, np.zeros(1 << HASH_BITS, bool)
        for part in batches:
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            names, scores, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            if known:
                rows = [places(texts[i], seen) for i in known]
                best, scores[known] = model.score(rows)
                accepted[known] = model.accepts(rows, best)
                for i, c in zip(known, best):
                    names[i] = model.classes[c]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)],
                                             names=[*part.schema.names, "lang_pred", "score", "accepted"])
    return docs.mapInArrow(returning(run, text_col), schema)
