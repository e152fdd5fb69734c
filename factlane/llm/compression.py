"""Quality by compression: which dictionary, built from good or from bad text, packs a text smaller.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces of bad
labelled texts.  A whole text is compressed with either, in blocks of one piece's length, so
that the dictionary matters as much at a long text's end as at its beginning.  The
difference of the two sizes, divided by the text's length and by the sizes' sum,
and the smaller size divided by the length, go through a logistic curve fitted to
labelled texts that the dictionaries have not seen.

Fitting uses at most ``SAMPLE`` labelled texts and ``PIECES`` pieces of ``PIECE_BYTES`` bytes
per class, those with the smallest seeded hashes; scoring covers every text, in the tasks.

Nulls: a missing text is an empty one, and an empty text has no difference: it gets the
curve's value at zero.  Rows without a label don't train.  Without labelled texts of both classes
every score is the share of good labels (0 without labels).  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import fit_logistic, for_share, logistic, sample
from .store import keep
from .text import per_text

SAMPLE = 2_000
PIECES = 2_500
PIECE_BYTES = 4_096
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.7


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.packers = []
        for data in dictionaries:
            trained = zstandard.ZstdCompressionDict(data)
            trained.precompute_compress(level=LEVEL)
            self.packers.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """A row per text: the difference by length and by the sizes' sum, and the smaller size by length."""
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            if text:
                blocks = [text[at : at + PIECE_BYTES] for at in range(0, len(text), PIECE_BYTES)]
                bad, good = (sum(len(p.compress(b)) for b in blocks) for p in self.packers)
                out[i] = (bad - good) / len(text), (bad - good) / (bad + good), min(bad, good) / len(text)
        return out


@dataclass
class CompressionModel:
    #: of bad and of good text; none without labelled texts of both classes
    dictionaries: tuple[bytes, bytes] | None
    middle: np.ndarray
    spread: np.ndarray
    curve: np.ndarray
    rate: float

    def scores(self, sizes: Sizes, texts: list[bytes]) -> np.ndarray:
        return logistic((sizes(texts) - self.middle) / self.spread, self.curve)


def pieces(sampled: DataFrame, label: int) -> list[bytes]:
    """At most PIECES pieces of the sampled texts of a class, by hash."""

    def cut(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        for batch in batches:
            found = [t[at : at + PIECE_BYTES] for t in (x.encode() for x in batch["text"] if x) for at in range(0, len(t), PIECE_BYTES)]
            yield pd.DataFrame({"piece": found, "h": np.array([xxhash.xxh64_intdigest(p) for p in found], np.uint64).view(np.int64)})

    of_class = sampled.where(F.col("label") == label).select("text")
    picked = of_class.mapInPandas(cut, "piece binary, h long").orderBy("h", "piece").limit(PIECES)
    return [bytes(r["piece"]) for r in picked.collect() if len(r["piece"]) >= 8]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; of too few texts for one, their raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> CompressionModel:
    """Dictionaries from three quarters of the sample, the curve from the rest."""
    sampled = keep(sample(docs, labels, label, per_class, "compression"), "quality_sample")
    known = labels.where(F.col(label).isin(0, 1))
    rate = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    bad, good = (pieces(sampled.where("fold < 3"), value) for value in (0, 1))
    none = np.zeros(3)
    if not bad or not good:
        return CompressionModel(None, none, none + 1, np.zeros(4), rate)
    dictionaries = (train_dictionary(bad), train_dictionary(good))

    def measure(batches: Iterator) -> Iterator:
        import pandas as pd

        sizes = Sizes(dictionaries)
        for batch in batches:
            found = sizes([(t or "").encode() for t in batch["text"]])
            yield pd.DataFrame({"x": list(found), "label": batch["label"].to_numpy()})

    # at most 2 * per_class rows of three numbers
    rest = sampled.where("fold = 3").mapInPandas(measure, "x array<double>, label int").toPandas()
    if rest["label"].nunique() < 2:
        rest = sampled.mapInPandas(measure, "x array<double>, label int").toPandas()
    x, y = np.array(rest["x"].tolist()), rest["label"].to_numpy(float)
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    curve = for_share(fit_logistic((x - middle) / spread, y), y.mean(), rate)
    return CompressionModel(dictionaries, middle, spread, curve, rate)


def score(docs: DataFrame, model: CompressionModel, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability ``name`` that the text is good; ``text`` itself goes unless it is kept.

    A column of ``docs`` that is called ``name`` is replaced.  Whole texts are scored, however long.
    """
    docs = docs if text.lower() == name.lower() else docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def function(texts: list[bytes]) -> list[list]:
        model = shared.value
        if model.dictionaries is None:
            return [np.full(len(texts), model.rate)]
        if "sizes" not in state:
            state["sizes"] = Sizes(model.dictionaries)
        return [model.scores(state["sizes"], texts)]

    return per_text(docs, text, f"`{name}` double", function, keep_text)
