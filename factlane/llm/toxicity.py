"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give the log-likelihood of each word's
characters.  At the top order each class has its own discounted counts; all that
discounting frees goes to lower orders that both classes share, built from
Kneser-Ney continuation counts over both.  So where a class has seen little, its
model says what the shared one says, and an expression that is rare in either class
moves the comparison little, while the stem of a toxic word, frequent in one class
and absent from the other, moves it much, also in forms never seen in training.

A text's evidence is the difference of the two log-likelihoods over the whole text divided by
the text's length, the highest differences among its distinct words, what its distinct words
have above ``NOTABLE``, and the logarithm of its length, as a longer text has higher ones by
chance.  A logistic curve makes a probability of it; it is fitted to evidence of labelled texts that
the counts have not seen: each quarter of the sample is judged by models of the other three.

Fitting uses a sample of at most ``SAMPLE`` labelled texts per class, those with the
smallest seeded hashes, so the models' size doesn't grow with the corpus; scoring
goes over every text, each word of it, inside the tasks.

Nulls: a missing text is an empty one; an empty text has no evidence and gets the
curve's value at none.  Rows without a label, or with a missing one, don't train.
Without labelled texts of both classes every score is the share of toxic labels (0
without labels).  Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import fit_logistic, for_share, learnable, logistic, sample
from .store import keep
from .text import by_bytes, free_name, per_text

#: Labelled texts per class that the models and the curve are fitted to, at most.
SAMPLE = 6_000
#: Bytes in an n-gram, 7 at most.
ORDER = 6
DISCOUNT = 0.9
THRESHOLD = 0.3
RIDGE = 0.1
#: Scores of words that a task remembers between batches.
REMEMBERED = 400_000
#: Padding before a word, as many as a context is long.
PAD = b"\x01"
PEAKS, NOTABLE = 3, 2.0
FEATURES = PEAKS + 3
#: Texts are taken together up to about this size.
GROUP_BYTES = 4_000_000


def _codes(words: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For the bytes of all words and their end: the n-grams of each order that end there, as integers.

    Also returns the word that each place belongs to.  An n-gram of ``order`` <= 7
    bytes fits a 64-bit integer.
    """
    pad = PAD * (order - 1)
    joined = np.frombuffer(b"".join([pad + w + b" " for w in words]), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(lengths.sum()) + (word + 1) * (order - 1)
    grams = [joined[place]]
    for back in range(1, order):
        grams.append(grams[-1] | (joined[place - back] << (8 * back)))
    return grams, word


@dataclass
class Table:
    """Values by n-gram, for many n-grams at once."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, wanted: np.ndarray, default: float = 0.0) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], default)


def _by_context(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, their total weight, and how many n-grams continue them."""
    context, at, kinds = np.unique(keys >> 8, return_inverse=True, return_counts=True)
    return context, np.bincount(at, weights, len(context)), kinds


@dataclass
class Level:
    """Discounted probabilities of the n-grams of one order, and what a context leaves to shorter ones."""

    seen: Table
    left: Table

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, discount: float) -> Level:
        context, total, kinds = _by_context(keys, counts)
        of_context = np.searchsorted(context, keys >> 8)
        return cls(Table(keys, np.maximum(counts - discount, 0) / total[of_context]), Table(context, discount * kinds / total))

    def mix(self, gram: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities; ``gram`` is what stands there, with its context in the higher bytes."""
        return self.seen.get(gram) + self.left.get(gram >> 8, 1.0) * lower


@dataclass
class ClassModels:
    """Both classes' models: own top levels, shared lower ones."""

    toxic: Level
    ordinary: Level
    shared: list[Level] = field(default_factory=list)
    order: int = ORDER
    #: The log ratios of all n-grams met in training, worked out once.
    met: Table | None = None

    @classmethod
    def fit(cls, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> ClassModels:
        """From the distinct n-grams of the top order (as ``_codes`` makes them) and their counts in each class."""
        by_key = np.argsort(grams)
        grams, toxic, ordinary = grams[by_key], toxic[by_key].astype(float), ordinary[by_key].astype(float)
        levels = []
        # continuation counts: of an n-gram, how many different bytes come before it.
        # The byte furthest back is the highest of the integer.
        for n in range(order - 1, 0, -1):
            longer = np.unique(grams & ((1 << (8 * (n + 1))) - 1))
            keys, counts = np.unique(longer & ((1 << (8 * n)) - 1), return_counts=True)
            levels.append(Level.of(keys, counts.astype(float), discount))
        own = [Level.of(grams[c > 0], c[c > 0], discount) for c in (toxic, ordinary)]
        models = cls(own[0], own[1], levels[::-1], order)
        models.met = Table(grams, models.log_ratio([grams & ((1 << (8 * n)) - 1) for n in range(1, order + 1)]))
        # an n-gram that isn't among these is in neither class
        none = np.empty(0)
        models.toxic.seen = models.ordinary.seen = Table(none.astype(np.int64), none)
        return models

    def log_ratio(self, grams: list[np.ndarray]) -> np.ndarray:
        """log p(toxic) / p(ordinary) of what ends each n-gram; ``grams`` has them for every order."""
        lower = np.full(len(grams[0]), 1 / 256)
        for level, gram in zip(self.shared, grams):
            lower = level.mix(gram, lower)
        return np.log(self.toxic.mix(grams[-1], lower)) - np.log(self.ordinary.mix(grams[-1], lower))

    def difference(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood of each word as toxic less that as ordinary, its end included."""
        grams, word = _codes(words, self.order)
        llr = self.met.get(grams[-1], np.nan)
        if len(rest := np.flatnonzero(np.isnan(llr))):
            llr[rest] = self.log_ratio([g[rest] for g in grams])
        return np.bincount(word, llr, len(words))


class Evidence:
    """The evidence of texts; remembers the words it has met."""

    def __init__(self, models: ClassModels):
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ratio, self.length = np.empty(0), np.empty(0)

    def learn(self, words: list[bytes]) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.ratio = np.concatenate([self.ratio, self.models.difference(words)])
        self.length = np.concatenate([self.length, np.fromiter(map(len, words), float, len(words)) + 1])

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """A row per text: mean over its length, its PEAKS highest words (0 where there are fewer), excess, log length."""
        out = np.zeros((len(texts), FEATURES))
        for some in by_bytes(texts, GROUP_BYTES):
            split = [texts[i].lower().split() for i in some]
            met = set().union(*split)
            if len(self.at) > REMEMBERED:
                self.forget()
            if new := list(met.difference(self.at)):
                self.learn(new)
            for i, words in zip(some, split):
                if not words:
                    continue
                at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                out[i, 0] = self.ratio[at].sum() / self.length[at].sum()
                # a word that repeats is one piece of evidence
                each = self.ratio[np.unique(at)]
                best = np.sort(np.partition(each, -PEAKS)[-PEAKS:] if len(each) > PEAKS else each)[::-1]
                out[i, 1 : 1 + len(best)] = best
                out[i, -2] = np.log1p(np.maximum(each - NOTABLE, 0).sum())
                out[i, -1] = np.log(len(words))
        return out


@dataclass
class ToxicityModel:
    models: ClassModels | None
    curve: np.ndarray
    rate: float

    def scores(self, evidence: Evidence, texts: list[bytes]) -> np.ndarray:
        return logistic(evidence(texts), self.curve)


def gram_counts(sampled: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram``, ``label``, ``fold``, ``n``: n-grams of the sample's words with their counts."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for (label, fold), part in batch.groupby(["label", "fold"]):
                words = [w for t in part["text"] for w in (t or "").encode().lower().split()]
                if words:
                    grams, counts = np.unique(_codes(words, order)[0][-1], return_counts=True)
                    yield pd.DataFrame({"gram": grams, "label": label, "fold": fold, "n": counts})

    counted = sampled.select("text", "label", "fold").mapInPandas(run, "gram long, label int, fold int, n long")
    return counted.groupBy("gram", "label", "fold").agg(F.sum("n").alias("n"))


def models_of(counted: dict[str, np.ndarray], order: int, left_out: int | None = None) -> ClassModels | None:
    """Models from the columns of ``gram_counts`` without one fold; none if a class is missing."""
    used = counted["fold"] != left_out
    label = counted["label"][used]
    if len(np.unique(label)) < 2:
        return None
    grams, at = np.unique(counted["gram"][used], return_inverse=True)
    toxic, ordinary = (np.bincount(at, counted["n"][used] * (label == value), len(grams)) for value in (1, 0))
    return ClassModels.fit(grams, toxic, ordinary, order)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE, order: int = ORDER) -> ToxicityModel:
    """The curve from evidence of each quarter of the sample under models of the rest; the models from all of it."""
    spark = docs.sparkSession
    sampled = keep(sample(docs, labels, label, per_class, "toxicity"), "toxicity_sample")
    known = labels.where(F.col(label).isin(0, 1))
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    # n-grams of a bounded sample
    table = gram_counts(sampled, order).toArrow()
    counted = {name: table.column(name).to_numpy() for name in table.column_names}
    del table
    parts = {fold: models_of(counted, order, fold) for fold in range(4)}
    if any(models is None for models in parts.values()):
        return ToxicityModel(None, np.zeros(1 + FEATURES), share)
    shared = spark.sparkContext.broadcast(parts)

    def evidence(batches):
        import pandas as pd

        of = {fold: Evidence(models) for fold, models in shared.value.items()}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                found = of[fold]([(t or "").encode() for t in part["text"]])
                yield pd.DataFrame({"x": list(found), "label": part["label"].to_numpy()})

    # at most 2 * per_class rows of a few numbers
    seen = sampled.mapInPandas(evidence, "x array<double>, label int").toPandas()
    shared.unpersist()
    x, y = np.array(seen["x"].tolist()), seen["label"].to_numpy(float)
    return ToxicityModel(models_of(counted, order), for_share(fit_logistic(x, y, RIDGE), y.mean(), share), share)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability ``name`` that the text is toxic; ``text`` itself goes unless it is kept.

    A column of ``docs`` that is called ``name`` is replaced.  Whole texts are scored, however long.
    """
    docs = docs if text.lower() == name.lower() else docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def function(texts: list[bytes]) -> list[list]:
        model = shared.value
        if model.models is None:
            return [np.full(len(texts), model.rate)]
        if "evidence" not in state:
            state["evidence"] = Evidence(model.models)
        return [model.scores(state["evidence"], texts)]

    return per_text(docs, text, f"`{name}` double", function, keep_text)


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns only."""
    model = fit(docs, learnable(labels))
    name = free_name(docs, "_score")
    return score(docs, model, name=name, keep_text=True).where(F.col(name) < threshold).drop(name)
