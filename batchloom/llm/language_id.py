"""Language identification: averaged subword embeddings and a linear softmax.

Subwords are the character n-grams of words (2 to 4 characters, word borders
included), hashed into ``BUCKETS``. A text is the mean of the embeddings of all
its subwords; a linear layer and softmax give a probability per language. Both
are trained by stochastic gradient descent in numpy, on a bounded sample of
labelled documents: at most ``per_lang`` of each language, those with the lowest
hashes of their ids. A fifth of the sample calibrates the model: the temperature of the
softmax, and when a prediction is rejected.

A text is rejected if its score is near chance (below the mean, by ratio, of chance and the score
that all but ``reject_share`` of the rightly predicted texts reach), or if it is not typical of
the predicted language. How typical it is tells the mean logarithm of the shares that its subwords have in the language,
against that of the language's own texts. The limit of this gap lies between what
all but ``reject_share`` of the known texts keep below, and what texts of a language left out,
each in turn, are above. So texts in a language that was not learned are rejected also where
the softmax is sure, as it often is between two languages.

Prediction runs over whole texts in tasks; the model that is broadcast has
2 x ``BUCKETS`` x languages numbers, whatever the corpus.

Defined cases: null texts and texts without letters are ``und`` with score 0, and
rejected. Without any labelled document, all texts are. Of more than ``max_langs``
languages those with most documents are learned, a bound on the model's memory;
texts in the others are judged like those of any unknown language. Equal texts have equal
results; ids may repeat or be null (a null id is never learned from; of rows with one id and
language, the one with the least hash of its text is). Other columns pass through ``recognised``
with their values, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.llm import textscan
from batchloom.llm.common import map_batches

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
PIECE = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all texts, and how many each text has."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], dtype=np.int64)
    starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one border after each word
    place = np.concatenate(([0], np.cumsum(keep)))
    codes = np.where(letter, codes, 0)[keep].astype(np.uint32)
    borders = place[starts]  # of each text, among the codes kept
    found, owner = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        inner = np.ones(m, dtype=bool)
        for i in range(1, n - 1):
            inner &= codes[i : i + m] != 0
        if n == 2:
            inner &= (codes[:m] != 0) | (codes[1:] != 0)
        h = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * _FACTORS[i]
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(inner)
        found.append((h[at] & np.uint32(BUCKETS - 1)).astype(np.int64))
        # A subword belongs to the text of its last character; the border before
        # a text's first word is the last one of the text before.
        owner.append(np.searchsorted(borders, at + n - 1, side="right") - 1)
    buckets = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    of = np.concatenate(owner) if owner else np.empty(0, dtype=np.int64)
    of = np.clip(of, 0, len(texts) - 1)
    order = np.argsort(of, kind="stable")
    return buckets[order], np.bincount(of, minlength=len(texts))


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # BUCKETS x languages: embedding times linear layer
    bias: np.ndarray
    typical: np.ndarray  # BUCKETS x languages: logarithms of shares
    temperature: float = 1.0
    limit: float = 0.0
    usual: np.ndarray | float = 0.0  # how typical the texts of each language are
    gap: float = np.inf  # how much less a text may be

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities, a row per text."""
        return self._scores(*subwords(texts))

    def _scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = np.tile(self.bias, (len(counts), 1))
        some = np.flatnonzero(counts)
        if len(some):
            z[some] += np.add.reduceat(self.logits[buckets], _starts(counts), axis=0, dtype=np.float64) / counts[some, None]
        return softmax(z / self.temperature)

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predicted language (its number), score, and whether it is rejected, per text."""
        buckets, counts = subwords(texts)
        p = self._scores(buckets, counts)
        best, score = p.argmax(axis=1), p.max(axis=1)
        rejected = score < self.limit
        some = np.flatnonzero(counts)
        if len(some):
            own = self.typical[buckets, np.repeat(best, counts)]
            mean = np.add.reduceat(own, _starts(counts), dtype=np.float64) / counts[some]
            rejected[some] |= np.broadcast_to(self.usual, len(self.langs))[best[some]] - mean > self.gap
        return best, score, rejected


def _starts(counts: np.ndarray) -> np.ndarray:
    """Where the subwords of each text that has some begin."""
    return np.concatenate(([0], np.cumsum(counts)[:-1]))[counts > 0].astype(np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def trained(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int, rate: float, reject_share: float, seed: int) -> Model:
    """A model of rows (language, buckets, counts), in the order given."""
    langs = sorted({r[0] for r in rows})
    k = len(langs)
    rng = np.random.default_rng(seed)
    layer = rng.normal(0, 1, (DIMENSIONS, k)) / np.sqrt(DIMENSIONS)
    embeddings = np.zeros((BUCKETS, DIMENSIONS))
    bias = np.zeros(k)
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    learn = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            lang, buckets, counts = learn[i]
            if not len(buckets):
                continue
            share = counts / counts.sum()
            if step % 2:  # every other step sees a short piece of the text
                share = rng.multinomial(int(rng.integers(10, 60)), share).astype(float)
                buckets, share = buckets[share > 0], share[share > 0]
                share /= share.sum()
            mean = share @ embeddings[buckets]
            error = softmax(mean @ layer + bias)
            error[langs.index(lang)] -= 1
            eta = rate * (1 - step / steps)
            grad = layer @ error
            layer -= eta * 0.01 * np.outer(mean, error)
            bias -= eta * 0.001 * error
            # The step is scaled so that it moves texts of any length alike.
            embeddings[buckets] -= (eta / (share @ share)) * share[:, None] * grad
            step += 1
    model = Model(langs, (embeddings @ layer).astype(np.float32), bias, shares(langs, learn))
    calibrate(model, held or rows, reject_share)
    return model


def shares(langs: list[str], rows: list[tuple[str, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logarithms of the shares of all subwords in each language; every document weighs the same."""
    total = np.full((BUCKETS, len(langs)), 0.5 / BUCKETS)
    for lang, buckets, counts in rows:
        if len(buckets):
            total[buckets, langs.index(lang)] += counts / counts.sum()
    return np.log(total / total.sum(axis=0)).astype(np.float32)


def calibrate(model: Model, rows: list[tuple[str, np.ndarray, np.ndarray]], reject_share: float) -> None:
    """Set temperature (least loss on these rows) and the limits of rejection of the model."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return
    weights = [c / c.sum() for _, _, c in rows]
    z = np.array([w @ model.logits[b] + model.bias for w, (_, b, _) in zip(weights, rows)])
    typical = np.array([w @ model.typical[b] for w, (_, b, _) in zip(weights, rows)])
    right = np.array([model.langs.index(lang) for lang, _, _ in rows])
    at, n = np.arange(len(rows)), len(model.langs)

    def loss(t: float) -> float:
        return -np.log(softmax(z / t)[at, right] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
    p = softmax(z / model.temperature)
    known = p.argmax(axis=1) == right
    if not known.any():
        return
    # Between chance and what right predictions reach.
    model.limit = float(np.sqrt(np.quantile(p.max(axis=1)[known], reject_share) / n))
    own = typical[at, right]
    # A language without a text here is as typical as all together.
    model.usual = np.array([np.median(own[right == k] if (right == k).any() else own) for k in range(n)])
    inside = np.quantile((model.usual[right] - own)[known], 1 - reject_share)
    model.gap = float(inside)
    if n > 1:  # every language left out in turn: its texts go to the best of the others
        z[at, right] = -np.inf
        other = z.argmax(axis=1)
        outside = np.quantile(model.usual[other] - typical[at, other], 0.05)
        model.gap = float(max(inside, (inside + outside) / 2))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py() or ""
            buckets, counts = np.unique(subwords([text])[0], return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "place": [batch.column("place")[i].as_py()], "lang": [batch.column("lang")[i].as_py()],
                    "buckets": pa.array([buckets], pa.list_(pa.int32())), "counts": pa.array([counts], pa.list_(pa.int32())),
                }
            )


def sample(docs: DataFrame, per_lang: int, max_langs: int) -> DataFrame:
    """Labelled documents outside the held-out fold, at most ``per_lang`` per language: place, lang, text.

    The languages are those with most documents, ties by name. Of each, ids with hashes in
    the lowest part of the range are looked at, about twice as many as wanted, so
    no language is ranked as a whole, and texts of the others are not read further.
    """
    rows = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2)).withColumn("place", F.xxhash64("doc_id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("place").alias("ids"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(max_langs)
    share = F.lit(2.0 * per_lang) / F.col("ids")
    low = F.col("place") < F.lit(-(2.0**63)) + share * F.lit(2.0**64)
    near = rows.join(F.broadcast(sizes), "lang").where((share >= 1) | low)
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    once = near.groupBy("lang", "place").agg(text["text"].alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    return once.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("place", "lang", "text")


def _arrays(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        for begin, end in zip(ends, ends[1:]):
            yield values[begin:end]


def fitted(docs: DataFrame, per_lang: int = 500, max_langs: int = 400, epochs: int = 6, rate: float = 0.5, reject_share: float = 0.005, seed: int = 7) -> Model | None:
    """A model learned from a bounded sample; None if nothing is labelled."""
    found = map_batches(sample(docs, per_lang, max_langs), _features, "place bigint, lang string, buckets array<int>, counts array<int>")
    table = found.toArrow()
    places, langs = table["place"].to_pylist(), table["lang"].to_pylist()
    arrays = zip(_arrays(table["buckets"]), _arrays(table["counts"]))
    # Repeated ids have equal places: the contents then set the order.
    keyed = sorted(
        ((p, lang, crc32(b.tobytes()), crc32(c.tobytes()), i), (lang, b, c))
        for i, (p, lang, (b, c)) in enumerate(zip(places, langs, arrays))
    )
    rows = [row for _, row in keyed]
    return trained(rows, epochs, rate, reject_share, seed) if rows else None


RESULTS = ("lang_pred", "score", "rejected")


def _predict(model, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in textscan.slices(batch, PIECE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                has = np.array([any(map(str.isalpha, t)) for t in texts])
                langs, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), ~has
                if m is None:
                    rejected[:] = True
                else:
                    best, found, unsure = m.judged(texts)
                    langs = [m.langs[b] if ok else "und" for b, ok in zip(best, has)]
                    score, rejected = np.where(has, found, 0.0), ~has | unsure
                columns = [*part.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return run


def predicted(docs: DataFrame, model: Model | None, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """The documents with predicted language, score and rejection, under names that they do not have yet."""
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(set(names) & set(docs.columns))} are there already")
    schema = T.StructType([*docs.schema.fields]).add(names[0], T.StringType()).add(names[1], T.DoubleType()).add(names[2], T.BooleanType())
    return map_batches(docs, _predict(docs.sparkSession.sparkContext.broadcast(model), names), schema)


def recognised(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is known well enough; all columns in their order."""
    model = fitted(docs.select("doc_id", "text", "lang"), **options)
    mark = "_" * (2 + max(map(len, docs.columns)))  # no column is called that
    kept = predicted(docs, model, tuple(mark + c for c in RESULTS)).where(~F.col(mark + "rejected"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, **options) -> DataFrame:
    """Prediction for every document; language, source and id are no input of it."""
    model = fitted(docs.select("doc_id", "text", "lang"), **options)
    rows = predicted(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
