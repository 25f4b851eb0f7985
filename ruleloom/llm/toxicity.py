"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on
those words of toxic text that ordinary text rarely has, in their proportions.
A window is compressed with the ordinary dictionary and with the ordinary one
extended by the toxic one; the bytes that the toxic part saves are its distance.
A text is judged by how many of its windows (of one and of four words) save at
least t bytes, for a few thresholds t; a logistic model, fitted on other
labelled texts than those that made the dictionaries, calibrates these counts
to a probability.

A toxic dictionary trained on whole toxic windows, against a separate ordinary
one, was tried first: most of a toxic text is ordinary, so such a dictionary is
filled with ordinary words, and what it lacks of the other's drowns the signal
(figures in the README).

The model is fitted on the driver from a bounded number of labelled rows
(``Limits``), of which it reads the whole texts.  Scoring reads every whole
text, in any order, with one small model a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm.common import materialize


@dataclass(frozen=True)
class Limits:
    """Bounds of the fitting sample in rows, and sizes of the dictionaries."""

    toxic_rows: int = 3000
    ordinary_rows: int = 6000
    dictionary_bytes: int = 24_576
    toxic_bytes: int = 6_000
    #: how much likelier a typical word is in toxic texts: the value that calibrates best is kept
    ratios: tuple[float, ...] = (10.0, 30.0, 60.0)
    #: a typical word is in at least this share of the toxic texts
    least_share: float = 0.002


#: Words of a window, and thresholds of saved bytes for windows of that size.
WINDOWS = ((1, (1, 2, 3, 4, 5, 6, 8)), (4, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15)))


#: Words whose saved bytes a model remembers before it starts afresh, and most bytes of such a word.
CACHED_WORDS, CACHED_BYTES = 300_000, 64


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _windows(words: list[bytes], width: int) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(0, len(words), width)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def __getstate__(self):
        return (self.ordinary, self.toxic, self.weights)

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights = state

    def _compressors(self):
        if "_ready" not in self.__dict__:
            made = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=65536, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self._ready = made
            self._known = {}
        return self._ready

    def _saved_by_words(self, words: list[bytes]) -> list[int]:
        """Bytes saved on windows of one word: a word saves the same wherever it stands, so it is compressed once."""
        plain, toxic = self._compressors()
        if len(self._known) >= CACHED_WORDS:
            self._known = {}
        known, out = self._known, []
        for word in words:
            saved = known.get(word)
            if saved is None:
                window = b" " + word + b" "
                saved = len(plain(window)) - len(toxic(window))
                if len(word) <= CACHED_BYTES and len(known) < CACHED_WORDS:
                    known[word] = saved
            out.append(saved)
        return out

    def features(self, text: str | None) -> np.ndarray:
        plain, toxic = self._compressors()
        words = _words(text)
        out = []
        for width, thresholds in WINDOWS:
            saved = np.array((self._saved_by_words(words) if width == 1 else [len(plain(w)) - len(toxic(w)) for w in _windows(words, width)]) or [0])
            for t in thresholds:
                n = int((saved >= t).sum())
                out += [np.log1p(n), n / np.sqrt(len(saved) + 8)]
        return np.array(out)

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + self.features(text) @ self.weights[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the constant is not shrunk."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / dev]
    w, shrink = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(shrink + 1e-9)
        w -= np.linalg.solve(h, z.T @ (p - y) + shrink * w)
    return np.r_[w[0] - (w[1:] * mean / dev).sum(), w[1:] / dev]


def _dictionary(size: int, samples: list[bytes], trim: int = 0) -> bytes:
    """Content of a trained dictionary; the samples themselves where they are too few to train."""
    try:
        trained = zstandard.train_dictionary(size, samples)
        return trained.as_bytes()[trim:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


def fit_model(texts: list[str | None], toxic: list[int], limits: Limits = Limits()) -> Model:  # noqa: B008
    """A model from labelled texts: even positions make dictionaries, odd ones calibrate."""
    order = np.random.RandomState(7).permutation(len(texts))
    bad = [texts[i] for i in order if toxic[i]]
    good = [texts[i] for i in order if not toxic[i]]
    if not bad or not good:
        base = b" "
        size = sum(2 * len(t) for _, t in WINDOWS)
        return Model(base, base, np.r_[6.0 if bad else -6.0, np.zeros(size)])
    made = lambda rows: rows[::2] if len(rows) > 1 else rows
    used = lambda rows: rows[1::2] if len(rows) > 1 else rows
    ordinary = [w for t in made(good) for w in _windows(_words(t), 4)]
    in_bad, in_good = Counter(), Counter()
    for t in made(bad):
        in_bad.update({b" " + w + b" " for w in _words(t)})
    for t in made(good):
        in_good.update({b" " + w + b" " for w in _words(t)})
    share = len(made(good)) / len(made(bad))
    least = max(1, round(limits.least_share * len(made(bad))))
    base = _dictionary(limits.dictionary_bytes, ordinary)
    kept = [(t, 1) for t in used(bad)] + [(t, 0) for t in used(good)]
    y = np.array([label for _, label in kept], float)
    found = []
    for ratio in limits.ratios:
        typical = [w for w, n in sorted(in_bad.items()) if n >= least and n * share > ratio * (in_good[w] + 1) for _ in range(n)]
        if not typical and found:
            continue
        typical = [typical[i] for i in np.random.RandomState(11).permutation(len(typical))]
        samples = [b"".join(typical[i : i + 16]).replace(b"  ", b" ") for i in range(0, len(typical), 16)]
        model = Model(base, _dictionary(limits.toxic_bytes, samples), np.zeros(1))
        x = np.array([model.features(t) for t, _ in kept])
        model.weights = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))
        found.append((-float((y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean()), model))
    return min(found, key=lambda f: f[0])[1]


def fold(key) -> F.Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out."""
    return (F.crc32(key.cast("string")) % 5).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, limits: Limits, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list, list]:
    """A bounded sample of labelled rows outside fold 0, by hash of the key."""
    # a key may be labelled more than once: each of its labels counts once
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold(F.col("k")) != 0)).distinct()
    picked = None
    for value, rows in ((1, limits.toxic_rows), (0, limits.ordinary_rows)):
        some = known.where(F.col("y") == value).orderBy(F.xxhash64("k"), "k").limit(rows)
        picked = some if picked is None else picked.union(some)
    # at most toxic_rows + ordinary_rows keys
    picked = materialize(picked.coalesce(1), "labelled")
    # of rows that repeat a key one text, by its hash: as many rows as keys at most
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(picked), "k")
    rows = texts.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")).select("k", "t", "y").collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1] or "", r[2]))
    return [r[1] for r in rows], [int(r[2]) for r in rows]


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) for its whole texts, appended by position."""
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # columns pass through as they are; one text at a time becomes Python
            scores = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``(key, held_out, score, predicted)`` for every document.

    A null text counts as empty; empty texts get the model's score for no
    windows.  Ties (equal texts) have equal scores.  Without labelled rows of
    one class the score is constant.  A null key is never held out.  Repeated
    rows are kept, an empty table gives an empty result, and other columns are
    ignored.  Long texts are read whole, one at a time.
    """
    model = fit_model(*labelled_sample(docs, labels, limits, key, text), limits)
    held = F.coalesce(fold(F.col(f"`{key}`")) == 0, F.lit(False)).alias("held_out")
    scored = score_texts(docs.select(F.col(f"`{key}`").alias(key), held, F.col(f"`{text}`").alias("__text")), model, "__text")
    return scored.select(key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
