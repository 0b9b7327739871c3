"""Language identification by string kernels, Nystroem landmarks and kernel ridge regression.

Kernel: blended spectrum of presence. A text's features are the distinct character
n-grams (n = 1..3) of its lower-cased letters, everything else being one separator; of these
count the n-grams that some landmark holds. Texts compare by the share they have in common,

    k(x, y) = |x & y| / sqrt(|x| |y|),

an inner product of unit vectors. Landmarks are a bounded sample of labelled texts of
every language. With K the landmarks' kernel matrix, a text's Nystroem features are
k(x, landmarks) K^(-1/2); one ridge regression per language against +1 / -1 gives its
score. Both steps are linear, so scoring is one matrix product per batch of texts:
(presence matrix) x (landmarks' presence) x (weights).

Whole texts are read in training and scoring, a batch of positions at a time. The driver
holds the landmarks' n-grams and the kernel rows of the training sample; both are bounded by
``Fit``, whatever the corpus. Counts of languages cover all labelled rows.

Null texts and texts without letters are ``und`` with score 0. If nothing can be
learned from (no labelled text with letters), all texts are ``und``. Ties go to the first
language in alphabetical order. Equal rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

UNKNOWN = "und"
ORDER = 3


@dataclass(frozen=True)
class Fit:
    """Documented bounds of the fit.

    landmarks and training texts per language; letters that get a symbol of their own (all
    others share one); ridge penalty; positions and texts of a scoring batch.
    """

    landmarks: int = 24
    training: int = 400
    letters: int = 80
    ridge: float = 1e-2
    positions: int = 1 << 20
    texts: int = 256


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case code point, and whether it is a letter."""
    points = range(0x110000)
    lower = np.array([ord(chr(p).lower()[0]) for p in points], dtype=np.int32)
    letter = np.fromiter((chr(p).isalpha() for p in points), dtype=bool, count=0x110000)
    return lower, letter


def code_points(texts: list[str]) -> np.ndarray:
    """Lower-case letters of the texts as code points, 0 for all else; each text ends with a 0."""
    raw = "\0".join(texts) + "\0"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lower, letter = _characters()
    return np.where(letter[points], lower[points], 0)


def alphabet(texts: list[str], size: int) -> np.ndarray:
    """The most frequent letters, ties by code point."""
    points, counts = np.unique(code_points(texts), return_counts=True)
    points, counts = points[points > 0], counts[points > 0]
    return np.sort(points[np.lexsort((points, -counts))[:size]])


class Grams:
    """n-grams over an alphabet as numbers; symbol 0 separates, 1 is any other letter."""

    def __init__(self, letters: np.ndarray):
        self.symbol = np.ones(0x110000, dtype=np.int32)
        self.symbol[0] = 0
        self.symbol[letters] = np.arange(2, len(letters) + 2)
        self.base = len(letters) + 2
        self.size = self.base + self.base**2 + self.base**3

    def of(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, n-gram numbers) per n; an n-gram starts at its place and does not end in a separator alone."""
        b = self.base
        code, first = symbols.astype(np.int64), 0
        yield np.arange(len(code)), code
        for n in range(2, ORDER + 1):
            first += b ** (n - 1)
            code = code[:-1] * b + symbols[n - 1 :]
            yield np.arange(len(code)), code + first


class Model:
    """Landmarks, their n-grams, and the weights of every language."""

    def __init__(self, letters: np.ndarray, vocabulary: np.ndarray, landmarks: np.ndarray, fit: Fit):
        self.grams, self.fit = Grams(letters), fit
        self.column = np.full(self.grams.size, -1, dtype=np.int32)
        self.column[vocabulary] = np.arange(len(vocabulary))
        self.width = len(vocabulary)
        self.landmarks = landmarks  # width x landmarks, unit columns
        self.languages: list[str] = []
        self.weights: np.ndarray | None = None

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts x vocabulary, 0 or 1; long texts are read in slices that overlap by an n-gram."""
        seen = np.zeros((len(texts), self.width), dtype=np.uint8)
        flat = seen.reshape(-1)
        symbols = self.grams.symbol[code_points(texts)]
        row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        row = row.astype(np.int64) * self.width
        step = self.fit.positions
        for low in range(0, len(symbols), step):
            part, rows = symbols[low : low + step + ORDER - 1], row[low : low + step + ORDER - 1]
            for places, code in self.grams.of(part):
                column = self.column[code]
                # an n-gram belongs to the text it starts in; it ends at that text's separator at most
                inside = (column >= 0) & (rows[places] == rows[len(part) - len(code) :])
                flat[rows[places][inside] + column[inside]] = 1
        return seen

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Texts x landmarks."""
        seen = self.presence(texts).astype(np.float32)
        norm = np.sqrt(np.maximum(seen.sum(axis=1), 1))
        return (seen @ self.landmarks) / norm[:, None]

    def learn(self, kernel: np.ndarray, labels: list[str], own: np.ndarray) -> None:
        """One-versus-rest ridge regression on Nystroem features; own: the landmarks' kernel matrix."""
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        features = np.column_stack([kernel.astype(np.float64) @ root, np.ones(len(kernel))])
        self.languages = sorted(set(labels))
        target = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # languages weigh alike, however many texts each has
        counts = {lang: labels.count(lang) for lang in self.languages}
        weight = np.array([1.0 / counts[lang] for lang in labels])[:, None]
        gram = features.T @ (features * weight)
        gram[np.diag_indices(len(gram) - 1)] += self.fit.ridge
        solved = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), features.T @ (target * weight))
        self.weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (share of the softmax) of each text; texts have letters."""
        scores = self.kernel(texts) @ self.weights[:-1] + self.weights[-1]
        best = scores.argmax(axis=1)
        share = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
        return [self.languages[k] for k in best], 1.0 / share.sum(axis=1)


def groups(texts: list[str], fit: Fit) -> Iterator[list[int]]:
    """Indices in runs of few texts and positions; a longer text is a run of its own."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if run and (len(run) >= fit.texts or size + len(text) > fit.positions):
            yield run
            run, size = [], 0
        run.append(i)
        size += len(text)
    if run:
        yield run


def _labelled(docs: DataFrame, key: str, text: str, lang: str, training, fit: Fit) -> tuple[list, list]:
    """(landmark rows, training rows with the landmarks), each a list of (key, lang): bounded, drawn by a hash of the key."""
    known = F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}")
    rows = docs.filter(training & known).select(
        F.col(key).alias("key"), F.col(lang).alias("lang")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    wanted = fit.landmarks + fit.training
    # three times as many as wanted in the mean, cut to the number wanted by rank
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 3 * wanted / n)))])
    draw = F.xxhash64(F.lit("language sample"), F.col("key"))
    some = rows.withColumn("draw", draw).filter(
        F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))
    taken = some.select("key", "lang", rank.alias("rank")).filter(F.col("rank") <= wanted).collect()
    pairs = [(r["key"], r["lang"], r["rank"]) for r in taken]
    return [(k, lang) for k, lang, r in pairs if r <= fit.landmarks], [(k, lang) for k, lang, _ in pairs]


def _rows_of(docs: DataFrame, key: str, text: str, keys: list) -> DataFrame:
    chosen = docs.sparkSession.createDataFrame([(k,) for k in keys], "key bigint")
    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t")).join(F.broadcast(chosen), "key")


def fit_model(docs: DataFrame, training, key: str = "doc_id", text: str = "text", lang: str = "lang",
              fit: Fit = Fit()) -> Model | None:
    """The model, learned from rows where ``training`` holds; None if there are none."""
    landmark_rows, training_rows = _labelled(docs, key, text, lang, training, fit)
    if not landmark_rows:
        return None
    landmark_keys = sorted({k for k, _ in landmark_rows})
    languages = dict(training_rows) | dict(landmark_rows)
    size = fit.letters

    def letters(batches):
        for batch in batches:
            for t in batch.column(1).to_pylist():
                points, counts = np.unique(code_points([t]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points[1:], pa.int64()), pa.array(counts[1:], pa.int64())], names=["point", "n"]
                )

    source = _rows_of(docs, key, text, landmark_keys)
    found = source.mapInArrow(letters, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n"))
    known = np.sort(np.array([r["point"] for r in found.orderBy(F.desc("n"), "point").limit(size).collect()], dtype=np.int64))
    grams = Grams(known)

    def gram_sets(batches):
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols = grams.symbol[code_points([t])]
                own = np.unique(np.concatenate([code for _, code in grams.of(symbols)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([own.tolist()], pa.list_(pa.int64()))], names=["key", "grams"]
                )

    sets = {r["key"]: np.array(r["grams"]) for r in source.mapInArrow(gram_sets, "key bigint, grams array<bigint>").collect()}
    order = sorted(sets)
    vocabulary = np.unique(np.concatenate([sets[k] for k in order]))
    presence = np.zeros((len(vocabulary), len(order)), dtype=np.float32)
    for j, k in enumerate(order):
        presence[np.searchsorted(vocabulary, sets[k]), j] = 1.0 / np.sqrt(len(sets[k]))
    model = Model(known, vocabulary, presence, fit)

    def kernels(batches):
        for batch in batches:
            ks, ts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for run in groups(ts, fit):
                values = model.kernel([ts[i] for i in run])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ks[i] for i in run], pa.int64()), pa.array(values.tolist(), pa.list_(pa.float32()))],
                    names=["key", "kernel"],
                )

    wanted = sorted({k for k, _ in training_rows} | set(order))
    got = _rows_of(docs, key, text, wanted).mapInArrow(kernels, "key bigint, kernel array<float>").collect()
    got.sort(key=lambda r: r["key"])
    model.learn(
        np.array([r["kernel"] for r in got]), [languages[r["key"]] for r in got], presence.T @ presence
    )
    return model


def classify(docs: DataFrame, model: Model | None, text: str = "text", fit: Fit = Fit()) -> DataFrame:
    """docs without the text, with ``lang_pred`` and ``score``; only the text is looked at.

    Columns of docs that are named like the two results are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by Fit
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    out = docs.select(*others).schema
    names = [*others, "lang_pred", "score"]

    def run(batches):
        known = shared.value
        for batch in batches:
            ts = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(len(others)).to_pylist()]
            langs, scores = [UNKNOWN] * len(ts), [0.0] * len(ts)
            with_letters = [i for i, t in enumerate(ts) if t is not None] if known else []
            for run_ in groups([ts[i] for i in with_letters], fit):
                found, share = known.predict([ts[with_letters[i]] for i in run_])
                for i, lang, s in zip(run_, found, share):
                    langs[with_letters[i]], scores[with_letters[i]] = lang, float(s)
            columns = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names
            )

    schema = out.add("lang_pred", "string").add("score", "double")
    return docs.select(*others, F.col(text).cast("string")).mapInArrow(run, schema)
