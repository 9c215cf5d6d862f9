"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its letter n-grams (with the word's
borders marked) and of the whole word, each found by hash in one table. The
distinct words of a text, in order of first use, form windows of ``WINDOW``
words; a window is the average of its words, and a softmax over two classes
reads it. Table and softmax are trained jointly in numpy, so a misspelling that
was never seen still shares most n-gram vectors with the word it hides. A text
is as toxic as its most toxic window: averaged whole, a few words would drown
in a long text. A logistic curve, fitted on a fifth of the labelled texts that
the table does not learn from, turns that window's logit into the score. As
everything from the table to the softmax is linear, scoring needs one number a
hash place: the model is broadcast as 256 KB, whatever the corpus.

The fit takes at most ``TAUGHT`` labelled texts of class 0 and 1 (those with
the smallest hash of their id) and ``TAUGHT_WINDOWS`` windows of each, evenly
spaced: the documented bounds. The curve is set back to the class shares of
all labelled texts. Every text is scored whole.

Nulls: a null or wordless text gets the lowest score, a null or foreign label
teaches nothing, rows without id are scored but do not teach. An id labelled
twice is toxic if one label says so; of rows with one id the first text in
code-point order teaches. Without texts of both classes the score is the share
of label 1 (0.5 if there is none). Extra columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import batches, mix, pieces, shared

TAUGHT = (3000, 1500)      # texts of class 0 and 1
TAUGHT_WINDOWS = 48
WINDOW = 16
CURVE_PART = 5             # one text in so many is kept for the curve
TABLE_BITS, WIDTH = 16, 8
GRAMS = (3, 4, 5)
LEAST_SHARE = 0.005        # n-grams of fewer texts than this share of the sample teach nothing
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 3, 600, 256, 0.02, 5
TEXT_PIECE = 1 << 20
LETTERS_AT_ONCE = 1 << 20
BORDER = re.compile(r"\s")
TRIM = ".,;:!?()[]{}<>|\"'`*_«»“”‘’…-"


def words_of(text: str | None) -> list[str]:
    """Distinct lower-cased words of a text without punctuation at their ends, in order of first use."""
    found: dict[str, None] = {}
    for piece in pieces(text or "", TEXT_PIECE, BORDER):
        found.update(dict.fromkeys(piece.lower().split()))
    return list(filter(None, dict.fromkeys(w.strip(TRIM) for w in found)))


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of ``n`` words; the last window ends with the last word."""
    return np.unique(np.append(np.arange(0, max(n - WINDOW, 0), WINDOW), max(n - WINDOW, 0)))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and table place of every n-gram of the words, and of the words themselves."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.add.reduceat(mix(letters * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), np.cumsum(sizes) - sizes)
    found = [(np.arange(len(words)), whole)]
    h = letters
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + letters[n - 1:]
        if n in GRAMS:
            inside = np.flatnonzero(place[:len(h)] + n <= sizes[owner[:len(h)]])
            found.append((owner[inside], h[inside] + np.uint64(n)))
    rows, hashes = (np.concatenate(x) for x in zip(*found))
    return rows, (mix(hashes) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _groups(words: list[str]) -> Iterator[list[str]]:
    """Few enough words at once for the arrays of ``subwords``."""
    return batches(words, lambda w: len(w) + 2, LETTERS_AT_ONCE)


def window_bags(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Table places and their weights in the average, for each taught window of a text."""
    words = words_of(text)
    starts = window_starts(len(words)) if words else []
    if len(starts) > TAUGHT_WINDOWS:
        starts = starts[np.linspace(0, len(starts) - 1, TAUGHT_WINDOWS).astype(int)]
    bags = []
    for lo in starts:
        window = words[lo:lo + WINDOW]
        rows, places = subwords(window)
        share = 1 / np.bincount(rows, minlength=len(window)) / len(window)
        known, at = np.unique(places, return_inverse=True)
        bags.append((known, np.bincount(at, share[rows])))
    return bags


def fitted(sizes: np.ndarray, places: np.ndarray, weights: np.ndarray, toxic: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Logit of class 1 of each table place, the bias last: embeddings and softmax trained jointly by Adam.

    ``sizes`` are the places of each window, ``toxic`` its label and ``texts``
    the number of its text. Both classes weigh the same, and so do the windows
    of a text together, up to the root of their number.
    """
    count, starts = 1 << TABLE_BITS, np.cumsum(sizes) - sizes
    owner = np.repeat(texts, sizes)
    pairs = np.unique(owner.astype(np.int64) * count + places)
    common = np.bincount(pairs % count, minlength=count) >= LEAST_SHARE * (texts.max() + 1)
    weights = np.where(common[places], weights, 0).astype(np.float32)
    windows = np.bincount(texts)
    emphasis = 1 / np.sqrt(windows[texts])
    emphasis /= np.where(toxic, (emphasis * toxic).sum(), (emphasis * (1 - toxic)).sum()) / (len(toxic) / 2)
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (count, WIDTH)).astype(np.float32)
    held = [table, rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    want = np.eye(2)[toxic]
    epochs = max(EPOCHS, LEAST_STEPS // -(-len(sizes) // BATCH))
    for epoch in range(epochs):
        order, rate = rng.permutation(len(sizes)), RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            chosen = order[lo:lo + BATCH]
            own = sizes[chosen]
            at = np.repeat(starts[chosen] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            place, weight, begin = places[at].astype(np.int64), weights[at], np.cumsum(own) - own
            average = np.add.reduceat(held[0][place] * weight[:, None], begin, axis=0)
            z = average @ held[1] + held[2]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = ((p / p.sum(axis=1, keepdims=True) - want[chosen]) * emphasis[chosen, None] / len(chosen)).astype(np.float32)
            # the two columns of the error are opposite, so one sum a place carries the table's gradient
            pull = np.bincount(place, weight * np.repeat(error[:, 1], own), minlength=count).astype(np.float32)
            step += 1
            for k, g in enumerate((np.outer(pull, held[1][:, 1] - held[1][:, 0]), average.T @ error, error.sum(axis=0))):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                held[k] -= np.float32(rate) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return np.append(held[0] @ (held[1][:, 1] - held[1][:, 0]), held[2][1] - held[2][0])


def curve(logits: np.ndarray, toxic: np.ndarray, odds: float) -> tuple[float, float]:
    """Slope and height of the logistic curve of class 1 over logits, by Newton steps; ``odds`` are those of all labelled texts."""
    weight = np.where(toxic, odds / max(toxic.sum(), 1), 1 / max((1 - toxic).sum(), 1)) * len(toxic)
    x = np.stack([logits, np.ones_like(logits)], 1)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        # a weak pull to slope 1 keeps separable texts finite
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + 0.25 * (at[0] - 1) ** 2)

    at = np.array([1.0, np.log(odds)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + [0.5 * (at[0] - 1), 0]
        change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.5, 1e-3]), gradient)
        while loss(at - change) > loss(at) and np.abs(change).max() > 1e-6:
            change = change / 2
        at = at - change
    return float(max(at[0], 1e-3)), float(at[1])


class WordLogits(dict):
    """Words and their logits; words seen lately are kept, never more than ``most``."""

    def __init__(self, logits: np.ndarray, most: int = 200_000):
        super().__init__()
        self.logits, self.bias, self.most = logits[:-1], float(logits[-1]), most

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = words
        for group in _groups(new):
            rows, places = subwords(group)
            means = np.bincount(rows, self.logits[places], minlength=len(group)) / np.bincount(rows, minlength=len(group))
            self.update(zip(group, means.tolist()))

    def highest(self, text: str | None) -> float | None:
        """Logit of the most toxic window; none without words."""
        words = words_of(text)
        if not words:
            return None
        self.learn(words)
        known = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        total = np.append(0, np.cumsum(known))
        starts = window_starts(len(words))
        return float((total[np.minimum(starts + WINDOW, len(words))] - total[starts]).max() / min(WINDOW, len(words)) + self.bias)


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[np.ndarray, float, float]:
    """Logits of the table, slope and height of the curve, from the rows of ``docs`` for which ``teaches`` holds and that have a label 0 or 1."""
    marks = (labels.where(teaches & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")))
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rank = F.xxhash64(F.col("id").cast("string"))
    # ids of labels without a document must not take places of the sample
    present = marks.join(known.select("id").distinct(), "id", "left_semi")
    shares = dict(present.groupBy("toxic").count().collect())
    odds = [shares.get(c, 0) for c in (0, 1)]
    if not all(odds):
        share = odds[1] / sum(odds) if sum(odds) else 0.5
        return np.zeros((1 << TABLE_BITS) + 1), 0.0, float(np.log(max(share, 1e-9)) - np.log(max(1 - share, 1e-9)))
    drawn = [present.where(F.col("toxic") == c).orderBy(rank, "id").limit(TAUGHT[c]) for c in (0, 1)]
    sample = known.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").groupBy("id").agg(
        F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, toxic, text in zip(pdf["id"], pdf["toxic"], pdf["text"]):
                made = window_bags(text)
                sizes, places, weights = (np.array([len(p) for p, _ in made]), *(np.concatenate([m[k] for m in made] or [[]]) for k in (0, 1)))
                yield pd.DataFrame({"id": [str(key)], "toxic": [toxic], "sizes": [sizes.astype(np.int32).tobytes()],
                                    "places": [places.astype(np.uint16).tobytes()], "weights": [weights.astype(np.float32).tobytes()]})

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in frames for r in zip(pdf["id"], pdf["toxic"], pdf["sizes"], pdf["places"], pdf["weights"]) if len(r[2])]
        rows.sort(key=lambda r: r[0])
        # every CURVE_PART-th text of each class, in id order, is kept for the curve
        place = {c: {r[0]: i for i, r in enumerate(x for x in rows if x[1] == c)} for c in (0, 1)}
        kept = np.array([place[t][i] % CURVE_PART == CURVE_PART - 1 for i, t, *_ in rows], bool)
        sizes, places, weights = ([np.frombuffer(r[k], kind) for r in rows] for k, kind in ((2, np.int32), (3, np.uint16), (4, np.float32)))
        toxic = np.array([r[1] for r in rows])
        if len(set(toxic[~kept])) < 2 or len(set(toxic[kept])) < 2:
            kept[:] = False
        teach = np.flatnonzero(~kept)
        counts = np.array([len(x) for x in sizes])
        logits = fitted(*(np.concatenate([held[i] for i in teach]) for held in (sizes, places, weights)),
                        np.repeat(toxic[teach], counts[teach]), np.repeat(np.arange(len(teach)), counts[teach]))
        rest = np.flatnonzero(kept) if kept.any() else teach
        best = np.array([np.add.reduceat(logits[places[i]] * weights[i], np.cumsum(sizes[i]) - sizes[i]).max() + logits[-1] for i in rest])
        slope, height = curve(best, toxic[rest], odds[1] / odds[0])
        yield pd.DataFrame({"logits": [logits.astype(np.float32).tobytes()], "slope": [slope], "height": [height]})

    model = (sample.mapInPandas(bags, "id string, toxic int, sizes binary, places binary, weights binary").repartition(1)
             .mapInPandas(train, "logits binary, slope double, height double").collect()[0])
    return np.frombuffer(model["logits"], np.float32), model["slope"], model["height"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score``, the probability of class 1, of every whole text."""
    given = shared(docs.sparkSession, model)

    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logits, slope, height = given()
        words = WordLogits(logits)
        for texts in frames:
            best = np.array([-1e6 if z is None else z for z in map(words.highest, texts)], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(slope * best + height, -500, 500))))

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(score, "double")(F.col(text_col)).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """``id``, ``score`` and ``predicted`` (1 from a score of 0.5) of every row of ``docs``."""
    got = scored(docs, learn(docs, labels, teaches, id_col, text_col, label_col), id_col, text_col)
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
