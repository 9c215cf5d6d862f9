"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view sees the words of a document (the hashed words that differ most
between good and bad documents) and the style of its writing; the metadata
view sees source, language and length. Both are logistic models, fitted first
on a bounded sample of labelled documents. In each round either model scores
all unlabelled documents and passes those it is surest about, a share of the
whole corpus, to the other as pseudo-labels; the words are chosen anew from
counts over labelled and passed documents, and both models are fitted again
with Newton sums over all of them. A share grows with the rounds and is chosen
afresh in each. However many are passed, together they weigh no more than the
labelled sample. On labelled documents kept out of the fit each view is calibrated, and a logistic
model combines the calibrated views; all documents are scored with it.

Good means: labelled as of quality and not as toxic. Rows without label, or
with a null one, do not teach. Null and empty texts have no words and plain
style; null metadata are a value of their own; repeated rows get equal
scores and are passed on together; ties keep the document (0.5 is kept). Without labels of both kinds
every score is 0.5.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import WordHashes, lowered_words, shared, small_enough, stored

LABELLED_DOCS = 8_000                              # expected size of the labelled sample the models are fitted on
WORDS, BUCKETS = 400, 2**20                        # words of the text view, hash buckets they are chosen from
ROUNDS, SURE_SHARE = 3, 0.05                       # co-training rounds; share of the unlabelled documents by which what a view passes on grows in each
SUMS = 32                                          # tasks whose Newton sums reach the driver
BINS = 100                                         # of a logit's unit, in the counts that say how sure the surest share is
SOURCE_BUCKETS = 64
_CLASS = np.zeros(256, np.int64)                   # byte classes: 0 other, 1 white space, 2 lower, 3 upper, 4 digit, 5 sign
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


def style(raw: bytes, buckets: np.ndarray) -> np.ndarray:
    """Shares of upper case, digits and signs, word length, share of distinct words, repeated neighbours, length."""
    n = max(len(raw), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / n
    words = max(len(buckets), 1)
    same = float((buckets[1:] == buckets[:-1]).sum()) / words
    distinct = len(np.unique(buckets)) / words
    return np.array([kinds[3], kinds[4], kinds[5], np.log1p(len(raw) / words), distinct / words ** -0.15, same, np.log1p(words)])


def metadata(source, lang, n_chars) -> list[float]:
    """The source's bucket, the language's, and the length's logarithm."""
    return [zlib.crc32(str(source).encode()) % SOURCE_BUCKETS, zlib.crc32(str(lang).encode()) % 16,
            np.log1p(0 if n_chars is None or n_chars != n_chars else max(n_chars, 0)) / 10]


class Logistic:
    """Regularised logistic regression on standardised features, fitted by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float, far=None, most: float = np.inf) -> Logistic:
        """``far``: function that sums another one's arrays over rows elsewhere; those rows weigh ``most`` at most together."""
        x = x.astype(np.float64)
        n, total, squares = _moments(x, y)
        distant = far(_moments) if far else None
        weight = 0.0
        if distant is not None:
            weight = min(1.0, most / distant[0][0])
            n, total, squares = (a + weight * b for a, b in zip((n, total, squares), distant, strict=True))
        self.mean = total / n
        self.scale = np.sqrt(np.maximum(squares / n - self.mean ** 2, 0)) + 1e-6
        self.weights = np.zeros(x.shape[1] + 1)
        self._steps(x, y, penalty, None, 0.0)
        if weight:
            self._steps(x, y, penalty, far, weight)
        return self

    def _steps(self, x, y, penalty, far, weight) -> None:
        ridge = np.full(len(self.weights), penalty)
        ridge[-1] = 1e-6
        for _ in range(25):
            sums = _newton_sums(self.mean, self.scale, self.weights)
            bend, slope = sums(x, y)
            if far:
                bend, slope = (a + weight * b for a, b in zip((bend, slope), far(sums), strict=True))
            step = np.linalg.solve(bend + np.diag(ridge), slope - ridge * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


def _moments(x, y):
    return np.array([float(len(x))]), x.sum(axis=0), (x * x).sum(axis=0)


def _newton_sums(mean, scale, weights):
    def sums(x, y):
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        p = _sigmoid(z @ weights)
        return (z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p)
    return sums


@dataclass
class QualityModel:
    words: np.ndarray          # bucket to its place among the chosen words, or -1
    text: Logistic
    page: Logistic
    text_scale: Logistic       # calibration of either view, and their combination
    page_scale: Logistic
    both: Logistic


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _feature_rows(frames):
    hashes = WordHashes()
    for frame in frames:
        rows = []
        for text, source, lang, n in zip(frame["text"], frame["source"], frame["lang"], frame["n_chars"], strict=True):
            buckets = (hashes.of(lowered_words(text)) % np.uint64(BUCKETS)).astype(np.int64)
            rows.append((np.unique(buckets).astype(np.int32).tobytes(),
                         [*style((text or "").encode("utf-8", "surrogatepass"), buckets), *metadata(source, lang, n)]))
        out = pd.DataFrame(rows, columns=["bag", "plain"])
        out["id"] = frame["id"].astype("Int64").array
        yield out


def _matrix(view: str, frame: pd.DataFrame, words: np.ndarray | None) -> np.ndarray:
    """Features of one view from the rows (bag, plain): chosen words and style, or source, language and length."""
    n = len(frame)
    plain = np.stack(frame["plain"].to_numpy()).astype(np.float64) if n else np.empty((0, 10))
    if view == "page":
        out = np.zeros((n, SOURCE_BUCKETS + 17))
        out[np.arange(n), plain[:, -3].astype(np.int64)] = 1
        out[np.arange(n), SOURCE_BUCKETS + plain[:, -2].astype(np.int64)] = 1
        out[:, -1] = plain[:, -1]
        return out
    places = int(words.max(initial=-1)) + 1
    out = np.zeros((n, places + plain.shape[1] - 3))
    bags = [np.frombuffer(b, np.int32) for b in frame["bag"]]
    place = words[np.concatenate(bags)] if n else np.empty(0, np.int64)
    row = np.repeat(np.arange(n), [len(b) for b in bags])
    out[row[place >= 0], place[place >= 0]] = 1
    out[:, places:] = plain[:, :-3]
    return out


def bucket_counts(bags: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): bad and good documents with a word in each bucket."""
    count = lambda which: np.bincount(np.concatenate([bags[i] for i in np.flatnonzero(which)] or [np.empty(0, np.int64)]), minlength=BUCKETS)
    return np.stack([count(~good), count(good)])


def choose_words(counts: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Places of the WORDS buckets whose ``n0`` bad and ``n1`` good documents differ most surely (chi-square), -1 for all others."""
    b, a = counts
    total = a + b
    expected = total * n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(total >= 5, (a - expected) ** 2 / expected + (b - (total - expected)) ** 2 / (total - expected), 0)
    best = np.argsort(-chi, kind="stable")[:WORDS]
    out = np.full(BUCKETS, -1, np.int16)
    best = best[chi[best] > 10]
    out[best] = np.arange(len(best))
    return out


def _summed(table: DataFrame, view: str, words_of):
    """Function that adds up what another makes of the features and pseudo-labels of ``view`` over all rows that have one."""
    label = f"{view}_label"
    rows = table.where(F.col(label).isNotNull()).select("bag", "plain", label).coalesce(SUMS)

    def total(sums):
        def run(frames):
            held = None
            for frame in frames:
                if len(frame):
                    got = sums(_matrix(view, frame, words_of()), frame[label].to_numpy(np.float64))
                    held = got if held is None else [a + b for a, b in zip(held, got, strict=True)]
            if held is not None:
                yield pd.DataFrame({"shapes": ["|".join(",".join(map(str, a.shape)) for a in held)],
                                    "sums": [np.concatenate([a.ravel() for a in held]).astype(np.float64).tobytes()]})
        got = rows.mapInPandas(run, "shapes string, sums binary").collect()
        if not got:
            return None
        flat = np.sum([np.frombuffer(r["sums"]) for r in got], axis=0)
        shapes = [tuple(map(int, x.split(","))) for x in got[0]["shapes"].split("|")]
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        return [flat[e - int(np.prod(x)):e].reshape(x) for e, x in zip(ends, shapes, strict=True)]
    return total


def _once(value_of):
    """A task unpacks a shared value once."""
    held = []

    def get():
        if not held:
            held.append(value_of())
        return held[0]
    return get


def _bins(z: np.ndarray) -> np.ndarray:
    return np.floor(z * BINS).astype(np.int64)


def surest(pool: DataFrame, models: dict, words: np.ndarray, share: float, rate: float) -> DataFrame:
    """(bag, plain, text_label, page_label): all rows of ``pool`` among the ``share`` that either view is surest about, labelled for the other.

    ``rate`` of them are good; ties at the bound pass together.
    """
    model_of = shared(pool.sparkSession, (models, words))

    def logits(frames):
        got, words = _once(model_of)()
        for frame in frames:
            if len(frame):
                yield frame, {view: got[view].logit(_matrix(view, frame, words)) for view in got}

    def count(frames):
        for _, z in logits(frames):
            yield pd.concat([pd.DataFrame({"view": view, "bin": _bins(z[view])}).groupby(["view", "bin"]).size().rename("n").reset_index() for view in z])

    counted = pool.select("bag", "plain").mapInPandas(count, "view string, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toPandas()
    bounds = {}
    for view in models:
        own = counted[counted["view"] == view].sort_values("bin")
        bins, n = own["bin"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        wanted = max(1, int(n.sum() * share))
        low, high = max(1, int(wanted * (1 - rate))), max(1, int(wanted * rate))
        bounds[view] = (int(bins[np.searchsorted(np.cumsum(n), low)]) if len(bins) else 0,
                        int(bins[::-1][np.searchsorted(np.cumsum(n[::-1]), high)]) if len(bins) else 0)

    def label(frames):
        for frame, z in logits(frames):
            out = frame.copy()
            for view, other in (("text", "page"), ("page", "text")):
                b, (low, high) = _bins(z[view]), bounds[view]
                out[f"{other}_label"] = np.where((b <= low) & (z[view] < -2), 0.0, np.where((b >= high) & (z[view] > 2), 1.0, np.nan))
            out = out[out["text_label"].notna() | out["page_label"].notna()].copy()
            out.loc[out["text_label"].isna(), "bag"] = None                        # the metadata view needs no words
            for c in ("text_label", "page_label"):
                out[c] = out[c].astype("Float64")
            yield out

    return stored(pool.select("bag", "plain").mapInPandas(label, "bag binary, plain array<double>, text_label double, page_label double"))


def _passed_words(passed: DataFrame) -> tuple[np.ndarray, float, float]:
    """Bucket counts of all documents passed to the text view, and how many bad and good ones there are."""
    rows = passed.where("text_label is not null").select("bag", "text_label")

    def count(frames):
        held = np.zeros((2, BUCKETS), np.int64)
        for frame in frames:
            held += bucket_counts([np.frombuffer(b, np.int32) for b in frame["bag"]], frame["text_label"].to_numpy() > 0)
        some = np.flatnonzero(held.any(axis=0))
        yield pd.DataFrame({"bucket": some, "bad": held[0][some], "good": held[1][some]})

    got = (rows.coalesce(SUMS).mapInPandas(count, "bucket int, bad long, good long").groupBy("bucket")
           .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas())
    counts = np.zeros((2, BUCKETS))
    counts[:, got["bucket"].to_numpy(np.int64)] = got[["bad", "good"]].to_numpy(np.float64).T
    n = {r["text_label"]: r["n"] for r in rows.groupBy("text_label").agg(F.count("*").alias("n")).collect()}
    return counts, float(n.get(0.0, 0)), float(n.get(1.0, 0))


def co_train(sample: pd.DataFrame, pool: DataFrame, rounds: int = ROUNDS) -> QualityModel:
    """Models from labelled rows (bag, plain, good), a fifth of which only calibrates, and all rows (bag, plain) of ``pool``."""
    good = sample["good"].to_numpy(bool)
    calibrate = np.random.default_rng(11).random(len(sample)) < 0.2
    teach = ~calibrate if not calibrate.all() else calibrate
    taught, y = sample[teach], good[teach].astype(float)
    bags = [np.frombuffer(b, np.int32) for b in taught["bag"]]
    own, rate = bucket_counts(bags, good[teach]), good[teach].mean()
    n0, n1 = float((y == 0).sum()), float(y.sum())
    words, passed, models = choose_words(own, n0, n1), None, {}
    for turn in range(rounds + 1):
        far = {"text": None, "page": None}
        if passed is not None:
            more, m0, m1 = _passed_words(passed)
            weight = min(1.0, len(taught) / max(m0 + m1, 1))
            words = choose_words(own + weight * more, n0 + weight * m0, n1 + weight * m1)
            words_of = shared(pool.sparkSession, words)
            far = {view: _summed(passed, view, _once(words_of)) for view in far}
        models = {view: Logistic().fit(_matrix(view, taught, words), y, 30.0, far[view], len(taught)) for view in far}
        if turn < rounds:
            passed = surest(pool, models, words, SURE_SHARE * (turn + 1), rate)
    held = np.flatnonzero(calibrate) if len(set(good[calibrate])) == 2 else np.arange(len(sample))
    y = good[held].astype(float)
    z = {view: models[view].logit(_matrix(view, sample.iloc[held], words))[:, None] for view in models}
    scales = {view: Logistic().fit(z[view], y, 1.0) for view in models}
    pair = np.column_stack([scales[view].logit(z[view]) for view in ("text", "page")])
    return QualityModel(words, models["text"], models["page"], scales["text"], scales["page"], Logistic().fit(pair, y, 1.0))


def fit(docs: DataFrame, labels: DataFrame, labelled_docs: int = LABELLED_DOCS) -> tuple[QualityModel | None, DataFrame]:
    """Co-trained model and the features (id, bag, plain, good) of all documents; no model without both classes.

    ``docs``: id, text, source, lang, n_chars; ``labels``: id, good (boolean). An id labelled twice teaches if its labels agree.
    An expected ``labelled_docs`` of the labelled documents teach; all unlabelled ones are the pool.
    """
    marks = (labels.where("id is not null and good is not null").groupBy("id")
             .agg(F.min("good").alias("good"), F.max("good").alias("_hi")).where("good = _hi").drop("_hi"))
    marks, n_marks = small_enough(marks)
    features = docs.select("id", "text", "source", "lang", "n_chars").mapInPandas(_feature_rows, "id long, bag binary, plain array<double>")
    table = stored(features.join(marks, "id", "left"))
    if not n_marks:
        return None, table
    draw = F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(1_000_003)) < 1_000_003 * labelled_docs / n_marks
    got = table.where(F.col("good").isNotNull() & draw).select("bag", "plain", "good").toPandas()
    if got["good"].nunique() < 2:
        return None, table
    order = np.argsort([zlib.crc32(b) for b in got["bag"]], kind="stable")       # independent of the order of arrival
    return co_train(got.iloc[order].reset_index(drop=True), table.where("good is null").select("bag", "plain")), table


_SCORES = "id long, text_score double, page_score double, quality double, keep boolean"


def _score(model_of):
    def run(frames):
        model = model_of()
        for frame in frames:
            if model is None:
                half = np.full(len(frame), 0.5)
                text = page = quality = half
            else:
                text = model.text_scale.logit(model.text.logit(_matrix("text", frame, model.words))[:, None])
                page = model.page_scale.logit(model.page.logit(_matrix("page", frame, None))[:, None])
                quality = _sigmoid(model.both.logit(np.column_stack([text, page])))
                text, page = _sigmoid(text), _sigmoid(page)
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "text_score": text, "page_score": page, "quality": quality, "keep": quality >= 0.5})
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   lang_col: str = "lang", size_col: str = "n_chars") -> DataFrame:
    """(id, text_score, page_score, quality, keep) of every row; ``labels`` holds id, quality 0/1 and toxic 0/1."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(size_col).cast("double").alias("n_chars"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    model, features = fit(rows, marks)
    return features.select("id", "bag", "plain").mapInPandas(_score(shared(docs.sparkSession, model)), _SCORES)
