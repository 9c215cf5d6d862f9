"""Language identification with one interpolated Kneser-Ney character model per language.

Fit: a bounded sample of labelled documents per language gives word counts;
for each language the character n-grams of orders 1 to ``ORDER`` are counted
over words padded with start marks and closed by an end mark. The highest order uses counts,
lower orders the number of distinct left neighbours (continuation counts);
absolute discounts come from the counts of counts. All languages share one
table per order: n-gram hashes in ascending order with two columns per
language, the discounted probability and the weight the n-gram passes on when
it serves as context.

Predict: every word of a text costs ``-log2 p`` in every language, summed over
the whole text and divided by the number of symbols; the lowest cross-entropy
wins. A word's cost depends on the word alone, so it is worked out once for
each distinct word that a task holds and looked up for all others.

Calibration, on labelled documents kept out of the fit (a language of which
half are fewer than ``FIT_DOCS`` is calibrated with a model of that half, then
fitted again on all, so that none is lost): a temperature turns
cross-entropy differences into a probability (``score``), and each language's
upper bound of cross-entropy by class of length, wider for short texts, decides
which texts are rejected as no text of that language. The bounds come from
median and quartiles of the documents that the models give their own label, so
mislabelled and garbage documents among them do not move the bounds.

Null texts and texts without letters are ``und`` with score 0 and rejected;
rows with a null language do not teach; equal cross-entropies go to the
alphabetically first language; an empty table, or one without labels, makes
every row ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.common import batches, mix, odd_multipliers, shared

ORDER = 5
FIT_DOCS = 3000             # expected documents of each language that the models are counted on
CALIBRATION_DOCS = 800      # expected documents of each language that the calibration looks at
HELD_WORDS = 150_000        # distinct words whose costs a task keeps
CHARACTERS = 500_000        # scored at a time
SHORT_SLACK = 8.0           # bits by which one symbol's text may exceed its language's bound; falls with the root of the length
LENGTHS = np.array([64, 512])   # symbols at which a class of length with a bound of its own begins
SPREADS, LEAST_SPREAD = 4, 0.25   # bound above the median, in interquartile ranges of that many bits at least
ENOUGH = 30                 # documents below which a class takes its language's figures, and a language all languages' spread
START, END = 1, 2
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class LanguageModels:
    """Sorted hash arrays of all orders, their values by language, and the calibration."""

    languages: list[str]
    hashes: list[np.ndarray]            # by order 1..ORDER, ascending
    value: list[np.ndarray]             # discounted probability of the n-gram, rows as hashes
    passes: list[np.ndarray]            # weight handed to the lower order when the n-gram is the context
    base: np.ndarray                    # by language: weight of the uniform distribution below the unigrams
    symbols: int
    temperature: float = 1.0
    ceiling: np.ndarray | None = None   # by language and class of length: highest accepted cross-entropy


def _padded(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with start and end marks; the places that are predicted; each place's word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(3)
    pad = order - 1
    width = lengths + pad + 1
    starts = np.cumsum(width) - width
    out = np.full(int(width.sum()), START, np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    within = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[starts[owner] + pad + within] = chars
    out[starts + width - 1] = END
    predicted = np.ones(len(out), bool)
    for j in range(pad):
        predicted[starts + j] = False
    return out, np.flatnonzero(predicted), np.repeat(np.arange(len(words)), lengths + 1)


def _gram_hashes(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k symbols that end at each place (meaningless before place k - 1)."""
    multipliers = odd_multipliers(order, seed=31)
    total, out = np.zeros(len(symbols), np.uint64), []
    for k in range(order):
        shifted = np.roll(symbols, k)
        total = total + (shifted + np.uint64(1)) * multipliers[k]
        out.append(mix(total + np.uint64(k + 1)))
    return out


def fit_language(words: list[str], counts: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, ...]]:
    """By order: n-gram hashes with discounted probability, and context hashes with the weight they pass on."""
    symbols, at, owner = _padded(words, order)
    grams = _gram_hashes(symbols, order)
    empty = mix(np.zeros(1, np.uint64))[0]
    weight = np.asarray(counts, np.float64)[owner]
    levels = []
    for k in range(order, 0, -1):
        keys, first, inverse = np.unique(grams[k - 1][at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight) if k == order else np.bincount(inverse)
        at = at[first]
        context = grams[k - 2][at - 1] if k > 1 else np.full(len(at), empty)
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        contexts, which = np.unique(context, return_inverse=True)
        total, types = np.bincount(which, count), np.bincount(which)
        levels.append((keys, np.maximum(count - discount, 0) / total[which], contexts, discount * types / total))
        # the next lower order counts distinct left neighbours: each type counts once
    return levels[::-1]


def _word_counts(docs: DataFrame) -> DataFrame:
    def count(frames):
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                tally = Counter()
                for text in texts:
                    tally.update(_WORD.findall(text.lower()))
                yield pd.DataFrame({"lang": lang, "word": list(tally), "n": list(tally.values())})
    return docs.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _fitted(sample: DataFrame) -> pd.DataFrame:
    return (_word_counts(sample.select("lang", "text")).groupBy("lang")
            .applyInPandas(_fit_group, "lang string, k int, keys binary, value binary, contexts binary, passes binary").toPandas())


def _fit_group(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("word")
    rows = []
    for k, (keys, value, contexts, passes) in enumerate(fit_language(list(frame["word"]), frame["n"].to_numpy()), 1):
        rows.append((frame["lang"].iloc[0], k, keys.tobytes(), value.astype(np.float64).tobytes(), contexts.tobytes(),
                     passes.astype(np.float64).tobytes()))
    return pd.DataFrame(rows, columns=["lang", "k", "keys", "value", "contexts", "passes"])


def _joined(fitted: pd.DataFrame, order: int) -> LanguageModels:
    """All languages' models in shared sorted arrays."""
    languages = sorted(fitted["lang"].unique())
    column = {lang: i for i, lang in enumerate(languages)}
    parts = {(r.lang, r.k): (np.frombuffer(r.keys, np.uint64), np.frombuffer(r.value), np.frombuffer(r.contexts, np.uint64),
                             np.frombuffer(r.passes)) for r in fitted.itertuples()}
    hashes, values, passed = [], [], []
    base = np.ones(len(languages))
    for k in range(1, order + 1):
        pieces = [parts[lang, k][0] for lang in languages]
        if k < order:
            pieces += [parts[lang, k + 1][2] for lang in languages]
        known = np.unique(np.concatenate(pieces))
        value, gives = np.zeros((len(known), len(languages)), np.float32), np.ones((len(known), len(languages)), np.float32)
        for lang in languages:
            keys, p, _, _ = parts[lang, k]
            value[np.searchsorted(known, keys), column[lang]] = p
            if k < order:
                _, _, contexts, q = parts[lang, k + 1]
                gives[np.searchsorted(known, contexts), column[lang]] = q
            if k == 1:
                base[column[lang]] = parts[lang, 1][3][0]
        hashes.append(known)
        values.append(value)
        passed.append(gives)
    return LanguageModels(languages, hashes, values, passed, base, len(hashes[0]) + 1)


def word_costs(models: LanguageModels, words: list[str]) -> np.ndarray:
    """(words, languages + 1): bits of each word in each language, and its number of symbols (end mark included)."""
    order = len(models.hashes)
    symbols, at, owner = _padded(words, order)
    grams = _gram_hashes(symbols, order)
    p = np.tile(models.base / models.symbols, (len(at), 1))
    above = None
    for k in range(1, order + 1):
        known = models.hashes[k - 1]
        wanted = grams[k - 1]
        place = np.searchsorted(known, wanted)
        place[place == len(known)] = 0
        hit = known[place] == wanted
        if k > 1:
            before = above[0][at - 1], above[1][at - 1]
            p *= np.where(before[1][:, None], models.passes[k - 2][before[0]], 1)
        p += np.where(hit[at][:, None], models.value[k - 1][place[at]], 0)
        above = place, hit
    bits = -np.log2(p)
    ends = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.column_stack([np.add.reduceat(bits, ends, axis=0), np.bincount(owner)])


class _Codes(dict):
    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word):
        self.fresh.append(word)
        code = self[word] = len(self)
        return code


class Scorer:
    """Cross-entropies of texts; keeps the costs of words met lately."""

    def __init__(self, models: LanguageModels):
        self.models, self.codes = models, _Codes()
        self.costs = np.empty((0, len(models.languages) + 1))

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits for each symbol, infinite for texts without letters; number of symbols."""
        parts = [self._entropies(part) for part in batches(iter(texts), lambda t: len(t or "") + 20, CHARACTERS)]
        if not parts:
            return np.empty((0, len(self.models.languages))), np.empty(0)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        lists = [[w for w in _WORD.findall(t.lower())] if t else [] for t in texts]
        if len(self.codes) > HELD_WORDS:
            self.codes, self.costs = _Codes(), self.costs[:0]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        codes = np.fromiter((self.codes[w] for words in lists for w in words), np.int64, int(lengths.sum()))
        if self.codes.fresh:
            self.costs = np.concatenate([self.costs, word_costs(self.models, self.codes.fresh)])
            letters = np.array([any(map(str.isalpha, w)) for w in self.codes.fresh])
            self.costs[len(self.costs) - len(letters):][~letters] = 0       # numerals that count as word characters
            self.codes.fresh = []
        total = np.zeros((len(texts), self.costs.shape[1]))
        some = lengths > 0
        if some.any():
            total[some] = np.add.reduceat(self.costs[codes], (np.cumsum(lengths) - lengths)[some], axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(total[:, -1:] > 0, total[:, :-1] / total[:, -1:], np.inf), total[:, -1]


def _posterior(entropies: np.ndarray, temperature: float) -> np.ndarray:
    z = -(entropies - entropies.min(axis=1, keepdims=True)) * temperature
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _entropy_rows(models_of):
    def run(frames):
        scorer = Scorer(models_of())
        for frame in frames:
            h, symbols = scorer.entropies(list(frame["text"]))
            yield pd.DataFrame({"lang": frame["lang"], "h": list(h), "symbols": symbols})
    return run


def ceilings(h: np.ndarray, truth: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Highest accepted cross-entropy by language and class of length; infinite where no document is given its label."""
    agreed, low = h.argmin(axis=1) == truth, h[np.arange(len(h)), truth]
    kind = np.digitize(symbols, LENGTHS)
    quartiles = lambda x: (np.median(x), np.subtract(*np.quantile(x, [0.75, 0.25])))
    out = np.full((h.shape[1], len(LENGTHS) + 1), np.inf)
    usual = np.median([quartiles(low[agreed & (truth == i)])[1] for i in np.unique(truth[agreed])]) if agreed.any() else 0.0
    for i in np.unique(truth[agreed]):
        own = agreed & (truth == i)
        middle, spread = quartiles(low[own])
        if own.sum() < ENOUGH:
            spread = max(spread, usual)
        out[i] = middle + SPREADS * max(spread, LEAST_SPREAD)
        for c in range(out.shape[1]):
            some = own & (kind == c)
            if some.sum() >= ENOUGH:
                middle, spread = quartiles(low[some])
                out[i, c] = middle + SPREADS * max(spread, LEAST_SPREAD)
    return out


def fit(docs: DataFrame, may_teach: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_docs: int = FIT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> LanguageModels | None:
    """Models and calibration from the rows of ``docs`` that ``may_teach`` allows; None without labelled rows.

    The fit reads an expected ``fit_docs`` documents of each language, all if
    it has no more, drawn by a hash of the id. Calibration reads an expected
    ``calibration_docs`` that the models it judges by were not fitted on; a
    language of which all are too few for both keeps an open bound.
    """
    labelled = docs.where(may_teach & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1_000_003)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = lambda most: F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, most / n * 1_000_003)])[F.col("lang")]
    half = lambda parity: (F.col("draw") % 2 == parity)
    fitted = _fitted(rows.where(half(0) & (F.col("draw") < 2 * rate(fit_docs))))
    small = [lang for lang, n in sizes.items() if n < 2 * fit_docs]         # half of the documents are not enough
    final = fitted
    if small:
        again = _fitted(rows.where(F.col("lang").isin(small) & (F.col("draw") < rate(fit_docs))))
        final = pd.concat([fitted[~fitted["lang"].isin(again["lang"])], again], ignore_index=True)
    if final.empty:
        return None
    models = _joined(final, ORDER)
    if fitted.empty:
        models.ceiling = np.full((len(models.languages), len(LENGTHS) + 1), np.inf)
        return models
    first = _joined(fitted, ORDER) if small else models
    _calibrate(first, rows.where(half(1) & (F.col("draw") < 2 * rate(calibration_docs))))
    models.temperature = first.temperature
    bounds = dict(zip(first.languages, first.ceiling, strict=True))
    models.ceiling = np.stack([bounds.get(lang, np.full(len(LENGTHS) + 1, np.inf)) for lang in models.languages])
    return models


def _calibrate(models: LanguageModels, rows: DataFrame) -> None:
    """Temperature and bounds from labelled rows that ``models`` were not fitted on."""
    seen = (rows.select("lang", "text")
            .mapInPandas(_entropy_rows(shared(rows.sparkSession, models)), "lang string, h array<double>, symbols double").toPandas())
    models.ceiling = np.full((len(models.languages), len(LENGTHS) + 1), np.inf)
    seen = seen[seen["lang"].isin(models.languages) & (seen["symbols"] > 0)]
    if len(seen):
        h = np.stack(seen["h"].to_numpy())
        truth = np.array([models.languages.index(x) for x in seen["lang"]])
        grid = 2.0 ** np.arange(-2, 7)
        losses = [-np.log(_posterior(h, t)[np.arange(len(h)), truth] + 1e-12).mean() for t in grid]
        models.temperature = float(grid[int(np.argmin(losses))])
        models.ceiling = ceilings(h, truth, seen["symbols"].to_numpy())


OUTPUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("bits", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def predictor(spark, models: LanguageModels | None):
    """Column function: text to (lang_pred, score, bits per symbol, accepted)."""
    models_of = shared(spark, models)

    @F.pandas_udf(OUTPUT)
    def predict(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = models_of()
        scorer = Scorer(m) if m else None
        for series in column:
            pred, score, bits, good = [], [], [], []
            for texts in batches(iter(series.to_list()), lambda t: len(t or "") + 20, 2_000_000):
                if m is None:
                    pred, score, bits, good = (x + [y] * len(texts) for x, y in ((pred, "und"), (score, 0.0), (bits, None), (good, False)))
                    continue
                h, symbols = scorer.entropies(texts)
                known = symbols > 0
                best = np.argmin(h, axis=1)
                low = h[np.arange(len(h)), best]
                h[~known] = 0
                pred += list(np.where(known, np.array(m.languages, dtype=object)[best], "und"))
                score += list(np.where(known, _posterior(h, m.temperature).max(axis=1), 0.0))
                bits += list(np.where(known, low, np.nan))
                good += list(known & (low <= m.ceiling[best, np.digitize(symbols, LENGTHS)] + SHORT_SLACK / np.sqrt(np.maximum(symbols, 1))))
            yield pd.DataFrame({"lang_pred": pred, "score": score, "bits": bits, "accepted": good})

    return predict


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves ``rest`` modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == rest


def accepted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is accepted as one of the learned languages, columns unchanged."""
    models = fit(docs, F.lit(True), id_col, text_col, lang_col)
    return docs.where(predictor(docs.sparkSession, models)(F.col(text_col))["accepted"])
