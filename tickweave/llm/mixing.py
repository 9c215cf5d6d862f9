"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, DataFrame functions only.

Documents are counted into cells (source, language, topic) of token mass. Each
round of raking scales the cells so that one dimension after the other meets
its target shares. A cell's ratio of raked to own mass, divided by the largest
ratio, is the probability with which each of its documents is kept: the
expected token shares of the sample are the raked ones, and the cell that is
wanted most keeps everything. The draw is a hash of the id, so a document's
fate is the same in every run.

A null in a dimension is a value of its own; null and empty texts weigh
nothing and are kept with their cell's probability (1 where a cell has no
mass); repeated rows share their fate; cells that do not occur stay empty, so
targets that need them are met as nearly as raking can; no rows give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import set_apart, stored

ROUNDS = 10
ONE_TASK_CELLS = 100_000     # so many cells are raked in one task without shuffles; more are shuffled by dimension
TEMPERATURES = {"source": 0.7, "lang": 0.9, "topic": 0.9}
# Topic of a text: the first marker that it contains.
TOPICS = [("table", " | "), ("web", "http"), ("contact", "@"), ("legal", "icense")]


def topic(text: Column) -> Column:
    return reduce(lambda rest, rule: F.when(text.contains(rule[1]), rule[0]).otherwise(rest), reversed(TOPICS), F.lit("prose"))


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\x0B\f]+")), F.lit(0)).cast("long")


def tempered_targets(cells: DataFrame, dimension: str, temperature: float, mass: str = "mass") -> DataFrame:
    """(dimension, target): the shares of token mass raised to ``temperature`` and normalised; 1 keeps them, 0 makes them equal."""
    sums = cells.groupBy(dimension).agg(F.sum(mass).alias("_m")).where("_m > 0")
    share = sums.withColumn("_p", F.pow(F.col("_m").cast("double"), F.lit(temperature)))
    total = share.agg(F.sum("_p").alias("_all"))
    return share.crossJoin(total).select(dimension, (F.col("_p") / F.col("_all")).alias("target"))    # one-row side


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, mass) with ``weight``: shares whose sums by each dimension approach its ``targets``."""
    total = cells.agg(F.sum("mass").alias("_total"))
    out = cells.crossJoin(total).withColumn("weight", F.col("mass") / F.col("_total")).drop("_total")
    for dimension, table in targets.items():
        named = table.select(F.col(dimension).alias("_value"), F.col("target").alias(f"_target_{dimension}"))
        out = out.join(named, F.col(dimension).eqNullSafe(F.col("_value")), "left").drop("_value")
    out = stored(out)
    if out.count() <= ONE_TASK_CELLS:
        out = out.coalesce(1)
    for done in range(1, rounds + 1):
        for dimension in targets:
            own = F.sum("weight").over(Window.partitionBy(dimension))
            out = out.withColumn("weight", F.when(own > 0, F.col("weight") * F.coalesce(f"_target_{dimension}", F.lit(0.0)) / own)
                                 .otherwise(F.col("weight")))
        if done % 5 == 0:
            out = stored(out)
            out = out.coalesce(1) if done < rounds and out.count() <= ONE_TASK_CELLS else out
    return out.drop(*[f"_target_{d}" for d in targets])


def keep_probabilities(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """(dimensions, mass, weight, probability): raked cells and the chance with which their documents are kept."""
    raked = rake(cells, targets, rounds)
    ratio = raked.withColumn("_ratio", F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")))
    top = ratio.agg(F.max("_ratio").alias("_top"))
    return (ratio.crossJoin(top).withColumn("probability", F.coalesce(F.col("_ratio") / F.col("_top"), F.lit(1.0)))
            .drop("_ratio", "_top"))


def draw(id_col: str, seed: str = "mix") -> Column:
    """Number in [0, 1) that depends on the id (null: empty) and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def _with_cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> dict[str, Column]:
    return {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic(F.coalesce(F.col(text_col), F.lit("")))}


def _matched(rows: DataFrame, probabilities: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    cells = stored(probabilities.select(*[F.col(d).alias(f"_cell_{d}") for d in dimensions], F.col("probability").alias("_keep_p")))
    few = cells.count() <= ONE_TASK_CELLS
    match = reduce(lambda x, y: x & y, [c.eqNullSafe(F.col(f"_cell_{d}")) for d, c in dimensions.items()])
    return rows.join(F.broadcast(cells) if few else cells, match).drop(*[f"_cell_{d}" for d in dimensions])


def _probabilities(digest: DataFrame, temperatures: dict[str, float], rounds: int) -> DataFrame:
    cells = stored(digest.groupBy(*temperatures).agg(F.sum("n_tokens").alias("mass")))
    return keep_probabilities(cells, {d: tempered_targets(cells, d, t) for d, t in temperatures.items()}, rounds)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
          temperatures: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, source, lang, topic, n_tokens, probability, kept) for every row of ``docs``."""
    digest = stored(docs.select(F.col(id_col).alias("id"), *[c.alias(d) for d, c in _with_cells(docs, text_col, source_col, lang_col).items()],
                                token_count(F.col(text_col)).alias("n_tokens")))
    temperatures = temperatures or TEMPERATURES
    probabilities = _probabilities(digest, temperatures, rounds)
    out = _matched(digest, probabilities, {d: F.col(d) for d in temperatures})
    return out.select("id", "source", "lang", "topic", "n_tokens", F.col("_keep_p").alias("probability"),
                      (draw("id") < F.col("_keep_p")).alias("kept"))


def sampled_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                    temperatures: dict[str, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, columns unchanged."""
    dimensions = _with_cells(docs, text_col, source_col, lang_col)
    digest = docs.select(*[c.alias(d) for d, c in dimensions.items()], token_count(F.col(text_col)).alias("n_tokens"))
    probabilities = _probabilities(digest, temperatures or TEMPERATURES, rounds)
    apart, back = set_apart(docs, drawn_id=F.col(id_col), **dimensions)
    return back(_matched(apart, probabilities, {d: F.col(d) for d in dimensions}).where(draw("drawn_id") < F.col("_keep_p")))


def oracle(rounds: int = ROUNDS) -> str:
    """The same result as one SQL statement, rounds unrolled."""
    rules = " ".join(f"WHEN contains(t, '{mark}') THEN '{name}'" for name, mark in TOPICS)
    steps, last = [], "w0"
    for i in range(rounds):
        for dimension in TEMPERATURES:
            name = f"w_{i}_{dimension}"
            steps.append(f"{name} AS (SELECT source, lang, topic, mass, w * p_{dimension} / sum(w) OVER (PARTITION BY {dimension}) AS w, "
                         f"p_source, p_lang, p_topic FROM {last})")
            last = name
    marginals = ", ".join(f"m_{d} AS (SELECT {d}, power(sum(mass), {t}) / sum(power(sum(mass), {t})) OVER () AS p_{d} FROM cells GROUP BY {d})"
                          for d, t in TEMPERATURES.items())
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
digest AS (SELECT doc_id, source, lang, CASE {rules} ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(t, '[^ \\t\\n\\r\\x0B\\f]+')) AS BIGINT) AS n_tokens FROM d),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM digest GROUP BY ALL),
{marginals},
w0 AS (SELECT c.*, c.mass / sum(c.mass) OVER () AS w, p_source, p_lang, p_topic
  FROM cells c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)),
{", ".join(steps)},
p AS (SELECT source, lang, topic, (w / mass) / max(w / mass) OVER () AS probability FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 9) AS probability,
  CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < probability AS kept
FROM digest JOIN p USING (source, lang, topic)"""
