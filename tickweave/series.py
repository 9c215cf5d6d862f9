"""Ordered series spread over many tasks.

Every order-dependent operator of this package runs on a ``Series``: a frame
range-partitioned by (keys, order), so that one very long key is split over
many partitions, frozen by a checkpoint, and numbered from zero inside each
key. On top of that layout there are four ways to compute:

* ``windowed``  bounded row frames: fixed-length chunks of positions plus the
  few neighbour rows a frame reaches into (one hash shuffle);
* ``running``   unbounded frames: per-chunk partials, a prefix over the small
  table of chunk totals, and the chunk-local frame;
* ``fold``      recurrences with resets, run per partition from a guessed
  state and repaired until every hand-over state is the true one;
* ``relay``     recurrences whose state follows from all earlier rows: runs of
  positions are stored apart and the state is handed from run to run, all
  keys side by side, each run read once;
* ``per_chunk`` vectorised numpy over chunk plus neighbours.

No task ever holds a whole key.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.session import checkpoint_folder, settle, stored

MAX_CHUNK_ROWS = 1 << 20
MIN_CHUNK_ROWS = 1 << 10
BROADCAST_SPAN_LIMIT = 200_000
FREE_REPAIR_ROUNDS = 6
RELAY_ROWS = 1 << 20        # rows of a key that one step of a relay works on
SMALL_EXIT_BYTES = 4096     # longer descriptions of a partition stay in storage


def _count_and_total(spans: DataFrame) -> tuple[int, int]:
    row = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def fit_chunk_rows(total: int, slots: int) -> int:
    """Chunk length: about four chunks per task slot, within fixed bounds."""
    return int(min(MAX_CHUNK_ROWS, max(MIN_CHUNK_ROWS, total // max(1, 4 * slots))))


@dataclass(frozen=True)
class Series:
    """A laid-out frame. ``df`` has ``_pos`` (0-based in its key)."""

    df: DataFrame
    laid: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    total: int
    chunk_rows: int
    span_count: int  # (key, partition) pairs: never fewer than the number of keys

    # -- shape ---------------------------------------------------------
    def derive(self, df: DataFrame) -> "Series":
        """The same series with other columns; rows and ``_pos`` must be unchanged.

        ``fold`` reads the layout itself, so it only sees columns added by
        ``with_columns``.
        """
        return replace(self, df=df)

    def with_columns(self, columns: dict[str, Column]) -> "Series":
        return replace(self, df=self.df.withColumns(columns), laid=self.laid.withColumns(columns))

    def attach(self, df: DataFrame, per_key: DataFrame, how: str = "inner") -> DataFrame:
        """Join a table with one row per key.

        It is broadcast when the layout has shown the number of keys to be
        small, so rows of a hot key stay where they are.
        """
        if not self.keys:
            return df.crossJoin(F.broadcast(per_key))  # one row
        small = F.broadcast(per_key) if self.span_count <= BROADCAST_SPAN_LIMIT else per_key
        return df.join(small, list(self.keys), how)

    def lengths(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))

    def with_length(self) -> "Series":
        """Add ``_n``, the number of rows of the key."""
        if not self.keys:
            return self.derive(self.df.withColumn("_n", F.lit(self.total).cast("long")))
        return self.derive(self.attach(self.df, self.lengths()))

    # -- bounded frames ------------------------------------------------
    def chunked(self, before: int = 0, after: int = 0, rows: int | None = None) -> DataFrame:
        """Rows copied into each chunk that needs them; ``_home`` marks the owner."""
        size = max(rows or self.chunk_rows, before, after, 1)
        home = F.floor(F.col("_pos") / F.lit(size)).cast("long")
        offset = F.col("_pos") % F.lit(size)
        df = self.df.withColumn("_home", home)
        if not before and not after:
            return df.withColumn("_chunk", F.col("_home"))
        targets = [F.col("_home")]
        if before:
            targets.append(F.when(offset >= size - before, F.col("_home") + 1))
        if after:
            targets.append(F.when((offset < after) & (F.col("_home") > 0), F.col("_home") - 1))
        return df.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))

    def chunk_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy("_pos")

    def windowed(self, build: Callable[[DataFrame, WindowSpec], DataFrame],
                 before: int = 0, after: int = 0) -> DataFrame:
        """Apply ``build(df, window)``; frames may reach ``before``/``after`` rows away."""
        spread = self.chunked(before, after)
        done = build(spread, self.chunk_window())
        return done.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")

    # -- unbounded frames ----------------------------------------------
    def running(self, specs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
        """Running ``sum``/``min``/``max``/``last`` (non-null) from the key's first row."""
        base = self.chunked()
        named = {f"_in_{name}": value for name, (_, value) in specs.items()}
        base = base.withColumns(named)
        totals, carries = [], {}
        by_chunk = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        for name, (kind, _) in specs.items():
            value = F.col(f"_in_{name}")
            if kind == "last":
                # max_by skips null orderings, so only non-null values compete
                totals.append(F.max_by(value, F.when(value.isNotNull(), F.col("_pos"))).alias(f"_t_{name}"))
                carries[f"_c_{name}"] = F.last(f"_t_{name}", ignorenulls=True).over(by_chunk)
            else:
                fn = getattr(F, kind)
                totals.append(fn(value).alias(f"_t_{name}"))
                carries[f"_c_{name}"] = fn(f"_t_{name}").over(by_chunk)
        carry = (base.groupBy(*self.keys, "_chunk").agg(*totals).withColumns(carries)
                 .drop(*[f"_t_{name}" for name in specs]))
        joined = base.join(carry, [*self.keys, "_chunk"])
        frame = self.chunk_window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = {}
        for name, (kind, _) in specs.items():
            value, before = F.col(f"_in_{name}"), F.col(f"_c_{name}")
            if kind == "last":
                out[name] = F.coalesce(F.last(value, ignorenulls=True).over(frame), before)
            elif kind == "sum":
                local = F.sum(value).over(frame)
                out[name] = F.when(local.isNull(), before).otherwise(
                    local + F.coalesce(before, F.lit(0)))
            else:
                pick = F.least if kind == "min" else F.greatest
                out[name] = pick(getattr(F, kind)(value).over(frame), before)
        return joined.withColumns(out).drop(
            "_home", "_chunk", *named, *[f"_c_{name}" for name in specs])

    # -- numpy over a chunk ----------------------------------------------
    def per_chunk(self, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str],
                  schema: str, before: int = 0, after: int = 0, rows: int | None = None) -> DataFrame:
        """Run ``fn`` on each chunk (sorted, with neighbours and ``_home`` mask as ``_own``).

        ``fn`` returns one row per input row it wants to emit. The group size
        is the chunk length plus the neighbours, never the length of a key.
        """
        spread = self.chunked(before, after, rows).select(
            *self.keys, *columns, "_pos", "_chunk", (F.col("_home") == F.col("_chunk")).alias("_own"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return fn(pdf.sort_values("_pos", kind="stable").reset_index(drop=True))

        return spread.groupBy(*self.keys, "_chunk").applyInPandas(run, schema)

    # -- recurrences ---------------------------------------------------
    def fold(self, kernel: Callable, start: tuple, columns: Sequence[str],
             outputs: dict[str, str], keep: Sequence[str] = (),
             exits: Callable | None = None) -> DataFrame:
        """Run a reset recurrence over every key and return its per-row outputs.

        ``exits(arrays)``, for kernels with one number of state, describes all
        rows of one key in one partition without knowing the state they start
        from: a function of that state that gives state and hits at the end
        (see ``bars.AmountExits``). Then the hand-over states of all partitions
        follow from these descriptions, and the layout is read twice whatever
        the number of partitions.

        ``kernel(state, fresh, arrays) -> (state, dict of output arrays)``
        processes consecutive rows of one key; ``fresh`` tells that the first
        row is the key's first. ``_hits`` in the outputs (0/1) is counted and
        returned as ``_seq``: the number of hits of the key before the row.
        """
        keys = list(self.keys)
        tag = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]) \
            if keys else F.lit("")
        laid = self.laid.withColumns({"_tag": tag, "_part": F.spark_partition_id()})
        width = len(start)
        probe_cols = list(dict.fromkeys(columns))

        def segments(batches: Iterator[pd.DataFrame], given: dict):
            """Yield (pdf slice, key tag, part, state before, fresh) keeping state across batches."""
            state, tag_now, first, hits = tuple(start), None, True, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                tags = pdf["_tag"].to_numpy()
                cuts = np.flatnonzero(tags[1:] != tags[:-1]) + 1
                for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(tags)]):
                    piece = pdf.iloc[lo:hi]
                    part = int(piece["_part"].iloc[0])
                    fresh = False
                    if tag_now is None:
                        carried = given.get(part)
                        state, hits = (tuple(start), 0) if carried is None else (carried[0], carried[1])
                        fresh = carried is None
                    elif tags[lo] != tag_now:
                        state, hits, first, fresh = tuple(start), 0, False, True
                    tag_now = tags[lo]
                    arrays = {c: piece[c].to_numpy() for c in probe_cols}
                    state, made = kernel(state, fresh, arrays)
                    made_hits = made.get("_hits")
                    seq = None
                    if made_hits is not None:
                        run = np.cumsum(made_hits)
                        seq = hits + run - made_hits
                        hits += int(run[-1])
                    yield piece, made, seq, part, tag_now, state, hits, first

        def probe(given: dict):
            def run(batches):
                first_tag = None
                last = None
                for _, _, _, part, tag_now, state, hits, first in segments(batches, given):
                    first_tag = tag_now if first_tag is None else first_tag
                    last = (part, first_tag, tag_now, list(map(float, state)), hits, first)
                if last is not None:
                    yield pd.DataFrame([last], columns=["part", "first_tag", "last_tag", "state", "hits", "single"])
            return run

        probe_schema = "part int, first_tag string, last_tag string, state array<double>, hits long, single boolean"
        thin = laid.select("_tag", "_part", *probe_cols)

        def describe(batches):
            held: dict[str, list] = {}
            part = None
            for pdf in batches:
                if not len(pdf):
                    continue
                part = int(pdf["_part"].iloc[0])
                tags = pdf["_tag"].to_numpy()
                cuts = np.flatnonzero(tags[1:] != tags[:-1]) + 1
                for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(tags)]):
                    if tags[lo] not in held:
                        held = {t: [] for t in list(held)[:1]}      # only the last key reaches over the border; of the first, the name counts
                    held.setdefault(tags[lo], []).append({c: pdf[c].to_numpy()[lo:hi] for c in probe_cols})
            if held:
                end = exits({c: np.concatenate([a[c] for a in list(held.values())[-1]]) for c in probe_cols})
                state, hits = end(start[0])
                yield pd.DataFrame([(part, list(held)[0], list(held)[-1], len(held) == 1, state, hits, end.total, pickle.dumps(end.packed()))],
                                   columns=["part", "first_tag", "last_tag", "single", "state", "hits", "total", "exit"])

        def described() -> dict:
            """One row per partition, states handed on from partition to partition by the described functions.

            A partition is looked into only where a state comes in that makes a hit in it. Long descriptions stay in
            storage and are fetched one at a time.
            """
            table = stored(thin.mapInPandas(describe, "part int, first_tag string, last_tag string, single boolean, state double, "
                                                      "hits long, total double, exit binary"))
            rows = table.withColumn("exit", F.when(F.length("exit") <= SMALL_EXIT_BYTES, F.col("exit"))).collect()

            def left(part: int, held: bytes | None, state: float) -> tuple[float, int]:
                if held is None:
                    held = table.filter(F.col("part") == part).select("exit").first()[0]
                return exits.unpacked(pickle.loads(held))(state)

            done, before = {}, None
            for row in sorted(rows, key=lambda r: r.part):
                state, hits = row.state, row.hits
                if row.single and before is not None and before.last_tag == row.first_tag and before.state[0] != start[0]:
                    entry = before.state[0]
                    state, hits = (entry + row.total, 0) if exits.untouched(entry, row.total) else left(row.part, row.exit, entry)
                before = done[row.part] = SimpleNamespace(part=row.part, first_tag=row.first_tag, last_tag=row.last_tag,
                                                          state=[state], hits=hits, single=row.single)
            return done

        def summaries(given: dict, parts: list[int] | None) -> dict:
            source = thin if parts is None else thin.filter(F.col("_part").isin(parts))
            rows = source.mapInPandas(probe(given), probe_schema).collect()  # one row per partition
            return {r.part: r for r in rows}

        def same(a, b) -> bool:
            if a is None or b is None:
                return a is b
            return all(x == y or (x != x and y != y) for x, y in zip(a, b))

        used: dict[int, tuple | None] = {}
        known = described() if exits else summaries({}, None)
        for part in known:
            used[part] = None
        rounds = 0
        while not exits:
            wanted, previous = {}, None
            for part in sorted(known):
                row = known[part]
                wanted[part] = tuple(previous.state) if previous is not None and \
                    previous.last_tag == row.first_tag else None
                previous = row
            wrong = [p for p in sorted(known) if not same(wanted[p], used[p])]
            if not wrong:
                break
            rounds += 1
            if rounds > FREE_REPAIR_ROUNDS:
                return self.relay(kernel, start, columns, outputs, keep)    # guesses do not settle
            given = {p: (wanted[p], 0) for p in wrong if wanted[p] is not None}
            known.update(summaries(given, wrong))
            for p in wrong:
                used[p] = wanted[p]

        # true hand-over states and hit counts for every partition
        final, previous, base = {}, None, 0
        for part in sorted(known):
            row = known[part]
            if previous is not None and previous.last_tag == row.first_tag:
                final[part] = (tuple(previous.state), base)
                base = base + row.hits if row.single else row.hits
            else:
                base = row.hits
            previous = row

        names = [n for n in outputs if n != "_hits"]
        kept = [*keys, *[c for c in keep if c not in keys]]
        fields = [f for f in self.laid.select(*kept).schema.fields]
        schema = T.StructType(fields)
        made_fields = [f"{name} {outputs[name]}" for name in names]
        if "_hits" in outputs:
            made_fields += ["_hits int", "_seq long"]
        schema = T.StructType(schema.fields + T.StructType.fromDDL(", ".join(made_fields)).fields)

        def emit(batches):
            for piece, made, seq, *_ in segments(batches, final):
                out = piece[kept].reset_index(drop=True)
                for name in names:
                    out[name] = made[name]
                if seq is not None:
                    out["_hits"] = made["_hits"]
                    out["_seq"] = seq
                yield out

        return laid.select("_tag", "_part", *dict.fromkeys([*probe_cols, *kept])).mapInPandas(emit, schema)

    def relay(self, kernel: Callable, start: tuple, columns: Sequence[str], outputs: dict[str, str], keep: Sequence[str] = (),
              rows: int | None = None) -> DataFrame:
        """``fold`` for recurrences that never fall into step: the state passes from run to run of ``rows`` positions.

        The rows are stored once, in one folder for each run number. Step by step the next folder is read, each key's
        state is joined to its run, and outputs and new states are stored. Every row is read once, whatever the number
        of partitions; there are as many steps as the longest key has runs. The state may be anything that pickles.
        """
        keys, rows = list(self.keys) or ["_all"], rows or RELAY_ROWS
        probe_cols = list(dict.fromkeys(columns))
        kept = [*keys, *[c for c in keep if c not in keys]]
        base = self.df if self.keys else self.df.withColumn("_all", F.lit(0))
        wanted = base.select(*dict.fromkeys([*kept, *probe_cols, "_pos"]), F.floor(F.col("_pos") / rows).alias("_run"))
        spark = base.sparkSession
        folder = f"{checkpoint_folder(spark)}/relay-{uuid.uuid4().hex}"
        wanted.write.partitionBy("_run").parquet(f"{folder}/rows")
        stored_rows = spark.read.schema(wanted.schema).parquet(f"{folder}/rows")
        runs = (wanted.agg(F.max("_run")).first()[0] or 0) + 1
        names = [n for n in outputs if n != "_hits"]
        fields = list(wanted.select(*kept).schema.fields) + [T.StructField(n, T.StructType.fromDDL(f"x {outputs[n]}")[0].dataType) for n in names]
        if "_hits" in outputs:
            fields += T.StructType.fromDDL("_hits int, _seq long").fields
        schema = T.StructType([*fields, T.StructField("_handed", T.BinaryType())])
        columns_out = [f.name for f in schema]

        def advance(pdf: pd.DataFrame, handed: bytes | None) -> pd.DataFrame:
            pdf = pdf.sort_values("_pos", kind="stable").reset_index(drop=True)
            state, hits = (tuple(start), 0) if handed is None else pickle.loads(handed)
            state, made = kernel(state, handed is None, {c: pdf[c].to_numpy() for c in probe_cols})
            out = pdf[kept].copy()
            for n in names:
                out[n] = made[n]
            if "_hits" in outputs:
                out["_hits"], out["_seq"] = made["_hits"], hits + np.cumsum(made["_hits"]) - made["_hits"]
                hits += int(np.sum(made["_hits"]))
            out["_handed"] = pd.Series([None] * (len(out) - 1) + [pickle.dumps((state, hits)) if len(out) == rows else None], dtype=object)
            return out[columns_out]

        def first(pdf: pd.DataFrame) -> pd.DataFrame:
            return advance(pdf, None)

        def later(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            return advance(pdf, bytes(states["_handed"].iloc[0])) if len(pdf) else pd.DataFrame(columns=columns_out)

        done = None
        for run in range(runs):
            now = stored_rows.filter(F.col("_run") == run).drop("_run").groupBy(*keys)
            if done is None:
                made = now.applyInPandas(first, schema)
            else:
                handed = done.filter("_handed IS NOT NULL").select(*keys, "_handed").groupBy(*keys)
                made = now.cogroup(handed).applyInPandas(later, schema)
            path = f"{folder}/made/run={run}"
            made.write.parquet(path)
            done = spark.read.schema(schema).parquet(path)
        return spark.read.schema(schema).parquet(*[f"{folder}/made/run={run}" for run in range(runs)]).drop(
            "_handed", *([] if self.keys else ["_all"]))


def lay_out(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("ts",),
            chunk_rows: int | None = None, parts: int | None = None) -> Series:
    """Range-partition, sort, freeze and number a frame.

    ``order`` must be a total order inside a key (add a tie-breaking id);
    rows that agree on all of it are interchangeable and share a partition.
    Keys must not be null. ``parts`` fixes the number of range partitions;
    left out, adaptive execution sizes them.
    """
    keys, order = tuple(keys), tuple(order)
    cols = [*keys, *order]
    laid = settle(df.repartitionByRange(*([parts] if parts else []), *cols).sortWithinPartitions(*cols)
                  .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    spans = settle(laid.groupBy(*keys, part.alias("_span"))
                   .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    count, total = _count_and_total(spans)
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    shift = spans.select(*keys, "_span", (
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    if count <= BROADCAST_SPAN_LIMIT:
        shift = F.broadcast(shift)
    numbered = (laid.withColumn("_span", part).join(shift, [*keys, "_span"])
                .withColumn("_pos", F.col("_mid") + F.col("_shift")).drop("_span", "_shift", "_mid"))
    if chunk_rows is None:
        chunk_rows = fit_chunk_rows(total, df.sparkSession.sparkContext.defaultParallelism)
    return Series(numbered, laid.drop("_mid"), keys, order, total, chunk_rows, count)
