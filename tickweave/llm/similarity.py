"""N-gram Jaccard join by token-combination prefixes, and near-duplicate classes made from its links.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two
documents link when ``100 * |A & B| >= 100 * threshold * |A | B|``; links are
exact, the method only avoids looking at pairs that cannot link:

1. *Repeats.* Hashes are dealt by value into parts; a part credits a set for
   each of its hashes that some other row holds too. A set needs at least
   ``threshold`` of its hashes repeated to have any partner; most stop here.
   Equal sets are then one class, and repeats are counted once more over
   classes.
2. *Token-combination prefixes.* Hashes are ordered by document frequency,
   rare first, and put in token classes: one class of rare hashes, indexed
   singly, and several classes of frequent hashes, indexed by pairs. A set's
   prefix is extended until the hashes a partner must share with it can no
   longer miss every indexed single and pair: a class with n prefix hashes
   proves a common signature once n - (k - 1) of them are shared.
3. *Verification.* Signatures held by the same sets are folded into one.
   Within a signature each class is first compared with one leader; links merge
   classes into components. Only pairs whose classes are still in different
   components matter afterwards; while a round links a good part of the sets
   left, other leaders are tried, so a large group of near copies costs a few
   comparisons a member. All pairs left over are held against the bounds of
   their sizes and parity sketches inside the tasks, crowded signatures block
   by block, and only those that may link become rows and are compared hash by
   hash: nothing is capped.

Nulls and texts without words give an empty set that links with nothing; rows
repeated in full are equal sets and link; a null id takes part, but is never
the name of a component. Ties have no effect on the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import (
    BROADCAST_ROWS,
    WordHashes,
    batches,
    discard,
    joined_by_key,
    lowered_words,
    mix,
    odd_multipliers,
    parts_for,
    set_apart,
    small_enough,
    stored,
    text_key,
)
from tickweave.llm.graph import connected_components
from tickweave.session import settle

PART_HASHES = 2_000_000      # hashes that one task of the repeat count holds
BLOCK_HASHES = 500_000     # hashes that one task gathers before it deals them out
RARE_DF = 32                 # hashes in at most so many sets are indexed singly
SKETCH_WORDS = 16            # 64-bit words of a set's parity sketch
BLOCK_SETS = 2_000           # sets of one signature that are compared with each other in one piece
PIECE_ROWS = 20_000          # signature rows that one group of the leftover comparison holds
SIGNATURES_HELD = 50_000     # signatures that a task gathers before it hands them on
WORTH_A_ROUND = 10           # leaders are tried again while a round links one in so many of the sets that are left


def shingle_hashes(words: np.ndarray, size: int, multipliers: np.ndarray) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of ``size`` words; of the whole sequence when it is shorter."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(n, size)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h += words[j:n - k + 1 + j] * multipliers[j]
    return np.unique(mix(h))


def _repeat_messages(sets: Iterator[tuple[int, int, np.ndarray]], parts: int) -> Iterator[pd.DataFrame]:
    """What a task tells the parts: hashes it has seen once, with their sets' places; hashes it has seen more often, bare.

    A set is named by its place in its block (two bytes a hash), so a message
    grows with its hashes and not with the number of parts.
    """
    import xxhash
    step = np.uint64(2**64 // parts + 1)
    for block in batches(sets, lambda s: len(s[2]) + 50, BLOCK_HASHES):
        names = np.array([s[:2] for s in block], np.int64)
        lengths = np.array([len(s[2]) for s in block], np.int64)
        tokens = np.concatenate([s[2] for s in block])
        owner = np.repeat(np.arange(len(block)), lengths)
        values, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        local = np.bincount(owner[again], minlength=len(block))
        known, single, owner = values[counts > 1], tokens[~again], owner[~again]
        part, known_part = (single // step).astype(np.int32), (known // step).astype(np.int32)
        order = np.argsort(part, kind="stable")
        single, owner = single[order], owner[order].astype(np.uint16)      # a block has at most BLOCK_HASHES / 50 sets
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        known_ends = np.searchsorted(known_part, np.arange(parts + 1))
        own = np.stack([names[:, 0], names[:, 1], lengths, local]).tobytes()
        # named by content: a task that runs again in another order makes other blocks, never other sets of the same name
        label = int(np.array(xxhash.xxh3_64_intdigest(own), np.uint64).view(np.int64))
        rows = []
        for p in range(parts):
            base = np.uint64(p) * step
            # 32 bits of the place inside the part are enough: a false repeat only delays a set's dismissal
            shift = np.uint64(max(0, int(step).bit_length() - 32))
            rows.append((p, label, owner[ends[p]:ends[p + 1]].tobytes(),
                         ((single[ends[p]:ends[p + 1]] - base) >> shift).astype(np.uint32).tobytes(),
                         ((known[known_ends[p]:known_ends[p + 1]] - base) >> shift).astype(np.uint32).tobytes(), b""))
        rows.append((label % parts, label, b"", b"", b"", own))     # the sets' own rows travel with some part
        yield pd.DataFrame(rows, columns=["part", "block", "owners", "hashes", "known", "own"])


_MESSAGE = "part int, block long, owners binary, hashes binary, known binary, own binary"


def _credit(frame: pd.DataFrame) -> pd.DataFrame:
    """By block: places of sets and how many of their hashes in this part occur again; or the sets' own rows, handed on."""
    out = [(row.block, b"", row.own) for row in frame.itertuples(index=False) if row.own]
    told = [row for row in frame.itertuples(index=False) if not row.own]
    if told:
        singles = np.concatenate([np.frombuffer(row.hashes, np.uint32) for row in told])
        known = [np.unique(np.frombuffer(row.known, np.uint32)) for row in told]
        _, inverse, counts = np.unique(np.concatenate([singles, *known]), return_inverse=True, return_counts=True)
        again, at = counts[inverse[:len(singles)]] > 1, 0
        for row in told:
            owners = np.frombuffer(row.owners, np.uint16)
            places, credit = np.unique(owners[again[at:at + len(owners)]], return_counts=True)
            at += len(owners)
            if len(places):
                out.append((row.block, places.tobytes() + credit.astype(np.uint32).tobytes(), b""))
    return pd.DataFrame(out, columns=["block", "credits", "own"])


def _total(frame: pd.DataFrame) -> pd.DataFrame:
    own = np.frombuffer(next(x for x in frame["own"] if x), np.int64).reshape(4, -1)
    credit = own[3].copy()
    for body in frame["credits"]:
        k = len(body) // 6
        credit[np.frombuffer(body, np.uint16, k)] += np.frombuffer(body, np.uint32, k, 2 * k)
    return pd.DataFrame({"a": own[0], "b": own[1], "n": own[2], "credit": credit})


def repeat_credit(df: DataFrame, columns: list[str], to_sets, expected: int) -> DataFrame:
    """(a, b, n, credit): how many of a set's n hashes occur in another row as well (never too few).

    ``to_sets`` turns pandas frames of ``columns`` into (a, b, hashes). A task
    names a hash it met several times once and without its sets, so a hash
    that a third of all rows hold reaches its part once per block of rows.
    """
    parts = parts_for(expected, PART_HASHES, least=8)

    def deal(frames):
        yield from _repeat_messages(to_sets(frames), parts)

    messages = df.select(columns).mapInPandas(deal, _MESSAGE)
    credited = messages.groupBy("part").applyInPandas(_credit, "block long, credits binary, own binary")
    sets = credited.groupBy("block").applyInPandas(_total, "a long, b long, n long, credit long")
    return sets.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum("credit").alias("credit"))


def _sets_of_texts(size: int):
    multipliers = odd_multipliers(size, seed=5)

    def to_sets(frames):
        hashes = WordHashes()
        for frame in frames:
            for a, b, text in zip(frame["a"], frame["b"], frame["text"], strict=True):
                yield a, b, shingle_hashes(hashes.of(lowered_words(text)), size, multipliers)
    return to_sets


def _sets_of_tokens(frames):
    for frame in frames:
        for a, b, tokens in zip(frame["a"], frame["b"], frame["tokens"], strict=True):
            yield a, b, np.frombuffer(tokens, np.uint64)


def least_common(n: int, percent: int) -> int:
    """Hashes of a set of n that any partner must share."""
    return -(-n * percent // 100)


def prefix_signatures(tokens: np.ndarray, df: np.ndarray, n: int, percent: int) -> list[int]:
    """Signatures of one set: rare hashes singly, frequent ones in pairs inside their token class.

    ``tokens`` are the hashes shared with other sets, ``df`` how many sets hold
    them; the n - len(tokens) others come first in the order and miss for
    certain. Sets of at most twice the size use the same token classes.
    """
    goal = n - least_common(n, percent) + 1 - (n - len(tokens))     # misses still to be forced
    if goal <= 0 or n < 4:
        return []
    order = np.lexsort((tokens, df))
    tokens, rare = tokens[order], df[order] <= RARE_DF
    found: list[int] = []
    bands = {n.bit_length(), (n * 100 // percent).bit_length()}
    for band in bands:
        misses = (2**band * (100 - percent)) // 100
        classes = max(1, 2 ** max(0, (misses // 8).bit_length() - 1))   # some ten hashes of a prefix fall in each
        group = np.where(rare, -1, (tokens % np.uint64(classes)).astype(np.int64))
        first = np.zeros(len(tokens), bool)
        first[np.unique(group, return_index=True)[1]] = True
        forced = np.cumsum(rare | ~first)                             # n_g - (k - 1) summed over classes
        end = int(np.searchsorted(forced, goal)) + 1
        salt = np.uint64(band * 2654435761 + 1)
        found.extend(mix(tokens[:end][rare[:end]] + salt).tolist())
        for g in range(classes):
            members = tokens[:end][group[:end] == g]
            if len(members) > 1:
                i, j = np.triu_indices(len(members), 1)
                low, high = np.minimum(members[i], members[j]), np.maximum(members[i], members[j])
                found.extend(mix(mix(low + salt) * np.uint64(3) + high).tolist())
    return found


def _links(percent: int):
    def verify(frames):
        for f in frames:
            keep = []
            for left, right in zip(f["tokens_u"], f["tokens_v"], strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield f.loc[keep, ["u", "v"]]
    return verify


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * SKETCH_WORDS classes of hashes: whether the set holds an odd number of them.

    Two sketches differ in no more bits than the sets differ in hashes.
    """
    odd = np.bincount((mix(tokens) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _close_pairs(percent: int):
    """Pairs of different components, among the rows of each signature (and pair of blocks), that may link; each once a piece."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sig", "low", "high", "n"], ignore_index=True)
        group = frame.groupby(["sig", "low", "high"], sort=False).ngroup().to_numpy()
        code, sids = pd.factorize(frame["sid"], sort=True)
        root, n, block = pd.factorize(frame["root"])[0], frame["n"].to_numpy(np.int64), frame["block"].to_numpy()
        across = (frame["low"] != frame["high"]).to_numpy()
        sketch = np.stack(frame["sketch"].to_numpy()).astype(np.int64).view(np.uint64)      # signed numbers would be counted without their sign
        found, at, step = [], np.arange(len(frame)), 0
        while len(at):
            step += 1
            at = at[at + step < len(frame)]
            to = at + step
            at = at[(group[to] == group[at]) & (100 * n[at] >= percent * n[to])]     # sizes ascend: what is too large stays so
            to = at + step
            live = (root[at] != root[to]) & ~(across[at] & (block[at] == block[to]))
            x, y = at[live], to[live]
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
            keep = apart * (100 + percent) <= (100 - percent) * (n[x] + n[y])      # sets that link differ in no more
            x, y = code[x[keep]], code[y[keep]]
            found.append(np.unique(np.minimum(x, y) * len(sids) + np.maximum(x, y)))
        found = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pd.DataFrame({"u": sids[found // max(1, len(sids))], "v": sids[found % max(1, len(sids))]})     # codes ascend with the sets' names
    return run


def folded(signed: DataFrame) -> DataFrame:
    """``signed`` without signatures of one set and with one signature for each distinct group of sets; all candidate pairs stay."""
    groups = (signed.groupBy("sig").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"),
                                        F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y")).where("m > 1"))
    return signed.join(groups.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig")


def similar_sets(sets: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Components and verified links of distinct token sets (sid binary, n int, tokens binary).

    Returns (sid, root) for sets with a link, and the links (u, v) that were
    verified to join them.
    """
    spark = sets.sparkSession
    expected = sets.agg(F.sum("n")).first()[0] or 0
    split = sets.withColumns({"a": F.xxhash64("sid"), "b": F.xxhash64(F.lit(1), "sid")})
    credit = repeat_credit(split, ["a", "b", "tokens"], _sets_of_tokens, expected)
    alive = stored(split.join(credit.where(f"100 * credit >= {percent} * n").select("a", "b"), ["a", "b"], "left_semi")
                   .select("sid", "n", "tokens"))

    def unpack(frames):
        for f in frames:
            for sid, tokens in zip(f["sid"], f["tokens"], strict=True):
                t = np.frombuffer(tokens, np.int64)
                yield pd.DataFrame({"token": t, "sid": [sid] * len(t)})

    singles = alive.select("sid", "tokens").mapInPandas(unpack, "token long, sid binary")
    df = singles.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    weighed = singles.join(df, "token").groupBy("sid").agg(F.collect_list(F.struct("token", "df")).alias("held"))
    weighed = weighed.select("sid", F.col("held.token").alias("held"), F.col("held.df").alias("df"))    # plain arrays reach numpy

    def sign(frames):
        for f in frames:
            sids, sizes, out = [], [], []
            for sid, n, held, df in zip(f["sid"], f["n"], f["held"], f["df"], strict=True):
                marks = set(prefix_signatures(np.asarray(held, np.int64).view(np.uint64), np.asarray(df, np.int64), n, percent))
                out.extend(marks)
                sids.extend([sid] * len(marks))
                sizes.extend([n] * len(marks))
                if len(out) > SIGNATURES_HELD:
                    yield pd.DataFrame({"sig": np.array(out, np.uint64).view(np.int64), "sid": sids, "n": sizes})
                    sids, sizes, out = [], [], []
            yield pd.DataFrame({"sig": np.array(out, np.uint64).view(np.int64), "sid": sids, "n": sizes})

    every = stored(weighed.join(alive.select("sid", "n"), "sid").select("sid", "n", "held", "df")
                   .mapInPandas(sign, "sig long, sid binary, n int"))
    signed = stored(folded(every))
    discard(every)

    def sketch(frames):
        for f in frames:
            yield pd.DataFrame({"sid": f["sid"], "sketch": [parity_sketch(np.frombuffer(t, np.uint64)) for t in f["tokens"]]})

    sketches = stored(alive.select("sid", "tokens").mapInPandas(sketch, "sid binary, sketch array<long>"))

    def not_ruled_out(pairs: DataFrame) -> DataFrame:
        side = lambda c: sketches.select(F.col("sid").alias(c), F.col("sketch").alias(f"sketch_{c}"))
        apart = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        return (pairs.join(side("u"), "u").join(side("v"), "v").where(apart * (100 + percent) <= (100 - percent) * (F.col("nu") + F.col("nv")))
                .select("u", "v"))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: alive.select(F.col("sid").alias(c), F.col("tokens").alias(f"tokens_{c}"))
        return stored(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tokens_u", "tokens_v")
                      .mapInPandas(_links(percent), "u binary, v binary"))

    near = f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"
    links = roots = tried = None
    last, spent = False, [alive, signed, sketches]
    for turn in range(2**31):
        # only signatures that still join different components matter
        placed = signed.withColumn("root", F.col("sid"))
        if roots is not None:
            known = roots.select(F.col("node").alias("sid"), "root")
            known = F.broadcast(known) if roots.count() <= BROADCAST_ROWS else known
            placed = signed.join(known, "sid", "left").select("sig", "sid", "n", F.coalesce("root", "sid").alias("root"))
        mixed = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("sig", "m")
        placed = stored(placed.join(mixed, "sig"))
        spent.append(placed)
        rows, sets = placed.agg(F.count("*"), F.countDistinct("sid")).first()
        if not rows:
            break
        if turn and merged * WORTH_A_ROUND < sets:
            last = True
            # crowded signatures are compared block by block, so that none is one task's work
            blocks = F.ceil(F.col("m") / BLOCK_SETS).cast("int")
            spread = (placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
                      .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                      .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
                      .join(sketches, "sid").select("sig", "low", "high", "block", "sid", "n", "root", "sketch"))
            pieces = parts_for(rows, PIECE_ROWS, least=8)
            pairs = (spread.groupBy(F.pmod(F.xxhash64("sig", "low", "high"), F.lit(pieces)).alias("piece"))
                     .applyInPandas(_close_pairs(percent), "u binary, v binary").distinct())
        else:
            lead = F.min(F.struct(F.xxhash64(F.lit(turn), "sid").alias("h"), F.col("sid"), F.col("n"), F.col("root"))).alias("lead")
            pairs = not_ruled_out(placed.join(placed.groupBy("sig").agg(lead), "sig").where("root <> lead.root")
                                  .select(F.least("lead.sid", "sid").alias("u"), F.greatest("lead.sid", "sid").alias("v"),
                                          F.col("lead.n").alias("nu"), F.col("n").alias("nv"))
                                  .where(near).distinct())
        pairs = stored(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
        spent.append(pairs)
        more = verified(pairs)
        merged = more.count()
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = more if links is None else links.unionByName(more)
        if merged:
            roots = connected_components(links, "u", "v")
        if last:
            break
    if roots is None:
        nothing = spark.createDataFrame([], "u binary, v binary")
        links, roots = nothing, nothing.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for done in spent:
        discard(done)
    return roots.withColumnRenamed("node", "sid"), links


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                           percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, text key (a, b), n_shingles, component_id (smallest id reachable by links), class label (null: empty set)."""
    key = text_key(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key["a"].alias("a"), key["b"].alias("b"))
    expected = (docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // 6
    credit = stored(repeat_credit(rows, ["a", "b", "text"], _sets_of_texts(shingle), expected))
    likely = credit.where(f"n > 0 and 100 * credit >= {percent} * n")
    to_sets = _sets_of_texts(shingle)

    def pack(frames):
        import xxhash
        for f in frames:
            got = [(a, b, xxhash.xxh3_128_digest(t.tobytes()), len(t), t.tobytes()) for a, b, t in to_sets([f])]
            yield pd.DataFrame(got, columns=["a", "b", "sid", "n", "tokens"])

    texts = joined_by_key(rows, likely, "left_semi", "text").dropDuplicates(["a", "b"]).select("a", "b", "text")
    packed = stored(texts.mapInPandas(pack, "a long, b long, sid binary, n int, tokens binary"))
    roots, _ = similar_sets(packed.dropDuplicates(["sid"]).select("sid", "n", "tokens"), percent)
    classes = packed.select("a", "b", "sid").join(roots, "sid", "left").select("a", "b", F.coalesce("root", "sid").alias("root"))
    labelled = (rows.select("id", "a", "b").join(credit.select("a", "b", F.col("n").alias("n_shingles")), ["a", "b"])
                .join(classes, ["a", "b"], "left")
                .select("id", "a", "b", "n_shingles",
                        F.when(F.col("n_shingles") > 0, F.coalesce(F.hex("root"), F.concat_ws(":", "a", "b"))).alias("label")))
    labelled = stored(labelled)
    discard(packed)
    discard(credit)
    named = labelled.groupBy("label").agg(F.min("id").alias("component_id")).where("label is not null")
    return (labelled.join(named, "label", "left")
            .select("id", "a", "b", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "label"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                       percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one for each near-duplicate class: the one with the smallest id.

    A class whose ids are all null keeps its smallest text key; of rows equal
    in id and text one stays. Documents without words stay as they are.
    """
    classes = near_duplicate_classes(docs, id_col, text_col, shingle, percent)
    chosen = (classes.where("n_shingles > 0 and id <=> component_id")
              .groupBy("label").agg(F.min(F.struct("id", "a", "b")).alias("k"))
              .select(F.col("k.id").alias("_kept_id"), F.col("k.a").alias("_kept_a"), F.col("k.b").alias("_kept_b"))
              .unionByName(classes.where("n_shingles = 0").select(F.col("id").alias("_kept_id"), F.col("a").alias("_kept_a"),
                                                                  F.col("b").alias("_kept_b")).distinct()))
    key = text_key(text_col)
    keyed, back = set_apart(docs, _own_id=F.col(id_col), _own_a=key["a"], _own_b=key["b"])
    match = ((F.col("_own_id").eqNullSafe(F.col("_kept_id"))) & (F.col("_own_a") == F.col("_kept_a"))
             & (F.col("_own_b") == F.col("_kept_b")))
    chosen, _ = small_enough(chosen)
    return back(keyed.join(chosen, match, "left_semi").dropDuplicates(["_own_id", "_own_a", "_own_b"]))
