"""Near-duplicate groups by the Jaccard similarity of word shingles: a grouped prefix join.

Shingles are ordered rare first, by a frequency sketch of fixed size that counts all documents'
shingles; any fixed order gives exact results, this one keeps common passages out of prefixes.
Documents with equal sets are one class; classes with equal prefix and size are one group. Groups
that share a prefix shingle are candidates. Two passes find all links that matter to components:

1. stars: within each group and each prefix shingle, all members against the one nearest to all;
2. the rest: pairs of one prefix shingle (or group) whose components still differ and whose sizes,
   places and signatures allow a link. Where many would meet, stars are made again before.

Candidate pairs are expanded to classes and verified on the whole sets. A set of thousands of near
copies costs thousands of pairs, not their square, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, small_batches, small_or_shuffled

#: Counters of the frequency sketch: 16 MB at any input.
SKETCH_BITS = 22
#: Longs of a set's signature: a bit says whether an odd number of the set's shingles hash to it.
SIGNATURE = 8
#: Stars are made again, up to so often, while more than this many pairs a posting would have to be looked at.
PAIRS_PER_POSTING, STAR_ROUNDS = 4, 5
#: Pairs of one document that a task verifies, about.
TASK_PAIRS = 256
ROWS = 256
#: Bytes that are hashed at once; longer texts go in pieces cut at blanks.
PIECE = 1 << 17

# A word's hash is a sum of a random number per byte times powers of an odd base, modulo 2**64. Sums
# over all prefixes of a buffer give any word's by a difference and a multiplication.
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_VALUE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, PIECE) + 2
        tables = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, x, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        if size > 4 * PIECE:  # one huge word: not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data and where they start."""
    codes = np.frombuffer(data, np.uint8)
    blank = np.r_[True, _BLANK[codes], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUE[codes] * power[: len(codes)], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return h ^ (h >> np.uint64(32)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """text in parts of about PIECE bytes that end at blanks."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words with hashes h."""
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += h[j : n + j]
        acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of width words; of all its words if they are fewer.

    Words are what 0x20 and 0x09-0x0D separate, with A-Z lowered.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        h, starts = _word_hashes(b" ".join(held))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held])).tolist()
        acc = _shingles(h, width) if len(h) >= width else h[:0]
        at = 0
        for end in ends:
            n = end - at
            out.append(np.unique(acc[at : end - width + 1] if n >= width else _shingles(h[at:end], n) if n else h[:0]))
            at = end
        held.clear()

    size = 0
    for t in texts:
        t = t or b""
        if len(t) > PIECE:
            if held:
                flush()
            h = np.concatenate([_word_hashes(x)[0] for x in _pieces(t)])
            out.append(np.unique(_shingles(h, min(width, len(h))) if len(h) else h))
            size = 0
            continue
        if size + len(t) > PIECE and held:
            flush()
            size = 0
        held.append(t)
        size += len(t) + 1
    if held:
        flush()
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(1).to_pylist()


def _signature(s: np.ndarray) -> np.ndarray:
    """SIGNATURE longs of a set's hashes. Two sets differ in at least as many shingles as their signatures in bits."""
    odd = np.bincount((s & np.uint64(64 * SIGNATURE - 1)).astype(np.int64), minlength=64 * SIGNATURE).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def frequency_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """Shingle counts of all texts (id, text binary) by the leading bits of the shingle's hash.

    A task sends its counters once, in compressed chunks; chunks are added up as they stream in.
    """
    size, chunk = 1 << SKETCH_BITS, 1 << (SKETCH_BITS - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, waiting = np.zeros(size, np.uint32), [], 0

        def add() -> None:
            buckets = (np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            np.add(n, np.bincount(buckets, minlength=size).astype(np.uint32), out=n)
            held.clear()

        for _, part in _texts(batches):
            held += shingle_sets(part, width)
            waiting += sum(map(len, held[-len(part) :]))
            if waiting > size // 8:
                add()
                waiting = 0
        if held:
            add()
        parts = [(i, n[i * chunk : (i + 1) * chunk]) for i in range(64)]
        parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in parts if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(sums[i].tobytes(), 1) for i in keys], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    out = np.zeros(size, np.int64)
    for r in texts.mapInArrow(count, schema).repartition(16, "chunk").mapInArrow(merge, schema).collect():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    # only the order matters: counts beyond four bytes are alike
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def _prefixes(texts: DataFrame, sketch, width: int, percent: int, kind: str, whole: bool) -> DataFrame:
    """(id, n, class, gkey, s0..) of each text: set size, digest of the set, digest of prefix and size, signature; with whole, (id, n, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = sketch.value
        digest = lambda a: hashlib.blake2b(a.tobytes(), digest_size=16).digest()
        for ids, part in _texts(batches):
            n, sets, groups, prefixes, signs = [], [], [], [], []
            for s in shingle_sets(part, width):
                order = np.argsort(frequency[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                first = s[order[: len(s) - (percent * len(s) + 99) // 100 + 1]] if len(s) else s
                n.append(len(s))
                if whole:
                    prefixes.append(first.view(np.int64))
                else:
                    sets.append(digest(s))
                    groups.append(digest(np.r_[np.uint64(len(s)), first]))
                    signs.append(_signature(s))
            if whole:
                ends = np.cumsum([0, *map(len, prefixes)])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), flat], names=["id", "n", "prefix"])
            else:
                bits = np.stack(signs).T
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sets), pa.array(groups), *map(pa.array, bits)], names=["id", "n", "class", "gkey", *names])

    names = [f"s{i}" for i in range(SIGNATURE)]
    return texts.mapInArrow(run, f"id {kind}, n long, " + ("prefix array<long>" if whole else "class binary, gkey binary, " + ", ".join(f"{x} long" for x in names)))


def _with_sets(pairs: DataFrame, known: DataFrame, x: str, other: str) -> DataFrame:
    """pairs with the sets of column x as sets_<x>. The sets of an id with many pairs go to several tasks, one for each TASK_PAIRS of them."""
    hot = pairs.groupBy(F.col(x).alias("id")).count().where(F.col("count") > TASK_PAIRS).select("id", F.ceil(F.col("count") / TASK_PAIRS).cast("int").alias("parts"))
    hot = cut(hot)
    held = known.select(F.col("id").alias(x), F.col("sets").alias(f"sets_{x}"))
    if hot.isEmpty():
        return pairs.join(held, x)
    # the others meet the sets where their grouping left them, without another exchange of sets
    hot = small_or_shuffled(hot.withColumnRenamed("id", x))
    dealt = held.join(hot, x).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    spread = pairs.join(hot, x).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
    return pairs.join(hot, x, "left_anti").join(held, x).unionByName(spread.join(dealt, [x, "part"]).drop("part"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, kind: str) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough. Only texts of those pairs are shingled again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in shingle_sets(part, width)], pa.binary())], names=["id", "shingles"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = [any(_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p in x for q in y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    needed = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    # a repeated id has the sets of all its texts
    known = texts.join(small_or_shuffled(needed), "id", "left_semi").mapInArrow(sets, f"id {kind}, shingles binary").groupBy("id").agg(F.collect_set("shingles").alias("sets"))
    both = _with_sets(_with_sets(pairs, known, "b", "a"), known, "a", "b")
    return both.select("a", "b", "sets_a", "sets_b").mapInArrow(similar, f"a {kind}, b {kind}")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _bands(n: Column) -> Column:
    """Sizes in bands, in order: each size up to 255 its own, then 128 bands to a doubling."""
    shift = F.greatest(F.floor(F.log2(n.cast("double"))) - 7, F.lit(0))
    return F.floor(n / F.pow(F.lit(2.0), shift)).cast("long") + shift * 256


def _differ(x: str, y: str) -> Column:
    """At least so many shingles are in one set only: the bits in which the signatures <x>0.. and <y>0.. differ."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(SIGNATURE)))


def _wanting(postings: DataFrame, percent: int) -> DataFrame:
    """The postings that may still link with one of another component, once for each band of sizes where there is such a one.

    postings: (k, token, g, comp, n, top, ...); top is the largest set that a posting's place still
    allows. A band of a token keeps the largest top and that of any other component, so that what
    only its own component could meet leaves without a pair being made.
    """
    at = ["k", "token", "band"]
    banded = postings.withColumn("band", _bands(F.col("n")))
    by_comp = cut(banded.groupBy(*at, "comp").agg(F.max("top").alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    best = by_comp.groupBy(*at).agg(F.max_by("comp", "top").alias("c1"), F.max("top").alias("t1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    other = by_comp.join(best.select(*at, "c1"), at).where("comp <> c1").groupBy(*at).agg(F.max("top").alias("t2"))
    sizes = best.join(other, at, "left").withColumnRenamed("band", "with")
    meets = (F.col("lo") <= F.col("top")) & (100 * F.col("hi") >= percent * F.col("n"))
    meets = meets & (F.when(F.col("comp") == F.col("c1"), F.col("t2")).otherwise(F.col("t1")) >= F.col("n"))
    return banded.join(sizes, ["k", "token"]).where(meets).drop("lo", "hi", "c1", "t1", "t2")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) with the links (a, b) added: only their ends' components go through the search."""
    of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = connected_components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct())
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = more.join(found, "node", "left_anti").select("node", "component")
    return cut(found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(new))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles long, component_id) of every row of docs.

    Texts are lower-cased in A-Z and split into words at 0x20 and 0x09-0x0D; the set of a text is
    its distinct shingles of ``width`` words, or the whole sequence if it has fewer. Two documents
    link when 100 x intersection >= percent x union; component_id is the smallest id reachable by
    links. Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an
    id are one document, which links where any of its texts does; each row reports its own size.
    Rows with a null id report their size and a null component. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(texts, width))
    sized = cut(_prefixes(texts, sketch, width, percent, kind, whole=False))
    full = sized.where("n > 0 AND id IS NOT NULL")
    signature = [f"s{i}" for i in range(SIGNATURE)]
    classes = cut(full.groupBy("class").agg(F.min("id").alias("node"), F.min("gkey").alias("gkey"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in signature]))
    groups = classes.groupBy("gkey").agg(F.min("node").alias("g"))
    members = cut(classes.join(groups, "gkey").select("g", "node", "n", *signature))
    # Texts that lead a group are shingled once more, which costs less than keeping and shuffling all prefixes.
    leads = cut(members.select(F.col("g").alias("id")).distinct())
    prefixes = _prefixes(texts.join(small_or_shuffled(leads), "id", "left_semi"), sketch, width, percent, kind, whole=True)
    postings = prefixes.select(F.col("id").alias("g"), "n", "prefix", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "g", "n", "pos", F.get("prefix", F.col("pos") - 1).alias("prev")).repartition("token")
    # One exchange by token serves both the leaders and the join with them. What stands first in its own
    # order has the fewest rare shingles: of near copies, the one nearest to the others.
    first = F.shiftleft(F.col("pos").cast("long"), 32) + F.shiftrightunsigned(F.xxhash64("g"), 32)
    of_lead = [F.min_by(c, "first").alias(f"{c}_a") for c in ("g", "n", "pos", "prev")]
    shared = postings.withColumn("first", first).groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high"), *of_lead).where("low <> high").drop("low", "high")
    postings = cut(postings.join(shared, "token"))
    similar_size = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))

    def can_reach(n_x, pos_x, n_y, pos_y):
        """Whether enough is left behind a common shingle at these places of both orders for the sets to be similar."""
        return F.least(n_x - pos_x, n_y - pos_y) >= F.ceil(F.lit(percent) * (n_x + n_y) / (100 + percent))

    def run_starts(prev_x, prev_y):
        """Whether the shingles before a common one differ. If not, the pair has met at that shingle, so the first one they share always starts a run."""
        return prev_x.isNull() | prev_y.isNull() | (prev_x != prev_y)

    # 1. stars
    stars = postings.where("g <> g_a").where(similar_size(F.col("n"), F.col("n_a")) & can_reach(F.col("n"), F.col("pos"), F.col("n_a"), F.col("pos_a")))
    stars = stars.where(run_starts(F.col("prev"), F.col("prev_a")))
    stars = stars.select(F.least("g", "g_a").alias("a"), F.greatest("g", "g_a").alias("b")).unionByName(members.where("g <> node").select(F.col("g").alias("a"), F.col("node").alias("b")))
    met = cut(stars.distinct())
    found = cut(connected_components(_verified(met, texts, width, percent, kind)))

    # 2. pairs of different components, by shingle and by group
    top = (F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")).alias("top")
    # what differs in more bits of the signatures than two similar sets can is no pair
    alike = _differ("s", "r") <= F.col("n") + F.col("m") - 2 * F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / (100 + percent))
    few, attempt, waiting = PAIRS_PER_POSTING * postings.count(), 0, True
    while waiting:
        placed = cut(members.join(found, "node", "left").select("g", "node", F.coalesce("component", "node").alias("comp"), *signature))
        spread = placed.groupBy("g").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
        tokens = postings.select("token", "g", "n", "pos", "prev").join(spread, "g")
        open_tokens = tokens.groupBy("token").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("token")
        own = placed.select("g", "comp").distinct()
        by_token = tokens.join(open_tokens, "token").join(own, "g").select(F.lit(0).alias("k"), "token", "g", "comp", "n", "pos", "prev")
        several = members.select("g", "n").distinct().join(spread.where("least <> most").select("g"), "g").join(own, "g")
        by_group = several.select(F.lit(1).alias("k"), F.xxhash64("g").alias("token"), "g", "comp", "n", F.lit(0).alias("pos"), F.lit(None).cast("long").alias("prev"))
        rest = cut(by_token.unionByName(by_group).select("k", "token", "g", "comp", "n", "prev", "pos", top))
        want = cut(_wanting(rest, percent).join(placed, ["g", "comp"]))
        key = [F.least("band", "with").alias("small"), F.greatest("band", "with").alias("large")]
        one = want.where("band <= with").select("k", "token", *key, F.col("node").alias("a"), F.col("comp").alias("c"), "n", "prev", "top", *signature)
        two = want.where("band >= with").select("k", "token", *key, F.col("node").alias("b"), F.col("comp").alias("d"), F.col("n").alias("m"), F.col("prev").alias("before"), F.col("top").alias("up_to"), *[F.col(c).alias(c.replace("s", "r")) for c in signature])
        at = ["k", "token", "small", "large"]
        work = one.groupBy(at).count().join(two.groupBy(at).agg(F.count("*").alias("with")), at).agg(F.sum(F.col("count") * F.col("with").cast("double"))).first()[0] or 0
        fits = (F.col("c") != F.col("d")) & (F.col("n") <= F.col("up_to")) & (F.col("m") <= F.col("top")) & run_starts(F.col("prev"), F.col("before")) & alike
        waiting = work > few and attempt < STAR_ROUNDS
        if waiting:
            # many pairs for few documents: first all that wait at a shingle against one of them
            attempt += 1
            lead = lambda side, x: side.groupBy(at).agg(*[F.min_by(c, F.xxhash64(x, F.lit(attempt))).alias(c) for c in side.columns if c not in at])
            pairs = one.join(lead(two, "b"), at).unionByName(lead(one, "a").join(two, at))
        else:
            pairs = one.join(two, at)
        pairs = pairs.where(fits & ((F.col("small") < F.col("large")) | F.lit(waiting) | (F.col("a") < F.col("b"))))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        pairs = cut(pairs.join(met, ["a", "b"], "left_anti"))
        more = None if pairs.isEmpty() else cut(_verified(pairs, texts, width, percent, kind))
        if more is None or more.isEmpty():
            # no link: the stars have done what they can
            attempt = STAR_ROUNDS
        else:
            found = _joined(found, more)
            if waiting:
                met = cut(met.unionByName(pairs))

    component = classes.select("class", "node").join(found, "node", "left").select("class", F.coalesce("component", "node").alias("comp"))
    # a class's smallest id stands for it; ids of several classes join their components by the links above
    return sized.join(component, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
