"""Near-duplicate lines within a few edits: a segment-partition join, in DataFrame functions only.

If two lines are at most t edits apart, one of the t + 1 even segments of the shorter one occurs
unchanged in the longer one, close to its place. A line's segments are its index entries, by length
and segment number; the substrings of a line that could match the segments of a line up to t
characters shorter are its probes, within windows that keep every match of at least one segment.
Lines that share an entry are candidates: first all against one leader per entry, then those of
different components; so copies by the thousand cost thousands of pairs. A candidate is verified by
edit distance: a band of 2t + 1 diagonals as bits of one integer, advanced a character at a time
over what is left between the common start and the common end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, small_or_shuffled

#: The fixed number of lines, entries or documents whose keys are broadcast; beyond, keys are shuffled.
FEW = 1_000_000
#: Characters whose counts tell lines apart before their texts are compared.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def within(a: Column, b: Column, most: int) -> Column:
    """Whether the arrays of characters a and b are at most ``most`` edits apart.

    Row r of column j is bit r - j + most of the band. The distance is followed down the band's
    lowest diagonal to the last row, and along the last row from there.
    """
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
    tail = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
    width, low = 2 * most + 1, F.array_repeat(F.lit(""), most)  # alike in both, so that no side is shorter than the band's half
    ones = (1 << width) - 1
    bits = lambda x: x.bitwiseAND(F.lit(ones).cast("long"))
    inverse = lambda x: bits(F.bitwise_not(x))

    def distance(x: Column, y: Column) -> Column:
        m = F.size(x)

        def match(c: Column, j: Column) -> Column:
            hits = [F.when(F.coalesce(F.get(x, j + (1 + i - most - 1)) == c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(width)]
            out = hits[0]
            for h in hits[1:]:
                out = out + h
            return out.cast("long")

        columns = F.transform(y, lambda c, j: F.struct(match(c, j).alias("pm"), (j + 1).alias("j")))

        def step(acc: Column, col: Column) -> Column:
            vp, vn, pm, j = acc["vp"], acc["vn"], col["pm"], col["j"]
            d0 = bits((bits(pm.bitwiseAND(vp) + vp)).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn)

            def rest(z: Column) -> Column:
                d0, hp = z["d0"], z["hp"]
                hn, half = d0.bitwiseAND(vp), F.shiftright(d0, 1)
                place = F.greatest(m - j + most, F.lit(0))
                down = 1 - F.shiftright(d0, 2 * most).bitwiseAND(F.lit(1).cast("long"))
                along = F.call_function("shiftright", hp, place).bitwiseAND(F.lit(1).cast("long")) - F.call_function("shiftright", hn, place).bitwiseAND(F.lit(1).cast("long"))
                return F.struct(
                    hn.bitwiseOR(inverse(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                    (acc["d"] + F.when(j <= m - most, down).otherwise(along)).cast("long").alias("d"),
                )

            return _let(d0, lambda v: _let(F.struct(v.alias("d0"), vn.bitwiseOR(inverse(v.bitwiseOR(vp))).alias("hp")), rest))

        start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(most).cast("long").alias("d"))
        return F.aggregate(columns, start, step)["d"]

    def core(z: Column) -> Column:
        x, y = tail(z["x"], z["p"]), tail(z["y"], z["p"])
        return _let(F.struct(F.reverse(x).alias("x"), F.reverse(y).alias("y")), lambda r: _let(F.struct(r["x"].alias("x"), r["y"].alias("y"), F.greatest(differ(r["x"], r["y"]) - 1, F.lit(0)).cast("int").alias("p")), last))

    def last(z: Column) -> Column:
        x, y = tail(z["x"], z["p"]), tail(z["y"], z["p"])
        return _let(F.struct(F.concat(low, x).alias("x"), F.concat(low, y).alias("y")), lambda r: distance(r["x"], r["y"]) <= most)

    first = F.struct(a.alias("x"), b.alias("y"), F.greatest(differ(a, b) - 1, F.lit(0)).cast("int").alias("p"))
    apart = _let(first, core)
    return (F.abs(F.size(a) - F.size(b)) <= most) & ((a == b) | apart)


def windows(most: int) -> Column:
    """array<struct<delta, i, shift>>: where probes look, as a constant.

    For the segments of lines shorter by delta, segment i may have moved by shift: at most i edits lie
    to its left and most - i to its right. With delta and shift zero it is the line's own segment.
    """
    out = []
    for delta in range(most + 1):
        for i in range(most + 1):
            for shift in range(max(-i, delta - (most - i)), min(i, delta + (most - i)) + 1):
                out.append(F.struct(F.lit(delta).alias("delta"), F.lit(i).alias("i"), F.lit(shift).alias("shift")))
    return F.array(*out)


def entries(lines: DataFrame, most: int) -> DataFrame:
    """(h1, token, own) from (h1, line, n): index entries (own 1) and probes (own 0).

    The windows are exploded first and each row computes one token, which keeps the generated code
    small enough to be compiled.
    """
    e = lines.select("h1", "line", "n", F.explode(windows(most)).alias("w")).select("h1", "line", "n", "w.*")
    e = e.withColumn("size", F.col("n") - F.col("delta"))
    e = e.withColumns({"base": F.expr(f"CAST(size DIV {most + 1} AS INT)"), "longer": F.expr(f"CAST(size % {most + 1} AS INT)")})
    # the last ``longer`` segments have one character more
    plus = F.col("i") - (most + 1) + F.col("longer")
    e = e.withColumns({"at": F.col("base") * F.col("i") + F.greatest(plus, F.lit(0)) + F.col("shift"), "length": F.col("base") + (plus >= 0).cast("int")})
    e = e.where("at >= 0 AND length > 0 AND at + length <= n")
    token = F.xxhash64("size", "i", F.substring(F.col("line"), F.col("at") + 1, F.col("length")))
    return e.select("h1", token.alias("token"), ((F.col("delta") == 0) & (F.col("shift") == 0)).cast("int").alias("own"))


def letter_counts(line: Column) -> list[Column]:
    """How often each of LETTERS occurs: an edit changes two of these counts by one at most."""
    return [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias(f"c_{c}") for c in LETTERS]


def counts_allow(x: str, y: str, most: int, lo: str = "", hi: str = "") -> Column:
    """Whether the letter counts of lines x and y, or of some lines between lo and hi of both, allow ``most`` edits."""
    gap = F.lit(0)
    for c in LETTERS:
        gap = gap + F.greatest(F.col(f"{lo}c_{c}{x}") - F.col(f"{hi}c_{c}{y}"), F.col(f"{lo}c_{c}{y}") - F.col(f"{hi}c_{c}{x}"), F.lit(0))
    return gap <= 2 * most


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, min_chars: int = 20) -> DataFrame:
    """(id_col, n_lines, n_kept, dropped_lines array<int>) of every row of docs.

    A text's lines are what its line ends (\\n) separate, numbered from 0. Lines link when they are
    equal, or when both have at least min_chars characters and differ by at most max_edits
    insertions, deletions or replacements of characters. Of the lines connected by links the first
    stays: that of the smallest id, and there the first. Empty lines link with nothing and stay;
    null and empty texts have one empty line. Rows that repeat an id and a text are kept or dropped
    alike; rows with a null id keep all their lines. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).where("id IS NOT NULL")
    raw = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    raw = raw.withColumns({"h1": F.xxhash64("line"), "n": F.length("line")})
    second = F.xxhash64(F.concat(F.lit("\u0001"), F.col("line")))
    lines = cut(raw.select("id", "line_no", "h1", second.alias("h2"), "n"))
    known = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n")))

    # entries that different lines share, of which one is in the index
    long = raw.where(F.col("n") >= min_chars)
    entry = entries(long, max_edits)
    shared = entry.groupBy("token").agg(F.min("h1").alias("lead"), F.max("h1").alias("top"), F.max("own").alias("own")).where("lead <> top AND own = 1")
    shared = cut(shared.select("token", "lead"))
    postings = cut(entry.select("h1", "token").join(small_or_shuffled(shared, FEW), "token").select("token", "lead", F.col("h1").alias("node")).distinct())

    needed = postings.select(F.col("node").alias("h1")).distinct()
    # 64-bit keys find candidates; a key of several lines stands for all of them until their texts are compared
    wanted = long.select("h1", second.alias("h2"), "line", "n").join(small_or_shuffled(needed, FEW), "h1", "left_semi")
    wanted = cut(wanted.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min("n").alias("n")))
    counts = [f"c_{c}" for c in LETTERS]
    traits = cut(wanted.select("h1", "n", *letter_counts(F.col("line"))))
    suffixed = lambda df, x: df.toDF(*[f"{c}{x}" for c in df.columns])

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (a, b) between lines, as strings of both hashes, from pairs (a, b) of keys; lines of one key are compared too."""
        name = F.concat_ws(":", "h1", "h2")
        x = wanted.select(F.col("h1").alias("a"), name.alias("name_a"), F.col("line").alias("line_a"), F.col("n").alias("n_a"))
        y = wanted.select(F.col("h1").alias("b"), name.alias("name_b"), F.col("line").alias("line_b"), F.col("n").alias("n_b"))
        met = pairs.join(y, "b").join(x, "a").where(F.abs(F.col("n_a") - F.col("n_b")) <= max_edits).where("name_a <> name_b")
        close = within(characters(F.col("line_a")), characters(F.col("line_b")), max_edits)
        return met.where(close).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))

    def near(pairs: DataFrame) -> DataFrame:
        """Only pairs of keys whose lines' lengths and letters allow a link."""
        x, y = suffixed(traits, "_a").withColumnRenamed("h1_a", "a"), suffixed(traits, "_b").withColumnRenamed("h1_b", "b")
        close = (F.abs(F.col("n_a") - F.col("n_b")) <= max_edits) & counts_allow("_a", "_b", max_edits)
        return pairs.join(x, "a").join(y, "b").where(close).select("a", "b").distinct()

    several_lines = cut(wanted.groupBy("h1").count().where("count > 1").select("h1"))
    same_key = several_lines.select(F.col("h1").alias("a"), F.col("h1").alias("b"))
    stars = cut(near(postings.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()).unionByName(same_key))
    links = cut(verified(stars))
    found = connected_components(links)

    # a key of several lines keeps a component of its own here, so that all its lines meet the others
    comp = found.select(F.split("node", ":")[0].cast("long").alias("node"), F.col("component").alias("comp")).join(several_lines.withColumnRenamed("h1", "node"), "node", "left_anti")
    placed = postings.join(comp, "node", "left").select("token", "node", F.coalesce("comp", F.col("node").cast("string")).alias("comp"))
    open_tokens = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    rest = cut(placed.join(open_tokens, "token").join(traits.withColumnRenamed("h1", "node"), "node").select("token", "node", "comp", "n", *counts))
    spans = [f(c).alias(f"{name}{c}") for c in ["n", *counts] for f, name in ((F.min, "lo"), (F.max, "hi"))]
    parts = cut(rest.groupBy("token", "comp").agg(*spans))
    left, right = suffixed(parts, "_a").withColumnRenamed("token_a", "token"), suffixed(parts, "_b").withColumnRenamed("token_b", "token")
    may_link = (F.col("lon_a") - F.col("hin_b") <= max_edits) & (F.col("lon_b") - F.col("hin_a") <= max_edits) & counts_allow("_a", "_b", max_edits, "lo", "hi")
    meet = left.join(right, "token").where((F.col("comp_a") < F.col("comp_b")) & may_link).select("token", "comp_a", "comp_b")
    one = suffixed(rest, "_a").withColumnsRenamed({"token_a": "token", "node_a": "x"})
    two = suffixed(rest, "_b").withColumnsRenamed({"token_b": "token", "node_b": "y"})
    cross = meet.join(one, ["token", "comp_a"]).join(two, ["token", "comp_b"])
    cross = cross.where((F.abs(F.col("n_a") - F.col("n_b")) <= max_edits) & counts_allow("_a", "_b", max_edits) & (F.col("x") != F.col("y")))
    cross = cut(cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    if not cross.isEmpty():
        more = cut(verified(cross))
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))

    # the first line of each class, for lines that are copies or linked
    in_class = known.withColumn("node", F.concat_ws(":", "h1", "h2")).join(found, "node", "left")
    firsts = in_class.where("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("first").alias("class_first"))
    several = in_class.where("copies > 1 OR component IS NOT NULL").join(firsts, F.col("component") == F.col("c"), "left").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("class_first", "first").alias("keep"))
    dropped = lines.join(several, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where((F.col("id") != F.col("keep.id")) | (F.col("line_no") != F.col("keep.line_no")))
    by_doc = dropped.groupBy("id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped_lines"))
    out = docs.select(F.col(id_col).alias("key"), F.size(F.split(text, "\n")).cast("long").alias("n_lines")).join(by_doc, F.col("key") == F.col("id"), "left")
    gone = F.coalesce("dropped_lines", F.array().cast("array<int>"))
    return out.select(F.col("key").alias(id_col), "n_lines", (F.col("n_lines") - F.size(gone)).cast("long").alias("n_kept"), gone.alias("dropped_lines"))
