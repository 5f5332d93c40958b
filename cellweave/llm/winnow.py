"""Document fingerprints by winnowing, in DataFrame operations only.

A text is cut into pieces: runs of at most `piece` code points without white space, end to end.  With `overlap`, pieces start at
each code point of a run as long as that many more follow in it, so that what two long runs (texts without spaces) share is found
wherever it stands in them; words, which are shorter, are cut from their own starts and need no more than that.  With an overlap
of `piece` (or True) all pieces of all runs overlap.  Each `k` pieces in a row have a rolling (polynomial) hash of 32 bits, and of each `window` such hashes in a row the least is kept, the rightmost of equals, with its
position.  Two texts that share window + k - 1 pieces in a row share a kept hash.  A text of fewer pieces than k has one hash
of all its pieces; of fewer hashes than a window, the least of them is kept; an empty one (or null, or all white space) has
an empty fingerprint.

Ties between equal texts or ids are broken by the text; very long texts are fingerprinted whole; of extra columns none is read.

Likeness is the Jaccard index of the sets of kept hashes; two empty fingerprints are alike, an empty and another are not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 4
K = 3
WINDOW = 8
#: Code points that follow in a run where pieces overlap: more than a word has, so only text without spaces is concerned.
LONG_RUN = 16
#: Modulus and base of the rolling hash: products stay below 2^63.
_P = (1 << 31) - 1
_BASE = 1_000_003
#: Positions are packed under the hash, turned round so that the least of equal hashes is the rightmost.
_LAST = (1 << 31) - 1


def piece_hashes(text: Column, piece: int = PIECE, overlap: int = 0) -> Column:
    if overlap is True:
        overlap = piece
    pattern = rf"(?=(\S{{1,{piece}}}))(?:\S(?=\S{{{overlap}}})|\S{{1,{piece}}})" if overlap else rf"(\S{{1,{piece}}})"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: F.pmod(F.xxhash64(s), F.lit(_P)))


def gram_hashes(pieces: Column, k: int = K) -> Column:
    """Rolling hash of each k pieces in a row, with the turned position below it."""

    def gram(i: Column) -> Column:
        total = F.get(pieces, i)
        for j in range(1, k):
            total = (total * _BASE + F.get(pieces, i + j)) % _P
        return total

    def packed(h: Column, i: Column) -> Column:
        return F.shiftleft(h, 31).bitwiseOR(F.lit(_LAST) - i)

    every = F.transform(F.sequence(F.lit(0), F.size(pieces) - k), lambda i: packed(gram(i), i.cast("bigint")))
    short = F.array(packed(F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, x: (a * _BASE + x) % _P), F.lit(0).cast("bigint")))
    return F.when(F.size(pieces) == 0, F.array().cast("array<bigint>")).when(F.size(pieces) < k, short).otherwise(every)


def kept(grams: Column, window: int = WINDOW) -> Column:
    """The least packed value of each window, each once, in order of position."""

    def least(i: Column) -> Column:
        return F.least(*[F.get(grams, i + j) for j in range(window)])

    every = F.transform(F.sequence(F.lit(0), F.size(grams) - window), least)
    return F.when(F.size(grams) == 0, grams).when(F.size(grams) < window, F.array(F.array_min(grams))).otherwise(F.array_distinct(every))


def with_fingerprint(df: DataFrame, text: str, name: str, *, piece: int = PIECE, k: int = K, window: int = WINDOW, overlap: int = 0) -> DataFrame:
    """df with `name`, the packed fingerprint of the text: hash * 2^31 + 2^31 - 1 - position."""
    part = lambda s: f"__{name}_{s}"
    df = df.withColumn(part("p"), piece_hashes(F.coalesce(F.col(text), F.lit("")), piece, overlap))
    df = df.withColumn(part("g"), gram_hashes(F.col(part("p")), k))
    return df.withColumn(name, kept(F.col(part("g")), window)).drop(part("p"), part("g"))


def hashes(packed: Column) -> Column:
    """The set of kept hashes."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, 31).cast("int")))


def rendered(packed: Column) -> Column:
    """The fingerprint as text: position:hash in decimal, in order of position, joined by spaces."""
    return F.array_join(F.transform(packed, lambda x: F.concat_ws(":", (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"), F.shiftright(x, 31).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of hashes."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """docs, dealt into ranges of falling doc_id, with `part`, and `guard` for the first rows of the next range, which stand at the end of each (the last range is followed by the first)."""
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.withColumn("ord", order)
    cuts = docs.agg(F.percentile_approx("ord", [i / parts for i in range(1, parts)], 100 * parts), F.max("ord")).first() if parts > 1 else None
    if cuts is None or not cuts[0]:
        top, bounds = docs.agg(F.max("ord")).first()[0], []
    else:
        bounds, top = sorted({c for c in cuts[0]} - {cuts[1]}, reverse=True), cuts[1]
    # range p holds bounds[p - 1] >= ord > bounds[p]; the first row of range p is the one with ord = bounds[p - 1]
    if bounds:  # counted in two steps, so that a row looks at about 2 * sqrt(parts) limits
        width = math.isqrt(len(bounds) - 1) + 1
        groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
        reached = F.size(F.filter(F.lit([x[0] for x in groups]).cast("array<bigint>"), lambda b: b >= F.col("ord")))
        inside = F.get(F.array(*[F.lit(x).cast("array<bigint>") for x in groups]), F.col("reached") - 1)
        docs = docs.withColumn("reached", reached)
        part = F.when(F.col("reached") == 0, 0).otherwise((F.col("reached") - 1) * width + F.size(F.filter(inside, lambda b: b >= F.col("ord"))))
    else:
        part = F.lit(0)
    docs = docs.withColumn("part", part)
    heads = {b: i for i, b in enumerate(bounds)} | {top: len(bounds)}
    is_head = F.col("ord").isin(*heads) if top is not None else F.lit(False)
    before = F.pmod(F.col("part") - 1, F.lit(len(bounds) + 1))
    places = F.when(is_head, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guard")), F.struct(before.alias("part"), F.lit(True).alias("guard")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guard"))))
    return docs.withColumn("place", F.explode(places)).withColumn("part", F.col("place.part")).withColumn("guard", F.col("place.guard")).drop("place", "reached")


def edited_fingerprints(docs: DataFrame, *, parts: int | None = None, piece: int = PIECE, k: int = K, window: int = WINDOW, overlap: int = 0) -> DataFrame:
    """Fingerprints (packed) of each row's text and of its edited text, and how near its own is to that and to the next row's.

    Edited: the last n_chars / 2 code points (rounded down) give way to as many of the next row's first, or all.  The next
    row is that of the next smaller doc_id (equal ids by text, null last), after the last the first; a single row is its own
    next.  One shuffle carries the texts: ranges of ids are dealt out with the next range's first row behind them.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * n
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = _dealt(source, parts).repartition(n, "part").sortWithinPartitions("part", "guard", F.desc("ord"), "text")
    marked = with_fingerprint(dealt, "text", "own", piece=piece, k=k, window=window, overlap=overlap)
    ahead = Window.partitionBy("part").orderBy("guard", F.desc("ord"), "text")
    size = F.char_length("text")
    both = marked.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_own", F.lead("own").over(ahead)).where("not guard")
    both = both.withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 2) as int))")))
    both = with_fingerprint(both, "edited", "changed", piece=piece, k=k, window=window, overlap=overlap)
    both = both.withColumn("h_own", hashes(F.col("own"))).withColumn("h_changed", hashes(F.col("changed"))).withColumn("h_next", hashes(F.col("next_own")))
    return both.select(
        "doc_id",
        size.cast("bigint").alias("n_chars"),
        "edited",
        F.col("own").alias("fingerprint"),
        F.col("changed").alias("edited_fingerprint"),
        likeness(F.col("h_own"), F.col("h_changed")).alias("near_edited"),
        likeness(F.col("h_own"), F.col("h_next")).alias("near_next"),
    )
