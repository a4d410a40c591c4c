"""Document fingerprints by winnowing, in SQL functions alone.

A text's units are its words (lower case, parted by white space); a word of more than LONG_WORD characters,
as in scripts without spaces, counts as its runs of CHARS characters, one from each place, instead. Units
are hashed, every K neighbouring ones together; of every window of neighbouring hashes the least is kept,
of equal ones the rightmost, with its place. A window holds WINDOW hashes, in texts of fewer than
WINDOW * SPREAD hashes that many times fewer, so that short texts keep several; the least of a window is
also the least of every smaller one around it, so texts of different windows still share hashes. Two texts
that share K + WINDOW - 1 units in a row therefore share a kept hash, and the places tell where. A text of
fewer than K units has one hash over all of them.

Defined cases: null and empty text have an empty fingerprint; two empty fingerprints are alike (1), an
empty and another are not (0); texts of any length are taken whole; equal texts have equal fingerprints; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.session import shuffle_width

K, WINDOW, SPREAD = 5, 8, 4
LONG_WORD, CHARS = 32, 4
CELLS = 128  # quantiles of the key that start a range; ranges are cut further by value


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where the body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """array<struct<place int, hash bigint>> in order of place; place counts units from 0."""

    def of_chars(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - CHARS), lambda i: F.xxhash64(*[F.get(chars, i + j) for j in range(CHARS)]))

    def of_long(words: Column) -> Column:
        one = lambda w: F.when(F.char_length(w) > LONG_WORD, _let(F.split(w, ""), of_chars)).otherwise(F.array(F.xxhash64(w)))
        return F.flatten(F.transform(words, one))

    def of_words(words: Column) -> Column:
        plain = F.transform(words, lambda w: F.xxhash64(w))
        return _let(F.when(F.exists(words, lambda w: F.char_length(w) > LONG_WORD), of_long(words)).otherwise(plain), of_hashes)

    def of_hashes(hashes: Column) -> Column:
        n = F.size(hashes)
        each = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]))
        few = F.array(F.xxhash64(hashes))
        return F.when(n == 0, F.array().cast("array<struct<place:int,hash:bigint>>")).otherwise(_let(F.when(n < K, few).otherwise(each), of_grams))

    def of_grams(grams: Column) -> Column:
        ordered = F.transform(grams, lambda g, i: F.struct(g.alias("g"), (-i).alias("back")))
        return _let(ordered, lambda o: of_ordered(grams, o))

    def of_ordered(grams: Column, ordered: Column) -> Column:
        width = F.greatest(F.least(F.floor(F.size(grams) / SPREAD).cast("int"), F.lit(WINDOW)), F.lit(1))
        least = lambda i: -F.array_min(F.slice(ordered, i, width))["back"]
        kept = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - width + 1), least))
        return F.transform(kept, lambda p: F.struct(p.alias("place"), F.get(grams, p).alias("hash")))

    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    return _let(words, of_words)


def spelled(prints: Column) -> Column:
    """The fingerprint as text: place:hash in hexadecimal, parted by spaces."""
    return F.concat_ws(" ", F.transform(prints, lambda x: F.concat(x["place"].cast("string"), F.lit(":"), F.lower(F.hex(x["hash"])))))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints against all of them."""
    x, y = a["hash"], b["hash"]
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _text, _print and the same of the next row by key (of equal keys by text), for the last the first's.

    Rows go to ranges of the key, cut at its quantiles and between these by value, and every range gets
    the first row of the next one as a guest; so one shuffle and no window over all rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    shares = [i / CELLS for i in range(CELLS + 1)]
    edges = rows.agg(F.percentile_approx("_key", F.array(*map(F.lit, shares)), F.lit(10 * CELLS)).alias("e")).first()["e"] or [0]
    edges = sorted(set(edges))
    finer = max(1, -(-4 * shuffle_width(spark) // CELLS))
    starts = F.array(*[F.lit(e).cast("long") for e in edges])
    cell = F.size(F.filter(starts, lambda e: e <= F.col("_key")))
    low, high = F.get(starts, cell - 1), F.coalesce(F.get(starts, cell), F.get(starts, cell - 1) + 1)
    inner = F.least(F.floor((F.col("_key") - low) / (high - low) * finer), F.lit(finer - 1))
    # keys below the first quantile and null keys come first, in one range of their own
    placed = rows.withColumn("_range", F.coalesce(F.when(cell > 0, cell * finer + inner), F.lit(-1)).cast("long"))
    order = [F.col("_key").asc_nulls_first(), F.col("_text")]
    firsts = placed.groupBy("_range").agg(F.min(F.struct(F.col("_key").isNotNull().alias("has"), F.col("_key").alias("k"))).alias("first"))
    by_range = Window.orderBy("_range")  # a row per range
    every = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hosts = firsts.select(F.col("first.k").alias("_guest"), F.coalesce(F.lag("_range").over(by_range), F.last("_range").over(every)).alias("_host"))
    guests = rows.join(F.broadcast(hosts), F.col("_key").eqNullSafe(F.col("_guest"))).select("_key", "_text", F.col("_host").alias("_range"), F.lit(True).alias("_is_guest"))
    dealt = placed.withColumn("_is_guest", F.lit(False)).unionByName(guests).repartition(4 * shuffle_width(spark), "_range")
    dealt = dealt.withColumn("_print", fingerprint(F.col("_text")))
    at = Window.partitionBy("_range").orderBy("_is_guest", *order)
    following = [F.lead(c).over(at).alias(f"_next{c}") for c in ("_text", "_print")]
    return dealt.select("*", *following).filter(~F.col("_is_guest")).select("_key", "_text", "_print", "_next_text", "_next_print")


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by the beginning of the following one."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_chars, edited_sha256, both fingerprints as text, near_edited, near_next."""
    pairs = with_next(df, key, text).withColumn("_edited", edited(F.col("_text"), F.col("_next_text")))
    prints = pairs.select(
        F.col("_key").alias(key), F.char_length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        "_print", "_next_print", fingerprint(F.col("_edited")).alias("_edited_print"),
    )
    return prints.select(
        key, "n_chars", "edited_sha256", spelled(F.col("_print")).alias("fingerprint"), spelled(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"), likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
