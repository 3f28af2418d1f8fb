"""Document fingerprints by winnowing (operator 6).

Schleimer, Wilkerson and Aiken, "Winnowing: Local Algorithms for Document
Fingerprinting" (2003).  A text's words are hashed, a polynomial rolls over every
``GRAM`` of them, and from every ``WINDOW`` neighbouring grams the smallest value is
chosen, the rightmost of equal ones.  Chosen grams keep their positions.  Two
texts that share ``GRAM + WINDOW - 1`` words in a row share a chosen gram.

Only DataFrame functions are used, each linear in the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.llm.common import let

GRAM, WINDOW = 5, 16
#: A run of letters and digits; a longer run, as in scripts without blanks, is cut into such pieces.
WORD = r"[\p{L}\p{N}]{1,16}"
PRIME, BASE = (1 << 31) - 1, 1_000_003
LOW = 1 << 32
#: Rows that are ordered together, about.
SLICE_ROWS = 1024
#: Ranges of doc_id with about as many rows each, which are cut into slices on their own.
RANGES = 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _grams(words: Column) -> Column:
    """The rolling value of every ``GRAM`` words; of all words, if there are fewer."""

    def roll(hashes: Column) -> Column:
        n, rolled = F.size(hashes), hashes
        for k in range(1, GRAM):
            # past the end the second array has nulls, and so has the result
            rolled = F.zip_with(rolled, F.slice(hashes, k + 1, n), lambda a, b: (a * BASE + b) % PRIME)
        whole = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, b: (a * BASE + b) % PRIME)
        return (
            F.when(n >= GRAM, F.slice(rolled, F.lit(1), n - (GRAM - 1)))
            .when(n > 0, F.array(whole))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME).cast("bigint"))), roll)


def _window_minima(grams: Column) -> Column:
    """The least of every ``WINDOW`` neighbours, from the least of every 2, 4, 8 ... of them."""

    def doubled(v: Column, reach: int) -> Column:
        step = min(reach, WINDOW - reach)
        if not step:
            return v
        return let(F.zip_with(v, F.slice(v, step + 1, F.size(v)), lambda a, b: F.least(a, b)), lambda x: doubled(x, reach + step))

    n = F.size(grams)
    return F.when(n <= WINDOW, F.filter(F.array(F.array_min(grams)), lambda x: x.isNotNull())).otherwise(
        F.slice(doubled(grams, 1), F.lit(1), n - (WINDOW - 1))
    )


def fingerprint(text: Column) -> Column:
    """Chosen grams in order, as ``value * 2**32 + 2**32 - 1 - position``; none for a text without words.

    So the least of equal values is the rightmost one.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    placed = F.transform(_grams(words), lambda h, i: h * F.lit(LOW) + (F.lit(LOW - 1) - i))
    return F.array_distinct(let(placed, _window_minima))


def values(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32)))


def text_form(chosen: Column) -> Column:
    """``value:position`` of every chosen gram, the value in hexadecimal, the position in words from 0."""
    return F.array_join(
        F.transform(
            chosen,
            lambda x: F.concat(
                F.lower(F.lpad(F.hex(F.shiftright(x, 32)), 8, "0")), F.lit(":"), (F.lit(LOW - 1) - x % LOW).cast("string")
            ),
        ),
        " ",
    )


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of the values of two fingerprints; 1 if both have none, 0 if one has."""
    return let(
        F.struct(values(left).alias("a"), values(right).alias("b")),
        lambda x: let(
            F.size(F.array_intersect(x["a"], x["b"])),
            lambda both: F.when(F.size(x["a"]) + F.size(x["b"]) == 0, 1.0).otherwise(
                both / (F.size(x["a"]) + F.size(x["b"]) - both)
            ),
        ),
    )


def _edges(docs: DataFrame) -> list[int]:
    """Least doc_ids of the ranges, but the first; an id that fills a range has one of its own."""
    shares = [k / RANGES for k in range(1, RANGES)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 20 * RANGES).alias("at")).first()["at"] or []
    repeated = {a for a, b in zip(found, found[1:]) if a == b}
    return sorted(set(found) | {a + 1 for a in repeated if a < MOST})


def _sliced(docs: DataFrame) -> DataFrame:
    """Add ``_slice``, which never falls when doc_id, then text rise; rows without doc_id are below all others.

    A range is cut by equal widths of doc_id, one of a single doc_id by the first bytes of the texts.  Widths
    follow from counts, so a far doc_id widens the slices of its own range alone.
    """
    c = F.col
    edges = _edges(docs)
    number = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), lambda e: e <= c("doc_id")))
    head = F.rpad(F.hex(F.substring(F.encode("text", "utf-8"), 1, 7)), 14, "0")
    begin = F.conv(head, 16, 10).cast("bigint")
    ranged = docs.withColumns({"_range": F.when(c("doc_id").isNull(), -1).otherwise(number), "_begin": begin})
    counted = ranged.groupBy("_range").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("_begin").alias("low_text"),
        F.max("_begin").alias("high_text"), F.count(F.lit(1)).alias("n"),
    )
    cuts = {}  # by range, of which there are at most 2 * RANGES
    for r in counted.collect():
        low, high = (r.low_text, r.high_text) if r.low == r.high else (r.low, r.high)
        cuts[r["_range"]] = (low, min(MOST, -(-(high - low + 1) // max(1, r.n // SLICE_ROWS))), r.low == r.high)
    listed = [cuts.get(k, (0, 1, False)) for k in range(-1, len(edges) + 1)]
    of_range = lambda i, kind: F.element_at(F.array(*[F.lit(x[i]).cast(kind) for x in listed]), c("_range") + 2)
    position = F.when(of_range(2, "boolean"), c("_begin")).otherwise(c("doc_id"))
    wide = lambda x: x.cast("decimal(20,0)")  # noqa: E731 -- differences of two ids may pass 64 bits
    inner = F.call_function("div", wide(position) - wide(of_range(0, "bigint")), wide(of_range(1, "bigint")))
    return ranged.withColumn("_slice", F.shiftleft(c("_range").cast("bigint"), 40) + inner).drop("_range", "_begin")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, chosen, next_text and next_chosen: of the next row, descending doc_id, after the last the first.

    Rows are ordered in slices of about ``SLICE_ROWS`` rows each; only the number of each slice is ordered in one
    place.  Any ids of 64 bits will do.  Rows of one doc_id whose texts begin with the same seven bytes share a slice.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut, name = _sliced(docs), "_slice"
    order = [F.desc_nulls_last("doc_id"), F.desc("text")]
    after = F.lead(F.struct("text", "chosen")).over(Window.partitionBy(name).orderBy(*order))
    rows = cut.withColumn("chosen", fingerprint(F.col("text"))).withColumn("after", after)

    first = F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")
    heads = cut.groupBy(name).agg(F.max(first).alias("head"))
    by_number = Window.orderBy(F.desc(name))
    whole = by_number.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbers = cut.select(name).distinct().select(
        name, F.coalesce(F.lead(name).over(by_number), F.first(name).over(whole)).alias("then")
    )
    heads = heads.select(F.col(name).alias("then"), F.col("head.text").alias("head_text"))
    heads = numbers.join(heads, "then").select(name, "head_text", fingerprint(F.col("head_text")).alias("head_chosen"))
    return rows.join(heads, name, "left").select(
        "doc_id", "text", "chosen",
        F.coalesce("after.text", "head_text").alias("next_text"),
        F.coalesce("after.chosen", "head_chosen").alias("next_chosen"),
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's whole text and of its edited text, and how alike they are.

    The edited text has the last third of its code points, rounded down, replaced
    by the first as many, or all, of the next row's text.  Null texts are empty;
    rows that repeat a doc_id are ordered by text; a single row is its own next one;
    no rows in, no rows out.  Further columns are ignored.
    """
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int"))
    edited = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    both = edited.withColumn("pair", let(fingerprint(F.col("edited")), lambda x: F.struct(
        text_form(x).alias("edited_fingerprint"), likeness(F.col("chosen"), x).alias("near_edited"))))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_form(F.col("chosen")).alias("fingerprint"),
        "pair.edited_fingerprint",
        "pair.near_edited",
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )
