"""Text functions of recognition rows, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edit weights, the near-list budget and the letters a handwritten digit reads as.
SUBSTITUTE, DELETE, INSERT, FIRST, BUDGET = 1.0, 2.0, 1.0, 2.0, 3.0
SHAPED = "lLIiSsGgOoBbZzqADT|"
MARKS = ".:)\\]\\-_"
LONGEST_WORD = 8


def normalise(read: Column) -> Column:
    """Lower case, letters a to z only."""
    return F.regexp_replace(F.lower(read), "[^a-z]", "")


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def weighted_distance(read: Column, word: Column) -> Column:
    """Edit distance from a read to a word: deleting costs 2, the rest 1; edits of the read's first
    letter, and inserting ahead of it, cost twice as much."""
    raw, target = _letters(read), _letters(word)
    size = F.size(target)
    top = F.transform(F.sequence(F.lit(0), size), lambda j: F.when(j == 0, F.lit(0.0)).otherwise(INSERT * FIRST + (j - 1) * INSERT).cast("double"))

    def row(before: Column, letter: Column, i: Column) -> Column:
        """The next row of the table, built cell by cell behind its first cell."""
        weight = F.when(i == 0, FIRST).otherwise(1.0)
        start = F.array((DELETE * FIRST + i * DELETE).cast("double"))

        def cell(done: Column, j: Column) -> Column:
            swap = F.when(F.element_at(target, j) == letter, 0.0).otherwise(SUBSTITUTE * weight)
            value = F.least(F.element_at(before, j + 1) + DELETE * weight, F.element_at(done, -1) + INSERT, F.element_at(before, j) + swap)
            return F.concat(done, F.array(value))

        places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, cell)

    numbered = F.transform(raw, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.element_at(F.aggregate(numbered, top, lambda before, x: row(before, x["c"], x["i"])), -1)


def log_score(p: Column, distance: Column, weight: float = 1.0, scale: Column | None = None) -> Column:
    """log10(p) - weight * distance; minus infinity at p = 0."""
    d = distance / scale if scale is not None else distance
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log10(p) - weight * d)


def squared_log_score(p: Column, distance: Column, weight: float = 1.0) -> Column:
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log10(p) - weight * distance * distance)


def power_complement_score(p: Column, distance: Column, n: float) -> Column:
    return F.lit(0.0) - distance * F.pow(1 - p, F.lit(n))


def complement_power_score(p: Column, distance: Column, n: float) -> Column:
    return F.lit(0.0) - distance * (1 - F.pow(p, F.lit(n)))


def label_of(token: Column) -> Column:
    """struct(kind, n): the ordinal label a token reads as, exact, shaped or null."""
    body = F.regexp_replace(F.regexp_replace(token, r"^\s+|\s+$", ""), rf"[{MARKS}\s]+$", "")
    digits = body.rlike("^[0-9]{1,2}$") & (body.cast("int") >= 1)
    shaped = body.rlike(rf"^[0-9{SHAPED.replace('|', '')}]{{1,2}}$") & ~body.rlike("^[0-9]+$")
    kind = F.when(digits, "exact").when(shaped, "shaped")
    return F.struct(kind.alias("kind"), F.when(digits, body.cast("int")).alias("n"))


def past_label(read: Column) -> Column:
    """The rest of a read behind the label it begins with; null where it begins with none."""
    rest = F.regexp_extract(read, rf"^(?:[0-9{SHAPED}]{{2}}|[0-9{SHAPED}](?![0-9{SHAPED}]))[{MARKS}\s]+(.+)$", 1)
    return F.when(rest != "", rest)


def dotted_prefix(literal: Column) -> Column:
    """struct(head, remainder): at most two letters or digits before a dot; null without one."""
    start = F.regexp_replace(literal, r"^\s+", "")
    found = start.rlike(r"^[\p{IsAlphabetic}\p{N}]{0,2}\.")
    return F.when(
        found,
        F.struct(F.substring_index(start, ".", 1).alias("head"), F.regexp_replace(F.regexp_replace(start, r"^[^.]*\.", ""), r"^\s+", "").alias("remainder")),
    )


def leading_digit(read: Column) -> Column:
    return read.rlike("^[0-9]")


def alphabetic_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"\p{IsAlphabetic}")))


def prose(text: Column) -> Column:
    """Two tokens with letters or more."""
    return alphabetic_tokens(text) >= 2


def shape_possible(text: Column) -> Column:
    """Short enough for a list word, and one token with letters at most."""
    return (F.length(normalise(text)) <= LONGEST_WORD) & (alphabetic_tokens(text) <= 1)


def strip_numbering(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "^[0-9]+", ""), "^[.):]+", ""), r"^\s+", "")


def worksheet_letters(word: Column) -> Column:
    """The first four letters in capitals, filled up with dashes."""
    return F.rpad(F.upper(F.substring(word, 1, 4)), 4, "-")
