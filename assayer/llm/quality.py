"""Line-first cleaning, in DataFrame functions only.

Every line meets the punctuation, navigation and boilerplate rules; failing lines are removed, and a document that
loses more than LOST of its word characters is rejected. Base counts come from the whole text.

Defined results: null or empty text has no words, fails the base rule and is not kept; blank lines are no lines;
extra columns are not read; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 50
REPEATED_PERCENT = 50
LOST = 0.5
#: A line fails the punctuation rule when symbols make up more than a fifth of its word characters.
SYMBOL_SHARE = 0.2
#: A line fails the navigation rule when a quarter of its words are lone separators.
SEPARATOR_SHARE = 0.25
#: Lines of at most so many words fail the boilerplate rule if they hold one of its phrases.
BOILERPLATE_WORDS = 25
#: Fixed values.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "click here",
    "enable javascript",
    "subscribe to our",
    "sign up for",
    "log in to",
    "share this",
    "lorem ipsum",
)
_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
#: A word of separators alone.
_SEPARATOR = r"(?<![^\x20\x09-\x0D])[|>\x{00BB}\x{2022}\x{00B7}/-]++(?![^\x20\x09-\x0D])"
#: A line with more words than the boilerplate rule takes.
_LONGER = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{{BOILERPLATE_WORDS + 1}}}"
#: Bits of a place in an array, which has fewer than 2**31, and the number that masks them.
_PLACE_BITS = 31
_PLACES = (1 << _PLACE_BITS) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _from(array: str, first: int, shorter: int) -> Column:
    """The array from place ``first`` on (1 is its begin), cut to a length that is ``shorter`` than the whole one's."""
    return F.slice(array, F.lit(first), F.greatest(F.size(array) - shorter, F.lit(0)))


def _neighbours(array: str) -> Column:
    return F.arrays_zip(_from(array, 1, 1).alias("x"), _from(array, 2, 1).alias("y"))


def _repeats(documents: DataFrame) -> DataFrame:
    """Turns ``words`` into ``n_repeat_words``.

    Windows become numbers, 33 bits of their hash ahead of their place, which sort without objects. Equal windows have equal
    bits; only places whose bits a neighbour has are looked at again, in order of the whole hash and the words themselves.
    """
    place = lambda key: key.bitwiseAND(F.lit(_PLACES)).cast("int")
    out = documents.withColumn("windows", F.arrays_zip(*(_from("words", k, 2).alias(f"w{k}") for k in (1, 2, 3))))
    key = lambda w, i: F.shiftleft(F.xxhash64(w), _PLACE_BITS).bitwiseOR(i.cast("long"))
    out = out.withColumn("keys", F.sort_array(F.transform("windows", key)))
    near = F.filter(_neighbours("keys"), lambda z: F.shiftright(z["x"].bitwiseXOR(z["y"]), _PLACE_BITS) == 0)
    out = out.drop("words").withColumn("near", near)
    places = F.array_distinct(F.concat(F.transform("near", lambda z: place(z["x"])), F.transform("near", lambda z: place(z["y"]))))
    out = out.withColumn("places", places)
    window = lambda i: F.get("windows", i)
    told = F.transform("places", lambda i: F.struct(F.xxhash64(window(i)).alias("h"), window(i).alias("w"), i.alias("i")))
    out = out.withColumn("told", F.sort_array(told))
    same = F.filter(_neighbours("told"), lambda z: (z["x"]["h"] == z["y"]["h"]) & (z["x"]["w"] == z["y"]["w"]))
    out = out.withColumn("same", same)
    out = out.withColumn("found", F.array_distinct(F.concat(F.transform("same", lambda z: z["x"]["i"]), F.transform("same", lambda z: z["y"]["i"]))))
    covered = F.array_distinct(F.concat("found", F.transform("found", lambda i: i + 1), F.transform("found", lambda i: i + 2)))
    return out.withColumn("n_repeat_words", _size(covered)).drop("windows", "keys", "near", "places", "told", "same", "found")


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = documents.select("doc_id", text.alias("text")).withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    counted = split.select(
        "doc_id",
        "text",
        "words",
        _size(F.col("words")).alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (_size(lines) - _size(F.array_distinct(lines))).alias("n_dup_lines"),
    )
    return _repeats(counted)


def failing(line: Column) -> Column:
    """Whether a line fails one of the rules; one without a word fails none.

    Most lines hold no symbol and no lone separator and have too many words for the third rule: a short look tells, and nothing is counted.
    """
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    chars = F.length(F.regexp_replace(line, _GAP, ""))
    marked = line.rlike(r"[#*$%&|<>]") & (symbols > SYMBOL_SHARE * chars)
    menu = line.rlike(_SEPARATOR) & (F.regexp_count(line, F.lit(_SEPARATOR)) >= SEPARATOR_SHARE * F.size(_words(line)))
    boilerplate = ~line.rlike(_LONGER) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return marked | menu | boilerplate


def clean(documents: DataFrame) -> DataFrame:
    """base_counts with base_failed, cleaned (the text without failing lines), lost (share of word characters) and kept."""
    counted = base_counts(documents)
    lines = F.split("text", "\n")
    out = counted.withColumn("cleaned", F.array_join(F.filter(lines, lambda x: ~failing(x)), "\n"))
    # Every word character is in one line, so what is left is what did not go.
    gone = F.array_join(F.filter(lines, failing), "\n")
    left = F.col("word_chars") - F.length(F.regexp_replace(gone, _GAP, ""))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    out = out.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(1.0)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= LOST))


def verdicts(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
