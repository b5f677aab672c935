"""Documents that every operator meets: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, row string, score double"


def documents(spark, texts):
    """texts: (doc_id, text); the further columns clash with names that operators use inside."""
    return spark.createDataFrame([(d, t, None, "s", None, 7, None, "x", None) for d, t in texts], SCHEMA)


PROSE = "the quick brown fox jumps over the lazy dog while seven other animals watch from a distance and say nothing at all about it"
ODD = [
    (1, PROSE),
    (2, PROSE),
    (2, PROSE),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "word"),
    (7, "two words"),
    (8, "ÄÖ ünï code   x\r\ny <|endoftext|> 's  double  space "),
    (9, (PROSE + "\n") * 900),
    (None, "no id " + PROSE),
]
