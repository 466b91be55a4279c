"""Small tables for the operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, ids=None):
    """A documents table of the given texts."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t)))
    return spark.createDataFrame(rows, SCHEMA)


#: Null, empty, blank, repeated and long texts, letters beyond ASCII.
ODD = [None, "", " \n\t ", "a b c", "a b c", "Ünïcödé wörds — ok", "x " * 3000, "A B C", "one", None, "\x00 nul", "tab\tand nbsp"]
