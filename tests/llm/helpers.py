"""Small inputs and plain versions of what the operators compute."""

import re

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def documents(spark, rows):
    """Documents from (doc_id, text[, source]), with the other columns null."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def close(a, b, tolerance=1e-9):
    return a == pytest.approx(b, rel=tolerance, abs=tolerance)
