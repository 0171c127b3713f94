"""Column expressions over text: canonical form, hashes, words, lines, shingles."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


@F.pandas_udf(T.StringType())
def casefold_without_joiners(text: pd.Series) -> pd.Series:
    """Case folding with zero-width joiners dropped, as tokenizer input."""
    drop = dict.fromkeys((0x200C, 0x200D))
    return text.map(lambda t: None if t is None else t.translate(drop).casefold())


def canonical(text: Column) -> Column:
    """Line ends as U+000A and Unicode composed; texts without a character above U+007F are not sent to Python."""
    lines = unix_lines(text)
    return F.coalesce(nfc(F.when(lines.rlike(r"[^\x00-\x7F]"), lines)), lines)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_parts(*parts: Column) -> Column:
    """SHA-256 over length-prefixed parts, so that no two lists of parts run together alike."""
    framed = [F.concat(F.octet_length(p).cast("string"), F.lit("\x1f"), p, F.lit("\x1e")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def space_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))


def letter_runs(text: Column) -> Column:
    """Runs of letters, marks and digits of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def faithful_units(text: Column) -> Column:
    """Number of word runs and single other visible characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def pretokens(text: Column) -> Column:
    """Runs of letters, runs of digits, single other visible characters."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+|\p{Nd}+|\S"), F.lit(0))


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def word_shingles(words: Column, size: int, short: str = "whole") -> Column:
    """Distinct runs of `size` words; a shorter text gives one shingle ("whole") or none ("none")."""
    def build(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        few = F.array(F.array_join(w, " ")) if short == "whole" else F.expr("cast(array() as array<string>)")
        return F.when(F.size(w) >= size, F.array_distinct(grams)).otherwise(few)

    return let(words, build)


def char_shingles(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters; a text of at most `size` gives itself."""
    def build(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(t) - (size - 1)), lambda i: F.substring(t, i, F.lit(size)))
        return F.when(F.length(t) > size, F.array_distinct(grams)).otherwise(F.array(t))

    return let(text, build)


def distinct_runs(text: str, size: int) -> int:
    """Number of distinct runs of `size` characters; a text of at most `size` is one.

    Characters are numbered within the text, and a run is the number that its characters' numbers make
    as digits. Texts of so many different characters that this exceeds 64 bits are counted by their runs.
    """
    if len(text) <= size:
        return 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bits, top = 64 // size, int(codes.max())
    if top >> bits:
        known = np.unique(codes)
        if len(known) > 1 << bits:
            return len({text[i : i + size] for i in range(len(text) - size + 1)})
        number = np.zeros(top + 1, np.uint32)
        number[known] = np.arange(len(known), dtype=np.uint32)
        codes = number[codes]
    codes = codes.astype(np.uint64)
    count = len(codes) - size + 1
    keys = codes[:count].copy()
    for i in range(1, size):
        keys <<= np.uint64(bits)
        keys |= codes[i : i + count]
    keys.sort()
    return 1 + int(np.count_nonzero(keys[1:] != keys[:-1]))


def char_shingle_count(text: Column, size: int) -> Column:
    """Size of `char_shingles` of a text, which are not made."""
    @F.pandas_udf(T.IntegerType())
    def counted(text: pd.Series) -> pd.Series:
        return text.map(lambda t: distinct_runs(t, size))

    return counted(text)


def seeded_fraction(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
