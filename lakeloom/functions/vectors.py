"""Array maths that has no built-in: holographic codes by circular convolution, graphemes, suffixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())


@F.pandas_udf(VECTOR)
def bind(a: pd.Series, b: pd.Series) -> pd.Series:
    """Circular convolution of two vectors of one length."""
    return pd.Series([np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), n=len(x)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(VECTOR)
def unbind(a: pd.Series, b: pd.Series) -> pd.Series:
    """Circular correlation, which undoes bind for role vectors of unit spectrum."""
    return pd.Series([np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), n=len(x)) for x, y in zip(a, b, strict=True)])


def unit_role(seed: int, size: int) -> np.ndarray:
    """A real vector whose spectrum has magnitude one and seeded phases."""
    phase = np.random.default_rng(seed).uniform(-np.pi, np.pi, size // 2 + 1)
    spectrum = np.exp(1j * phase)
    spectrum[0] = 1
    if size % 2 == 0:
        spectrum[-1] = 1
    return np.fft.irfft(spectrum, n=size)


@F.pandas_udf(T.ArrayType(T.StringType()))
def graphemes(text: pd.Series) -> pd.Series:
    """User-perceived characters; conjuncts of Indic scripts stay whole."""
    import regex

    cluster = regex.compile(r"\X")
    return text.map(lambda t: None if t is None else cluster.findall(t))


# Endings that are split off, of two Dravidian languages, and the first code points of Indic blocks.
TELUGU_SUFFIXES = (
    "గురించి", "ద్వారా", "కోసం", "వరకు", "నుండి", "వల్ల", "లోని", "యొక్క", "లను", "లకు", "లో", "కి", "కు", "తో", "గా", "పై", "చే", "అనే",
    "ను", "ని", "లు", "ల", "వి", "డు", "మ", "పు",
)
KANNADA_SUFFIXES = ("ದಲ್ಲಿ", "ಯನ್ನು", "ವನ್ನು", "ಗಾಗಿ", "ಇಂದ", "ಗಳು", "ಗಳ", "ಗೆ", "ಯಲ್ಲಿ", "ವರೆಗೆ", "ದ", "ವು", "ನ", "ಯ", "ಕ್ಕೆ")
BLOCKS = {"DEVANAGARI": 0x0900, "TELUGU": 0x0C00, "KANNADA": 0x0C80}


def script_of(word: str) -> str | None:
    """The script of the first character that is in a known block."""
    for c in word:
        for name, first in BLOCKS.items():
            if first <= ord(c) < first + 0x80:
                return name
    return None


def profiled(word: str, transliterate: bool, suffixes: bool) -> list[str]:
    """A pre-token moved to the pivot script and cut before a known ending, as the profile says."""
    script = script_of(word)
    endings = {"TELUGU": TELUGU_SUFFIXES, "KANNADA": KANNADA_SUFFIXES}.get(script, ())
    parts = split_suffix(word, endings, clusters=True) if suffixes else [word]
    if transliterate and script not in (None, "DEVANAGARI"):
        parts = [to_pivot_script(x, BLOCKS[script]) for x in parts]
    return parts


def split_suffix(word: str, suffixes: tuple[str, ...], least: int = 2, clusters: bool = False) -> list[str]:
    """[stem, suffix] for the longest suffix that leaves a stem of at least `least` characters, or user-perceived ones, else [word]."""
    import regex

    size = (lambda x: len(regex.findall(r"\X", x))) if clusters else len
    for s in sorted(suffixes, key=len, reverse=True):
        if word.endswith(s) and len(word) > len(s) and size(word[: -len(s)]) >= least:
            return [word[: -len(s)], s]
    return [word]


def to_pivot_script(text: str, first: int, pivot: int = 0x0900, width: int = 0x80) -> str:
    """Characters of an Indic block moved to the same place of the pivot block."""
    return "".join(chr(ord(c) - first + pivot) if first <= ord(c) < first + width else c for c in text)
