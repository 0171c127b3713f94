"""Secret scans with a trigram inverted index.

Each rule's regular expression is parsed and turned into a Boolean query over trigrams of UTF-8
bytes, ASCII letters folded, that every match must contain. A block of texts is read once: each
text's own trigrams that any rule asks for go into postings (bit sets of the block's rows), which
are intersected and united as the query says, and only the rows that remain are searched with the
expression. A rule without mandatory trigrams searches every row.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import re._parser as sre
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts

NAME = "op7_secret_scan"
ORACLE_SQL = None  # code-point offsets of non-overlapping matches are not expressible; tests use brute force


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)

#: Largest number of strings that an expression's part is expanded to when its trigrams are derived.
EXPAND = 64

#: Bytes of texts that are indexed at once; a longer text goes in pieces that overlap by two bytes.
BLOCK_BYTES = 4 << 20

#: A query: None (no mandatory trigram), or alternatives each of which is a set of trigrams.
Query = tuple[frozenset[bytes], ...] | None

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def folded(text: str) -> bytes:
    """UTF-8 with A-Z as a-z; no other character changes, as rules fold ASCII letters alone."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def grams(data: bytes) -> frozenset[bytes]:
    return frozenset(data[i : i + 3] for i in range(len(data) - 2))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, over folded text."""
    best: Query = None
    for strings in _runs(sre.parse(pattern, re.ASCII)):
        found = tuple({grams(folded(s)) for s in strings})
        if all(found):  # each alternative has a trigram
            both = found if best is None else tuple({a | b for a, b in itertools.product(best, found)})
            # Of too many alternatives the run alone is asked for, which every match contains too.
            best = both if len(both) <= EXPAND else found
    return best


def _runs(parsed) -> list[set[str]]:
    """Sets of strings, each of which has one member that any match contains (lower-cased)."""
    done: list[set[str]] = []
    now: set[str] = {""}

    def close():
        nonlocal now
        if now != {""}:
            done.append(now)
        now = {""}

    for op, arg in parsed:
        options = _options(op, arg)
        if options is not None and len(now) * len(options) <= EXPAND:
            now = {a + b for a in now for b in options}
            continue
        close()
        if options is not None:
            now = options
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            done.extend(_runs(arg[2]))
        elif op is sre.SUBPATTERN and not arg[1] & re.UNICODE:
            done.extend(_runs(arg[3]))
    close()
    return done


def _options(op, arg) -> set[str] | None:
    """All strings that a part of an expression can match, ASCII letters folded, or None if too many."""
    def fold(c: int) -> str:
        return chr(c + 32 if 65 <= c <= 90 else c)

    if op is sre.LITERAL:
        return {fold(arg)}
    if op is sre.AT:
        return {""}
    if op is sre.IN:
        found: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                found.add(fold(x))
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                found |= {fold(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        # Under Unicode rules a letter may match others than its ASCII pair.
        return None if arg[1] & re.UNICODE else _sequence(arg[3])
    if op is sre.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        found = set().union(*(x for x in each if x is not None))
        return None if None in each or len(found) > EXPAND else found
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        one = _sequence(inner)
        if one is None or high > 8:
            return None
        found, level = set(), {""}
        for n in range(high + 1):
            if n >= low:
                found |= level
            if len(found) > EXPAND or len(level) > EXPAND:
                return None
            level = {a + b for a in level for b in one}
        return found
    return None


def _sequence(parsed) -> set[str] | None:
    now = {""}
    for op, arg in parsed:
        options = _options(op, arg)
        if options is None:
            return None
        now = {a + b for a in now for b in options}
        if len(now) > EXPAND:
            return None
    return now


class TrigramIndex:
    """Postings of the asked trigrams over blocks of texts, as bit sets of a block's rows."""

    def __init__(self, asked: set[bytes]):
        self._slots = {g: i + 1 for i, g in enumerate(sorted(asked))}
        self._slot_of = np.zeros(1 << 24, np.uint16)  # trigram as a number -> slot, 0 for those that nothing asks for
        for g, slot in self._slots.items():
            self._slot_of[int.from_bytes(g, "big")] = slot

    def postings(self, texts: list[str]) -> np.ndarray:
        """[slots, rows]: whether the row's text has the slot's trigram."""
        out = np.zeros((len(self._slots) + 1, len(texts)), bool)
        rows, pieces, held = [], [], 0

        def flush():
            # Two zero bytes between pieces: trigrams across them hold no character of a text.
            data = np.frombuffer(b"\0\0".join(pieces), np.uint8).astype(np.int32)
            if len(data) > 2:
                slots = self._slot_of[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
                hits = np.flatnonzero(slots)
                starts = np.cumsum([0, *(len(p) + 2 for p in pieces[:-1])])
                owner = np.array(rows)[np.searchsorted(starts, hits, "right") - 1]
                out[slots[hits], owner] = True

        for row, text in enumerate(texts):
            data = folded(text)
            for at in range(0, max(1, len(data) - 2), BLOCK_BYTES):
                rows.append(row)
                pieces.append(data[at : at + BLOCK_BYTES + 2])
                held += len(pieces[-1])
                if held >= BLOCK_BYTES:
                    flush()
                    rows, pieces, held = [], [], 0
        if pieces:
            flush()
        return out

    def rows(self, query: Query, postings: np.ndarray) -> list[int]:
        """Rows whose texts satisfy the query."""
        if query is None:
            return list(range(postings.shape[1]))
        each = [postings[[self._slots[g] for g in needed]].all(0) for needed in query]
        return np.flatnonzero(np.logical_or.reduce(each)).tolist()


class Scanner:
    """Compiled rules and their trigram queries."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        # ASCII: letters in either case are the ASCII ones alone
        self._compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex({g for q in self.queries if q for alternative in q for g in alternative})

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, rule number, end), sorted."""
        postings = self.index.postings(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, pattern, query) in enumerate(zip(self.rules, self._compiled, self.queries, strict=True)):
            for row in self.index.rows(query, postings):
                found[row] += [
                    (m.start(), n, m.end())
                    for m in pattern.finditer(texts[row])
                    if m.end(rule.group) - m.start(rule.group) >= rule.least
                ]
        for spans in found:
            spans.sort()
        return found


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The process's scanner of these rules."""
    if rules not in _scanners:
        _scanners.clear()
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def secret_scan(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, one count n_<kind> per base kind, base_sha256, spans, n_other.

    Spans are kind:start:end by start, then by the rules' order, in code points with exclusive end;
    matches of a kind are leftmost and do not overlap. A null or empty text has no spans. Rows are
    independent, so repeated rows and null ids give results of their own; an empty table gives no
    rows, and other columns are ignored.
    """
    base = [n for n, r in enumerate(rules) if r.base]

    def work(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {f"n_{rules[n].kind}": [] for n in base} | {"base_sha256": [], "spans": [], "n_other": []}
        for spans in scanner(rules).scan([t or "" for t in texts]):
            told = [(n, f"{rules[n].kind}:{start}:{end}") for start, n, end in spans]
            for n in base:
                out[f"n_{rules[n].kind}"].append(sum(m == n for m, _ in told))
            mine = ",".join(x for n, x in told if rules[n].base)
            out["base_sha256"].append(hashlib.sha256(mine.encode()).hexdigest())
            out["spans"].append(",".join(x for _, x in told))
            out["n_other"].append(sum(not rules[n].base for n, _ in told))
        return out

    counts = "".join(f"n_{rules[n].kind} long, " for n in base)
    return map_texts(df, work, counts + "base_sha256 string, spans string, n_other long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
