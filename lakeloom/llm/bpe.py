"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches.

A word's encoding is found left to right. At each position the longest vocabulary token is tried
first, then its ever shorter prefixes that are tokens too; a token is accepted when the pair it
forms with its left neighbour is compatible, that is, when merging by rank would never join across
their border. If no token fits, the left neighbour is given up and its shorter prefixes are tried;
positions found to be dead ends are remembered, so that the work is linear in the word. Decoding
gathers the bytes of one blob of token strings by an offset table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts

NAME = "op2_bpe_encode_decode"
ORACLE_SQL = None  # merges by rank are not expressible; tests compare with the public library

#: Words kept in a worker's cache; it is emptied when full, and longer words are never kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: Tokens whose strings are gathered at once.
GATHER = 20_000
#: Entries of the pair-compatibility table, which fills as pairs are met; it is emptied when full.
TABLE_PAIRS = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BpeTokenizer:
    """Encoder and decoder of a byte-level BPE file whose words end in a suffix.

    The file's normalizer and pre-tokenizer are applied as the public library applies them: texts
    of code points below U+0300 take a regular expression, others the library's own steps.
    Token ids must rise with merge rank, which is checked on loading.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._path, self._library = path, None
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")")
        self._word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # str.split takes four control characters for white space that the file's pattern does not.
        self._outside = regex.compile("[^\\u0000-\\u001b\\u0020-\\u02ff]")

        # One character per symbol: a byte's own, or a private one for a byte that ends a word.
        inner = byte_symbols()
        closing = [chr(0xE000 + b) for b in range(256)]
        self._inner = {b: c for b, c in enumerate(inner)}
        self._closing = dict(enumerate(closing))
        spelled: dict[int, str] = {}
        for b in range(256):
            spelled[vocab[inner[b]]] = inner[b]
            spelled[vocab[inner[b] + end]] = closing[b]
        self._pairs: dict[tuple[int, int], int] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        last = max(spelled)
        for left, right in merges:
            made, parts = vocab[left + right], (vocab[left], vocab[right])
            if made <= last:
                raise ValueError("token ids must rise with merge rank")
            last = made
            self._pairs[parts] = made
            self._halves[made] = parts
            spelled[made] = spelled[parts[0]] + spelled[parts[1]]
        # Tokens that their own spelling does not encode to can never occur.
        self._alive = {t for t in sorted(spelled) if t not in self._halves}
        for made in sorted(self._halves):
            left, right = self._halves[made]
            if left in self._alive and right in self._alive and self._compatible(left, right, made):
                self._alive.add(made)
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t in self._alive:
            self._automaton.add_word(spelled[t], t)
        self._automaton.make_automaton()
        self._length = [len(spelled.get(t, "")) for t in range(max(spelled) + 1)]
        by_spelling = {spelled[t]: t for t in self._alive}
        self._shorter: dict[int, int] = {}
        for t in self._alive:
            s = spelled[t]
            for n in range(len(s) - 1, 0, -1):
                if (p := by_spelling.get(s[:n])) is not None:
                    self._shorter[t] = p
                    break

        # Decoding: the token's bytes are blob[offsets[id]:offsets[id + 1]], the space after each included.
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self._special.items()}
        ids = range(max(strings) + 1)
        self._strings = OffsetTable([strings.get(i, "") + " " for i in ids])
        self._digits = OffsetTable([f"{i} " for i in ids])
        self._cache = _Cache(self)
        self._table = _Compatible(self._compatible)

    def _compatible(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """Whether ranked merging of left + right keeps the border between them.

        The merges that build each side are undone from the latest to the earliest; a pair that
        meets at the border and would merge before the later of its own parts breaks the border.
        With `limit`, merges of that rank or later do not count.
        """
        pairs, halves = self._pairs, self._halves
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit = left
                if left not in halves:
                    # an atom on the later side: only the right side could still be taken apart
                    if right not in halves:
                        return True
                    limit, right = right + 1, halves[right][0]
                else:
                    left = halves[left][1]
            else:
                limit = right + 1
                if right not in halves:
                    if left not in halves:
                        return True
                    limit, left = left, halves[left][1]
                else:
                    right = halves[right][0]

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token, given in UTF-8."""
        if not word:
            return []
        text = "".join(map(self._inner.__getitem__, word[:-1])) + self._closing[word[-1]]
        size = len(text)
        length, shorter, table = self._length, self._shorter, self._table
        longest: list[int] = [-1] * (size + 1)
        for at, token in self._automaton.iter(text):
            longest[at - length[token]] = token  # ends only rise, so the longest is stored last
        longest.insert(0, longest.pop())  # slot -1 held the first position
        if length[longest[0]] == size:
            return [longest[0]]
        open_at = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            stop = at + length[token]
            if open_at[stop] and (not out or table[out[-1], token]):
                out.append(token)
                at = stop
                if at < size:
                    token = longest[at]
            elif token in shorter:
                token = shorter[token]
            else:
                open_at[at] = 0
                while True:  # give up left neighbours until one has a shorter form
                    token = out.pop()
                    at -= length[token]
                    if token in shorter:
                        token = shorter[token]
                        break
                    open_at[at] = 0
        return out

    def _foreign_words(self, text: str) -> list[str]:
        """The pre-tokens of any text, by the library's normalizer and pre-tokenizer, which are loaded when first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        text = self._library.normalizer.normalize_str(text)
        sub = self._library.pre_tokenizer.pre_tokenize_str
        # byte-level symbols back to text
        back = {c: b for b, c in self._inner.items()}
        return [bytes(map(back.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in sub(text)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        cache, out = self._cache, []
        for i, part in enumerate(self._special_split.split(text)):
            if i % 2:
                out.append(np.array([self._special[part]], "<i4").tobytes())
            elif self._outside.search(part):
                out.extend(map(cache.word, self._foreign_words(part)))
            else:  # no pre-token crosses white space
                out.extend([cache[c] for c in part.lower().split()])
        return np.frombuffer(b"".join(out), "<i4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' strings in UTF-8, joined by a space, as the file names no decoder."""
        return self._strings.joined(ids)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(np.fromiter(ids, np.int64)).decode("utf-8")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by a space."""
        return self._digits.joined(ids)


class OffsetTable:
    """Strings end to end in one blob, with the offset where each begins."""

    def __init__(self, strings: list[str]):
        data = [s.encode("utf-8") for s in strings]
        self.blob = np.frombuffer(b"".join(data), np.uint8)
        self.offsets = np.cumsum([0, *map(len, data)])

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of the ids one after the other, without the last byte."""
        out = []
        for at in range(0, len(ids), GATHER):
            part = ids[at : at + GATHER]
            first, stop = self.offsets[part], self.offsets[part + 1]
            ends = (stop - first).cumsum()
            places = np.repeat(stop - ends, stop - first)
            places += np.arange(len(places))
            out.append(self.blob[places].tobytes())
        return b"".join(out)[:-1]


class _Compatible(dict):
    """(left, right) -> whether the two tokens may stand side by side."""

    def __init__(self, decide):
        self._decide = decide

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= TABLE_PAIRS:
            self.clear()
        found = self[pair] = self._decide(*pair)
        return found


class _Cache(dict):
    """Pre-token, or run of characters between white space -> its ids as little-endian 32-bit numbers.

    One table serves both, as a pre-token taken alone is its own only pre-token.
    """

    def __init__(self, tokenizer: BpeTokenizer):
        self._tokenizer = tokenizer

    def word(self, word: str) -> bytes:
        """The ids of a pre-token."""
        ids = self.get(word)
        if ids is None:
            ids = np.array(self._tokenizer.encode_word(word.encode("utf-8", "surrogateescape")), "<i4").tobytes()
            self._keep(word, ids)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        words = self._tokenizer._word.findall(chunk)
        if words == [chunk]:
            return self.word(chunk)
        ids = b"".join(map(self.word, words))
        self._keep(chunk, ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = ids


_loaded: dict[str, BpeTokenizer] = {}


def tokenizer(path: str | None = None) -> BpeTokenizer:
    """The process's tokenizer for a file; its tables are built once per worker."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = BpeTokenizer(path)
    return _loaded[path]


def encode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text counts as empty and gives an empty array."""

    def work(texts: list[str | None]) -> dict[str, list]:
        t = tokenizer(path)
        return {"ids": [t.encode(x or "").tolist() for x in texts]}

    return map_texts(df, work, "ids array<int>", text_col, (id_col,))


def decode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) decoded from an array of ids; null counts as empty."""

    def work(ids: list[list[int] | None]) -> dict[str, list]:
        t = tokenizer(path)
        return {"text": [t.decode(x or ()) for x in ids]}

    return map_texts(df, work, "text string", ids_col, (id_col,))


def bpe_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Per row: doc_id (null stays null), n_tokens, ids_sha256, decoded_sha256, utf8_bytes (of the
    text). A null or empty text has no tokens and the digests of the empty string. Repeated rows
    give repeated results; columns besides doc_id and text are ignored.
    """

    def work(texts: list[str | None]) -> dict[str, list]:
        t = tokenizer(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "utf8_bytes": []}
        for text in texts:
            text = text or ""
            ids = t.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(t.decimal(ids)).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(t.decode_bytes(ids)).hexdigest())
            out["utf8_bytes"].append(len(text.encode("utf-8")))
        return out

    return map_texts(df, work, "n_tokens long, ids_sha256 string, decoded_sha256 string, utf8_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))
