"""3. BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that its encoding ends
with. A suffix automaton of the vocabulary gives the tokens that end at a place,
longest first; the one that may follow the last token of the prefix before it is
stored. Two tokens may stand side by side if no merge ever joins them across
their border, which is decided by undoing their merges from the last one back.
Following the stored tokens back from the end gives the ids. Unlike the merge
loop this takes time in proportion to the word, however long it is.

The vocabulary is a file of fixed size, so its automaton is broadcast. Words are
remembered per task (a bounded table that is emptied when full).

The text goes through the steps of such a tokenizer first: special tokens are cut
out as they stand, then NFC, lower case (character by character), and the words of
a pattern, which white space separates.

Defined results: a null text is empty and has no ids; repeated rows are encoded
each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlab.llm.common import PIECE, documents, map_batches

WORDS = r"\p{L}+|\p{N}|'s|'t|'re|'ve|'m|'ll|'d|[^\p{White_Space}\p{L}\p{N}]+"
#: the same for lower-cased texts of code points below 256
LATIN_WORDS = (
    "[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'s|'t|'re|'ve|'m|'ll|'d"
    "|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
# Code points that the tokenizers library, at Unicode 16, and the
# pattern and letter-case tables here, at Unicode 17 and 15, take differently.
NOT_YET_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
NEW_LOWER_CASE = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
REMEMBERED_WORDS = 400_000
REMEMBERED_PAIRS = 1_000_000
START_OF_WORD = 0xFFFFF  # in place of a token


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, iter(range(0x100, 0x200))
    return [letters.get(b) or chr(next(extra)) for b in range(256)]


class SuffixAutomaton:
    """Of several strings of small numbers; `moves` has (state << 10 | symbol) -> state."""

    def __init__(self):
        self.moves: dict[int, int] = {}
        self.link, self.length, self.out = [-1], [0], [[]]

    def _state(self, length: int, link: int, out: Iterable[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append(list(out))
        return len(self.length) - 1

    def _move(self, state: int, symbol: int, to: int) -> None:
        self.moves[state << 10 | symbol] = to
        self.out[state].append(symbol)

    def _split(self, before: int, state: int, symbol: int) -> int:
        """A copy of `state` for its strings that are no longer than via `before`."""
        copy = self._state(self.length[before] + 1, self.link[state], self.out[state])
        for s in self.out[state]:
            self.moves[copy << 10 | s] = self.moves[state << 10 | s]
        self.link[state] = copy
        while before >= 0 and self.moves.get(before << 10 | symbol) == state:
            self.moves[before << 10 | symbol] = copy
            before = self.link[before]
        return copy

    def extend(self, last: int, symbol: int) -> int:
        known = self.moves.get(last << 10 | symbol)
        if known is not None:  # an earlier string has it
            whole = self.length[known] == self.length[last] + 1
            return known if whole else self._split(last, known, symbol)
        new, before = self._state(self.length[last] + 1, 0, ()), last
        while before >= 0 and before << 10 | symbol not in self.moves:
            self._move(before, symbol, new)
            before = self.link[before]
        if before >= 0:
            target = self.moves[before << 10 | symbol]
            whole = self.length[target] == self.length[before] + 1
            self.link[new] = target if whole else self._split(before, target, symbol)
        return new

    def add(self, symbols: Iterable[int]) -> int:
        state = 0
        for s in symbols:
            state = self.extend(state, s)
        return state


class Vocabulary:
    """Merges, automaton and specials of a tokenizer file; sent to the tasks once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.strings = [""] * size
        for text, k in chain(ids.items(), self.specials.items()):
            self.strings[k] = text
        #: when a token is made; -1: it is a symbol
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[int, int] = {}  # (left << 20 | right) -> rank
        self.made: list[int] = []  # rank -> token
        for rank, (a, b) in enumerate(pairs):
            left, right, token = ids[a], ids[b], ids[a + b]
            self.merges[left << 20 | right] = rank
            self.made.append(token)
            self.rank[token], self.left[token], self.right[token] = rank, left, right
        letters = byte_letters()
        inside = [ids.get(x, -1) for x in letters]
        last = [ids.get(x + suffix, -1) for x in letters]
        symbols = sorted({x for x in inside + last if x >= 0})
        number = {x: k for k, x in enumerate(symbols)}
        self.inside = [number.get(x, -1) for x in inside]
        self.last = [number.get(x, -1) for x in last]
        spelled: dict[int, list[int]] = {x: [k] for x, k in number.items()}
        for token in self.made:
            spelled[token] = spelled[self.left[token]] + spelled[self.right[token]]
        auto = SuffixAutomaton()
        ends = {}
        for token, parts in spelled.items():
            end = auto.add(parts)
            if self._merged([symbols[k] for k in parts]) == [token]:  # else it is never the result
                ends[token] = (end, parts)
        # splitting moves strings to copies, so the places are looked up at the end
        token_at = [-1] * len(auto.length)
        for token, (_, parts) in ends.items():
            state = 0
            for s in parts:
                state = auto.moves[state << 10 | s]
            token_at[state] = token
        self.moves, self.link, self.length, self.token_at = auto.moves, auto.link, auto.length, token_at
        #: state -> tokens that end there, longest first, with their lengths
        self.ending: list[tuple] = [()] * len(token_at)
        for state in sorted(range(len(token_at)), key=auto.length.__getitem__):
            own = ((token_at[state], auto.length[state]),) if token_at[state] >= 0 else ()
            shorter = self.ending[auto.link[state]] if state else ()
            self.ending[state] = own + shorter if own else shorter

    def _merged(self, parts: list[int]) -> list[int]:
        """The merge loop, for the tokens of the vocabulary themselves."""
        while len(parts) > 1:
            ranks = [self.merges.get(a << 20 | b, 1 << 30) for a, b in zip(parts, parts[1:])]
            rank = min(ranks)
            if rank == 1 << 30:
                break
            k = ranks.index(rank)
            parts = [*parts[:k], self.made[rank], *parts[k + 2 :]]
        return parts

    def side_by_side(self, a: int, b: int) -> bool:
        """No merge joins the end of `a` with the start of `b` while both are made."""
        rank, merges = self.rank, self.merges
        until = 1 << 30  # the two pieces are neighbours until a merge of this rank
        while True:
            if merges.get(a << 20 | b, 1 << 30) < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # a was made last
                until, a = rank[a], self.right[a]
            else:  # of equal merges the left one comes first
                until, b = rank[b] + 1, self.left[b]


class _Pairs(dict):
    """Which tokens may follow each other, worked out when first asked."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __missing__(self, pair: int) -> bool:
        if len(self) >= REMEMBERED_PAIRS:
            self.clear()
        before, token = pair >> 20, pair & 0xFFFFF
        fits = before == START_OF_WORD or self.v.side_by_side(before, token)
        self[pair] = fits
        return fits


class WordEncoder(dict):
    """Word -> ids. Full, it keeps the words of the last round and starts another."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pairs = vocabulary, _Pairs(vocabulary)
        self.older: dict[str, tuple[int, ...]] = {}
        self.latin = re.compile(LATIN_WORDS)
        self.pattern = regex.compile(WORDS)
        odd = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NOT_YET_LETTERS)
        new = "".join(f"\\U{c:08x}" for c in NEW_LOWER_CASE)
        self.odd = re.compile(f"[{odd}{new}]")
        strict = WORDS.replace(r"\p{L}+|\p{N}|", rf"[\p{{L}}--[{odd}]]+|[\p{{N}}--[{odd}]]|")
        strict = strict.replace(r"|[^\p{White_Space}\p{L}\p{N}]+", rf"|(?:[{odd}]|[^\p{{White_Space}}\p{{L}}\p{{N}}])+")
        self.strict = regex.compile(strict, regex.V1)
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.tokens(word)
        if len(self) >= REMEMBERED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def symbols(self, word: str) -> list[int]:
        data = word.encode()
        inside = self.v.inside
        out = [inside[b] for b in data]
        out[-1] = self.v.last[data[-1]]
        return [s for s in out if s >= 0] if min(out) < 0 else out

    def tokens(self, word: str) -> tuple[int, ...]:
        v, pairs = self.v, self.pairs
        moves, ending, link, length = v.moves, v.ending, v.link, v.length
        symbols = self.symbols(word)
        last, size = [START_OF_WORD], [0]  # by prefix: its last token, and how long that is
        state = matched = at = 0
        for s in symbols:
            at += 1
            to = moves.get(state << 10 | s)
            while to is None:
                state = link[state]
                matched = length[state]
                to = moves.get(state << 10 | s)
            state = to
            matched += 1
            for token, n in ending[state]:
                if n <= matched and pairs[last[at - n] << 20 | token]:
                    last.append(token)
                    size.append(n)
                    break
            else:
                raise ValueError(f"no token ends at {at} of {word!r}")
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return tuple(out)

    def words(self, text: str) -> list[str]:
        """The words of a text; white space only separates, so it need not be made even."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text)
            odd = self.odd.search(text)
            if odd:
                text = text.translate(NEW_LOWER_CASE)
            # lower() looks at neighbours for one letter only, the capital sigma
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
            return (self.strict if odd else self.pattern).findall(text)
        return self.latin.findall(text.lower())

    def _plain(self, text: str) -> Iterable[int]:
        return chain.from_iterable(map(self.__getitem__, self.words(text)))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(x in text for x in self.v.specials):
            return list(self._plain(text))
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            out.extend([self.v.specials[part]] if k % 2 else self._plain(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the file, the tokens joined by spaces."""
        return " ".join(map(self.v.strings.__getitem__, ids))


#: the encoder of this Python worker and the broadcast it belongs to
_HERE: dict[int, WordEncoder] = {}


def encoder_of(shared) -> WordEncoder:
    key = id(shared.value)
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = WordEncoder(shared.value)
    return _HERE[key]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids of each text and what they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        ids_of, first, size = [], 0, 0
        doc_ids, texts = batch.column("doc_id"), batch.column("text")
        for k, text in enumerate(texts):
            ids_of.append(encoder.encode(text.as_py()))
            size += len(ids_of[-1])
            if size >= PIECE or k == len(texts) - 1:
                flat = np.fromiter(chain.from_iterable(ids_of), np.int32, size)
                ends = np.cumsum([0, *map(len, ids_of)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                decoded = pa.array(map(encoder.decode, ids_of), pa.string())
                part = doc_ids.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([part, lists, decoded], names=["doc_id", "ids", "decoded"])
                ids_of, first, size = [], k + 1, 0

    rows = documents(docs, id_col, text_col).select("doc_id", "text")
    return map_batches(rows, run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(encoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, *more columns, ids_sha256, decoded_sha256) of `encode`."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        *more,
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
