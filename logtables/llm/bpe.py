"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a word ends, at every prefix, in one token that is determined by the
prefix alone. An Aho-Corasick automaton over the vocabulary gives the tokens that end at a place;
of these exactly one is compatible with the last token of the prefix it leaves. Storing
that token per prefix and following the stored tokens back from the end of the word yields
the ids that merging by rank would give, in one walk over the word.

Two neighbours are compatible if merging the text of both keeps the boundary between them.
That is tested by undoing their merges from the later to the earlier one and looking for a
merge across the boundary that would have come first.

Rules of the vocabulary file: special tokens are found in the raw text; the text is
composed (NFC), cut at white space and lower-cased letter by letter; words are runs of
letters, single digits, runs of other signs and a few English endings; a word's last
symbol carries an end mark. Decoding puts the tokens' own texts in a row with blanks, as
the file names no decoder.

Defined results: null is encoded as the empty text, which has no ids and decodes to the
empty text; any other columns of the input are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_pass, free_name

#: Fixed values of the tokenizer: its word pattern, and white space that ``str.split`` adds to the pattern's.
#: Fixed values of the library: letters of later Unicode versions, which are signs to it (checked by a test
#: over every code point).
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 1C89 208F 209D-209F A7CB-A7CC A7CE-A7CF A7D2 A7D4 A7DA A7DC-A7DD A7E2 A7F1 "
    "AB6C-AB6D 107BB-107BF 10940-10959 10D50-10D65 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F "
)
#: Fixed values of the library: lower-case letters of later versions, as (first, last, distance).
LATER_LOWER = (
    (0x1C89, 0x1C89, 0x1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 0x1), (0xA7CE, 0xA7CE, 0x1),
    (0xA7D2, 0xA7D2, 0x1), (0xA7D4, 0xA7D4, 0x1), (0xA7DA, 0xA7DA, 0x1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_LOWER = {c: c + distance for first, last, distance in LATER_LOWER for c in range(first, last + 1)}
#: Fixed values of the library: numbers of later versions, which are signs to it.
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _set(ranges: str) -> str:
    """Code points in hexadecimal, as they stand in a character class."""
    return "".join("-".join(rf"\U{int(c, 16):08x}" for c in part.split("-")) for part in ranges.split())


_LETTERS = rf"[\p{{L}}--[{_set(''.join(LATER_LETTERS))}]]"
_NUMBERS = rf"[\p{{N}}--[{_set(LATER_NUMBERS)}]]"
WORD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{_LETTERS}+|{_NUMBERS}|[^\s{_LETTERS}{_NUMBERS}]+")
END = "</w>"
SPACE = regex.compile(r"[\t\n\v\f\r\x20\x85\xa0  -     　]+")
SPLIT_ONLY = regex.compile(r"[\x1c-\x1f]")
#: Stands for the end mark inside the automaton; no symbol of the alphabet is a line feed.
STOP = "\n"
#: Chunks of at most so many letters are remembered, so many of them per worker.
REMEMBERED_LETTERS, REMEMBERED_CHUNKS = 40, 400_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable, else the next free
    code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Codec:
    """Encodes and decodes with one vocabulary file; kept per worker by ``codec``."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.texts = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.texts[i] = text.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merges.setdefault((a, b), (rank, c))
            self.parts.setdefault(c, (rank, a, b))
        self.symbols = byte_symbols()
        self.fits: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if text not in self.special and self.reachable(i):
                inner = text[: -len(END)] + STOP if text.endswith(END) else text
                self.automaton.add_word(inner, (len(inner), i))
        self.automaton.make_automaton()

    def compatible(self, pair: int) -> bool:
        """Whether merging keeps the boundary between two neighbouring tokens, given as
        left * number of tokens + right."""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        known = self.fits[pair] = self._boundary_holds(*divmod(pair, len(self.texts)))
        return known

    def _boundary_holds(self, left: int, right: int) -> bool:
        # A merge of rank r on one side happens before a merge across the boundary only if
        # r is smaller; ``first`` is the rank that the merges undone so far start from. On
        # equal rank, the pair further left is merged first.
        first = len(self.merges)
        crossing_ties = False
        while True:
            across = self.merges.get((left, right))
            if across and (across[0] < first or across[0] == first and crossing_ties):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                first, left, crossing_ties = a[0], a[2], False
            else:
                first, right, crossing_ties = b[0], b[1], True

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own text gives the token."""
        known = self.sound.get(token)
        if known is None:
            part = self.parts.get(token)
            known = True if part is None else self.reachable(part[1]) and self.reachable(part[2]) and self._boundary_but(part)
            self.sound[token] = known
        return known

    def _boundary_but(self, part: tuple[int, int, int]) -> bool:
        # The halves stand side by side until their own merge, the one that crosses.
        rank, left, right = part
        own = self.merges.pop((left, right))
        try:
            return self._boundary_holds(left, right)
        finally:
            self.merges[left, right] = own

    def encode_word(self, word: str) -> bytes:
        """The ids of one word, as little-endian 32-bit numbers."""
        known = self.words.get(word)
        if known is not None:
            return known
        symbols, fits, size = self.symbols, self.fits, len(self.texts)
        text = "".join([symbols[b] for b in word.encode()]) + STOP
        last = [-1] * (len(text) + 1)  # per prefix: its last token
        span = [0] * (len(text) + 1)  # and that token's length
        for end, (length, token) in self.automaton.iter(text):
            place = end + 1
            if last[place] >= 0:
                continue
            if length < place:
                before = last[place - length]
                if before < 0:
                    continue
                pair = before * size + token
                fit = fits.get(pair)
                if not (self.compatible(pair) if fit is None else fit):
                    continue
            last[place] = token
            span[place] = length
        ids, place = [], len(text)
        while place:
            ids.append(last[place])
            place -= span[place]
        found = array("I", ids[::-1]).tobytes()
        if len(word) <= REMEMBERED_LETTERS:
            if len(self.words) > REMEMBERED_CHUNKS:
                self.words.clear()
            self.words[word] = found
        return found

    def encode_chunk(self, chunk: str) -> bytes:
        """The ids of a text without white space, as little-endian 32-bit numbers."""
        text = unicodedata.normalize("NFC", chunk)
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        if text.isascii():
            if text.isalpha():
                return self.encode_word(text)
        else:
            text = text.translate(_LOWER)
        return b"".join([self.encode_word(word) for word in WORD.findall(text)])

    def _plain(self, text: str) -> bytes:
        chunks = self.chunks
        pieces = SPACE.split(text) if SPLIT_ONLY.search(text) else text.split()
        try:
            return b"".join([chunks[p] for p in pieces])
        except KeyError:
            pass
        if len(chunks) > REMEMBERED_CHUNKS:
            chunks.clear()
        found = []
        for piece in pieces:
            ids = chunks.get(piece)
            if ids is None:
                ids = self.encode_chunk(piece)
                if len(piece) <= REMEMBERED_LETTERS:
                    chunks[piece] = ids
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_pattern is None or "<|" not in text:
            return self._plain(text)
        pieces = self.special_pattern.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in pieces)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8."""
        texts = self.texts
        return b" ".join([texts[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to every row, and ids (array of int) if
    asked for; a name that is taken gets an underscore."""
    names = [free_name(docs, n) for n in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")]

    def work():
        tokenizer = codec(path)

        def step(part: pa.RecordBatch) -> list[pa.Array]:
            counts, id_sums, text_sums, lists = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = tokenizer.encode(text)
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(memoryview(ids).cast("I").tolist() if ids else [])
            out = [pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            return [*out, pa.array(lists, pa.list_(pa.int32()))] if with_ids else out

        return step

    kinds = ("long", "string", "string", "array<int>")[: 3 + with_ids]
    return arrow_pass(docs, ", ".join(f"`{n}` {kind}" for n, kind in zip(names, kinds)), work)
