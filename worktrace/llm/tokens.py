"""Token ids as the tokenizers library gives them, with a cache of pre-tokens.

Texts of plain characters are cut into pre-tokens where the library's own pattern
cuts them, all texts of a batch at once as arrays of code points; other texts fall
into chunks at places where the pattern always splits, and chunks with an odd
character go to the library whole. Equal pre-tokens of a batch are gathered by hashes,
compared character by character, and asked for once. The library's model merges those
that are not known yet. Counts are known in a dict by their text, of CACHE entries of
pre-tokens of LONGEST characters at most. Ids are known in arrays of SLOTS places, looked
up a batch at a time; each place holds the characters of one pre-token of KEY bytes at
most and its KEPT ids at most, longer ones are in a dict as above. Both bound a worker's
memory and change no result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from worktrace.llm.hashing import PIECE, equal_stretches, stretch_blocks, stretch_hashes

#: The pre-token pattern of the byte-level vocabularies (fixed value of the format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE = 200_000
LONGEST = 64
SLOTS = 1 << 20  # a power of two; 81 bytes each
KEY = 32  # bytes
KEPT = 12
SEGMENT = 1 << 16  # characters that are cut into pre-tokens at a time

#: Characters whose letter, number, case and composition properties are the same
#: in every Unicode version, and the letters and numbers among them.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u0220]*")
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u0220"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_ODD_SPACE = re.compile(r" (?:\s|$)")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The library's tokenizer of a file, without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the bytes: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = byte_letters()
_BYTES = {c: b for b, c in _LETTERS.items()}


def to_letters(text: str) -> str:
    """A text in the letters of a byte-level vocabulary (latin-1 turns each byte into a character to translate)."""
    if text.isascii() and text.isalpha():
        return text
    if text[:1] == " " and text.isascii() and text[1:].isalpha():
        return _LETTERS[0x20] + text[1:]
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


def from_letters(token: str) -> bytes:
    return bytes(_BYTES[c] for c in token)


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings proven to encode alone as one token: text -> id.

    An entry is proven if its bytes are UTF-8, the pre-token pattern takes the
    text in one piece, and the library encodes the text to exactly its id.
    """
    tokenizer = load(path)
    pattern = regex.compile(BYTE_LEVEL_PATTERN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts: dict[str, int] = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = from_letters(token).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        if text not in special and pattern.fullmatch(text) and pattern.findall(text) == [text]:
            texts[text] = i
    order = list(texts)
    encoded = tokenizer.encode_batch_fast(order, add_special_tokens=False)
    return {t: texts[t] for t, e in zip(order, encoded, strict=True) if e.ids == [texts[t]]}


def space_chunks(text: str) -> list[str]:
    """The text cut before each single space that a non-space follows; the first chunk has no space before it.

    There the pattern always splits: white space before it is a pre-token that
    gives its last space away, and no pre-token goes on into a space.
    """
    pieces = text.split(" ")
    if not _ODD_SPACE.search(text):
        return pieces
    out, current = [], [pieces[0]]
    for piece in pieces[1:]:
        if piece and not piece[0].isspace():
            out.append(" ".join(current))
            current = [piece]
        else:
            current.append(piece)
    out.append(" ".join(current))
    return out


def segments(text: str) -> Iterator[str]:
    """The text in pieces of about SEGMENT characters, cut before single spaces, where the patterns always split."""
    at = 0
    while len(text) - at > SEGMENT and (m := _BETWEEN.search(text, at + SEGMENT)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


class _Cache:
    """Values by pre-token. Two generations of CACHE / 2 entries: what is used again lives on. Long ones are not kept."""

    def __init__(self, find: Callable):
        self.find, self.new, self.old = find, {}, {}

    def get(self, starts: np.ndarray, ends: np.ndarray, text: str) -> list:
        """The values of the stretches of `text` from starts to ends."""
        out, new, old = [], self.new, self.old
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            word = text[a:b]
            value = new.get(word)
            if value is None:
                value = old.get(word)
                if value is None:
                    value = self.find(word)
                if b - a <= LONGEST:
                    new[word] = value
                    if len(new) >= CACHE // 2:
                        self.old, self.new = old, new = new, {}
            out.append(value)
        return out


class _Slots:
    """Ids of pre-tokens by their characters. The hash gives the place; who comes later takes it."""

    def __init__(self, others: _Cache):
        self.others = others  # for longer ones
        self.keys = np.zeros((SLOTS, KEY // 8), "<u8")
        self.ids = np.zeros((SLOTS, KEPT), "<u4")
        self.sizes = np.zeros(SLOTS, np.uint8)

    def get(
        self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch of `text` (and of `units`, its characters) the number of its ids and where they begin in the third array.

        Keys are the characters, in one byte each or two, with zeros behind. No plain
        character is 0, 1 or 2, and the second of two bytes always is: keys differ
        if the stretches do.
        """
        fits = (ends - starts) * units.itemsize <= KEY
        keys = stretch_blocks(units, starts, np.where(fits, ends, starts), KEY // 8)
        slots = (hashes & np.uint64(len(self.keys) - 1)).astype(np.int64)
        known = fits & (self.keys[slots] == keys).all(axis=1)
        sizes = np.zeros(len(starts), dtype=np.int64)
        sizes[known] = self.sizes[slots[known]]
        kept = self.ids[slots[known]][_filled(sizes[known])]
        new, long = np.flatnonzero(~known & fits), np.flatnonzero(~fits)
        find = self.others.find
        values = [find(text[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        values += self.others.get(starts[long], ends[long], text)
        sizes[np.concatenate([new, long])] = [len(v) // 4 for v in values]
        flat = np.concatenate([kept, np.frombuffer(b"".join(values), "<u4")])
        order = np.concatenate([np.flatnonzero(known), new, long])
        begin = np.empty_like(sizes)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        self._keep(new[sizes[new] <= KEPT], slots, keys, sizes, begin, flat)
        return sizes, begin, flat

    def _keep(self, new: np.ndarray, slots: np.ndarray, keys: np.ndarray, sizes: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> None:
        new = new[np.unique(slots[new], return_index=True)[1]]  # one for a place
        filled = _filled(sizes[new])
        rows = np.zeros(filled.shape, "<u4")
        rows[filled] = flat[(begin[new][:, None] + np.arange(KEPT))[filled]]
        self.keys[slots[new]], self.ids[slots[new]], self.sizes[slots[new]] = keys[new], rows, sizes[new]


def _filled(sizes: np.ndarray) -> np.ndarray:
    """Which of KEPT places are filled, a row for each size."""
    return np.arange(KEPT) < sizes[:, None]


_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
_END_MARK = "\0"  # ends each text of a batch; no plain character


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each plain code point."""
    of = np.full(0x221, _OTHER, dtype=np.int8)
    for c in range(len(of)):
        of[c] = next((k for k, chars in ((_SPACE, r"\s"), (_LETTER, f"[{_L}]"), (_NUMBER, f"[{_N}]")) if re.fullmatch(chars, chr(c))), _OTHER)
    of[0] = _END
    return of


def pre_tokens(points: np.ndarray, attach: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens of plain texts begin, each text closed by an end mark, and of which class their last character is.

    attach: as BYTE_LEVEL_PATTERN cuts, a space goes with the pre-token behind it
    and other white space is pre-tokens; else as WordLevel.PATTERN does, which
    drops white space and takes numbers one by one.
    """
    kind = _classes()[points]
    first = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _END)
    if not attach:
        first |= kind == _NUMBER
    begins = first.copy()
    solid = np.flatnonzero(first & (kind != _SPACE) & (kind != _END))
    if attach:
        behind = solid[(solid > 0) & (kind[solid - 1] == _SPACE)]
        begins[behind - 1] = True
        begins[behind[points[behind - 1] == 0x20]] = False
    # an apostrophe alone takes s, t, m, d, re, ve or ll with it
    mark = solid[(points[solid] == 0x27) & begins[solid]]
    mark = mark[kind[mark + 1] == _LETTER]
    one, two = points[mark + 1], points[np.minimum(mark + 2, len(points) - 1)]
    short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
    long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
    for some, n in ((mark[short], 2), (mark[long], 3)):
        begins[some + 1] = False
        rest = some + n
        begins[rest[kind[rest] == _LETTER]] = True
    at = np.flatnonzero(begins)
    return at, kind[np.concatenate([at[1:], [len(points)]]) - 1]


class _Pieces:
    """Values of whole texts, from those of their pre-tokens and of chunks that the library takes whole.

    of_plain and of_odd give the value of one; `joined` that of a text from its
    pieces'; `known` those of pre-tokens, as `dealt` takes them to those of pieces.
    """

    def __init__(self, path: str, attach: bool, of_plain: Callable, of_odd: Callable):
        self.special = [t.content for t in load(path).get_added_tokens_decoder().values()]
        self.attach, self.of_odd, self.cache = attach, of_odd, _Cache(of_plain)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is_plain, piece) in order."""
        special = [s for s in self.special if s in text]
        if not special and _PLAIN.fullmatch(text):
            yield from ((True, s) for s in segments(text))
            return
        if self.attach:
            head, *rest = space_chunks(text)
            chunks = [head, *(" " + c for c in rest)]
        else:
            chunks = [w + " " for w in words(text)]
        run: list[str] = []
        for chunk in chunks:
            if _PLAIN.fullmatch(chunk) and not any(s in chunk for s in special):
                run.append(chunk)
                continue
            if run:
                yield from ((True, s) for s in segments("".join(run)))
                run = []
            yield False, chunk
        if run:
            yield from ((True, s) for s in segments("".join(run)))

    def of_texts(self, texts: Sequence[str | None]) -> list:
        """The value of each text."""
        parts = [list(self.pieces(t)) if t else [] for t in texts]
        plain = [s for p in parts for is_plain, s in p if is_plain]
        values = iter(self.of_plain_pieces(plain))
        return [self.joined([next(values) if is_plain else self.of_odd(s) for is_plain, s in p]) for p in parts]

    def of_plain_pieces(self, pieces: list[str]) -> Iterator:
        a = 0
        while a < len(pieces):
            b, size = a + 1, len(pieces[a])
            while b < len(pieces) and size + len(pieces[b]) < PIECE:
                size += len(pieces[b]) + 1
                b += 1
            yield from self.together(pieces[a:b])
            a = b

    def together(self, pieces: list[str]) -> Iterator:
        text = _END_MARK.join([*pieces, ""])
        text = text if self.attach else text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        starts, kind = pre_tokens(points, self.attach)
        ends = np.concatenate([starts[1:], [len(points)]])
        of_piece, real = np.cumsum(kind == _END), kind != _END
        if not self.attach:
            real &= kind != _SPACE
        starts, ends, of_piece = starts[real], ends[real], of_piece[real]
        units = points.astype("<u2" if points.max() > 0xFF else np.uint8)  # plain characters are below 0x221
        hashes = stretch_hashes(units, starts, ends)
        _, first, each = np.unique(hashes, return_index=True, return_inverse=True)
        same = first[each]
        if (ends - starts != (ends - starts)[same]).any() or not equal_stretches(units, starts, ends, starts[same]):
            first = each = np.arange(len(starts))  # different ones with one hash: each is looked up
        values = self.known(hashes[first], units, starts[first], ends[first], text)
        return self.dealt(values, each, np.bincount(of_piece, minlength=len(pieces))[: len(pieces)])


class _Counts(_Pieces):
    joined = staticmethod(sum)

    def known(self, hashes: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> list[int]:
        return self.cache.get(starts, ends, text)

    def dealt(self, values: list[int], each: np.ndarray, counts: np.ndarray) -> Iterator[int]:
        total = np.concatenate([[0], np.cumsum(np.array(values, dtype=np.int64)[each])])
        return iter(np.diff(total[np.cumsum(counts)], prepend=0).tolist())


class _Ids(_Pieces):
    joined = staticmethod(b"".join)

    def __init__(self, *args):
        super().__init__(*args)
        self.known = _Slots(self.cache).get

    def dealt(self, values: tuple[np.ndarray, np.ndarray, np.ndarray], each: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        size, begin, flat = values
        size, begin = size[each], begin[each]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)].tobytes()
        at = 0
        for end in (4 * total[np.cumsum(counts)]).tolist():
            yield ids[at:end]
            at = end


class ByteLevel:
    """Counts and ids of whole texts for a byte-level BPE file. `whole`: the proven set of whole_tokens(), or none."""

    def __init__(self, path: str, whole: Mapping[str, int] | None = None):
        tokenizer, known = load(path), whole or {}
        encode, merge = tokenizer.encode, tokenizer.model.tokenize
        self._counts = _Counts(
            path, True, lambda w: 1 if w in known else len(merge(to_letters(w))),
            lambda c: len(encode(c, add_special_tokens=False).ids),
        )
        self._ids = _Ids(
            path, True, lambda w: packed([t.id for t in merge(to_letters(w))]),
            lambda c: packed(encode(c, add_special_tokens=False).ids),
        )

    def counts(self, texts: Sequence[str | None]) -> list[int]:
        """Numbers of tokens."""
        return self._counts.of_texts(texts)

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian 32-bit integers, as the tokenizers library gives them."""
        return self._ids.of_texts(texts)


_WORD_SPLIT = re.compile(r"[ \t\n\r\v\f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def words(text: str) -> list[str]:
    """The stretches between white space as the library sees it (str.split() also splits at U+001C..U+001F)."""
    return [w for w in _WORD_SPLIT.split(text) if w] if _SEPARATORS.search(text) else text.split()


class WordLevel:
    """Ids of whole texts for a lower-case BPE with word ends, which drops white space."""

    #: The pre-token pattern of that vocabulary (fixed value of the format).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        tokenizer = load(path)
        encode, merge = tokenizer.encode, tokenizer.model.tokenize
        self._ids = _Ids(
            path, False, lambda w: packed([t.id for t in merge(to_letters(w))]),
            lambda c: packed(encode(c, add_special_tokens=False).ids),
        )

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian 32-bit integers."""
        return self._ids.of_texts(texts)


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    """One per worker process and file."""
    return ByteLevel(path)


@lru_cache(maxsize=4)
def word_level(path: str) -> WordLevel:
    return WordLevel(path)
