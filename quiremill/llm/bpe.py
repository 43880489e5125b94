"""Operator 8: byte-level BPE by segment trees, and the text encoders that operators 1, 9, 10 use.

Each piece of text has a segment tree over its byte positions. A leaf holds the rank of the pair
that starts there, with its position, so that the root is the leftmost pair of least rank. A merge
changes three leaves (the merged node, its live left neighbour, the node that vanished) and
recomputes their ancestors: logarithmic work a merge, O(n log n) a piece. Pieces of up to
WIDEST bytes are merged in lockstep, one numpy row a tree; longer ones by one tree in a list.

Many texts are cut into pieces at once: what the patterns say about runs of letters, numbers, white space
and signs is said about arrays of their characters. Equal pieces are encoded once a slice, their ids are
remembered, up to a bound a worker, and gathered into those of the texts. Texts of over twice AT_ONCE
characters are encoded in sections that begin at a single space, which no piece can cross.

Null text counts as empty and has no ids. Texts of any length are encoded whole. Repeated rows are
encoded each, an empty table gives an empty one, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import ctypes
import functools
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

WIDEST = 64
#: Pieces after which a worker's memory (about 200 bytes each) becomes the old one.
PIECES = 200_000
#: Characters of text that are cut up at a time.
AT_ONCE = 1 << 22
NONE = (1 << 62) - 1
#: No key, no rank, no id, and the leaf of no pair.
EMPTY, UNRANKED, NOBODY = np.uint32(0xFFFFFFFF), np.int32((1 << 24) - 1), np.uint32(0xFFFF)
TOP = np.int32((1 << 30) - 1)

# The patterns of the two kinds of vocabulary, with L, N, S for letters, numbers and white space.
#   bytes: 's|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+
#   words: 's|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+
ONE = np.frombuffer(b"stmd", np.uint8)
TWO = [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]
# Unicode's White_Space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

LETTER, NUMBER, SPACE, SIGN = range(4)
CLASSES = [(LETTER, regex.compile(r"\p{L}").match), (NUMBER, regex.compile(r"\p{N}").match), (SPACE, regex.compile(f"[{SPACES}]").match)]
#: The first UTF-8 byte of code points beyond 255 is at least this.
BEYOND = 0xC4
FOLDED = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)


def kind_of(point: int) -> int:
    return next((k for k, match in CLASSES if match(chr(point))), SIGN)


LATIN = np.array([kind_of(i) for i in range(256)], np.uint8)


def kinds(chars: np.ndarray) -> np.ndarray:
    """The class of each code point; those beyond 255 are looked up once each."""
    if chars.dtype == np.uint8:
        return LATIN[chars]
    out = LATIN[np.minimum(chars, 255)]
    far = np.flatnonzero(chars > 255)
    points, which = np.unique(chars[far], return_inverse=True)
    out[far] = np.array([kind_of(p) for p in points.tolist()], np.uint8)[which]
    return out


#: A space between two characters that are no white space: a piece begins there, whatever stands around it.
GAP = regex.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")


def sections(text: str) -> Iterator[str]:
    """text in parts of about AT_ONCE characters that can be encoded apart."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + AT_ONCE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Merges:
    """A vocabulary of fewer than 65,535 ids and which pairs of them merge, in which order."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: np.ndarray, made: np.ndarray, ranks: np.ndarray | None = None):
        """first, last: id of each byte, and of each byte at the end of a piece. pairs: (n, 2) ids by
        rank, made: the ids that they make. ranks: if not their places; must be ascending."""
        self.first, self.last, self.made = first.astype(np.uint32), last.astype(np.uint32), made.astype(np.uint32)
        bits = max(10, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, EMPTY, np.uint32), np.full(1 << bits, UNRANKED, np.int32)
        keys = self._key(pairs[:, 0], pairs[:, 1])
        ranks = np.arange(len(keys)) if ranks is None else ranks
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # linear probing, all keys that are still homeless at once
            free = self.keys[at] == EMPTY
            _, one = np.unique(np.where(free, at.astype(np.int64), -1 - np.arange(len(at))), return_index=True)
            take = one[free[one]]
            self.keys[at[take]], self.ranks[at[take]] = keys[left[take]], ranks[left[take]]
            stay = np.ones(len(left), bool)
            stay[take] = False
            left, at = left[stay], (at[stay] + np.uint32(1)) & self.mask
        both = lambda second: self.rank(np.repeat(self.first, 256), np.tile(second, 256))
        self.inner, self.final = both(self.first), both(self.last)  # of two bytes, the second one within or at the end
        self.by_pair: dict[int, int] | None = None

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint32(0x9E3779B1) >> self.shift

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, UNRANKED if it doesn't merge."""
        keys = self._key(a, b)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], UNRANKED)
        left = np.flatnonzero((found != keys) & (found != EMPTY))
        at = at[left]
        while len(left):
            at = (at + np.uint32(1)) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[at[hit]]
            go = ~hit & (found != EMPTY)
            left, at = left[go], at[go]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, two bytes each, little endian."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in (4, 8, 16, 32, WIDEST):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for i in range(0, len(rows), 1 << 14):
                part = rows[i : i + (1 << 14)]
                flat, counts = self._together([pieces[j] for j in part], sizes[part], width)
                raw, ends = flat.astype("<u2").tobytes(), np.cumsum(counts) * 2
                at = 0
                for j, end in zip(part.tolist(), ends.tolist(), strict=True):
                    out[j] = raw[at:end]
                    at = end
            low = width
        for j in np.flatnonzero(sizes > WIDEST).tolist():
            out[j] = self._alone(pieces[j])
        return out

    def _together(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces in a row, and how many of each; one segment tree a row. A leaf is the
        rank above six bits of position."""
        n = len(pieces)
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        col = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes) - 1
        own = self.first[raw]
        own[ends] = self.last[raw[ends]]
        ids = np.full((n, width + 1), NOBODY, np.uint32)  # the last column stands for no neighbour
        ids[row, col] = own
        live = ids != NOBODY
        place = np.arange(width + 1, dtype=np.int32)
        after = np.where(place + 1 < sizes[:, None], place + 1, width).astype(np.int32)
        before = np.concatenate([[width], place[:-1]]).astype(np.int32)[None, :].repeat(n, 0)
        tree = np.full((n, 2 * width), TOP, np.int32)
        inner = np.ones(len(raw), bool)
        inner[ends] = False
        pair = raw[:-1].astype(np.int32) << 8 | raw[1:]
        ranks = self.inner[pair]
        closing = ends[sizes > 1] - 1
        ranks[closing] = self.final[pair[closing]]
        inner = inner[:-1]
        r, c = row[:-1][inner], col[:-1][inner]
        tree[r, width + c] = ranks[inner] << 6 | c
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        act = np.flatnonzero(tree[:, 1] < UNRANKED << 6)
        while len(act):
            top = tree[act, 1]
            at, made = top & 63, self.made[top >> 6]
            gone = after[act, at]
            right, left = after[act, gone], before[act, at]
            ids[act, at] = made
            live[act, gone] = False
            after[act, at] = right
            before[act, right] = at  # in the last column where there is none
            ranks = self.rank(made, ids[act, right])
            tree[act, width + at] = np.where(right < width, ranks << 6 | at, TOP)
            tree[act, width + gone] = TOP
            some = np.flatnonzero(left < width)
            act_left, left = act[some], left[some]
            tree[act_left, width + left] = self.rank(ids[act_left, left], made[some]) << 6 | left
            r = np.concatenate([act, act, act_left])
            node = np.concatenate([width + at, width + gone, width + left])
            flat, base = tree.reshape(-1), r * (2 * width)
            level = width
            while level > 1:
                node = node >> 1
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])
                level //= 2
            act = act[tree[act, 1] < UNRANKED << 6]
        live[:, width] = False
        return ids[live], live.sum(1)

    def _alone(self, piece: bytes) -> bytes:
        """The same with one tree, for a piece of any length."""
        if self.by_pair is None:
            held = np.flatnonzero(self.keys != EMPTY)
            self.by_pair = dict(zip(self.keys[held].tolist(), self.ranks[held].tolist(), strict=True))
        n, get, made = len(piece), self.by_pair.get, self.made
        width = 1 << (n - 1).bit_length()
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        ids[-1] = int(self.last[piece[-1]])
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = [NONE] * (2 * width)

        def leaf(i: int) -> int:
            rank = get(ids[i] << 16 | ids[after[i]]) if after[i] >= 0 else None
            return NONE if rank is None else rank << 32 | i

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                value = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == value:
                    break
                tree[k] = value

        while (top := tree[1]) < NONE:
            at = top & 0xFFFFFFFF
            ids[at], gone = int(made[top >> 32]), after[at]
            after[at] = after[gone]
            if after[gone] >= 0:
                before[after[gone]] = at
            ids[gone] = -1
            put(gone, NONE)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([i for i in ids if i >= 0], "<u2").tobytes()


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary file: itself if it is
    printable and no space, else the next free one from code point 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


class Encoder:
    """Texts to ids. One for each vocabulary file and worker."""

    def __init__(self, name: str, merges: Merges, words: bool, other: Callable[[str], bytes] | None = None):
        """words: white space is dropped, letters are folded, each number stands alone, and other encodes
        chunks (what stands between spaces) with a character beyond code point 255."""
        self.name, self.merges, self.words, self.other = name, merges, words, other
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces. A full memory becomes the old one, whose pieces come back when they are met."""
        got = list(map(self.young.get, pieces))
        lost = [i for i, x in enumerate(got) if x is None]
        names = [pieces[i] for i in lost]
        back = list(map(self.old.get, names))
        if self.other:
            for i, x in enumerate(names):
                if back[i] is None and max(x) >= BEYOND:
                    back[i] = self.other(x.decode())
        fresh = [i for i, x in enumerate(back) if x is None]
        for i, x in zip(fresh, self.merges.encode([names[i] for i in fresh]), strict=True):
            back[i] = x
        for i, x in zip(lost, back, strict=True):
            got[i] = x
        if len(names) <= PIECES:  # so that neither memory holds more than twice as many
            self.young.update(zip(names, back, strict=True))
        if len(self.young) > PIECES:
            self.young, self.old = {}, self.young
        return got

    def _cut(self, chars: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of texts that begin at begins: (folded code points, where pieces begin and, last, the
        end, which of the pieces count). What the patterns say, for all characters at once."""
        n = len(chars)
        first = np.zeros(n + 1, bool)
        first[begins] = first[n] = True
        inside = None
        if self.words:
            blank = chars == 32
            if chars.dtype != np.uint8:
                chunk = np.cumsum(blank | first[:n])
                held = np.zeros(chunk[-1] + 1, bool)
                held[chunk[chars > 255]] = True
                inside = held[chunk] & ~blank
            low = FOLDED[np.minimum(chars, 255)].astype(chars.dtype)
            chars = low if inside is None else np.where(inside, chars, low)
        kind = kinds(chars)
        edge = first.copy()
        edge[1:n] |= kind[1:] != kind[:-1]
        run = edge.copy()
        quote = np.flatnonzero((chars == 39) & run[:n] & run[1:])
        if self.words:
            edge[:n] |= kind == NUMBER
        else:
            space = kind == SPACE
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
            edge[last] = True
            taken = last[chars[last] == 32] + 1  # goes with the space before it
            edge[taken] = False
            quote = quote[edge[quote]]
        quote = quote[~first[quote + 1]]
        quote = quote[kind[quote + 1] == LETTER]
        one = np.isin(chars[quote + 1], ONE)
        edge[quote[one] + 1], edge[quote[one] + 2] = False, True
        more = quote[~one]
        more = more[~run[more + 2]]
        two = more[np.isin(chars[more + 1].astype(np.uint32) << 8 | np.minimum(chars[more + 2], 255), TWO)]
        edge[two + 1], edge[two + 3] = False, True
        if inside is not None:  # such chunks are one piece
            edge[:n][inside] = False
            into = inside.copy()
            into[1:] &= ~inside[:-1] | first[1:n]
            edge[:n] |= into
            edge[1:n] |= inside[:-1] & ~inside[1:]
            edge |= first
        at = np.flatnonzero(edge)
        counts = np.ones(len(at) - 1, bool)
        if self.words:
            counts = kind[at[:-1]] != SPACE
            if inside is not None:
                counts |= inside[at[:-1]]
        return chars, at, counts

    def _together(self, texts: list[str]) -> list[bytes]:
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        try:
            chars = np.frombuffer(whole.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        begins = np.cumsum([0, *map(len, texts)])
        chars, at, counts = self._cut(chars, begins[:-1])
        if self.words:  # folded
            whole = chars.tobytes().decode("latin-1" if chars.dtype == np.uint8 else "utf-32-le")
        raw, places = whole.encode(), at
        if len(raw) > len(chars):
            more = (chars >= 0x80).view(np.int8)
            if chars.dtype != np.uint8:
                more = more + (chars >= 0x800) + (chars >= 0x10000)
            places = at + np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[at]
        cut = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)])
        coded = cut.dictionary_encode()
        which, known = coded.indices.to_numpy(), self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(known), "<u2")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        starts = np.cumsum(sizes) - sizes
        many = sizes[which] * counts
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat(starts[which] - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        bounds = (2 * ends[np.searchsorted(at, begins)]).tolist()
        return [ids[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]

    def some(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, two bytes each, little endian. Long texts go section by section."""
        long = {i for i, t in enumerate(texts) if len(t) > 2 * AT_ONCE}
        short = iter(self._together([t for i, t in enumerate(texts) if i not in long]))
        return [b"".join(self._together([s])[0] for s in sections(t)) if i in long else next(short) for i, t in enumerate(texts)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, two bytes each, little endian."""
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= AT_ONCE:
                yield from self.some(some)
                some, size = [], 0
        yield from self.some(some)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def ranked_encoder(path: str) -> Encoder:
    """By a rank file: any pair merges whose bytes together are a token, the least rank first."""
    ranks = read_ranks(path)
    found = sorted((r, ranks[t[:i]], ranks[t[i:]]) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
    # the tree orders by index in this list: pairs that make the same token share a rank
    triples = np.array(found, np.int64)
    one = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    first = np.searchsorted(triples[:, 0], triples[:, 0])  # the first place of each token
    merges = Merges(one, one, triples[:, 1:], triples[:, 0], first)
    return Encoder(path, merges, words=False)


@functools.cache
def json_encoder(path: str) -> Encoder:
    """By a tokenizers file of one of the two kinds used here: byte-level, or words with an end mark."""
    with open(path) as f:
        whole = json.load(f)
    model, letter = whole["model"], byte_letters()
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    one = np.array([vocab[letter[b]] for b in range(256)], np.int64)
    last = np.array([vocab[letter[b] + end] for b in range(256)], np.int64)
    merges = Merges(one, last, np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64))
    if not end:
        return Encoder(path, merges, words=False)
    return Encoder(path, merges, words=True, other=lambda p: np.array(library(path).encode(p, add_special_tokens=False).ids, "<u2").tobytes())


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


def forget() -> None:
    """Let go of a worker's encoders and what they remember. Tasks of other kinds call it when they begin,
    as one worker serves one kind after the other."""
    for cached in (ranked_encoder, json_encoder, library, token_bytes):
        cached.cache_clear()


def release() -> None:
    """Give the system back what Arrow and the C library keep for later use: workers stay while they idle,
    more of them than there are tasks at a time, and what each keeps adds up on its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for tasks that need no encoder, so that its worker keeps nothing of the task before nor of this one."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes]]]:
    """(keys, ids of each text, the bytes that they decode to) of bounded slices."""
    encoder, held = ranked_encoder(path), token_bytes(path)
    for keys, ids in encoded(batches, encoder):
        lists = [np.frombuffer(x, "<u2") for x in ids]
        yield keys, lists, [b"".join(map(held.__getitem__, x.tolist())) for x in lists]


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): ids as array<int>, decoded the bytes of all ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists, decoded in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, id_lists(lists), pa.array(decoded, pa.binary())], names=[key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded binary")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what encode_decode() gives, made where it is made."""
    kind = df.schema[key].dataType.simpleString()
    hexes = lambda raw: pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists, decoded in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) for x in lists], pa.int64()), hexes(x.astype("<u4").tobytes() for x in lists), hexes(decoded)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def id_lists(lists: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(keys, ids of each text) of bounded slices of the batches: one of over AT_ONCE characters only if one text is."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        at, some = 0, []
        size = 0
        for i in range(len(texts)):
            some.append(texts[i].as_py() or "")
            size += len(some[-1])
            if size >= AT_ONCE or i + 1 == len(texts):
                yield keys.slice(at, len(some)), encoder.some(some)
                at, some, size = i + 1, [], 0
    release()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
