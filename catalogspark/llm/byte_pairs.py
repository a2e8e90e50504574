"""Byte-pair encoding over numpy arrays: whole blocks of texts are cut into pre-tokens and merged together.

Nothing here loops over characters or texts. A block of texts is one byte array. Pre-token starts come from comparing
neighbouring character classes, a hash names each pre-token, and only pre-tokens that were not met before are merged,
all at once, by `RankSynchronous`. The cache of met pre-tokens is bounded and starts anew when it is full. A name only
finds the cached pre-token: its bytes are compared at every hit, and a pre-token that merely shares a name is merged too.
"""

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
#: Character classes.
OTHER, LETTER, NUMBER, SPACE = range(4)


def path_of(name: str) -> str:
    """A vocabulary's file, found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 stands for itself, the rest moves to 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


@functools.lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each stretch, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int):
    """Ranges of texts of at most limit bytes together; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def pretokens(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start. breaks: positions that no pre-token crosses (0 is one)."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, np.int64)
    if int(data.max()) < 128:
        chars, at = data, None
    else:
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64)
        at = np.concatenate([[0], at[:-1]])
        breaks = np.searchsorted(at, breaks)
    n = len(chars)
    kind = character_classes()[chars]
    broken = np.zeros(n + 3, bool)
    broken[breaks[breaks < n]] = True
    broken[0] = True
    new = broken[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    starts = new.copy()
    # the last white space before a word stands alone, or goes with the word if it is a blank
    words = np.flatnonzero(new & (kind != SPACE) & ~broken[:n])
    words = words[kind[words - 1] == SPACE]
    starts[words - 1] = True
    starts[words[chars[words - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll after anything but a blank
    q = np.flatnonzero((chars == 39) & starts)
    if len(q):
        padded = np.zeros(n + 3, np.uint32)
        padded[:n] = chars
        one = np.where(broken[q + 1], 0, padded[q + 1])
        two = np.where(broken[q + 1] | broken[q + 2], 0, padded[q + 2])
        size = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)  # s t m d
        size = np.where((np.isin(one, [114, 118]) & (two == 101)) | ((one == 108) & (two == 108)), 2, size)  # re ve ll
        q, size = q[size > 0], size[size > 0]
        starts[q + 1] = False
        after = q + 1 + size
        starts[after[after < n]] = True
    starts = np.flatnonzero(starts)
    return starts if at is None else at[starts]


class RankSynchronous:
    """Merges many byte sequences at once: in each round every sequence applies its own lowest-rank pair everywhere."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NONE)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all sequences, one after another, and how many each has. data: their bytes."""
        symbols, owner = self.byte_ids[data], np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NONE, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            over = low == NONE
            if over.any():
                done.append((symbols[over], owner[over]))
                symbols, owner, rank, low = symbols[~over], owner[~over], rank[~over], low[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == low)
            touch = np.diff(hits) == 1
            if touch.any():  # a a a: every second hit of a run
                place = np.arange(len(hits))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~touch]), place, 0))
                hits = hits[(place - begin) % 2 == 0]
            symbols[hits] = self.merged[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            now = hits - np.arange(len(hits))
            redo = np.concatenate([now, now[now > 0] - 1])
            rank[redo] = NONE
            redo = redo[redo + 1 < len(symbols)]
            redo = redo[owner[redo] == owner[redo + 1]]
            rank[redo] = self.ranks(symbols[redo], symbols[redo + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(lengths)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of every place spread over all places."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, for places 0 to len(data); bytes past the end are 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


#: The lowest k bytes of a number, for k = 0 to 8.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are named by a cryptographic hash.
LONG = 64


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, long: int = LONG) -> np.ndarray:
    """64-bit names of words, none of them 0: eight bytes at a time are mixed in, after the length.

    Each step is a bijection of the eight bytes, so words of up to eight bytes and equal length never share a name.
    Words of more than `long` bytes are named by blake2b.
    """
    size, view = ends - starts, eights(data)
    h = mixed(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    live = np.arange(len(size))
    live = live[size <= long]
    for k in range(0, long, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = mixed(h[live] ^ (view[starts[live] + k] & LOWEST[np.minimum(size[live] - k, 8)]))
    for i in np.flatnonzero(size > long).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return np.maximum(h, np.uint64(1))


def differing(view: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which words (of `eights` view) are not, byte for byte, the words (other, at, sizes)."""
    size = ends - starts
    wrong = size != sizes
    live, k = np.flatnonzero(~wrong), 0
    while len(live := live[size[live] > k]) > 16 or (len(live) and k < LONG):
        mask = LOWEST[np.minimum(size[live] - k, 8)]
        wrong[live] |= ((view[starts[live] + k] ^ other[at[live] + k]) & mask) != 0
        k += 8
    for i in live.tolist():  # a few long words
        step = np.arange(k, size[i] - size[i] % 8, 8)
        rest = LOWEST[size[i] % 8]
        last = int(size[i] - size[i] % 8)
        wrong[i] |= bool((view[starts[i] + step] != other[at[i] + step]).any()) or bool((view[starts[i] + last] ^ other[at[i] + last]) & rest)
    return wrong


class Names:
    """64-bit names to slots 0, 1, ... in order of arrival: an open-addressing table that is probed for many names at once."""

    def __init__(self):
        self.used, self.names = 0, np.zeros(1024, np.uint64)
        self.resize(20)

    def resize(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.slot = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.put(self.names[: self.used], 0)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Slot of each name, -1 where it is not known."""
        out, at, todo = np.full(len(names), -1, np.int64), (names >> self.shift).astype(np.int64), np.arange(len(names))
        while len(todo):
            here = self.keys[at[todo]]
            same = here == names[todo]
            out[todo[same]] = self.slot[at[todo[same]]]
            todo = todo[~same & (here != 0)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def put(self, names: np.ndarray, first: int) -> None:
        at, todo = (names >> self.shift).astype(np.int64), np.arange(len(names))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = names[free]
            self.slot[at[free]] = first + free
            todo = todo[self.keys[at[todo]] != names[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def add(self, names: np.ndarray) -> None:
        """Names that are not known yet, each once."""
        n = self.used + len(names)
        if n > len(self.names):
            self.names = np.concatenate([self.names, np.zeros(n, np.uint64)])
        self.names[self.used : n] = names
        first, self.used = self.used, n
        if 2 * n > len(self.keys):
            self.resize((4 * n).bit_length())
        else:
            self.put(names, first)


class Encoder:
    """Token counts and ids of blocks of texts."""

    def __init__(self, path: str, most_known: int = 400_000):
        self.bpe, self.most_known = RankSynchronous(path), most_known
        self.forget()

    def forget(self) -> None:
        self.known = Names()
        self.first, self.count, self.flat, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0
        self.text, self.written, self.text_at, self.size = np.zeros(1 << 16, np.uint8), 0, np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> None:
        lengths = ends - starts
        own = data[ragged(starts, lengths)]
        flat, counts = self.bpe.merge(own, lengths)
        for text, i in self.bpe.special.items():
            for k in np.flatnonzero(lengths == len(text)).tolist():
                if data[starts[k] : ends[k]].tobytes() == text:
                    a = int(counts[:k].sum())
                    flat = np.concatenate([flat[:a], np.array([i], np.int32), flat[a + int(counts[k]) :]])
                    counts[k] = 1
        used, n = self.known.used, self.known.used + len(names)
        if n > len(self.count):
            self.first, self.count, self.text_at, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.first, self.count, self.text_at, self.size))
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(flat), np.int32)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.count[used:n] = counts
        self.first[used:n] = self.filled + np.cumsum(counts) - counts
        self.filled += len(flat)
        if self.written + len(own) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text) + len(own), np.uint8)])
        self.text[self.written : self.written + len(own)] = own
        self.size[used:n] = lengths
        self.text_at[used:n] = self.written + np.cumsum(lengths) - lengths
        self.written += len(own)
        self.known.add(names)

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache slot of each pre-token of a block, and the number of pre-tokens before each text's end."""
        import pandas as pd

        if self.known.used > self.most_known:
            self.forget()
        breaks, inside, raw = offsets[:-1], [], None
        for text in self.bpe.special:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(text)
            while at >= 0:
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(text) - 1, "right"):
                    inside.append((at, at + len(text)))
                    at = raw.find(text, at + len(text))
                else:
                    at = raw.find(text, at + 1)
        if inside:
            breaks = np.unique(np.concatenate([breaks, np.array(inside).ravel()]))
        starts = pretokens(data, breaks)
        for a, b in inside:
            starts = starts[(starts <= a) | (starts >= b)]
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        codes, names = pd.factorize(word_names(data, starts, ends, 7))
        slot = self.known.find(names)
        new = np.flatnonzero(slot < 0)
        if len(new):
            where = np.empty(len(names), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            at = where[new]
            first = self.known.used
            self.learn(data, starts[at], ends[at], names[new])
            slot[new] = first + np.arange(len(new))
        slot = slot[codes]
        known = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,))
        other = np.flatnonzero(differing(eights(data), starts, ends, known, self.text_at[slot], self.size[slot]))
        if len(other):  # another pre-token with a cached one's name: it gets an entry that no name finds
            first = self.known.used
            self.learn(data, starts[other], ends[other], self.unused(len(other)))
            slot[other] = first + np.arange(len(other))
        return slot, np.searchsorted(starts, offsets)

    def unused(self, n: int) -> np.ndarray:
        """n names that no pre-token in the cache has."""
        out, number = np.zeros(0, np.uint64), self.known.used
        while len(out) < n:
            more = np.maximum(mixed(np.arange(number, number + n, dtype=np.uint64)), np.uint64(1))
            out, number = np.unique(np.concatenate([out, more[self.known.find(more) < 0]])), number + n
        return out[:n]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block."""
        slot, ends = self.slots(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.count[slot])])
        return np.diff(total[ends])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block, and where each text's begin (one more than texts)."""
        slot, ends = self.slots(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.count[slot])])
        return self.flat[ragged(self.first[slot], self.count[slot])], total[ends]


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)
