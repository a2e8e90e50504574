"""Byte-level BPE encoding and decoding with a rank file, by a two-tier lookup.

Texts travel to Python in Arrow batches; a block of texts is one byte array that is cut into pre-tokens at once (see
`byte_pairs`). First tier: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a token, for
all pre-tokens of a block together; a place found is believed only after its bytes are compared. Second tier: what is no
token is a linked list of bytes, whose neighbouring pairs wait in a heap by rank and then by place, so that one pre-token
of n bytes costs n log n. Merged misses are kept by their bytes in a bounded table of each worker.

Ids are packed: a binary of little-endian unsigned 32-bit numbers, a third of the size of an array in the row format.
Decoding gathers the tokens' bytes; it gives the bytes back, since ids of other origin need not end on whole characters.

Defined cases: null and empty texts have no ids (an empty binary) and decode to no bytes; nothing is special inside a text;
texts and pre-tokens of any length are encoded whole (a block grows to hold a longer text); null ids decode to no bytes, ids
outside the vocabulary raise an error; repeated rows are encoded each; no rows give no rows; results replace input columns of
the same name.
"""

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import ship_package
from catalogspark.llm.byte_pairs import blocks, buffers, differing, eights, mixed, path_of, pretokens, ragged, word_names

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text that are held as arrays at a time.
BLOCK = 1 << 20
#: Bytes of missed pre-tokens that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 1 << 24, 256


class PerfectHash:
    """n distinct 64-bit names to the places 0 to n - 1, each taken once.

    Level by level, the names that are alone in their cell of a bit array stay there; those that met move on to the next,
    smaller array. A name's place is the number of taken cells before its own.
    """

    def __init__(self, names: np.ndarray, room: float = 1.5):
        self.levels, self.sizes, left = [], [], names
        while len(left):
            size = max(int(room * len(left)), 2)
            cell = self.cell(left, len(self.levels), size)
            self.levels.append(np.bincount(cell, minlength=size) == 1)
            self.sizes.append(size)
            left = left[~self.levels[-1][cell]]
        self.before = np.concatenate([[0], np.cumsum([x.sum() for x in self.levels], dtype=np.int64)])
        self.ranks = [np.cumsum(x) - 1 for x in self.levels]

    @staticmethod
    def cell(names: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(names + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def places(self, names: np.ndarray) -> np.ndarray:
        """The place of each name; of names that were not given, any place or -1."""
        out, todo = np.full(len(names), -1, np.int64), np.arange(len(names))
        for level, taken in enumerate(self.levels):
            if not len(todo):
                break
            cell = self.cell(names[todo], level, self.sizes[level])
            hit = taken[cell]
            out[todo[hit]] = self.before[level] + self.ranks[level][cell[hit]]
            todo = todo[~hit]
        return out


class Codec:
    """Encodes and decodes blocks of texts by the ranks of a file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        tokens, self.ids = list(self.rank_of), np.array(list(self.rank_of.values()), np.uint32)
        self.longest = max(map(len, tokens))
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.seed = next(s for s in range(1, 100) if len(np.unique(word_names(self.flat, self.at, self.at + self.size, s))) == len(tokens))
        names = word_names(self.flat, self.at, self.at + self.size, self.seed)
        self.hash = PerfectHash(names)
        self.token_at = np.empty(len(tokens), np.int64)
        self.token_at[self.hash.places(names)] = np.arange(len(tokens))
        self.view = eights(self.flat)
        self.by_id = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.by_id[self.ids] = np.arange(len(tokens))
        self.known: dict[bytes, np.ndarray] = {}
        self.remembered = 0

    def whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The token that each pre-token is as a whole, as its number in the file, or -1."""
        place = self.hash.places(word_names(data, starts, ends, self.seed))
        token = np.where(place >= 0, self.token_at[place], 0)
        wrong = differing(eights(data), starts, ends, self.view, self.at[token], self.size[token])
        return np.where((place < 0) | wrong, -1, token)

    def merged(self, piece: bytes) -> np.ndarray:
        """Ids of a pre-token: the pair of lowest rank first, the leftmost of these first."""
        n, rank_of, longest = len(piece), self.rank_of, self.longest
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is named by its first byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop or not alive[j]:
                continue  # one of the pair has changed since
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                k = end[stop]
                if k - i <= longest and (r := rank_of.get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            h = before[i]
            if h >= 0 and stop - h <= longest and (r := rank_of.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(rank_of[piece[i : end[i]]])
            i = end[i]
        return np.array(out, np.uint32)

    def missed(self, piece: bytes) -> np.ndarray:
        found = self.known.get(piece)
        if found is None:
            found = self.merged(piece)
            if len(piece) <= LONGEST:
                if self.remembered > REMEMBERED:
                    self.known, self.remembered = {}, 0
                self.known[piece] = found
                self.remembered += len(piece)
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and where each text's begin (one more than texts)."""
        starts = pretokens(data, offsets[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        token = self.whole(data, starts, ends)
        miss = np.flatnonzero(token < 0)
        raw = data.tobytes() if len(miss) else b""
        found = [self.missed(raw[a:b]) for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
        count = np.ones(len(starts), np.int64)
        count[miss] = [len(x) for x in found]
        total = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(total[-1], np.uint32)
        hits = np.flatnonzero(token >= 0)
        out[total[hits]] = self.ids[token[hits]]
        if len(miss):
            out[ragged(total[miss], count[miss])] = np.concatenate(found)
        return out, total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens of a block, and where each row's begin."""
        token = np.where(ids < len(self.by_id), self.by_id[np.minimum(ids, len(self.by_id) - 1)], -1)
        if (token < 0).any():
            raise ValueError(f"{int(ids[token < 0][0])} is no id of the vocabulary")
        total = np.concatenate([[0], np.cumsum(self.size[token])])
        return self.flat[ragged(self.at[token], self.size[token])], total[offsets]


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One a worker process."""
    return Codec(path)


def _binaries(parts: list, n: int) -> pa.Array:
    """An array of n binaries from (bytes, offsets) of blocks."""
    if not parts:
        return pa.array([None] * n, pa.large_binary())
    base = np.cumsum([0] + [int(at[-1]) for _, at in parts])
    offsets = np.concatenate([[0]] + [at[1:] + b for (_, at), b in zip(parts, base, strict=False)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([x for x, _ in parts]))])


def encoded(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Packed ids of a text. vocabulary: a rank file of public_tokenizers."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        own = codec(path_of(vocabulary))
        data, offsets = buffers(texts)
        parts = []
        for a, b in blocks(offsets, BLOCK):
            ids, at = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append((ids.astype("<u4").view(np.uint8), 4 * at))
        return _binaries(parts, len(texts)).cast(pa.binary())

    return encode(text)


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Bytes of packed ids."""

    @F.arrow_udf("binary")
    def decode(packed: pa.Array) -> pa.Array:
        own = codec(path_of(vocabulary))
        packed = packed.fill_null(b"").cast(pa.large_binary())
        _, at, data = packed.buffers()
        offsets = np.frombuffer(at, np.int64, len(packed) + 1, 8 * packed.offset) if len(packed) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        parts = []
        for a, b in blocks(offsets, 4 * BLOCK):
            ids = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), "<u4")
            parts.append(own.decode(ids, (offsets[a : b + 1] - offsets[a]) // 4))
        return _binaries(parts, len(packed)).cast(pa.binary())

    return decode(ids)


def unpacked(ids: Column) -> Column:
    """Packed ids as array<long>, without Python."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long")
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(ids) / 4 - 1, F.lit(0)).cast("int")), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)
    return F.when(F.octet_length(ids) > 0, each).otherwise(F.array().cast("array<bigint>"))


def with_ids(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ids (packed) and n_tokens."""
    ship_package(docs.sparkSession)
    return docs.withColumn("ids", encoded(F.col(text), vocabulary)).withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


def op12_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole document, and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_ids(docs).select("doc_id", "n_tokens", "ids").withColumn("decoded", decoded(F.col("ids")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_two_tier_bpe": op12_two_tier_bpe}
