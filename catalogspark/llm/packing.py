"""Vector bin packing of tokenised examples into training sequences.

An example demands tokens, one segment, and loss-bearing tokens; a sequence offers a limit of each. Full lengths are
cut off an example and stand alone. The rest go through the dot-product heuristic: a sequence is filled by the example
whose demand vector, weighted by mean demand, has the largest dot product with what the sequence still offers. Where
nothing fits whole, the best example is cut. A sequence that cannot be filled (too many segments, or nothing left) is
cut back to a power of two, so no sequence needs padding.

Packing needs no shuffle: each task packs its own examples, a bounded window at a time, and numbers its sequences from
partition id * 2^40, so results are the same when a lost task runs again over the same partition.

Defined cases: null and empty texts are the end id alone; an example of any length is cut into full sequences; repeated
rows are packed each; a null key stays null; no rows give no rows; only key and texts are read, so other columns cannot
clash.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import give_back, ship_package
from catalogspark.llm import byte_pairs
from catalogspark.llm.token_counts import BLOCK, VOCABULARY

END_ID = 0
MAX_TOKENS, MAX_SEGMENTS = 1024, 128
#: Examples that are packed together.
WINDOW = 2048


class Limits:
    """tokens: a power of two. loss: loss-bearing tokens of a sequence."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None):
        self.tokens, self.segments, self.loss = tokens, segments, tokens if loss is None else loss
        if tokens < 1 or tokens & (tokens - 1) or segments < 1 or self.loss < 1:
            raise ValueError("tokens must be a power of two, segments and loss at least 1")


def loss_in(a: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Loss-bearing tokens in [a, a + size) of an example that bears loss in [lo, hi)."""
    return np.maximum(0, np.minimum(a + size, hi) - np.maximum(a, lo))


def pack_window(sizes: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length) that hold every token of every example's [start, start + size) once."""
    n, room = len(sizes), 2 * len(sizes) + 16
    grow = lambda x: np.concatenate([x, np.zeros(room, np.int64)])
    owner, start, size, lo, hi = np.concatenate([np.arange(n), np.zeros(room, np.int64)]), grow(starts), grow(sizes), grow(lo), grow(hi)
    loss = loss_in(start, size, lo, hi)
    alive = size > 0
    top = n
    scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss])
    mean = np.array([size[:n].mean(), 1.0, loss[:n].mean()]) * scale if n else scale
    out: list[list[tuple[int, int, int]]] = []

    def put_back(i: int, a: int, length: int) -> None:
        nonlocal top, owner, start, size, lo, hi, loss, alive
        if top == len(owner):
            owner, start, size, lo, hi, loss = (grow(x) for x in (owner, start, size, lo, hi, loss))
            alive = np.concatenate([alive, np.zeros(room, bool)])
        owner[top], start[top], size[top], lo[top], hi[top] = owner[i], a, length, lo[i], hi[i]
        loss[top] = max(0, min(a + length, hi[i]) - max(a, lo[i]))
        alive[top] = True
        top += 1

    while (live := np.flatnonzero(alive[:top])).size:
        left = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        pieces: list[tuple[int, int, int]] = []  # row, start, length
        t, s = size[live], loss[live]
        open_ = np.ones(len(live), bool)
        while left[0] > 0 and left[1] > 0 and open_.any():
            w = mean * left * scale * scale
            score = t * w[0] + w[1] + s * w[2]
            fits = open_ & (t <= left[0]) & (s <= left[2])
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                i = int(live[k])
                pieces.append((i, int(start[i]), int(size[i])))
                open_[k] = alive[i] = False
                left -= (int(size[i]), 1, int(loss[i]))
                continue
            # cut: as much of the best example as both tokens and loss allow
            ahead = np.maximum(0, lo[live] - start[live])
            most = np.minimum(left[0], np.where(s <= left[2], t, ahead + left[2]))
            most = np.where(open_, np.minimum(most, t), 0)
            if not (most > 0).any():
                break
            k = int(np.argmax(np.where(most > 0, most + score / (1 + score.max()), -1.0)))
            i, size_cut = int(live[k]), int(most[k])
            pieces.append((i, int(start[i]), size_cut))
            left -= (size_cut, 1, int(loss_in(start[i], size_cut, lo[i], hi[i])))
            open_[k] = alive[i] = False
            if size_cut < size[i]:
                put_back(i, int(start[i]) + size_cut, int(size[i]) - size_cut)
        total = sum(p[2] for p in pieces)
        extra = total - (1 << (total.bit_length() - 1))
        while extra:
            i, a, length = pieces.pop()
            back = min(extra, length)
            extra -= back
            put_back(i, a + length - back, back)
            if back < length:
                pieces.append((i, a, length - back))
        out.append([(int(owner[i]), a, length) for i, a, length in pieces])
    return out


def _schema(key: pa.Field, with_ids: bool) -> pa.Schema:
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([key, *(pa.field(x, pa.int64()) for x in names)] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", prompt: str | None = None, vocabulary: str = VOCABULARY, limits: Limits | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of sequences: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked.

    An example is its prompt's ids, if there is a prompt column, its text's ids and END_ID; the text's ids bear loss.
    """
    limits = limits or Limits()
    ship_package(docs.sparkSession)
    columns = [F.col(key).alias("key"), F.col(text).alias("text"), (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt")]
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_pairs.encoder(byte_pairs.path_of(vocabulary))
        part = TaskContext.get().partitionId()
        number = part << 40
        schema = None
        keys, ids, sizes, starts, los, his = [], [], [], [], [], []  # waiting rests of examples

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(columns[0], schema[0].type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([np.asarray(x, np.int32) for x in columns[7]], schema[7].type))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def row(k, own: np.ndarray, a: int, length: int, offset: int) -> tuple:
            cut = own[a : a + length]
            return (k, a, length, zlib.crc32(cut.astype("<u4").tobytes()), len(own), number, offset, *([cut] if with_ids else []))

        def flush() -> list[tuple]:
            nonlocal number
            found = []
            for sequence in pack_window(*(np.array(x, np.int64) for x in (sizes, starts, los, his)), limits):
                offset = 0
                for i, a, length in sequence:
                    found.append(row(keys[i], ids[i], a, length, offset))
                    offset += length
                number += 1
            for x in (keys, ids, sizes, starts, los, his):
                x.clear()
            return found

        for batch in batches:
            schema = schema or _schema(pa.field("key", batch.schema.field("key").type), with_ids)
            data, at = byte_pairs.buffers(batch.column("text"))
            if prompt:
                p_data, p_at = byte_pairs.buffers(batch.column("prompt"))
            names = batch.column("key").to_pylist()
            for a, b in byte_pairs.blocks(at, BLOCK):
                flat, where = enc.ids(data[at[a] : at[b]], at[a : b + 1] - at[a])
                if prompt:
                    p_flat, p_where = enc.ids(p_data[p_at[a] : p_at[b]], p_at[a : b + 1] - p_at[a])
                found = []
                for i in range(b - a):
                    parts = [flat[where[i] : where[i + 1]], np.array([END_ID], np.int32)]
                    lo = 0
                    if prompt:
                        lo = int(p_where[i + 1] - p_where[i])
                        parts.insert(0, p_flat[p_where[i] : p_where[i + 1]])
                    own = np.concatenate(parts)
                    hi = len(own) - 1
                    begin = 0
                    while len(own) - begin >= limits.tokens and loss_in(begin, limits.tokens, lo, hi) <= limits.loss:
                        found.append(row(names[a + i], own, begin, limits.tokens, 0))
                        number += 1
                        begin += limits.tokens
                    if begin < len(own):
                        for x, v in zip((keys, ids, sizes, starts, los, his), (names[a + i], own, len(own) - begin, begin, lo, hi), strict=True):
                            x.append(v)
                    if len(keys) >= WINDOW:
                        found += flush()
                if found:
                    yield rows(found)
        if keys:
            yield rows(flush())
        give_back()

    out = docs.select(*columns).mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("key", key)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_packing": op6_packing}
