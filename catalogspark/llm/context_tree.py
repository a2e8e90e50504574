"""Language-model scores by context-tree weighting over bytes, learnt from all training documents.

Each byte is eight binary decisions (the node of a binary tree over its leading bits). Every decision has a tree of byte
contexts of depth 0 to DEPTH; each context keeps its counts of zeros and ones, whose Krichevsky-Trofimov estimate has
block probability Pe, and the weighted probability is Pw = (Pe + product of the children's Pw) / 2, Pe at full depth.
A bit's probability mixes the estimates of all depths along its context with the weights that follow from Pe and Pw
after training; a context that was not met in training ends the path, and the deepest one that was met stands for it.
The sum of -log2 over a text is its code length.

The text that is modelled is the token sequence: words (A-Z lower-cased) joined by a blank, and one end byte, so that
the score is comparable with the unigram `base_score`.

All statistics come from the whole corpus. One pass over the texts deals the distinct (context, byte) strings and words
of each block of documents, with their training counts, packed, by hash; trees are climbed level by level where all
strings that share their TOP nearest context bytes meet, and above that where rows of a level meet by their nearest bytes.
Block probabilities depend on counts alone, hence the order of rows does not matter. Scoring never broadcasts the model:
the strings and words that a block sent are answered by the owners, and documents meet the answers of their block.

Scale: names travel in order as differences, byte by byte, compressed (about a byte each, since many are neighbours).
Blocks are runs of rows of a file with at most BLOCK_BYTES of text, so that most strings of a block are met many times
in it. A part's strings must fit one task: `spark.sql.shuffle.partitions` parts own them by their three nearest bytes.

Defined cases: null and empty texts are the end token alone; a null key counts as the empty text in `held_out`; texts of
any length are scored whole; repeated rows are learnt and scored each; without training documents every bit has
probability 1/2; no rows give no rows; only key and text are read, so other columns cannot clash.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions.session import row_named, ship_package, written
from catalogspark.llm import byte_pairs, shingles
from catalogspark.llm.byte_pairs import ragged

#: Bytes of context unless a caller asks for 3 to 7; with the byte itself, a 64-bit name holds no more than 7.
DEPTH = 6
END = 10
#: Levels that are climbed in slabs, and those that whole parts own.
MIDDLE, TOP = 4, 3
SLAB = 50_000
CHUNK = 1 << 20
#: Bytes of the texts of a block of documents; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
#: Blocks whose limits are broadcast; beyond it the join is left to Spark.
MAX_BROADCAST_BLOCKS = 500_000
#: Names and counts that are added up at a time.
GATHERED = 2_000_000
WORDS, STRINGS, TOPS = 0, 1, 2
END_WORD = np.uint64(0x51AFD7ED558CCD25)
LN2 = float(np.log(2.0))
BITS = np.arange(7, -1, -1)


def held_out(key: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == remainder


# -- texts to strings and words ------------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, tokens before each text, strings, strings before each text) of a block of texts.

    Words are 64-bit names, in order, each text's end last. A string is the byte and its context, nearest byte first.
    """
    data = shingles.LOWER[data]
    starts, ends, at = shingles.words(data, offsets)
    n, docs = len(starts), len(offsets) - 1
    count = np.diff(at)
    name = shingles.word_hashes(data, starts, ends)
    place = np.arange(n) + np.repeat(np.arange(docs), count)
    words = np.full(n + docs, END_WORD, np.uint64)
    words[place] = name
    # bytes: depth ends, then word, blank, word, ..., end
    size = ends - starts + 1
    doc_bytes = np.zeros(docs, np.int64)
    np.add.at(doc_bytes, np.repeat(np.arange(docs), count), size)
    doc_bytes = np.maximum(doc_bytes, 1)
    begin = np.concatenate([[0], np.cumsum(doc_bytes + depth)])
    stream = np.full(begin[-1], 32, np.uint8)
    stream[ragged(begin[:-1], np.full(docs, depth))] = END
    stream[begin[1:] - 1] = END
    before = np.cumsum(size) - size
    first = np.repeat(before[np.minimum(at[:-1], max(n - 1, 0))] if n else np.zeros(docs, np.int64), count)
    put = np.repeat(begin[:-1] + depth, count) + before - first
    stream[ragged(put, size - 1)] = data[ragged(starts, size - 1)]
    wide = stream.astype(np.int64)
    strings = wide[depth:].copy()
    for k in range(1, depth + 1):
        strings |= wide[depth - k : len(wide) - k] << (8 * (depth + 1 - k))
    own = ragged(begin[:-1], doc_bytes)
    return words, np.concatenate([[0], np.cumsum(count + 1)]), strings[own], np.concatenate([[0], np.cumsum(doc_bytes)])


def owner(names: np.ndarray, kind: int, parts: int, depth: int) -> np.ndarray:
    """Part that owns each name: words by hash, strings and tops by the hash of their TOP nearest context bytes."""
    if kind == STRINGS:
        names = names >> (8 * (depth + 1 - TOP))
    if kind == TOPS:
        names = names >> 8
    h = shingles.mixed((names if kind == WORDS else names & ((1 << 8 * TOP) - 1)).astype(np.uint64))
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in order, and the sum of each one's counts."""
    import pandas as pd

    codes, names = pd.factorize(names)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, codes, counts)
    order = np.argsort(names)
    return names[order], total[order]


def squeezed(x: np.ndarray, ordered: bool = False) -> bytes:
    """64-bit numbers, byte plane by byte plane, compressed; as differences if they are in order."""
    raw = x.view(np.uint64)
    raw = np.diff(raw, prepend=np.uint64(0)) if ordered else raw
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def spread(blob: pa.Scalar, kind: type, ordered: bool = False) -> np.ndarray:
    buffer = blob.as_buffer()
    n = int.from_bytes(buffer[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(buffer[8:], decompressed_size=8 * n), np.uint8).reshape(8, n)
    raw = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return (np.cumsum(raw, dtype=np.uint64) if ordered else raw).view(kind)


BLOBS = "file long, block long, kind int, part int, names binary, values binary"
_BLOB_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB_TYPES, strict=True)], ["file", "block", "kind", "part", "names", "values"])


def packed(file, block, kind: int, names: np.ndarray, values: np.ndarray, parts: int, depth: int) -> list[tuple]:
    """A row for each part that owns some of the names, which are in order and stay so."""
    part = owner(names, kind, parts, depth)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    own = [(p, order[edges[p] : edges[p + 1]]) for p in np.flatnonzero(np.diff(edges)).tolist()]
    return [(file, block, kind, p, squeezed(names[i], True), squeezed(values[i])) for p, i in own]


def counted(docs: DataFrame, parts: int, depth: int) -> DataFrame:
    """BLOBS of the words and strings of each block of documents, with training counts (0 for those of other texts alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        now, held = None, {WORDS: Gathered(), STRINGS: Gathered()}

        def passed_on() -> pa.RecordBatch:
            return blob_rows([r for kind in held for r in packed(*now, kind, *held[kind].total(), parts, depth)])

        def distinct(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            codes, names = pd.factorize(x)
            return names, np.bincount(codes[train], minlength=len(names))

        for batch in batches:
            data, at = byte_pairs.buffers(batch.column("text"))
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
            change = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (block[1:] != block[:-1])]))
            for i, j in zip(change.tolist(), [*change[1:].tolist(), len(batch)], strict=True):
                if now != (spot := (int(file[i]), int(block[i]))):
                    if now:
                        yield passed_on()
                    now, held = spot, {WORDS: Gathered(), STRINGS: Gathered()}
                for a, b in byte_pairs.blocks(at[i : j + 1], CHUNK):
                    a, b = a + i, b + i
                    words, w_at, strings, s_at = tokens(data[at[a] : at[b]], at[a : b + 1] - at[a], depth)
                    held[WORDS].add(*distinct(words.view(np.int64), np.repeat(train[a:b], np.diff(w_at))))
                    held[STRINGS].add(*distinct(strings, np.repeat(train[a:b], np.diff(s_at))))
        if now:
            yield passed_on()

    return docs.select("file", "block", "text", "held_out").mapInArrow(run, BLOBS)


class Gathered:
    """Names and counts of packed rows, added up whenever there are many."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((names, counts))
        self.waiting += len(names)
        if self.waiting > GATHERED:
            self.held = [self.total()]
            self.waiting = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return summed(*(np.concatenate(x) for x in zip(*self.held, strict=True)))


# -- the trees ------------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series, after moving small arguments up by 8."""
    small = x < 8
    product = np.ones_like(x)
    for k in range(8):
        product *= np.where(small, x + k, 1.0)
    y = np.where(small, x + 8, x)
    i2 = 1 / (y * y)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


SMALL = 64
LOG_KT = log_kt_of(*(x.astype(np.float64) for x in np.divmod(np.arange(SMALL * SMALL), SMALL)))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability; small counts are looked up."""
    out = LOG_KT[(np.minimum(zeros, SMALL - 1) * SMALL + np.minimum(ones, SMALL - 1)).astype(np.int32)]
    large = (zeros >= SMALL) | (ones >= SMALL)
    if large.any():
        out[large] = log_kt_of(zeros[large], ones[large])
    return out


def nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones), each rows x 8: for rows (context, byte) sorted by key, the node of each bit and its counts."""
    node, zeros, ones = (np.empty((len(keys), 8), t) for t in (np.int64, np.float64, np.float64))
    bits = (keys[:, None] >> BITS) & 1
    for k in range(8):
        head = keys >> (8 - k)
        new = np.concatenate([[True], head[1:] != head[:-1]])
        node[:, k] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        one = np.add.reduceat(counts * bits[:, k], first)
        zeros[:, k], ones[:, k] = (np.add.reduceat(counts, first) - one)[node[:, k]], one[node[:, k]]
    return node, zeros, ones


def climb(keys: np.ndarray, counts: np.ndarray, weighted: np.ndarray | None, steps: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Takes `steps` levels of context off rows sorted by key = context bytes, nearest first, then the byte.

    weighted: ln Pw of each row's nodes, None at full depth. Returns the parents' keys, counts and ln Pw, and for each
    row a, b with: probability of a 1 at the parent's level = a + b * that at the row's level.
    """
    node, zeros, ones = nodes(keys, counts)
    if weighted is None:
        weighted = log_kt(zeros, ones)
    seen = zeros + ones > 0
    a, b = np.zeros((len(keys), 8)), np.where(seen, 1.0, 0.0)
    row_of = np.arange(len(keys))  # the current level's row of each original row
    for level in range(depth, depth - steps, -1):
        # bytes of this level's context below the byte itself: drop the farthest one
        up = (keys >> 16) << 8 | (keys & 0xFF) if level else keys
        parents, inverse = np.unique(up, return_inverse=True)
        total = np.zeros(len(parents))
        np.add.at(total, inverse, counts)
        p_node, p_zeros, p_ones = nodes(parents, total)
        p_estimate = log_kt(p_zeros, p_ones)
        product = np.empty_like(p_estimate)
        for k in range(8):
            lead = np.flatnonzero(np.concatenate([[True], node[1:, k] != node[:-1, k]]))  # one row for each child node
            sums = np.bincount(p_node[inverse[lead], k], weights=weighted[lead, k], minlength=int(p_node[-1, k]) + 1)
            product[:, k] = sums[p_node[:, k]]
        p_weighted = np.logaddexp(p_estimate, product) - LN2
        share = np.exp(p_estimate - LN2 - p_weighted)
        estimate = (p_ones + 0.5) / (p_zeros + p_ones + 1.0)
        mine = inverse[row_of]
        child_seen = seen[row_of]
        s, e = share[mine], estimate[mine]
        a = np.where(child_seen, s * e + (1 - s) * a, e)
        b = np.where(child_seen, (1 - s) * b, 0.0)
        keys, counts, node, zeros, ones, weighted, seen, row_of = parents, total, p_node, p_zeros, p_ones, p_weighted, p_zeros + p_ones > 0, mine
    return keys, counts, weighted, a, b


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), 8).cast(pa.list_(pa.float64()))


def _matrix(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy().reshape(-1, 8)


def deep(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From strings in order up to level TOP: its keys, counts and ln Pw, and each string's bit probabilities below it."""
    middle = min(MIDDLE, depth)
    # slabs of whole subtrees up to level MIDDLE, so that memory does not hold the deep levels of a part at once
    heads = keys >> (8 * (depth + 1 - middle))
    starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    slabs = starts[np.concatenate([[True], starts[1:] // SLAB != starts[:-1] // SLAB])]
    found, p = [], np.empty((len(keys), 8))
    for i, j in zip(slabs.tolist(), [*slabs[1:].tolist(), len(keys)], strict=True):
        n = counts[i:j].astype(np.float64)
        _, zeros, ones = nodes(keys[i:j], n)
        *rest, a, b = climb(keys[i:j], n, None, depth - middle, depth)
        found.append(rest)
        p[i:j] = a + b * (ones + 0.5) / (zeros + ones + 1.0)
    mid, n, weighted = (np.concatenate(x) for x in zip(*found, strict=True))
    up, total, weighted, a, b = climb(mid, n, weighted, middle - TOP, middle)
    for i, j in zip(slabs.tolist(), [*slabs[1:].tolist(), len(keys)], strict=True):
        at = np.searchsorted(mid, keys[i:j] >> (8 * (depth + 1 - middle)) << 8 | (keys[i:j] & 0xFF))
        p[i:j] = a[at] + b[at] * p[i:j]
    return up & ((1 << 8 * (TOP + 1)) - 1), total, weighted, p  # without the sign's copies


def summary(blobs: DataFrame, parts: int, depth: int) -> DataFrame:
    """Rows (kind STRINGS: key, n, x = ln Pw) of level TOP, and for each part (kind WORDS: key = distinct words, n = tokens) of training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {WORDS: Gathered(), STRINGS: Gathered()}
        for batch in batches:
            for kind, names, values in zip(batch.column("kind").to_pylist(), batch.column("names"), batch.column("values"), strict=True):
                found[kind].add(spread(names, np.int64, True), spread(values, np.int64))
        columns = ["kind", "key", "n", "x"]
        _, n = found[WORDS].total()
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([WORDS], pa.int32()), pa.array([int((n > 0).sum())]), pa.array([float(n.sum())]), pa.nulls(1, pa.list_(pa.float64()))], columns)
        keys, counts = found[STRINGS].total()
        if len(keys):
            up, total, weighted, _ = deep(keys, counts, depth)
            for k in range(0, len(up), 50_000):
                x = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(up[x]), STRINGS, np.int32)), pa.array(up[x]), pa.array(total[x]), _lists(weighted[x])], columns)

    return blobs.repartition(parts, "part").mapInArrow(run, "kind int, key long, n double, x array<double>")


def one_up(rows: DataFrame, level: int) -> DataFrame:
    """Rows (key, n, x = ln Pw) of a level, climbed to the level above; a group has at most 256 ** level rows of each byte.

    Gives (kind 0: key, a, b of the row) and (kind 1: key, n, x of the parent).
    """

    def run(table: pa.Table) -> pa.Table:
        keys, counts = table["key"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(keys)
        up, total, weighted, a, b = climb(keys[order], counts[order], _matrix(table["x"])[order], 1, level)
        first = pa.table({"kind": pa.array(np.zeros(len(keys), np.int32)), "key": keys[order], "n": counts[order], "x": _lists(a), "y": _lists(b)})
        second = pa.table({"kind": pa.array(np.ones(len(up), np.int32)), "key": up, "n": total, "x": _lists(weighted), "y": _lists(weighted)})
        return pa.concat_tables([first, second])

    # level 3 meets by its two nearest context bytes, level 2 by one, level 1 as a whole (at most 65,536 rows)
    return rows.withColumn("near", F.shiftright("key", 16)).groupBy("near").applyInArrow(run, "kind int, key long, n double, x array<double>, y array<double>")


def tops(level: DataFrame, parts: int, depth: int) -> DataFrame:
    """BLOBS of kind TOPS: for the keys of level TOP, a and b of each bit's probability, a + b * that below."""
    steps = []
    for k in range(TOP, 0, -1):
        up = written(one_up(level, k), "level")
        steps.append(up.filter("kind = 0").select(F.col("key").alias(f"key{k}"), F.col("x").alias(f"a{k}"), F.col("y").alias(f"b{k}")))
        level = up.filter("kind = 1").select("key", "n", "x")
    out = steps[0]
    for k, step in zip(range(TOP - 1, 0, -1), steps[1:], strict=True):
        out = out.withColumn(f"key{k}", F.shiftright(f"key{k + 1}", 16) * 256 + F.col(f"key{k + 1}") % 256).join(step, f"key{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(f"key{TOP}").to_numpy()
            a, b = np.zeros((len(key), 8)), np.ones((len(key), 8))
            for k in range(TOP, 0, -1):
                a_k, b_k = _matrix(batch.column(f"a{k}")), _matrix(batch.column(f"b{k}"))
                a, b = a_k + b_k * a, b_k * b
            part, pairs = owner(key, TOPS, parts, depth), np.concatenate([a, b], 1)
            yield blob_rows([(None, None, TOPS, p, squeezed(key[part == p]), squeezed(np.ascontiguousarray(pairs[part == p]).ravel())) for p in np.unique(part).tolist()])

    return out.mapInArrow(run, BLOBS)


# -- scoring --------------------------------------------------------------------------------------------------------


def answers(blobs: DataFrame, above: DataFrame, parts: int, depth: int) -> DataFrame:
    """(file, block, kind, names, values): what the owners tell each block of its names: training counts of words, log10 probabilities of strings' last bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, keys, pairs, asked = {WORDS: Gathered(), STRINGS: Gathered()}, [], [], []
        for batch in batches:
            for kind, names, values in zip(batch.column("kind").to_pylist(), batch.column("names"), batch.column("values"), strict=True):
                if kind == TOPS:
                    keys.append(spread(names, np.int64))
                    pairs.append(spread(values, np.float64).reshape(-1, 16))
                else:
                    found[kind].add(spread(names, np.int64, True), spread(values, np.int64))
            mine = batch.filter(pa.compute.not_equal(batch.column("kind"), TOPS)).select(["file", "block", "kind", "names"])
            if len(mine):
                asked.append(mine)  # still compressed
        names, counts = found[WORDS].total()
        table = {WORDS: (names, counts.astype(np.float64))}
        names, counts = found[STRINGS].total()
        found.clear()
        if len(names):
            key, pair = np.concatenate(keys), np.concatenate(pairs)
            order = np.argsort(key)
            key, pair = key[order], pair[order]
            *_, p = deep(names, counts, depth)
            value = np.empty(len(names))
            for k in range(0, len(names), SLAB):
                x = slice(k, k + SLAB)
                near = (names[x] >> (8 * (depth + 1 - TOP)) & ((1 << 8 * TOP) - 1)) << 8 | (names[x] & 0xFF)
                at = np.searchsorted(key, near)
                one = pair[at, :8] + pair[at, 8:] * p[x]
                bit = (names[x, None] >> BITS) & 1
                value[x] = np.log10(np.where(bit == 1, one, 1 - one)).sum(1)
            table[STRINGS] = names, value
        for batch in asked:
            for i in range(len(batch)):
                names, values = table[batch.column("kind")[i].as_py()]
                told = squeezed(values[np.searchsorted(names, spread(batch.column("names")[i], np.int64, True))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("file", "block", "kind", "names")), pa.array([told], pa.binary())], ["file", "block", "kind", "names", "values"])

    return blobs.unionByName(above).repartition(parts, "part").mapInArrow(run, "file long, block long, kind int, names binary, values binary")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", out: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    out: which rows are not learnt from; by default `held_out` of the key. depth: bytes of context, 3 to 7.
    """
    if not TOP <= depth <= 7:
        raise ValueError("contexts have 3 to 7 bytes")
    ship_package(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = row_named(docs, F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out(F.col(key)) if out is None else out, F.lit(False)).alias("held_out"))
    rows = rows.select(F.col("rid.file").alias("file"), F.col("rid.row").alias("row"), "key", "text", "held_out")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.select("file", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))  # a file's rows are few enough for one task
    limits = sizes.withColumn("block", F.floor(before / BLOCK_BYTES)).groupBy("file", "block").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    limits = written(limits, "blocks").withColumnRenamed("file", "of")
    limits = F.broadcast(limits) if limits.count() <= MAX_BROADCAST_BLOCKS else limits
    rows = rows.join(limits, (F.col("file") == F.col("of")) & F.col("row").between(F.col("low"), F.col("high"))).select("file", "block", "key", "text", "held_out")
    blobs = written(counted(rows, parts, depth), "counts")
    level = written(summary(blobs, parts, depth), "level")
    seen = level.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("long"), F.coalesce(F.sum("key"), F.lit(0))).first()
    train_tokens, distinct = int(seen[0]), int(seen[1])
    told = answers(blobs, tops(level.filter(F.col("kind") == STRINGS).select("key", "n", "x"), parts, depth), parts, depth)
    kind = dict(rows.dtypes)["key"]
    log_all = float(np.log10(train_tokens + distinct + 1))

    def run(texts: pa.Table, told_: pa.Table) -> pa.Table:
        import pandas as pd

        if not texts.num_rows:
            return schema.empty_table()

        table = {}
        for k in (WORDS, STRINGS):
            mine = told_.filter(pa.compute.equal(told_["kind"], k))
            names, values = (np.concatenate(x) for x in zip(*((spread(a, np.int64, True), spread(b, np.float64)) for a, b in zip(mine["names"], mine["values"], strict=True)), strict=True))
            names, first = np.unique(names, return_index=True)  # a block that two tasks read asked twice
            table[k] = names, values[first]
        del told_, names, values, mine  # the texts and their tables are enough to hold

        def looked_up(kind: int, x: np.ndarray) -> np.ndarray:
            codes, names = pd.factorize(x)
            return table[kind][1][np.searchsorted(table[kind][0], names)][codes]

        found = []
        for batch in texts.to_batches():
            data, at = byte_pairs.buffers(batch.column("text"))
            for x, y in byte_pairs.blocks(at, CHUNK):
                words_, w_at, strings_, s_at = tokens(data[at[x] : at[y]], at[x : y + 1] - at[x], depth)
                n, lp = looked_up(WORDS, words_.view(np.int64)), looked_up(STRINGS, strings_)
                found.append((np.diff(w_at), np.add.reduceat((n > 0).astype(np.int64), w_at[:-1]), np.add.reduceat(np.log10(n + 1), w_at[:-1]), np.add.reduceat(lp, s_at[:-1]), np.diff(s_at)))
        n_tokens, n_known, base, score, n_bytes = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({
            "key": texts["key"], "held_out": texts["held_out"], "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(n_tokens), train_tokens, np.int64),
            "base_score": base - n_tokens * log_all, "score": score, "bits_per_byte": -score / np.log10(2) / n_bytes,
        })

    fields = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    schema = pa.schema([("key", pa.null()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), *((c, pa.float64()) for c in ("base_score", "score", "bits_per_byte"))])
    return rows.groupBy("file", "block").cogroup(told.groupBy("file", "block")).applyInArrow(run, fields).withColumnRenamed("key", key)


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of those that are not held out."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_context_tree": op4_context_tree}
