"""Product codes of vectors: codebooks learnt in rounds over the whole table, searched through a GNAT.

Components become integers, floor(scale * x). A vector is cut into equal consecutive parts; each part position has a codebook
of at most 256 entries, which starts as that part of the vectors of the smallest ids. A round assigns every part to the
nearest entry and moves each entry to the componentwise floor of the mean of its parts; entries without parts stay.

The entries of a codebook are held in a geometric near-neighbour access tree: a node's split points share out its entries,
and for each pair of split points it keeps the range of distances from the one to the entries of the other. A query's distance
to a split point leaves out every subtree whose range lies further from it than the best distance so far, strictly and
with bounds rounded outwards, so an entry at an equal distance is never lost; the distances that decide are integers, and
ties go to the lower index. Queries go down the tree together, a batch at a time.

One round is one pass: tasks add up their parts' sums and counts by entry, so a shuffle carries parts * entries rows a
task whatever the input; codebooks (parts * entries vectors) are all that the driver sees.

Defined cases: a vector that is null or holds null or non-finite components is dropped, and so is one with a component whose
integers are so large that an error could leave 64 bits (see `bound`); vectors whose length differs from that of the first
kept id, or is no multiple of the parts, get null code and error and take no part in learning; a null id is kept, and comes
last among ids; of repeated ids the smaller vector comes first, and repeated rows count each; fewer vectors than entries give
as many entries as vectors; labels of null belong together; no rows give no rows; other columns are not taken, so cannot clash.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import ship_package, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and entries up to which a node is not split: comparing a batch with a few dozen entries at once costs less than deciding which to leave out.
DEGREE, LEAF = 8, 64
#: Queries that go down a tree together.
BATCH = 4096
#: Labels up to which their sums are broadcast.
FEW_LABELS = 100_000


def bound(dims: int) -> int:
    """Integers of at least this size are refused: below it, the squared distances of dims components add up to less than 2**62."""
    return int((2**62 / max(dims, 1)) ** 0.5) // 2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows, in doubles while these hold them exactly."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * top * top * max(a.shape[1], 1) < 2**52:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - e) ** 2).sum(1) for e in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def below(squared: np.ndarray) -> np.ndarray:
    """A number that is at most the root of each integer."""
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), 0), 0)


def above(squared: np.ndarray) -> np.ndarray:
    """A number that is at least the root of each integer."""
    return np.nextafter(np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf), np.inf)


class Gnat:
    """A tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(entries)) if index is None else index
        if len(index) <= LEAF:
            self.index, self.points, self.children = index, entries[index], []
            return
        every = distances(entries[index], entries[index])
        chosen, apart = [0], every[0].copy()  # each next split point is the entry furthest from those before
        while len(chosen) < DEGREE and apart.max() > 0:
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, every[chosen[-1]])
        to_split = every[chosen]
        owner = to_split.argmin(0)
        owner[chosen] = np.arange(len(chosen))
        self.index, self.points = index[chosen], entries[index[chosen]]
        inner = np.ones(len(index), bool)
        inner[chosen] = False
        groups = [np.flatnonzero(inner & (owner == j)) for j in range(len(chosen))]
        # low[i, j] and high[i, j]: distances from split point i to the entries below split point j, rounded outwards
        self.low = np.array([[below(to_split[i, g]).min(initial=np.inf) for g in groups] for i in range(len(chosen))])
        self.high = np.array([[above(to_split[i, g]).max(initial=-np.inf) for g in groups] for i in range(len(chosen))])
        if len(chosen) == 1:  # all entries are equal: the smallest index stands for them
            self.children = [None]
        else:
            self.children = [Gnat(entries, index[g]) if len(g) else None for g in groups]

    def search(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Lowers best (squared distance) and at (entry) of the given rows of queries."""
        found = distances(queries[rows], self.points)
        near = found.min(1)
        entry = np.where(found == near[:, None], self.index, np.iinfo(np.int64).max).min(1)
        better = (near < best[rows]) | ((near == best[rows]) & (entry < at[rows]))
        best[rows[better]], at[rows[better]] = near[better], entry[better]
        if not any(self.children):
            return
        least, most = below(found), above(found)
        first = found.argmin(1)
        for nearest in (True, False):  # the subtree of the nearest split point first: it makes the best distance small
            for j, child in enumerate(self.children):
                if child is None:
                    continue
                turn = np.flatnonzero((first == j) == nearest)
                gap = np.maximum(least[turn] - self.high[:, j], self.low[:, j] - most[turn])  # the triangle inequality, from every split point
                gap = np.nextafter(gap, -np.inf).max(1)
                turn = turn[gap <= above(best[rows[turn]])]
                if len(turn):
                    child.search(queries, rows[turn], best, at)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each query."""
        best, at = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), np.iinfo(np.int64).max)
        for a in range(0, len(queries), BATCH):
            self.search(queries, np.arange(a, min(a + BATCH, len(queries))), best, at)
        return at, best


def integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists: all components as integers, where each row's begin, and which rows are kept."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    x = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]  # null components become NaN
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    with np.errstate(all="ignore"):
        whole = np.floor(x * scale)
        fine = np.isfinite(whole) & (np.abs(whole) < np.repeat(np.array([bound(n) for n in size.tolist()]), size))
    bad = np.concatenate([[0], np.cumsum(~fine)])
    kept = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    return np.where(fine, whole, 0).astype(np.int64), offsets, kept


def whole_rows(batches, dims: int | None, scale: int):
    """For each Arrow batch (id, label, vector): the batch's kept rows, their number of components and, for those of dims, a matrix."""
    for batch in batches:
        flat, offsets, kept = integers(batch.column(2), scale)
        size = np.diff(offsets)
        fits = np.flatnonzero(kept & (size == dims))
        yield batch, np.flatnonzero(kept), fits, flat[(offsets[fits][:, None] + np.arange(dims or 0)).ravel()].reshape(len(fits), dims or 0)


class Codebooks:
    """The entries of each part position."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]


def rows_of(table: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    return table.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the vectors of the smallest ids; None without vectors."""

    def keep(batches):
        for batch in batches:
            flat, offsets, kept = integers(batch.column(2), scale)
            at = np.flatnonzero(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([flat[offsets[i] : offsets[i + 1]] for i in at.tolist()], pa.list_(pa.int64()))], ["id", "whole"])

    whole = rows.mapInArrow(keep, f"id {rows.schema['id'].dataType.simpleString()}, whole array<long>")
    order = [F.col("id").asc_nulls_last(), "whole"]
    few = whole.orderBy(*order).limit(entries).collect()  # at most `entries` rows
    dims = len(few[0].whole) if few else 0
    if not dims or dims % parts:
        return None
    if any(len(r.whole) != dims for r in few):
        few = whole.filter(F.size("whole") == dims).orderBy(*order).limit(entries).collect()
    matrix = np.array([r.whole for r in few], np.int64)
    return Codebooks(np.split(matrix, parts, 1))


def moved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean."""
    parts, width = len(books.entries), books.entries[0].shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        books = shared.value
        trees = books.trees()
        total = [np.zeros((len(e), width + 1), np.int64) for e in books.entries]  # sums, and the count last
        for _, _, _, whole in whole_rows(batches, parts * width, scale):
            for p, tree in enumerate(trees):
                own = whole[:, p * width : (p + 1) * width]
                entry, _ = tree.nearest(own)
                order = np.argsort(entry, kind="stable")
                used, start = np.unique(entry[order], return_index=True)
                if len(used):
                    total[p][used, :width] += np.add.reduceat(own[order], start)
                    total[p][used, width] += np.diff(np.append(start, len(order)))
        for p, t in enumerate(total):
            used = np.flatnonzero(t[:, width])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(t[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "sums"])

    partial = rows.mapInArrow(sums, "part int, entry int, sums array<long>")
    found = partial.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width + 1)]).collect()  # parts * entries rows
    out = [e.copy() for e in books.entries]
    for part, entry, *s in found:
        out[part][entry] = [int(x) // int(s[-1]) for x in s[:-1]]
    return Codebooks(out)


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = moved(rows, books, scale)
    return books


def coded(rows: DataFrame, books: Codebooks | None, scale: int = SCALE) -> DataFrame:
    """id, label, code (two hex digits a part) and error of every kept vector."""
    parts, width = (len(books.entries), books.entries[0].shape[1]) if books else (0, 0)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches):
        trees = shared.value.trees() if shared.value else []
        digits = np.array([f"{i:02x}" for i in range(256)], object)
        for batch, kept, fits, whole in whole_rows(batches, parts * width if parts else None, scale):
            n = batch.num_rows
            codes, errors, error = np.full(n, None, object), np.full(n, None, object), np.zeros(len(fits), np.int64)
            text = np.full(len(fits), "", object)
            for p, tree in enumerate(trees):
                entry, squared = tree.nearest(whole[:, p * width : (p + 1) * width])
                text, error = text + digits[entry], error + squared
            codes[fits], errors[fits] = text, error
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(codes[kept].tolist(), pa.string()), pa.array(errors[kept].tolist(), pa.int64())], ["id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all rows with the same label added up. codes: a written table."""
    sums = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= FEW_LABELS
    sums = sums.select(F.col("label").alias("other"), "label_error")
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("other"))).drop("other")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all `embeddings`, with the digest of the codebooks."""
    ship_package(spark)
    rows = rows_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label", "embedding")
    books = fitted(rows)
    codes = with_label_errors(written(coded(rows, books), "codes"))
    digest = F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest())
    return codes.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _round_sql(i: int) -> str:
    """Assignment a<i> to the entries e<i>, and the entries e<i + 1> after it."""
    return f"""
a{i} AS (SELECT rid, part, min((p.n2 - 2 * list_dot_product(v, e.c) + e.n2)::BIGINT * 256 + entry) AS best FROM p JOIN (SELECT *, list_dot_product(c, c) AS n2 FROM e{i}) e USING (part) GROUP BY rid, part),
m{i} AS (SELECT part, entry, list(q ORDER BY pos) AS c FROM (SELECT part, best % 256 AS entry, pos, floor(sum(x) / count(*)) AS q FROM
    (SELECT rid, part, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM p) JOIN a{i} USING (rid, part) GROUP BY ALL) GROUP BY ALL),
e{i + 1} AS (SELECT part, entry, coalesce(m.c, e.c) AS c FROM e{i} e LEFT JOIN m{i} m USING (part, entry)),"""


ORACLE_SQL = {
    "op13_vector_codes": f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, [floor({SCALE} * x::DOUBLE) for x in embedding] AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT rid, part, v, list_dot_product(v, v) AS n2 FROM (SELECT rid, part, list_slice(w, part * len(w) // {PARTS} + 1, (part + 1) * len(w) // {PARTS}) AS v FROM k, range({PARTS}) r(part))),
e0 AS (SELECT part, rid - 1 AS entry, v AS c FROM p WHERE rid <= {ENTRIES}),{"".join(_round_sql(i) for i in range(ROUNDS + 1))}
o AS (SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string([x::BIGINT for x in c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (rid), h
"""
}
