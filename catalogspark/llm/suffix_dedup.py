"""Removal of repeated byte strings by bucket-pointer refinement of suffixes; exact.

Every byte that is covered by a string of LENGTH bytes which also starts somewhere else in the corpus goes.

A window of LENGTH bytes is represented by one suffix: the one at the leftmost smallest Q-gram name in the window (a
pure function of the window's bytes, so equal windows choose suffixes at equal offsets). About one suffix in 69 is
chosen by any window at all. Refinement, coarse to fine, keeps only what is still in a bucket with others:

1. initial buckets of chosen suffixes by their Q-gram, whose names are doubled up from 8-grams at later offsets;
2. within a bucket, suffixes whose whole surroundings (all windows that chose them) are equal move on as one;
3. the rest are split on the identifiers of later and earlier offsets: windows that reach far to the right need an equal
   stretch [p, p + RIGHT), the others an equal stretch [p - LEFT, p + Q);
4. what is left in a bucket is refined offset by offset (`refined`): buckets of 8 bytes are split by sorting each place
   on its own bucket identifier and that of the place h later; the new identifiers serve the next round, in which h
   doubles, up to 128 bytes, and the last round looks 72 bytes ahead, which makes LENGTH. Places that are alone in
   their bucket, or look ahead to one that is, leave at once.

Scale: step 1 moves 34 bytes for each chosen suffix, in packed blocks dealt by the bucket's hash; suffixes with equal
surroundings are combined in each task before that. Texts are shuffled once, to meet their own suffixes. Buckets of
step 4 with more than HOT members are split by the names of their windows, with ordinary aggregation.

Defined cases: null and empty texts have nothing to remove; texts shorter than LENGTH are kept whole; texts of any
length are cut into overlapping stretches; repeated rows and keys are rows of their own (and so repeat each other); no
rows give no rows; a document's other columns travel in one struct, so names cannot clash. Q-gram buckets are named by
64-bit hashes; equality is decided by 128 bits of hash in steps 2 and in hot buckets, and by the bytes in step 4.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.session import row_named, ship_package, written
from catalogspark.llm import byte_pairs
from catalogspark.llm.byte_pairs import eights, mixed, ragged, word_names

LENGTH, Q = 200, 64
#: Q-grams of a window.
SPAN = LENGTH - Q + 1
#: Windows that start at most NEAR bytes before their suffix need [p, p + RIGHT) equal, the others [p - LEFT, p + Q).
NEAR = 68
RIGHT, LEFT = LENGTH - NEAR, NEAR + 1
STRETCH = 1 << 20
HELD = 1_000_000
HOT = 50_000
SETTLED, OPEN, EXAMPLE = 1, 0, 2
PLACE = np.uint64((1 << 24) - 1)


#: Stretches around a suffix are shorter than this.
AROUND = 1024


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the Q-grams from each place on, doubled up from 8-grams: a name joins those of two places, h bytes apart."""
    h = mixed(eights(data)[: len(data) - 7] + np.uint64(21))
    step = 8
    while step < Q:
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) ^ h[step:])
        step *= 2
    return h


def chosen(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, lowest window, highest window, q-gram name, name of the surroundings) of a stretch's chosen suffixes, by place."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    name = gram_names(data)
    at = np.arange(len(name))
    low = (name & ~PLACE) | at.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    # windows that lie in one text
    whole = np.zeros(len(low) + 1, np.int64)
    begin, end = offsets[:-1], offsets[1:] - LENGTH + 1
    own = end > begin
    np.add.at(whole, begin[own], 1)
    np.add.at(whole, np.minimum(end[own], len(low)), -1)
    windows = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(windows):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place = (low[windows] & PLACE).astype(np.int64)
    text = np.searchsorted(offsets, windows, "right")
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    lo, hi = windows[new], windows[np.append(new[1:], len(windows)) - 1]
    place = place[new]
    around = mixed(word_names(data, lo, hi + LENGTH, 22, AROUND) + mixed((place - lo).astype(np.uint64) + np.uint64(7)))
    return place, lo, hi, name[place], around


def stretches(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(from, to, offsets of texts within, first text) of stretches of at most STRETCH bytes; longer texts overlap by LENGTH - 1."""
    for a, b in byte_pairs.blocks(offsets, STRETCH):
        size = int(offsets[b] - offsets[a])
        if size <= 2 * STRETCH:
            yield int(offsets[a]), int(offsets[b]), offsets[a : b + 1] - offsets[a], a
        else:  # one long text
            for x in range(0, size - LENGTH + 1, STRETCH):
                y = min(size, x + STRETCH + LENGTH - 1)
                yield int(offsets[a]) + x, int(offsets[a]) + y, np.array([0, y - x]), a


def buckets(rows: DataFrame) -> DataFrame:
    """(rid, p, lo, hi, status) of chosen suffixes that share their bucket, from rows (rid, text)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def blobs(name, columns, settled: int) -> Iterator[pa.RecordBatch]:
            part = ((mixed(name) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            own = [p for p in range(parts) if edges[p] < edges[p + 1]]
            if own:
                columns = [c[order] for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([settled] * len(own), pa.int32()), *(pa.array([c[edges[p] : edges[p + 1]].tobytes() for p in own], pa.binary()) for c in columns)],
                    ["part", "settled", "name", "around", "file", "place", "reach"],
                )

        def passed_on() -> Iterator[pa.RecordBatch]:
            name, around, file, place, reach = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((around, name))
            name, around, file, place, reach = (x[order] for x in (name, around, file, place, reach))
            first = np.concatenate([[True], (name[1:] != name[:-1]) | (around[1:] != around[:-1])])
            many = np.repeat(np.diff(np.append(np.flatnonzero(first), len(name))) > 1, np.diff(np.append(np.flatnonzero(first), len(name))))
            reach = reach | (many.astype(np.uint32) << np.uint32(31))
            # all but one of equal surroundings are settled here and only pass through
            yield from blobs(name[first], [x[first] for x in (name, around, file, place, reach)], 0)
            rest = ~first
            yield from blobs(place[rest], [x[rest] for x in (name, around, file, place, reach)], 1)

        for batch in batches:
            data, at = byte_pairs.buffers(batch.column("text"))
            rid = batch.column("rid")
            files, numbers = (rid.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for x, y, inner, first in stretches(at):
                place, lo, hi, name, around = chosen(data[x:y], inner)
                text = first + np.searchsorted(inner, place, "right") - 1
                local = place + x - at[text]
                spot = (numbers[text].astype(np.uint64) << np.uint64(32)) | local.astype(np.uint64)
                reach = ((place - lo) << 8 | (place - hi)).astype(np.uint32)
                if len(name):
                    found.append((name, around, files[text], spot, reach))
                held += len(name)
                if held >= HELD:
                    yield from passed_on()
                    held = 0
        if found:
            yield from passed_on()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.uint64, np.uint64, np.int64, np.uint64, np.uint32)
        gathered: list[tuple[np.ndarray, ...]] = []

        def out(file, place, reach, status) -> Iterator[pa.RecordBatch]:
            p = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
            reach = reach.astype(np.int64) & 0x7FFFFFFF
            columns = file, (place >> np.uint64(32)).astype(np.int64), p, p - (reach >> 8), p - (reach & 255), status.astype(np.int32)
            for a in range(0, len(p), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], ["file", "row", "p", "lo", "hi", "status"])

        for batch in batches:
            for i, settled in enumerate(batch.column("settled").to_pylist()):
                name, around, file, place, reach = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in zip(("name", "around", "file", "place", "reach"), kinds, strict=True))
                if settled:
                    yield from out(file, place, reach, np.full(len(file), SETTLED))
                else:
                    gathered.append((name, around, file, place, reach))
        if not gathered:
            return
        name, around, file, place, reach = (np.concatenate(x) for x in zip(*gathered, strict=True))
        gathered.clear()
        order = np.lexsort((around, name))
        name, around, file, place, reach = (x[order] for x in (name, around, file, place, reach))
        group = np.concatenate([[True], name[1:] != name[:-1]])
        same = np.concatenate([[True], group[1:] | (around[1:] != around[:-1])])
        size = np.diff(np.append(np.flatnonzero(same), len(name)))
        settled = np.repeat(size > 1, size) | (reach >> np.uint32(31) > 0)
        settled = np.repeat(np.maximum.reduceat(settled, np.flatnonzero(same)), size)
        kinds_in = np.add.reduceat(same.astype(np.int64), np.flatnonzero(group))  # distinct surroundings in the bucket
        shared = np.repeat(kinds_in > 1, np.diff(np.append(np.flatnonzero(group), len(name))))
        status = np.where(settled, np.where(shared & same, EXAMPLE, SETTLED), OPEN)
        keep = settled | shared
        yield from out(file[keep], place[keep], reach[keep], status[keep])

    blocks = rows.mapInArrow(deal, "part int, settled int, name binary, around binary, file binary, place binary, reach binary")
    met = blocks.repartition(parts, "part").mapInArrow(meet, "file long, row long, p long, lo long, hi long, status int")
    return met.select(F.struct("file", "row").alias("rid"), "p", "lo", "hi", "status")


def kept_of(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes, bytes]:
    """(bytes removed, maximal runs, kept bytes, kept bytes that end at characters) for ranges of window starts."""
    covered = np.zeros(len(text) + 1, np.int64)
    for lo, hi in spans:
        covered[lo] += 1
        covered[hi + LENGTH] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    data = np.frombuffer(text, np.uint8)
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    kept = data[~gone].tobytes()
    if not runs:
        return 0, 0, kept, kept
    # a character goes only if all its bytes do
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(begin, len(data)))
    whole = np.repeat(np.logical_and.reduceat(gone, begin), size) if len(begin) and begin[0] == 0 else gone
    return int(gone.sum()), runs, kept, data[~whole].tobytes()


def result(batch: pa.RecordBatch, spans: list, with_text: bool) -> pa.RecordBatch:
    rows = []
    for t, s in zip(batch.column("text"), spans, strict=True):
        body = bytes(t.as_buffer()) if t.is_valid else b""
        removed, runs, kept, chars = kept_of(body, s) if s else (0, 0, body, body)
        rows.append((len(body), removed, runs, hashlib.sha256(kept).hexdigest(), chars.decode("utf-8", "replace") if with_text and t.is_valid else None))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]
    return pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def contexts(waiting: DataFrame) -> DataFrame:
    """Halves of the windows of open suffixes: (name of the longer stretch, rid, p, lo, hi, open, bytes [lo, hi + LENGTH))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                data = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
                own = [e for e in batch.column("entries")[i].as_py() if e["status"] != SETTLED]
                if not own:
                    continue
                p, lo, hi, status = (np.array([e[k] for e in own], np.int64) for k in ("p", "lo", "hi", "status"))
                for far, a, b, x, y in ((0, np.maximum(lo, p - NEAR), hi, p, p + RIGHT), (1, lo, np.minimum(hi, p - NEAR - 1), p - LEFT, p + Q)):
                    some = np.flatnonzero(a <= b)
                    if len(some):
                        # hash only the stretch itself, so that long texts cost no more than their suffixes
                        length = (y - x)[some]
                        flat = data[ragged(x[some], length)]
                        end = np.cumsum(length)
                        names = mixed(word_names(flat, end - length, end, 23, AROUND) + np.uint64(far)).view(np.int64)
                        for j, name in zip(some.tolist(), names.tolist(), strict=True):
                            out.append((name, i, p[j], a[j], b[j], status[j] == OPEN, data[a[j] : b[j] + LENGTH].tobytes()))
            for k in range(0, len(out), 20_000):
                columns = list(zip(*out[k : k + 20_000], strict=True))
                kinds = (pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                arrays = [batch.column("rid").take(pa.array(c)) if t is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "rid", "p", "lo", "hi", "open", "bytes"])

    return waiting.mapInArrow(run, "name long, rid struct<file: long, row: long>, p long, lo long, hi long, open boolean, bytes binary")


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and where each begins."""
    data, at = byte_pairs.buffers(column.cast(pa.large_binary()).view(pa.large_string()))
    return data[at[0] : at[-1]], at - at[0]


def windows_of(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the bytes, row, start in its document) of each row's windows."""
    count = hi - lo + 1
    place, row = ragged(at[:-1], count), np.repeat(np.arange(len(lo)), count)
    return place, row, lo[row] + place - at[:-1][row]


def rebucketed(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of pairs of identifiers, numbered by where they begin in sorted order, and which have several members."""
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(a)))
    bucket, many = np.empty(len(a), np.int64), np.empty(len(a), bool)
    bucket[order], many[order] = np.repeat(first, size), np.repeat(size > 1, size)
    return bucket, many


def refined(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of the rows [at[i], at[i + 1]) start a string of `length` bytes (8 at least) that starts at another place of the same group of rows.

    Bucket identifiers of h bytes split into those of 2 h by the identifiers of the places h later, over and over.
    """
    n = len(data)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    room = at[1:][row] - np.arange(n) if n else np.zeros(0, np.int64)
    bucket = np.full(n, -1, np.int64)
    live = np.flatnonzero(room >= length)  # where the string begins, and all places that it looks ahead to
    need = np.zeros(n + 1, np.int64)
    np.add.at(need, live, 1)
    np.add.at(need, live + length - 8 + 1, -1)
    looked = np.flatnonzero(np.cumsum(need[:-1]) > 0)
    ids, many = rebucketed(eights(data)[looked], group[row[looked]])
    bucket[looked[many]] = ids[many]
    h = 8
    while h < length:
        ahead = min(h, length - h)
        size = h + ahead
        here = looked[(bucket[looked] >= 0) & (looked + ahead < n)]
        here = here[(bucket[here + ahead] >= 0) & (room[here] >= size)]
        ids, many = rebucketed(bucket[here], bucket[here + ahead])
        bucket = np.full(n, -1, np.int64)
        bucket[here[many]] = ids[many]
        looked, h = here[many], size
    return bucket >= 0


def _numpy(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def found_in_groups(rows: DataFrame) -> DataFrame:
    """(rid, lo, hi) of runs of repeated windows; rows of a name are compared with each other, offset by offset."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            names = table["name"].to_numpy()
            cut = int(np.searchsorted(names, names[-1])) if len(names) else 0  # the last name may go on
            if cut:
                yield from compared(table.slice(0, cut))
            waiting = table.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield from compared(waiting)

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.combine_chunks().to_batches():
            name, lo, hi, open_ = _numpy(batch, "name", "lo", "hi", "open")
            data, at = row_bytes(batch.column("bytes"))
            place, row, start = windows_of(at, lo, hi)
            twin = refined(data, at, name)[place] & open_[row]
            hits = np.flatnonzero(twin)
            if len(hits):
                new = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(row[hits]) != 0)])
                first, last = hits[new], hits[np.append(np.flatnonzero(new)[1:], len(hits)) - 1]
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(row[first])), pa.array(start[first]), pa.array(start[last])], ["rid", "lo", "hi"])

    dealt = rows.repartition(parts, "name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, "rid struct<file: long, row: long>, lo long, hi long")


def found_by_rows(rows: DataFrame) -> DataFrame:
    """The same for names with very many rows: each window is a row, and plain aggregation finds the repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 2_000):
                batch = whole.slice(k, 2_000)
                lo, hi, open_ = _numpy(batch, "lo", "hi", "open")
                data, at = row_bytes(batch.column("bytes"))
                place, row, start = windows_of(at, lo, hi)
                one, two = (word_names(data, place, place + LENGTH, seed, AROUND) for seed in (31, 32))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("rid").take(pa.array(row)), pa.array(start), pa.array(open_[row])], ["one", "two", "rid", "s", "open"])

    windows = rows.mapInArrow(run, "one long, two long, rid struct<file: long, row: long>, s long, open boolean")
    many = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two")
    return windows.filter("open").join(many, ["one", "two"], "left_semi").select("rid", F.col("s").alias("lo"), F.col("s").alias("hi"))


def deduplicated(docs: DataFrame, key_columns: list[str], text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; doc holds key_columns, kept the text that stays, whole characters only."""
    ship_package(docs.sparkSession)
    named = row_named(docs, F.struct(*(F.col(f"`{c}`") for c in key_columns)).alias("doc") if key_columns else F.struct(F.lit(0).alias("none")).alias("doc"), F.col(text).alias("text"))
    kind = dict(named.dtypes)["doc"]
    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    entries = buckets(named.select("rid", "text")).groupBy("rid").agg(F.collect_list(F.struct("p", "lo", "hi", "status")).alias("entries"))
    joined = named.join(entries, "rid", "left")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows, and rows that wait for step 4 with their text and entries."""
        for batch in batches:
            found = batch.column("entries").to_pylist()
            wait = np.array([bool(e) and any(x["status"] != SETTLED for x in e) for e in found], bool)
            spans = [[] if w or not e else [(x["lo"], x["hi"]) for x in e] for e, w in zip(found, wait, strict=True)]
            idle = pa.array(~wait)
            done = result(batch.filter(idle), [s for s, w in zip(spans, wait, strict=True) if not w], with_text)
            n = len(done)
            blank = [pa.nulls(n, batch.schema.field(c).type) for c in ("rid", "text", "entries")]
            names = ["rid", "text", "entries", "doc", *done.schema.names[1:]]
            yield pa.RecordBatch.from_arrays([*blank, *done.columns], names)
            rest = batch.filter(pa.array(wait))
            if len(rest):
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in ("rid", "text", "entries", "doc")), *(pa.nulls(len(rest), f.type) for f in list(done.schema)[1:])], names)

    entry = "array<struct<p: long, lo: long, hi: long, status: int>>"
    first = written(joined.select("rid", "text", "entries", "doc").mapInArrow(settle, f"rid struct<file: long, row: long>, text string, entries {entry}, doc {kind}, {out}"), "settled")
    waiting = first.filter("rid IS NOT NULL").select("rid", "text", "entries", "doc")
    halves = written(contexts(waiting.select("rid", "text", "entries")), "contexts")
    sizes = halves.groupBy("name").agg(F.count("*").alias("n"), F.max("open").alias("o")).filter("n > 1 AND o")
    alive = halves.join(sizes.select("name", "n"), "name")
    some = found_in_groups(alive.filter(F.col("n") <= HOT).drop("n")).unionByName(found_by_rows(alive.filter(F.col("n") > HOT).drop("n")))
    more = written(some, "repeats").groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries_, more_ = batch.column("entries").to_pylist(), batch.column("more").to_pylist()
            spans = [[(x["lo"], x["hi"]) for x in e if x["status"] != OPEN] + [(x["lo"], x["hi"]) for x in m or []] for e, m in zip(entries_, more_, strict=True)]
            yield result(batch, spans, with_text)

    last = waiting.join(more, "rid", "left").select("text", "entries", "more", "doc").mapInArrow(finish, f"doc {kind}, {out}")
    return first.filter("rid IS NULL").select(*last.columns).unionByName(last)


def keep_unrepeated(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with their texts less all repeated strings, without rows that lose all their words; `length` names a column of character counts to renew."""
    out = deduplicated(docs, [c for c in docs.columns if c != text], text, with_text=True)
    worded = ~(F.col("n_removed") > 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")

    def column(c: str) -> Column:
        if c == text:
            return F.col("kept").alias(c)
        own = F.col("doc")[c]
        return (F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(own) if c == length else own).alias(c)

    return out.filter(worded).select(*map(column, docs.columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are left of every document without strings of 200 bytes that start twice in the corpus."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
