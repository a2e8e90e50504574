"""Exact Jaccard self-join of word n-gram sets by universe partitioning.

Two sets of sizes a <= b with Jaccard >= t differ in at most D = (a + b)(1 - t)/(1 + t) elements. Sizes are cut into
bands; in the band of the larger set with its largest D, all elements are dealt by hash into m > D segments. D differing
elements touch at most D segments, so a linked pair has m - D equal ones, and by the pigeonhole principle the two sets
share one of the first D + 1 segments of any order that both follow. The order is by cost: a segment content costs the
classes that share it, so each set leaves out its m - D - 1 dearest segments (frequent passages, above all).

A band may allow one difference in its first segment instead: contents of the first segment less one element (its
one-deletion neighbourhood) are indexed too, and the other segments go down to the cheapest D - 1. A band does so if
its neighbourhoods cost less than the two segments that it then leaves out.

Candidates are compared in three steps: with the hub (smallest class) of each bucket; components are contracted; and the
classes of buckets that are still apart without their hub are partitioned anew into the finest segments there are, of one
element each, under the same order (this is where the pigeonhole becomes the prefix principle), with room for the overlap
that a link needs. Pairs are refused by sizes and 512-bit parity sketches before any text is fetched; the rest are verified exactly on
the texts.

Scale: equal sets are one class and meet only once. A signature travels as 6 bytes inside packed blocks, dealt by its own
hash (a clash of names only adds a candidate), and only contents that two classes share become rows. Texts are fetched
for surviving pairs alone. Hubs with many partners are split over tasks, their text once in each. Joins on names and classes are
inner joins, which adaptive execution splits where they are skewed. Every step is a written table or a plain join or
aggregate.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; fewer words than n are one
shingle of the whole sequence; texts of any length are compared whole; repeated rows and repeated keys are separate rows
of one class; component_id is the smallest key that is not null (null if all are null); no rows give no rows; input columns
other than key and text are not read, so they cannot clash. A document's shingles are counted by 64-bit names; whether
sets are equal and how far they overlap is decided by 128 bits.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.functions.session import give_back, row_named, ship_package, written
from catalogspark.llm import byte_pairs, shingles
from catalogspark.llm.components import components

BLOCK = 1 << 20
#: Signatures that a task gathers before it passes them on, and about as many that it compares at a time.
HELD = 250_000
#: Ratio of the largest to the smallest size in a band.
WIDTH = 1.4
#: Kinds of signature, in the low bits of its name: a segment, the first segment, its one-deletion neighbourhood, an empty segment.
PLAIN, FIRST, SHORTER, EMPTY = range(4)
#: 64-bit words of a sketch.
WORDS = 8
#: Bits of a name: 45 of hash, one for the parity of the band, two for the kind.
NAME = np.uint64((1 << 48) - 1)
#: Partners of a hub that one task compares.
PARTNERS = 512


class Bands:
    """Size bands for Jaccard >= num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a similarity above 0 and up to 1 is needed")
        self.num, self.den, self.bounds = num, den, [(1, 1)]

    def band(self, k: int) -> tuple[int, int]:
        while len(self.bounds) <= k:
            lo = self.bounds[-1][1] + 1
            # at least as wide as one step of the length filter, so that partners are at most one band away
            self.bounds.append((lo, max(int(lo * WIDTH), lo * self.den // self.num)))
        return self.bounds[k]

    def of(self, size: int) -> int:
        k = 0
        while self.band(k)[1] < size:
            k += 1
        return k

    def segments(self, k: int) -> int:
        """Segments of a band: one more than any pair differs in, and a sixteenth to leave out."""
        apart = 2 * self.band(k)[1] * (self.den - self.num) // (self.den + self.num)
        return apart + 1 + (apart + 12) // 16

    def apart(self, size: int, k: int) -> int:
        """Elements that a set of this size and a linked partner differ in at most, when the larger one is in band k."""
        return (size + min(self.band(k)[1], size * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    def searched(self, size: int) -> list[int]:
        """Bands of the larger set of a pair that a set of this size can be in."""
        k = self.of(size)
        return [k] + [k + 1] * (size * self.den >= self.num * self.band(k + 1)[0])

    def prefix(self, size: int) -> int:
        """Rarest elements of a set among which it meets any linked set."""
        return size - -(-size * self.num // self.den) + 1

    def index(self, size: int) -> int:
        """The same if the partner is no smaller and searches by its whole prefix."""
        return size - -(-size * 2 * self.num // (self.num + self.den)) + 1


def signatures(elements: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """Names of a set's segment contents and one-deletion neighbourhoods, and for even and odd bands how many segments are named.

    Empty segments come last in the order, so they are named only where a set has too few others.
    """
    out, named = [], [0, 0]
    for k in bands.searched(len(elements)):
        m = bands.segments(k)
        salt = np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = shingles.mixed(elements ^ salt)
        place = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        value = shingles.mixed(h + salt)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, place.astype(np.int64), value)
        filled = np.bincount(place.astype(np.int64), minlength=m) > 0
        filled[0] = True
        full = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)[: max(0, bands.apart(len(elements), k) + 1 - len(full))]
        shorter = sums[0] - value[place == 0]
        places = np.concatenate([full, empty, np.zeros(len(shorter), np.int64)]).astype(np.uint64)
        names = shingles.mixed(np.concatenate([sums[full], sums[empty], shorter]) + shingles.mixed(places * np.uint64(2) + salt))
        kind = np.repeat(np.array([PLAIN, EMPTY, SHORTER], np.uint64), [len(full), len(empty), len(shorter)])
        kind[0] = FIRST
        out.append(names << np.uint64(3) & NAME | np.uint64(4 * (k & 1)) | kind)
        named[k & 1] = len(full)
    return np.concatenate(out), named


def elements_alone(elements: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """Names of the finest segments: one element each."""
    return shingles.mixed(elements) << np.uint64(3) & NAME, [len(elements), 0]


def class_name(one: np.ndarray, two: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes() + two.tobytes(), digest_size=16).digest()


def each_set(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, at = byte_pairs.buffers(texts)
    for a, b in byte_pairs.blocks(at, BLOCK):
        yield from shingles.sets(data[at[a] : at[b]], at[a : b + 1] - at[a], n, wide=True)


def described(docs: DataFrame, n: int) -> DataFrame:
    """(rid, key, class, size, b0, ...) of every row of (rid, key, text); class is null for empty sets.

    b0, ... are the parities of the elements that fall on each of 512 bits: sets differ in at least as many elements as bits.
    """
    kinds = dict(docs.dtypes)
    names = ["rid", "key", "class", "size", *(f"b{i}" for i in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, bits = [], [], []
            for one, two in each_set(batch.column("text"), n):
                odd = (np.bincount((one & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1).astype(bool)
                classes.append(class_name(one, two) if len(one) else None)
                sizes.append(len(one))
                bits.append(np.packbits(odd).view(np.int64))
            table = np.array(bits, np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("key"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(table[:, i]) for i in range(WORDS))], names)

    return docs.mapInArrow(run, f"rid {kinds['rid']}, key {kinds['key']}, class binary, size long, " + ", ".join(f"b{i} long" for i in range(WORDS)))


def met(name: np.ndarray, owner: np.ndarray, ids: np.ndarray, facts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shared contents among all holders of some names."""
    order = np.lexsort((owner, name))
    name, owner = name[order], owner[order]
    keep = np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])[: len(name)]
    name, owner = name[keep], owner[keep]
    if not len(name):
        return
    bare = name & ~np.uint64(3)
    first = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
    count = np.diff(np.append(first, len(bare)))
    kind = (name & np.uint64(3)).astype(np.int32)
    segment = np.add.reduceat((kind != SHORTER).astype(np.int64), first)
    shared = np.repeat(count > 1, count)
    cost, wide = (np.repeat(x, count)[shared] - 1 for x in (segment, count))
    bare, kind, owner = bare[shared], kind[shared], owner[shared]
    odd = ((bare >> np.uint64(2)) & np.uint64(1)).astype(np.int32)
    columns = bare.view(np.int64), kind, odd, facts[owner, 0].astype(np.int64), facts[owner, 1 + odd].astype(np.int64), cost, wide
    for a in range(0, len(bare), 50_000):
        x = slice(a, a + 50_000)
        classes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(owner[x]), [None, pa.py_buffer(np.ascontiguousarray(ids[owner[x]]))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(c[x]) for c in columns), classes], ["name", "kind", "odd", "size", "named", "cost", "wide", "class"])


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared contents of one part's (blob); beyond six bytes a name and four of its owner, memory is that of HELD names."""
    names, ids, facts, owners, many = [], [], [], [], 0
    for batch in batches:
        for blob in batch.column("blob"):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            k = int(raw[:4].view(np.uint32)[0])
            a, b, c = 4 + 16 * k, 4 + 28 * k, 4 + 32 * k
            ids.append(raw[4:a].reshape(-1, 16).copy())
            facts.append(raw[a:b].copy().view(np.uint32).reshape(-1, 3))
            owners.append(np.uint32(many) + np.repeat(np.arange(k, dtype=np.uint32), raw[b:c].copy().view(np.uint32)))
            names.append(raw[c:].reshape(-1, 6).copy())  # six bytes each until their turn, and no batch is held
            many += k
    if not names:
        return
    ids, facts = np.concatenate(ids), np.concatenate(facts)
    two = ids.view(np.uint64)
    order = np.lexsort((two[:, 1], two[:, 0]))
    new = np.concatenate([[True], (two[order][1:] != two[order][:-1]).any(1)])
    same = np.empty(many, np.uint32)
    same[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    turns = -(-sum(map(len, names)) // HELD)
    for turn in range(turns):
        mine, whose = [], []
        for short, owner in zip(names, owners, strict=True):
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :6] = short
            full = wide.view(np.uint64).ravel()
            at = np.flatnonzero((full >> np.uint64(3)) % np.uint64(turns) == np.uint64(turn))
            mine.append(full[at])
            whose.append(same[owner[at]])
        yield from met(np.concatenate(mine), np.concatenate(whose), ids, facts)
    give_back()


def shared_contents(docs: DataFrame, n: int, bands: Bands, segments: Callable) -> DataFrame:
    """(name, kind, odd, class, size, named, cost, wide) of the contents that two or more classes of (text) share.

    cost: other classes with this content as a segment; wide: neighbourhoods included; named: segments of the class that are named at all.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[bytes, tuple[int, int, int]] = {}
        names: list[np.ndarray] = []
        held = 0

        def passed_on() -> pa.RecordBatch:
            name = np.concatenate(names)
            owner = np.repeat(np.arange(len(names)), [len(x) for x in names])
            ids = np.frombuffer(b"".join(classes), np.uint8).reshape(-1, 16)
            facts = np.array(list(classes.values()), np.uint32)
            part = ((name >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")  # owners stay in order
            part, name, owner = part[order], name[order], owner[order]
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            own, blobs = [], []
            for p in np.flatnonzero(np.diff(edges)).tolist():
                x = slice(edges[p], edges[p + 1])
                mine = owner[x]
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                count = np.diff(np.append(first, len(mine))).astype(np.uint32)
                who = mine[first]
                short = np.ascontiguousarray(name[x].view(np.uint8).reshape(-1, 8)[:, :6])
                own.append(p)
                blobs.append(np.uint32(len(who)).tobytes() + ids[who].tobytes() + facts[who].tobytes() + count.tobytes() + short.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            for one, two in each_set(batch.column("text"), n):
                if len(one) and (c := class_name(one, two)) not in classes:
                    found, named = segments(one, bands)
                    classes[c] = (len(one), *named)
                    names.append(found)
                    held += len(found)
                    if held >= HELD:
                        yield passed_on()
                        classes, names, held = {}, [], 0
        if held:
            yield passed_on()
        classes, names = {}, []
        give_back()

    dealt = docs.select("text").mapInArrow(deal, "part int, blob binary").repartition(parts, "part")
    return dealt.mapInArrow(meet, "name long, kind int, odd int, size long, named long, cost long, wide long, class binary")


def ranked(shared: DataFrame) -> DataFrame:
    """Adds `place`, the number of segments that come before this one in its set's order, and `inner`, the same without the first segment."""
    own = Window.partitionBy("class", "odd")
    segment = F.col("kind").isin(PLAIN, FIRST)
    order = own.orderBy(F.when(segment, 0).otherwise(1), "cost", "name")
    out = shared.withColumns({"rank": F.row_number().over(order), "present": F.count_if(segment).over(own)})
    # segments that no other class shares come first
    out = out.withColumn("place", F.col("named") - F.col("present") + F.col("rank") - 1)
    first = F.max(F.when(F.col("kind") == FIRST, F.col("place"))).over(own)
    inner = F.when(F.coalesce(first < F.col("place"), F.lit(True)), F.col("place") - 1).otherwise(F.col("place"))
    return out.withColumn("inner", inner).drop("rank", "present", "named")


def allocated(shared: DataFrame, bands: Bands) -> DataFrame:
    """(name, class) by which each class searches, under the cost-based allocation."""
    spark = shared.sparkSession
    top = shared.agg(F.max("size")).first()[0]
    table = [(k, *bands.band(k)) for k in range(bands.of(top) + 2)]  # logarithmic in the longest text
    band = F.broadcast(spark.createDataFrame(table, "k int, lo long, hi long"))
    sized = shared.join(band.select(F.col("k").alias("own"), "lo", F.col("hi").alias("up")), (F.col("size") >= F.col("lo")) & (F.col("size") <= F.col("up"))).drop("lo", "up")
    sized = sized.withColumn("k", F.when(F.col("own") % 2 == F.col("odd"), F.col("own")).otherwise(F.col("own") + 1)).join(band.select("k", "hi"), "k")
    num, den = bands.num, bands.den
    apart = F.expr(f"((size + least(hi, (size * {den}) div {num})) * {den - num}) div {den + num}")
    placed = ranked(sized.drop("own")).withColumn("apart", apart).drop("hi")
    placed = placed.filter((F.col("kind") != PLAIN) | (F.col("place") <= F.col("apart")))
    placed = written(placed.select("name", "kind", "class", "k", "place", "inner", "apart", "cost", "wide"), "placed")
    saved = F.when(F.col("kind").isin(PLAIN, FIRST) & (F.col("place") <= F.col("apart")) & (F.col("place") >= F.col("apart") - 1), F.col("cost")).otherwise(0)
    extra = F.when(F.col("kind").isin(SHORTER, FIRST), F.col("wide")).otherwise(0)
    near = F.broadcast(placed.groupBy("k").agg((F.sum(extra) < F.sum(saved)).alias("near")))  # one row a band
    plain, first = F.col("kind") == PLAIN, F.col("kind") == FIRST
    within = F.when(F.col("near"), ~plain | (F.col("inner") < F.col("apart") - 1)).otherwise((F.col("kind") == EMPTY) | ((plain | first) & (F.col("place") <= F.col("apart"))))
    return placed.join(near, "k").filter(within).select("name", "class")


def sifted(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column may be among the keys: all that are, and few others, found in a map of 2^24 bits.

    The map is a table of at most 2^18 words, so broadcasting it is bounded whatever the keys; it spares the exact join
    after it the shuffle of most rows while keys are fewer than bits, and costs little beyond.
    """
    hashed = lambda df: df.withColumn("_h", F.xxhash64(column)).withColumn("_w", F.expr(f"shiftright(_h, 6) & {(1 << 18) - 1}"))
    words = hashed(keys.select(column)).groupBy("_w").agg(F.expr("bit_or(shiftleft(1L, CAST(_h & 63 AS INT)))").alias("_bits"))
    return hashed(rows).join(F.broadcast(words), "_w").filter("_bits & shiftleft(1L, CAST(_h & 63 AS INT)) <> 0").drop("_h", "_w", "_bits")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets have den * |intersection| >= num * |union|, found from the texts.

    Each hub a is dealt over one task for PARTNERS partners, its text before theirs.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"))
    partners = pairs.join(salts, "a").select("a", F.expr("CAST(pmod(xxhash64(b), salts) AS INT)").alias("salt"), "b")
    roles = hubs.unionByName(partners).withColumn("class", F.coalesce("b", "a")).join(classes.select("class", "rid"), "class")
    roles = written(roles.select("rid", "a", "salt", "b"), "roles")
    rows = sifted(docs.select("rid", "text"), roles, "rid").join(roles, "rid").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = one = two = None
        for batch in batches:
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            linked = []
            for i, (mine, mine2) in enumerate(each_set(batch.column("text"), n)):
                if b[i] is None:
                    hub, one, two = (a[i], salt[i]), mine, mine2
                    continue
                assert hub == (a[i], salt[i])
                _, x, y = np.intersect1d(one, mine, assume_unique=True, return_indices=True)
                both = int((two[x] == mine2[y]).sum())
                if den * both >= num * (len(one) + len(mine) - both):
                    linked.append(i)
            keep = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    dealt = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a binary, b binary")


def near_enough(x: str, y: str, num: int, den: int):
    """Whether two sketched sets (columns size_x, b0_x, ...) may be linked: sizes and bits within what a link allows."""
    both = F.col(f"size_{x}") + F.col(f"size_{y}")
    bits = sum((F.bit_count(F.col(f"b{i}_{x}").bitwiseXOR(F.col(f"b{i}_{y}"))) for i in range(WORDS)), F.lit(0))
    length = (F.col(f"size_{x}") * den >= F.col(f"size_{y}") * num) & (F.col(f"size_{y}") * den >= F.col(f"size_{x}") * num)
    return length & (bits <= both - 2 * F.ceil(both * num / (num + den)))


def links(docs: DataFrame, described_: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """(node, root) of classes that are linked with another class; docs has (rid, text). None if no candidates exist."""
    bands = Bands(num, den)
    bits = [f"b{i}" for i in range(WORDS)]
    shared = written(shared_contents(docs, n, bands, signatures), "shared")
    if shared.isEmpty():
        return None
    reps = described_.filter("class IS NOT NULL").groupBy("class").agg(F.min("rid").alias("rid"), *(F.first(c).alias(c) for c in ("size", *bits)))
    members = written(allocated(shared, bands), "members")
    classes = written(reps.join(members.select("class").distinct(), "class", "left_semi"), "classes")
    drawn = lambda v: classes.select(F.col("class").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in ("size", *bits)])

    def starred(rest: DataFrame, seen: DataFrame | None, found: DataFrame | None) -> tuple:
        """Compares each bucket's classes with the bucket's smallest class."""
        hubs = rest.groupBy("name").agg(F.min("class").alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("name", "hub")
        met = rest.join(hubs, "name").filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
        return hubs, *checked(met, seen, found)

    def checked(pairs: DataFrame, seen: DataFrame | None, found: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        fresh = pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")
        fresh = fresh.join(drawn("a"), "a").join(drawn("b"), "b").filter(near_enough("a", "b", num, den))
        pairs = written(fresh.select("a", "b"), "pairs")
        new = written(verified(pairs, classes, docs, n, num, den), "links")
        found = new if found is None else found.unionByName(new)
        return pairs if seen is None else seen.unionByName(pairs), found, written(components(found), "roots")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))

    hubs, seen, found, roots = starred(members.withColumn("root", F.col("class")), None, None)
    # what remains: buckets whose classes, without their hub, are still apart
    left = rooted(members.join(hubs, "name").filter("class <> hub"), roots)
    apart = left.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("name")
    rest = written(left.join(apart, "name", "left_semi").select("class").distinct().join(classes.select("class", "rid"), "class").select("rid"), "rest")
    if rest.isEmpty():
        return roots
    texts = sifted(docs.select("rid", "text"), rest, "rid").join(rest, "rid", "left_semi")
    single = ranked(shared_contents(texts, n, bands, elements_alone))
    whole = F.expr(f"size - CAST(ceil(size * {num} / {den}) AS BIGINT)")
    short = F.expr(f"size - CAST(ceil(size * {2 * num} / {num + den}) AS BIGINT)")
    single = written(single.filter(F.col("place") <= whole).select("name", "class", "place", (F.col("place") <= short).alias("indexed")), "single")
    _, seen, found, roots = starred(rooted(single, roots), seen, found)
    known = rooted(single, roots).join(classes.drop("rid"), "class")
    x, y = (known.select("name", *[F.col(c).alias(f"{c}_{v}") for c in known.columns if c != "name"]) for v in "xy")
    least = F.ceil((F.col("size_x") + F.col("size_y")) * num / (num + den))
    room = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    smaller = (F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("class_x") < F.col("class_y")))
    # the first shared element of a linked pair leaves room for the overlap it needs
    met = x.filter("indexed").join(y, "name").filter(smaller & (F.col("root_x") != F.col("root_y")) & (room >= least) & near_enough("x", "y", num, den))
    return checked(met.select(F.least("class_x", "class_y").alias("a"), F.greatest("class_x", "class_y").alias("b")).distinct(), seen, found)[2]


def placed(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(rid, key, size, root) of every row of (rid, key, text)."""
    ship_package(rows.sparkSession)
    known = written(described(rows, n), "described")
    roots = links(rows.select("rid", "text"), known, n, num, den)
    if roots is None:
        return known.select("rid", "key", "size", F.col("class").alias("root"))
    return known.join(roots.withColumnRenamed("node", "class"), "class", "left").select("rid", "key", "size", F.coalesce("root", "class").alias("root"))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(rid, key, n_shingles, component_id) of every row."""
    rows = placed(row_named(docs, F.col(key).alias("key"), F.col(text).alias("text")), n, num, den)
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("least"))
    return rows.join(least, "root", "left").select("rid", "key", F.col("size").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs without all but the first row (by key, nulls last, then place) of each linked group; rows with an empty set stay."""
    named = row_named(docs, F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("doc"))
    rows = placed(named.select("rid", "key", "text"), n, num, den).filter("root IS NOT NULL")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "rid")).alias("first"))
    drop = rows.join(first, "root").filter("rid <> first.rid").select("rid")
    return named.join(drop, "rid", "left_anti").select(*(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with Jaccard >= 0.9 on 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = linked(docs, n=3, num=90, den=100)
    return out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLE_SQL = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 3 THEN list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:]) WHEN len(w) = 2 THEN [(w[1], w[2], NULL)]
      WHEN len(w) = 1 THEN [(w[1], NULL, NULL)] ELSE [] END)::VARCHAR AS g FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid, rid AS to_rid FROM w UNION SELECT r.rid, e.b FROM r JOIN e ON e.a = r.to_rid)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (rid)
JOIN (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN w d ON d.rid = r.to_rid GROUP BY r.rid) c USING (rid)
"""
}
