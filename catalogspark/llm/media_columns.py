"""Media columns: payloads stored as 8-bit sample files inside zip archives, and a Spark data source that reads them.

`store` writes each payload as a WAV member (8 bits, one channel) of a zip archive, one archive a task, and records
archives of tasks that succeeded in a manifest table, so files of failed or repeated attempts are never read.
`MediaArchives` is the data source: it plans partitions as byte ranges over the archives, each reader takes the members
whose local header lies in its range from the archive's central directory, reads every member on its own by offset
(a failed read is tried again alone, on a new handle), and streams Arrow batches of bounded size.

Archives are opened through pyarrow's file systems, so the shared folder may be local, HDFS or an object store.

Defined cases: a null or empty text is one block of padding; payloads of any length are stored whole; equal texts give
equal media; repeated rows are separate members; a null key comes back null; no rows make no archives and no rows;
only the key and the text are read, so other columns cannot clash. A member that stays unreadable after the last try
fails the task, or with `on_error=row` gives a row with null payload and the reason.
"""

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from catalogspark.functions.session import shared_dir, ship_package

UNIT, TAIL = 192, 16
RATE = 8000
#: Archive bytes of a partition, and payload bytes of an Arrow batch.
RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
LOCAL_HEADER = struct.Struct("<4s5H3L2H")


def file_system(uri: str):
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def padded(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def to_wav(payload: bytes, n_bytes: int) -> bytes:
    """RIFF file: format, a chunk with the unpadded length, samples."""
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"nbyt" + struct.pack("<IQ", 8, n_bytes)
    chunks += b"data" + struct.pack("<I", len(payload) & 0xFFFFFFFF) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", (4 + len(chunks)) & 0xFFFFFFFF) + b"WAVE" + chunks


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length, by walking the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, n_bytes, samples = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = at + 8
        if name == b"fmt " and struct.unpack_from("<HH", media, body) + struct.unpack_from("<H", media, body + 14) != (1, 1, 8):
            raise ValueError("not 8-bit samples of one channel")
        if name == b"nbyt":
            n_bytes = struct.unpack_from("<Q", media, body)[0]
        if name == b"data":
            samples = media[body : body + size]
            if len(samples) != size:
                raise ValueError("samples are cut off")
        at = body + size + size % 2
    if samples is None:
        raise ValueError("no samples")
    return samples, len(samples) if n_bytes is None else n_bytes


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> str:
    """Writes all texts as media; returns the folder, to be loaded with the format `media_archives`."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or shared_dir(spark, "media")
    fs, root = file_system(folder)
    fs.create_dir(f"{root}/archives", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.zip"
        fs, root = file_system(folder)
        out, n = None, 0
        for batch in batches:
            if out is None and len(batch):
                sink = fs.open_output_stream(f"{root}/archives/{name}")
                out = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = b"" if not t.is_valid else bytes(t.as_buffer())
                info = zipfile.ZipInfo(f"{n}/{'null' if k is None else k}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                out.writestr(info, to_wav(padded(body), len(body)))
                n += 1
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "members": [n]})

    pairs = docs.select(F.col(key).cast("string"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    pairs.mapInArrow(write, "archive string, members long").write.parquet(f"{folder}/manifest")
    return folder


class ByteRange(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class MediaArchives(DataSource):
    """Options: path (a folder that `store` made, or any folder of zip archives with WAV members), range_bytes, tries, on_error (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "key string, n_bytes long, payload binary, media_bytes long, media_sha256 string, error string"

    def reader(self, schema) -> "ArchiveReader":
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.tries, self.on_error = int(options.get("tries", 4)), options.get("on_error", "fail")

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over archives of known size; no member is looked at here."""
        import pyarrow.dataset as ds
        from pyarrow import fs as pafs

        fs, root = file_system(self.folder)
        at = root
        if fs.get_file_info(f"{root}/manifest").type == pafs.FileType.Directory:
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/manifest")) if f.path.endswith(".parquet")]
            names = ds.dataset(files, filesystem=fs, format="parquet").to_table(columns=["archive"])["archive"].to_pylist() if files else []
            at = f"{root}/archives"
        else:
            names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".zip")]
        out = []
        for info in fs.get_file_info([f"{at}/{n}" for n in sorted(names)]):
            if info.size is None:
                raise FileNotFoundError(info.path)
            out += [ByteRange(info.path, a, min(a + self.range_bytes, info.size)) for a in range(0, info.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def again(self, what):
        """what(), tried alone up to `tries` times."""
        for i in range(self.tries):
            try:
                return what()
            except (OSError, ValueError, zlib.error):
                if i == self.tries - 1:
                    raise
                time.sleep(0.1 * 2**i)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = file_system(self.folder)
        handle: list = [None]

        def opened(anew: bool):
            if anew or handle[0] is None:
                handle[0] = fs.open_input_file(partition.archive)
            return handle[0]

        def directory() -> list[zipfile.ZipInfo]:
            with zipfile.ZipFile(opened(True)) as z:
                return sorted((m for m in z.infolist() if partition.begin <= m.header_offset < partition.end), key=lambda m: m.header_offset)

        def member(m: zipfile.ZipInfo, state: list) -> bytes:
            f = opened(state.pop() if state else True)
            f.seek(m.header_offset)
            head = LOCAL_HEADER.unpack(f.read(LOCAL_HEADER.size))
            if head[0] != b"PK\x03\x04":
                raise ValueError("no member at this offset")
            f.seek(m.header_offset + LOCAL_HEADER.size + head[9] + head[10])
            raw = f.read(m.compress_size)
            body = zlib.decompress(raw, -15) if m.compress_type == zipfile.ZIP_DEFLATED else raw
            if zlib.crc32(body) != m.CRC:
                raise ValueError("checksum differs")
            return body

        names = ["key", "n_bytes", "payload", "media_bytes", "media_sha256", "error"]
        types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        listed = self.again(directory)
        handle[0] = None
        for m in listed:
            key = m.filename.rpartition("/")[2].removesuffix(".wav")
            key = None if key == "null" else key
            state = [False]  # the first try uses the open handle, later ones a new one
            try:
                media = self.again(lambda m=m, state=state: member(m, state))
                payload, n_bytes = from_wav(media)
                rows.append((key, n_bytes, payload, len(media), hashlib.sha256(media).hexdigest(), None))
                held += len(payload)
            except (OSError, ValueError, zlib.error) as e:
                if self.on_error != "row":
                    raise
                rows.append((key, None, None, None, None, str(e)))
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of all archives below a folder."""
    ship_package(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32 and feature, all computed from the samples that were read back."""

    @F.arrow_udf("payload_sha256 string, tail_crc32 long, feature string")
    def features(payloads: pa.Array) -> pa.Array:
        rows = []
        for p in payloads:
            if not p.is_valid:
                rows.append(None)
                continue
            raw = bytes(p.as_buffer())
            x = np.frombuffer(raw, np.uint8)
            wave = x.astype(np.int16) - 128
            hist = np.bincount(x, minlength=256)
            share = hist[hist > 0] / len(x)
            # exact integer sums first, so that the text never depends on the order of additions
            power, crossings = int((wave.astype(np.int64) ** 2).sum()), int(((wave[1:] < 0) != (wave[:-1] < 0)).sum())
            entropy = -float((share * np.log2(share)).sum())
            feature = f"rms={(power / len(x)) ** 0.5:.4f};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};peak={int(np.abs(wave).max())};zero_crossings={crossings};entropy={entropy:.4f}"
            rows.append({"payload_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-TAIL:]), "feature": feature})
        return pa.array(rows, pa.struct([("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]))

    out = media.withColumn("_f", features("payload"))
    return out.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_sha256": F.col("_f.payload_sha256"), "tail_crc32": F.col("_f.tail_crc32"), "feature": F.col("_f.feature")}).drop("_f")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document as media, reads it back through the data source and describes it."""
    folder = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = describe(load(spark, folder))
    return out.select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES = {"op3_media_columns": op3_media_columns}
