"""Training order on disk: packed token sequences, a keyed permutation to global slots, fixed-stride shards by range of slots."""

from __future__ import annotations

import base64
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, cut, shared_dir

#: Word pattern of the byte-level BPE vocabularies (a public, fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
SEQUENCE = 512
#: Record: number of tokens, then SEQUENCE little-endian 16-bit ids, zeros behind the last. Which documents a record holds
#: is in the shard's index beside it.
HEADER = "<i"
SHARD_RECORDS = 1 << 14
#: Bytes of sequences that a task sorts by shard at once, and the most partitions of the shuffle.
DEAL_BYTES = 64 << 20
_PARTITIONS = 20_000


def stride(length: int = SEQUENCE) -> int:
    return struct.calcsize(HEADER) + 2 * length


class Tokenizer:
    """Ids of whole texts; the ids of words between single blanks are kept for the next time, up to a bound.

    The pattern never matches over the border between a character that isn't white space and a blank before another
    such, so texts may be split there; anything else goes to the tokenizer as it is.
    """

    def __init__(self, vocabulary: str, keep: int = 300_000):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self, keep)

    def plain(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u2").tobytes()

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.plain(text)
        words = self.words
        try:
            return self.plain(first) + b"".join([words[w] for w in rest])
        except _Unsplit:
            return self.plain(text)


class _Unsplit(Exception):
    pass


class _Words(dict):
    def __init__(self, tokenizer: Tokenizer, keep: int):
        super().__init__()
        self.tokenizer, self.keep = tokenizer, keep

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unsplit
        found = self.tokenizer.plain(" " + word)
        if len(word) <= 40:
            if len(self) >= self.keep:
                self.clear()
            self[word] = found
        return found


_INDEX = ("doc_ids", "starts", "places")
_KINDS = {"n_tokens": pa.int32(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int32()), "places": pa.list_(pa.int64()), "tokens": pa.binary()}
_SQL_KINDS = "n_tokens int, doc_ids array<long>, starts array<int>, places array<long>, tokens binary"


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """(task, row, n_tokens, doc_ids, starts, places, tokens) for each sequence of `length` ids of docs (doc_id, text).

    A text's ids and one end mark follow those of the text before, so sequences are full but for the last of each task.
    doc_ids are the documents of a sequence in order; starts say where in the sequence each begins or goes on, places at
    which token of it. A null or empty text is the end mark alone. `task` and `row` number the sequences. The vocabulary is
    read where the tasks run, at the same path everywhere.
    """
    mark = struct.pack("<H", end)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, row = Tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        docs: list[int | None] = []
        starts: list[int] = []
        places: list[int] = []
        tokens: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal docs, starts, places, tokens, size
            rows.append((size, docs, starts, places, b"".join(tokens)))
            docs, starts, places, tokens, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal row, rows
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)]
            numbers = [pa.array(np.full(len(rows), task, np.int32)), pa.array(np.arange(row, row + len(rows)))]
            row, rows = row + len(rows), []
            return pa.RecordBatch.from_arrays([*numbers, *columns], ["task", "row", *_KINDS])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.ids(text.as_py() or "") + mark
                done = 0
                while done < len(ids):
                    piece = ids[done : done + 2 * (length - size)]
                    docs.append(doc)
                    starts.append(size)
                    places.append(done // 2)
                    tokens.append(piece)
                    size, done = size + len(piece) // 2, done + len(piece)
                    if size == length:
                        close()
                        if len(rows) >= 8192:
                            yield out()
        if size:
            close()
        if rows:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(each, f"task int, row long, {_SQL_KINDS}")


def permuted(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed bijection of range(n): a Feistel network over the next even number of bits, walked until within range."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:  # the round function mixes by multiplication and shifts
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed ^ mixed >> np.uint64(32)) & mask
        return left << half | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def starts_of(sequences: DataFrame) -> tuple[np.ndarray, int]:
    """Which number each task's first sequence has, and how many there are. Row counts by task are bounded by the tasks."""
    counts = sequences.groupBy("task").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("task")
    tasks, sizes = counts["task"].to_numpy(), counts["n"].to_numpy()
    starts = np.zeros((int(tasks.max()) + 1) if len(tasks) else 1, np.int64)
    starts[tasks] = np.append(0, np.cumsum(sizes)[:-1]) if len(tasks) else 0
    return starts, int(sizes.sum()) if len(sizes) else 0


def dealt(sequences: DataFrame, key: int, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(part, shard, block) of frozen sequences, in range partitions by slot: a partition holds whole shards in order.

    The slots are a keyed permutation of 0 .. N-1, a shard holds shard_records of them. What a task has for a shard goes as
    one compressed block of its rows, so the shuffle moves about what the frozen table takes.
    """
    starts, n = starts_of(sequences)
    sent = sequences.sparkSession.sparkContext.broadcast(starts)
    shards = -(-n // shard_records)
    each_part = max(1, -(-shards // _PARTITIONS))  # shards of a partition; one but for very many

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        slot = permuted(sent.value[table["task"].to_numpy()] + table["row"].to_numpy(), n, key)
        order = np.argsort(slot)
        rows = table.select(list(_KINDS)).append_column("slot", pa.array(slot)).take(pa.array(order)).combine_chunks()
        shard = slot[order] // shard_records
        borders = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist()
        pack = zstandard.ZstdCompressor(level=3)
        for lo, hi in zip(borders, [*borders[1:], len(shard)], strict=True):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rows.schema) as stream:
                stream.write_table(rows.slice(lo, hi - lo))
            columns = [pa.array([int(shard[lo]) // each_part], pa.int32()), pa.array([int(shard[lo])], pa.int32()), pa.array([pack.compress(sink.getbuffer())])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "block"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= DEAL_BYTES:
                yield from blocks(held)
                held, size = [], 0
        if held:
            yield from blocks(held)

    out = sequences.mapInArrow(each, "part int, shard int, block binary")
    return out.repartitionById(max(1, -(-shards // each_part)), "part").sortWithinPartitions("shard")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_shards(blocks: DataFrame, folder: str, length: int = SEQUENCE) -> DataFrame:
    """Writes dealt() blocks as files of fixed-stride records with an index each; (shard, path, first_slot, records, bytes, crc32, index_crc32).

    folder: a path or URI that pyarrow's file systems open on every executor. A file appears under its name only when
    it is whole, so a task that runs again replaces it by the same bytes. The result is the manifest, frozen once.
    """

    def written(store: fs.FileSystem, base: str, shard: int, packed: list[bytes]) -> tuple:
        tables = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all() for b in packed]
        rows = pa.concat_tables(tables).sort_by("slot").combine_chunks()
        n = rows["n_tokens"].to_numpy()
        records = np.zeros((len(n), stride(length)), np.uint8)
        head = struct.calcsize(HEADER)
        records[:, :head] = n.astype("<i4").view(np.uint8).reshape(-1, head)
        records[:, head:][np.arange(2 * length) < 2 * n[:, None]] = np.frombuffer(b"".join(rows["tokens"].to_pylist()), np.uint8)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, rows.select(list(_INDEX)).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(rows.select(list(_INDEX)))
        sums = []
        for end, data in ((".idx", sink.getvalue()), (".bin", records.tobytes())):
            part = f"{base}/shard-{shard:08d}{end}.{TaskContext.get().taskAttemptId()}.part"
            with store.open_output_stream(part) as file:
                file.write(data)
            store.move(part, f"{base}/shard-{shard:08d}{end}")
            sums.append(zlib.crc32(data))
        return shard, f"{folder}/shard-{shard:08d}.bin", rows["slot"][0].as_py(), len(n), records.nbytes, sums[1], sums[0]

    names = ["shard", "path", "first_slot", "records", "bytes", "crc32", "index_crc32"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        open_: int | None = None
        packed: list[bytes] = []
        done = []
        for batch in batches:
            for shard, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if packed and shard != open_:
                    done.append(written(store, base, open_, packed))
                    packed = []
                open_ = shard
                packed.append(block)
        if packed:
            done.append(written(store, base, open_, packed))
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        types = (pa.int32(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kinds = "shard int, path string, first_slot long, records long, bytes long, crc32 long, index_crc32 long"
    return cut(blocks.mapInArrow(each, kinds), "token-manifest")


def shard_rows(manifest: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(slot, shard, offset, n_tokens, doc_ids, starts, places, tokens) of the files of a manifest, read from them.

    A partition holds whole shards in order; offset is where a slot's record begins in its shard's file. A file that isn't
    what was written (records, crc32) fails its task.
    """
    kind = np.dtype([("n", "<i4"), ("ids", f"V{2 * length}")])
    head = struct.calcsize(HEADER)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, slot, records, crc, index_crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = _store(path)
                with store.open_input_stream(at.removesuffix(".bin") + ".idx") as file:
                    packed = file.read()
                index = pa.ipc.open_stream(packed).read_all() if zlib.crc32(packed) == index_crc else None
                done = found = 0
                with store.open_input_stream(at) as file:
                    while index is not None and (data := file.read(kind.itemsize * 1024)):
                        rows, found = np.frombuffer(data, kind), zlib.crc32(data, found)
                        numbers = np.arange(done, done + len(rows))
                        tokens = [data[i + head : i + head + 2 * n] for i, n in zip(range(0, len(data), kind.itemsize), rows["n"].tolist(), strict=True)]
                        columns = [pa.array(slot + numbers), pa.array(np.full(len(rows), shard, np.int32)), pa.array(numbers * kind.itemsize), pa.array(rows["n"].copy())]
                        columns += [index[c].slice(done, len(rows)).combine_chunks() for c in _INDEX] + [pa.array(tokens, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "n_tokens", *_INDEX, "tokens"])
                        done += len(rows)
                if (done, found) != (records, crc):
                    raise OSError(f"{path}: {done} records with crc32 {found}, {records} with {crc} were written")

    shards = manifest.count()
    part = max(1, -(-shards // _PARTITIONS))
    files = manifest.select("shard", "path", "first_slot", "records", "crc32", "index_crc32")
    files = files.repartitionById(max(1, -(-shards // part)), F.floor(F.col("shard") / part).cast("int")).sortWithinPartitions("shard")
    return files.mapInArrow(each, f"slot long, shard int, offset long, {_SQL_KINDS}")


def write(docs: DataFrame, key: int = 20240607, vocabulary: str = VOCABULARY, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS, end: int = END, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text; other columns are ignored) as shards in the order of training; their rows, read from the files.

    Rows are those of shard_rows(); slots are a keyed permutation of 0 .. N-1. Null and empty texts are an end mark, repeated
    rows come as often as they are there, documents without an id are there with a null one, an empty table gives no rows.
    folder: where the shards go, a new one in the shared folder if none is given.

    The sequences are frozen in the shared folder first: the order is one of that table's rows, and a lost executor's part
    is made again from it, not from another tokenization. It goes when the shards stand.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    if folder is None:
        folder = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    if folder.startswith("file:/"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    frozen = scratch.table(tokenize(docs, vocabulary, length, end), "sequences")
    manifest = write_shards(dealt(frozen, key, shard_records), folder, length)
    scratch.drop("sequences")
    return shard_rows(manifest, length)


@dataclass(frozen=True)
class Record:
    slot: int
    doc_ids: list[int | None]
    starts: list[int]
    places: list[int]
    tokens: np.ndarray


def read_shards(folder: str, start: int, stop: int, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS) -> Iterator[Record]:
    """Records of the slots start .. stop-1, one after another; reading goes on from any slot, and ends behind the last."""
    store, base = _store(folder)
    size = stride(length)
    for shard in range(start // shard_records, -(-stop // shard_records)):
        path = f"{base}/shard-{shard:08d}"
        if store.get_file_info(f"{path}.bin").type == fs.FileType.NotFound:
            return
        lo, hi = max(start, shard * shard_records), min(stop, (shard + 1) * shard_records)
        with store.open_input_stream(f"{path}.idx") as file:
            index = pa.ipc.open_stream(file.read()).read_all()
        with store.open_input_file(f"{path}.bin") as file:
            file.seek((lo - shard * shard_records) * size)
            for slot in range(lo, hi):
                record = file.read(size)
                if len(record) < size:
                    return
                (n,) = struct.unpack_from(HEADER, record)
                inside = (index[c][slot - shard * shard_records].as_py() for c in _INDEX)
                yield Record(slot, *inside, np.frombuffer(record, "<u2", n, struct.calcsize(HEADER)))
