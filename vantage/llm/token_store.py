"""Token ids of documents in Huffman-coded files.

The ids of all documents are counted over the whole corpus; a canonical Huffman code, limited to ``MAX_BITS`` bits by
package-merge, is derived from the counts and stored once, as code lengths. Files hold documents in ascending doc_id
order (nulls first), one file per range of doc_ids, in segments of at most ``SEGMENT`` ids:

    magic 8 bytes | documents, ids, blocks: uint64 | doc_id int64 per document | is-null uint8 per document |
    ids per document uint64 | bit offset uint64 per block and of the end | coded bits, padded with 8 zero bytes

All integers are little-endian. Blocks of ``BLOCK`` ids start at recorded bit offsets, so each can be decoded alone;
decoding looks ``MAX_BITS`` bits up in a table and works on all blocks of a segment in lock-step.
Beside the files lie the code lengths and a Parquet table ``manifest`` with a row for each file, so a store is opened by
its folder alone, and nothing that grows with the corpus passes through the driver.
A null text is empty; every document ends with id 0; an empty table gives no file and no row. Rows repeat freely, and
other columns are ignored. A text of any length is one document: it is held whole, with its ids, by the task that
encodes it, and may make a segment longer than ``SEGMENT``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import dir_size_partitions, discard, file_system, fresh_path, map_batches, shuffle_partitions, written
from vantage.llm.tokens import Encoder, default_tokenizer, encoder
from vantage.runtime import running

MAGIC = b"VHUFF01\n"
MAX_BITS, BLOCK, SEGMENT = 20, 256, 1 << 20
#: Ids in one file, about: documents are dealt by ranges of doc_id so that a task writes so many.
FILE_IDS = 1 << 23


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64) if counts.sum() > 1 << 62 else counts[order].astype(np.int64)
    level, kinds = leaves, []
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, packages))
        at = np.argsort(both, kind="stable")
        kinds.append(at < len(leaves))
        level = both[at]
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for leaf in reversed(kinds):
        own = int(leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= n - before
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, before = code + len(own), n
    return codes


def decode_table(lengths: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``bits`` bits: the id and its length."""
    own = np.flatnonzero(lengths)
    own = own[np.argsort(lengths[own], kind="stable")]
    spans = np.uint64(1) << (np.uint64(bits) - lengths[own].astype(np.uint64))
    ids, sizes = np.repeat(own.astype(np.uint32), spans.astype(np.int64)), np.repeat(lengths[own], spans.astype(np.int64))
    rest = (1 << bits) - len(ids)
    return np.concatenate((ids, np.zeros(rest, np.uint32))), np.concatenate((sizes, np.zeros(rest, np.uint8)))


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids' codes, one after another from the highest bit, as bytes; the bit at which each id starts, and the end."""
    n = lengths[ids].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(n)))
    start = at[:-1]
    word, room = start >> 6, 64 - (start & 63) - n
    code = codes[ids]
    words = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    if len(ids):
        # a code's bits are in its first word, shifted up or, where it runs over, down
        first = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[begins]] = np.add.reduceat(first, begins)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)  # at most one code runs into a word
    return words.astype(">u8").view(np.uint8), at


def unpack_bits(data: np.ndarray, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], block: int = BLOCK, bits: int = MAX_BITS) -> np.ndarray:
    """The ``n`` ids of blocks that start at ``offsets``; ``data`` needs 8 spare bytes at its end."""
    ids, sizes = table
    blocks = len(offsets)
    out = np.zeros((block, blocks), np.uint32)
    at = offsets.astype(np.int64)
    tail = n - (blocks - 1) * block if blocks else 0
    wide = data.astype(np.uint32)
    windows = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    mask, drop = np.uint32((1 << bits) - 1), 32 - bits
    if drop < 7:
        raise ValueError("codes are limited to 25 bits")
    for k in range(block):
        live = blocks if k < tail else blocks - 1
        look = windows[at[:live] >> 3] >> (drop - (at[:live] & 7)).astype(np.uint32) & mask
        out[k, :live] = ids[look]
        at[:live] += sizes[look]
    return out.T.reshape(-1)[:n]


def _tokens(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, n): each document's ids with the end id, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = bytes(encode.dtype.itemsize)
        for b in batches:
            ids = [encode(x) + end for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // len(end) for x in ids], pa.int64())], ["doc_id", "ids", "n"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids binary, n long")


def _counts(tokens: DataFrame, dtype: np.dtype, vocabulary: int) -> np.ndarray:
    """How often each id occurs: summed in each task, then by id; the vocabulary bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            col = b.column(0)
            if len(col):
                ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
                own = np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype)  # all rows' ids, one after another
                for at in range(0, len(own), 1 << 20):
                    total += np.bincount(own[at : at + (1 << 20)], minlength=vocabulary)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


_MANIFEST = "part long, name string, documents long, ids long, before long"


def write_store(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode whole texts and write the files; returns the store's folder, which is all that ``read_store`` needs.

    The manifest has (part, name, documents, ids, before): before is the number of ids in the files before.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    path = path or fresh_path(spark, "token-store")
    probe = Encoder(tokenizer)
    dtype, vocabulary = probe.dtype, probe.tok.get_vocab_size()
    tokens = written(_tokens(docs, tokenizer, id_col, text_col), "tokens")
    counts = _counts(tokens, dtype, vocabulary)
    lengths = code_lengths(counts)
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/code_lengths.u8") as f:
        f.write(lengths.tobytes())
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lens, codes = shared.value
        part = TaskContext.get().partitionId()
        own, base = file_system(path)
        name, out, held, size, docs_n, ids_n = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.vhuff", None, [], 0, 0, 0

        def segment() -> bytes:
            doc_ids = [d for d, _ in held]
            ids = np.frombuffer(b"".join(x for _, x in held), dtype)
            data, at = pack_bits(ids, lens, codes)
            offsets = np.concatenate((at[:-1:BLOCK], at[-1:]))
            head = np.array([len(held), len(ids), len(offsets) - 1], "<u8")
            each = np.array([len(x) // dtype.itemsize for _, x in held], "<u8")
            parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), each, offsets.astype("<u8"), data[: (int(at[-1]) + 7) // 8]]
            return MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts) + bytes(8)

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    out = own.open_output_stream(name)
                if held and size + len(x) > SEGMENT * dtype.itemsize:
                    out.write(segment())
                    held, size = [], 0
                held.append((d, x))
                size, docs_n, ids_n = size + len(x), docs_n + 1, ids_n + len(x) // dtype.itemsize
        if out is not None:
            out.write(segment())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], ["part", "name", "documents", "ids"])

    parts = dir_size_partitions(int(counts.sum()), FILE_IDS, shuffle_partitions(spark))
    order = F.xxhash64("ids")  # a doc_id that very many rows repeat is dealt out over files too
    ranged = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), order)
    made = written(map_batches(ranged.select("doc_id", "ids"), run, "part long, name string, documents long, ids long"), "files")
    running(made, ["part"], "before", F.col("ids")).write.parquet(f"{path}/manifest")
    discard(tokens, made)
    return path


def read_store(spark, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files of the folder ``path``.

    ids are little-endian uint32; start is the number of ids of all documents before it, ids_crc32 their checksum.
    Without ``with_ids`` the ids are decoded and summed up, but not returned.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = file_system(path)
        with own.open_input_file(f"{base}/code_lengths.u8") as f:
            table = decode_table(np.frombuffer(f.read(), np.uint8))
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with own.open_input_file(name) as f:
                    while magic := f.read(8):
                        if magic != MAGIC:
                            raise ValueError(f"{name} is not a token file")
                        n_docs, n_ids, n_blocks = np.frombuffer(f.read(24), "<u8").tolist()
                        doc_ids, nulls = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(n_docs), np.uint8)
                        each = np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
                        offsets = np.frombuffer(f.read(8 * (n_blocks + 1)), "<u8")
                        data = np.frombuffer(f.read((int(offsets[-1]) + 7) // 8 + 8), np.uint8)
                        ids = unpack_bits(data, offsets[:-1], n_ids, table).astype("<u4", copy=False).tobytes()
                        ends = np.cumsum(each)
                        texts = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), each.tolist(), strict=True)]
                        cols = [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(before + ends - each), pa.array(each), pa.array([zlib.crc32(x) for x in texts], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())] if with_ids else cols, names)
                        before += n_ids

    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select("name", "before")
    tasks = max(1, min(files.count(), 16 * shuffle_partitions(spark)))  # a task reads its files one after another
    return files.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def store_size(path: str) -> int:
    """Bytes of all token files of a store."""
    fs, root = file_system(path)
    from pyarrow.fs import FileSelector

    return sum(f.size for f in fs.get_file_info(FileSelector(root)) if f.path.endswith(".vhuff"))
