"""Token ids in sorted-string-table shards.

Documents are tokenized and written in key order, one shard for each range of
keys. A shard holds blocks of prefix-compressed entries, a sparse index with the
first key of each block, a Bloom filter over document ids, and a footer, so that
one document is found by two binary searches.

    block    zstandard frame of entries, then crc32 of the frame (4 bytes)
    entry    varints: shared key bytes, other key bytes, value bytes; key rest; value
    key      00 for a null id, or 01 and the id as 8 bytes, sign flipped, big endian;
             then the entry's number in the shard, 8 bytes, so repeated ids stay apart
    value    width of an id in bytes, 2 or 4 (one byte), then token ids, little-endian
    index    for each block: key length, key, offset, size, entries, ids before it
    footer   offsets and sizes of index and filter, entries, ids, magic

Defined results: a null or empty text has only the end id; documents of one id
are ordered by the hash of their text; a null id sorts first; texts are
tokenized whole; an empty table gives no shards and an empty result; extra
columns are ignored. A task writes to a name of its own and moves the finished
shard into place, so a repeated or lost task leaves no half shard.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.text_bytes import bounded
from loomstone.staging import fresh_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
CACHED_WORDS = 500_000
SHARD_BYTES = 256 << 20
BATCH_BYTES = 256 << 10
MAGIC = b"LSST0001"
FOOTER = struct.Struct("<QQQQQQ8s")
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
LATIN_CHUNK = re.compile(r"[a-zß-öø-ÿ]+(?=[ \t\n\r\x0b\x0c.,]|\Z)|[.,](?=[ \t\n\r\x0b\x0c]|\Z)|[^ \t\n\r\x0b\x0c]+")
SHARD_SCHEMA = "shard int, path string, n_docs long, n_tokens long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def id_key(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    """The id of an entry's key."""
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _probes(key: bytes, bits: int) -> list[int]:
    digest = hashlib.blake2b(key, digest_size=16).digest()
    a, b = struct.unpack("<QQ", digest)
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


def pack_ids(ids: bytes) -> bytes:
    """The stored value of 32-bit ids: 16-bit ones where they all fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def count_ids(value: bytes) -> int:
    """The number of ids in a stored value."""
    return (len(value) - 1) // value[0]


def unpack_ids(value: bytes) -> bytes:
    """32-bit ids of a stored value."""
    return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[0] == 2 else value[1:]


class ShardWriter:
    """Writes one shard; what it holds in memory is one block, the index and the ids."""

    def __init__(self, out):
        self.out, self.offset = out, 0
        self.entries = self.tokens = self.in_block = self.before = 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys = bytearray(), []
        self.compress = zstandard.ZstdCompressor(level=3).compress

    def add(self, doc_id: int | None, packed: bytes) -> None:
        """Write one document's ids as a stored value; documents come in key order."""
        own = id_key(doc_id)
        if not self.keys or self.keys[-1] != own:
            self.keys.append(own)
        key = own + struct.pack(">Q", self.entries)
        if not self.in_block:
            self.first, self.last, self.before = key, b"", self.tokens
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(packed)) + key[shared:] + packed
        self.last = key
        self.entries, self.in_block, self.tokens = self.entries + 1, self.in_block + 1, self.tokens + count_ids(packed)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        frame = self.compress(bytes(self.block))
        self.out.write(frame + struct.pack("<I", zlib.crc32(frame)))
        self.index += struct.pack("<H", len(self.first)) + self.first
        self.index += struct.pack("<QQQQ", self.offset, len(frame) + 4, self.in_block, self.before)
        self.offset += len(frame) + 4
        self.block, self.in_block = bytearray(), 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_probes(key, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(bytes(self.index) + packed)
        at = self.offset + len(self.index)
        self.out.write(FOOTER.pack(self.offset, len(self.index), at, len(packed), self.entries, self.tokens, MAGIC))


class ShardReader:
    """Reads one shard: whole in order, or one document by its id."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, length, bloom_at, bloom_length, self.entries, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.bloom_at, self.bloom_length = bloom_at, bloom_length
        raw, k, self.index = self.file.read_at(length, at), 0, []
        while k < len(raw):
            n = struct.unpack_from("<H", raw, k)[0]
            self.index.append((raw[k + 2 : k + 2 + n], *struct.unpack_from("<QQQQ", raw, k + 2 + n)))
            k += 2 + n + 32
        self.firsts = [x[0] for x in self.index]

    def close(self) -> None:
        self.file.close()

    def _block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size, count, _ = self.index[number]
        data = self.file.read_at(size, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"damaged block {number}")
        data = zstandard.ZstdDecompressor().decompress(data[:-4])
        at, key = 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, unpack_ids(data[at : at + length])
            at += length

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the shard, ids) in key order."""
        for number, (_, _, _, _, before) in enumerate(self.index):
            for key, value in self._block(number):
                yield key_id(key), before, value
                before += len(value) // 4

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id."""
        own = id_key(doc_id)
        bits = self.bloom_length * 8
        bloom = self.file.read_at(self.bloom_length, self.bloom_at)
        if not all(bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(own, bits)):
            return []
        number, found = max(0, bisect_right(self.firsts, own) - 1), []
        for block in range(number, len(self.index)):
            if self.firsts[block][: len(own)] > own:
                break
            found += [np.frombuffer(v, "<u4") for k, v in self._block(block) if k[: len(own)] == own]
        return found


class WordEncoder:
    """Ids of texts by the tokenizers library, one library call for many new words.

    The tokenizer drops white space, lower-cases, and treats runs of letters and
    what lies between them separately, so a text's ids are those of its chunks one
    after another. Chunks end at ASCII white space, and in Latin-1 texts, which
    are lower-cased first, also between letters and a full stop or comma. Ids of
    chunks are cached in two generations, each of bounded size.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.older = Tokenizer.from_file(path), {}, {}
        if hasattr(self.tokenizer.model, "_resize_cache"):  # ours stands before it
            self.tokenizer.model._resize_cache(0)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(pieces.values(), default=0) < 1 << 16 else "<u4"
        self.ends_word = np.zeros(max(pieces.values(), default=0) + 1, bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece.endswith("</w>")]] = True

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        """Parts of a text that can be encoded on their own."""
        if not text:
            return []
        if "<|" not in text:
            if text.isascii():
                return LATIN_CHUNK.findall(text.lower())
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return CHUNK.findall(text)
            return LATIN_CHUNK.findall(text.lower())
        return CHUNK.findall(text)

    def _learn(self, words: list[str]) -> None:
        plain = list(filter(str.isalpha, words))
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            # A run of letters ends with one word-ending piece; if the counts differ, offsets decide.
            if len(cuts) == len(part):
                self._store(part, ids, np.concatenate(([0], cuts)))
            else:
                self._learn_by_offsets(part)
        self._learn_by_offsets(list(filterfalse(str.isalpha, words)))

    def _learn_by_offsets(self, words: list[str]) -> None:
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            encoding = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            begins = np.fromiter((o[0] for o in encoding.offsets), np.int64, len(encoding.ids))
            self._store(part, np.array(encoding.ids, dtype="<u4"), np.searchsorted(begins, starts))

    def _store(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        raw, width = ids.astype(self.kind).tobytes(), int(self.kind[-1])
        at = (cuts * width).tolist()
        self.cache.update(zip(words, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """The stored value of each text: its ids and the end id."""
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.older = {}, self.cache
        split = [self.chunks(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        known = new & self.older.keys()
        self.cache.update(zip(known, map(self.older.__getitem__, known), strict=True))
        self._learn(list(new - known))
        ids_of = self.cache.__getitem__
        found = [map(ids_of, words) for words in split]
        last = np.array([end], "<u4")
        if self.kind == "<u2" and end < 1 << 16:
            tail = last.astype("<u2").tobytes()
            return [b"".join([b"\x02", *ids, tail]) for ids in found]
        return [pack_ids(np.frombuffer(b"".join(ids), self.kind).astype("<u4").tobytes() + last.tobytes()) for ids in found]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The tokenizer of a worker."""
    return WordEncoder(path)


def write_shards(docs: DataFrame, directory: str, tokenizer: str = TOKENIZER) -> list[tuple[str, int, int]]:
    """Tokenize and write all documents; (path, documents, ids) of the shards in key order.

    The list has one item per shard. Shards hold about SHARD_BYTES of text, or
    less where there are fewer of them than shuffle partitions.
    """
    spark = docs.sparkSession
    in_all = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-in_all // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, out = encoder(tokenizer).encode, None, None
        for batch in bounded(batches, most=BATCH_BYTES):
            if writer is None:
                shard = TaskContext.get().partitionId()
                system, base = fs.FileSystem.from_uri(directory)
                system.create_dir(base)
                own, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.sst"
                out = system.open_output_stream(own)
                writer = ShardWriter(out)
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist(), END_ID), strict=True):
                writer.add(doc_id, value)
        if writer is not None:
            writer.finish()
            out.close()
            system.move(own, final)
            path = f"{directory}/{final.rsplit('/', 1)[1]}"
            columns = [[shard], [path], [writer.entries], [writer.tokens]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "path", "n_docs", "n_tokens"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranged = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    shards = ordered.mapInArrow(run, SHARD_SCHEMA).collect()
    return [(r["path"], r["n_docs"], r["n_tokens"]) for r in sorted(shards, key=lambda r: r["shard"])]


def read_shards(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document from the files, one task per shard."""
    before = np.cumsum([0] + [t for _, _, t in shards]).tolist()
    paths = [p for p, _, _ in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for number in batch.column("id").to_pylist():
                reader, rows = ShardReader(paths[number]), []
                for doc_id, start, ids in reader.scan():
                    rows.append((doc_id, before[number] + start, len(ids) // 4, zlib.crc32(ids)))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, ROW_SCHEMA)


def token_rows(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the shards of all documents to the shared folder and read them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, fresh_path(spark, "tokens"), tokenizer))
