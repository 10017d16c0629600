"""The container format: chunks one after the other, with checksums, an end mark, an index and chunks of the user's own.

A chunk is a type byte, three bytes of length and a payload. Streams may follow each other in one file. Files come as rows of
(source, data); chunks and blocks are rows again. One file is one row, so it must fit in a task's memory; stores have no such bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codec

# Fixed values of the format: chunk types, the checksum's constants; the stream identifier's text and the index's marks are its own.
LEGACY, UNCOMPRESSED, COMPRESSED, COMPRESSED_CRC, END, INDEX, PADDING, IDENTIFIER = 0x00, 0x01, 0x02, 0x03, 0x20, 0x40, 0xFE, 0xFF
MAGIC = b"Sieve"
INDEX_HEAD, INDEX_TAIL = b"places", b"secalp"
CRC_POLYNOMIAL, CRC_MASK = 0x82F63B78, 0xA282EAD8


class CorruptStream(ValueError):
    """Bytes that are no stream of the format."""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CRC_POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def masked_crc(data: bytes) -> int:
    """CRC-32C, rotated by 15 bits, plus a constant."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return (c >> 15 | c << 17) + CRC_MASK & 0xFFFFFFFF


def chunk(kind: int, payload: bytes) -> bytes:
    return bytes([kind]) + len(payload).to_bytes(3, "little") + payload


def chunks(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(position, type, payload)."""
    at = 0
    while at < len(raw):
        size = int.from_bytes(raw[at + 1 : at + 4], "little")
        if at + 4 + size > len(raw):
            raise CorruptStream("a chunk is cut off")
        yield at, raw[at], raw[at + 4 : at + 4 + size]
        at += 4 + size


@dataclass
class Options:
    """Of readers: check_crc; the largest block they take; whether identifiers may be missing; user chunk types known to the caller."""

    check_crc: bool = True
    max_block: int = codec.MAX_BLOCK
    need_identifier: bool = True
    user_types: Sequence[int] = field(default_factory=tuple)

    def __post_init__(self):
        if not 4 << 10 <= self.max_block <= codec.MAX_BLOCK:
            raise ValueError("the largest block is from 4 KiB to 8 MiB")


@dataclass
class Block:
    stream: int
    number: int
    start: int
    at: int
    kind: int
    stored: int
    data: bytes


def read_blocks(raw: bytes, options: Options = Options(), from_offset: int = 0) -> Iterator[Block]:
    """Blocks of all streams in raw. Blocks that end before from_offset have no data: they are neither decoded nor checked."""
    stream, number, start, limit, open_ = -1, 0, 0, options.max_block, False
    for at, kind, payload in chunks(raw):
        if kind == IDENTIFIER:
            if open_ or len(payload) != 6 or payload[:5] != MAGIC or payload[5] & 15 > 13 or payload[5] >> 6:
                raise CorruptStream("a wrong stream identifier")
            limit = 1 << (payload[5] & 15) + 10
            if limit > options.max_block:
                raise CorruptStream("blocks are larger than this reader takes")
            stream, number, start, open_ = stream + 1, 0, 0, True
        elif kind >= 0x80 or kind == INDEX or 0x41 <= kind < 0x80:
            if 0xC0 <= kind < PADDING and kind not in options.user_types:
                raise CorruptStream(f"chunk {kind:#x} can't be skipped and nobody knows it")
        elif not open_ and options.need_identifier:
            raise CorruptStream("a chunk before the stream identifier")
        elif kind in (UNCOMPRESSED, COMPRESSED, COMPRESSED_CRC):
            stream, crc, body = max(stream, 0), int.from_bytes(payload[:4], "little"), payload[4:]
            size = len(body) if kind == UNCOMPRESSED else codec.varint(body, 0)[0]
            if not size or size > limit:
                raise CorruptStream("a block is empty or too large")
            data = b""
            if start + size > from_offset:
                data = body if kind == UNCOMPRESSED else codec.decode(body, False, limit)
                if options.check_crc and masked_crc(body if kind == COMPRESSED_CRC else data) != crc:
                    raise CorruptStream("a checksum is wrong")
            yield Block(stream, number, start, at, kind, len(payload), data)
            number, start = number + 1, start + size
        elif kind == END:
            if payload and codec.varint(payload, 0)[0] != start:
                raise CorruptStream("the stream's length is not what its end says")
            open_ = False
        else:
            raise CorruptStream(f"chunk {kind:#x} is not known")
    if open_:
        raise CorruptStream("the stream has no end")


def write_stream(data: bytes, block_size: int = 2 << 20, level: int = 1, index: bool = False, padding: int = 0, user: Sequence[tuple[int, bytes]] = (), encoder=None) -> bytes:
    """One stream; user chunks come first. padding: the length becomes a multiple of it.

    encoder: a function of a block's bytes that gives them encoded without the leading 0 byte, or None to leave them to codec.encode().
    """
    bits = max(10, (block_size - 1).bit_length()) - 10
    out, entries = bytearray(chunk(IDENTIFIER, MAGIC + bytes([bits]))), []
    for kind, payload in user:
        if not 0x80 <= kind <= PADDING:
            raise ValueError("user chunks are of types 0x80 to 0xfe")
        out += chunk(kind, payload)
    for start in range(0, len(data), block_size):
        part = data[start : start + block_size]
        packed = (encoder(part) if encoder else None) or codec.encode(part, False, level)
        stored = packed[:1] == b"\0"
        entries.append((len(out), start))
        crc = masked_crc(part).to_bytes(4, "little")
        out += chunk(UNCOMPRESSED, crc + part) if stored else chunk(COMPRESSED, crc + packed)
    out += chunk(END, codec.put_varint(len(data)))
    if index:
        out += index_chunk(entries, len(data), len(out), block_size)
    if padding > 1 and (missing := -len(out) % padding):
        out += chunk(PADDING, bytes(missing - 4 + (padding * -(-(4 - missing) // padding) if missing < 4 else 0)))
    return bytes(out)


def _signed(v: int) -> bytes:
    return codec.put_varint(v << 1 if v >= 0 else (-v << 1) - 1)


def _read_signed(raw: bytes, at: int) -> tuple[int, int]:
    v, at = codec.varint(raw, at)
    return (v >> 1) ^ -(v & 1), at


def _halved(v: int) -> int:
    return v // 2 if v >= 0 else -(-v // 2)


def index_chunk(entries: Sequence[tuple[int, int]], total: int, stored: int, block_size: int) -> bytes:
    """entries: (compressed, uncompressed) offsets. Only differences to what is expected are kept."""
    plain = any(u != k * block_size for k, (_, u) in enumerate(entries))
    body = bytearray(INDEX_HEAD + _signed(total) + _signed(stored) + _signed(block_size) + _signed(len(entries)) + bytes([plain]))
    if plain:
        for k, (_, u) in enumerate(entries):
            body += _signed(u - (entries[k - 1][1] + block_size if k else 0))
    guess = block_size // 2
    for k, (c, _) in enumerate(entries):
        off = c - (entries[k - 1][0] + guess if k else 0)
        body += _signed(off)
        guess += _halved(off) if k else 0
    return chunk(INDEX, bytes(body) + (4 + len(body) + 10).to_bytes(4, "little") + INDEX_TAIL)


def read_index(payload: bytes) -> dict:
    """total, stored, block_size and entries (compressed, uncompressed) of an index chunk's payload."""
    if payload[:6] != INDEX_HEAD or payload[-6:] != INDEX_TAIL:
        raise CorruptStream("not an index")
    at, head = 6, []
    for _ in range(4):
        v, at = _read_signed(payload, at)
        head.append(v)
    total, stored, block_size, n = head
    plain, at = payload[at], at + 1
    if block_size < 0 or not 0 <= n <= 65_536 or plain > 1:
        raise CorruptStream("a wrong index")
    plain_offsets, packed_offsets, guess = [], [], block_size // 2
    for k in range(n):
        v = 0
        if plain:
            v, at = _read_signed(payload, at)
        plain_offsets.append(v + (plain_offsets[-1] + block_size if k else 0))
    for k in range(n):
        v, at = _read_signed(payload, at)
        packed_offsets.append(v + (packed_offsets[-1] + guess if k else 0))
        guess += _halved(v) if k else 0
    return {"total": total, "stored": stored, "block_size": block_size, "entries": list(zip(packed_offsets, plain_offsets, strict=True))}


def bare_index(payload: bytes) -> bytes:
    """An index without the parts that are the same in each, to be kept elsewhere."""
    read_index(payload)
    return payload[len(INDEX_HEAD) : -len(INDEX_TAIL) - 4]


def whole_index(bare: bytes) -> bytes:
    """The payload that bare_index() was made from."""
    return INDEX_HEAD + bare + (4 + len(INDEX_HEAD) + len(bare) + 10).to_bytes(4, "little") + INDEX_TAIL


def index_json(payload: bytes) -> str:
    i = read_index(payload)
    return json.dumps({"total_uncompressed": i["total"], "total_compressed": i["stored"], "est_block_uncompressed": i["block_size"], "offsets": [{"compressed": c, "uncompressed": u} for c, u in i["entries"]]})


# DataFrames of files: (source, data)

CHUNKS = "source string, chunk_no int, position long, chunk_type int, length int, payload binary"
BLOCKS = "source string, stream_no int, block_no int, block_start long, block_len int, position long, chunk_type int, stored_len int, data binary"
OPS = "source string, block_no int, op_no int, op string, length int, offset int, literals int, header int"


def _mapped(files: DataFrame, schema: str, rows_of) -> DataFrame:
    kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = rows_of(source, data or b"")
                while part := [r for _, r in zip(range(256), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return files.select("source", "data").mapInArrow(run, schema)


def chunk_table(files: DataFrame) -> DataFrame:
    """All chunks of container files, for mixes and user chunks."""
    return _mapped(files, CHUNKS, lambda s, d: ((s, k, at, kind, len(p), p) for k, (at, kind, p) in enumerate(chunks(d))))


def block_table(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Decoded blocks of container files; a file's streams are numbered from 0."""
    return _mapped(files, BLOCKS, lambda s, d: ((s, b.stream, b.number, b.start, len(b.data), b.at, b.kind, b.stored, b.data) for b in read_blocks(d, options)))


def op_table(files: DataFrame) -> DataFrame:
    """Operations of the compressed blocks, for op totals, lineage and runs."""

    def ops(source, data):
        n = 0
        for _, kind, payload in chunks(data):
            if kind in (COMPRESSED, COMPRESSED_CRC):
                at = codec.varint(payload, 4)[1]
                for k, op in enumerate(codec.operations(payload, at)):
                    yield source, n, k, op.kind, op.length, op.offset, len(op.literals) if op.kind != "literal" else 0, op.header
            n += kind in (UNCOMPRESSED, COMPRESSED, COMPRESSED_CRC)

    return _mapped(files, OPS, ops)


def user_chunks(files: DataFrame) -> DataFrame:
    return chunk_table(files).where(F.col("chunk_type").between(0x80, 0xFD))


def streams_of(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(stream_id, block_no, block_start, block_len, data, is_last): container files as block tables for search and ranges; ids are hashes of file and stream."""
    from ..operators.blocks import from_pieces

    rows = block_table(files, options).select(F.xxhash64("source", "stream_no").alias("stream_id"), "block_no", "data")
    return from_pieces(rows)


def encoded(streams: DataFrame, block_size: int = 2 << 20, level: int = 1, index: bool = True) -> DataFrame:
    """(stream_id, data): each stream as the bytes of a container file."""

    def run(batches):
        for batch in batches:
            out = [write_stream(d or b"", block_size, level, index) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["stream_id", "data"])

    return streams.select("stream_id", "data").mapInArrow(run, "stream_id long, data binary")
