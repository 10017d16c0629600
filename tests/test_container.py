import random

import pytest
from pyspark.sql import functions as F

from sievestone.operators import analytics, search
from sievestone.operators.blocks import with_next_head
from sievestone.sources import codec, container


def inputs():
    rng = random.Random(7)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = b" ".join(rng.choice(words) for _ in range(12_000))
    far = bytes(rng.randrange(256) for _ in range(500))
    yield from (b"", b"a", b"abc", b"x" * 5, b"x" * 5000, b"xababab", text, text[:70_000] + far + text[:90_000] + far, bytes(rng.randrange(256) for _ in range(3000)), b"ab" * 40 + bytes(1100) + b"ab" * 400)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_blocks_round_trip(level):
    for data in inputs():
        for marked in (True, False):
            raw = codec.encode(data, marked, level)
            assert len(raw) <= len(data) + 2 and (not data or codec.decode(raw, marked) == data)
        assert codec.decode(codec.encode(data, True, level)) == data and codec.decoded_len(codec.encode(data, True, level)) == len(data)


def test_operations_by_the_description():
    """Examples written out by hand from the format's tables."""
    assert codec.decode(bytes([0, 5, 0 << 3, ord("x"), 3 << 3 | 4])) == b"xxxxx"  # a literal and a repeat of offset 1
    assert codec.decode(bytes([0, 7, 2 << 3]) + b"xab" + bytes([1 | 0 << 2 | 1 << 6, 0])) == b"xabab" + b"ab"  # copy1, offset 2, length 4
    data = bytes(range(100))
    lit = bytes([29 << 3, 70]) + data
    assert codec.decode(bytes([0, 104]) + lit + bytes([2 | 0 << 2, 0, 0])) == data + data[36:40]  # copy2, offset 64
    assert codec.decode(bytes([0, 107]) + lit + bytes([3 | 1 << 3 | 1 << 5, 4, 0]) + b"zz") == data + b"zz" + (data + b"zz")[34:39]  # fused copy2
    packed = [codec.encode(x, False, 2) for x in inputs()]
    kinds = {op.kind for raw in packed if raw and raw[0] for op in codec.operations(raw, codec.varint(raw, 0)[1])}
    assert kinds == {"literal", "repeat", "copy1", "copy2", "fused2", "copy3"}


@pytest.mark.parametrize("raw", [b"", b"\1", bytes([0, 5, 0]), bytes([0, 5, 4 << 3 | 4]), bytes([0, 3, 0, 65]), bytes([0, 255, 255, 255, 255, 15, 0]), bytes([0, 9, 29 << 3])])
def test_wrong_blocks_are_found(raw):
    with pytest.raises(codec.CorruptBlock):
        codec.decode(raw)


def test_streams_round_trip():
    assert container.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    for data in inputs():
        raw = container.write_stream(data, 4096, 1, True, 512, [(0x81, b"mine")])
        assert len(raw) % 512 == 0 and b"".join(b.data for b in container.read_blocks(raw)) == data
        index = next(p for _, kind, p in container.chunks(raw) if kind == container.INDEX)
        got = container.read_index(index)
        assert container.whole_index(container.bare_index(index)) == index
        assert got["entries"] == [(b.at, b.start) for b in container.read_blocks(raw)] and got["total"] == len(data)
    two = container.write_stream(b"one" * 50) + container.write_stream(b"two" * 50)
    assert [(b.stream, b.start) for b in container.read_blocks(two)] == [(0, 0), (1, 0)]
    uneven = [(10, 0), (50, 100), (75, 1500), (4000, 1501)]
    assert container.read_index(container.index_chunk(uneven, 2000, 5000, 1000)[4:])["entries"] == uneven
    own = container.write_stream(b"abcdabcdabcdabcd" * 20, 4096, encoder=lambda part: codec.encode(part, False, 2) if len(part) > 100 else None)
    assert b"".join(b.data for b in container.read_blocks(own)) == b"abcdabcdabcdabcd" * 20
    skipped = list(container.read_blocks(container.write_stream(bytes(9000), 4096), from_offset=5000))
    assert [len(b.data) for b in skipped] == [0, 4096, 808]


def test_wrong_streams_are_found():
    good = container.write_stream(b"hello hello hello hello " * 9, 4096)
    bad_crc = bytearray(good)
    bad_crc[14] ^= 1
    for raw in (good[:-3], good[: good.rindex(b"\x20")], bytes(bad_crc), good[10:], good + container.chunk(0x05, b""), container.chunk(0xC1, b"") + good, good[:9] + b"\x0e" + good[10:]):
        with pytest.raises(ValueError):
            list(container.read_blocks(raw))
    assert list(container.read_blocks(bytes(bad_crc), container.Options(check_crc=False)))
    assert list(container.read_blocks(container.chunk(0xC1, b"") + good, container.Options(user_types=[0xC1])))
    assert list(container.read_blocks(good[10:], container.Options(need_identifier=False)))
    with pytest.raises(ValueError):
        container.Options(max_block=1)


def test_container_tables(spark):
    texts = {i: (b"some text with a needle %d in it " % i) * 400 for i in range(4)}
    files = container.encoded(spark.createDataFrame(list(texts.items()), "stream_id long, data binary"), 4096).select(F.col("stream_id").cast("string").alias("source"), "data")
    blocks = container.block_table(files)
    assert {r.source: r.n for r in blocks.groupBy("source").agg(F.sum("block_len").alias("n")).collect()} == {str(i): len(d) for i, d in texts.items()}
    found = search.scan(with_next_head(container.streams_of(files), 8, 4096), b"needle 2")
    assert found.count() == 400
    mix = {r.chunk_type: r["count"] for r in analytics.mix(container.chunk_table(files), "chunk_type", "length").collect()}
    assert mix[container.IDENTIFIER] == mix[container.END] == mix[container.INDEX] == 4
    ops = container.op_table(files)
    assert ops.where("op <> 'literal'").agg(F.sum("length")).first()[0] + ops.agg(F.sum("literals") + F.sum(F.when(F.col("op") == "literal", F.col("length")).otherwise(0))).first()[0] == sum(map(len, texts.values()))
    assert analytics.lineage(ops, "source", ["block_no", "op_no"], "op", of="repeat").count() >= 0 and container.user_chunks(files).isEmpty()
    assert '"total_uncompressed"' in container.index_json(container.chunk_table(files).where(f"chunk_type = {container.INDEX}").first().payload)
