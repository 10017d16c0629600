import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievestone.functions.patterns import SearchConfig
from sievestone.operators import blocks, search
from sievestone.sources import store as st
from sievestone.streaming import builder, follow


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(9)
    rows = [(i, b"".join(rng.choice([b"alpha ", b"beta=1 ", b"gamma\n", b"delta "]) for _ in range(rng.randrange(1, 400)))) for i in range(12)]
    return spark.createDataFrame([*rows, (50, b"x" * 300 + b"needle" + b"y" * 700)], "stream_id long, data binary")


def test_store_round_trip(spark, streams, tmp_path):
    path, side, again = (str(tmp_path / x) for x in ("main", "side", "again"))
    st.write_store(streams, path, 128, [SearchConfig(match_len=4)], parts=3)
    with pytest.raises(Exception, match="(?i)exists"):
        st.write_store(streams, path, 128)
    own = st.Store(spark, path)
    key = lambda df: sorted((r.stream_id, r.stream_offset) for r in df.collect())
    want = key(search.scan(blocks.cut(streams, 64, 32), b"gamma\nbeta"))
    assert want and key(own.search(b"gamma\nbeta")) == want and own.verify().isEmpty()
    assert key(own.search(b"needle", bail=True)) == [(50, 300)] and own.stats(b"needle").first().blocks_searched < 5
    st.add_tables(spark, path, [SearchConfig(match_len=3, config_id=4).with_byte_prefix(b"=")], sidecar=side)
    assert key(st.Store(spark, path, side).search(b"=1 gamma")) == key(search.scan(blocks.cut(streams, 64, 32), b"=1 gamma"))
    st.rewrite(spark, path, again, block_size=200, codec="snappy")
    assert st.Store(spark, again).block_size == 200 and key(st.Store(spark, again).search(b"needle")) == [(50, 300)]
    whole = lambda df: {r.stream_id: bytes(r.data) for r in df.collect()}
    assert whole(own.read()) == whole(streams) and whole(own.tail(10)) == {k: v[-10:] for k, v in whole(streams).items()}
    assert own.seek_index.count() == own.blocks.count()


def test_search_opens_candidate_parts_only(spark, tmp_path):
    """A search opens the files of parts with a block left, no others, and finds all; so does one by tables beside the store."""
    rng = random.Random(10)
    rows = [(i, bytes(rng.choice(b"abcdefgh") for _ in range(4000)) + (b"the needle" if i == 7 else b"")) for i in range(16)]
    path, side = str(tmp_path / "main"), str(tmp_path / "side")
    st.write_store(spark.createDataFrame(rows, "stream_id long, data binary"), path, 512, [SearchConfig(match_len=6, base_log2=14)], parts=16)
    st.add_tables(spark, path, [SearchConfig(match_len=5, config_id=2, base_log2=14)], side)
    everything = len(st.Store(spark, path).blocks.inputFiles())
    for own in (st.Store(spark, path), st.Store(spark, path, side)):
        hit = own.search(b"the needle", bail=True)
        assert [(r.stream_id, r.stream_offset) for r in hit.collect()] == [(7, 4000)]
        assert everything >= 12 and len(own.candidates(b"the needle").inputFiles()) <= 2
        assert own.search(b"nowhere here").count() == 0 and own.candidates(b"nowhere here").count() == 0


def test_python_gets_small_batches(spark, tmp_path, monkeypatch):
    """Batches that go to Python are bounded by bytes, not by rows alone, where tables are built and where blocks are scanned."""
    frame, sizes = type(spark.range(0)), []

    def noted(df, f, schema):
        def sized(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"bytes": pa.array([batch.nbytes], pa.int64())})

        sizes.append(plain(df.coalesce(1), sized, "bytes long").agg(F.max("bytes"), F.sum("bytes")).first())
        return plain(df, f, schema)

    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", noted)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(8).select(F.col("id").alias("stream_id"), F.encode(F.expr("repeat('needle and hay ', 150000)"), "UTF-8").alias("data"))
    st.write_store(rows, str(tmp_path / "s"), 1 << 14, [SearchConfig(match_len=4)], parts=2)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert st.Store(spark, str(tmp_path / "s")).search(b"needle and hay").count() == 8 * 150000
    assert len(sizes) == 2 and all(most < 6 << 20 < total for most, total in sizes)


def test_files_and_sniffing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, raw in (("a/one.txt", b"\xffstream"), ("a/two.txt", b"\x00block"), ("three.txt", b"text"), ("four.bin", b"no")):
        (tmp_path / name).write_bytes(raw)
    df = st.sniff(st.files(spark, str(tmp_path), glob="*.txt", recursive=True))
    assert {r.source.rsplit("/", 1)[1]: r.kind for r in df.collect()} == {"one.txt": "stream", "two.txt": "block", "three.txt": "raw"}


def test_incremental_blocks(spark, tmp_path):
    """Pieces over several micro-batches give the blocks that cutting the whole stream gives."""
    data, src, out = bytes(range(256)) * 9, tmp_path / "in", str(tmp_path / "out")
    rng, at, seq = random.Random(2), 0, 0
    while at < len(data):
        n = rng.randrange(1, 300)
        rows = [(1, seq, data[at : at + n], at + n >= len(data)), (2, seq, b"zz", False)]
        spark.createDataFrame(rows, "stream_id long, seq long, data binary, flush boolean").coalesce(1).write.mode("append").parquet(str(src))
        at, seq = at + n, seq + 1
    pieces = spark.readStream.schema("stream_id long, seq long, data binary, flush boolean").option("maxFilesPerTrigger", 4).parquet(str(src))
    q = builder.build_blocks(pieces, 100, 8).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r.block_no, r.block_start, bytes(r.data)) for r in spark.read.parquet(out).where("stream_id = 1").collect())
    assert b"".join(x[2] for x in got) == data and [x[1] for x in got] == [100 * k for k in range(len(got))]
    heads = {r.block_no: (bytes(r.next_head), r.has_overlap) for r in spark.read.parquet(out).where("stream_id = 1").collect()}
    assert all(h == data[100 * (k + 1) : 100 * (k + 1) + 8] for k, (h, full) in heads.items() if full)
    assert sum(not full for _, full in heads.values()) <= 2


def test_follow(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    (src / "a.log").write_text("error one\nfine\n")
    (src / "b.log").write_text("all fine\nerror two\nerror three\n")
    q = follow.follow_matches(spark, str(src), "error").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.line for r in spark.table("followed").collect()) == ["error one", "error three", "error two"]


def test_commands(spark, tmp_path, capsys):
    from sievestone.__main__ import main

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("start\n" + "fill line\n" * 200 + "the needle is here needle\nend\n")
    store, side = str(tmp_path / "st"), str(tmp_path / "side")
    assert main(["compress", store, str(tmp_path / "logs"), "--bs", "512", "--search"]) == 0
    said = lambda *args: (main(list(args)), capsys.readouterr().out)
    assert said("search", "needle", store) == (0, "the needle is here needle\n")
    assert said("search", "-c", "needle", store, str(tmp_path / "logs")) == (0, f"{store}: 2\n{tmp_path / 'logs'}: 2\n")
    assert said("search", "-q", "needle", store)[0] == 0 and said("search", "-q", "nothing", store)[0] == 1
    assert said("search", "-n", "fill line\nthe", store)[1].startswith("1:")
    assert main(["sidecar", "build", store, side, "--search-lens", "4,6"]) == 0
    assert said("search", "--sidecar", side, "--bail", "needle", store)[1] == "the needle is here needle\n"
    assert said("tail", store, "--tail", "10+nl")[1] == "end\n" and said("cat", store, "--verify") == (0, "")
    assert '"histogram"' in said("stats", store, "--json")[1]
