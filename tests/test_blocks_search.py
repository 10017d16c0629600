"""Exact search against bytes.find, with and without tables."""

import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions.patterns import BYTE_PREFIX, LONG_PREFIX, MASK_PREFIX, PLAIN, SearchConfig
from sievestone.operators import blocks, index, search
from sievestone.plans import pruning


def offsets(data: bytes, pattern: bytes):
    out, i = [], data.find(pattern)
    while i >= 0:
        out.append(i)
        i = data.find(pattern, i + 1)
    return out


def streams(spark, rows):
    return spark.createDataFrame(rows, "stream_id long, data binary")


def found(df):
    return sorted((r.stream_id, r.stream_offset) for r in df.collect())


def expected(rows, pattern):
    return sorted((i, o) for i, d in rows for o in offsets(d, pattern))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, bytes(rng.choice(b"abcd=") for _ in range(rng.randrange(0, 400)))) for i in range(40)]
    return rows + [(90, b""), (91, b"a"), (92, b"ab" * 200), (93, "é=ab".encode() * 50)]


@pytest.mark.parametrize("pattern", [b"a", b"abca", b"=ab", b"d=ab=", b"abababababababababababababababababababab", b"zz"])
@pytest.mark.parametrize("block", [7, 64])
def test_scan_is_exact(spark, corpus, pattern, block):
    cut = blocks.cut(streams(spark, corpus), block, len(pattern))
    rows = search.scan(cut, pattern).collect()
    assert sorted((r.stream_id, r.stream_offset) for r in rows) == expected(corpus, pattern)
    assert all(r.stream_offset == r.block_no * block + r.offset_in_block for r in rows)


CONFIGS = [
    SearchConfig(match_len=3, base_log2=9),
    SearchConfig(match_len=1),
    SearchConfig(match_len=2, base_log2=8).with_byte_prefix(b"="),
    SearchConfig(match_len=2).with_mask_prefix(SearchConfig().with_byte_prefix(*b"abcdefgh=").mask()),
    SearchConfig(match_len=3).with_long_prefix(b"=a", 2),
    SearchConfig(match_len=8).with_long_prefix(b"d="),
]


@pytest.mark.parametrize("config", CONFIGS, ids=str)
@pytest.mark.parametrize("pattern", [b"=abca", b"d=a", b"abcabd", b"cd=ab=c"])
def test_pruned_search_loses_nothing(spark, corpus, config, pattern):
    cut = blocks.cut(streams(spark, corpus), 16, max(config.overlap, len(pattern)))
    tables = index.build_tables(cut, config, 16)
    assert found(search.search(cut, pattern, tables, config, 16)) == expected(corpus, pattern)


def test_blocks_without_tables_are_read(spark, corpus):
    config, pattern = SearchConfig(match_len=3), b"abca"
    cut = blocks.cut(streams(spark, corpus), 16, config.overlap + len(pattern))
    some = index.build_tables(cut, config, 16).where("block_no % 3 <> 1")
    assert found(search.search(cut, pattern, some, config, 16)) == expected(corpus, pattern)
    with pytest.raises(pruning.SearchTablesUnusable):
        search.search(cut, pattern, some, config, 16, bail=True)
    with pytest.raises(pruning.SearchTablesUnusable):
        search.search(cut, b"ab", index.build_tables(cut, config, 16), config, 16, bail=True)


def test_several_configs_skip_if_any_proves_absence(spark, corpus):
    configs = [SearchConfig(match_len=2, config_id=0), SearchConfig(match_len=4, config_id=1), SearchConfig(match_len=8, config_id=2).with_byte_prefix(b"x")]
    cut = blocks.cut(streams(spark, corpus), 32, 16)
    tables = index.build_tables(cut, configs, 32)
    kept = [pruning.candidates(cut, tables, c, b"abcad", 32).count() for c in (configs[:1], configs[1:2], configs)]
    assert kept[2] <= min(kept[:2])
    assert found(search.search(cut, b"abcad", tables, configs, 32)) == expected(corpus, b"abcad")


def test_rare_pattern_skips_most_blocks(spark):
    data = b"".join(b"%06d lorem ipsum dolor " % i for i in range(2000))
    cut = blocks.cut(streams(spark, [(1, data)]), 1024, 32)
    config = SearchConfig(match_len=6)
    stats = search.search_stats(cut, index.build_tables(cut, config, 1024), config, b"001234 lorem", 1024).first()
    assert stats.blocks_skipped + stats.blocks_searched == stats.blocks_total
    assert stats.blocks_skipped > 0.9 * stats.blocks_total and stats.usable_configs == 1


def test_straddles_over_short_blocks(spark):
    """A match over three blocks is found once, where it starts."""
    pieces = [b"xxxNEE", b"D", b"LExxNEEDL", b"Exx", b"", b"NEEDLE"]
    rows = spark.createDataFrame([(7, i, p) for i, p in enumerate(pieces)], "stream_id long, block_no int, data binary")
    cut = blocks.with_next_head(blocks.from_pieces(rows), 8)
    assert found(search.scan(cut, b"NEEDLE")) == [(7, o) for o in offsets(b"".join(pieces), b"NEEDLE")]
    config = SearchConfig(match_len=4)
    tables = index.build_tables(cut, config, 512)
    assert found(search.search(cut, b"NEEDLE", tables, config, 512, shortest=1)) == [(7, o) for o in offsets(b"".join(pieces), b"NEEDLE")]


def test_two_tone_blocks_skip_one(spark):
    data = bytearray(b"a" * 4096 + b"b" * 4096)
    data[4196:4202] = b"NEEDLE"
    cut = blocks.cut(streams(spark, [(1, bytes(data))]), 4096, 16)
    config = SearchConfig()
    tables = index.build_tables(cut, config, 4096)
    assert found(search.search(cut, b"NEEDLE", tables, config, 4096)) == [(1, 4196)]
    assert search.search_stats(cut, tables, config, b"NEEDLE", 4096).first().blocks_skipped == 1


def test_streams_do_not_run_into_each_other(spark):
    one = blocks.cut(streams(spark, [(1, b"....hello wor")]), 8, 16)
    two = blocks.cut(streams(spark, [(2, b"ld.. hello world")]), 8, 16)
    assert found(search.scan(blocks.concatenated(one, two), b"hello world")) == [(2, 5)]


def test_context_and_blocks(spark):
    data = bytes(range(97, 123)) * 4
    cut = blocks.cut(streams(spark, [(1, data)]), 10, 8)
    got = search.with_context(search.scan(cut, b"xyz"), cut, 3, 2, 3).collect()
    assert {r.stream_offset: bytes(r.context) for r in got} == {o: data[max(0, o - 3) : o + 5] for o in offsets(data, b"xyz")}
    ends = {r.stream_offset: (r.previous_block, r.following_block) for r in search.with_blocks(search.scan(cut, b"abcd"), cut).collect()}
    assert ends[0][0] is None and bytes(ends[0][1]) == data[10:20]


def test_population_limit_and_folding(spark):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(4096))
    cut = blocks.cut(streams(spark, [(1, noise), (2, b"ab" * 2048)]), 4096, 8)
    rows = {r.stream_id: r for r in index.build_tables(cut, SearchConfig(match_len=4, base_log2=10, max_pop=50), 4096).collect()}
    assert 1 not in rows and rows[2].total_bits == 256 and rows[2].reductions == 2 and len(rows[2].bitmap) == 32
    assert rows[2].popcount == sum(bin(b).count("1") for b in rows[2].bitmap)


def test_inline_tables_can_be_taken_out(spark, corpus):
    cut = blocks.cut(streams(spark, corpus), 64, 8)
    tables = index.build_tables(cut, SearchConfig(match_len=3), 64)
    both = index.inline_tables(cut, tables)
    side, main = index.extract_tables(both)
    key = lambda df: sorted((r.stream_id, r.block_no, r.popcount, bytes(r.bitmap)) for r in df.collect())
    assert key(side) == key(tables) and "tables" not in main.columns and both.count() == cut.count()


def test_configs():
    c = SearchConfig()
    assert c.table_type == PLAIN and c.with_byte_prefix(1, 2).table_type == BYTE_PREFIX
    assert c.with_byte_prefix(*range(9)).table_type == MASK_PREFIX and c.with_long_prefix(b"ab").table_type == LONG_PREFIX
    assert c.with_long_prefix(b"a").table_type == BYTE_PREFIX and c.with_long_prefix(b"a", 1).table_type == LONG_PREFIX
    assert SearchConfig(match_len=3).windows(b"abcd") == [(0, b"abc"), (1, b"bcd")]
    assert SearchConfig(match_len=2).with_byte_prefix(b"=").windows(b"=a=bc") == [(1, b"a="), (3, b"bc")]
    assert SearchConfig(match_len=2, long_prefix=b"ab").prefix_only(b"xab") and not SearchConfig(match_len=9 - 1).usable(b"short")
    for bad in (dict(match_len=0), dict(match_len=9), dict(base_log2=7), dict(extras=1), dict(max_pop=0), dict(prefixes=b"a", long_prefix=b"bc")):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    with pytest.raises(ValueError):
        search.checked(b"")


def test_windows_of_a_pattern(spark):
    cut = blocks.cut(streams(spark, [(1, b"aaaaheoronbbbb"), (2, b"c" * 14)]), 14, 8)
    config = SearchConfig(match_len=4)
    stats = search.window_stats(index.build_tables(cut, config, 512), config, b"heoron", 512).collect()
    assert len(stats) == 3 and all(r.present + r.absent == 2 and r.present >= 1 for r in stats)
    assert search.pattern_windows(spark, config, b"heoron").count() == 3
    assert search.exists(cut, b"oronb").first().found and not search.exists(cut, b"oronc").first().found
    assert index.exact_windows(cut, 4).agg(F.sum("windows")).first()[0] == len({b"aaaaheoronbbbb"[i : i + 4] for i in range(11)}) + 1
