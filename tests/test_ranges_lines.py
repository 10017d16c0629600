import random

import pytest
from pyspark.sql import functions as F

from sievestone.functions import scalar
from sievestone.functions.patterns import SearchConfig
from sievestone.operators import analytics, blocks, index, lines, ranges

TEXTS = [(1, "one\ntwo words\n\nlast"), (2, ""), (3, "no newline at all"), (4, "é\nñandú e\n"), (5, "\n\n\n"), (6, None)]


@pytest.fixture(scope="module")
def cut(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    return blocks.cut(blocks.streams(df, "id", "text"), 5)


def data(df):
    return {r.stream_id: bytes(r.data) for r in df.collect()}


RAW = {i: (t or "").encode() for i, t in TEXTS}


def test_reassembly(cut):
    assert data(blocks.reassemble(cut)) == {i: d for i, d in RAW.items() if d}
    assert blocks.check_lengths(cut, blocks.totals(cut)).isEmpty()


@pytest.mark.parametrize("lo,n", [(0, 4), (3, 9), (7, None), (100, 5)])
def test_ranges(cut, lo, n):
    want = {i: d[lo:] if n is None else d[lo : lo + n] for i, d in RAW.items()}
    assert data(ranges.read_range(cut, lo, n)) == {i: d for i, d in want.items() if d}


@pytest.mark.parametrize("n", [1, 6, 1000])
def test_tail(cut, n):
    assert data(ranges.tail(cut, n)) == {i: d[-n:] for i, d in RAW.items() if d}


def test_newline_alignment(cut):
    after = lambda d: d[d.find(b"\n") + 1 :] if b"\n" in d else d
    assert data(ranges.read_from(cut, 2, offset_nl=True)) == {i: after(d[2:]) for i, d in RAW.items() if d[2:]}

    def upto(d, n):
        at = d.find(b"\n", n)
        return d if at < 0 else d[:at]

    assert data(ranges.read_from(cut, 0, 4, limit_nl=True)) == {i: upto(d, 4) for i, d in RAW.items() if d}
    assert data(ranges.tail(cut, 7, nl=True)) == {i: after(d[-7:]) for i, d in RAW.items() if d}


def test_options():
    assert ranges.option("1KB+nl") == (1024, True) and ranges.option("1.5M") == (3 << 19, False)
    for bad in ("x", "1KB+x", "-1"):
        with pytest.raises(ValueError):
            ranges.option(bad)
    for bad in (dict(offset=1, tail=1), dict(tail=1, follow=True), dict(offset=1, seekable=False)):
        with pytest.raises(ValueError):
            ranges.check_options(**bad)


def test_seek_index(spark, cut):
    index = ranges.seek_index(cut)
    rows = sorted((r.stream_id, r.entry_no, r.uncompressed_offset) for r in index.collect())
    assert rows == sorted((i, k, 5 * k) for i, d in RAW.items() for k in range(-(-len(d) // 5)))
    asked = spark.createDataFrame([(1, 0), (1, 7), (1, -1), (1, 99), (3, 5), (9, 1)], "stream_id long, offset long")
    got = {(r.stream_id, r.offset): r.uncompressed_offset for r in ranges.find(index, asked, blocks.totals(cut)).collect()}
    assert got == {(1, 0): 0, (1, 7): 5, (1, -1): 15, (1, 99): None, (3, 5): 5, (9, 1): None}
    thin = sorted((r.stream_id, r.uncompressed_offset) for r in ranges.thin_index(index, 7).collect() if r.stream_id == 1)
    assert thin == [(1, 0), (1, 10)]
    assert '"total_uncompressed":19' in ranges.index_json(index, blocks.totals(cut)).where("stream_id = 1").first().json


def test_lines(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    got = sorted((r.stream_id, r.line_no, r.line_start, r.line) for r in lines.lines(df, "id", "text").collect())
    want = []
    for i, d in RAW.items():
        at = 0
        for k, part in enumerate(d.split(b"\n")):
            if k < d.count(b"\n") or part:
                want.append((i, k + 1, at, part.decode()))
            at += len(part) + 1
    assert got == sorted(want)
    assert [(r.stream_id, r.line_no, r.match_ordinal) for r in lines.matching_lines(df, "id", "text", "e").orderBy("stream_id", "line_no").collect()] == [(1, 1, 1), (3, 1, 1), (4, 2, 1)]


def test_occurrences(spark):
    df = spark.createDataFrame([(1, "xaaaay"), (2, "a.a\\Eb.."), (3, None)], "id long, text string")
    n = lambda *a, **k: {r.stream_id: r.n for r in lines.occurrences(df, "id", "text", *a, **k).collect()}
    assert n("aa") == {1: 3} and n("aa", overlapping=False) == {1: 2} and n("\\Eb.") == {2: 1} and n(".") == {2: 3}


def test_scalar_functions(spark):
    row = lambda **k: spark.range(1).select(*[v.alias(n) for n, v in k.items()]).first()
    L = F.lit
    r = row(a=scalar.log2_bucket(L(0)), b=scalar.log2_bucket(L(1)), c=scalar.log2_bucket(L(1023)), d=scalar.log2_bucket(L(1 << 40)), e=scalar.log2_label(L(10)), f=scalar.log2_label(L(24)))
    assert tuple(r) == (0, 0, 9, 24, "1K-2K", "16M+")
    r = row(a=scalar.ratio_bucket(L(5), L(100)), b=scalar.ratio_bucket(L(100), L(100)), c=scalar.ratio_bucket(L(1), L(0)), d=scalar.ratio_bucket(L(99), L(100)))
    assert tuple(r) == (0, 10, 10, 9)
    r = row(a=scalar.size_parse(L("64KB")), b=scalar.size_parse(L("1.5m")), c=scalar.size_parse(L("-1")), d=scalar.size_parse(L("8MiB")), e=scalar.size_parse(L("100")))
    assert tuple(r) == (65536, 3 << 19, None, 8 << 20, 100)
    raw = F.unhex(L("0102FF80"))
    r = row(a=scalar.byte_at(raw, L(2)), b=scalar.little_endian(raw, 4), c=scalar.popcount(raw), d=scalar.byte_at(raw, L(9)), e=scalar.little_endian(raw))
    assert tuple(r) == (255, int.from_bytes(bytes.fromhex("0102FF80"), "little"), 11, None, int.from_bytes(bytes.fromhex("0102FF80"), "little"))
    r = row(a=scalar.chunk_type_name(L(0x46)), b=scalar.chunk_type_name(L(0x90)), c=scalar.human_size(L(1536)), d=scalar.human_size(L(3)), e=scalar.bar(L(5), L(10), 10), f=scalar.header_clamp(L(9)), g=scalar.reduced_slot(L(1023), 10, L(2)))
    assert tuple(r) == ("compressed search table", "skippable user chunk", "1.50 KiB", "3 B", "█████", 7, 255)
    assert [scalar.auto_table_log2(n) for n in (1, 512, 513, 8 << 20, 1 << 30)] == [8, 9, 10, 23, 23]


def test_analytics(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, rng.choice("abc"), rng.randrange(0, 3000), rng.choice([None, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, u int, op string, length int, offset int")
    mix = {r.op: (r["count"], r.bytes) for r in analytics.mix(df, "op", "length").collect()}
    assert mix == {k: (sum(r[2] == k for r in rows), sum(r[3] + 4 for r in rows if r[2] == k)) for k in "abc"}
    hist = {r.bucket: r["count"] for r in analytics.size_histogram(df, "length").collect()}
    want = {}
    for r in rows:
        want[max(r[3], 1).bit_length() - 1] = want.get(max(r[3], 1).bit_length() - 1, 0) + 1
    assert hist == want
    whole = sorted(map(tuple, analytics.op_totals(df).collect()))
    merged = analytics.merge_totals(*[analytics.op_totals(df.where(f"u = {k}")) for k in range(3)])
    assert sorted(map(tuple, merged.select(*analytics.op_totals(df).columns).collect())) == whole
    by_user = {u: [r[2] for r in rows if r[1] == u] for u in range(3)}
    line = {}
    longest = {}
    for u, ops in by_user.items():
        for a, b in zip([None, *ops], ops):
            line[(b, a)] = line.get((b, a), 0) + 1
        run = 0
        for k, x in enumerate(ops):
            run = run + 1 if k and ops[k - 1] == x else 1
            longest[(u, x)] = max(run, longest.get((u, x), 0))
    assert {(r.kind, r.previous): r["count"] for r in analytics.lineage(df, "u", ["t"], "op").collect()} == line
    assert {(r.u, r.op): r.longest for r in analytics.longest_runs(df, "u", ["t"], "op").collect()} == longest
    drawn = analytics.draw(analytics.size_histogram(df, "length")).collect()
    assert max(len(r.bar) for r in drawn) == 40 and [r.bucket for r in drawn] == sorted(hist)
    assert analytics.report(df, "u", "op", F.col("length")).count() == 3


def test_sql_functions(spark):
    from sievestone.functions.sql import register

    register(spark)
    spark.createDataFrame(TEXTS, "id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, pos FROM texts, LATERAL find_all(text, '\n') ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(i, k) for i, d in RAW.items() for k, b in enumerate(d) if b == 10]
    r = spark.sql("SELECT log2_bucket(1023), ratio_bucket(99, 100), ratio_bucket(1, 0), reduced_slot(1023, 10, 2)").first()
    assert tuple(r) == (9, 9, 10, 255)


@pytest.mark.parametrize("match_len", [1, 3, 4, 5, 8])
def test_slots_are_those_of_built_tables(spark, match_len):
    """numpy, Column and SQL slots agree, and a built bitmap has exactly the bits of its windows' slots."""
    from sievestone.functions.sql import register
    from sievestone.functions.scalar import window_slot

    register(spark)
    raw = bytes((k * 37 + k // 7) % 256 for k in range(90))
    config = SearchConfig(match_len=match_len, base_log2=12, max_pop=100, max_reduced_pop=0)
    table = index.build_tables(blocks.cut(spark.createDataFrame([(1, raw)], "stream_id long, data binary"), 512, config.overlap), config, 512).first()
    bits = {8 * k + b for k, byte in enumerate(bytes(table.bitmap)) for b in range(8) if byte >> b & 1}
    windows = sorted({raw[i : i + match_len] for i in range(len(raw) - match_len + 1)})
    rows = spark.createDataFrame([(w,) for w in windows], "w binary").select(window_slot("w", 12).alias("a"), F.expr("window_slot(w, 12)").alias("b"), "w").collect()
    assert all(r.a == r.b == index.slot_of(bytes(r.w), 12) for r in rows) and {r.a % table.total_bits for r in rows} == bits
