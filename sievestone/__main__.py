"""Commands: compress, cat, tail, search, sidecar, stats. `python -m sievestone COMMAND -h` lists the options.

Inputs are files or folders of files, or stores that `compress` wrote. A store's files are streams named by their path.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.patterns import SearchConfig
from .functions.scalar import human_size, parse_size
from .operators import analytics, blocks, ranges, search
from .session import session
from .sources import store as st


def configs_of(a) -> list[SearchConfig]:
    """One configuration for each match length."""
    out = []
    for k, n in enumerate(a.search_lens):
        c = SearchConfig(match_len=n, max_pop=a.search_max, max_reduced_pop=a.search_lim, config_id=k)
        if a.search_prefix:
            c = c.with_long_prefix(a.search_prefix.encode(), a.search_extras)
        elif a.search_prefixes:
            c = c.with_byte_prefix(a.search_prefixes.encode())
        out.append(c)
    return out


def _table_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--search-lens", type=lambda s: [int(x) for x in s.split(",")], default=[6], metavar="N[,N...]")
    p.add_argument("--search-prefixes", default="", help="bytes in front of indexed windows")
    p.add_argument("--search-prefix", default="", help="a longer prefix in front of indexed windows")
    p.add_argument("--search-extras", type=int, default=0)
    p.add_argument("--search-max", type=int, default=75)
    p.add_argument("--search-lim", type=int, default=None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sievestone", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", aliases=["c"], help="files to a store")
    c.add_argument("store")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--block-size", "--bs", type=parse_size, default=8 << 20)
    c.add_argument("--codec", choices=st.CODECS, default="zstd")
    c.add_argument("--search", action="store_true", help="with search tables")
    c.add_argument("--overwrite", action="store_true")
    _table_options(c)
    for name in ("cat", "tail"):
        p = sub.add_parser(name, help="bytes of a store")
        p.add_argument("store")
        p.add_argument("--offset", type=ranges.option)
        p.add_argument("--tail", type=ranges.option, help="1KB+nl for tail, unless an offset is given" if name == "tail" else None)
        p.add_argument("--limit", type=ranges.option)
        p.add_argument("--verify", action="store_true", help="check that blocks are complete, print nothing else")
    s = sub.add_parser("search", aliases=["s", "find"], help="occurrences of a pattern")
    s.add_argument("pattern")
    s.add_argument("inputs", nargs="+")
    s.add_argument("-l", "--lines", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("-c", "--count", action="store_true")
    s.add_argument("-n", "--number", action="store_true")
    s.add_argument("-q", "--quiet", action="store_true", help="exit status 0 if found, else 1")
    s.add_argument("--bail", action="store_true", help="fail rather than read all blocks")
    s.add_argument("-v", "--stats", action="store_true")
    s.add_argument("--window-stats", action="store_true")
    s.add_argument("--sidecar", help="a folder with tables to go by")
    s.add_argument("--no-sidecar", action="store_true", help="read all blocks")
    d = sub.add_parser("sidecar", help="search tables in a folder of their own").add_subparsers(dest="action", required=True)
    b = d.add_parser("build")
    b.add_argument("store")
    b.add_argument("sidecar")
    _table_options(b)
    x = d.add_parser("extract")
    x.add_argument("store")
    x.add_argument("sidecar")
    x.add_argument("--newstream", help="and a store without tables")
    t = sub.add_parser("stats", help="what a store is made of")
    t.add_argument("store")
    t.add_argument("--json", action="store_true")
    t.add_argument("--csv", metavar="FOLDER")
    t.add_argument("--per-block", action="store_true")
    t.add_argument("--no-hist", action="store_true")
    return top


def is_store(spark, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/format")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _rows(df: DataFrame, render) -> int:
    n = 0
    for r in df.toLocalIterator():
        n += 1
        print(render(r))
    return n


def run_search(spark, a) -> int:
    pattern, found = a.pattern.encode(), False
    for path in a.inputs:
        if is_store(spark, path):
            own = st.Store(spark, path, a.sidecar)
            own.configs = [] if a.no_sidecar else own.configs
            matches, cut = own.search(pattern, a.bail), own.blocks
            if a.stats:
                own.stats(pattern).show(vertical=True)
            if a.window_stats:
                for c in own.configs:
                    search.window_stats(own.tables, c, pattern, own.block_size).orderBy("win").show(truncate=False)
        else:
            cut = blocks.cut(st.files(spark, path, recursive=True).select("stream_id", "data"), blocks.DEFAULT_BLOCK, len(pattern))
            matches = search.scan(cut, pattern)
        if a.quiet:
            if not matches.isEmpty():
                return 0
            continue
        if a.count:
            n = matches.count()
            print(f"{path}: {n}")
            found |= n > 0
            continue
        near = search.with_context(matches, cut, 1 << 16 if a.lines else 32, 1 << 16 if a.lines else 32, len(pattern)).orderBy("stream_id", "stream_offset")
        done: dict[int, int] = {}
        ordinal = 0
        for r in near.toLocalIterator():
            raw, at = bytes(r.context), min(r.stream_offset, 1 << 16 if a.lines else 32)
            lo = raw.rfind(b"\n", 0, at) + 1 if a.lines else 0
            hi = raw.find(b"\n", at + len(pattern)) if a.lines else -1
            hi = len(raw) if hi < 0 else hi
            if a.lines and r.stream_offset < done.get(r.stream_id, 0):
                continue
            done[r.stream_id] = r.stream_offset - at + hi
            ordinal += 1
            found = True
            print((f"{ordinal}:" if a.number else "" if a.lines else f"{r.stream_offset}: ") + raw[lo:hi].decode("utf-8", "replace"))
    return 0 if found or not a.quiet else 1


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session("sievestone")
    spark.sparkContext.setLogLevel("ERROR")
    if a.command in ("compress", "c"):
        data = st.files(spark, *a.inputs, recursive=True).select("stream_id", "data")
        st.write_store(data, a.store, a.block_size, configs_of(a) if a.search else (), a.codec, mode="overwrite" if a.overwrite else "errorifexists")
    elif a.command in ("cat", "tail"):
        own = st.Store(spark, a.store)
        ranges.check_options(a.offset, a.tail)
        tail = a.tail or (ranges.option("1KB+nl") if a.command == "tail" and not a.offset else None)
        if a.verify:
            return 1 if _rows(own.verify(), lambda r: f"{r.stream_id}: incomplete") else 0
        limit, limit_nl = a.limit or (None, False)
        out = own.tail(*tail, limit=limit) if tail else own.read(a.offset[0] if a.offset else 0, limit, offset_nl=bool(a.offset and a.offset[1]), limit_nl=limit_nl)
        for r in out.orderBy("stream_id").toLocalIterator():
            sys.stdout.buffer.write(bytes(r.data))
    elif a.command in ("search", "s", "find"):
        return run_search(spark, a)
    elif a.command == "sidecar" and a.action == "build":
        st.add_tables(spark, a.store, configs_of(a), a.sidecar)
    elif a.command == "sidecar":
        own = st.Store(spark, a.store)
        st.config_rows(spark, own.configs).write.parquet(f"{a.sidecar}/configs")
        own.tables.write.option("compression", "zstd").parquet(f"{a.sidecar}/tables")
        if a.newstream:
            st.rewrite(spark, a.store, a.newstream, configs=())
    elif a.command == "stats":
        own = st.Store(spark, a.store)
        if a.per_block:
            _rows(own.blocks.select("stream_id", "block_no", "block_start", "block_len", "is_last").orderBy("stream_id", "block_no"), lambda r: "\t".join(map(str, r)))
        if a.csv:
            analytics.write_csv(blocks.totals(own.blocks), a.csv)
        elif a.json:
            _rows(analytics.report(own.blocks.withColumn("kind", F.when(F.col("is_last"), "last").otherwise("full")), "stream_id", "kind", F.col("block_len")), lambda r: r.json)
        else:
            _rows(blocks.totals(own.blocks).withColumn("size", human_size("total_len")).orderBy("stream_id"), lambda r: "\t".join(map(str, r)))
            if not a.no_hist:
                analytics.draw(analytics.size_histogram(own.blocks, "block_len")).show(25, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
