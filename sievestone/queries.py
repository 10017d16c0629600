"""The registered queries: each operator over whole tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .functions.patterns import SearchConfig
from .operators import analytics, blocks, index, lines, ranges, search
from .plans import pruning
from .sources import store

BLOCK = 512
RARE, COMMON = "erorer", " the "
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_streams(spark, sf_dir) -> DataFrame:
    return blocks.streams(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_streams(spark, sf_dir) -> DataFrame:
    return blocks.streams(table(spark, sf_dir, "pages"), "page_id", "html")


def event_streams(spark, sf_dir) -> DataFrame:
    return blocks.streams(table(spark, sf_dir, "events"), "event_id", "props")


def _hex(df: DataFrame) -> DataFrame:
    """Bytes as lower-case hex digests: one column that any engine can compare."""
    return df.select("stream_id", F.length("data").cast("long").alias("n"), F.md5(F.hex("data").cast("binary")).alias("digest"))


def _hits_sql(source: str, pattern: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> str:
    p = pattern.replace("'", "''")
    return f"""
    WITH d AS (SELECT {key} AS id, hex({text}) AS h, strlen({text}) AS n FROM {source} WHERE contains({text}, '{p}')),
    o AS (SELECT id, n, unnest(list_filter(range(0, n - strlen('{p}') + 1), lambda i: substr(h, 2 * i + 1, 2 * strlen('{p}')) = hex('{p}'))) AS pos FROM d)
    SELECT id AS stream_id, pos AS stream_offset, pos // {block} AS block_no, pos % {block} AS offset_in_block,
           pos % {block} + strlen('{p}') > least({block}, n - pos // {block} * {block}) AS straddles FROM o"""


def _search(streams: DataFrame, pattern: str, *configs: SearchConfig) -> DataFrame:
    """A pruned search: blocks, tables, candidates, scan."""
    reach = max([len(pattern.encode()), *(c.overlap for c in configs)])
    cut = blocks.cut(streams, BLOCK, reach)
    return search.search(cut, pattern, index.build_tables(cut, configs, BLOCK), configs, BLOCK) if configs else search.scan(cut, pattern)


@query(f"""
    WITH d AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
    b AS (SELECT doc_id, h, n, unnest(range(0, (n - 1) // {BLOCK} + 1)) AS k FROM d)
    SELECT doc_id AS stream_id, k AS block_no, k * {BLOCK} AS block_start, least({BLOCK}, n - k * {BLOCK}) AS block_len,
           k = (n - 1) // {BLOCK} AS is_last, md5(substr(h, 2 * {BLOCK} * k + 1, 2 * {BLOCK})) AS digest FROM b""")
def block_cut(spark, sf_dir):
    return blocks.cut(doc_streams(spark, sf_dir), BLOCK).select("stream_id", "block_no", "block_start", "block_len", "is_last", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query("SELECT doc_id AS stream_id, strlen(text) AS n, md5(hex(text)) AS digest FROM documents WHERE strlen(text) > 0")
def block_reassemble(spark, sf_dir):
    return _hex(blocks.reassemble(blocks.cut(doc_streams(spark, sf_dir), BLOCK)))


@query(f"SELECT doc_id AS stream_id, (strlen(text) - 1) // {BLOCK} + 1 AS blocks, strlen(text) AS total_len, least({BLOCK}, strlen(text)) AS longest FROM documents WHERE strlen(text) > 0")
def block_totals(spark, sf_dir):
    return blocks.totals(blocks.cut(doc_streams(spark, sf_dir), BLOCK))


@query("SELECT 'documents' AS source, sum(strlen(text)) AS total FROM documents UNION ALL SELECT 'pages', sum(strlen(html)) FROM pages")
def concatenated_streams(spark, sf_dir):
    docs = blocks.cut(doc_streams(spark, sf_dir), BLOCK).withColumn("source", F.lit("documents"))
    pages = blocks.cut(page_streams(spark, sf_dir), BLOCK).withColumn("source", F.lit("pages")).withColumn("stream_id", -F.col("stream_id") - 1)
    return blocks.concatenated(docs, pages).groupBy("source").agg(F.sum("block_len").alias("total"))


@query(f"""
    WITH b AS (SELECT doc_id, text, strlen(text) AS n, hex(text) AS h, unnest(range(0, (strlen(text) - 1) // {BLOCK} + 1)) AS k FROM documents WHERE strlen(text) > 0)
    SELECT doc_id AS stream_id, k AS block_no, md5(substr(h, 2 * {BLOCK} * (k + 1) + 1, 2 * 600)) AS digest FROM b""")
def following_heads(spark, sf_dir):
    cut = blocks.with_next_head(blocks.cut(doc_streams(spark, sf_dir), BLOCK), 600, BLOCK)
    return cut.select("stream_id", "block_no", F.md5(F.hex("next_head").cast("binary")).alias("digest"))


@query(_hits_sql("documents", RARE))
def search_unindexed(spark, sf_dir):
    return _search(doc_streams(spark, sf_dir), RARE)


@query(_hits_sql("documents", COMMON))
def search_common(spark, sf_dir):
    return _search(doc_streams(spark, sf_dir), COMMON)


@query(_hits_sql("documents", RARE))
def search_pruned(spark, sf_dir):
    return _search(doc_streams(spark, sf_dir), RARE, SearchConfig(match_len=4))


@query(_hits_sql("events", '"k": 69', "event_id", "props"))
def search_byte_prefix(spark, sf_dir):
    return _search(event_streams(spark, sf_dir), '"k": 69', SearchConfig(match_len=2).with_byte_prefix(b' '))


@query(_hits_sql("documents", " attion to"))
def search_mask_prefix(spark, sf_dir):
    mask = SearchConfig().with_byte_prefix(b" \n.,;:-_\"'").mask()
    return _search(doc_streams(spark, sf_dir), " attion to", SearchConfig(match_len=5).with_mask_prefix(mask))


@query(_hits_sql("pages", 'href="/', "page_id", "html"))
def search_long_prefix(spark, sf_dir):
    return _search(page_streams(spark, sf_dir), 'href="/', SearchConfig(match_len=4).with_long_prefix(b'href="', 2))


@query(_hits_sql("pages", "<title>", "page_id", "html"))
def search_prefix_only(spark, sf_dir):
    return _search(page_streams(spark, sf_dir), "<title>", SearchConfig(match_len=4).with_long_prefix(b"<title>"))


@query(_hits_sql("documents", RARE))
def search_multi_config(spark, sf_dir):
    return _search(doc_streams(spark, sf_dir), RARE, SearchConfig(match_len=6, config_id=0), SearchConfig(match_len=3, config_id=1), SearchConfig(match_len=4, config_id=2).with_byte_prefix(b"e"))


@query(_hits_sql("conversations", "e", "conv_id * 1000 + turn", "text"))
def search_conversations(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return _search(blocks.streams(talk, "id", "text"), "e")


@query("SELECT doc_id AS stream_id, len(string_split(text, 'tion')) - 1 AS n FROM documents WHERE contains(text, 'tion')")
def occurrence_count(spark, sf_dir):
    return lines.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", "tion", overlapping=False)


@query("SELECT doc_id AS stream_id, len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'ee')) AS n FROM documents WHERE contains(text, 'ee')")
def overlapping_count(spark, sf_dir):
    return lines.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", "ee")


@query(f"SELECT doc_id AS stream_id, contains(text, '{RARE}') AS found FROM documents")
def streams_with_pattern(spark, sf_dir):
    return search.streams_with(doc_streams(spark, sf_dir), RARE)


@query(f"SELECT bool_or(contains(text, '{RARE}')) AS found FROM documents")
def pattern_exists(spark, sf_dir):
    return search.exists(blocks.cut(doc_streams(spark, sf_dir), BLOCK, len(RARE)), RARE)


_LINES_SQL = """
    WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    u AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM p),
    l AS (SELECT doc_id AS stream_id, line_no, n, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start FROM u)
"""


@query(_LINES_SQL + "SELECT stream_id, line_no, line_start, line_start + strlen(line) AS line_end, md5(line) AS digest FROM l WHERE line_no < n OR line <> ''")
def all_lines(spark, sf_dir):
    return lines.lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("stream_id", "line_no", "line_start", "line_end", F.md5(F.col("line").cast("binary")).alias("digest"))


@query(_LINES_SQL + f"SELECT stream_id, line_no, line_start, line_start + strlen(line) AS line_end, line, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS match_ordinal FROM l WHERE contains(line, '{RARE}')")
def matching_lines(spark, sf_dir):
    return lines.matching_lines(table(spark, sf_dir, "documents"), "doc_id", "text", RARE)


@query("""
    WITH u AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, lang, count(*) AS matching FROM u WHERE contains(line, 'tion') GROUP BY ALL""")
def matching_line_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hit = lines.matching_lines(docs, "doc_id", "text", "tion")
    return hit.join(docs.select(F.col("doc_id").alias("stream_id"), "source", "lang"), "stream_id").groupBy("source", "lang").agg(F.count("*").alias("matching"))


@query(_LINES_SQL + f"""
    , h AS (SELECT stream_id AS sid, stream_offset FROM ({_hits_sql("documents", RARE)}))
    SELECT stream_id, line_no, line_start, line_start + strlen(line) AS line_end, line, min(stream_offset) AS first_offset, count(*) AS matches
    FROM l JOIN h ON sid = stream_id AND stream_offset BETWEEN line_start AND line_start + strlen(line) GROUP BY ALL""")
def lines_of_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lines.lines_of_matches(_search(doc_streams(spark, sf_dir), RARE), lines.lines(docs.where(F.contains("text", F.lit(RARE))), "doc_id", "text"))


@query(f"""
    WITH h AS ({_hits_sql("pages", 'href="', "page_id", "html")})
    SELECT stream_id, stream_offset, substr(hex(html), 2 * greatest(0, stream_offset - 20) + 1, 2 * (stream_offset + 26 - greatest(0, stream_offset - 20))) AS context
    FROM h JOIN pages ON page_id = stream_id""")
def match_context(spark, sf_dir):
    cut = blocks.cut(page_streams(spark, sf_dir), BLOCK, 6)
    found = search.with_context(search.scan(cut, 'href="'), cut, 20, 20, 6)
    return found.select("stream_id", "stream_offset", F.hex("context").alias("context"))


@query(f"""
    WITH h AS ({_hits_sql("documents", RARE)}), d AS (SELECT doc_id, hex(text) AS x, strlen(text) AS n FROM documents)
    SELECT stream_id, stream_offset, least({BLOCK}, n - block_no * {BLOCK}) AS own, if(block_no = 0, NULL, {BLOCK}) AS before,
           if((block_no + 1) * {BLOCK} >= n, NULL, least({BLOCK}, n - (block_no + 1) * {BLOCK})) AS after FROM h JOIN d ON doc_id = stream_id""")
def match_blocks(spark, sf_dir):
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK, len(RARE))
    met = search.with_blocks(search.scan(cut, RARE), cut)
    return met.select("stream_id", "stream_offset", F.length("block").alias("own"), F.length("previous_block").alias("before"), F.length("following_block").alias("after"))


@query(f"SELECT i AS win, i AS pos, hex(substr('{RARE}', i + 1, 4)) AS \"window\" FROM range(0, 3) t(i)")
def pattern_windows(spark, sf_dir):
    return search.pattern_windows(spark, SearchConfig(match_len=4), RARE).select("win", "pos", F.hex("window").alias("window"))


@query(f"""
    WITH d AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
    b AS (SELECT doc_id, h, n, unnest(range(0, (n - 1) // {BLOCK} + 1)) AS k FROM d),
    w AS (SELECT doc_id, k, list_transform(range(k * {BLOCK}, least((k + 1) * {BLOCK}, n - 3)), lambda i: substr(h, 2 * i + 1, 8)) AS ws FROM b)
    SELECT doc_id AS stream_id, k AS block_no, coalesce(len(list_distinct(ws)), 0) AS windows FROM w""")
def exact_window_counts(spark, sf_dir):
    return index.exact_windows(blocks.cut(doc_streams(spark, sf_dir), BLOCK, 3), 4)


_CANDIDATES_SQL = f"""
    WITH h AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
    b AS (SELECT doc_id, h, n, unnest(range(0, (n - 1) // {BLOCK} + 1)) AS k FROM h),
    t AS (SELECT doc_id, k, h, n, substr(h, 2 * {BLOCK} * k + 1, 2 * ({BLOCK} + {len(RARE) - 1})) AS near FROM b)
    SELECT doc_id AS stream_id, k AS block_no, len(list_filter(range(0, strlen(near) // 2), lambda i: substr(near, 2 * i + 1, {2 * len(RARE)}) = hex('{RARE}'))) > 0 AS holds FROM t"""


@query(f"SELECT count(*) AS blocks, count_if(holds) AS holding, 0::BIGINT AS lost, true AS some_skipped FROM ({_CANDIDATES_SQL})")
def pruning_is_sound(spark, sf_dir):
    """Blocks that hold a match and were ruled out: none. And that some are ruled out at all."""
    config = SearchConfig(match_len=4)
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK, config.overlap + len(RARE))
    kept = pruning.candidates(cut, index.build_tables(cut, config, BLOCK), config, RARE, BLOCK).select("stream_id", "block_no", F.lit(True).alias("kept"))
    holding = search.scan(cut, RARE).select("stream_id", "block_no").distinct().withColumn("holds", F.lit(True))
    both = cut.select("stream_id", "block_no").join(kept, ["stream_id", "block_no"], "left").join(holding, ["stream_id", "block_no"], "left")
    return both.agg(F.count("*").alias("blocks"), F.count("holds").alias("holding"), F.count_if(F.col("holds") & F.col("kept").isNull()).alias("lost"), (F.count_if(F.col("kept").isNull()) > 0).alias("some_skipped"))


def _slot_sql(hexed: str, n: int) -> str:
    """The slot of a window of n (at most 4) bytes, given in hex, before it is taken modulo the table's bits."""
    value = " + ".join(f"('0x' || substr({hexed}, {2 * k + 1}, 2))::BIGINT * {1 << 8 * k}" for k in range(n))
    return f"(({value}) * {scalar.SLOT_LOW} + {n}) % {scalar.SLOT_PRIME} % 512"


def _tables_sql(overlap: int) -> str:
    """t: the search tables of both configurations of search_tables(), their bits as a list. overlap: the bytes kept behind a block."""
    plain = f"list_transform(range(k * {BLOCK}, least((k + 1) * {BLOCK}, n - 3)), lambda i: {_slot_sql('substr(h, 2 * i + 1, 8)', 4)})"
    behind = f"list_transform(list_filter(range(k * {BLOCK}, least((k + 1) * {BLOCK}, n - 3)), lambda i: substr(h, 2 * i + 1, 2) = '20'), lambda i: {_slot_sql('substr(h, 2 * i + 3, 6)', 3)})"
    return f"""
    WITH d AS (SELECT doc_id, hex(text) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
    b AS (SELECT doc_id, h, n, unnest(range(0, (n - 1) // {BLOCK} + 1)) AS k FROM d),
    s AS (SELECT doc_id, k, n, 0 AS c, list_distinct({plain}) AS slots, 25 AS lim, 4 AS need FROM b
          UNION ALL SELECT doc_id, k, n, 1, list_distinct({behind}), 10, 3 FROM b),
    f AS (SELECT *, list_distinct(list_transform(slots, lambda x: x % 256)) AS half FROM s WHERE len(slots) * 100 // 512 <= 70),
    t AS (SELECT doc_id AS stream_id, k AS block_no, c AS config_id, len(half) * 100 <= 256 * lim AS folded, CASE WHEN len(half) * 100 <= 256 * lim THEN half ELSE slots END AS bits,
          n <= (k + 1) * {BLOCK} OR least(n - (k + 1) * {BLOCK}, {overlap}) >= need AS has_overlap FROM f)"""


_BITMAP_SQL = "array_to_string(list_transform(range(0, CASE WHEN folded THEN 32 ELSE 64 END), lambda j: printf('%02X', coalesce(list_sum(list_transform(list_filter(bits, lambda x: x // 8 = j), lambda x: 1 << (x % 8)::INTEGER))::INTEGER, 0))), '')"


def _present_sql(k: int) -> str:
    """Whether a table has the k-th window of RARE."""
    slot = _slot_sql(f"hex('{RARE[k : k + 4]}')", 4)
    return f"list_contains(bits, {slot} % CASE WHEN folded THEN 256 ELSE 512 END)"


_HITS = ", ".join(f"{_present_sql(k)} AS p{k}" for k in range(3))


@query(_tables_sql(4 + len(RARE)) + f"""
    , o AS (SELECT *, {_HITS} FROM t WHERE config_id = 0),
    m AS (SELECT doc_id, k, least({BLOCK}, n - k * {BLOCK}) AS size, x.p0 AS a0, x.p1 AS a1, x.p2 AS a2, x.has_overlap AS xo, y.p0 AS b0, y.p1 AS b1, y.p2 AS b2, y.has_overlap AS yo, (k + 1) * {BLOCK} >= n AS last
          FROM b LEFT JOIN o x ON x.stream_id = doc_id AND x.block_no = k LEFT JOIN o y ON y.stream_id = doc_id AND y.block_no = k + 1),
    r AS (SELECT size, coalesce(xo AND NOT a0, false) OR coalesce(xo AND (last OR yo) AND ((NOT a0 AND (last OR NOT b0)) OR (NOT a1 AND (last OR NOT b1)) OR (NOT a2 AND (last OR NOT b2))), false) AS out FROM m),
    q AS (SELECT len(bits) * 100.0::DOUBLE / CASE WHEN folded THEN 256 ELSE 512 END AS p, folded, has_overlap FROM t WHERE config_id = 0)
    SELECT (SELECT count(*) FROM r) AS blocks_total, (SELECT count_if(out) FROM r) AS blocks_skipped, (SELECT count_if(NOT out) FROM r) AS blocks_searched, (SELECT sum(size)::BIGINT FROM r) AS bytes_total,
           (SELECT coalesce(sum(size) FILTER (out), 0)::BIGINT FROM r) AS bytes_skipped, count(*) AS tables, sum(CASE WHEN folded THEN 32 ELSE 64 END)::BIGINT AS table_bytes, min(p) AS population_min, max(p) AS population_max,
           round(avg(p), 6) AS population_avg, round(avg(folded::INTEGER), 6) AS reductions_avg, count_if(NOT has_overlap) AS without_overlap, 1 AS usable_configs FROM q""")
def search_statistics(spark, sf_dir):
    config = SearchConfig(match_len=4)
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK, config.overlap + len(RARE))
    stats = search.search_stats(cut, index.build_tables(cut, config, BLOCK), config, RARE, BLOCK)
    return stats.withColumns({c: F.round(c, 6) for c in ("population_avg", "reductions_avg")})


@query(_tables_sql(4) + " " + " UNION ALL ".join(f"SELECT {k} AS win, {k} AS pos, hex('{RARE[k : k + 4]}') AS \"window\", count_if({_present_sql(k)}) AS present, count_if(NOT {_present_sql(k)}) AS absent FROM t WHERE config_id = 0" for k in range(3)))
def window_statistics(spark, sf_dir):
    config = SearchConfig(match_len=4)
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK, config.overlap)
    return search.window_stats(index.build_tables(cut, config, BLOCK), config, RARE, BLOCK).withColumn("window", F.hex("window"))


@query(_tables_sql(4) + f"SELECT stream_id, block_no, config_id, folded::INTEGER AS reductions, len(bits)::INTEGER AS popcount, CASE WHEN folded THEN 256 ELSE 512 END AS total_bits, has_overlap, {_BITMAP_SQL} AS bitmap FROM t")
def search_tables(spark, sf_dir):
    configs = [SearchConfig(match_len=4), SearchConfig(match_len=3, config_id=1).with_byte_prefix(b" ")]
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK, max(c.overlap for c in configs))
    return index.build_tables(cut, configs, BLOCK).withColumn("bitmap", F.hex("bitmap"))


@query("SELECT d.doc_id AS stream_id, b.item_id FROM documents d, benchmark b WHERE strlen(b.text) > 0 AND contains(d.text, b.text)")
def pattern_set(spark, sf_dir):
    return search.pattern_set(doc_streams(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("SELECT doc_id AS stream_id, strlen(text) - 100 AS n0, least(700, strlen(text) - 100) AS n, md5(substr(hex(text), 201, 1400)) AS digest FROM documents WHERE strlen(text) > 100")
def range_read(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), (F.octet_length("text") - 100).cast("long").alias("n0"))
    return _hex(ranges.read_range(blocks.cut(doc_streams(spark, sf_dir), BLOCK), 100, 700)).join(docs, "stream_id")


@query("SELECT page_id AS stream_id, least(1024, strlen(html)) AS n, md5(substr(hex(html), greatest(0, 2 * (strlen(html) - 1024)) + 1, 2048)) AS digest FROM pages WHERE strlen(html) > 0")
def tail_read(spark, sf_dir):
    return _hex(ranges.tail(blocks.cut(page_streams(spark, sf_dir), BLOCK), 1024))


_NL = "list_position(list_transform(range(0, strlen({x}) // 2), lambda i: substr({x}, 2 * i + 1, 2)), '0A')"


@query(f"""
    WITH r AS (SELECT doc_id, substr(hex(text), 201) AS x FROM documents WHERE strlen(text) > 100),
    p AS (SELECT doc_id, x, {_NL.format(x="x")} AS pos FROM r),
    f AS (SELECT doc_id, CASE WHEN pos > 0 THEN substr(x, 2 * pos + 1) ELSE x END AS y FROM p)
    SELECT doc_id AS stream_id, strlen(y) // 2 AS n, md5(y) AS digest FROM f""")
def offset_newline(spark, sf_dir):
    return _hex(ranges.read_from(blocks.cut(doc_streams(spark, sf_dir), BLOCK), 100, offset_nl=True))


@query(f"""
    WITH r AS (SELECT doc_id, substr(hex(text), 1, 600) AS a, substr(hex(text), 601) AS x FROM documents WHERE strlen(text) > 0),
    p AS (SELECT doc_id, a, x, {_NL.format(x="x")} AS pos FROM r),
    f AS (SELECT doc_id, CASE WHEN pos > 0 THEN a || substr(x, 1, 2 * (pos - 1)) ELSE a || x END AS y FROM p)
    SELECT doc_id AS stream_id, strlen(y) // 2 AS n, md5(y) AS digest FROM f""")
def limit_newline(spark, sf_dir):
    return _hex(ranges.read_from(blocks.cut(doc_streams(spark, sf_dir), BLOCK), 0, 300, limit_nl=True))


@query("SELECT doc_id AS stream_id, ('0x' || substr(hex(text), 2 * 99 + 1, 2))::INTEGER AS value FROM documents WHERE strlen(text) > 99")
def byte_read(spark, sf_dir):
    return ranges.read_byte(blocks.cut(doc_streams(spark, sf_dir), BLOCK), 99)


@query(f"""
    WITH b AS (SELECT doc_id, strlen(text) AS n, unnest(range(0, (strlen(text) - 1) // {BLOCK} + 1)) AS k FROM documents WHERE strlen(text) > 0)
    SELECT doc_id AS stream_id, k AS entry_no, k * {BLOCK} AS compressed_offset, k * {BLOCK} AS uncompressed_offset FROM b""")
def seek_index(spark, sf_dir):
    return ranges.seek_index(blocks.cut(doc_streams(spark, sf_dir), BLOCK))


@query(f"""
    WITH e AS (SELECT doc_id, strlen(text) AS n, unnest(range(0, strlen(text), {BLOCK})) AS o FROM documents WHERE strlen(text) > 0),
    q AS (SELECT doc_id, strlen(text) AS n, unnest([0, 511, 512, 1300, -1, -600, 1000000]) AS "offset" FROM documents),
    a AS (SELECT doc_id, n, "offset", CASE WHEN "offset" < 0 THEN "offset" + n ELSE "offset" END AS t FROM q)
    SELECT a.doc_id AS stream_id, "offset", CASE WHEN t BETWEEN 0 AND a.n THEN o END AS compressed_offset, CASE WHEN t BETWEEN 0 AND a.n THEN o END AS uncompressed_offset
    FROM a ASOF LEFT JOIN e ON a.doc_id = e.doc_id AND a.t >= e.o""")
def seek_floor(spark, sf_dir):
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK)
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 511, 512, 1300, -1, -600, 1000000)])).alias("offset"))
    total = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), F.octet_length("text").cast("long").alias("total_len"))
    return ranges.find(ranges.seek_index(cut), asked, total)


@query(f"""
    WITH e AS (SELECT doc_id, unnest(range(0, strlen(text), {BLOCK})) AS o FROM documents WHERE strlen(text) > 0),
    k AS (SELECT doc_id, o FROM e WHERE o % {3 * BLOCK} = 0)
    SELECT doc_id AS stream_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS entry_no, o AS compressed_offset, o AS uncompressed_offset FROM k""")
def thinned_index(spark, sf_dir):
    return ranges.thin_index(ranges.seek_index(blocks.cut(doc_streams(spark, sf_dir), BLOCK)), 2 * BLOCK + 1)


@query(f"""
    SELECT page_id AS stream_id, to_json({{'total_uncompressed': strlen(html), 'est_block_uncompressed': strlen(html) // ((strlen(html) - 1) // {BLOCK} + 1),
           'offsets': list_transform(range(0, strlen(html), {BLOCK}), lambda o: {{'compressed': o, 'uncompressed': o}})}})::VARCHAR AS json FROM pages WHERE strlen(html) > 0""")
def index_json(spark, sf_dir):
    cut = blocks.cut(page_streams(spark, sf_dir), BLOCK)
    return ranges.index_json(ranges.seek_index(cut), blocks.totals(cut))


@query("""
    WITH s AS (SELECT 'documents' AS source, strlen(text) AS n FROM documents UNION ALL SELECT 'pages', strlen(html) FROM pages)
    SELECT source, least(24, length(bin(greatest(n, 1))) - 1) AS bucket, count(*) AS count FROM s GROUP BY ALL""")
def size_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.octet_length("text").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.octet_length("html").alias("n"))
    return analytics.size_histogram(docs.unionByName(pages), "n", ["source"])


@query(f"""
    WITH w AS ({ORACLES["exact_window_counts"]}), d AS (SELECT doc_id, strlen(text) AS n FROM documents),
    s AS (SELECT windows AS c, least({BLOCK}, n - block_no * {BLOCK}) AS u FROM w JOIN d ON doc_id = stream_id)
    SELECT CASE WHEN u <= 0 OR c * 100 // u >= 100 THEN 10 ELSE c * 100 // u // 10 END AS bucket, count(*) AS count FROM s GROUP BY ALL""")
def ratio_histogram(spark, sf_dir):
    cut = blocks.cut(doc_streams(spark, sf_dir), BLOCK, 3)
    met = index.exact_windows(cut, 4).join(cut.select("stream_id", "block_no", "block_len"), ["stream_id", "block_no"])
    return analytics.ratio_histogram(met, "windows", "block_len")


@query("SELECT source, lang, count(*) AS count, sum(strlen(text) + 4) AS bytes FROM documents GROUP BY ALL")
def source_mix(spark, sf_dir):
    return analytics.mix(table(spark, sf_dir, "documents"), ["source", "lang"], F.octet_length("text"))


@query("SELECT event_type, count(*) AS count, sum(strlen(props) + 4) AS bytes FROM events GROUP BY ALL")
def event_mix(spark, sf_dir):
    return analytics.mix(table(spark, sf_dir, "events"), "event_type", F.octet_length("props"))


@query("SELECT event_type AS op, count(*) AS count, sum(strlen(props)) AS bytes, min(strlen(props)) AS min_length, max(strlen(props)) AS max_length, min(user_id) AS min_offset, max(user_id) AS max_offset, sum(user_id)::BIGINT AS sum_offset FROM events GROUP BY ALL")
def op_totals(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.octet_length("props").alias("length"), F.col("user_id").alias("offset"))
    return analytics.op_totals(ops)


@query("""
    WITH l AS (SELECT event_type AS kind, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    SELECT kind, previous, count(*) AS count FROM l GROUP BY ALL""")
def event_lineage(spark, sf_dir):
    return analytics.lineage(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
    WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s),
    n AS (SELECT user_id, event_type, run, count(*) AS n FROM r GROUP BY ALL)
    SELECT user_id, event_type, max(n) AS longest FROM n GROUP BY ALL""")
def longest_runs(spark, sf_dir):
    return analytics.longest_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
    WITH b AS (SELECT source, lang, strlen(text) AS s, least(24, length(bin(greatest(strlen(text), 1))) - 1)::INTEGER AS bucket FROM documents),
    t AS (SELECT source, count(*) AS count, sum(s)::BIGINT AS bytes, min(s) AS min, max(s) AS max FROM b GROUP BY ALL),
    k AS (SELECT source, list({'kind': lang, 'count': n, 'bytes': y} ORDER BY lang) AS mix FROM (SELECT source, lang, count(*) AS n, sum(s)::BIGINT AS y FROM b GROUP BY ALL) GROUP BY ALL),
    h AS (SELECT source, list({'bucket': bucket, 'count': n} ORDER BY bucket) AS histogram FROM (SELECT source, bucket, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL)
    SELECT source, to_json({'count': count, 'bytes': bytes, 'min': min, 'max': max, 'mix': mix, 'histogram': histogram})::VARCHAR AS json FROM t JOIN k USING (source) JOIN h USING (source)""")
def source_report(spark, sf_dir):
    return analytics.report(table(spark, sf_dir, "documents"), "source", "lang", F.octet_length("text"))


@query("""
    WITH v AS (SELECT doc_id, strlen(text) AS n FROM documents)
    SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.2f MiB', round(n / 1048576.0, 2)) WHEN n >= 1024 THEN printf('%.2f KiB', round(n / 1024.0, 2)) ELSE n || ' B' END AS human,
           least(24, length(bin(greatest(n, 1))) - 1) AS bucket, least(7, n) AS header, n * 100.0 / 100000 AS share FROM v""")
def scalar_functions(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return v.select("doc_id", scalar.human_size("n").alias("human"), scalar.log2_bucket("n").alias("bucket"), scalar.header_clamp("n").alias("header"), scalar.percent("n", F.lit(100000)).alias("share"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM pages")
def url_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalar.url_file_name("url").alias("name"))


_STORES: dict[tuple, str] = {}
STORE_BLOCK, SELDOM = 1 << 14, "Apache License"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a store of all documents, written once in a session, with tables; beside it `side`, other tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        path = f"{store.shared_dir(spark)}/store-{uuid.uuid4().hex}"
        store.write_store(doc_streams(spark, sf_dir), path, STORE_BLOCK, [SearchConfig(match_len=6)], parts=64)
        store.add_tables(spark, path, [SearchConfig(match_len=5, config_id=3)], f"{path}/side")
        _STORES[key] = path
    return _STORES[key]


@query(_hits_sql("documents", SELDOM, block=STORE_BLOCK))
def stored_search(spark, sf_dir):
    """Only the parts of the store are opened that the tables leave a block in."""
    return store.Store(spark, _stored(spark, sf_dir)).search(SELDOM)


@query(_hits_sql("documents", SELDOM, block=STORE_BLOCK))
def stored_sidecar_search(spark, sf_dir):
    path = _stored(spark, sf_dir)
    return store.Store(spark, path, f"{path}/side").search(SELDOM, bail=True)


@query("SELECT doc_id AS stream_id, strlen(text) AS n, md5(hex(text)) AS digest FROM documents WHERE strlen(text) > 0")
def stored_read(spark, sf_dir):
    return _hex(store.Store(spark, _stored(spark, sf_dir)).read())
