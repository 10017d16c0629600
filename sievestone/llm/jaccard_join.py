"""N-gram Jaccard join with a prefix tree: which texts share at least 80 % of their word shingles, and the groups they form.

Sets of equal shingles are one class first, so copies cost one row. The sets of the classes, in one global order of shingles, are stored
in tries (`PrefixTrie`), which other sets walk down, counting what they share on a path once for all sets below it; a subtree ends where
the lengths that remain can't reach the overlap needed. The tries are dealt by first shingles, the top of the tree, and what a walk gives
back are links between groups. For the classes the join is exact:

1. Branches. Classes that share one of their PROBES least shingles go to the trie of that shingle's first class, in parts of TRIE_SETS;
   every set walks its part's trie, unless it is in one group with all of it already. This links nearly all that is alike.
2. Prefixes. Under one global order of all shingles, two sets with Jaccard j >= t share a shingle among the first
   n - ceil(t n) + 1 of each. The order puts frequent shingles last (`heavy`: in more classes than HEAVY_DF, counted over all
   prefixes) and is by hash otherwise. Passages that many texts share so never bring their texts together.
3. The rest. Classes that share a prefix shingle but are still in different groups are compared too. Pairs inside a group
   are not: they can't change it. No link between groups can be missed. Where few classes share the shingle, they are paired, and pairs
   that the prefixes don't rule out are walked in tries; where many do, they go to the branch of the shingle's first class again: those
   outside its commonest group are stored, in blocks, and all of the branch walk through each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import drop_saved, saved, small_batches, with_ids
from .tokens import mix, shingle_sets, words

#: A shingle in more classes than this comes last in the global order, as does any with the same last HEAVY_BITS bits: the bitmap of
#: these bits is what is broadcast (8 MB), whatever the input's size.
HEAVY_DF = 8
HEAVY_BITS = 26
#: Rounds in which prefixes that lost heavy shingles are filled up and counted again. More rounds change only the speed.
HEAVY_ROUNDS = 3
PROBES = 4
TRIE_SETS = 256
#: Classes that meet at a shingle of more classes than this are compared in blocks of about BLOCK_SETS stored sets, not as pairs; of the
#: sets that walk through a block, VISITORS go to one task.
HOT_DF = 64
BLOCK_SETS = 512
VISITORS = 8192


class PrefixTrie:
    """A trie over ascending arrays, held as the sorted list of arrays: a node is a range of arrays and a depth."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(x) for x in self.sets])

    def similar(self, probe: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(index of a set, its overlap with probe) for all with 100 * overlap >= percent * union.

        The overlap on a shared path is counted once for the whole subtree. A subtree ends as soon as what remains of its
        longest set and of the probe can't lift the overlap to what its shortest set needs.
        """
        stack = [(0, len(self.sets), 0, 0)] if self.sets and len(probe) else []
        while stack:
            lo, hi, depth, overlap = stack.pop()
            sizes = self.sizes[lo:hi]
            end = len(self.sets[lo]) if hi - lo == 1 else _shared(self.sets[lo], self.sets[hi - 1], depth)
            edge = self.sets[lo][depth:end]
            overlap += _hits(edge, probe)
            passed = int(np.searchsorted(probe, self.sets[lo][end - 1], "right")) if end else 0
            most = overlap + min(int(sizes.max()) - end, len(probe) - passed)
            if (100 + percent) * most < percent * (int(sizes.min()) + len(probe)):
                continue
            done = lo
            while done < hi and self.sizes[done] == end:
                if (100 + percent) * overlap >= percent * (end + len(probe)):
                    yield self.order[done], overlap
                done += 1
            while done < hi:
                key, to = self.sets[done][end], done + 1
                while to < hi and self.sets[to][end] == key:
                    to += 1
                stack.append((done, to, end, overlap))
                done = to


def _shared(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[depth:n] != b[depth:n])
    return depth + int(differ[0]) if differ.size else n


def _hits(edge: np.ndarray, probe: np.ndarray) -> int:
    at = np.searchsorted(probe, edge)
    at[at == len(probe)] = 0
    return int(np.count_nonzero(probe[at] == edge))


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _list(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sets(batches, k: int, percent: int, whole: bool):
    """Of each (id, text): id, set size, two digests of the set, and its first shingles by hash or all of them."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for w in words(column):
            size, one, two, heads = [], [], [], []
            for s in shingle_sets(w, k):
                n = len(s)
                size.append(n)
                one.append(np.add.reduce(mix(s + np.uint64(1))))
                two.append(np.bitwise_xor.reduce(mix(s + np.uint64(2))))
                heads.append(s if whole or not n else s[: prefix_size(n, percent)])
            digests = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(w.row, len(w)), pa.array(size, pa.int64()), *digests, _list(heads)], ["id", "n", "d1", "d2", "s"]
            )


SETS = "id long, n long, d1 long, d2 long, s array<long>"


def shingle_table(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _sets(b, k, percent, whole), SETS)


def _lengthened(batches, k: int, percent: int, heavy: np.ndarray):
    """Prefixes under the order with `heavy` last, of the sets whose prefix by hash has a heavy shingle; fresh: what wasn't in that."""
    for batch in _sets(batches, k, percent, True):
        flat = batch.column(4).values.to_numpy().view(np.uint64)
        ends = batch.column(4).offsets.to_numpy()
        slot = flat & np.uint64((1 << HEAVY_BITS) - 1)
        last = (heavy[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        keep, rows, fresh = [], [], []
        for i in range(batch.num_rows):
            a, b = ends[i], ends[i + 1]
            head = prefix_size(int(b - a), percent) if b > a else 0
            if last[a : a + head].any():
                s, m = flat[a:b], last[a:b]
                keep.append(i)
                rows.append(np.concatenate((s[~m], s[m]))[:head])
                fresh.append(s[head:][~m[head:]][: int(m[:head].sum())])
        if keep:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), _list(rows), _list(fresh)], ["id", "n", "s", "fresh"])


def _frequent(tokens: DataFrame) -> np.ndarray:
    """Bitmap of the last bits of shingles in more than HEAVY_DF rows; its size doesn't depend on the input."""
    slot = F.col("token").bitwiseAND(F.lit((1 << HEAVY_BITS) - 1)) + 1
    many = tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > HEAVY_DF).select(slot.alias("slot"))
    parts = many.groupBy((F.bitmap_bucket_number("slot") - 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << (HEAVY_BITS - 3), np.uint8)
    for part, bits in parts.toLocalIterator():
        out[part * len(bits) : (part + 1) * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _prefixes(docs: DataFrame, heads: DataFrame, copies: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, n, s): the prefix of each class under the final order. And the tables to drop at the end."""
    spark = docs.sparkSession
    heavy = _frequent(heads.select(F.explode("s").alias("token")))
    if not heavy.any():
        return heads.select("id", "n", "s"), []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    rows = with_ids(rows, copies, "left_anti")
    longer = None
    for left in range(HEAVY_ROUNDS)[::-1]:
        sent = spark.sparkContext.broadcast(heavy)
        if longer is not None:
            drop_saved(longer)
        longer = saved(rows.mapInArrow(lambda b, sent=sent: _lengthened(b, k, percent, sent.value), "id long, n long, s array<long>, fresh array<long>"), "longer")
        sent.destroy()
        if not left:
            break
        more = _frequent(longer.select(F.explode("fresh").alias("token"))) & ~heavy
        if not more.any():
            break
        heavy |= more
    changed = longer.select("id").distinct()
    return with_ids(heads.select("id", "n", "s"), changed, "left_anti").unionByName(longer.select("id", "n", "s")), [longer]


class _Groups:
    """Which keys are one group, as far as links have been found; a link inside a group isn't given back."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def link(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
            self.found.append((a, b))


def _compare(rows, percent: int, all_pairs: bool):
    """rows: (probe, other, set), sorted by probe; the probe's own set (other is null) before those to compare it with.

    Others are stored in tries of TRIE_SETS sets, which the probe walks; with all_pairs, so do all others that aren't linked to it.
    """
    probes: list[np.ndarray] = []
    key, opened, waiting, names = None, False, [], []
    groups = _Groups()

    def flush():
        if waiting and probes:
            trie = PrefixTrie(waiting)
            for p in probes:
                for i, _ in trie.similar(p, percent):
                    groups.link(key, names[i])
            if all_pairs:
                for name, p in zip(names, waiting, strict=True):
                    if groups.root(name) != groups.root(key):
                        for i, _ in trie.similar(p, percent):
                            groups.link(name, names[i])
        waiting.clear()
        names.clear()

    for batch in rows:
        probe, other = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lists = batch.column(2)
        flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for i in range(batch.num_rows):
            if probe[i] != key or other[i] is None and not opened:
                flush()
                if probe[i] != key:
                    groups.parent.clear()
                key, probes, opened = probe[i], [], True
            s = flat[ends[i] : ends[i + 1]].copy()
            if other[i] is None:
                probes.append(s)
            else:
                opened = False
                waiting.append(s)
                names.append(other[i])
                if len(waiting) >= TRIE_SETS:
                    flush()
        if groups.found:
            yield _links(groups.found)
    flush()
    if groups.found:
        yield _links(groups.found)


def _tasks(df: DataFrame) -> int:
    """A fixed number, as the work isn't in proportion to the bytes that adaptive execution would go by."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int, all_pairs: bool = False) -> DataFrame:
    """Links that join the groups of the pairs (a, b) whose sets (id, s) are similar; with all_pairs, of the b's of one a among each other
    as well. b's are spread over several tasks where a has very many; in different tasks, or tries, they meet a only."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(64)).alias("salt"))
    many = salted.groupBy("a").agg(F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.count("*") / (4 * TRIE_SETS)))).alias("parts"))
    salted = salted.join(many, "a").select("a", "b", (F.col("salt") % F.col("parts")).alias("salt"))
    others = salted.join(sets.select(F.col("id").alias("b"), "s"), "b").select("a", "b", "s", "salt")
    own = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), "s"), "a").select("a", F.lit(None).cast("long").alias("b"), "s", "salt")
    dealt = others.unionByName(own).repartition(_tasks(sets), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "s", "salt").mapInArrow(lambda rows: _compare(rows, percent, all_pairs), "a long, b long")


def _compare_blocks(rows, percent: int):
    """rows: (branch, block, part, late, id, g, s), sorted so: a block's stored sets first, then those that walk through it, which aren't held."""
    key, held, trie, names, of = None, [], None, [], []
    groups = _Groups()
    for batch in rows:
        cols = [batch.column(c).to_pylist() for c in range(6)]
        lists = batch.column(6)
        flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for r, (branch, block, part, late, name, g) in enumerate(zip(*cols, strict=True)):
            if (branch, block, part) != key:
                key, held, trie, names, of = (branch, block, part), [], None, [], []
                groups.parent.clear()
            s = flat[ends[r] : ends[r + 1]].copy()
            if not late:
                held.append(s)
                names.append(name)
                of.append(g)
                continue
            trie = trie or PrefixTrie(held)
            for k, _ in trie.similar(s, percent):
                if g != of[k] and groups.root(g) != groups.root(of[k]):
                    groups.link(g, of[k])
        if groups.found:
            yield _links(groups.found)


def _links(found: list) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _branch_links(hot: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links between groups g. hot: (token, id, g), classes at very frequent shingles; the branch of a shingle is its least class.

    All that share a shingle are in its branch. In each, what isn't in the commonest group is stored, in blocks, and all of it walk through
    them: no two of the commonest group are compared, and a set is sent once for each block of what isn't in it.
    """
    lead = hot.groupBy("token").agg(F.min("id").alias("branch"))
    member = saved(hot.join(lead, "token").select("branch", "id", "g").distinct(), "members")
    sizes = member.groupBy("branch", "g").agg(F.count("*").alias("n"))
    # The commonest group, of equal ones the least, by plain maxima and minima.
    most = sizes.groupBy("branch").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    top = sizes.join(most, "branch").where("n = most").groupBy("branch").agg(F.min("g").alias("top"), F.max("most").alias("most"), F.max("all").alias("all"))
    few = F.col("all") - F.col("most")
    top = saved(top.where(few > 0).select("branch", "top", F.ceil(few / BLOCK_SETS).cast("int").alias("blocks"), F.ceil(F.col("all") / VISITORS).cast("int").alias("parts")), "tops")
    dealt = member.join(top, "branch")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_by = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
    stored = dealt.where("g <> top").select("branch", dealt_by("blocks").alias("block"), each("parts").alias("part"), F.lit(0).alias("late"), "id", "g")
    walking = dealt.select("branch", each("blocks").alias("block"), dealt_by("parts").alias("part"), F.lit(1).alias("late"), "id", "g")
    whole = _whole_sets(docs, dealt.select("id").distinct(), k, percent, id_col, text_col)
    met = stored.unionByName(walking).join(whole, "id").select("branch", "block", "part", "late", "id", "g", "s").repartition(_tasks(docs), "branch", "block", "part").sortWithinPartitions("branch", "block", "part", "late")
    out = saved(met.mapInArrow(lambda rows: _compare_blocks(rows, percent), "a long, b long"), "linked")
    for t in (whole, member, top):
        drop_saved(t)
    return out


def _possible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs that their first shingles by hash (about a fifth) don't rule out: the overlap is at most what they share up to
    the smaller of their last hashes, and what remains of the shorter of both beyond."""
    ids = saved(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    own = with_ids(heads.select("id", "n", "s"), ids, "left_semi")
    met = pairs.join(own.toDF("a", "an", "sa"), "a").join(own.toDF("b", "bn", "sb"), "b")
    order = lambda x: x.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  hashes are unsigned
    met = met.withColumn("last", F.least(order(F.element_at("sa", -1)), order(F.element_at("sb", -1))))
    low = [F.filter(c, lambda x: order(x) <= F.col("last")) for c in ("sa", "sb")]
    met = met.select("a", "b", "an", "bn", low[0].alias("la"), low[1].alias("lb"))
    most = F.size(F.array_intersect("la", "lb")) + F.least(F.col("an") - F.size("la"), F.col("bn") - F.size("lb"))
    return met.where((100 + percent) * most >= percent * (F.col("an") + F.col("bn"))).select("a", "b")


def _sets_of(docs: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    return _whole_sets(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), k, percent, id_col, text_col)


def _whole_sets(docs: DataFrame, ids: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    return saved(shingle_table(with_ids(docs.select(id_col, text_col), ids, "left_semi", id_col), k, percent, id_col, text_col, True).select("id", "s"), "whole")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    component_id is the least id that links reach, the row's own included. Texts without words (null, empty, only spaces)
    have n_shingles 0 and link with nothing. Rows with equal ids count as one document with several texts. Rows with a
    null id are kept, link with nothing and have a null component. Other columns of docs are not looked at.
    """
    small_batches(docs.sparkSession)
    table = saved(shingle_table(docs, k, percent, id_col, text_col), "sets")
    full = table.where("n > 0 AND id IS NOT NULL")
    classes = saved(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("root"), F.count("*").alias("rows")), "classes")
    copies = saved(full.select("id", "n", "d1", "d2").join(classes.where("rows > 1"), ["n", "d1", "d2"]).where("id <> root").select("id", "root"), "copies")
    spare = copies.select("id").distinct().join(classes.select(F.col("root").alias("id")), "id", "left_anti")
    heads = with_ids(full, spare, "left_anti")

    # The first shingles by hash act as min-hashes: nearly all similar sets meet here, each with few others.
    first = heads.select("id", "n", F.explode(F.slice("s", 1, PROBES)).alias("token"))
    lead = first.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct(F.xxhash64("id", "token"), "id", "n")).alias("lead")).where("df > 1")
    met = first.join(lead.select("token", F.col("lead.id").alias("a"), F.col("lead.n").alias("an")), "token")
    near = f"100 * least(n, an) >= {percent} * greatest(n, an)"
    probes = saved(met.where(f"a <> id AND {near}").select("a", F.col("id").alias("b")).distinct(), "probes")
    whole = _sets_of(docs, probes, k, percent, id_col, text_col)
    links = saved(similar_pairs(probes, whole, percent, True), "linked")
    drop_saved(whole)
    group = saved(components(links, python=True), "groups")

    prefixes, drop = _prefixes(docs, heads, spare, k, percent, id_col, text_col)
    # Shingles of one class alone, nearly all, go before anything else is known of them.
    tokens = prefixes.select("id", F.explode("s").alias("token"))
    several = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    common = saved(tokens.join(several, "token", "left_semi").select("token", "id"), "common")
    member = heads.select("id", "n").join(group.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("g"))
    placed = saved(common.join(member, "id").select("token", "id", "n", "g"), "placed")
    ends = placed.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("df")).where("g0 < g1")
    split = saved(ends.select("token", "df"), "split")
    rest = saved(placed.join(split.where(F.col("df") <= HOT_DF), "token", "left_semi"), "rest")
    other = rest.select("token", F.col("id").alias("a"), F.col("n").alias("an"), F.col("g").alias("ag"))
    met = saved(rest.join(other, "token").where(f"g < ag AND {near}").select("a", F.col("id").alias("b")).distinct(), "met")
    left = saved(_possible(met, heads, percent).join(probes, ["a", "b"], "left_anti").join(probes.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "left")
    hot = split.where(F.col("df") > HOT_DF)
    if not hot.isEmpty():
        hot = saved(placed.join(hot, "token", "left_semi").select("token", "id", "g"), "hot")
        links = links.unionByName(_branch_links(hot, docs, k, percent, id_col, text_col))
        drop_saved(hot)
    whole = _sets_of(docs, left, k, percent, id_col, text_col)
    more = saved(similar_pairs(left, whole, percent), "linked")
    # An id with several texts ties their classes.
    ties = copies.select(F.col("id").alias("a"), F.col("root").alias("b")).join(full.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("id").alias("a")), "a")
    names = saved(components(links.unionByName(more).unionByName(ties), python=True), "groups")
    for t in [*drop, whole, split, common, placed, rest, met, left, probes, group, more, copies]:
        drop_saved(t)
    by_class = classes.join(names.withColumnRenamed("node", "root"), "root", "left").select("n", "d1", "d2", F.coalesce("component", "root").alias("component_id"))
    out = table.select("id", "n", "d1", "d2").join(by_class, ["n", "d1", "d2"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns as they are, with the document of least id of each component; rows with equal ids count once there.

    Texts without words are in no group and stay, as do rows with a null id.
    """
    found = saved(jaccard_components(docs, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("id"), "component_id", "n_shingles"), "found")
    gone = saved(found.where("id <> component_id").select("id").distinct(), "gone")
    kept = with_ids(docs, gone, "left_anti", id_col)
    twice = found.where("n_shingles > 0 AND id = component_id").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    if twice.isEmpty():
        return kept
    twice = saved(twice, "twice")
    worded = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    once = with_ids(kept.where(worded), twice, "left_semi", id_col).dropDuplicates([id_col])
    return with_ids(kept.where(worded), twice, "left_anti", id_col).unionByName(once).unionByName(kept.where(~worded | F.col(text_col).isNull()))
