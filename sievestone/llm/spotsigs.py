"""Document fingerprints by SpotSigs (Theobald et al. 2008), in DataFrame functions only.

A signature is an anchor, one of the most common words of a language, with the chain of the CHAIN content words that follow it.
Prose has many anchors, boilerplate and lists few, so the set of a text's signatures stands for its running text. Sets are
compared by Jaccard; sets whose sizes alone rule out the likeness asked for are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import IDS_MOST, drop_saved, saved

CHAIN = 2
#: Least likeness of a link.
LIKENESS = 0.8

# Anchors, the most common words of English, German, French and Spanish.
ANCHORS = (
    "the a an of to in is was and that for it on with as at by from be are this or "
    "der die das und ist ein eine den von zu mit nicht auf des dem "
    "le la les un une et est que de du dans pour qui par "
    "el los las una y en es del con para lo al"
).split()

_SPACES = r"[\x20\x09-\x0D]+"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, chain: int = CHAIN, anchors=tuple(ANCHORS)) -> Column:
    """The text's distinct signatures as 32-bit hashes.

    Words are in lower case, without ASCII punctuation around them. Content words are those that are no anchors. Where an anchor
    stands before a content word, the anchor and the chain from that word on are a signature; so are the start of the text and
    its first chain. Chains end with the text. A text of anchors only has one signature, of all its words; one without words, or
    null, has none.
    """
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SPACES)
    bare = F.filter(F.transform(words, lambda x: F.btrim(x, F.lit(_PUNCTUATION))), lambda x: x != "")
    return let(bare, lambda w: _signatures(w, chain, anchors))


def _signatures(w: Column, chain: int, anchors) -> Column:
    # Places of the content words among all words, in order.
    places = F.filter(F.transform(w, lambda x, i: F.when(~x.isin(*anchors), i)), lambda i: i.isNotNull())

    def spots(at: Column) -> Column:
        def spot(i: Column, k: Column) -> Column:
            opens = (k == 0) | (F.get(at, k - 1) < i - 1)
            before = F.when(i == 0, F.lit("^")).otherwise(F.get(w, i - 1))
            return F.when(opens, F.hash(before, *[F.get(w, F.get(at, k + j)) for j in range(chain)]))

        every = F.array_distinct(F.filter(F.transform(at, spot), lambda x: x.isNotNull()))
        return F.when((F.size(at) == 0) & (F.size(w) > 0), F.array(F.hash(w))).otherwise(every)

    return let(places, spots)


def fingerprint(sigs: Column) -> Column:
    """Number of signatures and a digest of them all."""
    return F.concat_ws(":", F.size(sigs), F.sha2(F.array_join(F.sort_array(sigs), ","), 256))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def next_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs: (doc_id, text). (doc_id, h, next_id, next_h, half) of each distinct document; whether rows are repeated.

    Documents are in descending order of id (nulls last), then of hash and length; the last is followed by the first. h is a hash of
    the text, half is half its code points. Ranks come from range partitions and the partitions' counts: no task sees all.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("n")]
    known = saved(docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")), "known")
    parts = saved(known.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranked")
    total = parts.count()
    starts = parts.groupBy("part").agg(F.count("*").alias("rows"))
    starts = starts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = parts.join(F.broadcast(starts), "part").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before"))
    ranked = saved(ranked.select("doc_id", "h", "n", "rank"), "ranked")
    after = ranked.select(F.pmod(F.col("rank") - 1, F.lit(max(total, 1))).alias("rank"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    pairs = ranked.join(after, "rank").select("doc_id", "h", "next_id", "next_h", F.floor(F.col("n") / 2).cast("int").alias("half"))
    return saved(pairs, "pairs"), known.count() > total


def edit_report(docs: DataFrame, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half comes from the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The last half of the code
    points, rounded down, is replaced by the first as many (or all) of the next document's, in descending order of id. Null
    texts are empty. Equal rows are one document, with equal results; different texts under one id follow each other.
    A single document follows itself. No rows give none; no other column of docs is looked at.

    Each text is shuffled once, and its part that goes to its predecessor once more, with its signatures.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pairs, repeated = next_documents(rows)
    keyed = rows.withColumn("h", F.xxhash64("text"))
    wanted = pairs.select(F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), "next_id", "next_h", "half")
    wanted = F.broadcast(wanted) if pairs.count() <= IDS_MOST else wanted  # 40 bytes each
    sent = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("next_id")) & (F.col("h") == F.col("next_h")))
    sent = sent.select("to_id", "to_h", "half", F.expr("substring(text, 1, half)").alias("tail"), signatures(F.col("text"), chain).alias("next_sigs"))
    sent = sent.dropDuplicates(["to_id", "to_h"]) if repeated else sent
    met = keyed.join(sent, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h")))
    edited = met.select("doc_id", "text", F.expr("concat(substring(text, 1, length(text) - half), tail)").alias("edited"), "next_sigs")
    edited = edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("text"), chain).alias("own"), signatures(F.col("edited"), chain).alias("other"), "next_sigs"
    )
    # One row of arrays binds each signature set, so that it is computed once.
    bound = edited.select("doc_id", "n_chars", "edited_sha256", F.explode(F.array(F.struct("own", "other", "next_sigs"))).alias("s"))
    own, other, following = F.col("s.own"), F.col("s.other"), F.col("s.next_sigs")
    return bound.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next")
    )


def near_duplicates(docs: DataFrame, least: float = LIKENESS, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_signatures, component_id): groups of texts whose signature sets have a likeness of `least` or more.

    Equal sets are one class. Of each class the rarest signatures are taken that any alike set must share one of, under an order by
    how many classes have them. Classes are partitioned by the logarithm of their set size to base 1/least; classes that share such
    a signature meet if they are in the same or neighbouring partitions and their sizes allow the likeness. First each
    meets one of each signature's; then, those that aren't yet in one group. Texts without signatures and null ids link with nothing.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.sort_array(signatures(F.col(text_col), chain)).alias("s"))
    table = saved(rows.select("id", F.sha2(F.array_join("s", ","), 256).alias("key"), F.size("s").alias("n"), "s"), "spots")
    classes = saved(table.where("n > 0").groupBy("key").agg(F.min("id").alias("root"), F.first("n").alias("n"), F.first("s").alias("s")), "classes")
    flat = classes.select("root", "n", F.explode("s").alias("sig"))
    df = flat.groupBy("sig").agg(F.count("*").alias("df"))
    keep = F.floor(F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    rare = flat.join(df, "sig").groupBy("root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("o"))
    part = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / least)))
    prefix = saved(rare.select("root", "n", part.alias("part"), F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("o")).select("root", "n", "part", "o.sig").where("o.df > 1"), "prefix")
    sets = classes.select("root", "s")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("root").alias("a"), F.col("s").alias("sa")), sets.select(F.col("root").alias("b"), F.col("s").alias("sb"))
        return saved(pairs.join(one, "a").join(two, "b").where(likeness(F.col("sa"), F.col("sb")) >= least).select("a", "b"), "alike")

    both = prefix.select("sig", F.col("root").alias("b"), F.col("n").alias("bn"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    lead = both.groupBy("sig", "part").agg(F.min(F.struct(F.xxhash64("b", "sig"), "b", "bn")).alias("l")).select("sig", "part", F.col("l.b").alias("b"), F.col("l.bn").alias("bn"))
    fits = (F.col("a") != F.col("b")) & (F.least("an", "bn") >= F.greatest("an", "bn") * least - 1e-9)
    mine = prefix.select("sig", "part", F.col("root").alias("a"), F.col("n").alias("an"))
    probes = saved(mine.join(lead, ["sig", "part"]).where(fits).select("a", "b").distinct(), "probes")
    links = verified(probes)
    group = saved(components(links), "groups").withColumnRenamed("node", "root")
    placed = prefix.join(group, "root", "left").select("sig", "part", "root", "n", F.coalesce("component", "root").alias("g"))
    rest = placed.join(placed.groupBy("sig").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("sig"), "sig")
    left = rest.select("sig", "part", F.col("root").alias("a"), F.col("n").alias("an"), F.col("g").alias("ga"))
    right = rest.select("sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("root").alias("b"), F.col("n").alias("bn"), F.col("g").alias("gb"))
    more = verified(saved(left.join(right, ["sig", "part"]).where(fits & (F.col("ga") != F.col("gb"))).select("a", "b").distinct().join(probes, ["a", "b"], "left_anti"), "left"))
    names = saved(components(links.unionByName(more)), "groups").withColumnRenamed("node", "root")
    for t in (prefix, probes, group, links, more):
        drop_saved(t)
    by_key = classes.join(names, "root", "left").select("key", F.coalesce("component", "root").alias("component_id"))
    return table.join(by_key, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_signatures"), F.coalesce("component_id", "id").alias("component_id"))
