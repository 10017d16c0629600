"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their votes, a linear classifier.

1. Voters. A word start (3 to 8 bytes, or a whole word) votes if a word of the text starts so: those of a fixed lexicon, and those
   that training labels single out by a likelihood ratio over distinct texts. Patterns vote on masked words, shouting
   marks and runs of one word.
2. Label model. Votes and the given label are noisy signs of a hidden class. EM estimates the class's share and each sign's accuracy;
   correlations of signs within the classes are estimated too, and signs that move together are merged and the model is
   fitted again. The given label is a sign like the others, so wrong labels are outvoted.
3. Classifier. Logistic regression of the hidden class's posterior on vote counts and densities. It alone scores texts.

Fitting takes at most FIT_ROWS labelled documents, those with the least hash of their id; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .tokens import Words, hash_word, hash_words, mix, shingles, words

FIT_ROWS = 12_000
VOTERS = 256
#: Least log likelihood ratio of a mined voter: about 1 in 10**7 by chance.
LEAST_RATIO = 16.0
STARTS = (3, 4, 5, 6, 7, 8)
WHOLE = 24

# Insults of general English and their counterparts in German, French and Spanish.
LEXICON = (
    "idiot moron stupid dumb scum trash loser clown pathetic worthless disgusting filth vermin "
    "dumm abschaum drecks vollidiot imbécile connard ordure crétin idiota imbécil estúpid escoria basura"
).split()
PATTERNS = ("masked", "shouting", "repeated")


def _stripped(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation around them."""
    punct = np.zeros(256, bool)
    punct[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(4):
        starts += (starts < ends) & punct[w.data[np.minimum(starts, len(w.data) - 1)]]
        ends -= (starts < ends) & punct[w.data[np.maximum(ends - 1, 0)]]
    return starts, ends


def _terms(w: Words):
    """(hash of a word's start, index of the word) in parts, one for each length."""
    starts, ends = _stripped(w)
    size = ends - starts
    for n in STARTS:
        own = np.flatnonzero(size >= n)
        yield hash_words(w.data, starts[own], starts[own] + n), own
    own = np.flatnonzero((size > STARTS[-1]) & (size <= WHOLE))
    yield hash_words(w.data, starts[own], ends[own]), own


def _doc_of(w: Words, word: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, word, "right") - 1


def _pattern_counts(w: Words) -> np.ndarray:
    """(texts, patterns)."""
    out = np.zeros((len(w), len(PATTERNS)))
    d, last = w.data, np.maximum(w.ends - 1, 0)
    if not len(w.starts):
        return out
    long = w.ends - w.starts > 2
    masked = long & (d[last] == ord("*")) & (d[last - 1] == ord("*"))
    shouting = long & (d[last] == ord("!")) & (d[last - 1] == ord("!"))
    repeated = np.zeros(len(w.starts), bool)
    repeated[1:] = w.hashes[1:] == w.hashes[:-1]
    for k, hit in enumerate((masked, shouting, repeated)):
        np.add.at(out[:, k], _doc_of(w, np.flatnonzero(hit)), 1)
    return out


def _votes(w: Words, voters: np.ndarray) -> np.ndarray:
    """(texts, voters + patterns): how many words of each text each voter votes for; voters ascend."""
    out = np.zeros((len(w), len(voters)))
    for h, word in _terms(w):
        at = np.searchsorted(voters, h)
        at[at == len(voters)] = 0
        hit = np.flatnonzero(voters[at] == h) if len(voters) else np.zeros(0, np.int64)
        np.add.at(out, (_doc_of(w, word[hit]), at[hit]), 1)
    return np.hstack((out, _pattern_counts(w)))


@dataclass
class LabelModel:
    """Hidden class y, and groups of binary signs that are independent given y."""

    groups: list[list[int]]
    share: float
    rates: np.ndarray  # (2, groups): P(sign | y)
    correlations: np.ndarray

    @staticmethod
    def merged(signs: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        return np.column_stack([signs[:, g].max(axis=1) for g in groups])

    def posterior(self, signs: np.ndarray) -> np.ndarray:
        x = self.merged(signs, self.groups)
        on, off = np.log(self.rates), np.log1p(-self.rates)
        logit = np.log(self.share / (1 - self.share)) + x @ (on[1] - on[0]) + (1 - x) @ (off[1] - off[0])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit_label_model(signs: np.ndarray, start: np.ndarray, together: float = 0.6, rounds: int = 30) -> LabelModel:
    """signs: (rows, signs) of 0 and 1; start: a first guess of the posterior."""
    model = _em(signs, [[k] for k in range(signs.shape[1])], start, rounds)
    c = model.correlations
    parent = list(range(len(c)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(np.triu(c, 1) > together), strict=True):
        parent[root(int(a))] = root(int(b))
    groups: dict[int, list[int]] = {}
    for k in range(len(c)):
        groups.setdefault(root(k), []).append(k)
    return _em(signs, list(groups.values()), start, rounds)


def _em(signs, groups, start, rounds) -> LabelModel:
    x = LabelModel.merged(signs, groups)
    y = start
    for _ in range(rounds):
        weight = np.vstack((1 - y, y))
        rates = (weight @ x + 0.5) / (weight.sum(axis=1, keepdims=True) + 1)
        model = LabelModel(groups, float(np.clip(y.mean(), 1e-3, 1 - 1e-3)), np.clip(rates, 1e-4, 1 - 1e-4), np.zeros((0, 0)))
        y = model.posterior(signs)
    # Correlations within the classes, weighted by the posterior.
    centred = [np.sqrt(wt)[:, None] * (x - r) for wt, r in zip((1 - y, y), model.rates, strict=True)]
    cov = sum(c.T @ c for c in centred) / max(1, len(x))
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    model.correlations = cov / np.outer(sd, sd)
    return model


@dataclass
class Scorer:
    voters: np.ndarray
    groups: list[list[int]]
    weights: np.ndarray

    def features(self, w: Words) -> np.ndarray:
        return features(_votes(w, self.voters), np.diff(w.first), self.groups)

    def score(self, w: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(w) @ self.weights, -30, 30)))


def features(votes: np.ndarray, n_words: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Of each group whether it votes; of all mined and lexicon groups together whether, how often and how densely; patterns; 1."""
    voters = votes[:, : votes.shape[1] - len(PATTERNS)]
    any_ = np.column_stack([voters[:, g].max(axis=1) > 0 for g in groups]).astype(float) if groups else np.zeros((len(votes), 0))
    total = any_.sum(axis=1)
    hits = voters.sum(axis=1)
    n = np.maximum(n_words, 1)
    patterns = np.log1p(votes[:, -len(PATTERNS) :]) / np.log1p(n)[:, None]
    return np.column_stack((any_, total > 0, np.log1p(total), np.log1p(100 * hits / n), patterns, np.ones(len(votes))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps; y are probabilities."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def is_held_out(id_col="doc_id"):
    """crc32 of the id as text, mod 5, is 0; an id that is null counts as held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Scorer:
    """A scorer from labelled documents that aren't held out. Without any, it knows the lexicon only.

    At most fit_rows labelled ids are used, those of least hash. A label other than 0 and 1, or of a null id, is left out; of an id's
    labels the greatest counts. Null texts are empty. No other column of docs or labels is looked at.

    Correlated voters are merged (by how far their votes, given the class, depend on each other) rather than modelled by terms of their own.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(~is_held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = saved(texts.join(F.broadcast(sample), "id").select("id", "y", "text"), "labelled")

    # Near copies of a labelled text are one witness: that with the least id for each least shingle.
    def groups(batches):
        for b in batches:
            for w in words(b.column(2)):
                runs = mix(shingles(w.hashes, 5))
                key = [int(runs[a : e - 4].min()) if e - a > 4 else int(np.bitwise_xor.reduce(w.hashes[a:e])) for a, e in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row, len(w)), b.column(1).slice(w.row, len(w)), pa.array(np.array(key, np.uint64).view(np.int64))], ["id", "y", "key"])

    witness = rows.mapInArrow(groups, "id long, y int, key long").groupBy("key", "y").agg(F.min("id").alias("id")).select("id")
    chosen = saved(rows.join(F.broadcast(witness), "id", "left_semi"), "witnesses")
    size = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    mined = _mine(chosen, size.get(0, 0), size.get(1, 0))
    voters = np.unique(np.array([*mined, *(hash_word(x) for x in LEXICON)], dtype=np.uint64))
    lexicon = np.array([hash_word(x) for x in LEXICON], dtype=np.uint64)

    def votes(batches):
        for b in batches:
            for w in words(b.column(2)):
                for i, v in enumerate(_votes(w, voters)):
                    on = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row + i, 1), b.column(1).slice(w.row + i, 1), pa.array([w.count(i)]), pa.array([on.tolist()], pa.list_(pa.int64())), pa.array([v[on].tolist()], pa.list_(pa.float64()))], ["id", "y", "n", "at", "v"])

    got = chosen.mapInArrow(votes, "id long, y int, n long, at array<long>, v array<double>").toArrow().sort_by("id").to_pydict()
    n = len(got["id"])
    x, y, sizes = np.zeros((n, len(voters) + len(PATTERNS))), np.array(got["y"], float), np.array(got["n"], float)
    for i in range(n):
        x[i, got["at"][i]] = got["v"][i]
    groups_, target = [[k] for k in range(len(voters))], np.zeros(0)
    if n and 0 < y.sum() < n:
        signs = np.column_stack((x > 0, y)).astype(float)
        model = fit_label_model(signs, 0.05 + 0.9 * y)
        target = model.posterior(signs)
        groups_ = [g for g in ([k for k in group if k < len(voters)] for group in model.groups) if g]
        return Scorer(voters, groups_, fit_logistic(features(x, sizes, groups_), target))
    weights = np.zeros(len(groups_) + 3 + len(PATTERNS) + 1)
    weights[: len(groups_)] = np.where(np.isin(voters, lexicon), 2.0, 0.0)
    weights[len(groups_)], weights[-1] = 1.0, -2.0
    return Scorer(voters, groups_, weights)


def _mine(rows: DataFrame, negative: int, positive: int) -> list[int]:
    """Word starts that speak for label 1; rows: (id, y, text) without near copies."""
    if not positive or not negative:
        return []

    def count(batches):
        kept, sums = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for b in batches:
            label = b.column(1).to_numpy()
            for w in words(b.column(2)):
                parts = [(h, _doc_of(w, word)) for h, word in _terms(w)]
                h, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, y = h[new], label[w.row + doc[new]]
                kept = np.concatenate((kept, h))
                sums = np.concatenate((sums, np.column_stack((1 - y, y))))
                kept, at = np.unique(kept, return_inverse=True)
                sums = np.column_stack([np.bincount(at, sums[:, k], len(kept)).astype(np.int64) for k in (0, 1)])
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["term", "a", "b"])

    total = rows.mapInArrow(count, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    base = positive / (positive + negative)
    q = F.col("b") / (F.col("a") + F.col("b"))
    ratio = F.col("b") * F.log(q / base) + F.when(F.col("a") > 0, F.col("a") * F.log((1 - q) / (1 - base))).otherwise(0.0)
    best = total.where((F.col("b") >= 5) & (q > 0.5)).withColumn("ratio", ratio).where(F.col("ratio") > LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(VOTERS)
    return best.select("term").toArrow().column(0).to_numpy().view(np.uint64).tolist()


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. Null and empty texts get the score of a text without votes.

    Rows are scored by themselves: repeated rows have equal scores, no rows give none; a null id is kept and counts as held out. Texts
    are read whole. No other column of docs is looked at, whatever its name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            for w in words(b.column(1)):
                s = sent.value.score(w)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row, len(w)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, with a score under 0.5."""
    sent, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [sent.value.score(w) < 0.5 for w in words(b.column(at))]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
