"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of each text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, Parser, compile_rules, reverse, shortest
from .tokens import texts


@dataclass(frozen=True)
class Rule:
    """A match is kept if its group `measured` (0: all of it) has `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    measured: int = 0
    any_case: bool = False


# The rules in the order in which kinds are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """The combined automaton finds where matches first end; a rule's own automata, backward and forward, give start and full length.

    For each rule the matches are those of a regular expression search from left to right without overlaps: a match that is
    dropped as too short still uses up its text. (Of `[0-9a-f]+` only runs of 32 can be kept, so the rule asks for these.)
    It relies on no rule having a match inside the part of another match of it that comes before that one's first end.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [Parser(r.pattern, r.any_case).parse() for r in rules]
        self.all = compile_rules([shortest(t) for t in trees], anywhere=True)
        self.forward = [compile_rules([t], anywhere=False) for t in trees]
        self.backward = [compile_rules([reverse(t)], anywhere=False) for t in trees]
        self.exact = [re.compile(r.pattern.encode(), re.I if r.any_case else 0) for r in rules]

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in bytes, in order."""
        table, accepting, accepts = self.all.table, self.all.first_accepting, self.all.accepts
        free = [0] * len(self.rules)
        found, state = [], self.all.start
        for at, c in enumerate(raw.translate(self.all.byte_class)):
            state = table[state + c]
            if state >= accepting:
                for k in accepts[state]:
                    if at >= free[k]:
                        start = _farthest(self.backward[k], raw[free[k] : at + 1][::-1])
                        if start:
                            start = at + 1 - start
                            end = self.end(k, raw, start)
                            free[k] = end
                            rule = self.rules[k]
                            m = self.exact[k].fullmatch(raw, start, end)
                            if m and len(m[rule.measured]) >= rule.least:
                                found.append((start, k, end))
        return sorted(found)

    def end(self, k: int, raw: bytes, start: int) -> int:
        dfa = self.forward[k]
        state, end = dfa.start, start
        for at in range(start, len(raw)):
            state = dfa.table[state + dfa.byte_class[raw[at]]]
            if state == dfa.dead:
                break
            if state >= dfa.first_accepting:
                end = at + 1
        return end


def _farthest(dfa: Dfa, raw: bytes) -> int:
    """Length of the longest match that starts with raw's first byte, 0 if there is none."""
    state, most = dfa.start, 0
    for at, b in enumerate(raw):
        state = dfa.table[state + dfa.byte_class[b]]
        if state == dfa.dead:
            break
        if state >= dfa.first_accepting:
            most = at + 1
    return most


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, ends) for each row: its matches by start, then rule; in code points, end exclusive.

    Null and empty texts have no match. Rows are looked at alone, so repeated rows give equal results; nothing is shuffled.
    """
    scanner = Scanner(rules)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)  # a few thousand integers, whatever the data

    def run(batches):
        scan = sent.value
        names = [r.kind for r in scan.rules]
        for batch in batches:
            offsets, data = texts(batch.column(1))
            kinds, starts, ends = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                raw = data[a:b].tobytes()
                found = scan.spans(raw)
                point = None
                if found and not raw.isascii():
                    point = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
                kinds.append([names[k] for _, k, _ in found])
                starts.append([s if point is None else int(point[s]) for s, _, _ in found])
                ends.append([e if point is None else int(point[e]) for _, _, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "kinds", "starts", "ends"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of find_secrets(): a row for each row of docs.

    Null and empty texts have no spans: counts 0, the digest of the empty string, spans ''. Repeated rows repeat, a null id stays null, no
    rows give none. No other column of docs is looked at.
    """
    found = find_secrets(docs, RULES, id_col, text_col).select("doc_id", F.arrays_zip("kinds", "starts", "ends").alias("m"))
    line = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ",")
    base = F.filter("m", lambda x: x["kinds"].isin(*BASE))
    count = lambda kind: F.size(F.filter("m", lambda x: x["kinds"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("m")).alias("spans"))
