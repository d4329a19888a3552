"""Matching rows with many text rules at once.

Every rule is a regular expression or a literal. From an expression's syntax a
set of literals is derived of which each match must hold one. One Aho-Corasick
automaton over the literals of all rules reads a text once; an expression is
tried only where one of its literals occurs (or if it has none). Rules are
compiled once per task and reach it with its code, in blocks of bounded size, so
rows and rules never meet in a join and no text is shuffled.

Expressions are Python's with ASCII classes and case (as the JVM has them by
default). A null text matches nothing; a rule that does not compile is an error
that names it; rules of one id are one rule each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the patterns of a block: about 16 MB of automaton and code in a task.
BLOCK = 1 << 20
#: A literal shorter than this occurs nearly everywhere and filters nothing.
SHORT = 2


@dataclass(frozen=True)
class TextRule:
    id: str
    pattern: str
    literal: bool = False


def required_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII strings of which every match of the expression holds at least one; None if there are none."""
    return _required(parser.parse(pattern, re.ASCII))


def _required(items) -> frozenset[str] | None:
    best, run = None, ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= SHORT and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        offer(frozenset([run]) if run else None)
        run = ""
        if kind is op.SUBPATTERN:
            offer(_required(value[3]))
        elif kind is op.ATOMIC_GROUP:
            offer(_required(value))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            offer(_required(value[2]))
        elif kind is op.BRANCH:
            each = [_required(b) for b in value[1]]
            offer(frozenset().union(*each) if all(each) else None)
    offer(frozenset([run]) if run else None)
    return best


class RuleMatcher:
    """Rules compiled together."""

    def __init__(self, rules: Iterable[TextRule]):
        self.rules = list(rules)
        self.always: list[int] = []
        self.tests: list[re.Pattern] = []
        self.automaton = ahocorasick.Automaton()
        by_literal: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            try:
                self.tests.append(re.compile(re.escape(r.pattern) if r.literal else r.pattern, re.ASCII))
            except re.error as e:
                raise ValueError(f"rule {r.id!r}: {e}") from e
            literals = required_literals(re.escape(r.pattern) if r.literal else r.pattern)
            for w in literals or ():
                by_literal.setdefault(w, []).append(i)
            if not literals:
                self.always.append(i)
        for w, at in by_literal.items():
            self.automaton.add_word(w, at)
        if by_literal:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Places of the rules that may match."""
        hits = set(self.always)
        if len(self.automaton):
            for _, at in self.automaton.iter(text.lower()):
                hits.update(at)
        return sorted(hits)

    def first(self, text: str) -> list[tuple[int, int, str]]:
        """(rule, position from 1, matched string) of the first match of every rule that matches."""
        found = ((i, self.tests[i].search(text)) for i in self.candidates(text))
        return [(i, m.start() + 1, m.group()) for i, m in found if m]

    def every(self, text: str) -> list[tuple[int, int, str]]:
        """The same for all matches."""
        return [(i, m.start() + 1, m.group()) for i in self.candidates(text) for m in self.tests[i].finditer(text)]


def blocks(rules: Iterable[TextRule], size: int = BLOCK) -> Iterable[list[TextRule]]:
    part, used = [], 0
    for r in rules:
        if part and used + len(r.pattern) > size:
            yield part
            part, used = [], 0
        part.append(r)
        used += len(r.pattern)
    if part:
        yield part


def match_rules(df: DataFrame, text: str, rules: Iterable[TextRule], every: bool = False, block: int = BLOCK) -> DataFrame:
    """The other columns of ``df`` with (rule_id, position, matched): a row per rule that matches, or per match.

    A batch matches equal texts once.
    """
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept, F.lit("").alias("rule_id"), F.lit(0).alias("position"), F.lit("").alias("matched")).schema

    def run(part: list[TextRule]):
        def find(batches):
            matcher = RuleMatcher(part)
            test = matcher.every if every else matcher.first
            for batch in batches:
                known: dict[str, list] = {}
                rows, hits = [], []
                for row, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    if t is not None:
                        if t not in known:
                            known[t] = test(t)
                        rows += [row] * len(known[t])
                        hits += known[t]
                columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
                columns += [
                    pa.array([part[i].id for i, _, _ in hits], pa.string()), pa.array([p for _, p, _ in hits], pa.int32()),
                    pa.array([m for _, _, m in hits], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "rule_id", "position", "matched"])

        return find

    source = df.select(*kept, F.col(text).alias("_text"))
    frames = [source.mapInArrow(run(part), schema) for part in blocks(rules, block)] or [df.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, frames)
