"""Secret scan: fixed patterns, and formats learned from them as probabilistic automata."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import with_text_columns
from millrace.session import ship

# Base patterns and least lengths: fixed values of the query's definition.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex")
FORMAT = "format"  # the kind of spans that only a learned format finds
ORDINARY = ""

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# A run of digits alone is a number, one of letters alone a word.
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
LONG_WORD = re.compile(r"[^\x20\x09-\x0D]{12,}")

SAMPLE = 1_000  # strings of each kind that the automata are fitted on: those of the least hash
SAMPLE_CHARS = 128  # longer strings are not fitted on
ALPHA = 0.05  # of the Hoeffding test that lets two states merge
MIN_GAIN = 0.25  # log-likelihood a character that a credential's format must gain over ordinary text
LOW_SHARE = 0.01  # share of the fitted credentials that may score below a format's threshold


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the fixed patterns, by start and kind; ends are exclusive."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: counts of visits, ends and symbols by state."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, int]] = field(default_factory=lambda: [{}])
    counts: list[dict[str, int]] = field(default_factory=lambda: [{}])
    alphabet: int = 96
    floor: float = -math.inf

    def add(self, value: str) -> None:
        """One more path of the prefix tree."""
        state = 0
        self.visits[0] += 1
        for c in value:
            if c not in self.moves[state]:
                self.moves[state][c] = len(self.visits)
                self.visits.append(0)
                self.ends.append(0)
                self.moves.append({})
                self.counts.append({})
            self.counts[state][c] = self.counts[state].get(c, 0) + 1
            state = self.moves[state][c]
            self.visits[state] += 1
        self.ends[state] += 1

    def _alike(self, a: int, b: int) -> bool:
        """Whether no statistic of two states, nor of those they lead to, differs by more than chance."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            bound = (math.sqrt(1 / n) + math.sqrt(1 / m)) * math.sqrt(0.5 * math.log(2 / ALPHA))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.counts[a].keys() | self.counts[b].keys():
                if abs(self.counts[a].get(c, 0) / n - self.counts[b].get(c, 0) / m) > bound:
                    return False
            todo += [(self.moves[a][c], self.moves[b][c]) for c in self.moves[b] if c in self.moves[a]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree ``tree`` to state ``into`` and whatever that leads to."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.counts[b].items():
                self.counts[a][c] = self.counts[a].get(c, 0) + n
                if c in self.moves[a]:
                    todo.append((self.moves[a][c], self.moves[b][c]))
                else:
                    self.moves[a][c] = self.moves[b][c]

    def merged(self) -> Automaton:
        """The automaton after merging compatible states in the order of the tree's breadth."""
        red = [0]
        while True:
            inside = set(red)
            blue = next(((s, c, t) for s in red for c, t in sorted(self.moves[s].items()) if t not in inside), None)
            if blue is None:
                return self
            source, symbol, state = blue
            twin = next((r for r in red if self._alike(r, state)), None)
            if twin is None:
                red.append(state)
            else:
                self.moves[source][symbol] = twin
                self._fold(twin, state)

    def score(self, value: str) -> float:
        """Log-likelihood a character, ends included, with add-half smoothing; unknown paths go on at the start."""
        state, total = 0, 0.0
        for c in value:
            total += math.log((self.counts[state].get(c, 0) + 0.5) / (self.visits[state] + 0.5 * self.alphabet))
            state = self.moves[state].get(c, 0)
        total += math.log((self.ends[state] + 0.5) / (self.visits[state] + 0.5 * self.alphabet))
        return total / (len(value) + 1)


def infer(values: list[str]) -> Automaton:
    """Grammar inference from examples: prefix tree, then merging."""
    made = Automaton()
    for v in sorted(values):
        made.add(v)
    made = made.merged()
    scores = sorted(made.score(v) for v in values)
    made.floor = scores[int(LOW_SHARE * len(scores))] if scores else math.inf
    return made


def _labelled(text: str):
    """Strings to learn from: secrets by kind, and long words that are none of them."""
    spans = base_spans(text)
    for kind, _, _, value in spans:
        yield kind, value
    ends = [(s, e) for _, s, e, _ in spans]
    for m in LONG_WORD.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in ends):
            yield ORDINARY, m[0]


def fit_formats(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton for each kind of credential found by the fixed patterns, and one for ordinary long words.

    All texts are read. Of each kind the ``sample`` different strings of the least hash are fitted on, which is
    the same set for any partitioning: each task passes on no more than its own least ones.
    """

    def least(batches):
        kept: dict[str, list] = defaultdict(list)  # heaps, the greatest hash on top
        have: dict[str, set] = defaultdict(set)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for kind, s in _labelled(value or ""):
                    if len(s) > SAMPLE_CHARS or s in have[kind]:
                        continue
                    item = (-zlib.crc32(s.encode()), s)
                    if len(kept[kind]) < sample:
                        heapq.heappush(kept[kind], item)
                    elif item > kept[kind][0]:
                        have[kind].discard(heapq.heapreplace(kept[kind], item)[1])
                    else:
                        continue
                    have[kind].add(s)
        rows = [(kind, -h, s) for kind, items in kept.items() for h, s in items]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
            names=["kind", "hash", "value"],
        )

    ship(docs.sparkSession)
    found = docs.select(text).mapInArrow(least, "kind string, hash long, value string").distinct()
    # Equal hashes: the greater string goes first, as in the tasks' heaps.
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("hash", F.desc("value")))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= sample).collect()
    by_kind = defaultdict(list)
    for r in rows:
        by_kind[r["kind"]].append(r["value"])
    return {kind: infer(values) for kind, values in sorted(by_kind.items())}


def format_spans(text: str, base: list[tuple[str, int, int, str]], formats: dict[str, Automaton]) -> list[tuple[str, int, int, str]]:
    """Candidates outside the base spans that some credential's automaton explains, and better than ordinary text's."""
    out = []
    ordinary = formats.get(ORDINARY)
    kinds = [a for k, a in formats.items() if k != ORDINARY]
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if not kinds or not DIGIT.search(value) or not LETTER.search(value):
            continue
        if any(s < m.end() and m.start() < e for _, s, e, _ in base):
            continue
        usual = ordinary.score(value) if ordinary else -math.log(96)
        if any((score := a.score(value)) >= a.floor and score - usual >= MIN_GAIN for a in kinds):
            out.append((FORMAT, m.start(), m.end(), value))
    return out


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan_secrets(docs: DataFrame, formats: dict[str, Automaton], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secret_spans``: (kind, start, end) by start, then kind in order of ``KINDS``; code points, ends exclusive.

    Spans of the fixed patterns may overlap those of another kind; spans of a learned ``format`` never overlap them.
    Null and empty texts have none. Whole texts are read, row by row; repeated rows, null ids and extra columns
    pass through.
    """

    def make():
        def one(value):
            base = base_spans(value or "")
            spans = base + format_spans(value or "", base, formats)
            return ([{"kind": k, "start": s, "end": e} for k, s, e, _ in sorted(spans, key=lambda x: (x[1], (*KINDS, FORMAT).index(x[0])))],)

        return one

    return with_text_columns(docs, text, make, T.StructType([T.StructField("secret_spans", SPANS)]), keep_text)


def redact_secrets(docs: DataFrame, formats: dict[str, Automaton], text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; spans that touch or overlap get one mark.

    Other texts stay as they are, null ones null.
    """

    def make():
        def one(value):
            if not value:
                return (value,)
            base = base_spans(value)
            spans = sorted((s, e) for _, s, e, _ in base + format_spans(value, base, formats))
            out, at = [], 0
            for start, end in spans:
                if start > at or not out:
                    out += [value[at:start], mark]
                at = max(at, end)
            return ("".join([*out, value[at:]]),)

        return one

    order = docs.columns
    return with_text_columns(docs, text, make, T.StructType([T.StructField(text, T.StringType())])).select(*order)
