"""Secret scans: fixed patterns, and formats learned by grammar inference.

The values that the fixed patterns find in a bounded sample of texts are the
labelled credentials. Of each kind a prefix tree of character classes is grown,
and states whose futures are statistically alike (Hoeffding's bound on the
share of endings and of each symbol) are merged, as in ALERGIA (Carrasco and
Oncina 1994), into a probabilistic automaton. A candidate's format likelihood
is its mean log-probability in the best of these automata less that in an automaton
of ordinary long tokens; every candidate is scored, and those above a threshold
are secrets too. Ordinary tokens that are kept from the fit set the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fill

#: The kinds in their order; the last is that of the learned formats.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Texts that the labelled sample is taken from, and values of each kind, at most.
SAMPLE_TEXTS, SAMPLE_VALUES = 4000, 2000
#: Ordinary tokens in the sample of one text, at most.
ORDINARY_EACH = 20
#: How sure a difference between two states must be to keep them apart.
ALPHA = 0.05
#: The share of ordinary tokens, kept from the fit, that may reach the threshold, and the least threshold: mean log-odds
#: for each character.
FALSE_RATE, LEAST_ODDS = 0.001, 0.25
#: Ordinary tokens are fitted without those as likely in an automaton of credentials as all but this share of its own:
#: they are credentials that nothing assigns.
ATYPICAL = 0.05
#: One ordinary token in so many, by a hash, is kept from the fit and sets the threshold.
KEPT_BACK = 4


def symbol(char: str) -> int:
    """The class of a character: digit, a-f, g-z, A-F, G-Z, other."""
    if "0" <= char <= "9":
        return 0
    if "a" <= char <= "z":
        return 1 if char <= "f" else 2
    if "A" <= char <= "Z":
        return 3 if char <= "F" else 4
    return 5


SYMBOLS = 6
OF = {chr(c): symbol(chr(c)) for c in range(128)}


@dataclass
class State:
    count: int = 0
    ends: int = 0
    edges: dict[int, int] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))


def prefix_tree(words: Iterable[str]) -> list[State]:
    states = [State()]
    for word in words:
        at = 0
        states[0].count += 1
        for char in word:
            s = OF.get(char, 5)
            states[at].used[s] += 1
            if s not in states[at].edges:
                states[at].edges[s] = len(states)
                states.append(State())
            at = states[at].edges[s]
            states[at].count += 1
        states[at].ends += 1
    return states


def _apart(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) > bound


class Automaton:
    """A probabilistic automaton: from each state, the next one and a log-probability for each class."""

    def __init__(self, words: Iterable[str], alpha: float = ALPHA):
        self.states = prefix_tree(words)
        self._infer(alpha)
        self._compile()

    def _alike(self, p: int, q: int, alpha: float) -> bool:
        """Whether the futures of two states are compatible, as far as both go."""
        stack = [(p, q)]
        while stack:
            a, b = (self.states[i] for i in stack.pop())
            if _apart(a.ends, a.count, b.ends, b.count, alpha):
                return False
            for s in a.edges.keys() | b.edges.keys():
                if _apart(a.used.get(s, 0), a.count, b.used.get(s, 0), b.count, alpha):
                    return False
                if s in a.edges and s in b.edges:
                    stack.append((a.edges[s], b.edges[s]))
        return True

    def _merge(self, parent: int, s: int, into: int) -> None:
        """Leads the parent's edge to `into` and folds the subtree that it led to into it."""
        gone = self.states[parent].edges[s]
        self.states[parent].edges[s] = into
        stack = [(into, gone)]
        while stack:
            a, b = (self.states[i] for i in stack.pop())
            a.count += b.count
            a.ends += b.ends
            for e, n in b.used.items():
                a.used[e] += n
            for e, target in b.edges.items():
                if e in a.edges:
                    stack.append((a.edges[e], target))
                else:
                    a.edges[e] = target

    def _infer(self, alpha: float) -> None:
        """Red states are settled; each blue one, a child of a red, joins the first compatible red or becomes one."""
        red = [0]
        while True:
            blue = [(p, s, t) for p in red for s, t in sorted(self.states[p].edges.items()) if t not in red]
            if not blue:
                break
            parent, s, target = max(blue, key=lambda x: (self.states[x[2]].count, -x[2]))
            for r in red:
                if self._alike(r, target, alpha):
                    self._merge(parent, s, r)
                    break
            else:
                red.append(target)
        self.red = red

    def _compile(self) -> None:
        place = {old: new for new, old in enumerate(self.red)}
        self.next: list[list[int]] = []
        self.log: list[list[float]] = []
        for old in self.red:
            state = self.states[old]
            total = sum(state.used.values()) + state.ends + 0.5 * (SYMBOLS + 1)
            self.next.append([place.get(state.edges.get(s), -1) for s in range(SYMBOLS)])
            self.log.append([math.log((state.used.get(s, 0) + 0.5) / total) for s in range(SYMBOLS)])
        del self.states

    def likelihood(self, word: str) -> float:
        """The mean log-probability of a word's characters; what leaves the automaton is as likely as chance."""
        at, total = 0, 0.0
        for char in word:
            s = OF.get(char, 5)
            if at < 0:
                total += -math.log(SYMBOLS) - 1
                continue
            total += self.log[at][s]
            at = self.next[at][s]
        return total / max(1, len(word))


@dataclass
class Formats:
    """Automata of credentials, that of ordinary tokens, and the log-odds that a secret must reach."""

    secrets: list[Automaton]
    ordinary: Automaton
    threshold: float

    def odds(self, word: str) -> float:
        return max(a.likelihood(word) for a in self.secrets) - self.ordinary.likelihood(word)

    def is_secret(self, word: str) -> bool:
        """Whether a token has a credential's format; tokens of letters alone never have."""
        return _mixed(word) and self.odds(word) >= self.threshold


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind; whole matches in code points."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    found.sort()
    return found


def learned_spans(text: str, formats: Formats | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates with a credential's format that touch no span of base."""
    if formats is None:
        return []
    found, i = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][2] <= a:
            i += 1
        if any(s < b and e > a for s, _, e in base[i : i + 8]) or not formats.is_secret(m[0]):
            continue
        found.append((a, 3, b))
    return found


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def value_of(text: str, span: tuple[int, int, int]) -> str:
    """The credential in a span: what is assigned, or all of it."""
    start, kind, end = span
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def labelled_values(text: str, ordinary_each: int = ORDINARY_EACH) -> list[tuple[str, str]]:
    """(kind, token) of a text: credentials by the pattern that found them, and ordinary long tokens."""
    base = base_spans(text)
    out = []
    for span in base:
        k, value = span[1], value_of(text, span)
        if k == 0 and len(value) < 12:
            continue  # short values have no format
        out.append((KINDS[k], value))
    n = 0
    for m in CANDIDATE.finditer(text):
        if n == ordinary_each:
            break
        if not any(s < m.end() and e > m.start() for s, _, e in base):
            out.append(("ordinary", m[0]))
            n += 1
    return out


def _mixed(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


def infer(labelled: Iterable[tuple[str, str]], *, values: int = SAMPLE_VALUES, false_rate: float = FALSE_RATE) -> Formats | None:
    """Formats from (kind, token) pairs, of each kind at most `values`, chosen by a hash; None where there is no credential or no ordinary token.

    Tokens that no pattern covers may still be credentials: those of letters and
    digits that are as likely in an automaton of credentials as its own are left out of the
    ordinary ones. The threshold is what a share `false_rate` of the ordinary
    tokens of letters and digits that are kept from the fit would reach.
    """
    by: dict[str, set[str]] = defaultdict(set)
    for kind, word in labelled:
        by[kind].add(word)
    shuffled = lambda words: sorted(words, key=lambda w: hashlib.md5(w.encode()).digest())[:values]
    ordinary = shuffled(by.pop("ordinary", ()))
    kinds = {k: shuffled(v) for k, v in sorted(by.items())}
    if not kinds or not ordinary:
        return None
    automata = [Automaton(v) for v in kinds.values()]
    typical = [sorted(map(a.likelihood, v))[int(len(v) * ATYPICAL)] for a, v in zip(automata, kinds.values(), strict=True)]
    foreign = lambda w: _mixed(w) and any(a.likelihood(w) >= t for a, t in zip(automata, typical, strict=True))
    own = [w for w in ordinary if not foreign(w)] or ordinary
    formats = Formats(automata, Automaton([w for i, w in enumerate(own) if i % KEPT_BACK] or own), -math.inf)
    odds = sorted(formats.odds(w) for w in own[::KEPT_BACK] if _mixed(w))
    reached = odds[max(0, math.ceil(len(odds) * (1 - false_rate)) - 1)] if odds else 0.0
    formats.threshold = max(LEAST_ODDS, reached + 1e-9)
    return formats


def fit_formats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS, values: int = SAMPLE_VALUES, ordinary_each: int = ORDINARY_EACH) -> Formats | None:
    """Formats from the base matches and ordinary tokens of at most `texts` documents, `values` of a kind and ordinary_each of a text.

    Half of them are chosen among those with a likely match and half among all, by a hash of the id.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    hit = F.col("_text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")

    def chosen(part: DataFrame) -> DataFrame:
        return part.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(texts // 2)

    ids = chosen(rows).union(chosen(rows.where(hit))).distinct()
    both = rows.join(F.broadcast(ids), "_id")  # at most `texts` ids

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for t in batch.column(0).to_pylist() for p in sorted(set(labelled_values(t, ordinary_each)))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], names=["kind", "word"])

    got = both.select("_text").mapInArrow(gather, "kind string, word string").distinct()
    return infer(((r.kind, r.word) for r in got.toLocalIterator()), values=values)


def scan(docs: DataFrame, formats: Formats | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_learned, base_spans, spans, odds) for each row of docs.

    Every candidate is scored, those of the fixed patterns too: odds lists, span
    by span, the format's mean log-odds for each character (nothing without formats).

    Spans are kind:start:end of whole matches in code points, end exclusive,
    by start, then kind, joined by commas. Null texts count as empty and have
    none; texts of any length are read whole; repeated rows each get theirs.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_text, all_text, odds = [], [], []
            for text in fill(batch.column(1)):
                text = text.as_py()
                base = base_spans(text)
                every = sorted([*base, *learned_spans(text, formats, base)])
                for k in range(4):
                    counts[k].append(sum(1 for x in every if x[1] == k))
                base_text.append(text_of(base))
                all_text.append(text_of(every))
                odds.append(",".join(f"{formats.odds(value_of(text, x)):.3f}" for x in every) if formats else "")
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (base_text, all_text, odds))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base_spans", "spans", "odds"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        find, "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_spans string, spans string, odds string"
    )


def mask(docs: DataFrame, formats: Formats | None, *, text_col: str = "text", with_: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced; spans that touch are replaced as one. Null texts stay null."""
    at = docs.columns.index(text_col)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                base = base_spans(text)
                parts, end = [], 0
                for a, _, b in sorted([*base, *learned_spans(text, formats, base)]):
                    if a >= end:
                        parts += [text[end:a], with_]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(cover, docs.schema)
