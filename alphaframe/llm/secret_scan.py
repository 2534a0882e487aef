"""Secret scans: fixed patterns, and automata inferred from the credentials that they find.

The patterns label credentials. From a bounded sample of all their forms, a probabilistic automaton is
inferred for each kind: the prefix tree of the credentials' character classes, whose states are merged where
their outgoing and ending frequencies agree within a confidence bound. Every other long token of
every text is then scored: its likelihood under the best automaton against its likelihood as an
ordinary token.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored

KINDS = ("assign", "access", "hex")
ADDED = "format"
SLICE = 512
# The patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")  # no labelled credential is shorter
CUTS, MARKS = re.compile(r"[=/.]"), "=./_-"
REMEMBERED = 1 << 16
SHAPE_MOST, GOES_ON = 256, "\n"  # a longer shape is cut there and marked as going on

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed; code points, end exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of 32 or more is a whole run, so asking for the length at once gives the same spans.
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def value_of(text: str, span: Span) -> str:
    kind, a, b = span
    return ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _classes() -> dict[int, str]:
    """A character's class: hex or other letter by case, digit, or the mark itself."""
    groups = {"a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}
    return {ord(c): k for k, chars in groups.items() for c in chars}


CLASS_OF = _classes()
FLOOR = 1e-5
LOG_FLOOR = math.log(FLOOR)


@dataclass
class Automaton:
    """log probabilities: by state, of ending and of each class with the next state."""

    ends: list[float]
    steps: list[dict[str, tuple[float, int]]]

    def __post_init__(self) -> None:
        self.likeliest = [max(x.values(), default=(0.0, k))[1] for k, x in enumerate(self.steps)]

    def log_likelihood(self, shape: str) -> float:
        total, state = 0.0, 0
        for c in shape:
            step = self.steps[state].get(c)
            if step is None:
                # A class not seen here stands in for the likeliest one.
                total += LOG_FLOOR
                state = self.likeliest[state]
            else:
                total += step[0]
                state = step[1]
        return total + self.ends[state]


def infer(shapes: Counter[str], alpha: float = 0.05) -> Automaton:
    """Merge states of the prefix tree, in breadth-first order, where frequencies are compatible.

    Two states are compatible if their ending frequency and that of each class differ by less than
    the Hoeffding bound at ``alpha``, and so do the states behind them. What stands behind a cut is taken
    to go on like what stands before.
    """
    # By state: how many come, how many end, and by class how many go on and where to.
    count, end, flow, step = [0], [0], [Counter()], [{}]
    for shape, n in sorted(shapes.items()):
        s, cut = 0, shape.endswith(GOES_ON)
        count[0] += n
        for k, c in enumerate(shape := shape.rstrip(GOES_ON), 1):
            if c not in step[s]:
                step[s][c] = len(count)
                count.append(0), end.append(0), flow.append(Counter()), step.append({})
            flow[s][c] += n
            s = step[s][c]
            count[s] += n if k < len(shape) or not cut else 0
        end[s] += 0 if cut else n
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            if not count[a] or not count[b]:
                continue
            if differ(end[a], count[a], end[b], count[b]) or any(
                    differ(flow[a][c], count[a], flow[b][c], count[b]) for c in step[a].keys() | step[b].keys()):
                return False
            work += [(step[a][c], y) for c, y in step[b].items() if c in step[a]]
        return True

    def fold(a: int, b: int) -> None:
        """Add the subtree of ``b``, still a tree, to ``a``, which may lie on loops."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            count[a] += count[b]
            end[a] += end[b]
            flow[a].update(flow[b])
            for c, y in step[b].items():
                if c in step[a]:
                    work.append((step[a][c], y))
                else:
                    step[a][c] = y

    settled, done = [0], {0}
    while edge := next(((r, c) for r in settled for c in sorted(step[r]) if step[r][c] not in done), None):
        parent, c = edge
        s = step[parent][c]
        target = next((r for r in settled if compatible(r, s)), None) if count[s] else parent
        if target is None:
            settled.append(s)
            done.add(s)
        else:
            step[parent][c] = target
            fold(target, s)
    number = {s: k for k, s in enumerate(settled)}
    return Automaton(
        [math.log(end[s] / count[s]) if end[s] else math.log(FLOOR) for s in settled],
        [{c: (math.log(flow[s][c] / count[s]), number[t]) for c, t in step[s].items()} for s in settled])


@dataclass
class Ordinary:
    """A smoothed model of ordinary tokens: each class given the one before."""

    pairs: dict[str, float]
    rest: float

    def log_likelihood(self, shape: str) -> float:
        return sum(self.pairs.get(a + b, self.rest) for a, b in zip("^" + shape, shape + "$"))


def ordinary(shapes: Counter[str]) -> Ordinary:
    pairs, firsts = Counter(), Counter()
    for shape, n in shapes.items():
        for a, b in zip("^" + shape, shape + "$"):
            pairs[a + b] += n
            firsts[a] += n
    kinds = len(set("".join(shapes))) + 2
    return Ordinary({p: math.log((n + 0.5) / (firsts[p[0]] + 0.5 * kinds)) for p, n in pairs.items()}, math.log(FLOOR))


def outside(a: int, b: int, base: list[Span]) -> list[tuple[int, int]]:
    """What of a run lies outside the base spans, which come by start."""
    out = []
    for _, x, y in base:
        if x < b and a < y:
            if a < x:
                out.append((a, x))
            a = max(a, y)
    return [*out, (a, b)] if a < b else out


def parts(text: str, a: int, b: int, least: int, most: int) -> set[tuple[int, int]]:
    """Candidates of a run: the whole, what lies between its cuts, and joined neighbours of those.

    Neighbours are joined up to ``most`` characters, and up to the next ``=`` in any case. Each is taken as it
    stands and without the marks at either end or both, if ``least`` characters are left.
    """
    cuts = [a, *(m.end() for m in CUTS.finditer(text, a, b)), b + 1]
    ranges = {(a, b)}
    if len(cuts) > 2:
        for i, x in enumerate(cuts[:-1]):
            for j in range(i + 1, len(cuts)):
                if j > i + 1 and cuts[j] - 1 - x > most:
                    break
                ranges.add((x, cuts[j] - 1))
        equals = [a, *(c for c in cuts[1:-1] if text[c - 1] == "="), b + 1]
        ranges.update((x, y - 1) for x, y in zip(equals, equals[1:]))
    out = set()
    for x, y in ranges:
        if y - x >= least:
            piece = text[x:y]
            low, high = y - len(piece.lstrip(MARKS)), x + len(piece.rstrip(MARKS))
            out.update((c, d) for c, d in ((x, y), (low, y), (x, high), (low, high)) if d - c >= least)
    return out


@dataclass
class Formats:
    automata: dict[str, Automaton]
    plain: Ordinary | None
    least: float
    shortest: int = ASSIGN_LEAST  # of the learned credentials
    longest: int = 256

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def score(self, token: str) -> float:
        """log of how much likelier the token is as a credential than as an ordinary token, which marks at its ends are no part of."""
        if not self.automata or self.plain is None:
            return -math.inf
        shape = token.translate(CLASS_OF)
        got = self.known.get(shape)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = max(a.log_likelihood(shape) for a in self.automata.values()) - self.plain.log_likelihood(shape.strip(MARKS))
            if len(shape) <= 64:
                self.known[shape] = got
        return got

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and with them the candidates of credential format outside of them, best first."""
        base = base_spans(text)
        added = []
        for m in RUN.finditer(text) if self.automata else ():
            for a, b in outside(*m.span(), base):
                if b - a < self.shortest:
                    continue
                good = [(-s, x, y) for x, y in parts(text, a, b, self.shortest, self.longest) if (s := self.score(text[x:y])) >= self.least]
                taken: list[tuple[int, int]] = []
                for _, x, y in sorted(good):
                    if not any(c < y and x < d for c, d in taken):
                        taken.append((x, y))
                added += [(ADDED, x, y) for x, y in taken]
        return base, sorted(base + added, key=lambda s: (s[1], (*KINDS, ADDED).index(s[0])))


def shape_of(token: str) -> str:
    return token[:SHAPE_MOST].translate(CLASS_OF) + GOES_ON * (len(token) > SHAPE_MOST)


def form_of(shape: str) -> str:
    return f"{len(shape)} {''.join(sorted(set(shape)))}"


def train_rows(texts: list[str], ordinary_too: list[bool]) -> Iterator[tuple[str, str]]:
    """Kind and shape of each credential, and where asked for of each ordinary token (kind ``plain``)."""
    for text, too in zip(texts, ordinary_too):
        base = base_spans(text)
        for s in base:
            yield s[0], shape_of(value_of(text, s))
        for m in RUN.finditer(text) if too else ():
            if not any(x < m.end() and m.start() < y for _, x, y in base):
                yield "plain", m[0][:SHAPE_MOST].translate(CLASS_OF)


def learn(
    docs: DataFrame, *, train_docs: int = 20_000, per_kind: int = 1000, alpha: float = 0.05, least: float = 20.0, per_form: int = 20,
) -> Formats:
    """Infer the automata from the credentials of all documents.

    Of each kind the ``per_kind`` most frequent shapes are used with their counts, and of each form (a length and a set
    of classes) about ``per_form`` more, which stand for all of that form. Ordinary tokens are those of about
    ``train_docs`` documents, taken by a hash of their id, the most frequent twenty times ``per_kind`` shapes.
    """
    n = docs.count()
    sampled = F.xxhash64("doc_id").cast("double") / F.lit(2.0 ** 64) + 0.5 <= F.lit(min(1.0, train_docs / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = Counter(train_rows([t or "" for t in part.column("text").to_pylist()], part.column("sampled").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in got], pa.string()), pa.array([form_of(s) for _, s in got], pa.string()),
                     pa.array([s for _, s in got], pa.string()), pa.array(got.values(), pa.int64())], names=["kind", "form", "shape", "n"])

    shapes = stored(
        docs.select("text", sampled.alias("sampled")).mapInArrow(run, "kind string, form string, shape string, n long")
        .groupBy("kind", "form", "shape").agg(F.sum("n").alias("n")))
    found: dict[str, Counter[str]] = defaultdict(Counter)
    for kind, most in [*((k, per_kind) for k in KINDS), ("plain", 20 * per_kind)]:
        for r in shapes.where(F.col("kind") == kind).orderBy(F.desc("n"), "shape").limit(most).collect():
            found[kind][r["shape"]] = r["n"]
    # Of a form with many shapes those below a share of the hash range, a few more than are kept.
    forms = shapes.where("kind <> 'plain'").groupBy("kind", "form").agg(F.count("*").alias("shapes"), F.sum("n").alias("total"))
    order = F.xxhash64("shape")
    share = F.lit(2.0 * per_form + 20) / F.col("shapes")
    few = shapes.join(forms, ["kind", "form"]).where(order.cast("double") / F.lit(2.0 ** 64) + 0.5 <= share)
    by_form: dict[tuple[str, str], list] = defaultdict(list)
    for r in few.select("kind", "form", "shape", "n", "total", order.alias("at")).collect():
        by_form[r["kind"], r["form"]].append(r)
    covered: Counter[tuple[str, str]] = Counter()
    for k in KINDS:
        for s, c in found[k].items():
            covered[k, form_of(s)] += c
    for (kind, form), rows in sorted(by_form.items()):
        more = [r for r in sorted(rows, key=lambda r: (r["at"], r["shape"])) if r["shape"] not in found[kind]][:per_form]
        times = (rows[0]["total"] - covered[kind, form]) / max(1, sum(r["n"] for r in more))
        found[kind].update({r["shape"]: max(1, round(r["n"] * times)) for r in more})
    plain = ordinary(found["plain"]) if found["plain"] else ordinary(Counter({"g" * 8: 1}))
    sizes = [len(x) for k in KINDS for x in found[k]] or [ASSIGN_LEAST]
    return Formats({k: infer(found[k], alpha) for k in KINDS if found[k]}, plain, least, min(sizes), max(sizes))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", formats: Formats | None = None, **training) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, end in code points).

    ``base`` has the spans of the fixed patterns, ``spans`` has those and the added ones of kind
    ``format``. A null text counts as empty. Texts are scanned whole. Rows that repeat give repeated results, null
    ids are passed on; where no credential can be learned from, nothing is added. Further columns are ignored.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    model = formats or learn(rows, **training)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def shown(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                both = [model.spans(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([shown(x[k]) for x in both], pa.list_(kind)) for k in (0, 1))],
                    names=["doc_id", "base", "spans"])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {id_kind}, base {span}, spans {span}")


def mask(text: str, spans: list[Span], mark: str) -> str:
    """The text with ``mark`` in place of each run of overlapping spans."""
    out, end = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def masked(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]",
    formats: Formats | None = None, **training,
) -> DataFrame:
    """All rows and columns, with the secrets masked and the length (if there is such a column) that of the new text.

    A null text stays null, and so does its length.
    """
    model = formats or learn(only(docs, doc_id=id_col, text=text_col), **training)
    place, length = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = list(part.columns)
                texts = [None if t is None else mask(t, model.spans(t)[1], mark) for t in columns[place].to_pylist()]
                columns[place] = pa.array(texts, pa.string())
                if length is not None:
                    columns[length] = pa.array([None if t is None else len(t) for t in texts], columns[length].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)
