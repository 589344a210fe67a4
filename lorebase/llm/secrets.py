"""Secret scans: fixed patterns, and formats learned by grammar inference."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Kinds in the order of listing; the last is what the automata add.
KINDS = ("assign", "access", "hex", "format")
TOKEN = "A-Za-z0-9+/_.=-"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Labelled credentials of a kind that an automaton is fitted on, at most (the lowest
#: by hash), and their most characters.
EXAMPLES, LONGEST = 400, 256
#: The share of held-out examples that a threshold may miss.
MISSED = 0.02
#: Log2 probability of a step that no example took.
UNSEEN = -14.0
#: Distinct runs of token characters whose verdicts a worker remembers before it starts afresh.
REMEMBERED = 50_000

_either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_key"))
ASSIGN = re.compile(rf"({_either.replace('_', '_?')})[\"']?\x20*[:=]\x20*[\"']?([{TOKEN}]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LONG_RUN = re.compile(rf"[{TOKEN}]{{24,}}")
#: A candidate begins and ends at an end of a run or beside one of these.
EDGES = frozenset("+/_.=-")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the fixed patterns, each kind's
    leftmost matches that do not overlap, without those too short."""
    out, low = [], text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    for run in LONG_RUN.finditer(text):
        out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text, run.start(), run.end())]
    return out


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


#: Character classes: how many characters each stands for.
CLASSES = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_CLASS = {c: "0" if c.isdigit() else ("a" if c <= "f" else "g") if c.islower() else ("A" if c <= "F" else "G") for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Symbols of an automaton's step: the classes, the six other token characters and the end, with half a count each.
ALPHABET, HALF = 12, 0.5


def classes(token: str) -> list[str]:
    """Each character's class: digit, a-f, g-z, A-F, G-Z, or itself."""
    return [_CLASS.get(c, c) for c in token]


def evidence(counts: Iterable[int]) -> float:
    """Log probability of a state's steps, whatever their distribution (Dirichlet
    with half a count per symbol)."""
    n, out = 0, 0.0
    for c in counts:
        n += c
        out += math.lgamma(HALF + c) - math.lgamma(HALF)
    return out + math.lgamma(ALPHABET * HALF) - math.lgamma(ALPHABET * HALF + n)


class State:
    def __init__(self) -> None:
        self.ends = 0
        self.steps: dict[str, int] = {}
        self.next: dict[str, State] = {}
        self.letters: dict[str, int] = {}

    def visits(self) -> int:
        return self.ends + sum(self.steps.values())


class Automaton:
    """A probabilistic deterministic automaton over character classes, with the
    letters that its states saw.

    It begins as the prefix tree of the examples. States of one depth are then
    merged where that is likelier than two distributions: where the evidence of
    their merged steps, and of those of all states that follow both, exceeds the
    evidence of each apart. States of different depths stay apart, so the
    automaton keeps positions and lengths, and a state seen once, too weak to
    differ, joins the one that it fits best.
    """

    def __init__(self, examples: Sequence[str]) -> None:
        self.root = State()
        for x in examples:
            s = self.root
            for c, k in zip(x, classes(x), strict=True):
                s.steps[k] = s.steps.get(k, 0) + 1
                s.letters[c] = s.letters.get(c, 0) + 1
                s = s.next.setdefault(k, State())
            s.ends += 1
        self.levels = [[self.root]]
        while level := self._merged(self.levels[-1]):
            self.levels.append(level)

    def _merged(self, above: list[State]) -> list[State]:
        """The states below, merged: the most seen first, each with the best that stays."""
        kept: list[State] = []
        below = [(s, k) for s in above for k in sorted(s.next)]
        for s, k in sorted(below, key=lambda x: -x[0].next[x[1]].visits()):
            one = s.next[k]
            best = max(((self.gain(r, one), -i) for i, r in enumerate(kept)), default=(0.0, 0))
            if best[0] > 0:
                self.fold(kept[-best[1]], one)
                s.next[k] = kept[-best[1]]
            else:
                kept.append(one)
        return kept

    @staticmethod
    def gain(a: State, b: State) -> float:
        """How much likelier one distribution is than two, for both states and those that follow."""
        out, todo = 0.0, [(a, b)]
        while todo:
            a, b = todo.pop()
            both = {k: a.steps.get(k, 0) + b.steps.get(k, 0) for k in {*a.steps, *b.steps}}
            out += evidence([a.ends + b.ends, *both.values()]) - evidence([a.ends, *a.steps.values()]) - evidence([b.ends, *b.steps.values()])
            todo += [(a.next[k], b.next[k]) for k in a.next if k in b.next]
        return out

    @staticmethod
    def fold(a: State, b: State) -> None:
        """Adds the tree at b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            a.ends += b.ends
            for mine, more in ((a.steps, b.steps), (a.letters, b.letters)):
                for k, n in more.items():
                    mine[k] = mine.get(k, 0) + n
            for k, t in b.next.items():
                if k in a.next:
                    todo.append((a.next[k], t))
                else:
                    a.next[k] = t

    def tables(self) -> list[tuple[float | None, dict[str, tuple[float, int]]]]:
        """Per state the log2 probability of its end and, by character, that of the
        step with the state that it leads to: of the class among the state's
        steps, and of the character within its class (one more count each)."""
        number = {id(s): i for i, s in enumerate(x for level in self.levels for x in level)}
        out = []
        for level in self.levels:
            for s in level:
                n, steps = s.visits(), {}
                for c in [*_CLASS, *EDGES]:
                    k = _CLASS.get(c, c)
                    if k in s.next:
                        steps[c] = (math.log2(s.steps[k] / n) + math.log2((s.letters.get(c, 0) + 1) / (s.steps[k] + CLASSES.get(k, 1))), number[id(s.next[k])])
                out.append((math.log2(s.ends / n) if s.ends else None, steps))
        return out


def score(tables: list, token: str) -> float:
    """Mean log2 probability of the token's characters and its end."""
    at, total = 0, 0.0
    for i, c in enumerate(token):
        if c not in tables[at][1]:
            return (total + UNSEEN * (len(token) + 1 - i)) / (len(token) + 1)
        p, at = tables[at][1][c]
        total += p
    end = tables[at][0]
    return (total + (UNSEEN if end is None else end)) / (len(token) + 1)


def shortest(tables: list) -> int:
    """Characters of the shortest token that an automaton may end after."""
    depth, todo = {0: 0}, [0]
    for s in todo:  # grows; states follow in the order of their depth
        if tables[s][0] is not None:
            return depth[s]
        for _, t in tables[s][1].values():
            if t not in depth:
                depth[t] = depth[s] + 1
                todo.append(t)
    return 1


def learn(examples: Sequence[str]) -> tuple[list, float]:
    """An automaton's tables and its threshold: the score that nearly all examples
    reach in an automaton of others (of one alone: its own)."""
    whole = Automaton(examples).tables()
    if len(examples) < 2:
        return whole, min((score(whole, x) for x in examples), default=0.0)
    held = []
    for fold in range(2):
        t = Automaton([x for i, x in enumerate(examples) if i % 2 != fold]).tables()
        held += [score(t, x) for i, x in enumerate(examples) if i % 2 == fold]
    return whole, sorted(held)[int(len(held) * MISSED)]


class Scanner:
    """Finds what fits a learned format in runs of token characters."""

    def __init__(self, models: Sequence[tuple[list, float]], ordinary: np.ndarray, least_bits: float):
        self.models, self.ordinary, self.least_bits, self.known = models, ordinary, least_bits, {}
        #: No automaton ends after fewer characters.
        self.least = min((shortest(tables) for tables, _ in models), default=1)
        self.runs = re.compile(rf"[{TOKEN}]{{{max(self.least, 1)},}}")

    def hits(self, run: str) -> list[tuple[int, int]]:
        """(start, end) in the run of candidates that fit: from the left, the longest first.

        Every part between two edges is a candidate. It fits if its mean log
        probability reaches a format's threshold, and if the format explains it
        by ``least_bits`` better than the letter pairs of all texts do.
        """
        out, free = [], 0
        for start in range(len(run) - self.least + 1):
            if start < free or start and run[start - 1] not in EDGES:
                continue
            best = 0
            for tables, least in self.models:
                at, total, plain, before = 0, 0.0, 0.0, 32
                for i in range(start, len(run)):
                    step = tables[at][1].get(run[i])
                    if step is None:
                        break
                    code = ord(run[i])
                    total, at, plain, before = total + step[0], step[1], plain + self.ordinary[before, code], code
                    end = tables[at][0]
                    if end is not None and (i + 1 == len(run) or run[i + 1] in EDGES or run[i] in EDGES):
                        all_ = total + end
                        if all_ >= least * (i + 2 - start) and all_ - plain - self.ordinary[code, 32] >= self.least_bits:
                            best = max(best, i + 1)
            if best:
                out.append((start, best))
                free = best
        return out

    def spans(self, text: str, taken: Sequence[tuple]) -> list[tuple[str, int, int, str]]:
        """Fitting candidates of a text outside ``taken``."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        good = False
        for run in set(self.runs.findall(text)):
            if run not in known:
                known[run] = self.hits(run)
            good = good or bool(known[run])
        if not good:
            return []
        out = []
        for m in self.runs.finditer(text):
            for s, e in known[m[0]]:
                s, e = s + m.start(), e + m.start()
                if not any(a < e and s < z for _, a, z, *_ in taken):
                    out.append(("format", s, e, text[s:e]))
        return out


def ordinary_text(pairs: np.ndarray) -> np.ndarray:
    """Log2 probability of each byte after each, from counts of all texts and half a count."""
    n = pairs.reshape(256, 256) + 0.5
    return np.log2(n / n.sum(1, keepdims=True))


def first_pass(docs: DataFrame, text_col: str) -> DataFrame:
    """Labelled credentials (kind, value), repeated, and the counts of neighbouring bytes (pair, n) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            found = set()
            for t in b.column(0):
                text = t.as_py() or ""
                found.update((k, v) for k, _, _, v in base_spans(text) if len(v) <= LONGEST)
                raw = np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)
                for low in range(0, len(raw) - 1, 1 << 20):
                    part = raw[low : low + (1 << 20) + 1].astype(np.int64)
                    total += np.bincount(part[:-1] << 8 | part[1:], minlength=1 << 16)
            rows = sorted(found)
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string()), pa.array(none, pa.int32()), pa.array(none, pa.int64())], names=["kind", "value", "pair", "n"])
        at = np.nonzero(total)[0]
        none = [None] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.string()), pa.array(none, pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["kind", "value", "pair", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, value string, pair int, n long")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """(id_col, spans, base_sha256), spans an array of (kind, start, end, value)
    in code points, end exclusive, by start and kind.

    The fixed patterns label credentials. Of each kind's distinct ones of at
    most LONGEST characters the ``examples`` (a documented bound) lowest by hash
    train an automaton. Every candidate in every text, that is every part of a
    run of token characters between two of its edges, is then scored by all
    automata, and becomes a span of kind format if it fits one and is no
    ordinary text: the format must explain it better than the letter pairs of
    all texts do, by as many bits as tell one word among all. Fixed spans
    always stay, and no format span overlaps one.

    The texts are read twice, for the labels and for the scores; the labels of a
    kind and the 65,536 pair counts, summed before the shuffle, are all that the
    driver sees. A null text counts as empty; repeated rows are scanned alike;
    very long texts and tokens are scanned whole; columns of any other name may
    be there; equal starts are listed by kind; an empty table, or one without
    labelled credentials, has fixed spans only.
    """
    light = materialize(first_pass(docs, text_col), "secrets")
    labelled = light.where("kind IS NOT NULL").select("kind", "value").distinct()
    models = []
    for kind in KINDS[:3]:
        rows = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples).collect()
        if rows:
            models.append(learn([r["value"] for r in rows]))
    pairs = np.zeros(1 << 16)
    for r in light.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    ordinary, least_bits = ordinary_text(pairs), math.log2(pairs.reshape(256, 256)[32].sum() + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        scanner = Scanner(models, ordinary, least_bits)
        for b in batches:
            out, shas = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                shas.append(hashlib.sha256(joined([x[:3] for x in base]).encode()).hexdigest())
                every = sorted(base + (scanner.spans(text, base) if models else []), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                out.append([dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind), pa.array(shas, pa.string())], names=[id_col, "spans", "base_sha256"])

    kept = docs.select(id_col, F.col(text_col).cast("string"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, spans array<struct<kind:string,start:long,end:long,value:string>>, base_sha256 string")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    n = {k: count(k) for k in KINDS}
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[n[k].alias(f"n_{k}") for k in KINDS[:3]], "base_sha256", text.alias("spans"), n["format"].alias("n_format"))
