"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lorebase.llm import spelling


def near(a, b):
    """Whether a and b differ by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    by = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(by[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize(("nodes", "sent"), [(1 << 18, 32 << 20), (60, 32 << 20), (60, 2000), (1, 1)])
def test_variants(spark, monkeypatch, nodes, sent):
    monkeypatch.setattr(spelling, "NODES", nodes)
    monkeypatch.setattr(spelling, "SENT_BYTES", sent)
    monkeypatch.setattr(spelling, "TASK_WORDS", 16)
    r = random.Random(4)
    many = nodes > 10
    pool = ["".join(r.choice("abÿ") for _ in range(r.randrange(5, 8))) for _ in range(60 if many else 12)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Überall", "Aßbcd×÷"]
    rows = [(i, " ".join(r.choice(pool[: r.randrange(1, len(pool)) + 1]) for _ in range(25))) for i in range(60 if many else 20)]
    rows += [(None, "aaaab aaaab aaaab"), (None, None), (99, ""), (98, "ab " * 9), (97, ("z" * 400 + " ") * 3), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "word": F.lit("clash")}).repartition(3)
    got = sorted(tuple(x) for x in spelling.spelling_variants(df).collect())
    assert got == brute(rows) and len(got) > (30 if many else 8)
    assert {x[5] is None for x in got} == {True, False} and any(x[1] != x[2] and x[1] for x in got) == many


def test_automaton_finds_each_near_word_once():
    r = random.Random(7)
    for letters in ("a", "ab", "abc"):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 7))) for _ in range(200)})
        trie = spelling.Trie.of([w.encode() for w in words], [1 + len(w) for w in words])
        for w in [*words, "", "b", "abcabc", "aaaaaaaa"]:
            if w:
                found = [v for v in words if near(w, v)]
                best = min(found, key=lambda v: (-len(v), v), default=None)
                assert trie.near(w.encode()) == (len(found), 1 + len(best) if best else 0, best.encode() if best else None), w


def test_whole_table(spark):
    """Against deletion neighbourhoods over all of a table's words."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["word"]: r for r in spelling.spelling_variants(df).collect()}
    words = {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()}
    rows = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            rows[w[:k] + w[k + 1 :]].add(w)
        rows[w].add(w)
    by = collections.defaultdict(set)
    for group in rows.values():
        for a in group:
            by[a] |= {b for b in group if near(a, b)}
    assert got.keys() == words.keys()
    for w, n in words.items():
        best = min(by[w], key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        assert (got[w]["n"], got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (n, len(by[w]), form, words[form] if form else None)
        assert got[w]["root"] == (got[form]["root"] if form else w)


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "too few words here")], "doc_id long, text string")).columns == ["word", "form", "root", "n", "n_near", "form_n"]
