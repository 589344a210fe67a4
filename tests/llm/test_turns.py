"""Conversation repair against a plain search of all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lorebase.llm import turns

WORD = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def solve(rows):
    """(cost, edits, output) of role, fault rows: the least by (cost, edits)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    best = {}
    for i in range(len(rows), -1, -1):
        now = {q: (0, "", []) if i == len(rows) and q in ("", "a") else None for q in after}
        for _ in range(5):  # insertions at one place
            for q in after:
                ways = [now[q]] if now[q] else []
                for r in "ua":
                    if r in after[q] and now[after[q][r]]:
                        c, e, o = now[after[q][r]]
                        ways.append((c + 2, "I" + e, [("user" if r == "u" else "assistant", "")] + o))
                if i < len(rows):
                    role, text, fault = rows[i]
                    c, e, o = best[q]
                    ways.append((c + 3, "D" + e, o))
                    if fault not in ("blank", "duplicate"):
                        t = fault == "truncated"
                        if role[:1] in after[q]:
                            c, e, o = best[after[q][role[:1]]]
                            ways.append((c + t, "K" + e, [(role, text)] + o))
                        for r in "ua":
                            if r in after[q]:
                                c, e, o = best[after[q][r]]
                                ways.append((c + 2 + t, "R" + e, [("user" if r == "u" else "assistant", text)] + o))
                now[q] = min(ways, key=lambda w: w[:2]) if ways else None
        best = now
    return best[""]


def brute(rows):
    given = damage(rows)
    by = collections.defaultdict(list)
    for r in given:
        by[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, n = set(), [], collections.Counter()
        for _, role, text in own:
            found = WORD.findall(text)
            fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
            n[fault] += 1
            seen.add((role, text))
            marked.append((role, text, fault))
        ts = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, audit, final = solve(marked) if marked else (0, "", [])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest()
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=repr)


def conversations(seed=3):
    r = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 14) if conv else 60):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "Änne"])
            rows.append((conv, turn if r.random() < 0.9 else r.choice([None, turn + 3]), role, r.choice(["Yes.", "No!", "what", "é ?\n ", "", " \t\n", None, "so… \x0b", "a.b", f"t{turn}."])))
    return rows + [(None, 1, "user", "x."), (None, None, "assistant", None), (7, 1, "user", "x."), (7, 1, "user", "x."), (7, 1, "user", "x."), (999, 0, "user", "y" * 500_000), (999, 1, "assistant", ".")] + [(20_000 + k, 0, "user", "only.") for k in range(20)]


@pytest.mark.parametrize("block", [1024, 1, 3])
def test_repairs(spark, monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("clash"), "block": F.lit(1)}).repartition(3)
    got = sorted((tuple(x) for x in turns.repair_report(turns.damaged(df), df).collect()), key=repr)
    want = brute(rows)
    assert got == want and any(w[7] == "" for w in want) and {c for w in want for c in w[7]} == set("DIKR")


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = sorted((tuple(x) for x in turns.repair_report(turns.damaged(df), df).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows_have_the_structure(spark):
    df = spark.createDataFrame([("b", 2, "user", "hi."), ("b", 1, "system", "be good."), ("a", 1, "user", "cut"), ("a", 2, "user", "more.")], "name string, n int, role string, text string")
    repair = turns.Repair(df, "name", "n")
    rows = [(r["conv"], r["edit"], r["role"], r["text"]) for r in repair.repaired.collect()]
    assert sorted(rows) == [("a", "K", "user", "cut"), ("a", "R", "assistant", "more."), ("b", "I", "assistant", ""), ("b", "K", "system", "be good."), ("b", "K", "user", "hi.")]
    assert {r["conv"]: (r["cost"], r["audit"]) for r in repair.summary.collect()} == {"a": (3, "KR"), "b": (2, "KKI")}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_report(df, df).count() == 0
