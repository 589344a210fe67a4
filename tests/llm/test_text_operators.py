"""Operators on documents against brute force, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing columns."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorebase.llm import katz, lines, mixing, packing, passages, quality, secrets, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(400)]


def prose(n, r=rnd):
    out = []
    for _ in range(n):
        out.append(r.choice(VOCAB))
        out.append(r.choice([" ", " ", " ", "\n", "  "]))
    return "".join(out)


@functools.cache
def corpus():
    texts = [prose(rnd.randrange(1, 200)) for _ in range(60)]
    texts += texts[:6] + [texts[7] + " end", None, "", "   ", "x", "A b C", prose(4000)]
    texts += ["\n".join(f"line {k} of one passage" for k in range(9)) + f"\nown {i}" for i in range(5)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["src1", "src2", "src0", None][i % 4 if i % 7 else 0], i) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id here", "en", "src1", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_mix(spark, docs, empty):
    sized = docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("target", F.lit("clash"))
    got = mixing.mix_sources(sized)
    rows = got.collect()
    assert len(rows) == len(corpus()) and set(got.columns) == {*SCHEMA.replace(",", "").split()[::2], "size", "source_size", "target", "copies"}
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(r["text"])) and 0 <= r["copies"] <= 2
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sums = {s: sum(r["size"] for r in by[s]) for s in order}
    want = mixing.water_fill(sums, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, Fraction(3, 2), Fraction(2))
    assert sum(want.values()) == Fraction(3, 2) * sum(sums.values())
    for s in order:
        taken = sum(r["size"] * r["copies"] for r in by[s])
        assert by[s][0]["source_size"] == sums[s] and by[s][0]["target"] == float(want[s])
        few = [r["size"] for r in by[s] if r["size"] * mixing.LARGE > want[s]]
        assert abs(taken - want[s]) <= (max(few) if len(few) == len(by[s]) else max((r["size"] for r in by[s]), default=0) / 2 + 1)
    again = mixing.mix_sources(sized.repartition(5))
    key = lambda rs: sorted((str(r["doc_id"]), r["copies"]) for r in rs)
    assert key(rows) == key(again.collect())
    assert mixing.sample_mix(docs).count() == sum(r["copies"] for r in rows) and mixing.sample_mix(docs).columns == docs.columns
    assert mixing.mix_sources(empty.withColumn("size", F.lit(1))).count() == 0
    taken = {c: F.lit(f"mine {c}") for c in ("target", "copies", "source_size", "size", "_row", "_size", "_words", "_rank", "_doc", "_copy", "a.b")}
    kept = mixing.sample_mix(docs.withColumns(taken))
    assert kept.columns == [*docs.columns, *taken] and kept.count() == sum(r["copies"] for r in rows)
    assert {tuple(r[c] for c in taken) for r in kept.collect()} == {tuple(f"mine {c}" for c in taken)}


def test_mix_is_near_its_target_whatever_the_sizes(spark):
    r = random.Random(8)
    rows = [(i, "heavy", r.choice([1, 2, 5, 30]) if i > 3 else 9000 - i) for i in range(2000)] + [(5000 + i, "even", 100) for i in range(3000)] + [(9000, "one", 77), (9001, None, 0)]
    for seed in (17, 18, 19):
        got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), seed=seed).toPandas()
        got["taken"] = got["copies"] * got["size"]
        near = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"))
        for s in ("heavy", "even"):
            assert abs(near.loc[s, "taken"] - near.loc[s, "target"]) <= 0.01 * near.loc[s, "target"]
        assert got["copies"].between(0, 2).all() and len(got) == len(rows)


def fingerprint(t, n=4):
    ws = (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + n]), 42) for i in range(max(1, len(ws) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    label = dict(zip(ids, ids, strict=True))
    while True:
        new = {i: min(label[j] for j in ids if i == j or linked(i, j)) for i in ids}
        if new == label:
            return label
        label = new


def test_simhash(docs, empty):
    rows = [r for r in corpus() if r[0] is not None]
    fp = {r[0]: fingerprint(r[1]) for r in rows}
    want = components(list(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fp"] % 2**64, r["component_id"]) == (fp[r["doc_id"]], want[r["doc_id"]])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_columns_of_any_name_stay(spark):
    rows = [(1, prose(80, random.Random(1)), "a"), (2, prose(80, random.Random(1)), "b"), (2, "zz", "c"), (3, None, "d"), (None, "x", "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, x string")
    for name in ("_id", "_key", "a.b"):
        c = d.withColumnRenamed("x", name)
        for f in (simhash.drop_near_duplicates, simhash.drop_near_copies, lines.drop_repeated_lines, passages.drop_repeated_passages):
            if f in (simhash.drop_near_copies, lines.drop_repeated_lines) and name == "_key":
                continue
            out = f(c)
            assert out.columns == c.columns, (f, name)
    kept = {(r["doc_id"], r["x"]) for r in simhash.drop_near_duplicates(d).collect()}
    assert (1, "a") in kept and (None, "e") in kept and kept == {(r["doc_id"], r["x"]) for r in simhash.drop_near_duplicates(d.repartition(5)).collect()}
    gone = {r["x"]: r["text"] for r in passages.drop_repeated_passages(d).collect()}
    assert len(gone) == 5 and gone["a"] == rows[0][1] and len(gone["b"]) < 40
    assert {r["_id"] for r in passages.repeated_passages(spark.createDataFrame([(1, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")).collect()} == {passages.NO_ID}


def test_golay_keys_meet():
    table = simhash.golay_table()
    assert ((table >= 0).sum(1) % 5 == 1).all()
    r = np.random.default_rng(5)
    for d in range(5):
        a = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for bit in r.permutation(64)[:d]:
                b[i] ^= np.uint64(1 << int(bit))
        keys = []
        for x in (a, b):
            rows, k = simhash.fuzzy_keys(x, table)
            sets = [set() for _ in x]
            for i, key in zip(rows.tolist(), k.tolist(), strict=True):
                sets[i].add(key)
            keys.append(sets)
        assert all(p & q for p, q in zip(*keys, strict=True))


def test_near_copies(spark, empty):
    """All pairs of five-word shingles at 0.8 or more are joined, none below, against brute force."""
    r = random.Random(5)
    texts = []
    for n in [6, 8, 9, 20, 40, 80, 150, 300] * 12:
        words = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(words))
        for cut in (1, n // 12, n // 7):
            at, other = r.randrange(n), words[:]
            other[at] = "changed"
            texts += [" ".join(other), " ".join(words[cut:])]
    texts += ["", "  ", None, texts[0].upper(), "w x y z", "w x y z"]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {find(i) for i in range(len(texts))}
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    got = [x["doc_id"] for x in simhash.drop_near_copies(df).collect()]
    assert got.count(None) == 1 and {x for x in got if x is not None} == want and len(got) == len(want) + 1
    assert len(simhash.drop_near_duplicates(df).collect()) > len(got)  # what the stage did before
    assert simhash.drop_near_copies(empty).count() == 0
    first = df.where("doc_id is not null")
    links = [sorted(map(tuple, simhash.near_links(first, "doc_id", "text", b)[1].collect())) for b in (4096, 3)]
    assert links[0] == links[1]
    # Groups that are split into blocks of texts join the same classes.
    whole, split = (components(sorted({x for link in found for x in link}), lambda i, j, f=set(found): (i, j) in f or (j, i) in f) for found in (links[0], [tuple(x) for x in simhash.near_links(first, "doc_id", "text", together=2)[1].collect()]))
    assert whole == split


def test_golay_keys_of_near_copies():
    """Words 2 bits apart or less always share a key, those of a pair just at the least similarity as often as said."""
    r, table = np.random.default_rng(4), simhash.golay_table()

    def shared(flips):
        bits = r.integers(0, 2, (len(flips), 1, 25), dtype=np.uint8)
        other = bits.copy()
        other[:, 0, :23] ^= flips
        pairs = [set(zip(*(x.tolist() for x in simhash.near_keys(b, table)), strict=True)) for b in (bits, other)]
        assert len(pairs[0]) / len(flips) == pytest.approx(simhash.NEAR_KEYS, abs=0.1)
        return len({row for row, _ in pairs[0] & pairs[1]}) / len(flips)

    two = np.zeros((3000, 23), np.uint8)
    for row in two:
        row[r.choice(23, 2, replace=False)] = 1
    assert shared(two) == 1
    assert shared((r.random((20000, 23)) < simhash.NEAR_BITS).astype(np.uint8)) == pytest.approx(simhash.NEAR_SHARED, abs=0.02)


def test_a_group_of_near_copies_has_few_links(spark, monkeypatch):
    """A group's links grow with its members, not with the buckets and blocks they meet in."""
    words, rows, wrote = [f"w{k}" for k in range(120)], [], {}
    for i in range(240):
        words[i % 120] = f"x{i}"
        rows.append((i, " ".join(f"y{i}" if k in (i % 7, i % 11 + 20) else w for k, w in enumerate(words))))
    real = simhash.materialize

    def kept(df, tag):
        wrote[tag] = real(df, tag)
        return wrote[tag]

    monkeypatch.setattr(simhash, "materialize", kept)
    monkeypatch.setattr(simhash, "drop_table", lambda df: None)
    simhash.near_links(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", together=10)
    assert 200 < wrote["near-candidates"].count() < 2.5 * len(rows) and 0 < wrote["near-links"].count() < 2.5 * len(rows)


def test_similar_groups():
    """Groups of sets, within one block and between two, against all pairs."""
    r = random.Random(8)
    base = [r.sample(range(10**6), n) for n in (1, 5, 6, 30, 30)]
    sets = [np.unique(np.array([x if r.random() > 0.06 else r.randrange(10**6) for x in b], np.uint64)) for b in base for _ in range(25)] + [np.zeros(0, np.uint64)]
    r.shuffle(sets)

    def near(i, j):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)

    ids = range(len(sets))
    assert dict(enumerate(simhash.similar_groups(sets).tolist())) == components(ids, near)
    cut = 50
    assert dict(enumerate(simhash.similar_groups(sets[:cut], sets[cut:]).tolist())) == components(ids, lambda i, j: (i < cut) != (j < cut) and near(i, j))
    assert simhash.similar_groups([]).tolist() == []
    assert simhash.similar_groups(sets[:3], []).tolist() == [0, 1, 2]


def test_simhash_blocks(spark):
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(3)]
    fps = sorted({b ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = components(fps, lambda i, j: (i ^ j).bit_count() <= 4)
    for block in (4096, 7):
        links = simhash.fingerprint_links(df, 4, block).collect()
        assert all((x["u"] ^ x["v"]).bit_count() <= 4 for x in links)
        label = {f: f for f in fps}
        for _ in fps:
            for x in links:
                label[x["u"]] = label[x["v"]] = min(label[x["u"]], label[x["v"]])
        assert label == want


def plain_base(text):
    """The fixed patterns as their contract words them."""
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{e}" for a, k, e in sorted(out)]


def test_base_spans_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = secrets.op3_secrets(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("format")] == want
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k + ":") for x in want) for k in secrets.KINDS[:3]]
        assert r["n_format"] == sum(x.startswith("format") for x in r["spans"].split(","))


def test_secrets(spark, empty):
    r = random.Random(5)
    key = lambda: "sk" + "".join(r.choice("0123456789ABCDEF") for _ in range(22)) + "zz"
    short = lambda: "".join(r.choice("0123456789") + r.choice("QXZJ") for _ in range(6))
    rows = [(i, f"{prose(30, r)} api_key = '{key()}' {prose(20, r)}") for i in range(60)]
    rows += [(60 + i, f"{prose(9, r)} Secret: {short()}; {prose(20, r)}") for i in range(60)]
    rows += [(200, f"auth={key()}."), (201, f"see path/{key()}/x"), (202, f"{prose(10, r)} {key()} {prose(3, r)}"), (203, f"a {short()}, b"), (204, "plain words only " * 30), (205, "2024-11-05T10:22:33 10.0.0.1 file_name-v2.txt 1234567890123456")]
    rows += [(206, None), (207, ""), (208, "x" * 200_000), (209, "a=" * 20_000), (210, key()[:-3]), rows[3], rows[3]]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("pair", F.lit(1))
    found = secrets.find_secrets(d).collect()
    assert len(found) == len(rows)
    by = {x["doc_id"]: x for x in found}
    text = dict(rows)
    for i in (200, 201, 202, 203):
        (s,) = by[i]["spans"]
        assert s["kind"] == "format" and s["value"] == text[i][s["start"] : s["end"]] and s["value"] in text[i].replace(",", " ").replace("=", " ").replace("/", " ").replace(". ", " ").rstrip(".").split()
    assert all(by[i]["spans"] == [] for i in (204, 205, 206, 207, 208, 209, 210))
    assert all([s["kind"] for s in by[i]["spans"]] == ["assign"] for i in range(120))
    assert secrets.find_secrets(empty).count() == 0
    bare = secrets.find_secrets(spark.createDataFrame([(1, "no secrets here")], "doc_id long, text string")).collect()
    assert bare[0]["spans"] == []


def test_automaton_keeps_positions_and_lengths():
    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(32)) for _ in range(65)]
    keys = ["ghp_" + "".join(r.choice("abcXYZ0123456789") for _ in range(20)) for _ in range(65)]
    one = secrets.Automaton(hexes)
    assert len(one.levels) == 33 and max(map(len, one.levels)) <= 3
    both = secrets.Automaton(hexes + keys)
    assert len(both.levels[1]) >= 2 and sum(s.ends for s in both.levels[24]) == 65 and sum(s.ends for s in both.levels[32]) == 65
    tables, least = secrets.learn(hexes + keys)
    fresh = "".join(r.choice("0123456789abcdef") for _ in range(32))
    assert secrets.score(tables, fresh) >= least > secrets.score(tables, fresh[:31]) and secrets.score(tables, fresh + "0") < least
    assert secrets.score(tables, "ghp_abcXYZ0123abcXYZ0123") >= least > secrets.score(tables, "ghq-abcXYZ0123abcXYZ0123")
    p = sum(2.0 ** (tables[0][1][c][0]) for c in tables[0][1])
    assert p == pytest.approx(1.0)
    assert secrets.learn(["abc123"])[1] == secrets.score(secrets.learn(["abc123"])[0], "abc123")


def test_lines(docs, empty):
    got = {r["_doc"]["doc_id"]: r for r in lines.dedup_lines(docs.withColumn("runs", F.lit(1))).collect()}
    first = min(i for i, t, *_ in corpus() if t and t.startswith("line 0"))
    assert got[first]["dropped"] == []
    for i in range(first + 1, first + 5):
        assert got[i]["dropped"] == list(range(9)) and got[i]["text"] == f"own {i - first}"
    for i, t, *_ in corpus():
        r = got[i]
        all_ = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert r["n_lines"] == len(all_)
        if not r["dropped"]:
            assert r["text"] == t
    kept = lines.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in kept.collect() if r["doc_id"] in range(first + 1, first + 5))
    assert lines.drop_repeated_lines(empty).count() == 0


def test_repeated_runs_are_found_whole(spark):
    r = random.Random(4)
    block = [f"shared {k}" for k in range(lines.GRAM + lines.WINDOW - 1)]
    rows = []
    for i in range(30):
        own = [f"{i} {k}" for k in range(8)]
        at = r.randrange(9)
        rows.append((i, "\n".join(own[:at] + block + own[at:])))
    out = {x["_doc"]["doc_id"]: x for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["dropped"] == [] and all(out[i]["text"].count("shared") == 0 and out[i]["n_lines"] - len(out[i]["dropped"]) == 8 for i in range(1, 30))


def test_every_repeated_line_is_dropped(spark):
    """Later repeats of single lines, and of runs whose parts have other first places, against brute force."""
    r = random.Random(8)
    texts = ["x\nb\nc\ny", "p\na\nb\nc\nd\nq", "r\na\nb\nc\nd\ns", f"own\n{'long words ' * 60}\nmine", f"{'long words ' * 60}\n\nother", "t\n\nt\nu"]
    texts += ["\n".join(str(r.randrange(60)) if r.random() < 0.6 else f"{i} {k}" for k in range(12)) for i in range(40)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        full = [x for x in t.split("\n") if WORD.search(x)]
        want[i] = [k for k, x in enumerate(full) if x in seen or x in full[:k]]
        seen.update(full)
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["_doc"]["doc_id"]: x["dropped"] for x in got} == want


def repeated(texts, least=1):
    """Per text the lines that lie in ``least`` lines in a row that stand earlier, by brute force."""
    seen, want = set(), []
    for t in texts:
        full = [x for x in t.split("\n") if WORD.search(x)]
        gone = set()
        for k in range(len(full) - least + 1):
            run = tuple(full[k : k + least])
            gone.update(range(k, k + least) if run in seen else ())
            seen.add(run)
        want.append(sorted(gone))
    return want


def test_lines_are_winnowed_and_the_rest_is_compared_exactly(spark):
    assert lines.GRAM > 1 and lines.WINDOW > 1
    r = random.Random(21)
    texts = ["x\nb\nc\ny", "p\na\nb\nc\nd\nq", "r\na\nb\nc\nd\ns", "a\na\na\na\na", "", "\n \n", "a", "}\nown\n}"]
    texts += ["\n".join(str(r.randrange(40)) if r.random() < 0.6 else f"{i} {k}" for k in range(r.randrange(14))) for i in range(40)]
    block = [f"shared {k}" for k in range(60)]
    for i in range(30):
        at, to = r.randrange(50), r.randrange(50)
        texts.append("\n".join([f"own {i}", *block[at : at + r.randrange(1, 11)], *block[to : to + 7], "\t", f"end {i}"]))
    texts += ["\n".join(f"copied {k}" for k in range(11))] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("_key", F.xxhash64("doc_id", "text")).cache()
    hashes = lines.line_hashes(docs, "doc_id").cache()
    full = {i: [x for x in t.split("\n") if WORD.search(x)] for i, t in enumerate(texts)}
    n = sum(map(len, full.values()))

    # Winnowing: fewer fingerprints than lines, each window of grams has one, and all it finds are repeats.
    chosen = collections.defaultdict(set)
    for m in lines.line_fingerprints(hashes, lines.GRAM, lines.WINDOW).collect():
        chosen[m["_id"]].add(m["_i"])
    assert sum(map(len, chosen.values())) < 0.7 * n
    for i, ls in full.items():
        grams = len(ls) - lines.GRAM + 1
        assert all(chosen[i] & set(range(k, k + lines.WINDOW)) for k in range(grams - lines.WINDOW + 1)) and chosen[i] <= set(range(max(grams, 0)))
    once = repeated(texts)
    found = {m["_id"]: {k for a, b in m["runs"] for k in range(a, b)} for m in lines.winnowed_runs(hashes).collect()}
    assert all(ks <= set(once[i]) for i, ks in found.items()) and sum(map(len, found.values())) > 0.5 * sum(map(len, once))
    assert found[len(texts) - 1] == set(range(len(full[len(texts) - 1])))

    # The exact pass reads what winnowing has left, and no more.
    runs = lines.winnowed_runs(hashes).cache()
    rest = {(m["_id"], k) for m in lines.remaining_runs(hashes, runs).collect() for k in range(m["start"], m["end"])}
    assert rest == {(i, k) for i, ks in enumerate(once) for k in ks if k not in found.get(i, ())} and rest

    # Whatever gram and window, the result is that of brute force.
    for least, gram, window in [(1, lines.GRAM, lines.WINDOW), (1, 3, 4), (2, 2, 3), (3, 2, 5)]:
        got = lines.dedup_lines(docs, gram=gram, window=window, least=least).collect()
        assert {x["_doc"]["doc_id"]: x["dropped"] for x in got} == dict(enumerate(repeated(texts, least))), (least, gram, window)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text, *_ in corpus():
        want[i, tuple(t.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    pieces = packing.pack(docs.withColumn("ids", F.lit(1)), sequence=64, grain=16).collect()
    seqs = collections.defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append(p)
    for k, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == 64 or at & (at - 1) == 0 and k >= max(seqs) - 6
    whole = collections.Counter()
    stream = collections.defaultdict(list)
    for p in pieces:
        stream[p["doc_id"], p["doc_tokens"], bytes(p["ids"])[:0]].append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    total = sum(len(x) for (_, x), n in want.items() for _ in range(n))
    assert sum(p["length"] for p in pieces) == total
    for (i, ids), n in want.items():
        if n == 1 and sum(1 for (j, _) in want if j == i) == 1:
            parts = sorted(x for (d, _, _), xs in stream.items() if d == i for x in xs)
            assert [v for _, x in parts for v in x] == list(ids)
            whole[i] += 1
    assert len(whole) > 50 and packing.pack(empty).count() == 0


def served_by_turns(totals, weights, size, grain):
    """The stream as (source, token) by the rounds themselves, one after another."""
    up = [max(1, size // grain * w * packing.WEIGHTS // sum(weights)) for w in weights]
    credit, given, out = [0] * len(totals), [0] * len(totals), []
    while any(g < t for g, t in zip(given, totals, strict=True)):
        for s, t in enumerate(totals):
            credit[s] += up[s]
            while credit[s] >= packing.WEIGHTS and given[s] < t:
                credit[s] -= packing.WEIGHTS
                n = min(grain, t - given[s])
                out += [(s, given[s] + k) for k in range(n)]
                given[s] += n
    return out


@pytest.mark.parametrize("totals, weights", [([1000, 500, 1], [1000, 500, 1]), ([700, 700], [3, 1]), ([5], [5]), ([640, 3, 900, 17], [5, 2, 1, 1])])
def test_pieces_follow_the_rounds(totals, weights):
    r = random.Random(3)
    sequence, grain = 64, 8
    stream = served_by_turns(totals, weights, sequence, grain)
    assert len(stream) == sum(totals)
    at = {x: k for k, x in enumerate(stream)}
    source, start, size = [], [], []
    for s, t in enumerate(totals):
        k = 0
        while k < t:
            n = min(t - k, r.choice([1, 2, 7, 8, 9, 40, 130]))
            source.append(s), start.append(k), size.append(n)
            k += n
    whole = len(stream) // sequence * sequence
    tail, place, k = [], whole, whole // sequence
    for bit in reversed(range(7)):
        if (len(stream) - whole) >> bit & 1:
            tail.append((place, k))
            place, k = place + (1 << bit), k + 1
    tail.append((len(stream), k))
    begins = {k: k * sequence for k in range(whole // sequence)} | {q: x for x, q in tail}
    rounds = packing.Rounds(totals, weights, sequence, grain)
    row, begin, length, seq, off = packing.cut(*(np.array(x) for x in (source, start, size)), rounds, whole, sequence, tail)
    seen = set()
    for i, b, n, q, o in zip(*(x.tolist() for x in (row, begin, length, seq, off)), strict=True):
        assert n > 0 and begins[q] + o + n <= begins.get(q + 1, len(stream))
        for t in range(n):
            assert at[source[i], start[i] + b + t] == begins[q] + o + t
            seen.add(begins[q] + o + t)
    assert len(seen) == len(stream)


def test_every_sequence_holds_the_target_mix(spark):
    sizes = {"a": 800, "b": 500, "c": 300, "d": 200}
    rows = [(k, "tok " * (37 + k % 11), s) for s, n in sizes.items() for k in range(n)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).toPandas()
    share = pieces.groupby("source")["length"].sum() / pieces["length"].sum()
    held = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    full = held[held.sum(axis=1) == packing.SEQUENCE].iloc[:-2]  # sources run out at the very end
    assert len(full) > 10
    assert ((full - share * packing.SEQUENCE).abs() <= 2 * packing.GRAIN).all().all()


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    for _ in range(400):
        t = "".join(r.choice([" ", "a", "the", "\n", "\t", "  ", "é", "1", ".", "'s", " ", "!", "<|endoftext|>"]) for _ in range(r.randrange(14)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_passages(spark, docs, empty):
    r = random.Random(9)
    shared = " ".join(r.choice(VOCAB) + str(r.randrange(1000)) for _ in range(80))
    short = " ".join(r.choice(VOCAB) + str(r.randrange(1000)) for _ in range(30))
    own = lambda: " ".join(r.choice(VOCAB) + str(r.randrange(100000)) for _ in range(60))
    texts = [f"{own()} {shared} {own()}" for _ in range(4)] + [f"{own()} {short} {own()}" for _ in range(4)] + [own(), None, "", own()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(d).collect()
    assert {x["_id"] for x in got} == {1, 2, 3} and {x["first_id"] for x in got} == {0}
    for x in got:
        assert texts[x["_id"]].encode()[x["lo"] : x["hi"]].decode() in shared and x["words"] >= 50
    cut = {x["doc_id"]: x["text"] for x in passages.drop_repeated_passages(d).collect()}
    assert shared in cut[0] and all(len(words(cut[i])) <= 145 for i in (1, 2, 3)) and all(cut[i] == texts[i] for i in range(4, len(texts)))
    assert passages.repeated_passages(empty).count() == 0 and passages.drop_repeated_passages(empty).count() == 0
    assert passages.drop_repeated_passages(docs).columns == docs.columns


def test_passages_of_many_holders_and_one_word_are_found_whole(spark):
    """Every 50 words that an earlier document holds are reported, and nothing else, against brute force."""
    r = random.Random(13)
    own = lambda n=30: " ".join(r.choice(VOCAB) + str(r.randrange(100000)) for _ in range(n))
    shared = own(90).split(" ")
    texts = [f"{own()} {' '.join(shared[k : k + 16])} {own()}" for k in range(0, 90, 8)]  # earlier first places of its parts
    texts += [f"{own()} {' '.join(shared)} {own()}" for _ in range(3)]
    texts += [f"{own()} {'Of ' * 80}{own()}", f"{own(10)} {'Of ' * 60}{own()}", f"{own()} {'a ' * 50}{own()}", f"{own()} {'a ' * 50}{own(9)}", f"{'a ' * 49}{own()}"]
    line = own(7)
    texts += ["\n".join([own(9), *[line] * n, own(4)]) for n in (12, 9, 8)]
    texts += [texts[3], own(60), "", None, *[" ".join(own(49).split()) for _ in range(2)]]
    rows = [(i, t) for i, t in enumerate(texts)]
    seen, want = {}, collections.defaultdict(set)
    for i, t in rows:
        raw = (t or "").encode()
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", raw)]
        spans = [(at[k][0], at[k + 49][1]) for k in range(len(at) - 49)]
        for lo, hi in spans:
            if raw[lo:hi] in seen:
                want[i].update(range(lo, hi))
        for lo, hi in spans:
            seen.setdefault(raw[lo:hi], i)
    got = collections.defaultdict(set)
    for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        part = texts[x["_id"]].encode()[x["lo"] : x["hi"]]
        assert x["first_id"] < x["_id"] and part in texts[x["first_id"]].encode() and x["words"] == len(part.split()) >= 50
        got[x["_id"]].update(range(x["lo"], x["hi"]))
    assert got == want and len(want) >= 7


def test_anchors_in_text_without_chunk_cuts():
    """Stretches that no chunk cut divides still have an anchor in every 50 words, the same in each copy."""
    gear = passages.gear_table()
    for unit in (b"Of ", b"and ", b"a ", b"one line of a list\n"):
        for pad in (b"", b"some other words before "):
            data = np.frombuffer(pad + unit * 100, np.uint8)
            begins, ends, doc = passages.word_places(data, np.array([0, len(data)]))
            at = passages.anchors(data, ends, doc, gear)
            n = len(pad.split())
            assert all(((at >= i + passages.ANCHOR - 1) & (at < i + passages.MIN_WORDS)).any() for i in range(n, len(ends) - passages.MIN_WORDS + 1))


def test_chunks_move_with_the_text():
    r = np.random.default_rng(3)
    data, gear = r.integers(97, 123, 5000, dtype=np.uint8), passages.gear_table()
    plain = [int(sum(int(gear[data[i - k]]) << k for k in range(passages.GEAR)) % 2**32) for i in range(40, 60)]
    assert passages.gear_hash(data, gear)[40:60].tolist() == plain
    _, s, e = passages.chunks(data, np.array([0, 5000]), gear)
    shifted = np.concatenate([data[:7], data])
    _, s2, e2 = passages.chunks(shifted, np.array([0, 5007]), gear)
    assert set(e[3:].tolist()) == {x - 7 for x in e2.tolist() if x - 7 >= e[3]} and (np.diff(e[1:-1]) > passages.GEAR).all()


def test_quality(docs, empty, spark):
    got = {r["_row"]: r for r in quality.judge(quality.text_measures(docs.select(F.struct("doc_id", "text").alias("_row"), "text", "lang", "source"))).collect()}
    for row, r in got.items():
        t = row["text"] or ""
        ws, ls = words(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        again = {k + j for k in range(len(ws) - 7) if grams[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(again))
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(again) > 30 * len(ws)) and not (r["kept"] and r["base_failed"])
    assert quality.filter_quality(docs).columns == docs.columns and quality.filter_quality(empty).count() == 0
    clean = [(i, prose(120, random.Random(i)), "en", "s", 0) for i in range(80)]
    junk = [(100 + i, " ".join(w + "$$$" for w in prose(120, random.Random(i)).split()), "en", "s", 0) for i in range(15)]
    kept = {r["doc_id"] for r in quality.filter_quality(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert kept == set(range(80))


def test_quantile_buckets(spark):
    values = [0, 1, 127, 128, 129, 1000, 65537]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v"))).collect()]
    assert got[:4] == values[:4] and all(b <= v and v - b <= v / 64 for v, b in zip(values, got, strict=True))


def katz_brute(rows, held):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    toks = [[*(t or "").encode().translate(lower).split(), None] for _, t in rows]
    uni, pair, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for w, h in zip(toks, held, strict=True):
        if not h:
            uni.update(w)
            p = [0, *w[:-1]]
            pair.update(zip(p, w, strict=True))
            ctx.update(p)
    hist = lambda c: np.array([0] + [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)])
    du, dp, n = katz.good_turing(hist(uni)), katz.good_turing(hist(pair)), sum(uni.values())
    off = lambda c, d: c * (d[c] if c <= katz.K else 1)
    unseen = 1 - sum(off(c, du) for c in uni.values()) / n
    p1 = lambda w: off(uni[w], du) / n if uni[w] else unseen
    after = collections.defaultdict(list)
    for (p, w), c in pair.items():
        after[p].append((w, c))
    alpha, flat = {}, set()
    for p, xs in after.items():
        if all(c > katz.K for _, c in xs):
            flat.add(p)
        kept = sum(c - 0.5 if p in flat else off(c, dp) for _, c in xs) / ctx[p]
        alpha[p] = (1 - kept) / (1 - sum(p1(w) for w, _ in xs))
        total = kept + alpha[p] * (sum(p1(w) for w in uni) + unseen - sum(p1(w) for w, _ in xs))
        assert abs(total - 1) < 1e-9
    out = []
    for w in toks:
        s = 0.0
        for p, x in zip([0, *w[:-1]], w, strict=True):
            c = pair[p, x]
            s += math.log10((c - 0.5 if p in flat else off(c, dp)) / ctx[p] if c else alpha.get(p, 1.0) * p1(x))
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (len(uni) + 1))) for x in w)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, s))
    return out


@pytest.mark.parametrize(("hot", "block", "entries"), [(250_000, 2_000_000, 500_000), (20, 300, 50)])
def test_katz(spark, docs, empty, hot, block, entries, monkeypatch):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "SPREAD", 100)
    rows = [(i, t) for i, t, *_ in corpus()]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    want = collections.defaultdict(list)
    for (i, _), h, x in zip(rows, held, katz_brute(rows, held), strict=True):
        want[i].append((h, *x))
    for r in katz.score_documents(docs, block=block, entries=entries).collect():
        near = [x for x in want[r["doc_id"]] if x[:4] == (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])]
        assert near and abs(near[0][4] - r["base_score"]) < 1e-6 and abs(near[0][5] - r["score"]) < 1e-6
    assert katz.score_documents(empty).count() == 0
    none = katz.score_documents(docs.limit(3), held_out=F.lit(True)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in none)
