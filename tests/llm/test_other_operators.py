"""Vectors, archives and the pipeline."""

import collections
import gzip
import math
import os
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorebase.llm import common, embeddings, mixing, warc
from lorebase.llm.common import connected_components


def cosine_brute(rows):
    ok = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    link = {i: {j for j in ok if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / math.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.95} if i in ok else set() for i in range(len(rows))}
    label = [r[0] for r in rows]
    while True:
        new = [min(label[k] for k in {i, *link[i]}) for i in range(len(rows))]
        if new == label:
            return [(r[0], len(link[i]), label[i], r[0] == label[i]) for i, r in enumerate(rows)]
        label = new


@pytest.mark.parametrize(("lists", "block"), [(1, 2048), (99, 8)])
def test_embeddings(spark, monkeypatch, lists, block):
    monkeypatch.setattr(embeddings, "MOST_LISTS", lists)
    monkeypatch.setattr(embeddings, "SURE", 4)  # exact in 12 dimensions
    monkeypatch.setattr(embeddings, "BLOCK", block)
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 12))
    near = x[:10].repeat(4, 0) + r.normal(size=(40, 12)) * 0.12
    v = [a.astype(np.float32).tolist() for a in (*x, *near, *x[:5], *(3 * x[5:8]))]
    v += [None, [0.0] * 12, [float("nan")] * 12, [1.0, None] * 6, [1.0, 2.0], [2.0, 4.0], [], [1e-30] * 12]
    rows = [(i, e) for i, e in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(3)
    got = sorted(tuple(z) for z in embeddings.near_vectors(df).collect())
    assert got == cosine_brute(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    twice = {z["vec_id"]: z["n_links"] for z in embeddings.near_vectors(df.where("vec_id = 104").union(df.where("vec_id = 104"))).collect()}
    assert twice == {104: 1}


def test_vectors_of_any_magnitude_link(spark):
    rows = [(1, [1e200, 2e200, 0.0]), (2, [1e200, 2.01e200, 0.0]), (3, [1e-200, 2e-200, 0.0]), (4, [2.0, -1.0, 0.0]), (None, [1.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_cls", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), None: (3, 1), 4: (0, 4)}


def test_recall_of_the_probes(spark):
    """Against brute force over a whole table, with the probes as they are."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r["vec_id"], [float(x) for x in r["embedding"]] if r["embedding"] else None) for r in df.collect())
    want = sum(n for _, n, _, _ in cosine_brute(rows))
    got = sum(r["n_links"] for r in embeddings.near_vectors(df).collect())
    assert 0.9 * want <= got <= want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 540)]
    label = {i: i for e in edges for i in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é & \r\n\r\nWARC/1.1\r\n</p>" * 900
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://c", ""), (5, "u\nv", big), (6, "http://d", big), (6, "http://d", big), (None, "http://e", "alone"), (7, "http://f", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(warc.round_trip(pages, f"file://{tmp_path}/w", segment=700).collect(), key=lambda r: (str(r["page_id"]), r["record_type"]))
    assert len(got) == len(rows) and all(r["problem"] is None for r in got)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.digest(html.encode())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html.encode()
        if r["record_type"] == "revisit":
            assert r["refers_to"] == top[html]
    assert [r["record_type"] for r in got if r["page_id"] == 6] == ["response", "revisit"]
    light = warc.round_trip(pages, segment=700, payloads=False).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["record_type"])) for r in light) == sorted(str((r["page_id"], r["payload_bytes"], r["record_type"])) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def archive(tmp_path, *records):
    out = b"".join("\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in h.items()], f"Content-Length: {len(b)}", "", ""]).encode() + b + b"\r\n\r\n" for h, b in records)
    half = len(out) // 2
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(out[:half]) + gzip.compress(out[half:]))
    return f"file://{tmp_path}/x.warc.gz"


def test_segments_and_damage(spark, tmp_path):
    payload = b"hello world, in chunks"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5;ext=1\r\nhello\r\n11\r\n world, in chunks\r\n0\r\n\r\n"
    seg = lambda o, k, total=None: {"WARC-Type": "response" if k == 1 else "continuation", "WARC-Record-ID": o if k == 1 else f"{o}{k}", "WARC-Segment-Number": k} | ({"WARC-Segment-Origin-ID": o} if k > 1 else {}) | ({"WARC-Segment-Total-Length": total} if total else {})
    path = archive(
        tmp_path,
        (seg("<a>", 3, len(block)), block[60:]), (seg("<a>", 1), block[:30]), (seg("<a>", 2), block[30:60]),
        (seg("<b>", 1), block[:30]), (seg("<b>", 3, len(block)), block[60:]),
        (seg("<c>", 1), block[:30]), (seg("<c>", 2, len(block)), block[30:40]),
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<d>"}, block[:-9]),
        ({"WARC-Type": "response", "WARC-Record-ID": "<e>"}, b"HTTP/1.1 200 OK\r\n\r\nplain"),
    )
    got = {r["record_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(got["<a>"]["payload"]) == payload and bytes(got["<e>"]["payload"]) == b"plain"
    assert "missing" in got["<b>"]["problem"] and "bytes of" in got["<c>"]["problem"] and got["<d>"]["problem"] and got["<d>"]["payload"] is None
    assert got["<i>"]["record_type"] == "warcinfo" and len(got) == 6
    (tmp_path / "bad").write_bytes(b"junk WARC/1.1\r\nContent-Length: 99999\r\n\r\nshort")
    assert {r["record_type"] for r in warc.read_archives(spark, f"file://{tmp_path}/bad").collect()} == {"malformed"}


def test_pipeline(spark, tmp_path):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(900)]
    text = lambda n: "\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(n))
    clean = [text(r.randrange(3, 9)) for _ in range(90)]
    near = clean[3].replace("\n", " ") + " end"
    shared = text(6)
    texts = [*clean, clean[3].replace("\n", " "), near, shared + "\n" + text(4), shared + "\n" + text(4), "short", " ".join(w + "###" for w in text(5).split()), None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({x["doc_id"]: x["text"] for x in docs.collect()})
    assert set(seen[0]) == set(range(94)) and set(seen[1]) == set(range(94))
    assert shared in seen[1][92] and not any(x in seen[1][93] for x in shared.split("\n"))
    assert 90 not in seen[2] and set(range(90)) <= set(seen[2])
    assert set(seen[3]) <= set(seen[2])
    # Brute force: what each stage may keep of what it was given.
    lines_seen, want = set(), {}
    for i in sorted(seen[0]):
        own = seen[0][i].split("\n")
        want[i] = "\n".join(x for k, x in enumerate(own) if x not in lines_seen and x not in own[:k])
        lines_seen.update(own)
    assert seen[1] == {i: t for i, t in want.items() if t}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in seen[1].items())}
    first = {i: min(j for j in seen[1] if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])) for i in seen[1]}
    assert set(seen[2]) == {i for i in first if first[i] == i} and all(seen[2][i] == seen[1][i] for i in seen[2])
    sizes = {s: sum(len(t.split()) for i, t in seen[2].items() if rows[i][3] == s) for s in ("s0", "s1", "s2", "s3")}
    targets = mixing.water_fill(sizes, dict(zip(sizes, (5, 2, 1, 5), strict=True)), Fraction(3, 2), Fraction(2))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    starts = collections.Counter((x["doc_id"], x["source"]) for x in out if x["start"] == 0)
    for s, target in targets.items():
        taken = sum(n * len(seen[2][i].split()) for (i, t), n in starts.items() if t == s)
        assert abs(taken - target) <= 60 and all(n <= 2 for n in starts.values())
    assert {x["doc_id"] for x in out} == set(seen[3])
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_stages_delete_what_the_one_before_wrote(spark, tmp_path):
    chain, wrote = common.Stages(), []

    def step(spark, docs, sf_dir):
        wrote.append(common.materialize(docs, "test-stage"))
        return wrote[-1]

    chain.after(None)(step)(spark, spark.range(3), "")
    chain.after("step")(step)(spark, wrote[0], "")
    assert wrote[0].count() == 3  # its result was not written, so its table stays
    wrote[1].write.parquet(f"{tmp_path}/out")
    gone = wrote[1]._lorebase_path.removeprefix("file://")
    assert os.path.exists(gone)
    assert chain.after("step")(step)(spark, spark.read.parquet(f"{tmp_path}/out"), "").count() == 3
    assert not os.path.exists(gone)
