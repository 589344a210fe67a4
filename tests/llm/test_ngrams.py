"""Katz models of any order against brute force, and against the block-wise scorer of order 2."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import katz
from lorebase.llm.ngrams import KatzModel, fit_katz

SCHEMA = "doc_id string, text string, ctx string, word string"


def made(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(vocab, [1 / (i + 1) for i in range(40)], k=r.randint(1, 60))) for _ in range(n)]
    texts += ["the same line again and again"] * 9 + ["", None, "Ünïcode Tab\tand\x0bmore", "ONE"]
    return [(None if i == 3 else f"d{i}", t, "mine", None) for i, t in enumerate(texts)]


def parts(text, order):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]
    padded = ["<s>"] * (order - 1) + words
    return [tuple(padded[i : i + order]) for i in range(len(words))]


class Plain:
    """The definition, played by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.c = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            for g in parts(t, order):
                for k in range(1, order + 1):
                    self.c[k][g[-k:]] += 1
        self.d = [katz.good_turing(np.array([0] + [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)])) for c in self.c]
        self.after = collections.defaultdict(dict)
        for k in range(1, order + 1):
            for g, n in self.c[k].items():
                self.after[g[:-1]][g[-1]] = n
        self.vocab = {g[0] for g in self.c[1]}

    def share(self, ctx, w):
        seen, k = self.after[ctx], len(ctx) + 1
        flat = all(n > katz.K for n in seen.values())
        n = seen[w]
        return (n - 0.5 if flat else n * (self.d[k][n] if n <= katz.K else 1)) / sum(seen.values())

    def p(self, ctx, w):
        if ctx not in self.after:
            return self.p(ctx[1:], w)
        seen = self.after[ctx]
        if w in seen:
            return self.share(ctx, w)
        freed = 1 - sum(self.share(ctx, x) for x in seen)
        return freed if not ctx else freed / (1 - sum(self.p(ctx[1:], x) for x in seen)) * self.p(ctx[1:], w)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_equal_brute_force_and_sum_to_one(spark, tmp_path, order):
    train, other = made(1, 60), made(2, 15) + [("x", "never seen words w1 w2 w3 w0 w0 w0", None, None)]
    fit_katz(spark.createDataFrame(train, SCHEMA), f"file://{tmp_path}/m", order)
    model, plain = KatzModel.load(spark, f"file://{tmp_path}/m"), Plain([t for _, t, *_ in train], order)
    for ctx in list(plain.after)[:200]:
        assert abs(sum(plain.p(ctx, w) for w in plain.vocab) + plain.p(ctx, "no such word") - 1) < 1e-9
    got = model.score(spark.createDataFrame(other, SCHEMA)).collect()
    key = lambda rs: sorted((str(i), n, k, round(s, 6)) for i, n, k, s in rs)
    want = []
    for i, t, *_ in other:
        gs = parts(t, order)
        want.append((i, len(gs), sum(g[-1] in plain.vocab for g in gs), sum(math.log10(plain.p(g[:-1], g[-1])) for g in gs)))
    assert key(got) == key(want)
    # The stored tables alone sum to one at every order.
    assert abs(model.grams(1).agg(F.sum("p")).first()[0] + model.unseen - 1) < 1e-9
    for k in range(2, order + 1):
        less = F.substring_index("ctx", " ", -(k - 2)) if k > 2 else F.lit("")
        low = model.grams(k - 1).select(F.col("ctx").alias("less"), "word", F.col("p").alias("low"))
        sums = model.grams(k).withColumn("less", less).join(low, ["less", "word"]).groupBy("ctx").agg(F.sum("p").alias("p"), F.sum("low").alias("low"))
        assert sums.join(model.contexts(k), "ctx").where("abs(p + alpha * (1 - low) - 1) > 1e-9").count() == 0 < sums.count()


def test_order_two_equals_the_block_wise_scorer(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(made(3, 40))], "doc_id long, text string")
    want = {r["doc_id"]: (r["n_tokens"], round(r["score"], 6)) for r in katz.score_documents(rows, held_out=F.lit(False)).collect()}
    got = fit_katz(rows, f"file://{tmp_path}/two", 2).score(rows)
    assert {r["doc_id"]: (r["n_tokens"], round(r["score"], 6)) for r in got.collect()} == want


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    model = fit_katz(none, f"file://{tmp_path}/none", 3)
    assert (model.total, model.unseen) == (0, 1.0) and model.score(none).count() == 0
    assert [tuple(r) for r in model.score(spark.createDataFrame([("a", "x y", None, None)], SCHEMA)).collect()] == [("a", 3, 0, 0.0)]
