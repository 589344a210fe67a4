"""Katz models of any order, kept in partitioned tables that any corpus can be scored against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import UPPER, WORD, materialize
from .katz import K, good_turing

#: No word holds a separator, so these stand for what comes before a text and for its end.
START, END = "\t", "\n"


def tokens(docs: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """(row, id, ctx, word): each token of each text, its end being the last,
    with the ``order - 1`` tokens before it, space-joined."""
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, UPPER.lower())
    words = F.concat(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array(F.lit(END)))
    before = F.array(*[F.lit(START)] * (order - 1)).cast("array<string>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.concat(before, words).alias("w"))
    at = F.explode(F.sequence(F.lit(order), F.size("w"))).alias("at")
    return rows.select("row", "id", "w", at).select("row", "id", F.array_join(F.slice("w", F.col("at") - (order - 1), order - 1), " ").alias("ctx"), F.element_at("w", F.col("at")).alias("word"))


def shorter(ctx: Column, order: int) -> Column:
    """The context of one token less, of a context at ``order``."""
    return F.substring_index(ctx, " ", -(order - 2)) if order > 2 else F.lit("")


def _seen(grams: DataFrame) -> np.ndarray:
    """n[r]: how many n-grams were seen r times, r up to K + 1."""
    return np.array([0, *grams.agg(*[F.count_if(F.col("n") == r) for r in range(1, K + 2)]).first()], float)


def _kept(d: np.ndarray, flat: Column) -> Column:
    """What discounting leaves of the count ``n``; half a count is taken off where ``flat``."""
    ratio = F.element_at(F.array(*[F.lit(float(x)) for x in d[1:]], F.lit(1.0)), F.least(F.col("n"), F.lit(K + 1)).cast("int"))
    return F.when(flat, F.col("n") - 0.5).otherwise(F.col("n") * ratio)


@dataclass(frozen=True)
class KatzModel:
    """A model in the folder ``path``: n-grams with their discounted
    probabilities, contexts with their backoff weights, each a table partitioned
    by order, and the probability of a word never seen."""

    spark: SparkSession
    path: str
    order: int
    total: int
    unseen: float

    @staticmethod
    def load(spark: SparkSession, path: str) -> KatzModel:
        return KatzModel(spark, path, *spark.read.parquet(f"{path}/summary").select("order", "total", "unseen").first())

    def grams(self, order: int) -> DataFrame:
        """(ctx, word, n, p) of one order."""
        return self.spark.read.parquet(f"{self.path}/grams/order={order}")

    def contexts(self, order: int) -> DataFrame:
        """(ctx, total, alpha) of one order, from 2."""
        return self.spark.read.parquet(f"{self.path}/contexts/order={order}")

    def log_p(self, asked: DataFrame, order: int) -> DataFrame:
        """(ctx, word, lp, known) for distinct (ctx, word) at ``order``: an n-gram
        seen in training has its own probability; the others are asked for at the
        order below, once each, and multiplied by their context's weight."""
        if order == 1:
            p = F.coalesce("p", F.lit(self.unseen))
            return asked.join(self.grams(1).select("word", "p"), "word", "left").select("ctx", "word", F.log10(p).alias("lp"), F.col("p").isNotNull().alias("known"))
        found = materialize(asked.join(self.grams(order).select("ctx", "word", "p"), ["ctx", "word"], "left"), "katz-found")
        missed = found.where("p IS NULL").select("ctx", "word", shorter(F.col("ctx"), order).alias("less"))
        lower = self.log_p(missed.select(F.col("less").alias("ctx"), "word").distinct(), order - 1).withColumnRenamed("ctx", "less")
        back = missed.join(materialize(lower, "katz-lower"), ["less", "word"]).join(self.contexts(order).select("ctx", "alpha"), "ctx", "left")
        back = back.select("ctx", "word", (F.col("lp") + F.log10(F.coalesce("alpha", F.lit(1.0)))).alias("lp"), "known")
        return found.where("p IS NOT NULL").select("ctx", "word", F.log10("p").alias("lp"), F.lit(True).alias("known")).unionByName(back)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id_col, n_tokens, n_known, score): one row per row of ``docs``; score is
        the log10 probability of its words and its end.

        Ids may be of any type, null too; other columns are not read. A null or
        empty text has one token, its end. Repeated rows are scored each; an
        empty table gives an empty result. Under a model without training rows
        every token has probability 1. A frequent n-gram is looked up once; the
        tokens that hold it meet its answer in a join of written tables, which
        adaptive execution splits.
        """
        t = materialize(tokens(docs, id_col, text_col, self.order), "katz-tokens")
        said = materialize(self.log_p(t.select("ctx", "word").distinct(), self.order), "katz-said")
        out = t.join(said, ["ctx", "word"]).groupBy("row", "id").agg(F.count("*").alias("n_tokens"), F.count_if("known").alias("n_known"), F.sum("lp").alias("score"))
        return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", "score")


def fit_katz(docs: DataFrame, path: str, order: int = 3, text_col: str = "text") -> KatzModel:
    """Learns a Katz model of ``order`` from all rows of ``docs`` and writes it to
    ``path``, a folder that driver and executors share.

    The texts are read once: n-grams of the highest order are counted, and those
    of each order below are sums over them, as each token ends one n-gram of
    every order. From the lowest order up, an n-gram gets its Good-Turing
    discounted share of its context; a context's weight is what discounting
    frees, over what the order below leaves to words not seen after it, so each
    distribution sums to one. Where a context has no count to discount, half a
    count is taken off each. Words never seen share what the words' discount
    frees. Counts and sums are combined before they are shuffled; the driver sees
    a few numbers per order. The summary is written last, so a model is whole or
    cannot be loaded.

    A null or empty text has one token, its end; repeated rows count each time;
    columns of any name may lie beside the text; an empty table gives a model in
    which every token has probability 1.
    """
    spark = docs.sparkSession
    if order < 1:
        raise ValueError("order is at least 1")
    counts = {order: tokens(docs, text_col, text_col, order).groupBy("ctx", "word").agg(F.count("*").alias("n"))}
    counts[order] = materialize(counts[order], "katz-counts")
    for k in range(order, 1, -1):
        counts[k - 1] = materialize(counts[k].groupBy(shorter(F.col("ctx"), k).alias("ctx"), "word").agg(F.sum("n").alias("n")), "katz-counts")

    n, (total, types) = _seen(counts[1]), counts[1].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    d = good_turing(n)
    freed = float(((1 - d) * np.arange(K + 1))[1:] @ n[1 : K + 1])
    flat = freed <= 0
    unseen = (0.5 * types if flat else freed) / total if total else 1.0
    model = KatzModel(spark, path, order, total, unseen)
    counts[1].withColumn("p", _kept(d, F.lit(flat)) / total).write.parquet(f"{path}/grams/order=1")

    for k in range(2, order + 1):
        d = good_turing(_seen(counts[k]))
        less = shorter(F.col("ctx"), k)
        lower = model.grams(k - 1).select(F.col("ctx").alias("less"), "word", F.col("p").alias("low"))
        with_low = materialize(counts[k].withColumn("less", less).join(lower, ["less", "word"]).drop("less"), "katz-low")
        off = F.col("n") - _kept(d, F.lit(False))
        sums = with_low.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum(off).alias("freed"), F.sum("low").alias("low"), F.min("n").alias("least"))
        flat_ = F.col("least") > K
        alpha = F.when(flat_, 0.5 * F.col("types")).otherwise(F.col("freed")) / F.col("total") / (1 - F.col("low"))
        # Written before it is joined, so that a frequent context can be split.
        sums.select("ctx", "total", flat_.alias("flat"), alpha.alias("alpha")).write.parquet(f"{path}/contexts/order={k}")
        grams = with_low.join(model.contexts(k).select("ctx", "total", "flat"), "ctx")
        grams.select("ctx", "word", "n", (_kept(d, F.col("flat")) / F.col("total")).alias("p")).write.parquet(f"{path}/grams/order={k}")
    spark.createDataFrame([(order, total, unseen)], "order int, total long, unseen double").coalesce(1).write.parquet(f"{path}/summary")
    return model
