"""Spelling variants: each word's distance-one automaton against broadcast trie shards."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import UPPER, drop_table, materialize, shuffle_partitions

#: Fewest code points and occurrences of a word; a word's form has DOUBLE its occurrences or more.
LEAST_LENGTH, LEAST_COUNT, DOUBLE = 5, 3, 2
#: One run in so many is damaged.
DAMAGE = 97
#: Most nodes of a trie shard, unless a single word has more, and bytes of the shards that are
#: broadcast at a time. A node takes NODE_BYTES.
NODES, SENT_BYTES, NODE_BYTES = 1 << 18, 32 << 20, 13
#: Words of a task at least.
TASK_WORDS = 2048
#: Automaton states behind the one edit, by how far the word's place is from the trie's depth.
INSERTED, REPLACED, DELETED = 1, 2, 4


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points and LEAST_COUNT occurrences,
    after the damage. Counts are combined before the shuffle."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(r"([A-Za-zÀ-ÿ]{%d,})" % LEAST_LENGTH), F.lit(1))  # shorter runs can't become words
    w = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    w = w.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    w = w.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    w = w.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A compact trie of sorted Latin-1 words. Nodes are numbered level by level, so
    those below node k are first[k] to first[k + 1]; labels has the byte that leads to
    a node, weights the occurrences of the word that ends there, or 0."""

    def __init__(self, labels: bytes, first: array, weights: array):
        self.labels, self.first, self.weights = labels, first, weights

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        places, chars, ends, last = [], [], [], b""
        for i, w in enumerate(words):
            same = next((k for k, (a, b) in enumerate(zip(w, last, strict=False)) if a != b), min(len(w), len(last)))
            places += [(d, i) for d in range(same + 1, len(w) + 1)]
            chars += w[same:]
            ends.append(len(places) - 1)
            last = w
        depth, word = np.array(places, np.int64).reshape(-1, 2).T
        order = np.lexsort((word, depth))
        number = np.empty(len(order) + 1, np.int64)
        number[order] = np.arange(1, len(order) + 1)
        n = len(order) + 1
        below = np.zeros(n + 1, np.int64)
        starts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        above, base = np.zeros(1, np.int64), 0
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            here = word[order[low:high]]
            parents = base + np.searchsorted(above, here, "right") - 1
            below[base : base + len(above)] = np.bincount(parents - base, minlength=len(above))
            above, base = here, low + 1
        first = np.concatenate([[1], 1 + np.cumsum(below[:n])])
        weights = np.zeros(n, np.int64)
        weights[number[ends]] = counts
        return cls(b"\0" + np.array(chars, np.uint8)[order].tobytes(), array("I", first.astype(np.uint32).tobytes()), array("q", weights.tobytes()))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.labels, self.first.tobytes(), self.weights.tobytes()

    @classmethod
    def unpacked(cls, labels: bytes, first: bytes, weights: bytes) -> Trie:
        return cls(labels, array("I", first), array("q", weights))

    def near(self, word: bytes) -> tuple[int, int, bytes | None]:
        """How many words of the trie are one edit from ``word``, and of these the
        most frequent: its occurrences and itself, the least of several.

        The automaton walks the trie depth-first: along the word itself until it
        leaves the trie, and from each node of that path below every label that is
        an edit, where at most three labels lead on.
        """
        labels, first, weights, size = self.labels, self.first, self.weights, len(word)
        found, most, best = 0, 0, None
        node = depth = riding = 0  # riding: states behind an edit whose path is a prefix of the word, too
        while True:
            if depth == size - 1 and (n := weights[node]):
                found += 1
                if n > most or n == most and word[:depth] < best:
                    most, best = n, word[:depth]
            x = word[depth] if depth < size else -1
            y = word[depth + 1] if depth + 1 < size else -1
            before = word[depth - 1] if depth else -1
            on = -1
            for k in range(first[node], first[node + 1]):
                c = labels[k]
                state = INSERTED | (DELETED if c == y else 0)
                if riding:
                    state |= (riding & INSERTED if c == before else 0) | (riding & REPLACED if c == x else 0)
                if c == x:
                    on, onward = k, state
                    continue
                todo = [(k, depth + 1, state | REPLACED if x >= 0 else state)]
                while todo:
                    at, d, state = todo.pop()
                    if (n := weights[at]) and -2 < size - d < 2 and state & (REPLACED if d == size else DELETED if d < size else INSERTED):
                        found += 1
                        if n >= most:
                            form = word[:depth] + labels[k : k + 1] + word[depth + 1 :] if d == size else word[:depth] + word[depth + 1 :] if d < size else word[:depth] + labels[k : k + 1] + word[depth:]
                            if n > most or form < best:
                                most, best = n, form
                    low, high = first[at], first[at + 1]
                    if low == high:
                        continue
                    wanted: dict[int, int] = {}
                    if state & INSERTED and d <= size:
                        wanted[word[d - 1]] = INSERTED
                    if state & REPLACED and d < size:
                        wanted[word[d]] = wanted.get(word[d], 0) | REPLACED
                    if state & DELETED and d + 1 < size:
                        wanted[word[d + 1]] = wanted.get(word[d + 1], 0) | DELETED
                    for c, s in wanted.items():
                        if (below := labels.find(c, low, high)) >= 0:
                            todo.append((below, d + 1, s))
            if on < 0:
                return found, most, best
            node, depth, riding = on, depth + 1, onward


def trie_shards(words: DataFrame) -> DataFrame:
    """(labels, first, weights, bytes): tries of NODES nodes at most over ``words``
    (word, n), each of words that follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["labels", "first", "weights", "bytes"]

        def shard(own: list[bytes], counts: list[int]) -> pa.RecordBatch:
            parts = Trie.of(own, counts).packed()
            return pa.RecordBatch.from_arrays([*(pa.array([p], pa.binary()) for p in parts), pa.array([sum(map(len, parts))], pa.int64())], names)

        own, counts, nodes = [], [], 0
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                word = word.encode("latin-1")
                if own and nodes + len(word) > NODES:
                    yield shard(own, counts)
                    own, counts, nodes = [], [], 0
                last = own[-1] if own else b""
                nodes += len(word) - next((k for k, (x, y) in enumerate(zip(word, last, strict=False)) if x != y), min(len(word), len(last)))
                own.append(word)
                counts.append(n)
        if own:
            yield shard(own, counts)

    return words.select("word", "n").mapInArrow(run, "labels binary, first binary, weights binary, bytes long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near): for each of ``words`` (word, n; written) how
    many others are one edit away, and the most frequent of these.

    Shards are broadcast as many at a time as fit in SENT_BYTES; each time all words
    meet these, and a word's few numbers are all that is written.
    """
    spark, total = words.sparkSession, words.count()
    tasks = max(shuffle_partitions(spark), math.ceil(total / (32 * TASK_WORDS)))
    ordered = words.repartitionByRange(max(1, math.ceil(total * LEAST_LENGTH / NODES)), "word").sortWithinPartitions("word")
    shards = materialize(trie_shards(ordered).withColumn("shard", F.monotonically_increasing_id()), "spell-shards")
    dealt = materialize(words.repartition(min(tasks, max(1, math.ceil(total / TASK_WORDS))), "word"), "spell-words")
    sizes = sorted((r["shard"], r["bytes"]) for r in shards.select("shard", "bytes").toLocalIterator())  # two numbers per NODES nodes
    rounds: list[list[int]] = []
    room = 0
    for shard, size in sizes:
        if not rounds or size > room:
            rounds.append([])
            room = SENT_BYTES
        rounds[-1].append(shard)
        room -= size
    schema = "word string, n long, n_near long, near_n long, near string"
    parts = []
    for k, chosen in enumerate(rounds):
        found = shards.where(F.col("shard").between(chosen[0], chosen[-1])).collect()
        sent = spark.sparkContext.broadcast([(bytes(r["labels"]), bytes(r["first"]), bytes(r["weights"])) for r in found])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, every=k == 0) -> Iterator[pa.RecordBatch]:
            tries = [Trie.unpacked(*x) for x in sent.value]
            for b in batches:
                rows = []
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    coded, count, most, best = word.encode("latin-1"), 0, 0, None
                    for t in tries:
                        c, m, w = t.near(coded)
                        count += c
                        if c and (m > most or m == most and w < best):
                            most, best = m, w
                    if count or every:
                        rows.append((word, n, count, most or None, best.decode("latin-1") if best is not None else None))
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["word", "n", "n_near", "near_n", "near"])

        parts.append(materialize(dealt.mapInArrow(run, schema), "spell-near"))
        sent.destroy()
    for t in (shards, dealt):
        drop_table(t)
    if len(parts) < 2:
        return parts[0] if parts else spark.createDataFrame([], schema)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min(F.when(F.col("near_n").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near")))
    return every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.m")).alias("near_n"), "b.near")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms of ``links`` (word, form) lead to.
    Each round doubles the steps taken; forms at least double in number, so there
    are no circles and few rounds."""
    now = materialize(links.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = now.select("word", "root").join(onward, "root", "left")
        old, now = now, materialize(far.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        drop_table(old)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs``.

    A null text has no words, a null id counts as empty text in the damage; rows
    that repeat count again; texts and words may be of any length; of equally
    frequent near words the least is the form; other columns don't matter, whatever
    their names; a table without words gives no rows.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "spell-vocabulary")
    near = near_words(words)
    better = F.col("near_n") >= DOUBLE * F.col("n")
    found = materialize(near.select("word", "n", "n_near", F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n")), "spell-forms")
    drop_table(words)
    last = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "_w")
    out = found.join(last, F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE tab AS (
  -- CRC-32 of each byte.
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS c FROM (SELECT range AS i FROM range(256)))
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')) AS run FROM documents) GROUP BY 1, 2
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END)) AS b FROM runs
), sums AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295::BIGINT) AS h FROM bytes, tab
), cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w, n FROM sums
), words AS (
  SELECT w, sum(n)::BIGINT AS n FROM cut WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), less AS (
  SELECT w, k, substr(w, 1, k::INT) || substr(w, k::INT + 2) AS d FROM (SELECT w, unnest(range(length(w))) AS k FROM words)
), pairs AS (
  SELECT a.w, b.w AS v FROM less a JOIN less b ON a.k = b.k AND a.d = b.d AND a.w <> b.w
  UNION SELECT less.w, words.w FROM less JOIN words ON words.w = less.d
  UNION SELECT words.w, less.w FROM less JOIN words ON words.w = less.d
), best AS (
  SELECT p.w, count(*) AS n_near, arg_min(p.v, (-b.n, p.v)) AS v, max(b.n) AS m FROM pairs p JOIN words b ON b.w = p.v GROUP BY p.w
), forms AS (
  SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * words.n THEN v END AS form, CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN best ON best.w = words.w
), steps AS (
  SELECT w, w AS x, 0 AS k FROM words UNION ALL SELECT s.w, f.form, k + 1 FROM steps s JOIN forms f ON f.w = s.x WHERE f.form IS NOT NULL
), last AS (
  SELECT w, arg_max(x, k) AS root FROM steps GROUP BY w
)
SELECT f.w AS word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN last l ON l.w = f.w
"""
