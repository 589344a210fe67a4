"""Language-model scoring with Katz backoff."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import UPPER, drop_folder, free_shuffles, materialize, new_path

#: Tokens of a block of documents, the unit that asks for counts.
BLOCK = 1_000_000
#: Entries (a block's distinct words or pairs) that one table partition gets on average.
ENTRIES = 500_000
#: Counts above this are not discounted.
K = 5
#: A context seen more often is spread over partitions by its successors;
#: there are at most SPREAD of these, by the corpus size.
HOT, SPREAD = 250_000, 20_000
#: Added count of the base score.
ADDED = 0.1
#: No word holds a space, so this stands for a text's end.
END_WORD = b" "


def packed(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, compressed."""
    x = np.ascontiguousarray(x).ravel()
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpacked(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def good_turing(n: np.ndarray) -> np.ndarray:
    """Katz's discount ratios d[0..K] (d[0] unused) from n[r], the number of
    types seen r times, r up to K + 1. Where the counts give no ratio between 0
    and 1, half a count is taken off."""
    d = np.ones(K + 1)
    n = n.astype(float)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


class Unigrams:
    """Discounted word probabilities, and that of any word not seen."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types, self.d = total, types, good_turing(n)
        freed = float(((1 - self.d) * np.arange(K + 1))[1:] @ n[1 : K + 1])
        self.flat = freed <= 0  # nothing is seen K times or less
        self.unseen = 1.0 if not total else (0.5 * types if self.flat else freed) / total

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        if not self.total:
            return np.full(len(c), self.unseen)
        kept = c - 0.5 if self.flat else c * self.d[np.where(c > K, 0, c).astype(int)]
        return np.where(c > 0, kept / self.total, self.unseen)


class Contexts:
    """What is summed per context: count, types, types seen 1..K times, and the
    words' backed-off probability: columns of one float array."""

    WIDTH = 3 + K

    @staticmethod
    def of(owner: np.ndarray, n: int, c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        seen = c > 0
        out = np.zeros((n, Contexts.WIDTH))
        out[:, 0] = np.bincount(owner, c, n)
        out[:, 1] = np.bincount(owner, seen, n)
        for r in range(1, K + 1):
            out[:, 1 + r] = np.bincount(owner, c == r, n)
        out[:, 2 + K] = np.bincount(owner, lower * seen, n)
        return out

    @staticmethod
    def backoff(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, whether half counts are taken off): what discounting frees,
        over what the lower order gives to words not seen after the context."""
        freed = x[:, 2 : 2 + K] @ ((1 - d) * np.arange(K + 1))[1:]
        flat = (freed <= 0) & (x[:, 0] > 0)
        freed = np.where(flat, 0.5 * x[:, 1], freed)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(x[:, 0] > 0, freed / x[:, 0] / (1 - x[:, 2 + K]), 1.0)
        return alpha, flat


def _words(text: bytes, lower: bytes) -> list[bytes]:
    return text.translate(lower).split()  # bytes.split() knows just the six ASCII separators


BLOCKS = "kind string, block long, ids array<bigint>, held array<boolean>, sizes binary, vocab binary, n_vocab long, n_tokens long, trained binary, tokens binary"


def block_table(docs: DataFrame, block: int) -> DataFrame:
    """Blocks of whole documents, two rows each: of kind tokens, with each
    document's tokens as places among the block's distinct words, and of kind
    words, with their hashes and their counts in the training documents."""
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest as hash_

        number = TaskContext.get().partitionId() << 32
        end, ids, held, sizes, parts, n = hash_(END_WORD), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            tokens, size = np.concatenate(parts), np.array(sizes, np.int64)
            vocab, places = np.unique(tokens, return_inverse=True)
            train = np.repeat(~np.array(held, bool), size)
            trained = np.bincount(places[train], minlength=len(vocab)).astype(np.uint32)
            texts = ("tokens", number, ids[:], held[:], size.tobytes(), None, len(vocab), len(tokens), None, packed(places.astype(np.uint32)))
            return _one(BLOCKS, [texts, ("words", number, None, None, None, vocab.tobytes(), None, None, packed(trained), None)])

        for b in batches:
            for id_, text, out in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                hashes = [hash_(w) for w in _words(text.as_py() or b"", lower)]
                hashes.append(end)
                ids.append(id_)
                held.append(out)
                sizes.append(len(hashes))
                parts.append(np.array(hashes, np.uint64))
                n += len(hashes)
                if n >= block:
                    yield flush()
                    number, n = number + 1, 0
                    for x in (ids, held, sizes, parts):
                        x.clear()
        if parts:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, the rows that go to partition p), in order."""
    order = np.argsort(part, kind="stable")
    cuts = np.nonzero(np.diff(part[order]))[0] + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


def _one(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    fields = [x.split() for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


ASK1 = "p long, block long, words binary, counts binary"
SAY1 = "p long, block long, a binary, b binary, stats array<bigint>"


ASK2 = "p long, block long, contexts binary, runs binary, words binary, counts binary, lower binary"
SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
START = np.uint64((1 << 40) - 1)


def _known(words: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and training counts of a block's words. Partitions hold ranges of
    hashes, so their replies follow one another in the block's order."""
    return np.concatenate([unpacked(w["a"], np.uint64) for w in words]), np.concatenate([unpacked(w["b"], np.uint64) for w in words])


def _part(words: np.ndarray, bits: int) -> np.ndarray:
    """The partition of a word's hash: its leading bits."""
    return (words >> np.uint64(32) >> np.uint64(32 - bits)).astype(np.int64)


def _pairs(ids: np.ndarray, c: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, docs_trained: int):
    """A block's distinct pairs as places of context and word, each token's
    pair, and ids and counts by place; the last place is the start of a text."""
    start = len(ids)
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[np.cumsum(sizes) - sizes] = start
    key, pair = np.unique(context * (start + 1) + tokens, return_inverse=True)
    return key // (start + 1), key % (start + 1), pair, np.append(ids, START), np.append(c, np.uint64(docs_trained))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.nonzero(np.append(True, np.diff(x) != 0))[0]


def _spread(ctx: np.ndarray, tgt: np.ndarray, c_ctx: np.ndarray, hot: int, parts: int) -> np.ndarray:
    """The table partition of each pair: by context, of hot contexts by successor too."""
    salt = np.where(c_ctx > hot, (tgt * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % (c_ctx // np.uint64(hot) + np.uint64(1)), np.uint64(0))
    mixed = (ctx + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + salt * np.uint64(0xCA5A826395121157)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, block: int = BLOCK, entries: int = ENTRIES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows whose ``held_out`` is false (by default those with
    crc32 of the id as text modulo 10 not 0; a null id counts as the empty text)
    and scores all. score is the log10 probability of a text's words and its end
    under a Katz model of order 2: a pair seen in training has its Good-Turing
    discounted share of its context, any other the context's backoff weight
    times the word's own discounted share; words never seen share what the
    words' discount frees. Every distribution sums to one: a context's weight is
    what its discount frees over what the lower order gives to words not seen
    after it. base_score adds 0.1 to each count.

    Documents are gathered into blocks, which are written. A block asks a table
    partition only once for each distinct word, then for each distinct pair, so
    frequent ones cost a row per block; pairs are partitioned by context, and a
    context seen over HOT times is spread over several partitions. Partitions
    merge what they are sent and store, per block, counts and context sums in the
    order asked; blocks then look up each token. Sent and stored entries grow
    with the corpus; a task holds one block or one partition. The driver sees
    sums, and the sums of contexts seen over HOT times or total / SPREAD if
    that is more (so at most SPREAD of them).

    A null text has one token, its end. Repeated rows count each time. Without
    training rows every token has probability 1. An empty table gives an empty
    result. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held"))
    path = new_path(spark, "katz-blocks")
    block_table(source, block).write.partitionBy("kind").parquet(path)

    def kind(name: str) -> DataFrame:
        return spark.read.schema(BLOCKS).parquet(path).where(F.col("kind") == name)

    blocks = kind("tokens")
    n_entries = blocks.agg(F.coalesce(F.sum("n_vocab"), F.lit(0))).first()[0]
    bits1 = max(0, min(31, (n_entries // entries).bit_length()))
    parts1 = 1 << bits1

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, vocab, trained in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                vocab, trained = np.frombuffer(vocab, np.uint64), unpacked(trained, np.uint32)
                yield _one(ASK1, [(p, number, vocab[rows].tobytes(), packed(trained[rows])) for p, rows in _dealt(_part(vocab, bits1))])

    def merge_words(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        counts = np.concatenate([unpacked(x, np.uint32) for x in table.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(place, counts, len(distinct)).astype(np.uint64)
        ids = np.arange(len(distinct), dtype=np.uint64) * np.uint64(parts1) + np.uint64(p)
        cuts = np.cumsum([len(w) for w in words])[:-1]
        rows = [(p, n, packed(ids[at]), packed(c[at]), None) for n, at in zip(table.column("block").to_pylist(), np.split(place, cuts), strict=True)]
        stats = [int(c.sum()), int((c > 0).sum()), *[int((c == r).sum()) for r in range(1, K + 2)]]
        often = c > HOT
        return pa.Table.from_batches([_one(SAY1, [*rows, (p, -1, ids[often].tobytes(), c[often].tobytes(), stats)])])

    asked = kind("words").select("block", "vocab", "trained").mapInArrow(ask_words, ASK1)
    said1 = materialize(asked.groupBy("p").applyInArrow(merge_words, SAY1), "katz-words")
    # The hashes have done their work.
    drop_folder(spark, f"{path}/kind=words")
    free_shuffles(spark)
    blocks = kind("tokens")

    def summed(said: DataFrame, width: int) -> np.ndarray:
        row = said.where("block = -1").agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(width)]).first()
        return np.array(list(row), np.int64)

    stats1 = summed(said1, K + 3)
    uni = Unigrams(int(stats1[0]), int(stats1[1]), np.concatenate([[0], stats1[2:]]))
    hot, totals = max(HOT, uni.total // SPREAD), blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    docs_trained, parts2 = totals[1], max(1, -(-totals[0] // entries))

    def hot_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _one("id long", [(x,) for x in np.frombuffer(a, np.int64)[np.frombuffer(c, np.uint64) > hot].tolist()])

    # Words seen over total / SPREAD times, so at most SPREAD.
    hot_ids = [r[0] for r in said1.where("block = -1").select("a", "b").mapInArrow(hot_words, "id long").collect()]
    hot_ids = np.array(sorted(hot_ids + [int(START)] * (docs_trained > hot)), np.uint64)

    def replies(said: DataFrame, name: str) -> DataFrame:
        return said.where("block >= 0").groupBy(F.col("block").alias(f"_{name}")).agg(F.sort_array(F.collect_list(F.struct("p", "a", "b"))).alias(name))

    with_words = blocks.select("block", "ids", "held", "sizes", "tokens").join(replies(said1, "words"), F.col("block") == F.col("_words"))

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                number, held, sizes, tokens, words = (b.column(i)[row].as_py() for i in range(5))
                ids, c = _known(words)
                tokens, sizes = unpacked(tokens, np.uint32).astype(np.int64), np.frombuffer(sizes, np.int64)
                ctx, tgt, pair, all_ids, all_c = _pairs(ids, c, tokens, sizes, docs_trained)
                train = np.repeat(~np.array(held, bool), sizes)
                counts = np.bincount(pair[train], minlength=len(ctx)).astype(np.uint32)
                for p, rows in _dealt(_spread(all_ids[ctx], all_ids[tgt], all_c[ctx], hot, parts2)):
                    at = _firsts(ctx[rows])
                    runs = np.diff(np.append(at, len(rows))).astype(np.uint32)
                    asked = all_ids[tgt[rows]]
                    asked = asked.astype(np.uint32) if asked.max() < 1 << 32 else asked
                    yield _one(ASK2, [(p, number, packed(all_ids[ctx[rows][at]]), packed(runs), bytes([asked.itemsize]) + packed(asked), packed(counts[rows]), packed(all_c[tgt[rows]]))])

    def merge_pairs(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        ctx, tgt, lower, counts, own = [], [], [], [], []
        for r in table.to_pylist():
            own.append(unpacked(r["contexts"], np.uint64))
            ctx.append(np.repeat(own[-1], unpacked(r["runs"], np.uint32)))
            tgt.append(unpacked(r["words"][1:], np.uint32 if r["words"][0] == 4 else np.uint64).astype(np.uint64))
            counts.append(unpacked(r["counts"], np.uint32))
            lower.append(unpacked(r["lower"], np.uint64))
        cuts = np.cumsum([len(x) for x in tgt])[:-1]
        contexts, owner = np.unique(np.concatenate(ctx), return_inverse=True)
        tgt, counts, lower = np.concatenate(tgt), np.concatenate(counts), np.concatenate(lower)
        _, one, pair = np.unique(owner.astype(np.uint64) << np.uint64(40) | tgt, return_index=True, return_inverse=True)
        c = np.bincount(pair, counts, len(one)).astype(np.int64)
        sums = Contexts.of(owner[one], len(contexts), c, uni.p(lower[one]))
        rows = [
            (p, n, packed(c[at].astype(np.uint32)), packed(sums[np.searchsorted(contexts, asked)].T), None)
            for n, at, asked in zip(table.column("block").to_pylist(), np.split(pair, cuts), own, strict=True)
        ]
        big = np.isin(contexts, hot_ids)
        return pa.Table.from_batches([_one(SAY1, [*rows, (p, -1, contexts[big].tobytes(), sums[big].tobytes(), [int((c == r).sum()) for r in range(1, K + 2)])])])

    asked = with_words.select("block", "held", "sizes", "tokens", "words").mapInArrow(ask_pairs, ASK2)
    said2 = materialize(asked.groupBy("p").applyInArrow(merge_pairs, SAY1), "katz-pairs")
    free_shuffles(spark)
    discount = good_turing(np.concatenate([[0], summed(said2, K + 1)]))

    def hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(a, np.int64).tolist()
                yield _one("id long, x array<double>", list(zip(ids, np.frombuffer(x).reshape(len(ids), Contexts.WIDTH).tolist(), strict=True)))

    sums = said2.where("block = -1").select("a", "b").mapInArrow(hot_sums, "id long, x array<double>")
    sums = {r[0]: list(r)[1:] for r in sums.groupBy("id").agg(*[F.sum(F.get("x", F.lit(i))) for i in range(Contexts.WIDTH)]).collect()}
    hot_x = np.array([sums.get(i, [0.0] * Contexts.WIDTH) for i in hot_ids.tolist()]).reshape(-1, Contexts.WIDTH)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, held, sizes, tokens, words, said = (b.column(i)[row].as_py() for i in range(6))
                ids, c = _known(words)
                tokens, sizes = unpacked(tokens, np.uint32).astype(np.int64), np.frombuffer(sizes, np.int64)
                ctx, tgt, pair, all_ids, all_c = _pairs(ids, c, tokens, sizes, docs_trained)
                x, seen = np.zeros((len(all_ids), Contexts.WIDTH)), np.empty(len(ctx), np.int64)
                for (_, rows), r in zip(_dealt(_spread(all_ids[ctx], all_ids[tgt], all_c[ctx], hot, parts2)), said, strict=True):
                    seen[rows] = unpacked(r["a"], np.uint32)
                    own = ctx[rows][_firsts(ctx[rows])]
                    x[own] = unpacked(r["b"], np.float64).reshape(Contexts.WIDTH, len(own)).T
                if len(hot_ids):
                    at = np.minimum(np.searchsorted(hot_ids, all_ids), len(hot_ids) - 1)
                    x = np.where((hot_ids[at] == all_ids)[:, None], hot_x[at], x)
                alpha, flat = Contexts.backoff(x, discount)
                kept = np.where(flat[ctx], seen - 0.5, seen * discount[np.where(seen > K, 0, seen)])
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(seen > 0, kept / x[ctx, 0], alpha[ctx] * uni.p(all_c[tgt]))
                starts = np.cumsum(sizes) - sizes
                base = np.log10((c + ADDED) / (uni.total + ADDED * (uni.types + 1)))
                add = lambda v: np.add.reduceat(v, starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes), pa.array(add((c > 0).astype(np.int64)[tokens])), pa.array(np.full(len(sizes), uni.total)), pa.array(add(base[tokens])), pa.array(add(np.log10(p)[pair]))],
                    names=[f.split()[0] for f in SCORES.split(", ")],
                )

    ready = with_words.join(replies(said2, "pairs"), F.col("block") == F.col("_pairs"))
    out = ready.select("ids", "held", "sizes", "tokens", "words", "pairs").mapInArrow(score, SCORES)
    return out.withColumnRenamed("id", id_col)


def op10_katz(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
