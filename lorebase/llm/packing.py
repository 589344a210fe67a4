"""Mixture-controlled packing of token streams into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, sent_if_few

#: Tokens of a sequence, which is a deficit round, and of what a source serves at once.
SEQUENCE, GRAIN = 2048, 128
END = 1
#: Sum of the whole-number weights by which rounds are computed.
WEIGHTS = 1 << 22
#: Bytes of text, or of ids, that a worker turns into one batch.
BYTES = 1 << 20


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit bytes, equal to the tokenizer
    file's own.

    Where the same vocabulary lies beside the file as ranks, texts go through
    the faster library, which encodes whole texts and keeps nothing of them;
    the file itself is loaded only for a text that holds a special token's
    string.
    """

    def __init__(self, path: str):
        import base64
        import json
        import os

        self.path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        at = raw.find('"added_tokens":')
        listed = json.JSONDecoder().raw_decode(raw, raw.index("[", at))[0] if at >= 0 else []
        self.special = [t["content"] for t in listed]
        self.ranked = None
        beside = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(beside):
            import public_tokenizers
            import tiktoken

            with open(beside, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("lorebase", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_encoders: dict[str, Encoder] = {}


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some BYTES each, one row at least."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BYTES, "right")))
        yield low, high
        low = high


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def token_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, _source, ids (little-endian 32-bit, with the
    closing id), doc_tokens, and its start in its source's part of the task's
    stream (_task, _start). A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer if "/" in tokenizer else _tokenizer_path(tokenizer)
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode, end, task, at = _encoders[path].encode, np.array([END], "<u4").tobytes(), TaskContext.get().partitionId(), {}
        for whole in batches:
            for low, high in _slices(_lengths(whole.column(1))):
                b = whole.slice(low, high - low)
                ids, sizes, starts = [], [], []
                for text, source in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                    x = encode(text.as_py() or "") + end
                    n = len(x) // 4
                    ids.append(x)
                    sizes.append(n)
                    starts.append(at.get(source, 0))
                    at[source] = starts[-1] + n
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array([task] * n, pa.int32()), pa.array(starts, pa.int64())],
                    names=[id_col, "_source", "ids", "doc_tokens", "_task", "_start"],
                )

    kept = docs.select(id_col, F.col(text_col).cast("string"), F.col(source_col).cast("string"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, _source string, ids binary, doc_tokens long, _task int, _start long")


class Rounds:
    """Deficit round-robin in closed form.

    Each round, of one sequence's length, gives source s a quantum of its share.
    A source serves whole grains; what is too little for one stays as its
    deficit for the next rounds. So by the end of round j a source has served
    floor(j * quantum / grain) grains, or all it has, whatever the order in
    which tasks compute it, and the stream's length before a source's part of a
    round is the sum of these. In any ``size`` tokens of the stream a source is
    thus within a grain or two of its share. A source that has run out leaves
    its part of later rounds unused: the others keep their proportions.
    """

    def __init__(self, totals: list[int], weights: list[int], size: int, grain: int):
        self.grain, all_ = grain, sum(weights)
        self.totals = np.array(totals, np.int64)
        # Grains served in WEIGHTS rounds; a source of any weight is served at last.
        share = [max(1, size // grain * w * WEIGHTS // all_) if all_ else 1 for w in weights]
        self.up = np.array(share, np.int64)
        self.grains = -(-self.totals // grain)
        #: The round by whose end a source has served all.
        self.last = -(-self.grains * WEIGHTS // self.up)

    def served(self, source: np.ndarray | slice, rounds: np.ndarray) -> np.ndarray:
        """Tokens of the sources served by the end of so many rounds."""
        j = np.minimum(rounds, self.last[source])
        return np.minimum(j * self.up[source] // WEIGHTS * self.grain, self.totals[source])

    def places(self, source: np.ndarray, grain: np.ndarray) -> np.ndarray:
        """Where these grains of the sources begin in the whole stream."""
        up = self.up[source]
        j = -(-(grain + 1) * WEIGHTS // up) - 1  # the round that serves it
        out = grain * self.grain - self.served(source, j)
        every = np.arange(len(self.totals))
        step = max(1, (1 << 20) // max(1, len(every)))
        for low in range(0, len(j), step):
            jj, ss = j[low : low + step, None], source[low : low + step, None]
            out[low : low + step] += self.served(slice(None), jj + (every[None] < ss)).sum(1)
        return out


def cut(source: np.ndarray, start: np.ndarray, size: np.ndarray, rounds: Rounds, whole: int, sequence: int, tail: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence number, offset) of the pieces of documents
    that lie at ``start`` of their sources' queues: cut where a source's part of
    the stream is interrupted and where a sequence ends."""
    g = rounds.grain
    first, last = start // g, (start + size - 1) // g
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    grain = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    s = source[row]
    at = rounds.places(s, grain)
    low = np.maximum(grain * g, start[row])  # in the source's queue
    high = np.minimum((grain + 1) * g, (start + size)[row])
    at += low - grain * g
    # The stream's places where sequences begin, as far as these pieces reach.
    edges = np.array([x for x, _ in tail], np.int64)
    length = high - low
    joined = np.zeros(len(row), bool)
    joined[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + length[:-1])
    heads = np.nonzero(~joined)[0]
    row, low, at = row[heads], low[heads], at[heads]
    length = np.add.reduceat(length, heads) if len(heads) else length
    # A piece is cut at each multiple of ``sequence`` and at each edge of the tail inside it.
    parts = []
    while len(row):
        inside = at < whole
        k = np.searchsorted(edges, at, "right") - 1
        end = np.where(inside, (at // sequence + 1) * sequence, edges[np.minimum(k + 1, len(edges) - 1)])
        take = np.minimum(length, end - at)
        number = np.where(inside, at // sequence, np.array([q for _, q in tail], np.int64)[np.maximum(k, 0)])
        offset = np.where(inside, at % sequence, at - edges[np.maximum(k, 0)])
        parts.append((row, low - start[row], take, number, offset))
        more = length > take
        row, low, at, length = row[more], (low + take)[more], (at + take)[more], (length - take)[more]
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def pack(
    docs: DataFrame,
    weights: Mapping[str | None, int] | None = None,
    tokenizer: str = "byte_bpe_50k.json",
    sequence: int = SEQUENCE,
    grain: int = GRAIN,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Pieces: id_col, source, start, length, ids, doc_tokens, sequence_id, offset.

    Every document's ids (closed by id 1) go, in the order of its source's
    queue, through deficit round-robin (``Rounds``) into one stream, which is
    cut every ``sequence`` tokens, the length of a round. ``weights`` are
    whole-number token proportions by source (a missing one counts 1); by
    default each source's own tokens, so that all run out together and every
    sequence mixes them alike, to within ``grain`` tokens. The stream's last
    tokens form sequences of falling powers of two, which need no padding.

    Queues are the documents in the order of tasks and rows of one reading;
    tokens are written with their place in the task's part of the queue, and
    the tasks' sums by source, prefix-summed and joined back, place the parts:
    nothing but these sums is shuffled while they are few. The driver sees one
    number per source, the configuration of the rounds. Null texts are empty,
    null sources form one source, repeated rows are packed each by itself, very
    long texts are cut like others, columns of any other name are ignored, and
    an empty table gives no pieces.
    """
    table = materialize(token_table(docs, tokenizer, id_col, "text", source_col), "tokens")
    sums = materialize(table.groupBy(F.col("_task").alias("_t"), F.col("_source").alias("_s")).agg(F.sum("doc_tokens").alias("_n")), "token-sums")
    per = sums.groupBy("_s").agg(F.sum("_n").alias("n")).collect()
    total_of = {r["_s"]: r["n"] for r in per}
    sources = sorted(total_of, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    totals = [total_of[s] for s in sources]
    shares = totals if weights is None else [max(1, weights.get(s, 1)) for s in sources]
    rounds, total = Rounds(totals, shares, sequence, min(grain, sequence)), sum(totals)
    whole = total // sequence * sequence
    # The tail's sequences: (first token, sequence number).
    tail, at, k = [], whole, total // sequence
    for bit in reversed(range(sequence.bit_length())):
        if (total - whole) >> bit & 1:
            tail.append((at, k))
            at, k = at + (1 << bit), k + 1
    tail.append((total, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for low, high in _slices(_lengths(whole_batch.column(2))):
                b = whole_batch.slice(low, high - low)
                source = np.array([number[s] for s in b.column(1).to_pylist()], np.int64)
                size, start, before = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
                row, begin, length, seq, off = cut(source, before + start, size, rounds, whole, sequence, tail)
                ids = b.column(2).to_pylist()
                pieces = [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), begin.tolist(), length.tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(begin), pa.array(length), pa.array(pieces, pa.binary()), pa.array(size[row]), pa.array(seq), pa.array(off)],
                    names=[id_col, "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    earlier = Window.partitionBy("_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_t", "_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = table.join(sent_if_few(before), (F.col("_task") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s")))
    placed = placed.select(id_col, "_source", "ids", "doc_tokens", "_start", "_before")
    kind = dict(table.dtypes)[id_col]
    return placed.mapInArrow(run, f"`{id_col}` {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
