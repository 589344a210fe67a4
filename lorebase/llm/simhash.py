"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import UPPER, Consumed, connected_components, drop_table, materialize, shuffle_partitions

#: Fingerprints, with their keys, that one task gets on average.
PER_TASK = 20_000
#: Widths of the fingerprint's three segments; each fits a 23-bit Golay word.
SEGMENTS = (22, 21, 21)
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the perfect binary [23,12,7] code.
GENERATOR = 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit polynomial by the generator."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - 11), 0)
    return r


def golay_table() -> np.ndarray:
    """2048 x 6: for each syndrome, the error patterns of weight 4 or less that
    lead to a codeword, the lightest first, -1 where there are fewer.

    The code is perfect, so one pattern has weight 3 or less; if it has exactly
    3, five patterns of weight 4 cover the other 20 positions, else none.
    """
    bits = [1 << i for i in range(23)]
    light = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    triples = [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    fours = [a | b | c | d for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for k, c in enumerate(bits[:j]) for d in bits[:k]]
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for patterns in (light + triples, fours):
        p = np.array(patterns, np.int64)
        for e, s in zip(p.tolist(), _syndromes(p).tolist(), strict=True):
            table[s, used[s]] = e
            used[s] += 1
    return table


def fuzzy_keys(fingerprints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: for each pair of segments, the pair's number with
    every combination of codewords within distance 4 of the two segments.

    Segments 2 bits apart or less share a codeword within distance 4 of both:
    if the one's nearest codeword is 2 away or less, that one; else its six
    patterns split the 23 positions and one of them keeps within distance 4
    after two flips. Four differing bits over three segments leave two segments
    that differ in 2 bits or less together, so linked fingerprints share a key.
    """
    fp = fingerprints.astype(np.uint64)
    near, shift = [], 64
    for width in SEGMENTS:
        shift -= width
        word = ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        errors = table[_syndromes(word)]
        near.append(np.where(errors < 0, -1, (word[:, None] ^ errors) >> 11))  # a codeword is told by its upper 12 bits
    rows, keys = [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        key = (near[i][:, :, None] << 12) | near[j][:, None, :] | (number << 24)
        ok = (near[i] >= 0)[:, :, None] & (near[j] >= 0)[:, None, :]
        rows.append(np.nonzero(ok)[0])
        keys.append(key[ok])
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprint(text: bytes, table: bytes, n: int) -> int:
    import xxhash

    words = text.translate(table).split()  # bytes.split() knows just the six ASCII separators
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= n:
        hs = [hash_(b" ".join(words), 42)]
    else:
        joined, starts, ends, at = b" ".join(words), [], [], 0
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        hs = [hash_(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :], strict=False)]
    votes = np.unpackbits(np.array(hs, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hs)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): the 64-bit SimHash of each whole text as a signed long."""
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [_fingerprint(t.as_py() or b"", lower, shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(id_col, F.col(text_col).cast("string"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, fp long")


def _in_blocks(keyed: DataFrame, large: DataFrame, value: str) -> DataFrame:
    """Adds ``sub``: each pair of blocks of a bucket named in ``large`` (_k, _n) is a bucket of its own."""
    mine = F.pmod(F.xxhash64(value), F.col("_n")).cast("int")
    keyed = keyed.join(large, F.col("key") == F.col("_k"), "left").withColumn("_b", F.coalesce(mine, F.lit(0)))
    keyed = keyed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
    return keyed.withColumn("sub", F.least("_b", "_o").cast("long") * F.lit(1 << 31) + F.greatest("_b", "_o"))


def fingerprint_links(distinct: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of column fp that join
    all that differ in ``radius`` (4 at most) bits or fewer.

    Each fingerprint gets its fuzzy keys; those that meet in a bucket are
    compared, and each task returns a spanning forest of the pairs it verified,
    so a dense group costs as many rows as members, not pairs. A bucket of over
    ``block`` rows is split into blocks, and each pair of blocks is a bucket of
    its own, for any task to compare.
    """
    if radius > 4:
        raise ValueError("three segments prove distances up to 4")
    table = golay_table()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                rows, keys = fuzzy_keys(part.view(np.uint64), table)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = parent[x]
            return x

        kept_k = kept_s = kept_f = None
        none = np.zeros(0, np.int64)

        def pairs(k: np.ndarray, s: np.ndarray, f: np.ndarray) -> list[tuple[int, int]]:
            found, at, step = [], np.arange(len(k) - 1) if len(k) else none, 1
            u = f.view(np.uint64)
            while len(at := at[at + step < len(k)]):
                at = at[(k[at] == k[at + step]) & (s[at] == s[at + step])]
                hit = at[np.bitwise_count(u[at] ^ u[at + step]) <= radius]
                for x, y in zip(f[hit].tolist(), f[hit + step].tolist(), strict=True):
                    if (a := root(x)) != (c := root(y)):
                        parent[max(a, c)] = min(a, c)
                        found.append((x, y))
                step += 1
            return found

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

        for b in batches:
            k, s, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if kept_k is not None:
                k, s, f = np.concatenate([kept_k, k]), np.concatenate([kept_s, s]), np.concatenate([kept_f, f])
            if not len(k):
                continue
            # The last bucket may go on in the next batch.
            last = int(np.searchsorted(k != k[-1], False)) if k[0] != k[-1] else 0
            last = len(k) - int(np.argmax((k[::-1] != k[-1]) | (s[::-1] != s[-1]))) if ((k != k[-1]) | (s != s[-1])).any() else 0
            found = pairs(k[:last], s[:last], f[:last])
            kept_k, kept_s, kept_f = k[last:], s[last:], f[last:]
            if found:
                yield out(found)
        if kept_k is not None and (found := pairs(kept_k, kept_s, kept_f)):
            yield out(found)

    spark = distinct.sparkSession
    # Each fingerprint becomes some 70 rows, so they are dealt out before.
    n = max(shuffle_partitions(spark), math.ceil(distinct.count() / PER_TASK))
    keyed = distinct.select("fp").repartition(n).mapInArrow(spread, "key long, fp long")
    # At most rows / block keys are split; their number is summed before the shuffle.
    large = keyed.groupBy(F.col("key").alias("_k")).count().where(F.col("count") > block).select("_k", F.ceil(F.col("count") / block).cast("int").alias("_n"))
    large = materialize(large, "simhash-large")
    if large.isEmpty():
        keyed = keyed.withColumn("sub", F.lit(0).cast("long"))
    else:
        keyed = _in_blocks(keyed, large, "fp")
    dealt = keyed.select("key", "sub", "fp").repartition(n, "key", "sub").sortWithinPartitions("key", "sub")
    return dealt.mapInArrow(compare, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fp, component_id) for each row of ``docs``.

    component_id is the smallest id whose fingerprint is reachable over links of
    ``radius`` bits or fewer, the row's own included. A null or wordless text
    has fingerprint 0 and links like any other; a null id takes part and gets
    its component, which is null if no member has an id. Repeated rows and
    copies share one fingerprint, which is compared once. Very long texts are
    hashed whole; columns of any other name may be there. An empty table gives
    an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    classes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("_rep")), "simhash-class")
    links = materialize(fingerprint_links(classes, radius), "simhash-links")
    comps = connected_components(links, "simhash-cc")
    # A component is named by its smallest id, not by its smallest fingerprint.
    joined = classes.join(comps, F.col("fp") == F.col("id"), "left").select("fp", "_rep", F.coalesce("component", "fp").alias("_c"))
    names = joined.groupBy(F.col("_c").alias("_n")).agg(F.min("_rep").alias("component_id"))
    named = joined.join(names, F.col("_c") == F.col("_n")).select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def _one_of_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _named, _text): the rows with an id, in a struct; of rows that repeat
    an id the one whose text has the lowest hash, so that reruns agree."""
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col(f"_doc.`{text_col}`").cast("string")
    rows = rows.select("_doc", F.col(f"_doc.`{id_col}`").alias("_named"), F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)).alias("_order"))
    return rows.groupBy("_named").agg(F.min_by("_doc", "_order").alias("_doc")).select("_doc", "_named", text.alias("_text"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each SimHash component: that of the smallest
    id. Rows without an id are kept; of rows that repeat an id, the one whose text
    has the lowest hash. Columns may have any name."""
    first = materialize(_one_of_each(docs, id_col, text_col), "simhash-first")
    found = simhash_components(first.select("_named", "_text"), "_named", "_text", **how)
    stay = found.where(F.col("_named") == F.col("component_id")).select(F.col("_named").alias("_stay")).distinct()
    named = first.join(stay, F.col("_named") == F.col("_stay"), "left_semi").select("_doc.*")
    return named.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


#: Near copies: words of a shingle and least Jaccard similarity of the sets of shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A pair just at the least similarity differs in about this share of its bits
#: (the angle of sets of one size, over pi), and may be missed this often.
NEAR_BITS, NEAR_MISSED = math.acos(2 * NEAR_PERCENT / (100 + NEAR_PERCENT)) / math.pi, 0.002
#: How often Golay words of such a pair have a codeword of ``golay_table`` in common, and codewords of a word on average.
NEAR_SHARED, NEAR_KEYS = 0.602, 5.32
#: Pairs that share a key of a short fingerprint are compared if 128 other bits differ in this many at most
#: (at the least similarity 19 on average, spread 4; of unlike texts 64, spread 6).
NEAR_RADIUS = 40
#: Sets of this many shingles at most are also keyed exactly; a bit says more of them than of large sets.
NEAR_SMALL = 5
_EIGHT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: bytes, table: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words, of all words if there are fewer."""
    import xxhash

    words = text.translate(table).split()
    runs = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], np.uint64))


def long_fingerprint(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """SimHash of 64 bits per block, each block by hashes of its own, as bytes."""
    votes = np.zeros(blocks * 64, np.int64)
    with np.errstate(over="ignore"):
        seeds = np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, len(hashes), 255):  # eight counters to a word hold up to 255
            x = hashes[at : at + 255, None] + seeds
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            votes += _EIGHT[x.view(np.uint8)].sum(0, dtype=np.uint64).view(np.uint8)
    return np.packbits(votes * 2 > len(hashes))


def near_tables(rows: int) -> tuple[int, int]:
    """Number of the short fingerprints, and bits of each beside its Golay word: so
    many that a key is held by some 64 of ``rows`` unlike texts, and as many tables
    as NEAR_MISSED asks for."""
    more = max(0, round(math.log2(max(rows, 1) * NEAR_KEYS / 64)) - 12)
    return math.ceil(math.log(NEAR_MISSED) / math.log(1 - NEAR_SHARED * (1 - NEAR_BITS) ** more)), more


def near_keys(bits: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys from texts x tables x (23 and more) bits: the table's
    number and the other bits with every codeword within distance 4 of the Golay
    word, as far as ``table`` names it (see ``golay_table``)."""
    more = bits.shape[2] - 23
    unit = 1 << np.arange(max(22, more), -1, -1, dtype=np.int64)
    word = bits[:, :, :23] @ unit[-23:]
    errors = table[_syndromes(word)]
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.int64), word.shape)
    if more:
        key = (key << more) | bits[:, :, 23:] @ unit[-more:]
    key = (key[:, :, None] << 12) | (word[:, :, None] ^ errors) >> 11
    ok = errors >= 0
    return np.nonzero(ok)[0], key[ok]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unites the groups of rows ``u`` and ``v`` pair by pair; ``label`` holds the first row of each row's group."""
    while len(u := u[apart := label[u] != label[v]]):
        v = v[apart]
        p, q = label[u], label[v]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label != (up := label[label])).any():
            label[:] = up


def _forest(cls: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """A link from each row to the first one of its group."""
    at = np.nonzero((label != np.arange(len(label))) & (cls[label] != cls))[0]
    return pa.RecordBatch.from_arrays([pa.array(cls[label[at]]), pa.array(cls[at])], names=["u", "v"])


def spanning(links: DataFrame, n: int) -> DataFrame:
    """Links (u, v) that connect what ``links`` do, in fewer rows: a task gets all links
    of a v and links each component's nodes to its least. Of a group whose members
    each have a link per bucket or block they were in, some one link a member is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)]) for b in batches if b.num_rows]
        if found:
            nodes, at = np.unique(np.concatenate(found, axis=1), return_inverse=True)
            at, label = at.reshape(2, -1), np.arange(len(nodes))
            _joined(label, at[0], at[1])
            yield _forest(nodes, label)

    return links.repartition(n, "v").mapInArrow(run, "u long, v long").distinct()


def similar_groups(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """For each of the sets of hashes the first one of its group, groups being
    joined by Jaccard similarities of NEAR_PERCENT or more. With ``right``, whose
    sets count on from those of ``left``, just pairs of one of each are compared.

    Shared hashes are counted exactly through lists of the sets that hold a hash.
    """
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets], np.int64)
    label = np.arange(len(sets))
    if not len(sets) or not sizes.sum():
        return label
    asked = len(left) if right is not None else len(sets)
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    listed = owner >= asked if right is not None else np.ones(len(owner), bool)
    order = np.argsort(number[listed], kind="stable")
    holders = owner[listed][order]
    ends = np.cumsum(np.bincount(number[listed], minlength=len(values)))
    starts, offsets = ends - np.diff(ends, prepend=0), np.concatenate([[0], np.cumsum(sizes)])
    for i in range(asked):
        mine = number[offsets[i] : offsets[i + 1]]
        mine = mine[times[mine] > 1]
        lists = [holders[x:y] for x, y in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
        if not lists:
            continue
        shared = np.bincount(np.concatenate(lists), minlength=len(sets))
        near = np.nonzero((shared > 0) & (100 * shared >= NEAR_PERCENT * (sizes + sizes[i] - shared)))[0]
        _joined(label, np.full(len(near), i), near)
    return label


def near_links(docs: DataFrame, id_col: str, text_col: str, block: int = 4096, together: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(cls, _rep) and links (u, v) between classes: a class is a set of
    shingles with the smallest id that has it, links join what is connected by
    Jaccard similarities, counted exactly, of NEAR_PERCENT or more.

    Candidates share a fuzzy key of one of the short fingerprints (see ``near_keys``)
    and differ in NEAR_RADIUS of 128 other bits at most. Neither candidates nor links
    are written pair by pair: tasks return spanning forests of the candidates of
    a bucket, these are thinned (see ``spanning``), and what they connect meets once
    more, with its texts, where all pairs are verified. A bucket of over ``block``
    rows, or a group of over ``together`` texts or 8 MB of text, is split into blocks,
    and each pair of blocks is a bucket of its own, for any task to compare.
    """
    spark = docs.sparkSession
    lower = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
    docs = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    rows = docs.count()
    tables, more = near_tables(rows)
    width, code = 23 + more, golay_table()
    blocks = 2 + -(-tables * width // 64)
    n = max(shuffle_partitions(spark), math.ceil(rows / PER_TASK))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            cls, bits, small = [], [], []
            for t in b.column(1).cast(pa.binary()):
                h = shingle_hashes(t.as_py() or b"", lower, NEAR_WORDS)
                cls.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                bits.append(long_fingerprint(h, blocks).tobytes())
                small.append((h[:2] >> np.uint64(2)).astype(np.int64).tolist() if len(h) <= NEAR_SMALL else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(small, pa.list_(pa.int64()))], names=[id_col, "cls", "bits", "small"]
            )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                cls = b.column(0).to_numpy(zero_copy_only=False)
                raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(cls), -1)
                fp = np.ascontiguousarray(raw[:, :16]).view(np.int64)
                parts = np.unpackbits(raw[:, 16:], axis=1)[:, : tables * width].reshape(len(cls), tables, width)
                rows, keys = ([x] for x in near_keys(parts, code))
                small = b.column(2).to_pylist()
                keys.append(np.array([k | 1 << 62 for x in small for k in x], np.int64))
                rows.append(np.array([i for i, x in enumerate(small) for _ in x], np.int64))
                r = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), cls[r], fp[r, 0], fp[r, 1])], names=["key", "cls", "f", "g"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of rows sorted by their first two ones, cut where these change."""
        kept = None
        for b in batches:
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            c = c if kept is None else [np.concatenate(x) for x in zip(kept, c, strict=True)]
            if not len(c[0]):
                continue
            other = (c[0] != c[0][-1]) | (c[1] != c[1][-1])
            last = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
            kept = [x[last:] for x in c]
            if last:
                yield [x[:last] for x in c]
        if kept is not None:
            yield kept

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, s, cls, f, g in buckets(batches):
            f, g = f.view(np.uint64), g.view(np.uint64)
            label, at, step = np.arange(len(k)), np.arange(len(k)), 1
            while len(at := at[at + step < len(k)]):
                at = at[(k[at] == k[at + step]) & (s[at] == s[at + step])]
                apart = np.bitwise_count(f[at] ^ f[at + step]) + np.bitwise_count(g[at] ^ g[at + step])
                hit = at[(apart <= NEAR_RADIUS) | (k[at] >= 1 << 62)]
                _joined(label, hit, hit + step)
                step += 1
            yield _forest(cls, label)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[pa.RecordBatch]:
            for b in batches:  # of the texts just the hashes are held
                sets = [shingle_hashes(t.as_py() or b"", lower, NEAR_WORDS).tobytes() for t in b.column(4).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.large_binary())], names=b.schema.names)

        for k, s, cls, side, sets in buckets(hashed()):
            cuts = np.nonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1]))[0] + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                order = x + np.argsort(side[x:y], kind="stable")
                left = order[side[order] == side[order[0]]]
                right = order[len(left) :]
                p, q = ([np.frombuffer(sets[i], np.uint64) for i in part] for part in (left, right))
                # Blocks that meet hold each other's rows only; one by itself is compared within.
                yield _forest(cls[order], similar_groups(p, q if len(q) or s[x] >> 31 != s[x] & 0x7FFFFFFF else None))

    kind = dict(docs.dtypes)[id_col]
    sketches = materialize(docs.mapInArrow(sketch, f"`{id_col}` {kind}, cls long, bits binary, small array<long>"), "near-sketch")
    names = materialize(sketches.groupBy("cls").agg(F.min(id_col).alias("_rep")), "near-class")
    one = sketches.join(names.select(F.col("cls").alias("_c"), "_rep"), (F.col("cls") == F.col("_c")) & (F.col(id_col) == F.col("_rep"))).select("cls", "bits", "small")
    one = materialize(one, "near-one")
    drop_table(sketches)
    keyed = one.mapInArrow(spread, "key long, cls long, f long, g long")
    large = keyed.groupBy(F.col("key").alias("_k")).count().where(F.col("count") > block).select("_k", F.ceil(F.col("count") / block).cast("int").alias("_n"))
    large = materialize(large, "near-large")
    if large.isEmpty():
        keyed = keyed.withColumn("sub", F.lit(0).cast("long"))
    else:
        keyed = _in_blocks(keyed, large, "cls")
    dealt = keyed.select("key", "sub", "cls", "f", "g").repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "cls")
    found = materialize(spanning(dealt.mapInArrow(candidates, "u long, v long"), n), "near-candidates")
    for t in (one, large):
        drop_table(t)
    groups = materialize(connected_components(found, "near-groups"), "near-group")
    drop_table(found)
    texts = names.join(groups, F.col("cls") == F.col("id")).select("cls", "_rep", F.col("component").alias("key"))
    texts = texts.join(docs, F.col("_rep") == F.col(id_col)).select("key", "cls", F.col(text_col).alias("_t"))
    texts = materialize(texts, "near-texts")
    size = F.greatest(F.ceil(F.count("*") / together), F.ceil(F.sum(F.octet_length("_t")) / (8 << 20))).cast("int")
    large = materialize(texts.groupBy(F.col("key").alias("_k")).agg(size.alias("_n")).where("_n > 1"), "near-large-groups")
    met = _in_blocks(texts, large, "cls").select("key", "sub", "cls", F.col("_b").cast("long").alias("_b"), "_t")
    met = met.repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "cls")
    return names, materialize(spanning(met.mapInArrow(verify, "u long, v long"), n), "near-links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component of
    texts that share NEAR_PERCENT of their shingles of NEAR_WORDS words or more.

    Rows without an id are kept; of rows that repeat an id, the one whose text has
    the lowest hash. Null and wordless texts equal each other; very long texts are
    compared whole; columns may have any name; an empty table gives an empty one.
    """
    with Consumed(docs.sparkSession) as made:
        first = made.keep(materialize(_one_of_each(docs, id_col, text_col), "near-first"))
        classes, links = near_links(first.select("_named", "_text"), "_named", "_text")
        comps = connected_components(links, "near-cc")
        joined = classes.join(comps, F.col("cls") == F.col("id"), "left").select("_rep", F.coalesce("component", "cls").alias("_c"))
        stay = made.keep(materialize(joined.groupBy("_c").agg(F.min("_rep").alias("_stay")), "near-stay"))
    kept = first.join(stay, F.col("_named") == F.col("_stay"), "left_semi").select("_doc.*")
    return kept.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
