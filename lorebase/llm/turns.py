"""Conversation structure repair by Dial's shortest paths over rows and states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import drop_table, materialize, ranked

#: Rows of a conversation that one block has. Blocks are solved apart from each other.
BLOCK = 1024
#: Costs of edits: a truncated row that stays adds to these.
DELETE, INSERT, KEEP, REROLE, STAYS = 3, 2, 0, 2, 1
#: States: nothing yet, after a system turn, a user's, an assistant's. An inserted or rerolled turn leads
#: from each to the state in NEXT; a kept one by its role's initial.
NEXT = (2, 2, 3, 2)
KEEPS = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
#: What is still to be inserted at the end, by state, and its cost.
TAIL = ("", "II", "I", "")
END = tuple(INSERT * len(t) for t in TAIL)
NEVER = 1 << 60
INITIALS, FAULTS, LEGAL = "sua", ("", "blank", "duplicate", "truncated"), ("su", "ua", "au")
ROLE = {2: "user", 3: "assistant"}


def _arcs(code: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows taken, next state) at a row with ``code`` in state q, by letter."""
    initial, fault = divmod(code, 4)
    stays = STAYS if FAULTS[fault] == "truncated" else 0
    yield "D", DELETE, 1, q
    yield "I", INSERT, 0, NEXT[q]
    if FAULTS[fault] in ("", "truncated"):
        if initial < 3 and KEEPS[q][initial] is not None:
            yield "K", KEEP + stays, 1, KEEPS[q][initial]
        yield "R", REROLE + stays, 1, NEXT[q]


def distances(codes: list[int], end: list[int]) -> list[list[int]]:
    """Dial's algorithm against the arcs: the least cost from (row, state) to the end
    of ``codes``, where state q still costs end[q]. Nodes wait in a bucket per cost."""
    size = len(codes)
    back: list[dict[int, list[tuple[int, int, int]]]] = []  # by row: arcs into (row + taken, state)
    for i, code in enumerate(codes):
        into: dict[int, list[tuple[int, int, int]]] = {}
        for q in range(4):
            for _, cost, taken, to in _arcs(code, q):
                into.setdefault(4 * taken + to, []).append((cost, i, q))
        back.append(into)
    dist = [[NEVER] * 4 for _ in range(size + 1)]
    base = min(end)
    buckets: list[list[tuple[int, int]]] = []

    def put(i: int, q: int, d: int) -> None:
        dist[i][q] = d
        while len(buckets) <= d - base:
            buckets.append([])
        buckets[d - base].append((i, q))

    for q, d in enumerate(end):
        if d < NEVER:
            put(size, q, d)
    at = 0
    while at < len(buckets):
        for i, q in buckets[at]:
            if dist[i][q] != at + base:
                continue  # it was reached for less
            arcs = []
            if i < size:
                arcs += back[i].get(q, ())
            if i:
                arcs += back[i - 1].get(4 + q, ())
            for cost, j, p in arcs:
                if at + base + cost < dist[j][p]:
                    put(j, p, at + base + cost)
        buckets[at] = []
        at += 1
    return dist


def walk(codes: list[int], dist: list[list[int]], q: int) -> tuple[str, int]:
    """The least string of edits among the cheapest ones from state q, and the state
    that they end in: from each node the first tight arc by letter."""
    i, letters = 0, []
    while i < len(codes):
        for letter, cost, taken, to in _arcs(codes[i], q):
            if dist[i][q] == cost + dist[i + taken][to]:
                letters.append(letter)
                i, q = i + taken, to
                break
    return "".join(letters), q


def _rows_out(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to (key, block, least costs from each state to each)."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
    for b in batches:
        rows = []
        for key, block, codes in zip(*(b.column(c).to_pylist() for c in ("key", "block", "codes")), strict=True):
            to = [distances(codes, [0 if p == q else NEVER for p in range(4)])[0] for q in range(4)]
            rows.append((key, block, [to[q][p] for p in range(4) for q in range(4)]))
        if rows:
            yield _rows_out(schema, rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transfers, the last block of a conversation first, to the costs that remain behind each block."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("end", pa.list_(pa.int64()))])
    now, end = None, list(END)
    for b in batches:
        rows = []
        for key, block, costs in zip(*(b.column(c).to_pylist() for c in ("key", "block", "costs")), strict=True):
            if key != now:
                now, end = key, list(END)
            rows.append((key, block, end))
            end = [min(costs[4 * p + q] + end[q] for q in range(4)) for p in range(4)]
        if rows:
            yield _rows_out(schema, rows)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their end to the edits, exits and costs from each state, and their counts."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("edits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "head", "foot")]])
    for b in batches:
        rows = []
        for key, block, codes, end in zip(*(b.column(c).to_pylist() for c in ("key", "block", "codes", "end")), strict=True):
            dist = distances(codes, end)
            ways = [walk(codes, dist, q) for q in range(4)]
            initials = [c // 4 for c in codes]
            illegal = sum(not _legal(x, y) for x, y in zip(initials, initials[1:], strict=False))
            faults = [sum(c % 4 == k for c in codes) for k in (1, 2, 3)]
            rows.append((key, block, [w for w, _ in ways], [q for _, q in ways], dist[0], *faults, illegal, initials[0], initials[-1]))
        if rows:
            yield _rows_out(schema, rows)


def _legal(x: int, y: int) -> bool:
    return x < 3 and y < 3 and INITIALS[x] + INITIALS[y] in LEGAL


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walked blocks in their order to the edits that follow those of the block before."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("edits", pa.string()), *[(n, pa.int64()) for n in ("cost", "blank", "duplicate", "truncated", "illegal", "exit")]])
    now, q, foot = None, 0, None
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["key"] != now:
                now, q, foot = r["key"], 0, None
            across = foot is not None and not _legal(foot, r["head"])
            rows.append((now, r["block"], q, r["edits"][q], r["costs"][q] if foot is None else 0, r["blank"], r["duplicate"], r["truncated"], r["illegal"] + across, r["exits"][q]))
            q, foot = r["exits"][q], r["foot"]
        if rows:
            yield _rows_out(schema, rows)


def _by_key(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", *order)


class Repair:
    """The repair of ``turns``, a table of conversations.

    ``summary``: key, conv, rows, gaps, blank, duplicate, truncated, illegal, cost and
    audit of each conversation that has rows. ``repaired``: key, conv, edit, role and
    text of the rows after the edits, those of a conversation one after another.

    Turns are ordered by number, nulls first, of equal ones by role and text. A null
    role or text counts as one space, so such a row is blank or of no known role; a
    null conversation is one of its own; rows that repeat are duplicates; texts may
    be of any length; other columns don't matter; an empty table has no conversation.

    A conversation is cut into blocks of BLOCK rows. The least costs through a block
    from each of the four states to each are a small matrix; summed from the last
    block to the first these tell what remains behind each block, so that all blocks
    can be walked apart, from each state; then one pass chooses the states. Only
    these few numbers and letters of a conversation ever meet in one task, and its
    texts where they are read one after another.
    """

    def __init__(self, turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        space = F.lit(" ")
        rows = turns.select(
            conv_key(F.col(f"`{conv}`")).alias("key"), F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), space).alias("role"), F.coalesce(F.col(f"`{text}`"), space).alias("text"),
        )
        rows = ranked(rows, "key", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "turns")
        self.rows = materialize(rows.withColumn("block", F.floor(F.col("_rank") / BLOCK).cast("long")), "turns-placed")
        # The first of equal rows by rank; written before the join, so that a frequent one can be dealt to many tasks.
        said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
        told = self.rows.select("key", said.alias("said"), "_rank")
        twice = materialize(told.groupBy("key", "said").agg(F.min("_rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "turns-said")
        end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
        fault = F.when(end == "", 1).when(F.col("_rank") > F.col("first"), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
        initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in zip(INITIALS, range(3), strict=True) for x in kv]), F.left("role", F.lit(1))), F.lit(3))
        coded = self.rows.withColumn("said", said).join(twice, ["key", "said"], "left").select("key", "block", "_rank", (4 * initial + fault).cast("int").alias("code"))
        codes = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "code"))), lambda x: x["code"])
        blocks = materialize(coded.groupBy("key", "block").agg(codes.alias("codes")), "turns-blocks")  # BLOCK rows at most
        long = materialize(blocks.where("block = 1").select("key"), "turns-long")
        costs = blocks.join(long, "key", "left_semi").mapInArrow(_transfers, "key string, block long, costs array<long>")
        ends = materialize(_by_key(costs, F.desc("block")).mapInArrow(_ends, "key string, block long, end array<long>"), "turns-ends")
        last = F.array(*[F.lit(x).cast("long") for x in END])
        walked = blocks.join(ends, ["key", "block"], "left").withColumn("end", F.coalesce("end", last))
        walked = walked.mapInArrow(_walked, "key string, block long, edits array<string>, exits array<long>, costs array<long>, blank long, duplicate long, truncated long, illegal long, head long, foot long")
        chosen = _by_key(walked, "block").mapInArrow(_chosen, "key string, block long, start long, edits string, cost long, blank long, duplicate long, truncated long, illegal long, exit long")
        self.chosen = materialize(chosen, "turns-chosen")
        for t in (twice, blocks, long, ends):
            drop_table(t)

    @property
    def summary(self) -> DataFrame:
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
        of = self.rows.groupBy("key").agg(F.first("conv").alias("conv"), gaps.alias("gaps"))
        count = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        inorder = F.array_sort(F.collect_list(F.struct("block", "edits")))
        tail = F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.max_by("exit", "block").cast("int") + 1)
        audit = F.concat(F.array_join(F.transform(inorder, lambda x: x["edits"]), ""), tail)
        return of.join(self.chosen.groupBy("key").agg(*count, audit.alias("audit")), "key")

    @property
    def repaired(self) -> DataFrame:
        kind = dict(self.rows.dtypes)["conv"]
        none = lambda t: F.lit(None).cast(t)
        last = self.chosen.groupBy("key").agg(F.max("block").alias("last"))
        marks = self.chosen.select("key", "block", "start", "edits").join(last, "key").select("key", none(kind).alias("conv"), "block", none("long").alias("_rank"), none("string").alias("role"), F.concat("edits", F.when(F.col("block") == F.col("last"), "+").otherwise("")).alias("text"), "start")
        rows = self.rows.select("key", "conv", "block", "_rank", "role", "text", none("long").alias("start"))
        return _by_key(marks.unionByName(rows), "block", F.asc_nulls_first("_rank")).mapInArrow(_edited, f"key string, conv {kind}, edit string, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows behind their block's edits to the rows that become of them. A + ends the last block's."""
    edits, at, q, now = "", 0, 0, None
    for b in batches:
        schema = pa.schema([("key", pa.string()), b.schema.field("conv"), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out: list[tuple] = []

        def put(key, conv, edit: str, role: str | None, text: str) -> None:
            nonlocal q
            q = KEEPS[q][INITIALS.index(role[0])] if edit == "K" else NEXT[q]
            out.append((key, conv, edit, role if edit == "K" else ROLE[q], text))  # noqa: B023

        left = b.num_rows
        for r in b.to_pylist():
            left -= 1
            if r["start"] is not None:
                edits, at, q, now = r["text"], 0, r["start"], None
                continue
            now = (r["key"], r["conv"])
            while edits[at] == "I":
                put(*now, "I", None, "")
                at += 1
            if edits[at] != "D":
                put(*now, edits[at], r["role"], r["text"])
            at += 1
            if edits[at : at + 1] == "+":
                for _ in TAIL[q]:
                    put(*now, "I", None, "")
        if out:
            yield _rows_out(schema, out)


def conv_key(conv: Column) -> Column:
    """A conversation's name as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def digests(repaired: DataFrame) -> DataFrame:
    """(key, sha256) of each conversation's ``role:text`` lines, from rows that follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("sha256", pa.string())])
        now, h = None, None
        for b in batches:
            out = []
            for key, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if out:
                yield _rows_out(schema, out)
        if now is not None:
            yield _rows_out(schema, [(now, h.hexdigest())])

    return repaired.select("key", "role", "text").mapInArrow(run, "key string, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with known damage, by the checksum of conversation and turn:
    rows dropped, emptied, cut, repeated or given to the user. Nulls are one space."""
    space = F.lit(" ")
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("col")


def repair_report(turns: DataFrame, given: DataFrame) -> DataFrame:
    """One row for each conversation of ``given``, repaired from ``turns``; those of
    which no row is left have zeros, no edits and the digest of an empty text."""
    repair = Repair(turns)
    found = repair.summary.join(digests(repair.repaired), "key", "left").drop("conv")
    every = given.select("conv_id", conv_key(F.col("conv_id")).alias("key")).distinct().join(found, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(given), given)
