"""JOI-16: which pages name which things, by an automaton of all names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .shared import written

#: Bytes of names that one automaton has, about; more names make more rounds over the pages.
NAME_BYTES = 8 << 20
#: Names that may lie anywhere in a text's letters and digits.
PLAIN = r"^[\p{L}\p{N}]{4,}$"
#: Pages that a task has as Python's texts at once.
PAGES = 200
#: Where a variant is looked for: a text, its letters and digits, or its links.
IN_TEXT, IN_LETTERS, IN_LINKS = 0, 1, 2


def _needed(variants: Column) -> Column:
    """The variants of a name that decide: a text with one whose letters and digits hold
    another one, a plain one of four characters or more, mentions that one too."""
    bare = lambda v: F.when(F.regexp_like(v, F.lit("[ -]")), F.regexp_replace(v, "[^a-z0-9]+", "")).otherwise(v)
    plain = F.filter(variants, lambda v: F.regexp_like(v, F.lit(PLAIN)))
    return F.filter(variants, lambda v: ~F.exists(plain, lambda u: (u != v) & F.contains(bare(v), u)))


def mentioned(pages: DataFrame, names: DataFrame, itself: bool = False, links: bool = False) -> DataFrame:
    """(id, other) for each of ``pages`` (id, body) that mentions a name of ``names``
    (other, of the type of id; name), in one of its variants (SCA-24/25), itself excepted
    unless ``itself``. With ``links`` also those that its wikilinks name (SCA-26), and
    a column linked that says so.

    Each task reads its pages once with an Aho-Corasick automaton over all variants,
    so the cost follows the pages and what is found, not the product of pages and
    names. Names are sent to the tasks NAME_BYTES at a time, all of one thing together.
    """
    spark = pages.sparkSession
    kind = dict(names.dtypes)["other"]
    v = names.select("other", tx.name_variants(F.col("name")).alias("v")).select("other", F.explode(_needed(F.col("v"))).alias("v")).distinct()
    several = F.regexp_like("v", F.lit("[ -]"))
    v = v.where(several | F.regexp_like("v", F.lit(PLAIN))).withColumn("place", F.when(several, IN_TEXT).otherwise(IN_LETTERS))
    if links:
        v = v.unionByName(names.select("other", F.lower("name").alias("v"), F.lit(IN_LINKS).alias("place")).distinct())
    v = written(v, "names")
    # A name of links is no more than a key of a dictionary.
    size = lambda c: F.coalesce(F.sum(F.when(c, F.octet_length("v") + 64)), F.lit(0))
    searched, keys, spaced = v.agg(size(F.col("place") != IN_LINKS), size(F.col("place") == IN_LINKS), F.coalesce(F.bool_or(F.col("place") == IN_TEXT), F.lit(False))).first()
    rounds = max(1, math.ceil(searched / NAME_BYTES), math.ceil(keys / NAME_BYTES / 4))
    low = F.lower("body")
    targets = tx.wikilinks(F.col("body")) if links else F.array().cast("array<string>")
    read = pages.where(low != "").select("id", (low if spaced else F.lit("")).alias("low"), F.regexp_replace(low, "[^a-z0-9]+", "").alias("compact"), targets.alias("links"))
    out = None
    for k in range(rounds):
        own = v.where(F.pmod(F.xxhash64("other"), F.lit(rounds)) == k).groupBy("v", "place").agg(F.collect_set("other").alias("others")).collect()
        sent = spark.sparkContext.broadcast({"names": [(r["v"], r["place"], r["others"]) for r in own]})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            if "found" not in sent.value:  # a worker's next task has them
                found = []
                for place in (IN_TEXT, IN_LETTERS):  # names of several words lie in the text, plain ones in its letters and digits
                    a = ahocorasick.Automaton()
                    for name, at, others in sent.value["names"]:
                        if at == place:
                            a.add_word(name, others)
                    if len(a):
                        a.make_automaton()
                        found.append((place, a))
                sent.value["found"] = found, {name: others for name, at, others in sent.value["names"] if at == IN_LINKS}
            found, keys = sent.value["found"]
            for whole in batches:
                for start in range(0, whole.num_rows, PAGES):
                    b, ids, others, linked = whole.slice(start, PAGES), [], [], []
                    texts = [b.column("low").to_pylist(), b.column("compact").to_pylist()]
                    for row, (i, to) in enumerate(zip(b.column("id").to_pylist(), b.column("links").to_pylist(), strict=True)):
                        link = {o for x in to for o in keys.get(x, ())}
                        hit = ({o for at, a in found for _, x in a.iter(texts[at][row]) for o in x} | link) - (set() if itself else {i})
                        ids += [i] * len(hit)
                        others += hit
                        linked += [o in link for o in hit]
                    cols = [pa.array(ids, b.schema.field("id").type), pa.array(others, b.schema.field("id").type), pa.array(linked, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "other", "linked"])

        part = read.mapInArrow(run, f"id {dict(pages.dtypes)['id']}, other {kind}, linked boolean")
        out = part if out is None else out.unionByName(part)
    return out if links else out.drop("linked")
