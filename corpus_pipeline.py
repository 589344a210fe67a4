"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing
and packing, each stage on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm.common import Consumed, Stages, materialize
from lorebase.llm.lines import drop_repeated_lines
from lorebase.llm.mixing import sample_mix
from lorebase.llm.packing import digests, pack
from lorebase.llm.quality import filter_quality
from lorebase.llm.simhash import drop_near_copies

#: A stage first deletes the intermediates of the one before, whose result was written.
_stages = Stages()


@_stages.after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their language and
    source. A null, empty or short text fails; null languages and sources are
    groups; repeated rows are judged alike; an empty table stays empty."""
    return filter_quality(docs)


@_stages.after("quality")
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeats of lines; those left without a line
    go. A null text stays, rows that repeat id and text are one document, an
    empty table stays empty."""
    return drop_repeated_lines(docs)


@_stages.after("lines")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id in each component of texts that share 80 %
    of their 5-word shingles. Rows without an id stay, of rows that repeat an id
    one stays, null texts equal each other, an empty table stays empty."""
    return drop_near_copies(docs)


@_stages.after("near_duplicates")
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets. A
    null source is a source, a text without words has no copies, an empty table
    stays empty."""
    return sample_mix(docs)


@_stages.after("mixture")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in sequences of 2048 tokens, each of the sources'
    proportions. A null text is its closing token, copies are documents of their
    own, an empty table gives no pieces."""
    return digests(pack(docs))


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mixing", mixture), ("packing", packing)]

#: SQL cannot express fingerprints or tokens; a test holds the stages' results against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read by the
    next. What a stage has consumed is deleted once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Consumed(spark) as made:
            docs = made.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        if last is not None:
            last.drop()
        last = made
    return STAGES[-1][1](spark, docs, sf_dir)
