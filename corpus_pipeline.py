"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame
that is written as Parquet and read again. All but the last return the columns of ``documents``.

Cases: rows with a null doc_id or text, empty texts and texts of few words pass every stage as clean (packing leaves
an end id for them); rows equal in doc_id and text are one document, kept or dropped together; an empty table gives
no pieces; ties between near-copies go to the smallest doc_id; further columns of ``documents``, whatever their
names, are carried along to the last stage under names of their own, so that no stage overwrites them; ``n_chars``
follows the text where there is such a column. Labels and benchmark are those of ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, decontam, line_dedup, packing, simhash, toxicity
from sluice.llm.queries import tokenizer_path, toxicity_model


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text under names that no operator uses."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_carried_{i}") for i, c in enumerate(others)])


def _back(found: DataFrame, docs: DataFrame, new: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The rows of ``found`` with the columns of ``docs``, but for those in ``new``."""
    others = iter(range(len(docs.columns)))
    names = {c: c if c in ("doc_id", "text") else f"_carried_{next(others)}" for c in docs.columns}
    return found.select(*[(new or {}).get(c, lambda v: v)(F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted to be toxic."""
    model = toxicity_model(docs, common.table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs), model).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat earlier passages; a document of which nothing is left goes."""
    kept = line_dedup.dedup_lines(_aside(docs)).where("n_removed = 0 or length(trim(kept_text)) > 0")
    length = F.length("kept_text").cast("long")
    return _back(kept, docs, {"text": lambda _: F.col("kept_text"), "n_chars": lambda old: F.when(F.col("n_removed") > 0, length).otherwise(old)})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies."""
    return _back(simhash.keep_one(_aside(docs)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth or more is benchmark text."""
    found = decontam.judged(decontam.find(_aside(docs), common.table(spark, sf_dir, "benchmark")))
    return _back(found.where("not contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The scores and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
