"""Corpus pipeline: toxicity, language, near-duplicates, packing, each over all that the last one kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last return the columns of
``documents``; each is written as Parquet and read again before the next.  Null and empty texts are
never toxic; they have no language, so the second stage rejects them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.language import identify, learn_floors, learn_profiles
from marlstone.llm.packing import cut_pieces, pack
from marlstone.llm.similar import similar_groups
from marlstone.llm.toxicity import chain_of, score
from marlstone.session import drop_scratch, materialize, scratch_count, table

VOCABULARY = "word_bpe_49k.json"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(stage: Stage) -> Stage:
    """Runs a stage with all columns but its own renamed, so that none can clash, and names them back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ("doc_id", "text", "lang") else f"aside_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@_aside
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain rejects.

    Null, empty and wordless texts stay; repeated rows share their verdict; texts of any length are
    read whole; an empty table, or one without labels, keeps all it has.
    """
    return score(docs, chain_of(spark, docs, sf_dir)).where(~F.col("rejected")).select(*docs.columns)


@_aside
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those unlike every language of the corpus, judged by learned documents of their length.

    Null and empty texts go; repeated rows share their verdict; without a labelled language nothing is
    known and all go; an empty table gives none.
    """
    train = docs.select("doc_id", "text", "lang")
    profiles = learn_profiles(train)
    found = identify(docs, profiles, keep=tuple(c for c in docs.columns if c != "text"), pass_text=True, floors=learn_floors(train, profiles))
    return found.where("known").select(*docs.columns)


@_aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group that shares four fifths of its five-word shingles.

    Rows without a doc_id can't stand for a group and stay; rows repeated under one doc_id are one
    document and stay together.
    """
    groups = similar_groups(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of at most 4096 tokens.

    Every row is packed, repeated ones and those without an id too; a longer text is cut into pieces;
    an empty table gives no rows.  Only ``doc_id`` and ``text`` are read, so other names can't clash.
    """
    import public_tokenizers

    return pack(cut_pieces(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]
#: No stage can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written into the shared folder and read again; what a stage wrote besides is deleted."""
    docs, start = table(spark, sf_dir, "documents"), scratch_count()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, start, keep_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
