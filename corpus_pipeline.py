"""Training-data pipeline over ``documents``: five stages, each written as
Parquet and read again as the next one's input.

1. language_id: rows without letters, without text, or whose language the net
   cannot tell (score near an even guess) go.
2. quality: rows under the classifier's threshold go.
3. near_duplicates: of texts that are linked by five-word shingles at a
   similarity of 0.8 or more, one stays.
4. decontamination: rows that hold a benchmark window go.
5. mixing: the rest is brought to the target weights; one row per document
   and epoch taken, with its tokens.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import decontam, jaccard, langid, mixing, quality
from arrears.llm.store import Scratch, free_name
from arrears.sources.tables import read_table

MIN_MARGIN = 0.15         # of the way from an even guess to certainty


def least_score(languages: int) -> float:
    """The least score that tells one of so many languages: a softmax gives an even guess 1 / languages."""
    even = 1 / languages
    return even + MIN_MARGIN * (1 - even)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the net tells; a corpus without languages to learn passes whole."""
    net = langid.train(spark, docs)
    if net is None:                       # nothing to learn: only what no language can have goes
        return docs.where(F.col("text").rlike(langid.LETTER))
    names = free_name(docs, "_lang"), free_name(docs, "_sure")
    judged = langid.predict(spark, docs, net, names)
    return judged.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least_score(len(net.classes)))).select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts."""
    model = quality.train(spark, docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    name = free_name(docs, "quality_score")
    return quality.score(spark, docs, model, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return jaccard.one_per_group(spark, docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return decontam.clean(spark, docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens)."""
    return mixing.mix_documents(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
]

#: the first two stages are trained models: no SQL says the same
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = s.write(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
