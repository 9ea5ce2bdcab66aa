"""Pipeline over documents: quality, near copies, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again for the next one. In every stage further columns, also ones named like a result, go through
as they are, and an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from codecorpus.llm import decontam, mix, ngram_join, quality, secrets
from codecorpus.llm._text import stored


def _table(spark, sf_dir, name):
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule or the trees reject go; the trees learn from the labelled ones of ``docs``.

    Null and empty texts have no words and go; rows that repeat an id are judged each by its own text; without labels
    only the base rule decides.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark, docs, sf_dir):
    """Of each group of documents linked by 80 % of their 5-word shingles, the one with the smallest id stays.

    Documents without shingles and rows with a null id stay; of rows that repeat an id one stays.
    """
    return ngram_join.one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents of which a twentieth or more are words of benchmark windows go; null and empty texts and repeated rows stay."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """Every secret found is replaced in the text by a mark; n_chars follows the new text, and stays where that is null. All rows stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", _length(clean))


def _length(df):
    """n_chars of the texts as they are now, as long."""
    from pyspark.sql import functions as F

    return F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))


def mix_sources(spark, docs, sf_dir):
    """The mix: taken documents, once for each copy, with copy, shard and order_key. Texts without words are never taken; a null source is one of its own."""
    return mix.mix(docs).rows()


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
]

#: SQL can't say what the trees and the network decide.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The mix that is left of ``documents`` after all stages, each fed with the stored result of the one before."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
