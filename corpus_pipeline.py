"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns the documents it keeps, with the
columns of documents; the last one returns the sequences. ORACLE_SQL is None, as SQL can't express
the robust estimates, the classifier and the packing; tests hold every stage against a plain version.

In all stages null and empty texts are empty, texts of any length are read whole, an empty table gives an empty one,
and columns may have any names, those that operators give to results included. No stage joins rows by doc_id: null
and repeated ids are rows like others, and a verdict stays with its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticut.llm import classify, near_dups, packing, quality_rules, substrings
from latticut.llm.base import table, written
from latticut.llm.queries import held_out

#: The least score that stays.
LEAST_QUALITY = 0.7


def apart(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that aren't used under names that no operator gives, and the expressions that undo this."""
    names = [c if c in used else f"_column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that fail the base limits or lie far out of their language and source.

    Null and empty texts have no words and go. A null language or source is a group of its own; repeated rows are
    judged alike. A row exactly at the cutoff stays.
    """
    rows, back = apart(docs, ("lang", "source"))
    names = dict(zip(docs.columns, rows.columns, strict=True))
    keep = tuple(c for c in rows.columns if c not in ("lang", "source"))
    rows = rows.withColumns({c: F.col(names[c]) for c in ("doc_id", "text")})
    return quality_rules.judge(rows, keep=keep).where("kept").select(*back)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows that score below LEAST_QUALITY. The model learns from the documents that are still there.

    Rows without an id have no label, but a score like others; so have empty texts. A score of LEAST_QUALITY stays.
    """
    model = classify.quality_model(docs, table(spark, sf_dir, "labels"), where=~held_out())
    rows, back = apart(docs, ("doc_id", "text"))
    scored = classify.quality_scores(rows.withColumn("_whole", F.col("text")), model, text_col="_whole", keep=rows.columns)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*back)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: five-word shingles, similarity 0.8.

    It is the one with the smallest id, a null id last; of rows that repeat that id any one. Rows without words are
    nobody's duplicates and stay.
    """
    rows, back = apart(docs, ("doc_id", "text"))
    # what a row is told by: 128 bits of its id and text
    rows = rows.withColumns({"_c1": F.xxhash64("doc_id", "text"), "_c2": F.xxhash64("text", "doc_id", F.length("text"))})
    found = near_dups.near_duplicates(rows.select("doc_id", "text", "_c1", "_c2"), keep=("_c1", "_c2"))
    told = written(found.groupBy("_c1", "_c2").agg(F.count("*").alias("_n"), F.sum(F.col("first").cast("long")).alias("_stay")).where("_stay < _n"), "verdicts")
    key = ["_c1", "_c2"]
    # of rows that agree in id and text one stays, whichever
    one = rows.join(told.where("_stay > 0"), key, "left_semi").dropDuplicates(key)
    return rows.join(told, key, "left_anti").unionByName(one).select(*back)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 50-byte strings that a row with a smaller id has; n_chars is that of the text that is left.

    All rows stay, if only with an empty text. Rows with a null id lose nothing and take nothing; rows that repeat
    an id take nothing from one another. A character of which bytes were removed goes whole.
    """
    rows, back = apart(docs, ("doc_id", "text", "n_chars"))
    found = substrings.remove_repeats(rows, keep=[c for c in rows.columns if c != "text"], as_text=True)
    changed = found.withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that they are packed into.

    Documents with the same least five-word shingle are a duplicate cluster, as near duplicates proper are gone by
    now; two conflict with the probability of their similarity. Empty texts are pieces of no words. Ties: see packing.
    """
    return packing.pack(docs, cluster=packing.similar_cluster(F.coalesce(F.col("text"), F.lit(""))))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dups", near_dups_stage),
    ("substrings", substrings_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    kept = reduce(lambda d, stage: written(stage[1](spark, d, sf_dir), stage[0]), STAGES[:-1], docs)
    return STAGES[-1][1](spark, kept, sf_dir)
