"""A training-corpus pipeline from five operators; each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared scratch folder and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxlab.llm import bpe, decontaminate, lines, simhash, toxicity
from proxlab.llm.common import saved
from proxlab.llm.queries import remainder, table, vocabulary


def beside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list]:
    """(``docs`` with columns that an operator would replace renamed, the columns of ``docs`` under their names)."""
    away = {c: f"_kept{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in added}
    back = [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]
    return docs.select(*[docs[f"`{c}`"].alias(away.get(c, c)) for c in docs.columns]), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models reject go.

    A null or word-less text scores the base rate of the labels and stays while that is under the threshold; rows
    without a doc_id are judged by their text alone; repeated rows are judged alike; without labels of both classes
    all stay or go by the base rate.  An empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    apart, back = beside(docs, ("score", "predicted"))
    return toxicity.score(apart, model).where("predicted = 0").select(*back)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across a source's documents go; a document stays, with n_chars of what is left.

    Copies count as one document here: near-duplicate removal, which follows, keeps one of them with its text.
    A line stays in the document of the smallest doc_id of its source that bears it (and in the copies of that one), so
    that text shared by a group of near copies is kept once.  A null source is a source of its own; a null
    text stays null, with null n_chars; bearers without a doc_id come last.  An empty table stays empty.
    """
    out = lines.drop_boilerplate(docs, "source", counts=False, once=True, keep_first="doc_id")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id.

    Rows without a doc_id stay; of repeated rows of the smallest doc_id one stays.  Null and empty texts have
    fingerprint zero and form a group like any other.  An empty table stays empty.
    """
    groups = saved(simhash.near_duplicates(docs, max_bits=4, shingle_words=4), "near-duplicates")
    stay = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    once, more = (stay.where(w).select("doc_id") for w in ("rows = 1", "rows > 1"))
    named = docs.where("doc_id IS NOT NULL")
    rest = [f"`{c}`" for c in docs.columns if c != "doc_id"]
    first = named.join(more, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*rest), F.coalesce(F.xxhash64("text"), F.lit(0))).alias("r")).select("doc_id", "r.*")
    return (named.join(once, "doc_id", "left_semi").select(*docs.columns).unionAll(first.select(*docs.columns))
            .unionAll(docs.where("doc_id IS NULL")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in windows of benchmark items go.

    Null and word-less texts hold no window and stay, rows without a doc_id and repeated rows are judged by their text;
    with an empty benchmark all stay.  An empty table stays empty.
    """
    apart, back = beside(docs, ("n_words", "n_hit", "items", "spans"))
    found = decontaminate.find(apart, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*back)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of what is left: [doc_id, n_tokens, ids, digests], one row per row.

    A null text counts as empty and has no tokens; a null doc_id stays null; columns other than doc_id and text go.
    """
    return bpe.encode(docs.select("doc_id", "text"), vocabulary()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]
#: stages 1, 3 and 5 have no SQL form; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
