"""The corpus pipeline: stages over documents, each written as Parquet to the shared folder and read again.

Every stage but the last returns the columns of documents. A stage works on all that its predecessor kept.
"""

from pyspark.sql import functions as F

from gridgrove.llm import decontaminate, jaccard, mixing, pii, toxicity
from gridgrove.llm.common import keep_ids, read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Rows cannot be had in SQL: the toxicity stage learns its weights. Tests compare each stage with a brute-force version.
ORACLE_SQL = None


def toxic(spark, docs, sf_dir):
    """Documents that the toxicity model doesn't reject; it learns from labels of the training fold only."""
    labels = read(spark, sf_dir, "labels").where(toxicity.training_rows())
    weights = toxicity.train(docs.where(toxicity.training_rows()), labels)
    scored = toxicity.score(docs.select(*COLUMNS), weights, name="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates, the one of the smallest id; repeated rows of an id become one."""
    found = jaccard.jaccard_join(docs)
    dropped = found.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    repeated = F.col("doc_id").isNull()
    kept = keep_ids(docs.select(*COLUMNS), dropped, "left_anti", "doc_id")
    return kept.where(~repeated).dropDuplicates(["doc_id"]).union(kept.where(repeated))


def uncontaminated(spark, docs, sf_dir):
    """Documents without a word of a benchmark window."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = found.where(F.size("hits") > 0).select("doc_id").distinct()
    return keep_ids(docs.select(*COLUMNS), hit, "left_anti", "doc_id")


def private(spark, docs, sf_dir):
    """All documents, with surrogates in place of personal data, and n_chars of the new texts where it was known."""
    done = pii.pseudonymise(docs.select(*COLUMNS))
    changed = (F.col("n_entities") > 0) & F.col("n_chars").isNotNull()
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark, docs, sf_dir):
    """Documents as often as their source's target weight asks for, in one random order."""
    return mixing.poisson_mix(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", uncontaminated),
    ("PII", private),
    ("mixing sources to target weights", mixed),
]


def run(spark, sf_dir):
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, "stage")
    return docs
