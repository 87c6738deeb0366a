"""Corpus preparation: stages over ``documents``, each written and read again.

1. Texts that the factorization machine finds toxic go.
2. One text of each group of near duplicates stays (shingles of five words,
   similarity 0.8 or more).
3. Texts with a passage of a benchmark item go.
4. Secrets in texts are replaced by a mark.
5. What is left is packed into sequences of 4096 tokens.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns of documents.

The similarity is 0.8 because a lower one would let texts go that share long
passages but differ in a quarter of their words; near copies below it stay.

Cases, in every stage: a row with a null text stays as it is (packed, it is one
separator); an empty text likewise; a null id is a row like others, and of rows
without ids that are near duplicates of nothing with an id one stays; very long
texts are read whole; of texts that tie as near duplicates the smallest id
stays; repeated rows go but for one, unless they have no words; with an empty
``documents`` every stage gives no rows, without ``labels`` no text is toxic, and
without ``benchmark`` none is contaminated; further columns pass through to the
last stage, whatever their names, and packing does not carry them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import decontamination, jaccard, packing, secret_scan, toxicity
from stratakv.llm._store import stored, table, unused


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "toxicity")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: No stage but the redaction is expressible in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
