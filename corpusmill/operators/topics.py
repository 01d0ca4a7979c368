"""Discovery of topics: word and word-pair weights, clusters by k-means, topics by LDA, on Spark's own library."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_document, fold

#: Words that tell nothing.
STOP = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "that", "this", "with", "as", "are", "be", "or", "an", "by", "de", "la", "que", "os", "as", "um", "uma", "para", "com", "não", "do", "da", "em", "http", "https", "www", "com")
MIN_WORDS, FEATURES, SEED = 15, 1 << 14, 20261031


def terms(docs: DataFrame, text: str) -> DataFrame:
    """Adds terms: words and pairs of words of the cleaned, folded text; documents of too few words go."""
    words = F.filter(F.split(F.lower(fold(clean_document(F.col(text)))), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))
    made = docs.withColumn("_w", words).where(F.size("_w") >= MIN_WORDS)
    pairs = F.zip_with("_w", F.slice("_w", 2, F.size("_w")), lambda a, b: F.concat_ws(" ", a, b))
    return made.withColumn("terms", F.concat("_w", F.filter(pairs, lambda p: F.contains(p, F.lit(" "))))).drop("_w")


def clusters(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Rows (key, cluster) by k-means on unit TF-IDF vectors; terms in fewer than two documents weigh nothing."""
    stages = [HashingTF(inputCol="terms", outputCol="tf", numFeatures=FEATURES), IDF(inputCol="tf", outputCol="weighed", minDocFreq=2), Normalizer(inputCol="weighed", outputCol="features"), KMeans(k=k, seed=SEED, predictionCol="cluster")]
    rows = terms(docs, text)
    return Pipeline(stages=stages).fit(rows).transform(rows).select(key, "cluster")


def topics(docs: DataFrame, text: str, k: int, top: int = 12) -> DataFrame:
    """Rows (topic, terms): the heaviest terms of each LDA topic."""
    rows = terms(docs, text)
    counter = CountVectorizer(inputCol="terms", outputCol="features", minDF=2.0, maxDF=0.9, vocabSize=20_000).fit(rows)
    model = LDA(k=k, seed=SEED, maxIter=10).fit(counter.transform(rows))
    names = F.array(*map(F.lit, counter.vocabulary)) if len(counter.vocabulary) <= 5_000 else None
    found = model.describeTopics(top)
    if names is not None:
        return found.select("topic", F.transform("termIndices", lambda i: F.element_at(names, i + 1)).alias("terms"))
    table = docs.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "i int, term string")
    return found.select("topic", F.posexplode("termIndices").alias("p", "i")).join(table, "i").groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("terms"))


def is_candidate(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Adds candidate: whether none of a row's top terms is known."""
    return rows.withColumn("candidate", ~F.arrays_overlap("terms", F.array(*map(F.lit, vocabulary))))
