"""Paragraphs found by an index that is stored once and asked by any number of questions.

A term holds letters and digits only, so a paragraph contains it exactly if one of the paragraph's
words does. The index has two tables: ``postings``, the words of every paragraph, kept by document, and
``vocabulary``, the distinct words with the three letters that they hold. A term is looked up under the
rarest of its own three letters and verified, so no term is searched in a paragraph, and no text is read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwright.functions.text import paragraphs, words
from poolwright.operators.ordering import joined_by_share
from poolwright.operators.retrieval import question_terms
from poolwright.session import materialize

GRAM = 3
#: Words held by more than one in so many postings are broadcast with their terms: there are no more of them than this.
HOT_WORDS = 200_000
#: Documents are of one kind if a hash of their questions is equal, modulo this.
KINDS = 4_096
#: Terms of all kinds that are broadcast at most.
KNOWN_AT_ONCE = 200_000


def grams(word: Column) -> Column:
    """The distinct runs of three characters in a word of three or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (GRAM - 1)), lambda i: F.substring(word, i, F.lit(GRAM))))


@dataclass(frozen=True)
class TermIndex:
    """``postings``: doc_id, paras (the words of each paragraph, joined by spaces). ``vocabulary``: word, n (paragraphs that hold it), grams."""

    postings: DataFrame
    vocabulary: DataFrame


def write_index(docs: DataFrame, path: str, delimiter: str = "\n\n") -> None:
    """Store the index of ``docs`` (doc_id, text; a doc_id occurs once) under ``path``.

    Postings are made in the scan, without a shuffle. Null texts and texts without words have none.
    """
    paras = F.transform(paragraphs("text", delimiter), lambda p: F.array_join(words(p, GRAM), " "))
    docs.select("doc_id", paras.alias("paras")).write.parquet(f"{path}/postings")
    counted = each_posting(docs.sparkSession.read.parquet(f"{path}/postings")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted.withColumn("grams", grams(F.col("word"))).write.parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


def each_posting(postings: DataFrame) -> DataFrame:
    """One row per word of a paragraph instead of ``paras``: the other columns, idx, word."""
    rest = [c for c in postings.columns if c != "paras"]
    held = postings.select(*rest, F.posexplode("paras").alias("idx", "_words")).filter("_words != ''")
    return held.select(*rest, "idx", F.explode(F.split("_words", " ")).alias("word"))


def words_with(index: TermIndex, terms: DataFrame) -> DataFrame:
    """The words of the index that contain one of the ``terms`` (term): word, n, terms.

    A term of which some three letters occur in no word is in none. The list of a word is bounded by the runs inside it.
    """
    under = index.vocabulary.select(F.explode("grams").alias("gram"), "word", "n")
    known = under.groupBy("gram").agg(F.count(F.lit(1)).alias("_words"))
    looked = terms.select("term").distinct().select("term", F.explode(grams(F.col("term"))).alias("gram"))
    counted = looked.join(known, "gram", "left").withColumn("_words", F.coalesce("_words", F.lit(0)))
    rarest = counted.groupBy("term").agg(F.min(F.struct("_words", "gram")).alias("_least")).filter("_least._words > 0")
    # Stored, so that the planner knows how few terms there are.
    met = materialize(rarest.select("term", F.col("_least.gram").alias("gram"))).join(under, "gram")
    return met.filter(F.contains("word", "term")).groupBy("word").agg(F.first("n").alias("n"), F.collect_set("term").alias("terms"))


def indexed_scores(index: TermIndex, questions: DataFrame, requests: DataFrame) -> DataFrame:
    """What ``retrieval.paragraph_scores`` returns, from the index: question_id, doc_id, idx, score above zero.

    ``questions``: question_id (once each), text. ``requests``: question_id, doc_id; a request that is
    repeated is returned as often as it was made, one without a document or question finds nothing.
    Only postings of requested documents are read on. A word that a large share of all paragraphs hold stays where it is:
    its terms are broadcast.

    Documents about which the same is asked are of one ``kind``. As long as all kinds together know few terms, a posting
    is met with those of its own kind where it lies, and only what is left is shuffled to the requests of its document.
    A kind may take in documents asked something else; the requests decide.
    """
    asked = materialize(question_terms(questions.select("question_id", "text")).select("question_id", F.explode("terms").alias("term")))
    pairs = requests.filter(F.col("doc_id").isNotNull()).groupBy("question_id", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    pairs = materialize(pairs)
    kinds = materialize(pairs.groupBy("doc_id").agg(F.pmod(F.bit_xor(F.xxhash64("question_id")), F.lit(KINDS)).alias("_kind")))
    of_kind = pairs.join(kinds, "doc_id").select("_kind", "question_id").distinct()
    # A hash of both is a shorter key than the term, and lets hardly anything else through.
    key = F.xxhash64("_kind", "term").alias("_key")
    known = materialize(of_kind.join(asked, "question_id").select(key).distinct())
    found = materialize(words_with(index, asked))
    postings = each_posting(index.postings.join(kinds, "doc_id"))
    hits = joined_by_share(postings, found, ["word"], "n", HOT_WORDS).select("doc_id", "_kind", "idx", F.explode("terms").alias("term"))
    if known.count() <= KNOWN_AT_ONCE:
        hits = hits.withColumn("_key", key).join(F.broadcast(known), "_key", "left_semi")
    # A paragraph counts a term once, whichever of its words hold it.
    wanted = pairs.join(asked, "question_id")
    scored = hits.join(wanted, ["doc_id", "term"]).select("question_id", "doc_id", "_times", "idx", "term").distinct()
    counts = scored.groupBy("question_id", "doc_id", "idx", "_times").agg(F.count(F.lit(1)).cast("int").alias("score"))
    return counts.select("question_id", "doc_id", "idx", "score", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("col")
