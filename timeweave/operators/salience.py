"""Salience of sentences: a tf-idf model of a corpus, scores of a recording's terms, and the sentences worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeweave.functions.partitions import pieces, spread
from timeweave.operators import terms as found

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{00A0}]+"
#: Words said without meaning, besides a language's stop words.
FILLERS = ("um", "em", "uh", "er", "hm", "hmm", "okay", "right")
STOP_WORDS = tuple(
    """a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her
    here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these
    they this those through to too under until up very was we were what when where which while who whom why will with you your""".split()
)
PUNCTUATION = ',.?!:"*()'


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, those beyond ASCII included; punctuation is left out."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(1))


def without_stop_words(df: DataFrame, term: str = "term") -> DataFrame:
    return df.filter(~F.col(term).isin(*STOP_WORDS, *FILLERS))


def lemmas(df: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """df with terms replaced by their lemma of `dictionary` (form, lemma), where it has one."""
    known = dictionary.select(F.col("form").alias("tw_form"), F.col("lemma").alias("tw_lemma"))
    return df.join(known, F.col(term) == F.col("tw_form"), "left").withColumn(term, F.coalesce("tw_lemma", term)).drop("tw_form", "tw_lemma")


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n: of white-space separated words."""
    return spread(df.select(text)).select(F.explode(F.split(F.col(text), r"[ \t\n\r\f\x0B]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def term_frequencies(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    return spread(df.select(doc, text)).select(doc, F.explode(terms(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """term, df: rows that have the term. Terms are counted where they lie, so that one exchange of (term, rows), summed before it,
    is enough."""
    texts = spread(df.select(F.col(text).cast("string").alias("text"))).select(F.lit(0).alias("tw_split"), F.lower("text").alias("text"))
    return texts.mapInArrow(found.vocabulary, "tw_split int, term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def tfidf(tf: DataFrame, model: DataFrame, n_docs: Column, doc: str) -> DataFrame:
    """doc, term, score: tf * ln(N / df), to unit length per document. Terms that the model lacks are left out."""
    weighed = tf.join(model, "term").withColumn("w", F.col("tf") * F.log(n_docs / F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))
    return weighed.select(doc, "term", F.when(norm > 0, F.col("w") / norm).otherwise(F.lit(0.0)).alias("score"))


def corpus_tfidf(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """What tfidf makes of the corpus's own term_frequencies and document_frequencies, and of the number of its rows: doc, term, score.

    Documents lie in splits by a hash of doc. What is exchanged by term is one row for each term of a split, not of a document; it
    comes back with its idf to the split, whose documents then are counted and scored where they lie, sorted by doc."""
    n = pieces(df)
    split = F.pmod(F.hash(doc), F.lit(n)).alias("tw_split")
    placed = df.filter(F.col(text).isNotNull()).select(split, F.lit(None).cast("double").alias("tw_idf"), F.col(doc).alias("id"), F.col(text).cast("string").alias("text"))
    has = placed.select("tw_split", "text").repartitionById(n, F.col("tw_split")).select("tw_split", F.lower("text").alias("text")).mapInArrow(found.vocabulary, "tw_split int, term string, n long")
    idf = F.log(F.col("n_docs") / F.sum("n").over(W.partitionBy("term")))
    model = has.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_docs")))).select("tw_split", idf.alias("tw_idf"), F.lit(None).cast(df.schema[doc].dataType).alias("id"), F.col("term").alias("text"))
    sorted_ = placed.unionByName(model).repartitionById(n, F.col("tw_split")).sortWithinPartitions("tw_split", F.col("tw_idf").isNull(), "id")
    lowered = sorted_.select("tw_split", "tw_idf", "id", F.when(F.col("tw_idf").isNull(), F.lower("text")).otherwise(F.col("text")).alias("text"))
    return lowered.mapInArrow(found.scores, f"id {df.schema[doc].dataType.simpleString()}, term string, score double").withColumnRenamed("id", doc)


def sentence_scores(tokens: DataFrame, scores: DataFrame, by: str, remove_stop_words: bool = False) -> DataFrame:
    """by, sent_id, score: mean score of a sentence's terms, each as often as it occurs; unknown ones count 0, as does a sentence
    without terms. tokens: by, sent_id, text; scores: by, term, score of the recordings."""
    said = tokens.select(by, "sent_id", F.explode_outer(terms(F.col("text"))).alias("term"))
    if remove_stop_words:
        said = said.withColumn("term", F.when(F.col("term").isin(*STOP_WORDS, *FILLERS), None).otherwise(F.col("term")))
    counted = said.groupBy(by, "sent_id", "term").agg(F.count("*").alias("n"))
    known = counted.join(scores, [by, "term"], "left").withColumn("n", F.when(F.col("term").isNull(), 0).otherwise(F.col("n")))
    total = known.groupBy(by, "sent_id").agg(F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))).alias("s"), F.sum("n").alias("n"))
    return total.select(by, "sent_id", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0)).alias("score"))


def salient_sentences(tokens: DataFrame, model: DataFrame, n_docs: Column, by: str) -> DataFrame:
    """What sentence_scores makes of the tf-idf of the recordings' own terms: by, sent_id, score. model: term, df, and what n_docs needs.

    Every term said is a row that goes to its term for df, and back to its recording, where one sort by term and sentence gives tf
    and the length of the recording's vector; nothing is counted before, and nothing joined to the sentences."""
    said = tokens.select(by, "sent_id", F.explode(terms(F.col("text"))).alias("term")).join(model.withColumn("tw_idf", F.log(n_docs / F.col("df"))), "term").select(by, "sent_id", "term", "tw_idf")
    term = W.partitionBy(by, "term").orderBy("sent_id")
    w = F.count(F.lit(1)).over(term.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.col("tw_idf")
    weighed = said.repartition(by).select(by, "sent_id", w.alias("s"), F.row_number().over(term).alias("tw_k"))
    found = weighed.select(by, "sent_id", "s", F.when(F.col("tw_k") == 1, F.col("s") * F.col("s")).otherwise(0.0).alias("q"), F.lit(0).alias("n"))
    empty = tokens.select(by, "sent_id", F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.size(terms(F.col("text"))).alias("n"))
    total = found.unionByName(empty).groupBy(by, "sent_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    norm = F.sqrt(F.sum("q").over(W.partitionBy(by)))
    return total.withColumn("tw_norm", norm).select(by, "sent_id", F.when((F.col("n") > 0) & (F.col("tw_norm") > 0), F.col("s") / F.col("tw_norm") / F.col("n")).otherwise(F.lit(0.0)).alias("score"))


def labels(scores: DataFrame, ratio: float, by: str, digits: int = 9) -> DataFrame:
    """scores with label: 1 if the score is at least `ratio` times the mean of its recording's sentences."""
    mean = F.avg("score").over(W.partitionBy(by))
    return scores.withColumn("label", (F.round("score", digits) >= F.round(ratio * mean, digits)).cast("double"))


def adjusted_script(text: Column) -> Column:
    """A script's text to compare by: lower case, line ends as spaces, no punctuation, two spaces as one (once)."""
    return F.replace(F.translate(F.translate(F.lower(text), "\n", " "), PUNCTUATION, ""), F.lit("  "), F.lit(" "))


def accuracy(transcript: DataFrame, script: DataFrame, by: str) -> DataFrame:
    """by, accuracy: product, over the transcript's words, of 1 - |n - m| / max(n, m) / (different words of the script), n and m
    being the word's counts in both. Both: by, word, n. Words of the script alone don't count."""
    size = script.groupBy(by).agg(F.count("*").alias("size"))
    joined = transcript.withColumnRenamed("n", "v").join(script.withColumnRenamed("n", "v2"), [by, "word"], "left").join(size, by, "left")
    v2 = F.coalesce("v2", F.lit(0))
    factor = 1 - F.abs(F.col("v") - v2) / F.greatest("v", v2) / F.coalesce("size", F.lit(1))
    return joined.groupBy(by).agg(F.product(factor).alias("accuracy"))
