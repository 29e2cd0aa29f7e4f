"""TF-IDF in relational form, label codes and the stratified split."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywise.constants import MAX_DF, MAX_FEATURES, MIN_DF, SPLIT_SEED, TEST_FRACTION
from tallywise.functions.text import char_ngrams, padded_words, word_ngrams
from tallywise.session import materialise

SPLIT_PREFIX = 4  # hexadecimal digits: 65536 buckets per label


def row_terms(text: Column, analyzer: str = "word") -> Column:
    """All terms of a row, repeats included."""
    if analyzer == "word":
        return word_ngrams(text)
    return F.flatten(F.transform(padded_words(text), lambda w: char_ngrams(w)))


def term_stats(df: DataFrame, text: str, analyzer: str = "word") -> DataFrame:
    """``(term, df, cf)``: rows with the term, and its occurrences.

    A term counts once per row through the row's distinct terms, so nothing is
    shuffled per (row, term): both counts combine on the map side, and only one
    line per task and term is exchanged.
    """
    if analyzer == "word":
        # one pass: the distinct terms and all terms of a row, told apart by position
        lists = df.select(row_terms(F.col(text)).alias("terms")).select(
            F.posexplode(F.array(F.array_distinct("terms"), F.col("terms"))).alias("all", "terms"))
        return (lists.select("all", F.explode("terms").alias("term")).groupBy("term")
                .agg(F.sum(1 - F.col("all")).alias("df"), F.sum("all").alias("cf")))
    once = df.select(F.explode(F.array_distinct(row_terms(F.col(text), analyzer))).alias("term"),
                     F.lit(1).cast("long").alias("df"), F.lit(0).cast("long").alias("cf"))
    # equal words are counted before they are cut into n-grams
    words = df.select(F.explode(padded_words(F.col(text))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    every = counted.select(F.explode(char_ngrams(F.col("word"))).alias("term"),
                           F.lit(0).cast("long").alias("df"), "cf")
    return once.unionByName(every).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(stats: DataFrame, n_rows: Column, min_df: int = MIN_DF, max_df: float = MAX_DF,
               max_features: int = MAX_FEATURES) -> DataFrame:
    """``(term, df, cf, idf)`` of the most frequent terms within the df bounds.

    Ties at the limit go to the smaller term. ``n_rows`` is the number of
    fitted rows.
    """
    fit = (F.col("df") >= min_df) & (F.col("df") <= n_rows * max_df)
    return (stats.where(fit).orderBy(F.desc("cf"), "term").limit(max_features)
            .withColumn("idf", F.log((n_rows + 1) / (F.col("df") + 1)) + 1))


def vector_stages(terms: list[tuple[str, float]]) -> list:
    """From a row's terms to its vector of tf times idf, scaled to length one; ``terms`` are (term, idf) by index."""
    counter = CountVectorizerModel.from_vocabulary([t for t, _ in terms], inputCol="terms", outputCol="term_counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in terms]), inputCol="term_counts", outputCol="scaled")
    return [counter, scale, Normalizer(p=2.0, inputCol="scaled", outputCol="features")]


def indexed_terms(vocab: DataFrame) -> list[tuple[str, float]]:
    """(term, idf) in the order of their indices; a vocabulary has at most ``max_features`` terms."""
    return [(r.term, r.idf) for r in vocab.orderBy(F.desc("cf"), "term").select("term", "idf").collect()]


def weigh(df: DataFrame, row: str, text: str, vocab: DataFrame, analyzer: str = "word", keep: bool = False) -> DataFrame:
    """``(row, term, weight)``: tf times idf, scaled to length one per row.

    A row's sparse vector is made where the row is and taken apart by index, so
    nothing is shuffled per row or term. The names of the indices, at most
    ``max_features``, are broadcast. With ``keep`` a row without a known term
    stays with a null term.
    """
    terms = indexed_terms(vocab)
    if not terms:
        none = df.select(row, F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("weight"))
        return none if keep else none.where(F.lit(False))
    out = df.select(row, row_terms(F.coalesce(F.col(text), F.lit("")), analyzer).alias("terms"))
    for stage in vector_stages(terms):
        out = stage.transform(out)
    vector = out.select(row, F.unwrap_udt("features").alias("v"))
    # vectors of mostly known terms are stored dense
    index = F.when(F.col("v.type") == 0, F.col("v.indices")).otherwise(F.sequence(F.lit(0), F.size("v.values") - 1))
    cells = F.filter(F.arrays_zip(index.alias("i"), F.col("v.values").alias("w")), lambda c: c["w"] != 0)
    spread = (F.explode_outer if keep else F.explode)(cells)
    flat = vector.select(row, spread.alias("c")).select(row, F.col("c.i").alias("_i"), F.col("c.w").alias("weight"))
    names = df.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(terms)], "_i int, term string")
    return flat.join(F.broadcast(names), "_i", "left").select(row, "term", "weight")


def fit_vocabulary(df: DataFrame, text: str, analyzer: str = "word", **limits) -> DataFrame:
    return vocabulary(term_stats(df, text, analyzer), df.agg(F.count(F.lit(1))).scalar(), **limits)


def fit_tfidf(df: DataFrame, row: str, text: str, analyzer: str = "word",
              **limits) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and weights of the same rows."""
    vocab = fit_vocabulary(df, text, analyzer, **limits)
    return vocab, weigh(df, row, text, vocab, analyzer)


def apply_tfidf(df: DataFrame, row: str, text: str, vocab: DataFrame,
                analyzer: str = "word") -> DataFrame:
    """Weights of other rows under a stored vocabulary.

    Every row is kept: one without a known term has a null term and no weight.
    """
    return weigh(df, row, text, vocab, analyzer, keep=True)


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)`` with codes by rank of the sorted distinct labels."""
    names = df.where(F.col(label).isNotNull()).select(label).distinct()
    # the distinct labels are the class list, one row per class
    return names.select(label, (F.row_number().over(Window.orderBy(label)) - 1).alias("code"))


def stratified_split(df: DataFrame, row: str, label: str, fraction: float = TEST_FRACTION,
                     seed: int = SPLIT_SEED) -> DataFrame:
    """Mark ``round(fraction * n)`` rows of each label as test, by seeded hash order.

    A label's last test hash is found from counts: per hash prefix first, then per hash of the one
    prefix that holds it. Rows are compared with it where they are, and no row is shuffled, whatever
    the size of a label; only rows of equal hash that are test rows in part are ranked.
    """
    # rows without a key come first, rows without a label are a class of their own
    digest = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row).cast("string"))), F.lit(""))
    slim = df.select(F.col(label).alias("_class"), digest.alias("_h")).withColumn("_prefix", F.substring("_h", 1, SPLIT_PREFIX))
    counts = slim.groupBy("_class", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    each = Window.partitionBy("_class")
    wanted = counts.withColumn("_test", F.round(F.sum("_n").over(each) * fraction))
    held = _holding(wanted, ["_class"], "_prefix", F.lit(0)).select(
        F.col("_class").alias("_c"), F.col("_prefix").alias("_p"), "_before", "_test")
    near = slim.join(F.broadcast(held), F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_prefix") == F.col("_p")))
    counts = near.groupBy("_class", "_h", "_before", "_test").agg(F.count(F.lit(1)).alias("_n"))
    last = _holding(counts, ["_class"], "_h", F.col("_before")).select(
        F.col("_class").alias("_c"), F.col("_h").alias("_last"), F.col("_n").alias("_ties"), (F.col("_test") - F.col("_before")).alias("_open"))
    last = materialise(df.sparkSession, last, "split")  # one line per label
    marked = df.withColumn("_h", digest).join(F.broadcast(last), F.col(label).eqNullSafe(F.col("_c")), "left")
    is_test = F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False))
    if last.where("_ties > _open").isEmpty():
        return marked.select(*df.columns, is_test.alias("is_test"))
    part = F.coalesce((F.col("_h") == F.col("_last")) & (F.col("_ties") > F.col("_open")), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", row))
    return (marked.where(~part).select(*df.columns, is_test.alias("is_test"))
            .unionByName(marked.where(part).select(*df.columns, (rank <= F.col("_open")).alias("is_test"))))


def _holding(counts: DataFrame, keys: list[str], order: str, before: Column) -> DataFrame:
    """The lines of ``counts`` in which row number ``_test`` of a key lies; ``_before`` is the number of rows ahead of the line."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", before + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return placed.where((F.col("_before") < F.col("_test")) & (F.col("_test") <= F.col("_before") + F.col("_n")))
