"""Text classifier: train-only TF-IDF + multinomial logistic regression (pyspark.ml)
(M8-M10, M13-M15, M19, S21, A14).

The vectoriser is learned on the training split only (vocabulary, document
frequencies) and applied unchanged to any other text, including a stream. There
is no Python on the row path. A training text's vocabulary terms are counted in its
row (``count_vectors``: no exchange, no row for a (document, term)) and written as
small sparse vectors; idf and norm are applied as the optimiser reads them. Scoring
needs no vectors: a document's terms meet a (term, idf, weight of each class) table
of at most ``MAX_FEATURES`` rows, one aggregate sums the weighted terms per class,
and the soft-max is a column expression. Ids that repeat are one document, whose rows
are added up (``vectorise``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from civicflow.functions import labels as L
from civicflow.functions import text as T
from civicflow.operators import text as X
from civicflow.operators.common import top_k_per_group
from civicflow.session import drop_scratch, scratch_path

# Classifier settings of the reference (C, iterations, vectoriser).
C = 1.0
MAX_ITER = 1000
TOL = 1e-4  # the reference solver's default stopping tolerance
MAX_FEATURES, MIN_DF, MAX_DF = 10000, 2, 0.95


@dataclass
class TextModel:
    vocab: DataFrame          # term, idx, idf  (<= MAX_FEATURES rows)
    labels: DataFrame         # label, label_idx (one row per class)
    n_features: int
    lr: LogisticRegressionModel

    def weights(self) -> DataFrame:
        """term, idf, coef (one weight a class): the model as a table of ``n_features`` rows."""
        coef = list(enumerate(self.lr.coefficientMatrix.toArray().T.tolist()))  # plain floats, whether Arrow is on or off
        table = self.vocab.sparkSession.createDataFrame(coef, "idx int, coef array<double>")
        return self.vocab.join(table, "idx")


@dataclass
class TrainingVectors:
    vocab: DataFrame          # term, idx, idf
    n_features: int
    rows: DataFrame           # label, features: a row for each training text
    path: str                 # folder of the written vectors
    whole: bool               # features hold tf x idf, L2-normalised; else 1 + ln(tf) alone


def idf() -> Column:
    return F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0


def numbered(terms: DataFrame) -> DataFrame:
    """Alphabetical index, like the reference's feature order."""
    # <= MAX_FEATURES rows (as many for each fold): numbering them in one window is bounded work.
    return terms.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def one_row_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own (ids alone are shuffled)."""
    return docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c")).filter((F.col("_c") > 1) | F.col(id_col).isNull()).isEmpty()


def fit_vectoriser(train: DataFrame, id_col: str, norm_col: str, one_row_docs: bool = False) -> DataFrame:
    """Vocabulary (alphabetical index) and idf of the training texts."""
    tokens = X.document_tokens(train, id_col, norm_col)
    vocab = X.heavy_vocabulary(X.counted_tokens(tokens), X.doc_count(train), min_df=MIN_DF, max_df=MAX_DF, max_features=MAX_FEATURES,
                               one_row_docs=one_row_docs, places=X.occurrences(tokens))
    return numbered(vocab.select("term", idf().alias("idf")))


def _known(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc, idx, tf) of the table's terms (at most MAX_FEATURES), the rows of a ``doc`` added up: one exchange, by doc."""
    known = counts.join(F.broadcast(vocab.select("term", "idx")), "term").filter(F.col("doc").isNotNull())
    return known.select("doc", "idx", "tf").repartition("doc").groupBy("doc", "idx").agg(F.sum("tf").alias("tf"))


def _weighted(known: DataFrame, table: DataFrame) -> DataFrame:
    """``_known`` with the table's columns and tf x idf as ``_w``."""
    j = known.join(F.broadcast(table.drop("term")), "idx")
    return j.withColumn("_w", (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf"))


def vectorise(docs: DataFrame, id_col: str, norm_col: str, vocab: DataFrame, n_features: int) -> DataFrame:
    """(id, features) with sublinear tf x train idf, L2-normalised; texts without any
    vocabulary term get an empty vector. ``features`` is the struct that a sparse vector is
    stored as: ``written_vectors`` makes it one."""
    per_doc = _weighted(_known(X.row_terms(docs, id_col, norm_col), vocab), vocab).groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("idx", "_w"))).alias("_t"), F.sqrt(F.sum(F.col("_w") ** 2)).alias("_n")
    )  # one document's terms: bounded by MAX_FEATURES
    features = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(n_features).alias("size"),
        F.coalesce(F.col("_t")["idx"], F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.transform("_t", lambda t: t["_w"] / F.col("_n")), F.array().cast("array<double>")).alias("values"))
    ids = docs.select(F.col(id_col).alias("doc"))
    return ids.join(per_doc, "doc", "left").select(F.col("doc").alias(id_col), features.alias("features"))


def count_vectors(tokens: DataFrame, vocab: DataFrame, n_features: int, path: str) -> DataFrame:
    """``tokens`` (..., _tok) with ``features``, the struct of a sparse vector of 1 + ln(tf), instead of the words; every row
    is a document. The counts are found in the row through a hash table of the vocabulary and written to ``path``."""
    if n_features == 0:
        empty = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("indices"),
                         F.array().cast("array<double>").alias("values"))
        return tokens.drop("_tok").withColumn("features", empty)
    terms = [r[0] for r in vocab.select("term").orderBy("idx").collect()]  # the vocabulary: <= MAX_FEATURES a fold
    count = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="features", minTF=1.0)
    words = F.coalesce("_tok", F.array().cast("array<string>"))  # a null text has no terms
    rows = count.transform(tokens.withColumn("_tok", words).withColumn("_terms", X.ngram_terms(F.col("_tok")))).drop("_tok", "_terms")
    rows.write.option("compression", "zstd").parquet(path)
    fields = [StructField("features", VectorUDT.sqlType()) if f.name == "features" else f for f in rows.schema]
    rows, at = tokens.sparkSession.read.schema(StructType(fields)).parquet(path), F.col("features")
    return rows.withColumn("features", F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(n_features).alias("size"), at["indices"].alias("indices"),
        F.transform(at["values"], lambda tf: 1.0 + F.log(tf)).alias("values")))


def _new_path(df: DataFrame, name: str) -> str:
    return scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")


def written_vectors(data: DataFrame, path: str | None = None) -> DataFrame:
    """``data`` written under the shared checkpoint folder and read back with ``features`` as vectors
    (an iterative fit reads its input many times)."""
    path = path or _new_path(data, "features")
    data.write.option("compression", "zstd").parquet(path)
    fields = [StructField("features", VectorUDT()) if f.name == "features" else f for f in data.schema]
    return data.sparkSession.read.schema(StructType(fields)).parquet(path)


def prepare(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("norm", T.strip_accents(T.normalise_text(F.col(text_col))))


def _written_counts(tokens: DataFrame, label_col: str, vocab: DataFrame, n_features: int, path: str) -> DataFrame:
    """``count_vectors`` as ``written_vectors``: vectors need a write and a read, the whole counts go then."""
    counts = _new_path(tokens, "counts")
    rows = written_vectors(count_vectors(tokens, vocab, n_features, counts).withColumnRenamed(label_col, "label"), path)
    drop_scratch(tokens.sparkSession, counts)
    return rows


def training_vectors(train: DataFrame, id_col: str, label_col: str) -> TrainingVectors:
    """The vectoriser of the training texts (``norm``: text or words) and their written vectors."""
    if not isinstance(train.schema["norm"].dataType, ArrayType):
        train = X.written_words(train.select(id_col, label_col, "norm"), "norm")
    single, path = one_row_ids(train, id_col), _new_path(train, "features")
    vocab = fit_vectoriser(train, id_col, "norm", single).checkpoint()
    n_features = vocab.count()
    if single:
        tokens = X.document_tokens(train, id_col, "norm", [label_col]).drop("doc")
        return TrainingVectors(vocab, n_features, _written_counts(tokens, label_col, vocab, n_features, path), path, False)
    feats = vectorise(train, id_col, "norm", vocab, n_features)
    data = feats.join(train.select(id_col, F.col(label_col).alias("label")), id_col)
    return TrainingVectors(vocab, n_features, written_vectors(data.select("label", "features"), path), path, True)


def left_out_vectors(train: DataFrame, id_col: str, label_col: str, part: str) -> dict[int, TrainingVectors] | None:
    """``training_vectors`` of the training texts without one part, for each part: the words (``norm``) are read for all
    parts at once, and one set of vectors over the union of the vocabularies is written. None where an id repeats:
    its rows may lie in several parts, so each part needs counts of its own."""
    if not one_row_ids(train, id_col):
        return None
    tokens = X.document_tokens(train, id_col, "norm", [label_col, part])
    vocabs = X.left_out_vocabularies(tokens.drop(label_col), part, MIN_DF, MAX_DF, MAX_FEATURES)
    vocabs = vocabs.select(part, "term", idf().alias("idf")).checkpoint()
    union = numbered(vocabs.select("term").distinct()).checkpoint()
    n_features, path = union.count(), _new_path(train, "features")
    rows = _written_counts(tokens.drop("doc"), label_col, union, n_features, path)
    parts = [r[0] for r in rows.select(part).distinct().collect()]  # the folds
    return {p: TrainingVectors(vocabs.filter(F.col(part) == p).select("term", "idf").join(F.broadcast(union), "term").checkpoint(), n_features,
                               rows.filter(F.col(part) != p).select("label", "features"), path, False) for p in parts}


def scaled(vectors: TrainingVectors) -> DataFrame:
    """(label, features) with tf x idf, L2-normalised, computed where it is read."""
    if vectors.whole or vectors.n_features == 0:
        return vectors.rows
    weight = [0.0] * vectors.n_features  # a term that is not in this vocabulary weighs nothing
    for r in vectors.vocab.select("idx", "idf").collect():  # <= MAX_FEATURES rows
        weight[r[0]] = r[1]
    rows = ElementwiseProduct(scalingVec=Vectors.dense(weight), inputCol="features", outputCol="_w").transform(vectors.rows)
    rows = Normalizer(p=2.0, inputCol="_w", outputCol="_v").transform(rows)
    return rows.select("label", F.col("_v").alias("features"))


def fit(train: DataFrame, id_col: str, label_col: str, vectors: TrainingVectors | None = None) -> TextModel:
    """M8: vectoriser + LR (multinomial, L2; inverse strength C mapped to regParam = 1 / (C n)). ``vectors``: those of
    ``left_out_vectors``, if there are any."""
    labels = train.select(label_col).distinct()
    labels = labels.withColumn("label_idx", (F.row_number().over(Window.orderBy(label_col)) - 1).cast("double"))
    labels = labels.withColumnRenamed(label_col, "label").checkpoint()  # one row per class
    own = vectors or training_vectors(train, id_col, label_col)
    data = scaled(own).join(F.broadcast(labels), "label").select("features", "label_idx")
    n = data.count()
    lr = LogisticRegression(
        featuresCol="features", labelCol="label_idx", family="multinomial",
        regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=MAX_ITER, tol=TOL,
    ).fit(data)
    train.sparkSession._jvm.System.gc()  # each evaluation left a shuffle; its files go once the driver's garbage is collected
    if not vectors:
        drop_scratch(train.sparkSession, own.path)
    return TextModel(own.vocab, labels, own.n_features, lr)


def predict(model: TextModel, docs: DataFrame, id_col: str) -> DataFrame:
    """Predicted class, max-probability confidence, band (S21), probability array.

    The margin of a class is its intercept plus the sum of the document's normalised weights times
    the class's weights; all classes and the norm come from one aggregate by document."""
    intercepts = model.lr.interceptVector.toArray().tolist()
    known = _known(X.row_terms(docs, id_col, "norm"), model.vocab)
    sums = _weighted(known, model.weights()).groupBy("doc").agg(
        F.sqrt(F.sum(F.col("_w") ** 2)).alias("_n"),
        *(F.sum(F.col("_w") * F.col("coef")[k]).alias(f"_m{k}") for k in range(len(intercepts))))
    margins = F.array(*(F.lit(b) + F.coalesce(F.col(f"_m{k}") / F.col("_n"), F.lit(0.0)) for k, b in enumerate(intercepts)))
    scored = docs.select(F.col(id_col).alias("doc")).join(sums, "doc", "left").select(F.col("doc").alias(id_col), margins.alias("_m"))
    scored = scored.withColumn("_e", F.transform("_m", lambda m: F.exp(m - F.array_max("_m"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)
    out = scored.select(id_col, F.transform("_e", lambda e: e / total).alias("probs"))
    conf = F.array_max("probs")
    out = out.withColumn("label_idx", (F.array_position("probs", conf) - 1).cast("double"))
    out = out.join(F.broadcast(model.labels), "label_idx")  # one row per class
    return out.select(
        id_col, F.col("label").alias("predicted"), F.round(conf, 3).alias("confidence"),
        L.confidence_band(conf).alias("confidence_band"), "probs",
    )


def top_classes(model: TextModel, scored: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """The k most probable classes per text (classes per text are few)."""
    ex = scored.select(id_col, F.posexplode("probs").alias("pos", "probability"))
    ex = ex.join(F.broadcast(model.labels), F.col("pos").cast("double") == F.col("label_idx"))
    w = Window.partitionBy(id_col).orderBy(F.desc("probability"), "label")
    return (
        ex.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(id_col, "rank", F.col("label").alias("category"), F.round("probability", 4).alias("probability"))
    )


def top_terms(model: TextModel, k: int = 10) -> DataFrame:
    """The k largest coefficients per class, joined to their terms and formatted."""
    cells = model.weights().select("term", F.posexplode("coef").alias("pos", "coef"))  # the model itself
    j = cells.join(model.labels, F.col("pos").cast("double") == F.col("label_idx"))
    top = top_k_per_group(j, ["label"], [F.desc("coef"), F.asc("term")], k, ["term"])
    packed = top.groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", F.col("coef").alias("weight")))).alias("t")
    )
    return packed.select(F.col("label").alias("category"), T.format_terms(F.col("t")).alias("top_terms"))


def save(model: TextModel, path: str) -> None:
    """A14 sink: the LR model plus the vectoriser and label tables as Parquet."""
    model.lr.write().overwrite().save(f"{path}/lr")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    model.labels.write.mode("overwrite").parquet(f"{path}/labels")


def load(spark, path: str) -> TextModel:
    """A14 source."""
    vocab = spark.read.parquet(f"{path}/vocab")
    return TextModel(vocab, spark.read.parquet(f"{path}/labels"), vocab.count(),
                     LogisticRegressionModel.load(f"{path}/lr"))
