"""Quality classifier by co-training of two views.

One classifier sees the text (hashed words and word shapes), the other the
page's metadata (source, language, length). Both are logistic regressions
fitted on labelled documents. Over rounds, each scores every unlabelled
document and hands the other those that it is most sure of, as pseudo-labels:
its sureness counts after calibration on held-out labels (Platt scaling), so a
view that tells nothing hands over nothing. In the end the calibrated log-odds
of both views are added, less the prior's, and every document gets a score.

The texts are read once: hashed words and shapes are counted into narrow
features, written to the shared folder, and every later scan reads these. A
round takes from all unlabelled documents: a scan leaves each one's log-odds
of both views, a distributed quantile of them gives each view's thresholds
(ties are parted by the id's hash), and a second scan takes the features of
what is handed over. The labelled documents alone are a bounded sample, the
``LABELLED_ROWS`` with the smallest hashes of their doc_id (one in five held
out).

Defined cases: a null or empty text has no features and is scored by the
intercept and its metadata, a null source or language is a value of its own, a
null length counts as 0; several labels of one doc_id count as the lowest,
several rows of an unlabelled one are handed over once;
without labels of both kinds every document has the share of good labels as
its score (1 if there are none); repeated rows get equal scores; an empty
table gives an empty result; input columns named like a result column give
way to it.
"""

from __future__ import annotations

import math

from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import UPPER, col, materialise, table

LABELLED_ROWS = 10_000
ROUNDS = 2
#: Share of all unlabelled documents that a view hands over per class, more by
#: as much every round.
HANDED = 0.1
#: Rank accuracy of the thresholds: one part in so many.
_QUANTILE = 10_000
#: Calibrated probability from which a pseudo-label counts as sure.
SURE = 0.95
_WORD_BUCKETS = 1 << 14
_SHAPE_BUCKETS = 1 << 10
_RESULT = ["text_score", "metadata_score", "score", "kept"]


def _tokens(text: Column) -> dict[str, Column]:
    """Words, word shapes (a run of lower-case letters is ``a``, of capitals
    ``A``, of digits ``0``, of one symbol that symbol) and shares of a text."""
    blank = r"[\x20\x09-\x0D]+"
    shape = text
    for pattern, mark in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "0"), (r"([^aA0\s])\1+", "$1")):
        shape = F.regexp_replace(shape, pattern, mark)
    full = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / full

    return {
        "_words": F.filter(F.split(F.lower(text), blank), lambda w: w != ""),
        "_shapes": F.filter(F.split(shape, blank), lambda w: w != ""),
        "_upper": share(UPPER),
        "_symbols": share("#*$%&|<>!@^~_=+{}[]"),
        "_digits": share("0123456789"),
        "_blanks": share(" \n\t"),
    }


def _view_columns(source: str, lang: str, n_chars: str, text: str) -> dict[str, Column]:
    size = F.log1p(F.greatest(F.coalesce(col(n_chars).cast("double"), F.lit(0.0)), F.lit(0.0)))
    meta = F.array(
        F.concat(F.lit("source="), F.coalesce(col(source).cast("string"), F.lit("\x00"))),
        F.concat(F.lit("lang="), F.coalesce(col(lang).cast("string"), F.lit("\x00"))),
        F.concat(F.lit("size="), F.floor(size * 2).cast("string")),
    )
    return {**_tokens(F.coalesce(col(text), F.lit(""))), "_meta": meta, "_size": size / 10}


#: Features of a document as they are stored: counts of hashed words and
#: shapes (whole numbers, so they pack well), shares and metadata.
_TEXT_FEATURES = ["_words_tf", "_shapes_tf", "_upper", "_symbols", "_digits", "_blanks"]
_METADATA_FEATURES = ["_meta", "_size"]


class Features:
    """The features of every document: columns ``c0``, ``c1``, ... are the
    input's ``names``, ``id`` is the document's."""

    def __init__(self, rows: DataFrame, names: list[str]) -> None:
        self.rows, self.names = rows, names

    def stored(self) -> "Features":
        """The same, written once to the shared folder; every later scan reads
        the narrow features and no text."""
        from tidecast.session import scratch_path

        spark = self.rows.sparkSession
        path = scratch_path(spark, "cotraining-features")
        self.rows.write.parquet(path)
        return Features(spark.read.parquet(path), self.names)


def featurise(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    keep: list[str] | None = None,
) -> Features:
    """Features of both views, with the columns ``keep`` of ``docs`` (all)."""
    names = docs.columns if keep is None else keep
    rows = docs.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(names)],
        (col(doc_id) if doc_id in docs.columns else F.lit(None)).alias("id"),
        F.xxhash64(col(text), col(source), col(lang), col(n_chars)).alias("_pick"),
        *[c.alias(n) for n, c in _view_columns(source, lang, n_chars, text).items()],
    )
    for column, buckets in (("_words", _WORD_BUCKETS), ("_shapes", _SHAPE_BUCKETS)):
        rows = HashingTF(inputCol=column, outputCol=f"{column}_tf", numFeatures=buckets).transform(rows).drop(column)
    return Features(rows, names)


def _steps() -> dict[str, list[Transformer]]:
    """From the stored features to the vectors of the classifiers."""
    return {
        "text": [
            *[Normalizer(inputCol=f"{c}_tf", outputCol=f"{c}_share", p=1.0) for c in ("_words", "_shapes")],
            VectorAssembler(inputCols=["_words_share", "_shapes_share", *_TEXT_FEATURES[2:]], outputCol="_text_x"),
        ],
        "metadata": [
            HashingTF(inputCol="_meta", outputCol="_meta_tf", numFeatures=256, binary=True),
            VectorAssembler(inputCols=["_meta_tf", "_size"], outputCol="_metadata_x"),
        ],
    }


def _vectors(df: DataFrame, name: str) -> DataFrame:
    for step in _steps()[name]:
        df = step.transform(df)
    return df


def _sigmoid(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


class View:
    """A fitted classifier of one view and its calibration."""

    def __init__(self, name: str, train: DataFrame, held_out: DataFrame) -> None:
        self.name = name
        self.model = self._logistic(f"_{name}_x", f"_{name}").fit(train)
        self.slope, self.offset = 1.0, 0.0
        margins = self.log_odds(held_out).select(array_to_vector(F.array(f"{name}_odds")).alias("x"), "label")
        platt = self._logistic("x", "_platt").fit(margins)
        self.slope, self.offset = float(platt.coefficients[0]), float(platt.intercept)

    @staticmethod
    def _logistic(x: str, out: str) -> LogisticRegression:
        return LogisticRegression(
            featuresCol=x, labelCol="label", rawPredictionCol=f"{out}_raw", probabilityCol=f"{out}_p", predictionCol=f"{out}_class",
            regParam=1e-4, maxIter=15,
        )

    def log_odds(self, df: DataFrame) -> DataFrame:
        """``df`` with the calibrated log-odds of a good document."""
        margin = vector_to_array(f"_{self.name}_raw")[1]
        return self.model.transform(df).withColumn(f"{self.name}_odds", self.slope * margin + self.offset)

    def sure(self, ends: list[float] | None) -> Column:
        """The label that this view is sure of, beyond the thresholds of both
        classes; else null. Ties at a threshold are settled by the id's hash."""
        low, high = ends or (-math.inf, math.inf)
        odds, least, rank = F.col(f"{self.name}_odds"), math.log(SURE / (1 - SURE)), self.rank()
        return F.when((rank >= high) & (odds >= least), 1.0).when((rank <= low) & (odds <= -least), 0.0)

    def rank(self) -> Column:
        """Log-odds with a tiny part from the id's hash, which parts equal ones."""
        return F.col(f"{self.name}_odds") + F.xxhash64("id", F.lit(self.name)) / F.lit(2.0**63) * 1e-6


class CoTrained:
    """Two co-trained views, or one score for all where none can be fitted."""

    def __init__(self, prior: float, views: list[View]) -> None:
        self.prior, self.views = prior, views

    def score(
        self, docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars"
    ) -> DataFrame:
        """``docs`` with both views' scores, the combined score and kept."""
        return self.score_features(featurise(docs, text=text, source=source, lang=lang, n_chars=n_chars))

    def score_features(self, features: Features) -> DataFrame:
        """The same from features, stored ones or not."""
        rows = features.rows
        out = [F.col(f"c{i}").alias(c) for i, c in enumerate(features.names) if c.lower() not in _RESULT]
        if not self.views:
            same = F.lit(self.prior)
            return rows.select(*out, *[same.alias(c) for c in _RESULT[:3]], (same >= 0.5).alias("kept"))
        for view in self.views:
            rows = view.log_odds(_vectors(rows, view.name))
        both = F.col("text_odds") + F.col("metadata_odds") - math.log(self.prior / (1 - self.prior))
        score = _sigmoid(both)
        return rows.select(
            *out,
            _sigmoid(F.col("text_odds")).alias("text_score"),
            _sigmoid(F.col("metadata_odds")).alias("metadata_score"),
            score.alias("score"),
            (score >= 0.5).alias("kept"),
        )


def _smallest(ids: DataFrame, rows: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("id"), "id").limit(rows)


def _one_row(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row of every id, combined before the shuffle."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*fields), "_pick").alias("f")).select("id", "f.*")


def _handed(rows: DataFrame, known: DataFrame, views: list[View], share: float) -> list[DataFrame]:
    """What the metadata view hands to the text view and the other way round:
    the surest of all unlabelled documents, with the taker's features. One
    scan of the stored features finds the thresholds; a second judges the
    metadata again and shuffles only the rows that it hands over."""
    text, metadata = views
    judged = metadata.log_odds(_vectors(rows, "metadata"))
    both = ["text_odds", "metadata_odds", *_METADATA_FEATURES]
    scored = _one_row(text.log_odds(_vectors(judged, "text")).select("id", "_pick", *both), both)
    scored = materialise(scored.join(known, "id", "left_anti"))
    ends = scored.agg(*[F.percentile_approx(v.rank(), [share, 1 - share], _QUANTILE).alias(v.name) for v in views]).first()
    by_text = scored.withColumn("label", text.sure(ends["text"])).dropna(subset=["label"])
    sure = judged.withColumn("label", metadata.sure(ends["metadata"])).dropna(subset=["label"])
    by_metadata = _one_row(sure.select("id", "_pick", "label", *_TEXT_FEATURES), ["label", *_TEXT_FEATURES]).join(known, "id", "left_anti")
    return [
        _vectors(by_metadata, "text").select("id", "label", "_text_x"),
        _vectors(by_text, "metadata").select("id", "label", "_metadata_x"),
    ]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    labelled_rows: int = LABELLED_ROWS,
    rounds: int = ROUNDS,
) -> CoTrained:
    features = featurise(docs, doc_id, text, source, lang, n_chars, keep=[]).stored()
    return fit_features(features, labels, label, doc_id, labelled_rows, rounds)


def fit_features(
    features: Features,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    labelled_rows: int = LABELLED_ROWS,
    rounds: int = ROUNDS,
) -> CoTrained:
    """Co-training on ``features``, which are scanned several times and should
    be stored."""
    known = (
        labels.select(col(doc_id).alias("id"), col(label).cast("double").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    plain = features.rows.filter("id is not null")
    # The sample is bounded, so its ids may go to every task.
    wanted = F.broadcast(materialise(_smallest(known, labelled_rows)))
    fields = ["label", *_TEXT_FEATURES, *_METADATA_FEATURES]
    rows = _one_row(plain.join(wanted, "id"), fields)
    labelled = materialise(_vectors(_vectors(rows, "text"), "metadata").select("id", "label", "_text_x", "_metadata_x"))
    held = F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(5)) == 0
    train, held_out = labelled.filter(~held), labelled.filter(held)
    counts = {(r["held"], r["label"]): r["count"] for r in labelled.groupBy(held.alias("held"), "label").count().collect()}
    good, total = sum(n for (_, y), n in counts.items() if y == 1), sum(counts.values())
    if any(not counts.get((h, y)) for h in (True, False) for y in (0.0, 1.0)):
        return CoTrained(good / total if total else 1.0, [])
    views: list[View] = []
    for turn in range(rounds + 1):
        # Each view learns from what the other was surest of in the last round.
        told = _handed(plain, known, views, min(0.5, turn * HANDED)) if views else [None, None]
        views = [
            View(name, train if more is None else train.select(more.columns).unionByName(more), held_out)
            for name, more in zip(("text", "metadata"), told)
        ]
    return CoTrained(good / total, views)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = featurise(docs, keep=["doc_id"]).stored()
    model = fit_features(features, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return model.score_features(features).select("doc_id", *_RESULT)
