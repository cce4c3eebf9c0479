"""Feature preparation with Spark ML: indices of labels and categories, imputation, scaling, one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.clean import named


def label_indexer(label: str, out: str = "label", order: str = "alphabetAsc") -> StringIndexer:
    """Index of each label; rows without one are skipped. Alphabetical, so balancing cannot reorder it."""
    return StringIndexer(inputCol=label, outputCol=out, handleInvalid="skip", stringOrderType=order)


def category_indexer(cols: Sequence[str], order: str = "frequencyDesc") -> StringIndexer:
    """Index of each value of all columns, in one fit; unseen values and null get the next index."""
    return StringIndexer(
        inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep", stringOrderType=order
    )


def one_hot_encoder(cols: Sequence[str]) -> OneHotEncoder:
    """0/1 vectors of the indices of ``category_indexer``."""
    return OneHotEncoder(
        inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols], handleInvalid="keep"
    )


def mean_imputer(cols: Sequence[str]) -> Imputer:
    """Mean of the known values in place of null and NaN."""
    return Imputer(inputCols=list(cols), outputCols=[f"{c}_imputed" for c in cols], strategy="mean")


def numeric_assembler(cols: Sequence[str]) -> VectorAssembler:
    """One vector of the imputed numbers; incomplete rows are skipped."""
    return VectorAssembler(
        inputCols=[f"{c}_imputed" for c in cols], outputCol="imputed_num_vector", handleInvalid="skip"
    )


def standard_scaler() -> StandardScaler:
    """Mean 0 and sample standard deviation 1."""
    return StandardScaler(
        inputCol="imputed_num_vector", outputCol="scaled_num_features", withStd=True, withMean=True
    )


def feature_assembler(cols: Sequence[str]) -> VectorAssembler:
    """Scaled numbers followed by the one-hot vectors."""
    return VectorAssembler(inputCols=["scaled_num_features", *[f"{c}_ohe" for c in cols]], outputCol="features")


def index_label(df: DataFrame, label: str, out: str = "label", order: str = "frequencyDesc") -> DataFrame:
    """Add the index of the label; by default the most frequent one is 0."""
    return label_indexer(label, out, order).fit(df).transform(df)


def index_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_idx`` for every column."""
    return category_indexer(cols).fit(df).transform(df)


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_imputed`` for every column."""
    return mean_imputer(cols).fit(df).transform(df)


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Spread a vector of known length over columns."""
    parts = vector_to_array(named(vector))
    return df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_scaled`` for every column: imputed, mean 0, standard deviation 1."""
    assembled = numeric_assembler(cols).transform(impute_mean(df, cols))
    scaled = standard_scaler().fit(assembled).transform(assembled)
    spread = vector_columns(scaled, "scaled_num_features", [f"{c}_scaled" for c in cols])
    return spread.drop("imputed_num_vector", "scaled_num_features")


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_ohe``, a 0/1 array, for every column."""
    indexed = index_categories(df, cols)
    encoded = one_hot_encoder(cols).fit(indexed).transform(indexed)
    return encoded.withColumns({f"{c}_ohe": vector_to_array(named(f"{c}_ohe")) for c in cols})
