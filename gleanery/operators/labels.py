"""Labelling and cleaning of profiles."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CUSTOM_STOP_WORDS
from ..functions.text import blank, clean_tokens, label, normalize, repair_encoding, technician
from .profiles import place_after


def label_programmes(df: DataFrame, name: str = "carrera", to: str = "grado") -> DataFrame:
    """Without technicians' and analysts' programmes; the label stands after the name."""
    return place_after(df.where(~technician(F.col(name))).withColumn(to, label(F.col(name))), to, name)


def stop_list(language: str = "spanish") -> list[str]:
    """Spark's stop words of a language, and the fixed ones."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords(language)) | set(CUSTOM_STOP_WORDS))


def clean_profiles(df: DataFrame, text: str = "perfil_egreso", to: str = "perfil_limpio", language: str = "spanish", annotate=None) -> DataFrame:
    """df with cleaned texts, rows without any word left out. annotate: a function of (tokens column) that drops names and
    gives lemmas, where a model for that is installed; without it tokens are their own lemmas.
    """
    words = clean_tokens(repair_encoding(normalize(F.col(text))), stop_list(language))
    words = annotate(words) if annotate else words
    return df.withColumn(to, F.array_join(words, " ")).where(~blank(F.col(to)))
