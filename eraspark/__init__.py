"""eraspark: Spark-native jobs for studying how the language of a text corpus
changes over time (cleaning, de-duplication, era binning, sampling, TF-IDF,
token rankings, linear text models, evaluation reports, page ingestion).

Every operator is a function ``DataFrame -> DataFrame`` or ``Column -> Column``
built on Spark SQL; Python workers are used only for HTML parsing.
"""

__version__ = "0.1.0"
