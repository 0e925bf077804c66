"""Spark-native curation and evaluation of image and text corpora.

Every operator is a plain ``DataFrame -> DataFrame`` function; Catalyst picks
the physical plan.  See ``README.md`` for the operator catalogue.
"""

__version__ = "0.1.0"
