"""Foliant: document and e-mail intelligence over whole corpora, written as Spark jobs.

``functions``   column expressions (text, amounts, dates, names, hashes)
``operators``   DataFrame -> DataFrame operators (classification, extraction, matching, ...)
``sources``     readers and writers
``plans``       registered queries with the SQL that checks them
``streaming``   Structured Streaming forms

Functions that run in Python workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
