"""Corpus, tokenizer and evaluation jobs on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its few task-side helpers
# travel inside the pickled function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
