"""Training-data operators for large text corpora (language, licences, shards, quality,
line and near duplicates, benchmark leaks, packing, exact search, personal data).

Nothing else in the library imports this subpackage.  Functions that run in Python
workers are shipped by value, so executors need no copy of the library.
"""

from pyspark import cloudpickle

import plotline

cloudpickle.register_pickle_by_value(plotline)
