"""Training-data operators: language, markup, duplicates, leaks, archives, urls, quality, tokens, chats.

Each operator takes DataFrames, reads only the columns it is told to, and returns its key with
its results, so that other columns of the input may have any name.  Functions that run in Python
workers are sent with the job, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
