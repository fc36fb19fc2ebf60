"""Operators that prepare training corpora. Nothing else in the library imports this package.

Functions that run in tasks are sent by value, so executors need this package's libraries (numpy, pyarrow,
xxhash, pyahocorasick) but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
