"""Operators for preparing language-model training data.

Functions of this subpackage travel to the Python workers by value, so the
workers need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
