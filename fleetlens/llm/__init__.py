"""Operators for training-data pipelines. Nothing else in the package imports this folder.

Functions that run in tasks are shipped with their code, so executors need only
the public libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
