"""Operators for training-data pipelines, and their queries.

Nothing else in the library imports this subpackage. Functions that run inside tasks are
sent along with the query, so workers need no copy of it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
