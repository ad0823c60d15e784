"""feedpulse: Spark-native content and sentiment analytics.

Column functions live in ``feedpulse.functions`` (take and return ``Column``),
table operators in ``feedpulse.operators`` (take and return ``DataFrame``),
readers/adapters/sinks in ``feedpulse.sources``, registered end-to-end
queries in ``feedpulse.plans`` and Structured Streaming jobs in
``feedpulse.streaming``.

Python functions of the package travel to executors by value, so a job needs no copy of
the package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
