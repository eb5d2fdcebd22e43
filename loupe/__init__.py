"""loupe: exploratory and time-series analytics as Spark DataFrame operators.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects and is
written with built-in Spark SQL functions, windows, joins and ``pyspark.ml``
so that Catalyst plans the work and executors do it.
"""

import sys

from pyspark import cloudpickle

# executor functions travel whole: workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
