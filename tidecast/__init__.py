"""tidecast: Spark-native sales forecasting and churn analytics.

Functions of this package that run inside Python workers (grouped numeric
fits, the random-feature UDF) are pickled by value, so executors need
nothing installed besides PySpark, numpy and pandas: the code travels with
the task, no package upload or shared folder is needed.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
