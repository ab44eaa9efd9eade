"""PySpark-native analytics for labelled text and layer-wise vectors."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few Python functions that run in tasks travel with the job, so executors
# need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
