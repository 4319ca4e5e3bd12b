"""brickstream: a PySpark-native engine for classified-listing data.

Every operator is a lazy ``DataFrame -> DataFrame`` function.  The subpackage
``llm`` (training-data operators) is optional: nothing else imports it.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
