"""Contact-map and genome-structure analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# helpers used inside Arrow functions travel with the plan, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
