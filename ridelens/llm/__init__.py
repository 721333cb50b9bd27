"""Training-data operators: near-duplicate joins, language and personal-data filters,
tokenisation, decontamination, vector search, chat formatting, URL and license rules.

Nothing else in the library imports this package.  Its functions are shipped to the
executors by value, so a worker needs numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
