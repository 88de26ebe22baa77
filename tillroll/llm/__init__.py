"""Training-data operators: thirteen self-contained modules over the corpus tables.

Nothing else in the package imports this one; :mod:`tillroll.llm.queries`
lists the registered queries and :mod:`tillroll.llm.oracle` their SQL.
"""

import sys

from pyspark import cloudpickle

# functions run by executors travel by value: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
