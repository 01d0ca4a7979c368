"""corpusmill: mining-style corpus analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the workers with their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
