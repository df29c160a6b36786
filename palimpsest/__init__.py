"""palimpsest: text-overlap, citation-graph and corpus analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# vectorised functions travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
