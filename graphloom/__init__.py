"""Data integration on Spark: profiles, schema matching, record linkage and knowledge-graph triples."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
