"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only where it can be imported.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value, so a cluster needs
# no copy of the package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
