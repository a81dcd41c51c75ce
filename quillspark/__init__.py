"""quillspark: Spark-native source-code analysis and document labeling."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks carry the few Python functions they run, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
