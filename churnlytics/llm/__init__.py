"""Operators of a training-data pipeline (packing, near-duplicates,
decontamination, URL filters, token counts, quality, toxicity, licences).

Nothing else in the library imports this package. Its functions travel to the
Python workers by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
