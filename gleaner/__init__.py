"""gleaner: content triage as Spark DataFrame jobs."""

import sys as _sys

try:
    # Python helpers run inside Spark's Python workers (pandas UDFs, mapInPandas).
    # Pickle this package's functions by value so workers need not import it from
    # their own path; with --py-files/addPyFile the by-reference form would also work.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):  # pragma: no cover - older cloudpickle
    pass
