"""The operators over the given tables, each with its SQL where SQL can state the result."""

import sys

from pyspark import cloudpickle

from driver_queries import gold, quality, retrieval, silver, sources

# As in the package: Python workers need no copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = (sources, silver, gold, quality, retrieval)


def queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
