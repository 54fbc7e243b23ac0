"""murmur: market mood as Spark jobs.

Every transform is a plain ``DataFrame -> DataFrame`` or ``Column -> Column``
function that takes its clock (``now``) and thresholds as arguments, so a run
is repeatable and Catalyst sees the whole plan.

* ``functions``  column expressions (text, numbers, labels, language)
* ``sources``    readers, parsers of landed data, writers
* ``operators``  joins, de-duplication, aggregation, windows, decisions
* ``plans``      whole jobs, the views over the test tables, the query registry
* ``streaming``  the stateless and windowed parts on Structured Streaming
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors
# need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
