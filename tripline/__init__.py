"""Intrusion-detection analytics on Spark DataFrames.

Raw security logs become typed events, rules and statistics turn events into
findings, and findings become scored, de-duplicated alerts.  Every operator
takes and returns DataFrames (or Columns), so Catalyst plans the whole job.
"""

import sys

from pyspark import cloudpickle

from tripline.session import build_session

# Python functions travel with the job: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
