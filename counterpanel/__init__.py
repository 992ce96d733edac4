"""Panel counterfactuals as Spark jobs: donor weights, gaps, inference, reports."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their task, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from counterpanel.plans.estimate import StudyResult, estimate  # noqa: E402

__all__ = ["StudyResult", "estimate"]
