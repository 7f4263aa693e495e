"""lexiflow: Spark-native operators for preparing and judging labelled text corpora.

Every public operator takes and returns a lazy ``DataFrame`` (or ``Column``);
nothing is collected to the driver except where documented (model fitting,
the empty-scan check of ``read_raw`` and strict label checks).
"""

from lexiflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
