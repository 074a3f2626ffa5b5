"""churnlytics: insurance-contract churn and settlement analytics on Spark.

Every public function takes and returns lazy ``pyspark.sql.DataFrame`` objects;
nothing is collected to the driver except bounded state (pivot keys, quantile
cut points, model coefficients).
"""

from churnlytics.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
