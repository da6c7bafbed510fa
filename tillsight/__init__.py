"""tillsight: retail transaction analytics expressed as Spark DataFrame plans.

Every public function takes DataFrames and returns a DataFrame (or a small
model/report object where a Spark ML estimator is involved).  Nothing is
collected to the driver except fixed-size thresholds and model parameters.
"""

__version__ = "0.1.0"
