"""lendspark: lending-risk analytics on Spark DataFrames, Spark ML and Structured Streaming.

Subpackages
-----------
functions   column expressions (null rules, derived ratios, bands, p-values on scalars)
sources     readers / writers, schemas, role views over the driver test tables
operators   DataFrame operators: features, enrichment, profiles, association,
            hypothesis tests, ordered counts, evaluation, preprocessing, models,
            segmentation, chart data, scoring
plans       end-to-end jobs (extract -> transform -> load -> train) and the
            registered query catalogue
streaming   continuous scoring of arriving application files
"""

from lendspark.session import get_spark

__all__ = ["get_spark"]
