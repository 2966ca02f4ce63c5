"""Clinical-symptom analytics on Spark: records, features, models, scores and drift."""

__version__ = "0.1.0"
