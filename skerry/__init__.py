"""skerry: anomaly detection on ordered vector streams, declared as Spark DataFrame plans."""

__version__ = "0.1.0"
