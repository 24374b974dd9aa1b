"""Product analytics on Spark: events in, star schema and product answers out."""

from tallyspark.session import build_session, tune

__all__ = ["build_session", "tune"]
__version__ = "0.1.0"
