"""Errors that end one step of a job but not the job."""

from __future__ import annotations

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException

SPARK_ERRORS = (PySparkException, Py4JError)
STEP_ERRORS = (*SPARK_ERRORS, ValueError, TypeError, KeyError, OSError)


def reason(error: Exception) -> str:
    """What went wrong, in full, without the stack of the Java side; the error's kind where it says nothing."""
    said = error.java_exception.getMessage() if isinstance(error, Py4JJavaError) else str(error)
    return (said or "").strip() or type(error).__name__
