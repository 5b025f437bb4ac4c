"""Document redaction and extraction as Spark DataFrame operators."""

from veilwork.options import RedactOptions
from veilwork.session import build_session

__all__ = ["RedactOptions", "build_session"]
