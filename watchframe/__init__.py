"""watchframe: observability analytics as Spark DataFrame operators."""

from watchframe.session import build_session, configure, work_dir

__all__ = ["build_session", "configure", "work_dir"]
