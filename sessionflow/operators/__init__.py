"""Statement-level operators: overview (01-04), funnel (05-08, 10, C1),
quality (09.1-09.4), commerce (11.1-11.5)."""

from . import commerce, funnel, overview, quality

__all__ = ["commerce", "funnel", "overview", "quality"]
