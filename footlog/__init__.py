"""Web and product analytics as Spark jobs: every operator returns a lazy DataFrame."""

from footlog.model import Scope, Window

__all__ = ["Scope", "Window"]
