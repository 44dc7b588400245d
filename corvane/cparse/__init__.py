"""A tolerant parser for C, in pure Python: it runs inside Spark's Python workers."""

from .nodes import Node
from .parser import parse, parsed

__all__ = ["Node", "parse", "parsed"]
