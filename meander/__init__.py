"""Attributed-graph walks and embeddings as Spark DataFrame operators."""

from meander.params import Params, SEPARATOR
from meander.scratch import Scratch

__all__ = ["Params", "Scratch", "SEPARATOR"]
