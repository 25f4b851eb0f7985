"""Declarative logic rules on Spark DataFrames."""

from ruleloom.lang.ast import ProgramError
from ruleloom.plans.program import Program

__all__ = ["Program", "ProgramError"]
