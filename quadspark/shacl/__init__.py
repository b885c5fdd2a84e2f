"""SHACL: validation, rules and the loading of shapes."""

from . import rules
from .constraints import CORE, PENDING, Constraint, ConstraintLibrary
from .loader import load_shapes
from .validator import validate, violations_df

__all__ = ["CORE", "PENDING", "Constraint", "ConstraintLibrary", "load_shapes", "rules", "validate", "violations_df"]
