"""Rule reasoning: rule sets, fixpoint materialisation, provenance, incremental maintenance."""

from .fixpoint import dred, materialise, materialise_incremental
from .rules import OWL_2_RL, PENDING_RULES, Rule, RuleSet

__all__ = ["OWL_2_RL", "PENDING_RULES", "Rule", "RuleSet", "dred", "materialise", "materialise_incremental"]
