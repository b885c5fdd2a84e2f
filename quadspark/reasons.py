"""Reasons of refusals, and the refusal envelope. The strings are fixed values."""

SPARQL_PARSE_ERROR = "sparql_parse_error"
SPARQL_EVAL_ERROR = "sparql_eval_error"
EXTENSION_NOT_LOADED = "extension_not_loaded"
AR_CONNECTION_ERROR = "ar_connection_error"
UNEXPECTED_ERROR = "unexpected_error"
INVALID_GRAPH = "invalid_graph"
INVALID_DSL = "invalid_dsl"
IR_INVALID = "ir_invalid"
SCHEMA_FIELD_UNKNOWN = "schema_field_unknown"
BACKEND_MISSING_CAPABILITY = "backend_missing_capability"
UNKNOWN_BACKEND = "unknown_backend"
AR_NOT_LOADED = "ar_not_loaded"
MODEL_UNKNOWN = "model_unknown"
AR_QUERY_ERROR = "ar_query_error"
RULE_SET_UNKNOWN = "rule_set_unknown"
REASONER_DIVERGED = "reasoner_diverged"
CHANGESET_SCOPE_MISMATCH = "changeset_scope_mismatch_for_reasoner"
DEPENDENCY_INDEX_UNAVAILABLE = "dependency_index_unavailable"
FULL_REBUILD_REQUIRED = "full_rebuild_required"
NON_MONOTONIC_RULE_SET = "non_monotonic_rule_set"
SHAPE_PARSE_ERROR = "shape_parse_error"
UNKNOWN_CONSTRAINT_COMPONENT = "unknown_constraint_component"
CYCLE_DETECTED = "cycle_detected"
RULE_PARSE_ERROR = "rule_parse_error"
UNKNOWN_RULE_TYPE = "unknown_rule_type"
CONDITION_SHAPE_MISSING = "condition_shape_missing"
SHAPES_FILE_MISSING = "shapes_file_missing"
SHAPES_FORMAT_UNKNOWN = "shapes_format_unknown"
SHAPES_PARSE_ERROR = "shapes_parse_error"
NO_BLOB = "no_blob"
ALREADY_HYDRATED = "already_hydrated"
EMPTY_BLOB = "empty_blob"
ETHEREAL_GRAPH_UNDECLARED = "ethereal_graph_undeclared"
REENTRANT_CHECKPOINT = "reentrant_checkpoint"
SCOPE_KWARG_CONFLICT = "scope_kwarg_conflict"
SCOPE_ROLE_MISSING = "scope_role_missing"
SCOPE_READ_WRITE_OVERLAP = "scope_read_write_overlap"


def refused(reason: str, because: object, **more) -> dict:
    return {"ok": False, "reason": reason, "because": str(because), **more}


def invalid_graph(*graphs: str | None) -> dict | None:
    """A refusal if any graph is a blank node."""
    for g in graphs:
        if isinstance(g, str) and g.startswith("_:"):
            return refused(INVALID_GRAPH, f"a graph cannot be a blank node (got {g!r})")
    return None
