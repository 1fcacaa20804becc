"""Fixed values and types of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

INT64_MIN, INT64_MAX, UINT64_MAX = -(1 << 63), (1 << 63) - 1, (1 << 64) - 1
GENESIS = "0" * 64

# Fixed values of the ledger format.
KINDS = ("tx", "margin", "verb", "hold", "refuse", "tick", "term", "snapshot", "judge", "dissent", "seg", "warn")
STATES = {"open": 0, "held": 1, "dispatched": 2, "escalated": 3, "closed": 4}
FLAGS = {"warrant": 1, "exogenous": 2, "blocked": 4, "shadow": 8, "explore": 16, "content": 32, "dirty": 64, "pinned": 128}
VERBS = {"hold": 0, "act": 1, "work": 2, "fetch": 3, "escalate": 4}
CONSTRAINT_COLUMNS = ("id", "opened_ns", "due_ns", "blocked_by", "pos_last", "src_pos_last", "pos_judged", "amount_minor", "cls", "seg", "seat", "state", "flags", "verb", "gear", "now_ns")
REFUSALS = ("constraint_violated", "quorum_insufficient", "license_exceeded", "pin_mismatch", "no_inverse", "stale_source", "stale_judgment", "reversibility_mismatch", "id_collision", "unknown_cell", "unknown_class", "not_authored_by_seam")
FAULTS = ("malformed", "not_leader", "no_quorum", "rate_limited", "duplicate_request", "stale_basis", "too_large")
SCAN_REASONS = (
    "no_prev_field", "bad_tail_width", "bad_prev", "no_h_field", "bad_h", "bad_row_end", "order_pos", "bad_pos", "order_term", "bad_term", "order_t_epoch_ns", "bad_t_epoch_ns",
    "order_k", "bad_k", "order_cell", "bad_cell", "order_cls", "bad_cls", "order_by", "bad_by", "order_body", "bad_body", "trailing_after_body", "hash_mismatch",
)

U64 = T.DecimalType(20, 0)

AFTER = T.StructType([T.StructField("amount_minor", T.LongType()), T.StructField("due_ns", T.LongType()), T.StructField("state", T.ShortType()), T.StructField("flags", T.ShortType())])
FACT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("source_pos", U64),
        T.StructField("cls", T.LongType()),
        T.StructField("exogenous", T.BooleanType()),
        T.StructField("has_inverse", T.BooleanType()),
        T.StructField("reverses_pos", U64),
        T.StructField("after", AFTER),
    ]
)
TX_BODY = T.StructType(
    [
        T.StructField("client_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("basis_pos", T.LongType()),
        T.StructField("reversibility", T.StringType()),
        T.StructField("facts", T.ArrayType(FACT)),
    ]
)
# DDL strings: these need no session.
REFUSE_BODY = "attempted_digest string, reason string, constraint_id string, count long, first_pos long, last_pos long"
TICK_BODY = "cadence_rule string, deadline_wheel_pos long"
TAPE = "pos long, term long, t_epoch_ns long, k string, cell decimal(20,0), cls long, by string, body string, prev string, h string, seg_first_pos long, line_no long, scan_reason string"
