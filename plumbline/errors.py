"""Refusals: every one has a code, an exit status and, where it helps, candidates."""

from __future__ import annotations

from collections.abc import Iterable

# Codes in the order of their exit statuses, which begin at 2 (fixed values).
CODES = (
    "unresolved ambiguous unreachable ambiguous_join_path unsupported_measure fanout_unsafe guardrail_block "
    "validation_failed assertion_failed read_only_violation schema_mismatch connection_error contradiction "
    "generation_failed structured_output_invalid structured_output_unsupported air_gapped_violation retries_exhausted "
    "telemetry_not_configured telemetry_send_failed tenant_unresolved tenant_scope_missing tenant_forbidden"
).split()
EXIT_STATUS = {code: status for status, code in enumerate(CODES, 2)}


class Refusal(Exception):
    """A query that can't be answered safely."""

    def __init__(self, code: str, message: str, candidates: Iterable[str] = ()) -> None:
        super().__init__(message)
        self.code, self.message, self.candidates = code, message, list(candidates)

    @property
    def exit_status(self) -> int:
        return EXIT_STATUS.get(self.code, 1)
