"""Errors of the engine: a code for programs, a reason and a suggestion for people."""

from __future__ import annotations

CODES = (
    "MISSING_PROVENANCE INVALID_TYPE INVALID_INPUT NOTE_NOT_FOUND CONFLICT UNKNOWN_CHANGE UNKNOWN_VERSION PERMISSION_DENIED "
    "TEMPLATE_NOT_FOUND MISSING_VARS IO_ERROR INTERNAL INVALID_MANIFEST PLUGIN_ABI PLUGIN_TRAP"
).split()


class EngineError(Exception):
    """A failure that a caller can act on."""

    def __init__(self, code: str, reason: str, suggestion: str = ""):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason, self.suggestion = code, reason, suggestion

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "reason": self.reason, "suggestion": self.suggestion}


def not_found(note_id: str) -> EngineError:
    return EngineError("NOTE_NOT_FOUND", f"There is no note {note_id!r}.", "list_notes and search give valid note ids.")
