"""What can go wrong, by what it means for the caller."""

from __future__ import annotations


class TidemarkError(Exception):
    """loses_record: a record was not stored. breaks_contract: the program is at fault, and trying again won't help."""

    loses_record = False
    breaks_contract = False


class SchemaError(TidemarkError, ValueError):
    """A schema or a limit breaks a rule; the message says which."""

    breaks_contract = True


class StoreError(TidemarkError, RuntimeError):
    """A store can't be opened as asked."""


class SchemaMismatch(StoreError):
    """A namespace belongs to another schema."""

    breaks_contract = True


class FromFuture(StoreError):
    """A store or a namespace was written by a later version."""


class MissingMigration(StoreError):
    """No chain of migrations leads from a namespace's version to the schema's."""

    breaks_contract = True


class BadName(StoreError, ValueError):
    """A name can't be a path component."""

    breaks_contract = True


class Damaged(StoreError):
    """What is stored can't be read."""


#: What rejected records carry in `violation`: whether the record is lost, and whether the program breaks its contract. An
#: undeclared span kind is reported, but its records are kept.
VIOLATIONS = {"unknown_event": (True, True), "unknown_metric": (True, True), "wrong_type": (True, True), "unknown_span_kind": (False, True)}
