"""Errors of the language: a name, a number, a message. Positive numbers are warnings, after which a session goes on."""

from __future__ import annotations

# The numbers and names that callers of the language know.
CODES = {
    "SM_KEYNOTFOUND": 301,
    "SM_INVALIDSIZE": 302,
    "SM_ENTRYEXISTS": 303,
    "SM_NOSUCHENTRY": 304,
    "SM_DBOPEN": -301,
    "SM_NOSUCHDB": -302,
    "SM_NOTOPEN": -303,
    "SM_NOSUCHTABLE": -304,
    "SM_BADOPEN": -305,
    "SM_FNOTOPEN": -306,
    "SM_BADATTR": -307,
    "SM_BADTABLE": -308,
    "SM_INDEXEXISTS": -309,
    "SM_TYPEMISMATCH": -310,
    "SM_BADOP": -311,
    "SM_AMBGATTR": -312,
    "SM_BADPARAM": -313,
    "SM_BADAGGFUN": -314,
    "QL_KEYNOTFOUND": 401,
    "QL_INVALIDSIZE": 402,
    "QL_ENTRYEXISTS": 403,
    "QL_NOSUCHENTRY": 404,
    "QL_BADJOINKEY": -401,
    "QL_ALREADYOPEN": -402,
    "QL_BADATTR": -403,
    "QL_DUPREL": -404,
    "QL_RELMISSINGFROMFROM": -405,
    "QL_FNOTOPEN": -406,
    "QL_JOINKEYTYPEMISMATCH": -407,
    "QL_BADOPEN": -408,
    "QL_EOF": -409,
    "PF_UNIX": -9,
    "IX_NOSUCHINDEX": -209,
}


class EngineError(Exception):
    """A statement that was refused, by a code of the language."""

    def __init__(self, name: str, detail: str = ""):
        self.name, self.code = name, CODES[name]
        super().__init__(f"{name} ({self.code})" + (f": {detail}" if detail else ""))

    @property
    def is_warning(self) -> bool:
        return self.code > 0


class FormatError(Exception):
    """A statement that is well formed but can't be carried out as written (lengths, numbers of elements). It has no code and ends nothing."""


class SyntaxFault(Exception):
    """Text that isn't a statement. The session skips it and goes on."""


class LineFault(Exception):
    """A line that doesn't fit the relation it is loaded into. No statement goes on behind it: it leaves the session as an exception."""
