"""What statements are, once parsed."""

from __future__ import annotations

from dataclasses import dataclass

NO_FUNCTION = ""


@dataclass(frozen=True)
class Name:
    """An attribute as written: with or without its relation."""

    relation: str | None
    attribute: str


@dataclass(frozen=True)
class Literal:
    """kind: INT, FLOAT or STRING."""

    kind: str
    value: int | float | str


@dataclass(frozen=True)
class Item:
    """An element of a select list: function(name), or the name alone."""

    function: str
    name: Name


@dataclass(frozen=True)
class Condition:
    left: Name
    op: str
    right: Name | Literal


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    relations: tuple[str, ...]
    conditions: tuple[Condition, ...] = ()
    order: Name | None = None
    descending: bool = False
    group: Name | None = None


@dataclass(frozen=True)
class CreateTable:
    relation: str
    attributes: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class DropTable:
    relation: str


@dataclass(frozen=True)
class CreateIndex:
    relation: str
    attribute: str


@dataclass(frozen=True)
class DropIndex:
    relation: str
    attribute: str


@dataclass(frozen=True)
class Load:
    relation: str
    path: str


@dataclass(frozen=True)
class Insert:
    relation: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Delete:
    relation: str
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Update:
    relation: str
    attribute: Name
    value: Name | Literal
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Setting:
    name: str
    value: str


@dataclass(frozen=True)
class Utility:
    """action: help, print, queryplans, reset, resize, exit or nothing; what: a relation, on, off, buffer or io."""

    action: str
    what: str = ""
    number: int = 0


Statement = Select | CreateTable | DropTable | CreateIndex | DropIndex | Load | Insert | Delete | Update | Setting | Utility
