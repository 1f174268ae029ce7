"""Null-safe access to XML-shaped columns, as SQL expression text.

The record schemas declare every child element as an array, because an XML
element may repeat and the first one counts.  A ``parent`` of ``None`` stands
for the record itself, whose elements are top-level columns.  Expressions are
text because a plan has thousands of them: Spark parses text at once, while
every ``Column`` call is a round trip from Python.
"""

from __future__ import annotations


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def named(expression: str, name: str) -> str:
    return f"{expression} AS `{name}`"


def struct(**fields: str) -> str:
    return struct_of(fields)


def struct_of(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{literal(name)}, {value}" for name, value in fields.items()) + ")"


def member(parent: str | None, name: str) -> str:
    return f"`{name}`" if parent is None else f"{parent}.`{name}`"


def child_list(parent: str | None, name: str) -> str:
    """All children called ``name``; null without a parent or without any."""
    return member(parent, name)


def item_at(items: str, index: int) -> str:
    """Item by position; null for a null array or a position beyond its end."""
    return f"get({items}, {index})"


def first_child(parent: str | None, name: str) -> str:
    return item_at(child_list(parent, name), 0)


def text_or_null(value: str) -> str:
    """Text of an element; an empty element has none."""
    return f"nullif({value}, '')"


def element_text(parent: str | None, name: str) -> str:
    return text_or_null(first_child(parent, name))


def attribute_text(element: str | None, name: str) -> str:
    """An attribute as it stands: unlike element text, ``''`` stays ``''``."""
    return member(element, f"_{name}")


def descend(parent: str | None, *names: str) -> str | None:
    for name in names:
        parent = first_child(parent, name)
    return parent


def value_at(path: str, parent: str | None = None) -> str:
    """Text of the element, or value of the ``@attribute``, at a dotted path."""
    *way, name = path.split(".")
    holder = descend(parent, *way)
    return attribute_text(holder, name[1:]) if name.startswith("@") else element_text(holder, name)


def present(element: str, fields: dict[str, str]) -> str:
    """A struct for an element that exists, null for one that does not."""
    return f"CASE WHEN {element} IS NOT NULL THEN {struct_of(fields)} END"


def joined_texts(parent: str, name: str) -> str:
    """Texts of the repeated element, one per line: null without a parent,
    ``''`` without texts."""
    texts = f"filter({child_list(parent, name)}, note -> note != '')"
    return f"CASE WHEN {parent} IS NOT NULL THEN coalesce(array_join({texts}, '\\n'), '') END"


def presence_flag(element: str) -> str:
    return f"CASE WHEN {element} IS NOT NULL THEN 'true' END"


def first_present(*choices: tuple[str, str]) -> str:
    """Label of the first element that exists, else null."""
    branches = " ".join(f"WHEN {element} IS NOT NULL THEN {literal(label)}" for element, label in choices)
    return f"CASE {branches} END"
