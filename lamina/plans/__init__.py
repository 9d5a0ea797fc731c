"""Registered queries; importing a module registers its own."""

from . import commands, derived, elements, exploration, formats, programs, relations, search  # noqa: F401
