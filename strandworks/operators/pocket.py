"""Pocket definitions: a small boolean language over contact counts.

``kind:positions:atoms OP number`` with ``&``, ``|`` and parentheses, where kind is
``c`` (sum of contacts), ``cs`` (residues with a contact), ``da`` (any distance) or
``daa`` (all distances); positions and atoms are comma lists, ``any`` for all atoms.
The text is tokenised and parsed into aggregate columns; nothing is evaluated.
"""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<st>(?:c|cs|daa|da):[\d,]+:[\w,']+)|(?P<op>>=|<=|==|!=|>|<|=)|(?P<num>\d+(?:\.\d+)?)|(?P<punct>[&|()]))")
_OPS = {">=": operator.ge, "<=": operator.le, "==": operator.eq, "=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt}


class FormatError(ValueError):
    """Not a pocket definition."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormatError(f"at {at}: {text[at:at + 12]!r}")
        out.append((m.lastgroup or "", m.group(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, mapping: dict[int, int] | None):
        self.tokens, self.at, self.mapping = _tokens(text), 0, mapping

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or value not in (None, v):
            raise FormatError(f"expected {value or kind}, found {v!r}")
        self.at += 1
        return v

    def either(self) -> Column:
        out = self.both()
        while self.peek() == ("punct", "|"):
            self.at += 1
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.atom()
        while self.peek() == ("punct", "&"):
            self.at += 1
            out = out & self.atom()
        return out

    def atom(self) -> Column:
        if self.peek() == ("punct", "("):
            self.at += 1
            out = self.either()
            self.take("punct", ")")
            return out
        kind, positions, names = self.take("st").split(":")
        compare, number = _OPS[self.take("op")], float(self.take("num"))
        wanted = [int(p) for p in positions.split(",")]
        if self.mapping is not None:
            wanted = [self.mapping[p] for p in wanted if p in self.mapping]
        here = F.col("res_id").isin(wanted) if wanted else F.lit(False)
        if names != "any":
            here = here & F.col("atom_name").isin(names.split(","))
        if kind == "c":
            return compare(F.count_if(here & F.col("is_contact")), F.lit(number))
        if kind == "cs":
            return compare(F.count_distinct(F.when(here & F.col("is_contact"), F.col("res_id"))), F.lit(number))
        test = F.when(here, compare(F.col("dist"), F.lit(number)))
        return F.coalesce(F.bool_or(test), F.lit(False)) if kind == "da" else F.coalesce(F.bool_and(test), F.lit(True))


def pocket(definition: str, mapping: dict[int, int] | None = None) -> Column:
    """An aggregate over rows ``(res_id, atom_name, is_contact, dist)`` of one ligand.
    Positions go through ``mapping``; those it lacks are left out."""
    p = _Parser(definition, mapping)
    out = p.either()
    if p.at != len(p.tokens):
        raise FormatError(f"trailing {p.peek()[1]!r}")
    return out
