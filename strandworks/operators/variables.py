"""Variables: named computations on objects, with failures as values.

A variable's id is its constructor text, such as ``SeqEl(10)`` or ``PFP(10,1)``.
Ids are parsed, never evaluated.  The registry maps a name to a builder of a
Catalyst column; a result is ``(ok, value, error)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.functions.tables import PFP

_ID = re.compile(r"^\s*(\w+)\s*\((.*)\)\s*$")


@dataclass(frozen=True)
class Variable:
    name: str
    args: tuple[str, ...]

    @property
    def id(self) -> str:
        return f"{self.name}({','.join(self.args)})"


def parse(text: str) -> Variable:
    """The variable an id names; raises on anything else."""
    m = _ID.match(text)
    if not m or m.group(1) not in REGISTRY:
        raise ValueError(f"not a variable: {text!r}")
    args = tuple(x.strip() for x in m.group(2).split(",")) if m.group(2).strip() else ()
    return Variable(m.group(1), args)


def _letter(seq: Column, position: int) -> tuple[Column, Column]:
    ok = F.lit(position >= 1) & (F.length(seq) >= position)
    return ok, F.substring(seq, max(position, 1), 1)


def seq_el(seq: Column, p: str) -> tuple[Column, Column, Column]:
    ok, letter = _letter(seq, int(p))
    return F.coalesce(ok, F.lit(False)), letter, F.lit(f"no position {int(p)}")


def pfp(seq: Column, p: str, component: str) -> tuple[Column, Column, Column]:
    i = int(component)
    if not 1 <= i <= 5:
        raise ValueError("components are 1 to 5")
    table = F.create_map(*[F.lit(x) for aa, row in sorted(PFP.items()) for x in (aa, str(row[i - 1]))])
    ok, letter = _letter(seq, int(p))
    value = F.try_element_at(table, letter)
    return F.coalesce(ok & value.isNotNull(), F.lit(False)), value, F.lit(f"no residue of the table at {int(p)}")


def count_letters(seq: Column, letters: str, start: str = "1", stop: str = "0") -> tuple[Column, Column, Column]:
    """How many of the letters stand in an inclusive slice; stop 0 is the end."""
    a, b = int(start), int(stop)
    part = F.substring(seq, a, b - a + 1 if b else 1 << 30)
    n = F.length(part) - F.length(F.regexp_replace(part, f"[{re.escape(letters)}]", ""))
    ok = F.coalesce(F.length(part) > 0, F.lit(False))
    return ok, n.cast("string"), F.lit("empty slice")


#: name -> (builder, type of the value)
REGISTRY: dict[str, tuple[Callable, str]] = {"SeqEl": (seq_el, "str"), "PFP": (pfp, "float"), "Count": (count_letters, "int")}


def calculate(objects: DataFrame, obj: str, seq: str, ids: list[str]) -> DataFrame:
    """``object_id, variable_id, ok, value, error, rtype``: every variable on every
    object, in one scan without a join.  A failure is a row with its message."""
    results = []
    for v in dict.fromkeys(ids):
        var = parse(v)
        builder, rtype = REGISTRY[var.name]
        ok, value, error = builder(F.col(seq), *var.args)
        results.append(
            F.struct(
                F.lit(var.id).alias("variable_id"), ok.alias("ok"), F.when(ok, value).alias("value"),
                F.when(~ok, error).alias("error"), F.lit(rtype).alias("rtype"),
            )
        )
    rows = objects.select(F.col(obj).alias("object_id"), F.explode(F.array(*results)).alias("r"))
    return rows.select("object_id", "r.*")


def wide(results: DataFrame, ids: list[str], replace_errors: bool = True) -> DataFrame:
    """One row per object, one column per variable; failures become null, or their
    message without ``replace_errors``.  The columns are given, so no extra job finds
    them; an object with two results for one variable raises."""
    value = F.col("value") if replace_errors else F.coalesce("value", "error")
    n = F.count(F.lit(1))
    one = F.when(n <= 1, F.first("v")).otherwise(F.raise_error(F.lit("two results for one variable")).cast("string"))
    return results.select("object_id", "variable_id", value.alias("v")).groupBy("object_id").pivot("variable_id", list(ids)).agg(one)


def long(results: DataFrame) -> DataFrame:
    return results.select(F.col("object_id").alias("ObjectID"), F.col("variable_id").alias("VariableID"), F.col("value").alias("VariableResult"))


def typed(results: DataFrame) -> DataFrame:
    """Values by their type: ``as_int``, ``as_float``, ``as_str``, null elsewhere."""
    pick = lambda kind, to: F.when(F.col("rtype") == kind, F.expr(f"try_cast(value as {to})"))
    return results.withColumns({"as_int": pick("int", "int"), "as_float": pick("float", "double"), "as_str": F.when(F.col("rtype") == "str", F.col("value"))})


def assign(objects: DataFrame, obj: str, ids: list[str]) -> DataFrame:
    """Rows of variables that are not computed yet."""
    names = F.array(*[F.lit(parse(v).id) for v in ids])
    return objects.select(F.col(obj).alias("object_id"), F.explode(names).alias("variable_id"), F.lit(None).cast("string").alias("value"))


def remove(variables: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the ``(object_id, variable_id)`` rows of ``gone``."""
    return variables.join(gone.select("object_id", "variable_id").distinct(), ["object_id", "variable_id"], "left_anti")


def reset(variables: DataFrame, which: DataFrame) -> DataFrame:
    """With null values for the ``(object_id, variable_id)`` rows of ``which``."""
    hit = which.select("object_id", "variable_id").distinct().withColumn("_hit", F.lit(True))
    out = variables.join(hit, ["object_id", "variable_id"], "left")
    return out.withColumn("value", F.when(F.col("_hit"), F.lit(None).cast("string")).otherwise(F.col("value"))).drop("_hit")
