"""Molecular formulas in Hill order: writing and parsing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def charge_suffix(charge: Column) -> Column:
    size = F.when(F.abs(charge) > 1, F.abs(charge).cast("string")).otherwise("")
    return F.when(charge > 0, F.concat(F.lit("+"), size)).when(charge < 0, F.concat(F.lit("-"), size)).otherwise("")


def write(comp: DataFrame) -> DataFrame:
    """(mol_id, formula, charge) of a composition (mol_id, element[, mass_number], n, charge).

    With carbon: C, H, then by symbol; without: all by symbol.  A natural element comes before
    its nuclides, which are written [13C].  One aggregation by molecule over a broadcast of elements.
    """
    dim = F.broadcast(dims.elements(comp.sparkSession).select(F.col("element").cast("int").alias("element"), "symbol"))
    mass = F.col("mass_number") if "mass_number" in comp.columns else F.lit(None).cast("int")
    part = comp.join(dim, "element").select("mol_id", "element", "charge", F.struct("symbol", mass.alias("mass"), "n").alias("p"))
    mol = part.groupBy("mol_id").agg(F.collect_list("p").alias("parts"), F.bool_or(F.col("element") == 6).alias("carbon"), F.sum("charge").alias("charge"))

    def ranked(p: Column) -> Column:
        first = F.when(~F.col("carbon"), 2).when(p["symbol"] == "C", 0).when(p["symbol"] == "H", 1).otherwise(2)
        shown = F.when(p["mass"].isNull(), p["symbol"]).otherwise(F.concat(F.lit("["), p["mass"].cast("string"), p["symbol"], F.lit("]")))
        count = F.when(p["n"] > 1, p["n"].cast("string")).otherwise("")
        return F.struct(first.alias("r"), p["symbol"].alias("s"), F.coalesce(p["mass"], F.lit(0)).alias("m"), F.concat(shown, count).alias("t"))

    text = F.array_join(F.transform(F.array_sort(F.transform("parts", ranked)), lambda r: r["t"]), "")
    return mol.select("mol_id", F.concat(text, charge_suffix(F.col("charge"))).alias("formula"), "charge")


def parse_simple(formulas: DataFrame) -> DataFrame:
    """(id, element, mass_number, n, charge) of well-formed formulas (id, formula), by Spark SQL alone.

    Parts are split at dots, a leading coefficient scales its part, and the tokens of a part are
    exploded, looked up among the element symbols and added up.  charge is the formula's, on each row.
    """
    dim = F.broadcast(dims.elements(formulas.sparkSession).select(F.col("element").cast("int").alias("element"), "symbol"))
    part = formulas.select("id", F.explode(F.split("formula", r"\.")).alias("part"))
    coef = F.coalesce(F.expr("try_cast(nullif(regexp_extract(part, '^([0-9]+)', 1), '') AS long)"), F.lit(1).cast("long"))
    sign = F.regexp_extract("part", r"([+-])[0-9]*$", 1)
    size = F.coalesce(F.expr("try_cast(nullif(regexp_extract(part, '[+-]([0-9]+)$', 1), '') AS long)"), F.lit(1).cast("long"))
    charge = coef * F.when(sign == "+", size).when(sign == "-", -size).otherwise(0)
    part = part.select("id", coef.alias("coef"), charge.alias("charge"), F.expr(r"regexp_extract_all(part, '(\\[[0-9]+[A-Z][a-z]*\\]|[A-Z][a-z]?)([0-9]*)', 0)").alias("tokens"))
    total = part.groupBy("id").agg(F.sum("charge").alias("charge"))
    token = part.select("id", "coef", F.explode("tokens").alias("t"))
    head = F.regexp_extract("t", r"([A-Z][a-z]*)", 1)
    alias = F.when(head == "D", 2).when(head == "T", 3)
    mass = F.coalesce(F.expr("try_cast(nullif(regexp_extract(t, '^\\\\[([0-9]+)', 1), '') AS int)"), alias)
    count = F.coalesce(F.expr("try_cast(nullif(regexp_extract(t, '([0-9]*)$', 1), '') AS long)"), F.lit(1).cast("long"))
    unit = token.select("id", F.when(alias.isNotNull(), "H").otherwise(head).alias("symbol"), mass.alias("mass_number"), (F.col("coef") * count).alias("k"))
    return unit.join(dim, "symbol").groupBy("id", "element", "mass_number").agg(F.sum("k").alias("n")).join(total, "id")


ERRORS = ("UnknownSymbol", "ZeroQuantity", "Overflow", "InvalidMassNumber", "UnclosedBracket", "UnexpectedCharacter")
_Z = {dims.symbol(z): z for z in range(1, 256)}
U32 = 2**32 - 1


class FormulaError(ValueError):
    def __init__(self, at: int, kind: str):
        super().__init__(f"{kind} at byte {at}")
        self.at, self.kind = at, kind


def _digits(s: str, i: int) -> tuple[str, int]:
    j = i
    while j < len(s) and "0" <= s[j] <= "9":
        j += 1
    return s[i:j], j


def _quantity(text: str, at: int) -> int:
    """A count or coefficient; its errors are told at its first digit."""
    if not text:
        return 1
    n = int(text)
    if n == 0:
        raise FormulaError(at, "ZeroQuantity")
    if n > U32:
        raise FormulaError(at, "Overflow")
    return n


def _constituent(s: str, i: int) -> tuple[tuple[int, int], int]:
    """((element, mass number or 0), next) of the symbol, alias or bracketed nuclide at i."""
    if s[i] == "[":
        number, j = _digits(s, i + 1)
        if not number:
            raise FormulaError(i + 1, "InvalidMassNumber")
        close = s.find("]", j)
        if close < 0:
            raise FormulaError(i, "UnclosedBracket")
        z = _Z.get(s[j:close])
        if z is None:
            raise FormulaError(j, "UnknownSymbol")
        if not z <= int(number) <= 65535:
            raise FormulaError(i + 1, "InvalidMassNumber")
        return (z, int(number)), close + 1
    j = i + 1
    while j < len(s) and j - i < 3 and "a" <= s[j] <= "z":
        j += 1
    for end in range(j, i, -1):
        if s[i:end] in _Z:
            return (_Z[s[i:end]], 0), end
    if s[i] in "DT":
        return (1, 2 if s[i] == "D" else 3), i + 1
    raise FormulaError(i, "UnknownSymbol")


def parse_one(formula: str) -> tuple[dict[tuple[int, int], int], int]:
    """({(element, mass number or 0): n}, charge); FormulaError at the first offending token's byte."""
    s = formula.encode("utf-8").decode("latin-1")  # one character a byte, so that places are bytes
    units: list[tuple[tuple[int, int], int, int]] = []
    charge, i, coef, opening, closed = 0, 0, 1, True, False
    while i < len(s):
        c = s[i]
        if c == ".":
            coef, opening, closed, i = 1, True, False, i + 1
        elif closed:
            raise FormulaError(i, "UnexpectedCharacter")
        elif opening and "0" <= c <= "9":
            text, j = _digits(s, i)
            coef, opening, i = _quantity(text, i), False, j
        elif c in "+-":
            text, j = _digits(s, i + 1)
            size = int(text) if text else 1
            charge += (size if c == "+" else -size) * coef
            if size > U32 or not -(2**31) <= charge < 2**31:
                raise FormulaError(i, "Overflow")
            opening, closed, i = False, True, j
        elif c == "[" or "A" <= c <= "Z":
            what, j = _constituent(s, i)
            text, end = _digits(s, j)
            n = _quantity(text, j) * coef
            if n > U32:
                raise FormulaError(i, "Overflow")
            units.append((what, n, i))
            opening, i = False, end
        else:
            raise FormulaError(i, "UnexpectedCharacter")
    total: dict[tuple[int, int], int] = {}
    for what, n, at in sorted(units, key=lambda u: (u[0], u[2])):
        total[what] = total.get(what, 0) + n
        if total[what] > U32:
            raise FormulaError(at, "Overflow")
    return total, charge


def parse(formulas: DataFrame) -> DataFrame:
    """(id, parts, charge, error_kind, error_at) of formulas (id, formula); a failed one has null parts and charge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["formula"], strict=True):
                try:
                    got, charge = parse_one(text)
                    rows.append((key, [{"element": z, "mass_number": m or None, "n": n} for (z, m), n in got.items()], charge, None, None))
                except FormulaError as e:
                    rows.append((key, None, None, e.kind, e.at))
            out = pd.DataFrame(rows, columns=["id", "parts", "charge", "error_kind", "error_at"])
            yield out.astype({"charge": "Int32", "error_at": "Int32"})

    return formulas.select(F.col("id").cast("long").alias("id"), "formula").where("formula is not null").mapInPandas(run, "id long, parts array<struct<element:int,mass_number:int,n:long>>, charge int, error_kind string, error_at int")
