"""Scalar maps over residues and conditions: classes, wheel angles, and the token numbers of a conditional sequence model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.scales import ALPHABET, HELIX_DEGREES, HYDROPHOBIC

# Numbers of the tokens, in the order begin, end, filler, residues, charge buckets, sources; and the buckets' lower bounds.
BEGIN, END, FILLER, RESIDUES = 0, 1, 2, 3
CHARGE_BOUNDS = (-2.0, 2.0, 4.0, 6.0, 8.0, 12.0)
CONDITIONS = RESIDUES + len(ALPHABET)
SOURCES = CONDITIONS + len(CHARGE_BOUNDS) + 1
VOCABULARY = SOURCES + 2
_CLASS = dict.fromkeys(ALPHABET, "polar") | dict.fromkeys(HYDROPHOBIC, "hydrophobic") | dict.fromkeys("KRH", "cationic") | dict.fromkeys("DE", "anionic")


def residue_class(a: str) -> str:
    return _CLASS.get(a, "polar")


def residue_class_of(a: Column) -> Column:
    out = F.when(a.isNull(), None)
    for kind in ("cationic", "anionic", "hydrophobic"):
        out = out.when(a.isin([c for c, k in _CLASS.items() if k == kind]), kind)
    return out.otherwise("polar")


def wheel_angle(position: int) -> float:
    return position * HELIX_DEGREES % 360


def charge_token(charge: float) -> int:
    return CONDITIONS + sum(charge >= b for b in CHARGE_BOUNDS)


def charge_bucket(charge: Column) -> Column:
    """Number of bounds that a charge reaches."""
    return sum(((charge >= b).cast("int") for b in CHARGE_BOUNDS), F.lit(0))


def source_token(second: bool) -> int:
    return SOURCES + bool(second)


def encode(s: str, charge: float, second: bool = False) -> list[int]:
    return [charge_token(charge), source_token(second), BEGIN, *(RESIDUES + ALPHABET.index(c) for c in s), END]


def decode(ids: Iterable[int]) -> str:
    """Residues alone; other tokens are passed over."""
    return "".join(ALPHABET[i - RESIDUES] for i in ids if RESIDUES <= i < CONDITIONS)


def encoded(s: Column, charge: Column, second: Column) -> Column:
    """encode as a Column: array of int."""
    letters = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) + (RESIDUES - 1))
    body = F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(letters)
    head = F.array(F.lit(CONDITIONS) + charge_bucket(charge), F.lit(SOURCES) + second.cast("int"), F.lit(BEGIN))
    return F.concat(head, body, F.array(F.lit(END)))


def decoded(ids: Column) -> Column:
    kept = F.filter(ids, lambda i: i.between(RESIDUES, CONDITIONS - 1))
    return F.array_join(F.transform(kept, lambda i: F.substr(F.lit(ALPHABET), i - (RESIDUES - 1), F.lit(1))), "")
