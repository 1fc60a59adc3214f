"""Element symbols and covalent radii as lookups inside expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element symbols by atomic number, from 1.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

# Single-bond covalent radii in angstrom (Cordero et al. 2008), H to Cm.
RADII = (
    0.31, 0.28, 1.28, 0.96, 0.84, 0.76, 0.71, 0.66, 0.57, 0.58, 1.66, 1.41, 1.21, 1.11, 1.07, 1.05, 1.02, 1.06,
    2.03, 1.76, 1.70, 1.60, 1.53, 1.39, 1.39, 1.32, 1.26, 1.24, 1.32, 1.22, 1.22, 1.20, 1.19, 1.20, 1.20, 1.16,
    2.20, 1.95, 1.90, 1.75, 1.64, 1.54, 1.47, 1.46, 1.42, 1.39, 1.45, 1.44, 1.42, 1.39, 1.39, 1.38, 1.39, 1.40,
    2.44, 2.15, 2.07, 2.04, 2.03, 2.01, 1.99, 1.98, 1.98, 1.96, 1.94, 1.92, 1.92, 1.89, 1.90, 1.87, 1.87,
    1.75, 1.70, 1.62, 1.51, 1.44, 1.41, 1.36, 1.36, 1.32, 1.45, 1.46, 1.48, 1.40, 1.50, 1.50,
    2.60, 2.21, 2.15, 2.06, 2.00, 1.96, 1.90, 1.87, 1.80, 1.69,
)

NUMBERS = {symbol: z for z, symbol in enumerate(SYMBOLS, 1)}


def symbol(z: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SYMBOLS]), z.cast("int"))


def atomic_number(name: Column) -> Column:
    """Null for an unknown symbol."""
    place = F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), name)
    return F.when(place > 0, place.cast("int"))


def covalent_radius(z: Column) -> Column:
    """Numbers beyond the table take its nearest end."""
    spot = F.least(F.greatest(z.cast("int"), F.lit(1)), F.lit(len(RADII)))
    return F.element_at(F.array(*[F.lit(r) for r in RADII]), spot)


def element_counts(numbers: Column) -> Column:
    """``array<struct<s, n>>`` of symbols and counts, by symbol."""
    kinds = F.array_sort(F.array_distinct(F.transform(numbers, symbol)))
    return F.transform(kinds, lambda s: F.struct(
        s.alias("s"), F.size(F.filter(numbers, lambda z: symbol(z) == s)).alias("n")))


def hill_formula(numbers: Column) -> Column:
    """Carbon, hydrogen, then alphabetical; alphabetical without carbon."""
    counts = element_counts(numbers)
    carbon = F.exists(numbers, lambda z: z == 6)
    keyed = F.transform(counts, lambda c: F.struct(
        F.when(carbon & (c["s"] == "C"), 0).when(carbon & (c["s"] == "H"), 1).otherwise(2).alias("k"), c["s"].alias("s"), c["n"].alias("n")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda c: F.when(
        c["n"] > 1, F.concat(c["s"], c["n"].cast("string"))).otherwise(c["s"])), "")


def element_set(numbers: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(numbers, symbol))), "-")


def reduced_composition(numbers: Column) -> Column:
    """Counts divided by their greatest common divisor, as ``C:1-O:2``."""
    counts = element_counts(numbers)
    smallest = F.array_min(F.transform(counts, lambda c: c["n"]))
    shared = F.filter(F.sequence(F.lit(1), smallest), lambda g: F.forall(counts, lambda c: c["n"] % g == 0))
    return F.array_join(F.transform(counts, lambda c: F.concat(
        c["s"], F.lit(":"), (c["n"] / F.array_max(shared)).cast("int").cast("string"))), "-")


def fractions(numbers: Column, elements: list[int]) -> Column:
    """Share of each listed element."""
    return F.transform(F.array(*[F.lit(z) for z in elements]), lambda z: F.size(F.filter(numbers, lambda x: x == z)) / F.size(numbers))
