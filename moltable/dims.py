"""Small dimension tables: elements, units of measure, coordination geometries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# IUPAC symbols and names of elements 1-118, in order of atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NAMES = (
    "Hydrogen Helium Lithium Beryllium Boron Carbon Nitrogen Oxygen Fluorine Neon Sodium Magnesium Aluminium Silicon "
    "Phosphorus Sulfur Chlorine Argon Potassium Calcium Scandium Titanium Vanadium Chromium Manganese Iron Cobalt Nickel "
    "Copper Zinc Gallium Germanium Arsenic Selenium Bromine Krypton Rubidium Strontium Yttrium Zirconium Niobium Molybdenum "
    "Technetium Ruthenium Rhodium Palladium Silver Cadmium Indium Tin Antimony Tellurium Iodine Xenon Caesium Barium "
    "Lanthanum Cerium Praseodymium Neodymium Promethium Samarium Europium Gadolinium Terbium Dysprosium Holmium Erbium "
    "Thulium Ytterbium Lutetium Hafnium Tantalum Tungsten Rhenium Osmium Iridium Platinum Gold Mercury Thallium Lead Bismuth "
    "Polonium Astatine Radon Francium Radium Actinium Thorium Protactinium Uranium Neptunium Plutonium Americium Curium "
    "Berkelium Californium Einsteinium Fermium Mendelevium Nobelium Lawrencium Rutherfordium Dubnium Seaborgium Bohrium "
    "Hassium Meitnerium Darmstadtium Roentgenium Copernicium Nihonium Flerovium Moscovium Livermorium Tennessine Oganesson"
).split()
# Pauling electronegativities of elements 1-103; - where no single value is established.
PAULING = (
    "2.20 - 0.98 1.57 2.04 2.55 3.04 3.44 3.98 - 0.93 1.31 1.61 1.90 2.19 2.58 3.16 - "
    "0.82 1.00 1.36 1.54 1.63 1.66 1.55 1.83 1.88 1.91 1.90 1.65 1.81 2.01 2.18 2.55 2.96 3.00 "
    "0.82 0.95 1.22 1.33 1.60 2.16 1.90 2.20 2.28 2.20 1.93 1.69 1.78 1.96 2.05 2.10 2.66 2.60 "
    "0.79 0.89 1.10 1.12 1.13 1.14 - 1.17 - 1.20 1.10 1.22 1.23 1.24 1.25 - 1.27 "
    "1.30 1.50 2.36 1.90 2.20 2.20 2.28 2.54 2.00 1.62 2.33 2.02 2.00 2.20 - "
    "0.70 0.90 1.10 1.30 1.50 1.38 1.36 1.28 1.30 1.30 1.30 1.30 1.30 1.30 1.30 1.30 -"
).split()
# Rank of elements 1-103 in the order by which oxidation states award bond electrons.
RANKS = (
    "69 83 8 39 64 73 80 82 84 85 5 25 43 59 68 75 78 81 4 10 18 30 36 44 48 52 54 58 55 41 49 62 67 72 77 79 "
    "3 9 13 27 31 32 34 37 38 40 57 35 45 53 61 65 70 74 1 6 12 13 14 15 14 17 19 19 12 20 21 22 23 12 11 "
    "16 28 32 42 44 46 47 60 50 51 56 63 66 71 76 2 7 12 26 33 30 29 24 26 26 26 26 26 26 26 26 26"
).split()
# Digit roots of systematic element names.
ROOTS = "nil un bi tri quad pent hex sept oct enn".split()
PERIOD_ENDS = (2, 10, 18, 36, 54, 86, 118)
NOBLE = (2, 10, 18, 36, 54, 86, 118)


def symbol(z: int) -> str:
    if z <= len(SYMBOLS):
        return SYMBOLS[z - 1]
    return "".join(ROOTS[int(d)][0] for d in str(z)).capitalize()


def name(z: int) -> str:
    """Systematic names drop an n of enn before nil and the last i of bi and tri before ium."""
    if z <= len(NAMES):
        return NAMES[z - 1]
    joined = "".join(ROOTS[int(d)] for d in str(z)) + "ium"
    return joined.replace("nnn", "nn").replace("ii", "i").capitalize()


def period(z: int) -> int | None:
    return next((k for k, end in enumerate(PERIOD_ENDS, 1) if z <= end), None)


def valence_electrons(z: int) -> int | None:
    """Outer s and p electrons: by the distance from the noble gases before and after; none for d and f blocks."""
    if z > 118:
        return None
    before = max((n for n in NOBLE if n < z), default=0)
    after = min(n for n in NOBLE if n >= z)
    if z - before <= 2:
        return z - before
    return 8 - (after - z) if after - z < 6 else None


def _value(text: str) -> float | None:
    return None if text == "-" else float(text)


def element_rows() -> list[tuple]:
    out = []
    for z in range(1, 256):
        known = z <= len(RANKS)
        out.append((z, symbol(z), name(z), period(z), valence_electrons(z), _value(PAULING[z - 1]) if known else None, int(RANKS[z - 1]) if known else None))
    return out


def elements(spark: SparkSession) -> DataFrame:
    """(element, symbol, name, period, valence_electrons, electronegativity, en_rank): 255 rows."""
    return spark.createDataFrame(element_rows(), "element smallint, symbol string, name string, period int, valence_electrons int, electronegativity double, en_rank int")


_BOHR, _KCAL, _KJ, _NEWTON, _DEBYE = 0.529177210544, 627.509474063, 2625.49963948, 8.2387235038e-8, 3.335640951981521e-30
# Fixed values: (unit, symbol, canonical units per unit) of each dimension; the canonical one comes first.
UNITS: dict[str, list[tuple[str, str, float]]] = {
    "acceleration": [("AngstromPerSquarePicosecond", "Å ps⁻²", 1.0), ("NanometerPerSquarePicosecond", "nm ps⁻²", 10.0), ("AngstromPerSquareFemtosecond", "Å fs⁻²", 1e6), ("MeterPerSquareSecond", "m s⁻²", 1e-14), ("AtomicAcceleration", "a₀ atu⁻²", 9.04421612109e8)],
    "amount_of_substance": [("Mole", "mol", 1.0), ("Millimole", "mmol", 0.001), ("Micromole", "μmol", 1e-6), ("Nanomole", "nmol", 1e-9), ("Picomole", "pmol", 1e-12), ("Femtomole", "fmol", 1e-15), ("Molecule", "molecule", 1.6605390671738466e-24)],
    "angle": [("Radian", "rad", 1.0), ("Degree", "°", math.pi / 180.0), ("Milliradian", "mrad", 1e-3), ("Revolution", "rev", 2.0 * math.pi)],
    "area": [("SquareAngstrom", "Å²", 1.0), ("SquareBohr", "a₀²", 0.280028520159), ("SquareNanometer", "nm²", 100.0), ("SquarePicometer", "pm²", 1e-4), ("SquareMeter", "m²", 1e20)],
    "charge": [("ElementaryCharge", "e", 1.0), ("Coulomb", "C", 1.0 / 1.602176634e-19), ("Nanocoulomb", "nC", 1.0 / 1.602176634e-10), ("Picocoulomb", "pC", 1.0 / 1.602176634e-7)],
    "concentration": [("Molar", "M", 1.0), ("Millimolar", "mM", 0.001), ("Micromolar", "μM", 1e-6), ("Nanomolar", "nM", 1e-9), ("Picomolar", "pM", 1e-12), ("Femtomolar", "fM", 1e-15), ("MolePerCubicMeter", "mol/m³", 0.001)],
    "density": [("GramPerCubicCentimeter", "g cm⁻³", 1.0), ("KilogramPerCubicMeter", "kg m⁻³", 0.001), ("DaltonPerCubicAngstrom", "Da Å⁻³", 1.66053906892)],
    "dipole_moment": [("Debye", "D", 1.0), ("ElectronBohr", "ea₀", 8.4783536198e-30 / _DEBYE), ("CoulombMeter", "C·m", 1.0 / _DEBYE)],
    "energy": [("Hartree", "Eₕ", 1.0), ("KilocaloriePerMole", "kcal mol⁻¹", 1.0 / _KCAL), ("KilojoulePerMole", "kJ mol⁻¹", 1.0 / _KJ), ("ElectronVolt", "eV", 1.0 / 27.211386245981), ("Wavenumber", "cm⁻¹", 1.0 / 219474.63136314), ("MilliElectronVolt", "meV", 1.0 / 27211.386245981), ("Joule", "J", 1.0 / 4.3597447222060e-18)],
    "force": [("HartreePerBohr", "Eₕ a₀⁻¹", 1.0), ("KilocaloriePerMolePerAngstrom", "kcal mol⁻¹ Å⁻¹", _BOHR / _KCAL), ("KilojoulePerMolePerNanometer", "kJ mol⁻¹ nm⁻¹", 0.0529177210544 / _KJ), ("ElectronVoltPerAngstrom", "eV Å⁻¹", _BOHR / 27.211386245981), ("Newton", "N", 1.0 / _NEWTON), ("Piconewton", "pN", 1e-12 / _NEWTON)],
    "force_constant": [("HartreePerSquareBohr", "Eₕ a₀⁻²", 1.0), ("KilocaloriePerMolePerSquareAngstrom", "kcal mol⁻¹ Å⁻²", _BOHR * _BOHR / _KCAL), ("KilojoulePerMolePerSquareNanometer", "kJ mol⁻¹ nm⁻²", 0.0529177210544 * 0.0529177210544 / _KJ), ("ElectronVoltPerSquareAngstrom", "eV Å⁻²", _BOHR * _BOHR / 27.211386245981), ("NewtonPerMeter", "N m⁻¹", 5.29177210544e-11 / _NEWTON), ("PiconewtonPerNanometer", "pN nm⁻¹", 5.29177210544e-14 / _NEWTON)],
    "frequency": [("Wavenumber", "cm⁻¹", 1.0), ("AtomicFrequency", "a.u.", 219474.63136314), ("Terahertz", "THz", 33.3564095198152), ("Hertz", "Hz", 1.0 / 29979245800.0)],
    "length": [("Angstrom", "Å", 1.0), ("Bohr", "a₀", _BOHR), ("Nanometer", "nm", 10.0), ("Picometer", "pm", 0.01), ("Meter", "m", 1e10)],
    "mass": [("Dalton", "Da", 1.0), ("ElectronMass", "mₑ", 5.485799090441e-4), ("ProtonMass", "mₚ", 1.0072764665789), ("Gram", "g", 6.0221407537e23), ("Kilogram", "kg", 6.0221407537e26)],
    "momentum": [("DaltonAngstromPerPicosecond", "Da Å ps⁻¹", 1.0), ("DaltonNanometerPerPicosecond", "Da nm ps⁻¹", 10.0), ("DaltonAngstromPerFemtosecond", "Da Å fs⁻¹", 1000.0), ("AtomicMomentum", "ℏ a₀⁻¹", 12.0012347360555), ("KilogramMeterPerSecond", "kg m s⁻¹", 6.0221407537e24)],
    "pressure": [("Bar", "bar", 1.0), ("Atmosphere", "atm", 1.01325), ("Pascal", "Pa", 1e-5), ("Kilopascal", "kPa", 0.01), ("Megapascal", "MPa", 10.0), ("Gigapascal", "GPa", 1e4)],
    "reciprocal_area": [("ReciprocalSquareAngstrom", "Å⁻²", 1.0), ("ReciprocalSquareBohr", "a₀⁻²", 3.571064830938), ("ReciprocalSquareNanometer", "nm⁻²", 0.01), ("ReciprocalSquarePicometer", "pm⁻²", 1e4), ("ReciprocalSquareMeter", "m⁻²", 1e-20)],
    "reciprocal_length": [("ReciprocalAngstrom", "Å⁻¹", 1.0), ("ReciprocalBohr", "a₀⁻¹", 1.889726125908), ("ReciprocalNanometer", "nm⁻¹", 0.1), ("ReciprocalPicometer", "pm⁻¹", 100.0), ("ReciprocalMeter", "m⁻¹", 1e-10)],
    "reciprocal_volume": [("ReciprocalCubicAngstrom", "Å⁻³", 1.0), ("ReciprocalCubicBohr", "a₀⁻³", 6.748334508335), ("ReciprocalCubicNanometer", "nm⁻³", 0.001), ("ReciprocalCubicPicometer", "pm⁻³", 1e6), ("ReciprocalCubicMeter", "m⁻³", 1e-30), ("ReciprocalLiter", "L⁻¹", 1e-27), ("ReciprocalMilliliter", "mL⁻¹", 1e-24)],
    "temperature": [("Kelvin", "K", 1.0), ("Rankine", "°R", 5.0 / 9.0)],
    "time": [("Picosecond", "ps", 1.0), ("Femtosecond", "fs", 0.001), ("Nanosecond", "ns", 1000.0), ("Second", "s", 1e12), ("AtomicTime", "atu", 2.4188843265864e-5)],
    "velocity": [("AngstromPerPicosecond", "Å ps⁻¹", 1.0), ("NanometerPerPicosecond", "nm ps⁻¹", 10.0), ("AngstromPerFemtosecond", "Å fs⁻¹", 1000.0), ("MeterPerSecond", "m s⁻¹", 0.01), ("AtomicVelocity", "a₀ atu⁻¹", 2.18769126216e4)],
    "volume": [("CubicAngstrom", "Å³", 1.0), ("CubicBohr", "a₀³", 0.148184711171), ("CubicNanometer", "nm³", 1000.0), ("CubicPicometer", "pm³", 1e-6), ("CubicMeter", "m³", 1e30), ("Liter", "L", 1e27), ("Milliliter", "mL", 1e24)],
}


def units(spark: SparkSession) -> DataFrame:
    """(dimension, unit, symbol, to_canonical)."""
    return spark.createDataFrame([(d, *u) for d, own in UNITS.items() for u in own], "dimension string, unit string, symbol string, to_canonical double")


def ratio(dimension: str, source: str, target: str) -> float:
    """What values in `source` are multiplied by to be in `target`: one quotient, so one rounding."""
    factor = {u: f for u, _, f in UNITS[dimension]}
    return factor[source] / factor[target]


def convert(column, dimension: str, source: str, target: str):
    return column * F.lit(ratio(dimension, source, target))


def shown(column, dimension: str, unit: str):
    """A quantity as text: value, a space, the unit's symbol."""
    return F.concat(column.cast("string"), F.lit(" " + next(s for u, s, _ in UNITS[dimension] if u == unit)))


# The coordination geometries in order, with polyhedral symbol, slots, configurations.
GEOMETRIES = [
    ("Linear", "L-2", 2, 1), ("Angular", "A-2", 2, 1), ("TrigonalPlanar", "TP-3", 3, 1), ("TrigonalPyramidal", "TPY-3", 3, 2), ("TShaped", "TS-3", 3, 3), ("Tetrahedral", "T-4", 4, 2), ("SquarePlanar", "SP-4", 4, 3),
    ("PyramidalizedSquare", "SPY-4", 4, 6), ("Seesaw", "SS-4", 4, 12), ("TrigonalBipyramidal", "TBPY-5", 5, 20), ("SquarePyramidal", "SPY-5", 5, 30), ("Octahedral", "OC-6", 6, 30), ("TrigonalPrismatic", "TPR-6", 6, 120),
]
# Geometry by electron domains and substituents.
VSEPR = {
    (2, 2): "Linear", (3, 3): "TrigonalPlanar", (3, 2): "Angular", (4, 4): "Tetrahedral", (4, 3): "TrigonalPyramidal", (4, 2): "Angular", (5, 5): "TrigonalBipyramidal", (5, 4): "Seesaw",
    (5, 3): "TShaped", (5, 2): "Linear", (6, 6): "Octahedral", (6, 5): "SquarePyramidal", (6, 4): "SquarePlanar", (6, 3): "TShaped", (6, 2): "Linear",
}


def geometries(spark: SparkSession) -> DataFrame:
    """(geometry, name, polyhedral_symbol, slot_count, configuration_count, is_stereogenic)."""
    return spark.createDataFrame([(i, *g, g[3] > 1) for i, g in enumerate(GEOMETRIES)], "geometry int, name string, polyhedral_symbol string, slot_count int, configuration_count int, is_stereogenic boolean")


def vsepr(spark: SparkSession) -> DataFrame:
    """(domains, coordination, geometry, geometry_name)."""
    index = {g[0]: i for i, g in enumerate(GEOMETRIES)}
    return spark.createDataFrame([(d, c, index[g], g) for (d, c), g in VSEPR.items()], "domains int, coordination int, geometry int, geometry_name string")
