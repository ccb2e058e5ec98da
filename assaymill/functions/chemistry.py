"""Structure functions behind an optional toolkit; without it they raise, as their results cannot be approximated."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

try:
    from rdkit import Chem
    from rdkit.Chem import rdFingerprintGenerator
    from rdkit.Chem.Scaffolds import MurckoScaffold
except ImportError:
    Chem = None

#: A structure with an atom of these is a metal complex, whatever its fragments.
METALS = frozenset(
    "Pt Pd Ni Co Cu Zn Fe Mn Cr Ti V Ru Rh Ir Os Mo W Re Au Ag Hg Cd Pb Al Ga In Sn Sb Bi Zr Hf Ta Nb Y La Ce Gd Lu Yb Er Eu Sm Tb Ho Dy Tm Pr Nd".split()
)


def available() -> bool:
    return Chem is not None


def _need() -> None:
    if Chem is None:
        raise RuntimeError("the optional structure toolkit is not installed")


def largest_fragment(smiles: Column | str) -> Column:
    """The fragment with the most letters outside brackets' hydrogens: a toolkit-free stand-in for screening salts, not a standardisation."""
    size = lambda f: F.length(F.regexp_replace(F.regexp_replace(f, r"\[H\]", ""), r"[^A-Za-z]", ""))
    parts = F.transform(F.split(smiles, r"\."), lambda f: F.struct((-size(f)).alias("n"), f.alias("f")))
    return F.array_min(parts)["f"]


def has_counter_ion(smiles: Column | str) -> Column:
    return F.instr(smiles, ".") > 0


def text_salt_class(smiles: Column | str) -> Column:
    """single, salt_or_solvate or metal_complex from the text alone, with no toolkit: metals are always written in brackets, fragments are parted by dots."""
    c = F.col(smiles) if isinstance(smiles, str) else smiles
    marks = F.regexp_extract_all(c, F.lit(r"\[[0-9]*([A-Z][a-z]?)[^\]]*\]"), F.lit(1))
    metal = F.exists(marks, lambda a: a.isin(*sorted(METALS)))
    return F.when(metal, "metal_complex").when(F.instr(c, ".") > 0, "salt_or_solvate").when(c.isNotNull(), "single")


def standardise():
    """Pandas UDF: canonical isomeric SMILES of the fragment with the most heavy atoms."""
    _need()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            m = Chem.MolFromSmiles(x) if x else None
            return None if m is None else Chem.MolToSmiles(max(Chem.GetMolFrags(m, asMols=True), key=lambda f: f.GetNumHeavyAtoms()))

        return s.map(one)

    return run


def inchikey():
    _need()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: Chem.MolToInchiKey(m) if x and (m := Chem.MolFromSmiles(x)) else None)

    return run


def murcko_scaffold():
    _need()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: MurckoScaffold.MurckoScaffoldSmiles(x) if x and Chem.MolFromSmiles(x) else None)

    return run


def morgan_bits(radius: int = 2, size: int = 2048):
    """Pandas UDF: chirality-aware circular fingerprint as array<tinyint>."""
    _need()

    @F.pandas_udf("array<tinyint>")
    def run(s: pd.Series) -> pd.Series:
        g = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=size, includeChirality=True)
        return s.map(lambda x: list(g.GetFingerprint(m)) if x and (m := Chem.MolFromSmiles(x)) else None)

    return run


def salt_class():
    """Pandas UDF: single, salt_or_solvate or metal_complex."""
    _need()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            m = Chem.MolFromSmiles(x) if x else None
            if m is None:
                return None
            if METALS & {a.GetSymbol() for a in m.GetAtoms()}:
                return "metal_complex"
            return "salt_or_solvate" if len(Chem.GetMolFrags(m)) > 1 else "single"

        return s.map(one)

    return run
