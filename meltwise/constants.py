"""Fixed domain values: element constants, thresholds, synonym and rule tables.

Operators read these tables by default; callers may pass their own.
"""

from __future__ import annotations

# Atomic weights (g/mol).
ATOMIC_WEIGHT = {
    "Ni": 58.69, "Co": 58.93, "Cr": 52.00, "Mo": 95.95, "W": 183.84,
    "Al": 26.98, "Ti": 47.87, "Ta": 180.95, "Nb": 92.91, "Re": 186.21,
    "Fe": 55.85, "C": 12.01, "B": 10.81, "Hf": 178.49, "Zr": 91.22,
    "Ru": 101.07, "V": 50.94, "Mn": 54.94, "Si": 28.09, "Cu": 63.55,
    "N": 14.01, "La": 138.91, "Y": 88.91,
}

# D-electron parameter Md per element.
MD = {
    "Ni": 0.717, "Co": 0.777, "Cr": 1.142, "Mo": 1.55, "W": 1.655,
    "Al": 1.9, "Ti": 2.271, "Ta": 2.224, "Nb": 2.117, "Re": 1.267,
    "Fe": 0.858, "Hf": 3.0, "Zr": 2.9, "Ru": 1.006, "V": 1.543,
}

# Element densities (g/cm3); anything else counts as 8.0.
DENSITY = {
    "Ni": 8.90, "Co": 8.90, "Cr": 7.19, "Mo": 10.28, "W": 19.25,
    "Al": 2.70, "Ti": 4.50, "Ta": 16.69, "Nb": 8.57, "Re": 21.02,
    "Fe": 7.87, "Hf": 13.31, "Zr": 6.51, "Ru": 12.37, "V": 6.11,
    "Mn": 7.21, "Si": 2.33, "Cu": 8.96, "C": 2.26, "B": 2.34,
}
DEFAULT_DENSITY = 8.0

# Elastic moduli (GPa) of the elements the mixing rule lists.
MODULUS = {
    "Ni": 200.0, "Cr": 279.0, "Co": 209.0, "Al": 70.0, "Ti": 116.0,
    "Mo": 329.0, "W": 411.0, "Fe": 211.0, "Ta": 186.0, "Re": 463.0,
    "Nb": 105.0, "Hf": 78.0, "Mn": 198.0, "Si": 130.0,
}
DEFAULT_MODULUS = 200.0

# Partition coefficients k (precipitate over matrix); default 1.0.
PARTITION = {
    "Al": 4.0, "Ti": 6.0, "Ta": 4.0, "Nb": 3.0, "Hf": 2.0, "Ni": 1.1,
    "Co": 0.6, "Cr": 0.1, "Mo": 0.3, "W": 0.4, "Re": 0.1, "Ru": 0.4,
    "Fe": 0.3, "V": 0.3,
}

# Vegard coefficients (angstrom per atomic fraction); default 0.0.
LATTICE = {
    "Ni": 0.0, "Al": 0.179, "Ti": 0.422, "Cr": 0.113, "Mo": 0.467,
    "W": 0.575, "Ta": 0.670, "Nb": 0.700, "Re": 0.528, "Co": 0.010,
    "Fe": 0.050, "Hf": 0.850, "V": 0.150, "C": 0.0, "B": 0.0, "Zr": 0.9,
}
LATTICE_NI = 3.524

# Valence electron counts; default 0.
VALENCE = {
    "Ni": 10, "Co": 9, "Fe": 8, "Cr": 6, "Mo": 6, "W": 6, "Al": 3, "Ti": 4,
    "Nb": 5, "Ta": 5, "Re": 7, "Ru": 8, "V": 5, "Hf": 4, "Zr": 4, "C": 4, "B": 3,
}

# Metallic radii (angstrom).
RADIUS = {
    "Ni": 1.246, "Co": 1.251, "Fe": 1.241, "Cr": 1.249, "Mo": 1.363,
    "W": 1.370, "Re": 1.375, "Al": 1.432, "Ti": 1.462, "Ta": 1.430,
    "Nb": 1.429, "Hf": 1.564, "V": 1.316,
}

# Matrix solid-solution coefficients.
SSS_COEFF = {"Re": 3.0, "W": 2.2, "Mo": 1.0, "V": 0.8, "Cr": 0.3, "Fe": 0.2, "Co": 0.1}

# Solid-solution potency (MPa per wt%).
POTENCY = {
    "Re": 18.0, "W": 12.0, "Mo": 10.0, "Hf": 10.0, "Nb": 8.0, "Ta": 7.0,
    "Ti": 6.0, "Cr": 3.0, "Al": 1.5, "Fe": 1.5, "Co": 2.0, "V": 4.0,
    "Mn": 0.5, "Si": 0.3,
}

# Precipitate formers and solubility terms of the volume-fraction rule.
FORMER_WEIGHT = {"Al": 0.75, "Ti": 1.20, "Ta": 1.30, "Nb": 1.05, "V": 0.5}
SOLUBILITY_BASE = 2.0
SOLUBILITY = {"Co": 0.04, "Fe": -0.05, "Cr": 0.03}

# Stability thresholds on Md (bulk) and the matrix upgrade.
TCP_MODERATE, TCP_ELEVATED, TCP_CRITICAL, TCP_MATRIX_BOOST = 0.940, 0.960, 0.985, 0.980
TCP_LEVELS = ["Low", "Moderate", "Elevated", "Critical"]

# Solid-solution family.
SSS = {
    "former_max": 2.0, "ys_min": 240.0, "ys_max": 500.0,
    "el_wrought": 52.0, "el_cast": 10.0,
    "ratio_wrought": 2.0, "ratio_cast": 1.5,
    "ratio_max_wrought": 2.4, "ratio_max_cast": 1.7,
    "sigma_base": 120.0, "hp_wrought": 40.0, "hp_cast": 20.0, "cast_reduction": 0.68,
    "t1": 600.0, "slow": 0.00055, "tau1": 450.0, "t2": 900.0, "tau2": 150.0, "floor": 0.12,
    "el_t": 500.0, "el_rate": 0.0019,
}

# Precipitate family temperature curve.
GP = {
    "stage1": 750.0, "linear": 0.00020, "tau1": 450.0, "tau2": 66.0, "floor": 0.02,
    "solvus_base": 700.0, "solvus_per_pct": 8.0, "ref": 25.0, "el_rate": 0.0018,
}

# Single-crystal / directionally solidified family.
SC_DS = {"t1": 850.0, "tau": 250.0, "floor": 0.35, "linear": 0.00006}

# Route parameters.
ROUTE = {
    "wrought": {"coeff_gp": 28.0, "base": 120.0, "hp": 50.0, "sss": 12.0,
                "cal_ys": 0.90, "cal_uts": 0.90, "cal_el": 1.0, "ductility": 35.0, "el_min": 10.0},
    "cast": {"coeff_gp": 10.0, "base": 120.0, "hp": 0.0, "sss": 12.0,
             "cal_ys": 0.95, "cal_uts": 0.95, "cal_el": 1.0, "ductility": 20.0, "el_min": 5.0},
}
WROUGHT_ROUTES = ["wrought", "forged"]

# Elastic modulus decay per degree above 20 C, floor 0.5.
EM_DECAY, EM_BASE_T, EM_FLOOR = 0.00032, 20.0, 0.50

# Anchoring gate and weight.
ANCHOR_MAX, ANCHOR_MAX_INCOMPATIBLE = 4.5, 3.0
ANCHOR_MIDPOINT, ANCHOR_SLOPE = 2.5, 0.5
ANCHOR_MIN_DIVERGENCE_PCT, ANCHOR_MAX_GP_DIFF = 15.0, 10.0

# Calibrated interval offsets and physical domain.
INTERVAL_OFFSETS = [
    ("ys", -182.719, 190.153, 0.0, None),
    ("uts", -217.685, 218.006, 0.0, None),
    ("el", -19.173, 19.423, 0.0, 100.0),
    ("em", -38.125, 37.793, 0.0, None),
]

# Declared feature ranges (inclusive).
FEATURE_RANGES = [
    ("density", 7.0, 10.0),
    ("gp", 0.0, 85.0),
    ("md_avg", 0.70, 1.05),
    ("mismatch", -2.0, 2.0),
]

# Admissible windows of the record sweep.
SWEEP_BOUNDS = {"ys": (50.0, 2000.0), "uts": (50.0, 2500.0), "el": (0.0, 80.0), "em": (50.0, 350.0)}

# Distance strata (half open) and temperature bands.
STRATA = [("NEAR", 0.0, 2.0), ("MID", 2.0, 4.5), ("FAR", 4.5, None)]
PROPERTIES = ["ys", "uts", "el", "em"]

# The 19 balance-free components of the test compositions, in index order.
FIXTURE_COMPONENTS = [
    "Co", "Cr", "Mo", "W", "Al", "Ti", "Ta", "Nb", "Re", "Fe",
    "C", "B", "Hf", "Zr", "Ru", "V", "Mn", "Si", "Cu",
]

# Property synonyms to canonical names.
PROPERTY_KEYS = {
    "YS": "ys", "Yield": "ys", "yield_strength": "ys", "YieldStrength": "ys",
    "Yield_Strength": "ys", "Yield Strength": "ys",
    "UTS": "uts", "Tensile": "uts", "tensile_strength": "uts", "TensileStrength": "uts",
    "Tensile_Strength": "uts", "Tensile Strength": "uts",
    "EM": "em", "E": "em", "Modulus": "em", "elastic_modulus": "em", "ElasticModulus": "em",
    "Elastic_Modulus": "em", "Elastic Modulus": "em",
    "El": "el", "elongation": "el", "Ductility": "el", "Elongation": "el",
    "GP": "gp", "Gamma_Prime": "gp", "gamma_prime": "gp", "GammaPrime": "gp", "γ'": "gp",
    "Gamma Prime": "gp", "density": "density", "Density": "density",
}
