"""Fixed values. Results depend on them, so they are stated plainly and in one place."""

from __future__ import annotations

# --- Fixed values: physical constants (Da) ---------------------------------------------------
PROTON = 1.007276466879
WATER = 18.01056468425

# --- Fixed values: monoisotopic residue masses (Da) of the 20 standard amino acids ------------
RESIDUE_MASS = {
    "A": 71.037113787,
    "C": 103.009184477,
    "D": 115.026943031,
    "E": 129.042593095,
    "F": 147.068413915,
    "G": 57.021463723,
    "H": 137.058911861,
    "I": 113.084064015,
    "K": 128.094963016,
    "L": 113.084064015,
    "M": 131.040484605,
    "N": 114.042927446,
    "P": 97.052763851,
    "Q": 128.058577540,
    "R": 156.101111050,
    "S": 87.032028409,
    "T": 101.047678473,
    "V": 99.068413915,
    "W": 186.079312952,
    "Y": 163.063328575,
}

# --- Fixed values: residue element counts in the order of ELEMENTS ----------------------------
ELEMENTS = ("C", "H", "N", "O", "S", "P")
RESIDUE_ATOMS = {
    "A": (3, 5, 1, 1, 0, 0),
    "C": (3, 5, 1, 1, 1, 0),
    "D": (4, 5, 1, 3, 0, 0),
    "E": (5, 7, 1, 3, 0, 0),
    "F": (9, 9, 1, 1, 0, 0),
    "G": (2, 3, 1, 1, 0, 0),
    "H": (6, 7, 3, 1, 0, 0),
    "I": (6, 11, 1, 1, 0, 0),
    "K": (6, 12, 2, 1, 0, 0),
    "L": (6, 11, 1, 1, 0, 0),
    "M": (5, 9, 1, 1, 1, 0),
    "N": (4, 6, 2, 2, 0, 0),
    "P": (5, 7, 1, 1, 0, 0),
    "Q": (5, 8, 2, 2, 0, 0),
    "R": (6, 12, 4, 1, 0, 0),
    "S": (3, 5, 1, 2, 0, 0),
    "T": (4, 7, 1, 2, 0, 0),
    "V": (5, 9, 1, 1, 0, 0),
    "W": (11, 10, 2, 1, 0, 0),
    "Y": (9, 9, 1, 2, 0, 0),
}

# --- Fixed values: monoisotopic nuclide masses (Da) used by composition text ------------------
NUCLIDE_MASS = {
    "C": 12.0,
    "H": 1.007825035,
    "N": 14.003074,
    "O": 15.99491463,
    "S": 31.9720707,
    "P": 30.973762,
    "2H": 2.014101779,
    "13C": 13.00335483,
    "15N": 15.00010897,
    "18O": 17.9991603,
}

# --- Fixed values: the modifications with published deltas (accession, title, composition) ----
# A full modification table is user input; this small one serves defaults, tests and queries.
MODIFICATIONS = (
    (1, "Acetyl", "H(2) C(2) O", 42.0105647),
    (4, "Carbamidomethyl", "H(3) C(2) N O", 57.021463723),
    (21, "Phospho", "H O(3) P", 79.9663312),
    (35, "Oxidation", "O", 15.994914622),
    (121, "GG", "H(6) C(4) N(2) O(2)", 114.0429274),
    (737, "TMT6plex", "H(20) C(8) 13C(4) N 15N O(2)", 229.1629321),
)

# --- Fixed values: Kyte-Doolittle hydropathy --------------------------------------------------
HYDROPATHY = {
    "A": 1.8,
    "C": 2.5,
    "D": -3.5,
    "E": -3.5,
    "F": 2.8,
    "G": -0.4,
    "H": -3.2,
    "I": 4.5,
    "K": -3.9,
    "L": 3.8,
    "M": 1.9,
    "N": -3.5,
    "P": -1.6,
    "Q": -3.5,
    "R": -4.5,
    "S": -0.8,
    "T": -0.7,
    "V": 4.2,
    "W": -0.9,
    "Y": -1.3,
}

# --- Fixed values: rough natural residue abundances (percent) for random peptides -------------
ABUNDANCE = {
    "A": 8.0,
    "C": 1.4,
    "D": 5.5,
    "E": 6.8,
    "F": 4.0,
    "G": 7.0,
    "H": 2.3,
    "I": 6.0,
    "K": 5.8,
    "L": 10.0,
    "M": 2.4,
    "N": 4.0,
    "P": 4.7,
    "Q": 4.0,
    "R": 5.5,
    "S": 6.6,
    "T": 5.4,
    "V": 7.0,
    "W": 1.0,
    "Y": 3.0,
}

# --- Fixed values: enzymes as (cut after, unless the next residue is one of) ------------------
ENZYMES = {
    "trypsin": ("KR", "P"),
    "trypsin/p": ("KR", ""),
    "lysc": ("K", ""),
    "unspecific": ("GASPVTCLINDQKEMHFRYW", ""),
}
VALID_RESIDUES = "GASPVTCLINDQKEMHFRYW"

# --- Fixed values: fragment grid columns (ion, charge), in grid order -------------------------
ION_COLUMNS = (("b", 1), ("y", 1), ("b", 2), ("y", 2))

# --- Fixed values: split salt and fractions ---------------------------------------------------
SPLIT_SALT = "pepdistill-v1"
SPLIT_FRACTIONS = (0.8, 0.1, 0.1)

# --- Fixed values: ion mobility conversion ----------------------------------------------------
MOBILITY_COEFFICIENT = 1059.62245
DRIFT_GAS_MASS = 28.0

# --- Fixed values: mass-shift tolerances (Da) -------------------------------------------------
SHIFT_TOLERANCE = 1e-4
DECLARED_TOLERANCE = 0.01

# --- Fixed values: retention-scale anchors (sequence, index value) and slack ------------------
ANCHORS = (("TFAHTESHISK", 0.0), ("SILDYVSLVEK", 100.0))
ANCHOR_TOLERANCE = 2.0

# --- Fixed values: histogram grid on [0, 1] ---------------------------------------------------
ANGLE_BINS = 50

# --- Fixed values: token ids ------------------------------------------------------------------
TOKEN_OFFSET = 65
TOKEN_PAD = 26
TOKEN_NTERM = 27
TOKEN_CTERM = 28

# --- Fixed values: reasons a labeler may give for not scoring a spectrum ----------------------
REFUSAL_REASONS = (
    "unsupported_by_wrapper",
    "mass_only_modification",
    "unresolved_modification_name",
    "non_finite_collision_energy",
    "teacher_returned_none",
)

# --- Fixed values: text library writer --------------------------------------------------------
DIANN_COLUMNS = (
    "ModifiedPeptide",
    "StrippedPeptide",
    "PrecursorMz",
    "PrecursorCharge",
    "Tr_recalibrated",
    "IonMobility",
    "ProteinID",
    "Decoy",
    "FragmentMz",
    "FragmentType",
    "FragmentNumber",
    "FragmentCharge",
    "FragmentLossType",
    "RelativeIntensity",
)

# --- Fixed values: provenance keys that are not settings, or not an identity ------------------
BUILD_ONLY_PREFIXES = ("generator", "output", "retention")
PATH_KEYS = ("inputs.model", "inputs.sequence.path")
RENAMED_KEYS = {
    "inputs.fasta_blake2b_256": "inputs.sequence.blake2b_256",
    "inputs.fasta": "inputs.sequence.path",
}
