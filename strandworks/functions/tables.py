"""Lookup tables that results depend on."""

#: Three- and one-letter codes of the amino acids.
AMINO = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}

#: Nucleotide residue names.
NUCLEOTIDES = ("DA", "DC", "DG", "DT", "A", "C", "G", "T", "U")

#: Common carbohydrate residue names; no full component dictionary.
CARBOHYDRATES = ("AHR", "ARA", "BGC", "BMA", "FRU", "FUC", "FUL", "GAL", "GLA", "GLC", "GCU", "IDS", "MAN", "NAG", "NDG", "NGA", "RAM", "RIB", "SIA", "SUC", "TRE", "XYP", "XYS")

#: The five ProtFP components of each amino acid.
PFP = {
    "G": (-5.7, -8.72, 4.18, -1.35, -0.31),
    "A": (-0.1, -4.94, -2.13, 1.7, -0.39),
    "C": (4.62, -3.54, 1.5, -1.26, 3.27),
    "V": (5.04, -2.9, -2.29, 1.38, 0.06),
    "L": (5.76, -1.33, -1.71, 0.63, -1.7),
    "I": (6.58, -1.73, -2.49, 1.09, -0.34),
    "M": (5.11, 0.19, -1.02, 0.15, 0.13),
    "F": (6.76, 0.88, 0.89, -1.12, -0.49),
    "W": (7.33, 4.55, 2.77, -2.41, -1.08),
    "Y": (3.14, 3.59, 2.45, -1.27, -0.06),
    "H": (0.17, 2.14, 1.2, 0.71, 1.16),
    "T": (-2.0, -1.77, -0.7, 1.02, 1.06),
    "P": (-3.82, -2.31, 3.45, 1.0, -3.22),
    "S": (-4.57, -2.55, -0.67, 1.11, 0.99),
    "D": (-6.61, 0.94, -3.04, -4.58, 0.48),
    "N": (-4.88, 0.81, 0.14, -0.14, 1.23),
    "E": (-5.1, 2.2, -3.59, -2.26, -2.14),
    "Q": (-3.95, 2.88, -0.83, 0.52, 0.9),
    "K": (-4.99, 5.0, 0.7, 3.0, -1.23),
    "R": (-2.79, 6.6, 1.21, 2.07, 1.67),
}

#: Covalent bond lengths by element pair, exclusive bounds.  NC-NC
#: is the range of non-covalent contacts.
BONDS = {
    "B-B": (1.7, 1.85), "B-C": (1.5, 1.8), "B-H": (1.0, 1.25), "B-O": (1.3, 1.6), "BR-C": (1.75, 2.0), "BR-H": (1.2, 1.5), "BR-O": (1.55, 1.6),
    "C-C": (1.3, 1.65), "C-CL": (1.6, 1.85), "C-F": (1.2, 1.5), "C-H": (0.9, 1.2), "C-I": (1.9, 2.3), "C-N": (1.2, 1.6), "C-O": (1.1, 1.6),
    "C-P": (1.7, 1.95), "C-RU": (1.8, 2.3), "C-S": (1.5, 1.95), "C-SE": (1.6, 1.99), "C-SI": (1.75, 1.95), "CL-H": (1.7, 1.85),
    "CL-O": (1.35, 1.5), "CL-P": (1.9, 2.1), "CL-S": (2.0, 2.15), "CL-SI": (2.05, 2.1), "F-F": (1.9, 2.35), "F-H": (0.7, 1.1),
    "F-N": (1.3, 1.45), "F-P": (1.45, 1.65), "F-S": (1.4, 1.8), "F-SI": (1.55, 1.75), "H-N": (0.9, 1.1), "H-O": (0.9, 1.1), "H-S": (1.2, 1.4),
    "I-O": (2.0, 2.2), "N-N": (1.1, 1.5), "N-O": (1.1, 1.6), "N-P": (1.5, 1.8), "N-S": (1.35, 1.85), "N-SI": (1.65, 1.8), "NC-NC": (2.0, 5.0),
    "O-P": (1.35, 1.8), "O-S": (1.3, 1.7), "O-SI": (1.55, 1.7), "P-P": (2.1, 2.26), "P-S": (1.85, 2.0), "P-SE": (2.0, 2.15), "P-SI": (2.2, 2.3),
    "S-S": (1.7, 2.1), "S-SE": (2.15, 2.3), "S-SI": (2.1, 2.2), "SE-SE": (2.29, 2.4), "SI-SE": (2.3, 2.4), "X-X": (1.2, 2.0),
}

#: What makes a group of atoms a ligand.
LIGAND_MIN_ATOMS, LIGAND_MIN_ATOM_CONTACTS, LIGAND_MIN_RESIDUE_CONTACTS = 6, 5, 3

#: Residue names of water and common solvents and ions.
SOLVENTS = tuple(
    """
    1PE 2HT 2PE 3CO 3NI 3P8 4MO 4PU 4TI 6MO 7PE ACT AF3 AG AL ALF AM AU AU3 AUC AZI BA BCT BEF BF4 BME BO4 BR BS3
    BSY BTB BU3 BUD CA CAC CD CE CF CIT CL CO CO3 COM CON CR CS CU CU1 CU3 CUA CUZ CXS CYN DIO DMS DOD DTD DTT DTV
    DVT DY EDO EMC EOH EPE ER3 EU EU3 F FE FE2 FLC FMT FPO GA GBL GD3 GG5 GLC GOL HG HN4 HOH IN IOD IPA IPH IR IR3
    IRI IUM K LA LCO LCP LI LU MAC MES MG MGF MG8 MLA MLI MMC MOO MN MN3 MOH MOS MOW MPD MRD MXE MYR NA ND NET NH4
    NI NO2 NO3 NRU OAA OCT OH OS OS4 OXL P4C P4G P6G PB PBM PD PDV PE4 PEG PER PG0 PG4 PGE PGF PGO PI PO3 PO4 PR
    PT PT4 PTL PTN RB RH3 RHD RHF RU SB SCN SE4 SEK SGM SIN SM SMO SO3 SO4 SR SRT T1A TAM TAR TB TBA TBR TCE TCN
    TFA TH THE TL TLA TMA TRS UNX V VN3 VO4 W WO5 Y1 YB YB2 YT3 ZCM ZN ZN2 ZR
    """.split()
)

#: Bits of an atom's mark.
MARK = {"UNK": 1, "SOLVENT": 2, "LIGAND": 4, "PEP": 8, "NUC": 16, "CARB": 32, "COVALENT": 64}

#: Heavy atoms of the canonical residues, without the terminal OXT.
BACKBONE = ("N", "CA", "C", "O")
SIDE_CHAIN = {
    "ALA": "CB", "ARG": "CB CG CD NE CZ NH1 NH2", "ASN": "CB CG OD1 ND2", "ASP": "CB CG OD1 OD2", "CYS": "CB SG", "GLN": "CB CG CD OE1 NE2",
    "GLU": "CB CG CD OE1 OE2", "GLY": "", "HIS": "CB CG ND1 CD2 CE1 NE2", "ILE": "CB CG1 CG2 CD1", "LEU": "CB CG CD1 CD2", "LYS": "CB CG CD CE NZ",
    "MET": "CB CG SD CE", "PHE": "CB CG CD1 CD2 CE1 CE2 CZ", "PRO": "CB CG CD", "SER": "CB OG", "THR": "CB OG1 CG2",
    "TRP": "CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2", "TYR": "CB CG CD1 CD2 CE1 CE2 CZ OH", "VAL": "CB CG1 CG2",
}

#: Van der Waals radii of the elements, for surface areas.
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8, "H": 1.2, "F": 1.47, "CL": 1.75, "SE": 1.9}

#: BLOSUM62, rows and columns in the order of its letters.
BLOSUM_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62 = """
4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0 -2 -1 0 -4
-1 5 0 -2 -3 1 0 -2 0 -3 -2 2 -1 -3 -2 -1 -1 -3 -2 -3 -1 0 -1 -4
-2 0 6 1 -3 0 0 0 1 -3 -3 0 -2 -3 -2 1 0 -4 -2 -3 3 0 -1 -4
-2 -2 1 6 -3 0 2 -1 -1 -3 -4 -1 -3 -3 -1 0 -1 -4 -3 -3 4 1 -1 -4
0 -3 -3 -3 9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3 -2 -4
-1 1 0 0 -3 5 2 -2 0 -3 -2 1 0 -3 -1 0 -1 -2 -1 -2 0 3 -1 -4
-1 0 0 2 -4 2 5 -2 0 -3 -3 1 -2 -3 -1 0 -1 -3 -2 -2 1 4 -1 -4
0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3 -1 -2 -1 -4
-2 0 1 -1 -3 0 0 -2 8 -3 -3 -1 -2 -1 -2 -1 -2 -2 2 -3 0 0 -1 -4
-1 -3 -3 -3 -1 -3 -3 -4 -3 4 2 -3 1 0 -3 -2 -1 -3 -1 3 -3 -3 -1 -4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4 -2 2 0 -3 -2 -1 -2 -1 1 -4 -3 -1 -4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5 -1 -3 -1 0 -1 -3 -2 -2 0 1 -1 -4
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5 0 -2 -1 -1 -1 -1 1 -3 -1 -1 -4
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6 -4 -2 -2 1 3 -1 -3 -3 -1 -4
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7 -1 -1 -4 -3 -2 -2 -1 -2 -4
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4 1 -3 -2 -2 0 0 0 -4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5 -2 -2 0 -1 -1 0 -4
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3 -4 -3 -2 -4
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7 -1 -3 -2 -1 -4
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4 -3 -2 -1 -4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4 1 -1 -4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4 -1 -4
0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1 -4
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 1
"""
