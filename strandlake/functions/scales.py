"""Residue scales and rule constants. They must equal published tables for right results."""

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
MIN_LENGTH, MAX_LENGTH = 8, 50
TOP_MIN_LENGTH, TOP_MAX_LENGTH = 12, 30
FORBIDDEN = "C"
MAX_IDENTITY = 0.80
POTENCY_UM = 16.0

HELIX_DEGREES, HELIX_RISE, HELIX_RADIUS = 100.0, 1.5, 2.3

PKA_BASE = {"H": 6.04, "K": 10.54, "R": 12.48}
PKA_ACID = {"C": 8.18, "D": 3.90, "E": 4.07, "Y": 10.46}
PKA_N_TERMINUS, PKA_C_TERMINUS = 9.69, 2.34

EISENBERG = dict(A=0.62, C=0.29, D=-0.90, E=-0.74, F=1.19, G=0.48, H=-0.40, I=1.38, K=-1.50, L=1.06, M=0.64, N=-0.78, P=0.12, Q=-0.85, R=-2.53, S=-0.18, T=-0.05, V=1.08, W=0.81, Y=0.26)
KYTE_DOOLITTLE = dict(A=1.8, C=2.5, D=-3.5, E=-3.5, F=2.8, G=-0.4, H=-3.2, I=4.5, K=-3.9, L=3.8, M=1.9, N=-3.5, P=-1.6, Q=-3.5, R=-4.5, S=-0.8, T=-0.7, V=4.2, W=-0.9, Y=-1.3)
BOMAN = dict(A=-1.81, C=-1.28, D=8.72, E=6.81, F=-2.98, G=-0.94, H=4.66, I=-4.92, K=5.55, L=-4.92, M=-2.35, N=6.64, P=0.00, Q=5.54, R=14.92, S=3.40, T=2.57, V=-4.04, W=-2.33, Y=-0.14)
WW_INTERFACE = dict(A=0.17, C=-0.24, D=1.23, E=2.02, F=-1.13, G=0.01, H=0.96, I=-0.31, K=0.99, L=-0.56, M=-0.23, N=0.42, P=0.45, Q=0.58, R=0.81, S=0.13, T=0.14, V=0.07, W=-1.85, Y=-0.94)
WW_OCTANOL = dict(A=0.50, C=-0.02, D=3.64, E=3.63, F=-1.71, G=1.15, H=2.33, I=-1.12, K=2.80, L=-1.25, M=-0.67, N=0.85, P=0.14, Q=0.77, R=1.81, S=0.46, T=0.25, V=-0.46, W=-2.09, Y=-0.71)
HELIX_PROPENSITY = dict(A=1.42, C=0.70, D=1.01, E=1.51, F=1.13, G=0.57, H=1.00, I=1.08, K=1.16, L=1.21, M=1.45, N=0.67, P=0.57, Q=1.11, R=0.98, S=0.77, T=0.83, V=1.06, W=1.08, Y=0.69)
SHEET_PROPENSITY = dict(A=0.83, C=1.19, D=0.54, E=0.37, F=1.38, G=0.75, H=0.87, I=1.60, K=0.74, L=1.30, M=1.05, N=0.89, P=0.55, Q=1.10, R=0.93, S=0.75, T=1.19, V=1.70, W=1.37, Y=1.47)
RESIDUE_MASS = dict(A=71.0788, C=103.1388, D=115.0886, E=129.1155, F=147.1766, G=57.0519, H=137.1411, I=113.1594, K=128.1741, L=113.1594, M=131.1926, N=114.1038, P=97.1167, Q=128.1307, R=156.1875, S=87.0782, T=101.1051, V=99.1326, W=186.2132, Y=163.1760)
WATER_MASS = 18.0153
#: Helix propagation weights; what is missing counts 0.5.
HELIX_WEIGHT = dict(A=1.00, C=0.45, D=0.52, E=0.72, F=0.65, G=0.20, H=0.54, I=0.70, K=0.76, L=0.85, M=0.82, N=0.48, P=0.02, Q=0.74, R=0.79, S=0.55, T=0.46, V=0.50, W=0.68, Y=0.51)
NUCLEATION_WATER, NUCLEATION_INTERFACE, INTERFACE_BOOST = 0.036, 0.145, 1.45

HYDROPHOBIC, BETA_BRANCHED, OXIDATION_PRONE = "AILMFVWY", "IVT", "MW"
LIABILITY_MOTIFS = ("NG", "DP", "DG", "NS")

#: name: (low, high) of the soft design windows, and the floor of the helical moment.
WINDOWS = {"net_charge": (3.0, 9.0), "mean_hydrophobicity": (-0.10, 0.55), "longest_hydrophobic_run": (0.0, 4.0), "boman": (0.0, 3.2)}
MOMENT_FLOOR = 0.25
