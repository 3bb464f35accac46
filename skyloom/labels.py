"""Labels of observations and their numbers."""

# Every label with its number, in order; the number is the place in the list.
LABELS = [
    "ok",
    "not checked",
    "duplicated timestamp outlier",
    "gross value outlier",
    "persistence outlier",
    "repetitions outlier",
    "in step outlier group",
    "in window variation outlier group",
    "buddy check outlier",
    "buddy check (with safetynets) outlier",
    "QC outlier",
    "gap",
    "interpolation",
    "failed interpolation",
    "raw modeldata fill",
    "failed raw modeldata fill",
    "debiased modeldata fill",
    "failed debiased modeldata fill",
    "diurnal debiased modeldata fill",
    "failed diurnal debiased modeldata fill",
    "Weighted diurnal debiased modeldata fill",
    "failed Weighted diurnal debiased modeldata fill",
]
NUMBERS = {label: i for i, label in enumerate(LABELS)}
OK, GAP = LABELS[0], LABELS[11]
CHECKS = {
    "duplicated_timestamp": LABELS[2],
    "gross_value": LABELS[3],
    "persistence": LABELS[4],
    "repetitions": LABELS[5],
    "step": LABELS[6],
    "window_variation": LABELS[7],
    "buddy_check": LABELS[8],
    "buddy_check_with_safetynets": LABELS[9],
}
FILLS = {
    "interpolation": LABELS[12],
    "raw": LABELS[14],
    "debiased": LABELS[16],
    "diurnal_debiased": LABELS[18],
    "weighted_diurnal_debiased": LABELS[20],
}
FAILED = {k: LABELS[NUMBERS[v] + 1] for k, v in FILLS.items()}
