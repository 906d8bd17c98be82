"""They must equal the established behaviour for results to agree."""

# Words that mark the role of a column, per ledger style, in order of preference.
DATE_WORDS = {
    "classic": ["date", "jour", "time", "reglement", "payment"],
    "service": ["date", "jour", "mois", "month", "time", "reglement", "payment"],
    "split": ["date", "jour", "reglement"],
    "by_code": ["date", "jour", "time", "mois"],
}
AMOUNT_WORDS = {
    "classic": ["montant", "sum", "prix", "amount", "valeur"],
    "service": ["montant", "sum", "prix", "amount", "valeur"],
    "split": ["montant", "amount", "somme", "sum"],
    "by_code": ["montant", "sum", "prix", "amount", "value"],
}
ENTITY_WORDS_SPLIT = ["ordon", "ordonnat", "etabl", "code"]
ENTITY_WORDS_BY_CODE = ["ordinateur", "ordonnateur", "ordonneur", "ordonateur"]
CODE_WORD = "code"
CODE_COMPANIONS = ["ord", "etabl", "agence"]

# Public holidays of the calendar check.
HOLIDAYS = [
    "2024-01-01",
    "2024-01-11",
    "2024-05-01",
    "2024-07-30",
    "2024-08-14",
    "2024-08-20",
    "2024-08-21",
    "2024-11-06",
    "2024-11-18",
]

# Limits of the horizon rule and of the naive rule.
MIN_MONTHS = 3
MAX_MONTHS = 24
ACTIVE_PER_MONTH = 3
SPARSE_PERCENT = 20
MIN_LEDGER_ROWS = 6
NAIVE_MONTHS = 6
SEASON = 12
MIN_SEASONAL_MONTHS = 24
SEASONAL_SHARE_CLASSIC = 0.10
SEASONAL_SHARE_SERVICE = 0.20
STATIONARY_P = 0.05
MARGIN_POINTS = 2.0
MARGIN_SHARE = 0.10
SIGMA_MEDIUM = 2.0
SIGMA_HIGH = 3.0
LOOK_BACK = 12
HOLD_OUT = 12
FINAL_MONTHS = 18
Z95 = 1.959963984540054
