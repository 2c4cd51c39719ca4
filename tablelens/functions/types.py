"""Semantic column types and the groups every analysis step keys on."""

NUMERIC = "NUMERIC"
CATEGORICAL = "CATEGORICAL"
DATETIME = "DATETIME"
TEXT = "TEXT"
BOOLEAN = "BOOLEAN"
ID = "ID"
CURRENCY = "CURRENCY"
PERCENTAGE = "PERCENTAGE"
UNKNOWN = "UNKNOWN"

NUMERIC_GROUP = (NUMERIC, CURRENCY, PERCENTAGE)
CATEGORICAL_GROUP = (CATEGORICAL, BOOLEAN)


def numeric_cols(types: dict) -> list:
    return [c for c, t in types.items() if t in NUMERIC_GROUP]


def categorical_cols(types: dict) -> list:
    return [c for c, t in types.items() if t in CATEGORICAL_GROUP]


def datetime_cols(types: dict) -> list:
    return [c for c, t in types.items() if t == DATETIME]


def text_cols(types: dict) -> list:
    return [c for c, t in types.items() if t == TEXT]
