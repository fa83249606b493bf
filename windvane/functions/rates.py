"""Rates of a confusion table, as SQL over columns tn, fp, fn, tp; a zero denominator gives 0."""

from __future__ import annotations


def ratio(numerator: str, denominator: str) -> str:
    return f"CASE WHEN {denominator} > 0 THEN double({numerator}) / ({denominator}) ELSE 0D END"


RECALL = ratio("tp", "tp + fn")
SPECIFICITY = ratio("tn", "tn + fp")

HEADLINE = {
    "precision": ratio("tp", "tp + fp"),
    "recall": RECALL,
    "f1": ratio("2 * tp", "2 * tp + fp + fn"),
    # Mean recall over the classes that occur in the labels.
    "balanced_accuracy": f"CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN ({RECALL} + {SPECIFICITY}) / 2D"
    f" WHEN tp + fn > 0 THEN {RECALL} WHEN tn + fp > 0 THEN {SPECIFICITY} END",
    "accuracy": ratio("tp + tn", "tp + tn + fp + fn"),
    "prevalence": ratio("tp + fn", "tp + tn + fp + fn"),
}

CONFUSION = {
    "specificity": SPECIFICITY,
    "negative_predictive_value": ratio("tn", "tn + fn"),
    "false_positive_rate": ratio("fp", "fp + tn"),
    "false_negative_rate": ratio("fn", "fn + tp"),
    "support_negative": "tn + fp",
    "support_positive": "tp + fn",
}


def aliased(rates: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in rates.items()]
