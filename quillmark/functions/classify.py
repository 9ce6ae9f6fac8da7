"""Roles of cited standards and certification schemes, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first rule that matches a title names the role.
TITLE_RULES = (
    ("test_method", r"\b(methods?\s+of\s+test|test\s+methods?|methods?\s+for\s+testing|determination\s+of|measurement\s+of)\b"),
    ("sampling", r"\b(methods?\s+of\s+sampling|sampling\s+(?:plan|procedure)|inspection\s+by\s+attributes)\b"),
    ("terminology", r"\b(glossary\s+of\s+terms|terminology|definitions|terms\s+and\s+definitions|nomenclature)\b"),
    ("installation", r"\b(code\s+of\s+practice|installation|erection|laying\s+of|selection.{0,20}installation|maintenance\s+of)\b"),
    ("safety", r"\b(safety\s+(?:requirements?|code|rules)|protection\s+against|hazard|fire\s+resistance|electrical\s+safety)\b"),
    ("dimensions", r"\b(dimensions?|tolerances?|preferred\s+(?:sizes|numbers)|designation\s+system)\b"),
)
# Rules on the citing sentence, used where the title says nothing.
CONTEXT_RULES = (
    ("test_method", r"\b(shall\s+be\s+tested|tested\s+in\s+accordance|type\s+test|routine\s+test)\b"),
    ("sampling", r"\b(sampl\w+|lot\s+acceptance)\b"),
    ("safety", r"\b(safety|hazard|protective)\b"),
    ("installation", r"\b(install\w+|erect\w+|commission\w+)\b"),
)
DEFAULT_ROLE = "related_product"
# Labels of the roles.
ROLE_LABELS = {
    "test_method": "Test method",
    "terminology": "Terminology",
    "safety": "Safety",
    "installation": "Installation",
    "sampling": "Sampling",
    "dimensions": "Dimensions",
    "related_product": "Related product",
}


def classify_reference(title: Column, context: Column | None = None) -> Column:
    """Role of a cited standard: title rules first, then context rules."""
    tests = [(title, r) for r in TITLE_RULES] + ([(context, r) for r in CONTEXT_RULES] if context is not None else [])
    hits = [F.when(text.rlike("(?i)" + pattern), role) for text, (role, pattern) in tests]
    return F.coalesce(*hits, F.lit(DEFAULT_ROLE))


def role_label(role: Column, default: str = "Related product") -> Column:
    labels = F.create_map(*(F.lit(x) for pair in ROLE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, role), F.lit(default))


def scheme_of_notification(text: Column) -> Column:
    """Certification scheme named by a notification: registration before hallmarking before the mark."""
    folded = F.lower(text)
    return F.when(folded.contains("compulsory registration"), "CRS").when(folded.contains("hallmark"), "Hallmarking").otherwise("BIS Product Certification (ISI)")
