"""Queries in Indic scripts brought to English terms, technical tokens untouched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, detect_query_language

# The procurement glossary, applied in this order.
GLOSSARY = {
    "केबल": "cable", "केबल्स": "cables", "तार": "wire", "कंडक्टर": "conductor", "तांबा": "copper", "तांबे": "copper", "तांब्याचे": "copper",
    "एल्युमिनियम": "aluminium", "ॲल्युमिनियम": "aluminium", "बख्तरबंद": "armoured", "आर्मर्ड": "armoured", "कवच": "armour",
    "भूमिगत": "underground", "जमिनीखालील": "underground", "इन्सुलेटेड": "insulated", "इन्सुलेशन": "insulation", "रोधन": "insulation", "रोधी": "insulation",
    "ट्रांसफार्मर": "transformer", "ट्रान्सफॉर्मर": "transformer", "बिजली": "power", "विद्युत": "electric", "वितरण": "distribution", "तेल": "oil", "इमर्स्ड": "immersed",
    "सीमेंट": "cement", "सिमेंट": "cement", "कंक्रीट": "concrete", "फाउंडेशन": "foundation", "पाया": "foundation", "बांधकाम": "construction", "निर्माण": "construction",
    "स्टील": "steel", "लोखंड": "steel", "छड़": "bars", "सळया": "bars",
    "पाइप": "pipes", "पाईप": "pipes", "प्लास्टिक": "plastic", "सौर": "solar", "बैटरी": "battery", "बॅटरी": "battery",
    "सुरक्षा": "safety", "परीक्षण": "testing", "चाचणी": "testing", "मानक": "standard", "विशिष्टता": "specification", "आवश्यकता": "requirements", "तीन": "three", "फेज": "phase",
}
# Fixed value: tokens that are kept as they are.
TECHNICAL = r"(?iU)\b(?:IS\s*:?\s*\d+(?:-\d+)?(?::\d{4})?|\d+(?:\.\d+)?\s*(?:kV|kVA|MVA|kW|MW|V|A|Hz|mm2|sqmm|mm|cm|m|HP)\b|\d+\s*core|Fe\s*\d+|XLPE|PVC|FRLS|TMT|OPC|PPC|LED|ACSR)\b"
INDIC = r"[ऀ-ൿ]+"


def translate_terms(text: Column) -> Column:
    """Glossary words replaced in order, what remains of Indic scripts blanked."""
    for word, english in GLOSSARY.items():
        text = F.replace(text, F.lit(word), F.lit(english))
    return F.regexp_replace(text, INDIC, " ")


def normalize_query(query: Column) -> Column:
    """struct of normalized, language and original.

    English queries are only trimmed.  Otherwise the text between technical
    tokens is translated; if nothing is left the trimmed query stands.  Null
    and blank queries come back empty.
    """
    trimmed = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", ""))
    language = detect_query_language(trimmed)
    tokens = F.regexp_extract_all(trimmed, F.lit(TECHNICAL), F.lit(0))
    pieces = F.zip_with(F.split(trimmed, TECHNICAL, -1), tokens, lambda s, t: F.concat(translate_terms(s), F.coalesce(t, F.lit(""))))
    english = collapse(F.array_join(pieces, ""))
    normalized = F.when(language == "en-IN", trimmed).otherwise(F.when(english == "", trimmed).otherwise(english))
    return F.struct(normalized.alias("normalized"), language.alias("language"), trimmed.alias("original"))
