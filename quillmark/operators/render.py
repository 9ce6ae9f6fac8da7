"""Texts made from records: versions, justifications, clauses, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import truthy

# Wording of the tender clause.
CONFORMITY = "Standard Conformity: The supplied materials/equipment shall strictly conform to {latest} ('{title}'), including all up-to-date amendments issued by the Bureau of Indian Standards (BIS)."
SCHEMES = {
    "CRS": "Mandatory Compulsory Registration (CRS): The product ('{product}') must be registered under the BIS Compulsory Registration Scheme (CRS) pursuant to Scheme-II of BIS (Conformity Assessment) Regulations, 2018. Bidders must furnish a valid BIS Registration number (R-number) and affix the standard words 'Self Declaration - Conforming to {number}' on packaging. Unregistered products shall be summarily rejected.",
    "HALLMARKING": "Mandatory BIS Hallmarking: All articles ('{product}') must bear mandatory BIS Hallmarking with a 6-digit alphanumeric Hallmarking Unique Identification (HUID) and fineness grade in accordance with the Bureau of Indian Standards (Hallmarking) Regulations. Bids offering non-hallmarked articles shall be rejected.",
    "ISI": "Mandatory Certification ({label}): The product must bear the valid Standard ISI Mark under Scheme-I of BIS (Conformity Assessment) Regulations, 2018, as mandated by the applicable Gazette Quality Control Order (QCO). Bidders must hold an active CM/L BIS license on bid submission date. Uncertified bids shall be summarily rejected.",
}
ROLE_CLAUSES = (
    ("Test method", 4, "Acceptance & Routine Testing: Acceptance testing, lot sampling, and routine quality verification at vendor premises shall strictly comply with test procedures prescribed in {list}."),
    ("Safety", 3, "Operational Safety & Environmental Protection: Equipment design, insulation barriers, and operational safety mechanisms shall strictly adhere to {list}."),
    ("Installation", 3, "Installation & Code of Practice: Field erection, mounting, laying, earthing, and commissioning practices shall strictly follow {list}."),
    ("Related product", 3, "Normative Raw Materials & Feedstocks: Sub-components, conductors, and raw materials used in manufacture shall conform to {list}."),
    ("Terminology", 3, "Terminology & Standards Nomenclature: Technical definitions, ratings, and engineering nomenclature shall be interpreted in accordance with {list}."),
)
DEFAULT_LABEL = "BIS Product Certification (ISI mark)"
# Wording of justifications.
SCOPE_COVERS = {"production": "The scope of this standard covers {list} as described in the specification.", "hybrid": "Scope covers {list} as described in the specification."}
NO_OVERLAP = {"production": "This standard was retrieved as semantically closest to the specification; review its scope before citing.", "hybrid": "Closest semantic match; review the scope before citing."}
CATALOGUE_MATCH = "National catalogue match from BIS {department} ({aspect}). Verified active standard in published Indian Standards catalogue."


def fill(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by a column."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest) if any("{" + k + "}" in rest for k in values) else None
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), values[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def version_string(key: Column, year: Column, amendments: Column, style: str = "production") -> Column:
    """Key, year and the last amendment of the list; the offline style always writes the colon."""
    last = F.try_element_at(amendments, F.lit(-1))
    word = {"production": " (Amendment ", "hybrid": " (Amdt ", "offline": " (Amdt "}[style]
    dated = F.coalesce(F.concat(F.lit(", "), truthy(last["date"])), F.lit("")) if style != "offline" else F.lit("")
    years = year.cast("string")
    base = F.concat(key, F.lit(":"), F.coalesce(years, F.lit(""))) if style == "offline" else F.concat(key, F.coalesce(F.concat(F.lit(":"), years), F.lit("")))
    return F.concat(base, F.when(F.size(amendments) > 0, F.concat(F.lit(word), F.coalesce(last["number"], F.lit("None")), dated, F.lit(")"))).otherwise(""))


def shared_terms(query: Column, title: Column, scope: Column, most: int = 4) -> Column:
    """Query terms of four letters or more that occur in title or scope, alphabetical, at most ``most``."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(scope, F.lit(""))))
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z]{4,}"), F.lit(0))))
    return F.slice(F.filter(terms, lambda t: F.contains(text, t)), 1, most)


def justify(query: Column, title: Column, scope: Column, tier: Column | None = None, department: Column | None = None, aspect: Column | None = None) -> Column:
    """Why a record was returned; with ``tier`` catalogue records name their department instead."""
    style = "production" if tier is None else "hybrid"
    terms = shared_terms(query, title, scope)
    own = F.when(F.size(terms) > 0, fill(SCOPE_COVERS[style], list=F.array_join(terms, ", "))).otherwise(NO_OVERLAP[style])
    if tier is None:
        return own
    found = fill(CATALOGUE_MATCH, department=F.coalesce(truthy(department), F.lit("BIS")), aspect=F.coalesce(truthy(aspect), F.lit("Standard")))
    return F.when((tier == "enriched") & truthy(scope).isNotNull(), own).otherwise(found)


def tender_clause(number: Column, latest: Column, title: Column, certification: Column, allied: Column) -> Column:
    """Numbered clauses: conformity, certification by scheme, then allied standards by role.

    ``certification``: struct of scheme, scheme_label, mandatory and product or
    null; ``allied``: map from role label to numbers, or null.
    """
    scheme = F.upper(F.trim(F.coalesce(truthy(certification["scheme"]), F.lit("ISI"))))
    product = F.coalesce(truthy(certification["product"]), F.lit("this item"))
    label = F.coalesce(truthy(certification["scheme_label"]), F.lit(DEFAULT_LABEL))
    texts = {k: fill(t, product=product, number=number, label=label) for k, t in SCHEMES.items()}
    certified = F.coalesce(certification["mandatory"], F.lit(False)) | truthy(certification["scheme"]).isNotNull()
    scheme_text = F.when(scheme == "CRS", texts["CRS"]).when(scheme == "HALLMARKING", texts["HALLMARKING"]).otherwise(texts["ISI"])
    clauses = [fill(CONFORMITY, latest=F.coalesce(truthy(latest), number), title=F.coalesce(title, F.lit(""))), F.when(certified, scheme_text)]
    for role, most, template in ROLE_CLAUSES:
        members = F.try_element_at(allied, F.lit(role))
        clauses.append(F.when(F.size(members) > 0, fill(template, list=F.array_join(F.slice(members, 1, most), ", "))))
    kept = F.array_compact(F.array(*clauses))
    return F.array_join(F.transform(kept, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n\n")


# Wording of the older clause, and the roles it lists with how many members each.
SHORT_MARK = "2. Mandatory Certification: The product must bear the valid {mark} mark as mandated by the appropriate Quality Control Order (QCO) published in the Gazette of India. Uncertified bids shall be summarily rejected."
SHORT_ROLES = (
    ("Test method", 4, "3. Acceptance & Routine Tests: Acceptance testing at vendor works shall strictly follow testing procedures prescribed in {list}."),
    ("Related product", 3, "4. Normative Raw Materials: Raw materials and components shall satisfy {list}."),
)


def short_clause(number: Column, latest: Column, title: Column, certification: Column, allied: Column) -> Column:
    """The older clause of four fixed items."""
    mark = F.coalesce(truthy(certification["scheme_label"]), truthy(certification["scheme"]), F.lit("ISI"))
    certified = F.coalesce(certification["mandatory"], F.lit(False)) | truthy(certification["scheme"]).isNotNull()
    parts = [
        F.concat(F.lit("1. "), fill(CONFORMITY, latest=F.coalesce(truthy(latest), number), title=F.coalesce(title, F.lit("")))),
        F.when(certified, fill(SHORT_MARK, mark=mark)),
    ]
    for role, most, template in SHORT_ROLES:
        members = F.try_element_at(allied, F.lit(role))
        parts.append(F.when(F.size(members) > 0, fill(template, list=F.array_join(F.slice(members, 1, most), ", "))))
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def certification_view(certification: Column) -> Column:
    """The certification with mandatory true where absent; null where there is none."""
    return F.when(certification.isNotNull(), certification.withField("mandatory", F.coalesce(certification["mandatory"], F.lit(True))))


def grounded(claims: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Claims (query_id, is_number, ...) about standards that the query did retrieve."""
    return claims.join(retrieved.select("query_id", "is_number").distinct(), ["query_id", "is_number"], "left_semi")


def parse_answer(raw: Column) -> Column:
    """array<struct<is_number, justification>> of a model's JSON answer, code fences removed; null if it can't be read."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?|```$", ""))
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    kind = "struct<justifications:array<struct<is_number:string,justification:string>>>"
    return F.from_json(body, kind)["justifications"]


def json_record(records: DataFrame, fields: tuple[str, ...]) -> Column:
    """A record as JSON with its ``fields`` in order; nulls are kept."""
    return F.to_json(F.struct(*(records[f] for f in fields)), {"ignoreNullFields": "false"})


def markdown_report(records: DataFrame) -> DataFrame:
    """(query_id, report): a Markdown section per record (position, is_number, title, confidence, justification)."""
    section = F.format_string("## %d. %s\n\n**%s** (confidence %.3f)\n\n%s\n", "position", "is_number", "title", "confidence", "justification")
    ordered = F.array_sort(F.collect_list(F.struct("position", section.alias("s"))))
    return records.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n").alias("report"))
