"""Output schema of document properties, and the messages that ask for them."""

from __future__ import annotations

import json
from typing import Any

from millrace.functions.schemas import inline_definitions
from millrace.functions.scalar import TRUNCATED

# Document properties and what each may be. Where several may hold, the property is an array.
ONE_OF = {
    "content_integrity": ["complete", "mostly_complete", "fragment", "severely_degraded"],
    "content_ratio": ["complete_content", "mostly_content", "mixed_content", "mostly_navigation", "minimal_content"],
    "content_length": ["substantial", "moderate", "brief", "minimal"],
    "content_quality": ["excellent", "good", "adequate", "poor", "unacceptable"],
    "information_density": ["dense", "adequate", "moderate", "thin", "empty"],
    "educational_value": ["high", "moderate", "basic", "minimal", "none"],
    "reasoning_indicators": ["analytical", "explanatory", "basic_reasoning", "minimal", "none"],
    "audience_level": ["expert", "advanced", "general", "beginner", "youth", "children"],
    "commercial_bias": ["none", "minimal", "moderate", "heavy", "pure_marketing"],
    "time_sensitivity": ["evergreen", "slowly_changing", "regularly_updating", "time_sensitive"],
    "content_safety": ["safe", "mild_concerns", "nsfw", "harmful", "illegal"],
    "pii_presence": ["no_pii", "contains_pii"],
}
ANY_OF = {
    "content_type": ["analytical", "instructional", "reference", "procedural", "qa_structured", "conversational", "creative", "transactional", "boilerplate", "news_report", "opinion_editorial", "review_critique", "technical_documentation", "specification_standard", "legal_document", "press_release", "structured_data", "source_code"],
    "business_sector": ["academic_research", "education_sector", "technology_software", "hardware_electronics", "healthcare_medical", "pharmaceutical_biotech", "financial_services", "legal_services", "government_public", "manufacturing_industrial", "mining_resources", "chemicals_materials", "energy_utilities", "retail_commerce", "wholesale_distribution", "real_estate_construction", "transportation_logistics", "travel_aviation", "automotive_industry", "telecommunications", "media_entertainment", "gaming_industry", "gambling_betting", "advertising_marketing", "hospitality_tourism", "food_beverage_hospitality", "agriculture_food", "environmental_services", "aerospace_defense", "insurance_industry", "nonprofit_ngo", "consulting_professional", "human_resources", "security_cyber", "consumer_goods", "general_interest", "other"],
    "technical_content": ["code_heavy", "math_heavy", "scientific", "data_heavy", "engineering", "basic_technical", "non_technical"],
    "regional_relevance": ["european", "north_american", "east_asian", "south_asian", "southeast_asian", "middle_eastern", "sub_saharan_african", "latin_american", "oceanian", "central_asian", "russian_sphere", "global", "culturally_neutral", "indeterminate"],
}
#: Besides names of countries.
COUNTRY_VALUES = ["supranational", "none"]
ORDER = ["content_integrity", "content_ratio", "content_length", "one_sentence_description", "content_type", "business_sector", "technical_content", "content_quality", "information_density", "educational_value", "reasoning_indicators", "audience_level", "commercial_bias", "time_sensitivity", "content_safety", "pii_presence", "regional_relevance", "country_relevance"]


def property_schema(countries: list[str] | None = None, compact: bool = True, flat: bool = True) -> dict[str, Any]:
    """JSON Schema of all properties. Countries are an enumeration if given, else told in the description."""
    several = {name: {"enum": values, "type": "string"} for name, values in ANY_OF.items()}
    several["country_relevance"] = {"type": "string", **({"enum": [*countries, *COUNTRY_VALUES]} if countries else {})}

    def one(name: str) -> dict[str, Any]:
        if name == "one_sentence_description":
            return {"type": "string"}
        if name in ONE_OF:
            return {"type": "string", "enum": ONE_OF[name]}
        told = {} if countries or name != "country_relevance" else {"description": f"Valid values: names of countries, {', '.join(COUNTRY_VALUES)}"}
        return {"type": "array", "minItems": 1, "items": {"$ref": f"#/$defs/{name}"}, **told}

    schema = {"type": "object", "properties": {n: one(n) for n in ORDER}, "required": list(ORDER), "additionalProperties": False, "x-guidance": {"whitespace_flexible": not compact}, "$defs": several}
    return inline_definitions(schema) if flat else schema


def property_schema_text(small: bool = True, **options: Any) -> str:
    """The schema as JSON text, on one line if small."""
    schema = property_schema(**options)
    return json.dumps(schema, separators=(",", ":")) if small else json.dumps(schema, indent=2)


def property_messages(text: str, guidelines: str, most_chars: int = 50_000) -> list[dict[str, str]]:
    """System message of the guidelines and user message of the (truncated) document between marks."""
    cut = text[:most_chars] + TRUNCATED if 0 < most_chars < len(text) else text
    return [{"role": "system", "content": guidelines}, {"role": "user", "content": f"<start_of_document>\n{cut}\n<end_of_document>"}]
