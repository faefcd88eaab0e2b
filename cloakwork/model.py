"""The data model: entity types, schemas of spans and matches, label maps of recorded model outputs."""

from __future__ import annotations

# Fixed values.
ENTITY_TYPES = [
    "PERSON", "ORGANIZATION", "EMAIL_ADDRESS", "IPV4_ADDRESS", "IPV6_ADDRESS", "IPV4_CIDR", "IPV6_CIDR", "HOSTNAME", "DOMAIN",
    "USERNAME", "CREDENTIAL", "TOKEN", "HASH", "UUID", "AWS_ACCESS_KEY", "JWT", "PHONE", "MAC_ADDRESS", "URL", "PATH",
    "IDENTIFIER", "ADDRESS", "CREDIT_CARD", "DATE_OF_BIRTH", "IBAN", "NATIONAL_ID", "OTHER",
]
#: Types whose trailing punctuation may be part of the value.
KEEP_TAIL = ["CREDENTIAL", "TOKEN", "PATH", "IDENTIFIER", "OTHER"]
#: Types that never get a realistic substitute.
ALWAYS_OPAQUE = ["CREDENTIAL", "TOKEN", "HASH", "JWT", "AWS_ACCESS_KEY", "PATH", "IDENTIFIER", "OTHER"]
#: Detectors in order of priority.
DETECTORS = ["regex", "denylist", "privacy_filter", "gliner_pii", "llm"]

# Labels of recorded models.
SPAN_LABELS = {
    "private_person": "PERSON",
    "private_email": "EMAIL_ADDRESS",
    "private_phone": "PHONE",
    "private_url": "URL",
    "private_address": "ADDRESS",
    "private_date": "DATE_OF_BIRTH",
    "account_number": "IDENTIFIER",
    "secret": "CREDENTIAL",
}
ZERO_SHOT_LABELS = {
    "person": "PERSON",
    "organization": "ORGANIZATION",
    "email": "EMAIL_ADDRESS",
    "email_address": "EMAIL_ADDRESS",
    "phone": "PHONE",
    "phone_number": "PHONE",
    "address": "ADDRESS",
    "date_of_birth": "DATE_OF_BIRTH",
    "credit_card": "CREDIT_CARD",
    "credit_card_number": "CREDIT_CARD",
    "iban": "IBAN",
    "ssn": "NATIONAL_ID",
    "national_id": "NATIONAL_ID",
    "account_number": "IDENTIFIER",
    "passport_number": "IDENTIFIER",
    "medical_record_number": "IDENTIFIER",
    "ip_address": "IPV4_ADDRESS",
    "url": "URL",
    "username": "USERNAME",
}
# Merging of spans, the break between texts, limits.
#: How far apart two spans of a type may stand to be one entity, and the characters that may stand between them.
MERGE_GAPS = {"PERSON": 3, "ADDRESS": 3, "DATE_OF_BIRTH": 3, "URL": 2, "PHONE": 2, "CREDENTIAL": 2, "IDENTIFIER": 1, "EMAIL_ADDRESS": 0}
MERGE_GAP_OTHERWISE = 1
MERGE_CHARACTERS = {"ADDRESS": " \t\n\r,"}
MERGE_CHARACTERS_OTHERWISE = " \t\n\r"
SENTINEL = "ANONYMIZER-SEGMENT-BREAK"
MOST_LLM_CHARS = 200_000
MOST_BODY_BYTES = 10 << 20

CANDIDATE = "struct<start:int,end:int,value:string,entity_type:string,ord:int>"
CANDIDATES = f"array<{CANDIDATE}>"
MATCHES = "array<struct<text:string,entity_type:string>>"
ATTRIBUTED = "array<struct<text:string,entity_type:string,source_detectors:array<string>>>"
OVERRIDES = (
    "struct<use_faker:boolean,faker_locale:array<string>,detector_mode:array<string>,regex_overlap_strategy:string,regex_patterns:string,"
    "llm_model:string,llm_prompt:string,denylist:string,gliner_labels:array<string>,gliner_threshold:double>"
)
REQUESTS = f"call_id string, input_type string, texts array<string>, is_final boolean, overrides {OVERRIDES}"
