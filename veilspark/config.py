"""Identifier types and engine settings. Everything here is read on the driver and ends up as literals."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class PiiType:
    name: str
    regex: tuple[str, ...] = ()
    validator: str | None = None
    context_words: tuple[str, ...] = ()
    requires_context: bool = False
    context_scope: int | str = 60  # characters around the span, or "page" or "doc"
    structured: bool = False
    min_chars: int = 0
    generic_words: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    single_token_needs_context: bool = False
    ner_labels: tuple[str, ...] = ()
    policy: str = "redact"
    hint: str = ""  # what a language model is told of the type
    enabled: bool = True


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# The patterns, context words and role words that results depend on.
TYPES: tuple[PiiType, ...] = (
    PiiType(
        "PERSON", min_chars=4, ner_labels=("person name", "full name"),
        context_words=("mr", "mrs", "ms", "smt", "shri", "dr", "name", "contact person", "director", "father"),
        generic_words=_words(
            "mr mrs ms dr smt shri kum the our of and director directors chairman managing joint executive independent whole-time secretary officer person"
            " contact promoter promoters name company member members trustee trustees partner partners auditor auditors chief financial ceo cfo cs compliance"
            " key managerial personnel senior management technical registrar bidder shareholder shareholders investor investors bidders allottee allottees"
            " applicant applicants"
        ),
    ),
    PiiType("EMAIL", (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",), structured=True, ner_labels=("email address",)),
    PiiType(
        "PHONE", (r"(?:\+\s?\d{1,3}[\s-]?)?(?:\(?\d{2,5}\)?[\s-]?)?\d{3,5}[\s-]?\d{3,5}(?:[\s-]?\d{2,4})?",), "phone", structured=True,
        ner_labels=("phone number", "telephone number"), context_words=("tel", "telephone", "phone", "mobile", "fax", "contact"),
        generic_words=("tel", "telephone", "phone", "mobile", "fax", "contact", "number", "no"),
    ),
    PiiType(
        "ORG", min_chars=4, single_token_needs_context=True, ner_labels=("organization", "company name"),
        context_words=("limited", "ltd", "llp", "private", "trust", "bank", "corporation", "inc", "counsel", "advocates", "solicitors", "associates", "consultants"),
        generic_words=_words(
            "our the of and to in for a an company companies prospectus red herring draft investor investors anchor registrar shareholder shareholders"
            " promoter promoters selling exchange exchanges stock manager managers lead running book director directors board officer officers secretary"
            " compliance offer issue portion bank bank's banks banker bankers sponsor escrow collection refund public account syndicate member members life"
            " insurance pension fund funds mutual central processing centre center self certified regional house venture qualified institutional buyer buyers"
            " retail individual non designated intermediaries depository participant participants registered broker brokers agent agents transfer share group"
            " entities entity trusts management key managerial personnel senior statutory auditor auditors independent chartered engineer monitoring agency"
            " legal counsel underwriter underwriters government state ministry department income tax authority income-tax govt office unit facility equity"
            " shares capital fresh sale price band lot bid bids application form forms"
        ),
        allowlist=(
            "SEBI", "Securities and Exchange Board of India", "BSE", "NSE", "National Stock Exchange", "RBI", "Reserve Bank of India", "Registrar of Companies",
            "RoC", "Companies Act", "SEBI ICDR Regulations", "Income Tax Department", "Government of India", "NSDL", "CDSL", "NPCI", "Ministry of", "Department of",
        ),
    ),
    PiiType("ADDRESS", min_chars=4, ner_labels=("street address", "postal address"), context_words=("office", "address", "road", "marg", "plot", "gat", "village", "taluka", "pune", "mumbai", "floor")),
    PiiType("DOB", (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",), structured=True, requires_context=True, ner_labels=("date of birth",), context_words=("date of birth", "dob", "born", "birth")),
    PiiType("SSN", (r"\b\d{3}-\d{2}-\d{4}\b",), "ssn", structured=True),
    PiiType("CREDIT_CARD", (r"\b(?:\d[ -]?){13,19}\b",), "luhn", structured=True),
    PiiType("IP", (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"), "ip", structured=True),
    PiiType("PAN", (r"\b[A-Z]{5}\s?[0-9]{4}\s?[A-Z]\b",), "pan", structured=True, ner_labels=("permanent account number",), context_words=("pan", "permanent account")),
    PiiType("AADHAAR", (r"\b\d{4}\s?\d{4}\s?\d{4}\b",), "verhoeff", structured=True),
    PiiType("DIN", (r"\b\d{7}\s?\d\b|\b\d\s?\d{7}\b|\b\d{8}\b",), "din", structured=True, requires_context=True, context_scope="doc", context_words=("din", "director identification")),
    PiiType("GSTIN", (r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",), structured=True),
    PiiType("IFSC", (r"\b[A-Z]{4}0[A-Z0-9]{6}\b",), structured=True),
)

# The address finder's anchors.
PIN_REGEX = r"\b[1-9]\d{2}\s?\d{3}\b"
ADDRESS_END_WORDS = ("India", "Maharashtra", "Gujarat", "Karnataka", "Delhi", "Madhya Pradesh", "Tamil Nadu")
ADDRESS_KEYWORDS = (
    "Road", "Marg", "Street", "Floor", "Plot", "Gat", "Flat", "Unit", "No.", "Building", "Tower", "Wing", "Block", "Village", "Taluka", "Nagar", "Colony", "Society",
    "Park", "Complex", "Centre", "Center", "Chambers", "House", "Apartment", "Bunglow", "Bungalow", "Lane", "Chowk", "Near", "Opp.", "Behind", "Sector", "Phase",
    "Area", "Estate", "District", "Dist.", "Off", "Industrial", "Campus", "Residency",
)
ADDRESS_STARTS = (":", ";", "at", "situated at", "located at")
ADDRESS_MAX_LEN = 260

# Titles before names (when searching, when clustering) and legal-form words.
SEARCH_HONORIFICS = ("mr", "mrs", "ms", "miss", "mx", "smt", "shri", "sh", "dr", "prof", "kumari", "master")
CLUSTER_HONORIFICS = ("mr", "mrs", "ms", "smt", "shri", "dr", "kum")
ORG_FORMS = (
    "family", "trust", "limited", "ltd", "private", "pvt", "llp", "inc", "company", "co", "group", "holdings", "industries", "international", "enterprises",
    "corporation", "corp", "foundation", "bank", "and", "&", "sons", "brothers", "associates", "partners", "ventures",
)
#: Names that are also everyday words: a lone one counts only next to other evidence. A short list of this
#: library's own; ``Settings.common_words`` takes any other, of any length (``words_in`` reads one).
COMMON_NAME_WORDS = ("broad", "everest", "may", "rose", "will", "mark", "grace", "hope", "young", "long", "short", "best", "rich", "wise", "park", "hill", "stone", "summer", "winter", "sun")
FINDER_RANK = {"regex": 0, "gliner": 1, "llm": 2, "propagate": 3}
#: Validators that see the candidate without white space.
SPACE_TOLERANT = ("PAN", "AADHAAR", "CREDIT_CARD", "PHONE", "DIN")
#: Types whose surrogate is refitted to each mention's punctuation.
SHAPE_TYPES = ("PHONE", "PAN", "AADHAAR", "CREDIT_CARD", "DIN", "SSN", "GSTIN", "IFSC")
ID_PREFIX = {"PERSON": "P", "ADDRESS": "ADDR"}


def words_in(path: str) -> tuple[str, ...]:
    """The words of a text file, lower-cased."""
    with open(path, encoding="utf-8") as f:
        return tuple(dict.fromkeys(f.read().lower().split()))


@dataclass(frozen=True)
class Settings:
    types: tuple[PiiType, ...] = TYPES
    drop_below: float = 0.5
    review_below: float = 0.7
    min_text_density: float = 0.0005
    max_single_letter_ratio: float = 0.15
    max_image_area_ratio: float = 0.10
    easy_page_sample: float = 0.10
    ner_threshold: float = 0.4
    salt: str = field(default_factory=lambda: os.environ.get("PII_SALT", ""))  # secret: whoever knows it can guess back
    legend: str = "none"  # none, surrogates or full
    paragraphs_per_page: int = 50
    #: Give entities without a letter or digit that keys keep a surrogate all the same.
    redact_empty_keys: bool = True
    common_words: tuple[str, ...] = COMMON_NAME_WORDS

    def enabled(self) -> list[PiiType]:
        return [t for t in self.types if t.enabled]

    def type(self, name: str) -> PiiType:
        return next(t for t in self.types if t.name == name)

    def with_type(self, name: str, **changes) -> Settings:
        return replace(self, types=tuple(replace(t, **changes) if t.name == name else t for t in self.types))
