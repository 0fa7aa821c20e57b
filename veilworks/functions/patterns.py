"""What the detectors look for. Patterns, word lists and names that results depend on.

Patterns are written for java.util.regex; FLAGS gives them Unicode classes and plain line ends.
Where DuckDB's RE2 needs another form, it stands beside as *_RE2.
"""

FLAGS = "(?Ud)"

# --- fixed values -----------------------------------------------------------------------------
US_STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|"
    "Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|"
    "New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|"
    "Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia"
)
STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
POSTAL_CODE = r"(?:\d{5}(?:-\d{4})?|[A-Z]\d[A-Z]\s?\d[A-Z]\d|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}|\d{3}-\d{4}|\d{4,6})"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
STREET_SUFFIXES = "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Way|Lane|Ln|Parkway|Pkwy|Circle|Cir|Court|Ct|Place|Pl|Plaza|Terrace|Ter|Trail|Trl|Highway|Hwy|Pike"

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<![A-Za-z0-9])(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
PHONE_RE2 = r"(?:^|[^A-Za-z0-9])((?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EIN = r"\b\d{2}-\d{7}\b"
AMOUNT = r"\$[\d,]+(?:\.\d{2})?\b"
ADDRESS = (
    r"\d+\s+[A-Za-z\s\.]+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Way|Lane|Ln)\.?[,\s]+(?:(?:Suite|Ste|Apt|Unit)\s+\d+[,\s]+)?"
    r"[A-Za-z\s]+,\s+(?:" + US_STATES + r"|[A-Z]{2})[,\s]+" + POSTAL_CODE
)
URL = r"(?:https?://)?(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[^\s,)]*)?(?<![.,)])"
URL_RE2 = r"(?:https?://)?(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/(?:[^\s,)]*[^\s,).])?)?"
BARE_AMOUNT = (
    r"(?i)(?:exceed|up to|maximum of|total of|aggregate of|limit of|not to exceed|in the amount of|principal amount of|sum of)\s+"
    r"([\d,]{4,}(?:\.\d{2})?)\s*(?:shares?|units?|dollars?|pounds?)?"
)
NAME = r"([A-Z][A-Za-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][A-Za-z]+)"
PERSON = {
    "h9a_label_line": r"(?m)(?:^|\n)\s*(?:Name|By|Signature|Attn):\s+" + NAME + r"\s*$",
    "h9b_defined_term": r"\b" + NAME + r"\s*\((?:the\s+)?[\"“]",
    "h9c_signature": r"(?:_{3,}|/s/)\s*\n?\s*" + NAME,
    "h9d_between": r"(?i)\b(?:between|among)\s+" + NAME + r"\s*[,;]",
    "h9e_role": r"(?i)\band\s+" + NAME + r"\s+as\s+[A-Z]",
}
DATE = {
    "h10a_month_first": r"\b(?:" + MONTHS + r")\s+\d{1,2},?\s+\d{4}\b",
    "h10b_numeric": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b",
    "h10c_day_first": r"\b\d{1,2}\s+(?:" + MONTHS + r")\s+\d{4}\b",
}
_CITY = r"((?:[A-Z][A-Za-z.']+\s+){0,3}[A-Z][A-Za-z.']+,\s*(?:" + US_STATES + "|" + STATE_CODES + r")(?:[,\s]+" + POSTAL_CODE + r")?)"
CITY_STATE = {"h11a_preposition": r"\b(?:in|at|of|from|to|near)\s+" + _CITY + r"\b", "h11b_own_line": r"(?m)^\s*" + _CITY + r"\s*$"}
STREET = r"(?i)\b(\d+\s+(?:[A-Za-z.']+ ){1,4}(?:" + STREET_SUFFIXES + r")\.?(?:[,\s]+(?:Suite|Ste|Apt|Unit|Floor|Fl)\s*#?\s*\d+)?)\b"

PERSON_STOP = [
    "New", "York", "North", "South", "East", "West", "United", "States", "Stock", "Market", "Trust", "Federal", "National", "District", "San", "Los",
    "Las", "Fort", "Santa", "Saint", "Monte", "Bank", "First", "Second", "Third", "Fourth", "Fifth", "Arbitration", "Association", "Commission",
    "Authority", "Regulatory", "Industry", "Securities", "Exchange", "Financial", "Advisory", "Administrative", "Judicial", "Municipal",
    "Congressional", "Agreement", "Consulting", "Services", "Transition", "License", "Purchase", "Employment", "Separation", "Amendment",
]
CORPORATE_SUFFIXES = [
    r"Pty\.?\s+Ltd\.?", r"Public\s+Benefit\s+Corporation", r"L\.L\.L\.P\.?", r"P\.L\.L\.C\.?", r"P\.L\.C\.?", r"L\.L\.C\.?", r"L\.L\.P\.?", r"L\.P\.?", r"P\.C\.?",
    r"S\.R\.L\.?", r"S\.p\.A\.?", r"S\.A\.?", r"G\.P\.?", r"N\.A\.?", r"B\.V\.?", r"K\.K\.?", r"G\.K\.?", "Corporation", "Company", "International", "Bank", "Trust",
    r"Inc\.?", "LLC", "LLLP", "LLP", "LP", r"Corp\.?", r"Ltd\.?", "Limited", "PLLC", "PLC", "PBC", "PC", r"Co\.?", "GP", "NA", "GmbH", "SAS", "SRL", "SpA", "BV", "SA",
    "FSB", "DST", r"Pty\.?", "Oyj", "Oy", "KGaA", "ASA", "AG", "AB", "SE", "NV", "Group", "Partners", "Associates", "Enterprises", "Holdings", "Foundation",
    "Technologies", "Solutions", "Services", "Systems",
]
SUFFIX = "|".join(CORPORATE_SUFFIXES)
COMPANY = rf"((?:[A-ZÀ-ɏ][A-Za-zÀ-ɏ&\-']+ )*(?:[A-ZÀ-ɏ][A-Za-zÀ-ɏ&\-']+),?\s*(?:{SUFFIX})\.?)"
DEFINED_TERM = rf"((?:[A-ZÀ-ɏ][A-Za-zÀ-ɏ&\-']+ )*(?:{SUFFIX})),?\s+\((?:the\s+)?[\"“]([^\"”]+)[\"”]\)"
DEAR = rf"Dear\s+((?:[A-ZÀ-ɏ][A-Za-zÀ-ɏ&\-']+ )*(?:{SUFFIX})),"
LABEL_AFTER = r"(?s)^.{0,500}?\((?:(?:hereinafter|hereafter)\s+)?(?:referred\s+to\s+as\s+)?(?:the\s+)?[\"“]([^\"”,]+)[,\"”]"
BARE_SUFFIX = rf"(?i),?\s*(?:{SUFFIX})\.?\s*$"
STRIP_SUFFIX = rf"(?i),?\s+(?:{SUFFIX})\s*$"
DETERMINER = r"(?i)^(?:The|This|That|These|Those|A|An)\s+"
AGREEMENT_TERMS = [
    "agreement", "contract", "plan", "schedule", "letter", "memorandum", "arrangement", "deed", "order", "addendum", "amendment", "supplement",
    "policy", "program", "handbook", "manual", "notice", "certificate", "indenture", "warrant", "lease", "sublease", "license", "note", "bond",
    "protocol",
]
LEGAL_ABBREVIATIONS = [
    "DTSA", "CFAA", "FCPA", "SOX", "HIPAA", "FERPA", "COPPA", "GDPR", "CCPA", "TCPA", "CAN-SPAM", "RICO", "ERISA", "FLSA", "FMLA", "ADA", "OSHA",
    "EPA", "SEC", "FTC", "DOJ", "FBI", "IRS", "EEOC", "NLRB", "FINRA", "CFTC", "OCC", "FDIC", "AAA",
]
DEFAULT_ROLES = ["Company", "Counterparty"]
NER_LABELS = {"person": "PERSON", "organization": "COMPANY", "address": "ADDRESS"}
NER_THRESHOLDS = {"person": 0.45, "organization": 0.5, "address": 0.5}
NER_PERSON_BLOCK = [
    "you", "i", "he", "she", "we", "they", "me", "him", "her", "us", "them", "it", "my", "your", "his", "our", "their", "attorney", "arbitrator",
    "party", "parties", "counsel", "judge", "plaintiff", "defendant", "claimant", "respondent", "witness", "executor", "trustee", "beneficiary",
    "agent", "representative", "consultant", "contractor", "employee", "employer", "client", "vendor", "receiving party", "disclosing party",
    "prevailing party", "indemnifying party", "indemnified party", "injured party", "the parties", "the company", "the contractor", "the consultant",
    "the employee", "the employer", "the client", "the vendor", "single arbitrator", "independent contractor",
]
NER_DETERMINER = r"(?i)^(?:the|a|an|any|any\s+other|each|no|such)\s+"
STATUTE_WORDS = [
    "act", "code", "rule", "statute", "law", "regulation", "amendment", "order", "ordinance", "convention",
]
SUFFIX_WORDS = [
    "inc", "llc", "llp", "lp", "ltd", "corp", "co", "plc", "pbc", "gmbh", "ag", "sa", "bv", "nv", "se", "ab", "oy", "oyj", "sas", "srl", "spa",
    "pllc", "lllp", "gp", "pc", "na", "fsb",
]
LEGAL_ROLES = [
    "company", "contractor", "consultant", "vendor", "customer", "employer", "employee", "landlord", "tenant", "licensor", "licensee", "borrower",
    "lender", "buyer", "seller", "investor", "partner", "party", "parties", "counterparty", "subcontractor",
]
INSTITUTIONS = [
    "arbitration", "association", "commission", "authority", "regulatory", "administration", "agency", "tribunal", "judiciary", "bureau",
]
ADDRESS_BLOCK = [
    "address", "addresses", "place", "location", "site", "area", "premises", "property", "office", "offices",
]
INITIALISM_STOP = [
    "the", "of", "and", "a", "an", "in", "for", "to", "at", "by",
]
MONTH_NAMES = [
    "May", "March", "August", "June", "April",
]
COMPANY_STOP = [
    "the", "of", "and", "a", "an", "in", "for", "to", "at", "by", "group", "holdings", "services", "partners", "associates", "international",
    "global", "general", "first", "new", "financial", "investment", "trust", "insurance", "resources", "industries", "systems", "technologies",
    "solutions", "properties", "development", "enterprises", "association", "corporation", "company", "limited", "incorporated",
]

INJECTIONS = [
    (r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|guidelines?)", "Instruction override: ignore previous instructions"),
    (r"disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|guidelines?)", "Instruction override: disregard previous instructions"),
    (r"forget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|guidelines?)", "Instruction override: forget previous instructions"),
    (r"override\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|guidelines?)", "Instruction override: override previous instructions"),
    (r"new\s+instructions?:\s*", "Instruction injection: new instructions block"),
    (r"system\s+prompt:\s*", "Instruction injection: system prompt reference"),
    (r"admin\s+override:\s*", "Instruction injection: admin override"),
    (r"developer\s+mode:\s*", "Instruction injection: developer mode"),
    (r"you\s+are\s+now\s+(a|an)\s+", "Role manipulation: 'you are now'"),
    (r"pretend\s+(you\s+are|to\s+be)\s+", "Role manipulation: pretend directive"),
    (r"act\s+as\s+(if\s+you\s+are\s+)?(a|an)\s+", "Role manipulation: act as directive"),
    (r"roleplay\s+as\s+", "Role manipulation: roleplay directive"),
    (r"do\s+not\s+(flag|report|mention)\s+(this|the|any|issues?|problems?|findings?)", "Output manipulation: suppress findings"),
    (r"skip\s+(all\s+)?rules?\s+", "Output manipulation: skip rules"),
    (r"bypass\s+(all\s+)?rules?\s+", "Output manipulation: bypass rules"),
    (r"return\s+(only\s+)?empty\s+(json|array|list)", "Output manipulation: force empty output"),
    (r"output\s+(only\s+)?\[\s*\]", "Output manipulation: force empty array"),
    (r"do\s+not\s+include\s+(this|in\s+(your|the)\s+(output|response|analysis|report))", "Output manipulation: suppress content in output"),
    (r"DAN\s+mode", "Jailbreak: DAN mode reference"),
    (r"jailbreak", "Jailbreak: explicit jailbreak reference"),
    (r"ignore\s+safety", "Jailbreak: safety bypass"),
    (r"ignore\s+ethical", "Jailbreak: ethics bypass"),
    (r"forget\s+everything", "Memory manipulation: forget everything"),
    (r"clear\s+(your\s+)?(memory|context|history)", "Memory manipulation: clear context"),
    (r"reset\s+(your\s+)?(memory|context|instructions?)", "Memory manipulation: reset context"),
    (r"disregard\s+(the\s+)?above", "Instruction override: disregard the above"),
    (r"from\s+now\s+on,?\s+(you|ignore|only|always|never)", "Instruction injection: 'from now on' directive"),
    (r"begin\s+(new\s+)?session", "Context manipulation: session reset"),
    (r"end\s+(of\s+)?system\s+prompt", "Boundary attack: end of system prompt"),
    (r"\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>", "Boundary attack: LLM control tokens"),
    (r"<\|im_start\|>|<\|im_end\|>", "Boundary attack: ChatML control tokens"),
    (r"human:\s*\n|assistant:\s*\n", "Boundary attack: conversation role injection"),
    (r"IMPORTANT:\s*(ignore|disregard|forget|override|bypass)", "Social engineering: urgency-prefixed override"),
    (r"do\s+not\s+reveal\s+(your|the|any)\s+(system|instructions?|prompt|rules?)", "Exfiltration attempt: suppress system prompt disclosure"),
    (r"repeat\s+(your|the)\s+(system|initial)\s+(prompt|instructions?|message)", "Exfiltration attempt: system prompt extraction"),
    (r"what\s+(are|were)\s+your\s+(initial|system|original)\s+(instructions?|prompt|rules?)", "Exfiltration attempt: system prompt query"),
]
INVISIBLE = {
    0x200B: "Zero-Width Space", 0x200C: "Zero-Width Non-Joiner", 0x200D: "Zero-Width Joiner", 0x200E: "Left-to-Right Mark", 0x200F: "Right-to-Left Mark",
    0x202A: "Left-to-Right Embedding", 0x202B: "Right-to-Left Embedding", 0x202C: "Pop Directional Formatting", 0x202D: "Left-to-Right Override",
    0x202E: "Right-to-Left Override", 0x2060: "Word Joiner", 0x2061: "Function Application", 0x2062: "Invisible Times", 0x2063: "Invisible Separator",
    0x2064: "Invisible Plus", 0x2066: "Left-to-Right Isolate", 0x2067: "Right-to-Left Isolate", 0x2068: "First Strong Isolate", 0x2069: "Pop Directional Isolate",
    0x00AD: "Soft Hyphen", 0xFEFF: "Byte Order Mark / Zero-Width No-Break Space", 0xFFF9: "Interlinear Annotation Anchor",
    0xFFFA: "Interlinear Annotation Separator", 0xFFFB: "Interlinear Annotation Terminator", 0x180E: "Mongolian Vowel Separator", 0x034F: "Combining Grapheme Joiner",
}
HIDDEN_TEXT = {
    "tiny": ["Text rendered at ", "pt — effectively invisible to readers.", "Remove the hidden text or increase the font size."],
    "hidden": ["Text has the 'hidden' font attribute enabled.", "", "Remove the hidden text or clear the hidden attribute."],
    "light": ["Text color is near-white (", "), making it invisible on a white background.", "Remove the hidden text or change the font color."],
}
INJECTION_ADVICE = "Remove or rewrite this text before sending the document to an AI service."
INVISIBLE_ADVICE = "Remove invisible characters. They may carry hidden payloads or manipulate text rendering/AI interpretation."
FIELD_INJECTION_ADVICE = ["Clear or rewrite the '", "' metadata field before sending this document to an AI service."]
FIELD_INVISIBLE_ADVICE = ["Clean the '", "' metadata field to remove invisible characters."]
# --- end of fixed values ----------------------------------------------------------------------

INVISIBLE_CLASS = "[" + "".join(chr(c) for c in sorted(INVISIBLE)) + "]"

#: (entity type, pattern, group, confidence) in detection order; the order breaks ties between types.
STRUCTURED = [("EMAIL", EMAIL, 0), ("PHONE", PHONE, 0), ("SSN", SSN, 0), ("EIN", EIN, 0), ("AMOUNT", AMOUNT, 0), ("ADDRESS", ADDRESS, 0), ("URL", URL, 0)]
STRUCTURED_RE2 = [(t, {"PHONE": PHONE_RE2, "URL": URL_RE2}.get(t, p), {"PHONE": 1}.get(t, g)) for t, p, g in STRUCTURED]


# --- the same patterns for java.util.regex, written so that it fails early -----------------------
# They match what the fixed values match, and SQL is made of those. A look at the next character spares the
# alternatives at places where none can begin, and a place within a run that failed as a whole is not tried again.
_by_initial: dict[str, list[str]] = {}
for _s in CORPORATE_SUFFIXES:
    _by_initial.setdefault(_s[0], []).append(_s[1:])
_SUFFIX = rf"(?=[{''.join(_by_initial)}])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in _by_initial.items()) + ")"
_INITIAL, _WORD = "[A-ZÀ-ɏ]", r"[A-ZÀ-ɏ][A-Za-zÀ-ɏ&\-']+"
_COMPANY = rf"(?:{_WORD} )*{_WORD}(?![a-z]),?\s*{_SUFFIX}\.?"
_NO_NAME = rf"(?!\p{{L}}|\s+(?i-Uu:{'|'.join(AGREEMENT_TERMS)})(?![A-Za-z]))"
_LABEL = LABEL_AFTER.removeprefix("(?s)^.{0,500}?")
#: Company names in group 2, which is empty where the suffix goes on as a word or a type of document follows.
COMPANY_KEPT = rf"(?={_INITIAL})(?=((?>{_COMPANY})))(?:(?=(\1){_NO_NAME}))?+\1"
#: The same with all up to the label that stands behind the name within 500 characters; empty without one.
PARTY = rf"(?={_INITIAL})(?=((?>{_COMPANY})))(?:(?=(\1{_NO_NAME}(?s:.{{0,500}}?){_LABEL.replace('([^', '(?:[^', 1)})))?+\1"
#: Of a match of PARTY the name (1) and the label (2).
PARTY_PARTS = rf"(?s)^((?>{_COMPANY})).{{0,500}}?{_LABEL}"
JAVA = {
    EMAIL: EMAIL.replace("+@", "++@", 1), PHONE: r"(?=[+(\d])" + PHONE, SSN: r"(?=\d)" + SSN, EIN: r"(?=\d)" + EIN,
    ADDRESS: ADDRESS.replace(r"\d+\s+[A-Za-z\s\.]+(?:", r"(?=\d)(?:(?<!\d)|\G)\d++\s+[A-Za-z\s\.]+(?=[SABDRWL])(?:", 1),
    URL: r"(?:(?<![a-zA-Z0-9-])|(?=https?://)|\G)" + URL.replace("9-]+", "9-]++", 1),
    BARE_AMOUNT: BARE_AMOUNT.replace("(?i)", "(?i)(?=[eumtalnips])", 1), STREET: r"(?=\d)" + STREET,
    PERSON["h9c_signature"]: "(?=[_/])" + PERSON["h9c_signature"], PERSON["h9d_between"]: "(?=[BbAa])" + PERSON["h9d_between"], PERSON["h9e_role"]: "(?=[Aa])" + PERSON["h9e_role"],
    DATE["h10a_month_first"]: "(?=[JFMASOND])" + DATE["h10a_month_first"], DATE["h10b_numeric"]: r"(?=\d)" + DATE["h10b_numeric"], DATE["h10c_day_first"]: r"(?=\d)" + DATE["h10c_day_first"],
    CITY_STATE["h11a_preposition"]: "(?=[iaoftn])" + CITY_STATE["h11a_preposition"],
    COMPANY: rf"(?={_INITIAL})({_COMPANY})", DEFINED_TERM: rf"(?={_INITIAL})" + DEFINED_TERM.replace(f"(?:{SUFFIX})", f"(?:{_SUFFIX})", 1),
    BARE_SUFFIX: BARE_SUFFIX.replace(f"(?:{SUFFIX})", f"(?:{_SUFFIX})", 1), STRIP_SUFFIX: STRIP_SUFFIX.replace(f"(?:{SUFFIX})", f"(?:{_SUFFIX})", 1),
}
