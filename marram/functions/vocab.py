"""Vocabularies and word lists of the report domain."""

# Controlled vocabularies.
EVENT_TYPES = "injury missing_person trapped_person road_blocked road_open fire flood structural_damage power_outage water_outage shelter_capacity medical_need food_need evacuation infrastructure_damage hazard resource_available resource_needed other".split()
PLACE_TYPES = "road_blocked road_open structural_damage power_outage water_outage shelter_capacity food_need medical_need evacuation infrastructure_damage hazard resource_available resource_needed".split()
COUNTABLE_TYPES = "injury missing_person trapped_person medical_need food_need shelter_capacity evacuation".split()
VOLATILE_TYPES = "road_blocked road_open power_outage water_outage fire flood".split()
SEVERITIES = "unknown low medium high critical".split()
STATUS_PAIRS = "road_blocked:road_open,power_outage:power_restored,water_outage:water_restored,fire:no_fire"

# Words that license a severity, strongest first.
SEVERITY_MARKERS = {
    "critical": ["critical", "critique", "critique!", "life-threatening", "life threatening", "gravementre", "mortal", "grave danger"],
    "high": ["grave", "gravementre", "serieux", "serieuse", "sévère", "severe", "majeur", "danger", "dangerous", "serious", "خطير", "قاسح"],
    "medium": ["modere", "modéré", "important", "urgent", "عاجل", "مهم"],
    "low": ["leger", "léger", "minor", "خفيفة"],
}
# Words that take a marker back within the next NEGATION_WINDOW words.
NEGATION_CUES = (
    "not no never dont doesnt isnt wasnt cannot unknown unsure maybe perhaps possibly if whether unclear".split()
    + ["mعرفتش", "معرفش", "واش", "ما", "ماعرف", "ماعرفش", "ما ادري", "مادري", "لا", "لم", "لن", "ليس", "غير", "بدون", "也许", "不知道", "不确定", "如果"]
)
NEGATION_WINDOW = 6

# Instruction-shaped patterns, matched without regard to case.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above|earlier)",
    r"disregard\s+(all\s+)?(previous|prior|above|earlier|the\s+above)",
    r"forget\s+(everything|all)\s+(you|above|before)",
    r"you\s+are\s+now\b",
    r"new\s+instructions?\s*:",
    r"(?:^|\n)\s*(system|assistant)\s*:",
    r"</?(?:untrusted_report|system|instructions?|prompt)>",
    r"\btherefore\s+the\s+answer\s+is\b",
    r"\balways\s+(?:return|output|report)\b",
    r"\boutput\s+only\b",
    r"\bmark\s+(?:this|it)\s+as\b",
    r"\bset\s+severity\s+to\b",
]

# Texts that stand for no answer, folded (lower case, no accents).
PLACEHOLDERS = [
    "", "-", "?", "n/a", "na", "nil", "none", "null", "undefined", "unknown", "unk", "no", "no information", "no data", "no location", "no place",
    "not specified", "non specified", "not available", "not stated", "not mentioned", "non given", "non provided", "non disclosed", "non existant", "non existe",
    "no location given", "location not specified", "unspecified", "undefined location", "unavailable", "unspecified location",
    "non specifie", "non precise", "non precisee", "non indique", "non mentionne", "non renseigne", "pas d'information", "inconnu", "indetermine",
    "non specifiee", "pas precise", "pas indique", "non defini", "غير محدد", "غير معروف", "غير مذكور", "لا يوجد", "لا معلومة",
]
# Parts of the wire format that a confused extractor echoes.
ECHOES = ["UNTRUSTED_REPORT", "untrusted_report", "REPORT", "EVENT", "ANSWER", "events:", "segment", "SEGMENT", "type", "location", "severity", "<UNTRUSTED_REPORT>", "</UNTRUSTED_REPORT>"]

# Places too general to be one.
GENERIC_PLACES = ["the road", "road", "street", "here", "there", "city", "town", "area", "place", "الطريق", "الشارع", "هنا", "هناك", "المدينة", "المنطقة", "بلدة", "طريق", "شارع"]
PLACE_STOPWORDS = "the of de du des la le les el al sidi city town ville centre center north south east west old new grande petite saint ad as".split()

FIELDS = ["event_type", "location_text", "people_affected", "severity", "time_reference", "description"]
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
