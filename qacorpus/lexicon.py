"""Lexicon profiles: every word list, rule, weight and threshold used by the operators.

An operator never hard-codes vocabulary; it takes a :class:`Profile`.  ``MEDICAL`` is the
default.  Build another with :func:`dataclasses.replace` to curate a different domain.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------------------
# Fixed values.  These lists, patterns and numbers decide results, so they are data that
# must stay exactly as given (content and order).
# --------------------------------------------------------------------------------------

ABBREVIATIONS = {
    "HDL-C": "High-Density Lipoprotein Cholesterol",
    "LDL-C": "Low-Density Lipoprotein Cholesterol",
    "cIMT": "carotid Intima-Media Thickness",
    "PCD": "Percutaneous Coronary Disease",
    "MI": "Myocardial Infarction",
    "CVD": "Cardiovascular Disease",
    "HTN": "Hypertension",
    "CAD": "Coronary Artery Disease",
    "CHF": "Congestive Heart Failure",
    "ECG": "Electrocardiogram",
    "EKG": "Electrocardiogram",
    "CBC": "Complete Blood Count",
    "BUN": "Blood Urea Nitrogen",
    "CRP": "C-Reactive Protein",
    "ESR": "Erythrocyte Sedimentation Rate",
    "HbA1c": "Hemoglobin A1c",
    "TSH": "Thyroid Stimulating Hormone",
    "T3": "Triiodothyronine",
    "T4": "Thyroxine",
    "PT": "Prothrombin Time",
    "PTT": "Partial Thromboplastin Time",
    "INR": "International Normalized Ratio",
    "DM": "Diabetes Mellitus",
    "COPD": "Chronic Obstructive Pulmonary Disease",
    "GERD": "Gastroesophageal Reflux Disease",
    "UTI": "Urinary Tract Infection",
    "URI": "Upper Respiratory Infection",
    "DVT": "Deep Vein Thrombosis",
    "PE": "Pulmonary Embolism",
    "IBS": "Irritable Bowel Syndrome",
    "IBD": "Inflammatory Bowel Disease",
    "mg/dL": "milligrams per deciliter",
    "mmol/L": "millimoles per liter",
    "mmHg": "millimeters of mercury",
    "bpm": "beats per minute",
    "kg/m²": "kilograms per square meter",
    "mL/min": "milliliters per minute",
    "ICU": "Intensive Care Unit",
    "ER": "Emergency Room",
    "OR": "Operating Room",
    "IV": "Intravenous",
    "IM": "Intramuscular",
    "SC": "Subcutaneous",
    "PO": "Per Oral",
    "PRN": "As Needed",
    "QID": "Four Times Daily",
    "TID": "Three Times Daily",
    "BID": "Twice Daily",
    "QD": "Once Daily",
    "NPO": "Nothing by Mouth",
    "SOB": "Shortness of Breath",
    "DOE": "Dyspnea on Exertion",
    "CHD": "Coronary Heart Disease",
    "AF": "Atrial Fibrillation",
    "VT": "Ventricular Tachycardia",
    "VF": "Ventricular Fibrillation",
}

TERMS = {
    "conditions": (
        "diabetes", "hypertension", "cancer", "pneumonia", "asthma", "covid", "flu", "fever", "stroke",
        "heart attack", "kidney disease", "liver disease", "arthritis", "depression", "anxiety",
        "tuberculosis", "hepatitis", "hiv", "aids", "malaria", "dengue", "cholera", "typhoid", "measles",
        "mumps", "rubella", "chickenpox", "shingles",
    ),
    "symptoms": (
        "pain", "headache", "nausea", "fatigue", "dizziness", "cough", "shortness of breath", "chest pain",
        "abdominal pain", "back pain", "joint pain", "muscle pain", "vomiting", "diarrhea", "constipation",
        "fever", "chills", "sweating", "weakness", "numbness", "tingling", "blurred vision", "hearing loss",
    ),
    "treatments": (
        "medication", "surgery", "therapy", "treatment", "prescription", "antibiotic", "antiviral",
        "antifungal", "chemotherapy", "radiation", "immunotherapy", "physical therapy", "occupational therapy",
        "speech therapy", "dialysis", "transplant", "bypass", "angioplasty", "stent", "pacemaker",
    ),
    "body_parts": (
        "heart", "lung", "brain", "liver", "kidney", "stomach", "blood", "bone", "muscle", "skin", "eye",
        "ear", "nose", "throat", "spine", "joint", "artery", "vein", "nerve", "gland", "organ", "tissue",
        "cell",
    ),
    "medical_professionals": (
        "doctor", "physician", "surgeon", "nurse", "specialist", "cardiologist", "neurologist", "oncologist",
        "psychiatrist", "radiologist", "pathologist", "anesthesiologist", "dermatologist", "ophthalmologist",
        "otolaryngologist",
    ),
}

SEVERITY = {
    "critical": (
        "stroke", "heart attack", "cardiac arrest", "sepsis", "coma", "hemorrhage", "emergency",
        "life threatening", "fatal", "death", "mortality", "severe trauma", "organ failure",
        "respiratory failure", "kidney failure", "liver failure", "brain death", "cardiac death",
        "sudden death", "anaphylaxis", "shock",
    ),
    "high": (
        "severe", "acute", "unstable", "complicated", "progression", "advanced", "metastatic", "malignant",
        "invasive", "aggressive", "rapid", "urgent", "hospitalization", "intensive care", "icu",
        "emergency room", "surgery",
    ),
    "moderate": (
        "chronic", "stable", "controlled", "manageable", "mild to moderate", "outpatient", "clinic",
        "regular follow-up", "monitoring", "observation",
    ),
    "low": (
        "mild", "minor", "routine", "screening", "prevention", "check-up", "wellness", "health maintenance",
        "preventive care", "education", "counseling", "lifestyle", "diet", "exercise",
    ),
}

SPECIALTY = {
    "cardiology": ("heart", "cardiac", "cardio", "chest pain", "blood pressure", "cholesterol"),
    "neurology": ("brain", "neuro", "stroke", "headache", "seizure", "memory"),
    "pulmonology": ("lung", "respiratory", "breathing", "cough", "asthma", "pneumonia"),
    "endocrinology": ("diabetes", "thyroid", "hormone", "insulin", "glucose"),
    "gastroenterology": ("stomach", "intestine", "liver", "digestive", "nausea", "diarrhea"),
    "orthopedics": ("bone", "joint", "muscle", "fracture", "arthritis", "spine"),
    "dermatology": ("skin", "rash", "eczema", "acne", "dermal"),
    "psychiatry": ("mental", "depression", "anxiety", "psychiatric", "mood"),
    "oncology": ("cancer", "tumor", "malignant", "chemotherapy", "radiation"),
    "pediatrics": ("child", "pediatric", "infant", "baby", "adolescent"),
}

DISEASE_GROUPS = {
    "infectious": ("infection", "pneumonia", "bronchitis", "flu", "covid", "tuberculosis", "hepatitis", "uti"),
    "respiratory": ("asthma", "copd", "pneumonia", "bronchitis", "emphysema"),
    "cardiovascular": ("hypertension", "heart attack", "angina", "arrhythmia", "stroke", "heart disease"),
    "digestive": ("gastritis", "gerd", "ulcer", "ibs", "crohn", "colitis", "appendicitis"),
    "neurological": ("migraine", "headache", "alzheimer", "parkinson", "epilepsy", "stroke", "meningitis"),
    "metabolic": ("diabetes", "thyroid", "obesity", "hypothyroidism", "hyperthyroidism"),
    "psychiatric": ("depression", "anxiety", "bipolar", "schizophrenia", "ptsd", "ocd"),
    "gynecological": ("pregnancy", "pcos", "endometriosis", "menopause", "fibroids"),
    "musculoskeletal": ("arthritis", "osteoporosis", "fibromyalgia", "gout", "fracture", "tendinitis"),
    "dermatological": ("eczema", "psoriasis", "acne", "dermatitis", "rash", "hives"),
    "oncological": ("cancer", "tumor", "leukemia", "lymphoma", "carcinoma"),
    "renal": ("kidney disease", "renal failure", "kidney stones", "nephritis"),
    "pediatric": ("measles", "chickenpox", "mumps", "rubella", "whooping cough"),
}

RESPONSE_CATEGORIES = {
    "Infection": ("infection", "bacterial", "viral", "flu", "cold", "fever", "pneumonia"),
    "Cardiovascular": ("heart", "cardiac", "blood pressure", "hypertension", "heart attack", "stroke", "chest pain"),
    "Respiratory": ("asthma", "copd", "bronchitis", "breathing", "cough", "shortness of breath"),
    "Neurological": ("headache", "migraine", "seizure", "epilepsy", "stroke", "dizziness"),
    "Gastrointestinal": ("stomach", "nausea", "vomiting", "diarrhea", "abdominal", "digestive"),
    "Musculoskeletal": ("arthritis", "joint pain", "back pain", "muscle", "bone", "osteoporosis"),
    "Endocrine": ("diabetes", "thyroid", "hormone", "insulin", "blood sugar"),
    "Mental_Health": ("depression", "anxiety", "stress", "panic", "bipolar", "ptsd"),
    "Dermatological": ("skin", "rash", "burn", "allergy", "eczema"),
    "Emergency": ("emergency", "urgent", "hospital", "call 911", "life threatening", "unconscious"),
    "Preventive": ("prevention", "screening", "vaccine", "checkup", "healthy lifestyle"),
    "Other": ("unknown", "unclear", "various", "multiple", "general"),
}

TRIAGE_SEVERITY = {
    "severe": ("severe", "intense", "unbearable", "emergency", "cant breathe", "chest pain", "heart attack"),
    "moderate": ("persistent", "worsening", "concerning", "frequent", "constant", "ongoing"),
}

TRIAGE_CATEGORY = {
    "flu": ("cough", "runny nose", "congestion", "body aches"),
    "fever": ("fever", "high temperature", "chills"),
    "digestion": ("nausea", "vomiting", "diarrhea", "stomach pain"),
    "respiratory": ("breathing", "shortness of breath", "wheezing"),
    "cardiovascular": ("chest pain", "heart", "palpitations"),
    "neurological": ("headache", "migraine", "dizziness"),
    "musculoskeletal": ("muscle pain", "joint pain", "back pain"),
    "skin": ("rash", "itching", "hives"),
}

ROUTES = {
    "diabetes": ("เบาหวาน", "diabetes"),
    "hypertension": ("ความดัน", "hypertension"),
    "cardiology": ("หัวใจ", "heart"),
    "emergency": ("ฉุกเฉิน", "emergency"),
}

# ordered rules: (type, severity, patterns); a pattern hits when every keyword in it occurs
ALERT_RULES = (
    ("heart_attack", "critical", (
        ("chest pain", "arm pain"),
        ("chest pain", "shortness of breath"),
        ("chest pressure", "sweating"),
        ("chest pain", "nausea"),
        ("crushing chest pain",),
    )),
    ("stroke", "critical", (
        ("facial drooping", "arm weakness"),
        ("slurred speech", "confusion"),
        ("sudden severe headache", "vision problems"),
        ("numbness", "weakness", "one side"),
        ("sudden confusion", "trouble speaking"),
    )),
    ("severe_allergic_reaction", "critical", (
        ("swelling", "throat", "difficulty breathing"),
        ("hives", "swelling", "difficulty breathing"),
        ("anaphylaxis",),
        ("throat closing", "swelling"),
    )),
    ("meningitis", "critical", (
        ("severe headache", "stiff neck", "fever"),
        ("headache", "neck stiffness", "sensitivity to light"),
        ("severe headache", "vomiting", "confusion"),
    )),
    ("severe_bleeding", "critical", (
        ("severe bleeding",),
        ("heavy bleeding", "won't stop"),
        ("bleeding profusely",),
        ("blood won't stop",),
    )),
)
ALERT_MESSAGES = {
    "heart_attack": "🚨 **EMERGENCY - POSSIBLE HEART ATTACK**",
    "stroke": "🚨 **EMERGENCY - POSSIBLE STROKE**",
    "severe_allergic_reaction": "🚨 **EMERGENCY - SEVERE ALLERGIC REACTION (ANAPHYLAXIS)**",
    "meningitis": "🚨 **EMERGENCY - POSSIBLE MENINGITIS**",
    "severe_bleeding": "🚨 **EMERGENCY - SEVERE BLEEDING**",
}
ALERT_ANSWER_MARKS = ("🚨", "EMERGENCY", "IMMEDIATE ACTION REQUIRED")
ALERT_ANSWER_TYPES = {
    "HEART ATTACK": "⚠️ HEART ATTACK",
    "STROKE": "⚠️ STROKE",
    "ALLERGIC REACTION": "⚠️ SEVERE ALLERGIC REACTION",
    "MENINGITIS": "⚠️ MENINGITIS",
    "BLEEDING": "⚠️ SEVERE BLEEDING",
}

# alternatives of whole-word patterns, one tuple per pattern
OFFENSIVE = (
    ("spam", "advertisement", "ads", "buy now", "click here", "promotional", "marketing"),
    ("xxx", "porn", "sex", "adult", "erotic", "sexual"),
    ("hate", "racist", "stupid", "idiot", "moron", "dumb", "retard"),
    ("scam", "fraud", "fake", "illegal", "banned", "prohibited"),
)
RELEVANCE_SIMPLE = (
    ("symptom", "diagnosis", "treatment", "medication", "doctor", "hospital", "patient", "disease", "illness"),
    ("mg", "ml", "dose", "tablet", "injection", "prescription", "therapy"),
    ("blood pressure", "heart rate", "temperature", "pulse", "vital signs"),
    ("medical", "clinical", "healthcare", "health", "medicine"),
)
RELEVANCE_WEIGHTED = (
    ("patient", "diagnosis", "treatment", "therapy", "medication", "prescription"),
    ("hospital", "clinic", "doctor", "physician", "nurse", "medical"),
    ("symptom", "disease", "illness", "condition", "syndrome"),
    ("mg", "ml", "dose", "tablet", "capsule", "injection"),
    ("blood pressure", "heart rate", "temperature", "vital signs"),
)
RELEVANCE_DETAILED = (
    (
        "symptom", "diagnosis", "treatment", "medication", "doctor", "hospital", "patient", "disease",
        "illness", "condition",
    ),
    ("mg", "ml", "dose", "dosage", "tablet", "injection", "prescription", "therapy", "pharmaceutical"),
    ("blood pressure", "heart rate", "temperature", "pulse", "vital signs", "lab results"),
    ("medical", "clinical", "healthcare", "health", "medicine", "therapeutic", "diagnostic"),
    ("surgery", "operation", "procedure", "examination", "test", "scan", "x-ray", "mri", "ct"),
)

PHRASES = {
    "high bp": "high blood pressure",
    "low bp": "low blood pressure",
    "heart attack": "myocardial infarction",
    "stroke": "cerebrovascular accident",
    "sugar": "blood glucose",
    "sugar level": "blood glucose level",
    "pills": "medication",
    "meds": "medications",
}
FILLERS = (
    ("please note that", "it should be noted that", "it is important to note"),
    ("in conclusion", "to summarize", "in summary"),
    ("as mentioned before", "as stated earlier"),
)
SYNONYMS = {
    "โรคเบาหวาน": ("diabetes", "เบาหวาน", "น้ำตาลในเลือด"),
    "ความดันโลหิตสูง": ("hypertension", "ความดันสูง", "โลหิตสูง"),
    "ไข้หวัดใหญ่": ("influenza", "flu", "ไข้หวัด"),
}
# Fixed output texts of the answer template.
CLARIFY = (
    "I'm having difficulty identifying a specific condition based on the symptoms you've described.\n\n"
    "Could you provide more details, such as:\n- When did the symptoms start?\n- How severe are they?\n"
    "- Are there any other symptoms?"
)
RECOMMEND = (
    "\n**Recommendation:**\nI strongly recommend consulting with a healthcare professional for an accurate "
    "diagnosis and appropriate treatment plan. Would you like to know more about your symptoms or this condition?"
)
LIKELY = ("Based on your symptoms, you likely have **", "**.\n")

ANSWER_FORMS = {
    "Yes": ("yes", "y", "true", "correct", "right", "positive"),
    "No": ("no", "n", "false", "incorrect", "wrong", "negative"),
    "Uncertain": ("maybe", "possibly", "uncertain", "unclear", "depends"),
    "Unknown": ("unknown", "not known", "not sure", "unclear"),
}

WEIGHT_SPECIALTY = {
    "cardiology": 1.2, "neurology": 1.2, "oncology": 1.1, "endocrinology": 1.1, "pulmonology": 1.0,
    "gastroenterology": 1.0, "nephrology": 1.0, "pediatrics": 0.9, "orthopedics": 0.9, "psychiatry": 0.9,
    "dermatology": 0.8, "urology": 0.8, "general_medicine": 0.7,
}
WEIGHT_SEVERITY = {"critical": 1.3, "high": 1.1, "moderate": 0.9, "low": 0.7}
WEIGHT_TYPE = {"medical_qa": 1.0, "advice": 0.9}

QUESTION_MARKERS = ("?", "what", "how", "why", "when", "where", "which", "who")
QUESTION_INDICATORS = (
    "?", "what", "how", "why", "when", "where", "which", "who", "is", "are", "can", "will", "should", "would",
    "could",
)
SCORE_MARKERS = ("?", "what", "how", "why", "when", "where")
GENERIC_ANSWERS = ("yes", "no", "maybe", "i don't know", "unclear", "unknown")
SCORE_TERMS = ("medical", "health", "disease", "symptom", "treatment")
INFORMATIVE = ("because", "due to", "caused by", "treatment", "recommended")
INFORMATIVE_DETAILED = ("because", "due to", "treatment", "recommended", "indicates", "suggests")
MCQ_MARKERS = ("(a)", "(b)", "(c)", "(d)", "choose", "select")
FEATURE_TERMS = (
    "patient", "treatment", "diagnosis", "symptom", "disease", "medication", "doctor", "hospital", "therapy",
    "clinical",
)
URGENT_WORDS = ("urgent", "emergency", "severe", "critical", "immediately", "acute")
YES_NO_STARTS = ("is", "are", "do", "does", "can", "could", "should")
WH_STARTS = ("what", "how", "why", "when", "where", "who", "which")
TEXT_TERMS = (
    "patient", "treatment", "diagnosis", "symptom", "disease", "medication", "doctor", "hospital", "surgery",
    "therapy", "clinical", "medical",
)
TEXT_ABBREVIATIONS = ("MI", "CVD", "HTN", "DM", "COPD", "ECG", "CBC", "TSH", "CT", "MRI")
ANSWER_TERMS = (
    "symptom", "treatment", "doctor", "health", "medical", "patient", "disease", "condition", "diagnosis",
    "medication", "therapy", "care",
)
INSULTS = ("stupid", "dumb", "idiot")
ADVICE_WORDS = ("please", "should", "recommend", "important")
RESPONSE_KEYWORDS = (
    "symptom", "treatment", "doctor", "medical", "health", "disease", "condition", "diagnosis", "therapy",
    "medication", "prevention",
)
RESPONSE_EMERGENCY = ("urgent", "emergency", "hospital", "call", "911", "immediately")
RESPONSE_PREVENTION = ("prevent", "healthy", "diet", "exercise", "lifestyle")
EMERGENCY_KEYWORDS = (
    "chest pain", "heart attack", "stroke", "choking", "bleeding", "unconscious", "breathing difficulty",
    "severe pain", "emergency", "call 911", "hospital", "urgent", "critical", "life threatening",
)
CONFIDENCE_TERMS = ("อาการ", "รักษา", "ยา", "โรค", "อันตราย")
MAIL_MARKER = "คำถาม:"

DISEASE_LABELS = (
    "acne", "addison", "adhd", "aids", "alzheimer", "angina", "anxiety", "appendicitis", "arrhythmia",
    "arthritis", "asthma", "atherosclerosis", "autism", "bipolar", "bronchiolitis", "bronchitis", "cancer",
    "carcinoma", "cardiac arrest", "cellulitis", "chickenpox", "cirrhosis", "colitis", "copd", "coronary",
    "crohn", "croup", "dementia", "dengue", "depression", "dermatitis", "developmental delay", "diabetes",
    "eczema", "emphysema", "encephalitis", "endometriosis", "epilepsy", "fibromyalgia", "flu", "fracture",
    "fungal infection", "gallstones", "gastritis", "gastroenteritis", "gerd", "gout", "hand foot mouth",
    "headache", "heart attack", "heart disease", "heart failure", "hepatitis", "herniated disc", "hiv",
    "hives", "hypertension", "hyperthyroidism", "hypothyroidism", "ibs", "incontinence", "infection",
    "influenza", "kawasaki", "kidney disease", "kidney stones", "leukemia", "lung cancer", "lung disease",
    "lymphoma", "malaria", "malignancy", "measles", "melanoma", "meningitis", "menopause", "metastasis",
    "migraine", "multiple sclerosis", "mumps", "myocardial infarction", "nephritis", "neuropathy", "obesity",
    "ocd", "osteoarthritis", "osteoporosis", "ovarian cyst", "pancreatitis", "panic disorder", "parkinson",
    "pcos", "pelvic inflammatory disease", "pneumonia", "pregnancy", "prostate cancer", "psoriasis", "ptsd",
    "rash", "renal failure", "respiratory infection", "rheumatoid arthritis", "rubella", "schizophrenia",
    "scoliosis", "seizure", "sepsis", "skin cancer", "sprain", "std", "stroke", "tendinitis", "thyroid",
    "tuberculosis", "tumor", "typhoid", "ulcer", "urinary tract infection", "uti", "whooping cough",
)

# --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """One domain's vocabulary.  Pattern fields hold tuples of whole-word alternatives."""

    name: str = "medical"
    abbreviations: dict = None
    terms: dict = None
    severity: dict = None
    severity_default: str = "moderate"
    specialty: dict = None
    specialty_default: str = "general_medicine"
    offensive: tuple = OFFENSIVE
    relevance_simple: tuple = RELEVANCE_SIMPLE
    relevance_weighted: tuple = RELEVANCE_WEIGHTED
    relevance_detailed: tuple = RELEVANCE_DETAILED
    phrases: dict = None
    fillers: tuple = FILLERS
    question_markers: tuple = QUESTION_MARKERS
    question_indicators: tuple = QUESTION_INDICATORS
    score_markers: tuple = SCORE_MARKERS
    score_terms: tuple = SCORE_TERMS
    informative: tuple = INFORMATIVE
    informative_detailed: tuple = INFORMATIVE_DETAILED
    # weight of one occurrence (weighted relevance) and of one distinct hit (detailed relevance)
    occurrence_weight: dict = None
    distinct_weight: dict = None
    weight_specialty: dict = None
    weight_severity: dict = None
    weight_type: dict = None
    text_terms: tuple = TEXT_TERMS
    text_abbreviations: tuple = TEXT_ABBREVIATIONS
    feature_terms: tuple = FEATURE_TERMS
    urgent_words: tuple = URGENT_WORDS
    emergency_keywords: tuple = EMERGENCY_KEYWORDS
    alert_rules: tuple = ALERT_RULES
    alert_messages: dict = None

    def __post_init__(self):
        defaults = dict(
            abbreviations=ABBREVIATIONS, terms=TERMS, severity=SEVERITY, specialty=SPECIALTY, phrases=PHRASES,
            occurrence_weight={"conditions": 3, "symptoms": 2}, distinct_weight={"conditions": 2},
            weight_specialty=WEIGHT_SPECIALTY, weight_severity=WEIGHT_SEVERITY, weight_type=WEIGHT_TYPE,
            alert_messages=ALERT_MESSAGES,
        )
        for key, value in defaults.items():
            if getattr(self, key) is None:
                object.__setattr__(self, key, value)

    @property
    def all_terms(self) -> tuple:
        """Terms of every category in order; a term listed twice counts twice."""
        return tuple(t for ts in self.terms.values() for t in ts)


MEDICAL = Profile()
