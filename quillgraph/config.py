"""The default profile: ontology and word lists as plain configuration. Any other profile can take its place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Types with their priority, abbreviations, singulars, legal triples and word lists of the domain.
TYPE_PRIORITY = {
    "CONDITION": 10, "MEDICATION": 9, "TREATMENT": 8, "SYMPTOM": 7, "DIAGNOSTIC_CRITERION": 6, "SPECIFIER": 5,
    "RISK_FACTOR": 4, "COURSE_FEATURE": 3, "PREVALENCE_STATEMENT": 2, "DEMOGRAPHIC": 1, "SAFETY_RESOURCE": 0,
}
ABBREVIATIONS = {
    "CBT": "COGNITIVE BEHAVIORAL THERAPY", "DBT": "DIALECTICAL BEHAVIOR THERAPY", "ACT": "ACCEPTANCE AND COMMITMENT THERAPY",
    "EMDR": "EYE MOVEMENT DESENSITIZATION AND REPROCESSING", "ECT": "ELECTROCONVULSIVE THERAPY", "TMS": "TRANSCRANIAL MAGNETIC STIMULATION",
    "SSRI": "SELECTIVE SEROTONIN REUPTAKE INHIBITOR", "SNRI": "SEROTONIN NOREPINEPHRINE REUPTAKE INHIBITOR", "TCA": "TRICYCLIC ANTIDEPRESSANT",
    "MAOI": "MONOAMINE OXIDASE INHIBITOR", "MDD": "MAJOR DEPRESSIVE DISORDER", "GAD": "GENERALIZED ANXIETY DISORDER", "PTSD": "POST TRAUMATIC STRESS DISORDER",
    "OCD": "OBSESSIVE COMPULSIVE DISORDER", "BPD": "BORDERLINE PERSONALITY DISORDER", "ADHD": "ATTENTION DEFICIT HYPERACTIVITY DISORDER",
    "SAD": "SEASONAL AFFECTIVE DISORDER", "BDD": "BODY DYSMORPHIC DISORDER", "ASD": "AUTISM SPECTRUM DISORDER",
}
SINGULARS = {
    "SYMPTOMS": "SYMPTOM", "CONDITIONS": "CONDITION", "CRITERIA": "CRITERION", "SPECIFIERS": "SPECIFIER", "TREATMENTS": "TREATMENT", "MEDICATIONS": "MEDICATION",
    "THERAPIES": "THERAPY", "DISORDERS": "DISORDER", "EPISODES": "EPISODE", "BEHAVIORS": "BEHAVIOR", "BEHAVIOURS": "BEHAVIOUR", "THOUGHTS": "THOUGHT",
    "CHANGES": "CHANGE", "PROBLEMS": "PROBLEM", "DIFFICULTIES": "DIFFICULTY", "DISTURBANCES": "DISTURBANCE", "STABILIZERS": "STABILIZER", "INHIBITORS": "INHIBITOR",
    "ANTIDEPRESSANTS": "ANTIDEPRESSANT", "ANTIPSYCHOTICS": "ANTIPSYCHOTIC", "RESOURCES": "RESOURCE", "HALLUCINATIONS": "HALLUCINATION", "DELUSIONS": "DELUSION",
    "FLASHBACKS": "FLASHBACK", "NIGHTMARES": "NIGHTMARE", "ATTACKS": "ATTACK", "FEELINGS": "FEELING", "EXPERIENCES": "EXPERIENCE", "ISSUES": "ISSUE",
    "EVENTS": "EVENT", "TECHNIQUES": "TECHNIQUE", "APPROACHES": "APPROACH", "FEATURES": "FEATURE", "RATES": "RATE",
}
TRIPLES = [
    ("CONDITION", "HAS_SYMPTOM", "SYMPTOM"), ("CONDITION", "TREATED_BY", "TREATMENT"), ("CONDITION", "TREATED_BY", "MEDICATION"), ("CONDITION", "PRESCRIBES", "MEDICATION"),
    ("CONDITION", "SUITABLE_FOR", "DEMOGRAPHIC"), ("CONDITION", "SUITABLE_FOR", "CONDITION"), ("MEDICATION", "SUITABLE_FOR", "DEMOGRAPHIC"), ("MEDICATION", "SUITABLE_FOR", "CONDITION"),
    ("TREATMENT", "SUITABLE_FOR", "DEMOGRAPHIC"), ("TREATMENT", "SUITABLE_FOR", "CONDITION"), ("CONDITION", "CONTRAINDICATED_FOR", "DEMOGRAPHIC"),
    ("MEDICATION", "CONTRAINDICATED_FOR", "DEMOGRAPHIC"), ("TREATMENT", "CONTRAINDICATED_FOR", "DEMOGRAPHIC"), ("CONDITION", "URGENT_ACTION", "SAFETY_RESOURCE"),
    ("SYMPTOM", "URGENT_ACTION", "SAFETY_RESOURCE"), ("SAFETY_RESOURCE", "URGENT_ACTION", "SAFETY_RESOURCE"), ("CONDITION", "HAS_DIAGNOSTIC_CRITERION", "DIAGNOSTIC_CRITERION"),
    ("CONDITION", "HAS_SPECIFIER", "SPECIFIER"), ("CONDITION", "HAS_RISK_FACTOR", "RISK_FACTOR"), ("CONDITION", "HAS_RISK_FACTOR", "DEMOGRAPHIC"), ("CONDITION", "HAS_RISK_FACTOR", "CONDITION"),
    ("CONDITION", "DIFFERENTIAL_DIAGNOSIS", "CONDITION"), ("CONDITION", "COMORBID_WITH", "CONDITION"), ("CONDITION", "HAS_COURSE", "COURSE_FEATURE"), ("CONDITION", "HAS_PREVALENCE", "PREVALENCE_STATEMENT"),
]
FRAGMENTS = "COMBINATION VARIOUS MULTIPLE SEVERAL LIFELONG ONGOING CONTINUED ADDITIONAL APPROACH OPTION STRATEGY PROGRAM INTERVENTION MANAGEMENT SUPPORT SERVICES CARE HELP FACTOR FACTORS ISSUE ISSUES SYMPTOM SYMPTOMS CONDITION CONDITIONS TREATMENT TREATMENTS MEDICATION MEDICATIONS INFORMATION TOPIC ASPECT THING THINGS LEVEL LEVELS".split()
GRAPH_STOP_WORDS = "OF AND OR THE A AN WITH FOR IN TO".split()
GENERIC_NAMES = [
    "DISORDER", "CONDITION", "CRITERION", "SPECIFIER", "DIAGNOSTIC CRITERION", "PREVALENCE", "PREVALENCE STATEMENT", "GLOBAL PREVALENCE", "NEURODEVELOPMENTAL DISORDER",
    "COMMUNICATION DISORDER", "MOOD DISORDER", "MENTAL DISORDER", "AFFECTIVE DISORDER", "COMORBID DISORDER", "ANOTHER DISORDER", "GENERALIZED DISORDER", "UNSPECIFIED DISORDER",
    "SEXUAL DISORDER", "LEARNING DISORDER", "NEUROLOGICAL DISORDER", "NEUROCOGNITIVE DISORDER",
]
LOW_SIGNAL_NAMES = [
    "ABILITY TO FUNCTION", "ADVERSE CIRCUMSTANCES", "BRAIN STRUCTURE AND FUNCTION", "COMMUNICATION SKILLS", "DIAGNOSTIC EVALUATION", "DISABILITY",
    "GUIDANCE ON COMMUNITY MENTAL HEALTH SERVICES", "LIFE SKILLS", "MEDICINES", "MHGAP HUMANITARIAN INTERVENTION GUIDE", "MHGAP PROGRAMME", "QUALITYRIGHTS INITIATIVE",
    "SCREENING FOR AUTISM", "SOCIAL SKILLS", "STIGMA", "STRENGTHS", "VIRUSES", "WHO SPECIAL INITIATIVE FOR MENTAL HEALTH",
]
LOW_SIGNAL_PART = "MENTAL HEALTH GAP ACTION PROGRAMME"
LOW_SIGNAL_SYMPTOMS = ["DEATH FROM SUICIDE", "FUNCTIONAL IMPAIRMENT", "MOOD STATES", "PHYSICAL HEALTH PROBLEM", "QUALITY OF LIFE", "SUICIDAL THOUGHT", "SUICIDE ATTEMPTS"]
FORBIDDEN_NAMES = "SYMTOM SYMPOM DEMOCRAPHIC SUBJECT OBJECT CONDITION SYMPTOM TREATMENT DEMOGRAPHIC ENTITY BEHAVIOR DEVELOPMENT SUPPORT SERVICES TREATMENTS SYMPTOMS MEDICATION SAFETY_RESOURCE".split()
STRENGTH_WORDS = {"very weak": 2, "weak": 3, "low": 3, "mild": 4, "medium": 5, "moderate": 5, "average": 5, "fairly strong": 7, "strong": 8, "high": 8, "very strong": 9, "extremely strong": 10}
STOPWORDS = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all both each few more most other some such no nor not only own same so than too very can will just should now".split()
QUERY_STOPWORDS = [*STOPWORDS, *"symptom symptoms condition conditions disorder disorders could might may would treated treatment".split()]
TOKEN_STOPWORDS = "the a an and or of to for in on with is are was were be by that this it as at from what which who how".split()
KEYWORD_STOPWORDS = [*TOKEN_STOPWORDS, *"symptom symptoms condition conditions disorder disorders could might would used".split()]
DOMAIN_KEYWORDS = "depression anxiety ptsd trauma bipolar stress autism asd adhd mood disorder mental health therapy treatment symptom criteria criterion specifier specifiers risk factor factors differential diagnosis comorbidity comorbid course prevalence epidemiology panic ocd schizophrenia psychosis phobia sad seasonal affective perinatal postpartum fatigue insomnia hypersomnia hallucination delusion".split()
SYMPTOM_PATTERNS = ["i feel", "i am feeling", "i've been feeling", "i have", "i've had", "i am having", "i'm having", "i'm experiencing", "i have been experiencing", "i'm suffering", "i have been suffering", "what could this be", "what could this possibly be", "what might this be", "what could it be", "could this be", "does this sound like"]
FOLLOW_UPS = ["and i", "also", "plus", "in addition", "another symptom", "more recently", "lately", "as well"]
CUE_WORDS = "appetite concentrate concentrating eat eating energy exhausted fatigue hopeless hungry irritable lost numb panic sad sadness sleep sleeping tired tiredness worry worried".split()
# Everyday phrases for symptoms, the preferred name first.
PHRASE_ALIASES = {
    "TIRED": ["FATIGUE", "TIREDNESS", "EASILY FATIGUED"], "TIRED ALL THE TIME": ["FATIGUE", "TIREDNESS", "EASILY FATIGUED"], "LOW ENERGY": ["FATIGUE", "TIREDNESS"],
    "EXHAUSTED": ["FATIGUE", "TIREDNESS", "EASILY FATIGUED"], "LOST MY APPETITE": ["LOSS OF APPETITE", "POOR APPETITE"], "LOST APPETITE": ["LOSS OF APPETITE", "POOR APPETITE"],
    "NO APPETITE": ["LOSS OF APPETITE", "POOR APPETITE"], "LOSS OF APPETITE": ["LOSS OF APPETITE", "POOR APPETITE"], "POOR APPETITE": ["POOR APPETITE", "LOSS OF APPETITE"],
    "CANT SLEEP": ["DISTURBED SLEEP", "SLEEP PROBLEM", "INSOMNIA"], "CAN T SLEEP": ["DISTURBED SLEEP", "SLEEP PROBLEM", "INSOMNIA"], "TROUBLE SLEEPING": ["DISTURBED SLEEP", "SLEEP PROBLEM", "INSOMNIA"],
    "CANNOT SLEEP": ["DISTURBED SLEEP", "SLEEP PROBLEM", "INSOMNIA"], "TROUBLE CONCENTRATING": ["TROUBLE CONCENTRATING", "DIFFICULTY CONCENTRATING"],
    "CANT CONCENTRATE": ["TROUBLE CONCENTRATING", "DIFFICULTY CONCENTRATING"], "LOST INTEREST": ["LOSS OF INTEREST"], "NO INTEREST": ["LOSS OF INTEREST"],
    "FEELING SAD": ["SADNESS", "DEPRESSED MOOD"], "FEEL SAD": ["SADNESS", "DEPRESSED MOOD"], "DOWN ALL THE TIME": ["DEPRESSED MOOD", "SADNESS"],
}
# Parts of questions that compare, and of those that tell of symptoms.
COMPARISON_PARTS = ["difference between", "compare", "vs", "versus", "distinguish"]
SYMPTOM_PARTS = ["i have", "i feel", "i am feeling", "i'm feeling", "experiencing", "suffering from", "what could", "what might", "lost my appetite", "can't sleep", "cant sleep", "trouble sleeping"]
# Words of questions by intent, and the relations each asks for.
INTENTS = [
    ("diagnostic_criteria", ["diagnostic criteria", "criteria", "criterion"], ["HAS_DIAGNOSTIC_CRITERION"]),
    ("specifiers", ["specifier", "specifiers", "subtype", "subtypes"], ["HAS_SPECIFIER"]),
    ("risk_factors", ["risk factor", "risk factors", "prognostic factor", "prognostic factors"], ["HAS_RISK_FACTOR"]),
    ("differential_diagnosis", ["differential diagnosis", "differentiate", "distinguish"], ["DIFFERENTIAL_DIAGNOSIS"]),
    ("comorbidity", ["comorbidity", "comorbid", "co-occur", "co occur", "cooccur"], ["COMORBID_WITH"]),
    ("course", ["development and course", "course", "onset", "progression"], ["HAS_COURSE"]),
    ("prevalence", ["prevalence", "incidence", "how common", "epidemiology", "sex ratio"], ["HAS_PREVALENCE"]),
    ("treatment", ["treated", "treatment", "treatments", "medication", "medications", "used for", "help with", "helps with"], ["TREATED_BY", "PRESCRIBES"]),
    ("symptoms", ["symptom", "symptoms", "signs"], ["HAS_SYMPTOM"]),
]
# Words of sections by relation.
SECTION_HINTS = {
    "HAS_SYMPTOM": ["diagnostic criteria", "diagnostic features", "associated features", "symptoms", "symptom", "clinical features"],
    "HAS_DIAGNOSTIC_CRITERION": ["diagnostic criteria", "criterion", "criteria"], "HAS_SPECIFIER": ["specifier", "specifiers", "severity", "with ", "without "],
    "HAS_RISK_FACTOR": ["risk and prognostic factors", "risk factor", "risk factors", "temperamental", "genetic and physiological", "environmental"],
    "DIFFERENTIAL_DIAGNOSIS": ["differential diagnosis", "differentiate", "distinguish", "rule out"],
    "COMORBID_WITH": ["comorbidity", "co-occur", "co occur", "comorbid", "associated with"],
    "HAS_COURSE": ["development and course", "course", "onset", "progression", "remission", "chronic"],
    "HAS_PREVALENCE": ["prevalence", "incidence", "lifetime prevalence", "12-month prevalence", "sex ratio", "how common"],
}
# Words of clinical prose.
CLINICAL_SIGNALS = ["associated features", "associated with", "behavior", "behavioral", "clinical", "comorbid", "comorbidity", "consequences", "criterion", "criteria", "development and course", "development", "diagnosis", "diagnostic", "differential diagnosis", "disorder", "duration", "episodes", "features", "functional consequences", "functional impairment", "impairment", "mental disorder", "onset", "pattern", "prevalence", "presentation", "prognosis", "psychotherapy", "risk and prognostic", "risk factor", "severity", "specifier", "specifiers", "subtype", "suicidal", "suicide", "symptom", "symptoms", "treatment"]
# Phrases of headers whose sections go.
DISCARD_PHRASES = ["acknowledgment", "acknowledgements", "advisors", "alphabetical listing", "american psychiatric association", "appendix", "assembly", "board of trustees", "british library cataloguing in publication data", "cautionary statement", "chairs", "classification", "contributors", "contents", "copyright", "course specifiers and glossary", "cross cutting review group", "cross cutting review groups", "dsm 5 basics", "dsm 5 classification", "dsm 5 research group", "dsm 5 task force", "dsm 5 tr chairs", "dsm steering committee", "editorial and coding consultants", "ethnoracial equity and inclusion work group", "foreword", "glossary", "highlights of changes", "index", "introduction", "library of congress cataloging in publication data", "numerical listing", "officers", "office of the medical director", "preface", "review committees", "review groups", "reviewers", "section editor", "staff", "study groups", "suggested readings", "task force", "use of the manual", "work group", "work groups"]
# Headers that are titles, and acronyms of sources.
TITLE_HEADERS = ["diagnostic and statistical manual of mental disorders", "dsm 5 tr", "dsm 5"]
SOURCE_ACRONYMS = {"adhd": "ADHD", "asd": "ASD", "dsm": "DSM", "nimh": "NIMH", "ocd": "OCD", "ptsd": "PTSD", "who": "WHO"}
# Patterns of questions that ask for information, and of the first person.
INFORMATIONAL = [r"^\s*what\s+is\s+", r"^\s*what\s+are\s+", r"^\s*define\s+", r"^\s*explain\s+", r"^\s*tell\s+me\s+about\s+", r"^\s*how\s+common\s+is\s+", r"^\s*what\s+are\s+the\s+(symptoms|criteria|risk factors|treatments)\s+of\s+"]
FIRST_PERSON = [r"\bi\b", r"\bme\b", r"\bmy\b", r"\bmyself\b", r"\bi'm\b", r"\bi am\b", r"\bi've\b", r"\bi have\b"]
# Patterns of crises, and who helps.
CRISIS_SIGNALS = {
    "explicit_self_harm_intent": [r"\bkill(?:ing)? myself\b", r"\bend(?:ing)? my life\b", r"\bcommit(?:ting)? suicide\b", r"\bsuicidal\b", r"\bsuicide\b", r"\bharm(?:ing)? myself\b", r"\bhurt(?:ing)? myself\b", r"\bself[- ]?harm\b", r"\bdo not want to live\b", r"\bdont want to live\b", r"\bdon't want to live\b", r"\bcan'?t go on\b", r"\bcannot go on\b", r"\bno way? ?to live\b", r"\bwant(?:ing)? to die\b", r"\bwish(?:ed)? i were dead\b", r"\bbetter off dead\b", r"\bend it all\b", r"\bend(?:ing)? it all\b"],
    "imminence_or_plan": [r"\btonight\b", r"\bright now\b", r"\btoday\b", r"\bthis evening\b", r"\bplan to\b", r"\bplanning to\b", r"\bgoing to\b", r"\boverdose\b", r"\bpills\b", r"\bgun\b", r"\brope\b", r"\bknife\b", r"\bjump off\b"],
    "severe_distress": [r"\bcan'?t go on\b", r"\bcannot go on\b", r"\bno reason to live\b", r"\bnot safe\b", r"\babout to\b", r"\bneed help now\b", r"\bhit rock bottom\b", r"\bworthless\b", r"\bhopeless\b", r"\bempty\b", r"\bgive up\b", r"\bno point\b", r"\bnot worth\b"],
}
CRISIS_RESOURCES = [("988 Suicide & Crisis Lifeline", "Call or text 988", "https://988lifeline.org"), ("Crisis Text Line", "Text HOME to 741741", "https://www.crisistextline.org"), ("Emergency services", "Call 911 or go to the nearest emergency department", "")]
GENERAL_SECTION = "General Section"
# Patterns of page numbers, placeholders of pictures, list lines and codes of diagnoses.
ROMAN = r"(?i)^[ivxlcdm]+$"
MARKER = r"(?i)^(?:page\s+)?(?:\d+|[ivxlcdm]+|[a-z]?\d+)$"
PICTURE = r"(?i)^\*\*(?:==> picture .* omitted <==|----- (?:Start|End) of picture text -----)\*\*(?:<br>)?$"
LIST_LINE = r"^\s*(?:[-*•]|\d+\.|[A-Z]\.|[a-z]\)|\([a-z]\))\s+"
ICD = r"\b[A-TV-Z][0-9][0-9AB](?:\.[A-Z0-9]{1,4})?\b"


@dataclass(frozen=True)
class Ontology:
    """What the graph operators need to know of a domain."""

    priority: dict[str, int] = field(default_factory=lambda: TYPE_PRIORITY)
    triples: list[tuple[str, str, str]] = field(default_factory=lambda: TRIPLES)
    forbidden: list[str] = field(default_factory=lambda: FORBIDDEN_NAMES)


CLINICAL = Ontology()
