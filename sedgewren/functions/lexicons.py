"""Word lists of the lexicon features."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on these very words.

ANXIETY_TERMS = (
    "anxiety", "anxious", "anxiously", "panic", "panicking", "panicked", "worry", "worrying", "worried", "worries", "nervous", "nervousness",
    "scared", "afraid", "fear", "fearful", "stress", "stressed", "stressful", "overwhelmed", "overwhelming", "edge", "restless",
    "racing thoughts", "racing heart", "intrusive thoughts", "tense", "tension", "dread", "dreading", "agoraphobia", "agoraphobic",
    "hyperventilate", "hyperventilating", "shaking", "trembling", "trembled", "freaking out", "freak out", "spiral", "spiraling", "catastrophize",
    "catastrophizing", "ruminating", "rumination",
)

ANXIETY_PHRASES = (
    "panic attack", "anxiety attack", "on edge", "racing thoughts", "can't breathe", "cant breathe", "heart racing", "chest tight", "tight chest",
    "what if", "i'm worried", "im worried", "i can't stop", "cant stop worrying",
)

HEALTH_ANXIETY_TERMS = (
    "hypochondria", "hypochondriac", "health anxiety", "illness anxiety", "googled my symptoms", "googling symptoms", "googled symptoms",
    "google symptoms", "webmd", "dr google", "checking pulse", "took my pulse", "felt my pulse", "checking heart rate", "self-diagnose",
    "self-diagnosing", "self diagnosed", "convinced i have", "convinced i'm dying", "convinced im dying", "doctor said i'm fine",
    "doctors say i'm fine", "tests came back normal", "labs were normal", "ekg was normal", "mri was clear", "ct scan", "ct scan was",
    "blood work was", "blood test was", "lump", "tumor", "tumour", "cancer", "stroke", "heart attack", "aneurysm", "blood clot", "embolism",
    "pulmonary embolism", "als", "ms", "multiple sclerosis", "lupus", "leukemia", "lymphoma", "hiv", "aids", "rabies", "meningitis", "sepsis",
    "appendicitis", "twinge", "tingling", "numbness", "lightheaded", "lightheadedness", "dizzy", "dizziness", "shortness of breath", "chest pain",
    "palpitations", "tremor", "twitch", "twitching", "muscle twitch", "rash", "lesion", "mole", "headache", "migraine",
)

HEALTH_ANXIETY_PHRASES = (
    "am i dying", "is this cancer", "is this a tumor", "is this a heart attack", "do i have", "could this be", "is this serious",
    "should i go to the er", "should i go to the hospital", "monitoring my symptoms", "checking my symptoms", "scared it's", "terrified i have",
    "spent hours googling", "won't accept", "can't accept the test results", "doctors keep telling me", "second opinion", "third opinion",
)

REASSURANCE_PATTERNS = (
    "please tell me", "please reassure me", "tell me i'm okay", "tell me im okay", "is this normal", "anyone else", "has anyone had",
    "did anyone", "should i be worried", "am i overreacting",
)

DEPRESSION_TERMS = (
    "depressed", "depression", "depressing", "hopeless", "hopelessness", "worthless", "worthlessness", "empty", "numb", "numbness", "anhedonia",
    "no pleasure", "lost interest", "exhausted", "fatigue", "tired all the time", "no energy", "can't get out of bed", "cant get out of bed",
    "slept all day", "crying", "crying spells", "no point", "pointless", "meaningless", "useless", "lonely", "loneliness", "isolated",
    "isolation",
)

SUICIDALITY_TERMS = (
    "suicide", "suicidal", "kill myself", "killing myself", "end my life", "ending my life", "end it all", "want to die", "wish i was dead",
    "wish i were dead", "better off dead", "no reason to live", "no point living", "self harm", "self-harm", "selfharm", "cutting myself",
    "overdose", "od'd", "took pills",
)

FIRST_PERSON_SINGULAR = (
    "i", "me", "my", "mine", "myself", "i'm", "im", "i've", "ive",
)

FIRST_PERSON_PLURAL = (
    "we", "us", "our", "ours", "ourselves",
)

SECOND_PERSON = (
    "you", "your", "yours", "yourself", "yourselves",
)

THIRD_PERSON = (
    "he", "she", "they", "them", "their", "theirs", "him", "her", "his", "hers",
)

UNCERTAINTY_TERMS = (
    "maybe", "perhaps", "might", "could", "possibly", "probably", "i think", "i guess", "i suppose", "not sure", "unsure", "what if", "wonder",
    "wondering",
)

CERTAINTY_TERMS = (
    "definitely", "certainly", "absolutely", "always", "never", "completely", "totally", "exactly", "i'm sure", "im sure", "i know", "obviously",
)

BODY_PARTS = (
    "heart", "chest", "lung", "lungs", "stomach", "abdomen", "head", "brain", "neck", "throat", "skin", "arm", "arms", "leg", "legs", "back",
    "spine", "kidney", "liver", "thyroid", "lymph", "node", "nodes", "breast", "testicle", "ovary", "uterus", "blood", "vein", "artery", "muscle",
    "muscles", "joint", "joints", "nerve", "nerves",
)

# The seven dimensions, their terms one a line.
DIMENSIONS = {
    "illness_worry": (
        "health anxiety", "illness anxiety", "hypochondria", "hypochondriac", "worried about my health", "preoccupied", "obsessed with my health",
        "anxious about my health", "fixated on",
    ),
    "bodily_vigilance": (
        "twinge", "tingling", "numbness", "lightheaded", "dizzy", "dizziness", "palpitations", "tremor", "twitch", "twitching", "shortness of breath",
        "chest pain", "every sensation", "aware of my body", "notice every", "checking pulse", "took my pulse", "felt my pulse",
        "checking heart rate",
    ),
    "serious_illness_fear": (
        "cancer", "tumor", "tumour", "stroke", "heart attack", "aneurysm", "blood clot", "embolism", "als", "multiple sclerosis", "lupus", "leukemia",
        "lymphoma", "sepsis", "meningitis", "convinced i have", "convinced i'm dying", "convinced im dying", "am i dying", "is this cancer",
        "terrified i have", "scared it's", "serious illness", "dying",
    ),
    "symptom_checking": (
        "googled my symptoms", "googling symptoms", "googled symptoms", "google symptoms", "webmd", "dr google", "spent hours googling",
        "self-diagnose", "self-diagnosing", "self diagnosed", "monitoring my symptoms", "checking my symptoms", "researching",
    ),
    "reassurance_seeking": (
        "please tell me", "please reassure me", "tell me i'm okay", "tell me im okay", "is this normal", "anyone else", "has anyone had",
        "did anyone", "should i be worried", "am i overreacting", "reassure me", "reassurance",
    ),
    "difficulty_reassured": (
        "tests came back normal", "labs were normal", "ekg was normal", "mri was clear", "blood work was", "doctor said i'm fine",
        "doctors say i'm fine", "can't accept the test results", "won't accept", "don't believe the doctor", "second opinion", "third opinion",
        "but i still",
    ),
    "medical_help_seeking": (
        "should i go to the er", "should i go to the hospital", "doctors keep telling me", "ct scan", "blood test", "went to the er", "urgent care",
        "emergency room", "made an appointment", "saw a specialist", "doctors appointment",
    ),
}

@dataclass(frozen=True)
class Lexicons:
    """The word sets that features and weak labels read. Callers may pass their own."""

    anxiety_terms: tuple[str, ...] = field(default=ANXIETY_TERMS)
    anxiety_phrases: tuple[str, ...] = field(default=ANXIETY_PHRASES)
    health_terms: tuple[str, ...] = field(default=HEALTH_ANXIETY_TERMS)
    health_phrases: tuple[str, ...] = field(default=HEALTH_ANXIETY_PHRASES)
    reassurance: tuple[str, ...] = field(default=REASSURANCE_PATTERNS)
    depression_terms: tuple[str, ...] = field(default=DEPRESSION_TERMS)
    suicidality_terms: tuple[str, ...] = field(default=SUICIDALITY_TERMS)
    first_singular: tuple[str, ...] = field(default=FIRST_PERSON_SINGULAR)
    first_plural: tuple[str, ...] = field(default=FIRST_PERSON_PLURAL)
    second_person: tuple[str, ...] = field(default=SECOND_PERSON)
    third_person: tuple[str, ...] = field(default=THIRD_PERSON)
    uncertainty: tuple[str, ...] = field(default=UNCERTAINTY_TERMS)
    certainty: tuple[str, ...] = field(default=CERTAINTY_TERMS)
    body_parts: tuple[str, ...] = field(default=BODY_PARTS)
