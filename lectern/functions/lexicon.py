"""Fixed word lists, phrases and patterns.

Everything in this module is a fixed value: results depend on these exact entries.
Functions elsewhere take them as default arguments, so a job can pass its own.
"""

# --- fixed values: stop words -------------------------------------------------

KEY_TERM_STOP_WORDS = (
    "the a an is are was were be been being "
    "to of and or in on at for with by "
    "from as this that it its their your my "
    "should would could must will can may"
).split()

CONCEPT_STOP_WORDS = (
    "the a an is are was were be been being "
    "to of and or in on at for with by "
    "from as this that it its their your my "
    "should would could must will can may have "
    "has had do does did what which who when "
    "where why how first then next before after "
    "during while patient scene ems emr emt "
    "appropriate correct proper identify describe "
    "explain understand recognize select determine"
).split()

ANSWER_STOP_WORDS = (
    "the a an is are was were be been being "
    "to of and or in on at for with by "
    "from as this that it its their your my "
    "should would could must will can may first "
    "then next before after when while during"
).split()

ALIGNMENT_STOP_WORDS = (
    "that this with from have been were they will "
    "would could should about their when what which "
    "more some such into than most also just only "
    "each other after before during between through "
    "being both same very must can able need does"
).split()

LOCK_STOP_WORDS = (
    "that this with from have been will would could should about their when what which"
).split()
FACTOR_STOP_WORDS = (
    "that this with from have been will would makes answer correct option because"
).split()
TARGET_STOP_WORDS = "that this with from about".split()
QUERY_STOP_WORDS = "that this with from about should would".split()

# --- fixed values: sentence and chunk cues -------------------------------------

RELEVANCE_ACTION_VERBS = (
    "should must ensure verify check assess perform establish maintain monitor provide administer"
).split()
RELEVANCE_PRIORITY_WORDS = "first priority before critical immediate".split()
ANCHOR_ACTION_WORDS = "should must ensure always never important".split()

QUOTE_ACTION_PATTERN = (
    r"\b(?:should|must|ensure|always|never|requires?|important|critical|essential"
    r"|priority|first|before|after)\b"
)
QUOTE_FACTUAL_PATTERN = (
    r"\b(?:is defined as|refers to|means|is a|is an|is the|are\s+(?:a|an|the)"
    r"|includes?|consists? of)\b"
)
QUOTE_PROCEDURAL_PATTERN = (
    r"\bstep\s+\d+\b|\b(?:first|then|next|finally),?\s+\w+|\b(?:procedure|protocol|sequence)\b"
)
ANCHOR_FACTUAL_PATTERN = r"\b(?:is|are|was|were)\s+(?:a|an|the|considered|defined)"
DEFINITION_PATTERN = r"\b(?:is|are)\s+(?:a|an|the)\b"

# --- fixed values: claims and evidence -----------------------------------------

CLAIM_TYPE_PATTERNS = (  # a later match replaces an earlier one
    ("procedural", r"\b(?:should|must|requires?|ensures?)\b"),
    ("definition", r"\b(?:is defined as|is a|is an|means|refers to)\b"),
    ("rationale", r"\b(?:because|therefore|thus|since|this is why)\b"),
    ("distractor", r"\b(?:is wrong|is incorrect|incorrect because|wrong because)\b"),
)
CRITICAL_CLAIM_PATTERN = r"\b(?:correct|right|best|appropriate|should)\b"

ALLOWED_INFERENCE_PATTERNS = (
    "is secondary", "should come after", "is not the first", "is not the priority",
    "is less urgent", "is less immediate", "should be done later", "comes after",
    "follows", "is premature", "is delayed",
    "introduces risk", "puts .* at risk", "is unsafe", "is dangerous", "doesn't protect",
    "doesn't address .* hazard", "ignores .* safety", "compromises safety",
    "doesn't address", "doesn't adequately", "is incomplete", "is insufficient",
    "only partially", "fails to address",
    "is not appropriate", "is not indicated", "is outside .* scope", "is not within",
    "exceeds", "is excessive",
    "wrong context", "wrong situation", "different scenario", "not applicable here",
)

SENSORY_PATTERNS = (
    ("sound", r"(\w+ing sound)"),
    ("sound", r"(crackling|popping|sizzling)"),
    ("smell", r"(smell(?:s)? (?:of |like )?\w+)"),
    ("visual", r"(blue|yellow|orange|green) (?:color|flash|glow)"),
)
MEASUREMENT_PATTERNS = (
    r"(\d+)\s*(?:feet|meters|yards|inches)",
    r"(\d+)\s*(?:minutes?|seconds?|hours?)",
    r"(\d+)\s*(?:percent|%)",
)
INFERENCE_ADMISSIONS = (
    "while not explicitly stated", "although not mentioned", "can be inferred",
    "extrapolating from", "generally accepted", "common practice",
    "based on general principles",
)
SOURCE_ADMISSIONS = (
    "chunks don't directly address", "chunks do not directly address",
    "sources don't directly address", "sources do not directly address",
    "not explicitly stated", "not explicitly mentioned", "while not explicitly",
    "although not explicitly", "inferred from general", "inferred from the",
    "no direct evidence", "no explicit evidence", "doesn't directly mention",
    "does not directly mention", "not directly covered", "not directly discussed",
    "extrapolating from", "based on general principles", "common practice suggests",
    "generally accepted that",
)

# --- fixed values: gates --------------------------------------------------------

STEM_NEGATIONS = ("not", "except", "never", "without")
ALSO_CORRECT_PATTERN = (
    r"\balso (?:correct|valid|acceptable)\b|\bcould also be\b|\banother valid\b"
    r"|\beither .+ or .+ (?:is|are) correct\b"
)
EXPLANATION_OPPOSITES = (("should", "should not"), ("must", "must not"), ("always", "never"))
ANSWER_OPPOSITES = (
    ("should", "should not"), ("should not", "should"), ("must", "must not"),
    ("must not", "must"), ("always", "never"), ("never", "always"), ("before", "after"),
    ("first", "last"), ("immediately", "delay"), ("required", "optional"),
    ("safe", "dangerous"), ("correct", "incorrect"),
)
PROCEDURE_OPPOSITES = (
    (r"first.{0,50}assess", r"first.{0,50}treat"),
    (r"before.{0,50}(?:calling|contact)", r"immediately.{0,50}(?:call|contact)"),
)
HOWEVER_PATTERN = r"(?:however|but|although).{0,100}(?:should not|must not|never|incorrect)"
MAIN_CLAIM_PATTERN = r"\bshould\b|\bmust\b|\balways\b"
TOPIC_CATEGORIES = {
    "cpr": "cardiac", "aed": "cardiac", "bleeding": "hemorrhage",
    "fracture": "musculoskeletal", "airway": "respiratory", "breathing": "respiratory",
    "shock": "circulatory", "poison": "toxicology", "medication": "pharmacology",
    "transport": "logistics",
}
FIRST_ACTION_PATTERN = (
    r"\bfirst\b.*\b(?:action|step|thing)\b|\bpriority\b|\binitial\b.*\b(?:action|response)\b"
)
PRIORITY_TARGET_WORDS = ("first", "priority", "initial", "before", "sequence")
META_OPTIONS = ("all of the above", "none of the above", "both a and b")
INFORMAL_PATTERN = (
    r"\b(?:gonna|wanna|gotta|kinda|sorta)\b|\b(?:yeah|yep|nope|ok|okay)\b|\blol\b"
)
EMOJI_PATTERN = "[\\x{1F300}-\\x{1F9FF}]"
DIFFICULTY_LEVELS = {"easy": 1, "medium": 2, "hard": 3}

# --- fixed values: options, plans and distractors --------------------------------

VAGUE_QUALIFIERS = ("most", "best", "appropriate", "possibly", "may", "could", "might")
OPTION_ACTION_VERBS = (
    "assess evaluate check monitor administer provide establish maintain position secure protect"
).split()
FACTOR_VAGUE_PHRASES = (
    "common sense", "everyone knows", "obviously", "general knowledge", "standard practice",
    "always", "typically", "usually", "normally", "in general", "as a rule",
)
PLAN_VAGUE_PHRASES = (
    "common sense", "obviously", "everyone knows", "general knowledge", "standard practice",
    "always", "never", "typical",
)
LOCKED_QUESTION_TYPES = ("first_action", "best_action", "most_important", "priority")
QUESTION_KINDS = LOCKED_QUESTION_TYPES + ("definition", "factual")
LOCK_TYPES = ("feasibility", "authority", "distance", "resource", "sequence", "time")
DISTRACTOR_TAGS = ("unsafe", "wrong_sequence", "out_of_scope", "partial", "common_misconception")
FAILURE_REASONS = (
    "approaches_hazard", "creates_new_hazard", "wrong_sequence", "skips_required_step",
    "premature_action", "exceeds_scope", "requires_unavailable", "contradicts_stem",
    "too_generic", "addresses_wrong_problem",
)
WRONGNESS_PATTERNS = (
    "opposite", "violates_protocol", "common_misconception", "wrong_sequence",
    "wrong_context", "incomplete", "excessive", "delayed",
)
CLEARLY_WRONG_PATTERNS = ("opposite", "violates_protocol")
DISTRACTOR_RULES = {  # difficulty: least clearly wrong, allowed patterns, forbidden patterns
    "beginner": (
        2,
        ("opposite", "violates_protocol", "common_misconception", "incomplete"),
        ("wrong_sequence",),
    ),
    "intermediate": (
        0,
        ("wrong_context", "wrong_sequence", "incomplete", "excessive", "delayed"),
        (),
    ),
    "advanced": (0, ("wrong_sequence",), ("opposite", "violates_protocol")),
}
SEQUENCE_CUES = ("first", "before", "then", "after", "priority", "initial")
SUGGESTION_VERBS = ("assess", "establish", "position", "secure", "administer")
SAFETY_CUES = ("protect", "safety", "hazard", "danger", "secure")
CARTOONISH_PATTERN = (
    r"do nothing|ignore|refuse|leave.*alone|walk away|cover.*with.*blanket"
    r"|move.*wires?.*with.*stick"
)
QUERY_INTENTS = ("high_precision", "synonym_variant", "quote_hunt", "scenario_context")

# --- fixed values: course structure ----------------------------------------------

STAGES = ("exam", "course", "labs", "capsules", "items", "content", "validated")
SEVERITIES = ("passed", "minor", "major", "critical")
SEVERITY_PRIORITY = {"critical": 100, "major": 50, "minor": 10, "passed": 0}
LAB_TYPES = ("guided", "exploratory", "challenge", "simulation")
CAPSULE_TYPES = ("conceptual", "procedural", "case_study", "practice", "review")
NEVER_AUTO_FIXED = ("options_count_valid", "no_duplicate_options", "chunk_ids_present")
