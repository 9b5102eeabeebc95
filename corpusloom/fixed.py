"""Fixed values of the data model: formats, word lists and patterns that results depend on.

They are stated here as they are, in their natural order, and used nowhere but by name.
"""

# --- fixed values: chunking presets, (pattern, level) in order of precedence within a level ---
GENERIC_PRESET = (
    (r"^[ \t]*(?:Section|Article)\s+\d+", 1),
    (r"^[ \t]*\d+\.\d+\.\d+", 3),
    (r"^[ \t]*\d+\.\d+", 2),
    (r"^[ \t]*\d+\.", 1),
    (r"^[ \t]*\(\w+\)", 3),
)
ACTS_PRESET = (
    (r"^[ \t]*(?:Chapter|Part)\s+[IVXLCDM\d]+", 1),
    (r"^[ \t]*(?:Section)\s+\d+[A-Z]?", 2),
    (r"^[ \t]*\(\d+\)", 3),
    (r"^[ \t]*\([a-z]\)", 4),
    (r"^[ \t]*\([ivx]+\)", 5),
)
STRICT_ACTS_PRESET = (
    (r"^[ \t]*(?i:Chapter|Part)\s+[IVXLCDM\d]+\b(?![,;])(?!.*\bsec(?:tion)?\b)", 1),
    (r"^[ \t]*\d+[A-Z]?\.(?![ \t]+\d+(?!\[))(?![ \t]+(?:Subs|Ins|Rep|Added|Omitted by|Substituted|Inserted|Repealed|Renumbered|Amended|Vide)\.?\b)", 2),
    (r"^[ \t]*(?:Section)\s+\d+[A-Z]?", 2),
    (r"^[ \t]*\(\d+\)", 3),
    (r"^[ \t]*\([a-z]\)", 4),
    (r"^[ \t]*\([ivx]+\)", 5),
)
CONSTITUTION_PRESET = (
    (r"^[ \t]*(?:Part|Schedule)\s+[IVXLCDM]+[A-Z]?", 1),
    (r"^[ \t]*(?:Article)\s+\d+[A-Z]?", 2),
    (r"^[ \t]*\(\d+\)", 3),
    (r"^[ \t]*\([a-z]\)", 4),
)
APPENDIX_CONSTITUTION_PRESET = (
    (r"(?i)^[ \t]*Appendix\s+[IVXLCDM]+[A-Z]?\s*$", 0),
    (r"(?i)^[ \t]*(?:(?:Part|Schedule)\s+[IVXLCDM]+[A-Z]?|[a-z]+\s+Schedule)", 1),
    (r"^[ \t]*(?:Article)\s+\d+[A-Z]?", 2),
    (r"^[ \t]*\d+[A-Z]?\.", 2),
    (r"^[ \t]*\(\d+\)", 3),
    (r"^[ \t]*\([a-z]\)", 4),
)
CONTRACTS_PRESET = (
    (r"^[ \t]*[Aa]rticle\s+[IVXLCDM]+\b", 1),
    (r"^[ \t]*[A-Z][A-Z\s]{4,}[A-Z]\b", 1),
    (r"^[ \t]*(?:Section|§)\s+\d+", 2),
    (r"^[ \t]*\d+\.\d+(?:\.\d+)*", 3),
    (r"^[ \t]*\([a-z]\)", 4),
)
JUDGMENTS_PRESET = (
    (r"^[ \t]*\d+\.", 1),
    (r"^[ \t]*\([a-z]\)", 2),
)
PRESETS = {
    "generic": GENERIC_PRESET,
    "acts": ACTS_PRESET,
    "acts_strict": STRICT_ACTS_PRESET,
    "constitution": CONSTITUTION_PRESET,
    "constitution_appendix": APPENDIX_CONSTITUTION_PRESET,
    "contracts": CONTRACTS_PRESET,
    "judgments_structured": JUDGMENTS_PRESET,
}
#: Headings whose whole line is the heading.
NAMED_HEADINGS = ("Section", "Article", "Chapter", "Part", "Schedule")

# --- fixed values: summaries ---
SUMMARY_SEPARATOR = "\n\n[Document summary]\n"
SUMMARY_MAX_CHARS = 150
TYPE_HINTS = ("agreement", "contract", "non-disclosure", "confidentiality", "nda", "licen", "employment", "purchase", "lease", "privacy policy")
GENERIC_QUOTED = (
    "agreement", "the agreement", "this agreement", "contract", "the contract", "party", "the party", "the parties", "parties",
    "confidential information", "effective date", "termination", "the termination", "the employee", "the employer", "document", "the document", "shall", "secret",
)
YEAR_PATTERN = r"\b(1[89]\d{2}|20\d{2})\b"
TITLE_PATTERN = r"\b(?:act|code)\b"
COURT_PATTERN = r"supreme court|high court"
VERSUS_PATTERN = r"([A-Z][A-Za-z ]{2,40}?)\s+[Vv](?:s\.?|ersus)\s+([A-Z][A-Za-z ]{2,40})"

# --- fixed values: citations, in output order ---
AIR_PATTERN = r"\bAIR\s+\d{4}\s+[A-Z]{2,6}\s+\d+\b"
SCC_BRACKET_PATTERN = r"\(\d{4}\)\s+\d+\s+SCC\s+\d+"
SCC_PATTERN = r"(?<!\()\b\d{4}\s+SCC\s+\d+\b"
SCR_PATTERN = r"\b\d{4}\s+SCR\s+\d+\b"
INSC_PATTERN = r"\b\d{4}\s+INSC\s+\d+\b"
SECTION_OF_ACT_PATTERN = r"\b[Ss]ection\s+(\d+[A-Z]?)\s+of\s+(?:the\s+)?([A-Z][A-Za-z ]{2,60}?(?:Act|Code|Rules|Regulations|Order))\b"
SECTION_SHORT_PATTERN = r"\b[Ss]ection\s+(\d+[A-Z]?)\s+([A-Z]{2,6})\b"
ARTICLE_PATTERN = r"\b[Aa]rticle\s+(\d+[A-Z]?)(?:\s*\((\d+)\))?"
SCHEDULE_PATTERN = r"\b[Ss]chedule\s+([IVXLCDM]+|\d+)\b"
CLAUSE_PATTERN = r"\b[Cc]lause\s+(\d+(?:\.\d+)*)\b"
INTERNAL_REF_PATTERN = r"\b(Exhibit|Schedule|Annexure|Appendix)\s+([A-Z0-9IVXLCDM]+)\b"
CITATION_CATEGORIES = ("judgments", "contracts")

# --- fixed values: references in queries ---
ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Twelfth")
REFERENCE_TYPES = ("Entry", "Article", "Section", "Part", "Chapter", "Schedule")
REFERENCE_VALUE = r"[IVXLCDM\d]+[A-Z]?"

# --- fixed values: query classes and rewriting ---
ACTOR_PATTERN = (
    r"^(?:if |suppose |in a scenario where |assume )?(?:a|an|the|my|our|two) "
    r"(?:person|company|employee|employer|man|woman|landlord|tenant|buyer|seller|contractor|police officer|doctor|driver|patient)\b"
)
PERSONAL_PATTERN = r"\b(my landlord|my employer|my boss|my neighbor|my tenant|my company|i was|i signed|i got|we were)\b"
NARRATIVE_PATTERN = (
    r"\b(terminated|signed|complained|threatened|refused|failed to|entered into|sued|caused|kept in custody|assaulted|stole|fired|breached|forced|agreed|arrested|harassed)\b"
)
ADVICE_PATTERN = (
    r"(?:what legal remedy|what legal rights|can (?:the|they|he|she|i|we)|is this (?:legal|valid)|"
    r"what (?:are|is) the (?:liability|consequences|punishment)|what can i do|can i sue)\b"
)
STOP_WORDS = (
    "a", "an", "the", "my", "our", "person", "company", "man", "woman", "what", "is", "are", "was", "were", "can", "may", "be", "available", "apply",
    "after", "being", "for", "several", "days", "and", "in", "with", "without", "about", "it", "this", "do", "does", "did", "to", "of", "on",
)
CONCEPTS = (
    ("threatened with violence", "threat violence coercion duress"),
    ("without being produced before a magistrate", "failure to produce before magistrate"),
    ("without notice", "lack of notice"),
    ("terminated an employee", "termination employee"),
    ("complained about discrimination", "discrimination complaint"),
    ("arrested", "arrest"),
    ("signed a contract", "contract validity"),
    ("kept in custody", "custody detention"),
)

# --- fixed values: embedding prefixes, fingerprints, fusion ---
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "
RRF_K = 60
MMR_LAMBDA = 0.7
STRUCTURAL_BOOST, HIERARCHY_BOOST, CITATION_BOOST = 0.1, 0.05, 0.05
FETCH_FACTOR = 5
FEDERATED_TOP = 8
RELATED_TOP = 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EXCERPT_CHARS = 1500
PDF_WIDTH, PDF_LINES = 92, 52
QUESTION_MAX_CHARS = 2000
CONSTITUTION_SUMMARY_TEXT = "Constitution of India — supreme law of the land"
CONSTITUTION_DOC = "Constitution of India"

# --- fixed values: messages of responses ---
REPORT_FOOTER = "Labels are checked for form and for naming a passage above, not for whether the passage bears the statement out. For information only."
SUPPORT_LIMITATION = "Citation labels were checked against the supplied passages; substantive legal support for each claim has not been verified."
ADVICE_LIMITATION = "This response is general legal information, not legal advice or a guarantee of any outcome. Consult a qualified lawyer for your situation."
NO_EVIDENCE_LIMITATION = "No supporting passages were retrieved from the indexed corpus, so the answer is not evidence-grounded."
NO_TEXT_LIMITATION = "Passages were retrieved but their full text could not be loaded, so no grounded answer was produced."
EMPTY_ANSWER_WARNING = "The answer is empty."
NO_CITATION_WARNING = "The answer contains no source citations."
UNKNOWN_LABEL_WARNING = "The answer references source labels not supplied to the prompt: "
UNVERIFIED_WARNING = "Citation labels are valid, but substantive support for each legal claim has not been verified."
NO_EVIDENCE_PROMPT = "There are no passages for this question. Say that the evidence does not reach, and leave the answer open."
NO_TEXT_PROMPT = "Entries were found for this question, but their texts are empty. Say that the evidence does not reach, and leave the answer open."
NO_EVIDENCE_ANSWER = "The indexed texts have no passage on this question, so it stays unanswered here."
NO_TEXT_ANSWER = "Entries on this question were found, but not their texts, so it stays unanswered until these can be read."
ANSWER_INSTRUCTION = "Answer from the passages alone and by the rules given before. Put the label of a passage, as it is written above, behind what rests on it. Name what the passages leave open."
