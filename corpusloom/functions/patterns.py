"""The word lists and patterns that results depend on."""

from __future__ import annotations

# German letters and stop words, English stop words.
GERMAN_LETTERS = "äöüßÄÖÜ"
GERMAN_STOPWORDS = """der die das und ist nicht mit für auf im den eine ein zu von als auch sich dem des bei oder
wir sie er es dass wie wird werden kann können über nach vor aus an am um doch nur noch""".split()
ENGLISH_STOPWORDS = """the and is are not with for on in to of a an as also this that these those be was were
can could should would will have has had from by about into over after before only more than""".split()

# What is cut out of extracted text, in any case, line by line.
NOISE = [
    r"Downloaded from https?://[^\s]+",
    r"Wiley Online Library on \[[^\]]+\]",
    r"See the Terms and Conditions \([^\)]+\)",
    r"on Wiley Online Library for rules of use",
    r"OA articles are governed by",
    r"applicable Creative Commons License",
    r"\d{8}, \d{4}, \d+, Downloaded from",
    r"©\s*\d{4}[^.]*\.",
    r"Copyright\s*©?\s*\d{4}[^.]*\.",
    r"All rights reserved\.?",
    r"Creative Commons Attribution",
    r"CC BY[^\s]*",
    r"doi:\s*10\.\d+/[^\s]+",
    r"https?://doi\.org/10\.\d+/[^\s]+",
    r"Received:?\s*\d+\s+\w+\s+\d{4}",
    r"Accepted:?\s*\d+\s+\w+\s+\d{4}",
    r"Published:?\s*\d+\s+\w+\s+\d{4}",
    r"First published:?\s*\d+\s+\w+\s+\d{4}",
    r"^\d+\s*$",
    r"^Page\s+\d+\s+of\s+\d+$",
    r"^\s*\d+\s*\|\s*",
    r"Accessed\s+\d+\s+\w+\s+\d{4}",
    r"https?://www\.jstor\.org/[^\s]+",
    r"JSTOR is a not-for-profit",
    r"Correspondence:?\s*[^\n]+@[^\n]+",
    r"E-?mail:?\s*[^\s]+@[^\s]+",
]

#: What a text needs for one of these to match, in lower case.
NOISE_SIGNS = ["downloaded from", "wiley online library", "see the terms", "oa articles", "applicable creative", "©", "copyright", "all rights reserved",
    "creative commons", "cc by", "doi", "received", "accepted", "published", "page", "|", "accessed", "jstor", "correspondence", "mail"]

# What the cleaner of plain documents cuts out, in any case, line by line.
GENERIC_NOISE = [r"^\d+\s*$", r"^Page\s+\d+", r"Downloaded from", r"©\s*\d{4}"]

# Words that end the lines of authors, and words of affiliations.
AUTHOR_STOPS = "abstract|keywords|introduction|correspondence|received|accepted"
AFFILIATIONS = "university|department|faculty|institute|school|centre|center"

# Signs of academic and of business documents, in lower-cased text.
ACADEMIC = [
    r"\babstract\b",
    r"\bmethodology\b",
    r"\breferences\b",
    r"\bdoi:\s*10\.",
    r"\bintroduction\b.*\bliterature\s+review\b",
    r"\bhypothesis\b",
    r"\bempirical\s+evidence\b",
]
BUSINESS = [
    r"\bexecutive\s+summary\b",
    r"\brecommendations?\b",
    r"\baction\s+items?\b",
    r"\bstakeholders?\b",
    r"\bROI\b",
    r"\bbudget\b",
    r"\bproject\s+plan\b",
    r"\bKPIs?\b",
]

# Lines with these are no titles.
NO_TITLE = [
    "journal of", "volume", "issue", "doi:", "http", "www.", "downloaded", "accepted:", "received:", "published:",
    "copyright", "all rights reserved", "@", "university of", "working paper", "discussion paper", "research paper",
    "page ", "pp.", "issn", "isbn",
]

# Patterns of question complexity.
SIMPLE = [
    r"^what is\b",
    r"^define\b",
    r"^summarize\b",
    r"^summary of\b",
    r"^list\b",
    r"^list papers\b",
    r"^how many\b",
    r"^when did\b",
    r"^who (?:is|are|was|were)\b",
    r"^which (?:paper|author|study)\b",
    r"^explain\b",
    r"^describe briefly\b",
    r"^give (?:me )?(?:a )?(?:brief )?(overview|summary)",
]
MEDIUM = [
    r"^how does\b",
    r"^how do\b",
    r"^how did\b",
    r"^what (?:are|were) the (?:effects?|impacts?|consequences?|results?)\b",
    r"\baffects?\b",
    r"\bimpacts?\b",
    r"\binfluences?\b",
    r"^what factors\b",
    r"^what role\b",
    r"\brole of\b",
    r"^why (?:did|does|do|is|are|was|were)\b",
]
COMPLEX = [
    r"\bcompare\b.*\b(?:and|with|to|versus|vs)\b",
    r"\bcontrast\b",
    r"\bdifferences? between\b",
    r"\bsimilarities? between\b",
    r"\bsynthesize\b",
    r"\bsynthesis\b",
    r"\bcritically (?:analyze|examine|evaluate)\b",
    r"\bevaluate the\b.*\b(?:evidence|literature|research)\b",
    r"\bhow does\b.*\brelate to\b",
    r"\bwhat (?:is|are) the (?:relationship|connection)s? between\b",
    r"\bintegrate\b.*\bfindings\b",
    r"\bacross (?:multiple|different|various)\b",
    r"\bmultiple (?:perspectives|viewpoints|approaches)\b",
    r"\bon one hand\b.*\bon the other\b",
    r"\bpros and cons\b",
    r"\badvantages and disadvantages\b",
    r"\bstrengths and weaknesses\b",
    r"\bover time\b.*\bhow\b",
    r"\bevolution of\b",
    r"\bhistorical (?:development|trajectory|analysis)\b",
]

# Signs of over-generalisation and of a percentage in an answer, in any case.
OVERGENERAL = [
    r"all (?:studies|research|papers|authors|evidence) (?:show|indicate|suggest|demonstrate)",
    r"(?:every|all) researcher",
    r"universal(?:ly)? agree",
    r"(?:always|never) the case",
]
PERCENTAGE = r"([0-9]+(?:\.[0-9]+)?)\s*(?:%|percent|percentage)"

# Plan tiers (documents, knowledge bases, bytes, calls a day; None: unlimited) for the usage report.
PLANS = [("free", 50, 3, 100 * 1024**2, 500), ("pro", 500, 20, 5 * 1024**3, 10_000), ("enterprise", None, None, None, None)]

# Words that test questions leave out.
EVAL_STOPS = """the and for with from into over under between a an of in on at by to as is are was were this that these those study studies analysis
research paper evidence case effects impact aims aim examining investigate intends develop proposes approach method methods results discussion conclusion""".split()

#: Words of page furniture and prose that begin with a capital but are no part of a name; callers pass their corpus's own.
NOT_NAMES = """abstract introduction methods results discussion conclusion references keywords university institute department school
the and for with from this that these those germany german european review study research paper journal volume issue page""".split()

# What a line of a paper, and of a business document, begins with where a section opens, in any case.
SECTION_HEADINGS = {
    "abstract": r"(abstract|summary)[\s:]",
    "introduction": r"(1[\.\s]|introduction|background)[\s:]",
    "methods": r"(\d+[\.\s]*)?(methodology|methods?|data|approach|research design)[\s:]",
    "results": r"(\d+[\.\s]*)?(results?|findings?|analysis|empirical)[\s:]",
    "discussion": r"(\d+[\.\s]*)?(discussion|implications?|interpretation)[\s:]",
    "conclusion": r"(\d+[\.\s]*)?(conclusion|concluding|summary)[\s:]",
}
EXPECTED_SECTIONS = ["abstract", "introduction", "methods", "results", "conclusion"]
BUSINESS_HEADINGS = {
    "executive_summary": r"(executive\s+summary|summary)[\s:\-]",
    "introduction": r"(introduction|background|overview)[\s:\-]",
    "analysis": r"(analysis|findings|results|assessment)[\s:\-]",
    "recommendations": r"(recommendations|proposed\s+actions|next\s+steps)[\s:\-]",
    "conclusion": r"(conclusion|summary|closing)[\s:\-]",
    "appendix": r"(appendix|appendices|attachments)[\s:\-]",
}
EXPECTED_BUSINESS = ["executive_summary", "introduction", "analysis", "conclusion"]

#: Characters of a chunk by section type, and the allowed words of a retrieval plan.
SECTION_SIZES = {"abstract": 1500, "introduction": 2000, "methods": 2000, "results": 2000, "discussion": 2000, "conclusion": 1500}
INTENTS = ["comparative", "synthesis", "factual", "exploratory"]
STRATEGIES = ["single", "multi_query", "expanded"]
