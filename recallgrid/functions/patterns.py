"""Word lists and patterns that decide scores and classes. Patterns are valid for Java, RE2 and Python."""

ERROR_WORDS = r"(?i)\b(error|exception|traceback|failed|failure|bug|crash|broken|timeout|denied|rejected|deprecated)\b"
SUCCESS_WORDS = r"(?i)\b(fixed|resolved|working|success|passed|deployed|completed|shipped|merged|approved)\b"
DECISION_WORDS = r"(?i)\b(decided|chose|switched|migrated|selected|picked|opted)\b"
DESIGN_WORDS = r"(?i)\b(design|pattern|refactor|architecture|restructur|modular|decouple|abstract)\b"
CODE_SPAN = r"```|`[^`]+`"
FILE_PATH = r"(?:\.{0,2}/)?(?:[\w@.-]+/)+[\w@.-]+\.\w+"
NEGATION = r"(?i)\b(not|don't|doesn't|didn't|won't|can't|cannot|isn't|aren't|wasn't|weren't|no longer|instead of|rather than|replaced|switched from|stopped using|removed|deprecated|dropped|never)\b"
ACTION = r"(?i)\b(use|using|uses|prefer|prefers|run|runs|running|install|installed|deploy|deployed|enable|enabled|disable|disabled|add|added|remove|removed|switch|switched|migrate|migrated|choose|chose|set|configured)\b"
RULE_WORDS = r"(?i)\b(always|never|prefer|standard|convention|rule|guideline|best practice|must|should always|should never)\b"
THEORY_WORDS = r"(?i)\b(pattern|architecture|design|principle|paradigm|framework|methodology|approach|strategy|abstraction|interface|protocol)\b"
SPECIFIC = r"(?:\.{0,2}/)?(?:[\w@.-]+/)+[\w@.-]+\.\w+|line \d+|Traceback \(most recent call last\)|(?:Error|Exception):\s|0x[0-9a-fA-F]+"
SEMANTIC_TAGS = ("rule", "convention", "preference", "standard", "architecture", "principle", "guideline", "best-practice", "design-pattern")
NUMBER_VERSION = r"(?:^|[^\p{L}\p{N}_])(?:v?[0-9]+(?:\.[0-9]+)+|[0-9]{2,})(?:[^\p{L}\p{N}_]|$)"
CAMEL_NAME = r"(?:^|[^\p{L}\p{N}_])[A-Z][a-z]+(?:[A-Z][a-z]+)+(?:[^\p{L}\p{N}_]|$)"
ERROR_NAME = r"\b\w*(?:Error|Exception)\b"
CAPITAL_NAME = r"\b[A-Z]\w*\b"
DOTTED_NAME = r"\b\w+(?:\.\w+)+\b"

# (domain, words, entity types, decay multiplier)
DOMAINS = (
    ("code-patterns", r"(?i)\b(def|class|function|import|require|module|component|refactor|implement|method|interface|struct)\b", ("file", "function", "variable"), 1.0),
    ("decisions", r"(?i)\b(chose|decided|choosing|switched|migrated|opted|selected|replaced|preferred|picked|strategy|approach|trade-?off)\b", ("decision",), 1.5),
    ("errors", r"(?i)\b(error|exception|traceback|bug|crash|fix|resolved|broken|failed|failure|timeout|denied|workaround)\b", ("error", "solution"), 0.7),
    ("dependencies", r"(?i)\b(import|require|install|pip|npm|yarn|package|dependency|version|upgrade|downgrade|library|framework)\b", ("dependency",), 1.2),
)

# (pattern of an intention; group 1 is the phrase)
INTENTIONS = (
    r"(?i)\bTODO\b[:\s]*([^\n]+?)(?:\n|$)",
    r"(?i)\bFIXME\b[:\s]*([^\n]+?)(?:\n|$)",
    r"(?i)remember to\s+([^\n]+?)(?:\.|$)",
    r"(?i)don'?t forget\s+([^\n]+?)(?:\.|$)",
    r"(?i)next time\s+([^\n]+?)(?:\.|$)",
    r"(?i)when we\s+([^\n]+?)(?:\.|$)",
    r"(?i)later\s+([^\n]+?)(?:\.|$)",
    r"(?i)eventually\s+([^\n]+?)(?:\.|$)",
    r"(?i)should also\s+([^\n]+?)(?:\.|$)",
)

# (kind, fixed key or None for the normalised value, pattern of name and value, confidence)
ATTRIBUTES = (
    ("interest", None, r"(?i)\b([A-Z][a-z]+)\s+(?:likes?|loves?|enjoys?|prefers?)\s+([^\n]+?)(?:\.|,|$)", 0.7),
    ("trait", None, r"\b([A-Z][a-z]+)\s+is\s+([a-z]+)\b", 0.7),
    ("interest", "travel", r"(?i)\b([A-Z][a-z]+)\s+(?:went\s+to|visited|traveled\s+to|travelled\s+to)\s+([^\n]+?)(?:\.|,|$)", 0.6),
    ("career", None, r"(?i)\b([A-Z][a-z]+)\s+(?:works\s+as\s+(?:a\s+|an\s+)?|is\s+a(?:n)?\s+)([^\n]+?)(?:\.|,|$)", 0.7),
    ("opinion", None, r"(?i)\b([A-Z][a-z]+)\s+(?:believes?|thinks?)\s+([^\n]+?)(?:\.|,|$)", 0.6),
    ("goal", None, r"(?i)\b([A-Z][a-z]+)\s+(?:wants?\s+to|hopes?\s+to)\s+([^\n]+?)(?:\.|,|$)", 0.6),
    ("habit", None, r"(?i)\b([A-Z][a-z]+)\s+(?:always|usually|often)\s+([^\n]+?)(?:\.|,|$)", 0.6),
)
NOT_NAMES = (
    "The", "This", "That", "These", "Those", "There", "They", "Then", "What", "When", "Where", "Which", "While", "Who", "Why", "How",
    "Here", "His", "Her", "Its", "Our", "Your", "Their", "Some", "Many", "Most", "Each", "Every", "Any", "All", "Both", "Few",
    "She", "But", "And", "For", "Not", "Yet", "Also", "Just", "Very", "Really", "Always", "Usually", "Often", "Never",
    "Because", "Since", "After", "Before", "During", "Until",
)

STOP_WORDS = (
    "a", "an", "the", "is", "it", "in", "on", "at", "to", "of", "for", "and", "or", "but", "not", "with", "by", "from", "as",
    "be", "was", "were", "been", "are", "am", "do", "did", "does", "has", "had", "have", "will", "would", "could", "should", "may",
    "can", "this", "that", "these", "those", "what", "which", "who", "how", "when", "where", "why", "if", "then", "so", "no", "yes",
    "all", "any", "some", "my", "your", "its", "our", "their", "we", "he", "she", "they", "me", "him", "her", "us", "them",
    "use", "using", "used", "like", "just", "get", "got", "set", "make", "made", "let", "try", "need", "want", "know", "think",
    "code", "file", "thing", "stuff",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_M = "|".join(MONTHS)
# (kind, pattern; group 1 is the expression)
TIMES = (
    ("date", rf"(?i)\b(\d{{1,2}}\s+(?:{_M})\s+\d{{4}})\b"),
    ("month_year", rf"(?i)\b((?:{_M})\s+\d{{4}})\b"),
    ("iso", r"\b(\d{4}-\d{2}-\d{2})\b"),
    ("month", rf"(?i)\b({_M})\b"),
    ("relative", r"(?i)\b(yesterday|today|last\s+week|last\s+month|\d+\s+days?\s+ago|\d+\s+weeks?\s+ago|recently|earlier|previously|before|the\s+week\s+before|the\s+day\s+before|prior\s+to)\b"),
    ("session", r"(?i)\b(session[\s_]\d+|(?:first|second|third|last)\s+session|conversation\s+\d+)\b"),
    ("ordinal", rf"(?i)\b((?:before|after|during|in)\s+(?:{_M}))\b"),
)
CONFLICT_MARK = r"--- \[Agent: ([^\]]+)\] ---"

# Keywords that decide the kind of a search.
TEMPORAL_KEYS = ("yesterday", "today", "last week", "last month", "last session", "recently", "before", "after", "when", "during", "while", "since", "until", "earlier", "later", "previous", "next", "morning", "evening", "night", "ago", "back then")
CODE_KEYS = ("function", "class", "method", "variable", "import", "error", "bug", "fix", "refactor", "implement", "API", "endpoint", "database", "schema", "test", "deploy")
RELATION_KEYS = ("relationship", "connection", "related", "between", "link", "cause", "effect", "impact", "influence", "depend", "lead to", "result in")
QUESTION_WORDS = ("who", "what", "where", "when", "why", "how", "which", "whose", "whom")
MODAL_WORDS = ("would", "could", "might", "likely", "probably", "possibly")
# (question pattern, what follows group 1 in the statement)
STATEMENTS = (
    (r"(?i)^what\s+(?:is|are|was|were)\s+(.+?)\??$", " is"),
    (r"(?i)^what\s+(?:does|did|do)\s+(.+?)\??$", ""),
    (r"(?i)^who\s+(?:is|are|was|were)\s+(.+?)\??$", " is"),
    (r"(?i)^where\s+(?:is|are|was|were)\s+(.+?)\??$", " is located"),
    (r"(?i)^when\s+(?:did|does|do|was|were|is|are)\s+(.+?)\??$", ""),
    (r"(?i)^how\s+(?:does|did|do|is|are|was|were|can|could|should|would)\s+(.+?)\??$", ""),
    (r"(?i)^why\s+(?:does|did|do|is|are|was|were)\s+(.+?)\??$", " because"),
    (r"(?i)^(?:is|are|was|were)\s+(.+?)\??$", ""),
    (r"(?i)^(?:does|did|do)\s+(.+?)\??$", ""),
    (r"(?i)^(?:can|could|would|should)\s+(.+?)\??$", ""),
)

# Words that carry no content in a question, and words at which a compared option ends besides them.
QUERY_STOPS = (
    "who", "what", "where", "when", "why", "how", "which", "whose", "whom", "would", "could", "should", "does", "did", "is", "are",
    "was", "were", "do", "has", "have", "had", "can", "will", "the", "a", "an", "if", "not", "it", "in", "on", "at", "to", "of",
    "for", "and", "or", "but", "with", "by", "from", "as", "be", "this", "that", "so", "no", "yes", "my", "your", "its", "our",
    "their", "we", "he", "she", "they", "me", "him", "her", "us", "them", "about", "also", "likely", "probably", "possibly",
    "still", "more", "most", "very", "around", "what's", "whats", "interested", "going", "considered", "consider", "considering",
)
OPTION_STOPS = ("interest", "might", "less")
ARTICLES = ("a", "an", "the")
LEADING_WORDS = ("what", "when", "where", "who", "why", "how", "does", "did", "is", "are", "was", "were", "would", "could", "should", "do", "can", "will", "has", "have", "had")
CUE_PHRASES = (
    "personality trait", "personality traits", "what attributes", "political leaning", "financial status", "religious", "patriotic", "career",
    "job might", "degree", "interested in", "more interested", "enjoy the song", "bookshelf", "member of the lgbtq", "ally",
)
TOPICS = (
    ("national park", ("camping", "outdoors", "nature", "hiking")),
    ("theme park", ("rides", "amusement park")),
    ("dr. seuss", ("children's books", "kids books", "classic books")),
    ("bookshelf", ("books", "reading", "collects")),
    ("vivaldi", ("classical music", "orchestra", "composer")),
    ("four seasons", ("classical music", "orchestra", "composer")),
    ("patriotic", ("serve country", "military", "public service")),
    ("religious", ("faith", "church", "spiritual")),
    ("political leaning", ("lgbtq rights", "liberal", "progressive")),
    ("financial status", ("money", "wealth", "afford", "comfortable")),
    ("personality traits", ("thoughtful", "authentic", "driven", "caring")),
    ("attributes", ("thoughtful", "authentic", "driven", "caring")),
    ("ally", ("supportive", "accepting", "rights")),
    ("member of the lgbtq", ("lgbtq", "transgender", "queer")),
)
# (pattern of a question, the statement that it asks to confirm)
CONFIRMED = (
    (r"(?i)^would\s+(\w+)\s+prefer\s+(.*)", " prefers "),
    (r"(?i)^does\s+(\w+)\s+enjoy\s+(.*)", " enjoys "),
    (r"(?i)^is\s+(\w+)\s+(?:a\s+)?(.*)", " is "),
    (r"(?i)^what\s+are\s+(\w+)'s\s+(.*)", " has "),
)
CONFIRM_LEAD = r"(?i)^(?:would|does|is|can|did|has|could|might)\s+"
SPEAKER = r"^([A-Z][a-z]+) said:\s*(.+)$"
# (pattern of a line: subject and object, verb of the fact)
FACTS = (
    (r"(?i)^([A-Z][a-z]+)\s+(?:really\s+|also\s+|just\s+|always\s+|often\s+|never\s+|still\s+|definitely\s+|usually\s+|sometimes\s+)?(?:loves|likes|enjoys|prefers|adores)\s+([^.!?\n]+)", " enjoys "),
    (r"(?i)^([A-Z][a-z]+)\s+is\s+(?:a fan of|into|keen on|interested in|passionate about)\s+([^.!?\n]+)", " is interested in "),
    (r"(?i)^([A-Z][a-z]+)\s+(?:wants|hopes|plans|dreams)\s+to\s+([^.!?\n]+)", " wants to "),
)
CLAUSE_END = r"(?s)\b(?:because|since|while|but|and|so|though)\b.*$"
# (words in what one speaker says, what they tell about the other)
PRAISE = (
    (r"you're so thoughtful|you are so thoughtful", " is thoughtful"),
    (r"your drive|drive to help", " is driven"),
    (r"being real|authentic", " is authentic"),
    (r"helping others|caring heart", " is caring"),
)
# (words of a line, words that exclude, what they tell about its subject)
HINTS = (
    (r"camping|campfire|meteor shower|hiking|forest|mountains", "", " enjoys outdoor activities, nature, camping, hiking, and national parks"),
    (r"nature|outdoors", r"camping|campfire|meteor shower|hiking|forest|mountains", " enjoys outdoor activities and nature"),
    (r"classical|bach|mozart|orchestra|symphony", "", " enjoys classical music and composers like Vivaldi"),
    (r"(?s)dr\. seuss|children's books|kids' books|kids books|classic.*book|book.*classic", "", " collects children's books and classic books"),
    (r"counseling|mental health", "", " is interested in counseling and mental health careers"),
    (r"volunteer|shelter|make a difference|help others|community service", "", " values helping others and community service"),
    (r"church|faith|cross necklace|spiritual|prayer", "", " has religious or spiritual beliefs"),
    (r"serve my country|join the military|running for office|policymaking|veteran", "", " is patriotic and interested in public service"),
    (r"adoption|have a family|having a family|kids who need it", "", " wants a family and cares about children"),
    (r"lgbtq|transgender|rights|acceptance|supportive community", "", " supports LGBTQ rights and acceptance"),
)

# Code, errors and decisions named in a text.
IMPORTED = r"(?:^|\n)\s*import\s+([\w.]+)"
FROM_IMPORT = r"(?:^|\n)\s*from\s+([\w.]+)\s+import\s+([\w, ]+)"
DEFINED = r"\bdef\s+(\w+)\s*\("
CALLED = r"\b(\w+)\s*\("
ERROR_FIXED = r"(?i)(?:fix(?:ed)?|resolv(?:ed|e|ing)|solved?)\s+(?:the\s+)?(\w*(?:Error|Exception|error|bug|issue))"
DECIDED = r"(?i)decided\s+to\s+use\s+(\w+(?:\s+\w+){0,2})\s+instead\s+of\s+(\w+(?:\s+\w+){0,2})"
CODE_SUFFIX = r"\.(?:py|js|ts|tsx|jsx|go|rs|java|c|h|cpp|rb|toml|yaml|yml|json|md|txt|cfg|ini|sh|css|html|sql|proto)$"
TRACEBACK = r"(Traceback) \(most recent call last\)"
FUNCTION_WORD = r"\bfunction\s+(\w+)"
REQUIRED = r"require\(['\"]([^'\"]+)['\"]\)"
DECISION_SPAN = r"(?i)((?:decided|chose|choosing|using|switched to|migrated to|replaced with)\s+\w+(?:\s+\w+){0,3})"
