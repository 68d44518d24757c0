"""Term lists, category tables and patterns of the built-in classifiers. All of these are fixed values."""

# Toxicity terms (substring, lower case).
TOXIC = """hate stupid idiot dumb kill die worst terrible awful sucks garbage trash shit fuck damn hell asshole bastard
bitch""".split()
# Sentiment terms.
POSITIVE = "good great excellent love amazing wonderful happy fantastic awesome best".split()
NEGATIVE = "bad terrible awful hate horrible worst sad angry disappointed poor".split()
# Further whole-word terms of the token classifier.
SEQUENCE_POSITIVE = [*POSITIVE, "exceeded"]
SEQUENCE_NEGATIVE = [*NEGATIVE, "never"]
PROFANITY = "fuck shit bitch asshole".split()

# Personal data, in the order in which it is looked for.
PII = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
]

# Prompt injection, most severe first: label, score, terms.
INJECTION = [
    ("jailbreak", 0.98, [
        "dan mode", "dan:", "jailbreak", "jailbroken", "developer mode", "dev mode", "god mode", "unrestricted mode", "no restrictions",
        "without restrictions", "bypass your", "bypass all", "disable your", "disable all safety", "ignore safety", "remove all filters",
        "hypothetically speaking", "for educational purposes", "in a fictional scenario",
    ]),
    ("instruction_override", 0.95, [
        "ignore previous instructions", "ignore all previous instructions", "ignore your instructions", "ignore the above",
        "disregard previous", "disregard your system", "disregard all prior", "forget your instructions", "forget everything above",
        "forget your previous", "override your instructions", "new instructions:", "your new instructions are",
        "instead, do the following", "do not follow your",
    ]),
    ("system_extraction", 0.90, [
        "repeat your instructions", "repeat your system", "repeat the above", "show your instructions", "show your system prompt",
        "print your instructions", "print your system", "what are your instructions", "what is your system prompt",
        "tell me your instructions", "reveal your instructions", "reveal your system", "display your prompt",
        "output your instructions", "echo your system",
    ]),
    ("role_switching", 0.85, [
        "you are now", "you're now", "act as", "act like", "pretend to be", "pretend you're", "pretend you are", "roleplay as",
        "play the role of", "assume the role", "from now on you are", "from now on, you are", "imagine you are", "imagine you're",
        "behave as", "respond as", "speak as",
    ]),
    ("delimiter_attack", 0.80, [
        "```system", "[system]", "<|system|>", "<<SYS>>", "<</SYS>>", "### system", "## system:", "### instruction", "---\nsystem",
        "end of user input", "begin system prompt", "[INST]", "[/INST]", "<s>", "</s>",
    ]),
]

# Financial advice, highest risk first: label, score, reference, terms.
ADVICE = [
    ("prohibited_claim", 0.98, "FCA COBS 4.2 - Misleading", [
        "guaranteed return", "guaranteed returns", "guaranteed profit", "guaranteed profits", "guaranteed income", "risk-free",
        "risk free", "no risk", "zero risk", "cannot lose", "can't lose", "will definitely", "certain to increase",
        "certain to grow", "double your money", "get rich quick", "easy money", "100% safe", "completely safe investment",
    ]),
    ("suitability", 0.90, "FCA COBS 9A.2", [
        "is suitable for you", "is right for you", "is perfect for you", "is ideal for you", "matches your needs",
        "meets your requirements", "based on your situation", "based on your circumstances", "given your risk profile",
        "given your financial situation", "for someone in your position", "for your specific needs", "this product suits you",
        "this investment suits you", "recommend this for you", "you should choose this", "best option for you",
        "perfect fit for your",
    ]),
    ("personal_advice", 0.75, "FCA COBS 9A", [
        "you should invest", "you should buy", "you should sell", "you should switch", "you need to invest", "i recommend",
        "i would recommend", "my recommendation", "my advice would be", "my advice is", "i suggest you", "i advise you",
        "you must invest", "you must buy", "open an account with", "transfer your pension to", "consolidate your pensions",
        "move your isa to", "switch your provider to", "put your money in", "invest in this",
    ]),
    ("guidance", 0.30, "FCA COBS 4", [
        "generally speaking", "as a general rule", "typically", "in general", "many people find", "some investors prefer",
        "options include", "you might consider", "you could consider", "one option is", "another option is", "it may be worth",
        "it might be worth", "you may want to", "factors to consider", "things to think about", "questions to ask yourself",
        "speak to a financial adviser", "consult a financial adviser", "seek professional advice",
    ]),
    ("information", 0.10, None, [
        "an isa is", "a pension is", "a sipp is", "isas are", "pensions are", "stocks and shares", "the difference between",
        "how does a", "what is a", "defined as", "this means that", "for example", "historically", "tax rules", "hmrc allows",
        "the annual allowance", "contribution limits", "tax relief", "capital gains tax", "inheritance tax",
    ]),
]

# The demo evaluator's patterns and words.
DEMO_PII = [
    ("ssn", r"\d{3}-\d{2}-\d{4}"),
    ("credit_card", r"\d{4}\s?\d{4}\s?\d{4}\s?\d{4}"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"\(\d{3}\)\s?\d{3}-\d{4}"),
]
DEMO_INJECTION = [
    r"(?i)ignore\s+(all\s+)?(previous|prior)\s+instructions?",
    r"(?i)disregard\s+(the\s+)?(above|previous)",
    r"(?i)forget\s+(what|everything)",
    r"(?i)system\s*:\s*override",
    r"(?i)\[?admin\s*mode\]?",
]
DEMO_TOXIC = "stupid idiot moron dumb incompetent worthless garbage trash fool pathetic".split()
DEMO_ADVICE = [
    r"(?i)you\s+should\s+(definitely\s+)?invest",
    r"(?i)i\s+(recommend|advise)\s+(you\s+)?(put|invest|buy)",
    r"(?i)buy\s+\w+\s+stock",
    r"(?i)guaranteed\s+to\s+(go\s+up|increase|profit)",
]

# Latency budget by tier, microseconds.
TIER_BUDGET = {"A": 2000, "B": 5000, "C": 10000}
# Tier by built-in classifier.
TIERS = {"pattern": "A", "pii": "A", "sentiment": "A", "prompt-injection": "A", "financial-advice": "A", "readability": "A", "toxicity": "B", "sequence": "B", "sentence-transformer": "C"}
