"""The cue patterns, word lists and limits that answers must agree with, in one place.

Patterns are written for Unicode character classes; `unicode` puts Java's flag before them.
"""

from __future__ import annotations


def unicode(pattern: str, flags: str = "") -> str:
    """The pattern with Unicode classes and word boundaries, as text rules are meant."""
    return f"(?U{flags}){pattern}"


# Category cues, in the order in which they are tried.
CATEGORIES = ("sentiment", "summarization", "ner", "debug", "codegen", "math", "logic", "factual")
CODE_HINT = r"```|\bdef \w+|\bfunction\b|\breturn\b|\bclass \w+\(|=>|\bprintln\b|\bconsole\.log\b"
SENTIMENT = r"\bsentiment\b|\bclassify\b[^.?!]{0,80}\b(review|tweet|comment|feedback|text|statement)\b"
SUMMARY = r"\bsummar(y|ize|ise|ies|izing|ising|ization|isation)\b|\btl;?dr\b|\bcondense\b"
ENTITIES = r"\bentit(y|ies)\b|\bnamed entit|\bextract\b[^.?!]{0,80}\b(people|persons?|organi[sz]ations?|locations?|dates?|names)\b"
DEBUG = r"\bbug(s|gy)?\b|\bdebug\b|\bfix(es|ed|ing)?\b|\bincorrect(ly)?\b|\bdoesn'?t work\b|\bnot work(ing)?\b|\berror\b|\bwrong (output|result|answer)\b"
CODEGEN = r"\b(write|create|implement|develop|code|build)\b[^.?!]{0,60}\b(function|program|script|method|class|snippet|code)\b|\bfunction that\b|\bprogram that\b"
CODE_VERB = r"\bwrite\b|\bimplement\b|\bcomplete\b"
MATH = (
    r"\bhow (many|much|far|long|old)\b|\bcalculate\b|\bcompute\b|\bwhat is \d|\bwhat'?s \d|\bpercent(age)?\b|%|\bsum\b|\bproduct of\b|\bdifference\b|\bremain(s|ing)?\b|\bleft over\b"
    r"|\btotal\b|\baverage\b|\bper (hour|day|week|month|item|unit)\b|\bcost(s)?\b|\bprice\b|\bdiscount\b|\binterest\b|\bspeed\b|\bdistance\b|\barea\b|\bperimeter\b|\bvolume\b"
)
NUMBER_WORD = r"\b(twice|half|double|triple|one|two|three|four|five|six|seven|eight|nine|ten|dozen)\b"
LOGIC = (
    r"\beach (own|owns|has|have|like|likes|wear|wears|drink|drinks|play|plays)\b|\bdifferent (pet|color|colour|car|house|drink|sport|hobby|job|instrument|fruit)\b"
    r"|\bwho (owns|has|likes|plays|wears|drinks|lives|sits)\b|\balways (lies|tells the truth)\b|\bliar\b|\btruth-?teller\b|\bif and only if\b|\bimplies\b|\bdeduce\b|\blogic puzzle\b"
    r"|\b(sits|seated|stands) (next to|between|left of|right of)\b|\bcan we conclude\b|\bdoes it follow\b|\bnecessarily true\b|\bfinished (before|after)\b|\bwho (finished|came|arrived)\b"
    r"|\btaller than\b|\bolder than\b|\bfaster than\b.*\bwho\b"
)
# Answers.
NUMBER = r"-?\$?\d[\d,]*\.?\d*"
HEDGE = r"\bas an ai\b|\bi (do not|don't) know\b|\bi cannot\b|\bi'm not sure\b|\bunable to\b"
SENTIMENT_LABEL = r"\b(positive|negative|neutral|mixed)\b"
ENTITY_LINE = r"^.+\s[-–—]\s*(person|organi[sz]ation|location|date)\s*$"
AGREE_STOP = "the a an is are was were of in on at to and or it its by with for as that this near located also which".split()
AGREE_SHARE = 0.75
EXPRESSION_LINE = r"^\s*\**Expression\**\s*[:=]"
BASELINE_HARD = r"```|\b(debug|algorithm|prove|puzzle|edge cases?|multi-step)\b"
BASELINE_MENTION = r"\b(local[\s_-]*ok|escalate|easy|hard)\b"
PLACEHOLDER = r"your[_-]|replace[_-]?me|example|placeholder"
# The feature tokenizer and hash.
FEATURE_TOKEN, FEATURE_TOKENS = r"[a-z0-9_]+|[^\sA-Za-z0-9_]", 256
FNV_START, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295
# Costs and limits.
LOCAL_CAPS = {"sentiment": 60, "ner": 120, "math": 200, "summarization": 80, "factual": 110, "logic": 200, "debug": 400, "codegen": 400}
REMOTE_CAPS = {"sentiment": 200, "ner": 400, "math": 300, "summarization": 500, "factual": 400, "logic": 300, "debug": 500, "codegen": 500}
RETRY_HEADROOM = {"math": 1.7, "debug": 1.9, "codegen": 1.9, "summarization": 1.6, "logic": 1.1, "sentiment": 1.1, "ner": 1.1, "factual": 1.1}
PREFILL_RATIO, TASK_OVERHEAD_S, DEFAULT_CAP, DEFAULT_HEADROOM, DEFAULT_REMOTE_CAP = 6.0, 1.5, 200, 1.2, 300
TRUST_ACC, ALWAYS_ESCALATE_ACC, MIN_UNVERIFIED, WILSON_Z = 0.90, 0.70, 10, 1.96
REACTIVE_DEADLINE_S, MIN_REMOTE_WINDOW_S, MIN_SLOW_RECALL = 25.0, 8.0, 0.90
ROUTE_NONE = 1.01
FALLBACK_ANSWER = "Unable to fully determine the answer within the time limit."
SIMILAR_TEMPLATE, SEQUENCE_ESCAPE = 0.82, 0.94
# Prompts whose wording implies tests, tried in order; (pattern, [(arguments, expected)]).
SPEC_TESTS = [
    (r"second[- ]largest", '[{"args":[[1,2,2,3]],"expected":2},{"args":[[5,1,4]],"expected":4},{"args":[[7,7,3]],"expected":3}]'),
    (r"\bfactorial\b", '[{"args":[5],"expected":120},{"args":[0],"expected":1}]'),
    (r"\bpalindrome\b", '[{"args":["racecar"],"expected":true},{"args":["hello"],"expected":false}]'),
    (r"reverse[sd]? (a |the )?string", '[{"args":["abc"],"expected":"cba"}]'),
    (r"\b(max(imum)?|largest) (value |number |element )?(of|in|from) (a |the )?list", '[{"args":[[3,9,1]],"expected":9},{"args":[[-5,-2,-9]],"expected":-2}]'),
    (r"\b(min(imum)?|smallest) (value |number |element )?(of|in|from) (a |the )?list", '[{"args":[[3,9,1]],"expected":1}]'),
    (r"sum of (all )?(the )?even", '[{"args":[[1,2,3,4]],"expected":6}]'),
    (r"sum of (all )?(the )?odd", '[{"args":[[1,2,3,4]],"expected":4}]'),
    (r"count[s]? (the )?(number of )?vowels", '[{"args":["hello"],"expected":2}]'),
    (r"\b(is )?prime\b", '[{"args":[7],"expected":true},{"args":[8],"expected":false}]'),
    (r"\bfizz ?buzz\b", "[]"),
]
# Names of models by likely size, and of larger ones.
SMALL_MODEL = r"(^|[^0-9])(0\.5|1|1\.5|2|3|4)b\b|mini|small|tiny|nano|flash|lite"
MID_MODEL = r"(^|[^0-9])(7|8|9|11|12|13|14)b\b"
LARGE_HINTS = ("pro", "k2", "large", "70b", "405b")
# How assignment puzzles list their items and people, what clues and the question look like.
PUZZLE_ITEMS = r"different \w+s?\s*[:\-]\s*([^.?!]+)"
PUZZLE_SEPARATOR = r",| and | or "
PUZZLE_ARTICLE = r"^(a|an|the) "
PUZZLE_NAME = r"\b([A-Z][a-z]+)\b"
PUZZLE_NOT_NAMES = frozenset({"Three", "Four", "Five", "Two", "Six", "The", "A", "An", "If", "Who"})
PUZZLE_HAS = r"\b([A-Z][a-z]+)\b (?:owns|has|likes|plays|drinks|wears|got|chose|picked)\s*(?:the |a |an )?(\w+)"
PUZZLE_LACKS = r"\b([A-Z][a-z]+)\b\s+(?:does\s*not|doesn[’']t|do\s*not|did\s*not|never|is\s*not|isn[’']t)\s+(?:own|owns|have|has|like|likes|play|plays|drink|drinks|wear|wears|got|choose|pick)?\s*(?:the |a |an )?(\w+)"
PUZZLE_ASKS = r"\bwho (?:owns|has|likes|plays|drinks|wears|got|chose|picked)\s*(?:the |a |an )?(\w+)"
PUZZLE_SIZES = range(2, 7)
# What code tests allow.
CODE_SECONDS, CODE_TOLERANCE = 5.0, 1e-6
# Abbreviations that end no sentence, and what a summary is asked for.
ABBREVIATIONS = r"\b(e\.g|i\.e|etc|vs|Mr|Mrs|Ms|Dr|St)\."
DECIMAL = r"\d+\.\d+"
SENTENCE_END = r"[.!?]+(?:\s|$)"
SENTENCES_EXACT = r"exactly (one|two|three|1|2|3) sentences?"
SENTENCE_SINGLE = r"\bin (a|one) (single )?sentence\b|\bone-sentence\b|\bsingle sentence\b"
WORDS_LIMIT = r"(no more than|at most|maximum(?: of)?|under|fewer than|less than|within|in) (\d+) words"
WORDS_EXACT = r"exactly (\d+) words"
# What is masked in prompts, and wording that varies between siblings of a template.
# Fields that may name a record's template, the first that does so.
TEMPLATE_FIELDS = ("template_id", "template_group", "prompt_template", "template")
MASKED_NUMBER = r"(?<!\w)(?:[$£€]\s*)?[+-]?(?:\d+(?:[.,]\d+)*)(?:%|st|nd|rd|th)?(?!\w)"
MASKED_NAME = r"\b(?:[A-Z][A-Za-z'’-]*|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-z'’-]*|[A-Z]{2,}))*\b"
CODEGEN_OPENING = r"(?i)^(?:write|implement|create)\s+(?:a\s+)?python\s+function\s+(?:that|which)\s+"
DEBUG_BODY = r"(?s)(\bdef\s+[A-Za-z_]\w*\s*\(.*)"
DEBUG_CLOSING = r"(?is)\s+(?:find\s+and\s+fix\s+it|identify\s+the\s+bug.*)$"
SUMMARY_OPENING = r"(?is)^summarize\s+the\s+following\s+paragraph\b.*?:\s*"
# Names of parameters by which a smoke test picks its argument, tried in order.
SMOKE_ARGUMENTS = [("num|lst|list|arr|items|values|data|seq", '[{"args":[[3,1,2]]}]'), ("s$|str|text|word|sentence", '[{"args":["hello"]}]'), ("n$|num|count|x$|k$", '[{"args":[5]}]')]
# Answers of the run.
PATHS = ("local-verified", "local-unverified", "escalated", "fallback")
RETRY_LEFT_S, EMERGENCY_LEFT_S = 4.0, 10.0
