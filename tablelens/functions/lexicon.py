"""Sentiment lexicon and stop words.

Fixed values: these word lists must equal the reference behaviour word for
word; they are stated here as plain lists in their natural order.
"""

POSITIVE = [
    "good", "great", "excellent", "amazing", "love", "loved", "awesome", "perfect",
    "happy", "satisfied", "best", "helpful", "thanks", "thank", "recommend",
    "recommended", "fast", "easy", "useful", "superb", "wonderful", "friendly",
    "positive", "quality", "brilliant", "delighted", "impressive", "fantastic",
    "like", "liked", "comfortable", "reliable", "smooth", "beautiful", "nice",
    "pleased", "great", "enjoyed", "value", "clear", "quick", "responsive", "nice",
]
NEGATIVE = [
    "bad", "terrible", "worst", "awful", "hate", "hated", "poor", "slow", "worse",
    "disappointed", "disappointing", "fail", "failed", "broken", "problem",
    "problems", "issue", "issues", "bad", "unhappy", "angry", "frustrated",
    "frustrating", "negative", "useless", "difficult", "unhelpful", "waste",
    "horrible", "rude", "late", "delayed", "error", "error", "bugs", "buggy",
    "complaint", "cancelled", "refund", "unclear", "confusing", "annoying",
    "scam", "overpriced", "unreliable", "garbage", "crappy", "disgusting", "drop",
    "never", "not", "no", "wrong", "cheap", "damaged", "missing", "ghost",
]
STRONG_NEGATIVE = ["terrible", "awful", "worst", "horrible", "hate", "hated", "fail",
                   "failed", "broken", "frustrated", "refund", "scam", "disgusting"]
# words removed from the negative list as ambiguous
NEGATIVE_REMOVED = ["no", "not", "bad"]
NEGATORS = ["not", "no", "never", "n't", "hardly", "barely"]
INTENSIFIERS = ["very", "really", "so", "extremely", "totally", "absolutely"]
NEGATION_FACTOR = 0.7
INTENSIFIER_FACTOR = 1.5
STRONG_FACTOR = 1.8
POSITIVE_CUT = 0.05
NEGATIVE_CUT = -0.05
TOKEN_PATTERN = "[a-z']+"

STOPWORDS = [
    "the", "and", "for", "with", "this", "that", "from", "are", "was", "were",
    "has", "have", "had", "will", "would", "can", "could", "should", "their",
    "they", "them", "then", "than", "when", "where", "what", "which", "while",
    "who", "whose", "your", "yours", "you", "our", "ours", "not", "but", "all",
    "any", "because", "been", "being", "both", "each", "few", "more", "most",
    "other", "some", "such", "only", "own", "same", "so", "too", "very", "just",
    "about", "above", "after", "again", "against", "before", "between", "through",
    "into", "onto", "been", "over", "under", "again", "there", "here", "also",
    "it", "its", "i", "we", "they", "be", "is", "do", "does", "got", "get", "one",
    "two", "on", "in", "at", "by", "of", "to", "as", "an",
]


def unique(words):
    seen, out = set(), []
    for w in words:
        if w not in seen:
            seen.add(w)
            out.append(w)
    return out


POS_WORDS = unique(POSITIVE)
NEG_WORDS = [w for w in unique(NEGATIVE) if w not in NEGATIVE_REMOVED]
STOP_WORDS = unique(STOPWORDS)
